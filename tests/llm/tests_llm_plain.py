"""Plain versions of operators for small inputs."""

import re

import numpy as np

SOLID = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {code: code + 32 for code in range(65, 91)}


def shingles(text, n=5):
    """The distinct runs of `n` words; of fewer words the whole."""
    words = SOLID.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def near_components(rows, percent):
    """The component of each (doc_id, text), all pairs compared; None without an id."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if None in (rows[i][0], rows[j][0]) or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[top(i)] = min(smallest.get(top(i), doc_id), doc_id)
    return [None if doc_id is None else smallest[top(i)] for i, (doc_id, _) in enumerate(rows)]


BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def licence_places(text):
    """(n_words, n_base, first_word, last_word, base_labels) of a text, word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    found = [
        (at, label)
        for phrase, label in BASE_PHRASES.items()
        for at in range(len(words))
        if words[at : at + len(phrase.split())] == phrase.split()
    ]
    places = [at for at, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(places, default=None), max(places, default=None), labels


def bytes_left(rows, n=50):
    """What is left of each (doc_id, text) without strings that start in an earlier document."""
    texts, owners, out = [(doc_id, (text or "").encode()) for doc_id, text in rows], {}, []
    for doc_id, text in texts:
        if doc_id is not None:
            for at in range(len(text) - n + 1):
                own = text[at : at + n]
                owners[own] = min(owners.get(own, doc_id), doc_id)
    for doc_id, text in texts:
        gone = np.zeros(len(text), bool)
        if doc_id is not None:
            for at in range(len(text) - n + 1):
                if owners[text[at : at + n]] < doc_id:
                    gone[at : at + n] = True
        out.append(bytes(np.frombuffer(text, np.uint8)[~gone]))
    return out
