"""Divergence audit, token counts and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from plyforge.llm import divergence, middle, tokencounts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, _id int, _text string, n int, term string"


def frame(spark, rows):
    return spark.createDataFrame([(*row, 7, "other", 8, "more") for row in rows], SCHEMA)


# Divergence


def low(text):
    return text.translate({code: code + 32 for code in range(65, 91)})


def plain_audit(rows, least, leading):
    docs = [(lang or "", source or "", TERM.findall(low(text or ""))) for _, text, lang, source in rows]
    held, counts, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        held.update({(lang, word) for word in words})
        counts.update((lang, source, word) for word in words)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(word for (own, word), n in held.items() if own == lang and n >= least)

        def shares(names):
            n = {word: sum(counts[lang, name, word] for name in names) for word in kept}
            total = sum(n.values()) + 2 * len(kept)
            return n, {word: 1 + 10**9 * (n[word] + 2) // total for word in kept}

        gap = lambda p, q: (p - q) ** 2 // (p + q)
        whole = shares(sources)[1]
        for source in sources:
            n, p = shares([source])
            parts = {"pair": [], "term": []}
            for other in sources - {source}:
                q = shares([other])[1]
                parts["pair"].append((-sum(gap(p[w], q[w]) for w in kept), other.encode(), other))
            for w in kept:
                if n[w] and p[w] > whole[w]:
                    parts["term"].append((-gap(p[w], whole[w]), w.encode(), w))
            for part, items in parts.items():
                for rank, (value, _, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= leading:
                        out.add((lang, source, part, item, -value, rank))
    return out


def test_audit_equals_a_plain_count(spark):
    small = {"block_terms": 7, "tile_terms": 16, "tile_sources": 2}
    rng = random.Random(3)
    words = ["".join(rng.choice("abcAé日") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = [
        (i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de"]), f"s{rng.randint(0, 5)}")
        for i in range(80)
    ]
    rows += [(None, None, None, None), (1, "a1b A_b", None, "x"), (1, "", "en", "quiet"), (2, "only here", "fr", "one")]
    rows += [(3, words[0], "de", "s1")] * 4 + [(4, "abcabcabcabcabc " * 3000, "en", "s2")]
    for least, size in ((3, 1 << 20), (2, 300)):
        found = divergence.audit(frame(spark, rows), least, 4, pass_bytes=size, **small).collect()
        assert len(found) == len(set(found))
        assert {tuple(row) for row in found} == plain_audit(rows, least, 4)


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    none = divergence.audit(frame(spark, [(1, "x", "en", "a"), (2, None, "en", "b")]))
    assert sorted(tuple(r) for r in none.collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_transducer_is_minimal_and_keeps_places():
    rng = random.Random(5)
    terms = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    built = divergence.Transducer.of(terms)
    data = b" ".join(terms) + b" aaaaaaaa zz"
    words = [(m.start(), len(m.group())) for m in re.finditer(rb"\S+", data)]
    at, sizes = (np.array(column) for column in zip(*words))
    found = built.places(np.frombuffer(data, np.uint8), at, sizes).tolist()
    assert found == [*range(len(terms)), -1, -1]
    assert [built.term(i) for i in range(len(terms))] == terms
    tails = {frozenset(t[i:] for t in terms if t[:i] == own[:i]) for own in terms for i in range(len(own) + 1)}
    assert len(built.final) == len(tails)  # one state for each set of endings


def test_shares_of_huge_counts_are_exact(spark):
    n = 9 * 10**17
    row = spark.createDataFrame([(n, 2 * n, 5)], "n long, total long, terms long")
    assert row.select(divergence.share("n", "total", "terms")).first()[0] == 1 + 10**9 * (n + 2) // (2 * n + 10)


# Token counts


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path(tokencounts.MODEL)
    return sentencepiece.SentencePieceProcessor(model_file=path)


def odd_texts():
    rng = random.Random(8)
    parts = [" ", "  ", "a", "the", "ing", "\n", "0", "é", "日本", "😀", "▁", "==", "--", "....", "\t", "er", "\0", "͸"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(600)]
    return texts + ["", " ", "<s></s><unk><0x0A>", "a" * 3000, " " * 2000, "ab" * 900, "the end " * 4000]


def test_counts_equal_the_library(spark, library):
    texts = odd_texts()
    rows = [(i, text, "", "") for i, text in enumerate(texts)] + [(None, None, "", ""), (1, texts[1], "", "")]
    found = tokencounts.count_tokens(frame(spark, rows), limit=40)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for doc_id, text, _, _ in rows:
        n = len(library.encode(text or "", num_threads=1))
        want.append((doc_id, len((text or "").encode()), n, n > 40))
    order = lambda row: (row[0] is not None, row)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)
    assert tokencounts.count_tokens(frame(spark, [])).count() == 0


def test_every_piece_and_couples_of_pieces(library):
    vocabulary, rng = tokencounts.model(tokencounts.MODEL), random.Random(9)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = pieces[::7] + ["".join(rng.choices(pieces, k=9)) for _ in range(3000)]
    texts += ["".join(rng.choices(pieces[:300], k=20)).replace(" ", "") for _ in range(2000)]
    found = tokencounts.row_counts(vocabulary, pa.array(texts))
    assert found.tolist() == [len(ids) for ids in library.encode(texts, num_threads=1)]


def test_long_texts_are_read_in_windows(library):
    vocabulary = tokencounts.model(tokencounts.MODEL)
    for text in ["".join(odd_texts()), " " * 999 + "x▁ y", "é" * 500, "ab" * 700]:
        assert tokencounts.row_counts(vocabulary, pa.array([text]), 48).tolist() == [len(library.encode(text))]


# Fill in the middle


def plain_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    head, mid, tail = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(head), len(mid), f"<S>{tail}<P>{head}<M>{mid}"
    return doc_id, len(units), "psm", len(head), len(mid), f"<P>{head}<S>{tail}<M>{mid}"


def middle_texts():
    rng = random.Random(4)
    passage = " ".join(rng.choice(["alpha", "été", "日本", str(rng.random())]) for _ in range(4000))
    texts = [passage, "before " + passage, passage + "\n after", passage[500:], passage[7:] + " "]
    texts += ["", None, " ", "\t\n ", "a", " a", "a ", "<P>", "a <M> b", "x <S", "P> <", "x" * 150_000, "é" * 90_000]
    texts += [" " * 140_000, "a b " * 30_000]
    texts += ["".join(rng.choice([" ", "\n", "w", "é", "日本", " v ", "<", "S>"]) for _ in range(rng.randint(0, 900))) for _ in range(150)]
    return texts


def test_middle_equals_a_plain_cut(spark):
    rows = [(i, text, "", "") for i, text in enumerate(middle_texts() * 2)] + [(None, "a b c", "", "")]
    made = middle.fill_in_middle(frame(spark, rows))
    found = made.withColumn("back", middle.restored(made["output"], made["form"])).collect()
    key = lambda row: (row[0] is not None, row[0])
    got = sorted((tuple(row)[:-1] for row in found), key=key)
    assert got == sorted((plain_middle(doc_id, text) for doc_id, text, _, _ in rows), key=key)
    texts = {row[0]: row[1] or "" for row in rows}
    assert all(row["back"] == texts[row["doc_id"]] for row in found)
    assert {row["form"] for row in found} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(frame(spark, [])).count() == 0


def test_equal_passages_share_chunks():
    cache = middle.Chunks()
    for text in middle_texts()[:5]:
        data = np.frombuffer(text.encode(), np.uint8)
        ends = middle.chunk_ends(data, np.array([0, len(data)]))
        starts = np.concatenate([[0], ends[:-1]])
        whole = middle.Text(data, starts, ends, cache)
        for k in range(0, whole.n + 1, 97):
            head = "".join(UNIT.findall(text)[:k])
            assert whole.after(k) == (len(head.encode()), len(head))
    assert cache.hits > 20


def test_a_full_cache_changes_nothing():
    small, large = middle.Chunks(limit=2000), middle.Chunks()
    for text in middle_texts():
        data = np.frombuffer((text or "").encode(), np.uint8)
        if len(data):
            ends = middle.chunk_ends(data, np.array([0, len(data)]))
            starts = np.concatenate([[0], ends[:-1]])
            one, two = (middle.Text(data, starts, ends, cache) for cache in (small, large))
            assert one.n == two.n and one.after(one.n // 2) == two.after(two.n // 2)
