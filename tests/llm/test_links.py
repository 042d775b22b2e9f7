"""Operators that link rows: near-duplicate documents, vectors, passages, repeated bytes."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from plyforge.llm import embeddings, graph, minhash, passages, suffixes

SCHEMA = "doc_id long, text string, digest string, rep string"


def words(seed, n):
    draw = np.random.default_rng(seed)
    return ["".join(draw.choice(list("abcdefghijkl"), 6)) for _ in range(n)]


def edited(own, seed, n):
    own, draw = list(own), np.random.default_rng(seed)
    for at in draw.choice(len(own), n, replace=False):
        own[at] = f"edit{seed}x{at}"
    return own


def documents():
    rows = [(i, " ".join(words(i, 40 + i)), None, "x") for i in range(100, 140)]
    base = words(1, 300)
    rows += [(10 + i, " ".join(edited(base, i, i % 9)), "d", None) for i in range(40)]
    rows += [(60 + i, " ".join(base), "d", None) for i in range(5)]
    passage = " ".join(words(2, 70))
    rows += [(80 + i, f"{' '.join(words(200 + i, 60))} {passage} {' '.join(words(300 + i, 30))}", "", "") for i in range(6)]
    rows += [(1, "", "", ""), (2, None, "", ""), (3, "short one", "", ""), (4, "short  ONE", "", "")]
    rows += [(None, " ".join(base), "", ""), (5, "ab " * 300, "", ""), (6, "ab " * 200, "", "")]
    rows += [rows[0], (100, "another text under the same id " * 9, "", "")]
    rows += [(7, "é" * 60 + "ü" * 60, "", ""), (8, "x" + "é" * 60, "", "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (8, 8)]
    found = graph.components(spark.createDataFrame(chain, "a long, b long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 70: 50, 100: 50}
    assert graph.components(found.where("false").toDF("a", "b")).count() == 0


def near_brute(rows, percent):
    sets = minhash.shingle_sets(pa.array([r[1] for r in rows]))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if None in (rows[i][0], rows[j][0]) or not len(sets[i]) or not len(sets[j]):
                continue
            if minhash._alike(sets[i], sets[j], percent):
                root[top(i)] = top(j)
    smallest = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            smallest[top(i)] = min(smallest.get(top(i), row[0]), row[0])
    return sorted(
        (-1 if r[0] is None else r[0], len(sets[i]), -1 if r[0] is None else smallest[top(i)])
        for i, r in enumerate(rows)
    )


@pytest.mark.parametrize("percent, block", [(85, 512), (80, 7)])
def test_near_documents_equal_brute_force(docs, percent, block):
    found = minhash.near_duplicates(docs, percent=percent, block_rows=block).collect()
    null = lambda x: -1 if x is None else x
    got = sorted((null(r["doc_id"]), r["n_shingles"], null(r["component_id"])) for r in found)
    assert got == near_brute(documents(), percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_deduplicate_keeps_one_of_each(docs, spark):
    left = minhash.deduplicate(docs)
    ids = sorted(str(r[0]) for r in left.collect())
    assert left.columns == docs.columns
    assert ids.count("100") == 3 and "10" in ids and not {"61", "64", "4"} & set(ids) and "None" in ids
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_estimate_is_close():
    draw = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        size = 2000
        common = int(2 * size * share / (1 + share))
        pool = draw.integers(0, 2**63, 4 * size, dtype=np.uint64)
        one, two = np.unique(pool[:size]), np.unique(pool[size - common : 2 * size - common])
        found = minhash.registers([one, two])
        more, same = (found[0] > found[1]).sum(), (found[0] == found[1]).sum()
        guess = minhash.likely(
            np.array([more]), np.array([minhash.REGISTERS - more - same]), np.array([same]),
            float(len(one)), np.array([float(len(two))]),
        )
        assert abs(guess[0] - share) < 0.12
        merged = np.maximum(found[0], found[1])
        assert (merged == minhash.registers([np.union1d(one, two)])[0]).all()


def bytes_brute(rows):
    owners, out = {}, []
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for doc_id, text in texts:
        if doc_id is not None:
            for at in range(len(text) - 49):
                own = text[at : at + 50]
                owners[own] = min(owners.get(own, doc_id), doc_id)
    for doc_id, text in texts:
        gone = np.zeros(len(text), bool)
        if doc_id is not None:
            for at in range(len(text) - 49):
                if owners[text[at : at + 50]] < doc_id:
                    gone[at : at + 50] = True
        left = bytes(np.frombuffer(text, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((-1 if doc_id is None else doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bucket", [1 << 24, 3000])
def test_repeated_bytes_equal_brute_force(docs, bucket, monkeypatch):
    found = suffixes.summary(suffixes.repeated_bytes(docs, bucket_bytes=bucket))
    got = sorted(tuple(-1 if x is None else x for x in row) for row in found.collect())
    assert got == bytes_brute(documents())


def test_samples_cover_every_string(monkeypatch):
    draw = np.random.default_rng(1)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 300)
    rows = [bytes(draw.choice(list(b"ab"), n).astype(np.uint8)) for n in (0, 49, 50, 900)] + [b"a" * 500]
    data, bounds = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    owner, places = {}, set()
    for block in suffixes.samples(data, bounds):
        for place, first, last, key in zip(*(x.tolist() for x in block)):
            for at in range(first, last + 1):
                assert at not in places
                places.add(at)
                text = data[at : at + 50].tobytes()
                assert owner.setdefault(text, (place - at, key)) == (place - at, key)
    assert places == {p for a, b in zip(bounds, bounds[1:]) for p in range(a, b - 49)}


def test_cut_texts(docs):
    cut = suffixes.deduplicate(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    rows = {r["doc_id"]: r["text"] for r in cut.where("doc_id IN (64, 2, 10, 8)").collect()}
    assert rows[64] == "" and rows[2] is None and rows[8] == "x"
    assert suffixes.repeated_bytes(docs.where("false")).count() == 0


def test_passages(docs):
    found = passages.repeated_passages(docs).collect()
    linked = {r["doc_id"] for r in found}
    assert set(range(81, 86)) <= linked and set(range(61, 65)) <= linked and {6} <= linked
    assert not linked & {80, 10, 1, 2, 3, 4, 5, *range(101, 140)}
    assert {r["doc_id"] for r in found if r["other_doc_id"] == 80} == set(range(81, 86))
    for row in found:
        if 81 <= row["doc_id"] <= 85:
            assert 80 <= row["other_doc_id"] and row["n_words"] == 70 and row["first_word"] == 60
        assert row["other_doc_id"] < row["doc_id"] and row["similarity"] >= 0.8
    assert passages.repeated_passages(docs.where("false")).count() == 0


def test_every_exact_passage_is_covered(docs):
    """Each 50 words that an earlier document holds are inside a passage, for most of them."""
    texts = {r[0]: (r[1] or "").lower().split() for r in documents() if r[0] not in (None, 100)}
    first = {}
    for doc_id in sorted(texts):
        for at in range(len(texts[doc_id]) - 49):
            first.setdefault(tuple(texts[doc_id][at : at + 50]), doc_id)
    expected = {
        doc_id
        for doc_id, own in texts.items()
        if any(first[tuple(own[at : at + 50])] < doc_id for at in range(len(own) - 49))
    }
    linked = {r["doc_id"] for r in passages.repeated_passages(docs).collect()}
    assert expected <= linked


def test_passages_of_frequent_lines(spark):
    """Copies of 50 to 53 words, most of them in lines that earlier documents hold elsewhere."""
    lines = [words(5000 + i, 10) for i in range(40)]
    rows = [(i, " ".join(words(6000 + i, 30) + lines[i] + words(7000 + i, 30))) for i in range(40)]
    draw = np.random.default_rng(9)
    for n in range(100):
        a, b, c = (lines[i] for i in draw.choice(40, 3, replace=False))
        body = a + words(8000 + n, 7) + b + words(9000 + n, 7) + c + words(10000 + n, 6 + n % 4)
        rows += [(i, " ".join(words(20000 + i, 25) + body + words(30000 + i, 25))) for i in (1000 + n, 2000 + n)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {r["doc_id"] for r in found if r["other_doc_id"] == r["doc_id"] - 1000}
    assert len(linked) >= 98 and all(r["doc_id"] >= 2000 for r in found)


def test_all_places_of_the_other_document():
    passage = np.arange(100, 160, dtype=np.uint64)
    other = np.concatenate([passage[::7], np.arange(500, 560, dtype=np.uint64), passage])
    assert [x[:4] for x in passages.shared(passage, other)] == [(0, 60, 69, 129)]
    one = np.zeros(12000, np.uint64)
    assert passages.shared(one, one)[0][4] == 1


def test_refused_texts_have_no_passage():
    """Texts refused before they are compared in full are not alike in any two stretches of theirs."""
    draw, refused, width = np.random.default_rng(3), 0, passages.WIDTH
    for _ in range(40):
        a, b = (draw.integers(0, draw.integers(2, 9), 60).astype(np.uint64) for _ in range(2))
        if passages._common(a, b, 80) is not None:
            continue
        refused += 1
        parts = [[set(x[i:j].tolist()) for i in range(61 - width) for j in range(i + width, 61)] for x in (a, b)]
        assert all(100 * len(one & two) < 80 * len(one | two) for one in parts[0] for two in parts[1])
    assert refused


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(60, 32))
    rows = [(i, (base[i % 60] + (0 if i < 60 else 0.08) * draw.normal(size=32)).astype(np.float32)) for i in range(400)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    rows += [(500 + i, rows[3][1]) for i in range(5)]
    odd = [(600, None), (601, []), (602, [0.0] * 32), (603, [float("nan")] * 32), (604, [None] + [1.0] * 31)]
    odd += [(605, [1.0] * 8), (606, [2.0] * 8), (607, [float("inf")] * 32), (None, rows[0][1])]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label string")
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(table, block=16).collect()}
    assert len(found) == len(rows) + len(odd)
    matrix = embeddings.unit(np.array([v for _, v in rows], np.float32))
    link = matrix @ matrix.T >= 0.95
    ids = np.array([i for i, _ in rows])
    total = link.sum(1) - 1
    got = np.array([found[i]["n_links"] for i in ids.tolist()])
    assert (got <= total).all() and got.sum() >= 0.99 * total.sum()
    assert [found[i]["n_links"] for i, _ in odd[:5]] == [0] * 5 and found[607]["n_links"] == 0
    assert found[606]["component_id"] == 605 and not found[606]["kept"] and found[606]["n_links"] == 1
    assert found[504]["component_id"] == found[3]["component_id"] and found[None]["n_links"] == 0
    assert embeddings.near_duplicates(table.where("false")).count() == 0


def test_a_passage_meets_all_earlier_documents(spark):
    """The copy's signatures stand in twelve earlier documents too, none of which is alike enough."""
    body, rows = words(41000, 60), []
    for i in range(12):
        other = list(body)
        for at in (5 + i, 25 + i, 45 + i):
            other[at] = f"changed{i}x{at}"
        rows.append((i, " ".join(words(42000 + i, 30) + other + words(43000 + i, 30))))
    rows += [(i, " ".join(words(44000 + i, 30) + body + words(45000 + i, 30))) for i in (50, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(docs).where("other_doc_id = 50").collect()
    assert [(r["doc_id"], r["first_word"], r["n_words"], r["similarity"]) for r in found] == [(60, 30, 60, 1.0)]


def test_pairs_of_nodes_are_joined_in_parts(monkeypatch):
    monkeypatch.setattr(passages, "PAIRS", 4)
    own, rep = np.zeros(3, passages._KEPT), np.zeros(6, passages._REP)
    rep["doc"] = [2, 0, 1, 0, 2, 1]
    assert [part["doc"].tolist() for part in passages._parts(own, rep)] == [[0, 0], [1, 1], [2, 2]]
    assert [len(part) for part in passages._parts(own[:0], rep)] == [6]
