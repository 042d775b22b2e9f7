"""Operators on documents: decontamination, packing, toxicity, licences."""

import hashlib
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plyforge.llm import batches, decontamination, licenses, packing, toxicity
from tests_llm_plain import licence_places

ODD = [
    (1, "", "x"),
    (2, None, "y"),
    (None, "some words of a document without an id", "z"),
    (3, "Ünï cödé " * 40 + "\n\n  tab\there", None),
    (4, "same text twice", "a"),
    (4, "same text twice", "a"),
    (5, "日本 " * 3000 + "end", "b"),
]
SCHEMA = "doc_id long, text string, _found string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def sentence(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefghij"), 5)) for _ in range(n))


def test_words_across_blocks(monkeypatch):
    import pyarrow as pa

    column = pa.array(["One, two-two;THREE", None, "", "é9 " * 50, "one two two three"])
    whole = batches.word_hashes(column)
    monkeypatch.setattr(batches, "BLOCK_BYTES", 7)
    parts = batches.word_hashes(column)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert np.diff(whole[1]).tolist() == [4, 0, 0, 50, 4] == batches.word_counts(column).tolist()
    assert (whole[0][:4] == whole[0][-4:]).all()


ITEMS = [(10, sentence(1, 30)), (11, sentence(2, 5)), (12, None), (13, "!"), (9, sentence(1, 30)), (14, "Two words")]


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_contamination_equals_brute_force(spark, limit):
    hit = [
        (20, f"{sentence(3, 40)} {ITEMS[0][1].upper()} {sentence(4, 40)}", ""),
        (21, f"{sentence(5, 400)} {ITEMS[1][1].replace(' ', ', ')} two-words", ""),
        (22, f"{sentence(6, 9)} {' '.join(ITEMS[0][1].split()[:12])}", ""),
    ]
    docs = ODD + hit
    bench = frame(spark, ITEMS, "item_id long, text string")
    found = decontamination.find_contamination(frame(spark, docs), bench, bench_bytes=limit)
    rows = found.selectExpr(
        "doc_id", "n_words", "n_hit", "size(items) AS n",
        "sha2(concat_ws(',', array_sort(transform(items, x -> string(x)))), 256) AS digest",
        "contaminated",
    ).collect()
    expected = decontamination.brute_force([row[:2] for row in docs], [x for x in ITEMS if x[1]])
    key = lambda row: (row[0] is None, row[0] or 0, row[1])
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


def test_decontaminate_keeps_columns_and_cuts_spans(spark):
    passage = sentence(1, 30)
    docs = frame(spark, [*ODD, (30, f"before {passage} after", "q")])
    bench = frame(spark, ITEMS, "item_id long, text string")
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r[0]) for r in kept.collect()) == sorted(
        str(r[0]) for r in ODD
    )
    cut = decontamination.decontaminate(docs, bench, remove="spans").where("doc_id = 30").first()
    assert cut["text"].split() == ["before", "after"] and cut["_found"] == "q"
    empty = bench.where("false")
    assert decontamination.decontaminate(docs, empty).count() == docs.count()
    assert decontamination.find_contamination(docs.where("false"), bench).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    docs = [*ODD, (7, "a<|endoftext|>b  c\n\n\td 're I'm", ""), (8, sentence(9, 3000), "")]
    rows = packing.pack(frame(spark, docs).repartition(3)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append(row)
    for doc_id, text, _ in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[doc_id], key=lambda r: (r["start"], r["sequence_id"], r["offset"]))
        assert all(r["doc_tokens"] == len(ids) for r in own)
        covered = set()
        for row in own:
            got = np.frombuffer(bytes(row["ids"]), "<u4").tolist()
            assert got == ids[row["start"] : row["start"] + row["length"]]
            covered.update(range(row["start"], row["start"] + row["length"]))
        assert covered == set(range(len(ids)))
        copies = sum(1 for other in docs if other[0] == doc_id)
        assert sum(r["length"] for r in own) == copies * len(ids)
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        fill = 0
        for row in own:
            assert row["offset"] == fill
            fill += row["length"]
        assert 0 < fill <= packing.CAPACITY
        total += fill
        padding += 0 if fill & (fill - 1) == 0 else packing.CAPACITY - fill
    assert padding <= 0.02 * total
    assert packing.pack(frame(spark, docs).where("false")).count() == 0


def test_cuts_are_reciprocal_parts():
    assert packing.cuts(2048 + 1500) == [2048, 1024, 256, 128, 92]
    assert packing.cuts(1) == [1] and packing.cuts(0) == []


def test_toxicity_holds_on_unseen_rows(spark):
    draw = np.random.default_rng(5)
    rows, labels = [], []
    for doc_id in range(600):
        words = sentence(doc_id, 60).split()
        toxic = doc_id % 5 == 0
        if toxic:
            for word in draw.choice(["vile", "rotten", "scumbag", "filthy"], 5):
                words.insert(int(draw.integers(len(words))), str(word))
        rows.append((doc_id, " ".join(words), "x"))
        labels.append((doc_id, int(toxic)))
    labels += [(None, 1), (3, None), (9999, 1)]
    docs = frame(spark, rows + ODD[:3], "doc_id long, text string, score string")
    marks = frame(spark, labels, "doc_id long, toxic int")
    keep = lambda doc_id: ~toxicity.held_out(doc_id)
    scored = toxicity.score(docs, marks, keep=keep).collect()
    assert len(scored) == 603 and all(0 <= r["score"] <= 1 for r in scored)
    unseen = [r for r in scored if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum((r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in unseen if r["doc_id"] > 2)
    assert right >= 0.98 * (len(unseen) - 3)
    left = toxicity.reject(docs, marks, keep=keep)
    assert left.columns == docs.columns and 470 <= left.count() <= 495
    nothing = toxicity.score(docs, marks.where("false")).collect()
    assert len(nothing) == 603 and all(r["predicted"] == 0 for r in nothing)
    assert toxicity.score(docs.where("false"), marks).count() == 0


def test_licence_keywords_are_in_every_match(spark):
    texts = [
        ("CC BY-SA 4.0", "cc-by-sa"), ("CC-BY-NC", "cc-by-nc"), ("cc by 4.0", "cc-by"), ("cc\n by-nc-nd", "cc-by-nc-nd"),
        ("the ODbL", "odbl"), ("Do what the fudge you want to public license", "wtfpl"), ("Expat license", "mit"),
        ("X11 licence", "mit"), ("Berkeley Software Distribution license", "bsd"), ("IBM public license", "cpl"),
        ("PSF license", "psf"), ("open rail license", "openrail"), ("open-source license", "open-source"),
    ]
    rows = [(n, text) for n, (text, _) in enumerate(texts)]
    got = licenses.summary(licenses.scan(frame(spark, rows, "doc_id long, text string"))).collect()
    for row in got:
        assert texts[row["doc_id"]][1] in row["labels"].split(","), texts[row["doc_id"]]
    gate = licenses.gate()
    for rule in licenses.rules():
        assert rule.keywords and all(len(key) > 2 for key in rule.keywords), rule
        assert all(gate.search(key.encode()) for key in rule.keywords)


def test_licences(spark):
    rows = [
        (10, "Released under the MIT License. MIT-license; no mit  licenses"),
        (11, "GNU Lesser General Public License v3 or general public-license"),
        (12, "SPDX-License-Identifier: BSD-3-Clause"),
        (13, "admit license, permit-license, éMIT License"),
        (14, "licensed under the Apache License, Version 2.0"),
    ]
    got = {r["doc_id"]: r for r in licenses.summary(licenses.scan(frame(spark, rows, "doc_id long, text string"))).collect()}
    base = lambda i: tuple(got[i][n] for n in ("n_base", "first_word", "last_word", "base_labels"))
    assert base(10) == (2, 3, 5, "mit") and base(11) == (2, 2, 7, "gpl")
    assert base(12) == base(13) == (0, None, None, "")
    assert got[11]["labels"] == "gpl,lgpl" and got[12]["labels"] == "bsd-3-clause"
    assert got[12]["score"] > got[14]["score"] > got[13]["score"] == 0
    odd = licenses.summary(licenses.scan(frame(spark, ODD))).collect()
    assert len(odd) == len(ODD) and all(r["labels"] == "" for r in odd)
    assert len(licenses.rules()) > 200


def test_stronger_and_longer_detections_win():
    found = [(0, 30, 20, "gpl"), (4, 30, 20, "lgpl"), (5, 9, 40, "mit"), (2, 12, 30, "x")]
    assert licenses.kept(found) == [(0, 30, 20, "gpl"), (2, 12, 30, "x"), (5, 9, 40, "mit")]


def test_digest_of_no_items(spark):
    row = spark.sql("SELECT array() AS items").select(decontamination.items_digest("items")).first()
    assert row[0] == hashlib.sha256(b"").hexdigest()


def test_suppression_equals_all_pairs_and_is_quick():
    draw = np.random.default_rng(3)

    def plain(found):
        out = []
        for one in sorted(set(found), key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
            if not any(a <= one[0] and one[1] <= b for a, b, _, _ in out):
                out.append(one)
        return sorted(out)

    for _ in range(300):
        starts = draw.integers(0, 12, 25).tolist()
        found = [(s, s + int(draw.integers(1, 9)), int(draw.integers(1, 4)) * 10, str(draw.choice(["a", "b"]))) for s in starts]
        assert licenses.kept(found) == plain(found)
    many = [(i, i + 3, 10, "mit") for i in range(0, 200_000, 5)]
    started = time.perf_counter()
    assert len(licenses.kept(many)) == len(many) and time.perf_counter() - started < 2


def test_base_places_equal_a_plain_search(spark):
    draw = np.random.default_rng(7)
    words = ["MIT", "License", "license,", "apache", "general", "public", "x", "é", "licenses", "1"]
    texts = [" ".join(draw.choice(words, int(draw.integers(0, 60)))) for _ in range(150)] + ["", None, "mit-license" * 900]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.summary(licenses.scan(rows)).collect()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert {r["doc_id"]: tuple(r[name] for name in names) for r in found} == {
        i: licence_places(text) for i, text in enumerate(texts)
    }
    assert licenses.summary(licenses.scan(rows.limit(0))).count() == 0
