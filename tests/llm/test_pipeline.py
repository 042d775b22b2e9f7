"""The corpus pipeline, stage by stage, against plain versions; and the registered queries."""

import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from plyforge.llm import decontamination, packing
from tests_llm_plain import bytes_left, near_components

DATA = "/root/testdata/sf0.001"


def words(seed, n):
    draw = np.random.default_rng(seed)
    return ["".join(draw.choice(list("abcdefghijkl"), 6)) for _ in range(n)]


def documents():
    bench = " ".join(words(900, 30))
    rows = []
    for i in range(120):
        own = words(i, 60 + i)
        if i % 6 == 0:
            own[5:5] = ["vile", "scumbag"]
        rows.append((i, " ".join(own)))
    base = words(500, 200)
    rows += [(200 + i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(0, 12)]
    shared = " ".join(words(501, 40))
    rows += [(300 + i, f"{' '.join(words(600 + i, 50))} {shared} é {' '.join(words(700 + i, 50))}") for i in range(4)]
    rows += [(400, f"{' '.join(words(800, 40))} {bench}"), (401, ""), (402, None), (None, "no id here")]
    return [(i, text, "en", "s", len(text or "")) for i, text in rows], [(1, bench), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    docs, bench = documents()
    labels = [(i, 1, int(i % 6 == 0)) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


@pytest.fixture(scope="module")
def outputs(spark, folder, tmp_path_factory):
    """What each stage is given, and the result of the last."""
    place = str(tmp_path_factory.mktemp("stages"))
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, folder).write.parquet(f"{place}/{number}")
        docs = spark.read.parquet(f"{place}/{number}")
    return [*out, docs]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_and_their_columns(outputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "minhash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing",
    ]
    assert all(df.columns == outputs[0].columns for df in outputs[:5])


def test_toxic_documents_go_and_clean_ones_stay(outputs):
    before, after = ({r["doc_id"] for r in df.collect()} for df in outputs[:2])
    gone = before - after
    toxic = {i for i in range(0, 120, 6)}
    assert gone <= toxic
    unseen = {i for i in toxic if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(gone & unseen) >= 0.5 * len(unseen) and len(gone) >= 0.8 * len(toxic)


def test_one_document_of_each_group(outputs):
    before = rows_of(outputs[1])
    component = near_components([(r[0], r[1]) for r in before], 80)
    expected = [r for r, c in zip(before, component) if c is None or c == r[0]]
    assert rows_of(outputs[2]) == expected and len(expected) < len(before)


def test_repeated_bytes_are_cut(outputs):
    before = rows_of(outputs[2])
    left = bytes_left([(r[0], r[1]) for r in before])
    expected = []
    for row, kept in zip(before, left):
        text = None if row[1] is None else kept.decode(errors="ignore")
        expected.append((row[0], text, *row[2:4], row[4] if text is None else len(text)))
    assert rows_of(outputs[3]) == sorted(expected, key=str)
    assert any(a != b for a, b in zip(before, sorted(expected, key=str)))


def test_contaminated_documents_go(outputs):
    before = rows_of(outputs[3])
    marks = decontamination.brute_force([(r[0], r[1]) for r in before], [(1, documents()[1][0][1])])
    expected = [r for r, mark in zip(before, marks) if not mark[5]]
    assert rows_of(outputs[4]) == expected and len(expected) == len(before) - 1


def test_packed_ids_are_those_of_the_texts(outputs):
    code, got = packing.encoder(packing.default_tokenizer()), defaultdict(list)
    for row in outputs[5].collect():
        got[row["doc_id"]].append((row["start"], bytes(row["ids"])))
        assert row["ids_crc32"] == zlib.crc32(bytes(row["ids"]))
    for row in outputs[4].collect():
        whole = b"".join(ids for _, ids in sorted(got[row["doc_id"]]))
        assert whole == np.append(code(row["text"] or ""), np.uint32(1)).astype("<u4").tobytes()


def test_run_gives_the_same_pieces(spark, folder, outputs):
    keys = ["doc_id", "start", "length", "ids_crc32"]
    total = lambda df: sorted(df.groupBy("doc_id").agg({"length": "sum"}).collect(), key=str)
    found = corpus_pipeline.run(spark, folder)
    assert set(keys) <= set(found.columns) and total(found) == total(outputs[5])


def test_stages_with_clashing_columns_and_without_rows(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    names = ["_score", "_digest", "_found", "component_id", "rep", "size", "key", "n", "_left"]
    wide = docs.select("*", *(F.lit(name).alias(name) for name in names))
    for name, given in (("wide", wide), ("none", wide.where("false"))):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            before = given
            path = f"{tmp_path}/{name}{number}"
            stage(spark, given, folder).write.parquet(path)
            given = spark.read.parquet(path)
            assert given.columns == wide.columns
            assert {row["doc_id"] for row in given.collect()} <= {row["doc_id"] for row in before.collect()}
        assert all(row[name] == name for row in given.collect() for name in names)
        assert (given.count() == 0) == (name == "none")
        assert (corpus_pipeline.STAGES[4][1](spark, given, folder).count() == 0) == (name == "none")


def test_scratch_of_finished_stages_goes(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    held = corpus_pipeline.one_of_each_group(spark, docs, folder)
    left = list(corpus_pipeline._LEFT)
    assert left
    corpus_pipeline.drop_contaminated(spark, held, folder)  # reads what the stage before it left
    assert held.count() == 20
    corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert not set(left) & set(corpus_pipeline._LEFT)


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else None if value is None else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_registered_queries(spark, name):
    found = entry.queries()[name](spark, DATA)
    rows, sql = found.collect(), entry.oracle_sql().get(name)
    assert rows
    if sql is None:
        return
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{DATA}/{file}'")
    result = con.execute(sql)
    columns = [column[0] for column in result.description]
    key = lambda rows: [tuple("" if v is None else v for v in row) for row in rows]
    assert sorted(columns) == sorted(found.columns)
    order = lambda own, names: sorted(
        (tuple(shown(row[names.index(c)]) for c in sorted(columns)) for row in own),
        key=lambda row: key([row]),
    )
    assert order(map(tuple, rows), found.columns) == order(result.fetchall(), columns)
