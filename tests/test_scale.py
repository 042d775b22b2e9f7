import random

import pytest
from pyspark.sql import functions as F

from plyforge import scale
from plyforge.functions.scoring import shuffle_key


def as_rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("salted", [False, True])
def test_hot_keys_join_like_any_other(spark, monkeypatch, how, salted):
    fact = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 17 != 0, F.col("id") % 50).alias("k"), "id"
    )
    dim = spark.range(5, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    if how in ("left_semi", "left_anti"):
        dim = dim.select("k")
    expected = fact.join(dim, "k", how)
    if salted:  # as if the rows for the hot keys were too many to broadcast
        monkeypatch.setattr(scale, "fits_broadcast", lambda df, max_rows=0, max_bytes=0: False)
    found = scale.lookup_join(fact, dim, "k", how, small=False, hot_rows=100)
    assert as_rows(found.select(expected.columns)) == as_rows(expected)


def test_known_counts_find_the_same_hot_keys(spark):
    fact = spark.range(1000).select((F.col("id") % 2 * F.col("id")).alias("k"))
    counts = fact.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in scale._hot_keys(fact, ["k"], 100, counts).collect()] == [(0,)]
    assert scale._hot_keys(fact, ["k"], 600, counts) is None
    assert scale._hot_keys(fact, ["k"], 600) is None


def test_broadcast_needs_few_and_short_rows(spark):
    assert scale.fits_broadcast(spark.range(10), max_rows=10)
    assert not scale.fits_broadcast(spark.range(11), max_rows=10)
    long = spark.range(2).select(F.repeat(F.lit("x"), 1000).alias("t"), F.lit([1, 2]).alias("a"))
    assert not scale.fits_broadcast(long, max_bytes=1500)
    assert scale.fits_broadcast(long, max_bytes=3000)
    assert not scale.fits_broadcast(spark.range(9).select(F.lit([[1]]).alias("n")), max_bytes=50)
    assert scale.fits_broadcast(spark.range(0))


@pytest.mark.parametrize("rows_per_bucket", [1, 7, 1000])
def test_prefix_sum(spark, rows_per_bucket):
    draw = random.Random(1)
    keys = draw.sample(range(-(10**12), 10**12), 60) + list(range(40))  # most keys close together
    rows = [(key, draw.randrange(5)) for key in keys]
    total, expected = 0, {}
    for key, weight in sorted(rows):
        expected[key] = total
        total += weight
    df = spark.createDataFrame(rows, "k long, w int").repartition(5)
    found = scale.prefix_sum(df, "k", F.col("w"), "start", rows_per_bucket)
    assert {row["k"]: row["start"] for row in found.collect()} == expected


def test_prefix_sum_of_nothing(spark):
    df = spark.createDataFrame([], "k long, w int")
    assert scale.prefix_sum(df, "k", F.col("w"), "start").collect() == []


@pytest.mark.parametrize("n", [0, 1, 137, 999, 1000])
def test_cuts_are_exact(spark, n):
    df = spark.range(1000).select((F.col("id") * F.col("id") * 3).alias("k"))
    key = shuffle_key(3, "k")
    cut = scale.hash_cut(df, key, n, collect_rows=4)
    assert (0 if cut is None else df.where(key <= cut).count()) == n
    cut = scale.order_cut(df, "k", n, collect_rows=10)
    assert (0 if cut is None else df.where(F.col("k") <= cut).count()) == n


def test_cuts_refuse_repeated_keys(spark):
    df = spark.range(100).select(F.lit(1).alias("k"))
    with pytest.raises(ValueError):
        scale.hash_cut(df, shuffle_key(3, "k"), 50, collect_rows=10)
    with pytest.raises(ValueError):
        scale.hash_cut(df, shuffle_key(3, "k"), 50)
    with pytest.raises(ValueError):
        scale.order_cut(df, "k", 50, collect_rows=10)


def test_cut_beyond_the_rows(spark):
    df = spark.range(10)
    assert scale.hash_cut(df, shuffle_key(3, "id"), 11) == scale.ABOVE_HEX
    with pytest.raises(ValueError):
        scale.order_cut(df, "id", 11)


@pytest.mark.parametrize("few", [True, False])
def test_match_rows(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(scale, "fits_broadcast", lambda df, max_rows=0, max_bytes=0: False)
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (9, "c"), (None, "d")], "k long, t string")
    big = spark.range(1000).select((F.col("id") % 5).alias("k"), "id")
    shrink = lambda rows: rows.groupBy("k").agg(F.min("id").alias("first"))
    found = scale.match_rows(wanted, big, "k", shrink=shrink)
    assert {tuple(r) for r in found.collect()} == {(1, "a", 1), (1, "b", 1), (9, "c", None), (None, "d", None)}


@pytest.mark.parametrize("few", [1, 4, 10_000])
def test_several_ranks_at_once(spark, few):
    df = spark.range(500).withColumn("k", F.col("id"))
    key = shuffle_key(5, "k")
    wanted = [0, 1, 2, 250, 250, 499, 500, 501]
    total, cuts = scale.hash_cuts(df, key, lambda n: wanted, collect_rows=few)
    assert total == 500 and cuts[0] is None and cuts[-1] == scale.ABOVE_HEX
    assert [df.where(key <= cut).count() for cut in cuts[1:]] == [1, 2, 250, 250, 499, 500, 500]
    assert scale.hash_cuts(df.limit(0), key, lambda n: [n, 1]) == (0, [None, scale.ABOVE_HEX])


def test_derived_sides_are_written_and_measured(spark):
    side = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    table, small = scale.sized(side)
    assert small and table.inputFiles() and sorted(table.collect()) == sorted(side.collect())
    assert not scale.sized(side, max_rows=6)[1]
    scan = table.where("k > 2")
    assert scale.sized(scan)[0] is scan
