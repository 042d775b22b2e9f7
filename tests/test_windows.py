import random

import pytest
from pyspark.sql import functions as F

from plyforge import scale
from plyforge.operators import metrics as mt
from plyforge.operators import tokens as tk
from plyforge.operators import windows as wn
from plyforge.plans import pretraining


@pytest.mark.parametrize("block, stride", [(1, 1), (3, 1), (4, 4), (5, 3), (8, 20), (200, 1)])
@pytest.mark.parametrize("sizes", [[7, 0, 1, 30, 2, 2], [4], [0], []])
def test_windows(spark, block, stride, sizes):
    draw = random.Random(2)
    games = [(10 * i, [draw.randrange(9) for _ in range(n)]) for i, n in enumerate(sizes)]
    tokens = [token for _, ids in games for token in ids]
    df = spark.createDataFrame(games, "game_id long, ids array<int>")
    stream = wn.token_offsets(df, "game_id", rows_per_bucket=2)
    found = {
        r["start"]: (r["x"], r["y"], r["w"])
        for r in wn.training_windows(stream, block, stride, [3]).collect()
    }
    expected = {}
    for start in range(0, max(0, len(tokens) - block), stride):
        y = tokens[start + 1 : start + block + 1]
        expected[start] = (tokens[start : start + block], y, [0.15 if t == 3 else 1.0 for t in y])
    assert found == expected


def test_pad_batches(spark):
    df = spark.createDataFrame([(3, [5]), (1, [7, 8, 9]), (9, [4, 4])], "i long, ids array<int>")
    rows = wn.pad_batches(df, "i", 2, rows_per_bucket=1).orderBy("i").collect()
    assert [(r["batch_no"], r["length"], r["padded"]) for r in rows] == [
        (0, 3, [7, 8, 9]), (0, 1, [5, 0, 0]), (1, 2, [4, 4])
    ]


@pytest.mark.parametrize("mode", ["min", "max"])
def test_best_so_far(spark, mode):
    draw = random.Random(4)
    rows = [(run, step, float(draw.randrange(20))) for run in "ab" for step in range(40)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    found = {
        (r["run"], r["step"]): (r["best"], r["is_best"])
        for r in wn.best_so_far(df, "value", "step", mode=mode, span=7).collect()
    }
    pick = min if mode == "min" else max
    for run in "ab":
        best = None
        for _, step, value in [row for row in rows if row[0] == run]:
            better = best is None or (value < best if mode == "min" else value > best)
            best = value if best is None else pick(best, value)
            assert found[run, step] == (best, better)


def test_preference_metrics(spark):
    schema = "pair_id long, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double"
    rows = [(1, -1.0, -2.0, -2.0, -1.0), (2, -3.0, -1.0, -1.0, -1.0), (3, -1.0, -1.0, -1.0, -1.0)]
    got = mt.preference_metrics(spark.createDataFrame(rows, schema), batch=2, max_batches=None).first()
    from math import exp, log

    loss = lambda z: log(1 + exp(-z))
    assert got["reward_accuracy"] == pytest.approx((0.5 + 0.0) / 2)
    assert got["preference_loss"] == pytest.approx(((loss(0.2) + loss(-0.2)) / 2 + loss(0.0)) / 2)
    first = mt.preference_metrics(spark.createDataFrame(rows, schema), batch=1, max_batches=1).first()
    assert first["reward_accuracy"] == 1.0
    empty = mt.preference_metrics(spark.createDataFrame([], schema)).first()
    assert tuple(empty) == (0.0, float("inf"))


def test_weighted_loss_is_a_mean_over_all_tokens(spark):
    schema = "seq_id long, logps array<double>, weights array<double>"
    rows = [(1, [-1.0, -2.0], [1.0, 0.15]), (2, [-4.0, -4.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, schema)
    assert mt.weighted_nll(df, 1).first()[0] == pytest.approx((1.3 / 2 + 4.0) / 2)
    assert mt.weighted_nll(df, 1, max_batches=1).first()[0] == pytest.approx(0.65)
    assert mt.weighted_nll(spark.createDataFrame([], schema), 1).first()[0] == float("inf")


def test_windows_inside_a_game_are_not_shuffled(spark):
    games = [(0, list(range(5000))), (1, [7] * 3), (2, list(range(1234)))]
    stream = wn.token_offsets(spark.createDataFrame(games, "game_id long, ids array<int>"), "game_id")
    windows = wn.training_windows(stream.select("start", "ids"), 10, 10)
    rows = windows.collect()
    tokens = [token for _, ids in games for token in ids]
    assert sorted(r["start"] for r in rows) == list(range(0, len(tokens) - 10, 10))
    assert all(r["y"] == tokens[r["start"] + 1 : r["start"] + 11] for r in rows)
    leaves = windows._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves()
    stages = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).nodeName() == "ShuffleQueryStage"]
    written = [stage.plan().metrics().apply("shuffleRecordsWritten").value() for stage in stages]
    assert written and sum(written) <= 12  # of 624 blocks those at the ends of games


def test_tokens_of_many_games_are_not_shuffled(spark, monkeypatch):
    """The offsets come to tokens in buckets; nothing else of a game goes through a shuffle."""
    texts = [(7 * i, f"{i} ab abc cab " * (i % 9)) for i in range(60)]
    corpus = spark.createDataFrame(texts, "order_key long, pgn string")
    merges, vocabulary = tk.train_bpe(corpus.select(F.col("pgn").alias("text")), tk.split_pieces(F.col("text")), n_merges=6)
    read = lambda: pretraining.window_dataset(corpus, merges, vocabulary, 16, 16)
    rows = lambda df: sorted((r["start"], r["x"], r["y"]) for r in df.collect())
    expected = rows(read())
    for module in (pretraining, scale):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(pretraining, "ROWS_PER_BUCKET", 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        windows = read()
        assert rows(windows) == expected and len(expected) > 20
        plan = windows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "Bucketed: true" in plan and "SortMergeJoin" not in plan
    assert dealt and not [line for line in dealt if "hashpartitioning(order_key" in line and ", 3)" not in line]
