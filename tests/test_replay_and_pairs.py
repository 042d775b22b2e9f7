import random

import pytest
from pyspark.sql import functions as F

from plyforge.operators import pairs as pr
from plyforge.operators import replay as rp
from plyforge.plans import preferences as plan


@pytest.fixture(scope="module")
def machine():
    draw = random.Random(8)
    return {(s, m): draw.randrange(6) for s in range(6) for m in "abc" if draw.random() < 0.8}


def test_walk_equals_a_plain_one(spark, machine):
    draw = random.Random(9)
    games = [(i, [draw.choice("abc") for _ in range(draw.randint(0, 50))]) for i in range(60)]
    games += [(100 + i, moves + ["a", "b"]) for i, moves in games[:20]]  # shared beginnings
    expected = set()
    for game, moves in games:
        state = 0
        for ply, move in enumerate(moves):
            if (state, move) not in machine:
                break
            expected.add((game, ply, str(state), move, str(machine[state, move])))
            state = machine[state, move]
    df = spark.createDataFrame(games, "game_id long, moves array<string>")
    steps = spark.createDataFrame([(s, m, n) for (s, m), n in machine.items()], "state int, move string, next_state int")
    assert {tuple(r) for r in rp.replay(df, steps, 0).collect()} == expected
    short = {row for row in expected if row[1] < 2}
    assert {tuple(r) for r in rp.replay(df, steps, 0, max_ply=2).collect()} == short
    legal = {g: len(m) >= 2 and sum(r[0] == g for r in expected) == len(m) for g, m in games}
    assert {r[0]: r[1] for r in rp.valid_moves(df, steps, 0, 2).collect()} == legal


def test_odd_lists(spark):
    rows = [(1, ["a", None, "a"]), (1, ["a", "a", None]), (2, None), (None, ["a"]), (3, [])]
    df = spark.createDataFrame(rows, "game_id long, moves array<string>")
    steps = spark.createDataFrame([("s", "a", "s"), ("s", "a", "t")], "state string, move string, next_state string")
    found = {(r["game_id"], tuple(r["moves"])): r["states"] for r in rp.game_states(df, steps, "s").collect()}
    assert found == {
        (1, ("a", None, "a")): ["s", None, None],
        (1, ("a", "a", None)): ["s", "s", None],
        (2, ()): [], (None, ("a",)): ["s"], (3, ()): [],
    }


def test_empty_relation(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, [])], "game_id long, moves array<string>")
    steps = spark.createDataFrame([], "state string, move string, next_state string")
    assert rp.replay(df, steps, "s").collect() == []
    assert not any(r[1] for r in rp.valid_moves(df, steps, "s", 0).collect())


def test_valid_texts(spark):
    steps = spark.createDataFrame([("s", "e4", "s"), ("s", "e5", "s")], "state string, move string, next_state string")
    texts = ["1.e4 e5 2.e4", "[g_start]1.e4 e5 2.e4 1-0[g_end]", "1.e4 e5 2.e4 *", "1.e4 e5 2.d4", "1.e4", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "game_id long, text string")
    check = lambda dialect: [
        r["is_legal"] for r in rp.valid_sequences(df, steps, "s", 3, dialect).orderBy("game_id").collect()
    ]
    assert check("evaluation") == [True, True, True, False, False, False, False]
    assert check("finetune") == [True, True, False, False, False, False, False]


def test_pass_rate(spark):
    df = spark.createDataFrame([(True,), (False,), (True,), (True,)], "is_legal boolean")
    assert tuple(rp.pass_rate(df).first()) == (3, 1, 75.0)
    assert tuple(rp.pass_rate(df.limit(0)).first()) == (0, 0, 0.0)


def test_positions_include_the_one_before_a_failing_move(spark):
    steps = spark.createDataFrame([("s", "a", "t")], "state string, move string, next_state string")
    df = spark.createDataFrame([(1, ["a", "x", "a"])], "game_id long, moves array<string>")
    rows = rp.reached_positions(df, steps, "s").orderBy("ply").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "s", []), (1, 1, "t", ["a"])]


def scored(spark, losses, position="p"):
    rows = [(position, i + 1, f"m{i}", 100 - loss) for i, loss in enumerate(losses)]
    return spark.createDataFrame(rows, "position string, pv_rank int, move string, cp int")


def test_loss_bands(spark):
    rows = pr.candidate_losses(scored(spark, [0, 30, 31, 49, 50])).orderBy("pv_rank").collect()
    assert [r["side"] for r in rows] == ["good", "good", None, None, "bad"]


@pytest.mark.parametrize("good, bad", [(1, 1), (1, 5), (4, 1), (2, 4), (3, 3), (5, 2)])
def test_pairs_are_distinct_and_complete(spark, good, bad):
    candidates = scored(spark, [0] * good + [90] * bad)
    for n in (1, 3, 100):
        rows = [(r["chosen"], r["rejected"]) for r in pr.pair_candidates(candidates, n).collect()]
        assert len(rows) == len(set(rows)) == min(n, good * bad)
        assert all(int(c[1:]) < good <= int(r[1:]) for c, r in rows)


def test_no_pairs_without_both_sides(spark):
    assert pr.pair_candidates(scored(spark, [0, 10, 40])).count() == 0
    assert pr.pair_candidates(scored(spark, [])).count() == 0


def test_every_pair_is_as_likely(spark):
    seen = {}
    for seed in range(60):
        for r in pr.pair_candidates(scored(spark, [0, 0, 90, 90]), 1, seed).collect():
            seen[r["chosen"], r["rejected"]] = seen.get((r["chosen"], r["rejected"]), 0) + 1
    assert len(seen) == 4 and min(seen.values()) >= 6


def test_tokenized_pairs_drop_long_moves(spark):
    from plyforge.operators import tokens as tk

    rows = [(1, "1.e4", "e5", "d5"), (2, "", "e4", "abcdefghij"), (3, "1.e4", "e5", "")]
    pairs = spark.createDataFrame(rows, "pair_id long, context string, chosen string, rejected string")
    docs = pairs.select(F.concat_ws(" ", "context", "chosen", "rejected").alias("text"))
    merges, vocabulary = tk.train_bpe(docs, tk.split_pieces(F.col("text")), 22)
    found = {r["pair_id"]: r for r in plan.tokenize_pairs(pairs, merges, vocabulary, 6).collect()}
    assert set(found) == {1, 3}  # the long rejected move does not fit; a lone space still is a token
    assert found[1]["chosen_ids"][0] == 0 and found[1]["chosen_move_len"] >= 1


def test_preference_pairs_from_openings(spark):
    openings = spark.createDataFrame(
        [(1, "one", "1.a b"), (2, "two", "1.a c 2.a")], "opening_id long, name string, pgn string"
    )
    steps = spark.createDataFrame(
        [("s", "a", "t"), ("s", "z", "u"), ("t", "b", "u"), ("t", "c", "s"), ("u", "a", "u")],
        "state string, move string, next_state string",
    )
    positions = plan.opening_positions(openings, steps, "s")
    assert {(r["position"], r["game_id"], r["context"]) for r in positions.collect()} == {("s", 1, ""), ("t", 1, "1.a")}
    candidates = scored(spark, [0, 80], "t").unionByName(scored(spark, [0, 80], "u"))
    rows = plan.preference_pairs(positions, candidates).collect()
    assert [(r["context"], r["chosen"], r["rejected"], r["cp_chosen"], r["cp_rejected"]) for r in rows] == [
        ("1.a", "m0", "m1", 100, 20)
    ]
