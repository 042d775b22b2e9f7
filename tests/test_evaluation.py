import pytest
from pyspark.sql import functions as F

from plyforge.operators import corpus as co
from plyforge.operators import evaluation as ev
from plyforge.operators import plugins, runs
from plyforge.plans import evaluation as plan
from plyforge.streaming import jobs

ANSWER = "model string, position string, sample_idx int, move string"


def test_legality(spark):
    legal = spark.createDataFrame([("p", "Nf6+"), ("p", "e5")], "position string, move string")
    moves = ["Nf6+", "Nf6", "Nf6#", "Nf6+#", "e5", "e5+", "e4", "", None]
    df = spark.createDataFrame([("m", "p", i, move) for i, move in enumerate(moves)], ANSWER)
    rows = ev.legal_answers(df, legal).orderBy("sample_idx").collect()
    assert [r["is_legal"] for r in rows] == [True, True, True, False, True, True, False, False, False]


def judged(spark, rows):
    return spark.createDataFrame(rows, "model string, position string, is_legal boolean, cpl int")


def test_screen_edges(spark):
    rows = [("m", "p", True, 199), ("m", "p", True, 200), ("m", "p", False, None), ("x", "p", False, None)]
    found = {r["model"]: r for r in ev.screen(judged(spark, rows), ["x"]).collect()}
    assert (found["m"]["n_legal"], found["m"]["mean_cpl"]) == (2, 199.5)
    assert found["m"]["blunder_rate"] == pytest.approx(1 / 3)
    assert (found["x"]["legality_rate"], found["x"]["mean_cpl"], found["x"]["blunder_rate"]) == (0.0, None, 0.0)
    assert found["x"]["is_specialist"] and not found["m"]["is_specialist"]
    fixed = {r["model"]: r for r in ev.screen(judged(spark, rows), n_gens=4).collect()}
    assert fixed["m"]["legality_rate"] == 0.5 and fixed["x"]["n_gens"] == 4


def test_summary_is_a_mean_of_means(spark):
    rows = [("m", "p", True, 0), ("m", "q", True, 100), ("m", "q", True, 300), ("m", "r", False, None), ("z", "p", False, None)]
    first, second = ev.screen_summary(ev.screen(judged(spark, rows))).collect()
    assert (first["model"], first["mean_cpl"], second["mean_cpl"]) == ("m", 100.0, None)


def test_tally_gives_the_same_summary(spark):
    legal = spark.createDataFrame([("p", "a"), ("p", "b")], "position string, move string")
    scores = spark.createDataFrame([("p", "a", -50), ("p", "b", 170)], "position string, move string, cp_after int")
    best = spark.createDataFrame([("p", 50)], "position string, best_cp int")
    moves = ["a", "a", "b", "x", None, "a"]
    df = spark.createDataFrame([("m", "p", i, move) for i, move in enumerate(moves)], ANSWER)
    raw = ev.centipawn_loss(ev.legal_answers(df, legal), best, scores)
    direct = ev.screen_summary(ev.screen(raw)).collect()
    assert plan.evaluate(df, legal, best, scores).collect() == direct
    assert direct[0]["mean_cpl"] == pytest.approx(220 / 4)


def test_hits(spark):
    rows = [("m", 1, 0, "Qh5#", True, "Qh5+"), ("m", 1, 1, "Qh5", False, "Qh5+"), ("m", 1, 2, None, False, "Qh5+"), ("m", 1, 3, "a3", True, "Qh5+")]
    df = spark.createDataFrame(rows, "model string, puzzle_id int, sample_idx int, move string, is_legal boolean, expected string")
    row = ev.puzzle_results(df, 4).first()
    assert (row["n_legal"], row["n_hits"], row["top1_acc"]) == (2, 1, 0.25)
    assert row["sample_moves"] == ["Qh5#", "Qh5", None, "a3"]
    chunks = ev.sample_moves(df, chunk=3).orderBy("chunk_no").collect()
    assert [len(c["sample_moves"]) for c in chunks] == [3, 1]
    parts = ev.puzzle_results(df, chunk=3).orderBy("chunk_no").collect()
    assert [(r["n_gens"], r["n_hits"], len(r["sample_moves"])) for r in parts] == [(4, 1, 3), (4, 1, 1)]
    cut = ev.puzzle_results(df, 2).first()
    assert (cut["n_gens"], cut["n_legal"], cut["sample_moves"]) == (2, 1, ["Qh5#", "Qh5"])


def test_promote_needs_a_baseline(spark):
    df = spark.createDataFrame([("a", 1.0), ("base", 2.0), ("b", 3.0), ("c", None)], "model string, mean_cpl double")
    assert [r["model"] for r in ev.promote(df, "base").collect()] == ["a"]
    assert ev.promote(df, "c").collect() == []
    assert ev.promote(df, "missing").collect() == []


def test_resume_starts_fresh_without_the_columns(spark):
    grid = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "puzzle_id int, model string")
    done = spark.createDataFrame([(1, "a", 3)], "puzzle_id int, model string, n_hits int")
    assert ev.remaining_work(grid, done, ["n_hits"]).count() == 2
    assert ev.remaining_work(grid, done, ["n_hits", "rating"]).count() == 3


def test_interrupted_run_equals_one_run(spark, tmp_path):
    schema = "puzzle_id int, model string, n_hits int, place int"
    rows = [(p, m, p, 10 * p + i) for p in range(6) for i, m in enumerate("ab")]
    for part in (rows[:7], rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.resume_eval_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), "place")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(rows)


def test_stop_rule(spark):
    rows = [("c", i + 1, 0, rate) for i, rate in enumerate([10.0, 20.0, 22.0, 60.0])]
    rows += [("d", 1, 0, 85.0), ("d", 2, 0, 99.0), ("e", 1, 0, None), ("f", 1, 2, 90.0), ("g", 1, 0, 1.0)]
    rows += [("h", i + 1, 0, 5.0 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "chain string, round int, exit_code int, pass_rate double")
    kept = {}
    for r in runs.round_progress(df).orderBy("chain", "round").collect():
        kept.setdefault(r["chain"], []).append((r["status"], r["stop_reason"]))
    assert [len(kept[c]) for c in "cdefgh"] == [3, 1, 1, 1, 1, 10]
    assert kept["c"][-1][1] == "small_gain"
    assert kept["d"][-1][1] == "target_reached"
    assert kept["e"][-1] == ("parse_error", "no_pass_rate")
    assert kept["f"][-1] == ("failed", "exit_code")
    assert kept["h"][-1][1] is None


def test_a_resumed_chain_goes_on_from_its_last_completed_round(spark):
    rows = [("c", 1, 0, 50.0), ("c", 2, 0, 60.0), ("c", 3, 0, 61.0), ("c", 4, 0, 70.0)]
    rows += [("d", 1, 0, 50.0), ("d", 2, 1, 70.0), ("d", 3, 0, 56.0)]
    df = spark.createDataFrame(rows, "chain string, round int, exit_code int, pass_rate double")
    kept = runs.round_progress(df, start_round=3).orderBy("chain", "round").collect()
    assert [(r["chain"], r["round"], r["delta_pp"], r["stop_reason"]) for r in kept] == [
        ("c", 3, 1.0, "small_gain"),
        ("d", 3, 6.0, None),
    ]


def test_corpus_guards(spark):
    games = spark.range(50).select(F.col("id").alias("game_id"), F.lit("1.e4").alias("pgn"))
    openings = spark.createDataFrame([(1, "x", "1.e4")], "opening_id long, name string, pgn string")
    with pytest.raises(ValueError):
        co.pretrain_corpus(games, openings)
    own = spark.range(50, 60).select(F.col("id").alias("game_id"), F.lit("1.d4").alias("pgn"))
    given = co.pretrain_corpus(games, openings, times=2, validation=own).groupBy("split").count()
    assert dict(map(tuple, given.collect())) == {"train": 52, "validation": 10}
    with pytest.warns(UserWarning, match="only 15"), pytest.raises(ValueError):
        co.finetune_corpus(games.limit(15), openings.limit(0), games.limit(0))
    with pytest.raises(ValueError):
        co.pair_split(spark.range(9), "id")
    split = co.pair_split(spark.range(50), "id")
    assert split.where("split = 'validation'").count() == 10


def test_finetune_validation_takes_all_of_a_small_set(spark):
    games = spark.range(12).select(F.col("id").alias("game_id"), (F.col("id") % 4).cast("string").alias("pgn"))
    openings = spark.createDataFrame([(1, "x", "1.e4")], "opening_id long, name string, pgn string")
    whole = co.finetune_corpus(games, openings, games.limit(0), times=3)
    counts = {(r["split"], r["source"]): r["count"] for r in whole.groupBy("split", "source").count().collect()}
    assert counts == {("validation", "generated"): 12, ("train", "opening"): 3}
    assert co.finetune_corpus(games, openings, games, dedup=True).where("source = 'generated'").count() == 4


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(500)
    first = co.seeded_sample(df, 33, "id", seed=5).collect()
    assert len(first) == 33 and sorted(first) == sorted(co.seeded_sample(df.repartition(7), 33, "id", seed=5).collect())
    assert co.seeded_sample(df, 900, "id").count() == 500
    assert co.seeded_sample(df, 0, "id").count() == 0


def test_plugins(spark):
    def model(prompts, samples):
        return [RuntimeError("late") if s else p + "!" for p, s in zip(prompts, samples)]

    prompts = spark.createDataFrame([("a", "x"), ("b", "y")], "prompt_id string, prompt string")
    rows = plugins.batch_generate(prompts, 2, model).orderBy("prompt_id", "sample_idx").collect()
    assert [r["text"] for r in rows] == ["x!", None, "y!", None]
    assert [r["error"] for r in rows] == [None, "RuntimeError: late"] * 2
    broken = plugins.batch_generate(prompts, 1, lambda p, s: 1 / 0).collect()
    assert all(r["text"] is None and r["error"].startswith("ZeroDivisionError") for r in broken)
    short = plugins.batch_generate(prompts, 1, lambda p, s: []).collect()
    assert all("0 results" in r["error"] for r in short)
    positions = spark.createDataFrame([("p",), ("q",)], "position string")
    analyse = lambda own, k: [[("m", 1), ("n", None)] if p == "p" else ValueError("q") for p in own]
    lines = plugins.batch_candidates(positions, analyse).orderBy("position", "pv_rank").collect()
    assert [tuple(r) for r in lines] == [
        ("p", 1, "m", 1, None),
        ("p", 2, "n", None, None),
        ("q", None, None, None, "ValueError: q"),
    ]
