"""Growing logs, puzzle sync with retries, FEN files in splits."""

import io
import random

import pytest
from pyspark.sql import functions as F

from plyforge.catalog import files
from plyforge.sources import puzzles as sp
from plyforge.streaming import jobs
from plyforge.streaming.logs import LogReader, line_end, lines_of


def test_lines_added_to_a_log_are_read(spark, tmp_path):
    logs, sink, check = (str(tmp_path / name) for name in ("logs", "out", "check"))
    one, two = tmp_path / "logs" / "run=1", tmp_path / "logs" / "run=2"
    one.mkdir(parents=True)
    (one / "log").write_text("start\n  Generated (41.5% pass rate)\nBest val loss: 1.2")  # no line end yet

    def summary():
        jobs.round_log_stream(spark, logs, sink, check)
        return {tuple(row) for row in jobs.round_summary(spark, sink).collect()}

    assert summary() == {("1", 41.5, None)}
    with open(one / "log", "a") as file:
        file.write("5\n(60.5% pass rate)\n")
    two.mkdir()
    (two / "log").write_text("Best val loss: 2.5\r\n")
    assert summary() == {("1", 41.5, 1.25), ("2", None, 2.5)}
    assert summary() == {("1", 41.5, 1.25), ("2", None, 2.5)}
    assert spark.read.parquet(sink).count() == 4


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_ranges_give_each_line_once(size):
    draw = random.Random(size)
    text = b"".join(b"x" * draw.randint(0, 9) + draw.choice([b"\n", b"\r\n"]) for _ in range(80)) + b"open"
    end = line_end(io.BytesIO(text), len(text))
    assert end == len(text) - 4
    first = text.index(b"\n") + 1
    found = []
    for start in range(first, end, size):
        found += lines_of(io.BytesIO(text), first, start, min(start + size, end))
    places = [i for i in range(first, end) if text[i - 1 : i] == b"\n"]
    assert [place for place, _ in found] == places
    assert [line for _, line in found] == text[first:end].decode().replace("\r\n", "\n").split("\n")[:-1]


def test_a_rewritten_log_is_read_from_its_start():
    reader = LogReader({"path": "/nowhere"})
    (part,) = reader.partitions({"a": 50, "b": 5}, {"a": 20, "b": 5})
    assert part.ranges == [("a", 0, 0, 20)]
    small = LogReader({"path": "/nowhere", "rangeBytes": "8"})
    assert [p.ranges for p in small.partitions({"a": 2}, {"a": 12, "b": 5})] == [
        [("a", 2, 2, 10)], [("a", 2, 10, 12), ("b", 0, 0, 5)],
    ]
    assert reader.latestOffset() == {}


def test_a_run_without_metric_lines_is_told_once(spark, tmp_path):
    logs, sink, check = (str(tmp_path / name) for name in ("logs", "out", "check"))
    (tmp_path / "logs" / "run=1").mkdir(parents=True)
    (tmp_path / "logs" / "run=1" / "log").write_text("start\nstep 1\n")
    jobs.round_log_stream(spark, logs, sink, check)
    assert [tuple(row) for row in jobs.round_summary(spark, sink).collect()] == [("1", None, None)]
    (tmp_path / "logs" / "run=1" / "log").write_text("start\nstep 1\nBest val loss: 2.5\n")
    jobs.round_log_stream(spark, logs, sink, check)
    assert [tuple(row) for row in jobs.round_summary(spark, sink).collect()] == [("1", None, 2.5)]


def test_logs_are_written_by_the_tasks(spark, tmp_path):
    place = (tmp_path / "in").as_uri()
    rows = [(1, "a"), (1, None), (None, "c"), (2, "d")]
    for part in (rows[:1], rows):
        lines = spark.createDataFrame(part, "run long, value string").repartition("run").sortWithinPartitions("run")
        files._write_logs(lines, place)
    found = {p.parent.name: p.read_text() for p in (tmp_path / "in").rglob("log")}
    assert sorted(found.pop("run=1").split("\n")) == ["", "", "a"]
    assert found == {"run=2": "d\n", "run=__HIVE_DEFAULT_PARTITION__": "c\n"}


def test_many_files_are_read_by_many_tasks():
    parts = LogReader({"path": "/nowhere"}).partitions({}, {f"f{i:04d}": 10 for i in range(1100)})
    assert [len(part.ranges) for part in parts] == [500, 500, 100]


def test_failed_rows_are_tried_again(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    games, built = {"a", "c"}, []

    def build(rows):
        built.append(sorted(row["PuzzleId"] for row in rows.collect()))
        found = rows.where(F.col("Game").isin(list(games)))
        return found.select(F.col("PuzzleId").alias("puzzle_id"), F.col("Game").alias("game_id"))

    def run():
        stream = spark.readStream.schema("PuzzleId string, Game string").parquet(source)
        jobs.sync_puzzles_stream(stream, sink, str(tmp_path / "check"), build)
        return sorted(row["puzzle_id"] for row in sp.read_puzzles_jsonl(spark, sink).collect())

    def arrive(*rows):
        spark.createDataFrame(rows, "PuzzleId string, Game string").coalesce(1).write.mode("append").parquet(source)

    arrive(("1", "a"), ("2", "b"), ("1", "a"))
    assert run() == ["1"] and built == [["1", "2"]]
    arrive(("1", "a"), ("3", "c"))
    assert run() == ["1", "3"]
    games.add("b")  # the game arrives, and no catalogue row with it
    assert run() == ["1", "2", "3"] and built[-1] == ["2"]
    tries = len(built)
    assert run() == ["1", "2", "3"] and len(built) == tries


def test_a_step_that_broke_off_is_done_again(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("1",), ("2",)], "PuzzleId string").coalesce(1).write.parquet(source)
    record = lambda rows: rows.select(F.col("PuzzleId").alias("puzzle_id"))

    def run(build):
        stream = spark.readStream.schema("PuzzleId string").parquet(source)
        jobs.sync_puzzles_stream(stream, sink, str(tmp_path / "check"), build)

    run(record)
    for done in (tmp_path / "check" / "commits").iterdir():  # as if the driver was lost before it
        if done.name.strip(".").startswith("0"):
            done.unlink()
    run(record)
    assert sorted(r["puzzle_id"] for r in sp.read_puzzles_jsonl(spark, sink).collect()) == ["1", "2"]


@pytest.mark.parametrize("size", ["64", "1k", "128m"])
def test_fen_files_in_splits_equal_whole_files(spark, tmp_path, size):
    draw, fen = random.Random(6), "r/1/2/3/4/5/6/K {} - - 0 {}"
    for name in ("a", "b"):
        lines = []
        for i in range(60):
            lines += draw.choice([[f"Game {i}"], [], [f"Game {i}", ""]])
            lines += [fen.format(draw.choice("wb"), i)] * draw.choice([1, 1, 2])
            lines += draw.choice([[""], [], [" ", "\t"] * 9]) + draw.choice([[f"{i}. Qh{i}+ x"], ["none"], []])
        (tmp_path / name).write_text("\n".join(lines) + draw.choice(["", "\n"]))
    whole = spark.createDataFrame([(p.as_uri(), p.read_text()) for p in tmp_path.iterdir()], "source string, text string")
    conf = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        lines = sp.read_fen_lines(spark, str(tmp_path))
        assert lines.select("source", "split").distinct().count() > 4
        found = sp.parse_fen_lines(lines).drop("source").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted(found) == sorted(sp.parse_fen_puzzles(whole).drop("source").collect())


def test_fen_lines_take_no_frame_that_shrinks(spark):
    """Such a frame is read anew for each line, so the time would grow with the square of a split."""
    lines = spark.createDataFrame([("a", 0, 0, "cite")], "source string, split long, place long, line string")
    plan = sp.parse_fen_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan
