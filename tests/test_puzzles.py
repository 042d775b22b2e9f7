import random

import pytest
import zstandard

from plyforge.operators import puzzles as pz
from plyforge.sources import games as sg
from plyforge.sources import puzzles as sp
from plyforge.sources import tables as st


CSV = 'a,b,c,d,e,f,g,h,i,j\np1,f w,u1 u2,1500,80,90,5,"mate short",http://x/y/z,"A, ""B"""\np2,f b,u3,bad,1,1,1,,url,\n'


@pytest.mark.parametrize("packed", [False, True])
def test_catalogue_files(spark, tmp_path, packed):
    path = tmp_path / ("c.csv.zst" if packed else "c.csv")
    path.write_bytes(zstandard.compress(CSV.encode()) if packed else CSV.encode())
    rows = sp.read_puzzle_csv(spark, str(path)).orderBy("PuzzleId").collect()
    assert [(r["PuzzleId"], r["Rating"], r["Themes"], r["OpeningTags"]) for r in rows] == [
        ("p1", 1500, "mate short", 'A, "B"'), ("p2", None, None, None)
    ]
    kept = pz.rating_band(sp.read_puzzle_csv(spark, str(path)))
    assert [r["PuzzleId"] for r in kept.collect()] == ["p1"]


def test_null_marker(spark, tmp_path):
    (tmp_path / "g.csv").write_text("PGN,n\n1.e4,1\nNone,2\n")
    rows = sg.read_game_csv(spark, str(tmp_path / "g.csv"), "PGN string, n int").orderBy("n").collect()
    assert [r["PGN"] for r in rows] == ["1.e4", None]


def test_records_skip_blank_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"puzzle_id":"a","rating":5,"themes":["x"]}\n\n  \n{"puzzle_id":"b"}\n')
    rows = sp.read_puzzles_jsonl(spark, str(tmp_path / "r.jsonl")).orderBy("puzzle_id").collect()
    assert [(r["puzzle_id"], r["themes"]) for r in rows] == [("a", ["x"]), ("b", None)]


def test_pairs_table_is_reused(spark, tmp_path):
    path, calls = str(tmp_path / "pairs"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([("", "e4", "a3", 30, -len(calls))], st.PAIR_SCHEMA)

    for rebuild, made in ((False, 1), (False, 1), (True, 2)):
        rows = st.pairs_table(spark, path, build, rebuild).collect()
        assert len(calls) == made and rows[0]["cp_rejected"] == -made
    (tmp_path / "p.json").write_text('[{"context":"","chosen":"e4","rejected":"a3","cp_chosen":1,"cp_rejected":2},\n{"context":"1.e4"}]')
    assert st.read_pairs_json(spark, str(tmp_path / "p.json")).count() == 2


def test_merges_keep_spaces(spark, tmp_path):
    rows = [(0, " ", "e", " e", 4), (1, " e", "4 ", " e4 ", 2)]
    df = spark.createDataFrame(rows, "rank int, left string, right string, token string, n long")
    st.write_merges(df, str(tmp_path / "m"))
    assert [tuple(r) for r in st.read_merges(spark, str(tmp_path / "m")).collect()] == [r[:4] for r in rows]


@pytest.mark.parametrize(
    "row, kept",
    [(("  ", None, "1.e4"), None), (("", None, "1.e4"), "1.e4"), ((None, " 1.d4\n", "x"), "1.d4"), ((None, None, None), None)],
)
def test_text_column_choice(spark, row, kept):
    df = spark.createDataFrame([(1, *row)], "game_id long, pgn string, PGN string, text string")
    assert [r["pgn"] for r in sg.read_games(df, "game_id").collect()] == ([kept] if kept else [])


def test_seeds_follow_the_openings(spark):
    empty = spark.createDataFrame([], "opening_id long, name string, pgn string")
    rows = sg.read_openings(empty).orderBy("opening_id").collect()
    assert len(rows) == 22 and rows[0]["opening_id"] == 0 and rows[0]["pgn"] == "1.e4 e5"


@pytest.mark.parametrize("n", [0, 1, 2, 5, 11, 100])
def test_split_sizes(spark, n):
    found = pz.split_80_10_10(spark.range(n).withColumnRenamed("id", "puzzle_id"))
    counts = {r["split"]: r["count"] for r in found.groupBy("split").count().collect()}
    held = -(-n // 5)
    expected = {"train": n - held, "validation": held // 2, "test": held - held // 2}
    assert counts == {name: size for name, size in expected.items() if size}


def test_split_of_eleven(spark):
    found = pz.split_80_10_10(spark.range(11).withColumnRenamed("id", "puzzle_id"))
    assert {r["split"]: r["count"] for r in found.groupBy("split").count().collect()} == {
        "train": 8, "validation": 1, "test": 2
    }


def test_theme_filters(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, None), (4, "b")], "i int, Themes string")
    ids = lambda rows: [r["i"] for r in rows.orderBy("i").collect()]
    assert ids(pz.require_themes(df, ["a"])) == [1]
    assert ids(pz.require_themes(df, [])) == [1, 2, 3, 4]
    assert ids(pz.exclude_themes(df, ["a", "x"])) == [2, 3, 4]


def test_describe_edges(spark):
    rows = [(None, 4), (1, 4), (2, 4), (10, 4)]
    df = spark.createDataFrame(rows, "x int, y int")
    x, y = pz.describe_numeric(df, ["x", "y"]).orderBy("column").collect()
    assert (x["count"], x["min"], x["q25"], x["q50"], x["q75"], x["max"]) == (3, 1.0, 1.5, 2.0, 6.0, 10.0)
    assert (y["std"], y["q50"]) == (0.0, 4.0)
    nothing = pz.describe_numeric(df.limit(0), ["x"]).first()
    assert nothing["count"] == 0 and nothing["q50"] is None


def test_fen_text(spark):
    fen = "r/1/2/3/4/5/6/K w - - 0 1"
    texts = {
        "first line": f"{fen}\n1. Qh5 e6",
        "complete": f"Paul v Carl, 1857 \n  {fen}\r\n\n \n1. Rxc7+ Kb8 2. Q#\n",
        "no solution": f"cite\n{fen}\n\n",
        "not numbered": f"cite\n{fen}\nQh5",
        "blank before": f"cite\n\n{fen}\n1. Qh5",
        "twice": f"cite\n{fen}\n{fen}\n1. Qh5",
        "empty": "",
    }
    df = spark.createDataFrame(list(texts.items()), "source string, text string")
    rows = {r["source"]: r for r in sp.parse_fen_puzzles(df).collect()}
    assert set(rows) == {"complete", "twice"}
    assert tuple(rows["complete"])[1:] == ("Paul v Carl, 1857", fen, "1. Rxc7+ Kb8 2. Q#", "Rxc7+")
    assert rows["twice"]["citation"] == fen


def test_first_failing_check_decides(spark):
    rows = [(None, None, False, None), ("u", None, False, None), ("u", "s", False, None), ("u", "s", True, None), ("u", "s", True, "")]
    df = spark.createDataFrame(rows, "best_uci string, best_san string, has_game boolean, pgn_context string")
    assert {r["outcome"]: r["n"] for r in pz.skip_reasons(df).collect()} == {
        "no move": 1, "move not legal": 1, "no source game": 1, "position not found": 1, "written": 1
    }


def test_quartiles_of_several_columns(spark):
    draw = random.Random(12)
    inf, nan = float("inf"), float("nan")
    rows = [(draw.randint(0, 9), draw.gauss(0, 1e6), draw.choice([1.5, -2.5, None]), None) for _ in range(700)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double")
    found = {row["column"]: row for row in pz.describe_numeric(df, ["a", "b", "c", "d"]).collect()}
    for i, name in enumerate("abc"):
        values = sorted(row[i] for row in rows if row[i] is not None)
        for share, label in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            place = (len(values) - 1) * share
            low, high = values[int(place)], values[min(int(place) + 1, len(values) - 1)]
            assert found[name][label] == pytest.approx(low + (high - low) * (place - int(place)))
    assert found["d"]["count"] == 0 and found["d"]["q50"] is None
    edge = spark.createDataFrame([(-inf,), (-1e308,), (1e308,), (inf,), (nan,)], "x double")
    row = pz.describe_numeric(edge, ["x"]).first()
    assert (row["q25"], row["q50"], row["q75"]) == (-1e308, 1e308, inf)
