import pytest
from pyspark.sql import functions as F

from plyforge.functions import notation as nt
from plyforge.functions import scoring as sc


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_half_moves(spark):
    text = F.lit("1.e4 e5 2.Nf3+ Nc6 3.Bb5#")
    assert value(spark, nt.parse_half_moves(text)) == ["e4", "e5", "Nf3+", "Nc6", "Bb5#"]
    assert value(spark, nt.parse_half_moves(F.lit(" 1... e5 2. Nf3"))) == ["e5", "Nf3"]
    assert value(spark, nt.parse_half_moves(F.lit(""))) == []


def test_isolated_pieces(spark):
    text = F.lit("1.e4 e5 2.Nf3+ Nc6 3.Bb5#")
    assert value(spark, nt.pretokenize(text)) == [
        "1.", "e4", " e5", " 2.", "Nf3", "+ ", "Nc6", " 3.", "Bb5", "#"
    ]
    assert value(spark, nt.find_pieces(F.lit("e4+ ?x"))) == ["e4", "+", " ", "x"]


@pytest.mark.parametrize(
    "text, finetune, evaluation",
    [
        ("1.e4 e5 *", "1.e4 e5 *", "1.e4 e5"),
        ("1.e4 e5 1-0", "1.e4 e5", "1.e4 e5"),
        ("1.e4 e5 1/2-1/2\n", "1.e4 e5", "1.e4 e5"),
        ("1.e4 e5*", "1.e4 e5", "1.e4 e5"),
        ("1.e4 e5", "1.e4 e5", "1.e4 e5"),
    ],
)
def test_result_mark(spark, text, finetune, evaluation):
    assert value(spark, nt.strip_result(F.lit(text), "finetune")) == finetune
    assert value(spark, nt.strip_result(F.lit(text), "evaluation")) == evaluation


def test_numbering_round_trip(spark):
    moves = F.lit(["e4", "e5", "Nf3"])
    assert value(spark, nt.numbered_text(moves)) == "1.e4 e5 2.Nf3"
    assert value(spark, nt.parse_half_moves(nt.numbered_text(moves))) == ["e4", "e5", "Nf3"]
    assert value(spark, nt.numbered_text(F.array().cast("array<string>"))) == ""


def test_small_functions(spark):
    assert value(spark, nt.opening_spacing(F.lit("1. e4 e5 2. Nf3"))) == "1.e4 e5 2.Nf3"
    assert value(spark, nt.normalise_san(F.lit("Nf6+#"))) == "Nf6"
    assert value(spark, nt.normalise_san(F.lit(None).cast("string"))) == ""
    assert value(spark, nt.game_id_from_url(F.lit("https://lichess.org/AbCdEfGh/black#36"))) == "AbCdEfGh"
    assert value(spark, nt.game_id_from_url(F.lit("https://lichess.org/AbCdEfGh#55"))) == "AbCdEfGh"
    assert value(spark, nt.game_id_from_url(F.lit("short"))) is None
    assert value(spark, nt.position_key(F.lit("a w KQkq - 0 1"))) == "a w KQkq -"
    assert value(spark, nt.wrap_special(F.lit(" 1.e4 "))) == "[g_start]1.e4[g_end]"
    assert value(spark, nt.wrap_special(F.lit(" [g_start]1.e4"))) == "[g_start]1.e4"
    assert value(spark, nt.canonical_context(F.lit("1. e4 e5 2. Nf3 *"))) == "1.e4 e5 2.Nf3"


def test_next_move(spark):
    prefix = F.lit("1.e4 e5")
    assert value(spark, nt.next_move(prefix, F.lit("[g_start]1.e4 e5 2.Nf3 Nc6"))) == "Nf3"
    assert value(spark, nt.next_move(prefix, F.lit("1.e4 e5"))) is None


def test_first_move_token(spark):
    assert value(spark, nt.first_move_token(F.lit(" 1... Nf6 e5"))) == "Nf6"
    assert value(spark, nt.first_move_token(F.lit(" "))) is None
    assert value(spark, nt.first_completion_token(F.lit("1. 2.Nf6 e5"))) == "Nf6"
    assert value(spark, nt.first_completion_token(F.lit("1. 2..."))) is None


def test_scores(spark):
    number = lambda x: F.lit(x).cast("int")
    assert value(spark, sc.score_cp(number(12), number(None))) == 12
    assert value(spark, sc.score_cp(number(None), number(3))) == 9997
    assert value(spark, sc.score_cp(number(None), number(-3))) == -9997
    assert value(spark, sc.score_cp(number(None), number(0))) == -10000


def test_truncation_and_move_logprob(spark):
    ids = F.lit([1, 2, 3, 4, 5])
    assert value(spark, sc.truncate_left(ids, 3, F.lit(2))) == [3, 4, 5]
    assert value(spark, sc.truncate_left(ids, 9, F.lit(2))) == [1, 2, 3, 4, 5]
    assert value(spark, sc.truncate_left(ids, 3, F.lit(4))) is None
    logps = F.lit([-1.0, -2.0, -4.0])
    assert value(spark, sc.move_logprob(logps, F.lit(2))) == -6.0
    assert value(spark, sc.move_logprob(logps, F.lit(3))) is None
