"""Column functions over move text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token texts, numbering and result patterns, pre-token patterns.
GAME_START = "[g_start]"
GAME_END = "[g_end]"
BLANKS = " \t\n\r\f\x0b"
MOVE_NUMBER = r"\d+\.+"
MOVE_NUMBER_AND_GAP = r"\d+\.+\s*"
FINETUNE_RESULT = r"\b(1-0|0-1|1/2-1/2|\*)\s*$"
EVALUATION_RESULT = r"\s*(1-0|0-1|1/2-1/2|\*)\s*$"
TRAINER_PIECES = r" ?\d+\.|\. ?| ?[-\w]+|[#+]\s+"
NOTEBOOK_PIECES = r" ?\d+\.|\. ?| ?[-\w]+|[#+]|\s+"

_MARK = "\u0001"


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Split on white space, without empty parts."""
    return F.filter(F.split(text, r"\s+"), lambda part: part != "")


def strip_specials(text: Column) -> Column:
    bare = F.replace(F.replace(text, F.lit(GAME_START), F.lit("")), F.lit(GAME_END), F.lit(""))
    return strip_blanks(bare)


def strip_result(text: Column, dialect="evaluation") -> Column:
    """Drop a final result mark.

    The `finetune` dialect needs a word boundary before the mark, so ` *` stays.
    """
    pattern = FINETUNE_RESULT if dialect == "finetune" else EVALUATION_RESULT
    return strip_blanks(F.regexp_replace(text, pattern, ""))


def parse_half_moves(text: Column, dialect="plain") -> Column:
    """Move text to an array of half-moves.

    `plain` only drops move numbers; `finetune` and `evaluation` first drop special tokens
    and the result mark, each in its own way.
    """
    if dialect == "plain":
        return words(F.regexp_replace(text, MOVE_NUMBER_AND_GAP, " "))
    numbers = MOVE_NUMBER_AND_GAP if dialect == "finetune" else MOVE_NUMBER
    bare = strip_result(strip_specials(text), dialect)
    return words(F.regexp_replace(bare, numbers, " "))


def numbered_text(moves: Column) -> Column:
    """`[e4, e5, Nf3]` to `1.e4 e5 2.Nf3`."""
    numbered = F.transform(
        moves,
        lambda move, i: F.when(
            i % 2 == 0, F.concat((F.floor(i / 2) + 1).cast("string"), F.lit("."), move)
        ).otherwise(move),
    )
    return F.array_join(numbered, " ")


def canonical_context(text: Column) -> Column:
    """Rewrite older records' context text to the numbered form without a result mark."""
    return numbered_text(parse_half_moves(text, "evaluation"))


def wrap_special(text: Column) -> Column:
    """Trim, then put start and end tokens around text that has no start token."""
    bare = strip_blanks(text)
    return F.when(bare.startswith(GAME_START), bare).otherwise(
        F.concat(F.lit(GAME_START), bare, F.lit(GAME_END))
    )


def opening_spacing(text: Column) -> Column:
    """`1. e4` to `1.e4`."""
    return F.regexp_replace(text, r"(\d+)\. ", "$1.")


def position_key(fen: Column) -> Column:
    """First four fields: the position without its clocks."""
    return F.array_join(F.slice(words(fen), 1, 4), " ")


def game_id_from_url(url: Column) -> Column:
    """Fourth `/` segment, cut at `#`; null when the address is too short."""
    return F.get(F.split(F.get(F.split(url, "/"), 3), "#"), 0)


def normalise_san(move: Column) -> Column:
    """Drop check and mate signs; null becomes the empty string."""
    return strip_blanks(F.rtrim(F.coalesce(move, F.lit("")), F.lit("+#")))


def san_key(move: Column) -> Column:
    """The form under which a move is looked up: one final check or mate sign is optional."""
    return F.regexp_replace(move, r"[+#]$", "")


def next_move(prefix: Column, generated: Column) -> Column:
    """First move of `generated` beyond the moves of `prefix`; null when there is none."""
    return F.get(
        parse_half_moves(generated, "evaluation"), F.size(parse_half_moves(prefix, "evaluation"))
    )


def first_move_token(text: Column) -> Column:
    """First token after a leading move number; null when there is none."""
    bare = F.regexp_replace(strip_blanks(text), r"^\d+\.+\s*", "")
    return F.get(words(bare), 0)


def first_completion_token(text: Column) -> Column:
    """First token that is more than a move number, without its number."""
    bare = F.transform(words(text), lambda part: F.regexp_replace(part, r"^\d+\.+", ""))
    return F.get(F.filter(bare, lambda part: part != ""), 0)


def pretokenize(text: Column, pattern=TRAINER_PIECES) -> Column:
    """Pieces with matches and the gaps between them both kept, in order."""
    marked = F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}")
    return F.filter(F.split(marked, _MARK), lambda piece: piece != "")


def find_pieces(text: Column, pattern=NOTEBOOK_PIECES) -> Column:
    """Only the matches, in order."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
