"""Corpus to training windows."""

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions.notation import wrap_special
from plyforge.operators.tokens import bpe_encode, split_pieces
from plyforge.operators.windows import token_offsets, training_windows
from plyforge.scale import BROADCAST_ROWS, ROWS_PER_BUCKET
from plyforge.session import bucketed, written


def encode_games(corpus: DataFrame, merges: DataFrame, vocabulary: DataFrame, key="order_key") -> DataFrame:
    """(key, ids) of wrapped games."""
    wrapped = corpus.select(key, wrap_special(F.col("pgn")).alias("_text"))
    pieces = split_pieces(F.col("_text"), specials=True)
    return bpe_encode(wrapped, pieces, merges, vocabulary, keys=[key])


def window_dataset(
    corpus: DataFrame, merges: DataFrame, vocabulary: DataFrame, block: int, stride=1, turn_ids=()
) -> DataFrame:
    """Training windows of the games in `order_key` order, ready to be written.

    The token table is written once: its offsets take several passes over narrow columns. For more
    games than are broadcast it is written in buckets, so that the offsets come to the tokens.
    """
    rows = corpus.count()
    encoded = encode_games(corpus, merges, vocabulary)
    if rows <= BROADCAST_ROWS:
        encoded = written(encoded, "tokens")
    else:
        encoded = bucketed(encoded, "order_key", ceil(rows / ROWS_PER_BUCKET), "tokens")
    return training_windows(token_offsets(encoded, "order_key"), block, stride, turn_ids)
