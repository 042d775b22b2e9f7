"""Byte-pair vocabulary: counting, learning, encoding and decoding.

As columns, pieces are strings of symbols `<a><b>…`. In byte mode a symbol is a token id; in symbol
mode it is the hex of the symbol's UTF-8 bytes, so no text can collide with the brackets. Merging a
pair is then `replace('<a><b>', '<c>')`, which works from left to right without overlaps. Learning
and encoding work on ids instead, in Arrow batches.
"""

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.fixed import SPECIAL_TOKENS, UNKNOWN_ID
from plyforge.functions.notation import TRAINER_PIECES, find_pieces, pretokenize
from plyforge.operators.learning import FIRST_BYTE_MERGE, learn_merges
from plyforge.scale import text_list
from plyforge.session import checkpointed

# Fixed value: highest move number that may be one token.
LAST_TURN = 300

CODED_WORDS = 1 << 23  # of 8 bytes
PIECE_WORDS = 24  # of a text, a list and their place in the dictionary
SLICE_BYTES = 1 << 20
SPECIAL_PATTERN = r"\[g_start\]|\[g_end\]|\[unknown\]|\[pad\]"


def byte_tokens(corpus: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(key, pos, token): the UTF-8 bytes of each text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return corpus.select(key, F.posexplode(pairs).alias("pos", "_hex")).select(
        key, "pos", F.conv("_hex", 16, 10).cast("int").alias("token")
    )


def split_pieces(text: Column, pattern=TRAINER_PIECES, isolated=True, specials=False) -> Column:
    """Pieces of a text. `isolated` keeps the gaps; `specials` keeps special tokens whole."""
    if specials:
        pattern = f"{SPECIAL_PATTERN}|{pattern}"
    return pretokenize(text, pattern) if isolated else find_pieces(text, pattern)


def piece_counts(corpus: DataFrame, pieces: Column) -> DataFrame:
    """(piece, freq): all later work follows the number of distinct pieces."""
    return (
        corpus.select(F.explode(pieces).alias("piece"))
        .groupBy("piece")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def base_symbols(piece: Column, mode="symbol") -> Column:
    """The bracketed starting symbols: characters, or bytes as ids."""
    if mode == "byte":
        pairs = F.regexp_extract_all(F.hex(F.encode(piece, "UTF-8")), F.lit("(..)"), F.lit(1))
        return F.array_join(
            F.transform(pairs, lambda h: F.concat(F.lit("<"), F.conv(h, 16, 10), F.lit(">"))), ""
        )
    chars = F.regexp_extract_all(piece, F.lit("(?s)(.)"), F.lit(1))
    return F.array_join(
        F.transform(
            chars, lambda c: F.concat(F.lit("<"), F.hex(F.encode(c, "UTF-8")), F.lit(">"))
        ),
        "",
    )


def symbol_list(symbols: Column) -> Column:
    """`<a><b>` to `[a, b]`."""
    return F.split(F.substring(symbols, F.lit(2), F.length(symbols) - 2), "><")


def pair_counts(pieces: DataFrame) -> DataFrame:
    """(left, right, n) of adjacent symbols in (symbols, freq), weighted by piece frequency."""
    listed = pieces.select(symbol_list(F.col("symbols")).alias("s"), "freq")
    pairs = F.transform(
        F.slice("s", F.lit(1), F.size("s") - 1),
        lambda left, i: F.struct(left.alias("left"), F.get(F.col("s"), i + 1).alias("right")),
    )
    return (
        listed.select(F.explode(pairs).alias("p"), "freq")
        .groupBy("p.left", "p.right")
        .agg(F.sum("freq").alias("n"))
    )


def top_pairs(counts: DataFrame, k=1, mode="symbol") -> DataFrame:
    """The `k` most frequent pairs; ties by (left, right)."""
    sides = [F.col(c).cast("int") if mode == "byte" else F.col(c) for c in ("left", "right")]
    return counts.orderBy(F.desc("n"), *sides).limit(k)


def merge_pairs(symbols: Column, merges) -> Column:
    """Apply (left, right, new) symbol merges one after the other."""
    if not merges:
        return symbols
    pairs = text_list(f"<{left}><{right}>" for left, right, _ in merges)
    rules = F.arrays_zip(pairs, text_list(f"<{new}>" for _, _, new in merges))
    return F.aggregate(rules, symbols, lambda s, rule: F.replace(s, rule["0"], rule["1"]))


def _text(hex_symbol: str) -> str:
    return bytes.fromhex(hex_symbol).decode("utf-8")


def merge_table(spark: SparkSession, merges, mode="symbol") -> DataFrame:
    """(rank, left, right, token, n); symbols as text, or as ids in byte mode."""
    show = (lambda s: s) if mode == "byte" else _text
    rows = [(rank, show(a), show(b), show(new), n) for rank, a, b, new, n in merges]
    return spark.createDataFrame(rows, "rank int, left string, right string, token string, n long")


def train_bpe(
    corpus: DataFrame,
    pieces: Column,
    vocab_size=None,
    mode="symbol",
    specials=SPECIAL_TOKENS,
    n_merges=None,
) -> tuple:
    """(merges, vocabulary) tables, as large as `vocab_size` or after `n_merges` merges.

    Byte mode starts from 256 byte ids. Symbol mode numbers the special tokens first, then the
    distinct characters, then the merges.
    """
    spark = corpus.sparkSession
    counted = checkpointed(piece_counts(corpus, pieces))
    if mode == "byte":
        merges = learn_merges(counted, n_merges or vocab_size - FIRST_BYTE_MERGE, mode)
        return merge_table(spark, merges, mode), byte_vocabulary(spark, merges)
    symbols = counted.select(
        F.explode(symbol_list(base_symbols(F.col("piece")))).alias("s")
    ).distinct()
    base = sorted(row[0] for row in symbols.where(F.col("s") != "").collect())
    merges = learn_merges(counted, n_merges or vocab_size - len(specials) - len(base), mode)
    return merge_table(spark, merges, mode), symbol_vocabulary(spark, base, merges, specials)


def byte_vocabulary(spark: SparkSession, merges) -> DataFrame:
    """(token_id, hex): the bytes of every byte-mode token."""
    known = {str(i): f"{i:02X}" for i in range(FIRST_BYTE_MERGE)}
    for _, left, right, new, _ in merges:
        known[new] = known[left] + known[right]
    rows = [(int(token), value) for token, value in known.items()]
    return spark.createDataFrame(rows, "token_id int, hex string")


def symbol_vocabulary(spark: SparkSession, base, merges, specials=SPECIAL_TOKENS) -> DataFrame:
    """(token_id, hex): special tokens, characters, then merged symbols without repeats."""
    ordered = [token.encode("utf-8").hex().upper() for token in specials]
    ordered += list(base)
    seen = set(ordered)
    for _, _, _, new, _ in merges:
        if new not in seen:
            seen.add(new)
            ordered.append(new)
    return spark.createDataFrame(list(enumerate(ordered)), "token_id int, hex string")


def _rules(merges: DataFrame, vocabulary: DataFrame, mode: str) -> tuple:
    """Ids of the characters by code point, and merge rules (left id, right id, new id) by rank."""
    rows = merges.select("rank", "left", "right", "token").orderBy("rank").collect()
    if mode == "byte":
        return {}, [(int(r["left"]), int(r["right"]), int(r["token"])) for r in rows]
    ids = {_text(r["hex"]): r["token_id"] for r in vocabulary.select("hex", "token_id").collect()}
    characters = {ord(text): number for text, number in ids.items() if len(text) == 1}
    return characters, [(ids[r["left"]], ids[r["right"]], ids[r["token"]]) for r in rows]


def merge_ids(ids: list, ranks: dict) -> list:
    """Merge the pair of the lowest rank, in all its places from the left, until no pair has a rule.

    The ids are linked, and a heap holds (rank, place) of the pairs, so a piece of n symbols takes
    n log n steps. Outdated entries are recognised when they come up.
    """
    size = len(ids)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(ranks[pair][0], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
    heapify(heap)
    while heap:
        rank, made = heap[0][0], []
        while heap and heap[0][0] == rank:
            _, i = heappop(heap)
            j = after[i]
            rule = ranks.get((ids[i], ids[j])) if j < size and ids[i] is not None else None
            if rule is None or rule[0] != rank:
                continue
            ids[i], ids[j], after[i] = rule[1], None, after[j]
            if after[i] < size:
                before[after[i]] = i
            made.append(i)
        for i in made:
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < size and (rule := ranks.get((ids[left], ids[right]))):
                    heappush(heap, (rule[0], left))
    return [number for number in ids if number is not None]


def _piece_coder(characters: dict, rules, mode: str, specials) -> Callable:
    """A function from a piece to its ids; unknown characters in a row are one id."""
    ranks = {}
    for rank, (left, right, new) in enumerate(rules):
        ranks.setdefault((left, right), (rank, new))
    whole = {token: [number] for number, token in enumerate(specials if mode == "symbol" else ())}

    def code(piece: str) -> list:
        if mode == "byte":
            return merge_ids(list(piece.encode("utf-8")), ranks)
        if piece in whole:
            return whole[piece]
        ids = []
        for char in piece:
            number = characters.get(ord(char), UNKNOWN_ID)
            if number != UNKNOWN_ID or not ids or ids[-1] != UNKNOWN_ID:
                ids.append(number)
        return merge_ids(ids, ranks)

    return code


def piece_encoder(merges: DataFrame, vocabulary: DataFrame, mode="symbol", specials=SPECIAL_TOKENS) -> Callable:
    """A column function from lists of pieces to their ids, one after the other.

    It works on slices of Arrow batches: the distinct pieces of a slice are coded once, and a task
    keeps the codes of pieces it has seen, up to a bound in bytes. No row leaves its task.
    """
    characters, rules = _rules(merges, vocabulary, mode)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code, seen, held = _piece_coder(characters, rules, mode, specials), {}, 0
        for lists in chain.from_iterable(map(_row_slices, batches)):
            pieces = lists.flatten().dictionary_encode()
            if held > CODED_WORDS:
                seen, held = {}, 0
            coded = []
            for piece in pieces.dictionary.to_pylist():
                ids = seen.get(piece)
                if ids is None:
                    ids = seen[piece] = code(piece)
                    held += len(ids) + PIECE_WORDS
                coded.append(ids)
            yield _joined(lists, pieces.indices, coded)

    return encode


def _row_slices(lists: pa.Array) -> Iterator[pa.Array]:
    """Slices whose pieces have at most SLICE_BYTES bytes, or of one longer row."""
    flat = lists.flatten()
    if not len(flat):
        yield from [lists] if len(lists) else []
        return
    kind = np.int64 if pa.types.is_large_string(flat.type) else np.int32
    bounds = np.frombuffer(flat.buffers()[1], kind)[flat.offset :]  # of a batch's pieces, not copied
    per_row = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = bounds[np.cumsum(per_row)].astype(np.int64) - int(bounds[0])
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        end = max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), start + 1)
        yield lists.slice(start, end - start)
        start = end


def _joined(lists: pa.Array, pieces: pa.Array, coded: list) -> pa.Array:
    """For lists of piece numbers the lists of the pieces' ids; null pieces and lists have none."""
    sizes = np.array([len(ids) for ids in coded] + [0], np.int64)
    flat = np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    number = pieces.fill_null(len(coded)).to_numpy(zero_copy_only=False).astype(np.int64)
    length = sizes[number]
    ends = np.cumsum(length)
    places = np.repeat(starts[number] - (ends - length), length) + np.arange(length.sum())
    per_row = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_row)])]
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[places]))


def encode_pieces(
    pieces: DataFrame, merges: DataFrame, vocabulary: DataFrame, mode="symbol", specials=SPECIAL_TOKENS
) -> DataFrame:
    """Add `ids` to pieces. Unknown characters in a row give one unknown id."""
    encode = piece_encoder(merges, vocabulary, mode, specials)
    return pieces.withColumn("ids", encode(F.array("piece")))


def bpe_encode(
    corpus: DataFrame,
    pieces: Column,
    merges: DataFrame,
    vocabulary: DataFrame,
    keys=("doc_id",),
    mode="symbol",
) -> DataFrame:
    """(keys, ids): the ids of each row's pieces, in order; none for a null text. No shuffle."""
    encode = piece_encoder(merges, vocabulary, mode)
    return corpus.select(*keys, encode(pieces).alias("ids"))


def _vocabulary_lookup(vocabulary: DataFrame) -> Column:
    """The token bytes as an array literal indexed by id."""
    rows = vocabulary.select("token_id", "hex").collect()
    known = {row["token_id"]: row["hex"] for row in rows}
    return text_list(known.get(i, "") for i in range(max(known) + 1))


def bpe_decode(encoded: DataFrame, vocabulary: DataFrame, ids="ids") -> DataFrame:
    """Add `text`: the tokens' bytes joined, with invalid bytes replaced. No shuffle."""
    table = _vocabulary_lookup(vocabulary)
    joined = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    return encoded.withColumn("text", F.make_valid_utf8(F.unhex(joined).cast("string")))


def turn_token_ids(spark: SparkSession, merges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token_id): move numbers `N.` and ` N.` that are a single token."""
    grid = spark.range(1, LAST_TURN + 1).select(
        F.explode(F.array(F.concat("id", F.lit(".")), F.concat(F.lit(" "), "id", F.lit(".")))).alias("piece")
    )
    coded = encode_pieces(grid, merges, vocabulary)
    return coded.where(F.size("ids") == 1).select(F.get("ids", F.lit(0)).alias("token_id")).distinct()


def compression(encoded: DataFrame, text="text", ids="ids") -> DataFrame:
    """Characters, UTF-8 bytes, tokens, and bytes per token of the whole corpus."""
    n_bytes, tokens = F.sum(F.octet_length(text)), F.sum(F.size(ids).cast("long"))
    return encoded.agg(
        F.sum(F.char_length(text)).alias("n_chars"),
        n_bytes.alias("n_bytes"),
        tokens.alias("n_tokens"),
        F.try_divide(n_bytes.cast("double"), tokens).alias("ratio"),
    )
