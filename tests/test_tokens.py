"""The tokenizer against a plain one-merge-at-a-time version."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plyforge.functions.notation import TRAINER_PIECES
from plyforge.operators import learning
from plyforge.operators import tokens as tk


def merged(symbols, left, right, new):
    out, i = [], 0
    while i < len(symbols):
        if symbols[i : i + 2] == [left, right]:
            out.append(new)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def plain_training(pieces, n, byte):
    words = [(list(p.encode()) if byte else list(p), f) for p, f in pieces.items()]
    merges = []
    for rank in range(n):
        counts = Counter()
        for symbols, freq in words:
            for pair in zip(symbols, symbols[1:]):
                counts[pair] += freq
        if not counts:
            break
        (left, right), _ = min(counts.items(), key=lambda item: (-item[1], item[0]))
        new = 256 + rank if byte else left + right
        merges.append((left, right, new))
        words = [(merged(symbols, left, right, new), freq) for symbols, freq in words]
    return merges


def plain_encoding(symbols, merges):
    ranks = {}
    for rank, (left, right, new) in enumerate(merges):
        ranks.setdefault((left, right), (rank, new))
    while True:
        found = [(*ranks[p], p) for p in zip(symbols, symbols[1:]) if p in ranks]
        if not found:
            return symbols
        _, new, (left, right) = min(found)
        symbols = merged(symbols, left, right, new)


def random_pieces(seed, alphabet):
    draw = random.Random(seed)
    return {
        "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 9))): draw.randint(1, 4)
        for _ in range(60)
    }


@pytest.mark.parametrize("alphabet", ["ab", "aab", "abcdef", "aé♞😀", "<>{}"])
@pytest.mark.parametrize("mode", ["symbol", "byte"])
def test_learning_equals_one_merge_at_a_time(spark, alphabet, mode):
    pieces = random_pieces(len(alphabet), alphabet)
    df = spark.createDataFrame(list(pieces.items()), "piece string, freq long")
    found = tk.learn_merges(df, 25, mode, every=3)
    show = int if mode == "byte" else tk._text
    assert [tuple(show(s) for s in merge[1:4]) for merge in found] == plain_training(
        pieces, 25, mode == "byte"
    )


def test_short_top_list_gives_the_same_merges(spark):
    pieces = random_pieces(5, "abcdefgh")
    df = spark.createDataFrame(list(pieces.items()), "piece string, freq long")
    assert tk.learn_merges(df, 20, top=3) == tk.learn_merges(df, 20)


def test_learning_stops_without_pairs(spark):
    df = spark.createDataFrame([("ab", 3), ("c", 9)], "piece string, freq long")
    assert [m[1:4] for m in tk.learn_merges(df, 5)] == [("61", "62", "6162")]


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


GAMES = [
    "[g_start]1.d4 d5 2.Nf3 Bf5[g_end]",
    "1.e4 e5 2.Nf3 Nc6 3.Bb5 a6 4.Ba4+ Nf6 10.O-O",
    "1.e4 c5 2.Nf3 d6 3.d4 cxd4 4.Nxd4 Nf6 5.Nc3",
    "",
    "é ♞ 😀😀 [g_end][g_start]",
]


@pytest.mark.parametrize("mode", ["symbol", "byte"])
def test_round_trip(spark, mode):
    docs = corpus(spark, GAMES)
    pieces = tk.split_pieces(F.col("text"), TRAINER_PIECES, specials=mode == "symbol")
    size = 300 if mode == "byte" else 70
    merges, vocabulary = tk.train_bpe(docs, pieces, size, mode)
    encoded = tk.bpe_encode(docs, pieces, merges, vocabulary, mode=mode)
    decoded = tk.bpe_decode(encoded, vocabulary)
    assert {r["doc_id"]: r["text"] for r in decoded.collect()} == dict(enumerate(GAMES))
    assert encoded.where("size(ids) = 0").count() == 1


@pytest.mark.parametrize("letters, n", [("abcd", 15), ("abcdefghijkl", 400)])
def test_encoding_equals_lowest_rank_first(spark, letters, n):
    pieces = random_pieces(3, letters)
    rules = plain_training(pieces, n, True)
    df = spark.createDataFrame([(p,) for p in pieces], "piece string")
    merges = tk.merge_table(spark, [(i, str(a), str(b), str(n), 0) for i, (a, b, n) in enumerate(rules)], "byte")
    found = {r["piece"]: r["ids"] for r in tk.encode_pieces(df, merges, None, "byte").collect()}
    assert found == {p: plain_encoding(list(p.encode()), rules) for p in pieces}


def test_merges_out_of_order(spark):
    # 256 has two producers, and the merge of 97 and 257 comes before the one that makes 257.
    rules = [(97, 257, 258), (97, 98, 256), (98, 99, 257), (99, 97, 256)]
    pieces = ["abc", "aabc", "bcabca", "cacaab", "a"]
    df = spark.createDataFrame([(p,) for p in pieces], "piece string")
    merges = tk.merge_table(spark, [(i, str(a), str(b), str(n), 0) for i, (a, b, n) in enumerate(rules)], "byte")
    found = {r["piece"]: r["ids"] for r in tk.encode_pieces(df, merges, None, "byte").collect()}
    assert found == {p: plain_encoding(list(p.encode()), rules) for p in pieces}


def test_unknown_characters_are_fused(spark):
    docs = corpus(spark, ["ab ab"])
    pieces = F.split("text", " ")
    merges, vocabulary = tk.train_bpe(docs, pieces, 7)
    df = spark.createDataFrame([("ab",), ("xyab",), ("axyzb",), ("[pad]",)], "piece string")
    found = {r["piece"]: r["ids"] for r in tk.encode_pieces(df, merges, vocabulary).collect()}
    assert found == {"ab": [6], "xyab": [2, 6], "axyzb": [4, 2, 5], "[pad]": [3]}


def test_empty_pieces_have_no_ids(spark):
    docs = corpus(spark, ["ab  ab", " "])
    pieces = F.split("text", " ")
    merges, vocabulary = tk.train_bpe(docs, pieces, n_merges=1)
    found = {r["doc_id"]: r["ids"] for r in tk.bpe_encode(docs, pieces, merges, vocabulary).collect()}
    assert found == {0: [6, 6], 1: []}


def test_merge_overlap(spark):
    row = spark.createDataFrame([("aaa",)], "p string").select(
        tk.symbol_list(tk.merge_pairs(tk.base_symbols(F.col("p")), [("61", "61", "6161")]))
    )
    assert row.first()[0] == ["6161", "61"]


def test_turn_tokens(spark):
    docs = corpus(spark, [" ".join(f"{n}.e4 e5" for n in range(1, 13))] * 3)
    pieces = tk.split_pieces(F.col("text"))
    merges, vocabulary = tk.train_bpe(docs, pieces, 60)
    ids = {r[0] for r in tk.turn_token_ids(spark, merges, vocabulary).collect()}
    texts = {r["token_id"]: bytes.fromhex(r["hex"]).decode() for r in vocabulary.collect()}
    assert ids and all(texts[i].strip().rstrip(".").isdigit() for i in ids)
    assert ids == {i for i, t in texts.items() if t[-1:] == "." and t.strip()[:-1].isdigit()}


def test_compression_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, ids array<int>")
    assert tk.compression(empty).first()["ratio"] is None


def test_invalid_bytes_are_replaced(spark):
    vocabulary = spark.createDataFrame([(0, "C3"), (1, "61")], "token_id int, hex string")
    df = spark.createDataFrame([([0, 1],)], "ids array<int>")
    assert tk.bpe_decode(df, vocabulary).first()["text"] == "�a"


def test_a_batch_is_worked_through_in_slices(monkeypatch):
    """Long pieces: memory follows a slice and the ids that are kept, not the rows of a batch."""
    monkeypatch.setattr(learning, "SLICE_SYMBOLS", 8)
    batch = pa.RecordBatch.from_pydict({"piece": ["abc", "d", "efgh", "x" * 20, "", "yz"], "freq": [1, 2, 3, 4, 5, 6]})
    assert [part.num_rows for part in learning._slices([batch], "piece")] == [3, 1, 2]
    found = list(learning._start(False)([batch]))
    assert [len(part) for part in found] == [3, 1, 2]
    whole = pa.Table.from_batches(found)
    assert whole["ids"].to_pylist() == [[ord(c) for c in piece] for piece in batch["piece"].to_pylist()]
    counts = [list(learning._count(whole.combine_chunks().to_batches()))[0]]
    monkeypatch.setattr(learning, "SLICE_SYMBOLS", 1 << 20)
    assert counts[0].to_pydict() == list(learning._count(whole.combine_chunks().to_batches()))[0].to_pydict()


def test_rows_are_encoded_in_slices(monkeypatch):
    monkeypatch.setattr(tk, "SLICE_BYTES", 4)
    lists = pa.array([["skipped"], ["ab", "c"], None, ["d"], [], ["efghij", None], ["k"]], pa.list_(pa.string()))[1:]
    parts = list(tk._row_slices(lists))
    assert [len(part) for part in parts] == [4, 1, 1]
    assert [row for part in parts for row in part.to_pylist()] == lists.to_pylist()
    assert list(tk._row_slices(lists[:0])) == []
