"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document is cut into pieces whose lengths are parts of the capacity (capacity, a half, a quarter,
down to `least`) and one short tail. A piece of length in (capacity/(k+1), capacity/k] belongs to
class k, and each sequence of class k holds exactly k pieces. Every task fills its own sequences,
so nothing is shuffled; what is left over in its open sequences is laid end to end at its close,
and the last such sequence is cut into powers of two, which need no padding.

Defined cases: null and empty texts are the end id alone; null ids, ties and repeated rows are
packed row by row; an empty table gives no pieces; other columns are left out; long texts are held
one at a time.
"""

import json
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm import batches as B

CAPACITY = 2048
LEAST = 128
END = 1
TOKENIZER = "byte_bpe_50k.json"

#: The usual pattern of byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long,"
    " offset long"
)
_FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(byte): byte for byte in shown}
    hidden = [byte for byte in range(256) if byte not in shown]
    return letters | {chr(256 + i): byte for i, byte in enumerate(hidden)}


class Encoder:
    """Token ids of texts as 32-bit arrays, equal to those of the vocabulary file's own library.

    A plain byte-level vocabulary is coded by a faster library with the same merges; the file's own
    library codes texts that hold a special token, and all texts of other vocabularies.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [token["content"] for token in spec.get("added_tokens", [])]
        self.whole = Tokenizer.from_file(path)
        self.fast = None
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (
            model["type"] == "BPE"
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(model.get(key) for key in ("dropout", "continuing_subword_prefix"))
            and not any(model.get(key) for key in ("end_of_word_suffix", "ignore_merges"))
        )
        if plain:
            import tiktoken

            letters = _byte_letters()
            special = set(self.special)
            ranks = {
                bytes(letters[letter] for letter in token): code
                for token, code in model["vocab"].items()
                if token not in special
            }
            self.fast = tiktoken.Encoding(
                "plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(token in text for token in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast(text), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity=CAPACITY, least=LEAST) -> list[int]:
    """Lengths of a document's pieces: whole sequences, halves of them, and a tail below `least`."""
    out, size = [], capacity
    while n:
        if n >= size:
            out.append(size)
            n -= size
        elif size > least:
            size //= 2
        else:
            out.append(n)
            n = 0
    return out


class Packer:
    """The sequences of one task. `rows` collects (doc_id, start, length, ids, tokens, seq, at)."""

    def __init__(self, first: int, capacity=CAPACITY, least=LEAST):
        self.capacity, self.least = capacity, least
        self.number = count(first)
        self.open, self.rows = {}, []

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for length in cuts(total, self.capacity, self.least):
            fits = self.capacity // length
            group = self.open.setdefault(fits, [])
            group.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total))
            start += length
            if len(group) == fits:
                self._emit(self.open.pop(fits))

    def _emit(self, pieces) -> None:
        sequence, at = next(self.number), 0
        for piece in pieces:
            self.rows.append((*piece, sequence, at))
            at += piece[2]

    def close(self) -> None:
        """Lay the open sequences' pieces end to end, with sizes that need no padding."""
        pieces = [piece for fits in sorted(self.open) for piece in self.open[fits]]
        left = sum(piece[2] for piece in pieces)
        room, group = 0, []
        while pieces or group:
            if not room:
                if group:
                    self._emit(group)
                    group = []
                room = min(self.capacity, 1 << (left.bit_length() - 1)) if left else 0
                if not room:
                    break
            doc_id, start, length, ids, total = pieces.pop(0)
            taken = min(length, room)
            group.append((doc_id, start, taken, ids[: 4 * taken], total))
            if taken < length:
                pieces.insert(0, (doc_id, start + taken, length - taken, ids[4 * taken :], total))
            room -= taken
            left -= taken
        self.open = {}


def pack(
    docs: DataFrame, *, doc_id="doc_id", text="text", tokenizer=None, end=END,
    capacity=CAPACITY, least=LEAST,
) -> DataFrame:
    """Pieces of all documents with their place in a sequence; `ids` are little-endian 32-bit ids.

    Sequence numbers are unique, not dense: the task's number is in their upper bits. `capacity`
    is a power of two. Fill of a sequence: the sum of its pieces' lengths.
    """
    path = tokenizer or default_tokenizer()
    closing = np.array([end], np.uint32)
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )

    def work(batches):
        code = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, least)

        def taken():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS
            )

        for batch in B.slices(batches, "text"):
            for key, value in zip(batch.column("doc_id").to_pylist(), B.texts(batch.column("text"))):
                packer.add(key, np.append(code(value), closing).astype("<u4").tobytes())
            if packer.rows:
                yield taken()
        packer.close()
        if packer.rows:
            yield taken()

    return narrow.mapInArrow(work, SCHEMA)
