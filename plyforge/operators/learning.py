"""Learning byte-pair merges from an inverted index of the distinct pieces.

A symbol is a number: a character's code point, or a byte in byte mode; merged symbols are numbered
on from there. A pair of symbols is one 64-bit number.
"""

from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.session import removed, scratch_path, written

# Fixed value: first merge id in byte mode.
FIRST_BYTE_MERGE = 256

FIRST_MERGED = 0x110000
TOP_PAIRS = 256
HEAD_PAIRS = 8192
ROUND_PAIRS = 64
MERGES_PER_INDEX = 128
BUCKETS = 32
LONG_PIECE = 64
SLICE_SYMBOLS = 1 << 20
INDEX_SYMBOLS = 1 << 16  # each stands in the index up to LONG_PIECE times
HELD_PAIRS = 1 << 20
COUNTS = "pair long, n long"


def _slices(batches, column, limit=None):
    """Slices of the batches with at most `limit` symbols (bytes of a text), or of one longer row.

    A batch is bounded by its rows, and a piece may be as long as a whole text.
    """
    for batch in batches:
        values = batch.column(column)
        size = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, before + (limit or SLICE_SYMBOLS), "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def _ragged(column) -> tuple:
    """(symbols, row of each) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _listed(symbols, rows, n) -> pa.Array:
    bounds = np.searchsorted(rows, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(symbols.astype(np.int32)))


def _pairs(symbols, rows) -> tuple:
    """(pair, row) of adjacent symbols."""
    inside = rows[1:] == rows[:-1]
    return ((symbols[:-1] << 32) | symbols[1:])[inside], rows[1:][inside]


def _merged(symbols, rows, rules) -> tuple:
    """The merges one after the other, each in all its places from the left."""
    for left, right, new in rules:
        at = np.flatnonzero((symbols[:-1] == left) & (symbols[1:] == right) & (rows[:-1] == rows[1:]))
        if not len(at):
            continue
        if left == right:  # of a run of equal symbols every second place
            first = np.append(True, np.diff(at) != 1)
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        symbols[at] = new
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols, rows = symbols[kept], rows[kept]
    return symbols, rows


def _totals(parts) -> pa.RecordBatch:
    """Pairs with their summed weights, those that add up to 0 left out."""
    pairs, weights = (np.concatenate([np.zeros(0, np.int64), *column]) for column in zip(*parts)) if parts else ([], [])
    pairs, place = np.unique(np.asarray(pairs, np.int64), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, place, np.asarray(weights, np.int64))
    kept = total != 0
    return pa.RecordBatch.from_arrays([pa.array(pairs[kept]), pa.array(total[kept])], names=["pair", "n"])


def _held(parts) -> list:
    """Pair counts that are summed up whenever there are many, and twice as many as after the last time."""
    if sum(len(pairs) for pairs, _ in parts) > max(HELD_PAIRS, 2 * len(parts[0][0])):
        return [tuple(column.to_numpy() for column in _totals(parts).columns)]
    return parts


def _start(byte: bool):
    """Pieces as lists of symbols."""

    def run(batches):
        for batch in _slices(batches, "piece"):
            code = (lambda p: list(p.encode("utf-8"))) if byte else (lambda p: [ord(char) for char in p])
            ids = pa.array([code(piece) for piece in batch.column("piece").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, batch.column("freq")], names=["ids", "freq"])

    return run


def _rewritten(rules):
    def run(batches):
        for batch in _slices(batches, "ids"):
            symbols, rows = _merged(*_ragged(batch.column("ids")), rules)
            ids = _listed(symbols, rows, batch.num_rows)
            yield pa.RecordBatch.from_arrays([ids, batch.column("freq")], names=["ids", "freq"])

    return run


def _count(batches):
    """Pair counts of a task's pieces."""
    parts = []
    for batch in _slices(batches, "ids"):
        pairs, rows = _pairs(*_ragged(batch.column("ids")))
        parts = _held([*parts, (pairs, batch.column("freq").to_numpy()[rows])])
    yield _totals(parts)


def _index_rows(batches):
    """One row for each distinct pair of a piece, with the piece."""
    for batch in _slices(batches, "ids", INDEX_SYMBOLS):
        symbols, rows = _ragged(batch.column("ids"))
        pairs, owner = _pairs(symbols, rows)
        order = np.lexsort((pairs, owner))
        pairs, owner = pairs[order], owner[order]
        new = np.append(True, (np.diff(pairs) != 0) | (np.diff(owner) != 0))[: len(pairs)]
        pairs, owner = pairs[new], pa.array(owner[new])
        columns = [pa.array(_bucket(pairs)), pa.array(pairs), batch.column("ids").take(owner), batch.column("freq").take(owner)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "pair", "ids", "freq"])


def _bucket(pairs: np.ndarray) -> np.ndarray:
    spread = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((spread >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)


def _changes(wanted, pending, rules):
    """How the counts change in the pieces that hold one of the `wanted` pairs.

    A piece stands in the index under several of them; it counts under the first.
    """
    order = np.argsort(np.array(wanted, np.int64), kind="stable")
    known = np.array(wanted, np.int64)[order]

    def run(batches):
        parts = []
        for batch in _slices(batches, "ids"):
            symbols, rows = _ragged(batch.column("ids"))
            pairs, owner = _pairs(symbols, rows)
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            found = known[at] == pairs
            first = np.full(batch.num_rows, len(known))
            np.minimum.at(first, owner[found], order[at[found]])
            kept = first < len(known)
            own = batch.column("pair")
            stored = own.is_valid().to_numpy(zero_copy_only=False)
            kept &= ~stored | (np.array(wanted, np.int64)[np.minimum(first, len(known) - 1)] == own.fill_null(-1).to_numpy())
            inside = kept[rows]
            before = _merged(symbols[inside], rows[inside], pending)
            freq = batch.column("freq").to_numpy()
            old, old_rows = _pairs(*before)
            new, new_rows = _pairs(*_merged(before[0].copy(), before[1], rules))
            parts = _held([*parts, (old, -freq[old_rows]), (new, freq[new_rows])])
        yield _totals(parts)

    return run


def settled(rows, complete: bool, known=frozenset()) -> list:
    """How many of the ranked pairs can be merged at once with the same result as one by one.

    A later pair is safe while it shares no symbol with the pairs already taken: then its own
    count cannot change, and any pair made or reduced by them stems from a pair that shares a
    symbol with them. Those all rank lower; so that none can draw level, every pair with the
    same count must be free of the taken symbols too, and the last count is left out when the
    list was cut there. A pair of two equal symbols can give a pair of its own kind, and one
    that spells a `known` symbol adds to that symbol's pairs, so nothing follows either.
    """
    taken, used, spelled = [], set(), set(known)
    for i, row in enumerate(rows):
        if i:
            level = [r for r in rows if r["n"] == row["n"]]
            if not complete and row["n"] == rows[-1]["n"]:
                break
            if any({r["left"], r["right"]} & used for r in level if r not in taken):
                break
        taken.append(row)
        used |= {row["left"], row["right"]}
        new = row["left"] + row["right"]
        if row["left"] == row["right"] or new in spelled:
            break
        spelled.add(new)
    return taken


class Symbols:
    """Names of symbols, as they are ordered and given out: hex of the text, or ids in byte mode."""

    def __init__(self, byte: bool):
        self.byte, self.names, self.numbers = byte, {}, {}

    def name(self, number: int) -> str:
        if number in self.names:
            return self.names[number]
        return str(number) if self.byte else chr(number).encode("utf-8").hex().upper()

    def order(self, number: int):
        return number if self.byte else self.name(number)

    def merge(self, left: int, right: int) -> tuple:
        """(number, name, whether it is a name of before) of the merged symbol."""
        number = (FIRST_BYTE_MERGE if self.byte else FIRST_MERGED) + len(self.names)
        name = str(number) if self.byte else self.name(left) + self.name(right)
        respelled = name in self.numbers
        number = self.numbers.setdefault(name, number)
        self.names.setdefault(number, name)
        return number, name, respelled


class PairIndex:
    """An inverted index from pairs to the pieces that hold them, and the leading pair counts.

    The index is a written table in folders by hash of the pair; each row carries its piece, as it
    stood when the index was written. Later merges are applied to what a round reads, so rows never
    need rewriting. A pair with a merged symbol is looked up under the pair that the symbol was
    made of: every piece with the symbol held that pair. Pieces of more than `LONG_PIECE` symbols,
    which would be stored under too many pairs, are kept once and searched in every round.

    The driver keeps the counts of the first `head` pairs and of all pairs with a merged symbol.
    Any other pair comes after the last of that list and can only fall, so while the next pair is
    before that place, it is the right one.
    """

    def __init__(self, pieces: DataFrame, symbols: Symbols, head: int):
        spark = self.spark = pieces.sparkSession
        self.symbols, self.pending, self.made = symbols, [], {}
        short = pieces.where(F.size("ids") <= LONG_PIECE)
        rows = short.mapInArrow(_index_rows, "bucket int, pair long, ids array<int>, freq long")
        # Pieces are dealt out evenly, so each task writes its own part of every folder, without a shuffle.
        dealt = rows.sortWithinPartitions("bucket", "pair")
        self.path = scratch_path(spark, "pairs")
        dealt.write.partitionBy("bucket").parquet(self.path)
        self.index = spark.read.schema(rows.schema).parquet(self.path)
        self.long = pieces.where(F.size("ids") > LONG_PIECE).select(F.lit(None).cast("long").alias("pair"), "ids", "freq")
        self.has_long = not self.long.isEmpty()
        first = self._first(pieces, head)
        self.counts = dict(first[:head])
        self.last = self._key(first[head - 1][0]) if len(first) > head else None

    def _first(self, pieces: DataFrame, head: int) -> list:
        """The first `head` + 1 pairs with their counts."""
        counts = pieces.mapInArrow(_count, COUNTS).groupBy("pair").agg(F.sum("n").alias("n"))
        left, right = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
        if not self.symbols.byte:
            names, name = dict(self.symbols.names), Symbols(False).name

            @F.arrow_udf("string")
            def named(numbers: pa.Array) -> pa.Array:
                return pa.array([names.get(number) or name(number) for number in numbers.to_pylist()], pa.string())

            left, right = named(left), named(right)
        rows = counts.select("pair", "n", left.alias("left"), right.alias("right"))
        ordered = rows.orderBy(F.desc("n"), "left", "right").limit(head + 1)
        return [(row["pair"], row["n"]) for row in ordered.collect()]

    def _key(self, pair: int):
        order = self.symbols.order
        return (-self.counts[pair], order(pair >> 32), order(pair & 0xFFFFFFFF), pair)

    def leading(self, top: int) -> tuple:
        """The next pairs in order, as far as they are known, and whether no other is left."""
        limit = nsmallest(top + 1, (-n for n in self.counts.values()))
        limit = limit[-1] if limit else 0
        ranked = nsmallest(top + 1, (self._key(pair) for pair, n in self.counts.items() if -n <= limit))
        if self.last is not None:
            ranked = [key for key in ranked if key <= self.last]
        name = self.symbols.name
        rows = [
            {"n": -n, "left": name(pair >> 32), "right": name(pair & 0xFFFFFFFF), "pair": pair}
            for n, _, _, pair in ranked[:top]
        ]
        return rows, self.last is None and len(ranked) <= top

    def _origin(self, left: int, right: int) -> int:
        while left in self.made or right in self.made:
            left, right = self.made[left] if left in self.made else self.made[right]
        return left << 32 | right

    def merge(self, rules) -> None:
        """Apply new merges: read the pieces they touch and bring the counts up to date."""
        wanted = list(dict.fromkeys(self._origin(left, right) for left, right, _ in rules))
        buckets = sorted(set(_bucket(np.array(wanted, np.int64)).tolist()))
        found = self.index.where(F.col("bucket").isin(buckets) & F.col("pair").isin(wanted))
        found = found.select("pair", "ids", "freq")
        if self.has_long:
            found = found.unionByName(self.long)
        run = _changes(wanted, list(self.pending), list(rules))
        changed = found.mapInArrow(run, COUNTS).groupBy("pair").agg(F.sum("n").alias("n"))
        self.pending += rules
        self.made |= {new: (left, right) for left, right, new in rules}
        for row in changed.where("n != 0").collect():  # pairs that touch the merged symbols
            pair, n = row["pair"], row["n"]
            if pair in self.counts or pair >> 32 in self.made or pair & 0xFFFFFFFF in self.made:
                self.counts[pair] = self.counts.get(pair, 0) + n
                if not self.counts[pair]:
                    del self.counts[pair]


def learn_merges(
    pieces: DataFrame, n_merges: int, mode="symbol", every=MERGES_PER_INDEX, top=TOP_PAIRS, head=HEAD_PAIRS
) -> list:
    """Merges (rank, left, right, new, n) from distinct pieces (piece, freq).

    Each round settles as many of the leading pairs as give the same merges as one at a time,
    reads the pieces that hold them from the pair index and adds up what changes. After `every`
    merges, or when the known counts no longer tell which pair is next, the pieces and the index
    are written anew. Stops early when no pair is left.
    """
    spark, kind = pieces.sparkSession, "ids array<int>, freq long"
    symbols, merges, known = Symbols(mode == "byte"), [], set()
    dealt = pieces.repartition(spark.sparkContext.defaultParallelism, "piece")
    state = written(dealt.mapInArrow(_start(symbols.byte), kind), "pieces")
    while True:
        index = PairIndex(state, symbols, head)
        respelled, done = False, False
        while len(index.pending) < every and not respelled and not done:
            rows, complete = index.leading(top)
            if not rows:
                done = index.last is None
                break
            rules = []
            for row in settled(rows, complete, known)[: min(ROUND_PAIRS, n_merges - len(merges))]:
                left, right = row["pair"] >> 32, row["pair"] & 0xFFFFFFFF
                new, name, again = symbols.merge(left, right)
                merges.append((len(merges), row["left"], row["right"], name, row["n"]))
                rules.append((left, right, new))
                known.add(name)
                respelled = respelled or again
            done = len(merges) == n_merges
            if respelled:  # the symbol has other pairs already, which are counted anew
                index.pending += rules
            elif not done:
                index.merge(rules)
        if not done:
            state = written(state.mapInArrow(_rewritten(index.pending), kind), "pieces")
        removed(spark, index.path)
        if done:
            return merges
