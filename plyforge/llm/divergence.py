"""Divergence of each source's word use from its language's and from each other source's.

1. Terms that enough documents of a language hold are counted in each task first and then by key.
2. The kept terms, in order, are dealt out by range; each task turns its share into blocks, minimal
   acyclic transducers that were built from the sorted terms. A path through a block spells a term,
   and the outputs on its way add up to the term's ordinal. Blocks of a language are numbered on, so
   an ordinal is the term's place among all kept terms of the language.
3. The texts are streamed through the transducers to be recounted: all words of a slice take a step
   together. Blocks go to the tasks as broadcasts of at most `PASS_BYTES`; a vocabulary beyond that
   takes several passes over the texts. Tasks add up their counts before the shuffle.
4. Shares, divergences and ranks are whole numbers. Terms are ranked by value and ordinal; only the
   leading ones are spelled out, by walking the transducers to their ordinals.
5. Pairs of sources are summed per range of ordinals and pair of tiles of sources, on arrays, so no
   row is made for a pair and term. A term that neither source holds adds the same to every pair,
   as its share is then fixed by the source's size.

Memory in a task: a slice of texts, a bounded table of counts, blocks of at most `PASS_BYTES`, two
tiles. The driver holds the blocks of one pass and one row of figures per block.

Odd cases: a null text, language or source counts as empty. A source without terms still has rows
for every other source of its language; a language without kept terms gives value 0 to all pairs.
Repeated rows count as documents of their own. Ties are settled by the item in byte order. Texts of
any length are read whole. Empty tables give none. Only text, lang and source are read, so other
columns may have any names.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyforge.llm.batches import LOWER, _cuts, raw, slices, texts, word_starts
from plyforge.scale import lookup_join
from plyforge.session import written

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Lower-cased bytes of terms; 0 for separators.
TERM_BYTES = np.array([b if 97 <= b <= 122 or b >= 128 else 0 for b in LOWER], dtype=np.uint8)

#: Fixed values of the audit: the scale of a share and what is added to every count.
SCALE = 1_000_000_000
ADDED = 2

MIN_DOCUMENTS = 10
BLOCK_TERMS = 1 << 18
PASS_BYTES = 64 << 20
HELD_COUNTS = 1 << 20
PLACE_BITS = 40
TERMS_PER_TILE = 4096
SOURCES_PER_TILE = 256
BLOCK = (
    "lang string, n_terms long, first binary, last binary, keys binary, targets binary, "
    "before binary, final binary, n_bytes long"
)


def _terms_of_documents(batches):
    """(lang, term, n): in how many of the rows a term stands; a term may be given several times."""
    found, held = {}, 0

    def rows():
        for lang, counter in found.items():
            names = pa.array(list(counter.keys()), pa.binary()).cast(pa.string())
            values = pa.array(list(counter.values()), pa.int64())
            langs = pa.array([lang] * len(counter), pa.string())
            for start in range(0, len(counter), 1 << 16):
                cut = [column.slice(start, 1 << 16) for column in (langs, names, values)]
                yield pa.RecordBatch.from_arrays(cut, names=["lang", "term", "n"])

    for part in slices(batches, "text"):
        data, bounds = raw(part.column("text"))
        whole = data.tobytes().translate(LOWER)
        for row, lang in enumerate(texts(part.column("lang"))):
            counter = found.setdefault(lang, Counter())
            size = len(counter)
            counter.update(set(TERM.findall(whole, bounds[row], bounds[row + 1])))
            held += len(counter) - size
        if held > HELD_COUNTS:
            yield from rows()
            found, held = {}, 0
    yield from rows()


class Transducer:
    """A minimal acyclic transducer from terms, as bytes, to their places in byte order.

    State s has its arcs at the keys `s * 256 + byte`; `before` is how many terms come earlier than
    those that follow the arc, among all that pass the state. The last state is the start.
    """

    def __init__(self, keys, targets, before, final):
        self.keys, self.targets, self.before, self.final = keys, targets, before, final
        self.start = len(final) - 1

    @classmethod
    def of(cls, terms):
        """Built from sorted distinct terms: what the next term can't change is looked up among the
        states so far, and only kept if it is new."""
        known, arcs, final, below = {}, [], [], []

        def settled(out, ends):
            key = (ends, *out)
            state = known.get(key)
            if state is None:
                state = known[key] = len(arcs)
                arcs.append(out)
                final.append(ends)
                below.append(ends + sum(below[target] for _, target in out))
            return state

        path, last = [[[], False]], b""
        for term in terms:
            same = 0
            for one, other in zip(term, last):
                if one != other:
                    break
                same += 1
            while len(path) > same + 1:
                out, ends = path.pop()
                path[-1][0].append((last[len(path) - 1], settled(out, ends)))
            path += [[[], False] for _ in range(len(term) - same)]
            path[-1][1] = True
            last = term
        while len(path) > 1:
            out, ends = path.pop()
            path[-1][0].append((last[len(path) - 1], settled(out, ends)))
        out, ends = path[0]
        arcs.append(out)
        final.append(ends)
        keys, targets, before = [], [], []
        for state, out in enumerate(arcs):
            count = int(final[state])
            for byte, target in out:
                keys.append(state * 256 + byte)
                targets.append(target)
                before.append(count)
                count += below[target]
        return cls(
            np.array(keys, np.int64), np.array(targets, np.int32), np.array(before, np.int32),
            np.array(final, bool),
        )

    def columns(self) -> dict:
        return {name: getattr(self, name).tobytes() for name in ("keys", "targets", "before", "final")}

    @classmethod
    def read(cls, row):
        kinds = {"keys": np.int64, "targets": np.int32, "before": np.int32, "final": bool}
        return cls(*(np.frombuffer(row[name], kind) for name, kind in kinds.items()))

    def places(self, data, at, sizes) -> np.ndarray:
        """The place of each word `data[at : at + size]`; -1 if it is none of the terms."""
        out = np.full(len(at), -1, np.int64)
        alive, state = np.arange(len(at)), np.full(len(at), self.start, np.int64)
        place, step = np.zeros(len(at), np.int64), 0
        while len(alive):
            ended = sizes[alive] == step
            if ended.any():
                done = ended & self.final[state]
                out[alive[done]] = place[done]
                alive, state, place = alive[~ended], state[~ended], place[~ended]
            key = state * 256 + data[at[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            alive, arc = alive[on], arc[on]
            state, place = self.targets[arc].astype(np.int64), place[on] + self.before[arc]
            step += 1
        return out

    def term(self, place: int) -> bytes:
        """The term at a place."""
        state, left, out = self.start, place, bytearray()
        while not (left == 0 and self.final[state]):
            low, high = np.searchsorted(self.keys, [state * 256, state * 256 + 256])
            arc = low + int(np.searchsorted(self.before[low:high], left, "right")) - 1
            left -= int(self.before[arc])
            out.append(int(self.keys[arc]) & 255)
            state = int(self.targets[arc])
        return bytes(out)


def _block(lang, terms):
    row = {"lang": lang, "n_terms": len(terms), "first": terms[0], "last": terms[-1]}
    row |= Transducer.of(terms).columns()
    row["n_bytes"] = sum(len(value) for value in row.values() if isinstance(value, bytes))
    return pa.RecordBatch.from_pylist([row])


def _blocks(limit: int):
    """Transducers of at most `limit` terms from sorted (lang, term) rows."""

    def run(batches):
        lang, held = None, []
        for batch in batches:
            terms = batch.column("term").cast(pa.binary()).to_pylist()
            for name, term in zip(texts(batch.column("lang")), terms):
                if held and (name != lang or len(held) == limit):
                    yield _block(lang, held)
                    held = []
                lang = name
                held.append(term)
        if held:
            yield _block(lang, held)

    return run


def vocabulary(docs: DataFrame, min_documents=MIN_DOCUMENTS, block_terms=BLOCK_TERMS) -> DataFrame:
    """Written transducer blocks of the terms that enough documents of a language hold."""
    counted = docs.mapInArrow(_terms_of_documents, "lang string, term string, n long")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents)
    kept = written(kept.select("lang", "term"), "terms")
    shares = max(1, -(-kept.count() // block_terms))
    dealt = kept.repartitionByRange(shares, "lang", "term").sortWithinPartitions("lang", "term")
    return written(dealt.mapInArrow(_blocks(block_terms), BLOCK), "blocks")


class Pass:
    """Blocks of one pass: for each language in order, with the ordinal each starts from."""

    def __init__(self, rows):
        self.langs = {}
        for row in rows:
            self.langs.setdefault(row["lang"], []).append(row)
        self.read = {}

    def __getstate__(self):
        return {"langs": self.langs, "read": {}}

    def blocks(self, lang):
        """(first 8 bytes, last 8 bytes, starting ordinals, transducers) of a language."""
        if lang not in self.read:
            rows = self.langs.get(lang, [])
            head = lambda name: np.array(
                [int.from_bytes(row[name][:8].ljust(8, b"\0"), "big") for row in rows], np.uint64
            )
            starts = [row["start"] for row in rows]
            self.read[lang] = head("first"), head("last"), starts, [Transducer.read(row) for row in rows]
        return self.read[lang]

    def ordinals(self, lang, data, at, sizes) -> np.ndarray:
        """The ordinal of each word, -1 for words that are no terms of these blocks."""
        first, last, starts, built = self.blocks(lang)
        out = np.full(len(at), -1, np.int64)
        if not built:
            return out
        head = np.zeros(len(at), np.uint64)
        for j in range(8):
            byte = np.where(sizes > j, data[np.minimum(at + j, len(data) - 1)], 0)
            head = (head << np.uint64(8)) | byte.astype(np.uint64)
        block, end = np.searchsorted(last, head, "left"), np.searchsorted(first, head, "right")
        asked = np.flatnonzero(block < end)
        while len(asked):
            for number in np.unique(block[asked]):
                own = asked[block[asked] == number]
                places = built[number].places(data, at[own], sizes[own])
                out[own] = np.where(places >= 0, places + starts[number], -1)
            block[asked] += 1
            asked = asked[(out[asked] < 0) & (block[asked] < end[asked])]
        return out

    def term(self, lang, ordinal) -> bytes | None:
        _, _, starts, built = self.blocks(lang)
        at = int(np.searchsorted(starts, ordinal, "right")) - 1 if len(starts) else -1
        if at < 0 or ordinal >= starts[at] + self.langs[lang][at]["n_terms"]:
            return None
        return built[at].term(ordinal - starts[at])


def passes(blocks: DataFrame, limit=PASS_BYTES):
    """The blocks in order with their starting ordinals, as broadcasts of at most `limit` bytes.

    One block can't be over the limit, as its terms are bounded, unless they are very long.
    """
    figures = blocks.select("lang", "first", "n_terms", "n_bytes").collect()
    figures.sort(key=lambda row: (row["lang"], bytes(row["first"])))
    groups, size, start, lang = [], limit + 1, 0, None
    for row in figures:
        start = 0 if row["lang"] != lang else start
        lang = row["lang"]
        if size + row["n_bytes"] > limit:
            groups.append({})
            size = 0
        groups[-1][lang, bytes(row["first"])] = start
        size += row["n_bytes"]
        start += row["n_terms"]
    spark = blocks.sparkSession
    for group in groups:
        wanted = spark.createDataFrame([(name, first) for name, first in group], "lang string, first binary")
        rows = blocks.join(F.broadcast(wanted), ["lang", "first"], "left_semi").collect()
        rows = [{**row.asDict(), "start": group[row["lang"], bytes(row["first"])]} for row in rows]
        rows.sort(key=lambda row: (row["lang"], row["start"]))
        yield spark.sparkContext.broadcast(Pass(rows))


def _recount(shared):
    """(lang, source, ordinal, n) of the slices of a task, added up before they are given."""

    def run(batches):
        found, groups, held = shared.value, {}, []
        names = []

        def rows():
            if not held:
                return
            keys, n = (np.concatenate(column) for column in zip(*held))
            keys, number = np.unique(keys, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, number, n)
            for at in range(0, len(keys), 1 << 16):
                cut = keys[at : at + (1 << 16)]
                langs, sources = zip(*(names[i] for i in cut >> PLACE_BITS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(sources, pa.string()),
                     pa.array(cut & ((1 << PLACE_BITS) - 1)), pa.array(total[at : at + (1 << 16)])],
                    names=["lang", "source", "ordinal", "n"],
                )

        for part in slices(batches, "text"):
            data, bounds = raw(part.column("text"))
            own = list(zip(texts(part.column("lang")), texts(part.column("source"))))
            for name in own:
                if name not in groups:
                    groups[name] = len(names)
                    names.append(name)
            number = np.array([groups[name] for name in own], np.int64)
            langs = sorted({name[0] for name in own})
            spoken = np.array([langs.index(name[0]) for name in own])
            for start, end in _cuts(data, bounds, TERM_BYTES):
                mapped, at = word_starts(data[start:end], bounds - start, TERM_BYTES)
                if not len(at):
                    continue
                gaps = np.append(np.flatnonzero(mapped == 0), len(mapped))
                stop = gaps[np.searchsorted(gaps, at)]
                stop = np.minimum(stop, np.append(at[1:], len(mapped)))
                row = np.searchsorted(bounds, at + start, "right") - 1
                for i in np.unique(spoken[row]):
                    mine = np.flatnonzero(spoken[row] == i)
                    ordinal = found.ordinals(langs[i], mapped, at[mine], stop[mine] - at[mine])
                    known = ordinal >= 0
                    keys = (number[row[mine[known]]] << PLACE_BITS) | ordinal[known]
                    held.append(np.unique(keys, return_counts=True))
            if sum(len(n) for _, n in held) > HELD_COUNTS or len(names) > HELD_COUNTS:
                yield from rows()
                groups, names, held = {}, [], []
        yield from rows()

    return run


def recount(docs: DataFrame, shared) -> DataFrame:
    """(lang, source, ordinal, n) of the occurrences of the terms in one pass's blocks."""
    schema = "lang string, source string, ordinal long, n long"
    counts = docs.mapInArrow(_recount(shared), schema)
    return counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _spelled(shared):
    def run(batches):
        found = shared.value
        for batch in batches:
            rows = batch.to_pylist()
            terms = [found.term(row["lang"], row["ordinal"]) for row in rows]
            out = batch.set_column(
                batch.schema.get_field_index("item"), "item", pa.array(terms, pa.binary()).cast(pa.string())
            )
            yield out.filter(out.column("item").is_valid())

    return run


def share(count: str, total: str, terms: str):
    """The share of a term in whole units, exact for counts of any size."""
    return F.expr(
        f"CAST(1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {ADDED} AS DECIMAL(20, 0))) DIV "
        f"CAST({total} + {ADDED} * {terms} AS DECIMAL(20, 0)) AS BIGINT)"
    )


def gap(p: str, q: str):
    """The divergence of two shares, at most twice `SCALE`."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def source_groups(docs: DataFrame, counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Written (lang, source, gid, total, terms, lang_total, rest): `rest` is the share of a term
    that the group doesn't hold."""
    sizes = blocks.groupBy("lang").agg(F.sum("n_terms").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    named = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    joined = lookup_join(lookup_join(named, sizes, "lang", "left"), langs, "lang", "left")
    filled = joined.na.fill(0, ["total", "terms", "lang_total"])
    rest = F.when(F.col("terms") > 0, share("0", "total", "terms"))
    return written(
        filled.select("*", rest.alias("rest"), F.monotonically_increasing_id().alias("gid")), "groups"
    )


def _tile_sums(key, rows: pd.DataFrame, tile_terms: int) -> pd.DataFrame:
    """Divergence of every pair of groups of two tiles over one range of ordinals."""
    lang, k, a, b = key
    places = rows["ordinal"].to_numpy()
    gids = rows["gid"].to_numpy()
    members = rows[places < 0].drop_duplicates("gid")
    ids, rest, tile = (members[name].to_numpy() for name in ("gid", "rest", "tile"))
    order = np.argsort(ids)
    ids, rest, tile = ids[order], rest[order], tile[order]
    width = int(members["width"].iloc[0])
    shares = np.repeat(rest[:, None], width, axis=1)
    held = places >= 0
    shares[np.searchsorted(ids, gids[held]), places[held] - k * tile_terms] = rows["p"].to_numpy()[held]
    left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
    out = []
    for i in left:
        others = right[right > i] if a == b else right
        apart = shares[others] - shares[i]
        value = (apart * apart // (shares[others] + shares[i])).sum(axis=1)
        out.append(pd.DataFrame({"lang": lang, "a": ids[i], "b": ids[others], "value": value}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})


def pair_values(
    counts: DataFrame, groups: DataFrame, tile_terms=TERMS_PER_TILE, tile_sources=SOURCES_PER_TILE
) -> DataFrame:
    """(lang, source, item, value) of every two groups of a language, both ways."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile_sources).alias("tiles"))
    placed = lookup_join(groups, tiles, "lang").withColumn(
        "tile", F.pmod(F.xxhash64("gid"), F.col("tiles"))
    )
    ranges = F.ceil(F.col("terms") / tile_terms)
    members = placed.where(F.col("terms") > 0).select(
        "lang", "gid", "tile", "tiles", "rest", "terms",
        F.explode(F.sequence(F.lit(0).cast("long"), ranges - 1)).alias("k"),
    )
    member_rows = members.select(
        "lang", "k", "gid", "tile", "tiles", "rest",
        F.least(F.lit(tile_terms).cast("long"), F.col("terms") - F.col("k") * tile_terms).alias("width"),
        F.lit(-1).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("p"),
    )
    held = lookup_join(
        counts, placed.select("lang", "source", "gid", "tile", "tiles", "total", "terms"), ["lang", "source"]
    ).select(
        "lang", F.floor(F.col("ordinal") / tile_terms).alias("k"), "gid", "tile", "tiles",
        F.lit(0).cast("long").alias("rest"), F.lit(0).cast("long").alias("width"), "ordinal",
        share("n", "total", "terms").alias("p"),
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = member_rows.unionByName(held).withColumn("_other", other)
    dealt = dealt.withColumn("ta", F.least("tile", "_other")).withColumn("tb", F.greatest("tile", "_other"))

    def tile_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _tile_sums(key, rows, tile_terms)

    sums = dealt.groupBy("lang", "k", "ta", "tb").applyInPandas(
        tile_sums, "lang string, a long, b long, value long"
    )
    total = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    empty = groups.where(F.col("terms") == 0).select("lang", F.col("gid").alias("a"))
    apart = empty.join(empty.withColumnRenamed("a", "b"), "lang").where("a < b").withColumn(
        "value", F.lit(0).cast("long")
    )
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    pairs = total.unionByName(apart).select("lang", both.alias("way"), "value").select("lang", "way.a", "way.b", "value")
    one = groups.select(F.col("gid").alias("a"), "source")
    two = groups.select(F.col("gid").alias("b"), F.col("source").alias("item"))
    return lookup_join(lookup_join(pairs, one, "a"), two, "b").select("lang", "source", "item", "value")


def term_values(counts: DataFrame, groups: DataFrame, leading=10) -> DataFrame:
    """(lang, source, ordinal, value, rank) of the terms that a group holds more of than its language."""
    common = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    sizes = groups.select("lang", "source", "total", "terms", "lang_total")
    known = lookup_join(counts, sizes, ["lang", "source"]).join(common, ["lang", "ordinal"])
    valued = known.select(
        "lang", "source", "ordinal",
        share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"),
    ).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    ranked = valued.select("lang", "source", "ordinal", gap("p", "q").alias("value"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= leading)


def audit(
    docs: DataFrame,
    min_documents=MIN_DOCUMENTS,
    leading=10,
    *,
    block_terms=BLOCK_TERMS,
    pass_bytes=PASS_BYTES,
    tile_terms=TERMS_PER_TILE,
    tile_sources=SOURCES_PER_TILE,
) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows compare a source with every other one of
    its language, `term` rows give the terms that set it apart most."""
    filled = docs.select(*(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("text", "lang", "source")))
    blocks = vocabulary(filled, min_documents, block_terms)
    counts = docs.sparkSession.createDataFrame([], "lang string, source string, ordinal long, n long")
    for shared in passes(blocks, pass_bytes):
        counts = counts.unionByName(written(recount(filled, shared), "counts"))
        shared.destroy()
    groups = source_groups(filled, counts, blocks)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(counts, groups, tile_terms, tile_sources).withColumn("rank", F.row_number().over(order))
    leaders = written(term_values(counts, groups, leading).withColumn("item", F.lit(None).cast("string")), "leaders")
    terms = docs.sparkSession.createDataFrame([], leaders.schema)
    for shared in passes(blocks, pass_bytes):
        terms = terms.unionByName(written(leaders.mapInArrow(_spelled(shared), leaders.schema), "terms"))
        shared.destroy()
    return (
        pairs.withColumn("part", F.lit("pair"))
        .unionByName(terms.drop("ordinal").withColumn("part", F.lit("term")))
        .select("lang", "source", "part", "item", "value", "rank")
    )
