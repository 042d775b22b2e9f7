"""Join, ranking and prefix-sum helpers that hold for very large and skewed inputs.

Three rules are kept here so the operators need not repeat them:

* a side is broadcast only after its rows and bytes were counted;
* a join key that holds a large share of the fact rows is taken out of the shuffle;
* positions in a global order are computed per bucket, never in one sorted task.
"""

from math import ceil

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plyforge.session import checkpointed, written

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
SALTS = 64
ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 16_384
COLLECT_ROWS = 10_000
HEX_STEP = 3
ABOVE_HEX = "g"


def text_list(values) -> Column:
    """A long list of texts without `;` as one literal; Spark splits it while planning."""
    return F.split(F.lit(";".join(values)), ";")


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with fewer splits than there are cores, dealt out to all of them.

    For a few files of text whose rows take long; a scan of many files stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: texts by length, numbers as 8 each, other nested columns as their JSON."""
    total = F.lit(0)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind in ("array<int>", "array<bigint>", "array<float>", "array<double>"):
            total = total + 8 * F.coalesce(F.size(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.octet_length(F.to_json(F.struct(name)))
        else:
            total = total + 8
    return total


def fits_broadcast(df: DataFrame, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> bool:
    """Whether all rows, counted in one aggregate, are few and short enough to broadcast."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df).cast("long")).alias("bytes")
    ).first()
    return row["rows"] <= max_rows and (row["bytes"] or 0) <= max_bytes


def _is_derived(df: DataFrame) -> bool:
    """Whether the rows come out of more than a filtered scan, so that a second run costs much."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(step in plan for step in ("Join", "Aggregate", "Window", "Generate", "MapIn", "Sort", "Repartition"))


def sized(df: DataFrame, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> tuple:
    """(rows, whether they are few and short enough to broadcast).

    Derived rows are written once and measured on the way, so that the check does not run their
    lineage a second time. A scan is only counted.
    """
    if not _is_derived(df):
        return df, fits_broadcast(df, max_rows, max_bytes)
    seen = Observation()
    size = F.sum(_row_bytes(df).cast("long")).alias("bytes")
    table = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), size), "side")
    return table, seen.get["rows"] <= max_rows and (seen.get["bytes"] or 0) <= max_bytes


def _any_null(columns):
    test = F.lit(False)
    for name in columns:
        test = test | F.col(name).isNull()
    return test


def _hot_keys(fact: DataFrame, on: list, hot_rows: int, counts=None):
    """The keys with at least `hot_rows` rows, the MAX_HOT_KEYS largest of them.

    Any other key holds either few rows or less than 1 / MAX_HOT_KEYS of all rows.
    """
    if counts is None:
        counts = fact.where(~_any_null(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= hot_rows).orderBy(F.desc("n")).limit(MAX_HOT_KEYS)
    rows = found.select(*on).collect()
    schema = counts.select(*on).schema
    return fact.sparkSession.createDataFrame(rows, schema) if rows else None


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on,
    how="inner",
    *,
    max_rows=BROADCAST_ROWS,
    hot_rows=HOT_ROWS,
    small=None,
    counts=None,
) -> DataFrame:
    """Join a large `fact` to `dim` on equal keys; `how` is inner, left, left_semi or left_anti.

    A `dim` of checked size is broadcast. Otherwise the join shuffles, with hot fact keys
    joined apart against their few `dim` rows, and null keys kept out of the shuffle. A caller
    that has already checked the size passes the answer as `small`, and one that knows the
    rows per key passes them as `counts` with a column `n`.
    """
    on = [on] if isinstance(on, str) else list(on)
    if small is None:
        dim, small = sized(dim, max_rows)
    if small:
        return fact.join(F.broadcast(dim), on, how)

    keyed = fact.where(~_any_null(on))
    parts = []
    hot = _hot_keys(keyed, on, hot_rows, counts)
    if hot is None:
        parts.append(keyed.join(dim, on, how))
    else:
        hot = F.broadcast(hot)
        hot_fact = keyed.join(hot, on, "left_semi")
        hot_dim = dim.join(hot, on, "left_semi")
        parts.append(keyed.join(hot, on, "left_anti").join(dim, on, how))
        if fits_broadcast(hot_dim, max_rows):
            parts.append(hot_fact.join(F.broadcast(hot_dim), on, how))
        else:
            salt = F.pmod(F.xxhash64(*fact.columns), F.lit(SALTS)).cast("int")
            spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            salted = hot_fact.withColumn("_salt", salt).join(
                hot_dim.withColumn("_salt", spread), [*on, "_salt"], how
            )
            parts.append(salted.drop("_salt"))
    if how in ("left", "left_anti"):
        parts.append(fact.where(_any_null(on)))

    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part, allowMissingColumns=True)
    return joined


def range_bucket(df: DataFrame, key: str, n_buckets: int) -> Column:
    """Bucket number of a numeric `key`, in key order, with about equal rows per bucket.

    One sketch pass finds the boundaries; the column then looks them up by halving steps.
    """
    shares = [i / n_buckets for i in range(1, n_buckets)]
    accuracy = min(1_000_000, 20 * n_buckets + 10_000)
    found = df.agg(F.percentile_approx(key, shares, accuracy)).first()[0] if shares else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    steps = [1 << bit for bit in reversed(range(len(bounds).bit_length()))]
    kind = dict(df.dtypes)[key]
    table = text_list(str(bound) for bound in bounds).cast(f"array<{kind}>")
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: at
        + F.when(F.get(table, at + step - 1) <= F.col(key), step).otherwise(F.lit(0)),
    )


def prefix_sum(
    df: DataFrame, order: str, weight: Column, out: str, rows_per_bucket=ROWS_PER_BUCKET
) -> DataFrame:
    """Add `out`: the sum of `weight` over all rows before this one in the unique `order`.

    Two levels: weights are summed per key range, the short list of range totals is scanned,
    and a window inside each range adds the rest. Only (order, weight) goes through this; the
    sums are then joined to the rows. A null or repeated `order` is an error.
    """
    narrow = checkpointed(df.select(order, weight.cast("long").alias("_weight")))
    rows, known = narrow.agg(F.count(F.lit(1)), F.count(order)).first()
    if rows != known:
        raise ValueError(f"{order} is null in a row")
    n_buckets = max(1, min(MAX_BUCKETS, ceil(rows / rows_per_bucket)))
    placed = narrow.withColumn("_bucket", range_bucket(narrow, order, n_buckets))
    inside = Window.partitionBy("_bucket").orderBy(order)
    before = F.coalesce(F.sum("_weight").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = placed.groupBy("_bucket").agg(F.sum("_weight").alias("_total"))
    scan = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(  # at most MAX_BUCKETS rows
        "_bucket", F.coalesce(F.sum("_total").over(scan), F.lit(0)).alias("_carried")
    )
    # Equal keys are neighbours in one bucket, so they show up on the way.
    seen, again = Observation(), (F.lag(order).over(inside) == F.col(order)).alias("_again")
    sums = placed.join(F.broadcast(carried), "_bucket").select(
        order, (F.col("_carried") + before).alias(out), again
    )
    sums = written(sums.observe(seen, F.count_if("_again").alias("again")).drop("_again"), "sums")
    if seen.get["again"]:
        raise ValueError(f"{order} is not unique")
    # The sums are narrow: a hash of them spares the rows of `df` a sort, and a shuffle too in buckets.
    return df.join(F.broadcast(sums) if rows <= BROADCAST_ROWS else sums.hint("shuffle_hash"), order)


def row_index(df: DataFrame, order: str, out="row_no", rows_per_bucket=ROWS_PER_BUCKET) -> DataFrame:
    """Number the rows from 0 in the unique `order`."""
    return prefix_sum(df, order, F.lit(1), out, rows_per_bucket)


def order_cut(df: DataFrame, key: str, n: int, collect_rows=COLLECT_ROWS):
    """The value v of a unique numeric `key` for which exactly `n` rows have key <= v.

    Each pass narrows the key range to one bucket, until the rest is short enough to sort
    on the driver. Returns None for n <= 0.
    """
    if n <= 0:
        return None
    rest, left, keys = df.select(key), n, None
    while True:
        size = rest.count()
        if left > size:
            raise ValueError(f"fewer than {n} rows")
        if size <= collect_rows:
            keys = sorted(row[0] for row in rest.collect())
            if left < size and keys[left - 1] == keys[left]:
                raise ValueError(f"{key} is not unique")
            return keys[left - 1]
        bucket = range_bucket(rest, key, 256)
        counts = rest.withColumn("_bucket", bucket).groupBy("_bucket").count().collect()
        if len(counts) == 1:
            raise ValueError(f"{key} is not unique")
        for number, count in sorted((row["_bucket"], row["count"]) for row in counts):
            if left <= count:
                rest = rest.where(bucket == number)
                break
            left -= count


def hash_cuts(df: DataFrame, key: Column, ranks, collect_rows=COLLECT_ROWS) -> tuple:
    """(number of rows, cuts): for each rank n the hex string h for which exactly `n` rows have the
    unique hash `key` <= h.

    `ranks` is a list, or a function from the number of rows to one. A cut is None for n <= 0, and
    ABOVE_HEX, which lets every row pass, for more than there are. All ranks are narrowed together
    by counting ever longer prefixes, so an exact split or sample costs a few narrow passes, most
    often two, and a map-only filter, however many parts it has.
    """
    keys = df.select(key.alias("_key")).where(F.col("_key").isNotNull())
    total, open_ranks, cuts, width = None, {}, [], 0
    while total is None or open_ranks:
        prefixes = sorted({prefix for prefix, _, _ in open_ranks.values()})
        inside = keys.where(F.substring("_key", 1, width).isin(prefixes)) if width else keys
        if width and max(size for _, _, size in open_ranks.values()) <= collect_rows:
            rows = sorted(row[0] for row in inside.collect())
            for i, (prefix, left, size) in open_ranks.items():
                own = [value for value in rows if value.startswith(prefix)]
                if left < size and own[left - 1] == own[left]:
                    raise ValueError("the ordering key is not unique")
                cuts[i] = own[left - 1]
            return total, cuts
        if width >= 30:
            raise ValueError("the ordering key is not unique")
        counts = inside.groupBy(F.substring("_key", 1, width + HEX_STEP).alias("_prefix")).count().collect()
        counts = sorted((row["_prefix"], row["count"]) for row in counts)
        if total is None:
            total = sum(count for _, count in counts)
            ranks = ranks(total) if callable(ranks) else ranks
            cuts = [None if n <= 0 else ABOVE_HEX for n in ranks]
            open_ranks = {i: ("", n, total) for i, n in enumerate(ranks) if 0 < n <= total}
        for i, (prefix, left, _) in open_ranks.items():
            for found, count in counts:
                if not found.startswith(prefix):
                    continue
                if left <= count:
                    open_ranks[i] = (found, left, count)
                    break
                left -= count
        width += HEX_STEP
    return total, cuts


def hash_cut(df: DataFrame, key: Column, n: int, collect_rows=COLLECT_ROWS):
    """The cut of `hash_cuts` for one rank."""
    return None if n <= 0 else hash_cuts(df, key, [n], collect_rows)[1][0]


def keep_keys(big: DataFrame, wanted: DataFrame, on) -> DataFrame:
    """Rows of `big` whose keys occur in `wanted`."""
    on = [on] if isinstance(on, str) else list(on)
    return lookup_join(big, wanted.select(*on).distinct(), on, "left_semi")


def match_rows(wanted: DataFrame, big: DataFrame, on, how="left", shrink=None) -> DataFrame:
    """Join `wanted` to a larger table that holds each key once after `shrink`.

    `big` is first cut to the wanted keys. When those are few, the cut is written once, so
    that checking its size and joining it do not read `big` again.
    """
    on = [on] if isinstance(on, str) else list(on)
    keys, few = sized(wanted.select(*on).distinct())
    cut = lookup_join(big, keys, on, "left_semi", small=few)
    cut = cut if shrink is None else shrink(cut)
    if few:
        return lookup_join(wanted, checkpointed(cut), on, how)
    return lookup_join(wanted, cut, on, how, small=False)
