"""Walk move lists through a transition relation (state, move, next_state)."""

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plyforge.functions.notation import parse_half_moves
from plyforge.session import scratch_path, written

# Fixed value: shortest move list that counts as a game.
MIN_HALF_MOVES = 6

STRETCH = 16
EDGES_PER_BUCKET = 4_000_000


class Relation:
    """The transitions as a table bucketed by (state, move), while a walk needs it.

    Spark broadcasts it if its files are small enough; otherwise each step of a walk shuffles its
    own rows to the buckets and never the relation. Of several next states the smallest counts.
    """

    def __init__(self, transitions: DataFrame):
        spark = self.spark = transitions.sparkSession
        text = lambda name: F.col(name).cast("string").alias(name)
        edges = transitions.select(text("state"), text("move"), text("next_state"))
        edges = edges.groupBy("state", "move").agg(F.min("next_state").alias("next_state"))
        edges = written(edges, "edges")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // EDGES_PER_BUCKET))
        self.name = f"edges_{uuid.uuid4().hex}"
        dealt = edges.repartition(buckets, "state", "move").write.bucketBy(buckets, "state", "move")
        dealt.sortBy("state", "move").option("path", scratch_path(spark, "relation")).saveAsTable(self.name)

    def __enter__(self):
        return self.spark.table(self.name)

    def __exit__(self, *_):
        self.spark.sql(f"DROP TABLE {self.name}")


def _trie(games: DataFrame) -> DataFrame:
    """(row, part, parent, node, moves): each list in stretches of `STRETCH` moves.

    A node is a 128-bit hash of all moves up to the end of a stretch, so equal openings share it.
    """
    plain = F.transform("moves", lambda move: F.coalesce(F.concat(F.lit("+"), move), F.lit("-")))
    part = lambda moves, k: F.slice(moves, k * STRETCH + 1, STRETCH)
    node = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    root = F.array(node(F.lit(0).cast("long"), F.lit(0).cast("long")))
    parts = F.sequence(F.lit(0), F.ceil(F.size("moves") / STRETCH).cast("int") - 1)

    def longer(seen, k):
        last, own = F.element_at(seen, -1), part(plain, k)
        return F.array_append(seen, node(F.xxhash64(last["a"], own), F.xxhash64(own, last["b"])))

    listed = games.where(F.size("moves") > 0).select("_row", "moves", F.aggregate(parts, root, longer).alias("_nodes"), parts.alias("_parts"))
    rows = F.transform(
        "_parts",
        lambda k: F.struct(
            k.alias("part"),
            F.get(F.col("_nodes"), k).alias("parent"),
            F.get(F.col("_nodes"), k + 1).alias("node"),
            part(F.col("moves"), k).alias("moves"),
        ),
    )
    return listed.select("_row", F.explode(rows).alias("p")).select("_row", "p.*")


def _walk(stretches: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, states, state) of (node, moves, state): `STRETCH` steps along the relation."""
    at = stretches.withColumn("_s0", F.col("state"))
    for j in range(STRETCH):
        step = edges.select(
            F.col("state").alias("_from"), F.col("move").alias("_move"), F.col("next_state").alias(f"_s{j + 1}")
        )
        fits = (F.col(f"_s{j}") == F.col("_from")) & (F.get("moves", F.lit(j)) == F.col("_move"))
        at = at.join(step, fits, "left").drop("_from", "_move")
    states = F.slice(F.array(*(f"_s{j + 1}" for j in range(STRETCH))), F.lit(1), F.size("moves"))
    return at.select("node", states.alias("states"), F.col(f"_s{STRETCH}").alias("state"))


def game_states(games: DataFrame, transitions: DataFrame, start) -> DataFrame:
    """Add `states` to (game_id, …, moves): the state after each move, null from the first
    missing transition on. States are strings.

    The lists are put into a trie by hashes of their beginnings, so that moves which games have in
    common from the start are walked once. A round takes all nodes one stretch further: one job
    for `STRETCH` plies, on distinct nodes only.
    """
    numbered = games.withColumn("moves", F.coalesce("moves", F.array().cast("array<string>")))
    games = written(numbered.withColumn("_row", F.monotonically_increasing_id()), "games")
    spark = games.sparkSession
    path = scratch_path(spark, "trie")
    listed = _trie(games)
    listed.write.partitionBy("part").parquet(path)
    listed = spark.read.schema(listed.schema).parquet(path)
    alive, walked = None, None
    with Relation(transitions) as edges:
        last = listed.agg(F.max("part")).first()[0]
        for part in range(0 if last is None else last + 1):
            nodes = listed.where(F.col("part") == part).groupBy("node").agg(
                F.any_value("parent").alias("parent"), F.any_value("moves").alias("moves")
            )
            if alive is None:
                nodes = nodes.withColumn("state", F.lit(str(start)))
            else:
                nodes = nodes.join(alive, "parent")
            seen, going = Observation(), F.count("state").alias("going")
            made = _walk(nodes.select("node", "moves", "state"), edges)
            made = written(made.observe(seen, going), "states")
            walked = made if walked is None else walked.unionByName(made)
            alive = made.where(F.col("state").isNotNull()).select(F.col("node").alias("parent"), "state")
            if not seen.get["going"]:
                break
    if walked is None:
        return games.withColumn("states", F.transform("moves", lambda _: F.lit(None).cast("string"))).drop("_row")
    reached = (
        listed.select("_row", "part", "node")
        .join(walked.select("node", "states"), "node")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("part", "states"))).alias("_parts"))
        .select("_row", F.flatten(F.transform("_parts", lambda part: part["states"])).alias("_reached"))
    )
    filled = F.transform("moves", lambda _, i: F.get(F.col("_reached"), i))
    return games.join(reached, "_row", "left").withColumn("states", filled).drop("_row", "_reached")


def replay(games: DataFrame, transitions: DataFrame, start, max_ply=None) -> DataFrame:
    """(game_id, ply, state_before, move, state_after) up to the first missing transition."""
    if max_ply is not None:
        games = games.withColumn("moves", F.slice("moves", 1, max_ply))
    walked = game_states(games.select("game_id", "moves"), transitions, start)
    steps = F.transform(
        "states",
        lambda state, i: F.struct(
            i.alias("ply"),
            F.when(i == 0, F.lit(str(start)))
            .otherwise(F.get(F.col("states"), i - 1))
            .alias("state_before"),
            F.get(F.col("moves"), i).alias("move"),
            state.alias("state_after"),
        ),
    )
    rows = walked.select("game_id", F.explode(steps).alias("step")).select("game_id", "step.*")
    return rows.where(F.col("state_after").isNotNull())


def reached_positions(games: DataFrame, transitions: DataFrame, start, max_ply=30) -> DataFrame:
    """(game_id, ply, position, played): each position a listed move is made from, also where
    that move has no transition."""
    capped = games.select("game_id", F.slice("moves", 1, max_ply).alias("moves"))
    walked = game_states(capped, transitions, start)
    before = F.transform(
        "moves",
        lambda move, i: F.struct(
            i.alias("ply"),
            F.when(i == 0, F.lit(str(start))).otherwise(F.get(F.col("states"), i - 1)).alias("position"),
            F.slice(F.col("moves"), F.lit(1), i).alias("played"),
        ),
    )
    rows = walked.select("game_id", F.explode(before).alias("at")).select("game_id", "at.*")
    return rows.where(F.col("position").isNotNull())


def unique_positions(positions: DataFrame, key="position", order=("game_id", "ply")) -> DataFrame:
    """One row per position, the first in order; a partial aggregate, since all games share
    their first position. `order` is a whole number and one below 2^31, which make one number."""
    game, ply = order
    place = F.col(game).cast("decimal(20, 0)") * F.lit(1 << 31).cast("decimal(10, 0)") + F.col(ply).cast("decimal(10, 0)")
    first = positions.groupBy(key).agg(F.min(place).alias("_place"))
    span = f"CAST({1 << 31} AS DECIMAL(10, 0))"
    part = lambda text, name: F.expr(text).cast(dict(positions.dtypes)[name]).alias(name)
    return first.select(
        key, part(f"(_place - pmod(_place, {span})) DIV {span}", game), part(f"pmod(_place, {span})", ply)
    )


def valid_sequences(
    texts: DataFrame,
    transitions: DataFrame,
    start,
    min_half_moves=MIN_HALF_MOVES,
    dialect="evaluation",
) -> DataFrame:
    """(game_id, is_legal) for (game_id, text): long enough, and every move has a transition.

    The `finetune` dialect leaves a final ` *` in place, so such games fail.
    """
    parsed = texts.select("game_id", parse_half_moves(F.col("text"), dialect).alias("moves"))
    return valid_moves(parsed, transitions, start, min_half_moves)


def valid_moves(games, transitions, start, min_half_moves=MIN_HALF_MOVES):
    """The same check for (game_id, moves)."""
    checked = F.when(F.size("moves") >= min_half_moves, F.col("moves")).otherwise(F.array())
    walked = game_states(games.select("game_id", checked.alias("moves")), transitions, start)
    legal = F.coalesce(F.element_at("states", -1).isNotNull(), F.lit(False))
    return walked.select(
        "game_id", F.when(F.size("states") > 0, legal).otherwise(False).alias("is_legal")
    )


def min_half_moves(games: DataFrame, n=MIN_HALF_MOVES, moves="moves") -> DataFrame:
    return games.where(F.size(moves) >= n)


def pass_rate(checked: DataFrame) -> DataFrame:
    """Legal and illegal counts and the legal percentage, 0 for an empty input."""
    legal = F.count_if("is_legal")
    total = F.count(F.lit(1))
    return checked.agg(
        legal.alias("legal"),
        (total - legal).alias("illegal"),
        F.coalesce(F.try_divide(100 * legal, total), F.lit(0.0)).alias("pass_rate"),
    )
