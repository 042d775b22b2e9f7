"""Tokenizer and training-window queries over `documents`, `orders` and `embeddings`."""

from pyspark.sql import functions as F

from plyforge.catalog.corpus import WORDS, games, sql_numbered, word_list
from plyforge.catalog.registry import documents, query, table
from plyforge.functions import scoring as sc
from plyforge.functions.notation import TRAINER_PIECES
from plyforge.operators import metrics as mt
from plyforge.operators import tokens as tk
from plyforge.operators import windows as wn
from plyforge.plans import preferences, pretraining
from plyforge.scale import spread


def sql_pieces(text):
    """Pieces of a text with the gaps between them, so that they add up to the text."""
    marked = f"regexp_replace({text}, '({TRAINER_PIECES})', chr(1) || '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda x: x <> '')"


def sql_symbols(piece):
    return f"array_to_string(list_transform(string_split({piece}, ''), lambda c: '<' || hex(c) || '>'), '')"


def sql_byte_symbols(piece):
    return f"array_to_string(list_transform(regexp_extract_all(hex(encode({piece})), '..'), lambda h: '<' || ('0x' || h)::INTEGER || '>'), '')"


def sql_text(symbol):
    return f"decode(unhex({symbol}))"


def sql_pairs(symbols):
    """Adjacent symbols of table `{symbols}(s, freq)` with their weighted counts."""
    return f"""SELECT l, r, sum(freq)::BIGINT AS n FROM (
  SELECT unnest(list_zip(a[1:len(a) - 1], a[2:len(a)])) AS p, p[1] AS l, p[2] AS r, freq
  FROM (SELECT string_split(s[2:len(s) - 1], '><') AS a, freq FROM {symbols}) WHERE len(a) > 1) GROUP BY l, r"""


def sql_merged(symbols, i):
    return f"replace({symbols}, '<' || m{i}.l || '><' || m{i}.r || '>', '<' || m{i}.t || '>')"


def sql_train(pieces, rounds, byte=False):
    """CTEs that learn `rounds` merges from the table `{pieces}(piece, freq)`, one at a time.

    Table `s{rounds}` has the pieces with all merges applied.
    """
    start = sql_byte_symbols("piece") if byte else sql_symbols("piece")
    order = "n DESC, l::INTEGER, r::INTEGER" if byte else "n DESC, l, r"
    steps = [f"s0 AS (SELECT piece, {start} AS s, freq FROM {pieces})"]
    for i in range(rounds):
        new = f"'{256 + i}'" if byte else "l || r"
        steps.append(
            f"m{i} AS MATERIALIZED (SELECT {i} AS rank, l, r, {new} AS t, n FROM ({sql_pairs(f's{i}')}) ORDER BY {order} LIMIT 1)"
        )
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT piece, {sql_merged('s', i)} AS s, freq FROM s{i}, m{i})")
    steps.append("merges AS (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(rounds)) + ")")
    return ",\n".join(steps)


def sql_encode(symbols, rounds, rows):
    """A query over `rows` with `s`: the learned merges applied to a text of symbols by rank."""
    for i in range(rounds):
        symbols = sql_merged(symbols, i)
    tables = "".join(f", m{i}" for i in range(rounds))
    return f"SELECT piece, {symbols} AS s FROM {rows}{tables}"


SPECIALS = "(VALUES (0, '[g_start]'), (1, '[g_end]'), (2, '[unknown]'), (3, '[pad]')) v(id, token)"
VOCABULARY = f"""base AS (SELECT DISTINCT hex(unnest(string_split(piece, ''))) AS token FROM pieces),
vocabulary AS (
  SELECT id, hex(token) AS token FROM {SPECIALS}
  UNION ALL SELECT 3 + row_number() OVER (ORDER BY token), token FROM base
  UNION ALL SELECT 4 + (SELECT count(*) FROM base) + rank, t FROM merges)"""

WORD_MERGES, BYTE_MERGES, PAIR_MERGES, TURN_MERGES, LONG_MERGES = 12, 8, 10, 16, 300
TEXT_PIECES = f"pieces AS MATERIALIZED (SELECT piece, count(*) AS freq FROM (SELECT unnest({sql_pieces('text')}) AS piece FROM documents) GROUP BY piece)"
TRAINED = f"WITH {TEXT_PIECES}, {sql_train('pieces', WORD_MERGES)}"
SHOWN_MERGES = f'SELECT rank, {sql_text("l")} AS "left", {sql_text("r")} AS "right", {sql_text("t")} AS token'


def sql_coded(rounds):
    """The ids of every document's pieces, all of which the merges were learned from."""
    return f"""placed AS (SELECT doc_id, unnest(w) AS piece, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {sql_pieces('text')} AS w FROM documents)),
coded AS (SELECT piece, string_split(s[2:len(s) - 1], '><') AS a FROM s{rounds}),
coded_ids AS (SELECT piece, list(v.id ORDER BY k) AS ids FROM (SELECT piece, unnest(a) AS token, generate_subscripts(a, 1) AS k FROM coded) c JOIN vocabulary v USING (token) GROUP BY piece),
encoded AS (
  SELECT d.doc_id, string_agg(array_to_string(c.ids, ','), ',' ORDER BY p.pos) AS ids, coalesce(sum(len(c.ids)), 0)::BIGINT AS n_tokens
  FROM documents d LEFT JOIN placed p USING (doc_id) LEFT JOIN coded_ids c USING (piece) GROUP BY d.doc_id)"""


def text_pieces():
    return tk.split_pieces(F.col("text"))


def text_vocabulary(spark, sf, merges=WORD_MERGES):
    """(merges, vocabulary) learned from all documents."""
    return tk.train_bpe(documents(spark, sf, "text"), text_pieces(), n_merges=merges)


def encoded_texts(spark, sf, merges=WORD_MERGES):
    learned, vocabulary = text_vocabulary(spark, sf, merges)
    docs = documents(spark, sf, "doc_id", "text")
    return tk.bpe_encode(docs, text_pieces(), learned, vocabulary), vocabulary


@query(
    "byte_tokens",
    """SELECT doc_id, ('0x' || h)::INTEGER AS token, count(*) AS n, sum(pos)::BIGINT AS places FROM (
  SELECT doc_id, unnest(a) AS h, generate_subscripts(a, 1) - 1 AS pos FROM (
    SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS a FROM documents)) GROUP BY ALL""",
)
def _(spark, sf):
    tokens = tk.byte_tokens(documents(spark, sf))
    return tokens.groupBy("doc_id", "token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places")
    )


@query("piece_counts", f"WITH {TEXT_PIECES} SELECT piece, freq FROM pieces")
def _(spark, sf):
    return tk.piece_counts(documents(spark, sf), text_pieces())


def counted_pairs(spark, sf):
    pieces = tk.piece_counts(documents(spark, sf), text_pieces())
    return tk.pair_counts(pieces.select(tk.base_symbols(F.col("piece")).alias("symbols"), "freq"))


def shown_pairs(counts):
    text = lambda name: F.unhex(name).cast("string").alias(name)
    return counts.select(text("left"), text("right"), "n")


COUNTED_PAIRS = f"WITH {TEXT_PIECES}, s AS (SELECT {sql_symbols('piece')} AS s, freq FROM pieces) SELECT {sql_text('l')} AS \"left\", {sql_text('r')} AS \"right\", n FROM ({sql_pairs('s')})"


@query("pair_counts", COUNTED_PAIRS)
def _(spark, sf):
    return shown_pairs(counted_pairs(spark, sf))


@query("top_pair", COUNTED_PAIRS + " ORDER BY n DESC, l, r LIMIT 1")
def _(spark, sf):
    return shown_pairs(tk.top_pairs(counted_pairs(spark, sf)))


@query(
    "merge_pairs",
    f"""WITH {TEXT_PIECES}, {sql_train('pieces', 3)}
SELECT piece, array_to_string(list_transform(string_split(s[2:len(s) - 1], '><'), lambda h: {sql_text('h')} || '|'), '') AS symbols FROM s3""",
)
def _(spark, sf):
    pieces = tk.piece_counts(documents(spark, sf), text_pieces())
    rules = [merge[1:4] for merge in tk.learn_merges(pieces, 3)]
    merged = tk.merge_pairs(tk.base_symbols(F.col("piece")), rules)
    shown = F.transform(tk.symbol_list(merged), lambda s: F.concat(F.unhex(s).cast("string"), F.lit("|")))
    return pieces.select("piece", F.array_join(shown, "").alias("symbols"))


@query("train_bpe", f"{TRAINED} {SHOWN_MERGES}, n FROM merges")
def train_bpe(spark, sf):
    return text_vocabulary(spark, sf)[0]


@query(
    "train_bpe_long",
    f"WITH {TEXT_PIECES}, {sql_train('pieces', LONG_MERGES)} {SHOWN_MERGES}, n FROM merges",
)
def _(spark, sf):
    return text_vocabulary(spark, sf, LONG_MERGES)[0]


@query(
    "train_bpe_bytes",
    f"WITH {TEXT_PIECES}, {sql_train('pieces', BYTE_MERGES, byte=True)} SELECT rank, l AS \"left\", r AS \"right\", t AS token, n FROM merges",
)
def _(spark, sf):
    docs = documents(spark, sf)
    return tk.train_bpe(docs, text_pieces(), tk.FIRST_BYTE_MERGE + BYTE_MERGES, "byte")[0]


ENCODED = "SELECT doc_id, coalesce(ids, '') AS ids FROM encoded"


@query("bpe_encode", f"{TRAINED}, {VOCABULARY}, {sql_coded(WORD_MERGES)} {ENCODED}")
def bpe_encode(spark, sf):
    return encoded_texts(spark, sf)[0].withColumn("ids", F.array_join("ids", ","))


@query(
    "bpe_encode_long",
    f"WITH {TEXT_PIECES}, {sql_train('pieces', LONG_MERGES)}, {VOCABULARY}, {sql_coded(LONG_MERGES)} {ENCODED}",
)
def bpe_encode_long(spark, sf):
    return encoded_texts(spark, sf, LONG_MERGES)[0].withColumn("ids", F.array_join("ids", ","))


@query("bpe_decode", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def _(spark, sf):
    encoded, vocabulary = encoded_texts(spark, sf)
    return tk.bpe_decode(encoded, vocabulary).select("doc_id", "text")


@query(
    "compression",
    f"""{TRAINED}, {VOCABULARY}, {sql_coded(WORD_MERGES)}, t AS (SELECT text AS x, n_tokens FROM documents JOIN encoded USING (doc_id))
SELECT sum(length(x))::BIGINT AS n_chars, sum(strlen(x))::BIGINT AS n_bytes, sum(n_tokens)::BIGINT AS n_tokens, round(sum(strlen(x)) / sum(n_tokens), 8) AS ratio FROM t""",
)
def _(spark, sf):
    encoded, vocabulary = encoded_texts(spark, sf)
    measured = tk.compression(tk.bpe_decode(encoded, vocabulary))
    return measured.withColumn("ratio", F.round("ratio", 8))


TURN_PIECES = f"pieces AS MATERIALIZED (SELECT piece, count(*) AS freq FROM (SELECT unnest(regexp_extract_all({sql_numbered(WORDS.format('text'))}, ' ?\\d+\\.')) AS piece FROM documents) GROUP BY piece)"


@query(
    "turn_token_ids",
    f"""WITH {TURN_PIECES}, {sql_train('pieces', TURN_MERGES)}, {VOCABULARY},
grid AS (SELECT p || n || '.' AS piece FROM range(1, 301) t(n), (VALUES (''), (' ')) s(p)),
coded AS ({sql_encode(sql_symbols('piece'), TURN_MERGES, 'grid')})
SELECT id::INTEGER AS token_id FROM coded JOIN vocabulary ON s = '<' || token || '>'""",
)
def _(spark, sf):
    numbers = F.regexp_extract_all("pgn", F.lit(r"( ?\d+\.)"), F.lit(1))
    corpus = games(spark, sf)
    merges, vocabulary = tk.train_bpe(corpus, numbers, n_merges=TURN_MERGES)
    return tk.turn_token_ids(spark, merges, vocabulary)


# Preference pairs as token ids


def order_pairs(spark, sf):
    n = F.col("o_orderkey")
    context = F.when(n % 5 != 0, F.concat(F.lit("1."), "o_orderstatus", F.lit(" x"), F.col("o_custkey") % 53))
    return spread(table(spark, sf, "orders")).select(
        n.alias("pair_id"),
        F.coalesce(context, F.lit("")).alias("context"),
        F.concat(F.lit("m"), F.col("o_custkey") % 97).alias("chosen"),
        F.concat(F.lit("k"), F.col("o_custkey") % 8900, F.lit("z")).alias("rejected"),
    )


PAIR_TEXTS = f"""WITH p AS (
  SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 5 <> 0 THEN '1.' || o_orderstatus || ' x' || (o_custkey % 53) ELSE '' END AS context,
    'm' || (o_custkey % 97) AS chosen, 'k' || (o_custkey % 8900) || 'z' AS rejected FROM orders),
texts AS (
  SELECT pair_id, 'context' AS part, '[g_start]' || context AS text FROM p
  UNION ALL SELECT pair_id, 'chosen', '[g_start]' || context || CASE WHEN context = '' THEN '' ELSE ' ' END || chosen FROM p
  UNION ALL SELECT pair_id, 'rejected', '[g_start]' || context || CASE WHEN context = '' THEN '' ELSE ' ' END || rejected FROM p),
split AS (SELECT pair_id, part, list_filter(string_split(regexp_replace(text, '(\\[g_start\\]|{TRAINER_PIECES})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS a FROM texts),
placed AS (SELECT pair_id, part, unnest(a) AS piece, generate_subscripts(a, 1) AS pos FROM split),
pieces AS MATERIALIZED (SELECT piece, count(*) AS freq FROM placed WHERE piece <> '[g_start]' GROUP BY piece),
{sql_train('pieces', PAIR_MERGES)}, {VOCABULARY},
coded AS (SELECT piece, string_split(s[2:len(s) - 1], '><') AS a FROM s{PAIR_MERGES}),
ids AS (
  SELECT piece, list(v.id ORDER BY k) AS ids FROM (SELECT piece, unnest(a) AS token, generate_subscripts(a, 1) AS k FROM coded) c JOIN vocabulary v USING (token) GROUP BY piece
  UNION ALL SELECT '[g_start]', [0]),
encoded AS (SELECT pair_id, part, flatten(list(ids ORDER BY pos)) AS ids FROM placed JOIN ids USING (piece) GROUP BY ALL),
wide AS (
  SELECT c.pair_id, c.ids AS c, x.ids AS x, len(c.ids) - len(b.ids) AS cl, len(x.ids) - len(b.ids) AS xl
  FROM encoded c JOIN encoded x ON x.pair_id = c.pair_id AND x.part = 'rejected' JOIN encoded b ON b.pair_id = c.pair_id AND b.part = 'context' WHERE c.part = 'chosen')
SELECT pair_id, array_to_string(list_slice(c, greatest(1, len(c) - 7), len(c)), ',') AS chosen_ids, cl::INTEGER AS chosen_move_len,
  array_to_string(list_slice(x, greatest(1, len(x) - 7), len(x)), ',') AS rejected_ids, xl::INTEGER AS rejected_move_len
FROM wide WHERE cl > 0 AND xl > 0 AND cl <= 8 AND xl <= 8"""


@query("tokenize_pairs", PAIR_TEXTS)
def tokenize_pairs(spark, sf):
    pairs = order_pairs(spark, sf)
    gap = F.when(F.col("context") == "", "").otherwise(" ")
    context = F.concat(F.lit("[g_start]"), "context")
    texts = pairs.select(
        F.explode(F.array(context, F.concat(context, gap, "chosen"), F.concat(context, gap, "rejected"))).alias("text")
    )
    pieces = F.filter(tk.split_pieces(F.col("text"), specials=True), lambda p: p != "[g_start]")
    merges, vocabulary = tk.train_bpe(texts, pieces, n_merges=PAIR_MERGES)
    coded = preferences.tokenize_pairs(pairs, merges, vocabulary, 8)
    return coded.withColumns(
        {name: F.array_join(name, ",") for name in ("chosen_ids", "rejected_ids")}
    )


# Token streams


def length_stream(spark, sf):
    """(doc_id, ids): word lengths as token ids."""
    return documents(spark, sf).select(
        "doc_id", F.transform(word_list(), lambda w: F.length(w)).alias("ids")
    )


STREAM = f"""WITH t AS (SELECT doc_id, list_transform({WORDS.format('text')}, lambda w: length(w)) AS a FROM documents),
games AS (SELECT doc_id, a, coalesce(sum(len(a)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t)"""


@query("token_offsets", STREAM + " SELECT doc_id, start, len(a)::INTEGER AS n FROM games")
def _(spark, sf):
    placed = wn.token_offsets(length_stream(spark, sf), "doc_id", rows_per_bucket=150)
    return placed.select("doc_id", "start", F.size("ids").alias("n"))


@query(
    "training_windows",
    STREAM
    + """, tokens AS (SELECT start + i - 1 AS pos, token FROM (SELECT start, unnest(a) AS token, generate_subscripts(a, 1) AS i FROM games)),
starts AS (SELECT pos AS start FROM tokens WHERE pos % 16 = 0 AND pos < (SELECT count(*) FROM tokens) - 64),
w AS (SELECT s.start, o.k, t.token FROM starts s, range(0, 65) o(k), tokens t WHERE t.pos = s.start + o.k)
SELECT start, string_agg(token::VARCHAR, ',' ORDER BY k) FILTER (k < 64) AS x, string_agg(token::VARCHAR, ',' ORDER BY k) FILTER (k > 0) AS y,
  string_agg(CASE WHEN token IN (3, 7) THEN '0.15' ELSE '1.0' END, ',' ORDER BY k) FILTER (k > 0) AS w FROM w GROUP BY start""",
)
def training_windows(spark, sf):
    stream = wn.token_offsets(length_stream(spark, sf), "doc_id")
    windows = wn.training_windows(stream, 64, 16, [3, 7])
    return windows.withColumns({name: F.array_join(name, ",") for name in ("x", "y", "w")})


def turn_stream(spark, sf):
    """(order, ids): a conversation turn's word lengths, in order of conversation and turn."""
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("place"),
        F.transform(word_list(), lambda w: F.length(w)).alias("ids"),
    )


@query(
    "training_windows_stride_1",
    f"""WITH t AS (SELECT conv_id * 100 + turn AS place, list_transform({WORDS.format('text')}, lambda w: length(w)) AS a FROM conversations),
tokens AS (SELECT a[t.i] AS token, row_number() OVER (ORDER BY place, t.i) - 1 AS pos, count(*) OVER () AS n FROM t, range(1, 100000) t(i) WHERE t.i <= len(a)),
w AS (SELECT pos AS start, n, string_agg(token::VARCHAR, ',') OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS x,
  string_agg(token::VARCHAR, ',') OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS y FROM tokens)
SELECT start, x, y FROM w WHERE start < n - 6""",
)
def _(spark, sf):
    stream = wn.token_offsets(turn_stream(spark, sf), "place", rows_per_bucket=100)
    windows = wn.training_windows(stream, 6)
    return windows.select("start", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@query(
    "pad_batches",
    f"""WITH t AS (SELECT conv_id * 100 + turn AS place, list_transform({WORDS.format('text')}, lambda w: length(w)) AS a FROM conversations),
b AS (SELECT *, (row_number() OVER (ORDER BY place) - 1) // 16 AS batch_no FROM t),
m AS (SELECT *, max(len(a)) OVER (PARTITION BY batch_no) AS longest FROM b)
SELECT place, batch_no, len(a)::INTEGER AS length, array_to_string(list_resize(a, longest, 0), ',') AS padded FROM m""",
)
def _(spark, sf):
    padded = wn.pad_batches(turn_stream(spark, sf), "place", 16, rows_per_bucket=100)
    return padded.select("place", "batch_no", "length", F.array_join("padded", ",").alias("padded"))


@query(
    "best_so_far",
    """SELECT user_id AS run, event_id AS step, value,
min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best,
value < coalesce(min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS is_best FROM events""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value")
    return wn.best_so_far(rows, "value", "step", span=1000)


@query(
    "best_so_far_max",
    """SELECT event_type AS run, event_id AS step, value,
greatest(100, max(value) OVER (PARTITION BY event_type ORDER BY event_id)) AS best,
value > greatest(100, coalesce(max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_best FROM events""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")
    return wn.best_so_far(rows, "value", "step", mode="max", start=100.0, span=500)


# Scores


def token_logps(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("logps"),
        (1 + F.col("vec_id") % 4).cast("int").alias("move_len"),
        F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.when(i % 3 == 0, 0.15).otherwise(1.0)).alias("weights"),
    )


LOGPS = "SELECT vec_id, list_transform(embedding, lambda x: -abs(x::DOUBLE)) AS l, (1 + vec_id % 4)::INTEGER AS m FROM embeddings"


@query("move_logprob", f"SELECT vec_id, round(list_sum(l[len(l) - m + 1:len(l)]), 8) AS logprob FROM ({LOGPS})")
def _(spark, sf):
    value = sc.move_logprob(F.col("logps"), F.col("move_len"))
    return token_logps(spark, sf).select("vec_id", F.round(value, 8).alias("logprob"))


@query(
    "weighted_nll",
    f"""WITH s AS (SELECT vec_id, -list_sum(list_transform(l, lambda x, i: x * CASE WHEN (i - 1) % 3 = 0 THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END)) AS nll, len(l) AS n FROM ({LOGPS})),
b AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 8 AS b FROM s)
SELECT round(avg(loss), 8) AS loss FROM (SELECT b, sum(nll) / sum(n) AS loss FROM b WHERE b < 50 GROUP BY b)""",
)
def _(spark, sf):
    return mt.weighted_nll(token_logps(spark, sf), 8, "vec_id").withColumn("loss", F.round("loss", 8))


@query(
    "preference_metrics",
    """WITH s AS (SELECT vec_id, -40 * abs(embedding[1]::DOUBLE) AS pc, -40 * abs(embedding[2]::DOUBLE) AS pr,
  -40 * abs(embedding[3]::DOUBLE) AS rc, -40 * abs(embedding[4]::DOUBLE) AS rr FROM embeddings),
b AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS b, 0.1::DOUBLE * ((pc - pr) - (rc - rr)) AS z FROM s),
m AS (SELECT b, avg(CASE WHEN 0.1::DOUBLE * (pc - rc) > 0.1::DOUBLE * (pr - rr) THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))) AS l FROM b WHERE b < 30 GROUP BY b)
SELECT round(avg(a), 6) AS reward_accuracy, round(avg(l), 6) AS preference_loss FROM m""",
)
def _(spark, sf):
    at = lambda i: -40 * F.abs(F.get("embedding", F.lit(i)).cast("double"))
    scored = table(spark, sf, "embeddings").select(
        "vec_id",
        at(0).alias("policy_chosen"),
        at(1).alias("policy_rejected"),
        at(2).alias("ref_chosen"),
        at(3).alias("ref_rejected"),
    )
    found = mt.preference_metrics(scored, "vec_id")
    return found.withColumns({name: F.round(name, 6) for name in found.columns})


@query(
    "loss_weights",
    f"SELECT doc_id, array_to_string(list_transform({WORDS.format('text')}, lambda w: CASE WHEN length(w) IN (2, 5) THEN '0.15' ELSE '1.0' END), ',') AS w FROM documents",
)
def _(spark, sf):
    weights = sc.loss_weights(F.col("ids"), F.lit([2, 5]))
    return length_stream(spark, sf).select("doc_id", F.array_join(weights, ",").alias("w"))


@query(
    "truncate_left",
    f"""WITH t AS (SELECT doc_id, list_transform({WORDS.format('text')}, lambda w: length(w)) AS a, 1 + doc_id % 60 AS m FROM documents)
SELECT doc_id, CASE WHEN least(len(a), 50) >= m THEN array_to_string(a[greatest(1, len(a) - 49):len(a)], ',') END AS ids FROM t""",
)
def _(spark, sf):
    kept = sc.truncate_left(F.col("ids"), 50, 1 + F.col("doc_id") % 60)
    return length_stream(spark, sf).select("doc_id", F.array_join(kept, ",").alias("ids"))


@query(
    "score_cp",
    """SELECT event_id, CASE WHEN m > 0 THEN 10000 - m WHEN m <= 0 THEN -10000 - m ELSE value::INTEGER END AS cp
FROM (SELECT event_id, floor(value) AS value, CASE WHEN event_id % 3 = 0 THEN event_id % 21 - 10 END AS m FROM events)""",
)
def _(spark, sf):
    mate = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 21 - 10)
    cp = F.floor("value").cast("long")
    return table(spark, sf, "events").select("event_id", sc.score_cp(cp, mate).alias("cp"))


# The whole pre-training path


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
WRAPPED = f"CASE WHEN starts_with(trim(text, {BLANKS}), '[g_start]') THEN trim(text, {BLANKS}) ELSE '[g_start]' || trim(text, {BLANKS}) || '[g_end]' END"
WINDOWS = f"""{TRAINED}, {VOCABULARY},
split AS (SELECT doc_id, list_filter(string_split(regexp_replace({WRAPPED}, '(\\[g_start\\]|\\[g_end\\]|\\[unknown\\]|\\[pad\\]|{TRAINER_PIECES})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS a FROM documents),
placed AS (SELECT doc_id, unnest(a) AS piece, generate_subscripts(a, 1) AS pos FROM split),
distinct_pieces AS (SELECT DISTINCT piece FROM placed),
coded AS (SELECT piece, string_split(s[2:len(s) - 1], '><') AS a FROM ({sql_encode(sql_symbols('piece'), WORD_MERGES, 'distinct_pieces')})),
ids AS (
  SELECT piece, list(v.id ORDER BY k) AS ids FROM (SELECT piece, unnest(a) AS token, generate_subscripts(a, 1) AS k FROM coded WHERE piece NOT IN (SELECT token FROM {SPECIALS})) c JOIN vocabulary v USING (token) GROUP BY piece
  UNION ALL SELECT token, [id] FROM {SPECIALS}),
tokens AS (SELECT token, row_number() OVER (ORDER BY doc_id, pos, i) - 1 AS pos FROM (
  SELECT doc_id, pos, unnest(ids) AS token, generate_subscripts(ids, 1) AS i FROM placed JOIN ids USING (piece))),
starts AS (SELECT pos AS start FROM tokens WHERE pos % 128 = 0 AND pos < (SELECT count(*) FROM tokens) - 128),
w AS (SELECT s.start, o.k, t.token FROM starts s, range(0, 129) o(k), tokens t WHERE t.pos = s.start + o.k)
SELECT start, string_agg(token::VARCHAR, ',' ORDER BY k) FILTER (k < 128) AS x, string_agg(token::VARCHAR, ',' ORDER BY k) FILTER (k > 0) AS y FROM w GROUP BY start"""


@query("window_dataset", WINDOWS)
def window_dataset(spark, sf):
    merges, vocabulary = text_vocabulary(spark, sf)
    corpus = documents(spark, sf).select(F.col("doc_id").alias("order_key"), F.col("text").alias("pgn"))
    windows = pretraining.window_dataset(corpus, merges, vocabulary, 128, 128)
    return windows.select("start", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))
