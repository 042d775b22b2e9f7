"""One query per operator, over its whole table, with the digest columns that are compared."""

from pyspark.sql import functions as F

from plyforge.llm import (
    decontamination,
    divergence,
    embeddings,
    html,
    licenses,
    middle,
    minhash,
    packing,
    passages,
    suffixes,
    tokencounts,
    toolcalls,
    toxicity,
)
from plyforge.llm.registry import query, table


@query(
    "op2_decontaminate",
    r"""
    WITH item_words AS (
        SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 13) - 1) AS gram
        FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
    doc_words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    sizes AS (SELECT DISTINCT len(gram) AS n FROM windows),
    starts AS (
        SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS gram
        FROM doc_words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
    hits AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM starts s JOIN windows g ON s.gram = g.gram),
    hit_words AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_hit
        FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
        coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op2_decontaminate(spark, folder):
    """Words of each document inside occurrences of benchmark windows."""
    found = decontamination.find_contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontamination.items_digest(F.col("items")).alias("items_sha256"),
        "contaminated",
    )


@query("op4_pack")
def op4_pack(spark, folder):
    """All documents packed into sequences of at most 2048 tokens."""
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op6_toxicity")
def op6_toxicity(spark, folder):
    """A toxicity score of every document, learned outside the held-out fold."""
    scored = toxicity.score(
        table(spark, folder, "documents"),
        table(spark, folder, "labels"),
        keep=lambda doc_id: ~toxicity.held_out(doc_id),
    )
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query("op10_licenses")
def op10_licenses(spark, folder):
    """Licence phrases and labels of every document."""
    return licenses.summary(licenses.scan(table(spark, folder, "documents")))


@query("op7_main_text")
def op7_main_text(spark, folder):
    """The main text of every page."""
    found = html.main_text(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query(
    "op8_tool_calls",
    r"""
    WITH calls AS (
        SELECT conv_id, turn, conv_id || ':' || turn AS call_id, coalesce(text, '') AS prompt,
            CASE role WHEN 'user' THEN 'answer' ELSE 'configure' END AS name
        FROM conversations WHERE role IN ('user', 'system')),
    results AS (
        SELECT conv_id, turn AS result_turn, conv_id || ':' || (turn - 1) AS call_id, text
        FROM conversations WHERE role = 'assistant')
    SELECT conv_id, call_id, c.turn, name, CASE WHEN c.turn IS NOT NULL THEN 0 END AS level,
        result_turn, (c.turn IS NOT NULL)::BIGINT AS n_calls,
        (result_turn IS NOT NULL)::BIGINT AS n_results, status,
        '{"arguments":' || coalesce('{"chars":' || length(prompt) || ',"prompt":' || to_json(prompt)
            || ',"turn":' || c.turn || '}', 'null') || ',"id":' || to_json(call_id) || ',"name":'
            || coalesce(to_json(name), 'null') || ',"result":' || coalesce(to_json(text), 'null')
            || ',"status":"' || status || '"}' AS line
    FROM calls c FULL JOIN results r USING (conv_id, call_id),
    LATERAL (SELECT CASE WHEN c.turn IS NULL THEN 'orphan' WHEN result_turn IS NULL
        THEN 'unanswered' ELSE 'linked' END AS status) s
    """,
)
def op8_tool_calls(spark, folder):
    """Each turn as a tool call, linked to its answer."""
    turns = table(spark, folder, "conversations")
    return toolcalls.link(
        toolcalls.calls_of(turns), toolcalls.results_of(turns), toolcalls.turn_schemas(spark)
    )


@query(
    "op5_embeddings",
    r"""
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x:
            x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    reach AS (
        SELECT a AS node, a AS seen FROM links UNION
        SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
    smallest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
    counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links,
        coalesce(component_id, e.vec_id) AS component_id,
        coalesce(component_id, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN counts ON a = vec_id LEFT JOIN smallest ON node = vec_id
    """,
)
def op5_embeddings(spark, folder):
    """Links and components of all vectors by cosine."""
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query("op3_minhash")
def op3_minhash(spark, folder):
    """Components of documents whose shingle sets are alike by 85 in 100 or more."""
    return minhash.near_duplicates(table(spark, folder, "documents"), percent=85).drop("text_key")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, folder):
    """Bytes of each document covered by 50-byte strings of earlier documents."""
    return suffixes.summary(suffixes.repeated_bytes(table(spark, folder, "documents")))


@query("op1_passages")
def op1_passages(spark, folder):
    """Passages of 50 words and more that an earlier document holds too, or nearly."""
    return passages.repeated_passages(table(spark, folder, "documents"))


@query(
    "op11_divergence",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    tokens AS (SELECT id, lang, source, unnest(w) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT id) >= 10),
    groups AS (SELECT DISTINCT lang, source FROM d),
    sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
    counts AS (
        SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n
        FROM tokens t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
    shares AS MATERIALIZED (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
            1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v) AS p
        FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
        LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
        LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
    lang_counts AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL),
    lang_shares AS (
        SELECT lang, term, 1 + (1000000000 * (n + 2)) // (total + 2 * v) AS q
        FROM lang_counts JOIN sizes USING (lang)
        JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM lang_counts GROUP BY lang) USING (lang)),
    gaps AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
    terms AS (
        SELECT s.lang, source, 'term' AS part, s.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
        FROM shares s JOIN lang_shares l ON s.lang = l.lang AND s.term = l.term WHERE n > 0 AND p > q)
    SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
    """,
)
def op11_divergence(spark, folder):
    """How far each source's words are from other sources' and from its language's."""
    return divergence.audit(table(spark, folder, "documents"))


@query("op12_token_counts")
def op12_token_counts(spark, folder):
    """Bytes and tokens of every document."""
    return tokencounts.count_tokens(table(spark, folder, "documents"))


@query(
    "op13_fill_in_middle",
    r"""
    WITH hashed AS (
        SELECT doc_id, coalesce(text, '') AS text,
            sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    units AS (
        SELECT doc_id, text, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT FOR i IN range(0, 4)] AS h,
            regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM hashed),
    cuts AS (
        SELECT doc_id, text, w, len(w) AS n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a,
            greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
    parts AS (
        SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle,
            array_to_string(w[b + 1:n], '') AS suffix FROM cuts)
    SELECT doc_id, n::BIGINT AS n, form,
        CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM parts
    """,
)
def op13_fill_in_middle(spark, folder):
    """Documents cut in three and put in another order, and the texts rebuilt from them."""
    made = middle.fill_in_middle(table(spark, folder, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
