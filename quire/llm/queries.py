"""Named queries of this subpackage: each applies one operator, with its
production parameters, to its whole table.  ``ORACLE_SQL`` holds the same
result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    chat_format, conversation_repair, decontaminate, html_extract, importance_resampling, packing, pivot_search,
    quality_rules, simhash_dedup, suffix_dedup, token_counts, toxicity, warc,
)
from quire.llm.common import shared_path
from quire.operators.rank import join_on_keys
from quire.session import checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@register("op1_quality_rules", rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM t, unnest(range(1, len(w) - 6)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, sum(n) AS n FROM (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM r) GROUP BY doc_id),
m AS (SELECT t.doc_id, text, w, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    5 * n_symbols > n_words
    OR 5 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * word_chars
    OR 2 * (length(text) - length(replace(text, '!', ''))) > n_words
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 2 * n_dup_lines > len(lines)
    OR 10 * len([i for i in range(2, len(w) + 1) if w[i] = w[i - 1]]) > 3 * n_words) AS kept
FROM b""")
def op1(spark, sf_dir):
    """Base measures and verdict of every document."""
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


#: the sample conversation whose texts look like markup
MARKUP_ID, MARKUP_TEXT = -7, "\\### Assistant: </turn> ok"


@register("op9_chat_format", r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                                  (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '</?turn')) AS body FROM r)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<turn ' || role || '>') + 1 + body + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""")
def op9(spark, sf_dir):
    """Turns and loss text of every conversation, read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(2).select(F.lit(MARKUP_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                   F.lit(MARKUP_TEXT).alias("text"))
    out = chat_format.formatted(chat_format.canonical(chat_format.message_lists(rows.unionByName(sample))))
    back = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
                      chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@register("op10_benchmark_decontamination", r"""
WITH n AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, row_number() OVER () AS k, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM n),
s AS (SELECT DISTINCT kind, id, k, array_to_string(w[i:i + 4], ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
c AS (SELECT id AS item_id, k, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY ALL),
m AS (SELECT d.id AS doc_id, d.k AS dk, i.id AS item_id, i.k AS k, count(*) AS n_shared
  FROM s d JOIN s i ON d.s = i.s WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM m JOIN c USING (item_id, k) WHERE 10 * n_shared >= 8 * n_item""")
def op10(spark, sf_dir):
    """Benchmark items found in documents, with the counts of the exact check."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_token_counts")
def op2(spark, sf_dir):
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@register("op6_packing")
def op6(spark, sf_dir):
    """Every piece of every packed document."""
    return packing.pieces(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def held_out(doc_id):
    """Whether a document is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@register("op3_toxicity")
def op3(spark, sf_dir):
    """Toxicity score of every document; learned from labels outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = toxicity.labelled_texts(docs, labels.where(~held_out("doc_id")))
    out = toxicity.scored(docs, toxicity.learn(labelled))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@register("op8_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
h AS (SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)""")
def op8(spark, sf_dir):
    """Every page, read back from the archives it was written to."""
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.pages_of(warc.read_archives(spark, path))


@register("op7_suffix_array_dedup")
def op7(spark, sf_dir):
    """What every document loses to passages of documents with smaller ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.repeated_passages(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op5_html_extraction")
def op5(spark, sf_dir):
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


#: CRC-32 in SQL: a table of 256 entries by its rule, then one step per byte of the string's hex form
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc(text: str) -> str:
    return (f"xor(list_reduce([4294967295] || list_transform(range(octet_length(encode({text}))),"
            f" lambda i: ('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::BIGINT),"
            " lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295)")


def _best_edits(offers: list[tuple[str, str, str, str]]) -> str:
    """Struct (cost, audit) of the best of (condition, state, cost, label); null without any."""
    each = ", ".join(f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{label}'}} END"
                     for when, state, cost, label in offers)
    return f"list_min([{each}])"


def _after_insertions(names: tuple[str, ...], source: str) -> str:
    """Two rounds of inserted turns reach every state (columns n, s, u, a)."""
    n, s, u, a = names
    one = (f"SELECT * REPLACE (list_min([{u}, CASE WHEN {n} IS NOT NULL THEN {{'c': {n}.c + 3, 'a': {n}.a || 'I'}} END,"
           f" CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + 3, 'a': {s}.a || 'I'}} END,"
           f" CASE WHEN {a} IS NOT NULL THEN {{'c': {a}.c + 3, 'a': {a}.a || 'I'}} END]) AS {u},"
           f" list_min([{a}, CASE WHEN {u} IS NOT NULL THEN {{'c': {u}.c + 3, 'a': {u}.a || 'I'}} END]) AS {a}) FROM ")
    return one + f"({one} ({source}))"


@register("op11_conversation_structure_repair", rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT DISTINCT key, {_crc("key")} % 20 AS c FROM crc, k),
d AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
    CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k JOIN h USING (key)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
g AS (SELECT conv_id, i, role, text, r, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM f),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS n, NULL::STRUCT(c INTEGER, a VARCHAR) AS s,
    NULL::STRUCT(c INTEGER, a VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR) AS a FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL
  SELECT x.conv_id, g.i,
    {_best_edits([("true", "n", "4", "D")])},
    {_best_edits([("true", "s", "4", "D"), ("NOT gone AND r = 's'", "n", "more", "K")])},
    {_best_edits([("true", "u", "4", "D")] + [(f"NOT gone{w}", q, c, e) for q in ("n", "s", "a") for w, c, e in
                                             ((" AND r = 'u'", "more", "K"), ("", "3 + more", "R"))])},
    {_best_edits([("true", "a", "4", "D"), ("NOT gone AND r = 'a'", "u", "more", "K"), ("NOT gone", "u", "3 + more", "R")])}
  FROM ({_after_insertions(("n", "s", "u", "a"), "SELECT * FROM steps")}) x JOIN g ON x.conv_id IS NOT DISTINCT FROM g.conv_id
    AND g.i = x.i + 1),
z AS (SELECT conv_id, list_min([n, a]) AS best FROM ({_after_insertions(("n", "s", "u", "a"),
    "SELECT * FROM steps QUALIFY i = max(i) OVER (PARTITION BY conv_id)")}) q),
l AS (SELECT conv_id, p, substr(best.a, p, 1) AS e, best.a AS audit FROM z, unnest(range(1, length(best.a) + 1)) AS v(p)),
m AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
    count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS q,
    count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd FROM l),
t AS (SELECT m.conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (q + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha
  FROM m LEFT JOIN g ON m.conv_id IS NOT DISTINCT FROM g.conv_id AND m.i = g.i AND e <> 'I' WHERE e <> 'D' GROUP BY m.conv_id),
w AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id
LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id""")
def op11(spark, sf_dir):
    """Faults, cheapest edits and digest of the repaired text of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    repair = conversation_repair.Repair(conversation_repair.damaged(rows))
    out = join_on_keys(rows.select("conv_id").distinct(), repair.audits(), ["conv_id"], "left")
    out = join_on_keys(out, conversation_repair.digests(repair.turns()), ["conv_id"], "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@register("op12_importance_resampling", rf"""
WITH {_CRC_TABLE},
w AS (SELECT kind, id, row_number() OVER () AS k, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
f AS (SELECT kind, k, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS f FROM w),
h AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM crc, (SELECT DISTINCT f FROM f)),
b AS (SELECT kind, k, bucket FROM f JOIN h USING (f)),
n AS (SELECT bucket, count(*) FILTER (kind = 'd')::DOUBLE AS s, count(*) FILTER (kind = 'b')::DOUBLE AS t FROM b GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain
  FROM n),
d AS (SELECT k, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM b JOIN g USING (bucket)
  WHERE kind = 'd' GROUP BY k),
r AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || id), 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d USING (k) WHERE kind = 'd'),
q AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM q""")
def op12(spark, sf_dir):
    """Weight and draw of every document towards the benchmark texts."""
    out = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@register("op13_exact_top_k_search", r"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, q.k, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""")
def op13(spark, sf_dir):
    """The 20 vectors of highest inner product for every twentieth vector."""
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
