"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, classifier, decontaminate, line_dedup, minhash, mixing, packing, phrases, quality_rules, repair, secrets, token_counts, warc
from tidemark.llm.common import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn`` under its name, with the SQL that gives the same rows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(
    """WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
    unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
occ AS (SELECT *, trim(raw) AS t, length(trim(raw)) AS k FROM line),
uniq AS (
  SELECT t, k, doc_id, n, k // 2 AS h FROM occ WHERE k >= 20
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, n) = 1),
blocked AS (
  SELECT a.t AS a, b.t AS b, a.k AS ka, b.k AS kb, a.doc_id AS da, a.n AS na, b.doc_id AS db, b.n AS nb
  FROM uniq a JOIN uniq b ON left(a.t, a.h) = left(b.t, a.h) AND b.k IN (a.k, a.k + 1) AND a.t <> b.t
  UNION
  SELECT a.t, b.t, a.k, b.k, a.doc_id, a.n, b.doc_id, b.n
  FROM uniq a JOIN uniq b ON right(a.t, a.k - a.h) = right(b.t, a.k - a.h) AND b.k IN (a.k, a.k + 1) AND a.t <> b.t),
linked AS (
  SELECT * FROM blocked WHERE CASE WHEN ka = kb
    THEN len(list_filter(range(1, ka + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1
    ELSE len(list_filter(range(0, kb), lambda i: left(b, i) || substr(b, i + 2) = a)) > 0 END),
near AS (
  SELECT b AS t FROM linked WHERE (da, na) < (db, nb) UNION SELECT a FROM linked WHERE (db, nb) < (da, na)),
judged AS (
  SELECT o.doc_id, o.n, o.raw, o.k >= 20 AS long, u.t IS NOT NULL AS first, w.t IS NOT NULL AS near
  FROM occ o LEFT JOIN uniq u ON o.t = u.t AND o.doc_id = u.doc_id AND o.n = u.n
  LEFT JOIN near w ON u.t = w.t)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (long) AS n_long,
  count(*) FILTER (long AND first AND NOT near) AS n_kept, count(*) FILTER (long AND first AND near) AS n_near,
  md5(coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (NOT long OR (first AND NOT near)), '')) AS text_md5
FROM judged GROUP BY doc_id"""
)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines kept of every document, and the digest of its cleaned text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc.doc_id", "n_lines", "n_long", "n_kept", "n_near", F.md5("text").alias("text_md5")
    )


@query()
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    counted = quality_rules.count_text(docs).withColumn("doc", F.struct(F.col("doc.doc_id")))
    counted = staged(counted, "quality-counts")
    judged = quality_rules.judge(counted, quality_rules.references(counted))
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )


@query()
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and places of the secrets of every document."""
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc.doc_id",
        *(
            F.size(F.get("found", F.lit(k))).cast("long").alias(f"n_{rule.kind}")
            for k, rule in enumerate(secrets.BASE)
        ),
        F.sha2(secrets.span_text(F.col("found"), secrets.BASE), 256).alias("base_sha256"),
        secrets.span_text(F.col("found"), secrets.RULES).alias("spans"),
    )


@query()
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_tokens")


@query()
def op3_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as it is read back from the archives."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return warc.archive_and_read(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault"
    )


@query()
def op7_weighted_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near-duplicates of every document, and its links."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc.doc_id", "class_id", "links")


@query()
def op8_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that leak benchmark items, and which."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    leaks = decontaminate.find_leaks(docs, table(spark, folder, "benchmark"))
    return leaks.select("doc_id", "item_id", *(F.round(c, 4).alias(c) for c in ("cosine", "share", "answer")))


@query(
    """WITH RECURSIVE calls AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
chain AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, p.level + 1 FROM chain p JOIN calls c ON c.conv_id = p.conv_id AND c.turn = p.turn + 2),
answers AS (
  SELECT conv_id, turn - 1 AS turn, text AS content FROM conversations WHERE role = 'assistant'),
rows AS (
  SELECT c.conv_id, c.turn, k.level, c.text, a.turn IS NOT NULL AS linked, a.content
  FROM calls c JOIN chain k USING (conv_id, turn) LEFT JOIN answers a USING (conv_id, turn))
SELECT conv_id, 't' || turn AS call_id, CAST(level AS BIGINT) AS level,
  CASE WHEN linked THEN 'linked' ELSE 'open' END AS status, length(text) > 0 AS valid,
  CAST(CASE WHEN length(text) > 0 THEN 0 ELSE 1 END AS BIGINT) AS n_errors,
  md5('{"after":["t' || (turn - 2) || '"],"arguments":{"text":' || to_json(text) || ',"turn":' || turn
    || '},"id":"t' || turn || '","name":"reply","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null')
    || ',"status":"' || CASE WHEN linked THEN 'linked' ELSE 'open' END || '"}') AS line_md5
FROM rows"""
)
def op4_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every user's turn as a call, linked to its answer, checked and serialised."""
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    linked = chat.link_calls(*chat.turns_as_calls(talks), chat.REPLY)
    return linked.select(
        "conv_id", "call_id", "level", "status", "valid", F.size("errors").cast("long").alias("n_errors"),
        F.md5("line").alias("line_md5"),
    )


@query()
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    judged = classifier.classify(docs, table(spark, folder, "labels"))
    return judged.withColumn("perplexity", F.round("perplexity", 6))


@query(
    """WITH sized AS (
  SELECT doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / w AS lim,
    CAST(sum(source_size) OVER () AS DOUBLE) AS all_size, CAST(sum(w) OVER () AS DOUBLE) AS all_w,
    coalesce(CAST(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS before_most,
    coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_w FROM src),
levels AS (SELECT *, (1.5::DOUBLE * all_size - before_most) / (all_w - before_w) AS level FROM ordered),
top AS (SELECT max(level) AS level FROM levels WHERE level <= lim),
wanted AS (
  SELECT source, source_size, CASE WHEN top.level IS NULL THEN most ELSE least(most, top.level * w) END AS target
  FROM levels, top),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized d JOIN wanted t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS taken
FROM placed"""
)
def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, carry=["doc_id"])
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken")


@query()
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return repair.whole_reports(repair.report(repair.repair(repair.damaged(talks))), talks)


@query(
    """WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
word AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM word),
gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spot, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM gram GROUP BY ALL HAVING count(*) >= 100),
tot AS (SELECT lang, count(*) AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
valued AS (
  SELECT t.lang, t.phrase, t.a, t.c, x.n AS l, y.n AS r, tot.n,
    (1000::HUGEINT * t.a * tot.n) // (x.n::HUGEINT * y.n) AS score
  FROM cut t JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(t.w[1:t.c], ' ')
  JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(t.w[t.c + 1:], ' ') JOIN tot ON tot.lang = t.lang),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
part AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM cand, range(2, 5) s(m), range(1, 5) t(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT v.* FROM lowest v LEFT JOIN part p USING (lang, phrase) WHERE p.around IS NULL OR 100 * p.around < 100 * v.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000"""
)
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Best phrases of every language."""
    return phrases.collocations(table(spark, folder, "documents").select("lang", "text"))
