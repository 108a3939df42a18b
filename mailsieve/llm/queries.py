"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import (
    alignment, collocations, fingerprints, language_id, line_dedup, minhash, mixing, quality_rules, secrets, sentencepiece, substring_dedup, toxicity, warc,
)
from mailsieve.llm.common import read_table

QUERIES = {}
ORACLE = {}
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_FILE = "/opt/tokenizers/byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM g),
cover AS (
  SELECT doc_id, count(DISTINCT i + o.x) AS n FROM win, (VALUES (0), (1), (2)) AS o(x) WHERE k > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, array_to_string(w, '') AS s, coalesce(c.n, 0) AS n_repeat_words,
    list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d LEFT JOIN cover c USING (doc_id)),
f AS (
  SELECT doc_id, n_words, length(s) AS word_chars, length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(s, '[^\pL]', '', 'g')) AS n_letters, length(regexp_replace(s, '[^\p{Lu}]', '', 'g')) AS n_capitals
  FROM m),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN word_chars < 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN n_symbols > CAST(0.1 AS DOUBLE) * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN n_dup_lines > CAST(0.3 AS DOUBLE) * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN n_letters < CAST(0.7 AS DOUBLE) * word_chars THEN 64 ELSE 0 END)
    + (CASE WHEN n_capitals > CAST(0.4 AS DOUBLE) * n_letters THEN 128 ELSE 0 END) AS bits FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
  CAST(bits AS BIGINT) AS fail_bits FROM b
"""


@query("op7_quality_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.failed(quality_rules.BASE).alias("base_failed"),
        (~quality_rules.failed(quality_rules.PRODUCTION)).alias("kept"),
        "fail_bits",
    )


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), model, keep=("doc_id", "held_out"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 1) / CAST(4503599627370496 AS DOUBLE))
      / greatest(CAST(0.05 AS DOUBLE), length(regexp_replace(coalesce(text, ''), '[^\pL]', '', 'g')) / CAST(greatest(length(coalesce(text, '')), 1) AS DOUBLE)) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (
  SELECT *, CASE WHEN cap > level * w THEN max(CASE WHEN cap > level * w THEN level END) OVER () * w ELSE cap END AS target FROM l),
e AS (SELECT *, least(floor(target / greatest(source_size, 1)), 3) AS epochs FROM t),
p AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(least(epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken FROM p
"""


@query("op3_source_mix", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, mixing.letter_share(docs["text"]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), least=50)


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND holder <> page_id THEN holder END AS refers_to FROM g
"""


@query("op5_warc", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(read_table(spark, sf_dir, "pages"), warc.new_folder(spark))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.fingerprints(docs).withColumnRenamed("id", "doc_id")


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece.load(PIECE_MODEL)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece.encode(docs, pieces, decoded="decoded")
    return rows.select(
        "doc_id", "piece_ids", F.size("piece_ids").alias("n_pieces"), "decoded", (F.col("decoded") == F.col("text")).alias("same")
    )


@query("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.predict(docs, model, keep=("doc_id", "held_out"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(read_table(spark, sf_dir, "documents"), alignment.load(BYTE_FILE, PIECE_MODEL))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
o AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM s),
c AS (SELECT lang, w[i:i + k - 1] AS p, k, CAST(count(*) AS HUGEINT) AS a FROM o GROUP BY 1, 2, 3),
f AS (SELECT * FROM c WHERE a >= 100),
t AS (SELECT lang, CAST(sum(a) AS HUGEINT) AS n FROM c WHERE k = 1 GROUP BY lang),
u AS (SELECT lang, p, k, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
x AS (
  SELECT u.*, l.a AS l, r.a AS r, t.n, 1000 * u.a * t.n // (l.a * r.a) AS score FROM u JOIN t ON u.lang = t.lang
  JOIN f l ON l.lang = u.lang AND l.p = u.p[1:cut] JOIN f r ON r.lang = u.lang AND r.p = u.p[cut + 1:u.k]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS no FROM x),
j AS (SELECT lang, p, k, a, unnest(range(1, k + 1)) AS i FROM f WHERE k > 2),
e AS (SELECT lang, p, k, a, i, unnest(range(i + 1, k + 1)) AS z FROM j),
m AS (SELECT lang, p[i:z] AS p, max(a) AS longer FROM e WHERE z - i + 1 < k GROUP BY 1, 2),
g AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN m ON b.lang = m.lang AND b.p = m.p
  WHERE no = 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM g)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))
