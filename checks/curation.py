"""Queries and check SQL: cleaning, filters, sampling, copies, splits, counts, sources, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.duck import NS, NW, S, SP, ctes, q
from mailsieve.functions import text as T
from mailsieve.operators import curation as C
from mailsieve.operators.verdicts import composition
from mailsieve.session import shared_dir, written
from mailsieve.plans.corpus_build import build_corpus
from mailsieve.sources import corpora, sinks
from mailsieve.sources.derived import load_derived, load_table

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def emails(spark: SparkSession, sf: str) -> DataFrame:
    return load_derived(spark, sf, "emails")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows: label 1 where the labels table marks a document, else 0."""
    marks = load_table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    docs = load_table(spark, sf, "documents").select("doc_id", "text", "source")
    joined = docs.join(marks, "doc_id", "left")
    return joined.withColumn("label", F.coalesce("label", F.lit(0)))


CORPUS = """corpus AS (SELECT d.doc_id, d.text, d.source, coalesce(CAST(l.toxic AS INTEGER), 0) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
CLEAN = (
    "trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, "
    f"'<[^>]+>', '', 'g'), 'http[s]?://{NS}+', '[URL]', 'g'), 'www\\.{NS}+', '[URL]', 'g'), "
    f"'{NS}+@{NS}+\\.{NS}+', '[EMAIL]', 'g'), 'Â', ''), '{S}+', ' ', 'g'))"
)
INFER = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(%s), "
    "'http[s]?://[a-zA-Z$-_!]+', '[URL]', 'g'), "
    "'\\b[A-Za-z0-9._%%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b', '[EMAIL]', 'g'), "
    f"'[\\+]?[(]?[0-9]{{1,3}}[)]?[-{SP}\\.]?[0-9]{{3}}[-{SP}\\.]?[0-9]{{4,6}}', '[PHONE]', 'g'), "
    f"'{S}+', ' ', 'g'))"
)


@query("clean_corpus", f"{ctes('emails')} SELECT email_id, {CLEAN % 'text'} AS text FROM emails")
def _clean(spark, sf):
    return emails(spark, sf).select("email_id", T.clean_corpus(F.col("text")).alias("text"))


@query("clean_inference", f"{ctes('emails')} SELECT email_id, {INFER % 'text'} AS text FROM emails")
def _infer(spark, sf):
    return emails(spark, sf).select("email_id", T.clean_inference(F.col("text")).alias("text"))


@query(
    "concat_text",
    f"{ctes('emails')} SELECT email_id, coalesce(subject, '') || ' ' || text AS text FROM emails",
)
def _concat(spark, sf):
    joined = T.concat_text(F.col("subject"), F.col("text"))
    return emails(spark, sf).select("email_id", joined.alias("text"))


@query(
    "combine_subject_body",
    f"""{ctes("emails")} SELECT email_id, CASE WHEN subject <> '' THEN 'Subject: ' || subject || chr(10) || chr(10) || text
    ELSE text END AS text FROM emails""",
)
def _combine(spark, sf):
    joined = T.combine_subject_body(F.col("subject"), F.col("text"))
    return emails(spark, sf).select("email_id", joined.alias("text"))


@query(
    "resolve_text",
    f"""{ctes("emails")} SELECT 'mail' AS kind, email_id, coalesce(subject, '') || ' ' || text AS text FROM emails
    UNION ALL SELECT 'combined', doc_id, text FROM documents UNION ALL SELECT 'body', page_id, html FROM pages""",
)
def _resolve(spark, sf):
    mail = C.resolve_text(emails(spark, sf).withColumnRenamed("text", "body"))
    docs = load_table(spark, sf, "documents").select("doc_id", F.col("text").alias("text_combined"))
    pages = load_table(spark, sf, "pages").select("page_id", F.col("html").alias("body"))
    parts = [("mail", mail, "email_id"), ("combined", C.resolve_text(docs), "doc_id"),
             ("body", C.resolve_text(pages), "page_id")]
    frames = [d.select(F.lit(k).alias("kind"), F.col(i).alias("email_id"), "text") for k, d, i in parts]
    return frames[0].union(frames[1]).union(frames[2])


@query(
    "tag_provenance",
    "SELECT doc_id, md5(text) AS text_md5, 0 AS label, 'enron' AS source, 'legit' AS email_type FROM documents",
)
def _tag(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"), "source")
    return C.tag(docs, 0, "enron", "legit")


@query("by_label", f"WITH {CORPUS} SELECT doc_id, source FROM corpus WHERE label = 1")
def _by_label(spark, sf):
    return C.by_label(corpus(spark, sf), 1).select("doc_id", "source")


@query(
    "min_length",
    f"SELECT doc_id, length({CLEAN % 'text'}) AS chars FROM documents WHERE length({CLEAN % 'text'}) > 50",
)
def _min_length(spark, sf):
    docs = C.min_length(C.clean(load_table(spark, sf, "documents")))
    return docs.select("doc_id", F.char_length("text").cast("bigint").alias("chars"))


@query(
    "attrition",
    f"""WITH c AS (SELECT {CLEAN % 'text'} AS text FROM documents), k AS (SELECT * FROM c WHERE length(text) > 50)
    SELECT (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c WHERE length(text) <= 50) AS removed_short,
    (SELECT count(*) - count(DISTINCT text) FROM k) AS removed_duplicates, (SELECT count(DISTINCT text) FROM k) AS remaining""",
)
def _attrition(spark, sf):
    return C.attrition(load_table(spark, sf, "documents"))


@query(
    "flatten_strings",
    f"""SELECT conv_id, turn, trim(regexp_replace(role, '{S}+', ' ', 'g')) AS role,
    trim(regexp_replace(text, '{S}+', ' ', 'g')) AS text FROM conversations""",
)
def _flatten(spark, sf):
    return C.flatten_strings(load_table(spark, sf, "conversations"))


LINES = """l AS (SELECT CASE doc_id % 4 WHEN 0 THEN text || ',0' WHEN 1 THEN '  ' || text || ',1 ' WHEN 2 THEN '  '
  ELSE text END AS value FROM documents)"""


def _lines(spark, sf) -> DataFrame:
    text = F.col("text")
    kind = F.col("doc_id") % 4
    value = (
        F.when(kind == 0, F.concat(text, F.lit(",0")))
        .when(kind == 1, F.concat(F.lit("  "), text, F.lit(",1 ")))
        .when(kind == 2, "  ")
        .otherwise(text)
    )
    return load_table(spark, sf, "documents").select(value.alias("value"))


_STRIPPED = f"regexp_replace(regexp_replace(value, '^{S}+', ''), '{S}+$', '')"


@query(
    "repair_csv",
    f"""WITH {LINES}, s AS (SELECT {_STRIPPED} AS v FROM l)
    SELECT left(v, length(v) - 2) AS text, CAST(right(v, 1) AS INTEGER) AS label FROM s
    WHERE v <> '' AND (ends_with(v, ',0') OR ends_with(v, ',1'))""",
)
def _repair(spark, sf):
    return corpora.repair_lines(_lines(spark, sf))[0]


@query(
    "repair_csv_rejects",
    f"""WITH {LINES}, s AS (SELECT {_STRIPPED} AS v FROM l)
    SELECT v AS line FROM s WHERE v <> '' AND NOT (ends_with(v, ',0') OR ends_with(v, ',1'))""",
)
def _rejects(spark, sf):
    return corpora.repair_lines(_lines(spark, sf))[1]


@query(
    "read_corpus",
    f"""{ctes("emails")}, c AS (SELECT {CLEAN % "coalesce(subject, '') || ' ' || text"} AS text FROM emails)
    SELECT text, 0 AS label, 'enron' AS source, 'legit' AS email_type FROM c WHERE length(text) > 50""",
)
def _read_corpus(spark, sf):
    path = f"{shared_dir(spark)}/mail-csv-{uuid.uuid4().hex}"
    raw = emails(spark, sf).select("subject", F.col("text").alias("body"), F.lit("0").alias("label"))
    raw.write.csv(path, header=True, quoteAll=True, escape='"')
    return corpora.read_corpus(spark, path, "enron")


@query("read_quoted_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents WHERE text <> ''")
def _read_quoted(spark, sf):
    """Documents with line feeds, through files of quoted fields."""
    path = f"{shared_dir(spark)}/quoted-csv-{uuid.uuid4().hex}"
    docs = load_table(spark, sf, "documents").filter("text <> ''").select("doc_id", "text", "lang")
    docs.write.csv(path, header=True, quoteAll=True, escape='"')
    return corpora.read_csv(spark, path)


def corpus_files(spark, sf) -> dict[str, str]:
    """A file for each of the eight kinds of corpus, in its own columns."""
    docs = load_table(spark, sf, "documents").filter("text IS NOT NULL")
    turns = load_table(spark, sf, "conversations").filter("text IS NOT NULL")
    part = lambda k: docs.filter(F.col("doc_id") % 6 == k)
    mark = F.when(F.col("doc_id") % 18 < 9, "0").otherwise("1").alias("label")
    subject = F.concat(F.lit("No "), (F.col("doc_id") % 50).cast("string")).alias("subject")
    tables = {
        "enron": part(0).select(subject, F.col("text").alias("body"), mark),
        "spamassasin": docs.filter("doc_id % 6 < 2").select("text", mark),
        "nazario": part(2).select(subject, F.col("text").alias("body")),
        "nigerian_fraud": docs.filter("doc_id % 6 IN (2, 3)").select(F.col("text").alias("text_combined"), F.col("lang").alias("note")),
        "phishing_email": part(4).select(F.col("text").alias("text_combined"), mark),
        "human_phishing": part(5).select(subject, F.col("text").alias("body")),
        "llm_legit": turns.filter("turn % 2 = 0").select("text"),
        "llm_phishing": turns.filter("turn % 2 = 1").select("text"),
    }
    paths = {}
    for kind, table in tables.items():
        paths[kind] = f"{shared_dir(spark)}/{kind}-csv-{uuid.uuid4().hex}"
        table.write.csv(paths[kind], header=True, quoteAll=True, escape='"')
    return paths


SMALL_QUOTAS = [("enron", 0, 12), ("spamassasin", 0, 9), ("nazario", 1, 14), ("nigerian_fraud", 1, 10), ("phishing_email", 1, 8), ("human", 1, 15), ("llm", 0, 20), ("llm", 1, 1000)]
_MARK = "CASE WHEN doc_id % 18 < 9 THEN 0 ELSE 1 END"
_WITH_SUBJECT = "'No ' || CAST(doc_id % 50 AS VARCHAR) || ' ' || text"
_ONCE = f"SELECT * FROM (SELECT r, label, source, type, {CLEAN % 'text'} AS text FROM raw WHERE NOT prepared) WHERE length(text) > 50"
CORPUS_BUILD = f"""WITH raw AS (
  SELECT 0 AS r, 0 AS label, 'enron' AS source, 'legit' AS type, false AS prepared, {_WITH_SUBJECT} AS text FROM documents WHERE doc_id % 6 = 0
  UNION ALL SELECT 1, 0, 'spamassasin', 'legit', false, text FROM documents WHERE doc_id % 6 < 2 AND {_MARK} = 0
  UNION ALL SELECT 2, 1, 'nazario', 'phishing', false, {_WITH_SUBJECT} FROM documents WHERE doc_id % 6 = 2
  UNION ALL SELECT 3, 1, 'nigerian_fraud', 'phishing', false, text FROM documents WHERE doc_id % 6 IN (2, 3)
  UNION ALL SELECT 4, 1, 'phishing_email', 'phishing', false, text FROM documents WHERE doc_id % 6 = 4 AND {_MARK} = 1
  UNION ALL SELECT 5, 1, 'human', 'phishing', true, {_WITH_SUBJECT} FROM documents WHERE doc_id % 6 = 5
  UNION ALL SELECT 6, 0, 'llm', 'legit', true, text FROM conversations WHERE turn % 2 = 0
  UNION ALL SELECT 7, 1, 'llm', 'phishing', true, text FROM conversations WHERE turn % 2 = 1),
  once AS ({_ONCE} UNION ALL SELECT r, label, source, type, text FROM raw WHERE prepared AND text IS NOT NULL),
  cleaned AS (SELECT r, label, source, type, {CLEAN % 'text'} AS text FROM once),
  firsts AS (SELECT text, min(r) AS r FROM cleaned WHERE length(text) > 50 GROUP BY text),
  one AS (SELECT DISTINCT c.* FROM cleaned c JOIN firsts f ON c.text = f.text AND c.r = f.r),
  keyed AS (SELECT *, md5('42:' || sha256(r || '|' || source || '|' || label || '|' || text)) AS k FROM one),
  quotas(source, label, quota) AS (VALUES {", ".join(f"('{s}', {y}, {n})" for s, y, n in SMALL_QUOTAS)}),
  taken AS (SELECT * FROM (SELECT k.*, quota, row_number() OVER (PARTITION BY k.source, k.label ORDER BY k.k) AS rn
    FROM keyed k JOIN quotas q ON k.source = q.source AND k.label = q.label) WHERE rn <= quota),
  placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS place, count(*) OVER (PARTITION BY label) AS n FROM taken)
  SELECT text, CAST(label AS INTEGER) AS label, source, type AS email_type,
    CASE WHEN place <= floor(0.8::DOUBLE * n) THEN 'train' WHEN place <= floor(0.9::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split FROM placed"""


@query("corpus_build", CORPUS_BUILD)
def _corpus_build(spark, sf):
    """All kinds read, cleaned, united, freed of copies, sampled by quota and split."""
    quotas = spark.createDataFrame(SMALL_QUOTAS, "source string, label int, quota int")
    return build_corpus(spark, corpus_files(spark, sf), quotas)


@query(
    "read_missing_corpus",
    "SELECT 'documents' AS source, count(*) AS emails, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents",
)
def _read_missing(spark, sf):
    """A union of the given documents with a corpus whose file is not there."""
    there = C.tag(load_table(spark, sf, "documents").select("text"), 0, "documents", "legit")
    missing = corpora.read_corpus(spark, f"{sf}/no-such-corpus.csv", "nazario")
    both = C.union_sources([there, missing])
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("emails"), F.sum(F.char_length("text")).alias("characters"))


@query("cap_rows", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500")
def _cap(spark, sf):
    return C.cap_rows(load_table(spark, sf, "events"), 500, "event_id").select("event_id", "event_type")


VALID = """CASE WHEN length(text) < 60 THEN 'text must have at least 60 character(s)'
  WHEN NOT (starts_with(link, 'http://') OR starts_with(link, 'https://')) THEN 'url must start with http:// or https://' END"""
REQUESTS = """r AS (SELECT doc_id, text, CASE doc_id % 9 WHEN 0 THEN 'ftp://x.example' ELSE 'https://x.example' END AS link FROM documents)"""


def _requests(spark, sf) -> DataFrame:
    link = F.when(F.col("doc_id") % 9 == 0, "ftp://x.example").otherwise("https://x.example")
    return load_table(spark, sf, "documents").select("doc_id", "text", link.alias("link"))


@query(
    "split_valid",
    f"WITH {REQUESTS}, v AS (SELECT *, {VALID} AS reason FROM r) SELECT doc_id, link FROM v WHERE reason IS NULL",
)
def _valid(spark, sf):
    return C.split_valid(_requests(spark, sf), 60, "link")[0].select("doc_id", "link")


@query(
    "split_rejected",
    f"WITH {REQUESTS}, v AS (SELECT *, {VALID} AS reason FROM r) SELECT doc_id, reason FROM v WHERE reason IS NOT NULL",
)
def _rejected(spark, sf):
    return C.split_valid(_requests(spark, sf), 60, "link")[1].select("doc_id", "reason")


@query(
    "sample_per_source",
    """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id)) AS rn
    FROM documents) WHERE rn <= 20""",
)
def _sample(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "source")
    return C.sample_n(docs, 20, 42, "doc_id")


@query(
    "sample_quota",
    f"""WITH {CORPUS}, z AS (SELECT *, CAST(count(*) OVER (PARTITION BY source, label) // 2 AS INTEGER) AS quota FROM corpus)
    SELECT doc_id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5('42:' || doc_id)) AS rn
    FROM z) WHERE rn <= quota""",
)
def _quota(spark, sf):
    rows = corpus(spark, sf).select("doc_id", "source", "label")
    quotas = rows.groupBy("source", "label").agg((F.expr("count(1) div 2")).cast("int").alias("quota"))
    return C.sample_quota(rows, quotas, 42, "doc_id")


UNION = """u AS (SELECT 0 AS source_rank, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
  UNION ALL SELECT 2, conv_id * 1000 + turn, text FROM conversations)"""


def _union(spark, sf) -> DataFrame:
    docs = load_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    items = load_table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    turns = load_table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return C.union_sources([docs, items, turns])


@query(
    "union_sources",
    f"WITH {UNION} SELECT source_rank, count(*) AS emails, CAST(sum(length(text)) AS BIGINT) AS characters FROM u GROUP BY source_rank",
)
def _union_counts(spark, sf):
    return _union(spark, sf).groupBy("source_rank").agg(
        F.count(F.lit(1)).alias("emails"), F.sum(F.char_length("text")).alias("characters")
    )


@query(
    "dedup_exact",
    f"""WITH {UNION} SELECT source_rank, id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, id) AS rn
    FROM u) WHERE rn = 1""",
)
def _dedup(spark, sf):
    return C.dedup_exact(_union(spark, sf), ["source_rank", "id"]).select("source_rank", "id")


SHINGLES = f"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{S}+'), lambda x: x <> '') AS w FROM documents),
  x AS (SELECT doc_id, len(w) AS n, unnest(w) AS w0, unnest(range(len(w))) AS pos FROM t),
  y AS (SELECT doc_id, n, pos, concat_ws(' ', w0, lead(w0, 1) OVER p, lead(w0, 2) OVER p, lead(w0, 3) OVER p, lead(w0, 4) OVER p) AS run
    FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
  s AS (SELECT DISTINCT doc_id, run FROM y WHERE pos = 0 OR pos <= n - 5),
  o AS (SELECT doc_id, run, min(doc_id) OVER (PARTITION BY run) AS owner FROM s),
  ov AS (SELECT doc_id, count(*) AS runs, count(*) FILTER (WHERE owner = doc_id) AS new_runs FROM o GROUP BY doc_id),
  r AS (SELECT doc_id, coalesce(new_runs, 0) AS new_runs, coalesce(1.0::DOUBLE - new_runs::DOUBLE / runs::DOUBLE, 0.0::DOUBLE) AS overlap
    FROM documents LEFT JOIN ov USING (doc_id))"""


@query("shingle_overlap", f"WITH {SHINGLES} SELECT doc_id, new_runs, overlap FROM r")
def _overlap(spark, sf):
    return C.shingle_overlap(load_table(spark, sf, "documents"), "doc_id")


@query(
    "nearest_copy",
    f"""WITH {SHINGLES}, c AS (SELECT doc_id, owner, count(*) AS n FROM o WHERE owner < doc_id GROUP BY doc_id, owner),
    b AS (SELECT doc_id, owner FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, owner) AS k FROM c) WHERE k = 1),
    k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT b.doc_id, b.owner, count(*) AS n FROM b JOIN s x ON x.doc_id = b.doc_id JOIN s y ON y.doc_id = b.owner AND y.run = x.run GROUP BY ALL)
    SELECT i.doc_id, i.owner AS other, i.n / (p.n + q.n - i.n) AS similarity FROM i JOIN k p ON p.doc_id = i.doc_id JOIN k q ON q.doc_id = i.owner""",
)
def _nearest(spark, sf):
    return C.nearest_copy(load_table(spark, sf, "documents"), "doc_id")


@query(
    "dedup_near",
    f"WITH {SHINGLES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE overlap >= 0.8::DOUBLE)",
)
def _near(spark, sf):
    return C.dedup_near(load_table(spark, sf, "documents"), "doc_id").select("doc_id")


SPLIT = f"""{CORPUS}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id)) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM corpus),
  sp AS (SELECT *, CASE WHEN rn <= floor(0.8::DOUBLE * n) THEN 'train' WHEN rn <= floor(0.9::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split FROM n)"""


def _split(spark, sf) -> DataFrame:
    return C.stratified_split(corpus(spark, sf), 42, "doc_id")


@query("stratified_split", f"WITH {SPLIT} SELECT doc_id, label, split FROM sp")
def _split_rows(spark, sf):
    return _split(spark, sf).select("doc_id", "label", "split")


@query("split_balance", f"WITH {SPLIT} SELECT split, label, count(*) AS emails FROM sp GROUP BY split, label")
def _balance(spark, sf):
    return C.split_balance(_split(spark, sf))


@query(
    "write_splits",
    f"WITH {SPLIT} SELECT f AS format, doc_id, label, split, md5(text) AS text_md5 FROM sp, (VALUES ('parquet'), ('csv')) v(f)",
)
def _write_splits(spark, sf):
    """All partitions, in both formats, read back."""
    rows = written(_split(spark, sf).select("doc_id", "label", "text", "split"), "split")
    frames = []
    for fmt in ("parquet", "csv"):
        path = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
        sinks.write_splits(rows, path, fmt)
        reader = spark.read.schema(rows.schema).option("header", True).option("escape", '"').option("multiLine", True)
        back = reader.format(fmt).load(path)
        frames.append(back.select(F.lit(fmt).alias("format"), "doc_id", "label", "split", F.md5("text").alias("text_md5")))
    return frames[0].union(frames[1])


@query(
    "class_weights",
    f"""WITH {CORPUS}, c AS (SELECT label, count(*) AS n FROM corpus GROUP BY label)
    SELECT doc_id, label, (SELECT CAST(sum(n) AS BIGINT) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM corpus JOIN c USING (label)""",
)
def _weights(spark, sf):
    return C.balance_classes(corpus(spark, sf), 42, "doc_id").select("doc_id", "label", "weight")


@query(
    "class_undersample",
    f"""WITH {CORPUS}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id)) AS rn FROM corpus)
    SELECT doc_id, label FROM n WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM corpus GROUP BY label))""",
)
def _undersample(spark, sf):
    return C.balance_classes(corpus(spark, sf), 42, "doc_id", "undersample").select("doc_id", "label")


@query(
    "counts_by_label",
    f"""WITH {CORPUS} SELECT v.label, (SELECT count(*) FROM corpus c WHERE c.label = v.label) AS emails
    FROM (VALUES (0), (1)) v(label)""",
)
def _by_labels(spark, sf):
    return C.counts_by_label(corpus(spark, sf))


@query("counts_by_source", "SELECT source, count(*) AS emails FROM documents GROUP BY source")
def _by_source(spark, sf):
    return C.counts_by_source(load_table(spark, sf, "documents"))


@query(
    "source_x_label",
    f"""WITH {CORPUS} SELECT source, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1
    FROM corpus GROUP BY source""",
)
def _crosstab(spark, sf):
    return C.source_x_label(corpus(spark, sf))


@query(
    "corpus_overview",
    f"""WITH {CORPUS} SELECT source, count(*) AS emails, CAST(sum(length(text)) AS BIGINT) AS characters, avg(label) AS phishing_share
    FROM corpus GROUP BY source""",
)
def _overview(spark, sf):
    return C.corpus_overview(corpus(spark, sf))


KINDS = f"""{CORPUS}, m AS (SELECT label, CASE doc_id % 3 WHEN 0 THEN 'llm' ELSE source END AS source FROM corpus)"""


@query(
    "composition",
    f"""WITH {KINDS} SELECT CASE WHEN label = 0 THEN 'legitimate' WHEN source = 'llm' THEN 'llm_phishing' ELSE 'human_phishing' END AS kind,
    count(*) AS emails FROM m GROUP BY 1""",
)
def _composition(spark, sf):
    origin = F.when(F.col("doc_id") % 3 == 0, "llm").otherwise(F.col("source"))
    return composition(corpus(spark, sf).withColumn("source", origin))
