"""Reading of labelled mail corpora into text, label, source, email_type."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from mailsieve.functions.text import concat_text, strip
from mailsieve.operators.curation import by_label, clean_long, resolve_text, tag

CORPUS_SCHEMA = "text string, label int, source string, email_type string"

# Label, source and type per corpus; keep: label filter; prepared: already clean.
CORPORA = {
    "enron": {"label": 0, "source": "enron", "type": "legit"},
    "spamassasin": {"label": 0, "source": "spamassasin", "type": "legit", "keep": 0},
    "nazario": {"label": 1, "source": "nazario", "type": "phishing"},
    "nigerian_fraud": {"label": 1, "source": "nigerian_fraud", "type": "phishing"},
    "phishing_email": {"label": 1, "source": "phishing_email", "type": "phishing", "keep": 1},
    "human_phishing": {"label": 1, "source": "human", "type": "phishing", "prepared": True},
    "llm_legit": {"label": 0, "source": "llm", "type": "legit", "prepared": True},
    "llm_phishing": {"label": 1, "source": "llm", "type": "phishing", "prepared": True},
}


SUBJECT_AND_BODY = ("enron", "human_phishing")
TEXT_COLUMNS = ("subject", "body", "text", "text_combined")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV, from its first line."""
    return spark.read.csv(path, header=True, quote='"', escape='"').columns


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with header, whose quoted fields may span lines, read in many tasks.

    A line ends a record if the quotes up to it are even. One pass counts the quotes of each
    byte range; their running parity says in which state each range begins, so the second
    pass parses all ranges at once. Records that lie across ranges come in pieces, at most
    two a range, and are put together by file. Quotes inside fields are doubled; a quote
    within an unquoted field is not allowed. Blank lines are skipped, a carriage return at
    a record's end goes.

    Each file's first record must be the header of the first file, else the job fails.
    Without a schema all columns are strings; a schema's fields must be in the header, and
    only they are given, in its types (what does not parse is NULL).
    """
    names = header_of(spark, path)
    missing = [f.name for f in schema or [] if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(names)}")
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    states, kinds = _states(lines), "file string, block long, kind int, record string"
    whole = lines.mapInArrow(_records(states, names, [WHOLE]), kinds)
    # In order of place: the end of a record begun before, a range inside one record, a record's beginning.
    parts = lines.mapInArrow(_records(states, names, [HEAD, INSIDE, TAIL]), kinds)
    order = Window.partitionBy("file").orderBy("block", "kind")
    numbered = parts.withColumn("no", F.sum((F.col("kind") == TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.sort_array(F.collect_list(F.struct("block", "kind", "record")))
    joined = numbered.groupBy("file", "no").agg(F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record"))
    records = whole.select("record").unionAll(joined.select("record"))
    plain = F.when(F.contains("record", F.lit("\r")), F.regexp_replace("record", "\r$", "")).otherwise(F.col("record"))
    fields = StructType([StructField(n, StringType()) for n in names])
    rows = records.select(plain.alias("record")).filter(F.col("record") != "")
    # Given out as rows, so that what is asked of the fields later does not read the record again.
    out = rows.select(F.inline(F.array(F.from_csv("record", fields.toDDL(), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}))))
    return out if schema is None else out.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema])


HEAD, INSIDE, TAIL, WHOLE = 0, 1, 2, 3


def _states(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """Which byte ranges begin inside quotes; a file, a number and a flag per range."""
    odd = F.sum(F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "block").agg(odd.alias("odd"))
    table = counts.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")).toArrow()
    return {(f, b): x for f, b, x in zip(*[table.column(c).to_pylist() for c in ("file", "block", "inside")])}


def _records(states: dict[tuple[str, int], bool], names: list[str], kinds: list[int]):
    """Records of each range of lines, as far as they lie in it, that are of the kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, inside, before, first = None, [], False, False, False

        def rest():
            if held:
                lines = [x for part in held for x in part.to_pylist()]
                yield from _fragments(place, [INSIDE if before else TAIL], pa.array(["\n".join(lines)]))

        def _fragments(at, kind, records):
            kind = np.asarray(kind, np.int32)
            wanted = np.isin(kind, kinds)
            if wanted.any():
                n = int(wanted.sum())
                columns = [pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array(kind[wanted]), records.filter(pa.array(wanted))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "kind", "record"])

        for batch in batches:
            values, files, blocks = (batch.column(c) for c in ("value", "file", "block"))
            if not len(values):
                continue
            file, block = files.dictionary_encode(), blocks.to_numpy()
            cuts = np.flatnonzero((np.diff(file.indices.to_numpy()) != 0) | (np.diff(block) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(values)]):
                if (files[int(i)].as_py(), int(block[i])) != place:
                    yield from rest()
                    place, held = (files[int(i)].as_py(), int(block[i])), []
                    inside, first = states[place], place[1] == 0
                    before = inside
                part = values.slice(i, j - i)
                # Lines after which no quote is open end a record.
                odd = pc.count_substring(part, '"').to_numpy().astype(np.int64)
                after = (np.cumsum(odd) + inside) % 2
                inside, ends = bool(after[-1]), np.flatnonzero(after == 0)
                held.append(part)
                if not len(ends):
                    continue
                ends = ends + 1 + sum(map(len, held[:-1]))
                lines = pa.concat_arrays(held)
                held = [lines.slice(ends[-1])] if ends[-1] < len(lines) else []
                records = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), lines), "\n")
                kind = np.full(len(ends), WHOLE)
                kind[0] = HEAD if before else WHOLE
                if first:
                    record = records[0].as_py()
                    if next(csv.reader([record.rstrip("\r")]), []) != names:
                        raise ValueError(f"{place[0]} begins with {record[:200]!r}, not with the header {','.join(names)}")
                    kind, records = kind[1:], records.slice(1)
                before, first = False, False
                yield from _fragments(place, kind, records)
        if place:
            yield from rest()

    return run


def read_or_empty(spark: SparkSession, read, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """What read() gives, or an empty frame of the schema when the path is missing."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_corpus(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One corpus in the common schema; empty if the file is missing.

    Only the columns the corpus needs are read. Prepared corpora are taken as they are,
    the others are cleaned and short texts dropped.
    """
    rule = CORPORA[kind]

    def load() -> DataFrame:
        names = header_of(spark, path)
        needed = ["subject", "body"] if kind in SUBJECT_AND_BODY else []
        needed += ["label"] if "keep" in rule else []
        found = [n for n in TEXT_COLUMNS if n in names or n in needed]
        fields = [StructField(n, StringType()) for n in found]
        fields += [StructField("label", IntegerType())] if "keep" in rule else []
        df = read_csv(spark, path, StructType(fields) if fields else None)
        if "keep" in rule:
            df = by_label(df, rule["keep"])
        if kind in SUBJECT_AND_BODY:
            df = df.withColumn("text", concat_text(F.col("subject"), F.col("body")))
        else:
            df = resolve_text(df)
        df = tag(df, rule["label"], rule["source"], rule["type"])
        df = df.select("text", "label", "source", "email_type")
        return df if rule.get("prepared") else clean_long(df)

    return read_or_empty(spark, load)


def repair_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (text, label) and rejected lines of a CSV with unquoted text.

    The label is what follows the last comma if it is 0 or 1; blank lines are skipped.
    lines has one column ``value`` without the header.
    """
    value = strip(F.col("value"))
    full = lines.select(value.alias("value")).filter(F.col("value") != "")
    good = F.rlike("value", F.lit(r"(?s),[01]\z"))
    rows = full.filter(good).select(
        F.regexp_extract("value", r"(?s)^(.*),[01]\z", 1).alias("text"),
        F.substring("value", -1, 1).cast("int").alias("label"),
    )
    rejects = full.filter(~good).select(F.col("value").alias("line"))
    return rows, rejects


def repair_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """repair_lines for files whose first line is the header 'text,label'.

    The first line is the one at the start of the file's first block; the same words further
    down are a rejected line.
    """
    numbered = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias("file"))
    first = numbered.filter("block = 0").groupBy("file").agg(F.min("n").alias("n"))
    header = numbered.join(first, ["file", "n"], "left_semi").filter(F.lower(strip(F.col("value"))) == "text,label")
    lines = numbered.join(F.broadcast(header.select("file", "n")), ["file", "n"], "left_anti")
    return repair_lines(lines.select("value"))
