"""Quoted CSV read in many byte ranges, against the reader that takes a file as one."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from checks.streams import folder
from mailsieve.functions.text import SPACE_CHARS, squeeze
from mailsieve.sources import corpora as C
from mailsieve.sources.corpora import read_csv


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


def file_of(path, name, rows, header="id,text,label", end="\n"):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w", newline="") as f:
        f.write(header + end)
        for i, text, label in rows:
            f.write(f"{i},{quoted(text)},{label}{end}")


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def some_rows(seed, n):
    rng = random.Random(seed)
    words = ["plain", "a,b", 'said "so"', "line\nbreak", "\n\n", "é🎉", '""', "", "x" * 40, "tab\t"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.randint(0, 1)) for i in range(n)]
    # A field longer than many ranges, and one that begins and ends with quotes and breaks.
    return rows[: n // 2] + [(n, "long\n" + "\n".join(f'"{k}", and more' for k in range(300)), 1), (n + 1, '"\n"', 0)] + rows[n // 2 :]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_give_the_same_rows(spark, small_ranges, end):
    path = folder(spark, "csv")
    rows = [some_rows(s, 150) for s in (1, 2)]
    for k, part in enumerate(rows):
        file_of(path, f"part{k}.csv", part, end=end)
    got = read_csv(spark, path)
    assert got.columns == ["id", "text", "label"] and spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 20
    found = sorted(((int(r.id), r.text or "", int(r.label)) for r in got.collect()))
    assert found == sorted((i, t, y) for part in rows for i, t, y in part)
    if end == "\n":
        whole = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_schema_and_header(spark, small_ranges):
    path = folder(spark, "csv")
    file_of(path, "a.csv", [(1, "x", 0), (2, "y", "none")])
    schema = StructType([StructField("label", IntegerType()), StructField("text", StringType())])
    assert sorted(map(tuple, read_csv(spark, path, schema).collect()), key=str) == [(0, "x"), (None, "y")]
    with pytest.raises(ValueError, match="no column subject"):
        read_csv(spark, path, StructType([StructField("subject", StringType())]))
    file_of(path, "b.csv", [(3, "z", 1)], header="id,label,text")
    with pytest.raises(Exception, match="begins with"):
        read_csv(spark, path).collect()


def test_few_rows(spark):
    path = folder(spark, "csv")
    file_of(path, "a.csv", [])
    assert read_csv(spark, path).collect() == []
    path = folder(spark, "csv")
    file_of(path, "a.csv", [(1, "last without line feed", 0)], end="\n")
    with open(f"{path}/a.csv", "a") as f:
        f.write('\n\n2,"open\nend",1')
    assert sorted(r.text for r in read_csv(spark, path).collect()) == ["last without line feed", "open\nend"]


def test_texts_are_parsed_and_cleaned_once(spark, tmp_path):
    """Filters on a cleaned text name neither the record nor the patterns again."""
    (tmp_path / "a.csv").write_text('subject,body,label\na,"<b>first</b>\nmail, which is long enough to be kept in the corpus",0\nb,short,0\n')
    rows = C.read_corpus(spark, str(tmp_path / "a.csv"), "enron")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1 and plan.count("<[^>]+>") == 1
    assert [r.text for r in rows.collect()] == ["a first mail, which is long enough to be kept in the corpus"]


def test_squeezed_white_space(spark):
    """As a plain pattern does it, whatever the white space and wherever it is."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "\u00e9", "\U0001f600", " ", " ", *SPACE_CHARS]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    texts += [f"a{c}b" for c in SPACE_CHARS] + [f"a {c}b" for c in SPACE_CHARS] + [f"{c} a" for c in SPACE_CHARS] + ["a b c", "", " ", "  "]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", squeeze(F.col("t")).alias("t"))
    assert {r.i: r.t for r in out.collect()} == {i: re.sub(f"[{SPACE_CHARS}]+", " ", t).strip(" ") for i, t in enumerate(texts)}
