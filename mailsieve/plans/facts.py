"""Evidence kept ready for continuous scoring: reduced once, read by key.

Observations come in numbered batches. Each is reduced to what scoring needs (pages to
their features, so HTML is looked at once), to the newest row per key, and written under
its number in folders by bucket of the key. A number that is written again replaces its
rows, so a retried batch does no harm. A micro-batch reads only the folders of its own URLs
and domains and keeps only their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions.urls import url_domain
from mailsieve.operators.pages import page_rows
from mailsieve.plans.deep_analysis import Evidence
from mailsieve.session import small_side
from mailsieve.sources.corpora import read_or_empty

KEYS = {"registry": ["domain"], "tls": ["domain"], "reputation": ["url"], "pages": ["url"], "hops": ["url", "hop_no"]}


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key, ties by the other columns in order; combines before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "observed_at")]
    order = (["observed_at"] if "observed_at" in rows.columns else []) + rest
    found = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("n"))
    return found.select(*[F.col(c) if c in keys else F.col(f"n.{c}").alias(c) for c in rows.columns])


def keys_of(urls: DataFrame) -> DataFrame:
    """Distinct url and domain of URL rows."""
    return urls.select("url", url_domain(F.col("url")).alias("domain")).distinct()


@dataclass
class FactStore:
    """Folders of evidence below path; buckets is fixed when the first batch is added."""

    path: str
    buckets: int = 256

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def add(self, evidence: Evidence, number: int) -> None:
        """Write the tables of a batch of observations under its number.

        Rows of a key land in one bucket; a key that is observed over and over is combined
        before the shuffle. Rows without a key are left out.
        """
        for name, keys in KEYS.items():
            table = getattr(evidence, name)
            if table is None:
                continue
            if name == "pages" and "visual_risk" not in table.columns:
                table = page_rows(table)
            found = newest(table.dropna(subset=keys[:1]), keys).withColumn("bucket", self.bucket(keys[0]))
            found.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={number}")

    def evidence(self, spark: SparkSession, keys: DataFrame) -> Evidence:
        """The evidence on some keys (url, domain). A table that was never added is missing.

        At most as many bucket numbers as there are buckets come to the driver.
        """
        tables = {}
        for name, (key, *_) in KEYS.items():
            table = read_or_empty(spark, lambda name=name: spark.read.parquet(f"{self.path}/{name}"), "bucket int")
            if len(table.columns) == 1:
                continue
            wanted = keys.select(key).filter(F.col(key).isNotNull()).distinct()
            here = [r[0] for r in wanted.select(self.bucket(key)).distinct().collect()]
            rows = table.filter(F.col("bucket").isin(here)).join(small_side(wanted), key, "left_semi")
            tables[name] = rows.drop("bucket", "batch")
        return Evidence(**tables)
