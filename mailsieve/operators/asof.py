"""As-of joins: what was known about a key at the time of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_before(
    rows: DataFrame, facts: DataFrame, key: str, at: str, observed: str = "observed_at",
    slice_seconds: int = 7 * 86400, out: str = "fact",
) -> DataFrame:
    """Every row with the newest fact of its key not after its time, as a struct column.

    The struct holds the facts' columns but the key, the time first; of facts at one time
    the largest by the other columns, in order, counts. It is NULL where there is none,
    and for rows without key or time. Repeated rows all stay.

    Time is cut into slices and rows and facts meet per (key, slice), so a busy key is many
    groups. What was newest before a slice comes from one row per (key, slice).
    """
    rest = [c for c in facts.columns if c not in (key, observed)]
    packed = F.struct(F.col(observed), *[F.col(c) for c in rest])

    def cut(time: Column) -> Column:
        return F.floor(F.unix_seconds(time) / slice_seconds)

    known = facts.filter(F.col(key).isNotNull() & F.col(observed).isNotNull())
    known = known.select(F.col(key).alias("_key"), cut(F.col(observed)).alias("_slice"), F.col(observed).alias("_at"), packed.alias("_fact"))
    known = known.groupBy("_key", "_slice", "_at").agg(F.max("_fact").alias("_fact"))

    kept = F.struct(*[F.col(c) for c in rows.columns]).alias("_row")
    placed = rows.select(F.col(key).alias("_key"), cut(F.col(at)).alias("_slice"), F.col(at).alias("_at"), kept)
    usable = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    own = placed.filter(usable)
    both = known.withColumn("_side", F.lit(0)).unionByName(own.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("_key", "_slice").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_fact", F.last("_fact", ignorenulls=True).over(so_far)).filter("_side = 1")

    slices = known.groupBy("_key", "_slice").agg(F.max("_fact").alias("_fact"))
    slices = slices.unionByName(own.select("_key", "_slice").distinct(), allowMissingColumns=True)
    slices = slices.groupBy("_key", "_slice").agg(F.max("_fact").alias("_fact"))
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select("_key", "_slice", F.last("_fact", ignorenulls=True).over(earlier).alias("_before")).filter("_before IS NOT NULL")

    found = inside.join(before, ["_key", "_slice"], "left").select("_row", F.coalesce("_fact", "_before").alias(out))
    return found.unionByName(placed.filter(~usable).select("_row"), allowMissingColumns=True).select("_row.*", out)
