"""Relational helpers: null-safe exclusion, overlays, diffs, event look-up and dense numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.tables import keep


def dense_index(df: DataFrame, order: list) -> DataFrame:
    """Column `index`: places from 0 in a global order, without one task for all rows: a range sort, counts for each partition, and
    row numbers inside them. The sorted rows are written with their partition's number, since a second evaluation could cut
    the ranges elsewhere. The counts are one row for each partition."""
    part, key = "index_part__", [c if isinstance(c, Column) else F.col(c) for c in order]
    placed = keep(df.repartitionByRange(*key).withColumn(part, F.spark_partition_id()))
    inside = placed.withColumn("index", F.row_number().over(Window.partitionBy(part).orderBy(*key)))
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return inside.join(F.broadcast(before), part).withColumn("index", F.col("index") + F.col("before") - 1).drop(part, "before")


def common_ids(frames: list[DataFrame], key: str) -> DataFrame:
    """Ids that every frame has."""
    tagged = reduce(DataFrame.union, [f.select(key).distinct() for f in frames])
    return tagged.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(frames)).select(key)


def overlay(base: DataFrame, repairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of base with the columns of their replacement where there is one, whatever its values."""
    new = repairs.select(key, F.lit(True).alias("repaired__"), *(F.col(c).alias(f"{c}__new") for c in columns))
    joined = base.join(new, key, "left")
    return joined.select(key, *(F.when(F.col("repaired__"), F.col(f"{c}__new")).otherwise(F.col(c)).alias(c) for c in columns))


def last_writer(frames: list[DataFrame], key: str) -> DataFrame:
    """One row for each key, from the last frame that has it."""
    tagged = reduce(DataFrame.unionByName, [f.withColumn("order__", F.lit(i)) for i, f in enumerate(frames)])
    values = [c for c in tagged.columns if c not in (key, "order__")]
    latest = tagged.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("order__", *values)).alias("v"))
    return latest.select(key, "v.*")


def state_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, op, before, after): create, update and delete between two snapshots; equal values, nulls too, are no change."""
    a = old.select(key, F.col(value).alias("before"), F.lit(True).alias("was__"))
    b = new.select(key, F.col(value).alias("after"), F.lit(True).alias("is__"))
    op = F.when(F.col("was__").isNull(), "create").when(F.col("is__").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return a.join(b, key, "full_outer").select(key, op.alias("op"), "before", "after").filter("op is not null")


def flips(before: DataFrame, after: DataFrame, key: str, passed: str) -> DataFrame:
    """(key, flip): flipped, still_F, regressed, still_T or absent (in one of the two alone)."""
    a, b = before.select(key, F.col(passed).alias("a")), after.select(key, F.col(passed).alias("b"))
    flip = F.when(F.col("a").isNull() | F.col("b").isNull(), "absent").when(~F.col("a") & F.col("b"), "flipped").when(F.col("a") & ~F.col("b"), "regressed").when(F.col("a"), "still_T").otherwise("still_F")
    return a.join(b, key, "full_outer").select(key, flip.alias("flip"))


def neighbours(events: DataFrame, run: str, order: list[str], kind: str, wanted: str, value: str) -> DataFrame:
    """Columns next_value and prev_value: the value of the nearest later and earlier event of the wanted kind in the run."""
    w = Window.partitionBy(run).orderBy(*order)
    only = F.when(F.col(kind) == wanted, F.col(value))
    return events.withColumn("next_value", F.first(only, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("prev_value", F.last(only, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def lineage(spark_sql, view: str, key: str, parent: str, root: str) -> DataFrame:
    """Root-to-node paths of a tree by a recursive query."""
    return spark_sql(f"""WITH RECURSIVE path(id, parent, depth, trail) AS (
      SELECT {key}, {parent}, 0, CAST({key} AS STRING) FROM {view} WHERE {root}
      UNION ALL SELECT c.{key}, c.{parent}, p.depth + 1, concat(p.trail, '>', c.{key}) FROM {view} c JOIN path p ON c.{parent} = p.id)
      SELECT * FROM path""")
