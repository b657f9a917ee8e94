"""Packs and prefixes over ordered groups of any size: a group is cut into blocks that are worked on side by side.

What a block does to the open pack hangs only on how much that pack holds when the block begins: up to the first item
that no longer fits nothing changes, and from there on the packs are those that begin at that item. So each block is
summed up as a short table (one entry for each place where the first new pack can begin), the tables of a group are
folded in order, and every block then knows the pack and the load that it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.tables import keep

#: Rows of a block, which one task holds at once.
BLOCK_ROWS = 1 << 16
GROUP, BLOCK, POS, CAP, SIZE = "group__", "block__", "pos__", "cap__", "size__"


def in_blocks(df: DataFrame, by: str, order: list[str | Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows with group__ (one value for each group, nulls included), block__ and pos__, both ascending in the order of a group.

    Rows are range-partitioned by (group, order), so a large group spreads over tasks, and written once: the numbers of
    rows hold for whatever reads them.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            at = first + row + np.arange(batch.num_rows, dtype=np.int64)
            row += batch.num_rows
            names = [*batch.schema.names, POS, BLOCK]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(at // block_rows)], names=names)

    keyed = df.withColumn(GROUP, F.to_json(F.struct(F.col(by).alias("g"))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = keyed.repartitionByRange(tasks, GROUP, *order).sortWithinPartitions(GROUP, *order)
    schema = T.StructType([*ranged.schema.fields, T.StructField(POS, T.LongType()), T.StructField(BLOCK, T.LongType())])
    return keep(ranged.mapInArrow(number, schema))


def _starts(sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums before each item (and of all), and for a pack that begins at an item the item that the next one begins at (or their number)."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.arange(n)
    full = np.searchsorted(total, total[:-1] + cap, side="right") - 1  # the first item that exceeds
    filled = np.searchsorted(total, total[:-1], side="right")  # a pack without load takes anything
    return total, np.minimum(np.maximum(np.maximum(full, filled), at + 1), n)


def _first(total: np.ndarray, cap: int, held: int) -> int:
    """The first item that opens a pack when the open one holds `held`."""
    k = max(int(np.searchsorted(total, cap - held, side="right")) - 1, 0)
    return min(k if held else max(k, int(np.searchsorted(total, 0, side="right"))), len(total) - 1)


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    """A block as a table over the first item that opens a pack: the load up to it, the packs opened then and the load at the end."""
    rows = rows.sort_values(POS)
    sizes, cap = rows[SIZE].to_numpy(np.int64), int(rows[CAP].iloc[0])
    total, following = _starts(sizes, cap)
    n = len(sizes)
    jump, opened, last = np.append(following, n), np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    while (jump[:-1] < n).any():  # pointer doubling
        opened = opened + opened[jump]
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    zero = _first(total, cap, 0)
    reach = min(zero + 1, n)
    return pd.DataFrame({GROUP: [rows[GROUP].iloc[0]], BLOCK: [rows[BLOCK].iloc[0]], CAP: [cap], "all": [int(total[-1])], "zero": [zero], "upto": [total[1 : reach + 1].tolist()], "opened": [opened[:reach].tolist()], "left": [(total[-1] - total[last[:reach]]).tolist()]})


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pack and load that each block of a group begins with."""
    group, pack, held = None, 0, 0
    for rows in batches:
        begin = []
        for name, cap, total, zero, upto, opened, left in zip(rows[GROUP], rows[CAP], rows["all"], rows["zero"], rows["upto"], rows["opened"], rows["left"], strict=True):
            if name != group:
                group, pack, held = name, 0, 0
            begin.append((pack, held))
            k = int(np.searchsorted(upto, cap - held, side="right")) if held else zero
            pack, held = (pack + int(opened[k]), int(left[k])) if k < len(upto) else (pack, held + total)
        yield pd.DataFrame({"block_of__": rows[BLOCK], "group_of__": rows[GROUP], "pack__": [p for p, _ in begin], "held__": [h for _, h in begin]})


def next_fit(df: DataFrame, by: str, order: list[str], size: str, capacity: int, *, min_packs: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Column `pack`: items of a group in order go to the open pack while they fit, else a new one opens. A larger item has a pack of its
    own; a null size is 0. With min_packs above 1 a group's capacity is at most its total divided by that, rounded down.

    Memory is a block's, whatever the group's size; blocks of one group are worked on by different tasks.
    """
    sized = df.withColumn(SIZE, F.coalesce(F.col(size).cast("long"), F.lit(0)))
    rows = in_blocks(sized, by, order, block_rows)
    capped = rows.withColumn(CAP, F.lit(capacity).cast("long"))
    if min_packs > 1:
        totals = rows.groupBy(F.col(GROUP).alias("of__")).agg(F.sum(SIZE).alias("total__"))
        least = F.when(F.col("total__") > 0, F.least(F.expr(f"total__ div {min_packs}"), F.lit(capacity))).otherwise(F.lit(capacity))
        capped = rows.join(totals, F.col(GROUP) == F.col("of__")).withColumn(CAP, least.cast("long")).drop("of__", "total__")
    table = f"{GROUP} string, {BLOCK} long, {CAP} long, all long, zero long, upto array<long>, opened array<long>, left array<long>"
    summaries = capped.select(GROUP, BLOCK, POS, SIZE, CAP).groupBy(GROUP, BLOCK).applyInPandas(_summary, table)
    begins = summaries.repartition(GROUP).sortWithinPartitions(GROUP, BLOCK).mapInPandas(_fold, "block_of__ long, group_of__ string, pack__ long, held__ long")
    joined = capped.join(keep(begins), (F.col(BLOCK) == F.col("block_of__")) & (F.col(GROUP) == F.col("group_of__"))).drop("block_of__", "group_of__")
    names = df.columns

    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by(POS)
        sizes = block.column(SIZE).to_numpy()
        cap, held, first = (block.column(c)[0].as_py() for c in (CAP, "held__", "pack__"))
        total, following = _starts(sizes, cap)
        opens = np.zeros(len(sizes), dtype=np.int64)
        k = _first(total, cap, held)
        while k < len(sizes):
            opens[k] = 1
            k = following[k]
        return block.select(names).append_column("pack", pa.array(first + np.cumsum(opens)))

    return joined.groupBy(BLOCK, GROUP).applyInArrow(pack, T.StructType([*df.schema.fields, T.StructField("pack", T.LongType())]))


def prefix_within(df: DataFrame, by: str, order: list[str], size: str, budget: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of each group before the running size passes the budget; a group's first row always stays, a null size is 0.

    Sums of blocks tell which blocks reach into the budget; only their rows are added up one by one.
    """
    rows = in_blocks(df.withColumn(SIZE, F.coalesce(F.col(size), F.lit(0))), by, order, block_rows)
    ordered = Window.partitionBy("of__").orderBy("block_of__")
    sums = rows.groupBy(F.col(GROUP).alias("of__"), F.col(BLOCK).alias("block_of__")).agg(F.sum(SIZE).alias("in__"), F.min(POS).alias("first__"))
    starts = sums.select("of__", "block_of__", (F.sum("in__").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("in__")).alias("before__"), F.min("first__").over(Window.partitionBy("of__")).alias("head__"))
    reached = rows.join(starts.filter(f"before__ <= {budget} or head__ is not null"), (F.col(GROUP) == F.col("of__")) & (F.col(BLOCK) == F.col("block_of__")))
    running = F.col("before__") + F.sum(SIZE).over(Window.partitionBy(GROUP, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0))
    return reached.withColumn("total__", running).filter((F.col("total__") <= budget) | (F.col(POS) == F.col("head__"))).select(*df.columns)
