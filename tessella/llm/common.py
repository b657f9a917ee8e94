"""Helpers shared by the training-data operators: scratch tables, batch slicing and vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.tables import remove_folder, shared_folder

#: Bytes of text that one numpy step works on; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 19
#: Bits of a filter of ids that is broadcast.
FILTER_BITS = 23


#: Rows and bytes of one Arrow batch while a table is written, which the JVM and the Python worker hold at the same time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches; after a task the memory that it freed goes back to the system, as workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


class Scratch:
    """Tables written to the shared folder, so that later jobs read them instead of a long lineage.

    A written table survives the loss of executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, shared_folder(spark, name)

    def write(self, df: DataFrame, table: str, level: int = 3) -> DataFrame:
        path, schema = f"{self.base}/{table}", df.schema
        # the table replaces the shuffle files that made it
        wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
        before = {key: self.spark.conf.get(key) for key in wanted}
        try:
            for key, value in wanted.items():
                self.spark.conf.set(key, value)
            df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, table: str) -> None:
        """Removes a table that no later step reads."""
        remove_folder(self.spark, f"{self.base}/{table}")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no input column has, whatever the case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that further columns can't clash with those made here. Null text reads as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def bucket_count(spark: SparkSession, least: int = 1024) -> int:
    """Buckets of packed hashes: a power of two, some for each shuffle partition, so a bucket's share of the data stays one task's work."""
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, 1 << (wanted - 1).bit_length())


def maybe(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is in the first column of ids, and by chance a few others: a one-hash bit set as a small broadcast
    table of at most 2**FILTER_BITS / 64 rows. Beyond its capacity it only lets more rows through to the exact join."""
    word, bits = fresh("word__", docs.columns), fresh("bits__", docs.columns)
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    own, other = at(F.col(id_col).cast("long")), at(F.col(ids.columns[0]).cast("long"))
    table = ids.groupBy(F.floor(other / 64).alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (other % 64).cast("int"))).alias(bits))
    return docs.join(F.broadcast(table), F.floor(own / 64) == F.col(word)).filter(F.getbit(bits, (own % 64).cast("int")) == 1).drop(word, bits)


def grouped_ranges(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key and the n + 1 cuts between the keys 0 to n - 1 in it."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(n + 1))


def once(value: Column) -> Column:
    """The value as the only row of a generator: filters above aren't pushed below it, which would compute it again, and
    once for each element where a lambda refers to it."""
    return F.explode(F.array(value))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about `limit` bytes each; a longer text is a range of its own."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


_R, _Q1, _Q2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers that a worker keeps; those of longer inputs are made anew.
KEPT_POWERS = 1 << 21


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base), np.full(size, inverse)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)
        if size <= KEPT_POWERS:
            _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE_BYTES that end behind a blank; the data's last byte is one."""
    start = 0
    while start < len(data):
        end = min(start + SLICE_BYTES, len(data))
        while end < len(data) and not _BLANK[data[end - 1]]:
            more = np.flatnonzero(_BLANK[data[end : end + SLICE_BYTES]])
            end = end + int(more[0]) + 1 if len(more) else min(end + SLICE_BYTES, len(data))
        yield start, end
        start = end


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts: (hash, document index, start and end in the texts joined by one space).

    A long text is worked on in pieces between words, so that the memory beyond the result is that of a piece.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    found = []
    for a, b in _pieces(data):
        part = data[a:b]
        gap = _BLANK[part]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        up, down = _powers(_R, len(part))
        total = np.empty(len(part) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        found.append((mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _Q2), starts + a, ends + a))
    hashes, starts, ends = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    doc = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
    return hashes, doc, starts, ends


def window_hashes(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of each run of k words, by the index of its first; runs may cross documents, which the caller drops."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base, source = (_Q2, mix(words ^ _Q1)) if second else (_Q1, words)
    up, down = _powers(base, len(words))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(source * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n] + np.uint64(k))
