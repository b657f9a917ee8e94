"""Line dedup with two Bloom filters: hashes seen once and hashes seen twice.

Pass 1 writes each task's distinct line hashes, packed by section. The owner of a section keeps one filter of hashes
seen once and one of those seen again, and gives back the second. Their size follows the number of hashes up to a
bound, so they can be broadcast; beyond it they only let more lines through. Pass 2 shuffles the 128-bit keys of
suspected lines alone, counts their documents exactly and picks the document that keeps the line. Pass 3 drops lines:
where few lines repeat they are broadcast and documents stay where they are, else verdicts and documents are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm.common import SLICE_BYTES, Scratch, doc_columns, fresh, slices, tidy

BLANKS = " \t\n\x0b\x0c\r"
SECTIONS = 256
PROBES = 4
SALTS = 16
#: Bits of the filters: at least, for each hash, and at most, so that 32 MB are broadcast whatever the input.
FILTER_LEAST, BITS_EACH, FILTER_MOST = 1 << 18, 16, 1 << 28
#: Repeated lines (24 bytes each) that are broadcast; with more of them documents are joined.
BROADCAST_LINES = 1 << 19
_digest = xxhash.xxh3_128_digest


def _keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line the digest of its key, or None for lines too short to count. Lower-casing bytes changes A-Z alone."""
    return [_digest(k.encode().lower()) if len(k := x.strip(BLANKS)) >= min_chars else None for x in (text or "").split("\n")]


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash inside its section: an array (PROBES, n)."""
    low, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(24)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * step + np.uint64(i * i)) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def _sections(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(56)).astype(np.int64) % SECTIONS


def _seen_twice(docs: DataFrame, min_chars: int, filter_bits: int | None, tmp: Scratch) -> np.ndarray:
    """All sections' filters of hashes seen twice, as bytes."""

    @tidy

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            hashes = np.frombuffer(b"".join(held), dtype="<u8")
            order = np.argsort(_sections(hashes), kind="stable")
            hashes = hashes[order]
            cuts = np.searchsorted(_sections(hashes), np.arange(SECTIONS + 1))
            full = [s for s in range(SECTIONS) if cuts[s] < cuts[s + 1]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([hashes[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary())], names=["section", "hashes"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.extend({k[:8] for k in _keys(text, min_chars) if k})
                if len(held) > 500_000:
                    yield flush()
        if held:
            yield flush()

    sent = tmp.write(docs.select("text").mapInArrow(send, "section int, hashes binary"), "hashes")
    if filter_bits is None:
        held = (sent.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 8
        filter_bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (BITS_EACH * held).bit_length()))
    bits = filter_bits // SECTIONS

    def build(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)
        for batch in tables:
            for packed in batch.column("hashes").to_pylist():
                hashes, counts = np.unique(np.frombuffer(packed, dtype="<u8"), return_counts=True)
                at = _positions(hashes, bits)
                again = (counts > 1) | once[at].all(axis=0)
                twice[at[:, again]] = True
                once[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["section", "bits"])

    full = np.zeros(filter_bits // 8, dtype=np.uint8)
    for row in sent.groupBy("section").applyInArrow(build, "section int, bits binary").collect():  # SECTIONS rows of bounded size
        full[row.section * bits // 8 : (row.section + 1) * bits // 8] = np.frombuffer(row.bits, np.uint8)
    return full


def _suspects(keys: list[bytes | None], twice: np.ndarray, bits: int) -> list[bytes]:
    """The distinct keys that the filter of twice-seen hashes holds."""
    found = sorted({k for k in keys if k})
    if not found:
        return []
    hashes = np.frombuffer(b"".join(k[:8] for k in found), dtype="<u8")
    at = _positions(hashes, bits) + _sections(hashes) * bits
    hit = ((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
    return [k for k, y in zip(found, hit, strict=True) if y]


def _gone(texts: list[str | None], ids: list[int | None], verdicts: np.ndarray, min_chars: int) -> Iterator[np.ndarray]:
    """For each text, which of its lines go: those with a verdict whose keeper is a larger document. verdicts: sorted rows
    (first and second half of the key, keeper), whose first halves are distinct."""
    keys = [_keys(t, min_chars) for t in texts]
    size = [len(x) for x in keys]
    halves = np.frombuffer(b"".join(k or bytes(16) for x in keys for k in x), dtype="<u8").reshape(-1, 2)
    long = np.array([k is not None for x in keys for k in x], dtype=bool)
    doc = np.repeat(np.array([0 if i is None else i for i in ids], dtype=np.int64), size)
    known = np.repeat(np.array([i is not None for i in ids], dtype=bool), size) & long
    if len(verdicts):
        at = np.searchsorted(verdicts["high"], halves[:, 0]).clip(max=len(verdicts) - 1)
        known &= (verdicts["high"][at] == halves[:, 0]) & (verdicts["low"][at] == halves[:, 1]) & (verdicts["keeper"][at] > doc)
    else:
        known[:] = False
    return iter(np.split(known, np.cumsum(size)[:-1]))


def _few(verdict: DataFrame) -> np.ndarray | None:
    """The verdicts as sorted rows, if a count shows that they are few."""
    if verdict.count() > BROADCAST_LINES:
        return None
    rows = verdict.select("line", "keeper").toArrow()  # at most BROADCAST_LINES rows
    out = np.zeros(rows.num_rows, dtype=[("high", "<u8"), ("low", "<u8"), ("keeper", "<i8")])
    halves = np.frombuffer(b"".join(rows.column("line").to_pylist()), dtype="<u8").reshape(-1, 2)
    out["high"], out["low"], out["keeper"] = halves[:, 0], halves[:, 1], np.asarray(rows.column("keeper"))
    out.sort(order="high")
    return out if (out["high"][1:] != out["high"][:-1]).all() else None


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, filter_bits: int | None = None) -> DataFrame:
    """Every input row with its lines deduplicated, and the columns n_lines, n_dropped, kept_text after the input's own.

    A line's key is the line without ASCII blanks at its ends, A-Z lower-cased. Keys of min_chars code points or more
    found in min_docs documents or more lose all their lines except in the largest document id that holds them; that
    document keeps all its occurrences. Null or empty text: one empty line, kept_text "". Rows that repeat a document id
    count as one document. A row with a null id is no document: it keeps its lines and takes no part in the counts.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "line-dedup")
    own = doc_columns(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    twice = _seen_twice(own, min_chars, filter_bits, tmp)
    bits, shared = 8 * len(twice) // SECTIONS, spark.sparkContext.broadcast(twice.tobytes())

    @tidy

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = _suspects(_keys(text, min_chars), seen, bits)
                ids += [doc] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "line"])

    pairs = tmp.write(own.mapInArrow(suspects, "doc_id long, line binary"), "suspects")
    # exact: partial counts before the shuffle, so a line of a third of all documents is one row per task
    distinct = pairs.groupBy("line", "doc_id").agg(F.lit(1).alias("one"))
    verdict = tmp.write(distinct.groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs), "verdicts")
    extra, names = [fresh(c, docs.columns) for c in ("n_lines", "n_dropped", "kept_text")], docs.columns
    few = _few(verdict)
    if few is not None:
        told, rows, flag = spark.sparkContext.broadcast(few), docs, None
    else:
        # a hot line's rows are spread over the salts, each with a copy of its verdict
        salted = verdict.select("line", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        losing = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"]).filter(F.col("doc_id") < F.col("keeper"))
        dropped = losing.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))  # at most the lines of one document
        flag, key = fresh("lines__", names), fresh("key__", names)
        rows = docs.join(dropped.select(F.col("doc_id").alias(key), F.col("lines").alias(flag)), F.col(id_col).cast("long") == F.col(key), "left").drop(key)

    @tidy

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(text_col), 4 * SLICE_BYTES):
                part = batch.slice(a, b - a)
                texts = part.column(text_col).to_pylist()
                if flag is None:
                    gone = _gone(texts, [None if i is None else int(i) for i in part.column(id_col).to_pylist()], told.value, min_chars)
                else:
                    gone = (np.array([k in lines for k in _keys(t, min_chars)]) if lines else np.zeros(0, dtype=bool) for t, lines in zip(texts, map(set, (x or () for x in part.column(flag).to_pylist())), strict=True))
                n, lost, kept = [], [], []
                for text, mask in zip(texts, gone, strict=True):
                    lines = (text or "").split("\n")
                    n.append(len(lines))
                    lost.append(int(mask.sum()))
                    kept.append("\n".join(x for x, y in zip(lines, mask, strict=True) if not y) if lost[-1] else text or "")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=[*names, *extra])

    schema = StructType([*docs.schema.fields]).add(extra[0], "long").add(extra[1], "long").add(extra[2], "string")
    return rows.mapInArrow(keep, schema)
