"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of `block` words; a repeated run of `window` words always holds a
whole block of its own document (2 * block - 1 <= window). Round 1 indexes the blocks and probes them with every
rolling window of block length: packed 40-bit hashes meet in buckets, and blocks that start anywhere else become
anchors. Round 2 extends the anchors: the full windows around them, as 64-bit hashes, meet again, and those that start
anywhere else are repeats; neighbouring ones make up maximal repeats. Within a task equal hashes are sent once, so
a passage of thousands of documents is one entry for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, bucket_count, doc_columns, grouped_ranges, slices, tidy, window_hashes, word_table

CHUNK_WORDS = 1 << 20


def _encode(column: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _starts(doc: np.ndarray) -> np.ndarray:
    """Index of the first word of each word's document."""
    first = np.ones(len(doc), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))


def _unique_in(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and for each input value whether it is there more than once."""
    found, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return found, counts[inverse] > 1


def _contains(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    return sorted_values[np.searchsorted(sorted_values, values).clip(max=len(sorted_values) - 1)] == values


def _repeated(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted values that are in two lists or more; each list holds a value once."""
    every = np.sort(np.concatenate(lists))
    return np.unique(every[1:][every[1:] == every[:-1]])


def _rows(kinds: dict[str, pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


ANCHOR = {"k": pa.int64(), "block": pa.int32()}
RUN = {"k": pa.int64(), "start": pa.int32(), "length": pa.int32()}


def _anchors(docs: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """(k, block): blocks of long enough documents whose words also start anywhere else."""
    bits = np.uint64(64 - (buckets - 1).bit_length())
    packet = {"bucket": pa.int32(), "probes": pa.binary(), "blocks": pa.binary(), "keys": pa.binary(), "numbers": pa.binary()}

    class Chunk:
        def __init__(self):
            self.hashes, self.block_hashes, self.keys, self.numbers, self.words = [], [], [], [], 0

        def add(self, ids: np.ndarray, texts: list[bytes]) -> None:
            words, doc, _, _ = word_table(texts)
            if len(words) < window:
                return
            first = _starts(doc)
            size = np.bincount(doc, minlength=len(texts))[doc]
            rolling = window_hashes(words, block)
            inside = (doc[: len(rolling)] == doc[block - 1 :]) & (size[: len(rolling)] >= window)
            at = np.arange(len(rolling)) - first[: len(rolling)]
            whole = inside & (at % block == 0)
            self.hashes.append(rolling[inside])
            self.block_hashes.append(rolling[whole])
            self.keys.append(ids[doc[: len(rolling)][whole]])
            self.numbers.append((at[whole] // block).astype(np.int32))
            self.words += len(words)

        def packets(self) -> Iterator[pa.RecordBatch]:
            if not self.hashes:
                return
            hashes, blocks, keys, numbers = (np.concatenate(x) for x in (self.hashes, self.block_hashes, self.keys, self.numbers))
            found, twice = _unique_in(hashes)
            again = _contains(np.unique(hashes[twice]), blocks)
            # anchors that the chunk itself shows need no probe elsewhere
            here = np.flatnonzero(again)
            order, cuts = grouped_ranges((keys[here].view(np.uint64) % np.uint64(buckets)).astype(np.int64), buckets)
            here = here[order]
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                part = here[cuts[b] : cuts[b + 1]]
                yield _rows(packet, [[int(b)], [None], [None], [keys[part].tobytes()], [numbers[part].tobytes()]])
            blocks, keys, numbers = blocks[~again], keys[~again], numbers[~again]
            cuts = np.searchsorted((found >> bits).astype(np.int64), np.arange(buckets + 1))
            order, own = grouped_ranges((blocks >> bits).astype(np.int64), buckets)
            rest = bits - np.uint64(32)
            low, block_low = ((x >> rest).astype(np.uint32) for x in (found, blocks[order]))
            keys, numbers = keys[order], numbers[order]
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            for part in np.array_split(full, max(1, len(full) // 256)):
                yield _rows(packet, [part.astype(np.int32), [low[cuts[b] : cuts[b + 1]].tobytes() for b in part], *([x[own[b] : own[b + 1]].tobytes() for b in part] for x in (block_low, keys, numbers))])

    @tidy

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for batch in batches:
            ids, texts = np.asarray(batch.column("k")), batch.column("text")
            for a, b in slices(texts):
                chunk.add(ids[a:b], _encode(texts[a:b]))
                if chunk.words >= CHUNK_WORDS:
                    yield from chunk.packets()
                    chunk = Chunk()
        yield from chunk.packets()

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, blocks, keys, numbers = [], [], [], []
        for batch in batches:
            for p, b, k, n in zip(*(batch.column(c).to_pylist() for c in ("probes", "blocks", "keys", "numbers")), strict=True):
                if p is None:
                    yield _rows(ANCHOR, [np.frombuffer(k, np.int64), np.frombuffer(n, np.int32)])
                    continue
                probes.append(np.unique(np.frombuffer(p, np.uint32)))
                blocks.append(np.frombuffer(b, np.uint32))
                keys.append(np.frombuffer(k, np.int64))
                numbers.append(np.frombuffer(n, np.int32))
        if probes:
            hit = _contains(_repeated(probes), np.concatenate(blocks))
            yield _rows(ANCHOR, [np.concatenate(keys)[hit], np.concatenate(numbers)[hit]])

    sent = docs.mapInArrow(send, "bucket int, probes binary, blocks binary, keys binary, numbers binary")
    return sent.groupBy("bucket").applyInArrow(meet, "k long, block int")


def _repeats(docs: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """(k, start, length): runs of windows, by their first words, that also start anywhere else. docs: k, text, blocks."""
    packet = {"bucket": pa.int32(), "others": pa.binary(), "hashes": pa.binary(), "keys": pa.binary(), "starts": pa.binary(), "lengths": pa.binary()}

    def runs(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run-length form of windows in order of (key, start) or of pieces of that order."""
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        return keys[at], starts[at].astype(np.int32), np.diff(np.append(at, len(keys))).astype(np.int32)

    class Chunk:
        def __init__(self):
            self.parts, self.words = [], 0

        def add(self, ids: np.ndarray, texts: list[bytes], anchors: list[list[int]]) -> None:
            words, doc, _, _ = word_table(texts)
            n = len(words) - window + 1
            if n <= 0:
                return
            first = _starts(doc)
            begin = np.searchsorted(doc, np.arange(len(texts)))
            mark = np.zeros(len(words) + 1, dtype=np.int32)
            for d, found in enumerate(anchors):
                at = begin[d] + np.asarray(found, dtype=np.int64) * block
                np.add.at(mark, np.maximum(at - (window - block), begin[d]), 1)
                np.add.at(mark, at + 1, -1)
            near = (np.cumsum(mark)[:n] > 0) & (doc[:n] == doc[window - 1 :])
            small = window_hashes(words, block)
            least, width = small, 1  # minimum over the block-long windows inside each full window
            span = window - block + 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            self.parts.append((window_hashes(words, window)[near], least[:n][near], ids[doc[:n][near]], (np.arange(n) - first[:n])[near].astype(np.int32)))
            self.words += int(near.sum())

        def packets(self) -> Iterator[pa.RecordBatch]:
            if not self.parts:
                return
            hashes, least, keys, starts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            _, twice = _unique_in(hashes)
            k, s, n = runs(keys[twice], starts[twice])
            order, cuts = grouped_ranges((k.view(np.uint64) % np.uint64(buckets)).astype(np.int64), buckets)
            k, s, n = k[order], s[order], n[order]
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            if len(full):
                yield _rows(packet, [full.astype(np.int32), [None] * len(full), [None] * len(full), *([x[cuts[b] : cuts[b + 1]].tobytes() for b in full] for x in (k, s, n))])
            bucket = (least % np.uint64(buckets)).astype(np.int64)  # shared by the neighbours of a window, so that runs stay together
            known, at = np.unique(hashes[twice], return_index=True)
            known_bucket = bucket[twice][at]
            order, known_cuts = grouped_ranges(known_bucket, buckets)
            known = known[order]
            hashes, keys, starts, bucket = hashes[~twice], keys[~twice], starts[~twice], bucket[~twice]
            order, cuts = grouped_ranges(bucket, buckets)
            hashes, keys, starts = hashes[order], keys[order], starts[order]
            full = np.flatnonzero((cuts[1:] > cuts[:-1]) | (known_cuts[1:] > known_cuts[:-1]))
            for part in np.array_split(full, max(1, len(full) // 256)):
                packed = [runs(keys[cuts[b] : cuts[b + 1]], starts[cuts[b] : cuts[b + 1]]) for b in part]
                yield _rows(packet, [part.astype(np.int32), [known[known_cuts[b] : known_cuts[b + 1]].tobytes() for b in part], [hashes[cuts[b] : cuts[b + 1]].tobytes() for b in part], *([p[i].tobytes() for p in packed] for i in range(3))])

    @tidy

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for batch in batches:
            ids, texts = np.asarray(batch.column("k")), batch.column("text")
            for a, b in slices(texts):
                chunk.add(ids[a:b], _encode(texts[a:b]), batch.column("blocks")[a:b].to_pylist())
                if chunk.words >= CHUNK_WORDS:
                    yield from chunk.packets()
                    chunk = Chunk()
        yield from chunk.packets()

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, hashes, keys, starts = [], [], [], []
        for batch in batches:
            for o, h, *run in zip(*(batch.column(c).to_pylist() for c in list(packet)[1:]), strict=True):
                k, s, n = np.frombuffer(run[0], np.int64), np.frombuffer(run[1], np.int32), np.frombuffer(run[2], np.int32)
                if h is None:
                    yield _rows(RUN, [k, s, n])
                    continue
                own = np.frombuffer(h, np.uint64)
                lists.append(np.concatenate([np.frombuffer(o, np.uint64), own]))
                hashes.append(own)
                keys.append(np.repeat(k, n))
                starts.append(np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(own)) if len(own) else s[:0])
        if lists:
            hit = _contains(_repeated(lists), np.concatenate(hashes))
            yield _rows(RUN, list(runs(np.concatenate(keys)[hit], np.concatenate(starts)[hit].astype(np.int64))))

    sent = docs.mapInArrow(send, "bucket int, others binary, hashes binary, keys binary, starts binary, lengths binary")
    return sent.groupBy("bucket").applyInArrow(meet, "k long, start int, length int")


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row.

    Words are `[^\\x20\\x09-\\x0D]+`. A window is `window` consecutive words of one document; each word that is covered by a window
    whose words also start anywhere else, the same document included, is removed, and kept words are joined by one space.
    Null and empty texts have no words; texts shorter than a window keep theirs. Rows that repeat an id are documents of their
    own: equal rows are copies of each other.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    tmp, buckets = Scratch(spark, "substrings"), bucket_count(spark)
    own = doc_columns(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    anchors = tmp.write(_anchors(own.select("k", "text"), block, window, buckets), "anchors")
    probed = own.select("k", "text").join(anchors.groupBy("k").agg(F.collect_set("block").alias("blocks")), "k")
    repeats = tmp.write(_repeats(probed, block, window, buckets), "repeats")
    runs = repeats.groupBy("k").agg(F.collect_list(F.struct("start", "length")).alias("runs"))

    @tidy

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids, texts, found = batch.column("doc_id")[a:b], _encode(batch.column("text")[a:b]), batch.column("runs")[a:b].to_pylist()
                n, removed, kept = [], [], []
                for text, gone in zip(texts, found, strict=True):
                    words = text.split()
                    keep = np.ones(len(words), dtype=bool)
                    if gone:
                        mark = np.zeros(len(words) + 1, dtype=np.int32)
                        start, length = np.array([(r["start"], r["length"]) for r in gone]).T
                        np.add.at(mark, np.minimum(start, len(words)), 1)
                        np.add.at(mark, np.minimum(start + length - 1 + window, len(words)), -1)
                        keep = np.cumsum(mark)[:-1] == 0
                    n.append(len(words))
                    removed.append(int(len(words) - keep.sum()))
                    kept.append(b" ".join(words if keep.all() else [w for w, y in zip(words, keep, strict=True) if y]).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return own.join(runs, "k", "left").select("doc_id", "text", "runs").mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_text string")
