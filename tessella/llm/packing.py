"""Packing along a space-filling curve.

A document's hashed words are projected to a direction in a few dimensions; its place on a Hilbert curve through the
cube around them is the sort key. A weighted sample of keys cuts the curve into stretches with about as many bytes of
text each, so neither many copies nor long texts make one task large; each task sorts its stretch by (key, id),
tokenises it and cuts the stream of ids into sequences. The rest at the end of a stretch goes to sequences whose
lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm.common import Scratch, doc_columns, slices, tidy, word_table

#: Bytes of text of one task's stretch, and of one where there are fewer stretches than shuffle partitions.
STRETCH_BYTES, LEAST_BYTES = 32 << 20, 1 << 20
#: Most keys that are sampled, for any number of stretches.
SAMPLE = 1 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file, which it matches in texts before any splitting."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("added tokens that take blanks or whole words only aren't matched literally")
    return {t["content"]: t["id"] for t in tokens}


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file with added tokens. Its ids are those of the same vocabulary's tokenizers file; a test compares them."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    special = dict(added)
    ranks = {word: i for word, i in ranks.items() if i not in special.values()}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


#: The quicker library takes the square of a run of white space as its time, and runs out of its stack in the end.
LONG_BLANK = re.compile(r"\s{2000}")


@lru_cache(maxsize=4)
def plain_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def text_ids(text: str, encoding: tiktoken.Encoding, file: str | None) -> np.ndarray:
    """The ids of a text; one with a very long run of white space is left to the tokenizers file, which has no such bound."""
    if file and len(text) >= 2000 and LONG_BLANK.search(text):
        return np.array(plain_tokenizer(file).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (n, d), each coordinate below 2**bits, on a Hilbert curve; d * bits is at most 62."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of each level, from the top
        for i in range(len(x)):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inverted, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for xi in x:
            key = (key << 1) | (((xi ^ flip) >> b) & 1)
    return key


def curve_keys(texts: list[bytes], dims: int = 4, bits: int = 8) -> np.ndarray:
    """Hilbert keys of texts: the direction of the sums of random signs of their words, whatever their length."""
    hashes, doc, _, _ = word_table(texts)
    z = np.column_stack([np.bincount(doc, weights=((hashes >> np.uint64(7 * i + 3)) & np.uint64(1)).astype(np.float64) * 2 - 1, minlength=len(texts)) for i in range(dims)])
    z = z / np.maximum(np.sqrt((z**2).sum(axis=1, keepdims=True)), 1)
    return hilbert_keys(np.clip((1 + z) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def _stretches(curve: np.ndarray, doc: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the sorted cuts (curve, doc_id) lie at or before each key."""
    order = np.lexsort((np.repeat([0, 1], [len(cuts), len(curve)]), np.concatenate([cuts[:, 1], doc]), np.concatenate([cuts[:, 0], curve])))
    before = np.empty(len(order), dtype=np.int64)
    before[order] = np.cumsum(order < len(cuts))
    return before[len(cuts) :].astype(np.int32)


def _cuts(keys: DataFrame) -> np.ndarray:
    """Keys that cut rows (doc_id, curve, bytes) into stretches of about equal bytes. The driver sees at most some 2 * SAMPLE rows."""
    total = int(keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    held = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, -(-total // STRETCH_BYTES), min(held, total // LEAST_BYTES))
    rate = min(SAMPLE, 32 * parts) / max(total, 1)
    times = F.floor(F.col("bytes") * rate + F.pmod(F.xxhash64("doc_id", "curve"), F.lit(1 << 30)) / (1 << 30))
    sample = keys.select("curve", "doc_id", times.alias("times")).filter("times > 0").toArrow()
    curve, doc, times = (np.asarray(sample.column(c).to_numpy()) for c in ("curve", "doc_id", "times"))
    order = np.lexsort((doc, curve))
    at = np.searchsorted(np.cumsum(times[order]), np.arange(1, parts) * times.sum() / parts)
    return np.column_stack([curve[order][at], doc[order][at]]) if len(order) else np.empty((0, 2), dtype=np.int64)


class _Packer:
    """Cuts a stream of documents' ids into sequences of `size`; each piece is (doc, start, ids, tokens of the document)."""

    def __init__(self, size: int, first: int):
        self.size, self.next, self.open, self.held = size, first, [], 0
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.size - self.held, len(ids) - at)
            self.open.append((doc, at, ids[at : at + take], len(ids)))
            at, self.held = at + take, self.held + take
            if self.held == self.size:
                self._close()

    def _close(self) -> None:
        offset = 0
        for doc, start, ids, total in self.open:
            self.out.append((doc, start, len(ids), total, self.next, offset, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.next, self.open, self.held = self.next + 1, [], 0

    def end(self) -> None:
        rest, left = self.open, self.held
        self.open, self.held = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc, start, ids, total = rest[0]
                take = min(room, len(ids))
                self.open.append((doc, start, ids[:take], total))
                room -= take
                rest[:1] = [(doc, start + take, ids[take:], total)] if take < len(ids) else []
            self._close()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack_documents(docs: DataFrame, *, vocabulary: str, pattern: str, added: dict[str, int] | None = None, file: str | None = None, size: int = 2048, end_id: int = 1, dims: int = 4, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start (ids of the document before it), length, doc_tokens (with the end
    id), sequence_id, offset in that sequence, and ids as packed little-endian unsigned 32-bit numbers.

    vocabulary and pattern: the tokenizer's rank file, at the same path on every machine, and its splitting pattern.
    file: the same vocabulary as a tokenizers file, for texts with long runs of white space; without it such a text is an error.
    added: tokens that are matched in texts as a whole, with their ids; without them such strings are plain text.
    Null and empty texts are the end id alone. Rows that repeat an id are documents of their own. size is a power of two.
    """
    own = doc_columns(docs, id_col, text_col)

    least = -(1 << 63)  # stands for a null id, as Spark sorts it first

    @tidy

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            keys = [curve_keys([x.encode() for x in texts[a:b].to_pylist()], dims, bits) for a, b in slices(texts)]
            size = np.asarray(pc.binary_length(texts), dtype=np.int64) + 64
            yield pa.RecordBatch.from_arrays([batch.column(0).fill_null(least), pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(size)], names=["doc_id", "curve", "bytes"])

    cuts = _cuts(Scratch(docs.sparkSession, "packing").write(own.mapInArrow(key, "doc_id long, curve long, bytes long"), "keys"))
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    @tidy

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                curve = curve_keys([x.encode() for x in part.column(1).to_pylist()], dims, bits)
                stretch = _stretches(curve, np.asarray(part.column(0).fill_null(least)), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(curve), pa.array(stretch)], names=["doc_id", "text", "curve", "stretch"])

    @tidy

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary, pattern, tuple((added or {}).items()))
        packer = _Packer(size, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = text_ids(text.as_py(), encoding, file)
                packer.add(doc, np.append(ids, np.uint32(end_id)))
                if len(packer.out) >= 2000:
                    yield packer.batch()
        packer.end()
        yield packer.batch()

    placed = own.mapInArrow(place, "doc_id long, text string, curve long, stretch int").repartitionById(len(cuts) + 1, "stretch")
    return placed.sortWithinPartitions("curve", "doc_id", F.xxhash64("text")).select("doc_id", "text").mapInArrow(pack, SCHEMA)
