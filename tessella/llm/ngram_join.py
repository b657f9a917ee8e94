"""N-gram Jaccard join by prefix trees.

1. One scan hashes each text's shingles. Equal sets are one set from here on (its smallest document id). The smallest
   hashes of each set meet in buckets; a set that shares too few of them with others can have no partner and goes.
2. The sets left are ordered rarest shingle first, with frequencies from a sketch (any fixed order is right). All sets
   that have a shingle in their prefixes are one star around the smallest of them: by the prefix principle linked sets
   share a star.
3. Each star is one task, which stores its sets in a trie of globally ordered shingles and runs the same sets through
   it: partial overlaps are shared by all sets below a node, and a probe leaves a subtree when its remaining shingles,
   or those of the longest set below, can't reach the needed overlap. Links inside one component aren't repeated.
4. A large star is dealt into chunks of sets of like size, each with a copy of its centre. What the chunks find are
   components; only sets outside a star's largest component are then probed into the star's other chunks of like size.
   A family of near copies is one component after its chunks, however large, so its cost grows with its size alone.
   (Sets of a large star that aren't similar meet chunk by chunk: that cost grows with the square of their number.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, bucket_count, doc_columns, fresh, grouped_ranges, maybe, mix, slices, tidy, window_hashes, word_table

SHINGLE = 5
CHUNK = 1 << 19
#: Most bits of a sketch's index; it is broadcast with a byte for each cell.
SKETCH_BITS = 23
SECTIONS = 64
#: Shingles of one chunk of a star, with SET_COST more for each set.
STAR_CHUNK = 1 << 15
SET_COST = 32
#: Ratio of set sizes in a band; linked sets are at most one band apart, as it is above 1 / 0.8.
BAND = 1.26


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document index) of the distinct shingles, sorted by document and hash. A-Z is lower-cased."""
    words, doc, _, _ = word_table([t.lower() for t in texts])
    grams = window_hashes(words, SHINGLE)
    inside = doc[: len(grams)] == doc[SHINGLE - 1 :] if len(grams) else np.empty(0, dtype=bool)
    hashes, owner = grams[inside], doc[: len(grams)][inside]
    count = np.bincount(doc, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(count)])
    few = [d for d in np.flatnonzero((count > 0) & (count < SHINGLE))]
    if few:
        hashes = np.concatenate([hashes, *(window_hashes(words[begin[d] : begin[d + 1]], int(count[d])) for d in few)])
        owner = np.concatenate([owner, few])
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _signatures(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and two 64-bit sums of each document's hashes."""
    size = np.bincount(owner, minlength=n)
    begin = np.concatenate([[0], np.cumsum(size)])
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)), out=total[1:])
        sums.append(total[begin[1:]] - total[begin[:-1]])
    return size, sums[0], sums[1]


def _misses(size: np.ndarray) -> np.ndarray:
    """Most shingles of a set of this size that a linked set may lack: size - ceil(0.8 * size)."""
    return size - (4 * size + 4) // 5


def _encode(column: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _rows(kinds: dict[str, pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


FOUND = {"doc_id": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "shared": pa.int64()}


def _digests(docs: DataFrame, buckets: int) -> DataFrame:
    """Two kinds of rows. With doc_id and shared -1: a document's set. With null doc_id: of set s1, `shared` of its smallest
    shingles are also among those of another set."""
    packet = {"bucket": pa.int32(), "rows": pa.binary(), "tokens": pa.binary(), "refs": pa.binary(), "sets": pa.binary(), "sizes": pa.binary()}
    shift = np.uint64(64 - (buckets - 1).bit_length())

    class Chunk:
        def __init__(self):
            self.tokens, self.owner, self.sets, self.sizes, self.known = [], [], [], [], {}
            self.held, self.digests = 0, []

        def add(self, ids: list, texts: list[bytes]) -> None:
            hashes, owner = shingle_sets(texts)
            size, s1, s2 = _signatures(hashes, owner, len(texts))
            self.digests.append((np.array([0 if i is None else i for i in ids], dtype=np.int64), size, s1.view(np.int64), s2.view(np.int64)))
            begin = np.concatenate([[0], np.cumsum(size)])
            take = _misses(size) + np.maximum(1, size // 10)
            at = np.arange(len(hashes)) - begin[owner]
            name = np.full(len(texts), -1)
            for d in np.flatnonzero(size):  # a set that the chunk has seen is sent once
                if (key := int(s1[d])) not in self.known:
                    name[d] = self.known[key] = len(self.known)
                    self.sets.append(key)
                    self.sizes.append(int(size[d]))
            keep = (at < take[owner]) & (name[owner] >= 0)
            self.tokens.append(hashes[keep])
            self.owner.append(name[owner[keep]])
            self.held += int(keep.sum())

        def packets(self) -> Iterator[pa.RecordBatch]:
            if not self.digests:
                return
            ids, size, s1, s2 = (np.concatenate(x) for x in zip(*self.digests, strict=True))
            for part in np.array_split(np.arange(len(ids)), max(1, len(ids) // 4096)):
                yield _rows(packet, [[int(s1[part[0]]) % buckets], [np.stack([x[part] for x in (ids, size, s1, s2)]).astype(np.int64).tobytes()], *([[None]] * 4)])
            tokens, owner = np.concatenate(self.tokens), np.concatenate(self.owner).astype(np.int64)
            sets, sizes = np.array(self.sets, dtype=np.uint64), np.array(self.sizes, dtype=np.int64)
            order, cuts = grouped_ranges((tokens >> shift).astype(np.int64), buckets)
            tokens, owner = tokens[order], owner[order]
            low = (tokens >> (shift - np.uint64(32))).astype(np.uint32)
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                used, refs = np.unique(owner[cuts[b] : cuts[b + 1]], return_inverse=True)
                yield _rows(packet, [[int(b)], [None], [low[cuts[b] : cuts[b + 1]].tobytes()], [refs.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes()], [sets[used].tobytes()], [sizes[used].tobytes()]])

    @tidy

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in slices(texts):
                chunk.add(ids[a:b], _encode(texts[a:b]))
                if chunk.held >= CHUNK:
                    yield from chunk.packets()
                    chunk = Chunk()
        yield from chunk.packets()

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, names, sizes = [], [], []
        for batch in batches:
            for rows, t, r, s, z in zip(*(batch.column(c).to_pylist() for c in list(packet)[1:]), strict=True):
                if rows is not None:
                    ids, n, s1, s2 = np.frombuffer(rows, np.int64).reshape(4, -1)
                    yield _rows(FOUND, [ids, n, s1, s2, np.full(len(ids), -1)])
                    continue
                low, own = np.frombuffer(t, np.uint32), np.frombuffer(s, np.uint64)
                refs = np.frombuffer(r, np.uint32 if len(own) > 65535 else np.uint16)
                tokens.append(low)
                names.append(own[refs])
                sizes.append(np.frombuffer(z, np.int64)[refs])
        if not tokens:
            return
        low, name, size = np.concatenate(tokens), np.concatenate(names), np.concatenate(sizes)
        order = np.lexsort((name, low))
        low, name, size = low[order], name[order], size[order]
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (name[1:] != name[:-1])  # copies of a set count once
        low, name, size = low[new], name[new], size[new]
        same = low[1:] == low[:-1]
        hit = np.zeros(len(low), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        found, at, counts = np.unique(name[hit], return_index=True, return_counts=True)
        none = np.zeros(len(found), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.array(size[hit][at]), pa.array(found.view(np.int64)), pa.array(none), pa.array(counts.astype(np.int64))], names=list(FOUND))

    sent = docs.mapInArrow(send, "bucket int, rows binary, tokens binary, refs binary, sets binary, sizes binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc_id long, n long, s1 long, s2 long, shared long")


def _sets(docs: DataFrame) -> DataFrame:
    """(sid, n, tokens) of documents joined with their (n, s1): the text whose set has that signature."""

    @tidy

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                hashes, owner = shingle_sets(_encode(part.column("text")))
                size, s1, _ = _signatures(hashes, owner, part.num_rows)
                begin = np.concatenate([[0], np.cumsum(size)])
                right = np.flatnonzero((size == np.asarray(part.column("n"))) & (s1.view(np.int64) == np.asarray(part.column("s1"))))
                yield pa.RecordBatch.from_arrays([part.column("sid").take(pa.array(right)), pa.array(size[right]), pa.array([hashes[begin[d] : begin[d + 1]].tobytes() for d in right], pa.binary())], names=["sid", "n", "tokens"])

    return docs.mapInArrow(work, "sid long, n long, tokens binary")


def _token_slices(batch: pa.RecordBatch, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for a, b in slices(batch.column("tokens"), 8 * limit):
        part = batch.slice(a, b - a)
        yield part, np.frombuffer(b"".join(part.column("tokens").to_pylist()), np.uint64), np.asarray(part.column("n"))


def sketch_bits(shingles: int) -> int:
    """Index bits of a sketch for so many shingles: some cells for each, as far as a broadcast allows."""
    return min(SKETCH_BITS, max(12, (2 * shingles).bit_length()))


def _sketch(sets: DataFrame, bits: int) -> bytes:
    """Frequencies of shingles by the first bits of their hashes, as bytes: exact below 128, logarithms above."""
    per = (1 << bits) // SECTIONS

    @tidy

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens, _ in _token_slices(batch):
                at, counts = np.unique((tokens >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                cuts = np.searchsorted(at, np.arange(SECTIONS + 1) * per)
                yield pa.RecordBatch.from_arrays([pa.array(range(SECTIONS), pa.int32()), *(pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in range(SECTIONS)], pa.binary()) for x in (at, counts.astype(np.uint32)))], names=["section", "at", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per, dtype=np.int64)
        for batch in batches:
            for a, c in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[np.frombuffer(a, np.uint32) % per] += np.frombuffer(c, np.uint32)
        small = np.where(total < 128, total, np.minimum(255, 128 + 4 * np.log2(np.maximum(total, 128) / 128)))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([small.astype(np.uint8).tobytes()], pa.binary())], names=["section", "bytes"])

    out = np.zeros(1 << bits, dtype=np.uint8)
    for row in sets.mapInArrow(send, "section int, at binary, counts binary").groupBy("section").applyInArrow(add, "section int, bytes binary").collect():  # SECTIONS rows of fixed size
        out[row.section * per : (row.section + 1) * per] = np.frombuffer(row.bytes, np.uint8)
    return out.tobytes()


def _stars(sets: DataFrame, sketch: Broadcast, bits: int, buckets: int) -> DataFrame:
    """(sid, hub): for each prefix shingle that several sets have, those sets and the smallest of them, which is in the rows too."""
    shift = np.uint64(64 - (buckets - 1).bit_length())

    @tidy

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            for part, tokens, size in _token_slices(batch):
                owner = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((tokens, rare[(tokens >> np.uint64(64 - bits)).astype(np.int64)], owner))
                at = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                keep = at <= _misses(size)[owner]
                tokens, sids = tokens[order][keep], np.asarray(part.column("sid"))[owner[keep]]
                order, cuts = grouped_ranges((tokens >> shift).astype(np.int64), buckets)
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[order[cuts[b] : cuts[b + 1]]].tobytes() for b in full], pa.binary()) for x in (tokens, sids))], names=["bucket", "tokens", "sids"])

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sids = [], []
        for batch in batches:
            tokens += [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
            sids += [np.frombuffer(x, np.int64) for x in batch.column("sids").to_pylist()]
        token, sid = np.concatenate(tokens), np.concatenate(sids)
        order = np.lexsort((sid, token))
        token, sid = token[order], sid[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = token[1:] != token[:-1]
        hub = sid[np.flatnonzero(new)][np.cumsum(new) - 1]
        pairs = np.stack([sid, hub], axis=1)[sid != hub]
        pairs = np.unique(np.concatenate([pairs, np.stack([pairs[:, 1]] * 2, axis=1)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["sid", "hub"])

    return sets.mapInArrow(send, "bucket int, tokens binary, sids binary").groupBy("bucket").applyInArrow(meet, "sid long, hub long").distinct()


def connected(edges: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """(v, label): the smallest vertex of the component of every vertex of (a, b) edges.

    Each round a vertex points to its neighbour (or itself) of least hashed rank and edges move along the pointers, so
    the graph shrinks by a factor whatever its shape; then pointers are followed back. Nothing is collected.
    """
    steps, round_ = [], 0
    live = tmp.write(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-edges0")
    while live.limit(1).count():
        both = live.union(live.select("b", "a"))
        rank = F.struct(F.xxhash64(F.col("b"), F.lit(round_)).alias("h"), F.col("b").alias("v"))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(round_)).alias("h"), F.col("a").alias("v"))
        to = tmp.write(both.groupBy("a").agg(F.min(rank).alias("m")).select("a", F.least("m", own)["v"].alias("p")), f"{name}-to{round_}")
        steps.append(to)
        moved = live.join(to, "a").select(F.col("p").alias("x"), "b").join(to.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("p").alias("b"))
        round_ += 1
        live = tmp.write(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges{round_}")
    if not steps:
        return live.select(F.col("a").alias("v"), F.col("b").alias("label"))
    roots = steps[-1].select(F.col("a").alias("v"), F.col("p").alias("root"))
    for to in reversed(steps[:-1]):
        roots = to.select(F.col("a").alias("v"), "p").join(roots.withColumnRenamed("v", "p"), "p", "left").select("v", F.coalesce("root", "p").alias("root"))
    roots = tmp.write(roots, f"{name}-roots")
    least = roots.groupBy("root").agg(F.min("v").alias("label"))
    return tmp.write(roots.join(least, "root").select("v", F.least("v", "label").alias("label")), f"{name}-labels")


class _Forest:
    """Components of the sets of one task; sets that begin with one label are one component."""

    def __init__(self, labels: np.ndarray):
        self.of = np.unique(labels, return_inverse=True)[1]

    def join(self, one: int, others: np.ndarray) -> list[int]:
        """Joins `one` with others; gives an index for each component that it wasn't in."""
        groups, at = np.unique(self.of[others], return_index=True)
        new = groups != self.of[one]
        if new.any():
            self.of[np.isin(self.of, groups[new])] = self.of[one]
        return others[at[new]].tolist()


class _Probes:
    """The probing sets of one task by their shingles."""

    def __init__(self, lists: list[np.ndarray], width: int):
        flat, self.width = np.concatenate([*lists, np.empty(0, dtype=np.int64)]), width
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.keys, self.end = owner * width + flat, np.cumsum([len(x) for x in lists])
        order = np.argsort(flat, kind="stable")
        self.owner, self.begin, self.n = owner[order], np.searchsorted(flat[order], np.arange(width + 1)), len(lists)

    def overlaps(self, shingles: np.ndarray) -> np.ndarray:
        """How many of the shingles each probe has."""
        first, count = self.begin[shingles], self.begin[shingles + 1] - self.begin[shingles]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(self.owner[at], minlength=self.n)

    def left(self, probes: np.ndarray, shingle: int) -> np.ndarray:
        """How many shingles after this one each of the probes has."""
        return self.end[probes] - np.searchsorted(self.keys, probes * self.width + shingle, side="right")


def _branches(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of lists in lexicographic order: the length that each has in common with the next, and the last list that has as much in common."""
    common = np.zeros(len(lists), dtype=np.int64)
    for place in range(len(lists) - 1):
        m = min(len(lists[place]), len(lists[place + 1]))
        differ = np.flatnonzero(lists[place][:m] != lists[place + 1][:m])
        common[place] = differ[0] if len(differ) else m
    last, open_ = np.full(len(lists), len(lists) - 1), []
    for place in range(len(lists)):
        while open_ and common[open_[-1]] > common[place]:
            last[open_.pop()] = place
        open_.append(place)
    return common, last


def trie_join(stored: np.ndarray, probes: np.ndarray, tokens: list[np.ndarray], size: np.ndarray, forest: _Forest) -> Iterator[tuple[int, int]]:
    """Links between stored and probing sets that join two components. tokens: ids of shared shingles, ascending in the global order.

    The stored sets in lexicographic order are a trie walked depth first: the stack holds, for the nodes above, the
    partial overlaps of the probes that can still be linked with a set below. Memory follows the number of shingles.
    """
    if not len(stored) or not len(probes):
        return
    stored = np.array(sorted(stored, key=lambda i: tokens[i].astype(">u4").tobytes()))
    lists, width = [tokens[i] for i in stored], 1 + max((int(t[-1]) for t in tokens if len(t)), default=0)
    table, (common, last) = _Probes([tokens[i] for i in probes], width), _branches(lists)
    length, own_size, probe_size = np.array([len(x) for x in lists]), size[stored], size[probes]

    def able(alive: np.ndarray, overlap: np.ndarray, depth: int, at: int, first: int, final: int) -> tuple[np.ndarray, np.ndarray]:
        """The probes that may be linked with one of the stored sets first to final, all alike in the first `depth` shingles."""
        below = forest.of[stored[first : final + 1]]
        reach = overlap + np.minimum(table.left(alive, at), length[first : final + 1].max() - depth)
        good = 180 * reach >= 80 * (probe_size[alive] + own_size[first : final + 1].min())
        if (below == below[0]).all():
            good &= forest.of[probes[alive]] != below[0]
        return alive[good], overlap[good]

    every = np.arange(len(probes))
    stack = [(0, *able(every, np.zeros(len(every), dtype=np.int64), 0, -1, 0, len(stored) - 1))]
    for place, i in enumerate(stored):
        own, (depth, alive, overlap) = lists[place], stack[-1]
        if common[place] > depth:
            if len(alive):
                overlap = overlap + table.overlaps(own[depth : common[place]])[alive]
                alive, overlap = able(alive, overlap, int(common[place]), int(own[common[place] - 1]), place, int(last[place]))
            depth = int(common[place])
            stack.append((depth, alive, overlap))
        other = forest.of[probes[alive]] != forest.of[i]
        if other.any():
            alive, overlap = alive[other], overlap[other]
            whole = overlap + table.overlaps(own[depth:])[alive]
            good = alive[180 * whole >= 80 * (probe_size[alive] + size[i])]
            for j in forest.join(i, probes[good]):
                yield i, j
        while stack[-1][0] > common[place]:
            stack.pop()
        # the next branch leaves at common[place], which is on the stack or above its top


def _links(chunks: DataFrame, keys: list[str], sketch: Broadcast, bits: int) -> DataFrame:
    """(a, b) inside groups of rows (sid, n, tokens, label, stored, probe)."""

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.frombuffer(sketch.value, np.uint8)
        columns, tokens = {c: [] for c in ("sid", "n", "label", "stored", "probe")}, []
        for batch in batches:
            for c, parts in columns.items():
                parts.append(batch.column(c).to_numpy(zero_copy_only=False))
            tokens += [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
        sid, n, label, stored, probe = (np.concatenate(x) for x in columns.values())
        found, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        # the global order, frequent shingles first, so that near copies share long paths; shingles of one set alone can't overlap
        place = np.empty(len(found), dtype=np.int64)
        order = np.lexsort((found, -rare[(found >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)))
        useful = counts[order] > 1
        place[order] = np.where(useful, np.cumsum(useful) - 1, -1)
        lists = [np.sort(x[x >= 0]) for x in np.split(place[inverse], np.cumsum(n)[:-1])]
        pairs = np.array(list(trie_join(np.flatnonzero(stored), np.flatnonzero(probe), lists, n, _Forest(label))), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(sid[pairs[:, 0]]), pa.array(sid[pairs[:, 1]])], names=["a", "b"])

    return chunks.groupBy(*keys).applyInArrow(work, "a long, b long")


def _dealt(stars: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (hub, sid, n, band, c) of chunks, with band -1 for stars of one chunk; and the chunks (hub, band, k) of larger stars."""
    weight = F.sum(F.col("n") + SET_COST)
    banded = stars.withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
    bands = tmp.write(banded.groupBy("hub", "band").agg(weight.alias("weight")), "bands")
    large = bands.groupBy("hub").agg(F.sum("weight").alias("all")).filter(F.col("all") > STAR_CHUNK).select("hub")
    chunks = tmp.write(bands.join(large, "hub").select("hub", "band", F.ceil(F.col("weight") / STAR_CHUNK).cast("int").alias("k")), "chunks")
    found = banded.join(chunks, ["hub", "band"], "left")
    c = F.coalesce(F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"), F.lit(0))
    return found.select("hub", "sid", "n", F.when(F.col("k").isNull(), -1).otherwise(F.col("band")).alias("band"), c.alias("c")), chunks


def _star_links(sets: DataFrame, sketch: Broadcast, bits: int, buckets: int, tmp: Scratch) -> DataFrame:
    """(a, b): links that make up the components of the sets."""
    sizes = sets.select("sid", "n").dropDuplicates(["sid"])
    stars = tmp.write(_stars(sets, sketch, bits, buckets).join(sizes, "sid"), "stars")
    members, chunks = _dealt(stars, tmp)
    members = tmp.write(members, "dealt")
    # a large star's centre is in each of its chunks of like size
    centre = members.filter("sid = hub and band >= 0").select("hub", "sid", "n", F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"))
    centres = centre.join(chunks, ["hub", "band"]).select("hub", "sid", "n", "band", F.explode(F.expr("sequence(0, k - 1)")).alias("c"))
    every = F.lit(True)
    placed = members.union(centres.select(*members.columns)).select("hub", "band", "c", "sid", F.col("sid").alias("label"), every.alias("stored"), every.alias("probe"))
    links = tmp.write(_links(placed.join(sets, "sid"), ["hub", "band", "c"], sketch, bits), "links")
    if not chunks.limit(1).count():
        return links
    # larger stars: sets outside the largest component are held against the other chunks
    near = connected(links, tmp, "near").withColumnRenamed("v", "sid")
    owned = tmp.write(members.filter("band >= 0").join(near, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "owned")
    most = owned.groupBy("hub", "label").agg(F.count("*").alias("m")).groupBy("hub").agg(F.max_by("label", F.struct("m", "label")).alias("most"))
    odd = owned.join(most, "hub").filter("label <> most").select("hub", "sid", "n", "label", F.col("band").alias("home"), F.col("c").alias("at"), F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"))
    aimed = tmp.write(odd.join(chunks, ["hub", "band"]), "aimed")
    parts = aimed.groupBy("hub", "band").agg(F.ceil(F.sum(F.col("n") + SET_COST) / STAR_CHUNK).cast("int").alias("parts"))
    probes = aimed.join(parts, ["hub", "band"]).select("hub", "band", F.explode(F.expr("sequence(0, k - 1)")).alias("c"), F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts")).cast("int").alias("part"), "sid", "label", "home", "at")
    probes = probes.filter("home <> band or at <> c").select("hub", "band", "c", "part", "sid", "label", F.lit(False).alias("stored"), F.lit(True).alias("probe"))
    held = owned.join(parts, ["hub", "band"]).select("hub", "band", "c", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "sid", "label", F.lit(True).alias("stored"), F.lit(False).alias("probe"))
    far = tmp.write(_links(held.union(probes).join(sets, "sid"), ["hub", "band", "c", "part"], sketch, bits), "far-links")
    return links.union(far)


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    A set is the distinct five-word shingles of a text, words being `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a shorter text is one shingle,
    a text without words has none and links with nothing. Two documents link when 100 * intersection >= 80 * union; component_id is the
    smallest doc_id that links reach. Null text is empty. Rows that repeat an id are each a row, and one document as far as links
    go; rows with a null id are left out.
    """
    spark = docs.sparkSession
    tmp, buckets = Scratch(spark, "ngrams"), bucket_count(spark, 256)
    own = doc_columns(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    found = tmp.write(_digests(own, buckets), "found")
    digest = found.filter("shared = -1").select("doc_id", "n", "s1", "s2")
    shared = found.filter("shared >= 0").groupBy("s1").agg(F.sum("shared").alias("shared"), F.max("n").alias("n")).filter(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("n") * 2 / 25)))
    repeated = tmp.write(digest.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.struct("n", "s1", "s2")).alias("low"), F.max(F.struct("n", "s1", "s2")).alias("own")).filter("rows > 1"), "repeated")
    again = repeated.limit(1).count() > 0
    reps = digest.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id")).withColumn("sid", F.col("doc_id"))
    if again:  # an id with several sets can't name them: those sets are named by a hash of their signatures
        several = repeated.filter("low <> own").select("doc_id", F.lit(True).alias("several"))
        reps = reps.join(several, "doc_id", "left").withColumn("sid", F.when(F.col("several"), F.xxhash64("n", "s1", "s2")).otherwise(F.col("doc_id"))).select("n", "s1", "s2", "doc_id", "sid")
    reps = tmp.write(reps, "reps")
    wanted = tmp.write(reps.join(shared.select("s1"), "s1").select("doc_id", "sid", "n", "s1"), "wanted")
    some = maybe(own, wanted.select(F.col("doc_id").alias("sid")), "doc_id").join(wanted.withColumnRenamed("doc_id", "named").hint("merge"), F.col("doc_id") == F.col("named")).select("sid", "n", "s1", "text")
    sets = _sets(some)
    sets = tmp.write(sets.dropDuplicates(["sid"]) if again else sets, "sets")  # rows that repeat an id and its text give one set
    bits = sketch_bits(wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    links = _star_links(sets, spark.sparkContext.broadcast(_sketch(sets, bits)), bits, buckets, tmp)
    if again:
        links = links.union(_within_ids(digest, repeated, reps))
    component = connected(links, tmp, "component")
    label = reps.join(component.select(F.col("v").alias("sid"), "label"), "sid", "left").select("n", "s1", "s2", "doc_id", F.coalesce("label", "sid").alias("component_id"))
    if again:  # labels may be hashes: the smallest id takes their place
        label = tmp.write(label, "label")
        lowest = label.groupBy("component_id").agg(F.min("doc_id").alias("lowest")).filter("component_id <> lowest")
        label = label.join(lowest, "component_id", "left").withColumn("component_id", F.coalesce("lowest", "component_id"))
        # a row without words belongs to its id's other rows
        filled = repeated.filter("low.n = 0 and own.n > 0").select("doc_id", "own")
        digest = digest.join(filled, "doc_id", "left").select("doc_id", "n", F.when(F.col("n") == 0, F.col("own")).otherwise(F.struct("n", "s1", "s2")).alias("key"))
    else:
        digest = digest.select("doc_id", "n", F.struct("n", "s1", "s2").alias("key"))
    digest = digest.select("doc_id", F.col("n").alias("n_shingles"), "key.n", "key.s1", "key.s2")
    return digest.join(label.drop("doc_id"), ["n", "s1", "s2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _within_ids(digest: DataFrame, repeated: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): the sets of one id, each linked with the smallest of them."""
    several = repeated.filter("low <> own").select("doc_id")
    held = digest.filter("n > 0").join(several, "doc_id").select("doc_id", "n", "s1", "s2").distinct().join(reps.select("n", "s1", "s2", "sid"), ["n", "s1", "s2"]).select("doc_id", "sid")
    first = held.groupBy("doc_id").agg(F.min("sid").alias("a"))
    return held.join(first, "doc_id").filter("sid <> a").select("a", F.col("sid").alias("b"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose document is the smallest of its group."""
    groups = near_groups(docs, id_col=id_col, text_col=text_col)
    name = fresh("copy__", docs.columns)
    copies = Scratch(docs.sparkSession, "copies").write(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "ids")
    return docs.join(copies, F.col(id_col).cast("long") == F.col(name), "left_anti")
