"""Collocations: phrases of words that occur together more often than their parts would.

Each task gathers texts into shards. A shard's words become numbers in the words' byte order, pieces are set apart by a
zero, and numpy prefix doubling sorts all suffixes by their first words. Where neighbouring suffixes share n words they
are one interval: its length is the count of that n-gram in the shard. A shard's distinct n-grams go to the owner of
their hash as compressed cells in sorted order, one cell for each owner, so a very common phrase is one entry for each
shard. An owner splits its cells by further bits of the hash into parts of bounded size, merges each part and keeps
what is frequent enough; scores, cuts and contained phrases are joins of that table with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, mix, tidy

#: Words of a shard; a longer text makes a larger one.
SHARD_WORDS = 1 << 18
#: Bytes of text for each owner and for each of the parts that it merges at once, and the number of owners beyond which each has several parts.
PART_BYTES, OWNERS = 4 << 20, 4096
#: Entries that an owner holds before it merges or splits them.
HELD = 1 << 18
#: Phrases that are hashed at once.
STEP = 1 << 14
CELLS = "owner int, langs array<string>, held array<int>, phrases binary, counts binary"
PARTS = "part int, langs array<string>, held array<int>, phrases binary, counts binary"
COUNTS = "lang string, phrase string, n long"

_KIND = np.zeros(256, dtype=np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(words, text of each word, piece of each word) of lower-cased texts; pieces never span texts."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    kind = _KIND[data]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is a break
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    return words, text, piece


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first `depth` symbols (0 or more each) at least, by prefix doubling; the end comes first."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + 1
    order, have = np.argsort(rank), 1
    while have < depth:
        later = np.zeros(n, dtype=np.int64)
        later[: max(n - have, 0)] = rank[have:]
        key = rank * (rank.max(initial=0) + 1) + later
        order = np.argsort(key)
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        have *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many symbols, `depth` at most, each suffix shares with the one before it in the order; no end of a piece (0) counts."""
    padded = np.concatenate([symbols, np.zeros(depth, dtype=symbols.dtype)])
    shared, going = np.zeros(len(order), dtype=np.int8), np.ones(max(len(order) - 1, 0), dtype=bool)
    for j in range(depth):
        here = padded[order + j]
        going &= (here[1:] == here[:-1]) & (here[1:] != 0)
        shared[1:] += going
    return shared


def intervals(symbols: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a start, count) of the distinct n-grams of 1 to `most` symbols without a zero, each n in sorted order."""
    order = suffix_array(symbols, most)
    shared = common_prefixes(symbols, order, most)
    ends = np.append(np.flatnonzero(symbols == 0), len(symbols))
    room = ends[np.searchsorted(ends, np.arange(len(symbols)))] - np.arange(len(symbols))
    left = room[order]
    for n in range(1, most + 1):
        fits = left >= n  # such suffixes with a like beginning are neighbours
        at = np.flatnonzero(fits)
        opens = np.flatnonzero(shared[at] < n)
        yield n, order[at[opens]], np.diff(np.append(opens, len(at)))


class _Shard:
    """Texts with their languages until they hold enough words, and the cells of their n-grams."""

    def __init__(self, owners: int, most: int):
        self.owners, self.most = owners, most
        self.texts: list[bytes] = []
        self.langs: list[str] = []
        self.size = 0

    def add(self, text: bytes, lang: str) -> None:
        self.texts.append(text)
        self.langs.append(lang)
        self.size += 1 + len(text) // 6

    def cells(self) -> pa.RecordBatch:
        names, lang = np.unique(np.array(self.langs, dtype=object), return_inverse=True)
        words, text, piece = words_of(self.texts)
        self.texts, self.langs, self.size = [], [], 0
        coded = words.dictionary_encode()
        spelt = coded.dictionary
        by_bytes = np.asarray(pc.sort_indices(spelt))
        place = np.empty(len(spelt), dtype=np.int64)
        place[by_bytes] = np.arange(len(spelt))
        spelt = spelt.take(pa.array(by_bytes))
        own = lang[text].astype(np.int64)
        symbol = own * len(spelt) + place[np.asarray(coded.indices)] + 1
        breaks = np.flatnonzero(np.diff(piece, prepend=-1))  # a zero before each piece
        symbols = np.insert(symbol, breaks, 0)
        hashes = _byte_hashes(spelt)
        owner, order_lang, phrase, count = [], [], [], []
        for n, start, c in intervals(symbols, self.most):
            ids = [symbols[start + j] - 1 for j in range(n)]
            of = ids[0] // max(len(spelt), 1)
            word = [i - of * len(spelt) for i in ids]
            h = of.astype(np.uint64) * np.uint64(0) + np.uint64(n)
            for w in word:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[w])
            owner.append((h % np.uint64(self.owners)).astype(np.int64))
            order_lang.append(of)
            texts = [spelt.take(pa.array(w)) for w in word]
            ended = pa.scalar(b"\n", pa.large_binary())
            phrase.append(pc.binary_join_element_wise(pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.large_binary())) if n > 1 else texts[0], ended, pa.scalar(b"", pa.large_binary())))
            count.append(c)
        # the number of all words of a language travels as that of the empty phrase
        totals = np.bincount(own, minlength=len(names))
        owner.append(np.zeros(len(names), dtype=np.int64))
        order_lang.append(np.arange(len(names)))
        phrase.append(pa.array([b"\n"] * len(names), pa.large_binary()))
        count.append(totals)
        return _cells(np.concatenate(owner), np.concatenate(order_lang), pa.chunked_array(phrase, pa.large_binary()).combine_chunks(), np.concatenate(count), names.tolist(), "owner")


def _byte_hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] if len(offsets) else 0 :]
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    starts = offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    at = np.arange(len(data[: offsets[-1] - offsets[0]])) - np.repeat(starts, lengths)
    spread = mix((data[: offsets[-1] - offsets[0]].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + at.astype(np.uint64))
    return mix(np.add.reduceat(spread, starts) + lengths.astype(np.uint64))  # words aren't empty


def _cells(group: np.ndarray, lang: np.ndarray, phrase: pa.LargeBinaryArray, count: np.ndarray, names: list[str], name: str) -> pa.RecordBatch:
    """One row for each group: its languages, how many phrases each has, the phrases (ended by line feeds) and counts, compressed."""
    order = np.argsort((group * len(names) + lang) * len(group) + np.arange(len(group)))  # phrases stay in order
    group, lang, count = group[order], lang[order], count[order].astype("<u8")
    phrase = phrase.take(pa.array(order))
    offsets = np.frombuffer(phrase.buffers()[1], dtype=np.int64)[: len(phrase) + 1]
    data = memoryview(phrase.buffers()[2] or b"")
    packer = zstandard.ZstdCompressor(level=1)
    present, starts = np.unique(group, return_index=True)
    cuts = np.append(starts, len(group))
    rows = {name: present.astype(np.int32).tolist(), "langs": [], "held": [], "phrases": [], "counts": []}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        of, first = np.unique(lang[a:b], return_index=True)
        rows["langs"].append([names[i] for i in of])
        rows["held"].append(np.diff(np.append(first, b - a)).tolist())
        rows["phrases"].append(packer.compress(data[offsets[a] : offsets[b]]))
        rows["counts"].append(packer.compress(count[a:b].tobytes()))
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _entries(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """The entries (lang, phrase, n) of each cell."""
    unpacker = zstandard.ZstdDecompressor()
    for langs, held, phrases, counts in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
        data = np.frombuffer(unpacker.decompress(phrases), dtype=np.uint8)
        ends = np.flatnonzero(data == 10)
        offsets = np.zeros(len(ends) + 1, dtype=np.int64)
        offsets[1:] = ends + 1 - np.arange(1, len(ends) + 1)
        words = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 10])])
        lang = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(langs), dtype=np.int32), held)), pa.array(langs, pa.large_string()))
        yield pa.table({"lang": lang, "phrase": words, "n": np.frombuffer(unpacker.decompress(counts), dtype="<u8").astype(np.int64)})


def _merged(tables: list[pa.Table]) -> pa.Table:
    """One row for each (lang, phrase) with the sum of n."""
    whole = pa.concat_tables(tables).unify_dictionaries() if len(tables) > 1 else tables[0]
    return whole.group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])


def count_phrases(docs: DataFrame, *, most: int = 3, least: int = 10, shard_words: int = SHARD_WORDS, part_bytes: int = PART_BYTES, most_owners: int = OWNERS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, n): exact counts of the phrases of 1 to `most` words that a language's texts hold `least` times or more, and of
    all its words for the empty phrase. Null texts are empty, a null language is `und`."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    total = int(own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(-(-total // part_bytes), most_owners))
    parts = max(1, -(-total // (owners * part_bytes)))

    @tidy
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(owners, most)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(text.as_buffer().to_pybytes(), lang.as_py())
                if shard.size >= shard_words:
                    yield shard.cells()
        if shard.texts:
            yield shard.cells()

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if parts == 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, dtype=np.int32)), *batch.columns[1:]], names=["part", *batch.schema.names[1:]])
                continue
            for table in _entries(batch):
                held.append(table)
                rows += table.num_rows
                if rows >= HELD:
                    yield _by_part(_merged(held), parts)
                    held, rows = [], 0
        if held:
            yield _by_part(_merged(held), parts)

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows = None, [], 0
        for batch in batches:
            for number, table in zip(batch.column(0).to_pylist(), _entries(batch), strict=True):
                if number != part and held:
                    yield from _frequent(held, least)
                    held, rows = [], 0
                part = number
                held.append(table)
                rows += table.num_rows
                if rows >= 2 * held[0].num_rows + HELD:
                    held = [_merged(held)]
                    rows = held[0].num_rows
        if held:
            yield from _frequent(held, least)

    owned = own.mapInArrow(cells, CELLS).repartitionById(owners, "owner")
    return owned.mapInArrow(split, PARTS).sortWithinPartitions("part").mapInArrow(merge, COUNTS)


def _by_part(table: pa.Table, parts: int) -> pa.RecordBatch:
    """Cells of the entries' parts, by hash bits that the owner didn't take."""
    lang = table.column("lang").combine_chunks()
    phrase = table.column("phrase").combine_chunks().cast(pa.large_binary())
    shifted = mix(_byte_hashes_or_empty(phrase)) % np.uint64(parts)
    ended = pc.binary_join_element_wise(phrase, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    return _cells(shifted.astype(np.int64), np.asarray(lang.indices).astype(np.int64), ended, table.column("n").to_numpy(), lang.dictionary.to_pylist(), "part")


def _byte_hashes_or_empty(phrases: pa.LargeBinaryArray) -> np.ndarray:
    out = np.zeros(len(phrases), dtype=np.uint64)
    for a in range(0, len(phrases), STEP):
        part = phrases.slice(a, STEP)
        filled = np.asarray(pc.binary_length(part)) > 0
        out[a : a + STEP][filled] = _byte_hashes(part.filter(pa.array(filled)))
    return out


def _frequent(tables: list[pa.Table], least: int) -> Iterator[pa.RecordBatch]:
    table = _merged(tables)
    kept = table.filter(pc.or_(pc.greater_equal(table.column("n"), least), pc.equal(table.column("phrase"), "")))
    for batch in kept.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=10_000):
        yield batch


def collocations(docs: DataFrame, *, top: int = 2000, most: int = 3, least: int = 10, percent: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at `[.,;:!?\\x0A-\\x0D]` into pieces of words `[^\\x20\\x09]+`. Candidates have 2 to `most` words
    and occur a >= `least` times. A cut after k words gives l and r, the counts of both parts, and floor(1000000 * a * a / (l * r)); the
    lowest counts, ties go to the smallest k. A candidate goes if a longer one that contains it has 100 * count >= percent * a.
    Null texts are empty, a null language is `und`; the order is score and a descending, then phrase by bytes. Repeated rows count each.
    """
    tmp = Scratch(docs.sparkSession, "collocations")
    counts = tmp.write(count_phrases(docs, most=most, least=least, text_col=text_col, lang_col=lang_col), "counts")
    words = F.split("phrase", " ")
    phrases = counts.filter("phrase != ''").select("lang", "phrase", "n", words.alias("words"))
    candidates = phrases.filter(F.size("words") > 1)
    part = lambda start, length: F.concat_ws(" ", F.slice("words", start, length))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select("lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    known = counts.filter("phrase != ''")
    both = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = {c: f"cast({c} as decimal(38,0))" for c in "alr"}
    scored = both.withColumn("score", F.expr(f"(1000000 * {wide['a']} * {wide['a']}) div ({wide['l']} * {wide['r']})"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")
    spans = candidates.filter(F.size("words") > 2).select("lang", "n", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    inner = spans.select("lang", "n", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("s")).select("lang", "n", part(F.col("s"), F.col("m")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer is null or 100 * longer < {percent} * a"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    sizes = counts.filter("phrase = ''").select("lang", F.col("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda w: w <> '') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
  w AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)),
  f AS (SELECT lang, x AS g, 1 AS m, count(*) AS a FROM w GROUP BY lang, g
    UNION ALL SELECT lang, x || ' ' || y AS g, 2, count(*) FROM w WHERE y IS NOT NULL GROUP BY lang, g
    UNION ALL SELECT lang, x || ' ' || y || ' ' || z AS g, 3, count(*) FROM w WHERE z IS NOT NULL GROUP BY lang, g),
  s AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
  h AS MATERIALIZED (SELECT * FROM f WHERE a >= 10),
  q AS (SELECT lang, g, a, string_split(g, ' ') AS v FROM h WHERE m > 1),
  c AS (SELECT lang, g, a, 1 AS k, v[1] AS u, array_to_string(v[2:], ' ') AS o FROM q UNION ALL SELECT lang, g, a, 2, v[1] || ' ' || v[2], v[3] FROM q WHERE len(v) = 3),
  k AS (SELECT c.lang, c.g, c.a, c.k, l.a AS l, r.a AS r, (1000000 * c.a::HUGEINT * c.a) // (l.a::HUGEINT * r.a) AS score
    FROM c JOIN h l ON l.lang = c.lang AND l.g = c.u JOIN h r ON r.lang = c.lang AND r.g = c.o),
  m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
  o AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, unnest([v[1] || ' ' || v[2], v[2] || ' ' || v[3]]) AS g, a FROM q WHERE len(v) = 3) GROUP BY lang, g),
  d AS (SELECT m.* FROM m LEFT JOIN o ON o.lang = m.lang AND o.g = m.g WHERE longer IS NULL OR 100 * longer < 50 * m.a)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score::BIGINT AS score
FROM d JOIN s ON s.lang = d.lang QUALIFY rank <= 2000
"""
