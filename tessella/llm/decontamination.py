"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Numbers, units and names become typed placeholders, so a question whose parameters were changed has the same
canonical windows as before. Every window of five canonical words of a document is hash-joined with the windows of
the benchmark. For documents that share enough windows with an item, the windows' places are aligned in several ways:
by each offset, by each offset with the nearest places around it, and by first places. In one alignment with enough
windows each slot value of the item has to stand for one value in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, doc_columns, fresh, once

# Words that count as units.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "ounce", "ounces", "pound", "pounds", "ton", "tons", "ml", "l",
    "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees",
]

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
MARKS = ".,;:!?\"'()[]"
BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Most rows of a side that is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def bare(word: Column) -> Column:
    return F.lower(F.translate(word, MARKS, ""))


def plain_words(w: Column) -> Column:
    return F.transform(w, bare)


def canonical(w: Column, plain: Column, digits: Column) -> Column:
    """The words with placeholders: anything with a digit is a number; a word of UNITS a unit; a capitalised word that doesn't
    begin a sentence a name; others are plain: lower-cased without punctuation. digits: whether the text has any."""

    def one(x: Column, i: Column) -> Column:
        before = F.substring(w[F.greatest(i - 1, F.lit(0))], -1, 1)
        capital = ~F.ascii(x).between(97, 122) & (F.lower(F.substring(x, 1, 1)) != F.substring(x, 1, 1))
        return (
            F.when(digits & (F.translate(x, "0123456789", "") != x), NUMBER)
            .when((i > 0) & capital & ~before.isin(".", "!", "?", ":"), NAME)
            .when(plain[i].isin(UNITS), UNIT)
            .otherwise(plain[i])
        )

    return F.transform(w, one)


def windows(hashes: Column) -> Column:
    """Hashes of the runs of WINDOW canonical words, in order."""
    return F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(hashes[i + j] for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def _spelt(rows: DataFrame, key: str) -> DataFrame:
    """(key, w, c): the words and their canonical forms."""
    split = rows.select(key, words(F.col("text")).alias("w"), F.col("text").rlike("[0-9]").alias("digits"))
    plain = split.select(key, "w", "digits", once(plain_words(F.col("w"))).alias("plain"))
    return plain.select(key, "w", once(canonical(F.col("w"), F.col("plain"), F.col("digits"))).alias("c"))


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    hashes = _spelt(rows, key).select(key, once(F.transform("c", lambda x: F.xxhash64(x))).alias("h"))
    return hashes.select(key, once(windows(F.col("h"))).alias("win"))


def _detailed(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    hashed = _spelt(rows, key).select(key, "w", "c", once(F.transform("c", lambda x: F.xxhash64(x))).alias("h"))
    return hashed.select(key, F.col("w").alias(f"{prefix}_w"), F.col("c").alias(f"{prefix}_c"), once(windows(F.col("h"))).alias(f"{prefix}_win"))


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots): documents with an alignment of at least `coverage` of an item's distinct windows, whose slots agree.

    n_slots counts distinct (kind, item value) pairs of aligned placeholders; they agree if each has one value in the
    document. n_windows and n_slots are the largest of the alignments that agree. Items of fewer than WINDOW words are no evidence and match nothing, as do null and empty texts. Rows that
    repeat an id are judged each, and one leak is enough.
    """
    tmp = Scratch(docs.sparkSession, "leaks")
    own = doc_columns(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    wanted = tmp.write(_hashed(items, "item_id").select("item_id", F.explode(F.array_distinct("win")).alias("hash"), F.size(F.array_distinct("win")).alias("n")), "items")
    probes = _hashed(own, "doc_id").select("doc_id", F.explode("win").alias("hash"))
    shared = probes.join(_small(wanted), "hash").groupBy("doc_id", "item_id", "hash").agg(F.max("n").alias("n"))
    near = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("k"), F.max("n").alias("n")).filter(F.col("k") >= F.col("n") * coverage)
    near = tmp.write(near.select("doc_id", "item_id"), "near")
    pairs = tmp.write(_pairs(own, items, near), "pairs")
    exact = pairs.select(*TEXT, F.lit(0).alias("rule"), (F.col("q") - F.col("p")).alias("at"), *VALUES)
    judged = exact.unionByName(_nearest(pairs)).unionByName(_first(pairs)).groupBy(*KEY).agg(F.size(F.collect_set("hash")).alias("k"), F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    left = F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["kind"], x["item"]))))
    judged = judged.select("doc_id", "item_id", "k", "n", left.alias("left"), F.size("slots").alias("all")).filter((F.col("k") >= F.col("n") * coverage) & (F.col("left") == F.col("all")))
    return judged.groupBy("doc_id", "item_id").agg(F.max("k").cast("long").alias("n_windows"), F.max("n").cast("long").alias("item_windows"), F.max("left").cast("long").alias("n_slots"))


# Columns: one alignment of an item with a document's text, and what it holds.
TEXT = ["doc_id", "row", "item_id"]
KEY, VALUES = [*TEXT, "rule", "at"], ["hash", "n", "slots"]


def _pairs(own: DataFrame, items: DataFrame, near: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, p, q, hash, n, slots): every place of an item's window, p, with every place of it in a near document, q. row: a hash of the text."""

    def places(rows: DataFrame, key: str, *more: Column) -> DataFrame:
        return rows.select(key, *more, "w", "c", F.posexplode("win").alias("at", "hash"))

    def spelt(side: DataFrame, key: str) -> DataFrame:
        return _detailed(side, key, "x").select(key, F.col("x_w").alias("w"), F.col("x_c").alias("c"), F.col("x_win").alias("win"))

    part = lambda x: F.slice(x, F.col("at") + 1, WINDOW)
    near_items = spelt(items.join(_small(near.select("item_id").distinct()), "item_id"), "item_id")
    i = places(near_items, "item_id", F.size(F.array_distinct("win")).alias("n")).select("item_id", "n", "hash", F.col("at").alias("p"), part("c").alias("kinds"), plain_words(part("w")).alias("left"))
    near_docs = spelt(own.join(_small(near.select("doc_id").distinct()), "doc_id"), "doc_id")
    d = places(near_docs, "doc_id", F.xxhash64("w").alias("row")).select("doc_id", "row", "hash", F.col("at").alias("q"), part("w").alias("words"))
    both = d.join(_small(i), "hash").join(_small(near), ["doc_id", "item_id"])
    slots = F.zip_with("kinds", F.arrays_zip("left", plain_words(F.col("words")).alias("right")), lambda k, x: F.when(k.startswith("<"), F.struct(k.alias("kind"), x["left"].alias("item"), x["right"].alias("doc"))))
    return both.select(*TEXT, "p", "q", "hash", "n", F.filter(slots, lambda x: x.isNotNull()).alias("slots"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each offset `at`: each window of the item at its place nearest to that offset, an item's length away at most, so
    that words put in or left out don't break the alignment."""
    far, offset = F.greatest(F.col("n"), F.lit(WINDOW)), F.col("q") - F.col("p")
    block = F.floor(F.col("offset") / F.col("far"))
    placed = pairs.withColumn("far", far).withColumn("offset", offset)
    at = placed.select(*TEXT, F.col("offset").alias("at"), block.alias("block")).distinct()
    close = placed.select(*TEXT, "p", "far", "offset", *VALUES, F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    gap = F.abs(F.col("offset") - F.col("at"))
    joined = close.join(at, [*TEXT, "block"]).filter(gap <= F.col("far"))
    best = joined.groupBy(*TEXT, "at", "p").agg(F.min_by(F.struct(*VALUES), F.struct(gap, "offset")).alias("v"))
    return best.select(*TEXT, F.lit(1).alias("rule"), "at", "v.*")


def _first(pairs: DataFrame) -> DataFrame:
    """Each window of the item at its first place in the document: parts of an item in any order."""
    best = pairs.groupBy(*TEXT, "p").agg(F.min_by(F.struct(*VALUES), "q").alias("v"))
    return best.select(*TEXT, F.lit(2).alias("rule"), F.lit(0).alias("at"), "v.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, whose documents have no leak."""
    found = Scratch(docs.sparkSession, "leaked").write(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("doc_id").distinct(), "ids")
    name = fresh("leaked__", docs.columns)
    return docs.join(_small(found.withColumnRenamed("doc_id", name)), F.col(id_col).cast("long") == F.col(name), "left_anti")


SQL = rf"""
WITH src AS (SELECT 0 AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
  sp AS (SELECT side, id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM src),
  wd AS (SELECT side, id, i - 1 AS p, w[i] AS raw, lower(translate(w[i], '{MARKS.replace("'", "''")}', '')) AS plain, CASE WHEN i > 1 THEN right(w[i - 1], 1) END AS prev
    FROM (SELECT side, id, w, unnest(range(1, len(w) + 1)) AS i FROM sp)),
  cn AS (SELECT side, id, p, plain, CASE WHEN translate(raw, '0123456789', '') <> raw THEN '{NUMBER}'
    WHEN p > 0 AND lower(raw[1]) <> raw[1] AND prev NOT IN ('.', '!', '?', ':') THEN '{NAME}'
    WHEN plain IN ({", ".join(f"'{u}'" for u in UNITS)}) THEN '{UNIT}' ELSE plain END AS c FROM wd),
  wn AS (SELECT side, id, p, string_agg(c, ' ') OVER o AS win, count(*) OVER o AS len FROM cn WINDOW o AS (PARTITION BY side, id ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
  iw AS (SELECT id AS item_id, p, win, count(DISTINCT win) OVER (PARTITION BY id) AS n FROM wn WHERE side = 1 AND len = {WINDOW}),
  dw AS (SELECT id AS doc_id, win, p AS q FROM wn WHERE side = 0 AND len = {WINDOW}),
  cv AS (SELECT doc_id, item_id FROM dw JOIN iw USING (win) GROUP BY ALL HAVING count(DISTINCT win) >= max(n) * 0.5),
  al AS (SELECT doc_id, item_id, p, q, win, n, q - p AS off FROM dw JOIN iw USING (win) JOIN cv USING (doc_id, item_id)),
  ag AS (SELECT doc_id, item_id, 0 AS rule, off AS pos, p, q, win, n FROM al
    UNION ALL SELECT doc_id, item_id, 1, pos, p, arg_min(q, {{'gap': abs(off - pos), 'off': off}}), any_value(win), any_value(n)
      FROM al JOIN (SELECT DISTINCT doc_id, item_id, off AS pos FROM al) USING (doc_id, item_id) WHERE abs(off - pos) <= greatest(n, {WINDOW}) GROUP BY doc_id, item_id, pos, p
    UNION ALL SELECT doc_id, item_id, 2, 0, p, min(q), any_value(win), any_value(n) FROM al GROUP BY doc_id, item_id, p),
  ck AS (SELECT doc_id, item_id, rule, pos, count(DISTINCT win) AS k, max(n) AS n FROM ag GROUP BY ALL HAVING count(DISTINCT win) >= max(n) * 0.5),
  sl AS (SELECT DISTINCT doc_id, item_id, rule, pos, a.c AS kind, a.plain AS item, b.plain AS doc FROM ag JOIN ck USING (doc_id, item_id, rule, pos), range({WINDOW}) r(j), cn a, cn b
    WHERE a.side = 1 AND a.id = item_id AND a.p = ag.p + j AND b.side = 0 AND b.id = doc_id AND b.p = ag.q + j AND a.c LIKE '<%'),
  sc AS (SELECT doc_id, item_id, rule, pos, count(*) AS pairs, count(DISTINCT (kind, item)) AS slots FROM sl GROUP BY ALL)
SELECT doc_id, item_id, max(k)::BIGINT AS n_windows, max(n)::BIGINT AS item_windows, max(coalesce(slots, 0))::BIGINT AS n_slots
FROM ck LEFT JOIN sc USING (doc_id, item_id, rule, pos) WHERE coalesce(pairs, 0) = coalesce(slots, 0) GROUP BY doc_id, item_id
"""
