"""Winnowing fingerprints: in each window of consecutive k-gram hashes the least one is chosen, with its position.

All of it is DataFrame functions: a pattern rolls over the text and gives the k characters from each one on, which are
hashed at once. A hash and its position make one number, whose minimum over a window is the least hash and of equal ones the
rightmost; minima are built by doubling. Long texts are worked on in pieces that overlap by a window, so arrays stay short
whatever a text's length.

Any passage of k + window - 1 characters that two texts share gives both a common hash, and the positions say where.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh, once

#: Characters of a k-gram and k-grams of a window.
K, WINDOW = 16, 32
#: Characters of a piece of a text, besides the overlap.
PIECE = 1 << 12
#: Most stretches of ids, whose ends the driver sees and a plan holds.
STRETCHES = 1 << 14
#: Hashes and positions lie below these.
HASHES, REACH = 1 << 32, 1 << 31


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, inside of lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _minima(keys: Column, window: int) -> Column:
    """The least of each run of `window` keys, a power of two, by its first; runs at the end are shorter. Each step doubles the runs."""
    m = 1
    while m < window:
        shifted = lambda v: F.slice(v, F.lit(m + 1), F.greatest(F.size(v) - m, F.lit(0)))  # noqa: E731, B023
        keys = let(keys, lambda v: F.zip_with(v, shifted(v), lambda a, b: F.least(a, b)))  # noqa: B023
        m *= 2
    return keys


def chosen(text: Column, k: int = K, window: int = WINDOW, start: Column | int = 0, first: Column | bool = True) -> Column:
    """hash * REACH + (REACH - 1 - position) of what winnowing chooses in the text, in the order of positions.

    start: the position of the text's first character. first: whether a text shorter than a window still gets the least of what it has.
    """
    start, first = (x if isinstance(x, Column) else F.lit(x) for x in (start, first))
    overlap = k + window - 2
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{PIECE + overlap}}})).{{1,{PIECE}}}"), F.lit(1))

    def of_piece(piece: Column, i: Column) -> Column:
        # a text below k characters is one gram
        grams = F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
        grams = F.when(F.char_length(piece) < k, F.array(piece)).otherwise(grams) if k > 1 else grams
        # the position counts down from the top, so that of equal hashes the last has the least key
        top = F.lit(REACH - 1) - start.cast("long") - i.cast("long") * PIECE
        keys = F.transform(grams, lambda g, j: F.call_function("shiftleft", F.xxhash64(g).bitwiseAND(F.lit(HASHES - 1)), F.lit(31)).bitwiseOR(top - j))
        # windows that begin in this piece; only a text's first may be a short one
        whole = F.least(F.lit(PIECE), F.char_length(piece) - overlap)
        windows = F.greatest(whole, F.when(first & (i == 0), F.lit(1)).otherwise(F.lit(0)))
        minima = F.slice(_minima(keys, window), F.lit(1), windows)
        return F.when(windows > 0, F.array_distinct(minima)).otherwise(F.array().cast("array<long>"))

    return F.array_distinct(F.flatten(F.transform(pieces, of_piece)))


def position(key: Column) -> Column:
    return F.lit(REACH - 1) - key.bitwiseAND(F.lit(REACH - 1))


def gram_hash(key: Column) -> Column:
    return F.call_function("shiftright", key, F.lit(31))


def before(keys: Column, start: Column, window: int) -> Column:
    """Of a text's chosen keys those of the windows that begin before `start`; the window just before it lies within the text.

    Later windows choose at the same or a later position, so these are the keys up to that window's choice, and that is the least key in it.
    """
    inside = F.filter(keys, lambda x: position(x).between(start - 1, start + (window - 2)))
    return let(position(F.array_min(inside)), lambda last: F.filter(keys, lambda x: position(x) <= last))


def hashes(keys: Column) -> Column:
    """The distinct hashes of chosen keys."""
    return F.array_distinct(F.transform(keys, gram_hash))


def spelt(keys: Column) -> Column:
    """A fingerprint as text: each choice's number hash * 2**31 + 2**31 - 1 - position in hexadecimal digits, separated by blanks."""
    return F.array_join(F.transform(keys, lambda x: F.hex(x)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of all hashes of both (Jaccard); 1 for two without any."""
    return let(F.size(F.array_intersect(a, b)), lambda both: let(F.size(a) + F.size(b) - both, lambda all_: F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)))


def fingerprints(docs: DataFrame, *, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The docs' columns with prints: array of (hash, position) structs in the order of positions.

    Null and empty texts have none; a text of fewer than k characters is one gram, one of fewer than `window` grams one window.
    The new column's name gets underscores if it is taken.
    """
    out = fresh("prints", docs.columns)
    keys = chosen(F.coalesce(F.col(text_col).cast("string"), F.lit("")), k, window)
    as_struct = F.transform(keys, lambda x: F.struct(gram_hash(x).alias("hash"), position(x).cast("int").alias("position")))
    return docs.withColumn(out, as_struct)


def _splits(keys: DataFrame, bytes_each: int, least_bytes: int) -> list[tuple[int, int]]:
    """Some keys in ascending order, the greatest of all included, between which rows (key, bytes) have about bytes_each bytes, less where
    that gives fewer stretches than tasks. Drawn from a sample of at most some 64 * STRETCHES rows; empty without rows."""
    total, last = keys.agg(F.sum("bytes"), F.max("key")).first()
    if last is None:
        return []
    tasks = 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = min(STRETCHES, max(-(-total // bytes_each), min(tasks, total // least_bytes), 1))
    times = F.floor(F.col("bytes") * (32 * parts / total) + F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / (1 << 30)).cast("int")
    drawn = keys.select("key", times.alias("times")).filter("times > 0").select("key", F.explode(F.sequence(F.lit(1), F.col("times"))))
    every = drawn.select("key", F.row_number().over(Window.orderBy("key")).alias("n")).filter("n % 32 = 0").select("key.*").distinct().collect()
    return sorted({(r.id, r.h) for r in every} | {(last.id, last.h)})


def with_next(docs: DataFrame, *, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bytes_each: int = 8 << 20, least_bytes: int = 1 << 18) -> DataFrame:
    """(doc_id, text, keys, next_text, next_keys) where the next document is the one that follows by descending id; the first follows the last.

    Null texts are empty. Equal ids follow by a hash of their texts, null ids come last; of rows with one id and text each
    follows another. Rows are dealt to stretches of ids by bytes, each sorted on its own: a stretch's greatest key is
    known, and its row is sent to the stretch above as well, where it comes last.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"))
    splits = _splits(own.select(key.alias("key"), (F.octet_length("text") + F.lit(64)).cast("long").alias("bytes")), bytes_each, least_bytes)
    n = max(len(splits), 1)
    ends = F.array(*(F.struct(F.lit(a).cast("long").alias("id"), F.lit(b).cast("long").alias("h")) for a, b in splits or [(0, 0)]))
    # stretch i has the keys above split i - 1, up to split i: how many splits are below a key, found by halving
    steps = F.array(*(F.lit(1 << b) for b in range(n.bit_length(), -1, -1)))
    stretch = F.aggregate(steps, F.lit(0), lambda at, step: F.when(at + step > n, at).when(F.element_at(ends, F.least(at + step, F.lit(n))) < F.col("key"), at + step).otherwise(at))
    placed = own.withColumn("key", key).withColumn("stretch", stretch)
    at = lambda stretch, guest: F.struct(stretch.alias("stretch"), F.lit(guest).alias("guest"))
    home, above = at(F.col("stretch"), 0), at((F.col("stretch") + 1) % n, 1)
    ends_here = F.element_at(ends, F.least(F.col("stretch") + 1, F.lit(n))) == F.col("key")
    dealt = placed.select("doc_id", "text", "key", F.explode(F.when(ends_here, F.array(home, above)).otherwise(F.array(home))).alias("to"))
    tasks = min(n, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    spread = dealt.select("doc_id", "text", "key", "to.*", (F.col("to.stretch") % tasks).alias("task")).repartitionById(tasks, "task").select("*", chosen(F.col("text"), k, window).alias("keys"))
    order = Window.partitionBy("task", "stretch").orderBy("guest", F.desc("key"))
    return spread.select("doc_id", "text", "keys", "guest", F.lead("text").over(order).alias("next_text"), F.lead("keys").over(order).alias("next_keys")).filter("guest = 0").drop("guest")


def compare_edits(docs: DataFrame, *, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of the next document (see with_next): doc_id, n_chars, edited_text,
    fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text's last floor(n_chars / 3) characters are the first as many (or all) of the next document. A window that lies in
    the part that stays, or in that of the next document, chooses what it chose there; only those across are winnowed again.
    """
    pairs = with_next(docs, k=k, window=window, id_col=id_col, text_col=text_col)
    n = F.char_length("text")
    cut = pairs.select("*", n.alias("n_chars"), (n - F.floor(n / 3)).cast("int").alias("stays"))
    edited = cut.select("*", F.concat(F.substring("text", F.lit(1), F.col("stays")), F.substring("next_text", F.lit(1), F.col("n_chars") - F.col("stays"))).alias("edited_text"))
    # windows that begin before `again` lie in the part that stays, those from `stays` on in the part of the next text
    reach = k + window - 2
    again, taken = F.greatest(F.col("stays") - reach, F.lit(0)), F.least(F.col("n_chars") - F.col("stays"), F.char_length("next_text"))
    placed = edited.select("*", again.alias("again"), taken.alias("taken"))
    none = F.array().cast("array<long>")
    early = F.when(F.col("again") > 0, before(F.col("keys"), F.col("again"), window)).otherwise(none)
    between = chosen(F.substring("edited_text", F.col("again") + 1, F.col("stays") - F.col("again") + reach), k, window, start=F.col("again"), first=F.col("again") == 0)
    late = F.when(F.col("taken") > reach, F.transform(before(F.col("next_keys"), F.col("taken") - reach, window), lambda x: x - F.col("stays"))).otherwise(none)
    both = placed.select("*", once(F.array_distinct(F.concat(early, between, late))).alias("edited_keys"))
    own = both.select("*", once(hashes(F.col("keys"))).alias("own"))
    return own.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_text",
        spelt(F.col("keys")).alias("fingerprint"),
        spelt(F.col("edited_keys")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_keys"))).alias("near_edited"),
        likeness(F.col("own"), hashes(F.col("next_keys"))).alias("near_next"),
    )
