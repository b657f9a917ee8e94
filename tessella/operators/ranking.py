"""Ranking, top-k, deduplication and sequence windows over trials and turns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row for each key: the first in order."""
    return numbered(df, by, order, "rank__").filter("rank__ = 1").drop("rank__")


def top_per_task(df: DataFrame, task: str, signature: Column, order: list, k: int) -> DataFrame:
    """The k best rows of each task, of rows with equal signatures the best alone."""
    once = first_of(df.withColumn("sig__", signature), [task, "sig__"], order)
    return numbered(once, [task], order, "rank__").filter(F.col("rank__") <= k).drop("rank__", "sig__")


def quality_score(reward: Column, bucket: Column, tools: Column, recovered: Column) -> Column:
    """Reward, a bonus for the bucket, one for compactness, less the share of recovered calls."""
    bonus = F.when(bucket == "evolve", 0.35).when(bucket == "fulleval", 0.10).otherwise(0.0)
    return reward + bonus + F.greatest(F.lit(0.0), 0.25 - 0.005 * tools) - F.when(tools > 0, 0.15 * recovered / tools).otherwise(0.0)


def compact_score(reward: Column, tools: Column, elapsed: Column) -> Column:
    """Reward with a sweet spot of 8 to 20 calls and of short runs; unknown or non-positive times change nothing."""
    calls = F.when(tools < 8, -0.20 * (8 - tools) / 8.0).when(tools <= 20, 0.10 * (tools - 8) / 12.0).otherwise(-0.40 * F.least(tools - 20, F.lit(40)) / 40.0)
    quick = F.when(elapsed <= 180, 0.10 * (1 - elapsed / 180.0)).when(elapsed <= 400, -0.05 * (elapsed - 180) / 220.0).otherwise(-(0.20 + 0.10 * F.least(elapsed - 400, F.lit(600.0)) / 600.0))
    return reward + calls + F.when(elapsed > 0, quick).otherwise(0.0)


def turn_pairs(turns: DataFrame, most: int = 8, least_chars: int = 4) -> DataFrame:
    """(conv_id, turn, prompt, response): every assistant turn of some length with all turns before it, the first `most` of each
    conversation. Turns later than the last kept one are left out before prompts are put together."""
    spoken = (F.col("role") == "assistant") & (F.length(F.trim("text")) >= least_chars)
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("k", F.count(F.when(spoken, 1)).over(w)).filter((F.col("k") < most) | ((F.col("k") == most) & spoken))
    said = F.concat_ws(": ", "role", "text")
    prior = F.collect_list(said).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("prompt", F.array_join(prior, "\n\n")).filter(spoken).select("conv_id", "turn", "prompt", F.col("text").alias("response"))


def oversample(df: DataFrame, weight: Column, most: int = 4) -> DataFrame:
    """Column `copy`: each row as often as its weight rounded half to even, between 1 and `most`."""
    copies = F.least(F.greatest(F.bround(weight).cast("int"), F.lit(1)), F.lit(most))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def recovery_slice(events: DataFrame, run: str, order: list[str], failed: Column, back: int = 4) -> DataFrame:
    """Events from `back` before the first failure of their run on; runs without a failure are left out."""
    w = Window.partitionBy(run).orderBy(*order)
    placed = events.withColumn("pos", F.row_number().over(w)).withColumn("failed__", failed)
    first = F.min(F.when(F.col("failed__"), F.col("pos"))).over(Window.partitionBy(run))
    return placed.withColumn("critical", first).filter(F.col("pos") >= F.col("critical") - back).drop("failed__")


def safe_prefix(events: DataFrame, run: str, order: list[str], acts: Column, failed: Column) -> DataFrame:
    """(run, segment, safe): segments begin with an action; one is safe if nothing up to the next action fails."""
    segment = F.count(F.when(acts, 1)).over(Window.partitionBy(run).orderBy(*order))
    return events.withColumn("segment", segment).filter("segment > 0").withColumn("failed__", failed).groupBy(run, "segment").agg((~F.bool_or("failed__")).alias("safe"))


def repeated_runs(events: DataFrame, run: str, order: list[str], fingerprint: str, warn: int = 3, stop: int = 5) -> DataFrame:
    """Column `level` (ok, warn, stop) by the number of equal fingerprints in a row up to this event."""
    w = Window.partitionBy(run).orderBy(*order)
    change = events.withColumn("new__", (~F.col(fingerprint).eqNullSafe(F.lag(fingerprint).over(w))) | (F.row_number().over(w) == 1))
    island = change.withColumn("island__", F.count(F.when(F.col("new__"), 1)).over(w))
    n = F.row_number().over(Window.partitionBy(run, "island__").orderBy(*order))
    return island.withColumn("streak", n).withColumn("level", F.when(F.col("streak") >= stop, "stop").when(F.col("streak") >= warn, "warn").otherwise("ok")).drop("new__", "island__")


def edit_hints(edits: DataFrame, run: str, path: str, order: list[str], soft: int, hard: int) -> DataFrame:
    """Column `hint`: edits of one path count up; at `hard` a hard hint comes and the count begins again."""
    n = F.row_number().over(Window.partitionBy(run, path).orderBy(*order))
    counted = edits.withColumn("count", F.pmod(n - 1, F.lit(hard)) + 1)
    return counted.withColumn("hint", F.when(F.col("count") == hard, "hard").when(F.col("count") >= soft, "soft"))


def budget_stop(events: DataFrame, run: str, order: list[str], cost: str, most: float) -> DataFrame:
    """Column `state` (ok, warn, stop) by the running cost against 0.8 and 1 times the most."""
    spent = F.sum(cost).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("spent", spent).withColumn("state", F.when(F.col("spent") >= most, "stop").when(F.col("spent") >= 0.8 * most, "warn").otherwise("ok"))


def trim_to_budget(turns: DataFrame, size: Column, budget: int) -> DataFrame:
    """The first turn of each conversation and the longest run of last turns that fits the budget with it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    placed = turns.withColumn("size__", size).withColumn("pos__", F.row_number().over(w)).withColumn("first__", F.first("size__").over(w))
    later = F.sum("size__").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("later__", later).filter((F.col("pos__") == 1) | (F.col("later__") + F.col("first__") <= budget)).select(*turns.columns)


def split_conversations(turns: DataFrame, size: str, budget: int, extra: int = 6) -> DataFrame:
    """The turns that pieces of conversations keep, with column `piece`, the place of its first turn.

    An odd last turn goes. Pairs of turns, each turn with `extra` on its size, are added up; one that would pass the budget closes the
    piece before it. It begins the next piece with its size counted, but one that is too long by itself is left out
    though its size counts on. A piece that no later pair closes counts only if it holds the last pair.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            for conv, part in rows.groupby("conv_id", sort=False, dropna=False):
                if held and not _alike(held[0]["conv_id"].iloc[0], conv):
                    yield _split_one(pd.concat(held), size, budget, extra)
                    held = []
                held.append(part)
        if held:
            yield _split_one(pd.concat(held), size, budget, extra)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.mapInPandas(work, T.StructType([*turns.schema.fields, T.StructField("piece", T.LongType())]))


def _alike(a: object, b: object) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _split_one(rows: pd.DataFrame, size: str, budget: int, extra: int) -> pd.DataFrame:
    sizes = (rows[size].to_numpy() + extra).tolist()
    pairs = len(sizes) // 2
    pieces, start, held = [], 0, 0
    for p in range(pairs):
        n = sizes[2 * p] + sizes[2 * p + 1]
        if held + n > budget:
            pieces.append((start, 2 * p))
            start, held = (2 * p + 2 if n > budget else 2 * p), 0
        elif p == pairs - 1:
            pieces.append((start, 2 * p + 2))
        held += n
    kept = [rows.iloc[a:b].assign(piece=a) for a, b in pieces if b > a]
    return pd.concat(kept) if kept else rows.iloc[:0].assign(piece=pd.Series(dtype="int64"))


def windows_of(messages: DataFrame) -> DataFrame:
    """Column `part`: `system` for a first message of the system, `active` for a last message of the user, `history` for the rest."""
    w = Window.partitionBy("conv_id")
    turn = F.struct("turn")
    first, last = F.min(turn).over(w) == turn, F.max(turn).over(w) == turn
    return messages.withColumn("part", F.when(first & (F.col("role") == "system"), "system").when(last & (F.col("role") == "user"), "active").otherwise("history"))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Advantages by the reverse recurrence over arrays of rewards and values; nothing follows the last step."""
    n = F.size(rewards)
    step = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("last"), F.lit(0.0).alias("next")),
        lambda acc, i: _gae_step(acc, F.element_at(rewards, (n - i).cast("int")), F.element_at(values, (n - i).cast("int")), gamma, lam),
        lambda acc: F.reverse(acc["out"]),
    )
    return F.when(n > 0, step).otherwise(F.array().cast("array<double>"))


def _gae_step(acc: Column, reward: Column, value: Column, gamma: float, lam: float) -> Column:
    now = reward + gamma * acc["next"] - value + gamma * lam * acc["last"]
    return F.struct(F.concat(acc["out"], F.array(now)).alias("out"), now.alias("last"), value.cast("double").alias("next"))


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean under a 0/1 mask; 0 where the mask is empty."""
    return F.coalesce(F.sum(value * mask) / F.nullif(F.sum(mask), F.lit(0)), F.lit(0.0))


#: Queries of one block that is broadcast, vectors and queries of one group that is compared by matrix products, and queries of one product.
QUERY_BLOCK, VECTOR_GROUP, QUERY_GROUP, QUERY_ROWS = 100_000, 16_384, 16_384, 256


def knn_novelty(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(key, novelty): mean cosine distance of each query to its k nearest others; 1.0 without any. A stated query set is held against
    all rows: groups of vectors against groups of queries by matrix products, of which each group keeps its k nearest. Vectors of
    another length than most, or with null or infinite components, are joined pair by pair."""
    q, o = queries.select(F.col(key).alias("q"), F.col(vector).alias("u")), vectors.select(F.col(key).alias("o"), F.col(vector).alias("v"))
    size = F.size("v")
    dims = o.groupBy(size.alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()  # a row for each length
    plain = lambda v: F.coalesce((F.size(v) == (dims.dims if dims else 0)) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))
    sizes = [df.agg(F.count("*"), F.coalesce(F.count_if(~plain(v)), F.lit(0))).first() for df, v in ((o, "v"), (q, "u"))]
    near = _nearest_by_products(o.filter(plain("v")), q.filter(plain("u")), k, sizes[0][0], sizes[1][0])
    if sizes[0][1]:
        near = near.union(_nearest_by_pairs(o.filter(~plain("v")), q, sizes[1][0]))
    if sizes[1][1]:
        near = near.union(_nearest_by_pairs(o.filter(plain("v")), q.filter(~plain("u")), sizes[1][1]))
    w = Window.partitionBy("q").orderBy("d", "o")
    mean = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("q").agg(F.avg("d").alias("novelty"))
    return q.select("q").join(mean, "q", "left").select(F.col("q").alias(key), F.coalesce("novelty", F.lit(1.0)).alias("novelty"))


def _nearest_by_pairs(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(q, o, d) of all pairs; queries in blocks that are small enough to be broadcast."""
    blocks = -(-n // QUERY_BLOCK)
    block = F.pmod(F.xxhash64("q"), F.lit(blocks))
    each = [vectors.join(F.broadcast(queries.filter(block == i)), F.col("q") != F.col("o")).select("q", "o", cosine_distance(F.col("u"), F.col("v")).alias("d")) for i in range(blocks)]
    return reduce(DataFrame.union, each)


def _nearest_by_products(vectors: DataFrame, queries: DataFrame, k: int, n: int, m: int) -> DataFrame:
    """(q, o, d) of each group's k nearest, or of more that tie; n and m: rows of both."""
    groups, blocks = max(1, -(-n // VECTOR_GROUP)), max(1, -(-m // QUERY_GROUP))
    part = lambda c, count: F.pmod(F.xxhash64(*c), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    o = vectors.filter("o is not null").select(part(("o", "v"), groups).alias("g"), every(blocks).alias("b"), "o", "v")
    q = queries.filter("q is not null").select(every(groups).alias("g"), part(("q", "u"), blocks).alias("b"), "q", "u")
    found = T.StructType([T.StructField("q", q.schema["q"].dataType), T.StructField("o", o.schema["o"].dataType), T.StructField("d", T.DoubleType())])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest_of_group(left, right, k)

    return o.groupBy("g", "b").cogroup(q.groupBy("g", "b")).applyInArrow(nearest, found)


def _nearest_of_group(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Products in single precision find the pairs that can be among a query's k nearest; their distances are then computed anew."""
    names, asked = (t.column(c).combine_chunks() for t, c in ((vectors, "o"), (queries, "q")))
    if not len(names) or not len(asked):
        return pa.table({"q": asked[:0], "o": names[:0], "d": pa.array([], pa.float64())})
    v, u = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1) for t, c in ((vectors, "v"), (queries, "u")))
    ids, wanted = names.to_numpy(zero_copy_only=False), asked.to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    own = [np.searchsorted(ids[order], wanted, side) for side in ("left", "right")]
    unit = [np.sqrt(_dots(x, x)) for x in (v, u)]
    flat = [n < 1e-100 for n in unit]  # such a vector may be near to all
    short_v, short_u = ((x / np.where(f, 1, n)[:, None]).astype(np.float32) for x, f, n in zip((v, u), flat, unit, strict=True))
    slack = (v.shape[1] + 8) * 2.0**-22
    width = max(1, len(v) // 256)
    heads = np.arange(0, len(v), width)
    rows: list[np.ndarray] = []
    for low in range(0, len(u), QUERY_ROWS):
        likeness = short_u[low : low + QUERY_ROWS] @ short_v.T
        likeness[:, flat[0]] = 1
        likeness[flat[1][low : low + QUERY_ROWS]] = 1
        for i in range(len(likeness)):
            likeness[i, order[own[0][low + i] : own[1][low + i]]] = -np.inf
        tops = np.maximum.reduceat(likeness, heads, axis=1)
        bar = np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] >= k else np.full(len(likeness), -2.0)
        at_u, at_v = np.nonzero(likeness >= np.maximum(bar - slack, -2)[:, None])
        at_u += low
        d = np.concatenate([_distances(u[at_u[i : i + 65_536]], v[at_v[i : i + 65_536]], unit[1][at_u[i : i + 65_536]], unit[0][at_v[i : i + 65_536]]) for i in range(0, len(at_u), 65_536)] or [np.empty(0)])
        best = np.lexsort((ids[at_v], d, at_u))
        place = np.arange(len(best)) - np.searchsorted(at_u, at_u[best])
        best = best[place < k]
        rows.append(np.stack([at_u[best], at_v[best], d[best].view(np.int64)]))
    at_u, at_v, d = np.concatenate(rows, axis=1)
    return pa.table({"q": asked.take(pa.array(at_u)), "o": names.take(pa.array(at_v)), "d": d.view(np.float64)})


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _distances(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    norm = norm_a * norm_b
    return np.where(norm > 0, 1 - _dots(a, b) / np.where(norm > 0, norm, 1), 0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 if a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0).cast("double"), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm).otherwise(0.0)


def complementary_pairs(changes: DataFrame, key: str, items: str) -> DataFrame:
    """Pairs (x, y) of candidates of which neither's items hold the other's, from rows with an array of items; a long list of candidates
    is compared by items."""
    if changes.count() > 10_000:
        return complementary_by_items(changes.select(key, F.explode(items).alias(items)), key, items)
    a, b = changes.select(F.col(key).alias("x"), F.col(items).alias("p")), changes.select(F.col(key).alias("y"), F.col(items).alias("q"))
    return a.join(F.broadcast(b), F.col("x") < F.col("y")).filter((F.size(F.array_except("p", "q")) > 0) & (F.size(F.array_except("q", "p")) > 0)).select("x", "y")


def complementary_by_items(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Pairs (x, y) of candidates of which neither's items hold the other's, from rows (key, item): both share fewer than each has."""
    own = rows.select(F.col(key).alias("x"), F.col(item).alias("item")).distinct()
    sizes = own.groupBy("x").agg(F.count("*").alias("p"))
    shared = own.join(own.withColumnRenamed("x", "y"), "item").filter("x < y").groupBy("x", "y").agg(F.count("*").alias("both"))
    pairs = sizes.join(sizes.select(F.col("x").alias("y"), F.col("p").alias("q")), F.col("x") < F.col("y")).join(shared, ["x", "y"], "left")
    return pairs.filter(F.coalesce("both", F.lit(0)) < F.least("p", "q")).select("x", "y")


def set_novelty(rows: DataFrame, candidates: DataFrame, key: str, item: str, k: int = 3) -> DataFrame:
    """(key, novelty): mean cosine distance of each candidate's items, as a set, to its k nearest other candidates'; 0 to or from one
    without items, 1.0 without others. rows: (key, item). The candidates are a short list; their items may be many."""
    own = rows.select(F.col(key).alias("x"), F.col(item).alias("item")).distinct()
    size = candidates.select(F.col(key).alias("x")).distinct().join(own.groupBy("x").agg(F.count("*").alias("n")), "x", "left").select("x", F.coalesce("n", F.lit(0)).alias("n"))
    shared = own.join(own.withColumnRenamed("x", "y"), "item").filter("x <> y").groupBy("x", "y").agg(F.count("*").alias("both"))
    others = size.select(F.col("x").alias("y"), F.col("n").alias("m"))
    pairs = size.join(F.broadcast(others), F.col("x") != F.col("y")).join(shared, ["x", "y"], "left")
    distance = F.when((F.col("n") == 0) | (F.col("m") == 0), 0.0).otherwise(1 - F.coalesce("both", F.lit(0)) / F.sqrt(F.col("n").cast("double") * F.col("m")))
    near = pairs.select("x", "y", distance.alias("d")).withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy("d", "y"))).filter(F.col("place") <= max(1, k))
    return size.join(near.groupBy("x").agg(F.avg("d").alias("novelty")), "x", "left").select(F.col("x").alias(key), F.coalesce("novelty", F.lit(1.0)).alias("novelty"))


def parent_ranks(rows: DataFrame, candidates: DataFrame, key: str, item: str, k: int = 3) -> DataFrame:
    """candidates (key, mean, ...) with novelty, rank_score = mean * sqrt(novelty) and place, best first and ties by key."""
    found = candidates.join(set_novelty(rows, candidates, key, item, k), key).withColumn("rank_score", F.coalesce("mean", F.lit(0.0)) * F.sqrt("novelty"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank_score"), key)).cast("long"))  # a row for each candidate


def select_parents(rows: DataFrame, candidates: DataFrame, key: str, item: str, *, turn: int, explore_every: int = 3, tie: float = 0.0, most: int = 4, least_unique: int = 1, k: int = 3) -> DataFrame:
    """(key, place) of at most `most` parents of the next round, from candidates (key, mean, scores, round) and rows (key, item) solved.

    First the best by rank, or the most novel in every explore_every-th turn; then those whose mean ties with the highest, best
    first; then those of the latest round that solve least_unique items or more that the incumbent doesn't, most first. The
    incumbent has the highest mean, and of those the fewest scores. All ties go by key.
    """
    ranked = parent_ranks(rows, candidates, key, item, k)
    explore = explore_every > 0 and turn > 0 and turn % explore_every == 0
    primary = ranked.orderBy(*([F.desc("novelty"), key] if explore else ["place"])).limit(1).select(key, F.lit(0).alias("group"), F.lit(0.0).alias("order"))
    top = candidates.agg(F.max("mean").alias("top"), F.max("round").alias("latest"))
    ties = candidates.crossJoin(F.broadcast(top)).filter(F.col("mean") >= F.col("top") - max(0.0, tie)).select(key, F.lit(1).alias("group"), (-F.col("mean")).alias("order"))
    incumbent = candidates.orderBy(F.desc("mean"), "scores", key).limit(1).select(F.col(key).alias("best"))
    solved = rows.select(key, item).distinct()
    known = solved.join(F.broadcast(incumbent), F.col(key) == F.col("best"), "left_semi").select(item)
    unique = solved.join(known, item, "left_anti").groupBy(key).agg(F.count("*").alias("gained")).filter(F.col("gained") >= max(1, least_unique))
    extra = candidates.crossJoin(F.broadcast(top)).filter("round = latest").join(unique, key).select(key, F.lit(2).alias("group"), (-F.col("gained").cast("double")).alias("order"))
    first = primary.union(ties).union(extra).groupBy(key).agg(F.min(F.struct("group", "order")).alias("m"))
    place = F.row_number().over(Window.orderBy("m.group", "m.order", key)).cast("long")  # a row for each candidate
    return first.select(key, place.alias("place")).filter(F.col("place") <= max(1, most))


def unique_counts(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, unique): for each candidate a map from every other candidate to the number of items that it has and the other doesn't."""
    own = rows.select(F.col(key).alias("x"), F.col(item).alias("item")).distinct()
    size = own.groupBy("x").agg(F.count("*").alias("n"))
    both = own.join(own.withColumnRenamed("x", "y"), "item").filter("x <> y").groupBy("x", "y").agg(F.count("*").alias("both"))
    pairs = size.join(F.broadcast(size.select(F.col("x").alias("y"))), F.col("x") != F.col("y")).join(both, ["x", "y"], "left")
    return pairs.groupBy("x").agg(F.map_from_entries(F.collect_list(F.struct("y", (F.col("n") - F.coalesce("both", F.lit(0))).alias("gained")))).alias("unique")).withColumnRenamed("x", key)


def regression_gate(rounds: DataFrame, campaign: str, tolerance: float) -> DataFrame:
    """(campaign, round, verdict, best_round) of rows (campaign, round, config, score, unique): a fold over the rounds of each campaign.

    skip: the tolerance is negative or the round has no score. accept: the first scored round, or a score of at least the bar less
    the tolerance; at the bar itself the round is the new best. pivot: below it, but `unique` (a map from rounds to counts)
    has items that the best round doesn't solve; the best stays. reject: else, and the best is what to go back to. The bar is
    the mean of all earlier scores of the best round's configuration.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        best, scores, out = None, {}, []
        for r in rows.sort_values("round").itertuples():
            score = None if pd.isna(r.score) else float(r.score)
            if tolerance < 0 or score is None:
                verdict = "skip"
            elif best is None:
                verdict, best = "accept", r
            else:
                seen = scores[best.config]
                bar, unique = sum(seen) / len(seen), dict(r.unique if r.unique is not None else {})
                verdict = "accept" if score >= bar - tolerance else "pivot" if unique.get(best.round, 0) > 0 else "reject"
                best = r if score >= bar else best
            if score is not None:
                scores.setdefault(r.config, []).append(score)
            out.append((getattr(r, campaign), r.round, verdict, None if best is None else best.round))
        return pd.DataFrame(out, columns=[campaign, "round", "verdict", "best_round"]).astype({"best_round": "Int64"})

    kind = {f.name: f.dataType.simpleString() for f in rounds.schema}
    return rounds.groupBy(campaign).applyInPandas(fold, f"{campaign} {kind[campaign]}, round {kind['round']}, verdict string, best_round long")


def failure_guard(calls: DataFrame, run: str, step: str, failed: Column, limit: int = 3) -> DataFrame:
    """(run, step, pending, warned) for every step: how many tool calls of the step before it failed, and whether they reach the limit."""
    steps = calls.groupBy(run, step).agg(F.count_if(F.coalesce(failed, F.lit(False))).alias("n"))
    pending = F.coalesce(F.lag("n").over(Window.partitionBy(run).orderBy(step)), F.lit(0))
    return steps.select(run, step, pending.alias("pending")).withColumn("warned", F.col("pending") >= limit)


# A bonus for each successful call, penalties for failed ones and for a loop, caps of both sums, and bounds below zero.
BONUS, PENALTY, LOOP_PENALTY, BONUS_CAP, PENALTY_CAP, FLOOR, CEILING = 0.05, 0.10, 0.20, 0.30, 0.50, -1.10, -0.60


def shaped_reward(steps: DataFrame, run: str, step: str, terminal: str) -> DataFrame:
    """(run, reward) of rows (run, step, successes, failures, looped, terminal): the terminal reward with the capped sums of the steps'
    bonuses and of their penalties. A loop counts in the last step. Below zero the result stays within FLOOR and CEILING."""
    last = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step))) == 1
    delta = F.col("successes") * BONUS - F.col("failures") * PENALTY - F.when(last & F.col("looped"), LOOP_PENALTY).otherwise(0.0)
    sums = steps.withColumn("delta__", delta).groupBy(run).agg(F.first(terminal).alias("t"), F.sum(F.greatest("delta__", F.lit(0.0))).alias("up"), F.sum(F.greatest(-F.col("delta__"), F.lit(0.0))).alias("down"))
    score = F.col("t") + F.least("up", F.lit(BONUS_CAP)) - F.least("down", F.lit(PENALTY_CAP))
    return sums.select(run, F.when(F.col("t") < 0, F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), score))).otherwise(score).alias("reward"))


def trim_with_tools(turns: DataFrame, conv: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Messages that stay when the oldest but the first go until the rest fits the budget; a call's results go with it.

    Reads role, calls (array of call ids) and call_id. Results that follow an assistant's message directly and belong to its calls form
    one group with it; any other result, those of the first message included, is a group of its own.
    """
    w, back = Window.partitionBy(conv).orderBy(*order), Window.partitionBy(conv).orderBy(*(F.desc(c) for c in order))
    so_far = (Window.unboundedPreceding, 0)
    tool = F.col("role").eqNullSafe("tool")
    placed = turns.withColumn("pos__", F.row_number().over(w)).withColumn("run__", F.sum(F.when(tool, 0).otherwise(1)).over(w.rowsBetween(*so_far)))
    run = Window.partitionBy(conv, "run__").orderBy("pos__")
    calls = F.when((F.first("role").over(run) == "assistant") & (F.first("pos__").over(run) > 1), F.first("calls").over(run))
    own = placed.withColumn("own__", F.coalesce(tool & F.array_contains(calls, F.col("call_id")), F.lit(False)))
    lost = F.sum(F.when(tool & ~F.col("own__"), 1).otherwise(0)).over(run.rowsBetween(*so_far))
    grouped = own.withColumn("own__", F.col("own__") & (lost == 0)).withColumn("group__", F.sum(F.when(F.col("own__"), 0).otherwise(1)).over(w.rowsBetween(*so_far)))
    later = grouped.withColumn("later__", F.sum(size).over(back.rowsBetween(*so_far))).withColumn("first__", F.first(size).over(w))
    whole = F.max("later__").over(Window.partitionBy(conv, "group__"))
    return later.withColumn("later__", whole).filter((F.col("pos__") == 1) | (F.col("later__") + F.col("first__") <= budget)).select(*turns.columns)


def trim_at_ratio(turns: DataFrame, conv: str, order: list[str], size: str, window: int, ratio: float = 0.8) -> DataFrame:
    """`trim_with_tools` down to a share of the context window."""
    return trim_with_tools(turns, conv, order, size, int(window * ratio))


def mini_eval(candidates: DataFrame, results: DataFrame, probes: DataFrame, max_regressions: int, keep: int) -> DataFrame:
    """(idx, gained, regressed, score, outcome) of each candidate: `regressed` if it breaks more than so many tasks that the parent solved,
    else `kept` for the best by score, then idx, and `cut` for others. Without results a candidate has no score and comes last.

    candidates: (idx); results: (idx, task, solved); probes: (task, parent), each task once. Tasks without a result count as not solved.
    """
    total = probes.agg(F.count("*").alias("n"), F.count_if("parent").alias("p"))  # one row
    solved = results.groupBy("idx", "task").agg(F.max("solved").alias("solved")).join(probes, "task", "left")
    s, parent = F.coalesce("solved", F.lit(False)), F.col("parent")
    sums = solved.groupBy("idx").agg(F.count_if(s & parent.isNotNull()).alias("hits"), F.count_if(s & F.coalesce(parent, F.lit(False))).alias("both"))
    each = candidates.join(sums, "idx", "left").crossJoin(F.broadcast(total))
    counted = each.select("idx", (F.col("hits") - F.col("both")).alias("gained"), (F.col("p") - F.col("both")).alias("regressed"), (F.col("hits") / F.col("n")).alias("score"))
    dropped = F.coalesce(F.col("regressed") > max_regressions, F.lit(False))
    place = F.row_number().over(Window.partitionBy("dropped__").orderBy(F.desc(F.coalesce("score", F.lit(-1.0))), "idx"))  # a row for each candidate of a round
    judged = counted.withColumn("dropped__", dropped).withColumn("place__", place)
    return judged.select("idx", "gained", "regressed", "score", F.when(F.col("dropped__"), "regressed").when(F.col("place__") <= keep, "kept").otherwise("cut").alias("outcome"))


def structural_screen(candidates: DataFrame, rejected: DataFrame, idx: str, signature: Column, empty: Column) -> DataFrame:
    """(idx, outcome): `empty`, `rejected` for a signature in rejected(signature), `duplicate` of an earlier one, or `kept`.

    The first of a signature is an aggregate that tasks combine before the shuffle, so a very common one is no hot group.
    """
    signed = candidates.select(F.col(idx), F.coalesce(empty, F.lit(True)).alias("empty__"), signature.alias("signature"))
    first = signed.filter("not empty__").groupBy("signature").agg(F.min(idx).alias("first__"))
    known = first.join(rejected.select("signature", F.lit(True).alias("known__")).distinct(), "signature", "left")
    judged = signed.join(known, "signature", "left")
    outcome = F.when(F.col("empty__"), "empty").when(F.col("known__"), "rejected").when(F.col(idx) > F.col("first__"), "duplicate").otherwise("kept")
    return judged.select(idx, outcome.alias("outcome"))


def recovery_pairs(turns: DataFrame, conv: str, order: list[str], size: str, response: Column, critical: str, most_pairs: int, most_chars: int, back: int = 4) -> DataFrame:
    """(conv, turn_index, context_from, chars): assistant turns after the critical one, each with the context that fits the budget.

    Positions count from 0. All earlier messages are the context, or those from `back` before the critical one on, if all of them are too long; a turn
    that is too long even so, or whose response is shorter than 4 characters, is left out. The first most_pairs of a conversation stay.
    critical: a column with the position, the same in all rows of a conversation; null: no pairs. size: characters of a message as rendered.
    """
    w = Window.partitionBy(conv).orderBy(*order)
    whole = Window.partitionBy(conv)
    placed = turns.withColumn("pos__", F.row_number().over(w) - 1).withColumn("before__", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.greatest(F.col(critical) - back, F.lit(0))
    cut = placed.withColumn("start__", start).withColumn("cut__", F.max(F.when(F.col("pos__") == F.col("start__"), F.col("before__"))).over(whole))
    said = cut.filter((F.col("role") == "assistant") & (F.col("pos__") > F.col(critical)) & (F.length(F.trim(response)) >= 4))
    full, short = F.col("before__") + F.col(size), F.col("before__") - F.col("cut__") + F.col(size)
    fitting = said.withColumn("all__", full <= most_chars).filter(F.col("all__") | (short <= most_chars))
    ranked = fitting.withColumn("k__", F.row_number().over(Window.partitionBy(conv).orderBy("pos__"))).filter(F.col("k__") <= most_pairs)
    return ranked.select(conv, F.col("pos__").alias("turn_index"), F.when(F.col("all__"), 0).otherwise(F.col("start__")).alias("context_from"), F.when(F.col("all__"), full).otherwise(short).alias("chars"))


def loop_levels(calls: DataFrame, run: str, order: list[str], fingerprint: str, name: str, messages: str, *, kept: int = 12, warn: int = 3, stop: int = 5, name_warn: int = 8, drop: int = 5) -> DataFrame:
    """Columns `streak`, `name_streak` and `level`: equal fingerprints and equal names in a row up to this call.

    `stop` from `stop` equal fingerprints on, else `warn` from `warn` on, else `name` from `name_warn` equal names on, else `ok`. Only the last `kept` calls are
    remembered, so no streak is longer than kept + 1. A call without a fingerprint (null or empty) ends both streaks, and so does a number of messages that has fallen by `drop`
    since the call before.
    """
    w = Window.partitionBy(run).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    none = F.coalesce(F.col(fingerprint) == "", F.lit(True))
    fallen = F.coalesce((F.lag(messages).over(w) > 0) & (F.lag(messages).over(w) - F.col(messages) >= drop), F.lit(False))
    placed = calls.withColumn("none__", none).withColumn("fallen__", fallen)
    for column, own in (("streak", fingerprint), ("name_streak", name)):
        new = F.col("none__") | F.col("fallen__") | F.coalesce(F.lag("none__").over(w), F.lit(True)) | ~F.col(own).eqNullSafe(F.lag(own).over(w))
        placed = placed.withColumn("new__", new).withColumn("island__", F.count_if("new__").over(so_far))
        length = F.row_number().over(Window.partitionBy(run, "island__").orderBy(*order))
        placed = placed.withColumn(column, F.when(F.col("none__"), 0).otherwise(F.least(length, F.lit(kept + 1))))
    level = F.when(F.col("streak") >= stop, "stop").when(F.col("streak") >= warn, "warn").when(F.col("name_streak") >= name_warn, "name").otherwise("ok")
    return placed.withColumn("level", level).drop("none__", "fallen__", "new__", "island__")


def safe_turns(turns: DataFrame, run: str, order: list[str], failed: Column, response: Column, fraction: float, most: int) -> DataFrame:
    """(run, turn_index) of assistant turns with calls among the first part of a run, at least its first message, whose results up to the
    next assistant turn are some and none failed. Responses have 4 characters or more; the first `most` of a run stay. Positions count from 0.

    Reads role and calls (an array). failed: of a result; null: no."""
    w = Window.partitionBy(run).orderBy(*order)
    placed = turns.withColumn("pos__", F.row_number().over(w) - 1).withColumn("n__", F.count("*").over(Window.partitionBy(run)))
    speaks, result = F.coalesce(F.col("role") == "assistant", F.lit(False)), F.coalesce(F.col("role") == "tool", F.lit(False))
    cut = placed.withColumn("part__", F.count_if(speaks).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy(run, "part__")
    seen = cut.withColumn("results__", F.count_if(result).over(part)).withColumn("failed__", F.count_if(result & F.coalesce(failed, F.lit(False))).over(part))
    early = F.col("pos__") < F.greatest(F.lit(1), F.floor(F.col("n__") * fraction))
    fit = seen.filter(speaks & early & (F.size("calls") > 0) & (F.col("results__") > 0) & (F.col("failed__") == 0) & (F.length(F.trim(response)) >= 4))
    return fit.withColumn("k__", F.row_number().over(w)).filter(F.col("k__") <= most).select(run, F.col("pos__").alias("turn_index"))
