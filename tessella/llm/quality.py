"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a shrinkage covariance, summed up by Spark over all labelled rows; the driver sees one row
of sums per class. A document's score is the logistic of the log-density difference of the two Gaussians plus the
log prior odds, taken from Mahalanobis distances with Cholesky factors that are computed once and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, mix, slices, tidy, window_hashes, word_table

STATISTICS = ("log_words", "log_word_length", "upper", "bang", "symbol", "digit", "newline", "distinct_words", "adjacent_repeats", "distinct_5grams", "log_ratio", "longest_line", "upper_words", "non_letter_words")


def _share(doc: np.ndarray, weight: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    return np.bincount(doc, weights=weight, minlength=n) / np.maximum(total, 1)


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    keys = np.sort(hashes ^ mix(doc.astype(np.uint64)))
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    order = np.argsort(hashes ^ mix(doc.astype(np.uint64)))
    return np.bincount(doc[order][first], minlength=n)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text, transformed to be nearer to normal: logarithms of sizes, square roots of counts a word,
    angles of shares. Those of empty texts are zero."""
    n = len(texts)
    hashes, doc, starts, ends = word_table(texts)
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    words = np.bincount(doc, minlength=n)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, begin[:-1], dtype=np.int64)  # with the blank behind each text, which no mask has

    upper = (data >= 65) & (data <= 90) | (data == 0xC3) & (np.roll(data, -1) < 0x9F)
    lower = (data >= 97) & (data <= 122) | (data == 0xC3) & (np.roll(data, -1) >= 0x9F)
    letter, bang, digit, newline = upper | lower, data == 33, (data >= 48) & (data <= 57), data == 10
    symbol = (data > 32) & (data < 127) & ~letter & ~digit & ~np.isin(data, np.frombuffer(b".,!", dtype=np.uint8))
    letters = np.maximum(count(letter), 1)
    caps, all_letters = (np.concatenate([[0], np.cumsum(m, dtype=np.int32)]) for m in (upper, letter))
    word_caps, word_letters = caps[ends] - caps[starts], all_letters[ends] - all_letters[starts]
    same = np.zeros(len(doc))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    grams = window_hashes(hashes, 5)
    inside = doc[: len(grams)] == doc[4:] if len(grams) else np.empty(0, dtype=bool)
    gram_doc = doc[: len(grams)][inside]
    n_grams = np.bincount(gram_doc, minlength=n)
    packed = _packed(texts)
    cut = np.flatnonzero(newline)
    bounds = np.unique(np.concatenate([cut, begin[1:] - 1]))
    gaps = np.diff(np.concatenate([[-1], bounds]))
    longest = np.zeros(n)
    np.maximum.at(longest, np.searchsorted(begin[1:], bounds, side="right").clip(max=n - 1), gaps)
    root, angle = np.sqrt, lambda share: np.arcsin(np.sqrt(np.clip(share, 0, 1)))
    return np.column_stack([
        np.log1p(words),
        np.log1p(size / np.maximum(words, 1)),
        angle(count(upper) / letters),
        root(count(bang) / np.maximum(words, 1)),
        angle(count(symbol) / np.maximum(size, 1)),
        angle(count(digit) / np.maximum(size, 1)),
        root(count(newline) / np.maximum(words, 1)),
        _distinct(doc, hashes, n) / np.maximum(root(words), 1) / 10,
        angle(_share(doc, same, n, words)),
        angle(_distinct(gram_doc, grams[inside], n) / np.maximum(n_grams, 1)),
        np.log((packed + 20) / (size + 20)),
        np.log1p(longest),
        angle(_share(doc, ((word_caps >= 2) & (word_caps == word_letters)).astype(float), n, words)),
        angle(_share(doc, (word_letters == 0).astype(float), n, words)),
    ])


def _packed(texts: list[bytes]) -> np.ndarray:
    """Compressed sizes: repeated passages make a text much smaller."""
    squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=False)
    return np.fromiter((len(squeeze.compress(x)) for x in texts), dtype=np.int64, count=len(texts))


@dataclass(frozen=True)
class Gaussian:
    """One class: its mean, the Cholesky factor of its shrunk covariance and its number of rows. The factor is inverted once here,
    so that a Mahalanobis distance is one product."""

    mean: np.ndarray
    factor: np.ndarray
    rows: float
    inverse: np.ndarray = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "inverse", np.tril(np.linalg.inv(self.factor)))


def _log_density(g: Gaussian, x: np.ndarray) -> np.ndarray:
    z = (x - g.mean) @ g.inverse.T
    return -0.5 * (z**2).sum(axis=1) - np.log(np.diag(g.factor)).sum() + np.log(g.rows)


def probability(model: dict[int, Gaussian], x: np.ndarray) -> np.ndarray:
    """P(label 1). With rows of one label alone it is that label; with none at all it is 0.5."""
    if len(model) < 2:
        return np.full(len(x), float(next(iter(model))) if model else 0.5)
    return np.round(1 / (1 + np.exp(np.clip(_log_density(model[0], x) - _log_density(model[1], x), -50, 50))), 6)


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), len(STATISTICS))


def _encoded(column: pa.Array) -> Iterator[list[bytes]]:
    for start, stop in slices(column):
        yield [(x or "").encode("utf-8", "surrogatepass") for x in column[start:stop].to_pylist()]


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats): the statistics of every whole text as packed doubles. Null text counts as empty."""

    @tidy

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.astype("<f8").tobytes() for texts in _encoded(batch.column(1)) for x in statistics(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, stats binary")


def fit(stats: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", shrinkage: float = 0.05) -> dict[int, Gaussian]:
    """The class Gaussians from every row that has a label of 0 or 1; other labels and nulls are left out."""
    d = len(STATISTICS)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    upper = np.triu_indices(d + 1)

    @tidy

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros((d + 1, d + 1)) for c in (0, 1)}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), _stack(batch.column("stats"))])
            y = np.asarray(batch.column("label"))
            for c in total:
                total[c] += x[y == c].T @ x[y == c]
        for c, m in total.items():
            k = len(upper[0])
            yield pa.RecordBatch.from_arrays([pa.array([c] * k, pa.int32()), pa.array(np.arange(k), pa.int32()), pa.array(m[upper])], names=["label", "cell", "value"])

    # per task and class the cells of one symmetric matrix; the driver gets two matrices
    cells = stats.join(known, "doc_id").select("stats", "label").mapInArrow(sums, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    model = {}
    for c in (0, 1):
        m = np.zeros((d + 1, d + 1))
        for row in cells:
            if row.label == c:
                m[upper[0][row.cell], upper[1][row.cell]] = row.value
        m += np.triu(m, 1).T
        n = m[0, 0]
        if n >= 1:
            mean = m[0, 1:] / n
            cov = m[1:, 1:] / n - np.outer(mean, mean)
            cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
            model[c] = Gaussian(mean, np.linalg.cholesky(cov), n)
    return model


def score(stats: DataFrame, model: dict[int, Gaussian]) -> DataFrame:
    """(doc_id, score) from a table of statistics."""

    @tidy

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(model, _stack(batch.column("stats"))))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(work, "doc_id long, score double")


def keep_good(docs: DataFrame, model: dict[int, Gaussian], *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least the threshold, with all their columns and in one pass without a shuffle."""

    @tidy

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [probability(model, statistics(texts)) >= threshold for texts in _encoded(batch.column(text_col))]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.empty(0, dtype=bool)))

    return docs.mapInArrow(work, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = 0.05) -> DataFrame:
    """(doc_id, score) of every row of docs, fitted on `labels`. Repeated ids: each row is scored, and learnt from, by itself."""
    stats = Scratch(docs.sparkSession, "quality").write(document_statistics(docs, id_col=id_col, text_col=text_col), "stats")
    return score(stats, fit(stats, labels, label_col=label_col, id_col=id_col, shrinkage=shrinkage))
