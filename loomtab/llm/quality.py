"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text gives a vector of transformed statistics (sizes, shares of character classes, word
shapes, repetition).  Class means and covariances come from sums over all labelled rows of the
training folds; each covariance is shrunk towards the pooled one and towards its diagonal, and is
kept as its Cholesky factor.  The score is the posterior of label 1 from the difference of the two
Mahalanobis log-densities.

Defined cases: null or empty text has the statistics of an empty text and gets a score like any
other; rows with a null doc_id are scored and have no label; repeated rows are scored each; labels
that are null or not 0 or 1 are left out; with labels of one class only (or none) every score is
that class's smoothed share; an empty table gives no rows; other columns are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, pieces, span_hashes, written

FOLDS = 5
#: Shrinkage of a class's covariance towards the pooled one, and then towards its own diagonal.
POOLED, DIAGONAL = 0.35, 0.1
#: Standardised statistics are cut here, so that no single one decides alone.
CUT = 5.0
THRESHOLD = 0.3
CHUNK_CHARS = 500_000

_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _MARK, _SYMBOL, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[:128] = _SYMBOL
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = _LOWER, _UPPER, _DIGIT
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = _BLANK, _LINE
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = _MARK

NAMES = (
    ["log_bytes", "log_words", "log_lines", "words_per_line", "word_mean", "word_spread", "word_longest"]
    + ["upper", "digit", "mark", "symbol", "other"]
    + ["ends_symbol", "ends_mark", "no_letter", "distinct_words", "repeated_lines"]
)


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, NAMES) transformed statistics; shares go through the arcsine of their root, sizes through log."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = np.cumsum(size + 1) - size - 1
    kind = _CLASS[data]
    counts = np.stack([np.add.reduceat(kind == c, begin, dtype=np.int64) for c in range(8)], 1).astype(float) if len(texts) else np.zeros((0, 8))
    counts[:, _LINE] -= 1  # the joint
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = (kind != _BLANK) & (kind != _LINE)
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(begin, starts, "right") - 1
    n = len(texts)
    words = np.bincount(doc, minlength=n).astype(float)
    length = (ends - starts).astype(float)
    per = np.maximum(words, 1)
    mean = np.bincount(doc, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(doc, length * length, n) / per - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    last = kind[ends - 1]
    letters = np.concatenate([[0], np.cumsum((kind == _LOWER) | (kind == _UPPER) | (kind == _OTHER))])
    bare = letters[ends] == letters[starts]
    hashes = span_hashes(data, starts, ends)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(d[new], minlength=n)
    lines = counts[:, _LINE] + 1
    unlike = np.fromiter((len(set(t.split("\n"))) for t in texts), float, n)
    share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / np.maximum(of, 1), 0, 1)))
    of = lambda mask: np.bincount(doc[mask], minlength=n)
    columns = [np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(words / lines), mean, spread, np.log1p(longest)]
    columns += [share(counts[:, c], size) for c in (_UPPER, _DIGIT, _MARK, _SYMBOL, _OTHER)]
    columns += [share(of(last == _SYMBOL), words), share(of(last == _MARK), words), share(of(bare), words)]
    columns += [np.log1p(distinct) / np.log(2 + words), share(lines - unlike, lines)]
    return np.stack(columns, 1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text and with x (array of statistics)."""
    name = fresh(docs, "x")
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            x = statistics(texts)
            edges = np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(edges), pa.array(x.reshape(-1)))], [*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, schema + ", " * bool(schema) + f"`{name}` array<double>")


class Discriminant:
    """Two Gaussian classes with shrunk covariances, from counts, sums and sums of products."""

    def __init__(self, n: np.ndarray, total: np.ndarray, product: np.ndarray):
        self.prior = (n[1] + 1) / (n.sum() + 2)
        self.fitted = bool((n >= 2).all())
        if not self.fitted:
            return
        mean = total.sum(0) / n.sum()
        self.shift = mean
        spread = np.sqrt(np.maximum(np.diag(product.sum(0)) / n.sum() - mean * mean, 0))
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        means, covs = [], []
        for c in (0, 1):
            m = total[c] / n[c]
            cov = product[c] / n[c] - np.outer(m, m)
            means.append((m - mean) / self.scale)
            covs.append(cov / np.outer(self.scale, self.scale))
        pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
        self.parts = []
        for c in (0, 1):
            cov = (1 - POOLED) * covs[c] + POOLED * pooled
            cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts.append((means[c], np.linalg.inv(factor), np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.shift) / self.scale, -CUT, CUT)
        density = [-0.5 * (((z - m) @ inv.T) ** 2).sum(1) - logdet for m, inv, logdet in self.parts]
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all labelled rows of the training folds; only sums per class reach the driver."""
    good = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("label"))
    rows = stats.where(~held_out()).select("doc_id", "x").join(good, F.col("doc_id") == F.col("labelled"))
    k = len(NAMES)
    x = [F.col("x")[i] for i in range(k)]
    sums = [F.sum(c) for c in x] + [F.sum(x[i] * x[j]) for i in range(k) for j in range(i + 1)]
    n, total, product = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for row in rows.groupBy("label").agg(F.count("*"), *sums).collect():
        c = row[0]
        n[c], total[c] = row[1], row[2 : 2 + k]
        low = np.tril_indices(k)
        product[c][low] = row[2 + k :]
        product[c] = product[c] + np.tril(product[c], -1).T
    return Discriminant(n, total, product)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    stats = written(document_statistics(docs.select("doc_id", "text")), "statistics")
    model = fit(stats, labels)
    return _apply(stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _apply(stats: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            x = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(NAMES)))
            yield batch.set_column(at, "score", pa.array(model.score(x)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "x" else "score double" for f in stats.schema)
    return stats.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with the columns of ``docs``.

    The statistics of the labelled rows fit the model; the texts are then scored where they lie.
    """
    stats = written(document_statistics(docs.select("doc_id", "text")), "statistics")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            yield batch.filter(pa.array(model.score(statistics(texts)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
