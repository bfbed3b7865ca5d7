"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on at most SAMPLE rows (those whose ids hash lowest); every row is indexed in
every tree.  A query walks all trees through one priority queue that orders the untaken branches of
the whole forest by their margin, until it has its PROBES of the leaves.  Each leaf meets its queries in blocks
of at most BLOCK rows, whatever its size, and yields the block's nearest for each query; a query's
best over all its leaves are ranked on exact double-precision cosines of the original vectors.

Defined cases: vectors that are null, of zero length, or hold null or non-finite components take no
part; nor do those of another dimension than the most frequent one; of rows with the same id and
vector one counts; a query is never its own neighbour, nor are rows with its id; ties go to the
smaller id; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

SAMPLE, TREES, LEAF, BLOCK = 32_768, 12, 128, 4096
#: Part of all leaves of the forest that a query opens.  Vectors without any structure need this
#: much for a recall over 0.9 in tables of every size; clustered ones have that with a tenth of it.
PROBES = 1 / 10
SEED = 11
#: Queries that meet a block in one product.
TOGETHER = 1024


class Forest:
    """Perfectly balanced trees on the sample: every inner node has a direction and a threshold."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        rng = np.random.default_rng(SEED)
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(unit) / leaf)))))
        inner = (1 << self.depth) - 1
        self.ways = np.zeros((trees, inner, unit.shape[1] if unit.ndim == 2 else 0), np.float32)
        self.cuts = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            groups = [np.arange(len(unit))]
            for node in range(inner):
                own = groups[node]
                if len(own) >= 2:
                    a, b = unit[rng.choice(own, 2, replace=False)]
                    way = a - b
                    if not way.any():
                        way = rng.standard_normal(unit.shape[1])
                else:
                    way = rng.standard_normal(unit.shape[1])
                way = (way / np.linalg.norm(way)).astype(np.float32)
                at = unit[own].astype(np.float32) @ way
                cut = np.median(at) if len(own) else np.float32(0)
                self.ways[t, node], self.cuts[t, node] = way, cut
                groups += [own[at < cut], own[at >= cut]]

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: (rows, trees)."""
        out = np.zeros((len(unit), len(self.ways)), np.int64)
        unit = unit.astype(np.float32)
        for t in range(len(self.ways)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                right = (unit * self.ways[t, node]).sum(1) >= self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node
        return out

    def probe(self, unit: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """(tree, leaf) pairs for one query, nearest margins first, through one queue for all trees."""
        inner = (1 << self.depth) - 1
        margins = [(self.ways[t] @ unit.astype(np.float32) - self.cuts[t]).tolist() for t in range(len(self.ways))]
        queue = [(0.0, t, 0) for t in range(len(self.ways))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < probes:
            passed, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t][node]
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(passed, abs(m)), t, far))
                node = near
            found.append((t, node))
        return found


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    common = kept.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).select("dim").first()
    return kept.where(F.size("v") == (common["dim"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Double-precision cosines, each summed by itself so that equal rows get equal scores."""
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding", probes: float = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    rows = usable(vectors, id_col, vector)
    sampled = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toLocalIterator()]
    forest = Forest(np.array(sampled, np.float64) if sampled else np.zeros((0, 0)))
    trees = len(forest.ways)
    opened = max(trees, int(np.ceil(probes * trees * (1 << forest.depth))))

    def unit_of(v: np.ndarray) -> np.ndarray:
        return v / np.abs(v).max(1, keepdims=True) / np.linalg.norm(v / np.abs(v).max(1, keepdims=True), axis=1, keepdims=True) if len(v) else v

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = forest.leaves(unit_of(matrix(batch.column(1))))
                key = leaf + np.arange(trees) * (1 << (forest.depth + 1))
                row = np.repeat(np.arange(batch.num_rows), trees)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), *(batch.column(i).take(pa.array(row)) for i in (0, 1))], ["leaf", "vec_id", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, row = [], []
            for i, q in enumerate(unit_of(matrix(batch.column(1)))):
                found = forest.probe(q, opened)
                leaf += [t * (1 << (forest.depth + 1)) + n for t, n in found]
                row += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *(batch.column(i).take(pa.array(row, pa.int64())) for i in (0, 1))], ["leaf", "query_id", "q"])

    indexed = written(rows.mapInArrow(index, "leaf long, vec_id long, v array<double>"), "forest")
    # at most trees x leaves rows: how many blocks each leaf needs
    sizes = {r["leaf"]: -(-r["n"] // BLOCK) for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    many = {leaf: n for leaf, n in sizes.items() if n > 1}
    blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("leaf")), F.lit(1)) if many else F.lit(1)
    dealt = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks.cast("long")).cast("long"))
    asked = rows.where(F.col("vec_id") % every == 0).repartition(F.col("vec_id")).mapInArrow(search, "leaf long, query_id long, q array<double>")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))

    def rank(key: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(queries):
            v, ids = np.stack(members["v"].to_numpy()), members["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            v, ids = v[order], ids[order]
            spare = len(ids) - len(np.unique(ids))
            asks = np.stack(queries["q"].to_numpy())
            unit = unit_of(v).T
            # rough scores to choose by, of TOGETHER queries at a time; what is chosen is scored exactly
            near = (r for a in range(0, len(asks), TOGETHER) for r in unit_of(asks[a : a + TOGETHER]) @ unit)
            for query, q, rough in zip(queries["query_id"].tolist(), asks, near):
                own = ids == query
                want = min(len(ids), k + spare + int(own.sum()))
                if not want:
                    continue
                best = np.flatnonzero((rough >= np.partition(rough, -want)[-want] - 1e-9) & ~own)
                score = cosines(q, v[best])
                first = np.lexsort((ids[best], -score))
                first = first[np.sort(np.unique(ids[best][first], return_index=True)[1])][:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best][first], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    near = dealt.groupBy("leaf", "block").cogroup(asked.groupBy("leaf", "block")).applyInPandas(rank, "query_id long, vec_id long, score double")
    one = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
