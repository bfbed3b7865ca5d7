"""Nearest neighbours of many rows among many: exact in the cells of a tree, and approximate with projections.

Both work on distinct vectors: copies are one row with their number, so a vector that a third of all
rows have meets nobody twice.

``nearest_pruned`` is exact.  A tree fitted on a bounded sample splits space at the middle of the widest
axis until its leaves, the cells, hold a few hundred base rows.  Each query first meets its own cell, which
bounds how far its neighbours can be, and then only those cells whose box of rows isn't beyond that bound.
In few dimensions that is a few cells whatever the tables' size, so the work grows with the queries.

``nearest_approximate`` deals vectors into buckets of several tables by rounded random projections.  A
query also looks into the neighbouring buckets whose borders are nearest to it.  Widths come from
distances measured for a bounded sample of queries against all rows, the number of projections from how
a sample of rows fills buckets.  A query for which too few rows were found is answered exactly.

Rows without an id, and vectors that are null or hold null, NaN or infinite numbers, take no part and have no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .domains import kept_table

#: Base rows of a group that a task holds at once, and rows of groups that one partition gets.
HELD, DEALT = 1 << 14, 1 << 20
#: Queries that a block meets at once; pairs that are compared at once.
SLICE, PAIRS = 256, 1 << 19
#: Base rows of a cell, cells at most in up to LOW dimensions and beyond, sample rows that the tree is fitted on for each cell.
LEAF, MOST_CELLS, LOW, FEW_CELLS, SAMPLED = 256, 1 << 16, 8, 512, 16
#: Dimensions up to which all differences are taken, and queries of a cell that one task gets.
DIRECT, QUERIES = 16, 1 << 18
#: Tables, projections of a table at most, candidates of a query that buckets should hold, and a bucket's width in distances.
TABLES, MOST_HASHES, CANDIDATES, WIDTH = 12, 12, 400, 4.0
#: Queries that are measured against all rows, and rows that tell how buckets fill.
MEASURED, FILLED = 64, 4096
#: What a bound is widened by.
SLACK = 1e-12


def _clean(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(row_id).cast("long").alias("own"), v.alias("v")).where(ok & F.col(row_id).isNotNull())


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """id (the least of the rows with that vector), v, copies."""
    return rows.groupBy("v").agg(F.min("own").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sampled(df: DataFrame, n: int) -> list:
    """At most n rows, those whose ids hash lowest."""
    return df.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(n).collect()


# --- groups that meet ---------------------------------------------------------------------------------


def _best(qi: np.ndarray, qv: np.ndarray, ids: np.ndarray, bv: np.ndarray, copies: np.ndarray, keep: int, metric: str) -> Iterator[list[np.ndarray]]:
    """Columns (id, hit, d, copies): each query's ``keep`` nearest of the base rows."""
    k, step = min(keep, len(ids)), max(1, PAIRS // len(ids))
    centre = bv.mean(0)
    near = bv - centre
    for start in range(0, len(qi), step):
        q = qv[start : start + step]
        if metric == "euclidean":
            rough = (near * near).sum(1)[None, :] - 2 * (q - centre) @ near.T
        else:
            rough = np.zeros((len(q), len(bv)))
            for j in range(bv.shape[1]):
                np.maximum(rough, np.abs(q[:, None, j] - bv[None, :, j]), out=rough)
        rows, best = np.arange(len(q)), np.empty((len(q), k), np.int64)
        for i in range(k):
            best[:, i] = rough.argmin(1)
            rough[rows, best[:, i]] = np.inf
        gaps = q[:, None, :] - bv[best]
        exact = np.sqrt((gaps**2).sum(2)) if metric == "euclidean" else np.abs(gaps).max(2)
        yield [np.repeat(qi[start : start + step], k), ids[best].reshape(-1), exact.reshape(-1), copies[best].reshape(-1)]


HITS = "id long, hit long, d double, copies long"


def _hits(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["id", "hit", "d", "copies"])


def best_in_groups(queries: DataFrame, base: DataFrame, on: str, keep: int, metric: str = "euclidean", block: int = HELD) -> DataFrame:
    """(id, hit, d, copies): each query's ``keep`` nearest rows of those with its ``on``, by the euclidean or the chebyshev distance.

    Both sides are rows (``on``, id, v, copies).  A task streams its groups, each one's base before its queries, and holds one
    group's base.  Of a group with more than ``block`` base rows each query's ``keep`` nearest of each part are returned; many
    queries of a group are dealt to several tasks, each of which gets its base.
    """
    both = base.select(on, F.lit(1).alias("b"), F.lit(0).alias("q")).unionByName(queries.select(on, F.lit(0).alias("b"), F.lit(1).alias("q")))
    parts = lambda c, most: F.greatest(F.lit(1), F.ceil(F.sum(c) / most)).cast("int")
    sizes = both.groupBy(F.col(on).alias("g")).agg(parts("b", block).alias("bs"), parts("q", QUERIES).alias("qs")).where("bs > 1 OR qs > 1")
    many = kept_table(sizes, "large-groups")
    place = {"b": F.lit(0), "q": F.lit(0)}
    b, q = base.select(on, F.lit(0).alias("side"), "id", "v", "copies"), queries.select(on, F.lit(1).alias("side"), "id", "v", F.lit(0).cast("long").alias("copies"))
    if many.isEmpty():
        b, q = b.withColumns(place), q.withColumns(place)
    else:
        own = lambda c: F.pmod(F.xxhash64("id"), F.coalesce(c, F.lit(1))).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
        b, q = (d.join(many, F.col(on) == F.col("g"), "left") for d in (b, q))
        b, q = b.withColumn("b", own("bs")).withColumn("q", every("qs")), q.withColumn("q", own("qs")).withColumn("b", every("bs"))
    order = [on, "b", "q"]
    rows = b.select(*order, "side", "id", "v", "copies").unionByName(q.select(*order, "side", "id", "v", "copies"))
    dealt = rows.repartition(max(1, -(-rows.count() // DEALT)), *order).sortWithinPartitions(*order, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, known = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(i).to_numpy() for i in range(4)]
            ids, v, copies = batch.column(4).to_numpy(), _matrix(batch.column(5), len(batch.column(5)[0])), batch.column(6).to_numpy()
            cuts = 1 + np.nonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0))[0]
            found = []
            for start, end in zip([0, *cuts], [*cuts, len(ids)]):
                group = tuple(m[start] for m in marks[:3])
                if group != current:
                    current, held, known = group, [], None
                if marks[3][start] == 0:
                    held.append((ids[start:end].copy(), v[start:end].copy(), copies[start:end].copy()))
                elif held:
                    known = known or [np.concatenate(x) for x in zip(*held)]
                    found += _best(ids[start:end], v[start:end], *known, keep, metric)
            if found:
                yield _hits(found)

    return dealt.mapInArrow(run, HITS)


def two_of(near: DataFrame) -> DataFrame:
    """(id, d1, d2, found) of all rows found, each counted once and as often as it has copies."""
    # as many as the groups that a query met
    hits = near.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("d", "hit", "copies"))).alias("h"))
    second = F.when(F.col("h")[0]["copies"] > 1, F.col("h")[0]["d"]).otherwise(F.get("h", F.lit(1))["d"])
    return hits.select("id", F.col("h")[0]["d"].alias("d1"), second.alias("d2"), F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x["copies"]).alias("found"))


def per_row(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, d1, d2) of all query rows, from those of distinct vectors (v, d1, d2)."""
    return rows.join(found.select("v", "d1", "d2"), "v").select(F.col("own").alias("id"), "d1", "d2")


# --- exact, in cells of a tree --------------------------------------------------------------------------


def fitted_tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value that each inner node splits at, by the middle of its widest axis; node i's children are 2 i + 1 and 2 i + 2."""
    axes, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    parts = [np.arange(len(x))]
    for level in range(depth):
        following = []
        for node, rows in enumerate(parts, 2**level - 1):
            side = np.ones(len(rows), bool)
            if len(rows):
                axis = int((x[rows].max(0) - x[rows].min(0)).argmax())
                c = x[rows, axis]
                middle = np.partition(c, len(c) // 2)[len(c) // 2]
                if middle == c.min():
                    middle = c[c > middle].min(initial=np.inf)
                axes[node], at[node] = axis, middle
                side = c < middle
            following += [rows[side], rows[~side]]
        parts = following
    return axes, at


def cells_of(base: DataFrame, rows: int, most: int | None = None, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The tree of a bounded sample: about ``leaf`` rows a cell, the square root of all rows if that makes more cells, ``most`` cells at most."""
    dim = len(base.first()["v"])
    most = most or (MOST_CELLS if dim <= LOW else FEW_CELLS)
    depth = int(np.log2(max(1, min(most, max(np.sqrt(rows), rows / leaf)))))
    share = int(min(1.0, SAMPLED * 2**depth / rows) * 2**20)
    some = base.where(F.pmod(F.xxhash64("id", F.lit(42)), F.lit(2**20)) < share) if share < 2**20 else base
    return fitted_tree(_matrix(some.select("v").toArrow().column("v").combine_chunks(), dim), depth)


def in_cells(rows: DataFrame, tree: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``rows`` (id, v, copies) with their cell."""
    axes, at = tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), -1 if not batch.num_rows else len(batch.column(1)[0]))
            node, every = np.zeros(len(v), np.int64), np.arange(len(v))
            for _ in range(int(np.log2(len(axes) + 1))):
                node = 2 * node + 1 + (v[every, axes[node]] >= at[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((node - len(axes)).astype(np.int32))], ["id", "v", "copies", "cell"])

    return rows.mapInArrow(run, "id long, v array<double>, copies long, cell int")


def boxes_of(cells: DataFrame, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node of the tree: least and largest coordinates of its rows, and how many these are; of each cell its distinct vectors."""
    sides = cells.select("cell", "copies", F.posexplode("v").alias("axis", "x")).groupBy("cell", "axis")
    # as many rows as there are cells and axes
    told = sides.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("copies").alias("n"), F.count("*").alias("rows")).toArrow()
    cell, axis, low, high, n, rows = (told.column(c).to_numpy() for c in ("cell", "axis", "lo", "hi", "n", "rows"))
    lo, hi = np.full((2 * leaves - 1, axis.max() + 1), np.inf), np.full((2 * leaves - 1, axis.max() + 1), -np.inf)
    held, distinct = np.zeros(2 * leaves - 1, np.int64), np.zeros(leaves, np.int64)
    lo[cell + leaves - 1, axis], hi[cell + leaves - 1, axis] = low, high
    held[cell + leaves - 1], distinct[cell] = n, rows
    for node in range(leaves - 2, -1, -1):
        left, right = 2 * node + 1, 2 * node + 2
        lo[node], hi[node] = np.minimum(lo[left], lo[right]), np.maximum(hi[left], hi[right])
        held[node] = held[left] + held[right]
    return lo, hi, held, distinct


def _two_nearest(q: np.ndarray, b: np.ndarray, copies: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the two nearest rows of ``b``, copies counted; NaN for what there isn't."""
    if q.shape[1] > DIRECT:
        centre = b.mean(0)
        near = b - centre
        rough = (near * near).sum(1)[None, :] - 2 * (q - centre) @ near.T
        best = np.argpartition(rough, min(8, len(b)) - 1, axis=1)[:, :8]
        square, copies = ((q[:, None, :] - b[best]) ** 2).sum(2), copies[best]
    else:
        square = np.zeros((len(q), len(b)))
        for j in range(q.shape[1]):
            gap = q[:, j, None] - b[None, :, j]
            square += gap * gap
        copies = np.broadcast_to(copies, square.shape)
    rows, first = np.arange(len(q)), square.argmin(1)
    d1 = np.sqrt(square[rows, first])
    if keep < 2:
        return d1, np.full(len(q), np.nan)
    square[rows, first] = np.inf
    d2 = np.sqrt(square.min(1)) if square.shape[1] > 1 else np.full(len(q), np.nan)
    return d1, np.where(copies[rows, first] > 1, d1, d2)


def met_in_cells(queries: DataFrame, base: DataFrame, keep: int) -> DataFrame:
    """``queries`` (id, v, cell) with the distances to the two nearest rows of ``base`` (id, v, copies, cell) in their cell.

    A task streams its cells, each one's base before its queries, and holds one cell's base.  A cell that many
    queries look into is dealt to several tasks, each of which gets its base.
    """
    many = kept_table(queries.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")).where("parts > 1"), "hot-cells")
    b = base.select("cell", F.lit(0).alias("part"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("id"), "v", "copies")
    q = queries.select("cell", F.lit(0).alias("part"), F.lit(1).alias("side"), "id", "v", F.lit(0).cast("long").alias("copies"))
    if not many.isEmpty():
        # as many rows as there are cells at most
        b = b.join(F.broadcast(many), F.col("cell") == F.col("c"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("c", "parts")
        q = q.join(F.broadcast(many), F.col("cell") == F.col("c"), "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("c", "parts")
    dealt = b.unionByName(q).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, known = None, [], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cell, part, side, copies = (batch.column(i).to_numpy() for i in (0, 1, 2, 5))
            v = _matrix(batch.column(4), len(batch.column(4)[0]))
            cuts = 1 + np.nonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1]))[0]
            d1, d2 = np.full(n, np.nan), np.full(n, np.nan)
            for start, end in zip([0, *cuts], [*cuts, n]):
                if (cell[start], part[start]) != current:
                    current, held, known = (cell[start], part[start]), [], None
                if side[start] == 0:
                    held.append((v[start:end].copy(), copies[start:end].copy()))
                elif held:
                    if known is None:
                        known = [np.concatenate(x) for x in zip(*held)]
                    step = max(1, PAIRS // len(known[0]))
                    for i in range(start, end, step):
                        j = min(i + step, end)
                        d1[i:j], d2[i:j] = _two_nearest(v[i:j], *known, keep)
            asked = pa.array(side == 1)
            arrays = [batch.column(3), batch.column(4), batch.column(0), pa.array(d1, mask=np.isnan(d1)), pa.array(d2, mask=np.isnan(d2))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "v", "cell", "d1", "d2"]).filter(asked)

    return dealt.mapInArrow(run, "id long, v array<double>, cell int, d1 double, d2 double")


def visits(queries: DataFrame, lo: np.ndarray, hi: np.ndarray, held: np.ndarray, keep: int) -> DataFrame:
    """(id, v, cell): which cells besides its own a query (id, v, cell, d1, d2) has to meet: those whose box isn't beyond its bound.

    The tree is walked from the root; differences are rounded as those of rows are, so no box is taken for farther than a row in it.
    """
    leaves = (len(held) + 1) // 2

    def reached(part: np.ndarray, v: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        who, node = part, np.zeros(len(part), np.int64)
        for _ in range(int(np.log2(leaves))):
            who, node = np.repeat(who, 2), np.repeat(2 * node + 1, 2)
            node[1::2] += 1
            if who.size * v.shape[1] > PAIRS and len(part) > 1:
                half = len(part) // 2
                yield from reached(part[:half], v, bound)
                yield from reached(part[half:], v, bound)
                return
            gap = np.maximum(np.maximum(lo[node] - v[who], v[who] - hi[node]), 0)
            near = (held[node] > 0) & (np.sqrt((gap * gap).sum(1)) <= bound[who] * (1 + SLACK))
            who, node = who[near], node[near]
        yield who, node - (leaves - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, home = _matrix(batch.column(1), lo.shape[1]), batch.column(2).to_numpy()
            bound = batch.column(3 if keep == 1 else 4).to_numpy(zero_copy_only=False).astype(float)
            # a query without enough rows at home is bounded by the farthest corner of the first node above that has them
            node = home.astype(np.int64) + leaves - 1
            while (up := (held[node] < keep) & (node > 0)).any():
                node = np.where(up, (node - 1) // 2, node)
            open_ = np.isnan(bound)
            corner = np.maximum(np.abs(v[open_] - lo[node[open_]]), np.abs(v[open_] - hi[node[open_]]))
            bound[open_] = np.where(held[node[open_]] >= keep, np.sqrt((corner * corner).sum(1)), np.inf)
            for who, cell in reached(np.arange(len(v)), v, bound):
                who, cell = who[cell != home[who]], cell[cell != home[who]]
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    return queries.select("id", "v", "cell", "d1", "d2").mapInArrow(run, "id long, v array<double>, cell int")


def pruned(queries: DataFrame, base: DataFrame, keep: int = 2, most: int | None = None, block: int = LEAF) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Of distinct vectors (id, v, copies): (id, v, d1, d2) of the queries, the cells that each met (id, cell), and the vectors of each cell."""
    rows = base.count()
    if not rows:
        spark = base.sparkSession
        return spark.createDataFrame([], "id long, v array<double>, d1 double, d2 double"), spark.createDataFrame([], "id long, cell int"), np.zeros(1, np.int64)
    tree = cells_of(base, rows, most, block)
    b = kept_table(in_cells(base, tree), "base-cells")
    lo, hi, held, distinct = boxes_of(b, len(tree[0]) + 1)
    first = kept_table(met_in_cells(kept_table(in_cells(queries, tree), "query-cells"), b, keep), "own-cells")
    away = kept_table(visits(first, lo, hi, held, keep), "visits")
    met = first.unionByName(met_in_cells(away, b, keep))
    # two distances for each cell that a query met
    best = F.sort_array(F.concat(F.collect_list("d1"), F.collect_list("d2")))
    found = met.groupBy("id", "v").agg(best.alias("d")).select("id", "v", F.get("d", F.lit(0)).alias("d1"), F.get("d", F.lit(1)).alias("d2"))
    return found, first.select("id", "cell").unionByName(away.select("id", "cell")), distinct


def nearest_pruned(queries: DataFrame, base: DataFrame, query_id: str = "id", base_id: str = "id", vector: str = "features", keep: int = 2, **how) -> DataFrame:
    """(id, d1, d2): each query's distances to its nearest ``base`` rows, exact; d2 is null if only one is kept."""
    rows = _clean(queries, query_id, vector)
    reps = kept_table(distinct_vectors(rows), "queries")
    found, _, _ = pruned(reps, kept_table(distinct_vectors(_clean(base, base_id, vector)), "base"), keep, **how)
    return kept_table(per_row(found, rows), "near")


def meetings(queries: DataFrame, base: DataFrame, query_id: str = "id", base_id: str = "id", vector: str = "features", **how) -> DataFrame:
    """One row: queries and base rows (distinct vectors), cells visited beyond the own one, and the share of all pairs of vectors that met."""
    q = kept_table(distinct_vectors(_clean(queries, query_id, vector)), "queries")
    b = kept_table(distinct_vectors(_clean(base, base_id, vector)), "base")
    _, met, distinct = pruned(q, b, **how)
    held = q.sparkSession.createDataFrame(list(enumerate(distinct.tolist())), "cell int, rows long")
    pairs = met.join(held, "cell").agg(F.sum("rows").alias("pairs"), F.count("*").alias("met"))
    sizes = q.agg(F.count("*").alias("queries")).join(F.broadcast(b.agg(F.count("*").alias("base"))))
    return sizes.join(F.broadcast(pairs)).select("queries", "base", (F.col("met") - F.col("queries")).alias("visits"), (F.col("pairs") / (F.col("queries") * F.col("base"))).alias("met"))


# --- approximate, with projections ------------------------------------------------------------------------


def probes_of(hashes: int) -> np.ndarray:
    """Steps to neighbouring buckets: one or two coordinates down or up; a row of (coordinate, step, coordinate, step)."""
    one = [(i, s, i, 0) for i in range(hashes) for s in (-1, 1)]
    two = [(i, s, j, t) for i, j in combinations(range(hashes), 2) for s in (-1, 1) for t in (-1, 1)]
    return np.array([*one, *two], np.int64)


def _key(table: int, places: np.ndarray) -> np.ndarray:
    h = np.full(places.shape[:-1], table + 1, np.uint64)
    for i in range(places.shape[-1]):
        h = (h ^ places[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def in_buckets(rows: DataFrame, planes: np.ndarray, shifts: np.ndarray, width: float, probes: int) -> DataFrame:
    """(key, id, v, copies): a row under its bucket of each table and under its ``probes`` likeliest neighbours."""
    steps = probes_of(planes.shape[1]) if probes else np.zeros((0, 4), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                v = _matrix(part.column(1), planes.shape[2])
                keys = []
                for t in range(len(planes)):
                    x = v @ planes[t].T / width + shifts[t]
                    low = np.floor(x)
                    places = low.astype(np.int64)
                    keys.append(_key(t, places)[:, None])
                    if len(steps):
                        edge = np.stack([x - low, 1 - (x - low)], 2)  # to the border below and above
                        side = lambda c, s: np.where(s[None, :] == 0, 0.0, edge[:, c, (s > 0).astype(int)])
                        score = side(steps[:, 0], steps[:, 1]) ** 2 + side(steps[:, 2], steps[:, 3]) ** 2
                        best = np.argpartition(score, min(probes, len(steps)) - 1, axis=1)[:, :probes]
                        near = np.repeat(places[:, None, :], best.shape[1], 1)
                        r, p = np.indices(best.shape)
                        near[r, p, steps[best, 0]] += steps[best, 1]
                        near[r, p, steps[best, 2]] += steps[best, 3]
                        keys.append(_key(t, near))
                key = np.concatenate(keys, 1)
                take = pa.array(np.repeat(np.arange(len(v)), key.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), *[c.take(take) for c in part.columns]], ["key", "id", "v", "copies"])

    return rows.mapInArrow(run, "key long, id long, v array<double>, copies long")


def fitted(queries: DataFrame, base: DataFrame, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Planes, shifts and width of the buckets."""
    some = _sampled(queries, MEASURED)
    sample = np.array([r["v"] for r in _sampled(base.select("id", "v"), FILLED)])
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    asked, ids = np.array([r["v"] for r in some]), np.array([r["id"] for r in some])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _hits(list(_best(ids, asked, batch.column(0).to_numpy(), _matrix(batch.column(1), dim), batch.column(2).to_numpy(), 2, "euclidean")))

    rows = base.count()
    found = [d for r in two_of(base.select("id", "v", "copies").mapInArrow(measured, HITS)).collect() for d in (r["d2"], r["d1"]) if d][: 2 * MEASURED]
    width = WIDTH * float(np.median(found)) if found else 1.0
    planes = rng.standard_normal((tables, MOST_HASHES, dim))
    shifts = rng.random((tables, MOST_HASHES))
    places = np.floor(sample @ planes[0].T / width + shifts[0]).astype(np.int64)
    asks = np.floor(asked @ planes[0].T / width + shifts[0]).astype(np.int64)
    for hashes in range(1, MOST_HASHES + 1):
        share = float((_key(0, asks[:, :hashes])[:, None] == _key(0, places[:, :hashes])[None, :]).mean())
        if share * rows <= CANDIDATES:
            break
    return planes[:, :hashes], shifts[:, :hashes], width


def nearest_approximate(queries: DataFrame, base: DataFrame, query_id: str = "id", base_id: str = "id", vector: str = "features", keep: int = 2, tables: int = TABLES, probes: int | None = None, seed: int = 42, block: int = HELD) -> DataFrame:
    """(id, d1, d2): distances to the nearest rows of the buckets that a query looks into; ``probes`` neighbours of each bucket (default two a projection)."""
    rows = _clean(queries, query_id, vector)
    reps = kept_table(distinct_vectors(rows), "queries")
    own = kept_table(distinct_vectors(_clean(base, base_id, vector)), "base")
    if own.isEmpty() or reps.isEmpty():
        return rows.select(F.col("own").alias("id"), F.lit(None).cast("double").alias("d1"), F.lit(None).cast("double").alias("d2")).limit(0)
    planes, shifts, width = fitted(reps, own, tables, seed)
    looked = kept_table(in_buckets(reps, planes, shifts, width, 2 * planes.shape[1] if probes is None else probes), "looked")
    held = kept_table(in_buckets(own, planes, shifts, width, 0), "held")
    found = kept_table(two_of(best_in_groups(looked, held, "key", keep, block=block)), "found")
    short = kept_table(reps.join(found.where(F.col("found") >= keep), "id", "left_anti"), "short")
    late, _, _ = pruned(short, own, keep)
    early = found.where(F.col("found") >= keep).join(reps.select("id", "v"), "id")
    return per_row(early.select("v", "d1", "d2").unionByName(late.select("v", "d1", "d2")), rows)
