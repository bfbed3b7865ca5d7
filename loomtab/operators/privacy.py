"""Nearest-neighbour privacy audits: distance to the closest record, membership and attribute inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assoc import average_ranks
from .neighbours import LOW, SLICE, nearest_approximate, nearest_pruned
from .running import exact_quantiles
from .split import sample_exact

BLOCK = 4096


def _blocked(df: DataFrame, id_col: str, vector: str, rows: int) -> DataFrame:
    """Rows grouped by hash into blocks of about ``rows``: (block, ids, flat)."""
    blocks = max(1, -(-df.count() // rows))
    keyed = df.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"), F.struct(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).alias("s"))
    g = keyed.groupBy("block").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return g.select("block", F.col("s.id").alias("ids"), F.flatten("s.v").alias("flat"))


def nearest_two(
    queries: DataFrame, base: DataFrame, query_id: str = "id", base_id: str = "id", vector: str = "features", block: int = BLOCK, keep: int = 2, mode: str = "auto", max_samples: int | None = None, seed: int = 42
) -> DataFrame:
    """(id, d1, d2): each query's distances to its nearest ``base`` rows.

    ``mode``: ``blocks`` and ``pruned`` are exact, ``approximate`` looks into buckets of near rows only
    (see ``neighbours``); ``auto`` is pruned for up to ``LOW`` dimensions and blocks beyond, where most cells would meet.  With ``max_samples`` both sides are first cut to so many rows, drawn by the
    hash of their ids.  By blocks, both sides are cut into blocks that meet pairwise (so many pairs, but memory is two
    blocks whatever the tables); each meeting keeps its ``keep`` best per query and these are merged.
    """
    if mode not in ("auto", "blocks", "pruned", "approximate"):
        raise ValueError(f"{mode!r} is none of auto, blocks, pruned, approximate")
    if mode == "auto":
        one = base.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
        mode = "pruned" if one is None or one["n"] <= LOW else "blocks"
    if max_samples is not None:
        queries, base = sample_exact(queries, [query_id], max_samples, seed), sample_exact(base, [base_id], max_samples, seed)
    if mode != "blocks":
        near = nearest_pruned if mode == "pruned" else nearest_approximate
        return near(queries, base, query_id, base_id, vector, keep)
    q = _blocked(queries, query_id, vector, block).select(F.col("ids").alias("qi"), F.col("flat").alias("qf"))
    b = _blocked(base, base_id, vector, block).select(F.col("ids").alias("bi"), F.col("flat").alias("bf"))
    met = q.join(b)  # blocks against blocks: (n / block) x (m / block) rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qi, bi = batch.column(0)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
                qv = batch.column(1)[i].values.to_numpy().reshape(len(qi), -1)
                bv = batch.column(3)[i].values.to_numpy().reshape(len(bi), -1)
                k = min(keep, len(bi))
                for start in range(0, len(qi), SLICE):
                    q = qv[start : start + SLICE]
                    rough = (bv * bv).sum(1)[None, :] - 2 * q @ bv.T
                    best = np.argpartition(rough, k - 1, axis=1)[:, :k]
                    exact = ((q[:, None, :] - bv[best]) ** 2).sum(2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi[start : start + SLICE], k)), pa.array(np.sqrt(exact).reshape(-1))], ["id", "d"])

    near = met.mapInArrow(run, "id long, d double")
    top = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("d")), 1, 2).alias("d"))
    return top.select("id", F.col("d")[0].alias("d1"), F.get("d", F.lit(1)).alias("d2"))


def dcr_nndr(real: DataFrame, synth: DataFrame, near: DataFrame | None = None, **how) -> DataFrame:
    """(id, dcr, nndr) per synthetic row: distance to the closest real one, and its ratio to the second.

    ``near``, here and below: the synthetic rows' distances to the real ones by ``nearest_two``, if they are known.
    """
    t = nearest_two(synth, real, **how) if near is None else near
    return t.select("id", F.col("d1").alias("dcr"), F.when(F.col("d2") == 0, 1.0).otherwise(F.col("d1") / F.col("d2")).alias("nndr"))


def dcr_summary(real: DataFrame, synth: DataFrame, **how) -> DataFrame:
    d = dcr_nndr(real, synth, **how)
    return d.agg(*[f(c).alias(f"{c}_{n}") for c in ("dcr", "nndr") for n, f in (("mean", F.avg), ("min", F.min))])


def leakage_threshold(train: DataFrame, holdout: DataFrame, **how) -> DataFrame:
    """One row: the distance to training rows that 5 % of the holdout are within."""
    return exact_quantiles(nearest_two(holdout, train, **how), [], (0.05,), "d1").select(F.greatest(F.col("q")[0], F.lit(1e-8)).alias("threshold"))


def leakage(train: DataFrame, holdout: DataFrame, synth: DataFrame, near: DataFrame | None = None, **how) -> DataFrame:
    """Share of synthetic rows nearer to training rows than 95 % of the holdout, with that threshold."""
    base = leakage_threshold(train, holdout, **how)
    near = nearest_two(synth, train, **how) if near is None else near
    return near.join(F.broadcast(base)).agg(F.first("threshold").alias("threshold"), (100.0 * F.avg((F.col("d1") < F.col("threshold")).cast("double"))).alias("leakage_pct"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by average ranks, over distinct scores; 0.5 without both classes."""
    pos = F.col(positive).cast("double")
    ranks = average_ranks(df.select(score, pos.alias("_p")), [], score).select(F.col(score).alias("_s"), "rank")
    counts = df.groupBy(F.col(score).alias("_t")).agg(F.sum(pos).alias("p"), F.count("*").alias("n"))
    s = counts.join(ranks, F.col("_s").eqNullSafe(F.col("_t"))).agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), (F.sum("n") - F.sum("p")).alias("q"))
    good = (F.col("p") > 0) & (F.col("q") > 0)
    return s.select(F.when(good, (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.when(good, F.col("p") * F.col("q"))).otherwise(0.5).alias("auc"))


def mia_auc(train: DataFrame, test: DataFrame, synth: DataFrame, least: int = 10, **how) -> DataFrame:
    """How well nearness to synthetic rows tells training rows from others; 0.5 with few rows."""
    parts = [nearest_two(d, synth, keep=1, **how).select((-F.col("d1")).alias("score"), F.lit(label).alias("label")) for d, label in ((train, 1), (test, 0))]
    both = parts[0].unionByName(parts[1])
    enough = both.groupBy("label").count().agg(F.min("count").alias("few"), F.count("*").alias("kinds"))
    return auc(both, "score", "label").join(F.broadcast(enough)).select(F.when((F.col("few") >= least) & (F.col("kinds") == 2), F.col("auc")).otherwise(0.5).alias("mia_auc"))


def distance_histogram(distances: DataFrame, bins: int = 20, col: str = "dcr", threshold: DataFrame | None = None) -> DataFrame:
    """(bin, n) over bins of equal width, and the threshold of leakage if its row is given."""
    span = distances.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    at = distances.join(F.broadcast(span)).select(F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1)).alias("bin"))
    out = at.groupBy("bin").agg(F.count("*").alias("n"))
    return out if threshold is None else out.join(F.broadcast(threshold))
