"""Packing: shortest-pack-first over the length histogram.

Every document's ids (with the end id) are cut into full pieces of ``max_len`` and one remainder.
The histogram of piece lengths has at most ``max_len`` entries, whatever the corpus; on it lengths
are placed longest first, each into the open packing pattern with the least in it, and the counts
of the patterns are updated.  The patterns then say, for each length and each range of ranks, which
sequence and offset a piece gets, and the pieces find theirs by their rank within their length.

Defined cases: null or empty text is one piece with the end id alone; a null or repeated doc_id is
kept (each row is packed by itself); an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, written
from .tokens import encoder

#: Characters that are encoded at a time.
CHUNK_CHARS = 500_000
#: Pieces per rank bucket, on average.
BUCKET = 2048


def cut_documents(docs: DataFrame, path: str, max_len: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``max_len`` ids: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            ids, bounds = enc.encode(texts)
            n = np.diff(bounds)
            per = -(-n // max_len)
            row = np.repeat(np.arange(len(n)), per)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * max_len
            length = np.minimum(n[row] - start, max_len)
            at = bounds[row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            out = [batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                edges = np.concatenate([at, at[-1:] + length[-1:]]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order of placement) and how often each occurs.

    ``histogram``: pieces per length.  Lengths come longest first; each goes to the open pattern
    with the least in it so far that still has room, as often as both last.
    """
    open_by_sum: dict[int, list[list]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, list]] = []
        for total in sorted(t for t in open_by_sum if t + length <= max_len):
            stack = open_by_sum[total]
            while left and stack:
                pattern, count = stack.pop()
                # as many pieces of this length as fit into one pattern stay together when there are plenty
                take = min(left, count)
                if take < count:
                    stack.append([pattern, count - take])
                placed.append((total + length, [(*pattern, length), take]))
                left -= take
            if not stack:
                del open_by_sum[total]
            if not left:
                break
        fit = max_len // length
        if left >= fit > 0:
            placed.append((length * fit, [(length,) * fit, left // fit]))
            left %= fit
        if left:
            placed.append((length * left, [(length,) * left, 1]))
        for total, entry in placed:
            open_by_sum.setdefault(total, []).append(entry)
    return [(tuple(p), c) for stack in open_by_sum.values() for p, c in stack]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Rank ranges of each length: length, low (first rank), sequence (of that rank), stride, offset.

    The piece of rank ``r`` in a range gets sequence ``sequence + (r - low)`` at ``offset``.
    """
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in sorted(patterns, key=lambda x: (-len(x[0]), x)):
        offset = 0
        for length in pattern:
            low = seen.get(length, 0)
            rows.append((length, low, sequence, offset))
            seen[length] = low + count
            offset += length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "low", "sequence", "offset"]).astype("int64")


def pack_pieces(cut: DataFrame, max_len: int) -> DataFrame:
    """Adds sequence_id and offset to pieces that are in a table (it is read three times)."""
    counted = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    table = slots(pack_histogram(counted, max_len))
    total = sum(counted.values())
    buckets = max(1, -(-total // BUCKET))
    spread = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    # ranks: pieces of the same length in earlier buckets, summed in two levels, plus the place in the bucket
    each = spread.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("super", F.floor(F.col("bucket") / 1024))
    whole = each.groupBy("length", "super").agg(F.sum("n").alias("sum"))
    above = whole.select("length", "super", (F.sum("sum").over(W.partitionBy("length").orderBy("super")) - F.col("sum")).alias("above"))
    inside = each.withColumn("below", F.sum("n").over(W.partitionBy("length", "super").orderBy("bucket")) - F.col("n"))
    base = inside.join(above, ["length", "super"]).select(F.col("bucket").alias("in_bucket"), F.col("length").alias("of"), (F.col("above") + F.col("below")).alias("base"))
    order = {k: g for k, g in table.groupby("length")}
    lows = {k: g["low"].to_numpy() for k, g in order.items()}
    sequences = {k: g["sequence"].to_numpy() for k, g in order.items()}
    offsets = {k: g["offset"].to_numpy() for k, g in order.items()}

    def place(rows: pd.DataFrame, bases: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ignore_index=True)
        lengths = rows["length"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1]])) if len(rows) else np.zeros(0, int)
        known = dict(zip(bases["of"].tolist(), bases["base"].tolist()))
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)]):
            length = int(lengths[a])
            rank = known[length] + np.arange(b - a)
            slot = np.searchsorted(lows[length], rank, "right") - 1
            sequence[a:b] = sequences[length][slot] + rank - lows[length][slot]
            offset[a:b] = offsets[length][slot]
        return rows.drop(columns="bucket").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return spread.groupBy("bucket").cogroup(base.groupBy("in_bucket")).applyInPandas(place, schema)


def pack_documents(docs: DataFrame, path: str, max_len: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset."""
    return pack_pieces(written(cut_documents(docs, path, max_len, with_ids), "pieces"), max_len)
