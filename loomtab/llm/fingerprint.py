"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's fingerprint holds the ``K`` smallest of the 48-bit hashes of its distinct ``width``-word
shingles (A-Z lower-cased; fewer words make the whole sequence the one shingle), in order, eight
characters each, so that fingerprints sort and cut as strings do.  Fingerprints are mergeable: the
``K`` smallest hashes of two of them are the fingerprint of the two texts' union.  Of two
fingerprints, ``resemblance`` estimates the Jaccard similarity of the sets, ``containment`` the
share of the first set that is in the second, and ``distinct`` the size of a set.  Sets of up to
``K`` shingles are held whole, so that their estimates are exact.

The query compares a text with its edited text and with the next document's.  For that, documents are
cut into ranges of descending doc_id by fixed edges and sorted there, and each range is also given the
first row of the range after it; rows stream through a task, which holds one slice of texts.

Defined cases: null texts are empty; texts without words have the empty fingerprint; two empty
fingerprints resemble and contain each other fully (1), an empty one and another not at all (0);
doc_id is an integer, null ones come last; rows that share a doc_id follow each other by their
text's hash, and if there are many they are cut into ranges of that hash; a table of one row is its
own next document; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import pieces, shingle_hashes

K, WIDTH, BITS = 256, 5, 48
CHUNK_CHARS = 500_000
#: Bytes of text in a range of documents, and ranges at most.
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000
#: Rows of one doc_id that may go into one range in any case.
MANY = 1000
#: Groups whose sketches a task holds before it gives them back.
HELD_GROUPS = 4096

_PLAIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SORTED = bytes(sorted(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"))
_TO, _FROM = bytes.maketrans(_PLAIN, _SORTED), bytes.maketrans(_SORTED, _PLAIN)


# --- sketches -----------------------------------------------------------------------------------


def sketches(texts: list[str], width: int = WIDTH, k: int = K) -> list[np.ndarray]:
    """Bottom-k sketch of each text: its smallest distinct hashes, in order."""
    return [bottom(s >> np.uint64(64 - BITS), k) for s in shingle_hashes(texts, width)]


def bottom(ordered: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct of hashes that are in order."""
    if len(ordered) > 1:
        ordered = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
    return ordered[:k].copy()


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two sketched sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Of the union's hashes up to where the first cut sketch ends, the share that both hold; exact if neither is cut."""
    for x in (a, b):
        if len(x) >= k:
            a, b = a[a <= x[-1]], b[b <= x[-1]]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Number of the set's distinct shingles: exact below k, else by how densely hashes lie."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's set that is in b's: of a's hashes, of those that b would hold."""
    if not len(a):
        return 1.0
    seen = a if len(b) < k else a[a <= b[-1]]
    if not len(seen):  # b is so much larger that its sketch ends before a's begins: by sizes instead
        u = distinct(merged(a, b, k), k)
        return float(min(1.0, max(0.0, (distinct(a, k) + distinct(b, k) - u) / distinct(a, k))))
    return len(np.intersect1d(seen, b)) / len(seen)


def encoded(sketch: np.ndarray) -> str:
    """Eight characters a hash; strings sort as the hashes do."""
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return base64.b64encode(raw).translate(_TO).decode("ascii")


def decoded(text: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode((text or "").encode("ascii").translate(_FROM)), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


# --- tables -------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """Per row: doc_id, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoded(s) for s in sketches(texts, width, k)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def likeness(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """``pairs`` with resemblance, containment (of a in b), n_a and n_b (distinct shingles) of two columns of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([decoded(t) for t in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in (a, b))
            out = [
                [resemblance(x, y, k) for x, y in zip(left, right)],
                [containment(x, y, k) for x, y in zip(left, right)],
                [distinct(x, k) for x in left],
                [distinct(y, k) for y in right],
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, pa.float64()) for v in out]], [*batch.schema.names, "resemblance", "containment", "n_a", "n_b"])

    own = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    return pairs.mapInArrow(run, f"{own}, resemblance double, containment double, n_a double, n_b double")


def merged_by(table: DataFrame, by: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """Per value of ``by``: the fingerprint of all its rows' texts together.

    A task merges what it holds of a group first, so a group of a third of all rows comes from each
    task as one sketch; the rest goes through a distinct and a rank that is cut before its shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            hashes = [[p[i : i + 8] for i in range(0, len(p), 8)] for p in map(encoded, held.values())]
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array(hashes, pa.list_(pa.string()))], ["g", "hashes"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = decoded(text)
                held[g] = merged(held[g], s, k) if g in held else s
                if len(held) > HELD_GROUPS:
                    yield given()
                    held.clear()
        if held:
            yield given()

    part = table.select(F.col(by).alias("g"), F.col(fingerprint).alias("f")).mapInArrow(run, f"g {dict(table.dtypes)[by]}, hashes array<string>")
    each = part.select("g", F.explode_outer("hashes").alias("h")).distinct()
    first = each.withColumn("at", F.row_number().over(W.partitionBy("g").orderBy(F.col("h").asc_nulls_last()))).where(F.col("at") <= k)
    # at most k hashes a group
    return first.groupBy(F.col("g").alias(by)).agg(F.array_join(F.sort_array(F.collect_list("h")), "").alias("fingerprint"))


# --- a text, its edited text and the next document ----------------------------------------------------


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id and text of all rows with ``range``, ranges of descending doc_id, and the number of ranges."""
    rows = docs.select("doc_id", "text", F.col("doc_id").cast("double").alias("place"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    slots = docs.sparkSession.sparkContext.defaultParallelism
    wanted = min(max(-(-(size or 0) // RANGE_BYTES), 2 * slots), MOST_RANGES, max(n, 1))
    fractions = [i / wanted for i in range(1, wanted)]
    found = rows.agg(F.percentile_approx("place", F.lit(fractions), 20 * wanted)).first()[0] if fractions and n else None
    # ids that alone fill several ranges, so at most ``wanted`` of them
    many = rows.groupBy("place").agg(F.count("*").alias("c")).where(F.col("c") > max(2 * n / wanted, MANY)).collect()
    hot = {r["place"]: min(-(-r["c"] * wanted // n), wanted) for r in many}
    own = {x for x in hot if x is not None}
    edges = sorted({float(e) for e in found or []} | own | {math.nextafter(x, math.inf) for x in own})
    splits = [-math.inf, *(edges or [0.0]), math.inf]
    placed = Bucketizer(splits=splits, inputCol="place", outputCol="cell", handleInvalid="keep").transform(rows)
    # cells descend, nulls last; a hot id's cell, which holds it alone, is cut by its texts' hashes
    cells = len(splits) - 1
    cuts = [1] * (cells + 1)
    for x, parts in hot.items():
        cuts[cells if x is None else cells - 1 - splits.index(x)] = parts
    begins = [0, *accumulate(cuts[:-1])]
    at = F.when(F.col("place").isNull(), F.lit(cells)).otherwise(cells - 1 - F.col("cell")).cast("int")
    number = F.get(F.lit(begins), at)
    if hot:
        share = (F.xxhash64("text").cast("double") + 2.0**63) / 2.0**64
        parts = F.get(F.lit(cuts), at)
        number = number + F.least(F.floor(share * parts), parts - 1)
    return placed.select("doc_id", "text", number.cast("int").alias("range")), sum(cuts)


def with_firsts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (range, halo, doc_id, th, text): all rows, and at each range's end, as halo, the first row of the range after it."""
    placed, ranges = in_order(docs)
    top = placed.groupBy("range").agg(F.max("doc_id").alias("top"))  # one row a range
    after = F.coalesce(F.lead("range").over(W.orderBy("range")), F.first("range").over(W.orderBy("range")))
    heads = top.withColumn("next", after).select(F.col("range").alias("for"), F.col("next").alias("of")).join(top.select(F.col("range").alias("of"), "top"), "of")
    few = F.broadcast(heads)
    first = placed.join(few, (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    least = first.groupBy(F.col("for").alias("range")).agg(F.min(F.struct(F.xxhash64("text").alias("th"), "doc_id", "text")).alias("f"))
    halos = least.select("range", F.lit(1).alias("halo"), "f.doc_id", "f.th", "f.text")
    own = placed.select("range", F.lit(0).alias("halo"), "doc_id", F.xxhash64("text").alias("th"), "text")
    return own.unionByName(halos), ranges


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by as many from the next text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compared_with_next(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, ranges = with_firsts(docs.select("doc_id", "text"))
    dealt = rows.repartitionById(ranges, "range").sortWithinPartitions("range", "halo", F.col("doc_id").desc_nulls_last(), "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # range, doc_id, text and sketch of the row before
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            own = sketches(texts, width, k)
            at, halo, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            firsts, nexts = [], []
            for i, text in enumerate(texts):
                if before is not None and before[0] == at[i]:
                    firsts.append(before), nexts.append((text, own[i]))
                before = None if halo[i] else (at[i], ids[i], text, own[i])
            changed = [edited(x[2], y[0]) for x, y in zip(firsts, nexts)]
            marks = sketches(changed, width, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[1] for x in firsts], batch.schema.field(2).type),
                    pa.array([len(x[2]) for x in firsts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed], pa.string()),
                    pa.array([encoded(x[3]) for x in firsts], pa.string()),
                    pa.array([encoded(m) for m in marks], pa.string()),
                    pa.array([resemblance(x[3], m, k) for x, m in zip(firsts, marks)], pa.float64()),
                    pa.array([resemblance(x[3], y[1], k) for x, y in zip(firsts, nexts)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
