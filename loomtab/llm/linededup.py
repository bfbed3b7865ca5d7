"""Line dedup with DataFrame functions only.

Line keys are hashed; (hash, document) pairs are range-partitioned and sorted by document and
position, so a line that a third of all documents share spreads over many partitions.  The sorted
stream gives each document's positions of a key, small partial aggregates give the number of
documents and the surviving document of a key, and per document the decisions come back as a keep
bitmap, compressed to the runs of lines that stay.  Text
is shuffled once, to meet its bitmap.

Keys are compared by two independent 64-bit hashes.

Defined cases: null or empty text is one empty line; documents with a null doc_id count together as
one document, smaller than all others; rows that share a doc_id count as one document but are each
rewritten; several occurrences inside the surviving document all stay; an empty table stays empty;
all other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, fresh, written

#: Length of a bitmap's last run: beyond any text's lines.
OPEN = 2**30


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """Per key hash (a, b) and document: the rows (by text hash) and positions that hold it, in order."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.withColumn("key", ascii_lower(F.btrim("line", F.lit(BLANKS)))).where(F.length("key") >= min_chars)
    hashed = keyed.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key").alias("b"), "doc_id", "th", "pos")
    ordered = hashed.repartitionByRange("a", "b", "doc_id").sortWithinPartitions("a", "b", "doc_id", "th", "pos")
    return ordered.groupBy("a", "b", "doc_id").agg(F.collect_list(F.struct("th", "pos")).alias("at"))


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Per row that loses lines: doc_id, th (hash of its text), the sorted positions that go."""
    seen = written(line_occurrences(docs, min_chars), "lines")
    common = seen.groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
    # written, so that both sides of the join are dealt anew and a hot key's partition can be split
    common = written(common.where(F.col("docs") >= min_docs).select("a", "b", "last"), "common-lines")
    lost = seen.join(common, ["a", "b"]).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    each = lost.select("doc_id", F.explode("at").alias("at")).select("doc_id", "at.th", "at.pos")
    return each.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def keep_runs(gone: Column) -> Column:
    """Keep bitmap, compressed to the runs (start, len) of its ones, from the sorted positions of its zeros; the last run is open."""
    before = F.concat(F.array(F.lit(-1)), gone)
    after = F.concat(gone, F.array(F.lit(OPEN)))
    runs = F.zip_with(before, after, lambda x, y: F.struct((x + 1).alias("start"), (y - x - 1).alias("len")))
    return F.filter(runs, lambda r: r["len"] > 0)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row that loses lines: doc_id, th, keep, its keep bitmap as runs of the lines that stay, and zeros, the lines that go."""
    return dropped_positions(docs, min_chars, min_docs).select("doc_id", "th", keep_runs(F.col("gone")).alias("keep"), F.size("gone").alias("zeros"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the lost lines gone from ``text``, plus n_lines (before) and n_dropped."""
    th, keep, total, lost = (fresh(docs, c) for c in ("th", "keep", "n_lines", "n_dropped"))
    key, zeros, own_th = fresh(docs, "key_id"), fresh(docs, "zeros"), fresh(docs, "th_own")
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("keep").alias(keep), F.col("zeros").alias(zeros))
    own = docs.withColumn(own_th, F.xxhash64("text"))
    met = own.join(maps.hint("shuffle_hash"), own["doc_id"].eqNullSafe(maps[key]) & (own[own_th] == maps[th]), "left")
    lines = lines_of(F.col("text"))
    kept = F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, F.least(r["len"], F.size(lines) - r["start"])))), "\n")
    return met.select(
        *[F.when(F.col(keep).isNull(), F.col(c)).otherwise(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(total),
        F.coalesce(F.col(zeros), F.lit(0)).cast("long").alias(lost),
    )


def dedup_lines_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256."""
    done = dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
common AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
    SELECT k.doc_id, k.pos, k.line, c.last IS NOT NULL AND k.doc_id < c.last AS lost
    FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
