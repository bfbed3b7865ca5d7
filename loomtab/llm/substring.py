"""Substring dedup: paragraph hashing, with a paragraph of ``width`` words at every word.

A unit is any stretch of ``width`` consecutive words, white space and line ends counting alike and A-Z
lower-cased, so a passage is found inside a line, over line ends and between edits.  Digests of units
are grouped over all documents; the earliest occurrence (by doc_id, then by the text's hash and the
position) stays, the words of every later one go, and the removed spans keep their offsets in the
original text.  Within one text an occurrence that overlaps the earliest one isn't a later one.

Not all units have to be shuffled.  Of the stretches of ``ANCHOR`` words in a unit the one with the
least hash is its anchor; equal units have equal anchors, neighbouring units mostly share one, so
about a tenth of the words begin an anchor.  Only units with an anchor that comes twice are looked at.
Rows that repeat an earlier row's whole text lose all of it at once and aren't cut into units.

Digests of units have 128 bits.  A unit that a third of all documents hold is pre-aggregated before
it is shuffled and meets its earliest occurrence in a join whose hot partitions can be split.

Defined cases: null or empty texts and those with fewer words than ``width`` stay as they are; rows
with a null doc_id rank first; repeated rows are ranked by their text's hash, and rows that agree in
that too are copies of one row with the same result; an empty table gives no rows; ``dedup_units``
keeps all other columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_list, fresh, mix, pieces, word_hashes, written

WIDTH, ANCHOR = 50, 32
CHUNK_CHARS = 500_000
#: A table of repeated texts, or of rows with removed words, is broadcast up to so many numbers; beyond, it is shuffled.
BROADCAST_NUMBERS = 2_000_000
_WORD = re.compile("[^\x20\x09-\x0d]+")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the polynomials over words


def stretch_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word that has so many."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = words, 1
    total, covered = np.zeros(n, np.uint64), 0
    # by doubling: ``out`` hashes ``done`` words; the binary digits of size say which to put together
    while True:
        if size & done:
            total = total * np.uint64(pow(base, done, 1 << 64)) + out[covered : covered + n]
            covered += done
        if covered == size:
            return mix(total)
        out = out[: len(out) - done] * np.uint64(pow(base, done, 1 << 64)) + out[done:]
        done *= 2


def anchor_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` neighbouring hashes is (the last of equal ones), each place once."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place = np.arange(len(hashes))
    done = 1
    while done < span:  # place[i]: of the least of the ``done`` hashes from i on
        by = min(done, span - done)
        a, b = place[:-by], place[by:]
        place = np.where(hashes[b] <= hashes[a], b, a)
        done += by
    return np.unique(place[:n])


def _own_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def marked_copies(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a boolean: whether an earlier row has the same text."""
    again, low, a, b, ga, gb = (fresh(docs, c) for c in ("again", "low", "text_a", "text_b", "ga", "gb"))
    keyed = docs.withColumns({a: F.xxhash64("text"), b: F.xxhash64(F.lit(7), "text")})
    texts = keyed.groupBy(F.col(a).alias(ga), F.col(b).alias(gb)).agg(F.min(F.struct("doc_id")).alias(low), F.count("*").alias(again)).where(F.col(again) > 1)
    few = _few(written(texts, "repeated-texts"), F.lit(1))
    met = keyed.join(few, (F.col(a) == F.col(ga)) & (F.col(b) == F.col(gb)), "left")
    return met.select(*docs.columns, (F.col(again).isNotNull() & ~F.col("doc_id").eqNullSafe(F.col(f"{low}.doc_id"))).alias(name))


def anchors(docs: DataFrame, width: int) -> DataFrame:
    """Every anchor: h, doc_id, th (hash of the row's text), pos (its first word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            words, counts = word_hashes(texts)
            h, row, pos, at = [], [], [], 0
            every = stretch_hashes(words, ANCHOR, _BASES[0])
            for i, n in enumerate(counts.tolist()):
                if n >= width:
                    own = every[at : at + n - ANCHOR + 1]
                    p = anchor_places(own, width - ANCHOR + 1)
                    h.append(own[p]), pos.append(p), row.append(np.full(len(p), i))
                at += n
            join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            take = pa.array(join(row, np.int64))
            columns = [pa.array(join(h, np.uint64).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(join(pos, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "th", "pos"])

    return _own_key(docs).mapInArrow(run, f"h long, doc_id {dict(docs.dtypes)['doc_id']}, th long, pos int")


def _few(df: DataFrame, numbers: Column) -> DataFrame:
    """A written table, broadcast if it holds few numbers (counted), else left to a shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(numbers + 3)).first()[0] or 0) <= BROADCAST_NUMBERS else df.hint("shuffle_hash")


def unit_occurrences(docs: DataFrame, width: int) -> DataFrame:
    """Units with an anchor that comes twice: digest (a, b), doc_id, th, pos (first word)."""
    seen = written(anchors(docs, width), "anchors")
    twice = written(seen.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("n")).where("n > 1").select("g"), "repeated-anchors")
    at = seen.join(twice, F.col("h") == F.col("g")).groupBy(F.col("doc_id").alias("id"), F.col("th").alias("tk")).agg(F.sort_array(F.collect_set("pos")).alias("at"))
    at = written(at, "anchored").hint("shuffle_hash")
    own = _own_key(docs)
    met = own.join(at, own["doc_id"].eqNullSafe(at["id"]) & (own["th"] == at["tk"])).select("doc_id", "th", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.arange(ANCHOR - width, 1)
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            words, counts = word_hashes(texts)
            a, b = (stretch_hashes(words, width, base) for base in _BASES)
            rows, places, first = [], [], 0
            for i, (n, found) in enumerate(zip(counts.tolist(), column_list(batch, "at"))):
                pos = np.unique(np.asarray(found)[:, None] + before)
                pos = pos[(pos >= 0) & (pos <= n - width)]
                rows.append(np.full(len(pos), i)), places.append(first + pos)
                first += n
            start = np.cumsum(counts) - counts
            row, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, places))
            take = pa.array(row)
            columns = [pa.array(a[place].view(np.int64)), pa.array(b[place].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array((place - start[row]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "doc_id", "th", "pos"])

    return met.mapInArrow(run, f"a long, b long, doc_id {dict(docs.dtypes)['doc_id']}, th long, pos int")


def removed_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row that loses words: doc_id, th, and the runs of lost words (first, end) in order; no text comes twice."""
    seen = written(unit_occurrences(docs, width), "units")
    rank = F.struct("doc_id", "th", "pos")
    grouped = seen.groupBy("a", "b").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    # written, so that both sides of the join are dealt anew and a hot digest's partition can be split
    first = written(grouped.where("n > 1").select("a", "b", "first"), "first-units")
    same_row = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    later = seen.join(first, ["a", "b"]).where(~same_row | (F.col("pos") - F.col("first.pos") >= width))
    lost = later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for at in batch.column(2).to_pylist():
                pos = np.asarray(at)
                cut = np.flatnonzero(np.diff(pos) > width)
                runs.append([{"first": int(x), "end": int(y) + width} for x, y in zip(pos[np.concatenate([[0], cut + 1])], pos[np.concatenate([cut, [len(pos) - 1]])])])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, kind)], ["doc_id", "th", "runs"])

    return written(lost.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, runs array<struct<first: int, end: int>>"), "removed")


def dedup_units(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with later copies of units gone from ``text``, plus removed: array of (start, end).

    The offsets are code points of the original text, end exclusive, from the first to the last word
    of a removed run; the white space around it stays.
    """
    th, key, gone, own_th = (fresh(docs, c) for c in ("th", "key_id", "removed", "own_th"))
    copy = fresh(docs, "copy")
    marked = marked_copies(docs, copy)
    lost = removed_words(marked.where(~F.col(copy)).select("doc_id", "text"), width)
    maps = _few(lost, F.size("runs") * 2).select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("runs").alias(gone))
    own = marked.withColumn(own_th, F.xxhash64("text"))
    met = own.join(maps, own["doc_id"].eqNullSafe(maps[key]) & (own[own_th] == maps[th]), "left").select(*docs.columns, copy, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, found = column_list(batch, "text"), column_list(batch, gone)
            spans: list[list[dict] | None] = [None] * len(text)
            for i, (lost, whole) in enumerate(zip(found, column_list(batch, copy))):
                if lost or whole:
                    at = [m.span() for m in _WORD.finditer(text[i] or "")]
                    if whole:
                        lost = [{"first": 0, "end": len(at)}]
                        if len(at) < width:
                            continue
                    spans[i] = [{"start": at[r["first"]][0], "end": at[r["end"] - 1][1]} for r in lost]
                    edges = [0, *(x for s in spans[i] for x in (s["start"], s["end"])), len(text[i])]
                    text[i] = "".join(text[i][a:b] for a, b in zip(edges[::2], edges[1::2]))
            names = batch.schema.names
            columns = [pa.array(text, batch.schema.field(c).type) if c == "text" else batch.column(k) for k, c in enumerate(names[:-2])]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*names[:-2], gone])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{gone}` array<struct<start: int, end: int>>"
    return met.mapInArrow(run, schema)


def dedup_units_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_removed, spans (start:end, comma-joined, in order), kept_sha256."""
    done = dedup_units(docs.select("doc_id", "text"), width)
    spans = F.transform("removed", lambda u: F.concat_ws(":", u["start"], u["end"]))
    return done.select(
        "doc_id",
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(spans, ","), F.lit("")).alias("spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS parts FROM documents),
parts AS (
    SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM split),
placed AS (
    SELECT *, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto,
           NOT regexp_matches(part, '^[\x20\x09-\x0D]') AS is_word
    FROM parts),
words AS (
    SELECT doc_id, upto - length(part) AS start, upto,
           translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word,
           row_number() OVER (PARTITION BY doc_id ORDER BY i) AS w
    FROM placed WHERE is_word),
lists AS (
    SELECT doc_id, list(word ORDER BY w) AS ws FROM words GROUP BY doc_id HAVING count(*) >= 50),
begun AS (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS w FROM lists),
units AS (
    SELECT doc_id, w, array_to_string(ws[w : w + 49], ' ') AS key FROM begun),
ranked AS (
    SELECT doc_id, w, first_value(doc_id) OVER k AS first_doc, first_value(w) OVER k AS first_w
    FROM units WINDOW k AS (PARTITION BY key ORDER BY doc_id, w)),
lost AS (
    SELECT DISTINCT doc_id, w + d AS w FROM ranked, range(50) AS r(d)
    WHERE doc_id <> first_doc OR w - first_w >= 50),
islands AS (
    SELECT *, w - row_number() OVER (PARTITION BY doc_id ORDER BY w) AS island FROM lost),
spans AS (
    SELECT doc_id, min(start) AS start, max(upto) AS upto FROM islands JOIN words USING (doc_id, w) GROUP BY doc_id, island),
listed AS (
    SELECT doc_id, count(*) AS n_removed, string_agg(start || ':' || upto, ',' ORDER BY start) AS spans FROM spans GROUP BY doc_id),
kept AS (
    SELECT p.doc_id, string_agg(p.part, '' ORDER BY p.i) AS kept FROM placed p
    WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = p.doc_id AND p.upto > s.start AND p.upto <= s.upto)
    GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(l.n_removed, 0) AS n_removed, coalesce(l.spans, '') AS spans, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
