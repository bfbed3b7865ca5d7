"""Source divergence audit: which sources of a language use other terms than the rest, by three-dimensional cubes.

Terms are counted in tasks and added up by (lang, source, term).  A language keeps the terms that enough
of its documents hold.  A group (lang, source) gives each kept term a share p of a billion, smoothed by
``SMOOTH``, in whole numbers.

Divergences of pairs come from cubes: a language's groups are dealt into blocks of about ``GROUPS``, its
terms into blocks of about ``TERMS``; the slice of a group block and a term block is built once and
sent to every cell (group block, group block, term block) that needs it.  A cell adds up the differences
of its pairs over its terms, and a sum over the cells along the term axis gives whole divergences.  Only
terms that a group has are sent; all others have the group's least share.  A cell's size doesn't depend
on the table's, and no group, however many rows it has, is more than a row of its slices.

Defined cases: null text, lang and source are empty strings; only A-Z are lower-cased; rows are counted
whatever their doc_id is, copies as often as they come (a term's documents are rows); a group without
terms has the least share everywhere; a language without kept terms has divergences 0 and no terms; a
language's only source has no pairs; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .collocation import Container
from .common import give_back, pieces, written
from .jaccard import checked_broadcast

CHUNK_CHARS = 500_000
SMOOTH, WHOLE = 5, 1_000_000_000
GROUPS, TERMS = 64, 4096
#: Counts, terms or groups that a task holds before it gives its counts on, in batches of so many.
HELD, BATCH = 1_500_000, 20_000

_LETTERS = bytearray(b" " * 65 + bytes(range(97, 123)) + b" " * 6 + bytes(range(97, 123)) + b" " * 5 + bytes(range(128, 256)))


def terms_of(text: str) -> list[bytes]:
    """Runs of letters A-Z, lower-cased, and of code points above U+007F."""
    return text.encode("utf-8", "surrogatepass").translate(bytes(_LETTERS)).split()


class _Numbers(dict):
    """Numbers of things in the order they are met, from 1."""

    def __missing__(self, thing) -> int:
        self[thing] = i = len(self) + 1
        return i


def counted_terms(docs: DataFrame) -> DataFrame:
    """Partial counts: lang, source, term, count; and for a null source the number of the language's rows with the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, groups, held = _Numbers(), _Numbers(), Container()

        def given() -> Iterator[pa.RecordBatch]:
            keys, counts = held.items()
            names = [pa.array([None, *(g[i] for g in groups)], pa.string()) for i in (0, 1)]
            text = pa.array([None, *terms], pa.binary()).cast(pa.string())
            for i in range(0, len(keys), BATCH):
                group, term = pa.array(keys[i : i + BATCH] >> 32), pa.array(keys[i : i + BATCH] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([names[0].take(group), names[1].take(group), text.take(term), pa.array(counts[i : i + BATCH])], ["lang", "source", "term", "count"])

        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            found = [terms_of(t) for t in texts]
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(map(terms.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
            # each document's terms once, with their counts
            each, counts = np.unique(np.repeat(np.arange(len(n)), n) << 32 | ids, return_counts=True)
            row, term = each >> 32, each & 0xFFFFFFFF
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            of_group = np.array([groups[g] for g in zip(langs, sources)], np.int64)
            of_lang = np.array([groups[g, None] for g in langs], np.int64)
            keys = np.concatenate([of_group[row] << 32 | term, of_lang[row] << 32 | term])
            if len(keys):
                counts = np.concatenate([counts, np.ones(len(row), np.int64)])
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                held.add(keys[first], np.add.reduceat(counts, first))
            if max(held.used, len(terms), len(groups)) > HELD:
                yield from given()
                terms, groups, held = _Numbers(), _Numbers(), Container()
        yield from given()
        terms, groups, held = _Numbers(), _Numbers(), Container()
        give_back()

    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), "text").mapInArrow(run, "lang string, source string, term string, count long")


def share(count: Column | str, n: str, terms: str) -> Column:
    """1 + floor(WHOLE * (count + SMOOTH) / (n + SMOOTH * terms)), exact."""
    wide = lambda c: F.expr(f"CAST({c} AS DECIMAL(19, 0))")
    top = F.lit(WHOLE).cast("decimal(10,0)") * (wide(count) + F.lit(SMOOTH).cast("decimal(1,0)"))
    below = wide(n) + F.lit(SMOOTH).cast("decimal(1,0)") * wide(terms)
    return F.call_function("div", top, below) + 1


def prepared(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Groups with their places in the cubes, and shares of the terms that groups have.

    Groups: lang, source, n, v (the language's kept terms), blocks, tblocks (of groups, of terms), i, at (block and
    place in it), p0 (share of a term that the group hasn't).  Shares: lang, source, term, k, t (term block and
    place), vk (terms of the block), p, q (the language's share), i, at.
    """
    partial = written(counted_terms(docs), "terms")
    kept = partial.where("source is null").groupBy("lang", "term").agg(F.sum("count").alias("docs")).where(F.col("docs") >= least_docs)
    kept = written(kept.select("lang", "term"), "kept-terms")
    # both sides dealt by language and term: a term has at most a task's rows for each task
    counts = partial.where("source is not null").join(kept, ["lang", "term"], "left_semi").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
    counts = written(counts, "term-counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    found = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    of_group = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = found.join(of_group, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    langs = groups.groupBy("lang").agg(F.count("*").alias("g"), F.sum("n").alias("m")).join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    langs = written(langs.select("lang", "m", "v", blocks("g", GROUPS).alias("blocks"), blocks("v", TERMS).alias("tblocks")), "languages")
    about = checked_broadcast(langs)
    # a block's rows: about GROUPS or TERMS, as hashes deal them
    placed = groups.join(about, "lang").withColumn("i", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("at", F.row_number().over(W.partitionBy("lang", "i").orderBy("source")) - 1)
    placed = placed.withColumn("p0", F.when(F.col("v") > 0, share("0", "n", "v")).otherwise(0).cast("long"))
    placed = written(placed, "groups")
    totals = counts.groupBy("lang", "term").agg(F.sum("count").alias("all")).join(about, "lang")
    totals = totals.withColumn("k", F.pmod(F.xxhash64("term"), F.col("tblocks")).cast("int")).withColumn("q", share("all", "m", "v"))
    totals = totals.withColumn("t", F.row_number().over(W.partitionBy("lang", "k").orderBy("term")) - 1).select("lang", "term", "k", "t", "q")
    few = checked_broadcast(placed.select("lang", "source", "n", "v", "i", "at"))
    shares = counts.join(totals, ["lang", "term"]).join(few, ["lang", "source"])
    return placed, written(shares.select("lang", "source", "term", "k", "t", share("count", "n", "v").alias("p"), "q", "i", "at"), "shares")


def slices(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Per (lang, i, k): sources, p0 (by place), terms (of the block), at, t, p (of what its groups have); blocks."""
    heads = groups.groupBy("lang", "i").agg(F.sort_array(F.collect_list(F.struct("at", "source", "p0"))).alias("g"), F.first("blocks").alias("blocks"), F.first("tblocks").alias("tblocks"))
    heads = heads.select("lang", "i", F.col("g.source").alias("sources"), F.col("g.p0").alias("p0"), "blocks", F.explode(F.sequence(F.lit(0), F.col("tblocks") - 1)).alias("k"))
    held = shares.groupBy("lang", "i", "k").agg(F.collect_list(F.struct("at", "t", "p")).alias("e"))  # at most a block of groups by a block of terms
    sizes = shares.groupBy("lang", "k").agg((F.max("t") + 1).alias("terms"))
    met = heads.join(held, ["lang", "i", "k"], "left").join(sizes, ["lang", "k"], "left")
    return met.select("lang", "i", "k", "blocks", "sources", "p0", F.coalesce("terms", F.lit(0)).alias("terms"), *[F.col(f"e.{c}").alias(c) for c in ("at", "t", "p")])


def cell_sums(cells: DataFrame) -> DataFrame:
    """lang, source, other, value: each cell's sums of differences over its terms, of each pair once."""

    def matrix(row: list, terms: int) -> np.ndarray:
        p0, at, t, p = row
        m = np.repeat(np.asarray(p0, np.int64)[:, None], terms, 1)
        if at is not None:
            m[np.asarray(at), np.asarray(t)] = p
        return m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                lang, same, terms = (batch.column(c)[r].as_py() for c in range(3))
                # a slice's numbers as arrays, not as objects
                arrays = [v.values.to_numpy() if (v := batch.column(c)[r]).is_valid else None for c in (4, 5, 6, 7, 9, 10, 11, 12)]
                a, b = matrix(arrays[:4], terms), matrix(arrays[4:], terms)
                mine, theirs = batch.column(3)[r].as_py(), batch.column(8)[r].as_py()
                left, right, sums = [], [], []
                for x in range(len(mine)):
                    first = x + 1 if same else 0
                    left += [mine[x]] * (len(theirs) - first)
                    right += theirs[first:]
                    sums.append(np.abs(b[first:] - a[x]).sum(1))
                columns = [pa.array([lang] * len(left), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(np.concatenate(sums) if sums else [], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "other", "value"])

    return cells.mapInArrow(run, "lang string, source string, other string, value long")


def pair_divergences(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value: sum of differences over all kept terms."""
    each = written(slices(groups, shares), "slices")
    body = ["sources", "p0", "at", "t", "p"]
    to_left = each.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)))
    to_right = each.withColumn("j", F.col("i")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j"))))
    right = to_right.select("lang", "i", "j", "k", *[F.col(c).alias(f"{c}_") for c in body])
    cells = to_left.join(right.hint("shuffle_merge"), ["lang", "i", "j", "k"]).select("lang", (F.col("i") == F.col("j")).alias("same"), "terms", *body, *[f"{c}_" for c in body])
    sums = cell_sums(cells).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("s"), F.col("other").alias("item")), F.struct(F.col("other").alias("s"), F.col("source").alias("item"))))
    return sums.select("lang", both.alias("b"), "value").select("lang", F.col("b.s").alias("source"), "b.item", "value")


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of a lang's sources, and each group's ``top`` terms above the lang's share."""
    groups, shares = prepared(docs, least_docs)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    # a group's pairs are as many as its language has other sources
    pairs = pair_divergences(groups, shares).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # Spark cuts by this rank before its shuffle, so that a group of many terms comes in few rows
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(out).unionByName(terms.select(out))


ORACLE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (
    SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(c) FROM counts x WHERE x.lang = g.lang AND x.source = g.source), 0) AS n
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes USING (lang)),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
           CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (CAST(g.n AS HUGEINT) + 5 * g.v) AS BIGINT) AS p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
langs AS (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL),
wholes AS (SELECT lang, sum(c) AS n FROM langs GROUP BY lang),
lang_shares AS (
    SELECT l.lang, l.term, CAST(1 + (1000000000::HUGEINT * (CAST(l.c AS HUGEINT) + 5)) // (CAST(n AS HUGEINT) + 5 * v) AS BIGINT) AS q
    FROM langs l JOIN wholes USING (lang) JOIN sizes USING (lang)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(coalesce((
        SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term)
        WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
    SELECT s.lang, s.source, s.term AS item, s.p - l.q AS value FROM shares s JOIN lang_shares l USING (lang, term) WHERE s.c > 0 AND s.p > l.q),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
