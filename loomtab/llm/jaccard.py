"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct ``width``-word shingles.  Documents with equal sets are one node.
The join has two levels.

First, of each node only the shingles that come first by hash are counted, its frame: whole sets of up
to FRAME, else n - ceil(t n) + 1 + n / 24 of them, FRAME at most.  Any two nodes over the threshold
share at least ``floor_matches`` shingles of their frames, so nodes whose frames hold too many shingles
that no other frame has can't match and are done.  A pair of n and m with o shingles in common shares,
in frames of f and g, min(f - n, g - m) + o for certain.  Where FRAME makes that small, another bound
holds: each of the min(f, g) first shingles of two sets' union is shared with probability >= t, whatever
the texts, so that a number of them is but for a probability under 1e-15, like that of a hash collision
(LEAST or more of FRAME for t = 0.75).

Second, the whole sets of the remaining nodes are ordered rare first by their document frequencies
among those nodes.  Two nodes over the threshold share at least ceil(t n) shingles.  A node picks the
number of matches k that costs least by those frequencies: its prefix is the shortest one in which
every partner must share at least k shingles, so a longer prefix demands more matches.  A pair that
shares the smaller of the two k in its prefixes is verified on its whole sets.

Groups: only lists of a few nodes are paired.  In a longer one, the leader, the node with the smallest
part of shingles of its own, as the source of a group of copies has, is compared with the others.  All
that it is linked to is connected.  A node x that it isn't linked to shares with it a number c of
shingles that is too small for any partner z with t (|x| + |z|) / (1 + t) > c, so z must share some of
what x has outside the leader; x looks for such z under the rarest of those shingles, as many as the
missing number demands, and stays in its list for smaller partners only.  So it goes on with the new
lists, of which long ones get leaders in turn, until all lists are short: what counts of x shrinks each
time, and no list is paired with itself however many copies it holds.

Defined cases: null texts and texts without words are empty sets, linked with nothing (component =
own doc_id); fewer words than ``width`` make the whole sequence the one shingle; a component's id is
its smallest doc_id that isn't null; rows that share a doc_id are sets of their own; extra columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix, pieces, shingle_hashes, written
from .components import components

FRAME, LEAST = 64, 16
CHUNK_CHARS = 500_000
#: Up to this many rows of (node, node) a table is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 2_000_000
#: A verified candidate costs as much as so many list entries.
VERIFY_COST = 16
#: A list with so many goals or fewer is paired; longer ones are compared with a leader.
FEW_GOALS = 8


def _ceil(n, pct: int):
    return -((-n * pct) // 100)


def frame_size(n, pct: int):
    n = np.asarray(n)
    return np.minimum(np.where(n <= FRAME, n, n - _ceil(n, pct) + 1 + n // 24), FRAME)


@cache
def likely_matches(size: int, pct: int) -> int:
    """Of the first ``size`` shingles of a linked pair's union so many are shared, but for a probability under 1e-15."""
    t, below, least = pct / 100, 0.0, 0
    while least < size and (below := below + comb(size, least) * t**least * (1 - t) ** (size - least)) < 1e-15:
        least += 1
    return least


@cache
def _floor(n: int, pct: int) -> int:
    m = np.arange(_ceil(n, pct), n * 100 // pct + 1)
    both = -(-(n + m) * pct // (100 + pct))
    mine, theirs = frame_size(n, pct), frame_size(m, pct)
    certain = np.minimum(mine - n, theirs - m) + both
    likely = np.array([likely_matches(f, pct) for f in range(FRAME + 1)])[np.minimum(mine, theirs)]
    return max(1, int(np.minimum(LEAST, np.maximum(certain, likely)).min(initial=LEAST)))


def floor_matches(n, pct: int):
    """Shingles that two frames share at least: the least over partners of all sizes that the threshold allows."""
    return np.array([_floor(x, pct) for x in np.asarray(n).tolist()], np.int64)


def node_of(shingles: np.ndarray) -> int:
    """64-bit identity of a set."""
    h = np.full(1, len(shingles), np.uint64)
    step = mix(shingles + np.arange(len(shingles), dtype=np.uint64))
    return int((mix(h + step.sum(dtype=np.uint64)) ^ np.bitwise_xor.reduce(mix(step))).view(np.int64)[0])


def shingle_frames(docs: DataFrame, width: int, pct: int) -> DataFrame:
    """Per row: doc_id, th (hash of its text), n (set size), node, frame; a node's frame is given once by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            sets = shingle_hashes(texts, width)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            nodes = [node_of(s) if len(s) else None for s in sets]
            sizes = frame_size(n, pct)
            frames = []
            for s, node, size in zip(sets, nodes, sizes.tolist()):
                fresh_one = node is not None and node not in given
                frames.append(s[:size].view(np.int64) if fresh_one else None)
                given.add(node)
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(nodes, pa.int64()), pa.array(frames, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n", "node", "frame"])

    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return own.mapInArrow(run, f"doc_id {kind}, th long, n long, node long, frame array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (text, want) -> want and its whole set, for rows whose text is the wanted node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            want = batch.column(1).to_pylist()
            rows = [(w, s.view(np.int64)) for w, s in zip(want, shingle_hashes(texts, width)) if len(s) and node_of(s) == w]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["node", "items"])

    return docs.select("text", "want").mapInArrow(run, "node long, items array<long>")


def checked_broadcast(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows (counted), else left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def known_shingles(nodes: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Entries (h, node) of shingles that several nodes have; and per node with some: node, n, size, known (df, h; rare first).

    ``nodes``: node, n, items; a node may come repeatedly.
    """
    tokens = nodes.select("node", F.explode("items").alias("h"))
    shared = written(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), f"{label}-shared")
    entries = written(tokens.join(shared, "h").select("h", "node", "df"), f"{label}-entries")
    met = entries.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("known"))
    about = nodes.groupBy(F.col("node").alias("of")).agg(F.first("n").alias("n"), F.first(F.size("items")).alias("size"))
    return entries, met.join(about, F.col("node") == F.col("of")).select("node", "known", "n", "size")


def prefix_lists(known: DataFrame, floor: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Entries (h, node, n, k, s) of the prefixes that each node chose; nodes that can't match have none.

    ``known``: node, known, n, size.  ``floor``: for set sizes, how many of the items any partner
    shares at least.  s: how many of the items other nodes have.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1)
            flat, ends = given.flatten(), np.asarray(given.offsets)
            df, h = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            node, n, size = (np.asarray(batch.column(i)) for i in (0, 2, 3))
            least = floor(n)
            out_h, out_row, out_k, out_s = [], [], [], []
            for i in range(len(node)):
                a, b = ends[i] - ends[0], ends[i + 1] - ends[0]
                alone = size[i] - (b - a)
                # for k matches, the shared part of the prefix has so many shingles
                k = np.arange(1, least[i] + 1)
                q = size[i] - least[i] + k - alone
                k, q = k[(q > 0) & (q >= k)], q[(q > 0) & (q >= k)]
                if not len(k):
                    continue
                entries = np.cumsum(df[a:b])[np.minimum(q, b - a) - 1]
                best = int(np.argmin(entries * (1 + VERIFY_COST / k)))
                take = int(min(q[best], b - a))
                out_h.append(h[a : a + take])
                out_row.append(np.full(take, i))
                out_k.append(np.full(take, k[best]))
                out_s.append(np.full(take, b - a))
            row = np.concatenate(out_row) if out_row else np.zeros(0, np.int64)
            columns = [np.concatenate(out_h), node[row], n[row], np.concatenate(out_k), np.concatenate(out_s)] if out_h else [row] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "node", "n", "k", "s"])

    chosen = written(known.mapInArrow(choose, "h long, node long, n long, k long, s long"), "prefixes")
    several = chosen.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("many")).where("many > 1").select("g")
    return written(chosen.join(several, F.col("h") == F.col("g"), "left_semi"), "lists")


# --- lists to links: entries are (h, node, n, s, k, goal, lo, hi, root) ------------------------------
#
# A goal looks in its list for partners of lo to hi shingles; an entry that isn't one only gets found.


def _least(n: Column, pct: int) -> Column:
    """Shingles of a partner of n at least."""
    return F.ceil(n * pct / 100)


def _most(n: Column, s: Column, pct: int) -> Column:
    """Shingles of a partner of n at most, s of which other nodes have."""
    return F.least(F.floor(n * 100 / pct), F.floor(s * (100 + pct) / pct) - n)


def with_limits(lists: DataFrame, pct: int) -> DataFrame:
    """The first round's entries: all are goals, for partners of every size that the threshold allows."""
    return lists.select("h", "node", "n", "s", "k", F.lit(True).alias("goal"), _least(F.col("n"), pct).alias("lo"), _most(F.col("n"), F.col("s"), pct).alias("hi"), F.col("node").alias("root"))


def _own(n: Column, s: Column) -> Column:
    """Thousandths of n shingles that no other node has."""
    return F.floor((n - s) * 1000 / n)


def parted(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of lists with few goals, and of all others with their list's leader y (oy, ry).

    The leader is of the component that most of the list is in, and there the node with the smallest part of its own.
    """
    lead = F.min(F.struct(_own(F.col("n"), F.col("s")).alias("own"), "node"))
    rooted = entries.groupBy("h", "root").agg(F.count_if("goal").alias("goals"), F.count("*").alias("all"), lead.alias("lead"))
    rank = F.struct("all", -F.col("lead.own"), "lead.node")
    per = rooted.groupBy("h").agg(F.sum("goals").alias("goals"), F.max_by(F.struct("lead.own", "lead.node", "root"), rank).alias("lead"), F.count("*").alias("roots"))
    # written, so that both sides of the join are dealt anew and a hot shingle's partition can be split
    per = written(per.where("goals > 0 and roots > 1").select("h", "goals", F.col("lead.node").alias("y"), F.col("lead.own").alias("oy"), F.col("lead.root").alias("ry")), "leaders")
    few = entries.join(per.where(F.col("goals") <= FEW_GOALS).select(F.col("h").alias("g")), F.col("h") == F.col("g"), "left_semi")
    many = entries.join(per.where(F.col("goals") > FEW_GOALS).drop("goals"), "h")
    return few, written(many, "led")


def paired(few: DataFrame, pct: int) -> DataFrame:
    """Candidates (x, y) of lists with few goals: each goal with its list's others, if they share as many lists as they must."""
    a, b = (few.select("h", *[F.col(c).alias(c + z) for c in ("node", "n", "s", "k", "goal", "lo", "hi", "root")]) for z in "xy")
    first = F.col("ny").between(F.col("lox"), F.col("hix")) & (~F.col("goaly") | (F.col("nodex") < F.col("nodey")))
    second = F.col("goaly") & F.col("nx").between(F.col("loy"), F.col("hiy")) & (F.col("nodex") < F.col("nodey"))
    both = F.col("ny").between(_least(F.col("nx"), pct), _most(F.col("nx"), F.col("sx"), pct)) & (F.col("nx") <= _most(F.col("ny"), F.col("sy"), pct))
    met = a.where("goalx").join(b, "h").where((F.col("rootx") != F.col("rooty")) & (first | second) & both)
    counted = met.groupBy(F.col("nodex").alias("x"), F.col("nodey").alias("y")).agg(F.count("*").alias("c"), F.min(F.least("kx", "ky")).alias("need"))
    return counted.where("c >= need").select("x", "y")


def stars(led: DataFrame) -> DataFrame:
    """Candidates (x, y, ox, oy) of every long list's leader y with the list's others."""
    others = led.where((F.col("node") != F.col("y")) & (F.col("root") != F.col("ry"))).withColumn("ox", _own(F.col("n"), F.col("s")))
    return others.groupBy(F.col("node").alias("x"), "y").agg(F.first("ox").alias("ox"), F.first("oy").alias("oy"))


def rough_roots(links: DataFrame) -> DataFrame:
    """node, root for nodes linked to one before them in the order of (own, node): the foremost's foremost.

    Nodes with the same root are connected; the rest is left to later.
    """
    a, b = F.struct(F.col("ox").alias("own"), F.col("x").alias("node")), F.struct(F.col("oy").alias("own"), F.col("y").alias("node"))
    down = links.select(F.greatest(a, b).alias("from"), F.least(a, b).alias("to"))
    first = down.groupBy(F.col("from.node").alias("node")).agg(F.min("to").alias("top")).select("node", F.col("top.node").alias("up"))
    over = first.select(F.col("node").alias("mid"), F.col("up").alias("top"))
    return first.join(over, F.col("up") == F.col("mid"), "left").select("node", F.coalesce("top", "up").alias("root"))


def compared(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a written table) with linked, nx, xs (x's shared shingles), ys."""
    few = checked_broadcast(pairs)
    ends = checked_broadcast(written(pairs.select("y").distinct(), "ends"))
    left = sets.join(few, sets["node"] == few["x"]).select(*pairs.columns, F.col("n").alias("nx"), F.col("items").alias("xs"))
    right = sets.join(ends, sets["node"] == ends["y"]).select(F.col("y").alias("z"), F.col("n").alias("nz"), F.col("items").alias("ys"))
    met = left.join(right, F.col("y") == F.col("z"))
    inter = F.size(F.array_intersect("xs", "ys"))
    return met.withColumn("linked", inter * (100 + pct) >= (F.col("nx") + F.col("nz")) * pct)


def remainders(met: DataFrame, before: DataFrame | None, pct: int) -> DataFrame:
    """Per node x that isn't linked to a leader: node, rest, cut, and the shingles of rest to look under (probes), for partners of lo to hi.

    rest: what the shingles of x that still count have outside the leader.  The others, ``covered`` in
    number, are too few for partners of more than ``cut`` shingles, so that these share some of rest.
    Of several leaders that one counts which covers most and leaves sizes to look for; one that
    covers nothing new counts last, as all under rest has been looked for before.
    """
    if before is None:
        cases = met.withColumn("had", F.col("xs"))
    else:
        cases = met.join(before.select(F.col("node").alias("of"), F.col("rest").alias("old")), F.col("x") == F.col("of"), "left").withColumn("had", F.coalesce("old", "xs"))
    cases = cases.select("x", "nx", F.size("had").alias("size"), F.array_except("had", "ys").alias("rest"), F.size("xs").alias("s"))
    cases = cases.withColumn("covered", F.col("s") - F.size("rest")).withColumn("cut", F.floor(F.col("covered") * (100 + pct) / pct) - F.col("nx"))
    hi = _most(F.col("nx"), F.col("s"), pct)
    fewer = F.size("rest") < F.col("size")
    rank = F.when(fewer & (F.col("cut") < hi), F.col("covered").cast("long")).when(fewer, -F.col("covered").cast("long")).otherwise(F.lit(-(1 << 40)))
    best = cases.groupBy("x").agg(F.max_by(F.struct("nx", "s", "size", "rest", "covered", "cut"), rank).alias("b")).select("x", "b.*")
    lo = F.greatest(_least(F.col("nx"), pct), F.col("cut") + 1)
    need = F.ceil((F.col("nx") + lo) * pct / (100 + pct)) - F.col("covered")
    count = F.when((lo <= hi) & (F.size("rest") < F.col("size")), F.greatest(F.size("rest") - need + 1, F.lit(0))).otherwise(0)
    return best.select(F.col("x").alias("node"), F.col("nx").alias("n"), "rest", F.least("cut", hi).alias("cut"), F.slice("rest", F.lit(1), count.cast("int")).alias("probes"), lo.alias("lo"), hi.alias("hi"))


def by_leader(own: DataFrame) -> DataFrame:
    """Entries of long lists, with the lists whose leaders are connected put together where that makes fewer pairs.

    Such lists mostly hold the same nodes, as those of a group of copies do; paired list by list, two nodes
    would meet once for each list that they share.  All pairs of a list are pairs of the lists together.
    """
    pairs = F.col("goals") * F.col("all")
    counted = lambda d, by: d.groupBy(*by).agg(F.count_if("goal").alias("goals"), F.count("*").alias("all"))
    apart_ = counted(own, ["ry", "h"]).groupBy("ry").agg(F.sum(pairs).alias("apart"))
    together = counted(own.groupBy("ry", "node").agg(F.first("goal").alias("goal")), ["ry"]).select("ry", pairs.alias("together"))
    joint = written(apart_.join(together, "ry").where("together < apart").select(F.col("ry").alias("z")), "joint-leaders")
    met = own.join(joint, F.col("ry") == F.col("z"), "left")
    return met.withColumn("h", F.when(F.col("z").isNotNull(), F.xxhash64("z", F.lit(1))).otherwise(F.col("h"))).drop("ry", "z").dropDuplicates(["h", "node"])


def staying(led: DataFrame, left: DataFrame, pct: int) -> DataFrame:
    """Of long lists, the nodes of ``left`` that look for partners up to their cut, and all that small."""
    own = led.where("node <> y").select("h", "ry", "node", "n", "s", "root").join(left.select("node", "cut"), "node", "left")
    own = written(own.withColumn("goal", F.coalesce(F.col("cut") >= _least(F.col("n"), pct), F.lit(False))), "staying-lists")
    own = written(by_leader(own), "staying")
    most = written(own.where("goal").groupBy(F.col("h").alias("g")).agg(F.max("cut").alias("most")), "caps")
    kept = own.join(most, F.col("h") == F.col("g")).where("goal or n <= most")
    return kept.select("h", "node", "n", "s", F.lit(1).alias("k"), "goal", _least(F.col("n"), pct).alias("lo"), F.col("cut").alias("hi"), "root")


def next_entries(left: DataFrame, index: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists of the probes of ``left``: under each, its goals and all nodes of the sizes that they look for."""
    probes = written(left.select(F.explode("probes").alias("h"), "node", "lo", "hi"), "probes")
    asked = checked_broadcast(written(probes.groupBy(F.col("h").alias("g")).agg(F.min("lo").alias("least"), F.max("hi").alias("most")), "asked"))
    about = sets.select("node", "n", F.size("items").cast("long").alias("s"))
    there = index.join(asked, F.col("h") == F.col("g")).select("h", "node", "least", "most").join(about, "node")
    there = there.join(probes.withColumnRenamed("node", "of").withColumnRenamed("h", "g"), (F.col("h") == F.col("g")) & (F.col("node") == F.col("of")), "left")
    there = there.where("of is not null or n between least and most").join(roots, "node", "left")
    return written(there.select("h", "node", "n", "s", F.lit(1).alias("k"), F.col("of").isNotNull().alias("goal"), "lo", "hi", F.coalesce("root", "node").alias("root")), "entries")


def renamed(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """``entries`` with their nodes' present roots."""
    return entries.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def linked_among(entries: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    pairs = written(paired(entries, pct), "pairs")
    return written(compared(pairs, sets, pct).where("linked").select("x", "y"), "links")


def apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The compared pairs (x, y) that are neither linked nor connected by the links so far."""
    to_x, to_y = (roots.select(F.col("node").alias(f"of{z}"), F.col("root").alias(f"root{z}")) for z in "xy")
    both = met.where("not linked").join(to_x, F.col("x") == F.col("ofx"), "left").join(to_y, F.col("y") == F.col("ofy"), "left")
    return both.where(F.coalesce("rootx", "x") != F.coalesce("rooty", "y")).select(*met.columns)


def links_of(lists: DataFrame, index: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Links (x, y) that connect what belongs together.  ``index``: entries (h, node) of whole sets."""
    entries, left, found, star_links = with_limits(lists, pct), None, [], None
    while True:
        few, led = parted(entries)
        found.append(linked_among(few, sets, pct))
        if led.isEmpty():
            return reduce(DataFrame.unionByName, found)
        met = compared(written(stars(led), "star-pairs"), sets, pct)
        met = written(met.select("x", "y", "ox", "oy", "nx", "linked", F.when(~F.col("linked"), F.col("xs")).alias("xs"), F.when(~F.col("linked"), F.col("ys")).alias("ys")), "met")
        new = met.where("linked").select("x", "y", "ox", "oy")
        star_links = new if star_links is None else star_links.unionByName(new)
        found.append(new.select("x", "y"))
        roots = written(rough_roots(star_links), "roots")
        now = written(remainders(apart(met, roots), left, pct), "remainders")
        found.append(linked_among(staying(renamed(led, roots), now, pct), sets, pct))
        entries = next_entries(now, index, sets, roots)
        kept = now.select("node", "rest")
        left = kept if left is None else written(left.join(kept.select("node"), "node", "left_anti").unionByName(kept), "rests")


def classed(docs: DataFrame, width: int, pct: int) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, n, node; and per node of, root, component."""
    members = written(shingle_frames(docs, width, pct), "frames")
    framed = members.where(F.col("frame").isNotNull()).select("node", "n", F.col("frame").alias("items"))
    maybe = prefix_lists(known_shingles(framed, "frame")[1], lambda n: floor_matches(n, pct)).select("node").distinct()
    low = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    wanted = written(maybe.join(low, "node"), "wanted")
    few = checked_broadcast(wanted.select(F.col("node").alias("want"), F.col("low").alias("want_doc")))
    sets = written(shingle_sets(docs.select("doc_id", "text").join(few, F.col("doc_id").eqNullSafe(F.col("want_doc"))), width), "sets")
    index, known = known_shingles(sets.select("node", F.size("items").cast("long").alias("n"), "items"), "set")
    known = written(known, "known")
    lists = prefix_lists(known, lambda n: np.maximum(1, _ceil(n, pct)))
    shared = known.select("node", "n", F.col("known.h").alias("items"))
    found = written(components(links_of(lists, index, shared, pct), "x", "y"), "components")
    # the class of a row: by its node, or by itself if its set is empty
    classes = low.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component"))
    named = written(classes.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("of"), "root", "component"), "classes")
    return members, named


def near_duplicates(docs: DataFrame, width: int = 5, pct: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    members, named = classed(docs, width, pct)
    met = members.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, F.col("node") == F.col("of"), "left")
    return met.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, pct: int = 75) -> DataFrame:
    """``docs`` without the rows of a component but one; columns unchanged.

    The row with the smallest doc_id stays, a null one only where all are null; of several rows with
    that doc_id the one whose text has the smallest hash, and of copies of that row any.  Rows are
    told apart by doc_id and text, so others with the same doc_id, or none, stay.
    """
    members, named = classed(docs, width, pct)
    th, gone_th, gone_id = fresh(docs, "th"), fresh(docs, "gone_th"), fresh(docs, "gone_id")
    rows = written(members.where("n > 0").join(named, F.col("node") == F.col("of")).groupBy("root", "doc_id", "th").agg(F.count("*").alias("n")), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    # written, so that both sides of the join are dealt anew and a large component's partition can be split
    first = written(rows.groupBy(F.col("root").alias("r")).agg(F.min(rank).alias("first"), F.sum("n").alias("all")).where("all > 1").select("r", "first"), "first-rows")
    met = rows.join(first, F.col("root") == F.col("r"))
    gone, repeated = (
        written(met.where(which).select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)), name)
        for which, name in ((rank > F.col("first"), "gone"), ((rank == F.col("first")) & (F.col("n") > 1), "repeated"))
    )

    def same(few: DataFrame) -> Column:
        return F.col("doc_id").eqNullSafe(few[gone_id]) & (F.col(th) == few[gone_th])

    few = checked_broadcast(gone)
    kept = docs.withColumn(th, F.xxhash64("text")).join(few, same(few), "left_anti")
    if not repeated.isEmpty():
        many = checked_broadcast(repeated)
        kept = kept.join(many, same(many), "left_anti").unionByName(kept.join(many, same(many), "left_semi").dropDuplicates(["doc_id", th]))
    return kept.select(*docs.columns)
