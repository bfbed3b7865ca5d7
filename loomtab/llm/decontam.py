"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised (lower-cased, white space collapsed).  An item of length
m within e edits of a stretch of a text shares at least m - q + 1 - q e of its q-grams with it, all on
diagonals that differ by at most e.  So shared q-grams are counted in overlapping bands of diagonals;
bands that reach that bound are aligned, within the band, and reported if the edits fit the budget.

The benchmark is searched in blocks of at most BLOCK_BYTES of items, each broadcast with the search
of all documents, so a large benchmark takes more passes.

Defined cases: null or empty texts and items match nothing; items with fewer than MIN_ITEM normalised
bytes have to be found unchanged, and those with fewer than Q, which have no q-gram, have to be all
of a text, as they can't be told from ordinary words elsewhere; repeated rows are searched each;
rows with a null doc_id or item_id are kept as such; an empty documents or benchmark table gives no
matches; other columns are left out of matches and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _power_table, mix, pieces

Q, EDIT_SHARE, MIN_ITEM = 10, 0.08, 30
BLOCK_BYTES = 4_000_000
CHUNK_CHARS = 2_000_000
PAIRS = 2_000_000  # pairs of a text's and an item's q-grams that are counted at a time
_FILTER = 1 << 24  # slots of the first, approximate test
_BASE = 0x9E3779B97F4A7C15
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised UTF-8 bytes, and the code point of ``text`` that each belongs to."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters grow; then only A-Z are lower-cased, so that offsets hold
        lower = text.translate(_ASCII_LOWER)
    data = np.frombuffer(lower.encode("utf-8", "surrogatepass"), np.uint8)
    blank = _BLANK[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    point = np.cumsum((data & 0xC0) != 0x80) - 1
    out = data[keep]
    out[_BLANK[out]] = 32
    return out, point[keep]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams."""
    n = len(data) - q + 1
    out = np.zeros(max(n, 0), np.uint64)
    powers = _power_table(_BASE, q)
    if n > 0:
        wide = data.astype(np.uint64) + np.uint64(1)
        for k in range(q):
            out += wide[k : k + n] * powers[k]
    return mix(out)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q, share: float = EDIT_SHARE):
        self.q = q
        kept = [(i, normalised(t.strip(" \t\n\x0b\x0c\r"))[0]) for i, t in items if t]
        kept = [(i, d) for i, d in kept if len(d)]
        self.ids, self.data = [i for i, _ in kept], [d for _, d in kept]
        length = np.array([len(d) for d in self.data], np.int64)
        # short items have to be found unchanged, and those without a q-gram have to be all of a text
        self.budget = np.where(length < MIN_ITEM, 0, np.minimum((share * length).astype(np.int64), (length - q) // q))
        self.bound = np.maximum(length - q + 1 - q * self.budget, 1)
        self.whole: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(length < q).tolist():
            self.whole.setdefault(self.data[k].tobytes(), []).append(k)
        filtered = self.bound[length >= q]
        all_grams = [grams(d, q) for d in self.data]
        hashes = np.concatenate([*all_grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(kept)), [len(g) for g in all_grams])
        pos = np.concatenate([*[np.arange(len(g)) for g in all_grams], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.pos = hashes[order], item[order], pos[order]
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[(self.hashes & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        self.least = int(filtered.min()) if len(filtered) else 1
        self.width = int(self.budget.max()) + 1 if len(kept) else 1

    def bands(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, diagonals) of the bands of a text that reach their item's bound."""
        g = grams(data, self.q)
        at = np.flatnonzero(self.maybe[(g & np.uint64(_FILTER - 1)).astype(np.int64)])
        if len(at) < self.least:
            return []
        left = np.searchsorted(self.hashes, g[at], "left")
        many = np.searchsorted(self.hashes, g[at], "right") - left
        at, left, many = at[many > 0], left[many > 0], many[many > 0]
        # repetitive texts share every gram with every place of repetitive items: so many pairs at a time
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1).tolist(), len(at)]
        slices = [(at[a:b], left[a:b], many[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]

        def pairs(at: np.ndarray, left: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            entry = np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())
            return self.item[entry], np.repeat(at, many) - self.pos[entry]

        # enough shared q-grams in the whole text at all
        shared = np.zeros(len(self.ids), np.int64)
        for part in slices:
            shared += np.bincount(pairs(*part)[0], minlength=len(self.ids))
        enough = shared >= self.bound
        if not enough.any():
            return []
        found, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in slices:
            item, diagonal = pairs(*part)
            item, diagonal = item[enough[item]], diagonal[enough[item]]
            band = np.floor_divide(diagonal, self.budget[item] + 1)
            key, n = np.unique(np.concatenate([(item << np.int64(40)) + band, (item << np.int64(40)) + band - 1]), return_counts=True)
            if len(found):
                key, back = np.unique(np.concatenate([found, key]), return_inverse=True)
                n = np.bincount(back, np.concatenate([count, n]), len(key)).astype(np.int64)
            found, count = key, n
        item = (found + (1 << 39)) >> np.int64(40)
        band = found - (item << np.int64(40))
        good = count >= self.bound[item]
        return [(int(i), int(b * (self.budget[i] + 1)), int(2 * (self.budget[i] + 1))) for i, b in zip(item[good], band[good])]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in code points of the text, best first where stretches overlap."""
        data, at = normalised(text)
        raw = data.tobytes()
        found: set[tuple[int, int, int, int]] = set()
        if len(raw) < self.q + 2:
            own = raw.strip(b" ")
            found |= {(0, k, raw.find(own), raw.find(own) + len(own)) for k in self.whole.get(own, ())}
        exact: dict[int, list[int]] = {}
        rest = []
        for item, first, many in self.bands(data):
            own, budget = self.data[item], int(self.budget[item])
            start = raw.find(own.tobytes(), max(0, first - budget), first + many + budget + len(own))
            if start >= 0:
                found.add((0, item, start, start + len(own)))
                exact.setdefault(item, []).append(start)
            else:
                rest.append((item, first, many))
        for item, first, many in rest:
            own, budget = self.data[item], int(self.budget[item])
            reach = len(own) - 2 * budget  # nearer than this, all that the band holds overlaps the exact match
            if any(first > start - reach and first + many < start + reach for start in exact.get(item, ())):
                continue
            hit = align(own, data, first, many, budget)
            if hit:
                found.add((hit[2], item, hit[0], hit[1]))
        out: list[tuple[int, int, int, int]] = []
        for edits, item, a, b in sorted(found):
            start, end = int(at[a]), int(at[b - 1]) + 1
            if all(item != x[0] or end <= x[1] or start >= x[2] for x in out):
                out.append((item, start, end, edits))
        return sorted(out, key=lambda x: (x[1], x[0]))


def _ends(item: np.ndarray, text: np.ndarray, first: int, many: int, free: bool) -> np.ndarray:
    """Edit distances of the whole item to stretches of the text, by the diagonal where they end.

    Only cells on the given diagonals count; a stretch starts anywhere (free) or on diagonal 0.
    """
    far = 1 << 20
    at = first + np.arange(many)
    padded = np.full(len(item) + many + 1, 256, np.int64)  # text[first ...], 256 where there is none
    lo, hi = max(first, 0), min(first + len(padded), len(text))
    if lo < hi:
        padded[lo - first : hi - first] = text[lo:hi]
    inside = (at >= 0) & (at <= len(text))
    row = np.where(inside, 0, far) if free else np.where(at >= 0, at, far)
    step = np.arange(many)
    for i in range(len(item)):
        same = padded[i : i + many] != item[i]
        change = row + np.where(padded[i : i + many] == 256, far, same)
        drop = np.append(row[1:], far) + 1
        best = np.minimum(change, drop)
        # a run of added characters goes along the diagonals
        row = np.minimum.accumulate(best - step) + step
        end = at + i + 1
        row = np.where((end >= 0) & (end <= len(text)), row, far)
    return row


def align(item: np.ndarray, text: np.ndarray, first: int, many: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best stretch within the band, or None over budget."""
    first, many = first - budget, many + 2 * budget
    row = _ends(item, text, first, many, True)
    k = int(row.argmin())
    edits = int(row[k])
    if edits > budget:
        return None
    end = first + k + len(item)
    # the same from the end backwards tells where it starts
    back = _ends(item[::-1], text[:end][::-1], -budget, 2 * budget + 1, False)
    size = len(item) - budget + int(np.flatnonzero(back == back.min())[-1])
    return end - min(size, end), end, edits


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, as it streams in."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = row["text"] or ""
        if held and size + len(text) > BLOCK_BYTES:
            yield Index(held)
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield Index(held)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points of the original text, end exclusive), edits."""
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, start long, end long, edits int"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = shared.value
            names = pa.array(found.ids, pa.int64() if item_kind in ("bigint", "int") else None)
            for batch, texts in pieces(batches, "text", CHUNK_CHARS):
                rows = []
                for i, text in enumerate(texts):
                    rows += [(i, *m) for m in found.matches(text)]
                columns = list(zip(*rows)) if rows else [[]] * 5
                ints = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(ints[0]), names.take(ints[1]), ints[2], ints[3], ints[4].cast(pa.int32())], ["doc_id", "item_id", "start", "end", "edits"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their columns."""
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches, "text", CHUNK_CHARS):
                yield batch.filter(pa.array([not shared.value.matches(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
