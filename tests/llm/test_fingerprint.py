"""Bottom-k sketches against whole sets, and the query against a brute-force version."""

import hashlib
import re

import numpy as np
import pytest

from loomtab.llm import fingerprint

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
ROWS = [
    (1, "a b c d e f g"), (2, "A b  c d\te f g"), (3, None), (4, ""), (5, "one two"), (6, LONG), (7, LONG + " end"), (8, "é" * 7 + " 日本 語 x y z"),
    (9, LONG[: len(LONG) // 2]), (11, "x"), (11, "repeated id, other text"), (11, "x"), (None, "no id at all"), (None, None), (-5, "below zero is an id as well"),
]


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, hashes):
    """Rows in the query's order with their exact likeness; ``hashes``: the order of texts that share an id."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    out = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        text = t or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        out.append((d, len(text), hashlib.sha256(new.encode()).hexdigest(), jaccard(shingles(text), shingles(new)), jaccard(shingles(text), shingles(after))))
    return out


def held_against(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(parts)
    hashes = {r[0]: r[1] for r in df.selectExpr("text", "xxhash64(text)").distinct().collect()}
    got = fingerprint.compared_with_next(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[4])
    want = sorted(brute(rows, hashes), key=key)
    got = sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[2], r.near_next))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want):
        assert abs(r.near_edited - w[3]) < 0.13 and abs(r.near_next - w[4]) < 0.13
        if r.n_chars < 200:  # sets that are held whole
            assert abs(r.near_edited - w[3]) < 1e-12
    return got


@pytest.mark.parametrize("parts", [1, 4])
def test_query_is_brute_force(spark, parts):
    got = held_against(spark, ROWS, parts)
    prints = {}
    for r in got:
        prints.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    by_id = {r.doc_id: r.fingerprint for r in got}
    assert by_id[1] == by_id[2] and by_id[4] == by_id[3] == ""


def test_many_ranges_and_hot_ids(spark, monkeypatch):
    """Ranges smaller than an id's rows, nulls among them, and empty ranges."""
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 200)
    monkeypatch.setattr(fingerprint, "MANY", 5)
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(40)]
    rows = [(d, " ".join(rng.choice(words, rng.integers(0, 25)))) for d in [*range(0, 600, 7), *[300] * 60, *[None] * 60, *[2**60] * 2]]
    held_against(spark, rows)


def test_single_row_and_empty_table(spark):
    one = fingerprint.compared_with_next(spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.compared_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates(spark):
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**48, n, dtype=np.uint64)) for n in (30_000, 20_000))
    b = np.unique(np.concatenate([b, a[::3]]))
    x, y = fingerprint.bottom(a), fingerprint.bottom(b)
    exact = jaccard(set(a.tolist()), set(b.tolist()))
    assert abs(fingerprint.resemblance(x, y) - exact) < 0.1
    assert abs(fingerprint.containment(x, y) - 1 / 3) < 0.12
    assert abs(fingerprint.distinct(x) / len(a) - 1) < 0.2
    assert np.array_equal(fingerprint.merged(x, y), fingerprint.bottom(np.union1d(a, b)))
    for s in (x, y, x[:3], x[:0]):
        assert np.array_equal(fingerprint.decoded(fingerprint.encoded(s)), s)
    codes = [fingerprint.encoded(x[i : i + 1]) for i in range(len(x))]
    assert codes == sorted(codes)
    few = fingerprint.bottom(a[:100])
    assert fingerprint.distinct(few) == 100 and fingerprint.containment(few, fingerprint.bottom(a[:150])) == 1.0
    assert fingerprint.containment(x[:0], x) == 1.0 and fingerprint.resemblance(x[:0], x) == 0.0
    pairs = spark.createDataFrame([(1, fingerprint.encoded(x), fingerprint.encoded(y)), (2, None, "")], "i int, a string, b string")
    got = {r.i: r for r in fingerprint.likeness(pairs, "a", "b").collect()}
    assert got[1].resemblance == fingerprint.resemblance(x, y) and got[1].n_a == fingerprint.distinct(x)
    assert (got[2].resemblance, got[2].containment, got[2].n_a) == (1.0, 1.0, 0.0)


def test_parts_merge_to_the_whole(spark):
    """Fingerprints of a source's documents, merged, are the fingerprint of all their shingles."""
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 90))), "hot" if i % 3 else f"s{i % 5}") for i in range(400)] + [(900, None, None), (901, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    prints = fingerprint.fingerprints(docs).withColumnRenamed("doc_id", "d")
    got = fingerprint.merged_by(prints.join(docs, prints["d"] == docs["doc_id"]), "source").collect()
    want = {}
    for _, t, s in rows:
        want.setdefault(s, []).append(fingerprint.sketches([t or ""])[0])
    assert {r.source: r.fingerprint for r in got} == {s: fingerprint.encoded(np.unique(np.concatenate(p))[: fingerprint.K]) for s, p in want.items()}
