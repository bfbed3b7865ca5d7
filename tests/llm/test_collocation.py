"""HAT-tries against plain counts, and the query against a brute-force version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomtab.llm import collocation

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, cell int"


def brute(rows, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        covered = Counter()
        for p, a in counts.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    covered[q] = max(covered[q], a)
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not (covered[p] and 100 * covered[p] >= cover * a):
                cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_like(seed, n=400):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "New", "york", "city", "é", "É", "日本", "a\x0bb", "x\x00y", "nbsp\xa0word", *[f"w{i}" for i in range(25)]]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ", " ", " ", " \x0d\x0c"]
    rows = [(i, "".join(w + e for w, e in zip(rng.choice(words, 30), rng.choice(ends, 30))), ["en", "fr", None, "und", ""][i % 7 % 5], "p", i) for i in range(n)]
    rows += [(1, "hot pair " * 400, "en", None, None), (None, None, "en", None, 1), (2, "", None, "", 2), (2, "a a a a a a a a a a a a a a", "aa", "", 2), (3, "rare words only", "xx", "", 2)]
    return rows


@pytest.fixture
def small(monkeypatch):
    """Containers, tries, word tables and merges so small that all bounds are met."""
    for name, value in {"BURST": 8, "HELD": 100, "MERGED": 50, "CELL_BYTES": 200, "CHUNK_WORDS": 7, "HELD_LANGS": 2, "CHUNK_CHARS": 300, "WAITING": 10, "RUN": 40}.items():
        monkeypatch.setattr(collocation, name, value)
    monkeypatch.setattr(collocation, "WORD_BYTES", 100)


def test_query_is_brute_force(spark):
    rows = rows_like(1)
    got = collocation.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_under_small_bounds(spark, small):
    rows = rows_like(2, 250)
    got = collocation.merged_runs(collocation.spilled_runs(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 32), 8, 1)
    f = {(r.lang, r.phrase): r.f for r in got.collect()}
    want = Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        want[lang, ""] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            want[lang, ""] += len(w)
            want.update((lang, " ".join(w[i : i + s])) for s in (1, 2, 3) for i in range(len(w) - s + 1))
    assert f == {k: v for k, v in want.items() if v}


def test_ranks_are_cut_per_language(spark):
    rows = rows_like(3)
    got = collocation.collocations(spark.createDataFrame(rows, SCHEMA), least=3, top=5, cover_pct=80)
    assert sorted(map(tuple, got.collect())) == brute(rows, least=3, cover=80, top=5)


def test_empty_tables_and_no_candidates(spark):
    assert collocation.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocation.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "few words", "en", None, None)], SCHEMA)).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    """Scores of phrases so frequent that a * a * 1000000 passes 64 bits."""
    big = [("en", "", 10**13), ("en", "x", 3 * 10**12), ("en", "y", 4 * 10**12), ("en", "x y", 2 * 10**12 + 1)]
    monkeypatch.setattr(collocation, "frequent_phrases", lambda docs, *_: docs)
    got = collocation.collocations(spark.createDataFrame(big, "lang string, phrase string, f long")).collect()
    a, left, right = 2 * 10**12 + 1, 3 * 10**12, 4 * 10**12
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, left, right, 10**13, 1000000 * a * a // (left * right))]


@pytest.mark.parametrize("seed", range(4))
def test_trie_is_a_counter(monkeypatch, seed):
    monkeypatch.setattr(collocation, "BURST", 30)
    rng = np.random.default_rng(seed)
    trie, want, spilled = collocation.HatTrie(), Counter(), Counter()
    for _ in range(30):
        # one first word fills containers; others are rare
        first = np.where(rng.random(200) < 0.7, 5, rng.integers(1, 2**20 - 1, 200))
        grams = first.astype(np.int64) << 40 | rng.integers(0, 6, 200) << 20 | rng.integers(0, 50, 200)
        want.update(grams.tolist())
        trie.add(grams)
        trie.settle()
        assert (np.diff(trie.starts) > 0).all() and all(c.used <= 30 for c in trie.containers)
        for start, end, c in zip(trie.starts, [*trie.starts[1:], 2**62], trie.containers):
            assert ((c.items()[0] >= start) & (c.items()[0] < end)).all()
        if trie.used > 700:
            for keys, counts in trie.spill(300):
                spilled.update(dict(zip(keys.tolist(), counts.tolist())))
            assert trie.used <= 300
    for keys, counts in trie.spill(0):
        spilled.update(dict(zip(keys.tolist(), counts.tolist())))
    assert spilled == want and trie.used == 0
