"""The query against a brute-force version, with blocks of the usual and of tiny sizes."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomtab.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, k int, p0 long"


def brute(rows, least=30, top=50):
    held, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        sources[lang].add(source)
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def rows_like(seed):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "É", "é", "naïve", "日本", "x1y", "it's", "MIXED", "[br]", "\x7f", *[f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]]
    rows = []
    for i in range(600):
        s = "hot" if rng.random() < 0.4 else f"s{rng.integers(0, 12)}"
        own = rng.choice(words, rng.integers(0, 40), p=np.roll(np.arange(1, len(words) + 1), int(s[1:]) * 3 if s != "hot" else 0) / (len(words) * (len(words) + 1) / 2))
        rows.append((i, " ".join(own), ["en", "en", "fr", None][i % 4], s, "t", 1, 2))
    rows += [(1, None, None, None, None, None, None), (None, "the the the", "en", "", None, 0, 0), (1, "", "lonely", "one", None, 0, 0), (1, "", "lonely", "two", None, 0, 0)]
    rows += [(7, "only source", "single", "s", None, 0, 0), (8, "12 34 --", "en", "no terms", None, 0, 0)]
    return rows


@pytest.mark.parametrize(("groups", "terms", "held"), [(64, 4096, 400_000), (3, 5, 20), (1, 1, 1)])
def test_query_is_brute_force(spark, monkeypatch, groups, terms, held):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = rows_like(groups)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), 30, 7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 30, 7)


def test_no_kept_terms_and_empty_tables(spark):
    rows = rows_like(9)[:50]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact(spark):
    """Counts whose products pass 64 bits."""
    n, v, count = 10**15 + 7, 10**6 + 3, 123456789012345
    got = spark.range(1).selectExpr(f"{n} AS n", f"{v} AS v", f"{count} AS c").select(divergence.share("c", "n", "v").alias("p")).first()[0]
    assert got == 1 + 1000000000 * (count + 5) // (n + 5 * v)
