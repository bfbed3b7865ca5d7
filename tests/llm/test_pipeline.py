"""The pipeline's stages in order, each against a brute-force version over its own input, on real and awkward rows."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest

from loomtab.llm import decontam, quality, queries

from .test_operators import LONG, LOWER, nearest_stretch

EXTRA = ["th", "x", "score", "n", "h", "node", "keep", "zeros", "gone_th", "bucket", "label", "rank"]
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_quality(rows, labels):
    """Plain quadratic discriminant: class means and covariances in float64, log-densities by solving."""
    mark = {r.doc_id: r.quality for r in labels if r.quality in (0, 1) and r.doc_id is not None}
    x = quality.statistics([t or "" for _, t, *_ in rows])
    told = [mark.get(r[0]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 else None for r in rows]
    y = np.array([-1 if v is None else v for v in told])
    use = y >= 0
    mean, spread = x[use].mean(0), x[use].std(0)
    scale = np.where(spread > 1e-9, spread, 1.0)
    z = (x - mean) / scale
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    share = np.array([(y == c).sum() for c in (0, 1)]) / use.sum()
    pooled = share[0] * covs[0] + share[1] * covs[1]
    density = []
    for c in (0, 1):
        cov = (1 - quality.POOLED) * covs[c] + quality.POOLED * pooled
        cov = (1 - quality.DIAGONAL) * cov + quality.DIAGONAL * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        gap = np.clip(z, -quality.CUT, quality.CUT) - z[y == c].mean(0)
        density.append(-0.5 * (gap * np.linalg.solve(cov, gap.T).T).sum(1) - 0.5 * np.linalg.slogdet(cov)[1])
    prior = ((y == 1).sum() + 1) / (use.sum() + 2)
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + np.log(prior / (1 - prior)), -700, 700)))


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = collections.defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(d)
    out = []
    for d, t, *rest in rows:
        if t is None:
            out.append((d, t, *rest))
            continue
        kept = []
        for line in t.split("\n"):
            having = seen[key(line)]
            last = max((v for v in having if v is not None), default=None)
            if len(key(line)) < 40 or len(having) < 5 or not (d is None or d < last):
                kept.append(line)
        out.append((d, "\n".join(kept), *rest))
    return out


def brute_near(rows, hashes):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i) if sets[i] else ("empty", i)].append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashes.get(r[1], 0))) for g in groups.values()]


def brute_clean(rows, items):
    out = []
    for r in rows:
        text, hit = decontam.normalised(r[1] or "")[0], False
        for item in items:
            own = decontam.normalised(item or "")[0]
            if len(own) >= decontam.MIN_ITEM:
                budget = min(int(decontam.EDIT_SHARE * len(own)), (len(own) - decontam.Q) // decontam.Q)
                hit |= len(text) + budget >= len(own) and nearest_stretch(own, text) <= budget
            elif len(own) >= decontam.Q:
                hit |= own.tobytes() in text.tobytes()
            elif len(own):
                hit |= own.tobytes().strip() == text.tobytes().strip()
        if not hit:
            out.append(r)
    return out


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """Real documents, cut to 1,500 characters, beside rows without ids or texts, repeated and near rows, shared lines and items; clashing columns."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    real = [(r.doc_id, r.text[:1500]) for r in queries.table(spark, sf, "documents").orderBy("doc_id").collect()]
    items = [r.text for r in queries.table(spark, sf, "benchmark").orderBy("item_id").collect()][:12]
    good = real[3][1] + " " + real[5][1]
    rows = real + [(1000, None), (1001, ""), (1002, "  \n\t"), (None, good), (None, None), (None, good), (1003, good), (1003, good), (1003, good + " more"), (1004, real[0][1] + " " + items[0] + " " + real[1][1])]
    rows += [(1100 + i, f"{real[i][1]}\n{LONG}\n{real[i + 1][1]}") for i in range(8)] + [(None, real[9][1] + "\n" + LONG)]
    rows += [(1200, real[2][1].replace("e", "é")), (1201, items[1].upper())]
    table = [(d, t, "en", "s", len(t or ""), *[f"{c}{i}" for c in EXTRA]) for i, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    spark.createDataFrame(table, schema).repartition(4).write.parquet(f"{path}/documents.parquet")
    queries.table(spark, sf, "labels").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (None, None), (99, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_are_brute_force(spark, folder, tmp_path):
    docs = queries.table(spark, folder, "documents")
    columns = docs.columns
    labels = queries.table(spark, folder, "labels").collect()
    items = [r.text for r in queries.table(spark, folder, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert out.columns == columns
        got = [tuple(r) for r in out.collect()]
        if k == 0:
            score = brute_quality(rows, labels)
            assert np.abs(score - quality.THRESHOLD).min() > 1e-9
            want = [r for r, s in zip(rows, score) if s >= quality.THRESHOLD]
            assert 0 < len(want) < len(rows)
        elif k == 1:
            want = [(d, t, a, b, len(t or "") if t is not None else None, *rest) for d, t, a, b, _, *rest in brute_lines(rows)]
            want = [w if w[1] is not None else (*w[:4], None, *w[5:]) for w in want]
        elif k == 2:
            hashes = {r[0]: r[1] for r in docs.selectExpr("text", "xxhash64(text)").distinct().collect()}
            want = brute_near(rows, hashes)
            # of rows that agree in id and text any may stay
            assert collections.Counter(r[:2] for r in got) == collections.Counter(r[:2] for r in want) and set(got) <= set(rows)
            want = got
        elif k == 3:
            want = brute_clean(rows, items)
            assert len(want) < len(rows)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(queries.vocabulary())
            tokens = collections.Counter((d, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in rows)
            pieces = collections.defaultdict(list)
            for r in out.collect():
                pieces[r.doc_id, r.doc_tokens].append((r.start, r.length))
            for key, spans in pieces.items():
                # every id of every row lies in exactly one piece
                assert sum(n for _, n in spans) == key[1] * tokens[key]
                cover = collections.Counter(i for a, n in spans for i in range(a, a + n))
                assert set(cover.values()) == {tokens[key]} and max(cover) == key[1] - 1
            assert set(pieces) == set(tokens)
            held = collections.defaultdict(list)
            for r in out.collect():
                held[r.sequence_id].append((r.offset, r.length))
            for spans in held.values():
                at = 0
                for a, n in sorted(spans):
                    assert a == at
                    at += n
                assert at <= 1024
            return
        assert collections.Counter(got) == collections.Counter(want), name
        docs = out


def test_scores_are_those_of_a_plain_discriminant(spark, folder):
    """The whole query of the classifier against the plain one: scores, folds and predictions of every row."""
    docs, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    rows = [tuple(r) for r in docs.collect()]
    want = sorted(((r[0] is None, r[0] or 0, s) for r, s in zip(rows, brute_quality(rows, labels.collect()))))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.score, r.held_out, r.predicted) for r in quality.scored(docs, labels).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 1e-9
    for none, d, score, held_out, predicted in got:
        assert held_out == (not none and zlib.crc32(str(d).encode()) % 5 == 0) and predicted == (score >= 0.3)


def test_empty_documents_go_through(spark, folder, tmp_path):
    empty = str(tmp_path)
    for name in ("labels", "benchmark"):
        queries.table(spark, folder, name).write.parquet(f"{empty}/{name}.parquet")
    queries.table(spark, folder, "documents").limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_run_is_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and "sequence_id" in got.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
