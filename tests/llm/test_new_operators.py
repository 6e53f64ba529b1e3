"""Edge cases and brute-force checks of operators 11 to 13."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle

from arborist.llm import divergence, jaccard, whitening

DOC = "doc_id long, text string, lang string, source string, prefix string, h long, comp string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "own", 1, "x") for i, t, lang, s in rows], DOC)


def brute_components(rows, percent):
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    size = defaultdict(int)
    for i, a in sets:
        size[i] = max(size[i], len(a))
    return {i: (size[i], find(i)) for i in parent}


@pytest.mark.parametrize("seed, part, chunk, pivots", [(1, 1000, 64, 16), (2, 7, 3, 2), (3, 5, 2, 1)])
def test_jaccard_against_brute_force(spark, monkeypatch, seed, part, chunk, pivots):
    """Chains of edits near the threshold, groups of copies, shared passages; small limits take the ways of large groups."""
    for name, value in (("PART", part), ("CHUNK", chunk), ("PIVOTS", pivots)):
        monkeypatch.setattr(jaccard, name, value)
    r, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(60)]
    for family in range(6):
        base = [f"w{family}x{r.randint(0, 500)}" for _ in range(r.choice([8, 40, 150]))]
        for _ in range(14):
            w = list(base)
            for k in r.sample(range(len(w)), r.randint(0, max(1, len(w) // 14))):
                w[k] = f"e{r.randint(0, 9)}"
            if r.random() < 0.4:
                at = r.randint(0, len(w))
                w[at:at] = passage[: r.randint(5, 60)]
            rows.append((len(rows), " ".join(w)))
            if r.random() < 0.3:
                base = w  # a chain: its ends needn't be linked
    rows += [(200, "a b"), (201, "A  b"), (202, None), (203, " \t"), (204, "a b c"), (0, rows[20][1]), (300, rows[3][1]), (300, rows[3][1])]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == brute_components(rows, 80)


def test_jaccard_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(300_000))
    rows = [(None, text, None, None), (1, text, None, None), (2, text + " more", None, None), (None, None, None, None)]
    got = sorted(tuple(-1 if c is None else c for c in x) for x in jaccard.jaccard_components(docs(spark, rows)).collect())
    assert got == [(-1, 0, -1), (-1, 299_996, -1), (1, 299_996, 1), (2, 299_997, 1)]
    assert jaccard.jaccard_components(docs(spark, rows).limit(0)).isEmpty()


def test_jaccard_pairs_of_a_crowded_group(spark, monkeypatch):
    """Texts that lie just below the threshold: what may be linked is found in a few pairs a class, not in one for each task that a class meets."""
    for name, value in (("PART", 20), ("CHUNK", 4), ("PIVOTS", 4)):
        monkeypatch.setattr(jaccard, name, value)
    made, real = [], jaccard._round

    def counted(members, buckets, payload="text"):
        found = jaccard.materialise(real(members, buckets, payload))
        made.append((payload, found.count()))
        return found

    monkeypatch.setattr(jaccard, "_round", counted)
    r, base, rows = random.Random(5), [f"w{k}" for k in range(200)], []
    for i in range(240):
        w = list(base)
        for k in r.sample(range(200), 5):
            w[k] = f"e{r.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == brute_components(rows, 80)
    assert sum(n for payload, n in made if payload == "list") <= 20 * len(rows)


def test_walk_equals_comparing():
    r = np.random.default_rng(4)
    for cut in range(200):
        jaccard.NODE = (128, 7)[cut % 2]
        base = r.integers(0, 1 << 40, r.integers(1, 300), np.uint64)
        some = []
        for _ in range(r.integers(1, 12)):
            keep = base[r.random(len(base)) > r.choice([0, 0.05, 0.2, 0.6])]
            some.append(some[0] if len(some) == 5 else np.unique(np.concatenate([keep, r.integers(0, 1 << 40, r.integers(0, 9), np.uint64)])))
        tree, x = jaccard.PrefixTree(some), some[int(r.integers(0, len(some)))]
        want = {i for i, s in enumerate(some) if len(x) and 100 * len(np.intersect1d(x, s)) >= 80 * len(np.union1d(x, s))}
        assert sorted(tree.walk(x)) == sorted(want)
    jaccard.NODE = 128


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, dims string")


def test_whitening_against_a_library(spark):
    r = np.random.default_rng(3)
    data = (r.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)) @ np.linalg.qr(r.standard_normal((12, 12)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(0, data[0].tolist()), (None, data[1].tolist())]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("-inf")] * 12), (904, [])]
    out = whitening.whiten(vectors(spark, rows + odd)).collect()
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100000
    n, sums = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov((x - x.mean(0)).T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - sums / n) @ axes[:, :8] / np.sqrt(values[:8])
    assert len(out) == n * 8 and {o["n"] for o in out} == {n}
    deviation = Counter((i, int(((n * row - sums) ** 2).sum())) for (i, _), row in zip(rows, x) for _ in range(8))
    assert Counter((o["vec_id"], int(o["deviation"])) for o in out) == deviation
    for c in range(8):
        got = {o["vec_id"]: o for o in out if o["component"] == c + 1}
        flip = np.sign(got[5]["whitened"] * want[5, c])
        assert all(abs(got[i]["whitened"] * flip - want[i, c]) < 1e-9 for i in range(1, 300))
        assert abs(got[5]["explained"] - values[c] / values.sum()) < 1e-12 and got[5]["identity_error"] < 1e-9


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0])] * 4)).isEmpty()
    assert whitening.whiten(vectors(spark, [(1, None)])).isEmpty()
    assert whitening.whiten(vectors(spark, []).limit(0)).isEmpty()
    # two lengths, each fitted apart; the longer one varies along one direction only
    rows = [(i, [float(i), float(i % 3)]) for i in range(9)] + [(20 + i, [float(i), 1.0, -float(i)]) for i in range(5)]
    out = whitening.whiten(vectors(spark, rows)).collect()
    assert Counter((o["vec_id"] >= 20, o["component"], o["n"]) for o in out) == {(False, 1, 9): 9, (False, 2, 9): 9, (True, 1, 5): 5}
    assert max(o["identity_error"] for o in out) < 1e-9
    # large entries go through Python's integers
    rows = [(i, [float(i) * 1e12, float(i * i)]) for i in range(6)]
    x = [[int(1024 * v) + 100000 for v in row] for _, row in rows]
    want = {i: sum((6 * x[i][d] - sum(y[d] for y in x)) ** 2 for d in (0, 1)) for i in range(6)}
    assert {o["vec_id"]: int(o["deviation"]) for o in whitening.whiten(vectors(spark, rows)).collect()} == want


@pytest.mark.parametrize("kind", range(4))
def test_eigenvectors(kind):
    r = np.random.default_rng(kind)
    for n in (1, 2, 3, 7, 40):
        a = r.standard_normal((n, n))
        q = np.linalg.qr(a)[0]
        a = [a @ a.T, np.eye(n), np.diag(np.arange(n) // 2 + 1.0), q @ np.diag(np.repeat(np.arange(1.0, n + 1), 3)[:n]) @ q.T][kind]
        values, vectors_ = whitening.leading_components((a + a.T) / 2, 8)
        want = np.linalg.eigvalsh(a)[::-1][: len(values)]
        assert len(values) == min(8, n)
        assert np.allclose(values, want, rtol=1e-13, atol=1e-13 * want[0])
        assert np.abs(vectors_ @ vectors_.T - np.eye(len(values))).max() < 1e-13
        assert np.abs(vectors_ @ a - values[:, None] * vectors_).max() < 1e-12 * want[0]


def brute_divergences(rows, min_docs):
    count, docs_, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(found)
        docs_[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs_[lang].items() if n >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            best = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:10]
            out |= {(lang, s, part, o.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", best)) for k, (v, o) in enumerate(found)}
    return out


@pytest.mark.parametrize("entries, flush", [(1 << 15, 1 << 17), (20, 30)])
def test_divergence_against_brute_force(spark, monkeypatch, entries, flush):
    """Small limits take many blocks and many partial counts."""
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "FLUSH", flush)
    r, rows = random.Random(5), []
    for _ in range(120):
        words = [r.choice(["Alpha", "béta", "ÉTÉ", "d1e", "x_y", "ω", "the", "z"]) + r.choice(["", "a", "b", "ü"]) for _ in range(r.randint(0, 30))]
        rows.append((r.choice([" ", "-", "7"]).join(words), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", None, "Ü"])))
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("rare words", "yy", "a"), ("none", "yy", "b"), ("the " * 50_000, "en", "long"), rows[0], rows[0]]
    cloudpickle.register_pickle_by_value(divergence)  # workers get the changed limits
    try:
        got = {tuple(x) for x in divergence.divergences(docs(spark, [(i, *x) for i, x in enumerate(rows)])).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(divergence)
    assert got == brute_divergences(rows, 10)
    assert divergence.divergences(docs(spark, []).limit(0)).isEmpty()


def test_run_lengths_and_large_counts():
    r = random.Random(2)
    for _ in range(300):
        column = [r.choice([0, 0, 0, 1, 2]) for _ in range(r.randint(1, 30))]
        at = [i for i, c in enumerate(column) if c]
        ends, values = divergence.run_lengths(np.array(at, np.int64), np.array([column[i] for i in at], np.int64), len(column))
        assert np.repeat(values, np.diff(ends, prepend=0)).tolist() == column
        assert all(a != b for a, b in zip(values, values[1:]))
    big = [3, 10**13]
    assert divergence.shares(np.array(big), 10**14, 7).tolist() == [1 + 10**9 * (c + 2) // (10**14 + 14) for c in big]
