"""The pipeline of five stages against a plain reckoning, and on odd and empty tables."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborist.llm import decontaminate, mixing, quality
from tests.llm.test_operators import prose

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def junk(i):
    return " ".join(["buy", "now", "!!!", "click"][(i + k) % 4] for k in range(i % 9 + 6))


@pytest.fixture
def tables(spark, tmp_path):
    def write(docs, labels, bench):
        for name, rows, schema in (("documents", docs, DOC), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
            spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def deduplicated(rows):
    sets = {}
    for i, t, _ in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def clean(rows, items):
    tokens = lambda t: re.findall("[0-9a-z]+", (t or "").lower())

    def held(t, item):
        x, y = tokens(t), tokens(item)
        diagonals = {p - q for p, a in enumerate(x) for q, b in enumerate(y) if a == b}
        return any(decontaminate.best_segment(decontaminate.np.array([x[p] == y[p - s] for p in range(max(0, s), min(len(x), s + len(y)))])) >= min(len(y), decontaminate.MATCHED) for s in diagonals)

    return [r for r in rows if not any(held(r[1], item) for _, item in items)]


def mixed(rows):
    """doc_id to copies, by prefix sums along each source."""
    by = defaultdict(list)
    for i, t, s in rows:
        size, digest = len(words(t)), hashlib.md5((t or "").encode()).hexdigest() if t is not None else "~"
        salt = int(hashlib.md5(f"{i}|{digest}".encode()).hexdigest()[:12], 16) % max(1, math.ceil(len(rows) / mixing.BLOCK_ROWS))
        by[s is None, s or ""].append((size.bit_length() or 1, salt, size, i))
    keys = sorted(by)
    total = {k: sum(x[2] for x in by[k]) for k in keys}
    weight = {k: mixing.WEIGHTS[n % 3] for n, k in enumerate(keys)}
    target, free = {}, set(keys)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        over = {k for k in free if share[k] > 3 * total[k]}
        if not over:
            break
        target.update({k: 3.0 * total[k] for k in over})
        free -= over
    target.update(share)
    out = {}
    for k in keys:
        u = int(hashlib.md5(f"mix:{k[1]}{str(k[0]).lower()}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[k] / total[k] if total[k] else 0.0
        for n, (_, _, _, i) in enumerate(sorted(by[k])):
            out[i] = min(3, math.floor(u + rate * (n + 1)) - math.floor(u + rate * n))
    return out


def test_pipeline_against_a_plain_reckoning(spark, tables):
    r = random.Random(9)
    items = [(k, prose(20, 900 + k)) for k in range(3)]
    rows = []
    for i in range(150):
        t = junk(i) if i % 5 == 0 else prose(r.randint(30, 90), i)
        if i % 11 == 1 and i > 20:
            w = rows[i - 12][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 13 == 2:
            t += " " + items[i % 3][1] + " tail"
        rows.append((i, t, ["a", "b", None][i % 3]))
    labels = [(i, int(i % 5 != 0), 0) for i in range(150) if i % 2]
    folder = tables([(i, t, "en", s, len(t)) for i, t, s in rows], labels, items)
    docs = corpus_pipeline.table(spark, folder, "documents")
    good = {x["doc_id"] for x in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("predicted = 1").collect()}
    assert len(good ^ {i for i in range(150) if i % 5}) < 6  # some texts are changed copies of junk
    kept = deduplicated([x for x in rows if x[0] in good])
    left = clean(kept, items)
    assert len(good) > len(kept) > len(left) > 50
    copies = mixed(left)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "shard_depth", "shard_page", "n_bytes", "shard_bytes"]
    got = out.collect()
    found = defaultdict(int)
    for x in got:
        found[x["doc_id"]] += 1
        assert (x["text"], x["source"], x["n_bytes"]) == (rows[x["doc_id"]][1], rows[x["doc_id"]][2], len(rows[x["doc_id"]][1].encode()))
        assert (x["shard"], x["shard_depth"], x["shard_page"]) == ("s", 0, 0) and x["shard_bytes"] == sum(y["n_bytes"] for y in got)
    assert found == {i: c for i, c in copies.items() if c}


def test_pipeline_takes_odd_and_empty_tables(spark, tables):
    long = prose(20_000, 7)
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (2, long + " x", "en", "b", 1), (None, prose(50, 3), None, None, None), (None, None, None, None, None), (3, "", "en", "a", 0), (4, " \n", "en", "a", 2), (5, prose(30, 4), "en", "b", 1)]
    labels = [(1, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, None), (5, 1, 0)]
    out = corpus_pipeline.run(spark, tables(rows, labels, [(None, prose(20, 5)), (1, None)]))
    assert {x["doc_id"] for x in out.where(F.length("text") > 10).collect()} == {1, None, 5}
    assert corpus_pipeline.run(spark, tables([], labels, [])).isEmpty()
    assert corpus_pipeline.run(spark, tables(rows, [], [])).where("doc_id = 2").isEmpty()
