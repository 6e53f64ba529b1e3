"""Operator 13: how far the sources of each language diverge, on run-length columns.

Terms are counted a document, summed by (lang, source, term) before the shuffle, and the kept vocabulary is each language's terms in
at least ``MIN_DOCS`` documents. The vocabulary of a language is dealt by hash to blocks of about ``ENTRIES`` nonzero counts. In a
block the terms are reordered so that those of equal counts in the first sources lie together, within them those of equal counts in
the next, and so on; then each group's column of counts is a list of runs, long ones of zeros included. A pair of groups is
compared on the intersection of their run boundaries: f of the two shares once a piece, times its length. No pair of groups meets a
term alone and the table of all terms by all groups is never written. The blocks' sums are added up by Spark; of its
terms, each block returns a group's best ``TOP``, which hold the best overall.

All arithmetic is on integers; shares of counts beyond 63 bits are taken with Python's.

Cases: null text, lang and source count as empty; a group without terms, or without any kept one, has share parts by count 0;
languages without kept terms give their pairs with value 0; repeated rows are documents each; ties go by the item's bytes; a document's
text is counted whole in one task; an empty table gives no rows; further columns are ignored. Output is a row for each ordered
pair of a language's sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

MIN_DOCS, TOP = 10, 10
UNIT = 1_000_000_000
ENTRIES, FLUSH = 1 << 15, 1 << 17
#: A-Z to a-z, every other ASCII sign but a-z to a space; bytes of larger code points stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with A-Z lower-cased."""
    return (text or "").encode().translate(_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, source, term, count, docs); the term '' marks a group that occurs."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, source, t.decode(), n, docs[t]) for (lang, source), (total, docs) in counts.items() for t, n in total.items()]
        counts.clear()
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "source", "term", "count", "docs"])

    held = 0
    for batch in batches:
        for text, lang, source in zip(*(batch[c].to_pylist() for c in ("text", "lang", "source"))):
            total, docs = counts.setdefault((lang or "", source or ""), (Counter({b"": 0}), Counter()))
            held -= len(total)
            own = Counter(terms(text))
            total.update(own)
            docs.update(own.keys())
            held += len(total)
            if held > FLUSH:
                yield flush()
                held = 0
    yield flush()


def run_lengths(positions: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the runs of a column of n counts that are 0 but at rising ``positions``."""
    if not len(positions):
        return np.array([n]), np.array([0])
    apart = positions[1:] != positions[:-1] + 1
    first = np.concatenate([[True], apart | (counts[1:] != counts[:-1])])
    starts, values = positions[first], counts[first]
    last = np.concatenate([first[1:], [True]])
    ends = positions[last] + 1
    # between two runs that don't touch, before the first and after the last, lies one of zeros
    gap_ends = np.concatenate([starts, [n]])
    gaps = gap_ends > np.concatenate([[0], ends])
    all_ends = np.concatenate([ends, gap_ends[gaps]])
    order = np.argsort(all_ends, kind="stable")
    return all_ends[order], np.concatenate([values, np.zeros(int(gaps.sum()), counts.dtype)])[order]


def divergence(p, q):
    """f of two shares, at most 1 + UNIT each, in integers."""
    return (p - q) * (p - q) // (p + q)


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept))."""
    if not len(counts) or int(counts.max()) < 9_000_000_000:
        return 1 + UNIT * (counts + 2) // (total + 2 * kept)
    return np.array([1 + UNIT * (int(c) + 2) // (total + 2 * kept) for c in counts.tolist()], np.int64)


def intersect(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of f over two columns of shares, each (ends, shares) of runs over the same terms."""
    ends = np.union1d(a[0], b[0])
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    return int((divergence(p, q) * np.diff(ends, prepend=0)).sum())


def _block(key, entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """A block's part of each pair's sum, both ways, and each group's best terms."""
    out: list[tuple] = []
    groups = groups.sort_values(["n_terms", "source"], ascending=[False, True], kind="stable")
    names, totals, kept, lang_total = groups["source"].tolist(), groups["total"].tolist(), int(groups["kept"].iloc[0]) if len(groups) else 0, int(groups["lang_total"].iloc[0]) if len(groups) else 0
    at = {s: i for i, s in enumerate(names)}
    lang = key[0]
    of_term: dict[str, list] = {}
    lang_count: dict[str, int] = {}
    for t, s, c, all_ in zip(*(entries[x].tolist() for x in ("term", "source", "count", "term_total"))):
        of_term.setdefault(t, []).append((at[s], -c))
        lang_count[t] = all_
    # falling counts in the first source, then in the next; the end sorts as a zero does
    order = sorted(of_term, key=lambda t: [*sorted(of_term[t]), (len(names), 0)])
    columns: list[tuple[list, list]] = [([], []) for _ in names]
    for position, t in enumerate(order):
        for s, c in of_term[t]:
            columns[s][0].append(position)
            columns[s][1].append(-c)
    runs = []
    q = shares(np.array([lang_count[t] for t in order], np.int64), lang_total, kept)
    for s, (positions, counts) in enumerate(columns):
        positions, counts = np.array(positions, np.int64), np.array(counts, np.int64)
        if order:
            ends, values = run_lengths(positions, counts, len(order))
            runs.append((ends, shares(values, totals[s], kept)))
        if len(positions):
            p = shares(counts, totals[s], kept)
            more = p > q[positions]
            f = divergence(p[more], q[positions][more])
            names_ = [order[i] for i in positions[more].tolist()]
            best = sorted(zip((-f).tolist(), (t.encode() for t in names_)))[:TOP]
            out += [(lang, names[s], "term", t.decode(), -v) for v, t in best]
    for a in range(len(names)):
        for b in range(a):
            value = intersect(runs[a], runs[b]) if order else 0
            out += [(lang, names[a], "pair", names[b], value), (lang, names[b], "pair", names[a], value)]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"]).astype({"value": "int64"})


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source)."""
    docs = docs.select("text", "lang", "source")
    partial = docs.mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    counts = materialise(partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))
    vocabulary = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("count").alias("term_total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = materialise(counts.drop("docs").join(vocabulary.drop("docs"), ["lang", "term"]))
    by_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    by_lang = kept.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.count(F.lit(1)).alias("entries"))
    kept_terms = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = counts.where("term = ''").select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").join(kept_terms, "lang", "left")
    groups = materialise(groups.na.fill(0).withColumn("blocks", (1 + F.floor(F.col("entries") / ENTRIES)).cast("int")))
    blocks = groups.select(F.col("lang").alias("lang"), F.col("blocks").alias("of")).distinct()
    entries = kept.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("of")).cast("int"))
    groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = entries.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInPandas(_block, "lang string, source string, part string, item string, value long")
    # one row for each pair after the grouping; terms are in one block each
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' OR rank <= {TOP}").select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, COALESCE(text, '') AS text, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source FROM documents),
t AS (SELECT i, lang, source, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, COUNT(*) AS n FROM t GROUP BY 1, 2 HAVING COUNT(DISTINCT i) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, COUNT(*) AS n FROM t GROUP BY ALL),
a AS (SELECT g.lang, g.source, v.term, COALESCE(c.n, 0) AS n, v.n AS ln FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT *, CAST(1 + 1000000000::HUGEINT * (n + 2) // (SUM(n) OVER (PARTITION BY lang, source) + 2 * COUNT(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p,
  CAST(1 + 1000000000::HUGEINT * (ln + 2) // (SUM(ln) OVER (PARTITION BY lang, source) + 2 * COUNT(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS q FROM a),
s AS (SELECT x.lang, x.source, y.source AS item, SUM((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(COALESCE(s.value, 0) AS BIGINT) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10"""
