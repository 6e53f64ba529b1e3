"""Operator 7: near-duplicate detection by min-max hashing.

A document is the set of its distinct 5-word shingles. Under each of ``HASHES`` permutations both the
smallest and the largest value are kept, so half the hash evaluations give as many signature
values. A band is the minima and maxima of two permutations; ``BANDS`` bands miss a pair of similarity
0.75 with probability (1 - 0.75**4)**32 < 1e-5. Links are confirmed on full sets, as integers.

Copies cost one row each: documents with equal sets are one class, represented by the smallest id, from the
first grouping on. Classes that share a band, directly or through others, form a loose group. Pairs of a
group are not enumerated. First every member is compared with ``PIVOTS`` pivots of its group; then every
member that is not in the group's largest component so far is a pivot for all the others. Two members
of one group are thus either linked through pivots or compared themselves, so no link between
components is lost. Loose groups are cut into salted parts of about ``PART`` members, and each part
meets the pivots in chunks, so a task holds a bounded number of sets whatever the group's size.

Cases: text without words, and null text, has an empty set, is linked with nothing and kept; fewer than five
words are one shingle; a null doc_id is linked with nothing, has a null component and is kept; rows that
share a doc_id are one document, linked with what any of them is linked with, and give one row; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, components, materialise, table
from .textbytes import chunks, mix, shingle_sets, signed

BANDS, HASHES = 32, 64
PERCENT = 75
PIVOTS, CHUNK, PART = 16, 64, 1000
_RNG = np.random.default_rng(7)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, HASHES, np.uint64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two fingerprints and BANDS band keys of each of the non-empty sets."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    prints = [np.add.reduceat(mix(flat ^ np.uint64(k)), first) for k in (0x1234567, 0x89ABCDEF)]
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for h in range(HASHES):
        x = flat * _MULTIPLIERS[h] + _OFFSETS[h]
        x ^= x >> np.uint64(32)
        band = h * BANDS // HASHES
        for value in (np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)):
            keys[:, band] = mix(keys[:, band] + value)
    return *prints, keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        n, one, two, keys = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.zeros((rows, BANDS), np.uint64)
        for a, b, buf, offs in chunks(batch["text"]):
            sets = shingle_sets(buf, offs)
            n[a:b] = [len(s) for s in sets]
            if n[a:b].any():
                real = a + np.flatnonzero(n[a:b])
                one[real], two[real], keys[real] = signatures([s for s in sets if len(s)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(signed(keys.ravel())))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(signed(one)), pa.array(signed(two)), lists], ["doc_id", "n", "f1", "f2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, _, buf, offs in chunks(batch["text"]):
            found += [s.tobytes() for s in shingle_sets(buf, offs)]
        keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(found, pa.binary())], [*(batch.schema.names[i] for i in keep), "shingles"])


class Pivots:
    """Sets with, for each of their elements, the sets that hold it, so that a set is compared with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.known, number = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.starts = np.searchsorted(number[order], np.arange(len(self.known) + 1))

    def linked(self, s: np.ndarray, percent: int = PERCENT) -> list[int]:
        """The sets with 100 * intersection >= percent * union with s; none is linked with an empty one."""
        if not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        at = at[self.known[at] == s]
        lengths = self.starts[at + 1] - self.starts[at]
        before = np.append(0, np.cumsum(lengths))
        both = np.bincount(self.owners[np.repeat(self.starts[at] - before[:-1], lengths) + np.arange(before[-1])], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (len(s) + self.sizes - both))).tolist()


def _compare(key, members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Links of each member with pivots of its group; of pivots that are linked already, one is enough."""
    found, by_group = [], dict(tuple(members.groupby("grp", sort=False)))
    for group, own in pivots.groupby("grp", sort=False):
        if group not in by_group:
            continue
        held = Pivots([np.frombuffer(x, np.uint64) for x in own["shingles"]])
        ids, comps = own["doc_id"].tolist(), own["comp"].tolist()
        for doc, comp, blob in zip(*(by_group[group][c] for c in ("doc_id", "comp", "shingles"))):
            seen = {comp}
            for i in held.linked(np.frombuffer(blob, np.uint64)):
                if ids[i] != doc and comps[i] not in seen:
                    found.append((doc, ids[i]))
                    seen.add(comps[i])
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _round(members: DataFrame, buckets: int) -> DataFrame:
    """Compare all members (grp, doc_id, comp, parts, part, shingles, pivot, n_pivots) with all pivots of their group."""
    chunks_ = F.floor((F.col("n_pivots") - 1) / CHUNK).cast("int")
    pivots = members.where("pivot").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(5)), chunks_ + 1).cast("int"))
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = members.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks_)))
    keys = ["bucket", "part", "chunk"]
    columns = [*keys, "grp", "doc_id", "comp", "shingles"]
    spread, pivots = (x.withColumn("bucket", bucket_of(F.col("grp"), buckets)).select(*[F.col(c).alias(c) for c in columns]) for x in (spread, pivots))
    return spread.groupBy(keys).cogroup(pivots.groupBy(keys)).applyInPandas(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of documents (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed_ = materialise(docs.mapInArrow(_signatures, "doc_id long, n long, f1 long, f2 long, bands array<long>"))
    real = signed_.where("n > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = materialise(classes)
    own = materialise(real.select("doc_id", "f1", "f2", "n").join(classes.drop("bands"), ["f1", "f2", "n"]).select("doc_id", "rep").distinct())
    # loose groups: classes that share a band
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top").select("key", "b")
    # the shared keys grow with the documents: merged at every size
    loose = components(materialise(keys.join(shared.hint("merge"), "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()))
    sizes = loose.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    loose = loose.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"), F.ceil(F.col("size") / PART).cast("int").alias("parts"), "size")
    # pivots are chosen on ids alone, so that sets are shuffled only to be compared
    first = F.xxhash64("doc_id", F.lit(3))
    nth = loose.groupBy("grp").agg(F.array_sort(F.collect_set(F.when(F.pmod(first, F.greatest(F.lit(1), F.floor(F.col("size") / (4 * PIVOTS)))) == 0, first))).alias("order"))
    # about 4 * PIVOTS candidates a group by hash, of which the PIVOTS smallest are taken
    nth = nth.select("grp", F.slice("order", 1, PIVOTS).alias("order"))
    loose = materialise(loose.join(nth, "grp").withColumn("pivot", F.array_contains("order", first)).withColumn("n_pivots", F.size("order").cast("long")).drop("order"))
    # a class is compared by the text of its representative; rows of one id may hold several texts
    columns = ["doc_id", "grp", "parts", "size", "pivot", "n_pivots"]
    # loose groups and kept ids grow with the documents: merged in, never broadcast, so the plan is the same at every size
    members = docs.join(loose.hint("merge"), "doc_id").select(*columns, "text").mapInArrow(_sets, "doc_id long, grp long, parts int, size long, pivot boolean, n_pivots long, shingles binary")
    members = materialise(members.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))
    buckets = max(1, loose.count() // PART)
    links = materialise(_round(members.where("n_pivots > 0").withColumn("comp", F.col("doc_id")), buckets))
    # what the pivots left: all members outside a group's largest component
    so_far = components(links)
    state = loose.select("doc_id", "grp", "size").join(so_far.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    count = state.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = count.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("all"))
    largest = largest.where("comps > 1").select("grp", F.col("top.comp").alias("largest"), (F.col("all") - F.col("top.n")).alias("n_pivots"))
    # in a group of up to PIVOTS members every pair has been compared
    rest = state.where(F.col("size") > PIVOTS).join(largest, "grp").select("doc_id", "comp", (F.col("comp") != F.col("largest")).alias("pivot"), "n_pivots")
    more = materialise(_round(members.drop("pivot", "n_pivots").join(materialise(rest), "doc_id"), buckets))
    twice = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    same = own.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    final = components(materialise(links.unionByName(more).unionByName(same).distinct()))
    placed = own.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    named = signed_.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    out = named.join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    nameless = signed_.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id").unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, whole rows; of rows that share a doc_id the smallest."""
    kept = materialise(near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*names).unionByName(docs.where("doc_id IS NULL"))
    again = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return whole
    rest = [c for c in docs.columns if c != "doc_id"]
    # maps have no order: they are compared as text
    order = F.struct(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes if c != "doc_id"])
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("dup_row")
    one = whole.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(least)
    one = one.select(*[F.col("doc_id") if c == "doc_id" else F.col("dup_row").getField(c).alias(c) for c in docs.columns])
    return whole.join(again, "doc_id", "left_anti").select(*names).unionByName(one)


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
