"""Operator 6: benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, A-Z lower-cased. A seed hashes the tokens at the positions of a
fixed mask and ignores the others, so a hit survives substituted tokens at ignored positions. The
masks are all ways in which a segment that is taken can begin, up to its WEIGHT-th match, so no such
segment is without a hit. They grow from one another by one match each, as a tree. The
benchmark's seeds are a table; a bitmap of their hashes and of those of shorter beginnings, of fixed size, is
broadcast and lets a pass over the documents follow only beginnings that may be in the table. The seeds at
the end are joined with it on the full hash.
Around each hit the document's tokens are laid over the item's on the hit's diagonal, and the best
ungapped segment (a match counts 1, a substitution -2) is taken. A document is contaminated where that
segment matches ``min(n, MATCHED)`` tokens of an item of n tokens.

Neighbouring hits of a document are one region, whose tokens, with ``AROUND`` more on either side, go along
for the verification; texts are read once and not shuffled. Regions are cut at ``REGION`` tokens, with the margins overlapping.

Items of fewer than MATCHED tokens must match whole, so only the unspaced mask is laid over their first tokens.
An item of more than AROUND tokens is judged by the parts within AROUND of a hit.

Cases: null text has no tokens; items with fewer than ``SHORTEST`` tokens are not searched, as such word runs
occur by chance; repeated items and documents are found like others; an empty table gives no rows;
joins go by hashes of id and text, so items and documents with null or repeated ids are found by their own
texts. An item_id with several texts gives one row a document, that of the text with the most matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .quality import LETTER
from .textbytes import LOWER, chunks, mix, prefix_hash, runs, signed, span_hash

#: Matches of a seed's mask, and of the least beginning that the bitmap is asked for.
WEIGHT, LEAST = 6, 3
SPAN = 12
SHORTEST, MATCHED = 5, 10
AROUND, REGION = 64, 512
#: A seed's bits in the bitmap are the BITMAP_LOG bits of its hash above each of these.
PLACES = (0, 32)
BITMAP_LOG = 24


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = runs(LETTER[buf], offs)
    return span_hash(prefix_hash(LOWER[buf]), starts, ends), first


def longer(mask: str) -> list[str]:
    """Masks with one match more, 1 a token that counts and 0 one that is ignored.

    In a best segment every beginning has a score above 0 (see ``best_segment``), so few tokens can be ignored.
    """
    score = mask.count("1") - 2 * mask.count("0")
    return [mask + "0" * k + "1" for k in range((score + 1) // 2)]


def masks(weight: int) -> list[str]:
    """All beginnings of best segments up to that many matches."""
    return [m for x in masks(weight - 1) for m in longer(x)] if weight > 1 else ["1"]


def _add(h: np.ndarray, token: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xD1342543DE82EF95) + token
    return h ^ h >> np.uint64(31)


def _seed(h: np.ndarray, mask: str) -> np.ndarray:
    return mix(h + np.uint64(int(mask, 2) * 64 + len(mask)))


def _begin(flat: np.ndarray) -> np.ndarray:
    """Hashes of LEAST consecutive tokens at every position of one flat array."""
    m = max(0, len(flat) - LEAST + 1)
    h = np.zeros(m, np.uint64)
    for k in range(LEAST):
        h = _add(h, flat[k : k + m])
    return h


def _item_masks(tokens: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Masks of LEAST to WEIGHT matches and their seeds at the positions where a segment of enough matches can begin."""
    n = len(tokens)
    todo = [(m, _begin(tokens)) for m in masks(LEAST)] if n >= SHORTEST else []
    while todo:
        mask, h = todo.pop()
        weight = mask.count("1")
        # the matches still needed follow, and items that must match whole have their first position only
        m = n - len(mask) - max(0, min(n, MATCHED) - weight) + 1
        if m <= 0:
            continue
        h = h[:m]
        yield mask, _seed(h, mask)
        if weight < min(n, WEIGHT):
            todo += [(x, _add(h[: n - len(x) + 1], tokens[len(x) - 1 :][: len(h)])) for x in longer(mask) if len(x) <= n]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, _, buf, offs in chunks(batch["text"]):
            flat, first = tokens(buf, offs)
            for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                n = y - x
                for mask, h in _item_masks(flat[x:y]):
                    final = mask.count("1") == min(n, WEIGHT)
                    out.append((np.repeat(a + i, len(h)), signed(h), np.arange(len(h)), np.repeat(n, len(h)), np.repeat(final, len(h))))
        item, seed, pos, n, final = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 5
        yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(item)), pa.array(seed), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(final.astype(bool))], ["item_id", "seed", "item_pos", "n", "final"])


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, _, buf, offs in chunks(batch["text"]):
            flat, first = tokens(buf, offs)
            found += [flat[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(found, pa.binary())], ["item_id", "item_tokens"])


def _hits(flat: np.ndarray, first: np.ndarray, bitmap: np.ndarray, short: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and seeds that the bitmap lets through; masks of ``short`` lengths are final as well."""
    low = np.uint64((1 << BITMAP_LOG) - 1)
    at, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    begun = _begin(flat)
    todo = [(m, np.arange(len(begun)), begun, None) for m in masks(LEAST)]
    while todo:
        mask, p, h, end = todo.pop()
        s = _seed(h, mask)
        for shift in PLACES:
            bit = (s >> np.uint64(shift)) & low
            inside = ((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
            p, h, s, end = p[inside], h[inside], s[inside], None if end is None else end[inside]
        if end is None:
            end = first[np.searchsorted(first, p, "right")]
            inside = p + len(mask) <= end
            p, h, s, end = p[inside], h[inside], s[inside], end[inside]
        if not len(p):
            continue
        weight = mask.count("1")
        if weight == WEIGHT or (weight == len(mask) and weight in short):
            at.append(p)
            seed.append(s)
        if weight < WEIGHT:
            for x in longer(mask):
                inside = p + len(x) <= end
                q = p[inside]
                todo.append((x, q, _add(h[inside], flat[q + len(x) - 1]), end[inside]))
    return np.concatenate(at), np.concatenate(seed)


def _regions(shared, short: set[int]) -> Callable:
    """Documents to regions with hits that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            rows, base, blob, hits, spots = [], [], [], [], []
            for a, _, buf, offs in chunks(batch["text"]):
                flat, first = tokens(buf, offs)
                at, seed = _hits(flat, first, bitmap, short)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                doc = np.searchsorted(first, at, "right") - 1
                i = 0
                while i < len(at):
                    end = min(at[i] + REGION, first[doc[i] + 1])
                    j = i + 1
                    while j < len(at) and at[j] < end and at[j] - at[j - 1] <= SPAN:
                        j += 1
                    x, y = max(first[doc[i]], at[i] - AROUND), min(first[doc[i] + 1], at[j - 1] + SPAN + AROUND)
                    rows.append(a + int(doc[i]))
                    base.append(int(x - first[doc[i]]))
                    blob.append(flat[x:y].tobytes())
                    hits.append(signed(seed[i:j]))
                    spots.append((at[i:j] - x).astype(np.int32))
                    i = j
            ends = np.concatenate([[0], np.cumsum([len(x) for x in hits], dtype=np.int32)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0, kind))) for x, kind in ((hits, np.int64), (spots, np.int32))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(base, pa.int64()), pa.array(blob, pa.binary()), *lists], ["doc_id", "base", "tokens", "seeds", "spots"])

    return run


def best_segment(equal: np.ndarray) -> int:
    """Matches in the ungapped segment of the best score, 1 for a match and -2 for a substitution."""
    best = score = matched = found = 0
    for x in equal.tolist():
        score, matched = (score + 1, matched + 1) if x else (score - 2, matched)
        if score <= 0:
            score = matched = 0
        elif score > best or (score == best and matched > found):
            best, found = score, matched
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for region, item, diagonal in zip(batch["tokens"], batch["item_tokens"], batch["diagonal"].to_pylist()):
            x, y = np.frombuffer(region.as_py(), np.uint64), np.frombuffer(item.as_py(), np.uint64)
            a, b = max(0, diagonal), min(len(x), diagonal + len(y))
            found.append(best_segment(x[a:b] == y[a - diagonal : b - diagonal]) if b > a else 0)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["item_id"], batch["n"], batch["base"], pa.array(found, pa.int32())], ["doc_id", "item_id", "n", "base", "matched"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_tokens, matched: documents (doc_id, text) with the items (item_id, text) that they hold."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = named.select(F.xxhash64("item_id", "text").alias("item_id"), "text")  # a key of its own for each id and text
    names = named.select(F.xxhash64("item_id", "text").alias("key"), "item_id").dropDuplicates(["key"])
    table_ = materialise(items.mapInArrow(_item_seeds, "item_id long, seed long, item_pos int, n int, final boolean"))
    places = F.array(*[F.shiftright("seed", n).bitwiseAND((1 << BITMAP_LOG) - 1) for n in PLACES])
    bits = table_.select(F.explode(places).alias("place"))
    words = bits.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_LOG - 6), np.uint64)
    for word, bits in words.collect():  # 262,144 rows at most
        bitmap[word] = bits & 0xFFFFFFFFFFFFFFFF
    short = {r[0] for r in table_.where(F.col("n") < WEIGHT).select("n").distinct().collect()}  # lengths below WEIGHT
    regions = materialise(docs.mapInArrow(_regions(spark.sparkContext.broadcast(bitmap), short), "doc_id long, base long, tokens binary, seeds array<long>, spots array<int>").withColumn("region", F.xxhash64("doc_id", "base", "tokens")))
    hits = regions.select("region", F.explode(F.arrays_zip("seeds", "spots")).alias("hit")).select("region", F.col("hit.seeds").alias("seed"), F.col("hit.spots").alias("spot"))
    pairs = hits.join(table_.where("final"), "seed").select("region", "item_id", "n", (F.col("spot") - F.col("item_pos")).alias("diagonal")).distinct()
    whole = items.mapInArrow(_item_tokens, "item_id long, item_tokens binary").dropDuplicates(["item_id"])
    laid = pairs.join(regions.select("region", "doc_id", "base", "tokens"), "region").join(whole, "item_id")
    found = laid.select("doc_id", "item_id", "n", "base", "tokens", "item_tokens", "diagonal").mapInArrow(_verify, "doc_id long, item_id long, n int, base long, matched int")
    found = found.where(F.col("matched") >= F.least(F.col("n"), F.lit(MATCHED)))
    found = found.withColumnRenamed("item_id", "key").join(names, "key").groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "n")).alias("best"))
    return found.select("doc_id", "item_id", F.col("best.n").alias("n_tokens"), F.col("best.matched").alias("matched"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, whole rows."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key")
    found = materialise(contamination(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("key")).distinct())
    # rows travel in a struct, so that no column of theirs is named as the key
    rows = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(found, "key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds; documents without one are clean."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
