"""Operator 3: language-model scoring by cross-entropy difference.

Two models of the same order over the same vocabulary, the 256 byte values: the target model is counted on
the documents of the wanted kind, the background model on all documents. Both are interpolated n-gram
models, p_n = (c(gram) + K p_{n-1}) / (c(context) + K). A document's cross-entropies are the means of its
per-token losses, and its score is the mean of the loss differences, target minus background: the lower,
the more it is like the target.

The counts are taken over all bytes of all documents and kept by the exact n-gram, however many there are. Documents
are cut into blocks of about ``BLOCK_BYTES``. A block's distinct n-grams with its counts are rows, so a common n-gram has
one row a block; the rows are summed by n-gram and go back to their blocks, which are scored with them. Nothing that grows
is broadcast or sent to the driver.

A document is scored with counts that include its own. Texts of any length are one text of one block.

Cases: null or empty text has 0 tokens, no cross-entropies and score 0; repeated rows are counted and scored
each; without any target document the target model is uniform; an empty table gives no rows; null doc_ids
are scored and are never of the target kind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .textbytes import LOWER, chunks

ORDER, K = 5, 5.0
PAD = ORDER - 1
#: Bytes of a block's texts, and of the padded texts that a task sorts at once.
BLOCK_BYTES = 1 << 25
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the n-grams of every order that end at each place of the padded texts; the places of the texts' bytes.

    PAD zero bytes stand before each text and after the last: they are the first bytes' context and the end mark of the
    text before. A key is the n-gram's bytes with its order in the highest byte.
    """
    n = len(offs) - 1
    wide = np.zeros(len(buf) + PAD * (n + 1), np.uint64)
    places = np.arange(len(buf)) + np.repeat(PAD * np.arange(1, n + 1), np.diff(offs))
    wide[places] = LOWER[buf]
    key, found = wide, [wide]
    for order in range(1, ORDER):
        older = np.zeros_like(wide)
        older[order:] = wide[:-order]
        key = key | older << np.uint64(8 * order)
        found.append(key | np.uint64(order << 56))
    return found, places


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys and their summed counts, of parts with keys and counts."""
    key, *counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[start], *(np.add.reduceat(x[order], start) for x in counts)


def _tally(buf: np.ndarray, offs: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys of texts, and their counts in all of them and in those of the target."""
    found, _ = grams(buf, offs)
    mine = np.repeat(target, np.diff(offs) + PAD)  # a text and its end mark; the first context is no text's
    parts = []
    for keys in found:
        key, n = np.unique(keys[PAD:], return_counts=True)
        parts.append((key, n, np.zeros_like(n)))
        if mine.any():
            key, n = np.unique(keys[PAD:][mine], return_counts=True)
            parts.append((key, np.zeros_like(n), n))
    return _summed(parts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their block."""
    block, size = uuid.uuid4().int >> 65, 0
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + PAD
        ends = size + np.cumsum(length)
        # a text that begins in a block is in it
        step = (ends - length) // BLOCK_BYTES
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((block + step) & (1 << 63) - 1)], [*batch.schema.names, "block"])
        size = int(ends[-1]) if len(ends) else size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, ...]] = []
    block = None

    def done() -> Iterator[pa.RecordBatch]:
        key, background, target = _summed(parts)
        for i in range(0, len(key), 100_000):
            one, two, three = key[i : i + 100_000], background[i : i + 100_000], target[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block, len(one))), pa.array(one.view(np.int64)), pa.array(two), pa.array(three)], ["block", "gram", "background", "target"])

    for batch in batches:
        wanted = pc.fill_null(batch["target"], False).to_numpy(zero_copy_only=False)
        of = batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if x == y:
                continue
            if parts and of[x] != block:
                yield from done()
                parts = []
            block = of[x]
            for a, b, buf, offs in chunks(batch["text"].slice(x, y - x)):
                parts.append(_tally(buf, offs, wanted[x + a : x + b]))
                if len(parts) == 8:
                    parts = [_summed(parts)]
    if parts:
        yield from done()


class Counts:
    """Counts by key: an open hash table in arrays."""

    def __init__(self, key: np.ndarray, counts: list[np.ndarray]) -> None:
        self.key, first = np.unique(key, return_index=True)
        self.counts = [np.append(x[first].astype(np.float64), 0.0) for x in counts]  # the last is that of absent keys
        self.bits = max(4, int(4 * len(self.key)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(self.key), dtype=np.int32), self._slot(self.key)
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            left = self.table[slot] != todo
            todo, slot = todo[left], slot[left] + 1 & len(self.table) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key's counts."""
        slot = self._slot(key)
        out = self.table[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[out] != key))
        while len(todo):
            slot[todo] = slot[todo] + 1 & len(self.table) - 1
            out[todo] = self.table[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.key[out[todo]] != key[todo])]
        return out


def losses(count: np.ndarray, total: float, found: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Bits that the model of these counts needs for each byte at ``places``; ``found`` has the counts' indices."""
    p = (count[found[0][places]] + 1.0) / (total + 256.0)
    for order in range(1, ORDER):
        gram, context = count[found[order][places]], count[found[order - 1][places - 1]]
        p = (gram + K * p) / (np.maximum(context, gram) + K)
    return -np.log2(p)


def _score(totals: list[float]) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ce_target", pa.float64()), ("ce_background", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        counts = Counts(counted["gram"].to_numpy().view(np.uint64), [counted[x].to_numpy() for x in ("target", "background")])
        parts = []
        for _, _, buf, offs in chunks(docs["text"], 1 << 18):
            keys, places = grams(buf, offs)
            found, n = [counts.find(x) for x in keys], np.diff(offs)
            row = [n]
            for count, total in zip(counts.counts, totals):
                sums = np.concatenate([[0.0], np.cumsum(losses(count, total, found, places))])
                row.append((sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(1, n))
            parts.append(row)
        n, one, two = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        none = n == 0
        return pa.Table.from_arrays([docs["doc_id"], pa.array(n), pa.array(one, mask=none), pa.array(two, mask=none), pa.array(one - two)], schema=schema)

    return run


def counts(blocks: DataFrame) -> DataFrame:
    """block, gram, background, target: each block's distinct n-grams with the counts of the whole corpus, of blocks (block, text, target)."""
    rows = blocks.select("block", "text", "target").mapInArrow(_count, "block long, gram long, background long, target long")
    whole = Window.partitionBy("gram")  # a row a block and task
    return rows.select("block", "gram", F.sum("background").over(whole).alias("background"), F.sum("target").over(whole).alias("target"))


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background, score of documents (doc_id, text); ``target`` holds the wanted doc_ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    # labels grow with the documents, so they are merged in, never broadcast: one plan at every size
    labelled = docs.join(wanted.hint("merge"), "doc_id", "left").select("doc_id", "text", "target")
    blocks = materialise(labelled.mapInArrow(_blocks, "doc_id long, text string, target boolean, block long"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + PAD
    row = blocks.agg(F.sum(F.when(F.col("target"), size)), F.sum(size)).first()
    pairs = blocks.select("block", "doc_id", "text").groupBy("block").cogroup(counts(blocks).groupBy("block"))
    return pairs.applyInArrow(_score([float(x or 0) for x in row]), "doc_id long, n_tokens long, ce_target double, ce_background double, score double")


def op3_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against those labelled as good."""
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
