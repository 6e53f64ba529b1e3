"""Operator 2: exact substring dedup with suffix arrays built by linear grouping.

Every 100-byte string of a text has one anchor, a 20-byte gram in it. A first pass counts the grams of small hash, about one
in ``SPARSE``. A string's anchor is its counted gram of the smallest hash that isn't crowded, i.e. occurs at most ``CROWD`` times;
else its crowded gram of the smallest hash; else, where it has no counted gram, its gram of the smallest hash; the leftmost of
ties. So equal strings have equal anchors, and stretches around anchors that occur once can't hold repeats. Bitmaps of the
repeated and of the crowded grams, of fixed size, let a second pass emit only the other stretches, which are dealt out by
anchor. A larger corpus fills the bitmaps, and then more stretches are shuffled, but the result stays the same.

The stretches of one anchor come sorted. Equal ones need no search: all but the first are repeats. The
distinct ones are joined to one text with separators, and its suffix array is built: suffixes are
grouped by their Lyndon prefix, the groups are processed in descending order, each member passing its
group on to its previous smaller suffix, and the order within groups is emitted in one scan, without
renaming. Neighbours of the array that agree in 100 bytes are equal strings; all but the earliest of each
run are repeats.

Before that, each batch of documents lets go of all but the earliest of its equal stretches, so a stretch with very many copies
is shuffled once a batch.

A string with crowded grams alone lies inside a passage that very many texts share, so nearly all stretches of such an anchor
are equal. They are dealt out to ``PARTS`` tasks by a hash of their bytes, equal ones together, and within a task they are
searched ``MAX_SPANS`` distinct ones at a time. What repeats across parts is found by the rest of their strings, which are
sorted by their 100 bytes and read in one pass, as far as their hashes occur again. Bitmaps of those hashes and of the texts that lose something,
of fixed size as well, keep all other strings and texts out of the shuffles.

Cases: null text is empty; texts below 100 bytes lose nothing; texts of any length are taken in overlapping parts
of ``PART_BYTES``; of equal (doc_id, start) in repeated rows none is earlier, so repeated rows keep or lose the same
bytes; a null doc_id comes before all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .textbytes import chunks, column_bytes, prefix_hash, signed, span_hash, window_hash

LENGTH, GRAM = 100, 20
MAX_SPANS, CROWD, PARTS, SPARSE = 500, 2000, 1024, 20
#: Bytes that start positions are taken from at once; they fit in the PLACE_BITS that the search for anchors packs.
PART_BYTES, PLACE_BITS = 1 << 20, 24
BITMAP_LOG = 26
_NONE = -(1 << 63)


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row of each text, bytes, offsets, place of the first byte): whole short texts, or a part of a long one.

    The parts of a text overlap by LENGTH - 1 bytes, so each 100-byte string starts in one of them and ends in the same.
    """
    for a, b, buf, offs in chunks(column, PART_BYTES):
        if len(buf) <= PART_BYTES:
            yield np.arange(a, b), buf, offs, 0
        else:
            for s in range(0, len(buf), PART_BYTES):
                part = buf[s : s + PART_BYTES + LENGTH - 1]
                yield np.array([a]), part, np.array([0, len(part)]), s


_COUNTED, _CROWDED, _OTHER = 0, 1, 2


def _candidates(hashes: np.ndarray) -> np.ndarray:
    return hashes < np.uint64((1 << 64) // SPARSE)


def anchors(buf: np.ndarray, offs: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of 100-byte strings with one anchor: text, first start, last start, anchor's hash and kind; and the prefix hash."""
    prefix, width, n = prefix_hash(buf), LENGTH - GRAM + 1, len(buf)
    empty = np.zeros(0, np.int64)
    nothing = (empty, empty, empty, empty.astype(np.uint64), empty, prefix)
    if n < LENGTH:
        return nothing
    hashes = window_hash(prefix, GRAM)
    counted = np.flatnonzero(_candidates(hashes))
    kind = np.full(len(hashes), _OTHER, np.uint64)
    kind[counted] = np.where(_inside(crowded, hashes[counted]), _CROWDED, _COUNTED)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = ((hashes >> np.uint64(2) | kind << np.uint64(62)) & ~low) | np.arange(n - GRAM + 1, dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    pos = (least & low).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    whole = doc[: n - LENGTH + 1] == doc[LENGTH - 1 :]
    new = whole.copy()
    new[1:] &= (pos[1:] != pos[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return nothing
    end = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
    return doc[first], first, end, hashes[pos[first]], kind[pos[first]].astype(np.int64), prefix


def _inside(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64((1 << BITMAP_LOG) - 1)
    return ((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def _gram_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counted grams of all texts."""
    for batch in batches:
        for _, buf, offs, _ in _parts(batch["text"]):
            if len(buf) < LENGTH:
                continue
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            found = window_hash(prefix_hash(buf), GRAM)
            found = found[_candidates(found) & (doc[: len(found)] == doc[GRAM - 1 :])]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(signed(found))], ["anchor"])


def _later(h: np.ndarray, doc: np.ndarray, start: np.ndarray, data: pa.Array) -> np.ndarray:
    """Of equal byte strings all that start later than the earliest; ``h`` are hashes of the strings."""
    gone = np.zeros(len(h), bool)
    order = np.lexsort((start, doc, h))
    near = h[order[1:]] == h[order[:-1]]
    some = order[np.append(False, near) | np.append(near, False)]
    if len(some):
        x, own, at = data.take(pa.array(some)), doc[some], start[some]
        fresh = np.ones(len(some), bool)
        fresh[1:] = pc.not_equal(x.slice(1), x.slice(0, len(some) - 1)).to_numpy(zero_copy_only=False)
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        gone[some] = (own != own[head]) | (at != at[head])
    return gone


#: ``span`` is null, and ``part`` -1, for a stretch that is known to be a repeat; its ``anchor`` only spreads the rows.
SPANS = "anchor long, part int, doc_id long, row long, start long, size long, span binary"


def _binary(buf: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    data = buf[np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)]
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])


def _spans(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, crowded = shared.value
        for batch in batches:
            docs, texts = batch["doc_id"].to_numpy(), batch["row"].to_numpy()
            for group in _groups(_parts(batch["text"])):
                found = []
                for rows, buf, offs, at in group:
                    doc, lo, hi, h, kind, prefix = anchors(buf, offs, crowded)
                    keep = (kind != _COUNTED) | _inside(repeated, h)
                    doc, lo, end, h, kind = doc[keep], lo[keep], hi[keep] + LENGTH, h[keep], kind[keep]
                    if len(doc):
                        found.append((h, span_hash(prefix, lo, end, 5), rows[doc], lo - offs[doc] + at, end - lo, kind, _binary(buf, lo, end - lo)))
                if not found:
                    continue
                h, own, row, start, size, kind = (np.concatenate(x) for x in list(zip(*found))[:6])
                span, doc, text = pa.concat_arrays([x[6] for x in found]), docs[row], texts[row]
                gone = _later(own, doc, start, span)
                part = np.where(gone, -1, np.where(kind == _CROWDED, 1 + (own % np.uint64(PARTS)).astype(np.int32), 0)).astype(np.int32)
                # other texts of one doc_id that begin alike are told apart by their row, as in the search
                key = np.where(gone, text, signed(h))
                span = pc.if_else(pa.array(gone), pa.scalar(None, pa.binary()), span)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(doc), pa.array(text), pa.array(start), pa.array(size), span], ["anchor", "part", "doc_id", "row", "start", "size", "span"])

    return run


def _groups(parts: Iterator[tuple], most: int = 6) -> Iterator[list[tuple]]:
    group: list[tuple] = []
    for part in parts:
        group.append(part)
        if len(group) == most:
            yield group
            group = []
    if group:
        yield group


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array by grouping suffixes under their Lyndon prefixes.

    Groups are a linked list in lexicographic order, processed from the last to the first. Each member i finds
    prev[i], the nearest earlier suffix in a lower group. A suffix that is found c times goes on with c
    copies of the group's string: it moves into a new group above those of its old group that are found less often.
    """
    n = len(text)
    symbols = sorted(set(text))
    number = {s: k for k, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[set[int]] = [set() for _ in symbols]
    for i, g in enumerate(group):
        members[g].add(i)
    down, up = [k - 1 for k in range(len(symbols))], [k + 1 for k in range(len(symbols))]
    done, prev, groups = bytearray(n), [-1] * n, []
    g = len(symbols) - 1
    while g >= 0:
        own = sorted(members[g])
        groups.append(own)
        hits: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            done[i] = 1
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        moved: dict[int, dict[int, list[int]]] = {}
        for j, c in hits.items():
            moved.setdefault(group[j], {}).setdefault(c, []).append(j)
        for old, parts in moved.items():
            at = old
            for c in sorted(parts):
                fresh, above = len(members), up[at]
                members.append(set(parts[c]))
                members[old].difference_update(parts[c])
                for j in parts[c]:
                    group[j] = fresh
                down.append(at)
                up.append(above)
                up[at] = down[above] = fresh
                at = fresh
            if not members[old]:
                down[up[old]] = down[old]
                if down[old] >= 0:
                    up[down[old]] = up[old]
        g = down[g]
    slot, of, filled = [], [0] * n, 0
    for k, own in enumerate(reversed(groups)):
        slot.append(filled)
        filled += len(own)
        for i in own:
            of[i] = k
    # a suffix's order in its group is that of its next smaller suffix, which is placed before it
    array, placed = [0] * n, bytearray(n)
    for k in range(-1, n):
        j = (n if k < 0 else array[k]) - 1
        while j >= 0 and not placed[j]:
            array[slot[of[j]]] = j
            slot[of[j]] += 1
            placed[j] = 1
            j = prev[j]
    return array


def repeats(spans: list[tuple[bytes, tuple[int, int]]]) -> list[tuple[int, int]]:
    """(span, offset) of each 100-byte string of ``spans`` (bytes, (doc_id, start)) that also starts earlier."""
    # strings whose hash occurs once can't repeat, so only the stretches with others go into the array
    joined = np.frombuffer(b"".join(b for b, _ in spans), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(b) for b, _ in spans])])
    owner = np.repeat(np.arange(len(spans)), np.diff(offs))
    at = np.flatnonzero(owner[: len(owner) - LENGTH + 1] == owner[LENGTH - 1 :])
    h = window_hash(prefix_hash(joined), LENGTH)[at]
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    if not equal.any():
        return []
    again = np.zeros(len(at), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    at = at[again]
    cut = np.flatnonzero((np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
    pieces = [(p[0], p[-1] + LENGTH) for p in np.split(at, cut)]
    ends, parts, source = np.zeros(len(joined), bool), [], []
    ends[at] = True
    for k, (x, y) in enumerate(pieces):
        parts += [joined[x:y].astype(np.int64) + len(pieces), [k]]
        source += [np.arange(x, y), [-1]]
    place = np.concatenate(source)
    array = place[suffix_array(np.concatenate(parts).tolist())]
    array = array[(array >= 0) & ends[array]].tolist()
    raw, out = joined.tobytes(), []

    def close(run: list[int]) -> None:
        if len(run) > 1:
            where = [(spans[owner[r]][1][0], spans[owner[r]][1][1] + r - int(offs[owner[r]])) for r in run]
            least = min(where)
            out.extend((int(owner[r]), r - int(offs[owner[r]])) for r, p in zip(run, where) if p != least)

    run, last = [], None
    for x in array:
        string = raw[x : x + LENGTH]
        if string != last:
            close(run)
            run, last = [], string
        run.append(x)
    close(run)
    return out


def _runs(found: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Sorted (span, offset) to (span, first, last) of consecutive offsets."""
    first = None
    for k, x in sorted(found):
        if first is not None and (k, x) == (first[0], first[2] + 1):
            first = (k, first[1], x)
        else:
            if first is not None:
                yield first
            first = (k, x, x)
    if first is not None:
        yield first


#: A repeat has no ``string``; a string that may start earlier elsewhere has its hash as ``key``.
FOUND = "doc_id long, row long, first long, last long, key long, string binary"


class _Group:
    """The distinct stretches of one anchor, or of one part of a crowded one, that were not searched yet."""

    def __init__(self) -> None:
        self.key, self.large = None, False
        self.spans: list[tuple[bytes, tuple[int, int]]] = []
        self.rows: list[int] = []
        self.out: list[tuple[np.ndarray, ...]] = []
        self.strings: list[tuple] = []

    def begin(self, key: tuple[int, int]) -> None:
        self.search()
        self.key, self.large = key, key[1] > 0

    def add(self, spans: list[bytes], docs: list[int], rows: list[int], starts: list[int]) -> None:
        for b, doc, row, start in zip(spans, docs, rows, starts):
            if len(self.spans) >= MAX_SPANS:
                self.large = True
                self.search()
            self.spans.append((b, (doc, start)))
            self.rows.append(row)

    def search(self) -> None:
        """Repeats within the stretches and, if there are more than these, the other strings."""
        # equal strings lie at equal distances from the anchor, so a single stretch can't repeat itself
        found = repeats(self.spans) if len(self.spans) > 1 else []
        if found:
            own = [(self.spans[k][1][0], self.rows[k], self.spans[k][1][1] + x, self.spans[k][1][1] + y) for k, x, y in _runs(found)]
            self.out.append(tuple(np.array(own, np.int64).T))
        if self.large:
            gone: dict[int, list[int]] = {}
            for k, x in found:
                gone.setdefault(k, []).append(x)
            for k, (b, (doc, start)) in enumerate(self.spans):
                buf = np.frombuffer(b, np.uint8)
                h = window_hash(prefix_hash(buf), LENGTH)
                at = np.setdiff1d(np.arange(len(h)), gone.get(k, []))
                if len(at):
                    self.strings.append((np.full(len(at), doc), np.full(len(at), self.rows[k]), start + at, h[at], _binary(buf, at, np.full(len(at), LENGTH))))
        self.spans, self.rows = [], []

    def flush(self) -> Iterator[pa.RecordBatch]:
        columns = ["doc_id", "row", "first", "last", "key", "string"]
        if self.strings:
            doc, row, first, h = (np.concatenate(x) for x in list(zip(*self.strings))[:4])
            string = pa.concat_arrays([x[4] for x in self.strings])
            gone = _later(h, doc, first, string)
            self.out.append((doc[gone], row[gone], first[gone], first[gone]))
            kept = pa.array(~gone)
            numbers = [pa.array(x[~gone]) for x in (doc, row, first, first, signed(h))]
            yield pa.RecordBatch.from_arrays([*numbers, string.filter(kept)], columns)
        if self.out:
            found = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*self.out)]
            n = len(found[0])
            yield pa.RecordBatch.from_arrays([*found, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], columns)
        self.out, self.strings = [], []


class _Sorted:
    """Reads strings sorted by key, bytes, doc_id and start: the first of each run of equal ones, whatever batch it was in."""

    def __init__(self) -> None:
        self.key, self.last, self.least = None, None, (0, 0, 0)

    def read(self, keys: list[np.ndarray], data: pa.Array, doc: np.ndarray, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that begin a key; rows that are repeats; rows that begin a run or are another text's at the same place."""
        n = len(data)
        other = np.ones(n, bool)
        other[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        other[0] = tuple(k[0] for k in keys) != self.key
        fresh = other.copy()
        fresh[1:] |= pc.not_equal(data.slice(1), data.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        fresh[0] |= data[0].as_py() != self.last
        head = np.append(-1, np.flatnonzero(fresh))[np.cumsum(fresh)]
        first_doc, first_start, first_row = (np.where(head < 0, old, x[head]) for x, old in zip((doc, start, row), self.least))
        again = ~fresh & ((doc != first_doc) | (start != first_start))
        self.key, self.last, self.least = tuple(k[-1] for k in keys), data[n - 1].as_py(), (first_doc[-1], first_start[-1], first_row[-1])
        return other, again, fresh | (~again & (row != first_row))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by anchor, part, bytes, doc_id, start and row to repeated starts, and to strings of crowded anchors."""
    group, reader = _Group(), _Sorted()

    def sure(doc: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        if len(doc):
            group.out.append((doc, row, start, start + size - LENGTH))

    for batch in batches:
        known = pc.equal(batch["part"], -1)
        sure(*(batch[c].filter(known).to_numpy() for c in ("doc_id", "row", "start", "size")))
        batch = batch.filter(pc.invert(known))
        if batch.num_rows:
            anchor, part, doc, row, start, size = (batch[c].to_numpy() for c in ("anchor", "part", "doc_id", "row", "start", "size"))
            span = batch["span"]
            other, again, keep = reader.read([anchor, part], span, doc, start, row)
            sure(doc[again], row[again], start[again], size[again])
            keep = np.flatnonzero(keep)
            of = np.cumsum(other)[keep]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(keep)]]) if len(keep) else np.zeros(1, np.int64)
            opens, closes = bounds[:-1], bounds[1:]
            # a single stretch needs no search, but the last group may go on
            need = (closes - opens > 1) | (part[keep[opens]] > 0) | (of[opens] == 0)
            need[-1:] = True
            for x, y in zip(opens[need].tolist(), closes[need].tolist()):
                k = keep[x:y]
                if of[x]:
                    group.begin((anchor[k[0]], part[k[0]]))
                group.add(span.take(pa.array(k)).to_pylist(), doc[k].tolist(), row[k].tolist(), start[k].tolist())
        yield from group.flush()
    group.search()
    yield from group.flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by key, bytes, doc_id and start to those that start earlier as well."""
    reader = _Sorted()
    for batch in batches:
        if batch.num_rows:
            key, doc, row, first = (batch[c].to_numpy() for c in ("key", "doc_id", "row", "first"))
            yield batch.filter(pa.array(reader.read([key], batch["string"], doc, first, row)[1])).select(["doc_id", "row", "first", "last"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = column_bytes(batch["text"])
        bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch["spans"]), 0).to_numpy()))
        flat = batch["spans"].flatten()
        first, last = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        found = []
        for i in range(batch.num_rows):
            raw, a, b = buf[offs[i] : offs[i + 1]], bounds[i], bounds[i + 1]
            kept, n_spans = raw.tobytes(), 0
            if b > a:
                step = np.zeros(len(raw) + 1, np.int32)
                np.add.at(step, first[a:b], 1)
                np.add.at(step, last[a:b] + LENGTH, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept, n_spans = raw[~gone].tobytes(), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            found.append((len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept))
        doc = batch["doc_id"].to_numpy()
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == _NONE), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _bitmaps(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the counted grams that occur again, and of those that occur more than CROWD times."""
    counts = docs.select("text").mapInArrow(_gram_hashes, "anchor long").groupBy("anchor").count().where("count > 1")
    low, bit = F.col("anchor").bitwiseAND((1 << BITMAP_LOG) - 1), "shiftleft(1L, CAST(anchor & 63 AS INT))"
    words = counts.groupBy(F.shiftright(low, 6).alias("word")).agg(F.expr(f"bit_or({bit})").alias("repeated"), F.expr(f"bit_or(IF(count > {CROWD}, {bit}, 0L))").alias("crowded")).toArrow()
    out = []
    for name in ("repeated", "crowded"):
        bitmap = np.zeros(1 << (BITMAP_LOG - 6), np.uint64)  # as many words at most, whatever the input
        bitmap[words["word"].to_numpy()] = words[name].to_numpy().view(np.uint64)
        out.append(bitmap)
    return out[0], out[1]


def _bitmap(values: DataFrame) -> np.ndarray:
    """Bits of the longs ``h``."""
    low, bit = F.col("h").bitwiseAND((1 << BITMAP_LOG) - 1), "bit_or(shiftleft(1L, CAST(h & 63 AS INT)))"
    words = values.groupBy(F.shiftright(low, 6).alias("word")).agg(F.expr(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_LOG - 6), np.uint64)  # as many words at most, whatever the input
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def _among(shared) -> Callable:
    """Whether a long has its bit in the shared bitmap."""

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        return pd.Series(_inside(shared.value, h.to_numpy().view(np.uint64)))

    return among


def _recurring(shared) -> Callable:
    """The strings whose key has its bit in the shared bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_inside(shared.value, batch["key"].to_numpy().view(np.uint64))))

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row of documents (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    spans = docs.mapInArrow(_spans(spark.sparkContext.broadcast(_bitmaps(docs))), SPANS)
    dealt = spans.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "span", "doc_id", "start", "row")
    found = materialise(dealt.mapInArrow(_resolve, FOUND))
    runs = "doc_id long, row long, first long, last long"
    # a string whose hash no other has can't repeat: few are left to be shuffled
    strings = found.where("string IS NOT NULL")
    again = spark.sparkContext.broadcast(_bitmap(strings.groupBy(F.col("key").alias("h")).count().where("count > 1")))
    strings = strings.mapInArrow(_recurring(again), FOUND)
    sure = found.where("string IS NULL")
    # texts that lose nothing needn't meet the runs: only those of the others, and of equal bits, are shuffled
    place = F.xxhash64("doc_id", "row")
    losing = _among(spark.sparkContext.broadcast(_bitmap(sure.select(place.alias("h")).unionByName(strings.select(place.alias("h"))))))
    dealt = strings.repartition("key").sortWithinPartitions("key", "string", "doc_id", "first", "row")
    gone = sure.select("doc_id", "row", "first", "last").unionByName(dealt.mapInArrow(_repeated, runs))
    per_row = gone.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # a row has fewer runs than bytes
    docs = docs.withColumn("place", place)
    laid = docs.where(losing("place")).join(per_row, ["doc_id", "row"], "left").select("doc_id", "text", "spans")
    laid = laid.unionByName(docs.where(~losing("place")).select("doc_id", "text"), allowMissingColumns=True)
    return laid.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
