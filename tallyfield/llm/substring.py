"""Substring dedup by fixed-block anchors.

A repeat of `window` words holds, wherever it starts, a whole block of
(window + 1) // 2 words of its earlier document's grid of non-overlapping
blocks.  So:

1. Anchors.  Every rolling window of block length is hashed; those on the
   grid are the index, all are probes.  They meet by hash range, as sorted
   delta-coded arrays; a hash with an index block and any other probe is a
   hit.  (Only part of the hash travels: a chance hit costs work in step 2
   and changes nothing.)  Ranges grow in number with the text, and a task
   reads its ranges one after another.
2. Extension.  Documents with hits are read again; each hit is extended to
   all full windows around it, and the first document of each window's
   64-bit hash decides which are repeats.  Overlapping windows add up to the
   maximal exact repeats.
3. The spans of a document's repeats are merged and cut out of its words.

A hash that a flush of a task (about FLUSH words) holds more than HOT times
travels once: the flush's places of it wait for the answer with the flush's own
table, so that a passage of a third of all documents gives its range at most
HOT entries a flush.

Windows are compared by their 64-bit hashes, never word by word: two different
windows near a hit are taken for one with a chance of 2**-64 a pair.  Flushes
are named by partition and order, so docs must give the same rows in the same
order when a task runs again, as a file scan does.

Behaviour: words are runs without white space (0x20, 0x09-0x0D), compared as
they are; a null text has none.  Rows with equal ids never count as earlier
than each other.  A row without an id loses nothing and is no reference.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .session import keep, ranges_for, ready

#: Words that a task gathers before it sends their hashes off; bounds its memory.
FLUSH = 1 << 20
#: Bytes of text to a hash range, about: a range holds an entry for each of their words.
RANGE = 8 << 20
#: Entries of one hash that a flush sends off singly.
HOT = 8
#: Bits of the anchors' hashes that travel.
ANCHOR_BITS = 44


def _batch(blobs: list[tuple[int, bytes]], key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blobs], pa.int64()), pa.array([b for _, b in blobs], pa.binary())], names=[key, "blob"])


class _Gathered:
    """Hashes, their documents and word positions, until they are worth a flush."""

    def __init__(self):
        self.clear()
        self.flushes = 0

    def clear(self):
        self.keys: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.pos: list[np.ndarray] = []
        self.n = 0

    def add(self, keys, doc, pos):
        if len(keys):
            self.keys.append(keys)
            self.doc.append(doc)
            self.pos.append(pos)
            self.n += len(keys)

    def sorted(self):
        keys, doc, pos = (np.concatenate(x) for x in (self.keys, self.doc, self.pos))
        order = np.argsort(keys)
        self.clear()
        self.flushes += 1
        return keys[order], doc[order], pos[order]

    def name(self) -> int:
        """Of the last flush: the same when the task runs again."""
        return (TaskContext.get().partitionId() << 24) + self.flushes


def _collapsed(keys: np.ndarray, place: np.ndarray, mark: np.ndarray, base: int, most: int, merge: Callable):
    """Sorted keys, each held more than `most` times once, with the place base + its number and merge(its marks, starts); and the number and place of all that it stood for."""
    start = kernel.runs(keys)
    count = np.diff(np.append(start, len(keys)))
    hot = count > most
    if not hot.any():
        return keys, place, mark, np.zeros(0, np.int64), np.zeros(0, np.int64)
    many = np.repeat(hot, count)
    firsts = np.concatenate(([0], np.cumsum(count[hot])[:-1]))
    number = np.arange(hot.sum())
    key = np.concatenate((keys[~many], keys[start[hot]]))
    at = np.concatenate((place[~many], base + number))
    marks = np.concatenate((mark[~many], merge(mark[many], firsts)))
    order = np.argsort(key)
    return key[order], at[order], marks[order], np.repeat(number, count[hot]), place[many]


def _entries(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a range's blobs in order, with their payloads, flushes and documents."""
    out = []
    for x in blobs:
        keys, value, table = kernel.unpack(x)
        rows = table.reshape(-1, 2)
        row = rows[value % len(rows)]
        out.append((keys, value // len(rows), row[:, 0], row[:, 1]))
    keys, payload, name, doc = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(keys)
    return keys[order], payload[order], name[order], doc[order]


def _own(name: int, firsts: np.ndarray, ids: np.ndarray, base: int, number: np.ndarray, place: np.ndarray) -> list[tuple[int, bytes]]:
    """What a flush keeps for itself: its documents, and the places of its hot hashes."""
    out = [(-1 - name, kernel.pack(firsts.astype(np.uint64), np.arange(len(firsts)), ids.reshape(-1)))]
    if len(number):
        out.append((-1 - name, kernel.pack(number.astype(np.uint64), place, np.array([base]))))
    return out


def _answers(place: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """A blob of sorted places for each flush."""
    order = np.lexsort((place, name))
    place, name = place[order], name[order]
    start = np.append(kernel.runs(name), len(name))
    return _batch([(int(name[a]), kernel.pack(place[a:e].astype(np.uint64), np.zeros(e - a, np.int64))) for a, e in zip(start[:-1], start[1:], strict=True)], "flush")


def _anchors(block: int, bits: int):
    """(doc_id, text, version) to (part, blob): hash ranges with (hash; place in flush * 4 + held twice * 2 + on the grid), and for each flush what it keeps, under negative parts."""
    grain = np.uint64(64 - ANCHOR_BITS)

    def run(batches):
        held = _Gathered()
        places: list[tuple[np.ndarray, np.ndarray]] = []
        base = 0

        def flush():
            nonlocal base
            keys, place, grid, number, waiting = _collapsed(*held.sorted(), base, HOT, lambda mark, starts: np.maximum.reduceat(mark, starts) | 2)
            cuts = kernel.by_range(keys << grain, bits)
            name = held.name()
            value, table = place * 4 + grid, np.array([name, 0])
            out = [(int(r), kernel.pack(keys[cuts[r] : cuts[r + 1]], value[cuts[r] : cuts[r + 1]], table)) for r in np.flatnonzero(np.diff(cuts))]
            out += _own(name, np.concatenate([f for _, f in places]), np.concatenate([i for i, _ in places], axis=1), base, number, waiting)
            places.clear()
            base = 0
            return _batch(out, "part")

        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column(0)))
            w = kernel.words(b.column(1))
            g = kernel.grams(w.hash, block, 7) >> grain
            if not len(g):
                continue
            whole = np.flatnonzero(w.text[: len(g)] == w.text[block - 1 :])
            pos = whole - w.first[w.text[whole]]
            held.add(g[whole], whole + base, (pos % block == 0).astype(np.int64))
            places.append((np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "version")]), w.first[:-1] + base))
            base += len(w.hash)
            if held.n >= FLUSH:
                yield flush()
        if held.n:
            yield flush()

    return run


def _hits(batches):
    """Ranges' blobs to (flush, blob): the places of hits; what flushes keep goes through."""
    for part, blobs in kernel.grouped(batches):
        if part < 0:
            yield _batch([(-1 - part, x) for x in blobs], "flush")
            continue
        keys, payload, name, _ = _entries(blobs)
        start = kernel.runs(keys)
        count = np.diff(np.append(start, len(keys)))
        marks = np.bitwise_or.reduceat(payload & 3, start)
        hit = np.repeat(((count > 1) | (marks > 1)) & (marks & 1 > 0), count)
        yield _answers(payload[hit] >> 2, name[hit])


def _spans_of(pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of runs of `length` words, merged where they touch: starts and ends."""
    if not len(pos):
        return pos, pos
    new = np.concatenate(([True], pos[1:] > pos[:-1] + length))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(pos) - 1)
    return pos[new], pos[last] + length


def _per_document(length: int):
    """A flush's blobs - its documents, the places of its hot hashes, answers - to (doc_id, version, spans): merged [start, end) word spans."""

    def run(batches):
        for _, blobs in kernel.grouped(batches):
            firsts = ids = hot = None
            places = []
            for x in blobs:
                keys, values, table = kernel.unpack(x)
                if len(table) > 1:
                    firsts, ids = keys.astype(np.int64), table.reshape(2, -1)
                elif len(table):
                    hot = (int(table[0]), keys.astype(np.int64), values)
                else:
                    places.append(keys.astype(np.int64))
            if not places:
                continue
            place = np.concatenate(places)
            if hot is not None:
                base, number, waiting = hot
                asked = place >= base
                place = np.concatenate((place[~asked], waiting[np.isin(number, place[asked] - base)]))
            place = np.unique(place)
            if not len(place):
                continue
            doc = np.searchsorted(firsts, place, "right") - 1
            pos = place - firsts[doc]
            out_ids, spans = [], []
            for a, e in zip(s := np.append(kernel.runs(doc), len(doc)), s[1:], strict=False):
                starts, ends = _spans_of(pos[a:e], length)
                out_ids.append(ids[:, doc[a]])
                spans.append(np.stack((starts, ends), 1).reshape(-1))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in np.array(out_ids).T), pa.array([x.tolist() for x in spans], pa.list_(pa.int64()))], names=["doc_id", "version", "spans"])

    return run


def _windows(window: int, block: int, bits: int):
    """(doc_id, text, spans of hits, version) to blobs as in _anchors, of the full windows around hits, each with its place and its document.

    A hot window stands under its flush's smallest document; its places in
    other documents are repeats for certain, and answered at once.
    """

    def run(batches):
        held = _Gathered()
        places: list[tuple[np.ndarray, np.ndarray]] = []
        base = 0

        def flush():
            nonlocal base
            name = held.name()
            ids = np.concatenate([i for i, _ in places], axis=1)
            firsts = np.concatenate([f for _, f in places])
            keys, place, _ = held.sorted()
            doc = ids[0][np.searchsorted(firsts, place, "right") - 1]
            keys, place, doc, number, waiting = _collapsed(keys, place, doc, base, HOT, np.minimum.reduceat)
            out = _own(name, firsts, ids, base, number, waiting)
            if len(number):
                least = np.empty(number[-1] + 1, np.int64)
                hot = place >= base
                least[place[hot] - base] = doc[hot]
                later = waiting[ids[0][np.searchsorted(firsts, waiting, "right") - 1] > least[number]]
                out.append((-1 - name, kernel.pack(np.sort(later).astype(np.uint64), np.zeros(len(later), np.int64))))
            cuts = kernel.by_range(keys, bits)
            for r in np.flatnonzero(np.diff(cuts)):
                here = slice(cuts[r], cuts[r + 1])
                docs, which = np.unique(doc[here], return_inverse=True)
                out.append((int(r), kernel.pack(keys[here], place[here] * len(docs) + which, np.stack((np.full(len(docs), name), docs), 1).reshape(-1))))
            places.clear()
            base = 0
            return _batch(out, "part")

        for b in batches:
            b = b.filter(pa.compute.and_(pa.compute.is_valid(b.column(0)), pa.compute.is_valid(b.column(2))))
            w = kernel.words(b.column(1))
            g = kernel.grams(w.hash, window, 13)
            if not len(g):
                continue
            spans = b.column(2)
            size = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten().to_numpy().reshape(-1, 2) + np.repeat(w.first[:-1], size // 2)[:, None]
            # places whose window holds a whole hit: from a span's start - (window - block) to its end - block
            mark = np.zeros(len(w.hash) + 2, np.int64)
            low = np.maximum(flat[:, 0] - (window - block), np.repeat(w.first[:-1], size // 2))
            np.add.at(mark, low, 1)
            np.add.at(mark, flat[:, 1] - block + 1, -1)
            near = np.cumsum(mark)[: len(g)] > 0
            keep_ = np.flatnonzero(near & (w.text[: len(g)] == w.text[window - 1 :]))
            held.add(g[keep_], keep_ + base, np.zeros(len(keep_), np.int64))
            places.append((np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "version")]), w.first[:-1] + base))
            base += len(w.hash)
            if held.n >= FLUSH // 2 or base >= FLUSH:
                if held.n:
                    yield flush()
                else:
                    places.clear()
                    base = 0
        if held.n:
            yield flush()

    return run


def _later(batches):
    """Ranges' blobs of full windows to (flush, blob): the places whose hash has a smaller document; what flushes keep goes through."""
    for part, blobs in kernel.grouped(batches):
        if part < 0:
            yield _batch([(-1 - part, x) for x in blobs], "flush")
            continue
        keys, place, name, doc = _entries(blobs)
        start = kernel.runs(keys)
        first = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(keys))))
        yield _answers(place[doc > first], name[doc > first])


def _cut(batches):
    """(doc_id, text, removed spans) to (doc_id, n_words, n_removed, kept)."""
    for b in batches:
        w = kernel.words(b.column(1))
        raw = w.data.tobytes()
        counts = w.counts()
        spans = b.column(2).to_pylist()
        removed, kept = [], []
        for i, n in enumerate(counts.tolist()):
            first = int(w.first[i])
            gone = np.zeros(n, bool)
            for a, e in zip(spans[i][::2], spans[i][1::2], strict=True) if spans[i] else ():
                gone[a:e] = True
            stay = np.flatnonzero(~gone) + first
            removed.append(n - len(stay))
            kept.append(b" ".join([raw[a:e] for a, e in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)]).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _digested(batches):
    for b in batches:
        for x in _cut([b]):
            yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array([hashlib.sha256(t.encode()).hexdigest() for t in x.column(3).to_pylist()])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _merged(spans: DataFrame) -> DataFrame:
    """One row for each id and text: the spans of repeated rows are joined into one list."""
    return spans.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs(doc_id, text, version) to (doc_id, version, spans): word spans [start, end, start, end ...] that also start in a smaller doc_id; documents without any are left out."""
    spark = docs.sparkSession
    ready(spark)
    block = (window + 1) // 2
    bits = ranges_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, RANGE)
    first = min(bits, kernel.FIRST_BITS)

    def by_flush(rows):
        return rows.repartition(F.col("flush")).sortWithinPartitions("flush")

    blobs = docs.mapInArrow(_anchors(block, first), "part long, blob binary")
    hits = kernel.in_ranges(blobs, bits, 2, 64 - ANCHOR_BITS).mapInArrow(_hits, "flush long, blob binary")
    hits = keep(_merged(by_flush(hits).mapInArrow(_per_document(block), "doc_id long, version long, spans array<long>")))
    around = docs.join(hits, ["doc_id", "version"]).select("doc_id", "text", "spans", "version").mapInArrow(_windows(window, block, first), "part long, blob binary")
    later = kernel.in_ranges(around, bits, 2).mapInArrow(_later, "flush long, blob binary")
    return keep(_merged(by_flush(later).mapInArrow(_per_document(window), "doc_id long, version long, spans array<long>")))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    return texts.join(repeated_spans(texts, window), ["doc_id", "version"], "left").select("doc_id", "text", "spans")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """docs to (doc_id, n_words, n_removed, kept): kept words joined by one space; one row per row of docs."""
    return _with_spans(docs, id_col, text_col, window).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def substring_dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """As substring_dedup, with the SHA-256 of the kept text in its place."""
    return _with_spans(docs, id_col, text_col, window).mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")
