"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of PASSAGE words that overlap by half.  Over the
words of the benchmark, hashed to TERMS terms, passages are TF-IDF vectors;
document frequencies come from all documents.  A randomised SVD (a one-pass
Nystroem sketch: every task adds up A'A times a random matrix, and only that
sum, of terms by rank numbers, reaches the driver) gives the latent space; the
benchmark's own passages enter it with the weight of the corpus, so that their
directions stay.  Passages whose cosine to an item reaches `cosine` are
candidates.  A candidate is a leak if the longest common subsequence of the
item's words and the passage's surroundings covers `covered` of the item, or
`paraphrased` of it and nearly all of its answer (its last sentence).

Terms, weights, rank and basis are those of the whole benchmark, whatever its
size: at most TERMS by `rank` numbers.  Documents are then searched for ITEMS
items a pass; which items share a pass changes nothing.
Words: letters, digits and bytes beyond ASCII, with A-Z as a-z.

Behaviour: null and empty texts have no passages; items without words match
nothing, items of fewer than MINIMUM words must be found whole; equal items are
reported each, and repeated rows of documents too; of equal finds in one
document the first passage is named; rows without an id come back with a null
id; an empty table on either side gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .session import keep, ready, unused

PASSAGE = 64
STRIDE = 32
#: Benchmark items searched for in one pass over the documents.
ITEMS = 4000
#: Terms that words are hashed to, and bits of the hash that tell whether a word is the benchmark's.
TERMS = 1 << 15
MEMBER_BITS = 22
#: Passages that are compared with all items of a pass at once.
AT_ONCE = 2048
MINIMUM = 8


def _plain(texts: list[str]) -> kernel.Words:
    return kernel.words(pa.array(texts, pa.string()), lower=True, between=kernel.PLAIN)


class Item:
    """An item's word hashes as bit masks for a bit-parallel longest common subsequence (Hyyroe 2004)."""

    def __init__(self, item_id: int, hashes: list[int], answer: int):
        self.id, self.n, self.answer = item_id, len(hashes), answer
        self.masks: dict[int, int] = {}
        for i, h in enumerate(hashes):
            self.masks[h] = self.masks.get(h, 0) | 1 << i

    def common(self, words: list[int]) -> tuple[int, int]:
        """(length of the longest common subsequence, its part in the item's answer)."""
        full = (1 << self.n) - 1
        v, masks = full, self.masks
        for w in words:
            m = masks.get(w)
            if m is not None:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return self.n - v.bit_count(), self.answer - (v >> (self.n - self.answer)).bit_count()


def read_items(rows: list[tuple[int, str]]) -> tuple[list[Item], list[np.ndarray]]:
    """Items, and the word hashes of each."""
    w = _plain([t for _, t in rows])
    items, all_hashes = [], [w.hash[a:b] for a, b in pairwise(w.first)]
    for (item_id, text), hashes in zip(rows, all_hashes, strict=True):
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text or "") if len(_plain([s]).hash)]
        answer = len(_plain(sentences[-1:]).hash) if len(sentences) > 1 else 0
        items.append(Item(item_id, hashes.tolist(), answer))
    return items, all_hashes


def _term(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(TERMS)).astype(np.int64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(4096)).astype(np.int64)


def _places(column, member: np.ndarray) -> tuple[kernel.Words, np.ndarray]:
    """(words, places of those that the benchmark has)."""
    w = kernel.words(column, lower=True, between=kernel.PLAIN)
    return w, np.flatnonzero(member[w.hash >> np.uint64(64 - MEMBER_BITS)])


def _frequencies(shared):
    def run(batches):
        df, n = np.zeros(TERMS, np.int64), 0
        for b in batches:
            w, found = _places(b.column(0), shared.value)
            df += np.bincount(np.unique(w.text[found] * TERMS + _term(w.hash[found])) % TERMS, minlength=TERMS)
            n += len(b)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], names=["term", "df"])

    return run


class Passages:
    """The passages of a batch that hold at least `least` informative words, as a sparse matrix: text, start word, and rows of unit length.

    place: of a term among the informative ones, or -1; idf: of the informative ones.
    """

    def __init__(self, w: kernel.Words, found: np.ndarray, place: np.ndarray, idf: np.ndarray, least: int = 3):
        term = place[_term(w.hash[found])]
        told = term >= 0
        found, term = found[told], term[told]
        text = w.text[found]
        pos = found - w.first[text]
        # a word belongs to the passage that starts in its stride and to the one before
        window = np.concatenate((pos // STRIDE, pos // STRIDE - 1))
        text, term = np.concatenate((text, text)), np.concatenate((term, term))
        ok = window >= 0
        text, term, window = text[ok], term[ok], window[ok]
        top = int(window.max(initial=0)) + 1
        key = (text * top + window) * len(idf) + term
        key, tf = np.unique(key, return_counts=True)
        row, term = key // len(idf), key % len(idf)
        start = kernel.runs(row)
        several = np.diff(np.append(start, len(row))) >= least
        stay = np.repeat(several, np.diff(np.append(start, len(row))))
        row, term, tf = row[stay], term[stay], tf[stay]
        self.start = kernel.runs(row)
        first = row[self.start]
        self.text, self.word = first // top, first % top * STRIDE
        self.term = term
        weight = (1 + np.log(tf)) * idf[term]
        norm = np.sqrt(np.add.reduceat(weight**2, self.start)) if len(row) else weight
        self.size = np.diff(np.append(self.start, len(row)))
        self.weight = (weight / np.repeat(norm, self.size)).astype(np.float32)

    def project(self, basis: np.ndarray) -> np.ndarray:
        """Rows times basis."""
        if not len(self.start):
            return np.zeros((0, basis.shape[1]), np.float32)
        return np.add.reduceat(self.weight[:, None] * basis[self.term], self.start)

    def slices(self, most: int = 1 << 15):
        """Parts of about `most` entries and at most AT_ONCE passages each."""
        rows = len(self.start)
        cuts = np.unique(np.concatenate((np.searchsorted(self.start, np.arange(0, len(self.term) + most, most)), np.arange(0, rows, AT_ONCE), [rows])))
        for a, b in pairwise(cuts):
            part = object.__new__(Passages)
            lo = self.start[a]
            hi = self.start[b] if b < len(self.start) else len(self.term)
            part.start, part.text, part.word, part.size = self.start[a:b] - lo, self.text[a:b], self.word[a:b], self.size[a:b]
            part.term, part.weight = self.term[lo:hi], self.weight[lo:hi]
            yield part


def _sketch(shared, blocks: int = 16):
    def run(batches):
        member, place, idf, omega = shared.value
        y, n = np.zeros(omega.shape, np.float32), 0
        for b in batches:
            for p in Passages(*_places(b.column(0), member), place, idf).slices():
                back = np.repeat(p.project(omega), p.size, axis=0) * p.weight[:, None]
                order = np.argsort(p.term, kind="stable")
                start = kernel.runs(p.term[order])
                if len(start):
                    y[p.term[order][start]] += np.add.reduceat(back[order], start)
                n += len(p.start)
        cuts = np.linspace(0, len(y), blocks + 1).astype(int)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks)), pa.array([n] * blocks, pa.int64()), pa.array([y[a:b].tobytes() for a, b in pairwise(cuts)], pa.binary())], names=["block", "n", "y"])

    return run


def _added(batches):
    block, n, total = None, 0, None
    for b in batches:
        for k, m, raw in zip(*(b.column(i) for i in range(3)), strict=True):
            block, n = k.as_py(), n + m.as_py()
            y = np.frombuffer(raw.as_py(), np.float32).astype(np.float64)
            total = y if total is None else total + y
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "n", "y"])


def nystroem(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors of a positive matrix G from y = G omega (Tropp et al. 2017)."""
    shift = 1e-7 * np.linalg.norm(y) + 1e-12
    y = y + shift * omega
    b = omega.T @ y
    s, u = np.linalg.eigh((b + b.T) / 2)
    good = s > 1e-10 * s.max()
    f = y @ (u[:, good] / np.sqrt(s[good]))
    return np.linalg.svd(f, full_matrices=False)[0][:, :rank]


def _latent(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _search(shared, cosine: float, covered: float, paraphrased: float):
    def run(batches):
        member, place, idf, basis, items, told = shared.value
        # the least common words that make item j a leak, its size, and which of 4096 buckets its words are in
        size_of = np.array([item.n for item in items])
        least = np.where(size_of < MINIMUM, size_of, min(covered, paraphrased) * size_of)
        buckets = np.zeros((len(items), 4096), bool)
        for j, item in enumerate(items):
            buckets[j, _bucket(np.fromiter(item.masks, np.uint64, len(item.masks)))] = True
        for b in batches:
            w, found = _places(b.column(1), member)
            hashes = w.hash[found]
            bucket = _bucket(hashes)
            out = []
            best: dict[tuple[int, int], tuple] = {}
            for p in Passages(w, found, place, idf, 1).slices():
                near = _latent(p.project(basis)) @ told.T
                i, j = np.nonzero(near >= cosine)
                text, word = p.text[i], p.word[i]
                first = w.first[text]
                # the item may start before the passage or end behind it; words outside the benchmark are in no item
                lo = np.searchsorted(found, np.maximum(first, first + word - size_of[j]))
                hi = np.searchsorted(found, np.minimum(w.first[text + 1], first + word + PASSAGE + size_of[j]))
                ok = hi - lo >= np.maximum(least[j], 1)
                i, j, text, word, lo, hi = (x[ok] for x in (i, j, text, word, lo, hi))
                if not len(i):
                    continue
                length = hi - lo
                start = np.cumsum(length) - length
                at = np.arange(length.sum()) + np.repeat(lo - start, length)
                has = buckets[np.repeat(j, length), bucket[at]]
                for k in np.flatnonzero(np.add.reduceat(has, start, dtype=np.int64) >= least[j]).tolist():
                    item, here = items[j[k]], slice(start[k], start[k] + length[k])
                    size, answer = item.common(hashes[at[here][has[here]]].tolist())
                    if size == item.n or item.n >= MINIMUM and (size >= covered * item.n or size >= paraphrased * item.n and item.answer and answer >= 0.9 * item.answer):
                        key, cos = (int(text[k]), int(j[k])), near[i[k], j[k]]
                        old = best.get(key)
                        if old is None or (size, cos) > old[:2]:
                            best[key] = (size, cos, int(word[k]))
            for (text, j), (size, cos, word) in sorted(best.items()):
                out.append((text, items[j].id, size, items[j].n, round(float(cos), 3), word))
            cols = list(zip(*out, strict=True)) or [()] * 6
            ids = b.column(0).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True))], names=["doc_id", "item_id", "common_words", "item_words", "cosine", "passage_start"])

    return run


_FOUND = "doc_id long, item_id long, common_words long, item_words long, cosine double, passage_start long"


def _passes(benchmark: DataFrame, passes: int):
    """The benchmark's items, ITEMS or so at a time; the driver holds one part."""
    for part in range(passes):
        rows = [tuple(r) for r in benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == part).orderBy("item_id", "text").toLocalIterator()]
        if rows:
            yield read_items(rows)


def _item_rows(hashes: list[np.ndarray], place: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, term, weight) of items as TF-IDF rows of unit length."""
    row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    term = place[_term(np.concatenate(hashes))]
    key, tf = np.unique((row * len(idf) + term)[term >= 0], return_counts=True)
    row, term = key // len(idf), key % len(idf)
    weight = (1 + np.log(tf)) * idf[term]
    norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=len(hashes)))
    return row, term, weight / norm[row]


def _projected(row, term, weight, n: int, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]))
    start = kernel.runs(row)
    if len(start):
        out[row[start]] = np.add.reduceat(weight[:, None] * basis[term], start)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rank: int = 160, cosine: float = 0.25, covered: float = 0.7, paraphrased: float = 0.5, common: float = 0.02, seed: int = 3) -> DataFrame:
    """(doc_id, item_id, common_words, item_words, cosine, passage_start) of every benchmark item found in a document."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    ready(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    n_items = items.count()
    passes = max(1, -(-n_items // ITEMS))
    member, terms = np.zeros(1 << MEMBER_BITS, bool), np.zeros(TERMS, bool)
    for _, hashes in _passes(items, passes):
        for h in hashes:
            member[h >> np.uint64(64 - MEMBER_BITS)] = True
            terms[_term(h)] = True
    if not terms.any():
        return spark.createDataFrame([], _FOUND)
    counts = texts.select("text").mapInArrow(_frequencies(sc.broadcast(member)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(TERMS + 1)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    n, df = df[-1], df[:-1]
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    # common words tell nothing; but every item keeps its rarest ones
    told = terms & (idf > np.log(1 / common))
    for _, hashes in _passes(items, passes):
        for h in hashes:
            term = _term(h)
            told[term[np.argsort(-idf[term], kind="stable")[:MINIMUM]]] = True
    place = np.full(TERMS, -1)
    place[told] = np.arange(told.sum())
    idf = idf[told]
    width = min(rank, len(idf))
    omega = np.random.default_rng(seed).standard_normal((TERMS, width)).astype(np.float32)[told]
    sums = texts.select("text").mapInArrow(_sketch(sc.broadcast((member, place, idf, omega))), "block long, n long, y binary")
    sums = sums.groupBy("block").applyInArrow(lambda t: pa.Table.from_batches(list(_added(t.to_batches()))), "block long, n long, y binary").toArrow().sort_by("block")
    y = np.frombuffer(b"".join(sums.column("y").to_pylist()), np.float64).reshape(len(idf), width).copy() if sums.num_rows else np.zeros(omega.shape)
    passages = sums.column("n")[0].as_py() if sums.num_rows else 0
    for _, hashes in _passes(items, passes):
        row, term, weight = _item_rows(hashes, place, idf)
        np.add.at(y, term, max(1.0, passages / n_items) * weight[:, None] * _projected(row, term, weight, len(hashes), omega)[row])
    basis = nystroem(y, omega.astype(np.float64), width).astype(np.float32)
    found = None
    for some, hashes in _passes(items, passes):
        own = _latent(_projected(*_item_rows(hashes, place, idf), len(hashes), basis)).astype(np.float32)
        new = texts.mapInArrow(_search(sc.broadcast((member, place, idf, basis, some, own)), cosine, covered, paraphrased), _FOUND)
        found = new if passes == 1 else keep(new) if found is None else found.unionByName(keep(new))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that hold a benchmark item; rows are told apart by id and text, so null and repeated ids follow their own text."""
    row = F.xxhash64(id_col, text_col)
    keyed = docs.select(row.alias("doc_id"), F.col(text_col).alias("text"))
    leak = unused("leak", docs)
    hit = keep(leaks(keyed, benchmark, **how).select(F.col("doc_id").alias(leak)).distinct())
    return docs.join(hit, row == F.col(leak), "left_anti")
