"""Vectorised word and n-gram hashing shared by the text operators.

Everything here works on whole Arrow string columns: the UTF-8 buffer is cut
into words with numpy masks, a word's 64-bit hash comes from one running
polynomial sum over the buffer, and an n-gram's hash is a weighted sum of the
hashes of its words.  No Python code runs per word.

Word definition: ``[^\\x20\\x09-\\x0D]+``; a null text has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters and digits: ASCII white space, punctuation and controls stand between words, all other bytes are in them.
PLAIN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at once; bounds the kernel's scratch memory to about 30 bytes for each of these.
PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = _odd(256, 11)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if 0 not in _powers or len(_powers[0][0]) < n:
        def up(b: int) -> np.ndarray:
            a = np.full(n + 1, b, np.uint64)
            a[0] = 1
            return np.cumprod(a, dtype=np.uint64)

        _powers[0] = (up(_BASE), up(_INVERSE))
    return _powers[0]


@dataclass
class Words:
    """Words of a batch of texts, in order: byte spans, hash, text index; first[i]:first[i+1] are text i's words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Cut every text into words and hash them; lower: A-Z count as a-z; between: the bytes that separate words."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, z.astype(np.uint64), z, np.zeros(len(offsets), np.int64))
    solid = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before &= ~edge[:-1]
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after &= ~edge[1:]
    end = np.flatnonzero(solid & ~after) + 1
    del solid, before, after, edge
    hashes = np.empty(len(start), np.uint64)
    w = 0
    while w < len(start):
        lo = start[w]
        v = max(w + 1, int(np.searchsorted(end, lo + PIECE, "right")))
        hi = end[v - 1]
        up, down = _power(max(PIECE, int(hi - lo)) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        hashes[w:v] = (total[end[w:v] - lo] - total[start[w:v] - lo]) * down[start[w:v] - lo]
        w = v
    text = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    return Words(data, start, end, mix(hashes ^ (end - start).astype(np.uint64)), text, first)


def grams(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every k consecutive word hashes; the caller masks those that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_odd(k, seed * 1000 + k)):
        out += hashes[j : j + n] * c
    return mix(out)


# Sorted integer lists as bytes: differences at the least width that holds the largest.


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    x = np.ascontiguousarray(x, dtype="<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return width, x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(raw: bytes, width: int) -> np.ndarray:
    x = np.zeros((len(raw) // width, 8), np.uint8)
    x[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return x.reshape(-1).view("<u8")


def pack(keys: np.ndarray, values: np.ndarray, table: np.ndarray | None = None) -> bytes:
    """Sorted uint64 keys, a value below 2**63 for each, and a table of 64-bit numbers."""
    table = np.zeros(0, np.int64) if table is None else table
    wk, k = _narrow(np.diff(keys, prepend=np.uint64(0)))
    wv, v = _narrow(values)
    return np.array([wk, wv, len(keys), len(table)], "<i8").tobytes() + k + v + table.astype("<i8").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wk, wv, n, t = (int(x) for x in np.frombuffer(raw[:32], "<i8"))
    a = 32 + n * wk
    b = a + n * wv
    keys = np.cumsum(_widen(raw[32:a], wk), dtype=np.uint64)
    return keys, _widen(raw[a:b], wv).astype(np.int64), np.frombuffer(raw[b : b + 8 * t], "<i8")


def by_range(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2**bits equal ranges of the 64-bit key space in sorted keys."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(keys, edges, "left"), [len(keys)]))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))


#: log2 of the ranges that one flush of a task is cut into; more are made from these by another shuffle.
FIRST_BITS = 12


def grouped(batches):
    """(part, blob) rows in order of part to (part, blobs) lists; a list is bounded by the size of a range."""
    part, blobs = None, []
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if p != part:
                if blobs:
                    yield part, blobs
                part, blobs = p, []
            blobs.append(x.as_py())
    if blobs:
        yield part, blobs


def _finer(bits: int, to: int, wide: int, spare: int, flush: int = 1 << 20):
    """Blobs of ranges of `bits` to those of the finer ranges of `to` bits; blobs of negative parts as they are."""

    def run(batches):
        for part, blobs in _parcels(batches, flush):
            if part < 0:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])
                continue
            parts = [unpack(x) for x in blobs]
            tables = [t.reshape(-1, wide) for _, _, t in parts]
            at = np.cumsum([0, *map(len, tables)])
            keys = np.concatenate([k for k, _, _ in parts])
            which = np.concatenate([v % max(1, len(t)) + a for (_, v, _), t, a in zip(parts, tables, at, strict=False)])
            values = np.concatenate([v // max(1, len(t)) for (_, v, _), t in zip(parts, tables, strict=True)])
            table = np.concatenate(tables)
            order = np.argsort(keys, kind="stable")
            keys, which, values = keys[order], which[order], values[order]
            edges = (np.uint64(part) << np.uint64(64 - bits)) + (np.arange(1, 1 << (to - bits), dtype=np.uint64) << np.uint64(64 - to))
            cuts = np.concatenate(([0], np.searchsorted(keys, edges >> np.uint64(spare), "left"), [len(keys)]))
            out = []
            for r in np.flatnonzero(np.diff(cuts)):
                here = slice(cuts[r], cuts[r + 1])
                own, value = table, values[here]
                if len(table):
                    own, row = np.unique(table[which[here]], return_inverse=True, axis=0 if wide > 1 else None)
                    value = value * len(own) + row.reshape(-1)
                out.append(((part << (to - bits)) + int(r), pack(keys[here], value, own.reshape(-1))))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["part", "blob"])

    return run


def _parcels(batches, flush: int):
    """As grouped, but a long list comes in parcels of about `flush` bytes."""
    part, blobs, n = None, [], 0
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if blobs and (p != part or n >= flush):
                yield part, blobs
                blobs, n = [], 0
            part = p
            blobs.append(x.as_py())
            n += len(blobs[-1])
    if blobs:
        yield part, blobs


def in_ranges(blobs: DataFrame, bits: int, wide: int = 1, spare: int = 0) -> DataFrame:
    """(part, blob) rows of min(bits, FIRST_BITS) ranges, to rows of 2**bits ranges that stand together, in order, in one task each.

    A blob's table has rows of `wide` numbers; without a table a value is any
    number, else it is a number times the table's rows, plus the row it goes with.
    Keys come without their `spare` lowest bits.
    """
    now = min(bits, FIRST_BITS)
    while now < bits:
        to = min(bits, now + FIRST_BITS)
        blobs = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(_finer(now, to, wide, spare), "part long, blob binary")
        now = to
    return blobs.repartition(F.col("part")).sortWithinPartitions("part")
