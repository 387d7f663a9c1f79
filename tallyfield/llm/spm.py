r"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file compiles into one transducer, the composition of

* the normaliser: the model's rule table, of which the longest rule that fits is
  applied place by place, then extra spaces away, a dummy prefix, spaces to ``▁``,
* the pieces: an arc for each piece from its characters to its id, and for a
  character that no piece holds the arcs of its UTF-8 bytes,
* for BPE models an acceptor of id pairs.  A sequence of pieces is what merging
  gives if and only if every two neighbours, merged on their own, stay those two
  pieces; the acceptor's state is the last piece, and its arcs weigh 0 if the
  pair is stable and infinity if not.  Its arcs are found when first asked for.

A text is composed with it and the shortest path in the tropical semiring taken:
for unigram models the least sum of -score, for BPE the one path of finite weight.
Unknown characters in a row have one id if the model has no bytes to fall back to.
Models with user-defined pieces are refused.

No piece holds ``▁`` behind another character, and some characters are in no
longer piece at all; paths of what stands between such places are independent,
so the shortest path of a text is put together from those of its segments, which
are remembered (at most CACHE of them).

Behaviour: a null text has null ids, an empty one none; texts of any length are
encoded whole; an empty table gives no rows; a text with ``▁`` itself decodes to
a space, and one that the rule table changes to what it was changed to, which
round_trip reports.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ready

#: Segments, and pairs of pieces, that a Python worker remembers.
CACHE = 250_000
PAIRS = 1_000_000
SPACE = "▁"
# Fixed values of the model format: piece types, model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(raw: bytes):
    """(field number, value) of a protocol buffer message: ints, floats' four bytes, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + size]
            at += size


class Rules:
    """The normaliser's rule table: a double-array trie of UTF-8 strings, its leaves places in a list of what replaces them."""

    def __init__(self, table: bytes):
        size = struct.unpack_from("<I", table)[0] if table else 0
        self.trie = struct.unpack_from(f"<{size // 4}I", table, 4) if table else ()
        self.to = table[4 + size :]

    def step(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the text at a place, and how many bytes of it that replaces."""
        trie, size, found = self.trie, 0, -1
        if trie:
            node = self._below(0, trie[0])
            for i in range(at, len(raw)):
                node ^= raw[i]
                if node >= len(trie) or trie[node] & 0x800000FF != raw[i]:
                    break
                leaf = trie[node] & 256
                node = self._below(node, trie[node])
                if leaf:
                    size, found = i + 1 - at, trie[node] & 0x7FFFFFFF
        if size:
            return self.to[found : self.to.index(0, found)], size
        size = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return raw[at : at + size], size

    @staticmethod
    def _below(node: int, unit: int) -> int:
        """A unit holds the offset of what is below its node: 21 bits, eight bits further if its tenth bit is set."""
        return node ^ unit >> 10 << (8 if unit & 512 else 0)


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model, self.prefix, self.escape, self.trim, self.rules = UNIGRAM, True, True, True, Rules(b"")
        for number, value in fields(model):
            if number == 1:
                one = dict(fields(value))
                self.pieces.append(one[1].decode())
                self.scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.kinds.append(one.get(3, NORMAL))
            elif number == 2:
                self.model = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(fields(value))
                self.rules, self.trim = Rules(rules.get(2, b"")), bool(rules.get(4, 1))
                self.prefix, self.escape = bool(rules.get(3, 1)), bool(rules.get(5, 1))
        if self.model not in (UNIGRAM, BPE) or USER_DEFINED in self.kinds:
            raise ValueError("this model isn't supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.scores[i] for i in self.ids.values()) - 10
        # of every prefix of a piece: the pieces it starts with, (id, length), longest first
        self.arcs: dict[str, tuple[tuple[int, int], ...]] = {"": ()}
        for p in sorted({p[:j] for p in self.ids for j in range(1, len(p) + 1)}, key=len):
            self.arcs[p] = ((self.ids[p], len(p)), *self.arcs[p[:-1]]) if p in self.ids else self.arcs[p[:-1]]
        self.cut = self._cuts()
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.raw[self.unknown] = " ⁇ ".encode()

    def _cuts(self) -> re.Pattern:
        """Segments: what can't be in one piece is apart - text before a space, letters and others, and characters in no longer piece."""
        bodies = [p.lstrip(SPACE) for p in self.ids]
        if any(SPACE in p for p in bodies):
            return re.compile(r"(?s).+")
        joined = {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}
        letters = {c for c in joined if c.isalpha()}
        apart = not any(letters & {*p} and {*p} - letters for p in bodies)
        groups = [g for g in ([letters, joined - letters] if apart else [joined]) if g]
        runs = [f"{SPACE}*[{''.join(sorted(map(re.escape, g)))}]+" for g in groups]
        return re.compile("|".join([*runs, f"{SPACE}+", "(?s:.)"]))

    def normalise(self, text: str) -> str:
        if self.rules.trie:
            text = self._ruled(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return text
        text = f" {text}" if self.prefix else text
        return text.replace(" ", SPACE) if self.escape else text

    def _ruled(self, text: str) -> str:
        raw, at, out = text.encode(), 0, []
        while at < len(raw):
            to, size = self.rules.step(raw, at)
            out.append(to)
            at += size
        return b"".join(out).decode()

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours, the best-scored piece first and of equals the leftmost, until no two make a piece."""
        ids, scores = self.ids, self.scores
        while len(symbols) > 1:
            best = at = None
            for i in range(len(symbols) - 1):
                piece = ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def accepts(self, last: int, piece: int) -> bool:
        """The pair acceptor; last: -1 at the start of a segment."""
        key = (last, piece)
        found = self.stable.get(key)
        if found is None:
            pair = [self.pieces[piece]] if last < 0 else [self.pieces[last], self.pieces[piece]]
            found = self.merged(list("".join(pair))) == pair
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            self.stable[key] = found
        return found

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode()) if self.bytes else (self.unknown,)

    def shortest(self, segment: str) -> tuple[int, ...]:
        """The ids on the shortest path through a segment."""
        return self._stable_path(segment) if self.model == BPE else self._least_path(segment)

    def _stable_path(self, segment: str) -> tuple[int, ...]:
        """BPE: all finite paths weigh 0, so the first that a search finds, the longest arcs first, is the shortest.

        What leads to a place by stable pairs is what merging gives for the text
        up to there, so a place has one state and is entered once.
        """
        arcs, stable, accepts, n = self.arcs, self.stable, self.accepts, len(segment)
        entered: set[int] = set()
        path: list[int] = []
        ends: list[int] = [0]
        ways: list = []  # of each place on the path: the arcs left to try
        at, last = 0, -1
        while at < n:
            if len(ways) == len(path):
                end = min(at + 3, n)
                found = arcs.get(segment[at:end])
                if found is None:
                    while found is None:
                        end -= 1
                        found = arcs.get(segment[at:end])
                else:
                    while end < n:
                        end += 1
                        more = arcs.get(segment[at:end])
                        if more is None:
                            break
                        found = more
                # the fallback arc: a character in no longer piece has no neighbour to merge with
                ways.append(iter(found or ((-2, 1),)))
            for piece, length in ways[-1]:
                end = at + length
                if end in entered:
                    continue
                if piece == -2:
                    ok = True
                elif last == -2:
                    ok = accepts(-1, piece)
                else:
                    ok = stable.get((last, piece))
                    if ok is None:
                        ok = accepts(last, piece)
                if ok:
                    entered.add(end)
                    path.append(piece)
                    ends.append(end)
                    at, last = end, piece
                    break
            else:
                ways.pop()
                ends.pop()
                path.pop()
                at, last = ends[-1], path[-1] if path else -1
        if -2 not in path:
            return tuple(path)
        out, at = [], 0
        for piece in path:
            out += [piece] if piece >= 0 else self.fallback(segment[at])
            at += len(self.pieces[piece]) if piece >= 0 else 1
        return tuple(out)

    def _least_path(self, segment: str) -> tuple[int, ...]:
        """Unigram: the least sum of -score, place by place."""
        ids, n, longest = self.ids, len(segment), self.longest
        back, last = [0] * (n + 1), [-1] * (n + 1)
        least = [0.0] + [float("inf")] * n
        lowest = self.lowest
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                piece = ids.get(segment[j:i])
                if piece is not None and least[j] - self.scores[piece] < least[i]:
                    least[i], back[i], last[i] = least[j] - self.scores[piece], j, piece
            if segment[i - 1] not in ids and least[i - 1] - lowest < least[i]:
                least[i], back[i], last[i] = least[i - 1] - lowest, i - 1, -2
        out: list[tuple[int, ...]] = []
        while n:
            out.append((last[n],) if last[n] >= 0 else self.fallback(segment[n - 1]))
            n = back[n]
        return tuple(x for part in reversed(out) for x in part)

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for segment in self.cut.findall(self.normalise(text)):
            ids = known.get(segment)
            if ids is None:
                ids = self.older.get(segment) or self.shortest(segment)
                if len(segment) <= 48:
                    known[segment] = ids
            out += ids
        if not self.bytes:
            out = [x for i, x in enumerate(out) if x != self.unknown or not i or out[i - 1] != x]
        if len(known) >= CACHE:  # what was used of late stays for another generation
            self.known, self.older = {}, known
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if (self.prefix or self.trim) and raw[:1] == b" " else raw).decode("utf-8", "replace")


_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """A worker compiles a model once."""
    key = hash(model)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    return _compiled[key]


def _encode(model):
    def run(batches):
        t = compiled(model.value)
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                texts = part.column(1).to_pylist()
                ids = [None if x is None else t.encode(x) for x in texts]
                same = [None if x is None else t.decode(i) == x for x, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if i is None else len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    return run


def _decode(model):
    def run(batches):
        t = compiled(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else t.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def _model(df: DataFrame, path: str):
    """The model's bytes, read by the driver and broadcast: some hundred kilobytes, whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to (doc_id, n_tokens, token_ids, round_trip): round_trip says that decoding gives the text back."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(_model(docs, model_path)), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, token_ids) to (doc_id, text)."""
    ready(tokens.sparkSession)
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("token_ids"))
    return rows.mapInArrow(_decode(_model(tokens, model_path)), "doc_id long, text string")
