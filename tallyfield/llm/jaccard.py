"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence matrix.

1. Every document's set of word n-grams is hashed.  Documents with equal sets
   are one *class* (one row of the matrix), so copies never pair up.
2. The matrix is laid out in column ranges (of n-gram hashes, shipped as
   sorted, delta-coded arrays).  A range drops its columns with one class: they
   can't add to any product.  The others get the log of their class count.
3. A class whose shared columns can't reach the threshold leaves.  Two classes
   that do reach it share a column within the size-derived prefix of both, so
   every prefix column names a *tile*, that of its smallest class, and each
   class goes once, whole, to every tile that a prefix column of it names.
   Copies of one text mostly have one smallest class, so their tiles are few.
4. A tile is multiplied in one task, column block by column block: overlap
   counts add up, and after each block the pairs that can't reach the threshold
   any more, by the set sizes and the columns that are left, are discarded, and
   rows without a pair left are compacted away.  No pair leaves the task: only
   a spanning forest of its links does, fewer rows than the tile has.
5. A tile beyond `TILE_ENTRIES` or `TILE_ROWS` is dealt into blocks, each with the tile's first
   class beside it.  Of such tiles, the classes outside the largest component
   are then multiplied with all others, block against block.

Results are exact up to hash collisions: n-grams are compared by 56 bits (two
sets of 1000 n-grams take a false overlap with a chance below 2**-36), classes
by 64 bits of a sum over the set.

Behaviour: null or blank texts have an empty set and no links; rows with a
null id come back with the component of their class (null if none of it has
an id); repeated ids and rows each come back; an empty table gives no rows;
columns of docs other than the id and the text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .session import keep, ranges_for, ready, unused

#: Words whose n-grams a task gathers before it sends them off; bounds its memory.
FLUSH = 1 << 20
#: Bits of an n-gram's hash in the product's column keys; the bits above hold log2 of the column's count.
COLUMN_BITS = 56
#: N-grams that one column range holds, about; ranges grow in number with the data.
RANGE = 1 << 21
#: Entries and rows of a tile's block, about; they bound a task's memory.
TILE_ENTRIES, TILE_ROWS = 1 << 19, 2048
#: Classes of a column from which on it is multiplied as a dense one.
DENSE = 40


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, n-gram hash) of every distinct n-gram sorted by text, and set sizes.  Texts of fewer than k words: the whole sequence."""
    w = kernel.words(column, lower=True)
    counts = w.counts()
    g = kernel.grams(w.hash, k)
    whole = w.text[: len(g)] == w.text[k - 1 :] if len(g) else np.zeros(0, bool)
    text, gram = w.text[: len(g)][whole], g[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = [kernel.mix(np.array([np.bitwise_xor.reduce(kernel.mix(w.hash[a : a + n] + np.arange(1, n + 1, dtype=np.uint64)))], np.uint64) + np.uint64(n))[0] for a, n in zip(w.first[short], counts[short], strict=True)]
        text, gram = np.concatenate((text, short)), np.concatenate((gram, np.array(extra, np.uint64)))
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    if len(gram):
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
        text, gram = text[new], gram[new]
    return text, gram, np.bincount(text, minlength=len(column)).astype(np.int64)


def class_ids(text: np.ndarray, gram: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each text's set, from the wrapping sum of its mixed hashes."""
    ends = np.cumsum(sizes)
    total = np.concatenate(([np.uint64(0)], np.cumsum(kernel.mix(gram ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return kernel.mix((total[ends] - total[ends - sizes]) ^ kernel.mix(sizes.astype(np.uint64))).view(np.int64)


def _sizes(k: int):
    def run(batches):
        for b in batches:
            text, gram, sizes = shingle_sets(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(class_ids(text, gram, sizes))], names=["doc_id", "n_shingles", "cls"])

    return run


def _columns(k: int, bits: int):
    """Texts to (range, packed) rows: sorted n-gram hashes, each with the row of its class in the table behind them."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        n = 0

        def flush():
            grams = np.concatenate([x for x, _ in held])
            rows = np.concatenate([y for _, y in held])
            order = np.argsort(grams)
            grams, rows = grams[order], rows[order]
            cuts = kernel.by_range(grams, bits)
            ranges = np.flatnonzero(np.diff(cuts))
            blobs = []
            for r in ranges:
                table, value = np.unique(rows[cuts[r] : cuts[r + 1]], return_inverse=True)
                blobs.append(kernel.pack(grams[cuts[r] : cuts[r + 1]], value, table))
            return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for b in batches:
            text, gram, sizes = shingle_sets(b.column(0), k)
            ids = class_ids(text, gram, sizes)
            first = np.zeros(len(ids), bool)
            for i, c in enumerate(ids.tolist()):
                if sizes[i] and c not in seen:
                    seen.add(c)
                    first[i] = True
            new = first[text]
            if new.any():
                held.append((gram[new], ids[text[new]]))
                n += int(new.sum())
            if n >= FLUSH:
                yield flush()
                held, seen, n = [], set(), 0
        if held:
            yield flush()

    return run


def _shared(bits: int):
    """(part, blob) rows in order of part to blobs of ranges of classes: the columns of a class that other classes have too."""

    def run(batches):
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            cls, column = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            order = np.argsort(cls.view(np.uint64), kind="stable")
            cls, column = cls[order], column[order]
            cuts = kernel.by_range(cls.view(np.uint64), bits)
            ranges = np.flatnonzero(np.diff(cuts))
            blobs = [kernel.pack(cls[cuts[r] : cuts[r + 1]].view(np.uint64), column[cuts[r] : cuts[r + 1]]) for r in ranges]
            return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "blob"])

        held = 0
        for _, blobs in kernel.grouped(batches):
            parts = [kernel.unpack(x) for x in blobs]
            keys = np.concatenate([p[0] for p in parts])
            cls = np.concatenate([p[2][p[1]] for p in parts])
            del parts
            order = np.lexsort((cls, keys))
            keys, cls = keys[order], cls[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])
            keys, cls = keys[new], cls[new]
            start = kernel.runs(keys)
            count = np.diff(np.append(start, len(keys)))
            count = np.repeat(count, count)
            several = count > 1
            keys, cls, count = keys[several], cls[several], count[several]
            if len(keys):
                out.append((cls, ((np.log2(count).astype(np.uint64) << np.uint64(COLUMN_BITS)) | (keys >> np.uint64(64 - COLUMN_BITS))).view(np.int64)))
                held += len(keys)
            if held >= FLUSH:
                yield flush()
                held = 0
        if out:
            yield flush()

    return run


def _whole(batches):
    """Blobs of _shared in order of part to (cls, columns) rows, each class once, its columns in order."""
    for _, blobs in kernel.grouped(batches):
        parts = [kernel.unpack(x) for x in blobs]
        cls = np.concatenate([k for k, _, _ in parts]).view(np.int64)
        column = np.concatenate([v for _, v, _ in parts])
        del parts
        order = np.lexsort((column, cls))
        cls, column = cls[order], column[order]
        start = kernel.runs(cls)
        yield pa.RecordBatch.from_arrays([pa.array(cls[start]), pa.ListArray.from_arrays(pa.array(np.append(start, len(cls)).astype(np.int32)), pa.array(column))], names=["cls", "cols"])


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the links a[i] - b[i] that a spanning forest needs."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out.append(i)
    return out


def _pairs(rows: np.ndarray, start: np.ndarray, count: np.ndarray, allowed, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(a * width + b, overlap) of the pairs of rows a < b that meet in columns; column i holds rows[start[i] :][: count[i]]."""
    codes, sums, n = [], [], 0

    def added():
        key, at = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(sums), minlength=len(key))
        codes[:], sums[:] = [key], [total]

    for c in np.unique(count).tolist():
        i, j = np.triu_indices(c, 1)
        each = max(1, (1 << 21) // len(i))
        here = start[count == c]
        for at in range(0, len(here), each):
            member = rows[here[at : at + each, None] + np.arange(c)]
            a, b = member[:, i].ravel(), member[:, j].ravel()
            ok = allowed(a, b)
            codes.append(a[ok] * width + b[ok])
            sums.append(np.ones(len(codes[-1])))
            n += len(codes[-1])
            if n >= 1 << 22:
                added()
                n = len(codes[0])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0)
    added()
    return codes[0], sums[0]


def _dense(n: np.ndarray, m: np.ndarray, columns: list[np.ndarray], allowed: np.ndarray, overlap: np.ndarray, percent: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of rows of one tile: overlap counts so far, plus those of columns, each an array of rows.

    m: how many entries of each row columns has.  Pairs are dropped when the entries left can't make up the overlap they need.
    """
    need = percent * (n[:, None] + n[None, :]) / (100 + percent)
    live, rest = np.arange(len(n)), m.astype(np.float64)
    for at in range(0, len(columns), block):
        possible = allowed & (overlap + np.minimum(rest[:, None], rest[None, :]) >= need)
        stay = np.flatnonzero(possible.any(1))
        if len(stay) < 0.8 * len(live):
            live, rest = live[stay], rest[stay]
            allowed, overlap, need = (x[np.ix_(stay, stay)] for x in (allowed, overlap, need))
        if not len(live):
            break
        to = np.full(len(n), -1)
        to[live] = np.arange(len(live))
        some = columns[at : at + block]
        row = to[np.concatenate(some)]
        column = np.repeat(np.arange(len(some)), [len(x) for x in some])
        x = np.zeros((len(live), len(some)), np.float32)
        x[row[row >= 0], column[row >= 0]] = 1
        overlap = overlap + x @ x.T
        rest = rest - x.sum(1)
    linked = allowed & (overlap >= need)
    # breadth first over the links: every row is reached once
    unseen, out = np.ones(len(live), bool), []
    for first in range(len(live)):
        queue = [first] if unseen[first] else []
        unseen[first] = False
        while queue:
            at = queue.pop()
            fresh = np.flatnonzero(linked[at] & unseen)
            unseen[fresh] = False
            queue += fresh.tolist()
            out += [(at, x) for x in fresh.tolist()]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return live[a], live[b]


def tile_links(tile: np.ndarray, n: np.ndarray, size: np.ndarray, cols: np.ndarray, node: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, node) of the links within tiles.

    Rows are in order of tile; row i has set size n[i] and the next size[i] of cols.
    Rows of one node are not compared, nor rows of one side (0: of any).
    """
    rows = len(tile)

    def allowed(a, b):
        return (node[a] != node[b]) & ((side[a] != side[b]) | (side[a] == 0)) & (n[a] * 100 >= n[b] * percent) & (n[b] * 100 >= n[a] * percent)

    row = np.repeat(np.arange(rows), size)
    order = np.lexsort((cols, tile[row]))
    row, key, of = row[order], cols[order], tile[row[order]]
    new = np.ones(len(row), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(row)))
    sparse, dense = (count > 1) & (count < DENSE), np.flatnonzero(count >= DENSE)
    code, overlap = _pairs(row, start[sparse], count[sparse], allowed, rows)
    a, b = code // max(rows, 1), code % max(rows, 1)
    found = [(a[ok], b[ok]) for ok in [((100 + percent) * overlap >= percent * (n[a] + n[b])) & ~np.isin(tile[a], tile[row[start[dense]]])]]
    for t in np.unique(tile[row[start[dense]]]):
        lo, hi = np.searchsorted(tile, [t, t + 1])
        here = dense[tile[row[start[dense]]] == t]
        here = here[np.argsort(-count[here], kind="stable")]
        columns = [row[start[i] : start[i] + count[i]] - lo for i in here]
        so_far = np.zeros((hi - lo, hi - lo), np.float32)
        own = tile[a] == t
        so_far[a[own] - lo, b[own] - lo] = so_far[b[own] - lo, a[own] - lo] = overlap[own]
        all_rows = np.arange(lo, hi)
        x, y = _dense(n[lo:hi], np.bincount(np.concatenate(columns), minlength=hi - lo), columns, allowed(all_rows[:, None], all_rows[None, :]), so_far, percent)
        found.append((x + lo, y + lo))
    a, b = (node[np.concatenate(x)] for x in zip(*found, strict=True))
    return a, b


def _multiplied(percent: int):
    """(key..., node, side, n, cols) rows in order of key to links (a, b) of nodes."""

    def run(batches):
        held: list[tuple] = []
        total = tiles = 0
        last = None

        def flush():
            tile, n, size, cols, node, side = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            a, b = tile_links(tile, n, size, cols, node, side, percent)
            at = _forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at])], names=["a", "b"])

        for b in batches:
            if not len(b):
                continue
            key = np.stack([b.column(i).to_numpy() for i in range(3)])
            new = np.ones(len(b), bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
            new[0] = last is None or tuple(key[:, 0]) != last
            last = tuple(key[:, -1])
            lists = b.column(6)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            cuts = np.append(np.flatnonzero(new), len(b))
            if cuts[0]:
                cuts = np.insert(cuts, 0, 0)
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if new[x]:
                    tiles += 1
                    if total >= TILE_ENTRIES:
                        yield flush()
                        total = 0
                held.append((np.full(y - x, tiles), b.column(5).to_numpy()[x:y], np.diff(ends[x : y + 1]), flat[ends[x] : ends[y]], b.column(3).to_numpy()[x:y], b.column(4).to_numpy()[x:y]))
                total += len(held[-1][3])
        if held:
            yield flush()

    return run


def _links(rows: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """placed(tile, x, y, cls, node, side): the links between nodes that rows of one block (tile, x, y) reach."""
    blocks = placed.join(rows.select("cls", "n", "cols"), "cls").select("tile", "x", "y", "node", "side", "n", "cols")
    return blocks.repartition("tile", "x", "y").sortWithinPartitions("tile", "x", "y").mapInArrow(_multiplied(percent), "a long, b long")


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """(tile, cls, n, m): which tiles each class goes to."""
    entries = rows.select("cls", "n", F.size("cols").alias("m"), F.posexplode(F.slice("cols", 1, F.col("p"))).alias("at", "col"))
    column = entries.groupBy("col").agg(F.min("cls").alias("tile"), F.count("*").alias("classes"), F.min("n").alias("low"), F.max("n").alias("high")).where("classes > 1")
    met = entries.join(column, "col").where((F.col("high") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("low") * percent))
    # from the first column that two rows share, all of their overlap is ahead: what is left must make up for the smallest partner
    met = met.where((100 + percent) * (F.col("m") - F.col("at")) >= percent * (F.col("n") + F.col("low")))
    return met.select("tile", "cls", "n", "m").distinct()


def _dealt(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tiles in blocks of about TILE_ENTRIES: each class in one, the tile's own class in all."""
    x = F.when(F.col("cls") == F.col("tile"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), F.col("blocks"))))
    return members.join(sizes, "tile").select("tile", F.explode(x).alias("x"), F.lit(0).cast("long").alias("y"), "cls", F.col("cls").alias("node"), F.lit(0).cast("long").alias("side"))


def _across(members: DataFrame, state: DataFrame, large: DataFrame) -> DataFrame:
    """Blocks of large tiles for what is left: classes outside the largest component, against all."""
    inside = keep(members.join(large.select("tile"), "tile").join(state, "cls", "left").select("tile", "cls", "m", F.coalesce("component", "cls").alias("node")))
    sums = inside.groupBy("tile", "node").agg(F.count("*").alias("k"), F.sum("m").alias("e"))
    main = sums.groupBy("tile").agg(F.max_by("node", F.struct("k", "node")).alias("main"), F.sum("k").alias("rows"), F.sum("e").alias("entries"), F.max("k").alias("most"), F.max_by("e", F.struct("k", "node")).alias("most_entries"))

    def half(rows, entries):
        return F.ceil(F.greatest(2 * rows / TILE_ROWS, 2 * entries / TILE_ENTRIES))

    main = main.where("rows > most").select("tile", "main", half(F.col("rows"), F.col("entries")).alias("all_blocks"), half(F.col("rows") - F.col("most"), F.col("entries") - F.col("most_entries")).alias("odd_blocks"))
    inside = inside.join(main, "tile")
    zero, at = F.lit(0).cast("long"), F.xxhash64("cls", F.lit(1))
    every = inside.select("tile", F.pmod(at, "all_blocks").alias("x"), F.explode(F.sequence(zero, F.col("odd_blocks") - 1)).alias("y"), "cls", "node", F.lit(1).cast("long").alias("side"))
    odd = inside.where("node <> main").select("tile", F.explode(F.sequence(zero, F.col("all_blocks") - 1)).alias("x"), F.pmod(at, "odd_blocks").alias("y"), "cls", "node", F.lit(2).cast("long").alias("side"))
    return every.unionByName(odd)


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """docs to (doc_id, n_shingles, component_id): one row per row of docs; links where 100 * overlap >= percent * union."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes = keep(texts.mapInArrow(_sizes(words), "doc_id long, n_shingles long, cls long"))
    bits = ranges_for(sizes.agg(F.sum("n_shingles")).first()[0] or 0, RANGE)
    classes = sizes.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"))

    blocks = kernel.in_ranges(texts.select("text").mapInArrow(_columns(words, min(bits, kernel.FIRST_BITS)), "part long, blob binary"), bits)
    shared = kernel.in_ranges(blocks.mapInArrow(_shared(min(bits, kernel.FIRST_BITS)), "part long, blob binary"), bits).mapInArrow(_whole, "cls long, cols array<long>")
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    rows = keep(shared.join(classes, "cls").where(F.size("cols") >= least).withColumn("p", F.size("cols") - least + 1).select("cls", "n", "p", "cols"))

    members = keep(_tiles(rows, percent))
    tiles = keep(members.groupBy("tile").agg(F.count("*").alias("rows"), F.sum("m").alias("entries")).where("rows > 1").select("tile", F.ceil(F.greatest(F.col("rows") / TILE_ROWS, F.col("entries") / TILE_ENTRIES)).alias("blocks")))
    links = keep(_links(rows, _dealt(members, tiles), percent))
    state = components(links).withColumnRenamed("node", "cls")
    large = tiles.where("blocks > 1")
    if not large.isEmpty():
        state = keep(state)
        more = _links(rows, _across(members, state, large), percent)
        state = components(links.union(keep(more))).withColumnRenamed("node", "cls")

    # components by the smallest document id of their classes
    named = keep(classes.join(state, "cls", "left").select("cls", "id", F.coalesce("component", "cls").alias("comp")))
    names = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    of = named.join(names, "comp").select("cls", "component_id")
    out = sizes.join(of, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with exactly one row of each component: that with the smallest id, a null id only where no other has one.

    Rows are told apart by id and text, so null and repeated ids follow their own
    text; of rows equal in both, one stays.  Rows without n-grams all stay.
    """
    key, by = F.xxhash64(id_col, text_col), unused("row_key", docs)
    found = ngram_jaccard(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), **options).where("n_shingles > 0")
    found = keep(found.groupBy(F.col("doc_id").alias(by), "component_id").agg(F.count("*").alias("copies")))
    ids = docs.select(key.alias(by), F.col(id_col).alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", by))
    best = keep(found.join(ids, by).groupBy("component_id").agg(first.alias("first")).select(f"first.{by}"))
    left = docs.withColumn(by, key).join(found.join(best, by, "left_anti").select(by), by, "left_anti")
    twice = keep(found.where("copies > 1").join(best, by, "left_semi").select(by))
    if not twice.isEmpty():
        left = left.join(twice, by, "left_anti").unionByName(left.join(twice, by, "left_semi").dropDuplicates([by]))
    return left.select(*docs.columns)
