"""Quality classifier by co-training.

Two views of a document.  The content view has its words (hashed, present or
not), the last bytes of each word as features of their own, and the levels of
its shares of character classes, line breaks and distinct words.  The metadata
view reads nothing of the text: language, source and recorded size, alone and
in pairs.  A logistic model a view is fitted on labelled documents.  Over
`rounds`, both models score all documents without a label, and each hands those
of them that it is surest of to the other as pseudo-labels.  Both are then
calibrated on labelled documents that neither was fitted on (Platt), and the
sum of their log-odds over the prior scores every document.

Bounds, as fitting goes: at most `most_labelled` labelled documents, those with
the smallest hash of their id, and at most 8 * `most_pseudo` pseudo-labelled ones are
fitted on, in one task.  The search for the latter covers all documents, and so
does the final scoring, each in one pass without a shuffle of texts; what is
broadcast is the weight vectors.

There are two such pairs of models, for quality and for not toxic; P(good) is
the lesser of their probabilities.  A document is kept at P(good) >= 0.5.

Behaviour: null and empty texts have no words and are scored by their metadata;
null languages, sources and sizes (or no such columns) are a category of their
own; null labels count as bad, and so does a document with labels that
contradict each other; repeated rows are scored each, as are equal scores alike;
a label with one class only is ignored, and with two of them all is kept with
score null; an empty table gives no rows; other columns of docs come back
untouched, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .session import keep, ready

#: Features of the content view: words, then shapes of words, then levels of shares.
DIMENSIONS = 1 << 17
_SHAPES, _LEVELS = 1 << 12, 1 << 9
_WORDS = DIMENSIONS - _SHAPES - _LEVELS
#: Features of the metadata view.
METADATA = 1 << 12
HEADS = ("quality", "civil")
# Byte classes for the shares: other, lower, upper, digit, punctuation, white space, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_CLASS[[32, *range(9, 14)]] = 5


def _distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(text.astype(np.int64) * DIMENSIONS + feature)
    return key // DIMENSIONS, key % DIMENSIONS


def _shares(w: kernel.Words, column, distinct: np.ndarray) -> np.ndarray:
    """Levels of a text's shares, a row a text."""
    data, offsets = kernel.text_bytes(column)
    size = np.maximum(np.diff(offsets), 1)
    kinds, counts = _CLASS[data], np.maximum(w.counts(), 1)

    def of(mask):
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return np.diff(total[offsets]) / size

    shares = [*(np.sqrt(of(kinds == k)) for k in range(1, 7)), np.sqrt(of(data == 10) * 4), distinct / counts, size / counts / 20]
    return np.stack([np.minimum(31, 32 * x).astype(np.int64) + 32 * i for i, x in enumerate(shares)], 1)


def content_view(column) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): words without case, the shape of each word's last three bytes with the word's case, and levels of shares."""
    w, lowered = kernel.words(column), kernel.words(column, lower=True)
    word = ((lowered.hash >> np.uint64(20)) % np.uint64(_WORDS)).astype(np.int64)
    shape = np.zeros(len(w.hash), np.int64)
    for back in (3, 2, 1):
        at = np.maximum(w.end - back, w.start)
        byte = w.data[at].astype(np.int64)
        shape = shape * 131 + np.where(_CLASS[byte] == 4, byte, _CLASS[byte])
    shape = _WORDS + (kernel.mix(shape.astype(np.uint64)) % np.uint64(_SHAPES)).astype(np.int64)
    text, feature = _distinct(np.concatenate((w.text, w.text)), np.concatenate((word, shape)))
    levels = _WORDS + _SHAPES + _shares(w, column, np.bincount(text[feature < _WORDS], minlength=len(column)))
    text, feature = np.concatenate((text, np.repeat(np.arange(len(column)), levels.shape[1]))), np.concatenate((feature, levels.ravel()))
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def metadata_view(lang, source, size) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): language, source, log2 of the recorded size, and their pairs, hashed."""
    known: dict[tuple, list[int]] = {}
    rows = []
    for key in zip(lang.to_pylist(), source.to_pylist(), size.to_pylist(), strict=True):
        if key not in known:
            a, b, n = key
            n = None if n is None else max(n, 0).bit_length()
            names = (f"lang {a!r}", f"source {b!r}", f"size {n}", f"lang {a!r} source {b!r}", f"source {b!r} size {n}")
            known[key] = sorted({zlib.crc32(x.encode("utf-8", "replace")) % METADATA for x in names})
        rows.append(known[key])
    return np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.array([x for r in rows for x in r], np.int64)


def _views(b: pa.RecordBatch):
    """Both views of the rows of a batch with text, lang, source and n_chars."""
    return content_view(b.column("text")), metadata_view(b.column("lang"), b.column("source"), b.column("n_chars"))


#: What the fit knows of a document: labels (1 good, 0 bad, -1 none) and pseudo-labels, each for one view as their taker.
MARKS = (*HEADS, *(f"{h}_{v}" for h in HEADS for v in range(2)))


def _featurise(batches):
    for b in batches:
        for at in range(0, len(b), 200):
            part = b.slice(at, 200)
            lists = []
            for text, feature in _views(part):
                first = np.searchsorted(text, np.arange(len(part) + 1))
                lists.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(feature.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([part.column("key"), *(part.column(m) for m in MARKS), *lists], names=["key", *MARKS, "content", "metadata"])


_FEATURES = "key long, " + ", ".join(f"{m} int" for m in MARKS) + ", content array<int>, metadata array<int>"


class Model:
    """Logistic regression with an L1 penalty over the rows of a view, by accelerated proximal gradient.

    Each weight has a step of its own, from a diagonal that majorises the
    curvature, so that rare words move as far as common ones.
    """

    def __init__(self, penalty: float, steps: int = 200):
        self.penalty, self.steps = penalty, steps

    def fit(self, view, rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Model:
        x = view.take(rows)
        weight = weight / weight.sum()
        w, bias = np.zeros(x.width), 0.0
        v, vb, t = w.copy(), bias, 1.0
        step, bias_step = (1 / (0.25 * c + 1e-9) for c in x.curvature(weight))
        for _ in range(self.steps):
            error = weight * (1 / (1 + np.exp(-np.clip(x.dot(v) + vb, -35, 35))) - target)
            new = v - step * x.back(error)
            new = np.sign(new) * np.maximum(np.abs(new) - step * self.penalty, 0)
            nb = vb - bias_step * error.sum()
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - bias)
            w, bias, t = new, nb, nt
        self.weight, self.bias = x.spread(w, view.width), bias
        return self

    def score(self, view) -> np.ndarray:
        return view.dot(self.weight) + self.bias


class Sparse:
    """Rows of present features."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n: int, width: int, columns: np.ndarray | None = None):
        self.row, self.column, self.n, self.width, self.columns = row, column, n, width, columns

    def dot(self, w):
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def back(self, e):
        return np.bincount(self.column, weights=e[self.row], minlength=self.width)

    def curvature(self, weight):
        size = np.bincount(self.row, minlength=self.n) + 1
        return self.back(weight * size), (weight * size).sum()

    def take(self, rows, least: int = 3):
        """Some rows, without features that fewer than `least` of them have."""
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        chosen = place[self.row] >= 0
        row, column = place[self.row[chosen]], self.column[chosen]
        columns = np.flatnonzero(np.bincount(column, minlength=self.width) >= least)
        to = np.full(self.width, -1)
        to[columns] = np.arange(len(columns))
        chosen = to[column] >= 0
        return Sparse(row[chosen], to[column[chosen]], len(rows), len(columns), columns)

    def spread(self, w, width):
        out = np.zeros(width)
        out[self.columns] = w
        return out


def platt(score: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """(a, b) with P = 1 / (1 + exp(-(a * score + b))), by Newton steps with smoothed targets."""
    good = target.sum()
    goal = np.where(target > 0, (good + 1) / (good + 2), 1 / (len(target) - good + 2))
    a, b = 1.0, 0.0
    x = np.stack((score, np.ones(len(score))), 1)
    for _ in range(100):  # with a weak pull to (1, 0), and steps of at most 1
        p = 1 / (1 + np.exp(-np.clip(x @ (a, b), -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (p - goal) + 0.1 * np.array([a - 1, b]))
        move /= max(1.0, float(np.abs(move).max()))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def fit_views(views: list, target: np.ndarray, fitting: np.ndarray, held: np.ndarray, given: list[np.ndarray], penalties, pseudo: float) -> dict:
    """Models of both views, fitted on labelled rows and each view's pseudo-labels (given, -1: none), and calibrated on held rows."""
    models = []
    for view, labels, penalty in zip(views, given, penalties, strict=True):
        extra = np.flatnonzero(labels >= 0)
        rows = np.concatenate((fitting, extra))
        goal = np.concatenate((target[fitting], labels[extra]))
        models.append(Model(penalty).fit(view, rows, goal, np.concatenate((np.ones(len(fitting)), np.full(len(extra), pseudo)))))
    scores = [m.score(v) for m, v in zip(models, views, strict=True)]
    lines = [platt(s[held], target[held]) for s in scores]
    both = sum(a * s[held] + b for (a, b), s in zip(lines, scores, strict=True))
    return {"models": [(m.weight.astype(np.float32), m.bias) for m in models], "lines": lines, "top": platt(both, target[held]), "prior": float(target[fitting].mean())}


def _fitted(seed: int, penalties: tuple, pseudo: float):
    """The rows of _featurise to one row with the pickled models, a pair for each label that has both classes."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("key")
        views = []
        for name, width in (("content", DIMENSIONS), ("metadata", METADATA)):
            lists = rows.column(name).combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            views.append(Sparse(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy().astype(np.int64), len(size), width))
        fold = kernel.mix(rows.column("key").to_numpy().view(np.uint64) + np.uint64(seed)) % np.uint64(5)
        heads = {}
        for name in HEADS:
            target = rows.column(name).to_numpy().astype(float)
            fitting, held = np.flatnonzero((target >= 0) & (fold > 0)), np.flatnonzero((target >= 0) & (fold == 0))
            if len(set(target[fitting])) == 2 and len(held):
                heads[name] = fit_views(views, target, fitting, held, [rows.column(f"{name}_{v}").to_numpy().astype(float) for v in range(2)], penalties, pseudo)
        return pa.table({"models": pa.array([pickle.dumps(heads)], pa.binary())})

    return run


def _kept_columns(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns that the views and the fit read; those that docs lacks are null."""
    def of(name, kind):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"), of("lang", "string"), of("source", "string"), of("n_chars", "long"))


def _raw_scores(rows: DataFrame, heads: dict) -> DataFrame:
    """(doc_id, key, a column a head and view) of every row: what each model alone says."""
    shared = rows.sparkSession.sparkContext.broadcast(heads)
    names = [f"{h}_{v}" for h in heads for v in range(2)]

    def run(batches):
        for whole in batches:
            for start in range(0, len(whole), 500):
                part = whole.slice(start, 500)
                views = _views(part)
                says = [pa.array(np.bincount(text, weights=w[feature], minlength=len(part)) + bias) for h in shared.value.values() for (text, feature), (w, bias) in zip(views, h["models"], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *says], names=["doc_id", "key", *names])

    return rows.mapInArrow(run, "doc_id long, key long, " + ", ".join(f"{n} double" for n in names))


def _surest(scores: DataFrame, heads: dict, most_pseudo: int) -> DataFrame:
    """Of all documents without a label, those that one view's model is surest of, as pseudo-labels for the other view: (key, MARKS)."""
    found = None
    for h, fitted in heads.items():
        for giver in range(2):
            says, taker = F.col(f"{h}_{giver}"), f"{h}_{1 - giver}"
            usual = math.log(fitted["prior"] / (1 - fitted["prior"]))  # a model that tells nothing says this of all documents
            for label, order, sure, share in ((1, says.desc(), says > max(1, usual + 1), fitted["prior"]), (0, says.asc(), says < min(-1, usual - 1), 1 - fitted["prior"])):
                some = scores.where(sure).orderBy(order, "key").limit(max(1, round(most_pseudo * share))).select("key", *(F.lit(label if m == taker else -1).alias(m) for m in MARKS))
                found = some if found is None else found.union(some)
    return found.groupBy("key").agg(*(F.max(m).alias(m) for m in MARKS))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", most_labelled: int = 6000, most_pseudo: int = 1000, rounds: int = 2, seed: int = 7, penalties: tuple = (4e-4, 4e-4), pseudo: float = 0.2) -> dict | None:
    """docs(doc_id, text, lang, source, n_chars), labels(doc_id, quality, toxic) to fitted pairs of models; None if no label has both classes."""
    spark = docs.sparkSession
    ready(spark)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("quality"), F.min((F.coalesce("toxic", F.lit(1)) == 0).cast("int")).alias("civil"))
    rows = _kept_columns(docs, text_col).withColumn("key", F.xxhash64("doc_id", "text", "lang", "source", "n_chars"))
    ids = rows.where("doc_id is not null").select("doc_id").distinct()
    none = [F.lit(-1).alias(m) for m in MARKS[2:]]
    chosen = keep(ids.join(said, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most_labelled))
    labelled = keep(rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["key"]).select("*", *none).mapInArrow(_featurise, _FEATURES))
    sample = labelled
    for turn in range(rounds + 1):
        models = sample.groupBy().applyInArrow(_fitted(seed, penalties, pseudo), "models binary").collect()
        heads = pickle.loads(models[0][0]) if models else {}
        if not heads or turn == rounds:
            break
        scores = keep(_raw_scores(rows.where("doc_id is not null"), heads).join(said, "doc_id", "left_anti"))  # the scores travel, not the texts
        surest = keep(_surest(scores, heads, most_pseudo))
        given = rows.join(F.broadcast(surest), "key").dropDuplicates(["key"])
        sample = labelled.unionByName(given.mapInArrow(_featurise, _FEATURES))
    return heads or None


def probability(heads: dict, views: tuple, n: int) -> np.ndarray:
    """P(good) of n texts in both views."""
    out = np.ones(n)
    for f in heads.values():
        (a0, b0), (a1, b1), (a, b) = *f["lines"], f["top"]
        alone = [np.bincount(text, weights=w[feature], minlength=n) + bias for (text, feature), (w, bias) in zip(views, f["models"], strict=True)]
        logit = a0 * alone[0] + b0 + a1 * alone[1] + b1
        out = np.minimum(out, 1 / (1 + np.exp(-np.clip(a * logit + b, -35, 35))))
    return np.round(out, 6)


def score(docs: DataFrame, fitted: dict, text_col: str = "text", name: str = "p_good") -> DataFrame:
    """docs with a column more: P(good).  Every column comes back."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    # positions, not names, pass through Python: names may clash
    carried = [f"c{i}" for i in range(len(names))]
    inner = docs.toDF(*carried)

    def of(column, kind):
        return (F.col(f"c{names.index(column)}") if column in names else F.lit(None)).cast(kind)

    rows = inner.select(*carried, of(text_col, "string").alias("text"), of("lang", "string").alias("lang"), of("source", "string").alias("source"), of("n_chars", "long").alias("n_chars"))

    def run(batches):
        for whole in batches:
            for start in range(0, len(whole), 500):
                part = whole.slice(start, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], pa.array(probability(shared.value, _views(part), len(part)))], names=[*carried, "p"])

    schema = ", ".join(f"{c} {inner.schema[c].dataType.simpleString()}" for c in carried) + ", p double"
    return rows.mapInArrow(run, schema).toDF(*names, name)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **how) -> DataFrame:
    """docs to (doc_id, p_good, kept) for every row."""
    rows = _kept_columns(docs, text_col)
    fitted = fit(rows, labels, **how)
    if fitted is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("p_good"), F.lit(True).alias("kept"))
    return score(rows, fitted).select("doc_id", "p_good", (F.col("p_good") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the columns of docs."""
    fitted = fit(docs, labels, text_col, **how)
    if fitted is None:
        return docs
    own = "p"
    while own in docs.columns:
        own += "_"
    scored = score(docs, fitted, text_col, own)
    return scored.where(F.col(own) >= threshold).drop(own)
