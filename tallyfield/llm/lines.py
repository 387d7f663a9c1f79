r"""Line dedup by a log-template tree of fixed depth.

Every line descends a tree: its token count, then its first `depth` tokens,
where a token with a digit counts as the variable field ``<*>``.  At a leaf,
digit fields are already general; any other position at which the leaf holds
`min_texts` or more different tokens, or more than `max_children`, is general
too, unless that leaves a line with fewer than `min_constant` of its tokens as
constants (a leaf of prose generalises nothing).  What remains is the line's
template.

A template that `min_texts` or more different texts hold is recurring.  Its
lines are dropped from all documents but the one with the smallest id among
those that hold it, so one copy of everything stays in the corpus.  Copies of a
whole text count as one text.

Only DataFrame functions.  Leaves with too few lines for a position to be general
never reach the per-position count.  Hot lines are counted with
map-side partial sums, and meet their documents in a join that Spark can split.

Behaviour: null and empty texts have no lines and come back as they are; blank
lines are never dropped; rows without an id lose their recurring lines unless
no row with an id holds them; repeated ids count as one document; a document may
end up empty; an empty table gives no rows; all columns of docs come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import keep, ready, unused

FIELD = "<*>"


#: Leaves, or texts, that are sent to every task instead of being joined; 8 bytes each.
BROADCAST_LEAVES = 500_000


def masked(line: Column) -> Column:
    """A line with single spaces between its tokens and digit fields masked.  Lines that need neither are only trimmed."""
    spaced = F.regexp_replace(line, r"[\t\r\x0B\f ]+", " ")
    return F.when(F.rlike(line, F.lit(r"[0-9\t\r\x0B\f]|  ")), F.regexp_replace(F.trim(spaced), r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(F.trim(line))


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """A row a line that isn't blank: doc, version (a hash of the text), place, line (masked), n (tokens), path and exact (hashes of its way down the tree, and of all of it)."""
    source = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("version"), F.posexplode(F.split(text_col, "\n", -1)).alias("place", "raw"))
    rows = source.select("doc", "version", "place", masked(F.col("raw")).alias("line")).where("line <> ''")
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return rows.withColumn("n", n).withColumn("path", F.xxhash64("n", F.substring_index("line", " ", depth))).withColumn("exact", F.xxhash64("line"))


def general_templates(docs: DataFrame, held: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, max_children: int = 24, min_constant: float = 0.6, min_texts: int = 8) -> DataFrame:
    """(exact, merged): the lines whose leaf generalises more than digit fields, with the hash of their template.

    held has the hashes of lines; the lines themselves are read only where a leaf is full,
    and of the texts that have a line only one is split again.
    """
    most = min(max_children, max(2, min_texts) - 1)  # a template of min_texts texts recurs, so a field needs no more tokens than that
    kinds = keep(held.where(F.col("n") > depth).groupBy("path", "exact").agg(F.min("version").alias("version")))
    full = keep(kinds.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > most).select("path"))
    small = full.count() <= BROADCAST_LEAVES
    kinds = kinds.join(F.broadcast(full) if small else full, "path", "left_semi")
    texts = keep(kinds.select(F.col("version").alias("_version")).distinct())
    if texts.count() <= BROADCAST_LEAVES:
        docs = docs.join(F.broadcast(texts), F.xxhash64(text_col) == F.col("_version"), "left_semi")
    inside = _lines(docs, id_col, text_col, depth).where(F.col("n") > depth)
    inside = inside.join(F.broadcast(full) if small else full, "path", "left_semi")
    forms = keep(inside.groupBy("path", "exact").agg(F.max("line").alias("line")).select("path", "exact", F.split("line", " ", -1).alias("tokens")))
    places = forms.select("path", F.posexplode("tokens").alias("pos", "token")).where(F.col("token") != FIELD)
    kinds = places.groupBy("path", "pos", F.xxhash64("token").alias("token")).agg(F.lit(1).alias("one")).groupBy("path", "pos").agg(F.count("*").alias("n"))
    general = kinds.where(F.col("n") > most).groupBy("path").agg(F.collect_set("pos").alias("open"))
    opened = F.transform("tokens", lambda t, i: F.when(F.array_contains("open", i), FIELD).otherwise(t))
    merged = forms.join(general, "path").select("exact", "tokens", opened.alias("opened")).where(F.size(F.filter("opened", lambda t: t != FIELD)) >= min_constant * F.size("tokens"))
    return merged.select("exact", F.xxhash64(F.array_join("opened", " ")).alias("merged")).dropDuplicates(["exact"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_texts: int = 8, depth: int = 3, lines_col: str = "n_lines", dropped_col: str = "n_dropped", **leaf) -> DataFrame:
    """docs with recurring lines taken out of text_col, and the counts lines_col and dropped_col (each unless docs has such a column)."""
    ready(docs.sparkSession)
    names = docs.columns
    held = keep(_lines(docs, id_col, text_col, depth).select("doc", "version", "place", "n", "path", "exact"))
    merged = keep(general_templates(docs, held, id_col, text_col, depth, min_texts=min_texts, **leaf))
    held = held.join(merged, "exact", "left").select("doc", "version", "place", F.coalesce("merged", "exact").alias("template"))
    texts = held.groupBy("template", "version").agg(F.min("doc").alias("first")).groupBy("template").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    recurring = keep(texts.where(F.col("texts") >= min_texts).select("template", "first"))  # apart, so that the join below can split hot templates
    dropped = held.join(recurring, "template").where(~F.col("doc").eqNullSafe(F.col("first")))
    # rows are told apart by id and text, so that repeated ids with other texts keep their own lines
    none = F.lit(-(1 << 62))
    doc, version, gone = (unused(c, docs) for c in ("doc", "version", "gone"))
    out = keep(dropped.groupBy(F.coalesce("doc", none).alias(doc), F.col("version").alias(version)).agg(F.collect_set("place").alias(gone)))
    rows = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), none)).withColumn(version, F.xxhash64(text_col)).join(out, [doc, version], "left")
    pieces = F.split(text_col, "\n", -1)
    # one pass over the lines, however many go: the places that stay, then their lines
    stay = F.transform(F.array(pieces), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(gone)), lambda i: F.get(p, i)), "\n"))
    columns = [F.when(F.col(gone).isNull(), F.col(c)).otherwise(stay[0]).alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    more = {lines_col: F.when(F.length(text_col) > 0, F.size(pieces)).otherwise(0), dropped_col: F.coalesce(F.size(gone), F.lit(0))}
    return rows.select(*columns, *(c.alias(n) for n, c in more.items() if n not in names))
