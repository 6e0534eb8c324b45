"""Line dedup with a log-template tree, with DataFrame operations only.

The tree has a fixed depth: a line goes down by its number of tokens, then by
its first ``depth`` tokens (tokens that hold a digit count as a wildcard). In a
leaf, a token's support is the number of distinct lines that have it at that
place. A line of the template must share ``similarity`` of its places with others,
so the support of its least common token among the commonest so many stands for
the template's size; tokens with at least ``SHARE`` of that (and two lines) stay
fixed, the other places are variable fields. Supports grow together with the
corpus, so a field whose values recur stays a field on any size, and small
templates count by their own size in a leaf of many. A line with at least
``similarity`` fixed places takes that pattern as its template, any other line
is its own template.

A template recurs when its lines are found in at least two documents and, unless
they have ``long_line`` tokens or more, at least ``min_lines`` times (a document
counts once for each distinct line). All documents but the first that has it, in (id, text hash) order, lose its lines,
so no content leaves the corpus altogether.

Scale: lines travel as hashes; equal lines are counted map-side, so a line that
is in a third of all documents is one row after the first step. Only the lines
of leaves with several distinct lines are spelt out, one per distinct line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import hash_pair, hot_split_join, let, written

DEPTH, SIMILARITY, MIN_LINES = 3, 0.7, 3
LONG_LINE = 20                  # tokens of a line that two documents do not share by chance
SHARE = 0.5                     # of its template's size, for a token to stay fixed
WILDCARD = "<*>"
LEAF_CLASSES = 1 << 20
HOT = 100                       # lines joined by broadcast, however many documents have them


def masked_lines(text: Column) -> Column:
    """array<string>: the lines of a text, each with its tokens one space apart and those
    with a digit as wildcards. The text is rewritten as a whole, and only where it has something to rewrite."""
    def spaced(t: Column) -> Column:
        odd = t.rlike("[\\t\\x0B\\f\\r]") | t.startswith(" ") | t.endswith(" ")
        for pair in ("  ", " \n", "\n "):
            odd = odd | t.contains(pair)
        return F.when(odd, F.btrim(F.regexp_replace(F.regexp_replace(t, "[ \\t\\x0B\\f\\r]+", " "), " ?\\n ?", "\n"), F.lit(" "))).otherwise(t)

    def without_digits(t: Column) -> Column:
        return F.when(t.rlike("[0-9]"), F.regexp_replace(t, r"[^\s0-9]*+[0-9]\S*+", WILDCARD)).otherwise(t)
    return F.split(without_digits(spaced(text)), "\n")


def _described(lines: DataFrame, depth: int) -> DataFrame:
    """``lines`` (line) with l1, l2 (128 bits that identify a masked line), its number of tokens n and its leaf."""
    l1, l2 = hash_pair("line")
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.where("line <> ''").withColumn("l1", l1).withColumn("l2", l2).withColumn("n", n).withColumn(
        "leaf", F.xxhash64("n", F.substring_index("line", " ", depth)))


def _lines(rows: DataFrame, depth: int) -> DataFrame:
    """(key, h, line, l1, l2, n, leaf): the distinct masked lines of each document."""
    each = rows.select("key", "h", F.explode(F.array_distinct(masked_lines(F.col("text")))).alias("line"))
    return _described(each, depth)


def _generalised(lines: DataFrame, distinct: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(l1, l2, t1, t2): lines that have a template with variable fields.

    A broadcast of the leaves' hash classes (at most LEAF_CLASSES numbers) passes over
    the stored lines of other leaves before anything is shuffled. A leaf's hash covers its token count.
    """
    leaves = distinct.where(F.col("n") > depth).groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    in_class = F.pmod(F.col("leaf"), F.lit(LEAF_CLASSES)).cast("int")
    classes = F.broadcast(leaves.select(in_class.alias("class")).distinct())
    spelt = (lines.where(F.col("n") > depth).select("l1", "l2", "n", "leaf", "line")
             .withColumn("class", in_class).join(classes, "class", "left_semi")
             .groupBy("l1", "l2").agg(F.first("n").alias("n"), F.first("leaf").alias("leaf"), F.first("line").alias("line"))
             .join(leaves.select("leaf", "n"), ["leaf", "n"]))
    places = spelt.select("l1", "l2", "n", "leaf", F.posexplode(F.split("line", " ")).alias("pos", "token")).where(F.col("pos") >= depth)
    places = written(places.select("l1", "l2", "n", "leaf", "pos", F.xxhash64("pos", "token").alias("token")), "line-places")
    shared = places.groupBy("leaf", "token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    marks = places.join(shared, ["leaf", "token"], "left")
    each = marks.groupBy("l1", "l2").agg(F.first("n").alias("n"), F.first("leaf").alias("leaf"),
                                         F.collect_list(F.struct(F.coalesce("m", F.lit(1)).alias("m"), "pos", "token")).alias("all"))
    needed = F.greatest(F.ceil(F.lit(similarity) * F.col("n")).cast("int") - depth, F.lit(1))
    level = F.sort_array(F.transform("all", lambda x: x["m"]), asc=False)[F.least(needed, F.size("all")) - 1]
    fixed = let(level, lambda least: F.filter("all", lambda x: (x["m"] > 1) & (x["m"] >= F.lit(SHARE) * least)))

    def template(fixed: Column) -> Column:
        u, v = hash_pair("leaf", "n", fixed)
        return F.struct(u.alias("t1"), v.alias("t2"), (F.size(fixed) + depth).alias("fixed"))
    one = F.transform(F.array(F.sort_array(F.transform(fixed, lambda x: F.struct(x["pos"], x["token"])))), template)
    # exploded rather than filtered as a column, which would evaluate it twice
    fits = F.filter(one, lambda t: (t["fixed"] >= F.lit(similarity) * F.col("n")) & (t["fixed"] < F.col("n")))
    return each.select("l1", "l2", F.explode(fits).alias("t")).select("l1", "l2", "t.t1", "t.t2")


def recurring_lines(rows: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY,
                    min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """(key, h, l1, l2, generalised): the lines that documents lose, one row for each
    distinct line of a document whose template recurs and which is not the first to have it.

    A document is told by a hash of (key, h) while templates are counted, so that
    the sums stay in hash tables; only the lines of recurring templates are asked
    for the first document.
    """
    lines = written(_lines(rows, depth), "lines")
    who = F.xxhash64("key", "h")
    distinct = lines.groupBy("l1", "l2").agg(F.first("n").alias("n"), F.first("leaf").alias("leaf"), F.count(F.lit(1)).alias("m"),
                                             F.min(who).alias("least"), F.max(who).alias("most"))
    distinct = written(distinct, "distinct-lines")
    general = written(_generalised(lines, distinct, depth, similarity), "line-templates")
    recurs = ((F.col("m") >= min_lines) | (F.col("n") >= long_line)) & (F.col("least") != F.col("most"))
    some = distinct.join(general, ["l1", "l2"])
    kept = some.groupBy("t1", "t2").agg(F.first("n").alias("n"), F.sum("m").alias("m"), F.min("least").alias("least"), F.max("most").alias("most")).where(recurs)
    wide = general.join(kept.select("t1", "t2"), ["t1", "t2"]).select("l1", "l2", "t1", "t2", F.lit(True).alias("generalised"))
    plain = (distinct.where(recurs).join(general, ["l1", "l2"], "left_anti")
             .select("l1", "l2", F.col("l1").alias("t1"), F.col("l2").alias("t2"), F.lit(False).alias("generalised")))
    recurring = written(plain.unionByName(wide), "recurring-lines")
    hot = [(r["l1"], r["l2"]) for r in distinct.join(recurring, ["l1", "l2"], "left_semi").orderBy(F.desc("m")).limit(HOT).collect()]
    hit = written(hot_split_join(lines.select("key", "h", "l1", "l2"), recurring, ["l1", "l2"], hot=hot), "recurring-hits")
    first = written(hit.groupBy("t1", "t2").agg(F.min(F.struct("key", "h")).alias("first")), "recurring-first")
    lost = hot_split_join(hit, first, ["t1", "t2"])
    return lost.where(~(F.col("key").eqNullSafe(F.col("first.key")) & (F.col("h") == F.col("first.h")))).select("key", "h", "l1", "l2", "generalised")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                         similarity: float = SIMILARITY, min_lines: int = MIN_LINES, stats: bool = True,
                         drop_emptied: bool = False, long_line: int = LONG_LINE) -> DataFrame:
    """``docs`` with ``text_col`` less the lines it loses, plus ``n_lines``,
    ``n_dropped`` and ``n_generalised`` (with ``stats``; columns of these names are
    replaced then). ``drop_emptied``: rows that lost all lines but blank ones go.

    Lines end at ``\\n``; blank lines never recur and stay. A null text stays
    null, with no lines. Rows that repeat id and text are one document and get the
    same result, though each adds to a template's count. The first of documents
    with null ids comes before any other.
    """
    new = ("n_lines", "n_dropped", "n_generalised")
    columns = [c for c in docs.columns if not stats or c not in new]
    text = F.col(f"row.`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    rows = rows.select(F.col(f"row.`{id_col}`").alias("key"), F.xxhash64(text).alias("h"), "row")
    hit = recurring_lines(rows.select("key", "h", text.alias("text")), depth, similarity, min_lines, long_line)
    lost = hit.groupBy("key", "h").agg(
        F.collect_set(F.struct("l1", "l2")).alias("gone"),
        F.collect_set(F.when(F.col("generalised"), F.struct("l1", "l2"))).alias("wide")).withColumnsRenamed({"key": "k", "h": "g"})
    joined = rows.join(lost, rows["key"].eqNullSafe(lost["k"]) & (rows["h"] == lost["g"]), "left")
    none = F.col("gone").isNull()
    n = F.coalesce(F.size(F.split(text, "\n")), F.lit(0))

    def divided(ids: Column) -> Column:
        return F.struct(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col("gone"), ids[i])).alias("stay"),
                        F.size(F.filter(ids, lambda x: F.array_contains(F.col("wide"), x))).alias("wide"))
    ids = F.transform(masked_lines(text), lambda x: F.struct(*[h.alias(c) for h, c in zip(hash_pair(x), ("l1", "l2"))]))
    cut = F.when(~none, let(ids, divided))
    out = joined.select("row", none.alias("whole"), n.alias("n"), cut.alias("cut")).select("row", "whole", "n", "cut.stay", "cut.wide")
    if drop_emptied:
        out = out.where(F.col("whole") | F.exists("stay", lambda x: F.trim(x) != ""))
    kept = F.when(F.col("whole"), text).otherwise(F.array_join("stay", "\n"))
    counts = [F.col("n").alias("n_lines"), F.when(F.col("whole"), 0).otherwise(F.col("n") - F.size("stay")).alias("n_dropped"),
              F.coalesce("wide", F.lit(0)).alias("n_generalised")] if stats else []
    return out.select(*[kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns], *counts)
