"""Sentence boundaries learnt from the corpus, without labels.

Three likelihood ratios are taken over all texts by grouped aggregates: a word that
is followed by a period far more often than words are is an abbreviation (short words and words with inner
periods sooner than long ones, and the less so the more often it stands without); two
words that follow one another across a period more often than chance are a
collocation; a word that follows sentence ends more often than chance is a sentence
starter. A period after an abbreviation or within a collocation then ends no sentence,
unless a starter follows it. Word counts are taken of distinct tokens first, so a
frequent word is a few rows after the first aggregate.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import SENTENCE_CLOSERS, SENTENCE_END
from ..functions.text import SENTENCE_BLANKS, SENTENCE_GAP, _MARK
from ..session import scratch_path

ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0       # least scores, as published with the method
INITIAL = "^(\\p{L}|[0-9][0-9.,-]*)$"                       # what may open a collocation
LEAST_PAIRS = 2                                             # a pair seen once is no collocation
P_ABBREVIATION = 0.99                                       # share of an abbreviation's occurrences with a period
LITERALS = 20_000                                           # words that may stand in a plan; more are joined
OPENING, CLOSING = "\"'([{", "\"')]},;:!?"
BLANK_RUN = "[ \\t\\n\\r\\f\\x0B]+"


class Boundaries(NamedTuple):
    """What was learnt: (word), (word, next) and (word), stored tables."""
    abbreviations: DataFrame
    collocations: DataFrame
    starters: DataFrame


def word_of(token: Column) -> Column:
    """The token in lower case, without what opens or closes a quotation or clause."""
    return F.lower(F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING)))


def bare(word: Column) -> Column:
    """Without a period at its end."""
    return F.when(word.endswith("."), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def _x_log(x: Column, p: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(p))


def abbreviation_score(with_period: Column, without: Column, word: Column, p: Column) -> Column:
    """Likelihood ratio of "nearly always has a period" against the share ``p`` of all
    words, weighted by length, inner periods and occurrences without one."""
    ratio = 2 * (with_period * (F.log(F.lit(P_ABBREVIATION)) - F.log(p)) + without * (F.log(F.lit(1 - P_ABBREVIATION)) - F.log(1 - p)))
    inner = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    n = (F.length(word) - inner).cast("double")
    return ratio * F.exp(-n) * (inner + 1) * F.pow(n, -without)


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Likelihood ratio of b being as frequent after a as elsewhere."""
    p, p1, p2 = b / n, both / a, F.try_divide(b - both, n - a)
    rest = n - a - b + both
    even = _x_log(both, p) + _x_log(a - both, 1 - p) + _x_log(b - both, p) + _x_log(rest, 1 - p)
    apart = _x_log(both, p1) + _x_log(a - both, 1 - p1) + _x_log(b - both, p2) + _x_log(rest, 1 - p2)
    return -2 * (even - apart)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def learn_boundaries(docs: DataFrame, text_col: str = "text") -> Boundaries:
    """Learn from every text of ``docs``; null texts say nothing. A corpus without a
    period or without words has no abbreviations, collocations or starters."""
    tokens = F.filter(F.split(F.col(text_col), BLANK_RUN), lambda t: t != "")
    texts = docs.select(tokens.alias("t"))
    seen = texts.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    ends = F.filter(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.col("t")[i].rlike(f"{SENTENCE_END}{SENTENCE_CLOSERS}$"))
    after = texts.where(F.size("t") > 1).select(F.explode(F.transform(ends, lambda i: F.struct(
        F.col("t")[i].alias("a"), F.col("t")[i + 1].alias("b")))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("m"))

    word = word_of(F.col("token"))
    counts = seen.select(bare(word).alias("word"), word.endswith(".").alias("period"), "m").where(F.col("word").rlike("[\\p{L}\\p{N}]"))
    counts = _stored(counts.groupBy("word").agg(F.sum(F.when(F.col("period"), F.col("m")).otherwise(0)).alias("w"),
                                                F.sum(F.when(~F.col("period"), F.col("m")).otherwise(0)).alias("o")), "boundary-words")
    n, periods = counts.agg(F.sum(F.col("w") + F.col("o")), F.sum("w")).first()
    n, periods = n or 0, periods or 0
    if not 0 < periods < n:
        none = counts.select("word").limit(0)
        return Boundaries(none, none.select("word", F.col("word").alias("next")), none)
    share = F.lit(periods / n)
    score = abbreviation_score(F.col("w").cast("double"), F.col("o").cast("double"), F.col("word"), share)
    abbreviations = _stored(counts.where((F.col("w") > 0) & F.col("word").rlike("\\p{L}")).where(score >= ABBREVIATION).select("word"), "boundary-abbreviations")

    first, second = word_of(F.col("a")), bare(word_of(F.col("b")))
    pairs = after.select(first.endswith(".").alias("period"), bare(first).alias("word"), second.alias("next"), "m").where(
        F.col("next").rlike("[\\p{L}\\p{N}]"))
    pairs = _stored(pairs.groupBy("period", "word", "next").agg(F.sum("m").alias("m")), "boundary-pairs")
    size = counts.select("word", (F.col("w") + F.col("o")).alias("c"))
    size_next = size.select(F.col("word").alias("next"), F.col("c").alias("c_next"))
    total = F.lit(float(n))

    def over(a: Column, b: Column, both: Column, least: float) -> Column:
        return (both * total > a * b) & (association(a.cast("double"), b.cast("double"), both.cast("double"), total) >= least)
    inner = pairs.where(F.col("period") & (F.col("m") >= LEAST_PAIRS) & F.col("word").rlike(INITIAL)).join(size, "word").join(size_next, "next")
    collocations = _stored(inner.where(over(F.col("c"), F.col("c_next"), F.col("m"), COLLOCATION)).select("word", "next"), "boundary-collocations")

    broken = pairs.join(abbreviations.withColumn("abbreviated", F.lit(True)), "word", "left").where(~F.col("period") | F.col("abbreviated").isNull())
    starts = broken.groupBy("next").agg(F.sum("m").alias("m"))
    breaks = starts.agg(F.sum("m")).first()[0] or 0
    starters = starts.join(size_next, "next").where(over(F.lit(breaks), F.col("c_next"), F.col("m"), STARTER)).select(F.col("next").alias("word"))
    return Boundaries(abbreviations, collocations, _stored(starters, "boundary-starters"))


def _pieces(text: Column) -> Column:
    """The text cut behind every place where the rule splitter would cut, nothing lost."""
    return F.split(F.regexp_replace(text, f"({SENTENCE_END}{SENTENCE_CLOSERS})({SENTENCE_GAP})", "$1$2" + _MARK), _MARK)


def _last(piece: Column) -> Column:
    return word_of(F.element_at(F.split(F.btrim(piece, F.lit(SENTENCE_BLANKS)), BLANK_RUN), -1))


def _first(piece: Column) -> Column:
    return bare(word_of(F.get(F.split(F.ltrim(piece, F.lit(SENTENCE_BLANKS)), BLANK_RUN, 2), F.lit(0))))


def chunk_sentences_learnt(docs: DataFrame, doc_col: str, text_col: str, learnt: Boundaries | None = None,
                           literals: int = LITERALS) -> DataFrame:
    """Sentence chunks (doc, pos, text) by the rule splitter, less the boundaries
    that ``learnt`` (by default learnt from ``docs``) takes back.

    A few learnt words stand in the plan as a hash set, and no text moves. More than ``literals`` are
    joined to the boundaries instead, and the pieces of a document meet again by a key
    of their row. A marker character in a text counts as a cut there; a null text has no chunks.
    """
    learnt = learnt or learn_boundaries(docs, text_col)
    tables = [t.limit(literals + 1).collect() for t in learnt]
    if sum(map(len, tables)) > literals:
        return _by_join(docs, doc_col, text_col, learnt)
    abbreviations, starters = ([r["word"] for r in t] for t in (tables[0], tables[2]))
    collocations = [f"{r['word']} {r['next']}" for r in tables[1]]

    def within(value: Column, words: list[str]) -> Column:
        return value.isin(words) if words else F.lit(False)

    def real(before: Column, behind: Column) -> Column:
        def judged(pair: Column) -> Column:
            last, following = pair["last"], pair["next"]
            held = within(bare(last), abbreviations) | within(F.concat(bare(last), F.lit(" "), following), collocations)
            return ~last.endswith(".") | ~held | within(following, starters)
        return F.transform(F.array(F.struct(_last(before).alias("last"), _first(behind).alias("next"))), judged)[0]

    def joined(p: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.when(i == 0, F.lit(True)).otherwise(real(p[F.greatest(i - 1, F.lit(0))], p[i])))
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: F.btrim(F.array_join(
            F.slice(p, i + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - i), ""), F.lit(SENTENCE_BLANKS))))[0]
    sentences = F.filter(F.transform(F.array(_pieces(F.col(text_col))), joined)[0], lambda s: s != "")
    return docs.where(F.col(text_col).isNotNull()).select(F.col(doc_col), F.posexplode(sentences).alias("pos", "text"))


def _by_join(docs: DataFrame, doc_col: str, text_col: str, learnt: Boundaries) -> DataFrame:
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(doc_col).alias("doc"), F.monotonically_increasing_id().alias("row"), _pieces(F.col(text_col)).alias("p"))
    each = F.transform("p", lambda x, i: F.struct(x.alias("piece"), F.when(i > 0, _last(F.col("p")[F.greatest(i - 1, F.lit(0))])).alias("last"), _first(x).alias("next")))
    pieces = _stored(rows.select("doc", "row", F.posexplode(each).alias("i", "x")).select("doc", "row", "i", "x.*"), "boundary-pieces")
    pieces = pieces.withColumn("word", bare(F.col("last")))
    for table, key, name in ((learnt.abbreviations, ["word"], "abbreviated"), (learnt.collocations, ["word", "next"], "paired"),
                             (learnt.starters.withColumnRenamed("word", "next"), ["next"], "starts")):
        pieces = pieces.join(table.withColumn(name, F.lit(True)), key, "left")
    held = F.coalesce(F.col("last").endswith(".") & (F.col("abbreviated") | F.col("paired")) & F.col("starts").isNull(), F.lit(False))
    number = F.sum((~held).cast("int")).over(Window.partitionBy("row").orderBy("i"))        # pieces of one text
    merged = pieces.withColumn("s", number).groupBy("row", "s").agg(F.first("doc").alias("doc"), F.btrim(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), ""), F.lit(SENTENCE_BLANKS)).alias("text")).where("text <> ''")
    pos = F.row_number().over(Window.partitionBy("row").orderBy("s")) - 1
    return merged.select(F.col("doc").alias(doc_col), pos.alias("pos"), "text")
