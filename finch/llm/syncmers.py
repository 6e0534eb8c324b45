"""Document fingerprints from closed syncmers, with DataFrame operations only.

A text is read as words, or, where it has fewer than ``SHORT`` characters or hardly any
spaces, as characters: then a text of some dozens of characters has several anchors too, and one
changed character in a long unspaced text leaves the others. Both depend on the text alone. Tokens are hashed; a k-mer of words is kept when the least of its s-mers stands
at its first or last place. That depends on the k-mer alone, so an edit changes
only the anchors whose k-mer it touches, and equal passages have equal anchors
wherever they stand. ``syncmers`` keeps the place of each anchor for positional
matching; a fingerprint is the distinct anchors in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..operators.ordering import dense_index
from .common import let

K, S = 8, 2
SHORT, LONG_WORD = 512, 16      # characters of a text, and on average of a word, that are read one by one


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens_of(text: Column) -> Column:
    """Words, or the characters of a short or unspaced text."""
    def chosen(words: Column) -> Column:
        spaced = (F.length(text) >= SHORT) & (F.size(words) * LONG_WORD >= F.length(text))
        return F.when(spaced | (F.size(words) == 0), words).otherwise(F.filter(F.split(text, ""), lambda c: c != ""))
    return let(words_of(text), chosen)


def _short(h: Column) -> Column:
    """The upper 32 bits of a 64-bit hash."""
    return F.shiftright(h, 32).cast("int")


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos int, hash int>>: the closed syncmers of a text by token
    position. A text of fewer than ``k`` tokens has one anchor, of all of them;
    a text without words has none."""
    inner = k - s + 1                       # s-mers of a k-mer

    def anchors(h: Column) -> Column:
        n = F.size(h)

        def chosen(m: Column) -> Column:
            def closed(i: Column) -> Column:
                inside = [m[i + j] for j in range(1, inner - 1)]
                return F.least(m[i], m[i + (inner - 1)]) <= (F.least(*inside) if len(inside) > 1 else inside[0])
            return F.transform(F.filter(F.sequence(F.lit(0), n - k), closed), lambda i: F.struct(
                i.alias("pos"), _short(F.xxhash64(*[h[i + j] for j in range(k)])).alias("hash")))

        mers = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[h[i + j] for j in range(s)]))
        whole = F.array(F.struct(F.lit(0).alias("pos"), _short(F.xxhash64(h)).alias("hash")))
        return F.when(n >= k, let(mers, chosen)).when(n > 0, whole).otherwise(F.filter(whole, lambda _: F.lit(False)))

    if inner < 3:
        raise ValueError("k - s must be at least 2")
    return let(F.transform(tokens_of(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w)), anchors)


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """array<int>: distinct anchors in text order."""
    return F.array_distinct(F.transform(syncmers(text, k, s), lambda a: a["hash"]))


def as_hex(fp: Column) -> Column:
    """Eight hex digits an anchor."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared share of all anchors of two fingerprints; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda x: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0))
               .otherwise(x / (F.size(a) + F.size(b) - x)))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (key, h, text, fp, next_key, next_prefix, next_fp).

    The next document is the one that follows in (id, text hash) order, null ids
    first; the first follows the last. Rows that repeat id and text are one
    document in that order and each get its result. Texts move once, by (id,
    hash); the next document sends only as many leading characters as a quarter
    of its predecessor, and its fingerprint.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    row = F.xxhash64("key", "h").alias("row")              # (row, h) stands for (key, text): never null, unlike key
    ids = base.select("key", row, "h", F.floor(F.length("text") / 4).cast("int").alias("need")).distinct()
    order = dense_index(ids, [F.col("key").asc_nulls_first(), "h"], "idx")
    n = F.lit(max(order.count(), 1)).cast("long")
    cur = order.select("idx", F.col("row").alias("cur_row"), F.col("h").alias("cur_h"), "need")
    links = cur.join(order.select(F.pmod(F.col("idx") - 1, n).alias("idx"), "row", "h"), "idx").drop("idx")
    # a running count, not row_number: a limit pushed below the shuffle would keep the two uses from sharing it
    turn = F.count(F.lit(1)).over(Window.partitionBy("row", "h").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    rows = base.select("key", row, "h", "text", fingerprint(F.col("text")).alias("fp"))
    ahead = rows.withColumn("turn", turn).where("turn = 1").join(links, ["row", "h"]).select(
        F.col("cur_row").alias("row"), F.col("cur_h").alias("h"), F.col("key").alias("next_key"),
        F.col("text").substr(F.lit(1), F.col("need")).alias("next_prefix"), F.col("fp").alias("next_fp"))
    return rows.join(ahead, ["row", "h"]).select("key", "h", "text", "fp", "next_key", "next_prefix", "next_fp")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter of
    its characters replaced by as many of the next document's first), with the
    likeness to the edited text's and the next document's fingerprint.

    A null text is empty. A table of one document follows itself. Other columns
    are not read.
    """
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 4).cast("int")), F.col("next_prefix"))
    pairs = neighbours(docs, id_col, text_col).withColumn("edited", edited)
    pairs = pairs.withColumn("edited_fp", fingerprint(F.col("edited")))
    return pairs.select(F.col("key").alias(id_col), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                        as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
                        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.size("fp").alias("n_anchors"),
                        F.col("next_key").alias(f"next_{id_col}"))
