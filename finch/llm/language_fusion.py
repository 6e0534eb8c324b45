"""Language identification by Bayesian evidence fusion.

Four sources speak for a page's language: its text (hashed byte trigrams, one
multinomial model per language), the language its markup declares, the suffix
of its address, and the other pages of its host. Text models are counted over all
labelled documents. How far a declaration or a suffix can be believed is counted
over all pages, by grouped aggregates of what their texts say. The prior of a host
is its pages' mean belief, smoothed towards its domain, which is smoothed towards
its suffix, which is smoothed towards all pages; a page's own text is left out of
its prior. The log evidences add up.

The text's log-likelihood is scaled to that of ``EFFECTIVE`` independent trigrams
at most, as overlapping trigrams repeat each other; shorter texts weigh less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import broadcast_if_small
from .bloom_cascade import host_and_path
from .common import hot_split_join, slices, written

BUCKETS = 1 << 16
EFFECTIVE = 30.0
HOST_WEIGHT, DOMAIN_WEIGHT, SUFFIX_WEIGHT = 4.0, 8.0, 16.0      # pages that a level's parent counts for
MARKUP = r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;"
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def trigrams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the lower-case texts in a row (texts are
    set off by a space on either side), and the trigrams of each."""
    coded = [f" {t.lower()} ".encode("utf-8", "surrogatepass") if t and t.strip() else b"" for t in texts]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    x = np.frombuffer(b"".join(coded) + b"  ", np.uint8).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    keep = np.ones(len(h), bool)
    ends = np.cumsum(sizes)[sizes > 0]
    keep[ends - 1] = keep[ends - 2] = False
    return (h >> np.uint32(16)).astype(np.int32)[keep], np.maximum(sizes - 2, 0)


def fit_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log P(bucket | language), log P(language)) from all rows with a
    text and a language. The languages of the labels must be few (at most 500)."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.lower(F.col(lang_col).cast("string")).alias("lang")).where(
        "text is not null and lang is not null")
    seen = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(501).collect()
    if len(seen) > 500:
        raise ValueError("more than 500 languages")
    langs = [r["lang"] for r in seen]

    def count(batches):
        table = np.zeros((len(langs), BUCKETS), np.int64)
        for frame in batches:
            texts, lang = frame["text"].tolist(), frame["lang"].map(langs.index).to_numpy(int)
            for a, b in slices(texts):
                found, sizes = trigrams(texts[a:b])
                of = np.repeat(lang[a:b], sizes)
                for k in np.unique(lang[a:b]):
                    table[k] += np.bincount(found[of == k], minlength=BUCKETS)
        k, at = np.nonzero(table)
        yield pd.DataFrame({"k": k.astype(np.int32), "bucket": at.astype(np.int32), "n": table[k, at]})

    got = rows.mapInPandas(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(langs), BUCKETS), 0.1)
    table[got["k"], got["bucket"]] += got["n"]
    n = np.array([r["n"] for r in seen], float)
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table, np.log(n / n.sum()) if langs else n


def text_evidence(spark, model: np.ndarray):
    """A column function: text -> array<double>, a log-likelihood for each language."""
    shared = spark.sparkContext.broadcast(model.T.astype(np.float32))       # languages x BUCKETS

    @F.pandas_udf("array<double>")
    def weigh(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for chunk in chunks:
            texts, out = chunk.tolist(), []
            for a, b in slices(texts):
                found, sizes = trigrams(texts[a:b])
                upto = np.concatenate([np.zeros((1, shared.value.shape[1])), np.cumsum(shared.value[found], 0, dtype=np.float64)])
                ends = np.cumsum(sizes)
                total = upto[ends] - upto[ends - sizes]
                out += list(total * (np.minimum(sizes, EFFECTIVE) / np.maximum(sizes, 1))[:, None])
            yield pd.Series(out)

    return weigh


def _normal(logs: Column) -> Column:
    """Probabilities from log weights."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], n: int, name: str, of: str = "belief") -> DataFrame:
    """Sums of the vectors ``of`` by key, as one array column."""
    got = rows.groupBy(*keys).agg(*[F.sum(F.col(of)[k]).alias(f"_s{k}") for k in range(n)])
    return got.select(*keys, F.array(*[f"_s{k}" for k in range(n)]).alias(name))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, host, suffix, declared, text_lang, lang, confidence) of every page.

    ``docs`` carries the labelled texts. A null page or address has no evidence of
    its kind: without any, the prior decides. Ties go to the language that comes
    first in the alphabet. Without labelled texts ``lang`` is null.
    """
    spark = pages.sparkSession
    langs, model, prior = fit_text(docs, text_col, lang_col)
    n = len(langs)
    host, _ = host_and_path(F.col(url_col).cast("string"))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    labels = F.split("host", r"\.")
    declared = F.lower(F.regexp_extract(html, DECLARED, 1))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), declared.alias("declared"), html.alias("html"))
    rows = rows.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    if not n:
        none = F.lit(None).cast("string")
        return rows.select(F.col("id").alias(id_col), "host", "suffix", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("confidence"))
    weigh = text_evidence(spark, model)
    said = rows.withColumn("said", weigh(F.regexp_replace("html", MARKUP, " "))).drop("html")
    base = F.array(*[F.lit(float(x)) for x in prior])
    said = said.withColumn("belief", _normal(F.zip_with("said", base, lambda a, b: a + b)))
    said = written(said, "language-evidence")

    everywhere = _sums(said, [], n, "s").first()["s"] or [0.0] * n
    total = sum(x or 0.0 for x in everywhere) or 1.0
    world = [((x or 0.0) + 1.0) / (total + n) for x in everywhere]
    flat = F.array(*[F.lit(x) for x in world])

    def smooth(sums: Column, parent: Column, weight: float) -> Column:
        held = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(sums, parent, lambda a, p: (F.greatest(a, F.lit(0.0)) + weight * p) / (F.greatest(held, F.lit(0.0)) + weight))

    # sums of each level come from those of the level below it, so pages are summed once and joined once by host
    by_host = written(_sums(said, ["host", "domain", "suffix"], n, "o"), "language-hosts")
    by_domain = written(_sums(by_host, ["domain", "suffix"], n, "m", "o"), "language-domains")
    by_suffix = written(_sums(by_domain, ["suffix"], n, "u", "m"), "language-suffixes")
    by_domain = written(hot_split_join(by_domain, by_suffix, ["suffix"]).drop("suffix"), "language-domains")
    by_host = written(hot_split_join(by_host, by_domain, ["domain"]).drop("domain", "suffix"), "language-hosts")
    # what declarations say, believed as far as texts bear them out: P(value | language); two or three letters, so few
    by_declared = broadcast_if_small(written(_sums(said, ["declared"], n, "d"), "language-declared"))
    full = hot_split_join(said, by_host, ["host"]).join(by_declared, "declared")
    own = F.col("belief")
    less = lambda sums: F.zip_with(sums, own, lambda a, b: a - b)  # noqa: E731  without the page itself
    suffix_prior = smooth(less(F.col("u")), flat, SUFFIX_WEIGHT)
    full = full.withColumn("p0", suffix_prior)
    full = full.withColumn("p1", smooth(less(F.col("m")), F.col("p0"), DOMAIN_WEIGHT))
    full = full.withColumn("p2", smooth(less(F.col("o")), F.col("p1"), HOST_WEIGHT))
    # P(declared | language) over P(declared): the share of the language among the pages that declare it, against all
    claim = F.when(F.col("declared") == "", F.transform(flat, lambda _: F.lit(1.0))).otherwise(
        F.zip_with(smooth(less(F.col("d")), flat, 1.0), flat, lambda a, p: a / p))
    logs = F.zip_with(F.zip_with("said", "p2", lambda s, p: s + F.log(p)), claim, lambda s, c: s + F.log(c))
    full = full.withColumn("p", _normal(logs))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: names[(F.array_position(c, F.array_max(c)) - 1).cast("int")]
    return full.select(F.col("id").alias(id_col), "host", "suffix", "declared", best(F.col("belief")).alias("text_lang"),
                       best(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"))
