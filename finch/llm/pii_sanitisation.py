"""Personal data by patterns, and the terms that give it away by information theory.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected
entities. The corpus then tells which other terms stand for them. With ``p(c)`` the share
of the corpus' terms that stand within ``WINDOW`` terms of a mention of entity c, and
``p(c | t)`` that share among the occurrences of term t, t discloses

    PMI(c; t) / IC(c) = log2(p(c | t) / p(c)) / -log2 p(c)

of what there is to know about c: 0 when they are independent, 1 when t is never
seen without c. A term over the threshold, with support from several different
contexts (copies of one are one), is sanitised wherever it stands: generalised to its
first letters, or its digits masked, if that form stays below the threshold
for all entities that the term discloses, else removed.

One pass over the texts yields term counts, summed per task, and a row for each
term near a mention, at most ``2 * WINDOW`` a mention, so no pairs within a group
arise. The disclosing terms go back to the texts as a broadcast only when they are
small; otherwise texts and terms are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import bytes_at_most
from .common import hash_pair, hot_split_join, written

KINDS = ("email", "ip", "card", "phone")
WINDOW = 16                     # terms on either side of a mention
DISCLOSURE, SUPPORT = 0.95, 2        # two contexts: what stands near a mention once tells nothing
FLUSH_TERMS = 200_000           # distinct terms that a task counts before it passes them on
BROADCAST_BYTES = 16 << 20
TERM = re.compile(r"[^\W_]+")

# A digit run that a match of four parts could begin in begins it: the look-behind only saves attempts.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        x = int(d) * (1 + place % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match ends in a domain and begins at the first character of its local part
    that the last match has left; so looking back from each ``@`` finds the leftmost matches in linear time."""
    free = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the matches of the four patterns, in order."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = "".join(DIGITS.findall(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """The same address or number, however it is written."""
    start, kind, end = span
    value = text[start:end]
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else ''.join(DIGITS.findall(value))}"


def _outside(text: str, spans: list) -> list[tuple[int, int, str]]:
    """(start, end, lower-case term) of the terms that touch no base span."""
    out, k, reach = [], 0, 0
    for m in TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if m.start() >= reach:
            out.append((m.start(), m.end(), m.group().lower()))
    return out


def _evidence(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def flush():
            low: Counter = Counter()
            for term, n in counts.items():
                low[term.lower()] += n
            counts.clear()
            return pd.DataFrame({"term": pd.Series(list(low), dtype=object), "entity": pd.Series([None] * len(low), dtype=object),
                                 "context": 0, "n": list(low.values())})

        for frame in batches:
            near = []
            for text in frame["text"]:
                spans = base_spans(text)
                if not spans:
                    counts.update(TERM.findall(text))
                else:
                    terms = _outside(text, spans)
                    counts.update(t for _, _, t in terms)
                    near += _near(text, spans, terms, window)
                if len(counts) >= FLUSH_TERMS:
                    yield flush()
            if near:
                yield pd.DataFrame(near, columns=["term", "entity", "context", "n"])
        if counts:
            yield flush()
    return run


def _near(text: str, spans: list, terms: list, window: int) -> list[tuple[str, str, int, int]]:
    """(term, entity, context, n) for the terms within ``window`` of a mention; a
    term near several mentions of an entity counts for the first."""
    taken: dict[str, int] = {}
    out, at = [], 0
    for span in spans:
        while at < len(terms) and terms[at][0] < span[0]:
            at += 1
        name = entity(text, span)
        low, high = max(0, at - window, taken.get(name, 0)), min(len(terms), at + window)
        taken[name] = max(high, taken.get(name, 0))
        context = xxhash.xxh3_64_intdigest(" ".join(t for _, _, t in terms[max(0, at - window) : high])) - (1 << 63)
        out += [(t, name, context, n) for t, n in Counter(t for _, _, t in terms[low:high]).items()]
    return out


def general_form(term: Column) -> Column:
    """Digits masked, or the first three letters of a word."""
    return F.when(term.rlike("[0-9]"), F.regexp_replace(term, "[0-9]", "#")).otherwise(F.concat(F.substring(term, 1, 3), F.lit("*")))


def _disclosure(n_both: Column, n_term: Column, n_entity: Column, n: Column) -> Column:
    """PMI over information content; an entity that is near every term tells nothing."""
    p = n_entity / n
    return F.when(p < 1, F.log2(n_both / n_term / p) / -F.log2(p)).otherwise(F.lit(0.0))


def disclosing_terms(docs: DataFrame, text_col: str = "text", window: int = WINDOW, disclosure: float = DISCLOSURE,
                     support: int = SUPPORT) -> DataFrame:
    """(term, entities, disclosure, general): the terms of ``docs`` that disclose an
    entity, how many, how much of the most exposed, and the form that replaces
    the term (null: it has to go). Stored below the shared checkpoint folder."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seen = written(texts.mapInPandas(_evidence(window), "term string, entity string, context long, n long"), "pii-evidence")
    total = written(seen.where("entity is null").groupBy("term").agg(F.sum("n").alias("n_term")), "pii-terms")
    near = seen.where("entity is not null").groupBy("term", "entity", "context").agg(F.sum("n").alias("n"))
    near = written(near.groupBy("term", "entity").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("contexts")), "pii-near")
    size = F.lit(total.agg(F.sum("n_term")).first()[0] or 0)
    mentions = near.groupBy("entity").agg(F.sum("n_both").alias("n_entity"))
    pairs = near.where(F.col("contexts") >= support).join(total, "term").join(mentions, "entity")
    pairs = pairs.withColumn("disclosure", _disclosure(F.col("n_both"), F.col("n_term"), F.col("n_entity"), size))
    told = written(pairs.where(F.col("disclosure") >= disclosure).withColumn("form", general_form(F.col("term"))), "pii-told")
    forms = total.groupBy(general_form(F.col("term")).alias("form")).agg(F.sum("n_term").alias("n_form"))
    form_near = near.groupBy("entity", general_form(F.col("term")).alias("form")).agg(F.sum("n_both").alias("n_form_both"))
    told = told.join(forms, "form").join(form_near, ["entity", "form"])
    still = _disclosure(F.col("n_form_both"), F.col("n_form"), F.col("n_entity"), size)
    out = told.groupBy("term").agg(F.count(F.lit(1)).alias("entities"), F.max("disclosure").alias("disclosure"),
                                   F.when(F.max(still) < disclosure, F.first("form")).alias("general"))
    return written(out, "pii-disclosing")


def _clean(text: str, spans: list, general: dict) -> str:
    """The text with entities replaced by their kind, terms by their form or nothing."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]" if kind < len(KINDS) else general[text[start:end].lower()] or ""]
        elif end <= at:
            continue
        at = end
    return "".join([*out, text[at:]])


def _spelt(spans: list) -> str:
    return ",".join(f"{(*KINDS, 'term')[kind]}:{start}:{end}" for start, kind, end in spans)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, disclosure: float = DISCLOSURE,
              support: int = SUPPORT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, text, clean, n_email, n_ip, n_card, n_phone, n_term, base, spans): every row
    with its spans (``kind:start:end`` in code points, by start and kind, comma-joined;
    ``base`` has those of the patterns alone) and its text without what they cover.

    A null text is empty; null ids, equal ids, repeated rows and other columns change nothing;
    an empty table gives none. Texts of any length are one value of a row, scanned in linear time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    told = disclosing_terms(rows, "text", window, disclosure, support).select("term", "general")
    everywhere = None
    if bytes_at_most(told, broadcast_bytes):
        everywhere = docs.sparkSession.sparkContext.broadcast({r["term"]: r["general"] for r in told.collect()})
    else:
        t1, t2 = hash_pair("text")
        rows = rows.withColumn("t1", t1).withColumn("t2", t2)

        def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                frame["terms"] = [list({t.lower() for t in TERM.findall(x)}) for x in frame["text"]]
                yield frame[["t1", "t2", "terms"]]

        held = rows.select("t1", "t2", "text").mapInPandas(terms, "t1 long, t2 long, terms array<string>")
        held = hot_split_join(written(held.select("t1", "t2", F.explode("terms").alias("term")).distinct(), "pii-held"), told, ["term"])
        held = written(held.groupBy("t1", "t2").agg(F.collect_list("term").alias("terms"), F.collect_list(F.coalesce("general", F.lit(""))).alias("generals")), "pii-held")
        rows = hot_split_join(rows, held, ["t1", "t2"], "left").drop("t1", "t2")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = {c: [] for c in ("clean", *(f"n_{k}" for k in KINDS), "n_term", "base", "spans")}
            own = [None] * len(frame) if everywhere else [dict(zip(t, g)) if t is not None else {} for t, g in zip(frame["terms"], frame["generals"])]
            for text, known in zip(frame["text"], own):
                known = everywhere.value if everywhere else known
                base = spans = base_spans(text)
                if known:
                    spans = sorted(base + [(a, len(KINDS), b) for a, b, t in _outside(text, base) if t in known])
                kinds = Counter(k for _, k, _ in spans)
                for k, name in enumerate((*KINDS, "term")):
                    out[f"n_{name}"].append(kinds[k])
                out["base"].append(_spelt(base))
                out["spans"].append(_spelt(spans))
                out["clean"].append(_clean(text, spans, known) if spans else text)
            yield pd.DataFrame({"id": frame["id"], "text": frame["text"], **out})

    kind = rows.schema["id"].dataType.simpleString()
    counts = "".join(f"n_{k} long, " for k in (*KINDS, "term"))
    found = rows.mapInPandas(apply, f"id {kind}, text string, clean string, {counts}base string, spans string")
    return found.withColumnRenamed("id", id_col)
