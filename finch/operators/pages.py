"""Page-text operators: main block, text extraction, line trimming, fetch
outcome over an attempt log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import BACKOFF_FACTOR, ERROR_MARKER, FAILURE_TEXT, FETCH_RETRIES
from ..functions.text import PY_SPACE, line_trim

# Main-content candidates, in order of preference.
MAIN_PATTERNS = (
    ("main", "(?is)<main\\b[^>]*>(.*?)</main>"),
    ("article", "(?is)<article\\b[^>]*>(.*?)</article>"),
    ("div_main", "(?is)<div\\b[^>]*\\brole\\s*=\\s*[\"']?main\\b[^>]*>(.*?)</div>"),
    ("body", "(?is)<body\\b[^>]*>(.*?)</body>"),
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def main_block(df: DataFrame, html_col: str = "html") -> DataFrame:
    """JVM-side approximation of ``page_main``: the first non-empty of main /
    article / div role=main / body, up to its first close tag -> (tag, block)."""
    found = [(name, F.nullif(F.regexp_extract(html_col, pat, 1), F.lit(""))) for name, pat in MAIN_PATTERNS]
    tag = F.coalesce(*[F.when(b.isNotNull(), F.lit(name)) for name, b in found])
    return df.withColumn("tag", tag).withColumn("block", F.coalesce(*[b for _, b in found]))


def html_text(col) -> Column:
    """Native text of an HTML fragment: script/style/comments removed, every
    tag a line break, basic entities decoded, lines stripped, empty lines
    dropped. (An approximation of a tree walk, JVM-side.)"""
    s = F.regexp_replace(_c(col), "(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>", "")
    s = F.regexp_replace(s, "(?s)<!--.*?-->", "")

    def decode(piece):
        for ent, ch in ENTITIES:
            piece = F.replace(piece, F.lit(ent), F.lit(ch))
        return F.regexp_replace(piece, f"(?U)^{PY_SPACE}+|{PY_SPACE}+$", "")
    # every tag is a line break: split on tags and newlines in one pass, then
    # decode entities per piece (a decoded "<" can no longer look like a tag)
    lines = F.transform(F.split(s, "<[^>]*>|\n"), decode)
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def page_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    return main_block(df, html_col).withColumn(out_col, html_text("block"))


def trim_lines(df: DataFrame, col: str = "text", skip_lines: int = 6, min_words: int = 2) -> DataFrame:
    return df.withColumn(col, line_trim(col, skip_lines, min_words))


# ---------------------------------------------------------------------------
# exact tree-walk extraction (Python, Arrow batches)
# ---------------------------------------------------------------------------

SLICE_CHARS = 1 << 20           # characters of text read for each batch of results
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset(("script", "style", "template"))


def main_node(html: str | None) -> tuple[str | None, str | None, str]:
    """(tag, block, text) of a page's main node: the first ``main``, else the first
    ``article``, else the first ``div role=main``, else ``body``; a node counts
    even when empty. ``block`` is the markup between its tags.

    ``text`` joins its child elements by a space; the strings inside a child are
    stripped and joined by newlines. Text directly below the node, script, style
    and template children and their contents, and comments do not count. A page
    without any such node gives (None, None, "").

    The tree is never built: open tags are a stack, and each candidate collects
    its text while it is open, so depth and unclosed tags cost nothing extra.
    """
    from html.parser import HTMLParser

    found: dict[str, dict] = {}                     # first node of each kind

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack: list[str] = []
            self.open: dict[str, int] = {}          # how often a tag is on the stack
            self.live: list[dict] = []              # candidates that are open
            self.silent = 0                         # open tags whose strings do not count

        def place(self):
            line, col = self.getpos()
            return starts[line - 1] + col

        def handle_starttag(self, tag, attrs):
            self.handle_startendtag(tag, attrs)
            if tag in VOID_TAGS:
                return
            self.stack.append(tag)
            self.open[tag] = self.open.get(tag, 0) + 1
            self.silent += tag in SILENT_TAGS
            kind = tag if tag in ("main", "article", "body") else "div_main" if tag == "div" and dict(attrs).get("role") == "main" else None
            if kind and kind not in found:
                node = {"depth": len(self.stack), "from": self.place() + len(self.get_starttag_text()), "to": len(html), "parts": []}
                found[kind] = node
                self.live.append(node)

        def handle_startendtag(self, tag, attrs):   # also called for every start tag: a child of the node just above
            for node in self.live:
                if node["depth"] == len(self.stack) and tag not in ("script", "style"):
                    node["parts"].append([])

        def handle_endtag(self, tag):
            if not self.open.get(tag):
                return
            while True:
                last = self.stack.pop()
                self.open[last] -= 1
                self.silent -= last in SILENT_TAGS
                for node in [n for n in self.live if n["depth"] > len(self.stack)]:
                    node["to"] = self.place()
                    self.live.remove(node)
                if last == tag:
                    return

        def handle_data(self, data):
            text = data.strip()
            if text and not self.silent:
                for node in self.live:
                    if node["depth"] < len(self.stack):
                        node["parts"][-1].append(text)

    html = html or ""
    starts = [0]
    for line in html.split("\n")[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    walk = Walk()
    walk.feed(html)
    walk.close()
    for kind in ("main", "article", "div_main", "body"):
        if kind in found:
            node = found[kind]
            return kind, html[node["from"]:node["to"]], " ".join("\n".join(p) for p in node["parts"])
    return None, None, ""


def text_rows(one: Callable[[str | None], tuple], fields: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function over (id, text): the id and what ``one`` makes of the text.

    Texts leave Arrow one by one, and results are passed on every ``SLICE_CHARS`` characters, so a
    worker holds one of Spark's batches and little beside it, however long the texts are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            done, held, start = [], 0, 0
            for at, value in enumerate(texts, 1):
                text = value.as_py()
                done.append(one(text))
                held += len(text or "")
                if held >= SLICE_CHARS or at == len(texts):
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*done), fields.values())]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(done)), *columns], names=[batch.schema.names[0], *fields])
                    done, held, start = [], 0, at
    return run


def page_main(df: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, tag, block, text) of every page's main node: a small per-row helper
    in mapInArrow; Spark spreads pages over tasks."""
    run = text_rows(main_node, {"tag": pa.string(), "block": pa.string(), "text": pa.string()})
    id_type = dict(df.dtypes)[id_col]
    return df.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {id_type}, tag string, block string, text string")


def page_text_exact(df: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    return page_main(df, id_col, html_col).select(id_col, "text")


# ---------------------------------------------------------------------------
# fetch outcome over an attempt log
# ---------------------------------------------------------------------------

def fetch_outcome(attempts: DataFrame, url_col: str, order_cols: list[str], failed: Column,
                  body_col: str, retries: int = FETCH_RETRIES, backoff: float = BACKOFF_FACTOR) -> DataFrame:
    """Per URL: the first successful attempt among the first ``retries``, its
    body (or the failure text), and the seconds waited (backoff * 2^attempt
    after every failure before it).

    Only the first ``retries`` attempts per URL are ranked; Spark plans this
    as a per-key top-k (WindowGroupLimit) before the shuffle, so a URL with a
    huge log moves at most ``retries`` rows per map partition.
    """
    w = Window.partitionBy(url_col).orderBy(*order_cols)
    first = (attempts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= retries)
                     .withColumn("_fail", failed | F.col(body_col).contains(ERROR_MARKER)))
    per = first.groupBy(url_col).agg(
        F.min(F.when(~F.col("_fail"), F.col("_n"))).alias("_ok_n"),
        F.collect_list(F.struct(F.col("_n"), F.col("_fail"), F.col(body_col).alias("b"))).alias("_a"))
    ok_body = F.filter("_a", lambda a: a["_n"] == F.col("_ok_n"))
    waited = F.aggregate(F.filter("_a", lambda a: a["_fail"] & (F.col("_ok_n").isNull() | (a["_n"] < F.col("_ok_n")))),
                         F.lit(0.0), lambda acc, a: acc + F.lit(backoff) * F.pow(F.lit(2.0), a["_n"] - 1))
    return per.select(
        url_col,
        F.col("_ok_n").isNotNull().alias("ok"),
        (F.col("_ok_n") - 1).cast("int").alias("attempt"),
        F.coalesce(F.try_element_at(ok_body, F.lit(1))["b"], F.lit(FAILURE_TEXT)).alias("text"),
        waited.alias("waited_sec"))
