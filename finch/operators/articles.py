"""Main text of a web page by block densities.

A page is a row of text blocks, cut at block-level tags. A block speaks for the article with
its words and against it with its links: ``words - LINK_COST * linked words - BLOCK_COST``, so
menus, bylines and teasers count below zero and paragraphs above. The article is the run of
blocks with the greatest sum; short paragraphs within it are kept, menus around it are not.

Pages are independent rows; the walk over one is a small helper in a task. It goes through the
markup once, whatever is left open: a tag ends at the next ``>``, and an unclosed
tag, comment or script takes the rest.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .pages import text_rows

LINK_COST, BLOCK_COST = 3, 6
# Elements that begin and end a block.
BLOCK_TAGS = frozenset((
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
# Elements whose contents are no part of any text.
RAW_TAGS = frozenset("script style textarea title".split())
SKIPPED_TAGS = frozenset("head nav footer aside form noscript template svg button select".split())
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*+)")
CLOSE = {tag: re.compile(f"</{tag}\\b", re.I) for tag in RAW_TAGS}


def blocks(html: str) -> list[tuple[str, int, int]]:
    """(text, words, linked words) of the blocks of a page that have words, in order."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    links: list[int] = []                    # parts at which links open and close, in turns
    skipped: dict[str, int] = {}
    skipping, linked, at, end = 0, False, 0, len(html)

    def close() -> None:
        nonlocal parts, links
        if parts:
            bounds = [0, *links, len(parts)]
            # a link's words are those of its own text, also where it touches other text
            marked = sum(len("".join(parts[a:b]).split()) for a, b in zip(bounds[1::2], bounds[2::2]))
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, text.count(" ") + 1, marked))
        parts, links = [], [0] if linked else []

    while at < end:
        tag = html.find("<", at)
        if tag < 0:
            tag = end
        if tag > at and not skipping:
            parts.append(unescape(html[at:tag]))
        if tag == end:
            break
        if html.startswith("<!--", tag):
            stop = html.find("-->", tag + 4)
            at = end if stop < 0 else stop + 3
            continue
        name = NAME.match(html, tag)
        stop = html.find(">", tag) if name or html.startswith(("<!", "<?", "</"), tag) else tag
        if stop < 0:                         # no tag can end any more
            break
        if stop == tag:                      # a lone "<" is text
            if not skipping:
                parts.append("<")
            at = tag + 1
            continue
        at = stop + 1
        if not name:
            continue
        kind, closing = name.group(1).lower(), html[tag + 1] == "/"
        if kind in RAW_TAGS and not closing:
            close()
            ahead = CLOSE[kind].search(html, at)
            at = end if not ahead else ahead.start()
        elif kind in SKIPPED_TAGS:
            close()
            if not closing:
                skipped[kind] = skipped.get(kind, 0) + 1
                skipping += 1
            elif skipped.get(kind):
                skipped[kind] -= 1
                skipping -= 1
        elif kind in BLOCK_TAGS:
            close()
        elif kind == "a" and not skipping and linked == closing:
            linked = not closing
            links.append(len(parts))
    close()
    return out


def article(html: str | None) -> tuple[str, int, int, int]:
    """(text, words, blocks of the article, blocks of the page): the run of blocks with the
    greatest sum above zero (of equal ones the one that ends first, the shortest of these);
    no text without one."""
    found = blocks(html or "")
    best = total = start = 0
    run = (0, 0)
    for i, (_, words, linked) in enumerate(found):
        if total <= 0:
            total, start = 0, i
        total += words - LINK_COST * linked - BLOCK_COST
        if total > best:
            best, run = total, (start, i + 1)
    held = found[run[0] : run[1]]
    return "\n".join(t for t, _, _ in held), sum(w for _, w, _ in held), len(held), len(found)


def page_article(df: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, text, n_words, n_blocks, page_blocks) of every page. A null page has no text."""
    run = text_rows(article, {"text": pa.string(), "n_words": pa.int32(), "n_blocks": pa.int32(), "page_blocks": pa.int32()})
    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string, n_words int, n_blocks int, page_blocks int")
