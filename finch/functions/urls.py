"""URL and link column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import TOPIC_BLOCK_SUBSTRING, TOPIC_BLOCKLIST, WIKI_SUBREDDIT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# "(?d)": only "\n" ends a line, so "." behaves as in Python's re.
MD_LINK = "(?d)\\[.*?\\]\\((.*?)\\)"


def markdown_links(col) -> Column:
    """Targets of ``[text](target)`` links, in order of appearance."""
    return F.regexp_extract_all(_c(col), F.lit(MD_LINK), 1)


def is_internal_wiki(col, subreddit: str = WIKI_SUBREDDIT) -> Column:
    return _c(col).contains(f"reddit.com/r/{subreddit}/wiki/")


def wiki_target(col) -> Column:
    """Page name: the piece after the last "/wiki/"."""
    return F.element_at(F.split(_c(col), "/wiki/"), -1)


# scheme "://" authority; the authority ends at the first "/", "?" or "#".
AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def url_authority(col) -> Column:
    """``urlparse(url).netloc``: user info and port kept, "" when there is no
    "scheme://" prefix. A lenient split like the original's, so a stray "%"
    does not make the whole URL unparsable."""
    return F.regexp_extract(_c(col), AUTHORITY, 1)


def url_topic(col) -> Column:
    """Second-to-last "/" piece; NULL when there are fewer than two pieces."""
    return F.try_element_at(F.split(_c(col), "/"), F.lit(-2))


def url_file_name(col) -> Column:
    """Last "/" piece without non-word characters, plus ".txt"."""
    last = F.element_at(F.split(_c(col), "/"), -1)
    return F.concat(F.regexp_replace(last, "(?U)\\W+", ""), F.lit(".txt"))


def topic_allowed(col, substring: str = TOPIC_BLOCK_SUBSTRING, blocklist=TOPIC_BLOCKLIST) -> Column:
    return ~_c(col).contains(substring) & ~_c(col).isin(*blocklist)
