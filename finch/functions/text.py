"""Text column expressions (all JVM-side; no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import PDF_KEEP_CLASS, REMOVED_PHRASES, SENTENCE_CLOSERS, SENTENCE_END

# Python's str.isspace() set, written for Java regex: Unicode White_Space plus
# the four information separators \x1c-\x1f that Python also treats as space.
PY_SPACE = "[\\s\\x1c-\\x1f]"
# Line breaks recognised by Python's str.splitlines().
PY_LINE_BREAK = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"
# Whitespace that separates sentences (ASCII, so both regex dialects agree).
SENTENCE_GAP = "[ \\t\\n\\r\\f]+"
SENTENCE_BLANKS = " \t\n\r\f\x0b"
_MARK, _ESCAPE = "\u0001", "\u0002"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: trim Python whitespace at both ends."""
    return F.regexp_replace(_c(col), f"(?U)^{PY_SPACE}+|{PY_SPACE}+$", "")


def py_split_words(col) -> Column:
    """``str.split()`` with no argument: runs of whitespace, no empty pieces."""
    return F.filter(F.split(_c(col), f"(?U){PY_SPACE}+"), lambda w: w != "")


def word_count(col) -> Column:
    return F.size(py_split_words(col))


def clean_pdf_text(col, lowercase: bool = True) -> Column:
    """Page-text cleaning: keep letters, digits and basic punctuation.

    The original runs three substitutions (blank lines, disallowed characters,
    whitespace runs) then strips; together they replace every maximal run of
    characters outside the kept class with one space and trim. Here that is one
    pass that extracts the runs of kept characters and joins them with a
    space (same result; extraction scales across cores much better than a
    replacement with a match at every word gap).
    """
    out = F.array_join(F.regexp_extract_all(_c(col), F.lit(f"[{PDF_KEEP_CLASS}]+"), 0), " ")
    return F.lower(out) if lowercase else out


def sentence_split(col) -> Column:
    """Rule sentence splitter: break after . ! ? (plus closing quotes or
    brackets) followed by whitespace; strip each sentence, drop empty ones."""
    def pieces(text: Column) -> Column:
        return F.split(F.regexp_replace(text, f"({SENTENCE_END}{SENTENCE_CLOSERS}){SENTENCE_GAP}", "$1" + _MARK), _MARK)

    def trimmed(s: Column) -> Column:
        return F.btrim(s, F.lit(SENTENCE_BLANKS))
    text = _c(col)
    # a marker character in the text itself becomes two others meanwhile
    safe = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_MARK), F.lit(_ESCAPE + "m"))
    rare = F.transform(pieces(safe), lambda s: F.replace(F.replace(trimmed(s), F.lit(_ESCAPE + "m"), F.lit(_MARK)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE)))
    return F.filter(F.when(text.contains(_MARK), rare).otherwise(F.transform(pieces(text), trimmed)), lambda s: s != "")


def sentence_count(col) -> Column:
    """``size(sentence_split(text))`` without building a sentence: every boundary
    ends one, and there is one more unless only blanks are left behind the last."""
    text = _c(col)
    boundary = f"{SENTENCE_END}{SENTENCE_CLOSERS}{SENTENCE_GAP}"
    body = F.rtrim(text, F.lit(SENTENCE_BLANKS))
    ends = F.when(F.length(body) < F.length(text), text.rlike(f"{boundary}[{SENTENCE_BLANKS}]*\\z")).otherwise(F.lit(False))
    return F.regexp_count(text, F.lit(boundary)) + F.when((body == "") | ends, 0).otherwise(1)


def splitlines(col) -> Column:
    """``str.splitlines()``: like a split on line breaks, without the empty
    piece a trailing break would leave."""
    parts = F.split(_c(col), PY_LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def drop_header_lines(col, n: int = 4) -> Column:
    """Drop the first ``n`` lines, join with newlines, strip, lower-case."""
    lines = splitlines(col)
    kept = F.slice(lines, n + 1, F.greatest(F.size(lines), F.lit(1)))
    return F.lower(py_strip(F.array_join(kept, "\n")))


def line_trim(col, skip_lines: int = 6, min_words: int = 2) -> Column:
    """Drop the first ``skip_lines`` lines, then every line with fewer than
    ``min_words`` words (lines split on "\\n" only, as the original does)."""
    lines = F.split(_c(col), "\n")
    kept = F.slice(lines, skip_lines + 1, F.greatest(F.size(lines), F.lit(1)))
    return F.array_join(F.filter(kept, lambda l: word_count(l) >= min_words), "\n")


def remove_phrases(col, phrases=REMOVED_PHRASES, lowercase: bool = True) -> Column:
    """Lower-case, then delete each phrase in order (order matters: a later
    phrase may be part of an earlier one)."""
    out = F.lower(_c(col)) if lowercase else _c(col)
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(""))
    return out


def quote_block(col) -> Column:
    """Markdown quote: bullets become "  *", every line gets a "> " prefix."""
    return F.regexp_replace(F.replace(_c(col), F.lit("•"), F.lit("  *")), "(?m)^", "> ")


def pages_of(col, page_chars: int) -> Column:
    """Cut a text into fixed-size pages (code points) -> array<string>."""
    n = F.greatest(F.ceil(F.char_length(_c(col)) / F.lit(page_chars)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.substring(_c(col), i * page_chars + 1, page_chars))
