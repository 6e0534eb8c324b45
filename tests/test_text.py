from hypothesis import given, settings, strategies as st

from helpers import col1
from finch.functions import text as tx

ALPHABET = st.sampled_from(list("ab Z9.,;:!?()'\"\n\t\r\x0b\x0c\x1c é-#•") + [" ", " ", "  ", "\n\n"])
TEXTS = st.lists(ALPHABET, max_size=40).map("".join)


KEPT = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.,;:!?()'") | {'"'}


def kept_runs(text):
    """The maximal runs of kept characters, by a walk over the characters."""
    runs, now = [], []
    for ch in text + "\0":
        if ch in KEPT:
            now.append(ch)
        elif now:
            runs.append("".join(now))
            now = []
    return " ".join(runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=30))
def test_clean_pdf_joins_the_kept_runs(spark, texts):
    got = col1(spark, texts, tx.clean_pdf_text("x"))
    assert got == [kept_runs(t).lower() for t in texts]


def test_clean_pdf_cased(spark):
    assert col1(spark, ["Hello,  World!\n\n\nÉtat"], tx.clean_pdf_text("x", False)) == ["Hello, World! tat"]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=30))
def test_splitlines_and_header_drop_match_python(spark, texts):
    got = col1(spark, texts, tx.drop_header_lines("x", 2))
    assert got == ["\n".join(t.splitlines()[2:]).strip().lower() for t in texts]


def test_line_trim_cases(spark):
    texts = ["a b\nc d\ne f\none\n\n g  h ", "x y\nz z", "", "1\n2\n\tk\u00a0l\nm\n  \nn o p"]
    assert col1(spark, texts, tx.line_trim("x", 2, 2)) == ["e f\n g  h ", "", "", "\tk\u00a0l\nn o p"]


def test_sentences_keep_control_characters(spark):
    assert col1(spark, ["a.\u0001 b. c\u0001b d! \u0001t"], tx.sentence_split("x")) == [["a.\u0001 b.", "c\u0001b d!", "\u0001t"]]


def test_sentence_split_cases(spark):
    got = col1(spark, ['One. Two!  "Three?" Four\nfive.  ', "", "no end", "a.b. c"], tx.sentence_split("x"))
    assert got == [["One.", "Two!", '"Three?"', "Four\nfive."], [], ["no end"], ["a.b.", "c"]]


def test_remove_phrases_order(spark):
    t = "Key takeaways from this chapter: read Varsity. We recommend reading this chapter on varsity to learn more and understand the concepts in-depth."
    assert col1(spark, [t], tx.remove_phrases("x")) == [": read . "]


def test_quote_block(spark):
    assert col1(spark, ["• a\nb\n"], tx.quote_block("x")) == [">   * a\n> b\n"]


def test_pages_of(spark):
    assert col1(spark, ["abcdefg", ""], tx.pages_of("x", 3)) == [["abc", "def", "g"], [""]]
