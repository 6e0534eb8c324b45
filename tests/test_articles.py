import random
import re
import time

import pytest

from finch.operators.articles import BLOCK_COST, LINK_COST, article, blocks, page_article


def test_blocks_by_hand():
    page = ("<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body><nav><a href='/'>Home page</a></nav>"
            "<h1>A &amp; B</h1><p>One <b>bold</b> two <a href='x'>link here</a>, end<br>next 1 < 2<!-- <p>no</p> --><ul><li><A HREF=y>only link</A></ul>"
            "<footer>Foot</footer></body></html>")
    assert blocks(page) == [("A & B", 3, 0), ("One bold two link here, end", 6, 2), ("next 1 < 2", 4, 0), ("only link", 2, 2)]


def test_article_between_menus():
    menu = "<ul>" + "<li><a href='/x'>some menu entry</a></li>" * 6 + "</ul>"
    paragraphs = ["word " * 40, "short one", "other " * 30]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    text, words, n, total = article(f"{menu}<div>By someone</div>{body}{menu}<p>Copyright nobody</p>")
    assert text == "\n".join(p.strip() for p in paragraphs) and (words, n, total) == (72, 3, 17)


def brute(page):
    found = blocks(page)
    score = [w - LINK_COST * k - BLOCK_COST for _, w, k in found]
    runs = [(sum(score[i:j]), -j, i) for i in range(len(found)) for j in range(i + 1, len(found) + 1)]
    best = max(runs, default=(0, 0, 0))
    return "" if best[0] <= 0 else "\n".join(t for t, _, _ in found[best[2] : -best[1]])


@pytest.mark.parametrize("seed", range(25))
def test_run_is_the_greatest(seed):
    rng = random.Random(seed)
    parts = ["<p>", "</p>", "<li>", "<a>", "</a>", "<b>", "</b>", "<nav>", "</nav>", "<!-- c -->", "<br>", "word ", "two words ", "<", "&lt;", "long text of more than six words here ", "<script>x</script>"]
    for _ in range(60):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert article(page)[0] == brute(page)


@pytest.mark.parametrize("unit", ["<p", "<!--", "<", "<script>", "<nav>", "<a ", "</", "<a>x", "<p>x ", "&", "<a href=\"", "<title>"])
def test_linear_on_what_is_left_open(unit):
    start = time.time()
    article(unit * 300_000)
    assert time.time() - start < 10


def test_rows(spark):
    rows = [(1, "<p>" + "w " * 20 + "</p>"), (2, None), (3, ""), (4, "plain " * 10), (5, "<p>few</p>")]
    got = {r.page_id: (r.text, r.n_words, r.n_blocks, r.page_blocks) for r in page_article(
        spark.createDataFrame(rows, "page_id long, html string"), "page_id").collect()}
    assert got == {1: (" ".join("w" * 20), 20, 1, 1), 2: ("", 0, 0, 0), 3: ("", 0, 0, 0), 4: ("plain " * 9 + "plain", 10, 1, 1), 5: ("", 0, 0, 1)}


def test_finds_the_article_of_most_pages(spark):
    """Where a page marks its article and that has 60 words or more, the text found is that one: words by F1."""
    from collections import Counter

    from helpers import SMALL
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html")
    found = {r.page_id: Counter(r.text.split()) for r in page_article(pages, "page_id").collect()}
    scores = []
    for r in pages.collect():
        marked = re.search("(?s)<article>(.*?)(</article>|$)", r.html)
        if marked and marked.group(2):
            words = Counter(" ".join(t for t, _, _ in blocks(marked.group(1))).split())
            if sum(words.values()) < 60:
                continue
            scores.append(2 * sum((words & found[r.page_id]).values()) / max(1, sum(words.values()) + sum(found[r.page_id].values())))
    assert scores and sum(scores) / len(scores) > 0.95


def test_worker_holds_little_beside_its_batch():
    """Results of a batch of long pages are passed on while later pages are still to be read."""
    import pyarrow as pa

    from finch.operators.pages import SLICE_CHARS, text_rows
    pages = [f"<p>{'word ' * (SLICE_CHARS // 20)}</p>"] * 40 + [None, "", "<p>short</p>"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], names=["page_id", "html"])
    asked = []
    run = text_rows(lambda h: (asked.append(h), article(h))[1], {"text": pa.string(), "n_words": pa.int32(), "n_blocks": pa.int32(), "page_blocks": pa.int32()})
    seen, got = [], []
    for part in run(iter([batch, batch.slice(0, 0)])):
        seen.append(len(asked))
        got += part.to_pylist()
    assert seen[0] <= 5 and len(seen) >= 10
    assert [r["page_id"] for r in got] == list(range(len(pages)))
    assert [(r["text"], r["n_words"], r["n_blocks"], r["page_blocks"]) for r in got] == [article(p) for p in pages]
