"""Template dedup against a version that holds everything in dictionaries."""

import random
import re
from collections import Counter, defaultdict

from finch.llm import line_templates as lt


def plain(rows, depth=3, similarity=0.7, min_lines=3):
    def tokens(line):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in line.split())

    docs = [(i, t, [tokens(x) for x in t.split("\n")]) for i, t in rows]
    leaf = lambda x: (len(x), x[:depth])
    distinct = {x for _, _, ls in docs for x in ls if x}
    support = Counter((leaf(x), p, t) for x in distinct for p, t in enumerate(x))
    template = {}
    for x in distinct:
        fixed = tuple(t if p < depth or support[leaf(x), p, t] > 1 else None for p, t in enumerate(x))
        n = sum(t is not None for t in fixed)
        if len(x) > depth and similarity * len(x) <= n < len(x) and sum(leaf(y) == leaf(x) for y in distinct) > 1:
            template[x] = fixed
        else:
            template[x] = ("own", x)
    holders = defaultdict(list)
    for d, (_, _, ls) in enumerate(docs):
        for x in {y for y in ls if y}:
            holders[template[x]].append(d)
    gone = {t: min(h) for t, h in holders.items() if len(h) >= min_lines and len(set(h)) > 1}
    return {i: "\n".join(line for line, x in zip(t.split("\n"), ls) if not x or gone.get(template[x], d) == d)
            for d, (i, t, ls) in enumerate(docs)}


def test_against_dictionaries(frame, words):
    rows = [(k, "\n".join([words(12, k), f"Page {k} of 90", f"posted by user{k} on day {k} of the year", "", f"your order was sent today by {words(1, k)} from our town",
                          "All rights reserved.", words(9, 100 + k % 4)])) for k in range(40)]
    rows += [(100, "All rights reserved."), (101, "odd line here\n"), (102, "")]
    got = {r["doc_id"]: r for r in lt.drop_recurring_lines(frame(rows)).collect()}
    want = plain(rows)
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[0]["n_dropped"] == 0 and "sent today" in got[0]["text"] and "sent today" not in got[5]["text"]
    assert got[5]["n_generalised"] == 1 and got[100]["text"] == "" and got[100]["n_dropped"] == 1


def test_edges(frame):
    rows = [(None, "boiler plate"), (1, None), (2, "boiler plate\nboiler plate\nown"), (3, "boiler plate"), (3, "boiler plate"), (4, " \n")]
    got = sorted(((r["doc_id"] or 0, r["text"], r["h"]) for r in lt.drop_recurring_lines(frame(rows)).collect()), key=str)
    assert got == sorted([(0, "boiler plate", "x"), (1, None, "x"), (2, "own", "x"), (3, "", "x"), (3, "", "x"), (4, " \n", "x")], key=str)
    left = lt.drop_recurring_lines(frame(rows), stats=False, drop_emptied=True)
    assert left.columns == ["doc_id", "text", "h", "row", "key"] and left.count() == 4
    assert lt.drop_recurring_lines(frame([])).collect() == []


def test_two_documents_are_not_enough_and_one_long_text(frame, words):
    long = "\n".join(words(8, k, 600) for k in range(2000))
    rows = [(1, "twice\n" + long), (2, "twice"), (3, long)]
    got = {r["doc_id"]: r["text"] for r in lt.drop_recurring_lines(frame(rows)).collect()}
    assert got == plain(rows) and got[2] == "twice"


def test_long_lines_recur_from_two_documents_on(frame, words):
    passage, short = words(55, 1, 600), words(lt.LONG_LINE - 1, 2, 600)
    edited = passage.rsplit(" ", 1)[0] + " otherwise"       # a template of two long lines
    other = words(lt.LONG_LINE, 3, 600)
    rows = [(k, f"{words(8, 10 + k, 600)}\n{line}") for k, line in enumerate([passage, passage, short, short, other, other, edited])]
    got = {r["doc_id"]: r["text"] for r in lt.drop_recurring_lines(frame(rows)).collect()}
    assert {k for k, t in rows if got[k] == t} == {0, 2, 3, 4}
    assert all(got[k] == rows[k][1].split("\n")[0] for k in (1, 5, 6))


def test_templates_do_not_fade_with_size(frame, words):
    def docs(n, values):                                    # a common template, and one of a tenth of its lines in the same leaf
        rng = random.Random(n)
        name, city = (lambda: f"name{'abcdefghij'[rng.randrange(values)]}{'abcdefghij'[rng.randrange(values)]}"), (lambda: words(1, rng.randrange(values * values)))
        return [(k, f"{words(8, 5000 + k, 600)}\n" + (f"the page was seen by {name()} while in {city()} this year" if k % 10 else
                                                      f"the page was last edited by {name()} from {city()} on request")) for k in range(n)]
    for n in (100, 1000):
        rows = docs(n, 10)
        got = {r["doc_id"]: r["text"] for r in lt.drop_recurring_lines(frame(rows)).collect()}
        whole = {k for k, t in rows if got[k] == t}
        assert whole == {0, 1}, (n, len(whole))


def test_native(spark):
    from finch.llm import queries
    plan = queries.op2_line_templates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
