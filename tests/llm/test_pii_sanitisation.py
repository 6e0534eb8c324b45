import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from finch.llm import pii_sanitisation as pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def plain(text):
    """The contract, word for word."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == 2 and 12 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_patterns_equal_the_contract(seed):
    rng = random.Random(seed)
    letters = ["a@.b-", "0123.", "01 -2", "+1 (2).3-", "a@.+1 -2é"][seed % 5]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), text


def test_known_values():
    text = "Mail x.y%z+1@mail.example.com, é 4111 1111 1111 1111 or 4111-1111-1111-1112, 256.1.1.1, 10.0.0.255, +1 (017) 555-7713."
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)] == [
        ("email", "x.y%z+1@mail.example.com"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255"), ("phone", "+1 (017) 555-7713")]


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@a.", "+1 ", "1-", "a@", "é1"])
def test_linear_time(unit):
    start = time.time()
    pii.base_spans(unit * (2_000_000 // len(unit)))
    assert time.time() - start < 20


def corpus():
    """Jane Roe and badge 7741 stand by one address; other words stand anywhere."""
    rng = random.Random(5)
    word = lambda: "w" + "".join(rng.choice("abcdef") for _ in range(2))
    some = lambda n: " ".join(word() for _ in range(n))
    docs = [some(80) for _ in range(40)]
    for k in range(6):
        docs.append(f"{some(30)} Janette {some(2)} roe@mail.example.com {some(3)} badge 7741 {some(40)}")
    docs += [f"{some(20)} 10.0.0.{k} {some(20)}" for k in range(9)]
    docs += [f"{some(30)} janette Roebuck {some(9)}", f"{some(5)} badge 9999 {some(5)}", "Janissary janitor january", "", None]
    docs += docs[40:42] * 3
    return docs


def brute(texts, window, threshold, support):
    total, near, contexts = Counter(), Counter(), defaultdict(set)
    for text in texts:
        text = text or ""
        spans = plain(text)
        terms = [(m.start(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        total.update(t for _, t in terms)
        seen = set()
        for a, k, b in spans:
            value = text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b])
            at = sum(p < a for p, _ in terms)
            around = range(max(0, at - window), min(len(terms), at + window))
            for i in around:
                if (k, value, i) not in seen:
                    near[(k, value), terms[i][1]] += 1
                    contexts[(k, value), terms[i][1]].add(" ".join(terms[j][1] for j in around))
                seen.add((k, value, i))
    n = sum(total.values())
    form = lambda t: re.sub("[0-9]", "#", t) if re.search("[0-9]", t) else t[:3] + "*"
    of_entity, of_form, form_near = Counter(), Counter(), Counter()
    for (c, t), m in near.items():
        of_entity[c] += m
        form_near[c, form(t)] += m
    for t, m in total.items():
        of_form[form(t)] += m

    def told(both, one, c):
        p = of_entity[c] / n
        return math.log2(both / one / p) / -math.log2(p)
    out = {}
    for (c, t), m in near.items():
        if len(contexts[c, t]) >= support and (d := told(m, total[t], c)) >= threshold:
            still = told(form_near[c, form(t)], of_form[form(t)], c) >= threshold
            old = out.get(t, (0, 0, form(t)))
            out[t] = (old[0] + 1, max(old[1], d), None if still else old[2])
    return out


@pytest.mark.parametrize("threshold,support", [(0.8, 3), (0.5, 2), (0.95, 1)])
def test_disclosure_equals_brute_force(frame, threshold, support):
    texts = corpus()
    got = {r.term: (r.entities, r.disclosure, r.general) for r in pii.disclosing_terms(
        frame(list(enumerate(texts))), disclosure=threshold, support=support).collect()}
    want = brute(texts, pii.WINDOW, threshold, support)
    assert {t: (a, round(d, 9), g) for t, (a, d, g) in got.items()} == {t: (a, round(d, 9), g) for t, (a, d, g) in want.items()}
    assert "7741" in got and "janette" in got


@pytest.mark.parametrize("limit", [pii.BROADCAST_BYTES, 0])
def test_terms_go_everywhere_and_clean_texts_stay(frame, limit):
    """By broadcast and by join alike; nulls, empty and repeated rows included."""
    texts = corpus()
    told = brute(texts, pii.WINDOW, 0.8, 3)
    rows = list(enumerate(texts)) + [(None, texts[40]), (1, texts[1])]
    found = pii.sanitised(frame(rows), disclosure=0.8, support=3, broadcast_bytes=limit).collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in found) == sorted((i is None, i or 0, t or "") for i, t in rows)
    for r in found:
        base = plain(r.text)
        spans = base + [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W_]+", r.text)
                        if m.group().lower() in told and not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert r.spans == ",".join(f"{(*pii.KINDS, 'term')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert (r.n_email, r.n_ip, r.n_term) == tuple(sum(k == x for _, k, _ in spans) for x in (0, 1, 4))
        assert r.clean == r.text if not spans else r.clean != r.text and "7741" not in r.clean and "roe@" not in r.clean
    assert sum(r.n_term > 0 for r in found) < len(found) / 2


def test_overlapping_spans_are_covered_once():
    text = "call +1 4111 1111 1111 1111 now 7741 x"
    spans = [(5, 3, 27), (8, 2, 27), (32, 4, 36)]
    assert pii._clean(text, spans, {"7741": "####"}) == "call [phone] now #### x"
    assert pii._clean(text, spans, {"7741": None}) == "call [phone] now  x"


def test_empty_table(frame):
    assert pii.sanitised(frame([])).collect() == []
    assert [r.spans for r in pii.sanitised(frame([(1, None)])).collect()] == [""]


def test_very_long_text(frame, words):
    text = words(300_000, 3) + " me@home.example.org " + words(300_000, 4)
    (row,) = pii.sanitised(frame([(1, text)])).collect()
    assert row.n_email == 1 and row.base == f"email:{text.index('me@')}:{text.index('me@') + 19}"
