import hashlib
import random
import re
import zlib

import pytest

from finch.llm import conversation_repair as cr

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def repair(rows):
    """One conversation by a plain search over whole audits: the least (cost, audit) by state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, r, x in rows:
        body = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((r, x))

    def inserts(best):
        for _ in range(3):
            for s, (cost, audit, said) in list(best.items()):
                new = (cost + 5, audit + "I", said + [(NAME[NEXT[s]], "")])
                if NEXT[s] not in best or new[:2] < best[NEXT[s]][:2]:
                    best[NEXT[s]] = new
        return best

    best = inserts({"": (0, "", [])})
    for (_, _, r, x), fault in zip(rows, faults):
        ahead = {}

        def offer(state, cost, audit, said):
            if state not in ahead or (cost, audit) < ahead[state][:2]:
                ahead[state] = (cost, audit, said)
        for s, (cost, audit, said) in best.items():
            offer(s, cost + 2, audit + "D", said)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if r[:1] in ("s", "u", "a") and (r[:1] == NEXT[s] or (s, r[:1]) == ("", "s")):
                offer(r[:1], cost + more, audit + "K", said + [(r, x)])
            offer(NEXT[s], cost + 1 + more, audit + "R", said + [(NAME[NEXT[s]], x)])
        best = inserts(ahead)
    cost, audit, said = min(best[s] for s in ("", "a") if s in best)
    turns = [t for _, t, _, _ in rows if t is not None]
    heads = [r[:1] for _, _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest())


def brute(rows):
    after = damage(rows)
    return {c: repair([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "k", 1, True) for c, t, r, x in rows],
                                 "conv_id long, turn long, role string, text string, ck string, piece int, kept boolean").repartition(3)


def shown(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def some_rows(rng, conv, n):
    say = ["Well.", "Yes!", "no end", "what?", "", " \t", "a.b", "Ends. \n", None, "Well."]
    return [(conv, rng.choice([k, k, k, k + 7, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]), rng.choice(say))
            for k in range(n)]


@pytest.mark.parametrize("piece", [2, 4096])
def test_equals_search_over_audits(spark, piece):
    """Long conversations in pieces of 2 rows give what whole ones do."""
    rng = random.Random(7)
    rows = [r for c in range(40) for r in some_rows(rng, c if c else None, rng.randint(1, 14))]
    rows += rows[:9]
    want = brute(rows)
    assert {v[5] > 0 for v in want.values()} == {True, False}
    assert shown(cr.repair_report(cr.damaged(frame(spark, rows)), piece)) == want


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"{k} said{rng.choice(['.', '', '!'])}") for k in range(3000)]
    rows += [(2, 0, "user", "Hm."), (2, 1, "assistant", "long " * 2_000_000 + ".")]
    assert shown(cr.repair_report(cr.damaged(frame(spark, rows)), 256)) == brute(rows)


def test_ties_take_the_least_audit(spark):
    """One user turn too many: deleting either costs the same, and DKK sorts before KDK."""
    said = [(1, k, r, x, True) for k, (r, x) in enumerate([("user", "A."), ("user", "B."), ("assistant", "C.")])]
    said += [(2, 0, "user", "A.", False)]
    got = shown(cr.repair_report(spark.createDataFrame(said, "conv long, turn long, role string, text string, kept boolean")))
    assert got[1] == (0, 0, 0, 0, 1, 2, "DKK", hashlib.sha256(b"user:B.\nassistant:C.").hexdigest())
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_row_level_result(spark):
    rows = spark.createDataFrame([(5, 0, "user", "Hello.", True), (5, 1, "tool", "Hi.", True), (5, 1, "tool", "Hi.", True)],
                                 "conv long, turn long, role string, text string, kept boolean")
    row = cr.repaired(rows).collect()
    assert [(r.ck, r.audit, r.roles, r.texts) for r in row] == [("5", "KRD", ["user", "assistant"], ["Hello.", "Hi."])]


def test_empty_table(spark):
    assert cr.repair_report(cr.damaged(frame(spark, []))).collect() == []


def test_ids_of_another_type(spark):
    rows = [("x", 0, "user", "Hello."), ("", 1, "assistant", None), (None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert shown(cr.repair_report(cr.damaged(table))) == brute(rows)
