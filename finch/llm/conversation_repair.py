"""Repair of conversation structure by cost DP and prefix-doubling path ranking.

A conversation's rows are nodes of a small graph: (row, role last put out). Arcs
are edits: keep the row, give it another role, delete it, insert an empty turn. The
DP from the last row back gives every node the least cost to a legal end
(nothing, or an optional system turn and user and assistant in turns). Arcs that keep to that
cost are optimal. Among the optimal paths the one whose audit (the initials of its
edits) is least is wanted: nodes are ranked by their audits' first letter, then by the first 2,
4, 8 ... letters, each round from the ranks of a node and of the node that its
doubled pointer reaches. The ranks pick every node's arc, and the doubled pointers
give the whole path without a step-by-step walk. (An initial fixes its arc's
target here, so where a conversation is cut into pieces, ranks never have to look
beyond a border.)

Conversations of up to ``PIECE`` rows are dealt over tasks whole, many to a
task. Longer ones are numbered by a distributed index and cut into pieces of
``PIECE`` rows. A piece is a 4 x 4 cost matrix between the roles at its borders;
products of these matrices over all later pieces, by doubling joins, give the
costs at each border, and the pieces' role maps, doubled likewise, the role each starts
from. So no task holds more than a piece.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import broadcast_if_small, dense_index
from .common import hash_pair, hot_split_join, written

PIECE = 4096                    # rows of a piece
BUCKET_BYTES = 16 << 20         # text of the short conversations of a task, on average
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
INF = 1 << 40
LETTERS = "DIKR"                # in ASCII order
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])          # the role that an inserted or changed turn has
NAMES = {USER: "user", ASSISTANT: "assistant"}
# legal to keep: from the state of the row, a turn with the initial of the column
LEGAL = np.array([[0, 1, 1, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 1, 0]], bool)
END = np.array([0, INF, INF, 0])
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ("cn boolean, ck string, piece long, gaps long, " + "".join(f"{c} long, " for c in _COUNTS)
          + "audit string, roles array<string>, texts array<string>")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, kept): ``rows`` as damaged by the hash of conversation and
    turn: dropped (``kept`` is false), emptied, without sentence ends, doubled, or the user's. Nulls are one space."""
    space = F.lit(" ")
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col(conv_col).cast("string"), space), F.coalesce(F.col(turn_col).cast("string"), space))) % 20
    text = F.coalesce(F.col(text_col).cast("string"), space)
    text = F.when(h == 1, F.lit("")).when(h == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(h == 4, F.lit("user")).otherwise(F.coalesce(F.col(role_col).cast("string"), space))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1)))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                       (h != 0).alias("kept"), copies.alias("copy")).drop("copy")


class Graph:
    """Nodes and optimal arcs of conversations (or pieces) laid one behind the other.

    lens: rows of each; initial (0 none of s, u, a), must (has to go), cut (truncated):
    per row. ends: (conversations, 4) costs at the end, ``last`` where that is the
    conversation's end and not a border."""

    def __init__(self, lens, initial, must, cut, ends, last):
        self.lens = lens
        self.first = np.cumsum(lens + 1) - (lens + 1)           # slot of each one's first row; a slot more for its end
        slots = int((lens + 1).sum())
        self.end = self.first + lens
        is_row = np.ones(slots, bool)
        is_row[self.end] = False
        x, go, extra = np.zeros(slots, np.int64), np.zeros(slots, bool), np.zeros(slots, np.int64)
        x[is_row], go[is_row], extra[is_row] = initial, must, np.where(cut, TRUNCATED, 0)
        self.row = np.cumsum(is_row) - is_row
        # cost and target state of every arc, INF where there is none: (slots, states, letters)
        cost = np.full((slots, 4, 4), INF)
        to = np.zeros((slots, 4, 4), np.int64)
        cost[is_row, :, 0] = DELETE
        to[:, :, 0] = np.arange(4)
        cost[is_row, :, 1] = INSERT
        cost[self.end[last], :, 1] = INSERT
        to[:, :, 1] = NEXT
        cost[:, :, 2] = np.where(is_row[:, None] & ~go[:, None] & LEGAL[:, x].T, KEEP + extra[:, None], INF)
        to[:, :, 2] = x[:, None]
        cost[:, :, 3] = np.where((is_row & ~go)[:, None], REROLE + extra[:, None], INF)
        to[:, :, 3] = NEXT
        self.cost, self.to = cost, to
        self.least = self._dp(ends)

    def _dp(self, ends: np.ndarray) -> np.ndarray:
        least = np.full((int((self.lens + 1).sum()), 4), INF)
        order = np.argsort(-self.lens, kind="stable")
        sizes = self.lens[order]
        for back in range(int(self.lens.max(initial=0)) + 1):
            at = self.end[order[: np.searchsorted(-sizes, -back, "right")]] - back
            if back:
                after, cost, to = least[at + 1], self.cost[at], self.to[at]
                found = np.minimum(INF, np.min([cost[:, :, k] + np.take_along_axis(after, to[:, :, k], 1) for k in (0, 2, 3)], 0))
            else:
                found = ends[order].copy()
            closed = self.cost[at, :, 1] < INF
            turned = np.where(closed, found[:, NEXT] + INSERT, INF)
            found[:, USER], found[:, ASSISTANT] = (np.minimum(found[:, q], turned[:, q]) for q in (USER, ASSISTANT))
            for q in (START, SYSTEM):
                found[:, q] = np.minimum(found[:, q], np.where(closed[:, q], found[:, USER] + INSERT, INF))
            least[at] = found
        return least

    def rank(self) -> None:
        """Ranks of all nodes by their least audit, and pointers 1, 2, 4 ... letters on."""
        slots = len(self.least)
        step = np.array([1, 0, 1, 1])                           # an insertion stays at its row
        target = (np.arange(slots)[:, None, None] + step) * 4 + self.to
        target = np.minimum(target, slots * 4 - 1).reshape(-1, 4)
        total = self.cost.reshape(-1, 4) + self.least.ravel()[target]
        best = (total == self.least.reshape(-1, 1)) & (total < INF)
        goes = best.any(1)
        node = np.arange(slots * 4)

        def pick(rank: np.ndarray) -> np.ndarray:
            """The arc whose letter and target rank come first."""
            key = np.arange(4) * (int(rank.max(initial=0)) + 1) + rank[target]
            return np.argmin(np.where(best, key, np.iinfo(np.int64).max), 1)

        letter = pick(np.zeros(slots * 4, np.int64))
        rank = np.where(goes, letter + 1, 0)
        pointer = np.where(goes, target[node, letter], node)
        self.pointers, self.length = [pointer], goes.astype(np.int64)
        while True:
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[pointer], return_inverse=True)
            self.length = self.length + self.length[pointer]
            further = pointer[pointer]
            if (further == pointer).all():
                break
            pointer = further
            self.pointers.append(pointer)
        self.letter = pick(rank)
        self.pointers[0] = np.where(goes, target[node, self.letter], node)

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length of each one's path, its nodes in a row, the nodes after each) from
        the entry states, by the pointers whose powers of two make up the step."""
        start = self.first * 4 + entry
        size = self.length[start]
        steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        node = np.repeat(start, size)
        for k, pointer in enumerate(self.pointers):
            node = np.where(steps >> k & 1 == 1, pointer[node], node)
        return size, node, self.pointers[0][node]

    def exits(self) -> np.ndarray:
        """(conversations, 4): the state at the end when entered with each state."""
        return self.pointers[-1][(self.first[:, None] * 4 + np.arange(4))] % 4


def _initials(roles) -> np.ndarray:
    code = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    return np.array([code.get(r[:1], 0) for r in roles], np.int64)


def _solved(frame: pd.DataFrame, lens: np.ndarray, entry: np.ndarray, ends: np.ndarray, last: np.ndarray,
            before: list[str], texts: list[str], duplicate: np.ndarray) -> pd.DataFrame:
    """Per conversation or piece: counts, cost, audit and repaired turns. ``frame`` holds
    the rows in order, ``before`` the role initial ahead of each one's first row."""
    roles = frame["role"].tolist()
    initial = _initials(roles)
    blank = frame["blank"].to_numpy(bool)
    duplicate = duplicate & ~blank
    cut = frame["cut"].to_numpy(bool) & ~blank & ~duplicate
    graph = Graph(lens, initial, blank | duplicate, cut, ends, last)
    graph.rank()
    size, node, then = graph.paths(entry)
    letters = graph.letter[node]
    audit = "".join(np.array(list(LETTERS))[letters])
    row = graph.row[node // 4]
    new = [NAMES.get(s) for s in (then % 4).tolist()]
    out = {c: [] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "texts")}
    stops, steps = np.cumsum(lens), np.cumsum(size)
    for k, (r, n, s, m) in enumerate(zip(stops.tolist(), lens.tolist(), steps.tolist(), size.tolist())):
        heads = ([before[k]] if before[k] is not None else []) + [x[:1] for x in roles[r - n : r]]
        out["illegal"].append(sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])))
        for name, flag in (("blank", blank), ("duplicate", duplicate), ("truncated", cut)):
            out[name].append(int(flag[r - n : r].sum()))
        out["cost"].append(int(graph.least[graph.first[k], entry[k]]))
        out["audit"].append(audit[s - m : s])
        said = [(roles[row[i]] if letters[i] == 2 else new[i], "" if letters[i] == 1 else texts[row[i]]) for i in range(s - m, s) if letters[i]]
        out["roles"].append([a for a, _ in said])
        out["texts"].append([b for _, b in said])
    return pd.DataFrame(out)


def _short(frame: pd.DataFrame) -> pd.DataFrame:
    """All conversations of a bucket."""
    frame = frame.sort_values(["cn", "ck", "tn", "turn", "role", "text"], ascending=[True, True, False, True, True, True], kind="stable")
    keys = frame[["cn", "ck"]].drop_duplicates()
    conv = frame.groupby(["cn", "ck"], sort=False).ngroup().to_numpy()
    kept = frame["kept"].to_numpy(bool)
    rows, conv = frame[kept], conv[kept]
    lens = np.bincount(conv, minlength=len(keys))
    gaps = np.zeros(len(keys), np.int64)
    known = ~rows["tn"].to_numpy(bool)
    for c, turns in rows["turn"][known].groupby(conv[known]):
        gaps[c] = min(int(turns.max()) - int(turns.min()) + 1 - turns.nunique(), (1 << 63) - 1)
    again = pd.DataFrame({"c": conv, "r": rows["role"].to_numpy(), "t": rows["text"].to_numpy()}).duplicated().to_numpy()
    n = len(keys)
    done = _solved(rows, lens, np.zeros(n, np.int64), np.tile(END, (n, 1)), np.ones(n, bool), [None] * n, rows["text"].tolist(), again)
    done.insert(0, "cn", keys["cn"].to_numpy())
    done.insert(1, "ck", keys["ck"].to_numpy())
    done.insert(2, "piece", 0)
    done.insert(3, "gaps", gaps)
    return done


def _piece_graph(frame: pd.DataFrame, ends: np.ndarray) -> Graph:
    must = frame["must"].to_numpy(bool)
    return Graph(np.array([len(frame)]), _initials(frame["role"]), must, frame["cut"].to_numpy(bool) & ~must, ends[None, :], np.zeros(1, bool))


def _matrix(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Costs from each state before the piece (row) to each state behind it."""
    frame = frame.sort_values("pos")
    cost = [_piece_graph(frame, np.where(np.arange(4) == q, 0, INF)).least[0] for q in range(4)]
    return pd.DataFrame({"cn": [key[0]], "ck": [key[1]], "piece": [key[2]], "m": [np.stack(cost, 1).ravel().tolist()],
                         "tail": [frame["role"].iloc[-1][:1]]})


def _exits(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("pos")
    graph = _piece_graph(frame, np.array(frame["ends"].iloc[0]))
    graph.rank()
    return pd.DataFrame({"cn": [key[0]], "ck": [key[1]], "piece": [key[2]], "f": [graph.exits()[0].tolist()]})


def _long(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One piece, entered with a known state, with known costs behind it."""
    frame = frame.sort_values("pos")
    head = frame.iloc[0]
    done = _solved(frame, np.array([len(frame)]), np.array([head["entry"]]), np.array([head["ends"]]), np.array([bool(head["final"])]),
                   [head["before"]], frame["text"].tolist(), frame["again"].to_numpy(bool))
    for at, (name, value) in enumerate((("cn", key[0]), ("ck", key[1]), ("piece", key[2]), ("gaps", 0))):
        done.insert(at, name, value)
    return done


def _scan(table: DataFrame, column: str, join, ahead: bool, pieces: int) -> DataFrame:
    """``column`` of every piece combined with those of all pieces behind it (or before it), by doubling joins."""
    step = 1
    while step < pieces:
        other = table.select("cn", "ck", (F.col("piece") + (-step if ahead else step)).alias("piece"), F.col(column).alias("_other"))
        both = table.join(other, ["cn", "ck", "piece"], "left")
        table = written(both.withColumn(column, F.when(F.col("_other").isNull(), F.col(column)).otherwise(join(F.col(column), F.col("_other")))).drop("_other"),
                        "repair-scan")
        step *= 2
    return table


def _product(a: Column, b: Column) -> Column:
    """(min, +) product of two 4 x 4 matrices."""
    return F.array(*[F.least(*[a[4 * i + k] + b[4 * k + j] for k in range(4)], F.lit(INF)) for i in range(4) for j in range(4)])


def _long_pieces(rows: DataFrame, piece: int) -> DataFrame:
    """The pieces of conversations that are too long for one task."""
    key = ["cn", "ck"]
    rows = rows.where("kept").withColumn("tie", F.monotonically_increasing_id())
    rows = dense_index(rows, ["cn", "ck", F.col("tn").desc(), "turn", "role", "text", "tie"])
    h1, h2 = hash_pair("role", "text")
    rows = written(rows.withColumn("h1", h1).withColumn("h2", h2).drop("tie"), "repair-long")
    about = rows.groupBy(*key).agg(F.min("idx").alias("start"), F.max("idx").alias("stop"), F.max(F.when(~F.col("tn"), F.col("turn"))).alias("hi"),
                                   F.min(F.when(~F.col("tn"), F.col("turn"))).alias("lo"), F.count_distinct(F.when(~F.col("tn"), F.col("turn"))).alias("d"))
    gaps = F.coalesce(F.least(F.col("hi").cast("decimal(38)") - F.col("lo") + 1 - F.col("d"), F.lit((1 << 63) - 1)).cast("long"), F.lit(0))
    about = written(about.select(*key, "start", F.floor((F.col("stop") - F.col("start")) / piece).alias("end"), gaps.alias("gap")), "repair-about")
    seen = rows.groupBy(*key, "h1", "h2").agg(F.min("idx").alias("seen"))
    rows = hot_split_join(rows, written(seen, "repair-seen"), [*key, "h1", "h2"]).join(broadcast_if_small(about), key)
    pos = F.col("idx") - F.col("start")
    again = F.col("idx") > F.col("seen")
    rows = written(rows.select(*key, "role", "text", "blank", "cut", again.alias("again"), (F.col("blank") | again).alias("must"),
                               pos.alias("pos"), F.floor(pos / piece).alias("piece"), F.col("end"), F.col("gap")), "repair-rows")
    narrow = rows.select(*key, "piece", "pos", "role", "must", "cut")
    matrices = written(narrow.groupBy(*key, "piece").applyInPandas(_matrix, "cn boolean, ck string, piece long, m array<long>, tail string"), "repair-matrices")
    pieces = int(about.agg(F.max("end")).first()[0]) + 1
    behind = _scan(matrices, "m", _product, True, pieces)
    close = [0, 2 * INSERT, INSERT, 0]                          # the end's costs with what may be inserted there
    ends = F.array(*[F.least(*[F.col("m")[4 * i + j] + close[j] for j in range(4)], F.lit(INF)) for i in range(4)])
    ends = behind.select(*key, (F.col("piece") - 1).alias("piece"), ends.alias("ends"))
    known = matrices.select(*key, "piece").join(ends, [*key, "piece"], "left")
    tails = matrices.select(*key, (F.col("piece") + 1).alias("piece"), F.col("tail").alias("before"))
    known = written(known.join(tails, [*key, "piece"], "left").select(
        *key, "piece", "before", F.col("ends").isNull().alias("final"), F.coalesce("ends", F.array(*[F.lit(c) for c in close])).alias("ends")), "repair-known")
    maps = narrow.join(known.select(*key, "piece", "ends"), [*key, "piece"]).groupBy(*key, "piece").applyInPandas(
        _exits, "cn boolean, ck string, piece long, f array<int>")
    # the map of all pieces up to one: the later map applied to what the earlier one gives
    upto = _scan(written(maps, "repair-maps"), "f", lambda later, earlier: F.transform(earlier, lambda q: later[q]), False, pieces)
    entry = upto.select(*key, (F.col("piece") + 1).alias("piece"), F.col("f")[0].alias("entry"))
    known = known.join(entry, [*key, "piece"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    done = rows.join(known, [*key, "piece"]).groupBy(*key, "piece").applyInPandas(_long, RESULT)
    return done.drop("gaps").join(broadcast_if_small(about.select(*key, F.col("gap").alias("gaps"))), key)


def repaired(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(cn, ck, piece, gaps, blank, duplicate, truncated, illegal, cost, audit, roles,
    texts): the repaired turns of every conversation of ``rows`` (conv, turn, role,
    text, kept), whole or in pieces of ``piece`` rows.

    ck is the conversation's id as text, cn tells a null one. Rows are taken by
    turn, null turns first, then by role and text; equal rows are later
    copies of the first. Rows not ``kept`` only name their conversation. Null roles
    and texts are one space. A piece's cost includes all pieces behind it. Texts may be of any length; a
    table without rows gives none.
    """
    body = F.rtrim("text", F.lit(BLANKS))
    base = rows.select(F.col("conv").isNull().alias("cn"), F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("ck"),
                       F.col("turn").isNull().alias("tn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "kept")
    base = base.withColumn("blank", body == "").withColumn("cut", ~F.substring(body, -1, 1).isin(".", "!", "?"))
    sizes = written(base.groupBy("cn", "ck").agg(F.count_if("kept").alias("m"), F.sum(F.octet_length("text").cast("long")).alias("bytes")), "repair-sizes")
    all_rows, size = sizes.agg(F.sum("m"), F.sum("bytes")).first()
    buckets = max(-(-(all_rows or 0) // piece), -(-(size or 0) // BUCKET_BYTES), 1)
    long = sizes.where(F.col("m") > piece).select("cn", "ck")
    some = not long.isEmpty()
    if some:
        long = broadcast_if_small(written(long, "repair-long-keys"))
    short = base.join(long, ["cn", "ck"], "left_anti") if some else base
    bucket = F.pmod(F.xxhash64("cn", "ck"), F.lit(buckets))
    done = short.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_short, RESULT)
    return done.unionByName(_long_pieces(base.join(long, ["cn", "ck"], "left_semi"), piece)) if some else done


def repair_report(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of every conversation of ``rows``. Pieces of long ones are put together:
    the audit and the hashed text are one value of a conversation."""
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    pieces = repaired(rows, piece).withColumn("said", F.when(F.size("roles") > 0, said))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("piece", c))), lambda x: x[c])
    whole = pieces.groupBy("cn", "ck").agg(
        F.max("gaps").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.max(F.when(F.col("piece") == 0, F.col("cost"))).alias("cost"), F.array_join(ordered("audit"), "").alias("audit"),
        F.sha2(F.array_join(ordered("said"), "\n"), 256).alias("repaired_sha256"))
    kind = rows.schema["conv"].dataType
    return whole.select(F.when(~F.col("cn"), F.col("ck")).cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal",
                        "cost", "audit", "repaired_sha256")
