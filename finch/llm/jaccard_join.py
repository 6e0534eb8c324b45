"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of word shingles. Equal texts are one class, so copies cost one
row. MinHash bands bring classes into buckets; buckets that share a class form a
candidate component. Inside a component classes are compared block against
block: MinHash values are compared in steps, and a pair is dropped as soon as
the posterior probability that its similarity reaches the threshold (uniform
prior, binomial likelihood of the matches so far) falls below the tolerance.
The rest is verified exactly on the shingle sets. No pair leaves its task: a
class gets its number of links and the least class it is connected with in the
block, and components of the exact links are closed by joins.

Blocks hold a bounded number of classes and bytes, so a component of any size is
spread over tasks; equal texts, hot buckets and hot hosts of edges are counted
map-side or split off.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import hash_pair, hashed_words, hot_split_join, ngram_hashes, slices, written
from .components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4             # misses a pair at 0.8 with a chance of 5e-8
STEP, TOLERANCE = 16, 1e-9
BLOCK_BYTES, BLOCK_CLASSES = 12 << 20, 2048
KEY_CLASSES = 1 << 20
HASHES = BANDS * ROWS


def shingles(texts, n: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted: n words in a row, lower case;
    all words of a shorter text; none without words."""
    words, lens = hashed_words([t.lower().split() if t else [] for t in texts])
    grams, counts = ngram_hashes(words, lens, n)
    ends, gram_ends = np.cumsum(lens), np.cumsum(counts)
    out = []
    for i, (size, count) in enumerate(zip(lens, counts)):
        if count:
            out.append(np.unique(grams[gram_ends[i] - count : gram_ends[i]]))
        elif size:
            own = words[ends[i] - size : ends[i]]
            out.append(ngram_hashes(own, np.array([size]), int(size))[0] ^ np.uint64(size))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, HASHES) uint32; empty sets have all ones."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, HASHES, np.uint64)
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(32), starts)
    return out


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, least matches to go on) by step: with a uniform prior,
    P(similarity >= t | m of n match) is P(Binomial(n + 1, t) <= m)."""
    steps = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = m = 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        steps.append((n, m))
    return steps


def _survivors(a: np.ndarray, b: np.ndarray, steps, same: bool):
    """(i, j) of the pairs that no step drops; i < j in one block."""
    rows = max(1, (1 << 20) // max(1, len(b)))
    for start in range(0, len(a), rows):
        part = a[start : start + rows]
        n, least = steps[0]
        hits = np.zeros((len(part), len(b)), np.uint8)
        for k in range(n):
            hits += part[:, k, None] == b[None, :, k]
        alive = hits >= least
        if same:
            alive &= np.arange(start, start + len(part))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(alive)
        m = hits[i, j].astype(np.int32)
        i += start
        for (prev, _), (n, least) in zip(steps, steps[1:]):
            m = m + (a[i, prev:n] == b[j, prev:n]).sum(1)
            keep = m >= least
            i, j, m = i[keep], j[keep], m[keep]
        if len(i):
            yield i, j


class _Sets:
    """Shingle sets of a block pair, coded densely, for exact intersections."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        uniq, codes, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.width = len(uniq)
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.keys = owner * self.width + codes                    # sorted: owners ascend, sets are sorted
        self.start = np.cumsum(self.size) - self.size
        self.codes = codes
        wanted = np.flatnonzero(df > 1)                           # only these can be shared
        place = np.full(self.width, -1, np.int64)
        place[wanted] = np.arange(len(wanted))
        self.shared = len(wanted)
        own = place[codes] >= 0
        self.dense_owner, self.dense_code = owner[own], place[codes][own]

    def overlaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """|set i & set j| for pairs (i, j)."""
        few, many = np.where(self.size[i] <= self.size[j], i, j), np.where(self.size[i] <= self.size[j], j, i)
        out = np.empty(len(i), np.int64)
        for a in range(0, len(i), 4096):
            f, m = few[a : a + 4096], many[a : a + 4096]
            n = self.size[f]
            at = np.repeat(self.start[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            want = np.repeat(m, n) * self.width + self.codes[at]
            pos = np.searchsorted(self.keys, want)
            pos[pos == len(self.keys)] = 0
            out[a : a + 4096] = np.add.reduceat(self.keys[pos] == want, np.cumsum(n) - n)
        return out

    def matrix(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """All intersections of rows with cols, by matrix products over slabs of codes."""
        out = np.zeros((len(rows), len(cols)), np.float32)
        used = np.zeros(len(self.size), np.int64) - 1
        used[np.union1d(rows, cols)] = np.arange(len(np.union1d(rows, cols)))
        mine = used[self.dense_owner] >= 0
        owner, code = used[self.dense_owner[mine]], self.dense_code[mine]
        codes, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        for a in range(0, len(codes), 2048):
            lo, hi = np.searchsorted(code, [a, a + 2048])
            slab = np.zeros((used.max() + 1, 2048), np.float32)
            slab[owner[lo:hi], code[lo:hi] - a] = 1
            out += slab[used[rows]] @ slab[used[cols]].T
        return out


def _links(sig_a, sig_b, sets: _Sets, shift: int, steps, threshold: float):
    """(i, j) of the exact links; j counts from ``shift`` in the sets."""
    same = shift == 0
    for i, j in _survivors(sig_a, sig_b, steps, same):
        rows, cols = np.unique(i), np.unique(j) + shift
        dense = 2e-11 * len(rows) * len(cols) * min(sets.shared, sets.size[rows].sum()) * 2 + 2e-9 * (len(rows) + len(cols)) * sets.shared
        if len(i) > 2000 and dense < 1e-7 * np.minimum(sets.size[i], sets.size[j + shift]).sum():
            both = sets.matrix(rows, cols)[np.searchsorted(rows, i), np.searchsorted(cols, j + shift)].astype(np.int64)
        else:
            both = sets.overlaps(i, j + shift)
        keep = both / (sets.size[i] + sets.size[j + shift] - both) >= threshold
        yield i[keep], j[keep] + shift


def _compare(threshold: float, tolerance: float):
    steps = least_matches(threshold, tolerance)

    def one(frame: pd.DataFrame, i: int, j: int):
        frame = frame.drop_duplicates("node").sort_values(["block", "node"])
        sig = np.stack([np.frombuffer(x, np.uint16) for x in frame["sig"]])
        sets = _Sets([np.frombuffer(x, np.uint64) for x in frame["shingles"]])
        cut = 0 if i == j else int((frame["block"] == i).sum())
        first, second = (sig, sig) if i == j else (sig[:cut], sig[cut:])
        links, edges = np.zeros(len(frame), np.int64), []
        label = np.arange(len(frame))
        for a, b in _links(first, second, sets, cut, steps, threshold) if len(first) and len(second) else ():
            np.add.at(links, a, 1)
            np.add.at(links, b, 1)
            edges.append((a, b))
        if edges:
            a, b = (np.concatenate(x) for x in zip(*edges))
            while True:
                least = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, least)
                np.minimum.at(new, b, least)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        node = frame["node"].to_numpy()
        keep = links > 0
        return pd.DataFrame({"node": node[keep], "links": links[keep], "root": node[label[keep]]})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [one(x, i, j) for (_, i, j), x in frame.groupby(["comp", "i", "j"], sort=False)]
        return pd.concat(parts) if parts else pd.DataFrame({"node": [], "links": [], "root": []})

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t1, t2 = hash_pair(text)
    return docs.select(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"), text.alias("text"))


def _classes(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, t1, t2, first, copies, n, bands): one row per distinct text, written;
    first is the least (id, t1, t2)."""
    kind = rows.schema["id"].dataType.simpleString()

    def sign(batches):
        for frame in batches:
            for a, b in slices(frame["text"].tolist()):
                cut = frame.iloc[a:b]
                sets = shingles(cut["text"].tolist(), shingle)
                sig = minhashes(sets).reshape(len(sets), BANDS, ROWS).astype(np.uint64)
                h = np.zeros((len(sets), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    h = (h ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                bands = [x.view(np.int64) if len(s) else np.empty(0, np.int64) for x, s in zip(h, sets)]
                yield pd.DataFrame({"id": cut["id"], "t1": cut["t1"], "t2": cut["t2"],
                                    "n": [len(s) for s in sets], "bands": bands})

    signed = rows.mapInPandas(sign, f"id {kind}, t1 long, t2 long, n int, bands array<long>")
    classes = signed.groupBy("t1", "t2").agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("no_id"),
                                             F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    first = F.struct(F.when(~F.col("no_id"), F.col("least")).alias("id"), "t1", "t2")
    return written(classes.select(F.monotonically_increasing_id().alias("node"), "t1", "t2", first.alias("first"), "copies", "n", "bands"),
                   "text-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(t1, t2, first, copies, n_links, group): one row per distinct text; t1, t2
    are the text's hash, first its least (id, t1, t2), n_links the number of
    other distinct texts at or above the threshold, group the least ``first`` of
    all texts connected with it.

    A null text is an empty one; texts without words are linked to no other
    text. A text shorter than a shingle is one shingle. Null ids come first.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    classes = _classes(rows, shingle)
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", "b")
    edges = banded.join(centres, "bucket").select(F.col("node").alias("a"), "b")
    members = connected_components(edges).select("node", F.col("root").alias("comp"))
    members = classes.select("node", "t1", "t2", "n").join(members, "node")
    sizes = members.groupBy("comp").agg(F.sum(F.col("n") * 8 + 300).alias("bytes"), F.count(F.lit(1)).alias("m"))
    sizes = sizes.select("comp", F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("m") / BLOCK_CLASSES)).cast("int").alias("blocks"))
    members = written(hot_split_join(members, sizes, ["comp"]), "jaccard-members")

    # texts of the members: a broadcast of the hash classes of their keys (at most KEY_CLASSES numbers) spares the others the shuffle
    in_class = F.pmod(F.col("t1"), F.lit(KEY_CLASSES)).cast("int")
    wanted = F.broadcast(members.select(in_class.alias("class")).distinct())
    texts = rows.withColumn("class", in_class).join(wanted, "class", "left_semi").select("t1", "t2", "text")
    texts = texts.join(members, ["t1", "t2"]).dropDuplicates(["node"])

    def spell(batches):
        for frame in batches:
            for a, b in slices(frame["text"].tolist()):
                cut = frame.iloc[a:b]
                sets = shingles(cut["text"].tolist(), shingle)
                sig = (minhashes(sets) & np.uint32(0xFFFF)).astype(np.uint16)
                yield pd.DataFrame({"node": cut["node"], "comp": cut["comp"], "blocks": cut["blocks"],
                                    "sig": [x.tobytes() for x in sig], "shingles": [s.tobytes() for s in sets]})

    spelt = texts.select("node", "comp", "blocks", "text").mapInPandas(
        spell, "node long, comp long, blocks int, sig binary, shingles binary")
    packs = max(1, int((members.agg(F.sum(F.col("n") * 8 + 300)).first()[0] or 0) // BLOCK_BYTES) + 1)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = spelt.withColumn("block", block).withColumn("other", other).select(
        "node", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "shingles",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(
            F.xxhash64("comp", F.least("block", "other"), F.greatest("block", "other"))).alias("pack"))
    found = written(dealt.groupBy("pack").applyInPandas(_compare(threshold, tolerance), "node long, links long, root long"), "jaccard-links")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    full = classes.select("node", "t1", "t2", "first", "copies").join(links, "node", "left").join(groups, "node", "left")
    full = written(full.withColumn("root", F.coalesce("root", "node")).fillna(0, ["n_links"]), "jaccard-classes")
    least = full.groupBy("root").agg(F.min("first").alias("group"))
    return hot_split_join(full, least, ["root"]).select("t1", "t2", "first", "copies", "n_links", "group")


def near_duplicate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, text_id, copies, n_links, class_id) of every row: the least id of its
    equal texts and of its group, the copies of its text, and its links to other texts."""
    found = written(near_duplicates(docs, id_col, text_col, **how), "jaccard-result")
    return hot_split_join(_rows(docs, id_col, text_col).select("id", "t1", "t2"), found, ["t1", "t2"]).select(
        F.col("id").alias(id_col), F.col("first.id").alias("text_id"), "copies", "n_links", F.col("group.id").alias("class_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` less all but the first, by (id, text hash), of each
    group; of repeated rows one stays."""
    row = F.xxhash64("id", "t1", "t2").alias("row")         # never null, unlike id
    found = near_duplicates(docs, id_col, text_col, **how).where(F.col("first") == F.col("group"))
    keep = found.select(F.col("first.id").alias("id"), "t1", "t2").select(row, "t1", "t2")
    t1, t2 = hash_pair(F.coalesce(F.col(f"all.`{text_col}`").cast("string"), F.lit("")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))
    packed = packed.select("all", F.col(f"all.`{id_col}`").alias("id"), t1.alias("t1"), t2.alias("t2")).select("all", row, "t1", "t2")
    one = F.row_number().over(Window.partitionBy("row", "t1", "t2").orderBy("t1"))
    return packed.join(keep, ["row", "t1", "t2"], "left_semi").withColumn("rn", one).where("rn = 1").select("all.*")
