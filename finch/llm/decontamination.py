"""Benchmark decontamination: rare n-gram seeds joined to test items, then Smith-Waterman.

Seeds are the 3-grams of a test item and its gapped pairs of word pairs (``a b . d e``), so a copy with every
third word changed still holds some. One scan of the corpus finds where seeds stand; how often each stands
in the corpus is its rarity. Seeds and items are then joined: the seeds of a document that
agree with an item on nearby diagonals are one place, and its rarest seed speaks for it. A place is passed over only if it has a
single seed which stands more than ``RARE`` times in the corpus; any other place is aligned,
however many documents share it. The words of such places meet their items in a second join, those that
hold too few of the item's words to reach the score at all are left out (which loses nothing), and the rest are aligned locally. The
score is the alignment's share of a perfect match.

Seed hashes are broadcast in passes of a bounded number; everything that grows with the corpus or
the benchmark is joined, with the commonest keys split off. An item of any length is aligned in pieces of bounded
length, so neither a long document, a common passage, nor a seed that many items share gathers in one task.
Items of fewer than ``LEAST_WORDS`` words are no evidence and are passed over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .common import hashed_words, hot_split_join, mix, slices, written

SEED = 3                        # words of a seed
LEAST_WORDS = 6                 # of an item
RARE = 20                       # occurrences of a seed that speaks for a place alone
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE = 0.5                     # least share of the perfect score
PIECE, STRIDE = 64, 48          # longer items are aligned by overlapping pieces of so many words
PAD = 8                         # document words that a window holds beyond each end of the piece
BAND = 128                      # diagonals of a place, at most (and PAD more)
MAX_SEEDS = 2 << 20             # seeds a broadcast may hold: 16 MB
CLASSES = 1 << 20               # hash classes of the documents with places, broadcast to spare the others the shuffle


def normalise(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    words = [w.strip(".,;:!?()[]{}\"'`*_#<>|/\\\\") for w in text.lower().split()] if text else []
    return [w for w in words if w]


def seeds_of(words: np.ndarray, lens: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of all seeds of the word lists in a row."""
    ends = np.cumsum(lens)
    room = np.repeat(ends, lens) - np.arange(len(words))            # words from each position to its list's end
    found = []
    whole, spread = tuple(range(seed)), (0, 1, 3, 4)
    for kind, offsets in enumerate((whole, spread), 1):
        at = np.flatnonzero(room > offsets[-1])
        h = np.full(len(at), kind, np.uint64)
        for o in offsets:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at + o])
        found.append((h, at))
    return np.concatenate([h for h, _ in found]), np.concatenate([at for _, at in found])


def pieces(items: DataFrame, id_col: str, text_col: str, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(item, words array<long>, seeds array<struct<seed, at>>): word hashes and seeds of every
    item of ``least_words`` or more, in pieces."""
    kind = items.schema[id_col].dataType.simpleString()

    def cut(batches):
        for frame in batches:
            rows = []
            for item, text in zip(frame["item"], frame["text"]):
                words, _ = hashed_words([normalise(text)])
                for a in range(0, max(1, len(words) - (PIECE - STRIDE)), STRIDE) if len(words) >= least_words else ():
                    part = words[a : a + PIECE]
                    h, at = seeds_of(part, np.array([len(part)]), seed)
                    rows.append((item, part.view(np.int64), h.view(np.int64), at))
            yield pd.DataFrame(rows, columns=["item", "words", "seed", "at"])

    found = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        cut, f"item {kind}, words array<long>, seed array<long>, at array<int>")
    return found.select("item", "words", F.arrays_zip("seed", "at").alias("seeds"))


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences (linear gaps)."""
    out = np.zeros(len(items), np.int32)
    order = np.argsort([len(w) for w in windows], kind="stable")
    for a in range(0, len(order), 2048):
        at = order[a : a + 2048]
        n, m = max(len(items[k]) for k in at), max(len(windows[k]) for k in at)
        x, y = np.zeros((len(at), n), np.uint64), np.ones((len(at), m), np.uint64)      # 0 and 1 match nothing
        for r, k in enumerate(at):
            x[r, : len(items[k])], y[r, : len(windows[k])] = items[k], windows[k]
        slope = -GAP * np.arange(m + 1, dtype=np.int32)
        h = np.zeros((len(at), m + 1), np.int32)
        best = np.zeros(len(at), np.int32)
        for i in range(n):
            new = np.maximum(h + GAP, 0)
            np.maximum(new[:, 1:], h[:, :-1] + np.where(x[:, i, None] == y, MATCH, MISMATCH), out=new[:, 1:])
            # gaps along the window: the best of h[k] + GAP * (j - k) over k <= j
            h = np.maximum.accumulate(new + slope, 1) - slope
            np.maximum(best, h.max(1), out=best)
        out[at] = best
    return out


def _tagged(words: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tag, key) of the words of each range: its number, and a hash of that and the word."""
    sizes = stop - begin
    tag = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(tag)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[tag]
    return tag, mix(words[at] + tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hits(docs: DataFrame, seeds: np.ndarray, seed: int) -> DataFrame:
    """(row, h, seed, pos): where documents hold one of the (sorted) seed hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def scan(batches):
        for frame in batches:
            texts, rows, hs = frame["text"].tolist(), frame["row"].to_numpy(), frame["h"].to_numpy()
            for a, b in slices(texts):
                words, lens = hashed_words([normalise(t) for t in texts[a:b]])
                h, at = seeds_of(words, lens, seed)
                lo = np.minimum(np.searchsorted(shared.value, h), len(shared.value) - 1)
                hit = np.flatnonzero(shared.value[lo] == h)
                doc = np.repeat(np.arange(len(lens)), lens)[at[hit]]
                start = (np.cumsum(lens) - lens)[doc]
                yield pd.DataFrame({"row": rows[a:b][doc], "h": hs[a:b][doc], "seed": h[hit].view(np.int64), "pos": (at[hit] - start).astype(np.int32)})

    return docs.select("row", "h", "text").mapInPandas(scan, "row long, h long, seed long, pos int")


def places(rows: DataFrame, parts: DataFrame, seed: int = SEED, rare: int = RARE) -> DataFrame:
    """(row, h, pid, low, high): where documents (row, h, text) may hold a piece (pid,
    words, seeds), by the diagonals of its seeds."""
    spark = rows.sparkSession
    each = parts.select("pid", F.explode("seeds").alias("s")).select("pid", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
    holders = written(each.groupBy("seed").agg(F.collect_list(F.struct("pid", "at")).alias("held")), "leak-seeds")
    passes = -(-holders.count() // MAX_SEEDS)
    path = scratch_path(spark, "leak-hits")
    spark.createDataFrame([], "row long, h long, seed long, pos int").write.parquet(path)
    for k in range(passes):
        some = holders.select("seed").where(F.pmod(F.xxhash64("seed"), F.lit(passes)) == k).toPandas()["seed"].to_numpy(np.int64)
        if len(some):                                       # about MAX_SEEDS numbers a pass
            _hits(rows, np.sort(some.view(np.uint64)), seed).write.mode("append").parquet(path)
    hits = spark.read.parquet(path)
    counts = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    holders = written(holders.join(counts, "seed"), "leak-holders")
    pairs = hot_split_join(hits, holders, ["seed"]).select("row", "h", "seed", "n", "pos", F.inline("held"))
    diagonal = F.col("pos") - F.col("at")
    band = F.floor(diagonal / BAND)
    # seeds near a border count on both sides of it
    bands = F.when(F.pmod(diagonal, F.lit(BAND)) < PAD, F.array(band, band - 1)).otherwise(F.array(band))
    pairs = pairs.select("row", "h", "seed", "n", "pid", diagonal.alias("d"), F.explode(bands).alias("band"))
    found = pairs.groupBy("row", "h", "pid", "band").agg(F.min("n").alias("n"), F.min("seed").alias("a"), F.max("seed").alias("b"),
                                                         F.min("d").alias("low"), F.max("d").alias("high"))
    return found.where((F.col("a") != F.col("b")) | (F.col("n") <= rare)).select("row", "h", "pid", "low", "high")


def _windows(frames):
    """The words around each place of a document, with the place's piece."""
    for frame in frames:
        for a, b in slices(frame["text"].tolist()):
            cut = frame.iloc[a:b]
            words, lens = hashed_words([normalise(t) for t in cut["text"]])
            out = []
            for row, h, at, first, n in zip(cut["row"], cut["h"], cut["at"], np.cumsum(lens) - lens, lens):
                for x in at:
                    lo, hi = max(0, x["low"] - PAD), min(n, x["high"] + PIECE + PAD)
                    if lo < hi:
                        out.append((row, h, x["pid"], words[first + lo : first + hi].tobytes()))
            yield pd.DataFrame(out, columns=["row", "h", "pid", "window"])


def _aligned(least: float):
    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            items = [np.asarray(x, np.int64).view(np.uint64) for x in frame["words"]]
            windows = [np.frombuffer(x, np.uint64) for x in frame["window"]]
            size = np.array([len(x) for x in items])
            stop, stop_w = np.cumsum(size), np.cumsum([len(x) for x in windows])
            # an alignment matches no more words than the item has in the window
            tag, held = _tagged(np.concatenate(items), stop - size, stop)
            there = _tagged(np.concatenate(windows), stop_w - np.array([len(x) for x in windows]), stop_w)[1]
            most = np.bincount(tag, np.isin(held, there), len(items))
            at = np.flatnonzero(most >= least * size)
            got = align([items[k] for k in at], [windows[k] for k in at]) if len(at) else np.empty(0)
            share = got / (MATCH * size[at].astype(float))
            at, share = at[share >= least], share[share >= least]
            yield pd.DataFrame({"row": frame["row"].to_numpy()[at], "h": frame["h"].to_numpy()[at], "item": frame["item"].to_numpy()[at], "score": share})
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", seed: int = SEED, least: float = SCORE,
                 least_words: int = LEAST_WORDS, rare: int = RARE) -> DataFrame:
    """(id, h, item, score): every document that holds an item, or a piece of a
    long item, with an alignment score of ``least`` or more; the best score of each.

    ``h`` is the text's hash. Null or empty texts and items hold nothing. Repeated
    documents and repeated items count once.
    """
    kind = benchmark.schema[item_col].dataType.simpleString()
    parts = pieces(benchmark, item_col, item_text, least_words, seed).withColumn("pid", F.monotonically_increasing_id())
    parts = written(parts, "leak-pieces")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).where("text is not null")
    rows = rows.withColumn("row", F.xxhash64("id", "h"))
    found = places(rows, parts, seed, rare).groupBy("row", "h").agg(F.collect_list(F.struct("pid", "low", "high")).alias("at"))
    found = written(found, "leak-places")
    in_class = F.pmod(F.col("row"), F.lit(CLASSES)).cast("int")
    wanted = F.broadcast(found.select(in_class.alias("class")).distinct())
    held = rows.withColumn("class", in_class).join(wanted, "class", "left_semi").drop("class")
    texts = held.select("row", "h", "text").join(found, ["row", "h"]).dropDuplicates(["row", "h"])
    windows = written(texts.mapInPandas(_windows, "row long, h long, pid long, window binary"), "leak-windows")
    pairs = hot_split_join(windows, parts.select("pid", "item", "words"), ["pid"]).select("row", "h", "item", "words", "window")
    scored = pairs.mapInPandas(_aligned(least), f"row long, h long, item {kind}, score double")
    best = written(scored.groupBy("row", "h", "item").agg(F.max("score").alias("score")), "leak-scores")
    return best.join(rows.join(best.select("row", "h").distinct(), ["row", "h"], "left_semi").select("row", "h", "id").distinct(), ["row", "h"]).select("id", "h", "item", "score")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    row = F.xxhash64("id", "h").alias("row")
    found = contaminated(docs, benchmark, id_col, text_col, **how).select(row, "h").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))
    packed = packed.select("all", F.col(f"all.`{id_col}`").alias("id"), F.xxhash64(F.col(f"all.`{text_col}`").cast("string")).alias("h"))
    return packed.select("all", row, "h").join(found, ["row", "h"], "left_anti").select("all.*")
