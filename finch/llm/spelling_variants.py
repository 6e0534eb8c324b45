"""Spelling variants of a vocabulary by search schemes over a bidirectional FM-index.

Two words one edit apart agree on the first or on the second half of either of
them. So a word is sent to the buckets of its halves, where it meets the words
that begin or end alike, and each bucket builds a bidirectional FM-index over its
delimited words: a Burrows-Wheeler transform of the words and one of the reversed
words, both as wavelet matrices. One search scheme matches the delimiter and the
first half exactly and goes right, the other matches the second half and the
delimiter and goes left; both keep the suffix-rank interval of the matched part in
either direction and allow one replaced, added or left-out character in the half
that is still to come. An interval that has both delimiters is one word.

Buckets hold a bounded number of characters. A half that is shared by more is dealt
over several buckets: each holds a part of its words, and all are searched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import broadcast_if_small
from .common import written

# Characters of delimited words in one index.
BUCKET_CHARS = 1 << 20
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 199                    # one run in so many loses a code point
LEAST_LENGTH, LEAST_COUNT = 6, 5
DOMINANCE = 5                   # a form occurs at least so many times as often as its variant


class Wavelet:
    """Wavelet matrix of a symbol sequence: extends backward-search intervals."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.width, self.ones, self.zeros, cur = width, [], [], symbols
        for bit in range(width - 1, -1, -1):
            b = cur >> bit & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b)]).astype(np.int32))
            self.zeros.append(int(len(b) - self.ones[-1][-1]))
            cur = np.concatenate([cur[b == 0], cur[b == 1]])
        counts = np.bincount(symbols, minlength=1 << width)
        self.first = np.cumsum(counts) - counts                 # rank of the first suffix with a symbol
        self.leaf = np.zeros(1 << width, np.int64)
        self.leaf[cur[::-1]] = np.arange(len(cur) - 1, -1, -1)  # place of the symbol's first copy at the last level

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray):
        """(lo, hi, smaller) of the intervals with ``c`` put before the pattern;
        smaller: how many of the old interval have a lesser symbol there."""
        smaller = np.zeros(len(lo), np.int64)
        for level in range(self.width):
            ones, z = self.ones[level], self.zeros[level]
            one = c >> (self.width - 1 - level) & 1 == 1
            a, b = ones[lo], ones[hi]
            smaller += np.where(one, (hi - lo) - (b - a), 0)
            lo, hi = np.where(one, z + a, lo - a), np.where(one, z + b, hi - b)
        shift = self.first[c] - self.leaf[c]
        return lo + shift, hi + shift, smaller

    def branch(self, lo: np.ndarray, hi: np.ndarray):
        """(state, symbol, lo, hi, smaller) of every symbol found before each interval."""
        state, sym = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        smaller = np.zeros(len(lo), np.int64)
        for ones, z in zip(self.ones, self.zeros):
            a, b = ones[lo], ones[hi]
            zero = (hi - lo) - (b - a)
            left, right = zero > 0, b > a
            state = np.concatenate([state[left], state[right]])
            sym = np.concatenate([sym[left] * 2, sym[right] * 2 + 1])
            smaller = np.concatenate([smaller[left], (smaller + zero)[right]])
            lo, hi = np.concatenate([(lo - a)[left], (z + a)[right]]), np.concatenate([(hi - b)[left], (z + b)[right]])
        shift = self.first[sym] - self.leaf[sym]
        return state, sym, lo + shift, hi + shift, smaller


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each word starts (one more at the end)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(lens)])


def _transform(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of ``$w0$w1$...$``, words sorted, ``$`` = 0.

    Suffixes are ranked by prefix doubling. The delimiters count as distinct, the
    last one least and the others in the order of the words they open: the order of
    the whole (cyclic) suffixes, as words are distinct and sorted. So the longest
    word bounds the rounds, and the delimiter of rank j + 1 opens word j.
    """
    n, words = len(codes) + len(starts), len(starts) - 1
    opens = starts + np.arange(words + 1)                       # places of the delimiters
    text = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[opens] = False
    text[inside] = codes
    rank = text + words
    rank[opens] = np.append(np.arange(1, words + 1), 0)
    step = 1
    while True:
        far = np.zeros(n, np.int64)
        far[: n - step] = rank[step:] + 1
        key = rank * (max(n, int(rank.max()) + 1) + 2) + far
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = new, step * 2
        if new[order[-1]] == n - 1:
            return text[order - 1]


class Index:
    """Bidirectional FM-index of distinct words."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        letters = sorted(set("".join(words)))
        self.width = max(1, int(len(letters)).bit_length())
        self.letters = np.array([ord(c) for c in letters], np.int64)
        self.left = Wavelet(self._bwt(self.words), self.width)                          # puts a symbol before
        self.right = Wavelet(self._bwt(sorted(w[::-1] for w in words)), self.width)     # puts a symbol behind

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words as symbols, one more than any in the index for unknown letters."""
        points, starts = _flat(words)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, -1), starts

    def _bwt(self, words: list[str]) -> np.ndarray:
        return _transform(*self.coded(words))

    def near(self, words: list[str], rightward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): word i of ``words`` and word j of the index are one edit apart, the
        edit behind the first half of word i (``rightward``) or before the second."""
        asked = words if rightward else [w[::-1] for w in words]
        codes, starts = self.coded(asked)
        codes = np.append(codes, 0)
        lens = np.diff(starts)
        exact_len = lens // 2 if rightward else lens - lens // 2
        way = self.right if rightward else self.left

        def symbol(i, p):
            return np.where(p < lens[i], codes[np.minimum(starts[i] + p, len(codes) - 1)], 0)

        def go(i, p, lo, size, back):
            """States (word, interval, its size, interval in the other direction) one exact symbol on."""
            c = symbol(i, p)
            ok = c >= 0
            i, c, lo, size, back = i[ok], c[ok], lo[ok], size[ok], back[ok]
            a, b, smaller = way.extend(lo, lo + size, c)
            ok = b > a
            return i[ok], a[ok], (b - a)[ok], (back + smaller)[ok]

        every = np.arange(len(words))
        none = (np.empty(0, np.int64),) * 4
        clean = (every, np.zeros(len(words), np.int64), np.full(len(words), len(self.words) + 1), np.zeros(len(words), np.int64))
        edited, found = none, []
        for p in range(int(lens.max(initial=0)) + 1):
            i, lo, size, back = clean
            here = p >= exact_len[i]
            late = tuple(x[here] for x in clean)
            nexts, follow = [], [go(i[~here], p, lo[~here], size[~here], back[~here])]
            if len(late[0]):
                i, lo, size, back = late
                state, sym, a, b, smaller = way.branch(lo, lo + size)
                child = i[state], a, b - a, back[state] + smaller
                want = symbol(child[0], p)
                follow.append(tuple(x[(sym == want) & (want > 0)] for x in child))
                other = (sym != want) & (sym > 0)
                nexts.append(tuple(x[other & (want != 0)] for x in child))              # replaced
                edited = tuple(np.concatenate(x) for x in zip(edited, (x[other] for x in child)))  # added before p
                want = symbol(i, p)
                gone = (want != 0) & (want != symbol(i, p + 1))                         # left out: the last of a run stands for all
                nexts.append(tuple(x[gone] for x in late))
            done = lens[edited[0]] == p
            i, lo, size, back = go(*((x[done] for x in edited[:1])), p, *(x[done] for x in edited[1:]))
            found.append((i, back if rightward else lo))
            going = go(edited[0][~done], p, *(x[~done] for x in edited[1:]))
            edited = tuple(np.concatenate(x) for x in zip(going, *nexts)) if nexts else going
            clean = tuple(np.concatenate(x) for x in zip(*follow))
        i, j = (np.concatenate(x) for x in zip(*found))
        return i[j > 0], j[j > 0] - 1                           # rank 0: both delimiters at the ends, no word


def _search(frame: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n) within one bucket: rows (word, n, side, asks, own)."""
    own = frame[frame["own"]].drop_duplicates("word")
    found: set[tuple[str, str]] = set()
    count = dict(zip(own["word"], own["n"]))
    index = Index(list(count)) if count else None
    for side in (False, True) if count else ():
        asked = frame.loc[frame["asks"] & (frame["side"] == side), "word"].unique().tolist()
        if asked:
            i, j = index.near(asked, side)
            found.update((asked[a], index.words[b]) for a, b in zip(i.tolist(), j.tolist()))
    word, near = zip(*found) if found else ((), ())
    return pd.DataFrame({"word": pd.Series(word, dtype=object), "near": pd.Series(near, dtype=object),
                         "near_n": np.array([count[w] for w in near], np.int64)})


def near_words(vocabulary: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(word, near, near_n): every pair of rows of ``vocabulary`` (word, n; distinct,
    not null, one code point at least) whose words differ by one edit, both ways.
    Meant for a stored table: it is read three times."""
    length = F.length("word")
    routes = []
    for side, rest in ((True, lambda l: F.floor(l / 2)), (False, lambda l: l - F.floor(l / 2))):
        sizes = F.array_distinct(F.array(*[rest(length + d).cast("int") for d in (-1, 0, 1)]))
        routes.append(F.transform(sizes, lambda s: F.struct(
            F.lit(side).alias("side"), (s == rest(length).cast("int")).alias("asks"),
            F.xxhash64(F.lit(side), F.col("word").substr(F.lit(1) if side else length - s + 1, s)).alias("half"))))
    routed = vocabulary.select("word", "n", F.inline(F.concat(*routes)))
    weight = F.sum(length + 1)
    packs = int((routed.agg(weight).first()[0] or 0) // bucket_chars) + 1
    wide = routed.groupBy("half").agg(weight.alias("w")).where(F.col("w") > bucket_chars).select(
        "half", F.ceil(F.col("w") / bucket_chars).cast("int").alias("blocks"))
    wide = broadcast_if_small(written(wide, "wide-halves"))         # at most one for each bucket_chars of input
    routed = routed.join(wide, "half", "left")
    turn = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    block = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(
        F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(turn))
    dealt = routed.withColumn("turn", turn).withColumn("block", F.explode(block)).select(
        "word", "n", "side", "asks", (F.col("block") == F.col("turn")).alias("own"),
        F.when(F.col("blocks").isNull(), F.pmod("half", F.lit(packs))).otherwise(F.xxhash64("half", "block")).alias("pack"))
    found = dealt.groupBy("pack").applyInPandas(_search, "word string, near string, near_n long")
    return found.repartition("word").dropDuplicates(["word", "near", "near_n"])


def damaged_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> Column:
    """(word): the runs of letters of ``docs``, A-Z lower-cased; every ``DAMAGE``-th,
    by the hash of id and run, less one code point. Shorter results are left out.
    A null id is the empty string in the hash."""
    pattern = RUN.replace("+", f"{{{least_length},}}")      # a run that is too short stays so
    runs = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(pattern), F.lit(0))
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % DAMAGE == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    return run.select(word.alias("word")).where(F.length("word") >= least_length)


def group_variants(words: DataFrame, least_count: int = LEAST_COUNT, dominance: int = DOMINANCE,
                   bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words that occur ``least_count`` times
    in ``words`` (word; one row an occurrence).

    ``n_near`` counts the words one edit away. ``form`` is the commonest of them (ties:
    the least in code-point order) if it occurs ``dominance`` times as often as the word,
    ``root`` the last word when forms are followed; as counts grow by ``dominance``
    (more than 1) along the way, it ends. Null and empty words are left out; without words the
    result is empty. A word of any length is one row, and its pieces are bounded by its length.
    """
    vocabulary = words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    vocabulary = written(vocabulary, "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    near = near_words(vocabulary, bucket_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    full = vocabulary.join(near, "word", "left")
    form_n = -F.col("best.m")
    fits = form_n >= dominance * F.col("n")
    full = written(full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(fits, F.col("best.w")).alias("form"), F.when(fits, form_n).alias("form_n")), "variant-forms")
    # pointers double: after k rounds ``to`` is 2^k forms on; only words with a form take part
    hops = full.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        ahead = hops.select(F.col("word").alias("to"), F.col("to").alias("further"))
        moved = written(hops.join(ahead, "to", "left"), "variant-hops")
        hops = moved.select("word", F.coalesce("further", "to").alias("to"))
        if moved.where("further is not null").isEmpty():
            break
    return full.join(hops, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``group_variants`` of the (damaged) runs of all texts; null texts have none."""
    return group_variants(damaged_runs(docs, id_col, text_col), **how)
