"""Language-model scores from a weighted backoff automaton.

Model: word n-grams with Dirichlet-smoothed interpolation,
``p(w|h) = (c(h,w) + mu * p(w|h')) / (c(h) + mu)``, where h' is h less its first
word; the base is add-half over the training vocabulary and one unseen word. As
an automaton: a state for every history that training has seen, an arc for every
n-gram seen, and a failure arc of weight ``mu / (c(h) + mu)`` from each state to
the state of its shortened history. A text is one left-to-right traversal that
carries the state and adds up log-probabilities: at each token it takes the state's arc, or
failure arcs until a state has one.

Spark does the counting and the lookups. Each task packs the texts of its input splits into
buckets of a few MB. Each bucket asks for the counts of its own distinct n-grams: sorted
hashes, one binary block per range of the hash space, with the training counts
that the bucket itself contributes. A task per hash range sums the counts of its
n-grams over all buckets (in 64 bits) and answers every block in the block's own order. Each
bucket then builds the part of the automaton that its texts can reach, from the
answers, and traverses it, all texts side by side (long ones in stretches that begin a
history early). The whole model is never in one place, nothing is
pruned, and a frequent word is one entry per bucket. Hashes have as many bits as the input's size
plus ``SPARE_BITS``: an n-gram shares its hash, and so its counts, with another of the corpus
at a chance below 2^-SPARE_BITS (one in 65,000).

Texts of any length stay whole in a bucket of their own size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import hashed_words, mix, size_slices, slices, written

ORDER, MU = 3, 400.0
BUCKET_BYTES = 6 << 20          # text per bucket
RANGE_BYTES = 12 << 20          # text per range of the hash space
SPARE_BITS = 16
STRETCH = 512                   # tokens that a lane of the traversal reads
END = "\n"                      # no word holds a line feed


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END.encode()]


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, and the tokens of each."""
    hashes, lens = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in slices(texts):
        h, n = hashed_words([words_of(t) for t in texts[a:b]])
        hashes.append(h)
        lens.append(n)
    return np.concatenate(hashes), np.concatenate(lens)


def _grams(words: np.ndarray, lens: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """By order 1..n, the hash of the n-gram that ends at each token, of ``bits``
    bits from order 2 on; tokens with a shorter history in their text have 0."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(lens) - lens, lens)
    out = [mix(words)]
    for n in range(2, order + 1):
        # of the history's code, not its words: histories that share a code share their arcs as well
        prev = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        g = mix(prev * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(n)) >> np.uint64(64 - bits)
        g[place < n - 1] = 0
        out.append(g)
    return out


def _packed(frames):
    """Buckets of about BUCKET_BYTES of the rows of a task, each as one binary value."""
    held, size = [], 0

    def bucket():
        ids = pa.concat_arrays([x.column("doc_id") for x in held])
        table = pa.table({"doc_id": ids, "held_out": pa.concat_arrays([x.column("held_out") for x in held]),
                          "text": pa.concat_arrays([x.column("text").cast(pa.large_string()) for x in held])})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([_zip(sink.getvalue().to_pybytes())], pa.binary())],
                                          names=["bucket", "docs"])

    for batch in frames:
        for a, b in size_slices(pc.binary_length(batch.column("text")).to_pylist(), BUCKET_BYTES):
            cut = batch.slice(a, b - a)
            more = cut.column("text").nbytes
            if held and size + more > BUCKET_BYTES:
                yield bucket()
                held, size = [], 0
            held.append(cut)
            size += more
    if held:
        yield bucket()


def _unpacked(docs: bytes) -> pd.DataFrame:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(docs)).read_all().to_pandas(integer_object_nulls=True)


def _requests(order: int, ranges: int, bits: int):
    def blocks(bucket, docs):
        frame = _unpacked(docs)
        words, lens = _tokens(frame["text"].tolist())
        train = np.repeat(~frame["held_out"].to_numpy(bool), lens)
        rows = []
        for n, grams in enumerate(_grams(words, lens, order, bits), 1):
            uniq, codes = np.unique(grams, return_inverse=True)
            counts = np.bincount(codes, weights=train, minlength=len(uniq)).astype(np.uint64)
            if n > 1:
                counts[uniq == 0] = 0
            width = 64 if n == 1 else bits
            edge = np.searchsorted(uniq, np.array([(r << width) // ranges for r in range(ranges)], np.uint64))
            for r, (a, b) in enumerate(zip(edge, [*edge[1:], len(uniq)])):
                if a < b:
                    rows.append((n, r, _pack(uniq[a:b]), _zip(counts[a:b].tobytes())))
        return pd.DataFrame(rows, columns=["n", "range", "grams", "counts"]).assign(bucket=bucket)

    def run(frames):
        for frame in frames:
            for bucket, docs in zip(frame["bucket"], frame["docs"]):
                yield blocks(bucket, docs)
    return run


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Differences of sorted hashes, by byte planes (high bytes are mostly 0)."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return _zip(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = _unzip(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Training counts over all buckets, in the order of each block."""
    blocks = [_unpack(x) for x in frame["grams"]]
    sizes = [len(b) for b in blocks]
    uniq, codes = np.unique(np.concatenate(blocks), return_inverse=True)
    own = np.concatenate([_unzip(x, np.uint64) for x in frame["counts"]])
    total = np.zeros(len(uniq), np.uint64)
    np.add.at(total, codes, own)
    back = np.split(total[codes], np.cumsum(sizes)[:-1])
    tokens = np.zeros(len(blocks), np.int64)
    types = np.zeros(len(blocks), np.int64)
    tokens[0], types[0] = total.sum(), (total > 0).sum()       # once for the range
    return pd.DataFrame({"n": frame["n"], "range": frame["range"], "bucket": frame["bucket"],
                         "counts": [_zip(x.tobytes()) for x in back], "tokens": tokens, "types": types})


class Automaton:
    """The states and arcs that a bucket's tokens can reach.

    ``state`` numbers the root (0) and the histories seen in training; ``fail`` and
    ``fail_weight`` are each state's failure arc; an arc is found by (state, word) and has a
    log-probability and a target. Words without an arc at the root are unseen.
    """

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray], mu: float, floor: float):
        order = len(grams)
        uniq, first, codes = zip(*(np.unique(g, return_index=True, return_inverse=True) for g in grams))
        codes = [c.astype(np.int32) for c in codes]
        counts = [np.where(u == 0, 0, c) if n else c for n, (u, c) in enumerate(zip(uniq, counts))]
        self.words, self.width = codes[0].astype(np.int64), len(uniq[0])
        del uniq
        state, fail, weight, size = [], [np.zeros(1, np.int64)], [np.zeros(1)], 1
        for n in range(order - 1):              # histories of n + 1 words
            seen = counts[n] > 0
            state.append(np.where(seen, size + np.cumsum(seen) - 1, 0))
            shorter = state[n - 1][codes[n - 1][first[n]]] if n else np.zeros(len(seen), np.int64)
            fail.append(shorter[seen])
            weight.append(np.log10(mu / (counts[n][seen] + mu)))
            size += int(seen.sum())
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(weight)
        prob, keys, logs, targets = None, [], [], []
        for n in range(order):
            last, seen = first[n], counts[n] > 0
            if n == 0:
                prob = (counts[0] + 0.5) / floor
                source = np.zeros(len(seen), np.int64)
            else:
                before = codes[n - 1][np.maximum(last - 1, 0)]          # the n-gram's history, whose count is c(h)
                prob = (counts[n] + mu * prob[codes[n - 1][last]]) / (counts[n - 1][before] + mu)
                source = state[n - 1][before]
                seen = seen & (source > 0)          # by a shared hash a seen n-gram may lack its history
            # behind the longest n-grams the state is that of the last order - 1 words
            target = state[n] if n < order - 1 else state[n - 1][codes[n - 1][last]] if n else np.zeros(len(seen), np.int64)
            keys.append((source * self.width + codes[0][last])[seen])
            logs.append(np.log10(prob[seen]))
            targets.append(target[seen])
        self.arcs = pd.Index(np.concatenate(keys))
        self.logs, self.targets = np.concatenate(logs), np.concatenate(targets)
        self.unseen = np.log10(0.5 / floor)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) of reading a word in each state."""
        logs, then = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left, here = np.arange(len(state)), state
        while len(left):
            arc = self.arcs.get_indexer(here * self.width + word[left])
            hit = arc >= 0
            logs[left[hit]] += self.logs[arc[hit]]
            then[left[hit]] = self.targets[arc[hit]]
            out = ~hit & (here == 0)
            logs[left[out]] += self.unseen
            on = ~hit & (here > 0)
            logs[left[on]] += self.fail_weight[here[on]]
            left, here = left[on], self.fail[here[on]]
        return logs, then

    def traverse(self, lens: np.ndarray, early: int) -> np.ndarray:
        """The log10 probability of each text. Lanes of ``STRETCH`` tokens read side by
        side; one that begins inside a text reads ``early`` tokens more ahead of it, uncounted, which settle its state."""
        pieces = -(-lens // STRETCH)
        text = np.repeat(np.arange(len(lens)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(lens) - lens)[text]
        start, stop = begin + nth * STRETCH, begin + np.minimum((nth + 1) * STRETCH, lens[text])
        place = np.maximum(start - early, begin)
        order = np.argsort(place - stop, kind="stable")                 # longest lanes first
        place, start, stop = place[order], start[order], stop[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order))
        left = len(order)
        while left:
            logs, state[:left] = self.step(state[:left], self.words[place[:left]])
            total[:left] += np.where(place[:left] >= start[:left], logs, 0)
            place[:left] += 1
            while left and place[left - 1] >= stop[left - 1]:
                left -= 1
        return np.bincount(text[order], total, minlength=len(lens))


def _score(order: int, mu: float, bits: int, total: int, types: int):
    def run(key, packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for docs in packed["docs"]:
            docs = _unpacked(docs)
            words, lens = _tokens(docs["text"].tolist())
            grams, counts = _grams(words, lens, order, bits), []
            for n in range(1, order + 1):
                mine = answers[answers["n"] == n].sort_values("range")
                counts.append(np.concatenate([_unzip(x, np.uint64) for x in mine["counts"]] or [np.empty(0, np.uint64)]).astype(float))
            floor = total + 0.5 * (types + 1)
            automaton = Automaton(grams, counts, mu, floor)
            of_word = counts[0][automaton.words]
            edge = np.concatenate([[0], np.cumsum(lens)])
            known = np.concatenate([[0], np.cumsum(of_word > 0)])
            parts.append(pd.DataFrame({
                "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": lens, "n_known": known[edge[1:]] - known[edge[:-1]],
                "train_tokens": total, "base_score": np.add.reduceat(np.log10((of_word + 0.5) / floor), edge[:-1]),
                "score": automaton.traverse(lens, order - 1)}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None,
                    order: int = ORDER, mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row; scores are log10 probabilities.

    ``held_out``: a boolean column over ``docs``; the rows where it is true or
    null are scored but not learnt from (default: none is held out). A null text
    is empty and has the end token alone. Repeated rows are trained on and scored
    each. Without training rows every token is unseen. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = F.coalesce(held_out, F.lit(True)) if held_out is not None else F.lit(False)
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    ranges = int(size // RANGE_BYTES) + 1
    bits = min(64, int(size).bit_length() + SPARE_BITS)
    packed = written(rows.mapInArrow(_packed, "bucket long, docs binary"), "lm-buckets")
    ask = packed.mapInPandas(_requests(order, ranges, bits), "n int, range int, grams binary, counts binary, bucket long")
    answers = written(ask.groupBy("n", "range").applyInPandas(
        _answer, "n int, range int, bucket long, counts binary, tokens long, types long"), "lm-answers")
    sums = answers.where("n = 1").agg(F.sum("tokens"), F.sum("types")).first()
    total, types = int(sums[0] or 0), int(sums[1] or 0)
    kind = rows.schema["doc_id"].dataType
    schema = (f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return (packed.groupBy("bucket").cogroup(answers.select("bucket", "n", "range", "counts").groupBy("bucket"))
            .applyInPandas(_score(order, mu, bits, total, types), schema))
