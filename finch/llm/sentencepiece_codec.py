"""SentencePiece models run by the tokenizers library.

The model protobuf is parsed here (a small wire-format reader), and its pieces,
scores, normaliser and byte fallback are rebuilt as a ``tokenizers`` tokenizer:
``Unigram`` for unigram models, ``BPE`` with merges ranked by piece score for
BPE models. Batches of distinct text segments are encoded by the library's own
threads. Every segment is also encoded by ``sentencepiece`` itself (``parity``)
and decoded again (``round_trip``).

A piece of such a vocabulary holds the space marker only at its start. Where
the loaded vocabulary has that property and the normaliser works on single
characters, a text is the concatenation of its segments (a run of spaces and
the characters up to the next run), so encoding each distinct segment of a
batch once gives exactly the ids of the whole text. Other models, and texts
that hold the marker character itself, are encoded whole.
"""

from __future__ import annotations

import re
import struct

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import size_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6     # piece types of the model format
SEGMENT = re.compile(" +[^ ]*")
GROUP, LINE = 65_536, 128        # words looked at together; words of one line
KEEP = 300_000                   # segments that a task remembers, at some 250 bytes each


def _fields(buf: bytes):
    """(field number, value) of one protobuf message; length-delimited values are bytes."""
    i, n = 0, len(buf)

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, buf[i : i + size]
            i += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, struct.unpack("<f", buf[i : i + 4])[0] if size == 4 else buf[i : i + 8]
            i += size


def parse_model(blob: bytes) -> dict:
    """Pieces (text, score, type) and the settings that decide the encoding."""
    out = {"pieces": [], "model_type": 1, "byte_fallback": 0, "charsmap": b"", "dummy_prefix": 1,
           "squeeze": 1, "escape": 1, "suffix": 0}
    for no, value in _fields(blob):
        if no == 1:
            f = dict(_fields(value))
            out["pieces"].append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
        elif no == 2:
            f = dict(_fields(value))
            out |= {"model_type": f.get(3, 1), "byte_fallback": f.get(35, 0), "suffix": f.get(24, 0)}
        elif no == 3:
            f = dict(_fields(value))
            out |= {"charsmap": f.get(2, b""), "dummy_prefix": f.get(3, 1), "squeeze": f.get(4, 1), "escape": f.get(5, 1)}
    return out


def build_tokenizer(spec: dict) -> str:
    """The tokenizer as the library's JSON, to be loaded in every task."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if spec["model_type"] not in (1, 2) or spec["suffix"]:
        raise ValueError("only unigram and BPE models with the marker in front are supported")
    pieces = spec["pieces"]
    ids = {p: i for i, (p, _, _) in enumerate(pieces)}
    unk = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
    if spec["model_type"] == 1:
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk, bool(spec["byte_fallback"]))
    else:
        merges = []
        for p, score, kind in pieces:
            if kind in (NORMAL, USER) and len(p) > 1:
                for i in range(1, len(p)):
                    left, right = p[:i], p[i:]
                    if left in ids and right in ids:
                        merges.append((-score, ids[p], ids[left], ids[right], left, right))
        merges.sort()
        model = models.BPE(ids, [m[-2:] for m in merges], unk_token=pieces[unk][0], fuse_unk=True,
                           byte_fallback=bool(spec["byte_fallback"]))
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec["charsmap"])] if spec["charsmap"] else []
    if spec["squeeze"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    steps += [normalizers.Prepend(MARK)] if spec["dummy_prefix"] else []
    steps += [normalizers.Replace(" ", MARK)] if spec["escape"] else []
    tok.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * bool(spec["dummy_prefix"]))
    users = [AddedToken(p, normalized=False) for p, _, t in pieces if t == USER]
    if users:
        tok.add_tokens(users)
    return tok.to_str()


def segmentable(spec: dict) -> bool:
    """Texts may be cut before each run of spaces without changing any id."""
    inner = any(MARK in p.lstrip(MARK) for p, _, t in spec["pieces"] if t in (NORMAL, USER))
    return bool(any(p == MARK for p, _, _ in spec["pieces"]) and spec["dummy_prefix"] and spec["escape"] and not spec["squeeze"] and not spec["charsmap"] and not inner)


class Codec:
    """Encoder and decoder of one task, with a bounded memory of segments."""

    def __init__(self, tokenizer_json: str, model: bytes, by_segment: bool, threads: int = 2, keep: int = KEEP):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_segment, self.threads, self.keep = by_segment, threads, keep
        self.known: dict[str, list[int]] = {}
        self.starts = np.array([(self.tok.id_to_token(i) or "").startswith(MARK) for i in range(self.sp.get_piece_size())])
        self.unlike, self.lossy = set(), set()          # segments without parity, without round trip

    def _learn(self, segments: set[str]) -> None:
        if len(self.known) > self.keep:                 # frequent segments are in nearly every slice and stay
            self.known = {s: self.known[s] for s in segments & self.known.keys()}
            self.unlike &= self.known.keys()
            self.lossy &= self.known.keys()
        fresh = [s for s in segments if s not in self.known]
        words = [s for s in fresh if " " not in s and MARK not in s] if self.by_segment else []
        alone = [s for s in fresh if " " in s or MARK in s] if self.by_segment else fresh
        for a in range(0, len(words), GROUP):           # words side by side, cut again where a marker starts a piece
            alone += self._learn_group(words[a : a + GROUP])
        got = [e.ids for e in self.tok.encode_batch_fast(alone, add_special_tokens=False)]
        theirs = self.sp.encode(alone, num_threads=self.threads)
        back = self.tok.decode_batch(got, skip_special_tokens=False)
        self.known.update(zip(alone, got))
        self.unlike.update(s for s, x, y in zip(alone, got, theirs) if x != y)
        self.lossy.update(s for s, x in zip(alone, back) if x != s)

    def _learn_group(self, words: list[str]) -> list[str]:
        """Learn words by one text of lines of them; returns those to be looked at alone."""
        lines = [" ".join(words[a : a + LINE]) for a in range(0, len(words), LINE)]
        got = [e.ids for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)]
        theirs = self.sp.encode(lines, num_threads=self.threads)
        back = self.tok.decode_batch(got, skip_special_tokens=False)
        odd = []
        for k, (line, ids, sp_ids, text) in enumerate(zip(lines, got, theirs, back)):
            some = words[k * LINE : (k + 1) * LINE]
            cuts = np.flatnonzero(self.starts[np.array(ids, int)]).tolist()
            if ids == sp_ids and text == line and len(cuts) == len(some):
                self.known.update(zip(some, (ids[x:y] for x, y in zip(cuts, [*cuts[1:], len(ids)]))))
            else:
                odd += some
        return odd

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        """(ids, parity, round trip) of each text."""
        parts = []
        for t in texts:
            if not t:
                parts.append([])
            elif self.by_segment and MARK not in t:
                # the first character of a match is the marker that every encoding puts in front
                parts.append([m[1:] for m in SEGMENT.findall(" " + t)] if "  " in t or t[0] == " " or t[-1] == " " else t.split(" "))
            else:
                parts.append([t])
        distinct = set(chain.from_iterable(parts))
        distinct.discard("")
        self._learn(distinct)
        self.known[""] = [self.tok.token_to_id(MARK)]          # a single space at the end of a text
        ids = [list(chain.from_iterable(map(self.known.__getitem__, p))) for p in parts]
        same = [self.unlike.isdisjoint(p) for p in parts] if self.unlike else [True] * len(parts)
        back = [self.lossy.isdisjoint(p) for p in parts] if self.lossy else [True] * len(parts)
        return ids, same, back

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


def load_model(path: str = MODEL) -> tuple[str, bytes, bool]:
    """(tokenizer JSON, model bytes, may be cut into segments) of a model file."""
    with open(path, "rb") as f:
        blob = f.read()
    spec = parse_model(blob)
    return build_tokenizer(spec), blob, segmentable(spec)


def encode_documents(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, threads: int = 2, keep: int = KEEP) -> DataFrame:
    """``docs`` with ``token_ids`` array<int>, ``n_tokens`` int, ``parity`` and
    ``round_trip`` booleans; columns of these names are replaced.

    The model file is read once on the driver (vocabulary files are a few MB)
    and travels with the task. A null or empty text has no ids and both flags
    true. ``round_trip`` is false where the model's normaliser changes the text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = load_model(model_path)
    new = ("token_ids", "n_tokens", "parity", "round_trip")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    schema = T.StructType(docs.schema.fields + [
        T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()),
        T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        codec = Codec(*parts, threads=threads, keep=keep)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for a, b in size_slices(pc.binary_length(column).fill_null(0).to_pylist()):
                ids, same, back = codec.encode(column.slice(a, b - a).to_pylist())
                lens = np.fromiter(map(len, ids), np.int32, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(flat))
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*cut.columns, lists, pa.array(lens), pa.array(same), pa.array(back)],
                                                 names=[*cut.schema.names, *new])

    return docs.mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, ids_col: str = "token_ids", out: str = "text", model_path: str = MODEL) -> DataFrame:
    """``tokens`` with the text that ``ids_col`` decodes to (null ids: null)."""
    from pyspark.sql.functions import pandas_udf

    parts = load_model(model_path)

    @pandas_udf("string")
    def back(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(*parts)
        for ids in chunks:
            known = ids.notna()
            got = codec.decode([list(map(int, x)) for x in ids[known]])
            yield pd.Series(got, index=ids.index[known], dtype=object).reindex(ids.index)

    return tokens.withColumn(out, back(ids_col))
