import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from finch.llm import sentencepiece_codec as sc

ODD = ["", None, " ", "   ", "a", " a", "a ", "  a   b  ", "line\nnext\n\n end \n", "tab\tand\r\n", "naïve café ñ ß SS", "日本語のテキスト と 中文", "🙂 emoji 👩‍👩‍👧 ​",
       "▁marker ▁ inside▁ text", "a▁ b", "\x00\x01 control", "<s> </s> <unk> <0x41>", "x" * 5000, "many words " * 3000, "!!! ??? %%% ###", " nbsp and thin"]


@pytest.fixture(scope="module")
def model():
    with open(sc.MODEL, "rb") as f:
        return f.read()


def test_ids_equal_the_model_library(frame, model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(1)
    noise = ["".join(rng.choice("ab ▁\n\té日🙂<>") for _ in range(rng.randrange(30))) for _ in range(200)]
    rows = list(enumerate(ODD + noise))
    got = {r["doc_id"]: r for r in sc.encode_documents(frame(rows)).collect()}
    for i, t in rows:
        assert got[i]["token_ids"] == sp.encode(t or ""), t
        assert got[i]["n_tokens"] == len(got[i]["token_ids"]) and got[i]["parity"], t
        assert got[i]["round_trip"] == (sp.decode(got[i]["token_ids"]) == (t or "")), t
        assert "▁" in (t or "") or got[i]["round_trip"], t


def test_decoding_gives_the_text_back(frame):
    rows = [(i, t) for i, t in enumerate(ODD) if t and "▁" not in t]
    back = sc.decode_ids(sc.encode_documents(frame(rows)), out="back").where(~F.col("back").eqNullSafe(F.col("text"))).count()
    assert back == 0


def test_small_memory_of_segments(model, words):
    codec = sc.Codec(*sc.load_model(), threads=1, keep=50)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for k in range(5):
        texts = [words(200, k), words(100, k + 50), ""]
        assert codec.encode(texts)[0] == sp.encode(texts)


def test_tables(frame):
    clash = frame([(1, "a b"), (1, "a b"), (None, "c")]).withColumn("parity", F.lit("mine"))
    got = sc.encode_documents(clash)
    assert got.columns == ["doc_id", "text", "h", "row", "key", "token_ids", "n_tokens", "parity", "round_trip"] and got.count() == 3
    assert sc.encode_documents(frame([])).collect() == []


def test_unigram_model(tmp_path):
    m = pb.ModelProto()
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in [("▁", -3.0), ("a", -4.0), ("b", -4.5), ("▁ab", -5.0), ("ab", -5.5), ("abb", -7.0), ("▁b", -6.0), ("c", -5.1)]]
    for p, s, t in pieces:
        m.pieces.add(piece=p, score=s, type=t)
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = True
    m.trainer_spec.unk_id = 0
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    path = tmp_path / "uni.model"
    path.write_bytes(m.SerializeToString())
    codec = sc.Codec(*sc.load_model(str(path)), threads=1)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["ab abb", "bab cab", "abbab é", "a  b", "z", ""]
    ids, same, back = codec.encode(texts)
    assert ids == sp.encode(texts) and all(same) and all(back)
