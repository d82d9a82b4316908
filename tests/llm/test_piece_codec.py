import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import TEXTS, documents, empty
from hypothesis import given, settings, strategies as st

from presswire.llm import piece_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OURS = C.codec(PATH)
AWKWARD = [" " * 4000 + "a" + " " * 777 + "b  c", "  a", "a  b", "     ", " ", "▁", "▁▁a b▁", "ﬁ Ⅷ 𝒳 x𝒳y", "<s> </s> <unk> <0x41>", "a\nb\n\nc", "  \n  indented",
           "don't stop", "x" * 3000, "日本語" * 50, "тест слово", "   ﬁ   ﬂ"]


def test_ids_are_those_of_the_library():
    texts = AWKWARD + [t or "" for t in TEXTS]
    for text, ids in zip(texts, OURS.encode(texts)):
        assert ids.tolist() == LIBRARY.encode(text)
        assert OURS.decode(ids.tolist()) == text.replace("▁", " ")


def test_ids_of_the_given_documents(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert [x.tolist() for x in OURS.encode(texts)] == LIBRARY.encode(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeérstin ▁\n,.AT1日"), max_size=40))
def test_any_text(text):
    assert OURS.encode([text])[0].tolist() == LIBRARY.encode(text)


def test_operator_on_awkward_rows(spark):
    docs = documents(spark, TEXTS + AWKWARD)
    rows = C.encode_texts(docs, model=PATH, keep=docs.columns).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = LIBRARY.encode(r.text or "")
        assert r["ids"] == ids and r.n_ids == len(ids) and r.round_trip and r.source == "src"
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.n_decoded == len(r.text or "")
    back = C.decode_ids(spark.createDataFrame([(1, LIBRARY.encode("some text")), (2, None), (3, [])],
                                              "doc_id long, ids array<int>"), model=PATH, keep=["doc_id"])
    assert {r.doc_id: r.text for r in back.collect()} == {1: "some text", 2: None, 3: ""}


@pytest.mark.parametrize("with_ids", [False, True])
def test_empty_table(spark, with_ids):
    assert C.encode_texts(empty(spark), model=PATH, keep=["doc_id"], with_ids=with_ids).count() == 0


def test_cuts_of_a_group_are_held_at_once(monkeypatch):
    codec, seen = C.PieceCodec(PATH), []
    whole = codec._encode
    monkeypatch.setattr(codec, "_encode", lambda texts: seen.append(sum(map(len, texts))) or whole(texts))
    monkeypatch.setattr(C, "GROUP_CHARS", 50)
    texts = ["some words of a text", "x" * 80, "", "more of it", "and the rest of these words"] * 3
    assert [x.tolist() for x in codec.encode(texts)] == LIBRARY.encode(texts)
    assert codec.encode([]) == [] and len(seen) > 5 and max(seen) <= 80
