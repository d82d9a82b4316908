import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import TEXTS, documents, empty
from tokenizers import Tokenizer

from presswire.llm import token_planes as P
from presswire.session import work_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACES = ["a  b", "a   b", " a", "  a", "a ", "a  ", "a\n b", "a \n b", "a\n\n  b \t c", "x\u00a0 y", "x \u00a0y", "\u2003 z",
          "it's 'tis  's", "1 2  33 ,. !?  ", " ", "  ", "\n", "<|endoftext|> a <|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>", "<|endoftext|", "x  <|endoftext|>  y", "\x1c x\x85 y"]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_cuts_give_the_ids_of_the_whole_text():
    texts = SPACES + [t or "" for t in TEXTS]
    assert [x.tolist() for x in P.CutEncoder(PATH).encode(texts)] == expected(texts)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 100, 1001])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(bits, n, width):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2 ** (8 * width) - 1, n).astype(np.uint32)
    docs = np.array([(3, 1, 0, n)], P.DOC)
    data = P.pack_file(ids, docs, width, bits, 100, 1)
    back, records = P.unpack_file(data)
    assert back.tolist() == ids.tolist() and records.tolist() == docs.tolist()
    with pytest.raises(ValueError):
        P.unpack_file(b"x" * len(data))


@pytest.mark.parametrize("bits", [False, True])
def test_files_hold_all_documents_in_order(spark, bits):
    docs = documents(spark, TEXTS + SPACES)
    folder = work_path(spark, "planes")
    manifest = P.write_tokens(docs, folder, tokenizer=PATH, bits=bits, file_ids=500, block_ids=64)
    assert manifest.count() > 3
    rows = sorted(P.read_tokens(spark, folder, manifest).collect(), key=lambda r: r.start)
    source = docs.collect()
    ids = dict(zip((r.text for r in source), expected([r.text for r in source])))
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in source), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        options = [ids[s.text] + [0] for s in source if s.doc_id == r.doc_id]
        assert r.ids in options and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_empty_table(spark):
    folder = work_path(spark, "planes")
    manifest = P.write_tokens(empty(spark), folder, tokenizer=PATH)
    assert P.read_tokens(spark, folder, manifest).count() == 0
