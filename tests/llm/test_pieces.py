import hashlib
import random
from array import array

import numpy as np
import pytest
import sentencepiece
from helpers import rows_of

from braidwork.llm import pieces, queries


@pytest.fixture(scope="module")
def model():
    return queries.piece_model()


def test_table_equals_the_library_and_the_definition(model):
    table, lib = pieces.table_of(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(1)
    parts = ["a", "th", "in", " ", "  ", "\n", "\t", "é", "日", "😀", "aaaa", "....", "==", "11", "▁", "x▁", "\x00", "ß", "ing", "'s", "THE", "//", "{}", "​"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = array("I")
        ids.frombytes(table.encode(text))
        want = lib.encode(text, add_bos=True, add_eos=True)
        assert list(ids) == want
        assert table.decode(ids).decode() == lib.decode(want)
    for word in ("▁hello", "thththth", "aaaaaaaaa", "internationalization"):
        assert [table.name[i] for i in table.chunk_ids(word)] == table.merge(word)


def test_query_form_and_edges(frame, odd_texts, model):
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = rows_of(odd_texts) + rows_of(odd_texts)[:3]
    got = pieces.encode_pieces(frame(rows), model).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert all(want[r.doc_id] == (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    kept = pieces.encode_pieces(frame(rows_of(["a b"])), model, keep_ids=True).first()
    assert kept.ids == lib.encode("a b", add_bos=True, add_eos=True) and kept.decoded == "a b"
    assert pieces.encode_pieces(frame([]), model).collect() == []


def test_cache_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 10)
    table = pieces.PieceTable(model)
    text = " ".join(f"word{i}" for i in range(200))
    assert table.encode(text) == pieces.table_of(model).encode(text)
    assert len(table.cache) <= 10
