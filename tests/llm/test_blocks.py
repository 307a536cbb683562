import re

import numpy as np
import pyarrow as pa

from braidwork.llm.blocks import slices, words


def test_words_follow_the_pattern(odd_texts):
    texts = [t or "" for t in odd_texts]
    w = words(pa.array(odd_texts))
    data = w.data.tobytes()
    for r, t in enumerate(texts):
        own = [data[w.start[k] : w.end[k]].decode() for k in range(w.first[r], w.first[r + 1])]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", t)


def test_hashes_tell_words_and_grams_apart():
    w = words(pa.array(["a b a b", "ab", "b a b c"]))
    h = w.hashes()
    assert h[0] == h[2] and h[0] != h[1] and len(set(h.tolist())) == 4
    at, grams = w.grams(h, 2)
    texts = ["a b", "b a", "a b", "b a", "a b", "b c"]
    assert len(at) == len(texts)
    assert all((grams[i] == grams[j]) == (texts[i] == texts[j]) for i in range(6) for j in range(6))


def test_slices_keep_all_rows_in_order(odd_texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(odd_texts))), pa.array(odd_texts)], ["doc_id", "text"])
    parts = list(slices([batch], limit=1000))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(len(odd_texts)))
    assert np.array_equal(words(pa.concat_arrays([p.column("text") for p in parts])).hashes(), words(batch.column("text")).hashes())
