from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokenids as K


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab C\n\t .,'é1 　!"), max_size=40)), max_size=8))
def test_encoding_is_the_tokenizers(texts):
    enc, _ = K.encoder(K.VOCABULARY)
    ids, at = K.encode(pa.array(texts, pa.string()), K.VOCABULARY)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [enc.encode_ordinary(t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50_255), max_size=300), max_size=5), st.sampled_from([1, 7, 128, 256]), st.sampled_from([0.5, 0.9, 1.0]))
def test_round_trip(docs, block, percentile):
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    starts, payloads = K.pack(np.array([x for d in docs for x in d], np.uint32), at, block, percentile)
    for d, s, p in zip(docs, starts, payloads):
        assert K.unpack(p, s).tolist() == d
        for k, x in enumerate(s):  # any block alone
            assert K.unpack_block(p, x).tolist() == d[k * block : (k + 1) * block]


def test_outliers_are_exceptions():
    ids = np.array([5] * 120 + [50_000] * 8, np.uint32)
    _, payloads = K.pack(ids, np.array([0, 128]))
    assert payloads[0][6] == 0 and payloads[0][7] == 8 and len(payloads[0]) == 8 + 8 * 5


def test_odd_rows(spark):
    enc, _ = K.encoder(K.VOCABULARY)
    got = K.token_blocks(spark.createDataFrame(odd_rows(), DOCS)).collect()
    want = sorted((str(i), enc.encode_ordinary(t or "")) for i, t, *_ in odd_rows())
    assert sorted((str(r.doc_id), K.unpack(r.payload, r.block_starts).astype(int).tolist()) for r in got) == want
    assert all(r.n_tokens == 0 and r.block_starts == [] and r.payload == b"" for r in got if r.doc_id in (1, 2))
    assert K.token_blocks(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        K.token_blocks(spark.createDataFrame([], DOCS), block=300)
