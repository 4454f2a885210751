"""Packs of histograms and of tables: every piece once, no overlap, no gap, few sequences."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, documents, empty
from traceloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 256), st.integers(1, 40), max_size=40))
def test_histograms(counts):
    groups = packing.pack_histogram(counts, 256, 16)
    used = defaultdict(int)
    for parts, n in groups:
        assert n > 0 and sum(parts) <= 256
        for p in parts:
            used[p] += n
    assert dict(used) == counts
    need = sum(k * v for k, v in counts.items())
    lower = max(-(-need // 256), sum(v for k, v in counts.items() if k > 128))
    assert sum(n for _, n in groups) <= lower * 1.5 + 3


def test_few_sequences():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    made = sum(n for _, n in packing.pack_histogram(counts, 4096))
    assert made <= lengths.sum() / 4096 * 1.01 + 1


def test_least_squares():
    rng = np.random.default_rng(4)
    a, x = rng.random((20, 6)), np.array([0, 1.5, 0, 2, 0, 0.5])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    assert (packing.nnls(-a, np.ones(20)) == 0).all()


@pytest.mark.parametrize("size", [64, 4096])
def test_odd_rows(spark, size):
    got = packing.pack_documents(documents(spark), PATH, 1, size).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d, text, _ in ODD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), size)):
            piece = ids[at : at + size]
            want.append((d, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(repr, want))
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_few_sequences_for_a_table(spark):
    """No more than a percent above what the tokens, and pieces that cannot share a sequence, ask for; equal lengths spread over tasks."""
    out = packing.op9_best_fit_packing(spark, "/root/testdata/sf0.01").select("sequence_id", "length", "offset", "doc_id", "piece").collect()
    least = max(-(-sum(r.length for r in out) // 4096), sum(r.length > 2048 for r in out))
    assert len({r.sequence_id for r in out}) <= 1.01 * least + 1
    docs = documents(spark, [(i, "same text here", "s") for i in range(5000)]).repartition(7)
    got = packing.pack_documents(docs, PATH).collect()
    size = got[0].length
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000 and len({r.sequence_id for r in got}) == -(-5000 // (4096 // size))
