"""Token ids as the library gives them, boundaries in near-minimal space, files read back, damage found."""
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, documents, empty
from traceloom.llm import token_files, tokens
from traceloom.llm.common import new_path
from traceloom.llm.tokens import Encoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=700))
def test_boundaries(steps):
    values = np.cumsum(steps)
    data = token_files.EliasFano.encode(values).to_bytes()
    back, at = token_files.EliasFano.from_bytes(memoryview(data), 0)
    assert at == len(data) and back.values().tolist() == values.tolist()
    assert [int(back.select(np.array([i]))[0]) for i in range(len(values))] == values.tolist()
    some = np.arange(0, len(values), 3)
    assert back.select(some).tolist() == values[some].tolist()


def test_space():
    n, universe = 20_000, 9_000_000
    values = np.sort(np.random.default_rng(1).integers(0, universe, n))
    assert len(token_files.EliasFano.encode(values).to_bytes()) * 8 / n < 2.5 + np.log2(universe / n)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    path = public_tokenizers.path(name)
    own, library = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    pieces = ["a", "B", " ", "\n", "'s", "é", "9", "!", "\t", "<|endoftext|>", "字", "İ", "ſ", " the", ".", "  ", "\r\n", " ", "don't", "ABC"]
    texts = ["", " ", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(1500)), *(t or "" for _, t, _ in ODD)]
    for t in texts:
        assert own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:100]


@pytest.mark.parametrize("shard_ids", [50, 2_000_000])
def test_round_trip(spark, shard_ids):
    out = new_path(spark, "test-tokens")
    token_files.write_token_files(documents(spark), out, BYTES, 2, shard_ids)
    got = token_files.read_token_files(spark, out).orderBy("start").collect()
    library = Tokenizer.from_file(BYTES)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((d for d, _, _ in ODD), key=lambda d: (d is not None, d or 0))
    want = []
    for d, text, _ in ODD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(repr, want))


def test_one_document_of_a_shard_and_damage():
    parts = [np.arange(n, dtype="<u2").tobytes() for n in (3, 1, 5)]
    data = token_files.Shard.build(0, 0, [None, -4, 9], parts, 2) + b"\n"
    shard = token_files.Shard(data)
    assert shard.document(2).tolist() == [0, 1, 2, 3, 4] and shard.document(0).tolist() == [0, 1, 2] and shard.n_null == 1
    for bad in (data[:-3], b"x" + data[1:]):
        with pytest.raises(ValueError):
            token_files.Shard(bad)


def test_empty(spark):
    out = new_path(spark, "test-tokens")
    token_files.write_token_files(empty(spark), out, BYTES)
    assert token_files.read_token_files(spark, out).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_texts_of_different_words_and_a_small_cache(name, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 300)
    path = public_tokenizers.path(name)
    own, library = Encoder(path), Tokenizer.from_file(path)
    own.parts = tokens.Known(own._part, 4000)
    rng = random.Random(3)
    texts = ["", "x" * 900, " ".join(f"Word{rng.randrange(10**9)}x" for _ in range(2000)), "two\n\nlines  and\n more ", " 字 ".join(["plain words here"] * 60), "", "last"]
    texts += ["\n".join(" ".join(f"é{rng.randrange(99)}." for _ in range(9)) for _ in range(20)) for _ in range(5)]
    got = [x.tolist() for x in own.raw(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    entries = [*own.parts.new.items(), *own.parts.old.items()]
    assert sum(tokens.ENTRY + len(k) + len(v) for k, v in entries) <= 2 * (4000 + tokens.ENTRY + 2000)
