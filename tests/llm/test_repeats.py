"""Removed bytes against brute force; maximal repeats against all substrings."""
import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import documents, empty, rng, words
from traceloom.llm import repeats


def slow(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                mark[i : i + least] = b"\1" * least
        kept = bytes(x for x, m in zip(r, mark, strict=True) if not m)
        spans = sum(1 for i in range(len(r)) if mark[i] and not (i and mark[i - 1]))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, least=200, **how):
    got = repeats.remove_repeats(documents(spark, rows), least, **how).collect()
    want = [(d, *x) for (d, _, _), x in zip(rows, slow([t for _, t, _ in rows], least), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_odd_rows(spark):
    from tests.llm.helpers import ODD

    check(spark, [r for r in ODD if r[0] != 7])


def test_very_long_text(spark):
    from tests.llm.helpers import ODD

    r = rng(8)
    check(spark, [x for x in ODD if x[0] == 7] + [(20, words(r, 30_000, 10**6), "s"), (21, words(r, 300), "s")])


@pytest.mark.parametrize("seed", range(8))
def test_groups_cover_what_repeats(seed):
    """Over contexts with borders, the union of maximal repeats is every byte of a string that starts at two places."""
    r, least = np.random.default_rng(100 + seed), 4
    parts = [bytes(r.integers(97, 99 + seed % 3, r.integers(1, 40)).astype(np.uint8)) for _ in range(9)]
    parts += parts[:2]
    data, left, starts = repeats._joined(parts)
    got = np.zeros(len(data), bool)
    for at, n in zip(*repeats.SuffixArray(data, left, 64).covered(least), strict=True):
        got[at : at + n] = True
    seen = Counter(p[i : i + least] for p in parts for i in range(len(p) - least + 1))
    want = np.zeros(len(data), bool)
    for p, s in zip(parts, starts.tolist(), strict=True):
        for i in range(len(p) - least + 1):
            if seen[p[i : i + least]] > 1:
                want[s + i : s + i + least] = True
    assert (got == want).all()


def test_shared_passages(spark):
    r = rng(3)
    passages = [words(r, n, 50) for n in (30, 45, 60, 200)]
    rows = []
    for i in range(120):
        parts = [words(r, r.randrange(5, 60), 500)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        rows.append((i, " ".join(parts), "s"))
    rows += [(500, "ab" * 400, "s"), (501, "x" * 199, "s"), (502, "x" * 200, "s"), (503, "x" * 201, "s"), (504, "é" * 150, "s"), (504, "é" * 150, "s"), (None, "z" * 450, "s")]
    check(spark, rows)


def test_many_variants_of_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(repeats, "VARIANTS", 8)
    r = rng(5)
    core = words(r, 40, 90)
    rows = [(i, words(r, 20) + " " + core + " " + words(r, 20), "s") for i in range(60)] + [(100 + i, rows_, "s") for i, rows_ in enumerate([words(r, 60)] * 3)]
    check(spark, rows)


def test_windows_across_scans(spark):
    r = rng(6)
    core = words(r, 60)
    check(spark, [(1, words(r, 900) + core + words(r, 700), "s"), (2, words(r, 100) + core, "s"), (3, "x" * 9000, "s")], scan=2048)


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats(seed):
    r = np.random.default_rng(seed)
    data = r.integers(97, 99 + seed % 3, 60 + 10 * seed).astype(np.uint8)
    left = len(data) - np.arange(len(data))
    got = {(n, tuple(sorted(at.tolist()))) for n, at in repeats.SuffixArray(data, left, 64).maximal_repeats(3)}
    raw, want = data.tobytes(), set()
    places = {}
    for n in range(3, len(raw)):
        for i in range(len(raw) - n + 1):
            places.setdefault(raw[i : i + n], []).append(i)
    for s, at in places.items():
        if len(at) > 1 and len({raw[i - 1 : i] if i else None for i in at}) > 1 and len({raw[i + len(s) : i + len(s) + 1] or None for i in at}) > 1:
            want.add((len(s), tuple(at)))
    assert got == want


def test_empty(spark):
    assert repeats.remove_repeats(empty(spark)).count() == 0
