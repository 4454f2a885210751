"""Round trips, damage, seeking, and the digests by hand."""
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, documents, empty
from traceloom.llm import flac


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=5))
def test_round_trip(parts):
    payloads = [p + b"\xff" * (-len(p) % flac.BLOCK or (0 if p else flac.BLOCK)) for p in parts]
    files = flac.encode_streams(payloads)
    assert flac.decode_streams(files) == payloads
    assert flac.decode_streams(files, flac._walk) == payloads


def crc(data, poly, width):
    """By long division, a bit at a time."""
    c = 0
    for byte in data:
        for i in range(7, -1, -1):
            top = c >> (width - 1) & 1 ^ byte >> i & 1
            c = (c << 1 & (1 << width) - 1) ^ (poly if top else 0)
    return c


class Reader:
    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def signed(self, n):
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def plain_decode(data):
    """A second decoder of 8-bit mono files, from the format's description: one field after another. Also the kinds of subframes."""
    assert data[:4] == b"fLaC"
    r, kinds, out, last = Reader(data), set(), [], 0
    r.at = 32
    while not last:
        last, kind, size = r.take(1), r.take(7), r.take(24)
        if kind == 0:
            body = data[r.at // 8 : r.at // 8 + size]
        r.at += 8 * size
    total, number = int.from_bytes(body[13:18], "big") & (1 << 36) - 1, 0
    while len(out) < total:
        start = r.at // 8
        assert r.take(14) == 0x3FFE and r.take(2) == 0
        block = {2: 576}[r.take(4)]
        assert (r.take(4), r.take(4), r.take(3), r.take(1)) == (0, 0, 1, 0)
        lead = r.take(8)
        more = 0 if lead < 128 else f"{lead:08b}".index("0") - 1
        value = lead if lead < 128 else lead & (1 << (6 - more)) - 1
        for _ in range(more):
            value = value << 6 | r.take(8) & 63
        assert value == number
        assert r.take(8) == crc(data[start : r.at // 8 - 1], 0x07, 8)
        assert r.take(1) == 0
        kind, wasted = r.take(6), r.take(1)
        assert not wasted
        if kind == 0:
            kinds.add("constant")
            x = [r.signed(8)] * block
        elif kind == 1:
            kinds.add("verbatim")
            x = [r.signed(8) for _ in range(block)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            kinds.add(f"fixed{order}" if kind < 32 else "linear")
            x = [r.signed(8) for _ in range(order)]
            shift, weights = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None
            if kind >= 32:
                precision, shift = r.take(4) + 1, r.signed(5)
                weights = [r.signed(precision) for _ in range(order)]
            assert r.take(2) == 0
            parts = 1 << r.take(4)
            for part in range(parts):
                k = r.take(4)
                for _ in range(block // parts - (order if not part else 0)):
                    folded = r.unary() << k | r.take(k)
                    guess = sum(w * x[-1 - i] for i, w in enumerate(weights)) >> shift
                    x.append(guess + (folded >> 1 ^ -(folded & 1)))
        out += x
        r.at += -r.at % 8
        assert r.take(16) == crc(data[start : r.at // 8 - 2], 0x8005, 16)
        number += 1
    assert r.at == 8 * len(data) and hashlib.md5(bytes(v & 255 for v in out)).digest() == body[18:]
    return bytes(v + 128 for v in out), kinds


def test_known_checksums():
    assert crc(b"123456789", 0x07, 8) == flac.crc8(b"123456789") == 0xF4
    own = flac.crc16_rows(np.frombuffer(b"x123456789", np.uint8), np.array([1]), np.array([9]))
    assert crc(b"123456789", 0x8005, 16) == own[0] == 0xFEE8


def test_another_decoder_agrees():
    rng, t = np.random.default_rng(2), np.arange(576)
    smooth = 128 + 90 * np.sin(t / 40)
    blocks = {
        "constant": np.full(576, 7), "verbatim": rng.integers(0, 256, 576), "linear": 128 + 50 * np.sin(t * 0.9) + 40 * np.sin(t * 1.7), "text": np.frombuffer(("The quick brown fox jumps. " * 30).encode()[:576], np.uint8),
        "steps": np.cumsum(rng.integers(-1, 2, 576)) % 100 + 78, "smooth": smooth, "ramp": np.arange(576) // 3 % 250, "noise": np.clip(128 + rng.normal(0, 3, 576), 0, 255),
    }
    payloads = [np.asarray(b).astype(np.uint8).tobytes() for b in blocks.values()]
    payloads.append(b"".join(payloads) * 20)
    seen = set()
    for p, data in zip(payloads, flac.encode_streams(payloads), strict=True):
        got, kinds = plain_decode(data)
        assert got == p
        seen |= kinds
    assert {"constant", "verbatim", "linear"} <= seen and sum(k.startswith("fixed") for k in seen) >= 2


def test_damage_is_found():
    payload = flac.payload_of("The quick brown fox. " * 200)
    data = bytearray(flac.encode_streams([payload])[0])
    for at in (len(data) // 2, len(data) - 1, len(data) - 40):
        broken = data.copy()
        broken[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode_streams([bytes(broken)])
    with pytest.raises(flac.FlacError):
        flac.decode_streams([bytes(data[:-100])])


def test_seek():
    payload = flac.payload_of("".join(chr(33 + i * i % 90) for i in range(200_000)))
    data = flac.encode_streams([payload])[0]
    for at, n in ((0, 10), (575, 2), (100_000, 1000), (len(payload) - 5, 5)):
        assert flac.pcm_at(data, at, n) == payload[at : at + n]
    assert len(flac.Stream(data).seek) > 10


def test_seek_tables_with_gaps_and_lies():
    payload = flac.payload_of("".join(chr(33 + i * i % 90) for i in range(90_000)))
    data = flac.encode_streams([payload])[0]
    stream = flac.Stream(data)
    assert len(stream.seek) < stream.total // flac.BLOCK and flac.decode_streams([data]) == [payload]
    at = data.index(b"\x83") + 4 + 18 + 8  # the place of the second point
    with pytest.raises(flac.FlacError):
        flac.decode_streams([data[:at] + bytes(8) + data[at + 8 :]])


def test_blocks_with_their_places(spark):
    media = flac.encode_media(documents(spark))
    files = {}
    for r in media.collect():
        files.setdefault(r.doc_id, []).append(bytes(r.media))
    got = flac.pcm_blocks(media).collect()
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, {})[r.sample] = bytes(r.pcm)
        assert any(f[r.byte : r.byte + 2] == b"\xff\xf8" for f in files[r.doc_id])
    for d, text, _ in ODD:
        if d not in (5, None):
            assert b"".join(x for _, x in sorted(whole[d].items())) == flac.payload_of(text or "")
    assert flac.pcm_blocks(flac.encode_media(empty(spark))).count() == 0


def test_standard_header():
    data = flac.encode_streams([b"\x80" * 576])[0]
    assert data[:4] == b"fLaC" and data[4] == 0 and int.from_bytes(data[5:8], "big") == 34 and data[26:42] == hashlib.md5(b"\0" * 576).digest()


def test_digests_of_odd_rows(spark):
    got = flac.media_digests(flac.encode_media(documents(spark))).collect()
    assert len(got) == len(ODD)
    by_text = {}
    for d, text, _ in ODD:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        by_text.setdefault(d, set()).add((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in by_text[r.doc_id]
    assert flac.media_digests(flac.encode_media(empty(spark))).count() == 0
