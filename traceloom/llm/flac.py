"""FLAC: lossless 8-bit mono streams with frame checksums and a seek table, coded for many frames at once."""
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, small_batches, texts

BLOCK = 576
RATE = 16000
#: Bytes of payload and frames that are coded together, to bound a worker's memory.
TOGETHER, FRAMES = 1 << 20, 2048


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        out[i] = c
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16_rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[start:start + length], a byte of all rows at a time."""
    order = np.argsort(-lengths, kind="stable")
    start, left = starts[order], lengths[order]
    crc = np.zeros(len(starts), np.uint32)
    live = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")
    for i, n in enumerate(live):
        crc[:n] = ((crc[:n] << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16[(crc[:n] >> np.uint32(8)) ^ data[start[:n] + i]]
    out = np.zeros_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number as FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >> (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size & 0xFF) | n, *tail[::-1]])


#: Order of the linear predictor, bits of its coefficients, and how many of them are behind the point.
ORDER, PRECISION, SHIFT = 4, 12, 9


def predictors(x: np.ndarray) -> np.ndarray:
    """(frames, ORDER) whole-number coefficients, of SHIFT bits behind the point, by Levinson and Durbin's recursion.

    The samples are windowed and their mean stays in, as the decoder knows none. Silent frames get zeros.
    """
    w = x * np.hanning(x.shape[1])
    r = np.stack([np.einsum("ij,ij->i", w[:, : x.shape[1] - k], w[:, k:]) for k in range(ORDER + 1)], axis=1)
    a, error = np.zeros((len(x), ORDER)), r[:, 0] * (1 + 1e-6) + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] -= k[:, None] * a[:, i - 1 :: -1][:, :i] if i else 0
        a[:, i] = k
        error *= 1 - k * k
    most = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -most, most - 1).astype(np.int32)


def _predicted(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Residuals of the linear predictor, for all samples after the first ORDER."""
    n = x.shape[1]
    total = np.zeros((len(x), n - ORDER), np.int32)
    for j in range(ORDER):
        total += coefficients[:, j, None] * x[:, ORDER - 1 - j : n - 1 - j]
    return x[:, ORDER:] - (total >> SHIFT)


def _field(out: np.ndarray, rows: np.ndarray, at: int, width: int, value) -> None:
    """Write the low bits of value (a number, or one for each row) at a place of these rows."""
    for j in range(width):
        out[rows, at + j] = np.asarray(value) >> (width - 1 - j) & 1


class _Frames:
    """Coded subframe bits of many frames, each of BLOCK samples: constant, verbatim, a fixed predictor or a linear one, whichever is shortest."""

    def __init__(self, samples: np.ndarray):
        """samples: (frames, BLOCK) signed 8-bit values."""
        x = samples.astype(np.int32)
        n = len(x)
        constant = (x == x[:, :1]).all(axis=1)
        linear = predictors(x)
        # kinds 0 .. ORDER are fixed predictors of that order, the last one is the linear one
        residuals = [*(np.diff(x, n=k, axis=1) if k else x for k in range(ORDER + 1)), _predicted(x, linear)]
        orders = np.array([*range(ORDER + 1), ORDER])
        sums = np.stack([np.abs(e).sum(axis=1) / e.shape[1] for e in residuals])
        # the coefficients weigh as much as a tenth of a bit a sample, about
        sums[-1] *= 1.07
        kind = sums.argmin(axis=0)
        order = orders[kind]
        folded = np.zeros((n, BLOCK), np.int32)
        for k, e in enumerate(residuals):
            at = np.flatnonzero(kind == k)
            folded[at, orders[k] :] = e[at] << 1 ^ e[at] >> 31
        live = np.arange(BLOCK)[None, :] >= order[:, None]
        costs = np.stack([np.where(live, (folded >> k) + 1 + k, 0).sum(axis=1) for k in range(9)])
        rice = costs.argmin(axis=0)
        # subframe header 8, warm-up 8 each, precision 4, shift 5 and coefficients, coding method 2, partition order 4, parameter 4
        coded = 8 + 8 * order + np.where(kind > ORDER, 9 + ORDER * PRECISION, 0) + 10 + costs.min(axis=0)
        verbatim = (coded >= 8 + 8 * BLOCK) & ~constant
        rice_coded = ~verbatim & ~constant
        bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, coded))
        self.sizes = (bits + 7) // 8
        out = np.zeros((n, int(self.sizes.max()) * 8), np.uint8)
        bytes_ = np.unpackbits((x & 255).astype(np.uint8), axis=1)
        at = np.flatnonzero(constant)
        out[at, 8:16] = bytes_[at, :8]
        at = np.flatnonzero(verbatim)
        if len(at):
            out[at, 6] = 1
            out[at, 8 : 8 + 8 * BLOCK] = bytes_[at]
        for k in range(ORDER + 2):
            at = np.flatnonzero(rice_coded & (kind == k))
            if not len(at):
                continue
            warm = int(orders[k])
            _field(out, at, 1, 6, 8 + k if k <= ORDER else 31 + ORDER)
            out[at, 8 : 8 + 8 * warm] = bytes_[at, : 8 * warm]
            base = 8 + 8 * warm
            if k > ORDER:
                _field(out, at, base, 4, PRECISION - 1)
                _field(out, at, base + 4, 5, SHIFT)
                base += 9
                for j in range(ORDER):
                    _field(out, at, base, PRECISION, linear[at, j])
                    base += PRECISION
            _field(out, at, base + 6, 4, rice[at])
            base += 10
            value, p = folded[at, warm:], rice[at][:, None]
            quotient = value >> p
            stop = base + np.cumsum(quotient + 1 + p, axis=1) - p - 1
            row = np.broadcast_to(at[:, None], stop.shape)
            out[row, stop] = 1
            for j in range(int(rice[at].max())):
                # bit j from the top of each parameter's low bits
                wide = np.flatnonzero(rice[at] > j)
                shift = rice[at][wide][:, None] - 1 - j
                out[row[wide], stop[wide] + 1 + j] = value[wide] >> shift & 1
        self.bytes = np.packbits(out, axis=1)


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload; a payload is unsigned 8-bit PCM of a positive multiple of BLOCK samples."""
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError("a payload must be a positive multiple of the block size")
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int16) - 128
    subframes: list[bytes] = []
    for i in range(0, len(samples), FRAMES):
        part = _Frames(samples[i : i + FRAMES])
        subframes += [row[:n].tobytes() for row, n in zip(part.bytes, part.sizes.tolist(), strict=True)]
    heads = {}
    counts = [len(p) // BLOCK for p in payloads]
    for i in range(max(counts)):
        heads[i] = _header(i)
    parts, lengths = [], []
    at = 0
    for n in counts:
        for i in range(n):
            parts.append(heads[i] + subframes[at])
            lengths.append(len(parts[-1]))
            at += 1
    size = np.array(lengths, np.int64)
    checks = crc16_rows(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)
    out, at = [], 0
    for p, n in zip(payloads, counts, strict=True):
        own = [x + int(c).to_bytes(2, "big") for x, c in zip(parts[at : at + n], checks[at : at + n], strict=True)]
        at += n
        sizes = [len(x) for x in own]
        total = n * BLOCK
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + hashlib.md5(signed).digest()
        offsets = np.cumsum([0, *sizes[:-1]])
        step = max(1, n // 64)
        seek = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, n, step))
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + b"".join(own))
    return out


class FlacError(ValueError):
    pass


class _Bits:
    """Reads bit fields of many frames in step; data holds 8 spare bytes."""

    def __init__(self, data: np.ndarray):
        # the 8 bytes from each place as one big-endian number
        self.data = data
        wide = np.zeros(len(data) - 7, np.uint64)
        for i in range(8):
            wide |= data[i : len(data) - 7 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.wide = wide

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.wide[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.window(at) >> np.uint64(64 - n)).astype(np.int64) if n else np.zeros(len(at), np.int64)


def _unary(bits: _Bits, at: np.ndarray) -> np.ndarray:
    """Zeros before the next one. The top 53 bits of a window are exact as a float, whose exponent tells the first one."""
    top = (bits.window(at) >> np.uint64(11)).astype(np.float64)
    if (top > 0).all():
        return 1075 - (top.view(np.int64) >> 52)
    out = np.where(top > 0, 1075 - (top.view(np.int64) >> 52), 53)
    more = np.flatnonzero(top == 0)
    if len(more):
        if (at[more] + 53 >= 8 * (len(bits.wide) - 1)).any():
            raise FlacError("a residual runs past the data")
        out[more] += _unary(bits, at[more] + 53)
    return out


def _signed(x: np.ndarray, bits: int) -> np.ndarray:
    return (x ^ 1 << (bits - 1)) - (1 << (bits - 1)) if bits else x


def _residual_block(bits: _Bits, at: np.ndarray, block: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice residuals of frames of one predictor order: (frames, block - order), and where they end."""
    n = len(at)
    out = np.zeros((n, block - order), np.int64)
    end = np.zeros(n, np.int64)
    kinds = bits.take(at, 6)
    for kind in np.unique(kinds):
        method, parts = int(kind) >> 4, 1 << (int(kind) & 15)
        if method > 1 or block % parts or block // parts < order:
            raise FlacError("an unknown residual coding")
        idx = np.flatnonzero(kinds == kind)
        pos = at[idx] + 6
        place, wide = 0, 5 if method else 4
        for part in range(parts):
            p = bits.take(pos, wide)
            pos = pos + wide
            count = block // parts - (order if not part else 0)
            escape = p == (1 << wide) - 1
            raw = np.where(escape, bits.take(pos, 5), 0)
            pos = np.where(escape, pos + 5, pos)
            shift = p.astype(np.uint64)
            plain = np.flatnonzero(~escape)
            full = not escape.any()
            for j in range(place, place + count):
                if full:
                    q = _unary(bits, pos)
                    pos = pos + q + 1
                    value = q << p | np.where(p > 0, (bits.window(pos) >> ((np.uint64(64) - shift) & np.uint64(63))).astype(np.int64), 0)
                    pos = pos + p
                    out[idx, j] = (value >> 1) ^ -(value & 1)
                    continue
                if len(plain):
                    own = pos[plain]
                    q = _unary(bits, own)
                    own = own + q + 1
                    s = shift[plain]
                    value = q << p[plain] | np.where(p[plain] > 0, (bits.window(own) >> ((np.uint64(64) - s) & np.uint64(63))).astype(np.int64), 0)
                    pos[plain] = own + p[plain]
                    out[idx[plain], j] = (value >> 1) ^ -(value & 1)
                for width in np.unique(raw[escape]):
                    sel = np.flatnonzero(escape & (raw == width))
                    out[idx[sel], j] = _signed(bits.take(pos[sel], int(width)), int(width))
                    pos[sel] += int(width)
            place += count
        end[idx] = pos
    return out, end


def _subframes(bits: _Bits, at: np.ndarray, block: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames, block) of subframes that start at these bits, and where they end."""
    heads = bits.take(at, 8)
    if (heads & 0x81).any():
        raise FlacError("a reserved bit is set, or wasted bits are used")
    kinds = heads >> 1 & 63
    out, end = np.zeros((len(at), block), np.int64), np.zeros(len(at), np.int64)
    for kind in np.unique(kinds):
        idx = np.flatnonzero(kinds == kind)
        pos, kind = at[idx] + 8, int(kind)
        if kind == 0:
            out[idx] = _signed(bits.take(pos, depth), depth)[:, None]
            end[idx] = pos + depth
        elif kind == 1:
            for j in range(block):
                out[idx, j] = _signed(bits.take(pos + j * depth, depth), depth)
            end[idx] = pos + block * depth
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            warm = np.stack([_signed(bits.take(pos + j * depth, depth), depth) for j in range(order)], axis=1) if order else np.zeros((len(idx), 0), np.int64)
            pos = pos + order * depth
            if kind < 32:
                x, end[idx] = _residual_block(bits, pos, block, order)
                for k in range(order, 0, -1):  # undo one difference after another
                    x = np.diff(warm, n=k - 1, axis=1)[:, -1:] + x.cumsum(axis=1)
                x = np.concatenate([warm, x], axis=1)
                out[idx] = x
                continue
            precision = bits.take(pos, 4) + 1
            shift = _signed(bits.take(pos + 4, 5), 5)
            if (precision > 15).any() or (shift < 0).any():
                raise FlacError("an unknown predictor")
            pos = pos + 9
            coefficients = np.zeros((len(idx), order), np.int64)
            for width in np.unique(precision):
                sel = np.flatnonzero(precision == width)
                for j in range(order):
                    coefficients[sel, j] = _signed(bits.take(pos[sel] + j * int(width), int(width)), int(width))
            pos = pos + order * precision
            residual, end[idx] = _residual_block(bits, pos, block, order)
            x = np.concatenate([warm, np.zeros((len(idx), block - order), np.int64)], axis=1)
            for j in range(order, block):
                guess = (coefficients * x[:, j - order : j][:, ::-1]).sum(axis=1) >> shift
                x[:, j] = residual[:, j - order] + guess
            out[idx] = x
        else:
            raise FlacError("a reserved subframe type")
    return out, end


class Stream:
    """The metadata of a FLAC file of this module's kind: mono, 8 bits, blocks of BLOCK samples."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("not a FLAC file")
        at, last, self.seek = 4, False, []
        while not last:
            last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                self.block = int.from_bytes(body[:2], "big")
                packed = int.from_bytes(body[10:18], "big")
                self.depth, self.total, self.md5 = (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34]
                if packed >> 41 & 7 or self.depth != 8 or self.block != BLOCK or self.total % BLOCK:
                    raise FlacError("not of the kind this module writes")
            elif kind == 3:
                self.seek = [struct.unpack_from(">QQH", body, i)[:2] for i in range(0, size, 18)]
            at += 4 + size
        self.first = at

    def offset_of(self, sample: int) -> tuple[int, int]:
        """(sample, byte) of the last seek point at or before a sample; the byte counts from the file's start."""
        return next(((s, self.first + b) for s, b in reversed(self.seek) if s <= sample), (0, self.first))


def _walk(data: bytes, stream: Stream) -> list[tuple[int, int]]:
    """(start, length of the header) of each frame, by decoding one after another."""
    out, at = [], stream.first
    for i in range(stream.total // BLOCK):
        head = _header(i)
        if data[at : at + len(head)] != head:
            raise FlacError(f"frame {i} is missing")
        out.append((at, len(head)))
        near = np.frombuffer(data[at + len(head) : at + 64 * BLOCK] + bytes(16), np.uint8)
        at += len(head) + (int(_subframes(_Bits(near), np.zeros(1, np.int64), BLOCK, 8)[1][0]) + 7) // 8 + 2
    return out


def _sought(data: bytes, stream: Stream) -> list[tuple[int, int]]:
    """As _walk, from the seek table; between its points by searching for the headers, where residuals that look like one make the frame's end disagree."""
    known = {s // BLOCK: stream.first + b for s, b in stream.seek}
    out, at = [], stream.first
    for i in range(stream.total // BLOCK):
        head = _header(i)
        at = known[i] if i in known else data.find(head, at)
        if at < 0 or data[at : at + len(head)] != head or not i and at != stream.first:
            raise FlacError(f"frame {i} is missing")
        out.append((at, len(head)))
        at += len(head)
    return out


def decode_streams(files: list[bytes], find=_sought) -> list[bytes]:
    """Payloads (unsigned 8-bit PCM) of FLAC files; raises FlacError if a frame's checksum or the whole MD5 disagrees.

    The seek tables tell where frames start, and those of all files are decoded in step. Should an end not meet the next header, the file is walked frame by frame.
    """
    spots: list[tuple[int, int, int]] = []
    counts, base, streams = [], 0, []
    for data in files:
        stream = Stream(data)
        starts = find(data, stream)
        ends = [*(s for s, _ in starts[1:]), len(data)]
        spots += [(base + s, h, base + e) for (s, h), e in zip(starts, ends, strict=True)]
        counts.append(len(starts))
        streams.append(stream)
        base += len(data)
    whole = np.frombuffer(b"".join(files) + bytes(16), np.uint8)
    table = np.array(spots, np.int64).reshape(-1, 3)
    samples = []
    for i in range(0, len(table), FRAMES):
        part = table[i : i + FRAMES]
        first = int(part[0, 0])
        near = whole[first : int(part[-1, 2]) + 16]
        x, end = _subframes(_Bits(near), 8 * (part[:, 0] + part[:, 1] - first), BLOCK, 8)
        samples.append(x.astype(np.int8))
        stop = (end + 7) // 8 + first
        if (stop + 2 != part[:, 2]).any():
            if find is not _walk:
                return [decode_streams([data], _walk)[0] for data in files]
            raise FlacError("a frame does not end where the next one starts")
        want = whole[stop].astype(np.uint32) << np.uint32(8) | whole[stop + 1]
        if (crc16_rows(whole, part[:, 0], stop - part[:, 0]) != want).any():
            raise FlacError("a frame's checksum is wrong")
    pcm = np.concatenate(samples) if samples else np.zeros((0, BLOCK), np.int8)
    out, at = [], 0
    for stream, n in zip(streams, counts, strict=True):
        signed = pcm[at : at + n].tobytes()
        at += n
        if hashlib.md5(signed).digest() != stream.md5:
            raise FlacError("the MD5 of the samples is wrong")
        out.append((np.frombuffer(signed, np.uint8) ^ 128).tobytes())
    return out


def pcm_at(data: bytes, sample: int, count: int) -> bytes:
    """Samples from a place in a file, decoded from the seek point before it only."""
    stream = Stream(data)
    at, byte = stream.offset_of(sample)
    if sample < 0 or sample + count > stream.total:
        raise FlacError("outside the file")
    out = []
    while at < sample + count:
        near = np.frombuffer(data[byte : byte + 64 * BLOCK] + bytes(16), np.uint8)
        head = len(_header(at // BLOCK))
        x, end = _subframes(_Bits(near), np.array([8 * head]), BLOCK, 8)
        out.append((x[0].astype(np.int8).view(np.uint8) ^ 128).tobytes())
        byte += (int(end[0]) + 7) // 8 + 2
        at += BLOCK
    skip = sample % BLOCK if not out else sample - (at - BLOCK * len(out))
    return b"".join(out)[skip : skip + count]


_crc8_known: dict[bytes, int] = {}


def crc8_cached(head: bytes) -> int:
    if head not in _crc8_known:
        if len(_crc8_known) > 65536:
            _crc8_known.clear()
        _crc8_known[head] = crc8(head)
    return _crc8_known[head]


def _header(number: int) -> bytes:
    """Of a frame: fixed blocks of 576, the stream's rate, mono, 8 bits."""
    head = b"\xff\xf8\x20\x02" + _coded_number(number)
    return head + bytes([crc8_cached(head)])


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def features(pcm: bytes) -> str:
    """Integer features of unsigned PCM: blocks, sum of squares about the middle, crossings of the middle, least and greatest."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int16) - 128
    power = int((x.astype(np.int64) ** 2).sum())
    return f"blocks={len(x) // BLOCK};power={power};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};min={int(x.min())};max={int(x.max())}"


_MEDIA = "doc_id long, n_bytes long, media binary"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column(batch, "doc_id")
        payloads = [payload_of(x) for x in texts(batch)]
        sizes = [len(x.encode()) for x in texts(batch)]
        at = 0
        while at < len(payloads):
            stop, size = at + 1, len(payloads[at])
            while stop < len(payloads) and size + len(payloads[stop]) <= TOGETHER:
                size += len(payloads[stop])
                stop += 1
            yield pa.RecordBatch.from_arrays([ids[at:stop], pa.array(sizes[at:stop], pa.int64()), pa.array(encode_streams(payloads[at:stop]), pa.binary())], ["doc_id", "n_bytes", "media"])
            at = stop


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a FLAC file of 8-bit samples, padded with 255 to full blocks.

    Null texts are empty, and an empty text is one block of 255. Null ids, repeated rows and other columns do no harm;
    an empty table gives no rows. Write the result as a table to keep it.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_encoded, _MEDIA)


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, files = column(batch, "doc_id"), column(batch, "n_bytes"), column(batch, "media").to_pylist()
        at = 0
        while at < len(files):
            stop, size = at + 1, len(files[at])
            while stop < len(files) and size + len(files[stop]) <= TOGETHER:
                size += len(files[stop])
                stop += 1
            pcm, own = decode_streams(files[at:stop]), files[at:stop]
            yield pa.RecordBatch.from_arrays([
                ids[at:stop], sizes[at:stop], pa.array([len(x) for x in pcm], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in pcm]),
                pa.array([zlib.crc32(x[-32:]) for x in pcm], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in own]), pa.array([features(x) for x in pcm]),
            ], [x.split()[0] for x in _READ.split(", ")])
            at = stop


def media_digests(media: DataFrame) -> DataFrame:
    """Decode media from encode_media, check all frames, and digest what was read back; a damaged file fails the task."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decoded, _READ)


_BLOCKS = "doc_id long, sample long, byte long, pcm binary"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(column(batch, "doc_id").to_pylist(), column(batch, "media").to_pylist(), strict=True):
            pcm, starts = decode_streams([data])[0], [at for at, _ in _sought(data, Stream(data))]
            sample = np.arange(0, len(pcm), BLOCK)
            for at in range(0, len(starts), FRAMES):
                part = slice(at, at + FRAMES)
                blocks = pa.array([pcm[x : x + BLOCK] for x in sample[part].tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks), pa.int64()), pa.array(sample[part]), pa.array(starts[part], pa.int64()), blocks], [x.split()[0] for x in _BLOCKS.split(", ")])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, sample, byte, pcm) of every frame of media from encode_media: a block of unsigned 8-bit samples, the number of
    its first sample, and the place in the file where a reader that seeks it starts."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_unpacked, _BLOCKS)


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 3: every text as FLAC and back."""
    return media_digests(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
