"""FLAC columns: an encoder and a decoder for mono 8-bit streams, and PCM blocks with their sample offsets.

A byte b of the payload is the signed sample b - 128. Frames hold ``BLOCK`` samples, in the smallest of a constant,
verbatim, fixed or general linear predictor with Rice-coded residuals. The decoder reads all of these, checks the CRC-8 of each
header, the CRC-16 of each frame and the MD5 of the stream, and a seek table gives each frame's first sample and offset.
A Rice code or a predicted sample is known only from those before it, so many frames are decoded side by side, a sample of each at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE, UNIT = 4096, 8000, 192
LPC_PRECISION, LPC_ORDER = 10, 4
TOGETHER = 256
"""Frames that are decoded side by side."""
#: Coefficients of the fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _byte_table(poly: int, bits: int) -> np.ndarray:
    """Remainder of each byte value, the most significant bit first."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out & top, (out << 1) ^ poly, out << 1) & mask
    return out


CRC8, CRC16 = _byte_table(0x07, 8), _byte_table(0x8005, 16)


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


class _Crc16:
    """CRC-16 of a frame as the XOR of table entries by byte and distance from the end: the code is linear."""

    def __init__(self) -> None:
        self.table = CRC16[None, :].astype(np.uint16)

    def __call__(self, data: np.ndarray) -> int:
        while len(self.table) < len(data):
            last = self.table[-1].astype(np.int64)
            more = [last := CRC16[last >> 8] ^ (last << 8) & 0xFFFF for _ in range(1024)]
            self.table = np.concatenate([self.table, np.array(more, np.uint16)])
        return int(np.bitwise_xor.reduce(self.table[np.arange(len(data) - 1, -1, -1), data]))


_crc16 = _Crc16()


def _numbered(n: int) -> bytes:
    """The frame number in the variable-length form of UTF-8, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 1
    while n >= 1 << (6 - size):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        size += 1
    return bytes([0xFF00 >> size & 0xFF | n, *reversed(tail)])


def _residual(samples: np.ndarray, coefs: tuple | np.ndarray, shift: int) -> np.ndarray:
    order = len(coefs)
    if order == 1 and not shift:
        return np.diff(samples)
    predicted = np.zeros(len(samples) - order, samples.dtype)
    for back, c in enumerate(coefs, 1):
        predicted += int(c) * samples[order - back : len(samples) - back]
    return samples[order:] - (predicted >> shift)


def _rice(residual: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Zigzag form of the residual, its best Rice parameter, and the size in bits.

    The best parameter is within one of the logarithm of the mean.
    """
    folded = (residual << 1) ^ (residual >> 31)
    n = max(len(folded), 1)
    near = int(np.log2(max(float(folded.sum(dtype=np.int64)) / n, 1.0)))
    size, k = min((int((folded >> k).sum(dtype=np.int64)) + n * (k + 1), k) for k in range(max(0, near - 1), min(near + 1, 14) + 1))
    return folded, k, size


def _lpc(samples: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    """Quantised predictor coefficients from the autocorrelation of the samples, and their shift; none where it determines none."""
    x = samples.astype(float)
    r = np.array([x @ x, *(x[:-lag] @ x[lag:] for lag in range(1, order + 1))])
    try:
        found = np.linalg.solve(r[np.abs(np.subtract.outer(range(order), range(order)))], r[1:])
    except np.linalg.LinAlgError:
        return np.zeros(0, np.int64), 0
    top = 2 ** (LPC_PRECISION - 1) - 1
    shift = max(0, min(14, int(np.floor(np.log2(top / max(np.abs(found).max(), 1e-9))))))
    return np.clip(np.rint(found * 2**shift), -top, top).astype(np.int64), shift


def _bits(value: int, width: int) -> np.ndarray:
    return np.array([value >> i & 1 for i in range(width - 1, -1, -1)], np.uint8)


def _rice_bits(folded: np.ndarray, k: int) -> np.ndarray:
    """Each value as its quotient in unary, ended by a one, then k bits."""
    stops = np.cumsum((folded >> k) + (1 + k), dtype=np.int32) - (1 + k)
    out = np.zeros(int(stops[-1]) + 1 + k if len(stops) else 0, np.uint8)
    out[stops] = 1
    rest = folded.astype(np.uint16)
    for bit in range(k):
        stops += 1
        out[stops] = (rest >> (k - 1 - bit)) & 1
    return out


def _frame(samples: np.ndarray, number: int, lpc: bool) -> bytes:
    n = len(samples)
    header = bytes([0xFF, 0xF8, 0x70 | 0x04, 0x02]) + _numbered(number) + struct.pack(">H", n - 1)
    parts = [np.zeros(1, np.uint8)]
    if (samples == samples[0]).all():
        parts += [_bits(0, 7), _bits(int(samples[0]) & 0xFF, 8)]
    else:
        plans = [(8 * n, None)]
        predictors = [(8 + o, c, 0) for o, c in enumerate(FIXED[: 2 if lpc else 3]) if o < n]
        if lpc and n > 4 * LPC_ORDER and len((general := _lpc(samples, LPC_ORDER))[0]):
            predictors.append((32 + LPC_ORDER - 1, *general))
        for kind, coefs, shift in predictors:
            folded, k, size = _rice(_residual(samples, coefs, shift))
            plans.append((size + 8 * len(coefs) + (len(coefs) * LPC_PRECISION + 9) * (kind >= 32), (kind, coefs, shift, folded, k)))
        _, plan = min(plans, key=lambda p: p[0])
        if plan is None:
            parts += [_bits(1, 6), _bits(0, 1), np.unpackbits(samples.astype(np.int8).view(np.uint8))]
        else:
            kind, coefs, shift, folded, k = plan
            parts += [_bits(kind, 6), _bits(0, 1), np.unpackbits(samples[: len(coefs)].astype(np.int8).view(np.uint8))]
            if kind >= 32:
                parts += [_bits(LPC_PRECISION - 1, 4), _bits(shift, 5)] + [_bits(int(c) & (1 << LPC_PRECISION) - 1, LPC_PRECISION) for c in coefs]
            parts += [_bits(0, 2), _bits(0, 4), _bits(k, 4), _rice_bits(folded, k)]
    body = np.packbits(np.concatenate(parts)).tobytes()
    whole = header + bytes([_crc8(header)]) + body
    return whole + struct.pack(">H", _crc16(np.frombuffer(whole, np.uint8)))


def encode(payload: bytes, lpc: bool = True) -> bytes:
    """The payload as a FLAC stream with STREAMINFO and SEEKTABLE. An empty payload has no frame.

    Each frame takes the smallest of its forms: constant, verbatim, fixed predictors up to order 1, and a general one of order
    ``LPC_ORDER``, or without ``lpc`` fixed ones up to order 2.
    """
    samples = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    frames = [_frame(samples[at : at + BLOCK], i, lpc) for i, at in enumerate(range(0, len(samples), BLOCK))]
    sizes = [len(f) for f in frames] or [0]
    digest = hashlib.md5(samples.astype(np.int8).tobytes()).digest()
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(samples)).to_bytes(8, "big") + digest
    points, offset = b"", 0
    for i, f in enumerate(frames):
        points += struct.pack(">QQH", i * BLOCK, offset, min(BLOCK, len(samples) - i * BLOCK))
        offset += len(f)
    blocks = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
    return b"fLaC" + blocks + b"".join(frames)


class _Reader:
    """Bits of one frame, one per byte."""

    def __init__(self, data: np.ndarray) -> None:
        self.bits, self.at = np.unpackbits(data), 0
        self.bytes = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        self.text = self.bits.tobytes()

    def take(self, width: int) -> int:
        self.at += width
        return int(self.text[self.at - width : self.at].translate(_AS_DIGITS) or b"0", 2)

    def signed(self, width: int) -> int:
        value = self.take(width)
        return value - (value >> (width - 1) << width) if width else 0

    def samples(self, n: int, width: int) -> np.ndarray:
        """n signed numbers of ``width`` bits."""
        block = self.bits[self.at : self.at + n * width].reshape(n, width).astype(np.int64)
        self.at += n * width
        value = block @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        return value - (block[:, 0] << width) if width else value

    def rice(self, n: int, k: int) -> np.ndarray:
        """n Rice codes. Where each starts is known only from the one before; the values are then cut out at once."""
        find, at, stops = self.text.find, self.at, []
        note, step = stops.append, 1 + k
        for _ in range(n):
            at = find(b"\x01", at)
            note(at)
            at += step
        ends = np.array(stops, np.int32)
        if n and (ends.min() < self.at or at > len(self.bits)):
            raise ValueError("a residual runs beyond its frame")
        value = ends - self.at
        value[1:] = np.diff(ends) - step
        if k:
            first = ends + 1
            byte = first >> 3
            window = self.bytes[byte] << 16 | self.bytes[byte + 1] << 8 | self.bytes[byte + 2]
            value = value << k | window >> (24 - k - (first & 7)) & ((1 << k) - 1)
        self.at = at
        return (value >> 1) ^ -(value & 1)


_AS_DIGITS = bytes([48, 49]) + bytes(range(2, 256))


def _predicted(warm: np.ndarray, residual: np.ndarray, coefs: tuple | list, shift: int) -> np.ndarray:
    order = len(coefs)
    if shift == 0 and order < len(FIXED) and tuple(coefs) == FIXED[order]:
        # A fixed predictor is a difference of that order: undo it by as many running sums.
        head = [warm]
        for _ in range(order - 1):
            head.append(np.diff(head[-1]))
        out = residual
        for level in reversed(head[:order]):
            out = np.cumsum(np.concatenate([level[-1:], out]))[1:]
        return np.concatenate([warm, out])
    out = warm.tolist()
    back = list(reversed([int(c) for c in coefs]))
    for r in residual.tolist():
        out.append(r + (sum(c * s for c, s in zip(back, out[-order:], strict=True)) >> shift))
    return np.array(out, np.int64)


def _block_size(code: int) -> int | None:
    """Samples in a frame by the code of its header; None where they follow the header's number."""
    if code == 1:
        return UNIT
    if 2 <= code <= 5:
        return 576 << (code - 2)
    return None if code in (6, 7) else 256 << (code - 8)


def _subframe(bits: _Reader, n: int, width: int) -> np.ndarray:
    bits.take(1)
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = 1
        while not bits.take(1):
            wasted += 1
        width -= wasted
    if kind == 0:
        out = np.full(n, bits.signed(width), np.int64)
    elif kind == 1:
        out = bits.samples(n, width)
    else:
        fixed = 8 <= kind <= 12
        if not fixed and kind < 32:
            raise ValueError(f"subframe type {kind} is reserved")
        order = kind - 8 if fixed else kind - 31
        warm, coefs, shift = bits.samples(order, width) if order else np.zeros(0, np.int64), FIXED[order] if fixed else (), 0
        if not fixed:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            coefs = bits.samples(order, precision).tolist()
        parameter, partitions = 4 + bits.take(2), 1 << bits.take(4)
        parts = []
        for i in range(partitions):
            count = n // partitions - (order if i == 0 else 0)
            k = bits.take(parameter)
            if k == (1 << parameter) - 1:
                raw = bits.take(5)
                parts.append(bits.samples(count, raw) if raw else np.zeros(count, np.int64))
            else:
                parts.append(bits.rice(count, k))
        out = _predicted(warm, np.concatenate(parts), coefs, shift)
    return out << wasted


class _Head:
    """Fields at the start of a subframe."""

    def __init__(self, data: np.ndarray) -> None:
        self.size = 8 * min(len(data), 100)
        self.value, self.at = int.from_bytes(data[:100].tobytes(), "big"), 0

    def take(self, width: int) -> int:
        self.at += width
        return self.value >> (self.size - self.at) & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        value = self.take(width)
        return value - (value >> (width - 1) << width)


def _common(data: np.ndarray, n: int) -> tuple | None:
    """(order, first samples, coefficients, shift, Rice parameter, where the codes start) of a subframe of linear prediction with one
    partition of Rice codes; None of any other."""
    head = _Head(data)
    head.take(1)
    kind = head.take(6)
    if head.take(1) or not (8 <= kind <= 12 or kind >= 32):
        return None
    order = kind - 8 if kind < 32 else kind - 31
    if order >= n or 8 * order + (15 * order + 9) * (kind >= 32) + 32 > head.size:
        return None
    warm, coefs, shift = [head.signed(8) for _ in range(order)], FIXED[order] if kind < 32 else (), 0
    if kind >= 32:
        precision, shift = head.take(4) + 1, head.signed(5)
        coefs = tuple(head.signed(precision) for _ in range(order))
    if head.take(2) or head.take(4):  # longer parameters, several partitions
        return None
    k = head.take(4)
    return None if k == 15 or shift < 0 else (order, warm, coefs, shift, k, head.at)


def _side_by_side(subframes: list[tuple]) -> list[np.ndarray]:
    """Samples of subframes (data, n, fields as ``_common`` has them), which come in falling order of their codes' number."""
    counts = np.array([n - f[0] for _, n, f in subframes])
    data = np.concatenate([*(d for d, *_ in subframes), np.full(8, 255, np.uint8)])
    starts = np.cumsum([0, *(8 * len(d) for d, *_ in subframes)])
    k = np.array([f[4] for _, _, f in subframes], np.int32)
    bits = np.unpackbits(data)
    ones = np.flatnonzero(bits).astype(np.int32)
    before = np.cumsum(bits, dtype=np.int32)
    before -= bits
    stops = np.zeros((counts[0], len(counts)), np.int32)
    first = (starts[:-1] + [f[5] for _, _, f in subframes]).astype(np.int32)
    at, step = first.copy(), k + 1
    active = np.searchsorted(-counts, -np.arange(counts[0]), "left")
    try:
        for i, a in enumerate(active.tolist()):
            stop = stops[i, :a] = ones[before[at[:a]]]
            at[:a] = stop + step[:a]
    except IndexError:
        raise ValueError("a residual runs beyond its frame") from None
    if (at > starts[1:]).any():
        raise ValueError("a residual runs beyond its frame")
    value = stops - np.concatenate([first[None], stops[:-1] + step])
    byte, wide = (stops + 1) >> 3, data.astype(np.int32)
    window = wide[byte] << 16 | wide[byte + 1] << 8 | wide[byte + 2]
    value = value << k | window >> (24 - k - (stops + 1 & 7)) & ((1 << k) - 1)
    residual = (value >> 1) ^ -(value & 1)
    out: list = [None] * len(counts)
    general: dict[int, list[int]] = {}
    for i, (_, _, (order, warm, coefs, shift, *_)) in enumerate(subframes):
        if shift == 0 and order < len(FIXED) and coefs == FIXED[order]:
            out[i] = _predicted(np.array(warm, np.int64), residual[: counts[i], i], coefs, 0)
        else:
            general.setdefault(order, []).append(i)
    for order, own in general.items():
        samples = np.zeros((order + counts[own[0]], len(own)), np.int64)
        samples[:order] = np.array([subframes[i][2][1] for i in own]).T
        coefs = np.array([subframes[i][2][2][::-1] for i in own]).T
        shift, left = np.array([subframes[i][2][3] for i in own]), residual[:, own]
        for i, a in enumerate(np.searchsorted(-counts[own], -np.arange(counts[own[0]]), "left").tolist()):
            samples[order + i, :a] = left[i, :a] + ((coefs[:, :a] * samples[i : order + i, :a]).sum(0) >> shift[:a])
        for j, i in enumerate(own):
            out[i] = samples[: order + counts[i], j]
    return out


def _checked(stream: bytes) -> tuple[list[tuple[int, int, int, np.ndarray]], bytes]:
    """((first sample, offset, samples, subframe) of each frame, MD5) of a mono 8-bit stream, with the checksums of headers and frames checked."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, info = 4, False, b"", b""
    while not last:
        last, kind, size = stream[at] >= 0x80, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + size]
        if kind == 3:
            points = stream[at + 4 : at + 4 + size]
        at += 4 + size
    seek = list(struct.iter_unpack(">QQH", points))
    total = int.from_bytes(info[10:18], "big") & (1 << 36) - 1
    if sum(p[2] for p in seek) != total:
        raise ValueError("the seek table does not cover the stream")
    ends = [p[1] for p in seek[1:]] + [len(stream) - at]
    out = []
    for (first, offset, count), after in zip(seek, ends, strict=False):
        data = np.frombuffer(stream, np.uint8, after - offset, at + offset)
        if _crc16(data[:-2]) != int(data[-2]) << 8 | int(data[-1]):
            raise ValueError(f"frame at sample {first}: its CRC-16 is wrong")
        code, lead = int(data[2]) >> 4, int(data[4])
        size = 5 if lead < 0x80 else 12 - (lead ^ 0xFF).bit_length()
        n = _block_size(code)
        if n is None:
            width = code - 5
            n = int.from_bytes(data[size : size + width].tobytes(), "big") + 1
            size += width
        if _crc8(data[:size].tobytes()) != int(data[size]):
            raise ValueError(f"frame at sample {first}: its CRC-8 is wrong")
        if n != count:
            raise ValueError(f"frame at sample {first} has {n} samples, the seek table {count}")
        out.append((first, offset, n, data[size + 1 : -2]))
    return out, info[18:34]


Frames = list[tuple[int, int, np.ndarray]]


def frames_of(streams: list[bytes | None]) -> list[Frames | None]:
    """[(first sample, offset from the first frame, samples), ...] of each mono 8-bit stream, checked; None of a null one.

    The seek table bounds the frames; a stream without it, or with a wrong checksum, raises ValueError.
    """
    opened = [None if s is None else _checked(s) for s in streams]
    bodies = [(data, n) for o in opened if o is not None for _, _, n, data in o[0]]
    fields = [_common(data, n) for data, n in bodies]
    samples = [None if f is not None else _subframe(_Reader(d), n, 8) for (d, n), f in zip(bodies, fields, strict=True)]
    common = sorted((i for i, f in enumerate(fields) if f is not None), key=lambda i: fields[i][0] - bodies[i][1])
    for at in range(0, len(common), TOGETHER):
        some = common[at : at + TOGETHER]
        for i, found in zip(some, _side_by_side([(*bodies[i], fields[i]) for i in some]), strict=True):
            samples[i] = found
    out, rest = [], iter(samples)
    for o in opened:
        if o is None:
            out.append(None)
            continue
        own = [(first, offset, next(rest)) for first, offset, _, _ in o[0]]
        if hashlib.md5(b"".join(s.astype(np.int8).tobytes() for _, _, s in own)).digest() != o[1]:
            raise ValueError("the stream's MD5 is wrong")
        out.append(own)
    return out


def _pcm(samples: np.ndarray) -> bytes:
    return (samples + 128).astype(np.uint8).tobytes()


def decode(stream: bytes) -> bytes:
    """The payload of a stream that ``encode`` made."""
    return b"".join(_pcm(s) for _, _, s in frames_of([stream])[0])


def payload(text: str | None) -> bytes:
    """UTF-8 of the text, padded with spaces to a positive multiple of ``UNIT``."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


STREAMS_AT_ONCE = 500


def _some_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``STREAMS_AT_ONCE`` rows, to bound what a worker holds."""
    for whole in batches:
        yield from (whole.slice(start, STREAMS_AT_ONCE) for start in range(0, whole.num_rows, STREAMS_AT_ONCE))


def encode_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", lpc: bool = True) -> DataFrame:
    """(key, n_bytes, media): each whole text's payload as FLAC. A null text counts as empty.

    Repeated rows have a row each; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_at_once(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                    pa.array([encode(payload(t), lpc) for t in texts], pa.binary()),
                ],
                [key, "n_bytes", "media"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


Block = tuple[int, int, bytes]


def _blocks_of(streams: list[bytes | None]) -> list[list[Block] | None]:
    """(first sample, offset, PCM) of each frame of each stream."""
    return [own and [(first, offset, _pcm(s)) for first, offset, s in own] for own in frames_of(streams)]


BLOCKS = "array<struct<first_sample:long,media_offset:long,pcm:binary>>"


def with_blocks(media: DataFrame) -> DataFrame:
    """Adds ``blocks`` to all columns, in place of such a column: the decoded frames of ``media`` in order, null for a null stream.

    Each has its PCM bytes, the first sample's number and the frame's offset in the stream. A damaged stream raises ValueError.
    """
    media = media.drop("blocks")
    at = media.columns.index("media")
    kind = pa.list_(pa.struct([("first_sample", pa.int64()), ("media_offset", pa.int64()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_at_once(batches):
            blocks = _blocks_of(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, kind)], [*batch.schema.names, "blocks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{fields}, blocks {BLOCKS}")


def pcm_blocks(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, first_sample, media_offset, pcm): a row for each decoded frame; a null stream has none."""
    found = with_blocks(media.select(key, "media"))
    return found.select(key, F.posexplode("blocks").alias("block", "b")).select(key, "block", "b.*")


def feature(data: bytes) -> str:
    """Number, sum, energy, zero crossings and peak of the samples, in whole numbers."""
    s = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    crossings = int((np.diff(s >= 0)).sum())
    return f"n={len(s)};sum={int(s.sum())};energy={int((s * s).sum())};crossings={crossings};peak={int(np.abs(s).max(initial=0))}"


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of each stored stream, from the PCM blocks that are read back from it.

    A null stream has nulls. Repeated rows have a row each; columns besides ``n_bytes`` are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_at_once(batches):
            rows, streams = [], batch.column(2).to_pylist()
            for stream, blocks in zip(streams, _blocks_of(streams), strict=True):
                if stream is None:
                    rows.append((None,) * 6)
                    continue
                data = b"".join(pcm for _, _, pcm in blocks)
                rows.append((
                    len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]),
                    len(stream), hashlib.sha256(stream).hexdigest(), feature(data),
                ))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                [key, "n_bytes", *[f.split()[0] for f in DIGEST.split(", ")]],
            )

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, {DIGEST}")
