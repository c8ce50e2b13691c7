"""FLAC frames: headers, Rice residuals, fixed and linear prediction, stereo decorrelation; and finding a frame by its number.

A frame carries the number of its first sample, so decoding can begin at any frame: sync words in a stretch of bytes are
candidates, the header's CRC-8 confirms them, and bisection over the file finds the frame that holds a sample."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from operator import mul

import numpy as np

# Fixed values of the format: sample rates by code, bits by code, fixed predictors' order by subframe code.
RATES = {1: 88_200, 2: 176_400, 3: 192_000, 4: 8_000, 5: 16_000, 6: 22_050, 7: 24_000, 8: 32_000, 9: 44_100, 10: 48_000, 11: 96_000}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(poly: int, bits: int) -> list[int]:
    table = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        table.append(c & ((1 << bits) - 1))
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Info:
    """STREAMINFO, tags, and where frames begin."""

    rate: int
    channels: int
    bits: int
    frames: int
    most_block: int
    most_bytes: int
    begin: int
    tags: dict


@dataclass(frozen=True)
class Header:
    at: int  # the frame's first byte
    body: int  # the first byte after the header
    start: int  # its first sample
    size: int  # samples a channel
    mode: int  # channel assignment
    bits: int


def read_info(read, most_comment: int = 1 << 20) -> Info:
    """read(offset, n) -> bytes. Metadata blocks are passed by their sizes; of pictures and padding nothing is read."""
    if read(0, 4) != b"fLaC":
        raise ValueError("not a FLAC file")
    at, info, tags = 4, None, {}
    while True:
        head = read(at, 4)
        if len(head) < 4:
            raise ValueError("metadata ends early")
        kind, size = head[0] & 127, int.from_bytes(head[1:], "big")
        if kind == 0:
            body = read(at + 4, 34)
            if len(body) < 34:
                raise ValueError("STREAMINFO ends early")
            _, most_block, _, most_bytes = struct.unpack(">HH", body[:4]) + (int.from_bytes(body[4:7], "big"), int.from_bytes(body[7:10], "big"))
            packed = int.from_bytes(body[10:18], "big")
            info = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, most_block, most_bytes)
        elif kind == 4 and size <= most_comment:
            tags = _comments(read(at + 4, size))
        at += 4 + size
        if head[0] & 128:
            break
    if info is None:
        raise ValueError("no STREAMINFO")
    return Info(*info, at, tags)


def _comments(body: bytes) -> dict[str, str]:
    try:
        (skip,) = struct.unpack_from("<I", body)
        (count,) = struct.unpack_from("<I", body, 4 + skip)
        at, tags = 8 + skip, {}
        for _ in range(count):
            (n,) = struct.unpack_from("<I", body, at)
            key, _, value = body[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
            tags.setdefault(key.lower(), value)
            at += 4 + n
        return tags
    except struct.error:
        return {}


def parse_header(data: bytes, at: int, info: Info) -> Header | None:
    """The frame header at data[at:], or None where it is none that belongs to this stream."""
    try:
        if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
            return None
        size_code, rate_code, mode, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
        if size_code == 0 or rate_code == 15 or mode > 10 or bits_code == 3 or data[at + 3] & 1:
            return None
        first, end = data[at + 4], at + 5
        more = 0 if first < 128 else 8 - (first ^ 255).bit_length() - 1
        number = first if first < 128 else first & (0x3F >> more)
        if first >= 128 and not 1 <= more <= 6:
            return None
        for b in data[end : end + more]:
            if b & 0xC0 != 0x80:
                return None
            number = number << 6 | b & 63
        end += more
        if size_code in (6, 7):
            size = int.from_bytes(data[end : end + size_code - 5], "big") + 1
            end += size_code - 5
        else:
            size = 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8
        end += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
        bits = BITS.get(bits_code, info.bits)
        if end >= len(data) or crc8(data[at:end]) != data[end] or (2 if mode > 7 else mode + 1) != info.channels or bits != info.bits:
            return None
    except IndexError:
        return None
    return Header(at, end + 1, number if data[at + 1] & 1 else number * info.most_block, size, mode, bits)


def headers(data: bytes, info: Info, at: int = 0):
    """All frame headers in a stretch of bytes, in order."""
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        found = parse_header(data, at, info) if data[at + 1] & 0xFE == 0xF8 else None
        if found:
            yield found
        at += 1


class Bits:
    """A frame's bits with, for each place, the place of the next 1: unary codes are read by looking up."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        n = len(self.bits)
        place = np.where(self.bits, np.arange(n), n)
        self.next_one = np.minimum.accumulate(place[::-1])[::-1].tolist()
        self.number = int.from_bytes(data, "big")
        self.total, self.at = n, 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > self.total:
            raise ValueError("a frame ends early")
        return self.number >> self.total - self.at & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def unary(self) -> int:
        one = self.next_one[self.at]
        n, self.at = one - self.at, one + 1
        if self.at > self.total:
            raise ValueError("a frame ends early")
        return n

    def array(self, count: int, width: int) -> np.ndarray:
        """count signed numbers of a width."""
        if not width:
            return np.zeros(count, "int64")
        cells = self.bits[self.at : self.at + count * width].reshape(count, width).astype("int64")
        self.at += count * width
        values = cells @ (1 << np.arange(width - 1, -1, -1, dtype="int64"))
        return values - (cells[:, 0] << width)

    def rice(self, count: int, k: int) -> np.ndarray:
        ends, at, next_one, step = [], self.at, self.next_one, k + 1
        starts = []
        try:
            for _ in range(count):
                one = next_one[at]
                starts.append(at)
                ends.append(one)
                at = one + step
        except IndexError:
            raise ValueError("a frame ends early") from None
        if at > self.total:
            raise ValueError("a frame ends early")
        self.at = at
        one = np.array(ends, "int64")
        value = one - np.array(starts, "int64")
        for j in range(1, k + 1):
            value = value << 1 | self.bits[one + j]
        return value >> 1 ^ -(value & 1)


def _residual(bits: Bits, size: int, order: int) -> np.ndarray:
    wide = 5 if bits.take(2) == 1 else 4
    parts = 1 << bits.take(4)
    out = []
    for n in range(parts):
        count = size // parts - (order if n == 0 else 0)
        if count < 0 or size % parts:
            raise ValueError("bad partition")
        k = bits.take(wide)
        out.append(bits.array(count, bits.take(5)) if k == (1 << wide) - 1 else bits.rice(count, k))
    return np.concatenate(out)


def _subframe(bits: Bits, size: int, width: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("bad subframe")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        x = np.full(size, bits.signed(width), "int64")
    elif kind == 1:
        x = bits.array(size, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        x = _fixed(bits.array(order, width), bits, size, order)
    elif kind >= 32:
        order = kind - 31
        warm = bits.array(order, width).tolist()
        precision, shift = bits.take(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise ValueError("bad predictor")
        weights = bits.array(order, precision).tolist()[::-1]
        x = list(warm)
        for r in _residual(bits, size, order).tolist():
            x.append(r + (sum(map(mul, weights, x[-order:])) >> shift))
        x = np.array(x, "int64")
    else:
        raise ValueError("bad subframe")
    return x << wasted


def _fixed(warm: np.ndarray, bits: Bits, size: int, order: int) -> np.ndarray:
    """Residuals are differences of some order: as many running sums undo them."""
    x = _residual(bits, size, order)
    for level in range(order, 0, -1):
        before = np.diff(warm, level - 1)  # the (level - 1)th difference just before x
        x = np.cumsum(np.concatenate([before[-1:], x]))[1:]
    return np.concatenate([warm, x])


def decode_frame(frame: bytes, header: Header) -> np.ndarray:
    """size x channels integers of the frame at the start of these bytes; ValueError where it is damaged.

    The subframes tell where the frame ends, and its checksum stands there."""
    bits = Bits(frame[header.body - header.at :])
    mode = header.mode
    widths = [header.bits] * (mode + 1) if mode < 8 else [header.bits + (mode == 9), header.bits + (mode in (8, 10))]
    parts = [_subframe(bits, header.size, w) for w in widths]
    end = header.body - header.at + -(-bits.at // 8)
    if crc16(frame[:end]) != int.from_bytes(frame[end : end + 2], "big") or end + 2 > len(frame):
        raise ValueError("checksum")
    if mode == 8:  # left and side
        parts[1] = parts[0] - parts[1]
    elif mode == 9:  # side and right
        parts[0] = parts[1] + parts[0]
    elif mode == 10:  # mid and side
        mid = parts[0] << 1 | parts[1] & 1
        parts = [mid + parts[1] >> 1, mid - parts[1] >> 1]
    return np.stack(parts, axis=1)


def find_frame(read, length: int, info: Info, sample: int, step: int = 1 << 16) -> int:
    """The offset of a frame that begins at or before a sample and near it, by bisection over the bytes.

    A header counts where the next one follows it in number, as a checksum of 8 bits alone is met by chance."""
    low, high, best = info.begin, length, info.begin
    step = max(step, 3 * info.most_bytes)
    while high - low > step:
        middle = (low + high) // 2
        found = list(headers(read(middle, step), info))
        starts = {h.start for h in found}
        first = next((h for h in found if h.start + h.size in starts), None)
        if first is None or first.start > sample:
            high = middle
        else:
            best, low = middle + first.at, middle + max(1, first.at)
    return best


def frames(read, info: Info, at: int, step: int = 1 << 17):
    """(header, bytes) of all frames from an offset on. A frame ends where the header of the next one's number begins; where there
    is none within reach, at the next header of a later number."""
    data, base, here, reach, expected = b"", at, 0, max(2 * info.most_bytes, 1 << 18), 0
    while True:
        head = next((h for h in headers(data, info, here) if h.start >= expected), None)
        while head is None and (fresh := read(base + len(data), step)):
            data += fresh
            head = next((h for h in headers(data, info, here) if h.start >= expected), None)
        if head is None:
            return
        expected = head.start + head.size
        while True:
            later = [h for h in headers(data, info, head.body) if h.start >= expected]
            end = next((h.at for h in later if h.start == expected), None)
            if end is not None or len(data) - head.at > reach or not (fresh := read(base + len(data), step)):
                break
            data += fresh
        if end is None:
            end = later[0].at if later else len(data)
        yield head, data[head.at : end]
        here = end
        if here > 4 * step:
            data, base, here = data[here:], base + here, 0


def decode_range(read, length: int, info: Info, first: int, behind: int):
    """(start, size, samples or None, error or None) of what holds samples first to behind - 1, in order: frames, and gaps where
    no frame's header was found."""
    known = None
    for head, data in frames(read, info, find_frame(read, length, info, first) if first else info.begin):
        if known is not None and head.start > known and head.start > first and known < behind:
            yield known, head.start - known, None, f"no frame at sample {known}"
        known = head.start + head.size
        if head.start >= behind:
            return
        if known > first:
            try:
                yield head.start, head.size, decode_frame(data, head), None
            except (ValueError, IndexError) as e:
                yield head.start, head.size, None, f"frame at sample {head.start}: {e}"
    known = first if known is None else max(known, first)
    if known < behind:
        yield known, behind - known, None, f"no frame at sample {known}"
