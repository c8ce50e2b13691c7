"""A small FLAC writer for tests: constant, verbatim, fixed and linear subframes, Rice partitions, all channel modes."""

import numpy as np

from tessitura.sources.flac import crc8, crc16


class Out:
    def __init__(self):
        self.text = []

    def put(self, value, bits):
        if bits:
            self.text.append(format(value & (1 << bits) - 1, f"0{bits}b"))

    def unary(self, n):
        self.text.append("0" * n + "1")

    def bytes(self):
        text = "".join(self.text)
        text += "0" * (-len(text) % 8)
        return int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:]


def rice(out, residual, size, order, parts_log, wide):
    out.put(1 if wide else 0, 2)
    out.put(parts_log, 4)
    parts, at = 1 << parts_log, 0
    for n in range(parts):
        count = size // parts - (order if n == 0 else 0)
        part = residual[at : at + count]
        at += count
        if n == parts - 1 and count < 40:  # escaped: plain numbers
            width = max(1, max((int(abs(v)).bit_length() + 1 for v in part), default=1))
            out.put(31 if wide else 15, 5 if wide else 4)
            out.put(width, 5)
            for v in part:
                out.put(int(v), width)
            continue
        k = max(0, min(14, int(np.log2(np.mean(np.abs(part)) + 1)) if count else 0))
        out.put(k, 5 if wide else 4)
        for v in part:
            u = (int(v) << 1) ^ (int(v) >> 63)
            out.unary(u >> k)
            out.put(u, k)


def subframe(out, x, width, kind, parts_log=2, wide=False):
    wasted = 0
    if len(x) and np.any(x) and not np.any(x & 3):
        wasted = 2
        x = x >> 2
        width -= 2
    name, order = kind
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[name]
    out.put(0, 1)
    out.put(code, 6)
    out.put(1 if wasted else 0, 1)
    if wasted:
        out.unary(wasted - 1)
    if name == "constant":
        out.put(int(x[0]), width)
    elif name == "verbatim":
        for v in x:
            out.put(int(v), width)
    else:
        for v in x[:order]:
            out.put(int(v), width)
        if name == "fixed":
            residual = np.diff(x, order)
        else:
            weights, shift = [int(round(v * 64)) for v in np.linspace(1.6, -0.7, order)], 6
            out.put(11, 4)
            out.put(shift, 5)
            for v in weights:
                out.put(v, 12)
            residual = [int(x[n]) - (sum(w * int(x[n - 1 - j]) for j, w in enumerate(weights)) >> shift) for n in range(order, len(x))]
        rice(out, residual, len(x), order, parts_log, wide)


def number(n):
    if n < 128:
        return bytes([n])
    more = 1
    while n >= 1 << (6 - more + 6 * more):
        more += 1
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | n >> 6 * more]) + bytes(0x80 | n >> 6 * j & 63 for j in range(more - 1, -1, -1))


def write(x, rate=8000, bits=16, block=512, kinds=(("fixed", 2),), modes=(1,), tags=None, wide=False):
    """The file of x (samples x channels, integers); kinds and modes take turns over the frames."""
    x = np.asarray(x, "int64")
    channels, frames = x.shape[1], []
    for n, a in enumerate(range(0, len(x), block)):
        part, kind, mode = x[a : a + block], kinds[n % len(kinds)], modes[n % len(modes)] if channels == 2 else channels - 1
        last = len(part) < block
        head = bytes([0xFF, 0xF8, 7 << 4, (mode << 4) | {16: 4, 24: 6, 8: 1}[bits] << 1]) + number(n) + (len(part) - 1).to_bytes(2, "big")
        head += bytes([crc8(head)])
        left, right = part[:, 0], part[:, -1]
        subs = {8: [left, left - right], 9: [left - right, right], 10: [(left + right) >> 1, left - right]}.get(mode, [part[:, c] for c in range(channels)])
        widths = {8: [bits, bits + 1], 9: [bits + 1, bits], 10: [bits, bits + 1]}.get(mode, [bits] * channels)
        out = Out()
        for s, w in zip(subs, widths):
            own = ("verbatim", 0) if last and len(part) < 16 else ("fixed", 1) if kind[0] == "constant" and np.any(s != s[0]) else kind
            subframe(out, s, w, own, 0 if last else 2, wide)
        data = head + out.bytes()
        frames.append(data + crc16(data).to_bytes(2, "big"))
    packed = rate << 44 | channels - 1 << 41 | bits - 1 << 36 | len(x)
    info = block.to_bytes(2, "big") * 2 + (0).to_bytes(3, "big") + max(map(len, frames)).to_bytes(3, "big") + packed.to_bytes(8, "big") + bytes(16)
    entries = [f"{k}={v}".encode() for k, v in (tags or {}).items()]
    comments = (4).to_bytes(4, "little") + b"test" + len(entries).to_bytes(4, "little") + b"".join(len(e).to_bytes(4, "little") + e for e in entries)
    blocks = bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + len(comments).to_bytes(3, "big") + comments
    return b"fLaC" + blocks + b"".join(frames), [4 + len(blocks) + sum(map(len, frames[:n])) for n in range(len(frames))]
