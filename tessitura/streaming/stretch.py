"""Time stretch of audio that arrives in chunks: what the vocoder carries from one frame to the next is the state of a track."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

BLOCK_OUT = 4096
OUT = "track_id bigint, block_no bigint, samples array<double>"
#: numbers and arrays that a Stretcher carries, in the order of the state's columns
_NUMBERS = ("step", "heard", "base", "raw_base", "given")
_ARRAYS = ("buffer", "phase", "turn", "tail", "norm", "raw")
_STATE = ", ".join([*(f"{n} bigint" for n in (*_NUMBERS, "expected", "passed", "blocks")), *(f"{a} binary" for a in (*_ARRAYS, "pending"))])


class Stretcher:
    """A phase vocoder and a resampler after it, fed piece by piece: together the pieces' output is that of the whole.

    Samples are (channels, n). A step analyses a frame and the one a hop later, which are hop * rate apart from step to step, and
    lays its synthesis over the last ones. The half frame of zeros before the track is latency, skipped at the front."""

    def __init__(self, speed: float, semitones: float = 0.0, channels: int = 1, frame: int = 1024):
        self.speed, self.factor, self.frame, self.hop = min(4.0, max(0.25, speed)), 2 ** (semitones / 12), frame, frame // 4
        self.same = abs(self.speed - 1) < 1e-4 and abs(semitones) < 1e-4
        self.rate = self.speed / self.factor
        self.window, self.expected_turn = np.hanning(frame), 2 * np.pi * self.hop * np.arange(frame // 2 + 1) / frame
        self.step = self.heard = self.base = self.given = 0
        self.raw_base = -(frame // 2)  # the place of raw's first sample in the vocoder's output
        self.buffer = np.zeros((channels, frame // 2))
        self.phase = self.turn = np.zeros((channels, 0))
        self.tail, self.norm, self.raw = np.zeros((channels, frame)), np.zeros((1, frame)), np.zeros((channels, 0))

    def feed(self, x: np.ndarray, last: bool) -> np.ndarray:
        """The output that is certain once x has been heard."""
        if self.same:
            return x
        self.heard += x.shape[1]
        self.buffer = np.concatenate([self.buffer, x] + ([np.zeros((len(x), self.frame + self.frame // 2))] if last else []), axis=1)
        made = []
        while True:
            at = int(self.step * self.hop * self.rate)
            if at + self.hop + self.frame > self.base + self.buffer.shape[1] or (last and self.step * self.hop * self.rate >= max(1.0, self.heard)):
                break
            self._synthesise(at - self.base)
            made.append(self.tail[:, : self.hop] / np.maximum(self.norm[:, : self.hop], 1e-6))
            self.tail = np.concatenate([self.tail[:, self.hop :], np.zeros((len(x), self.hop))], axis=1)
            self.norm = np.concatenate([self.norm[:, self.hop :], np.zeros((1, self.hop))], axis=1)
            self.step += 1
        behind = min(int(self.step * self.hop * self.rate) - self.base, self.buffer.shape[1])
        self.buffer, self.base = self.buffer[:, behind:], self.base + behind
        if last:
            made += [self.tail / np.maximum(self.norm, 1e-6), np.zeros((len(x), 2 * self.frame))]
        self.raw = np.concatenate([self.raw, *made], axis=1)
        if self.raw_base < 0:  # the latency
            skipped = min(-self.raw_base, self.raw.shape[1])
            self.raw, self.raw_base = self.raw[:, skipped:], self.raw_base + skipped
        return self._resampled(last)

    def _synthesise(self, at: int) -> None:
        frames = np.stack([self.buffer[:, at : at + self.frame], self.buffer[:, at + self.hop : at + self.hop + self.frame]])
        here, ahead = np.fft.rfft(self.window * frames, axis=2)
        if not self.phase.shape[1]:
            self.phase = np.angle(here)
        else:
            self.phase = self.phase + self.expected_turn + self.turn - 2 * np.pi * np.round(self.turn / (2 * np.pi))
        self.turn = np.angle(ahead) - np.angle(here) - self.expected_turn
        self.tail += self.window * np.fft.irfft(np.abs(here) * np.exp(1j * self.phase), self.frame, axis=1)
        self.norm += self.window**2

    def _resampled(self, last: bool) -> np.ndarray:
        """Output of the places whose neighbours are known: linear between two upwards, a mean of some downwards."""
        total = max(1, int(np.floor(self.heard / self.speed + 0.5))) if last else 1 << 62
        known = self.raw_base + self.raw.shape[1]
        if abs(self.factor - 1) <= 1e-9:
            n = max(0, min(total, known) - self.given)
            out, self.raw, self.raw_base = self.raw[:, :n], self.raw[:, n:], self.raw_base + n
        else:
            width = int(np.ceil(self.factor)) if self.factor > 1 else 1
            n = max(0, min(total, int((known - width - 1) / self.factor)) - self.given)
            at = (self.given + np.arange(n)) * self.factor
            low = at.astype(np.int64)
            if self.factor < 1:
                a = low - self.raw_base
                out = self.raw[:, a] + (self.raw[:, a + 1] - self.raw[:, a]) * (at - low)
            else:
                start = np.maximum(low - width // 2, 0)
                sums = np.concatenate([np.zeros((len(self.raw), 1)), np.cumsum(self.raw, axis=1)], axis=1)
                out = (sums[:, start + width - self.raw_base] - sums[:, start - self.raw_base]) / width
            free = min(self.raw.shape[1], max(0, int((self.given + n) * self.factor) - width - 1 - max(0, self.raw_base)))
            self.raw, self.raw_base = self.raw[:, free:], self.raw_base + free
        self.given += n
        if last and self.given < total:
            out = np.concatenate([out, np.zeros((len(out), total - self.given))], axis=1)
        return out


class StretchProcessor(StatefulProcessor):
    """Chunks of a track in order of chunk_no; those that come before their turn wait in the state."""

    def __init__(self, speed: float, semitones: float, channels: int, frame: int, start_frame: int):
        self.make = lambda: Stretcher(speed, semitones, channels, frame)
        self.channels, self.start_frame = channels, start_frame

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", _STATE)
        self.early = handle.getMapState("early", "chunk_no bigint", "samples array<double>, last boolean")

    def handleInputRows(self, key, rows, timerValues):
        work = self.make()
        expected = passed = blocks = 0
        pending = np.zeros((self.channels, 0))
        if self.held.exists():
            row = dict(zip([c.split()[0] for c in _STATE.split(", ")], self.held.get()))
            for n in _NUMBERS:
                setattr(work, n, row[n])
            for a in _ARRAYS:
                setattr(work, a, np.frombuffer(row[a]).reshape(1 if a == "norm" else self.channels, -1).copy())
            expected, passed, blocks = row["expected"], row["passed"], row["blocks"]
            pending = np.frombuffer(row["pending"]).reshape(self.channels, -1)
        for part in rows:
            for no, samples, last in zip(part["chunk_no"], part["samples"], part["last"]):
                if no >= expected:  # a chunk that comes again is the same one
                    self.early.updateValue((int(no),), ([float(x) for x in samples], bool(last)))
        done, out = False, []
        while not done and self.early.containsKey((expected,)):
            samples, done = self.early.getValue((expected,))
            self.early.removeKey((expected,))
            x = np.asarray(samples, float).reshape(-1, self.channels).T
            skip = min(max(0, self.start_frame - passed), x.shape[1])
            expected, passed = expected + 1, passed + x.shape[1]
            pending = np.concatenate([pending, work.feed(x[:, skip:], done)], axis=1)
            while pending.shape[1] >= BLOCK_OUT or (done and pending.shape[1]):
                out.append((key[0], blocks, pending[:, :BLOCK_OUT].T.reshape(-1)))
                pending, blocks = pending[:, BLOCK_OUT:], blocks + 1
        if done:
            self.held.clear()
            self.early.clear()
        else:
            arrays = [np.ascontiguousarray(getattr(work, a), dtype=float).tobytes() for a in _ARRAYS]
            self.held.update((*(int(getattr(work, n)) for n in _NUMBERS), expected, passed, blocks, *arrays, np.ascontiguousarray(pending).tobytes()))
        yield pd.DataFrame(out, columns=["track_id", "block_no", "samples"])

    def close(self) -> None:
        pass


def stretch_stream(chunks: DataFrame, speed: float, semitones: float = 0.0, channels: int = 1, frame: int = 1024, start_frame: int = 0) -> DataFrame:
    """(track_id, block_no, samples) in blocks of 4096 frames, the last one shorter, of a stream of chunks.

    chunks: (track_id, chunk_no from 0, samples ARRAY interleaved by channel, last BOOLEAN). Put together the blocks are what
    ``signal.stretch`` gives of each channel of the whole, from start_frame on; the channels share their steps. The state of a
    track is a few frames, and goes with its last chunk; chunks may come in any order, and come again. Needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``)."""
    rows = chunks.select("track_id", "chunk_no", "samples", "last").groupBy("track_id")
    return rows.transformWithStateInPandas(StretchProcessor(speed, semitones, channels, frame, start_frame), OUT, "Append", "None")
