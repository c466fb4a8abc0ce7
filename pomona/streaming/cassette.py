"""Cassette signals, decoded as they arrive.

A recording is a 770 Hz tone, a short cycle, then bits by the width of a full cycle (0: 2 x 250 us, 1: 2 x 500 us)
until the signal is lost; its last byte is the xor of all others and FF. The decoder keeps its phase, the
running cycle and the bits so far, so a recording may come in any number of pieces.
"""

from __future__ import annotations

import io
import pickle
import struct
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Full cycles of tone before data may start, and widths of cycles in microseconds.
TONE_CYCLES = 770
TONE, SHORT, ZERO, ONE, LOST = (1150.0, 1450.0), (350.0, 520.0), (400.0, 700.0), (800.0, 1150.0), 2200.0
RECORDS = "start long, stop long, n_bytes int, checksum_ok boolean, data binary"


class Decoder:
    """Feeds on samples of one signal; rising crossings of zero part its cycles."""

    def __init__(self, rate: int):
        self.rate, self.phase, self.cycles, self.at, self.edge, self.level = rate, "tone", 0, 0, None, 0.0
        self.start, self.bits = 0, bytearray()

    def feed(self, samples: np.ndarray) -> list[tuple]:
        """Recordings that end in these samples: (start, stop, bytes, checksum_ok)."""
        x = np.r_[self.level, samples.astype(float)]
        up = np.flatnonzero((x[:-1] < 0) & (x[1:] >= 0))
        places = self.at + up - 1 + x[up] / (x[up] - x[up + 1])  # between two samples
        self.level, self.at = float(x[-1]), self.at + len(samples)
        out = []
        for p in places.tolist():
            if self.edge is not None:
                out += self._cycle((p - self.edge) * 1e6 / self.rate, p)
            self.edge = p
        if self.edge is not None and (self.at - self.edge) * 1e6 / self.rate > LOST:
            out += self.finish()
        return out

    def _cycle(self, us: float, at: float) -> list[tuple]:
        if self.phase == "tone":
            if TONE[0] <= us <= TONE[1]:
                self.cycles += 1
            elif self.cycles > TONE_CYCLES and SHORT[0] <= us <= SHORT[1]:
                self.phase, self.start, self.bits = "data", round(at), bytearray()
            else:
                self.cycles = 0
        elif ZERO[0] <= us <= ZERO[1]:
            self.bits.append(0)
        elif ONE[0] <= us <= ONE[1]:
            self.bits.append(1)
        else:
            return self.finish(us)
        return []

    def finish(self, us: float | None = None) -> list[tuple]:
        """Ends a recording, if one is running."""
        out = []
        if self.phase == "data" and len(self.bits) >= 8:
            n = len(self.bits) // 8
            data = np.packbits(np.frombuffer(bytes(self.bits[: 8 * n]), np.uint8)).tobytes()
            check = 0xFF
            for b in data[:-1]:
                check ^= b
            out = [(self.start, round(self.at), data[:-1], check == data[-1])]
        self.phase, self.bits, self.edge = "tone", bytearray(), None
        self.cycles = 1 if us is not None and TONE[0] <= us <= TONE[1] else 0
        return out


def signal(data: bytes, rate: int = 44100, tone: int = 900) -> np.ndarray:
    """A recording of the data, as 16-bit samples."""
    check = 0xFF
    for b in data:
        check ^= b
    halves = [1e6 / 770 / 2] * (2 * tone) + [200, 250]
    for bit in np.unpackbits(np.frombuffer(data + bytes((check,)), np.uint8)):
        halves += [500, 500] if bit else [250, 250]
    halves += [250]
    edges = np.r_[0, np.cumsum(halves)] * rate / 1e6
    t = np.arange(int(edges[-1]) + rate // 100)
    half = np.searchsorted(edges, t, "right") - 1
    inside = t < edges[-1]
    widths = np.diff(edges)
    phase = np.where(inside, (t - edges[np.minimum(half, len(widths))]) / widths[np.minimum(half, len(widths) - 1)], 0)
    return (np.where(inside, np.sin(np.pi * phase) * np.where(half % 2, -1, 1), 0) * 20000).astype(np.int16)


def read_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples of the first channel of 8- or 16-bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()
        x = np.frombuffer(raw, np.uint8).astype(float) - 128 if width == 1 else np.frombuffer(raw, "<i2").astype(float)
        return w.getframerate(), x[::channels]


def write_wav(samples: np.ndarray, rate: int = 44100) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def decode_files(files: DataFrame) -> DataFrame:
    """(path, content) of WAV files -> path and their recordings. A file that is no WAV gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    rate, x = read_wav(bytes(content))
                except (wave.Error, EOFError, struct.error):
                    continue
                d = Decoder(rate)
                rows = [(path, s, e, len(x), ok, x) for s, e, x, ok in d.feed(x) + d.finish()]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "start", "stop", "n_bytes", "checksum_ok", "data"])

    return files.select("path", "content").mapInPandas(run, f"path string, {RECORDS}")


def decode_stream(pieces: DataFrame) -> DataFrame:
    """A stream of (signal string, piece long, rate int, samples binary of 16 bits) -> signal and its recordings.

    Pieces of a signal must reach the stream in order; within a micro-batch they are put in order by number.
    The state of a signal is its decoder, a few kilobytes besides the bits of a running recording.
    """

    def run(key: tuple, pdfs: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        decoder, done = pickle.loads(state.get[0]) if state.exists else None, []
        for r in pd.concat(list(pdfs)).sort_values("piece").itertuples():
            if decoder is None:
                decoder = Decoder(int(r.rate))
            done += decoder.feed(np.frombuffer(r.samples, "<i2"))
        state.update((pickle.dumps(decoder),))
        if done:
            yield pd.DataFrame([(key[0], s, e, len(x), ok, x) for s, e, x, ok in done], columns=["signal", "start", "stop", "n_bytes", "checksum_ok", "data"])

    return pieces.groupBy("signal").applyInPandasWithState(run, f"signal string, {RECORDS}", "decoder binary", "append", "NoTimeout")
