"""Flux images: pulses made from known tracks are read back, whatever their coding, speed and noise."""

import random
import struct

import numpy as np
import pytest

from pomona.functions import flux, gcr35, nibbles
from pomona.sources import disk, filesystems

RNG = random.Random(21)


def pulses(track, cell=37, jitter=0.0, drift=0.0):
    """Widths between one bits of a track; bytes FF in front of fields are sync bytes of ten bits."""
    bits, run = [], 0
    for b in track:
        run = run + 1 if b == 0xFF else 0
        bits += [b >> (7 - i) & 1 for i in range(8)] + [0, 0] * (run > 2)
    ones = np.flatnonzero(bits)
    cells = np.diff(np.r_[ones[-1] - len(bits), ones])
    widths = cells * cell * (1 + drift * np.sin(np.arange(len(cells)) / 900)) * (1 + jitter * np.array([RNG.uniform(-1, 1) for _ in cells]))
    return np.maximum(1, np.rint(widths)).astype(np.int64), len(bits)


def huffman(values):
    """Two slices, of the upper and the lower 16 bits, each with a tree as deep as its values need."""
    out = b""
    for shift, part in ((16, values >> 16), (0, values & 0xFFFF)):
        distinct = sorted(set(part.tolist()))
        if len(distinct) == 1:
            out += bytes((shift, 0x80 | 15)) + b"\x80" + distinct[0].to_bytes(2, "big")
            continue

        def build(items):
            if len(items) == 1:
                return "1", {items[0]: ""}, items
            half = len(items) // 3 or 1  # not balanced
            (ta, ca, va), (tb, cb, vb) = build(items[:half]), build(items[half:])
            return "0" + ta + tb, {**{k: "0" + c for k, c in ca.items()}, **{k: "1" + c for k, c in cb.items()}}, va + vb

        tree, codes, order = build(distinct)
        pack = lambda s: bytes(int(s[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(s), 8))
        out += bytes((shift, 0x80 | 15)) + pack(tree) + b"".join(v.to_bytes(2, "big") for v in order) + pack("".join(codes[v] for v in part.tolist()))
    return out


def track_data(widths, coded, seen=None):
    avg = huffman(widths) if coded else widths.astype(">u4").tobytes()
    idx = b"" if seen is None else seen.astype(">u2").tobytes()
    heads = [len(avg) | (1 << 22 if coded else 0), 0, 0, len(idx)]
    out = struct.pack(">I", len(widths)) + b"".join(h.to_bytes(3, "big") for h in heads) + avg + idx
    return out + bytes(-len(out) % 256)


def image(tracks, kind):
    head = bytearray(512)
    head[:27], head[57:59], head[140:142] = disk.FDI, b"\r\n", b"\2\0"
    heads = 2 if kind == 2 else 1
    head[142:144], head[144], head[145] = (len(tracks) // heads - 1).to_bytes(2, "big"), heads - 1, kind
    for i, t in enumerate(tracks):
        head[152 + 2 * i : 154 + 2 * i] = (0x8000 | len(t) // 256 if t else 0).to_bytes(2, "big")
    return bytes(head) + b"".join(tracks)


def test_huffman_slices():
    values = np.array([RNG.choice([3, 700, 70000, 1 << 30, 65535]) for _ in range(500)])
    assert (flux.expand(huffman(values), 500) == values).all()
    assert (flux.expand(huffman(np.full(70, 9)), 70) == 9).all()
    with pytest.raises(ValueError):
        flux.expand(huffman(values)[:-40], 500)


@pytest.mark.parametrize(("coded", "jitter", "drift"), [(False, 0.0, 0.0), (True, 0.08, 0.03)])
def test_floppy(coded, jitter, drift):
    data = filesystems.build_dos([dict(path="HELLO", kind="T", data=b"\xc1\xc2" * 3000)])
    physical = nibbles.reorder(data, "physical", "dos")
    tracks = []
    for t in range(35):
        widths, _ = pulses(nibbles.encode_track(t, [physical[(t * 16 + s) * 256 : (t * 16 + s + 1) * 256] for s in range(16)], length=6200), jitter=jitter, drift=drift)
        seen = np.full(len(widths), 0x0005)
        tracks.append(track_data(np.r_[widths[:50], widths[50] // 2, widths[50] - widths[50] // 2, widths[51:]] if coded else widths, coded, np.r_[seen[:50], 1, seen[50:]] if coded else None))
    tracks[9] = b""
    got, outer = disk.open_image("a.fdi", image(tracks, 1))
    assert outer is None and got.file_format == "fdi" and {t for t, _ in got.bad} == {9}
    keep = [i for i in range(len(data)) if i // 4096 != 9]
    back = nibbles.reorder(got.data, "dos", "physical")
    assert all(back[i] == data[i] for i in keep)
    fs = filesystems.open_filesystem(got)
    assert fs.name == "DOS" and next(fs.entries())["data"] == b"\xc1\xc2" * 3000
    with pytest.raises(ValueError):
        disk.read_fdi(image([b""] * 20 + tracks[20:], 1))


def test_micro_floppy():
    data, tracks, at = RNG.randbytes(819200), [], 0
    for i in range(160):
        n = gcr35.sectors_on(i // 2)
        sectors = [data[at + 512 * s : at + 512 * s + 512] for s in range(n)]
        at += 512 * n
        widths, total = pulses(b"\xff" * 40 + gcr35.encode_track(i // 2, i % 2, sectors) + b"\xff" * 40)
        cells = flux.RATES[i // 32] // flux.TURNS
        widths[0] += (cells - total) * 37 if cells > total else 0
        tracks.append(track_data(widths, False))
    assert disk.read_fdi(image(tracks, 2)).data == data
