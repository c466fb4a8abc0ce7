"""Tracks of a packed 5.25-inch disk: runs, and the twenty most frequent bytes of each track in 4 to 7 bits."""

from __future__ import annotations

from collections import Counter

TRACK, TRACKS, RUN = 4096, 35, 0x97
#: The favourites' codes, and how many bits each has; the lowest bit comes first.
CODES = (0x03, 0x09, 0x1F, 0x0F, 0x07, 0x1B, 0x0B, 0x0D, 0x15, 0x37, 0x3D, 0x25, 0x05, 0xB1, 0x11, 0x21, 0x01, 0x57, 0x5D, 0x1D)
LENGTHS = (4, 4, 5, 5, 5, 5, 5, 5, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7, 7, 7)


def _bits(value: int, n: int = 8) -> str:
    return format(value & (1 << n) - 1, f"0{n}b")[::-1]


FAVOURITES = [_bits(c, n) for c, n in zip(CODES, LENGTHS)]
_BYTE = [_bits(b) for b in range(256)]
_BACK = {s: b for b, s in enumerate(_BYTE)}


def favourites(track: bytes) -> bytes:
    """The twenty most frequent bytes, most frequent first, ties by value; unused ones fill up."""
    n = Counter(track)
    return bytes(sorted(range(256), key=lambda b: (-n[b], b))[:20])


def pack(data: bytes, volume: int = 254) -> bytes:
    """143,360 bytes as four zeros, three zero bits, the volume, and the tracks."""
    if len(data) != TRACK * TRACKS:
        raise ValueError("not a disk of 35 tracks")
    out = ["000", _BYTE[volume]]
    for t in range(TRACKS):
        track = data[t * TRACK : (t + 1) * TRACK]
        best = favourites(track)
        out += [_BYTE[b] for b in best]
        code = {b: FAVOURITES[i] for i, b in enumerate(best)}
        i = 0
        while i < TRACK:
            j = i + 1
            while j < TRACK and track[j] == track[i] and j - i < 256:
                j += 1
            if j - i > 3:
                out += [_BYTE[RUN], _BYTE[track[i]], _BYTE[j - i & 255]]
            else:
                out += [code.get(track[i]) or "0" + _BYTE[track[i]]] * (j - i)
            i = j
    bits = "".join(out)
    bits += "0" * (-len(bits) % 8)
    return bytes(4) + int(bits, 2).to_bytes(len(bits) // 8, "big")


def unpack(data: bytes, start: int = 4) -> tuple[bytes, int]:
    """The disk and its volume number. start: 0 if the four bytes before the packed data are missing."""
    if len(data) <= start + TRACKS * 20:
        raise ValueError("too short for a packed disk")
    bits = format(int.from_bytes(b"\1" + data[start:], "big"), "b")[1:]
    if bits[:3] != "000":
        raise ValueError("no packed disk")
    volume, at = _BACK[bits[3:11]], 11
    run = _BYTE[RUN]
    out = bytearray()
    try:
        for t in range(TRACKS):
            code = {FAVOURITES[k]: _BACK[bits[at + 8 * k : at + 8 * k + 8]] for k in range(20)}
            at += 160
            end = (t + 1) * TRACK
            while len(out) < end:
                if bits[at] == "0":
                    out.append(_BACK[bits[at + 1 : at + 9]])
                    at += 9
                    continue
                for n in (4, 5, 6, 7):
                    b = code.get(bits[at : at + n])
                    if b is not None:
                        out.append(b)
                        at += n
                        break
                else:
                    if bits[at : at + 8] != run:
                        raise ValueError("bits that are no code")
                    out += bytes((_BACK[bits[at + 8 : at + 16]],)) * (_BACK[bits[at + 16 : at + 24]] or 256)
                    at += 24
                    if len(out) > end:
                        raise ValueError("a run beyond its track")
    except (KeyError, IndexError):
        raise ValueError("the packed disk ends early") from None
    if len(bits) - at > 8 * 256:
        raise ValueError("too much follows the packed disk")
    return bytes(out), volume
