"""Disk bytes of 5.25-inch media: sector skews, address fields, 6-and-2 and 5-and-3 coding, with numpy."""

from __future__ import annotations

import numpy as np

#: The physical sector of each logical one, by the order a file system counts in.
TO_PHYSICAL = {
    "physical": tuple(range(16)),
    "dos": (0, 13, 11, 9, 7, 5, 3, 1, 14, 12, 10, 8, 6, 4, 2, 15),
    "prodos": (0, 2, 4, 6, 8, 10, 12, 14, 1, 3, 5, 7, 9, 11, 13, 15),
    "cpm": (0, 3, 6, 9, 12, 15, 2, 5, 8, 11, 14, 1, 4, 7, 10, 13),
}
FROM_PHYSICAL = {k: tuple(v.index(i) for i in range(16)) for k, v in TO_PHYSICAL.items()}


def skew(sector: int, fs_order: str, image_order: str) -> int:
    """Where an image of one order keeps the sector that a file system of another order asks for."""
    return FROM_PHYSICAL[image_order][TO_PHYSICAL[fs_order][sector]]


def reorder(data: bytes, fs_order: str, image_order: str) -> bytes:
    """A whole image of 16-sector tracks, as a file system of `fs_order` counts its sectors."""
    x = np.frombuffer(data, np.uint8).reshape(-1, 16, 256)
    return x[:, [skew(s, fs_order, image_order) for s in range(16)]].tobytes()


def _disk_bytes(most_zeros: int, adjacent_ones: bool) -> list[int]:
    """Bytes from AA on with the top bit set and few zeros in a row; the two reserved for marks are left out."""
    out = []
    for b in range(0x96 if adjacent_ones else 0xAB, 0x100):
        bits = f"{b:08b}"
        pairs = bits.count("00")
        run = max(len(z) for z in bits.split("1"))
        if b in (0xAA, 0xD5) or run > most_zeros or pairs > most_zeros - 1 or (adjacent_ones and "11" not in bits[1:]):
            continue
        out.append(b)
    return out


#: 64 bytes with at most one pair of zeros and two ones side by side; 32 bytes without adjacent zeros.
SIX = _disk_bytes(2, True)
FIVE = [b for b in _disk_bytes(1, False) if "00" not in f"{b:08b}"]
_SIX_BACK = np.full(256, -1)
_SIX_BACK[SIX] = np.arange(len(SIX))
_FIVE_BACK = np.full(256, -1)
_FIVE_BACK[FIVE] = np.arange(len(FIVE))


def encode_62(sector: bytes) -> bytes:
    """256 bytes as 343 disk bytes: 86 of low bit pairs, 256 of high six bits, a checksum; each xored with the one before."""
    d = np.frombuffer(sector, np.uint8).astype(np.int64)
    pair = (d & 1) << 1 | d >> 1 & 1
    low = np.zeros(86, np.int64)
    for k in range(3):
        part = pair[86 * k : 86 * (k + 1)]
        low[: len(part)] |= part << (2 * k)
    values = np.r_[low[::-1], d >> 2]
    chain = np.r_[values, 0] ^ np.r_[0, values]
    return np.array(SIX, np.uint8)[chain].tobytes()


def decode_62(disk: bytes) -> bytes | None:
    """The 256 bytes of 343 disk bytes, or None if a byte or the checksum is wrong."""
    v = _SIX_BACK[np.frombuffer(disk[:343], np.uint8)]
    if len(v) < 343 or (v < 0).any():
        return None
    values = np.bitwise_xor.accumulate(v)
    if values[342]:
        return None
    low, high = values[:86][::-1], values[86:342]
    i = np.arange(256)
    pair = low[i % 86] >> (2 * (i // 86)) & 3
    return (high << 2 | (pair & 1) << 1 | pair >> 1).astype(np.uint8).tobytes()


def encode_53(sector: bytes) -> bytes:
    """256 bytes as 411 disk bytes: 154 of low bits, 256 of high five bits, a checksum."""
    d = np.frombuffer(sector, np.uint8).astype(np.int64)
    groups = d[:255].reshape(51, 5)[::-1]  # groups of five count down
    top = groups >> 3
    x = groups & 7
    thirds = np.stack([x[:, 0] << 2 | (x[:, 3] >> 2 & 1) << 1 | x[:, 4] >> 2 & 1, x[:, 1] << 2 | (x[:, 3] >> 1 & 1) << 1 | x[:, 4] >> 1 & 1, x[:, 2] << 2 | (x[:, 3] & 1) << 1 | x[:, 4] & 1])
    low = np.zeros(154, np.int64)
    for k in range(3):
        low[51 * k : 51 * (k + 1)] = thirds[k]
    low[153] = d[255] & 7
    values = np.r_[low[::-1], top.T.reshape(-1), d[255] >> 3]
    chain = np.r_[values, 0] ^ np.r_[0, values]
    return np.array(FIVE, np.uint8)[chain].tobytes()


def decode_53(disk: bytes) -> bytes | None:
    v = _FIVE_BACK[np.frombuffer(disk[:411], np.uint8)]
    if len(v) < 411 or (v < 0).any():
        return None
    values = np.bitwise_xor.accumulate(v)
    if values[410]:
        return None
    low, high = values[:154][::-1], values[154:410]
    t = low[:153].reshape(3, 51)
    top = high[:255].reshape(5, 51).T
    bits = np.stack([t[0] >> 2, t[1] >> 2, t[2] >> 2, (t[0] >> 1 & 1) << 2 | (t[1] >> 1 & 1) << 1 | t[2] >> 1 & 1, (t[0] & 1) << 2 | (t[1] & 1) << 1 | t[2] & 1], 1)
    groups = (top << 3 | bits)[::-1].reshape(-1)
    return np.r_[groups, high[255] << 3 | low[153]].astype(np.uint8).tobytes()


def encode_44(value: int) -> bytes:
    return bytes((value >> 1 | 0xAA, value | 0xAA))


def decode_44(pair: bytes) -> int:
    return (pair[0] << 1 | 1) & pair[1] & 0xFF


#: Prologues and epilogue of address and data fields.
ADDRESS = {16: b"\xd5\xaa\x96", 13: b"\xd5\xaa\xb5"}
DATA, EPILOGUE = b"\xd5\xaa\xad", b"\xde\xaa\xeb"


def encode_track(track: int, sectors: list[bytes], volume: int = 254, length: int = 6656) -> bytes:
    """A track of 13 or 16 sectors in physical order, filled up with sync bytes."""
    n = len(sectors)
    out = bytearray()
    for s, data in enumerate(sectors):
        out += b"\xff" * 14 + ADDRESS[n] + encode_44(volume) + encode_44(track) + encode_44(s) + encode_44(volume ^ track ^ s) + EPILOGUE
        out += b"\xff" * 5 + DATA + (encode_62(data) if n == 16 else encode_53(data)) + EPILOGUE
    return bytes(out) + b"\xff" * (length - len(out))


def decode_track(disk: bytes, track: int, count: int = 16) -> list[bytes | None]:
    """The track's sectors in physical order, None where one can't be read; the track is a ring."""
    ring = disk + disk[:1000]
    out: list[bytes | None] = [None] * count
    at = 0
    while (at := ring.find(ADDRESS[count], at)) >= 0 and at < len(disk):
        field = ring[at + 3 : at + 11]
        at += 3
        if len(field) < 8:
            break
        volume, t, s, check = (decode_44(field[i : i + 2]) for i in (0, 2, 4, 6))
        if volume ^ t ^ s ^ check or t != track or s >= count:
            continue
        start = ring.find(DATA, at + 8, at + 60)
        if start >= 0 and out[s] is None:
            body = ring[start + 3 : start + 3 + (343 if count == 16 else 411)]
            out[s] = decode_62(body) if count == 16 else decode_53(body)
    return out
