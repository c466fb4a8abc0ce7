"""3.5-inch disk bytes: five zones of 12 to 8 sectors, 524 bytes each under a rolling three-byte checksum."""

from __future__ import annotations

from pomona.functions.nibbles import SIX

BACK = {b: i for i, b in enumerate(SIX)}
ADDRESS, DATA, END = b"\xd5\xaa\x96", b"\xd5\xaa\xad", b"\xde\xaa"
TAG = 12


def sectors_on(cylinder: int) -> int:
    return 12 - cylinder // 16


def _roll(a: int, b: int, c: int) -> tuple[int, int]:
    """The top bit of c goes round and, with it, into the carry."""
    carry = c >> 7
    return (c << 1 | carry) & 0xFF, carry


def encode_sector(data: bytes, tags: bytes = bytes(TAG)) -> bytes:
    """703 disk bytes: groups of three bytes as four, the three checksums at the end."""
    src, out = tags + data, bytearray()
    a = b = c = 0
    for i in range(0, 524, 3):
        part = src[i : i + 3]
        c, carry = _roll(a, b, c)
        s = a + part[0] + carry
        a, carry = s & 0xFF, s >> 8
        x = part[0] ^ c
        s = b + part[1] + carry
        b, carry = s & 0xFF, s >> 8
        y = part[1] ^ a
        if len(part) > 2:
            c = c + part[2] + carry & 0xFF
            z = part[2] ^ b
        else:
            z = 0
        out += bytes(SIX[v] for v in ((x >> 6) << 4 | (y >> 6) << 2 | z >> 6, x & 63, y & 63, z & 63)[: len(part) + 1])
    return bytes(out) + bytes(SIX[v] for v in ((a >> 6) << 4 | (b >> 6) << 2 | c >> 6, a & 63, b & 63, c & 63))


def decode_sector(disk: bytes) -> tuple[bytes, bytes] | None:
    """(tags, data), or None if a byte or a checksum is wrong."""
    try:
        v = [BACK[x] for x in disk[:703]]
    except KeyError:
        return None
    if len(v) < 703:
        return None
    out, i = bytearray(), 0
    a = b = c = 0
    while len(out) < 524:
        top, n = v[i], min(3, 524 - len(out))
        part = [v[i + 1 + k] | (top >> (4 - 2 * k) & 3) << 6 for k in range(n)]
        i += 1 + n
        c, carry = _roll(a, b, c)
        x = part[0] ^ c
        s = a + x + carry
        a, carry = s & 0xFF, s >> 8
        y = part[1] ^ a
        s = b + y + carry
        b, carry = s & 0xFF, s >> 8
        out += bytes((x, y))
        if n > 2:
            z = part[2] ^ b
            c = c + z + carry & 0xFF
            out.append(z)
    top = v[i]
    if [v[i + 1 + k] | (top >> (4 - 2 * k) & 3) << 6 for k in range(3)] != [a, b, c]:
        return None
    return bytes(out[:TAG]), bytes(out[TAG:])


def encode_track(cylinder: int, head: int, sectors: list[bytes], kind: int = 0x22) -> bytes:
    out = bytearray()
    for s, data in enumerate(sectors):
        side = head << 5 | cylinder >> 6
        head_bytes = [cylinder & 63, s, side, kind]
        check = head_bytes[0] ^ head_bytes[1] ^ head_bytes[2] ^ head_bytes[3]
        out += b"\xff" * 8 + ADDRESS + bytes(SIX[v] for v in (*head_bytes, check)) + END
        out += b"\xff" * 4 + DATA + bytes((SIX[s],)) + encode_sector(data) + END
    return bytes(out)


def decode_track(disk: bytes, cylinder: int, head: int) -> list[bytes | None]:
    """The sectors of a track, None where one can't be read; the track is a ring."""
    ring, at = disk + disk[:900], 0
    out: list[bytes | None] = [None] * sectors_on(cylinder)
    while (at := ring.find(ADDRESS, at)) >= 0 and at < len(disk):
        field = [BACK.get(b, 64) for b in ring[at + 3 : at + 8]]
        at += 3
        if len(field) < 5 or field[0] ^ field[1] ^ field[2] ^ field[3] != field[4]:
            continue
        if field[0] | (field[2] & 1) << 6 != cylinder or field[2] >> 5 != head or field[1] >= len(out):
            continue
        start = ring.find(DATA, at, at + 60)
        if start >= 0 and out[field[1]] is None:
            found = decode_sector(ring[start + 4 : start + 4 + 703])
            out[field[1]] = found and found[1]
    return out
