"""Schemes that hold several volumes: partition maps, and disks shared by two DOS volumes.

Each scheme gives (name, image) for its volumes; ranges that can't be read stay listed, with no image.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from pomona.sources.disk import Image

#: 32 MB volumes of a card without a map.
VOLUME_BLOCKS = 65535


def _range(data: bytes, start: int, count: int) -> Image | None:
    part = data[start * 512 : (start + count) * 512]
    return Image(part) if count > 0 and len(part) == count * 512 else None


def mac_map(data: bytes) -> Iterator[tuple[str, Image | None]]:
    """A driver descriptor, then one map entry per block, high byte first."""
    if data[:2] != b"ER" or data[512:514] != b"PM":
        raise ValueError("no Macintosh partition map")
    (count,) = struct.unpack_from(">I", data, 516)
    for i in range(1, min(count, 62) + 1):
        e = data[512 * i : 512 * i + 512]
        if e[:2] != b"PM":
            raise ValueError("a map entry without its mark")
        start, size = struct.unpack_from(">II", e, 8)
        name, kind = (e[a : a + 32].split(b"\0")[0].decode("mac_roman") for a in (16, 48))
        if kind not in ("Apple_partition_map", "Apple_Driver", "Apple_Driver43", "Apple_Free"):
            yield name or kind, _range(data, start, size)


def micro_drive(data: bytes) -> Iterator[tuple[str, Image | None]]:
    """Up to two tables of eight starts and lengths; the top byte of a length serves another purpose."""
    if data[:2] != b"\xca\xcc" or not 1 <= data[12] <= 8 or data[13] > 8 or struct.unpack_from("<I", data, 32)[0] != 256:
        raise ValueError("no MicroDrive map")
    for n, at in ((data[12], 32), (data[13], 128)):
        for i in range(n):
            start, size = (struct.unpack_from("<I", data, at + 32 * k + 4 * i)[0] for k in (0, 1))
            yield f"Partition {i + (at > 32) * 8}", _range(data, start, size & 0xFFFFFF)


def focus_drive(data: bytes) -> Iterator[tuple[str, Image | None]]:
    """Up to 30 entries in block 0, their names in blocks 1 and 2."""
    if data[:14] != b"Parsons Engin." or not 1 <= data[15] <= 30:
        raise ValueError("no FocusDrive map")
    for i in range(data[15]):
        start, size = struct.unpack_from("<II", data, 32 + 16 * i)
        name = data[512 + 32 * i : 544 + 32 * i].split(b"\0")[0].decode("ascii", "replace")
        yield name or f"Partition {i}", _range(data, start, size)


def plain_card(data: bytes) -> Iterator[tuple[str, Image | None]]:
    """No map at all: volumes of 32 MB one after another, if the first and the second one look like volumes."""
    blocks = len(data) // 512
    if blocks <= VOLUME_BLOCKS + 1:
        raise ValueError("one volume at most")
    heads = [data[i * (VOLUME_BLOCKS + 1) * 512 :][1024:1536] for i in (0, 1)]
    if not all(h[:2] == b"BD" or (h[:2] == b"\0\0" and h[4] >> 4 == 0xF) for h in heads):
        raise ValueError("no card of several volumes")
    for i in range(min(8, -(-blocks // (VOLUME_BLOCKS + 1)))):
        start = i * (VOLUME_BLOCKS + 1)
        yield f"Volume {i + 1}", _range(data, start, min(VOLUME_BLOCKS + 1, blocks - start))


#: Where a volume of 50 tracks of 32 sectors keeps its VTOC, in sectors.
VTOC = 17 * 32


def _check_wide(data: bytes, at: int) -> None:
    vtoc = data[at : at + 256]
    if vtoc[0x34] != 50 or vtoc[0x35] != 32 or not vtoc[1] < 50 or not vtoc[2] < 32:
        raise ValueError("no DOS volume of 400K")


def uni_dos(data: bytes) -> Iterator[tuple[str, Image | None]]:
    """An 800K disk in halves."""
    if len(data) != 819200:
        raise ValueError("not 800K")
    for i in (0, 1):
        _check_wide(data, i * 409600 + VTOC * 256)
    yield from [(f"DOS {i + 1}", Image(data[i * 409600 : (i + 1) * 409600], None, 32)) for i in (0, 1)]


def oz_dos(data: bytes) -> Iterator[tuple[str, Image | None]]:
    """An 800K disk whose blocks hold a sector of either volume."""
    if len(data) != 819200:
        raise ValueError("not 800K")
    for i in (0, 1):
        _check_wide(data, VTOC * 512 + i * 256)
    halves = np.frombuffer(data, np.uint8).reshape(-1, 2, 256)
    yield from [(f"DOS {i + 1}", Image(halves[:, i].tobytes(), None, 32)) for i in (0, 1)]


#: In the order of detection. Shared disks are tried after whole file systems of their size would be.
SCHEMES = (("MacPart", mac_map), ("MicroDrive", micro_drive), ("FocusDrive", focus_drive), ("CFFA", plain_card), ("UNIDOS", uni_dos), ("OzDOS", oz_dos))


def open_partitions(image: Image) -> tuple[str, list[tuple[str, Image | None]]] | None:
    """The scheme and volumes on block media, or None."""
    if image.sectors != 16 or image.order not in (None, "prodos") or len(image.data) < 819200:
        return None
    for name, scheme in SCHEMES:
        try:
            return name, list(scheme(image.data))
        except (ValueError, IndexError, struct.error):
            continue
    return None


def embedded(system) -> Iterator[tuple[str, Image, range]]:
    """DOS volumes in the blocks at the end of an 800K ProDOS disk that its bitmap marks but no file uses: name, image, blocks.

    One volume of up to 50 tracks, several of 140K, or five of 160K, the first of which has lost its first tracks.
    """
    from pomona.sources.filesystems import DOS

    if system is None or system.name != "ProDOS" or system.total != 1600:
        return
    marked, first = system.marked(), system.total
    while first and first - 1 in marked and first - 1 not in system.used:
        first -= 1
    idle = system.total - first
    tries = []
    if idle >= 280 and idle % 8 == 0 and idle <= 400:
        tries.append([(first, idle)])
    if idle >= 280 and idle % 280 == 0:
        tries.append([(first + 280 * i, 280) for i in range(idle // 280)])
    if idle in (1537, 1593):
        tries.append([(320 * i, 320) for i in range(5)])
    for places in tries:
        found = []
        for n, (start, count) in enumerate(places):
            # the volume's blocks hold its tracks in ProDOS order
            image = Image(system.image.data[start * 512 : (start + count) * 512], "prodos")
            try:
                DOS(image)
            except (ValueError, IndexError):
                continue
            found.append((f"DOS {n + 1}", image, range(max(start, first), start + count)))
        if found:
            yield from found
            return
