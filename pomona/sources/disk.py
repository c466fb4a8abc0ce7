"""Disk images: outer wrappers, image wrappers, sector orders and detection, from the published formats."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from dataclasses import dataclass, field
from datetime import datetime

from pomona.functions import ddd, flux, gcr35
from pomona.functions.codecs import rotating_sum
from pomona.functions.nibbles import decode_track, encode_track, reorder, skew

TRACK = 16 * 256
FLOPPY_SIZES = (143360, 116480, 819200, 409600, 737280, 1474560)
#: Largest image unpacked in memory from a compressed wrapper.
MOST = 64 << 20


@dataclass
class Image:
    """Sectors or blocks of one volume; `order` is the order in which `data` keeps 16-sector tracks, or None for block media."""

    data: bytes
    order: str | None = None
    sectors: int = 16
    file_format: str = "sector"
    physical: str = "sectors"
    volume: int | None = None
    damaged: bool = False
    notes: list = field(default_factory=list)
    bad: set = field(default_factory=set)

    @property
    def blocks(self) -> int:
        return len(self.data) // 512

    @property
    def tracks(self) -> int:
        return len(self.data) // (256 * self.sectors)

    def sector(self, track: int, number: int, fs_order: str = "dos") -> bytes:
        if not (0 <= track < self.tracks and 0 <= number < self.sectors):
            raise ValueError(f"no sector {track}/{number}")
        at = skew(number, fs_order, self.order) if self.sectors == 16 and self.order else number
        at = (track * self.sectors + at) * 256
        return self.data[at : at + 256]

    def run(self, first: int, count: int) -> bytes:
        """Blocks one after another, in ProDOS order."""
        if self.order in (None, "prodos") and 0 <= first <= first + count <= self.blocks:
            return self.data[first * 512 : (first + count) * 512]
        return b"".join(self.block(first + k) for k in range(count))

    def block(self, number: int, fs_order: str = "prodos") -> bytes:
        if not 0 <= number < self.blocks:
            raise ValueError(f"no block {number}")
        if self.order in (None, fs_order):
            return self.data[number * 512 : number * 512 + 512]
        t, s = divmod(number, 8)
        return self.sector(t, 2 * s, fs_order) + self.sector(t, 2 * s + 1, fs_order)


def unwrap(name: str, data: bytes) -> tuple[str, bytes, str | None, list]:
    """Takes off a gzip or one-file zip wrapper: (inner name, data, wrapper, notes)."""
    if data[:2] == b"\x1f\x8b":
        d, out, notes = zlib.decompressobj(31), b"", []
        try:
            out = d.decompress(data, MOST)
            damaged = not d.eof
        except zlib.error:
            damaged = True
            out = _salvage(data)
        if damaged:  # a damaged tail is passed over if what came before it is a whole floppy
            if len(out) not in FLOPPY_SIZES:
                raise ValueError("damaged gzip data")
            notes.append(("warning", "the gzip data is damaged; opened read-only"))
        return name[:-3] if name.lower().endswith(".gz") else name, out, "gzip", notes
    if data[:4] == b"PK\3\4":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            files = [i for i in z.infolist() if not i.is_dir()]
            if len(files) != 1 or files[0].file_size > MOST:
                raise ValueError("not a zip of one image")
            return files[0].filename, z.read(files[0]), "zip", []
    return name, data, None, []


def _salvage(data: bytes) -> bytes:
    d, out = zlib.decompressobj(31), bytearray()
    try:
        for i in range(0, len(data), 256):
            out += d.decompress(data[i : i + 256])
    except zlib.error:
        pass
    return bytes(out)


def wrap(data: bytes, kind: str | None, name: str = "image.po", when: datetime | None = None) -> bytes:
    """A gzip or zip wrapper; its time is `when`, or the same for all without it, so that equal data give equal files."""
    if kind == "gzip":
        return gzip.compress(data, mtime=0 if when is None else int(when.timestamp()))
    if kind == "zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name, (1990, 1, 1, 0, 0, 0) if when is None else when.timetuple()[:6]), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()
    return data


# --- image wrappers

_2MG = struct.Struct("<4s4sHHIIIIIIIII16x")
_2MG_ORDERS = ("dos", "prodos", "nibble")


def read_2mg(data: bytes) -> Image:
    """64-byte header: order, flags (DOS volume), offsets of data, comment and creator chunk."""
    magic, creator, size, _, order, flags, _, offset, length, c_at, c_len, x_at, x_len = _2MG.unpack_from(data)
    if magic != b"2IMG" or order > 2:
        raise ValueError("not a 2IMG file")
    body = data[offset : offset + length] if length else data[offset:]
    notes = [("info", data[c_at : c_at + c_len].decode("mac_roman"))] if c_at and c_len else []
    volume = flags & 0xFF if flags & 0x100 else None
    if order == 2:
        image = read_nibbles(body)
    else:
        image = Image(body, _2MG_ORDERS[order] if order == 0 or len(body) == 143360 else None)
    image.file_format, image.volume = "2mg", volume
    image.notes += notes
    return image


def write_2mg(image: Image, comment: str = "", creator: bytes = b"pmna", volume: int | None = None) -> bytes:
    order = 0 if image.order == "dos" else 1
    text = comment.encode("mac_roman", "replace")
    flags = 0 if volume is None else 0x100 | volume
    head = _2MG.pack(b"2IMG", creator, 64, 1, order, flags, 0 if order == 0 else image.blocks, 64, len(image.data), 64 + len(image.data) if text else 0, len(text), 0, 0)
    return head + image.data + text


def read_dc42(data: bytes) -> Image:
    """84-byte header; a wrong checksum leaves the image readable but damaged."""
    size, tag = struct.unpack_from(">II", data, 64)
    if data[82:84] != b"\1\0" or data[0] > 63 or size not in (409600, 819200, 737280, 1474560) or len(data) < 84 + size:
        raise ValueError("not a DiskCopy 4.2 file")
    body = data[84 : 84 + size]
    image = Image(body, None, file_format="dc42")
    image.notes.append(("info", data[1 : 1 + data[0]].decode("mac_roman")))
    if rotating_sum(body) != struct.unpack_from(">I", data, 72)[0]:
        image.damaged = True
        image.notes.append(("warning", "the checksum is wrong"))
    return image


def write_dc42(image: Image, name: str = "image") -> bytes:
    text = name.encode("mac_roman", "replace")[:63]
    formats = {409600: b"\0\2", 819200: b"\1\x22", 737280: b"\2\x22", 1474560: b"\3\x22"}
    head = bytes((len(text),)) + text.ljust(63, b"\0") + struct.pack(">IIII", len(image.data), 0, rotating_sum(image.data), 0) + formats[len(image.data)] + b"\1\0"
    return head + image.data


def read_nibbles(data: bytes, sectors: int | None = None) -> Image:
    """35 tracks of 6656 or 6384 disk bytes; three of tracks 1, 16, 17 and 26 must be all but readable."""
    length = {35 * 6656: 6656, 35 * 6384: 6384}.get(len(data))
    if length is None:
        raise ValueError("not a nibble image")
    tracks = [data[t * length : (t + 1) * length] for t in range(35)]
    for count in (sectors,) if sectors else (16, 13):
        good = sum(sum(s is not None for s in decode_track(tracks[t], t, count)) > count - 4 for t in (1, 16, 17, 26))
        if good >= 3:
            break
    else:
        raise ValueError("no known format of disk bytes")
    image = Image(b"", "physical" if count == 16 else None, count, "nibble", "nibbles")
    out = []
    for t, track in enumerate(tracks):
        for s, sector in enumerate(decode_track(track, t, count)):
            if sector is None:
                image.bad.add((t, s))
            out.append(sector or bytes(256))
    image.data = b"".join(out)
    if image.bad:
        image.notes.append(("warning", f"{len(image.bad)} sectors can't be read"))
    return image


def write_nibbles(image: Image, volume: int = 254) -> bytes:
    data = reorder(image.data, "physical", image.order) if image.order and image.order != "physical" else image.data
    n = image.sectors
    return b"".join(encode_track(t, [data[(t * n + s) * 256 : (t * n + s + 1) * 256] for s in range(n)], volume) for t in range(35))


def read_trackstar(data: bytes) -> Image:
    """40 or 80 tracks in 6656 bytes each: a text, a zero, disk bytes from the last to the first, their number."""
    if len(data) not in (6656 * 40, 6656 * 80):
        raise ValueError("no TrackStar image")
    step, tracks = len(data) // (6656 * 40), []
    for t in range(0, 40 * step, step):  # half tracks are passed over
        b = data[t * 6656 : (t + 1) * 6656]
        n = int.from_bytes(b[0x19FE:0x1A00], "little") or 6525
        disk = b[0x81 : 0x81 + n][::-1]
        if b[0x80] or n > 6525 or any(x < 0x80 for x in disk):
            raise ValueError("no TrackStar image")
        tracks.append(disk)
    image = Image(b"", "physical", 16, "trackstar", "nibbles")
    out = []
    for t, track in enumerate(tracks[:35]):
        for s, sector in enumerate(decode_track(track, t)):
            if sector is None:
                image.bad.add((t, s))
            out.append(sector or bytes(256))
    if len(image.bad) > 35 * 8:
        raise ValueError("hardly a sector can be read")
    image.data = b"".join(out)
    image.notes.append(("info", data[:0x2E].decode("ascii", "replace").rstrip()))
    return image


def write_trackstar(image: Image, text: str = "", volume: int = 254) -> bytes:
    data = reorder(image.data, "physical", image.order)
    out = bytearray()
    for t in range(40):
        disk = encode_track(t, [data[(t * 16 + s) * 256 : (t * 16 + s + 1) * 256] for s in range(16)], volume, 0) if t < 35 else b"\xff" * 6000
        b = bytearray(6656)
        b[:0x2E] = text.encode("ascii", "replace")[:0x2E].ljust(0x2E)
        b[0x81 : 0x81 + len(disk)] = disk[::-1]
        b[0x19FE:0x1A00] = len(disk).to_bytes(2, "little")
        out += b
    return bytes(out)


def read_ddd(data: bytes) -> Image:
    """A packed disk, whose four leading bytes may be missing; it is known by its length after unpacking alone."""
    for start in (4, 0):
        try:
            body, volume = ddd.unpack(data, start)
        except ValueError:
            continue
        return Image(body, "dos", file_format="ddd", volume=volume)
    raise ValueError("no packed disk")


def write_ddd(image: Image, volume: int = 254) -> bytes:
    return ddd.pack(reorder(image.data, "dos", image.order) if image.order else image.data, volume)


FDI = b"Formatted Disk Image file\r\n"


def read_fdi(data: bytes) -> Image:
    """A flux image: a header with a descriptor for each track, then tracks of pulse streams in whole 256 bytes.

    5.25-inch disks become 35 tracks of sectors, 3.5-inch ones 800K of blocks. Tracks that can't be read are bad
    sectors; more than half of them make the image none.
    """
    if data[:27] != FDI or len(data) < 512:
        raise ValueError("no flux image")
    last_track, last_head, kind = int.from_bytes(data[142:144], "big"), data[144], data[145]
    heads = last_head + 1
    if (kind, heads) not in ((1, 1), (2, 2)) or last_track > 83:
        raise ValueError("a flux image of an unknown drive")
    tracks, at, failed = [], 512, 0
    for i in range((last_track + 1) * heads):
        word = int.from_bytes(data[152 + 2 * i : 154 + 2 * i], "big")
        size = (word & 0x3FFF if word >> 14 == 2 else word & 0xFF) * 256
        rate = flux.RATE if kind == 1 else flux.RATES[min(4, i // heads // 16)]
        try:
            if word >> 14 != 2:
                raise ValueError("a blank track, or one that isn't pulses")
            tracks.append(flux.disk_bytes(flux.bits(*flux.streams(data[at : at + size]), rate)))
        except (ValueError, struct.error, IndexError):
            failed += 1
            tracks.append(b"")
        at += size
    if failed > len(tracks) // 2:
        raise ValueError("hardly a track can be read")
    image = Image(b"", "physical" if kind == 1 else None, 16, "fdi", "nibbles" if kind == 1 else "sectors")
    out = []
    for i, track in enumerate(tracks[:35] if kind == 1 else tracks[:160]):
        found = decode_track(track, i) if kind == 1 else gcr35.decode_track(track, i // 2, i % 2)
        image.bad.update((i, s) for s, sector in enumerate(found) if sector is None)
        out += [sector or bytes(256 if kind == 1 else 512) for sector in found]
    image.data = b"".join(out)
    image.data = image.data.ljust(143360 if kind == 1 else 819200, b"\0")
    if image.bad:
        image.notes.append(("warning", f"{len(image.bad)} sectors can't be read"))
    return image


def read_hdv(data: bytes) -> Image:
    if data[:13] != b"SIMSYSTEM_HDV":
        raise ValueError("not a Sim //e volume")
    return Image(data[15:], None, file_format="sim2e")


def write_hdv(image: Image) -> bytes:
    return b"SIMSYSTEM_HDV" + image.blocks.to_bytes(2, "little") + image.data


def read_sectors(data: bytes, order: str | None = None) -> Image:
    if len(data) == 116480:
        return Image(data, None, 13)
    if not data or len(data) % 512:
        raise ValueError("not a whole number of blocks")
    if len(data) == 143360 or (order and len(data) % TRACK == 0):
        return Image(data, order or "dos")
    return Image(data, None)


#: Extensions that settle the format, and the order a bare sector image is taken to be in.
BY_EXTENSION = {"2mg": read_2mg, "2img": read_2mg, "dc": read_dc42, "dc6": read_dc42, "nib": read_nibbles, "nb2": read_nibbles, "hdv": read_hdv, "app": read_trackstar, "ddd": read_ddd, "fdi": read_fdi}
ORDERS = {"do": "dos", "dsk": "dos", "po": "prodos", "d13": None, "cpm": "cpm", "raw": "physical"}


def open_image(name: str, data: bytes) -> tuple[Image, str | None]:
    """The image in a file and its outer wrapper: by extension first, then by content in a fixed order."""
    name, data, outer, notes = unwrap(name, data)
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    image = None
    if extension in BY_EXTENSION:
        try:
            image = BY_EXTENSION[extension](data)
        except (ValueError, struct.error):
            if extension not in ("hdv", "dc", "app"):  # what these name is settled; a failure is final
                raise
    elif extension in ORDERS:
        try:
            image = read_sectors(data, ORDERS[extension])
        except ValueError:
            image = None
    for read in () if image else (read_fdi, read_dc42, read_2mg, read_ddd, read_hdv, read_trackstar, read_nibbles, read_sectors):
        try:
            image = read(data)
            break
        except (ValueError, struct.error):
            continue
    if image is None:
        raise ValueError("no known image format")
    image.notes = notes + image.notes
    return image, outer
