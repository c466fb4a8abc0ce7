"""File systems on disk images: catalogues and file contents, and builders for the ones that are written.

Each reader yields one dictionary per entry with what the `entries` table needs, and marks the chunks it
uses. Damage never stops a catalogue; it is noted on the entry.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np

from pomona.sources.disk import Image

DEPTH = 64


def entry(**values) -> dict:
    base = dict(path="", fssep=":", sub_volume="", record_kind="file", file_type=0, aux_type=0, access=0xE3, created=None, modified=None, data_len=0, rsrc_len=None, packed_len=0, format="", quality="good", data=None, rsrc=None, chunks=[])
    return base | values


def prodos_date(raw: bytes) -> datetime | None:
    """Four bytes of packed date and time; None if there is none or it is no date."""
    date, time = int.from_bytes(raw[:2], "little"), int.from_bytes(raw[2:4], "little")
    year = date >> 9
    try:
        return datetime(year + (2000 if year < 40 else 1900), date >> 5 & 15, date & 31, time >> 8 & 31, time & 63) if date else None
    except ValueError:
        return None


def pack_prodos_date(when: datetime | None) -> bytes:
    if when is None:
        return bytes(4)
    return ((when.year % 100) << 9 | when.month << 5 | when.day).to_bytes(2, "little") + (when.hour << 8 | when.minute).to_bytes(2, "little")


class ProDOS:
    """Volume directory at block 2; seedling, sapling and tree files, forked files, subdirectories."""

    name = "ProDOS"

    def __init__(self, image: Image):
        self.image, self.used = image, Counter()
        head = image.block(2)
        if head[0:2] != b"\0\0" or head[4] >> 4 != 0xF or not 1 <= head[4] & 15 <= 15 or head[35:37] != b"\x27\x0d":
            raise ValueError("no ProDOS volume")
        self.volume = _prodos_name(head[5 : 5 + (head[4] & 15)], head[26:28] if head[32] else b"\0\0")
        self.total = int.from_bytes(head[41:43], "little")
        self.bitmap_at = int.from_bytes(head[39:41], "little")
        self.used.update((0, 1))
        self.used.update(range(self.bitmap_at, self.bitmap_at + -(-self.total // 4096)))

    def fit(self) -> tuple[int, int]:
        """Directory blocks that name the one before them, and, counted down, blocks that files and bitmap say different things of."""
        links, at, before = 0, 2, 0
        while at and at < self.image.blocks and links < self.total:
            b = self.image.block(at)
            if int.from_bytes(b[:2], "little") != before:
                break
            links, before, at = links + 1, at, int.from_bytes(b[2:4], "little")
        probe = ProDOS(self.image)  # of its own, as reading a catalogue counts blocks
        try:
            damaged = sum(e["quality"] == "damaged" for e in probe.entries())
            return links, -len(probe.used.keys() ^ probe.marked()) - damaged
        except (ValueError, IndexError):
            return links, -2 * 65536

    def marked(self) -> set[int]:
        """Blocks that the bitmap says are in use."""
        bits = b"".join(self.image.block(self.bitmap_at + i) for i in range(-(-self.total // 4096)))
        return set(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[: self.total] == 0).tolist())

    def _file(self, kind: int, key: int, eof: int) -> tuple[bytes, list[int], int]:
        """Contents, blocks and the length without holes."""
        if kind == 1:
            index, blocks = [], [key]
        elif kind == 2:
            index, blocks = [key], self._index(key)
        elif kind == 3:
            index, blocks = [key], []
            for k in self._index(key)[: -(-eof // 131072)]:
                index += [k] if k else []
                blocks += self._index(k) if k else [0] * 256
        else:
            raise ValueError(f"storage type {kind}")
        blocks = blocks[: max(1, -(-eof // 512))] if kind == 1 or eof else blocks[:1]
        real = [b for b in blocks if b]
        self.used.update(index + real)
        out = b"".join(self.image.block(b) if b else bytes(512) for b in blocks)
        return out[:eof], index + real, 512 * (len(real) + len(index))

    def _index(self, block: int) -> list[int]:
        b = self.image.block(block)
        return [b[i] | b[256 + i] << 8 for i in range(256)]

    def entries(self, block: int = 2, prefix: str = "", seen: frozenset = frozenset()) -> Iterator[dict]:
        if len(seen) > DEPTH:
            return
        at, first = block, True
        while at and at not in seen:
            seen |= {at}
            self.used[at] += 1
            b = self.image.block(at)
            for i in range(1 if first else 0, 13):
                e = b[4 + 39 * i : 43 + 39 * i]
                kind, n = e[0] >> 4, e[0] & 15
                if not kind:
                    continue
                yield from self._entry(e, kind, n, prefix, seen)
            at, first = int.from_bytes(b[2:4], "little"), False

    def _entry(self, e: bytes, kind: int, n: int, prefix: str, seen: frozenset) -> Iterator[dict]:
        path = prefix + _prodos_name(e[1 : 1 + n], e[28:30])
        key, eof = int.from_bytes(e[17:19], "little"), int.from_bytes(e[21:24], "little")
        out = entry(path=path, fssep="/", file_type=e[16], aux_type=int.from_bytes(e[31:33], "little"), access=e[30], created=prodos_date(e[24:28]), modified=prodos_date(e[33:37]), data_len=eof, packed_len=512 * int.from_bytes(e[19:21], "little"), format=self.name)
        try:
            if kind == 0xD:
                yield out | {"record_kind": "directory", "packed_len": eof}
                yield from self.entries(key, path + "/", seen)
                return
            if kind == 5:
                x = self.image.block(key)
                self.used[key] += 1
                forks = []
                for o in (0, 256):
                    forks.append(self._file(x[o], int.from_bytes(x[o + 1 : o + 3], "little"), int.from_bytes(x[o + 5 : o + 8], "little")))
                (data, c1, p1), (rsrc, c2, p2) = forks
                out |= {"record_kind": "forked", "data": data, "rsrc": rsrc, "data_len": len(data), "rsrc_len": len(rsrc), "packed_len": p1 + p2, "chunks": [key, *c1, *c2]}
            else:
                out["data"], out["chunks"], out["packed_len"] = self._file(kind, key, eof)
        except (ValueError, IndexError):
            out["quality"] = "damaged"
        yield out


def _prodos_name(raw: bytes, flags: bytes) -> str:
    bits = int.from_bytes(flags, "little")
    name = raw.decode("latin-1")
    return "".join(c.lower() if bits & 0x8000 and bits >> (14 - i) & 1 else c for i, c in enumerate(name))


def build_prodos(volume: str, files: list[dict], blocks: int = 280) -> bytes:
    """A volume image with the given files (path, data, rsrc, file_type, aux_type, access, created, modified).

    Directories are made as paths need them, or by rows with the record_kind directory. Blocks of zeros inside a file become holes.
    """
    bitmap = -(-blocks // 4096)
    disk, free = bytearray(blocks * 512), iter(range(6 + bitmap, blocks))
    used = set(range(6 + bitmap))

    def take() -> int:
        b = next(free, None)
        if b is None:
            raise ValueError("the volume is full")
        used.add(b)
        return b

    def put(b: int, data: bytes) -> None:
        disk[b * 512 : b * 512 + len(data)] = data

    def fork(data: bytes) -> tuple[int, int, int]:
        """Storage type, key block, blocks used."""
        parts = [data[i : i + 512] for i in range(0, len(data), 512)] or [b""]
        where = []
        for i, p in enumerate(parts):
            hole = i and not any(p) and len(parts) > 1
            where.append(0 if hole else take())
            if not hole:
                put(where[-1], p)
        real = sum(map(bool, where))
        if len(where) == 1:
            return 1, where[0], 1

        def index(some: list[int]) -> int:
            b = take()
            put(b, bytes(x & 255 for x in some).ljust(256, b"\0") + bytes(x >> 8 for x in some).ljust(256, b"\0"))
            return b

        if len(where) <= 256:
            return 2, index(where), real + 1
        subs = [index(where[i : i + 256]) for i in range(0, len(where), 256)]
        return 3, index(subs), real + len(subs) + 1

    def row(kind: int, name: str, file_type: int, key: int, count: int, eof: int, f: dict, header: int) -> bytes:
        up = name.upper()
        flags = sum(1 << (14 - i) for i, c in enumerate(name) if c.islower())
        flags = (flags | 0x8000) if flags else 0
        e = bytes((kind << 4 | len(up),)) + up.encode().ljust(15, b"\0") + bytes((file_type,)) + key.to_bytes(2, "little") + count.to_bytes(2, "little") + eof.to_bytes(3, "little")
        return e + pack_prodos_date(f.get("created")) + flags.to_bytes(2, "little") + bytes((f.get("access", 0xE3),)) + f.get("aux_type", 0).to_bytes(2, "little") + pack_prodos_date(f.get("modified")) + header.to_bytes(2, "little")

    tree: dict = {}
    for f in files:
        at = tree
        *parents, name = f["path"].split("/")
        for p in parents:
            at = at.setdefault(p, {})
        if f.get("record_kind") == "directory":  # one that may stay empty
            at.setdefault(name, {})
        else:
            at[name] = f

    def directory(node: dict, chain: list[int], head: bytes) -> None:
        rows = [head]
        for name, f in node.items():
            if "path" in f and isinstance(f.get("data", b""), bytes):
                if f.get("rsrc") is not None:
                    b = take()
                    x = bytearray(512)
                    n = 1
                    for o, part in ((0, f.get("data") or b""), (256, f["rsrc"])):
                        k, key, count = fork(part)
                        x[o : o + 8] = bytes((k,)) + key.to_bytes(2, "little") + count.to_bytes(2, "little") + len(part).to_bytes(3, "little")
                        n += count
                    put(b, bytes(x))
                    rows.append(row(5, name, f.get("file_type", 6), b, n, 512, f, chain[0]))
                else:
                    data = f.get("data") or b""
                    k, key, count = fork(data)
                    rows.append(row(k, name, f.get("file_type", 6), key, count, len(data), f, chain[0]))
            else:
                need = -(-(len(f) + 1) // 13)
                own = [take() for _ in range(need)]
                parent = (len(rows) // 13, len(rows) % 13 + 1)
                sub = bytes((0xE0 | len(name),)) + name.upper().encode().ljust(15, b"\0") + b"\x75" + bytes(7) + bytes(4) + b"\0\0" + b"\xc3\x27\x0d" + len(f).to_bytes(2, "little") + chain[parent[0]].to_bytes(2, "little") + bytes((parent[1], 0x27))
                rows.append(row(0xD, name, 0x0F, own[0], need, 512 * need, {}, chain[0]))
                directory(f, own, sub)
        if len(rows) > 13 * len(chain):
            raise ValueError("the directory is full")
        for i, b in enumerate(chain):
            part = rows[13 * i : 13 * i + 13]
            prev, nxt = (chain[i - 1] if i else 0), (chain[i + 1] if i + 1 < len(chain) else 0)
            put(b, prev.to_bytes(2, "little") + nxt.to_bytes(2, "little") + b"".join(r.ljust(39, b"\0") for r in part))

    head = bytes((0xF0 | len(volume),)) + volume.upper().encode().ljust(15, b"\0") + bytes(8) + bytes(4) + b"\0\0" + b"\xc3\x27\x0d" + len(tree).to_bytes(2, "little") + (6).to_bytes(2, "little") + blocks.to_bytes(2, "little")
    directory(tree, [2, 3, 4, 5], head)
    bits = bytearray(512 * bitmap)
    for b in range(blocks):
        if b not in used:
            bits[b // 8] |= 0x80 >> b % 8
    put(6, bytes(bits))
    return bytes(disk)


class DOS:
    """VTOC at track 17, linked catalogue sectors, track/sector lists."""

    name = "DOS"
    #: Letters of the type bits, and the ProDOS type each stands for.
    TYPES = {0x00: ("T", 0x04), 0x01: ("I", 0xFA), 0x02: ("A", 0xFC), 0x04: ("B", 0x06), 0x08: ("S", 0xF2), 0x10: ("R", 0xFE), 0x20: ("AA", 0xFC), 0x40: ("BB", 0x06)}

    def __init__(self, image: Image):
        self.image, self.used = image, Counter()
        if image.tracks < 18:
            raise ValueError("too few tracks")
        self.vtoc = image.sector(17, 0)
        t, s = self.vtoc[1], self.vtoc[2]
        if t >= image.tracks or s >= image.sectors or self.vtoc[0x34] < 18 or self.vtoc[0x35] not in (13, 16, 32) or not 1 <= self.vtoc[3] <= 3:
            raise ValueError("no DOS volume")
        good, seen = 0, set()
        while t and (t, s) not in seen and t < image.tracks and s < image.sectors:
            seen.add((t, s))
            b = image.sector(t, s)
            t, s = b[1], b[2]
            good += 1
        if good < 3:
            raise ValueError("no DOS catalogue")
        self.good = good
        self.volume = f"DOS {self.vtoc[6]:03d}"
        self.used.update((0, s) for s in range(image.sectors))
        self.used.update((t, s) for t in (1, 2) for s in range(image.sectors))
        self.used[17, 0] += 1

    def fit(self) -> int:
        """A catalogue's first sector stands at the same place in all orders, so its longest chain decides."""
        return self.good

    def marked(self) -> set:
        out = set()
        for t in range(self.image.tracks):
            bits = int.from_bytes(self.vtoc[0x38 + 4 * t : 0x3C + 4 * t], "big")
            out.update((t, s) for s in range(self.image.sectors) if not bits >> (32 - self.image.sectors + s) & 1)
        return out

    def entries(self) -> Iterator[dict]:
        t, s, seen = self.vtoc[1], self.vtoc[2], set()
        while t and (t, s) not in seen:
            seen.add((t, s))
            self.used[t, s] += 1
            b = self.image.sector(t, s)
            for i in range(7):
                e = b[11 + 35 * i : 46 + 35 * i]
                if e[0] == 0:
                    return
                if e[0] != 0xFF:
                    yield self._entry(e)
            t, s = b[1], b[2]

    def _entry(self, e: bytes) -> dict:
        letter, kind = self.TYPES.get(e[2] & 0x7F, ("?", 0))
        name = bytes(c & 0x7F for c in e[3:33]).decode("ascii").rstrip(" ")
        out = entry(path=name, fssep="\0", file_type=kind, access=0x21 if e[2] & 0x80 else 0xE3, format=self.name)
        try:
            lists, sectors, t, s = [], [], e[0], e[1]
            while t:
                if (t, s) in lists:
                    raise ValueError("a list that loops")
                lists.append((t, s))
                b = self.image.sector(t, s)
                sectors += [(b[12 + 2 * i], b[13 + 2 * i]) for i in range(122)]
                t, s = b[1], b[2]
            while sectors and sectors[-1] == (0, 0):
                sectors.pop()
            real = [c for c in sectors if c != (0, 0)]
            raw = b"".join(self.image.sector(*c) if c != (0, 0) else bytes(256) for c in sectors)
            self.used.update(lists + real)
            data, aux, suspicious = self._cut(letter, raw)
            out |= {"data": data, "data_len": len(data), "aux_type": aux, "packed_len": max(0, len(data) - 256 * (len(sectors) - len(real))), "chunks": lists + real}
            if suspicious:
                out["quality"] = "suspicious"
        except ValueError:
            out["quality"] = "damaged"
        return out

    @staticmethod
    def _cut(letter: str, raw: bytes) -> tuple[bytes, int, bool]:
        """Contents, aux type, and whether a length in the file goes beyond its sectors."""
        if letter in ("A", "I"):
            n = int.from_bytes(raw[:2], "little")
            return raw[2 : 2 + n], 0x801 if letter == "A" else 0, n + 2 > len(raw) > 0
        if letter == "B":
            n = int.from_bytes(raw[2:4], "little")
            return raw[4 : 4 + n], int.from_bytes(raw[:2], "little"), n + 4 > len(raw) > 0
        if letter == "T":
            last = raw[-256:].find(0)
            return (raw if last < 0 else raw[: len(raw) - len(raw[-256:]) + last]), 0, False
        return raw, 0, False


def build_dos(files: list[dict], volume: int = 254, tracks: int = 35) -> bytes:
    """A DOS 3.3 volume in DOS order with files (path, data, kind as a type letter, aux_type, locked)."""
    disk = bytearray(tracks * 4096)
    free = [(t, s) for t in [*range(18, tracks), *range(16, 2, -1)] for s in range(15, -1, -1)]
    letters = {v[0]: k for k, v in DOS.TYPES.items()}

    def put(t: int, s: int, data: bytes) -> None:
        at = (t * 16 + s) * 256
        disk[at : at + len(data)] = data

    rows = []
    for f in files:
        data, kind = f.get("data", b""), f.get("kind", "B")
        if kind in ("A", "I"):
            data = len(data).to_bytes(2, "little") + data
        elif kind == "B":
            data = f.get("aux_type", 0).to_bytes(2, "little") + len(data).to_bytes(2, "little") + data
        parts = [data[i : i + 256] for i in range(0, len(data), 256)]
        if len(free) < len(parts) + -(-max(1, len(parts)) // 122):
            raise ValueError("the disk is full")
        where = []
        for p in parts:
            hole = kind == "T" and not any(p)
            where.append((0, 0) if hole else free.pop(0))
            if not hole:
                put(*where[-1], p)
        lists = [free.pop(0) for _ in range(-(-max(1, len(where)) // 122))]
        for i, at in enumerate(lists):
            nxt = lists[i + 1] if i + 1 < len(lists) else (0, 0)
            put(*at, bytes((0, *nxt, 0, 0)) + (122 * i).to_bytes(2, "little") + bytes(5) + b"".join(bytes(c) for c in where[122 * i : 122 * i + 122]))
        size = sum(c != (0, 0) for c in where) + len(lists)
        name = bytes(ord(c) | 0x80 for c in f["path"].ljust(30)[:30])
        rows.append(bytes((*lists[0], letters[kind] | (0x80 if f.get("locked") else 0))) + name + size.to_bytes(2, "little"))
    if len(rows) > 105:
        raise ValueError("the catalogue is full")
    for i in range(15):
        s = 15 - i
        nxt = (17, s - 1) if s > 1 else (0, 0)
        put(17, s, bytes((0, *nxt)) + bytes(8) + b"".join(rows[7 * i : 7 * i + 7]))
    vtoc = bytearray(256)
    vtoc[:7] = bytes((4, 17, 15, 3, 0, 0, volume))
    vtoc[0x27], vtoc[0x30], vtoc[0x31], vtoc[0x34], vtoc[0x35], vtoc[0x37] = 122, 18, 1, tracks, 16, 1
    for t in range(tracks):
        bits = sum(1 << (16 + s) for s in range(16) if (t, s) in set(free))
        vtoc[0x38 + 4 * t : 0x3C + 4 * t] = bits.to_bytes(4, "big")
    put(17, 0, bytes(vtoc))
    return bytes(disk)


class Pascal:
    """Directory of 26-byte rows at block 2; files are contiguous."""

    name = "Pascal"
    #: The ProDOS type of each kind.
    KINDS = {0: 0, 1: 0x01, 2: 0x02, 3: 0x03, 4: 0, 5: 0x05, 6: 0, 7: 0x08, 8: 0x09}

    def __init__(self, image: Image):
        self.image, self.used = image, Counter()
        head = b"".join(image.block(b) for b in range(2, 6))
        start, end = int.from_bytes(head[:2], "little"), int.from_bytes(head[2:4], "little")
        n = head[6]
        self.total, self.count = int.from_bytes(head[14:16], "little"), int.from_bytes(head[16:18], "little")
        if start != 0 or not 3 <= end <= 64 or head[4:6] != b"\0\0" or not 1 <= n <= 7 or not all(0x20 < c < 0x7F for c in head[7 : 7 + n]) or not 0 < self.total <= max(image.blocks, 280) or self.count > 77:
            raise ValueError("no Pascal volume")
        self.volume = head[7 : 7 + n].decode("ascii")
        self.rows = b"".join(image.block(b) for b in range(2, min(end, image.blocks)))
        self.used.update(range(end))

    def fit(self) -> tuple[int, int]:
        """Rows that name a file behind the one before, and, counted down, what stands behind the last row."""
        good, at = 0, len(self.used)
        for i in range(1, self.count + 1):
            e = self.rows[26 * i : 26 * i + 26]
            a, b = int.from_bytes(e[:2], "little"), int.from_bytes(e[2:4], "little")
            if len(e) == 26 and at <= a < b <= self.total and 1 <= e[6] <= 15 and all(0x20 < c < 0x7F for c in e[7 : 7 + e[6]]):
                good, at = good + 1, b
        rest = self.rows[26 * (self.count + 1) :]
        return good, rest.count(0) - len(rest)

    def marked(self) -> None:
        return None  # this file system keeps no bitmap

    def entries(self) -> Iterator[dict]:
        for i in range(1, self.count + 1):
            e = self.rows[26 * i : 26 * i + 26]
            a, b, kind, last = int.from_bytes(e[:2], "little"), int.from_bytes(e[2:4], "little"), e[4] & 15, int.from_bytes(e[22:24], "little")
            size = (b - a - 1) * 512 + last
            out = entry(path=e[7 : 7 + min(15, e[6])].decode("ascii", "replace"), fssep="\0", file_type=self.KINDS.get(kind, 0), data_len=max(0, size), packed_len=max(0, b - a) * 512, modified=_pascal_date(e[24:26]), format=self.name, chunks=list(range(a, b)))
            try:
                if b <= a or last > 512:
                    raise ValueError("an extent that ends before it starts")
                out["data"] = b"".join(self.image.block(k) for k in range(a, b))[:size]
                self.used.update(range(a, b))
            except ValueError:
                out["quality"] = "damaged"
            yield out


def _pascal_date(raw: bytes) -> datetime | None:
    """Month in the low 4 bits, then day in 5, then year in 7."""
    v = int.from_bytes(raw, "little")
    year = v >> 9
    try:
        return datetime(year + (2000 if year < 40 else 1900), v & 15, v >> 4 & 31)
    except ValueError:
        return None


def build_pascal(volume: str, files: list[dict], blocks: int = 280) -> bytes:
    disk, at, rows = bytearray(blocks * 512), 6, []
    for f in files:
        data, when = f.get("data", b""), f.get("modified")
        n = max(1, -(-len(data) // 512))
        if at + n > blocks:
            raise ValueError("the volume is full")
        disk[at * 512 : at * 512 + len(data)] = data
        date = ((when.year % 100) << 9 | when.day << 4 | when.month) if when else 0
        name = f["path"].upper().encode()[:15]
        last = len(data) - (n - 1) * 512
        rows.append(at.to_bytes(2, "little") + (at + n).to_bytes(2, "little") + f.get("kind", 5).to_bytes(2, "little") + bytes((len(name),)) + name.ljust(15, b"\0") + last.to_bytes(2, "little") + date.to_bytes(2, "little"))
        at += n
    name = volume.upper().encode()[:7]
    head = bytes((0, 0, 6, 0, 0, 0, len(name))) + name.ljust(7, b"\0") + blocks.to_bytes(2, "little") + len(rows).to_bytes(2, "little") + bytes(8)
    table = head + b"".join(rows)
    disk[1024 : 1024 + len(table)] = table
    return bytes(disk)


class CPM:
    """32-byte extents in the first two kilobytes of the directory; 1 KB allocation blocks after three system tracks."""

    name = "CP/M"

    def __init__(self, image: Image):
        self.image, self.used = image, Counter()
        if image.sectors != 16 or len(image.data) != 143360:
            raise ValueError("no CP/M floppy")
        self.directory = self._alloc(0) + self._alloc(1)
        for i in range(64):
            e = self.directory[32 * i : 32 * i + 32]
            if e[0] == 0xE5:
                continue
            if e[0] > 31 or any(c & 0x7F < 0x20 for c in e[1:12]) or e[12] > 31 or e[15] > 128 or any(b > 127 for b in e[16:]):
                raise ValueError("no CP/M directory")
        if all(self.directory[32 * i] == 0xE5 for i in range(64)) and len(set(self.directory)) > 1:
            raise ValueError("no CP/M directory")
        self.volume = "CP/M"

    def _alloc(self, n: int) -> bytes:
        return self.image.block(24 + 2 * n, "cpm") + self.image.block(25 + 2 * n, "cpm")

    def marked(self) -> None:
        return None

    def entries(self) -> Iterator[dict]:
        files: dict = {}
        for i in range(64):
            e = self.directory[32 * i : 32 * i + 32]
            if e[0] != 0xE5:
                files.setdefault((e[0], bytes(c & 0x7F for c in e[1:12])), []).append(e)
        for (user, raw), extents in files.items():
            extents.sort(key=lambda e: e[12])
            last = extents[-1]
            size = 16 * 1024 * last[12] + 128 * last[15]
            blocks = [b for e in extents for b in e[16:] if b]
            base, ext = raw[:8].decode("ascii").rstrip(), raw[8:].decode("ascii").rstrip()
            out = entry(path=base + ("." + ext if ext else ""), fssep="\0", access=0x21 if extents[0][9] & 0x80 else 0xE3, aux_type=user, data_len=size, packed_len=1024 * len(blocks), format=self.name, chunks=blocks)
            try:
                out["data"] = b"".join(self._alloc(b) for b in blocks)[:size]
                self.used.update(blocks)
            except ValueError:
                out["quality"] = "damaged"
            yield out


def open_filesystem(image: Image, forced: str | None = None, extra: Sequence[type] = (), settled: bool = False):
    """The file system on an image, trying its preferred sector order first; None if there is none that is known.

    The order of detection is part of the result on hybrid disks. extra: further file systems, classes like those here,
    which are tried last. Where a volume's first sector stands at the same place in several orders, the order that `fit`
    speaks for most is taken; on ProDOS and Pascal disks only unless the image's order is settled.
    """
    from pomona.sources.more_filesystems import FAT, HFS, RDOS, Gutenberg

    kinds = [k for k in (FAT, DOS, ProDOS, Pascal, CPM, RDOS, HFS, Gutenberg, *extra) if forced in (None, k.name)]
    if image.order and image.physical == "sectors" and len(image.data) % 4096 == 0:
        orders = [image.order, *(o for o in ("prodos", "dos", "cpm", "physical") if o != image.order)]
    else:
        orders = [image.order]
    for kind in kinds:
        found = []
        for order in orders:
            trial = Image(image.data, order, image.sectors, image.file_format, image.physical, image.volume, image.damaged, image.notes, image.bad)
            try:
                found.append(kind(trial))
            except (ValueError, IndexError):
                continue
            if kind is not DOS and (settled or not hasattr(kind, "fit")):
                break
        if found:
            return found[0] if len(found) == 1 else max(found, key=lambda system: system.fit())
    return None
