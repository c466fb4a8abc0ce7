"""HFS, RDOS, Gutenberg and the mere detection of FAT; all read-only."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta

from pomona.sources.disk import Image
from pomona.sources.filesystems import entry


def _mac_date(seconds: int) -> datetime | None:
    return datetime(1904, 1, 1) + timedelta(seconds=seconds) if seconds else None


class HFS:
    """Catalogue and extents as B*-trees of 512-byte nodes; files as up to three extents, more in the second tree."""

    name = "HFS"

    def __init__(self, image: Image):
        self.image, self.used = image, Counter()
        m = image.block(2)
        if m[:2] != b"BD":
            raise ValueError("no HFS volume")
        self.blocks, self.size, _, self.start = struct.unpack_from(">HIIH", m, 18)
        if not self.size or self.size % 512 or m[36] > 27:
            raise ValueError("no HFS volume")
        self.volume = m[37 : 37 + m[36]].decode("mac_roman")
        self.total = image.blocks
        self.bitmap_at = struct.unpack_from(">H", m, 14)[0]
        self.overflow: dict = {}
        self.overflow = dict(self._extents(self._fork(m[134:146], struct.unpack_from(">I", m, 130)[0], 3, 0)))
        self.catalog = self._fork(m[150:162], struct.unpack_from(">I", m, 146)[0], 4, 0)

    def marked(self) -> set[int]:
        out = set()
        for b in range(self.blocks):
            if self.image.block(self.bitmap_at + b // 4096)[b % 4096 // 8] >> (7 - b % 8) & 1:
                out.add(b)
        return out

    def _fork(self, record: bytes, size: int, file_id: int, fork: int) -> bytes:
        out, at = bytearray(), 0
        while len(out) < size:
            got = 0
            for start, count in struct.iter_unpack(">HH", record):
                if count and start + count > self.blocks:
                    raise ValueError("an extent beyond the volume")
                self.used.update(range(start, start + count))
                first = (self.start * 512 + start * self.size) // 512
                out += self.image.run(first, count * self.size // 512)
                got += count
            at += got
            if len(out) >= size:
                break
            record = self.overflow.get((file_id, fork, at))
            if record is None or not got:
                raise ValueError("extents are missing")
        return bytes(out[:size])

    @staticmethod
    def _leaves(tree: bytes) -> Iterator[bytes]:
        """The records of all leaf nodes in order."""
        node, seen = struct.unpack_from(">I", tree, 24)[0], set()
        while node and node not in seen:
            seen.add(node)
            n = tree[node * 512 : node * 512 + 512]
            if len(n) < 512 or n[8] != 0xFF:
                raise ValueError("a damaged tree")
            count = struct.unpack_from(">H", n, 10)[0]
            at = [struct.unpack_from(">H", n, 510 - 2 * i)[0] for i in range(count + 1)]
            yield from (n[a:b] for a, b in zip(at, at[1:]))
            node = struct.unpack_from(">I", n)[0]

    def _extents(self, tree: bytes) -> Iterator[tuple]:
        for r in self._leaves(tree) if tree else ():
            fork, file_id, at = struct.unpack_from(">xBIH", r)
            yield (file_id, fork, at), r[8:20]

    def entries(self) -> Iterator[dict]:
        names, rows = {}, []
        for r in self._leaves(self.catalog):
            parent, n = struct.unpack_from(">I", r, 2)[0], r[6]
            name = r[7 : 7 + n].decode("mac_roman")
            d = r[(1 + r[0] + 1) // 2 * 2 :]
            if d[0] == 1:
                names[struct.unpack_from(">I", d, 6)[0]] = (parent, name)
            if d[0] in (1, 2) and parent != 1:
                rows.append((parent, name, d))

        def path(parent: int, name: str, depth: int = 0) -> str:
            if parent <= 2 or parent not in names or depth > 64:
                return name
            return path(*names[parent], depth + 1) + ":" + name

        for parent, name, d in rows:
            if d[0] == 1:
                yield entry(path=path(parent, name), record_kind="directory", created=_mac_date(struct.unpack_from(">I", d, 10)[0]), modified=_mac_date(struct.unpack_from(">I", d, 14)[0]), format=self.name)
                continue
            kind, creator = struct.unpack_from(">II", d, 4)
            (file_id,), (n_data, p_data) = struct.unpack_from(">I", d, 20), struct.unpack_from(">II", d, 26)
            n_rsrc, p_rsrc = struct.unpack_from(">II", d, 36)
            out = entry(path=path(parent, name), record_kind="forked" if n_rsrc else "file", file_type=kind, aux_type=creator, access=0x21 if d[2] & 1 else 0xE3, created=_mac_date(struct.unpack_from(">I", d, 44)[0]), modified=_mac_date(struct.unpack_from(">I", d, 48)[0]), data_len=n_data, rsrc_len=n_rsrc or None, packed_len=p_data + p_rsrc, format=self.name)
            try:
                out["data"] = self._fork(d[74:86], n_data, file_id, 0)
                out["rsrc"] = self._fork(d[86:98], n_rsrc, file_id, 0xFF) if n_rsrc else None
            except ValueError:
                out["quality"] = "damaged"
            yield out


class RDOS:
    """A catalogue of 32-byte rows on track 1; files are runs of sectors. Three variants, told apart by signature."""

    name = "RDOS"
    TYPES = {"A": 0xFC, "B": 0x06, "T": 0x04}

    def __init__(self, image: Image):
        self.image, self.used = image, Counter()
        head = image.sector(1, 0, "physical")
        text = bytes(c & 0x7F for c in head[:6]).decode("ascii")
        if text not in ("RDOS 2", "RDOS 3") or (image.sectors == 13 and text != "RDOS 2"):
            raise ValueError("no RDOS volume")
        if text == "RDOS 3":
            self.kind, self.order, self.per_track = "RDOS33", "prodos", 16
        else:
            self.kind, self.order, self.per_track = ("RDOS32" if image.sectors == 13 else "RDOS3"), "physical", 13
        self.volume = self.kind

    def marked(self) -> None:
        return None

    def _sector(self, n: int) -> bytes:
        return self.image.sector(*divmod(n, self.per_track), self.order)

    def entries(self) -> Iterator[dict]:
        rows = b"".join(self.image.sector(1, s, self.order) for s in range(11))
        for i in range(88):
            e = rows[32 * i : 32 * i + 32]
            if e[24] == 0:
                return
            if e[0] == 0x80 or e[24] == 0xA0:
                continue
            count, (load, size, start) = e[25], struct.unpack_from("<HHH", e, 26)
            name = bytes(c & 0x7F for c in e[:24]).decode("ascii").rstrip()
            out = entry(path=name, fssep="\0", file_type=self.TYPES.get(chr(e[24] & 0x7F), 0), aux_type=load, data_len=size, packed_len=256 * count, format=self.kind)
            if start + count > self.image.tracks * self.per_track:
                out |= {"quality": "damaged", "data_len": 0}
            else:
                out["data"] = b"".join(self._sector(start + k) for k in range(count))[:size]
                out["chunks"] = [divmod(start + k, self.per_track) for k in range(count)]
                self.used.update(out["chunks"])
            yield out


class Gutenberg:
    """Every sector starts with links to the one before, itself and the next; top bits mark a file's ends."""

    name = "Gutenberg"

    def __init__(self, image: Image):
        self.image, self.used = image, Counter()
        head = image.sector(17, 7)
        if head[:2] != b"\x11\x07" or head[2] & 0x7F != 17 or head[3] & 0x7F != 7 or any(head[16 * i + 15] != 0x8D for i in range(16)):
            raise ValueError("no Gutenberg volume")
        self.volume = bytes(c & 0x7F for c in head[6:15]).decode("ascii").rstrip()

    def marked(self) -> None:
        return None

    def _chain(self, t: int, s: int) -> Iterator[tuple[tuple, bytes]]:
        seen = set()
        while (t, s) not in seen:
            seen.add((t, s))
            b = self.image.sector(t, s)
            yield (t, s), b
            if b[4] & 0x80:
                return
            t, s = b[4], b[5]
        raise ValueError("a chain that loops")

    def entries(self) -> Iterator[dict]:
        for at, b in self._chain(17, 7):
            self.used[at] += 1
            for i in range(1, 16):
                e = b[16 * i : 16 * i + 16]
                if 0x40 in (e[12], e[13]) or e[0] in (0, 0xA0):
                    continue
                out = entry(path=bytes(c & 0x7F for c in e[:12]).decode("ascii").rstrip(), fssep="\0", file_type=0x04, format=self.name)
                try:
                    chain = list(self._chain(e[12], e[13]))
                    data = b"".join(x[6:] for _, x in chain)
                    out |= {"data": data, "data_len": len(data), "packed_len": 256 * len(chain), "chunks": [c for c, _ in chain]}
                    if (e[12], e[13]) != (17, 7):
                        self.used.update(out["chunks"])
                except ValueError:
                    out["quality"] = "damaged"
                yield out


class FAT:
    """Only told from others; one entry says so."""

    name = "FAT"

    def __init__(self, image: Image):
        self.image, self.used = image, Counter()
        b = image.block(0)
        if b[510:512] != b"\x55\xaa" or b[0] not in (0xEB, 0xE9) or int.from_bytes(b[11:13], "little") != 512:
            raise ValueError("no FAT volume")
        self.volume = b[43:54].decode("latin-1").rstrip()

    def marked(self) -> None:
        return None

    def entries(self) -> Iterator[dict]:
        text = b"This volume has a FAT file system, whose files are not read.\r"
        yield entry(path="(not supported)", file_type=0x04, access=0x01, data=text, data_len=len(text), packed_len=len(text), format=self.name)


def build_hfs(volume: str, files: list[dict], blocks: int = 1600) -> bytes:
    """A small HFS volume for files in the root (path, data, rsrc, file_type, aux_type): one level of leaves."""
    disk = bytearray(blocks * 512)
    start, count = 8, blocks - 10
    leaves: list[list[bytes]] = [[]]

    def key(parent: int, name: bytes) -> bytes:
        k = bytes((6 + len(name), 0)) + parent.to_bytes(4, "big") + bytes((len(name),)) + name
        return k + b"\0" * (len(k) % 2)

    def add(record: bytes) -> None:
        if sum(map(len, leaves[-1])) + len(record) + 2 * len(leaves[-1]) + 20 > 512:
            leaves.append([])
        leaves[-1].append(record)

    catalog_blocks = 4 + len(files)
    at = [1 + catalog_blocks]

    def fork(data: bytes) -> tuple[int, int, bytes]:
        n = -(-len(data) // 512)
        first = at[0]
        at[0] += n
        if at[0] > count:
            raise ValueError("the volume is full")
        disk[(start + first) * 512 : (start + first) * 512 + len(data)] = data
        return len(data), n * 512, struct.pack(">HH", first if n else 0, n) + bytes(8)

    name = volume.encode("mac_roman")
    add(key(1, name) + b"\1\0" + struct.pack(">HHI", 0, len(files), 2) + bytes(60))
    for i, f in enumerate(sorted(files, key=lambda f: f["path"].upper())):
        n1, p1, e1 = fork(f.get("data") or b"")
        n2, p2, e2 = fork(f.get("rsrc") or b"")
        body = b"\2\0\0\0" + struct.pack(">II", f.get("file_type", 0x54455854), f.get("aux_type", 0)) + bytes(8) + struct.pack(">IHIIHII", 16 + i, 0, n1, p1, 0, n2, p2) + bytes(12 + 16 + 2) + e1 + e2 + bytes(4)
        add(key(2, f["path"].encode("mac_roman")) + body)
    tree = bytearray(catalog_blocks * 512)
    tree[8], tree[10:12] = 1, b"\0\3"
    tree[14:32] = struct.pack(">HIIII", 1, 1, sum(map(len, leaves)), 1, len(leaves))
    for i, records in enumerate(leaves, 1):
        n, o, places = bytearray(512), 14, []
        n[:12] = struct.pack(">IIBBH", i + 1 if i < len(leaves) else 0, i - 1, 0xFF, 1, len(records))
        for r in records:
            places.append(o)
            n[o : o + len(r)] = r
            o += len(r)
        for k, p in enumerate([*places, o]):
            n[510 - 2 * k : 512 - 2 * k] = p.to_bytes(2, "big")
        if i < catalog_blocks:
            tree[i * 512 : i * 512 + 512] = n
        else:
            raise ValueError("too many files")
    disk[(start + 1) * 512 : (start + 1 + catalog_blocks) * 512] = tree
    m = bytearray(512)
    m[:2], m[14:16], m[18:30] = b"BD", b"\0\3", struct.pack(">HIIH", count, 512, 512, start)
    m[36], m[37 : 37 + len(name)] = len(name), name
    m[146:162] = struct.pack(">IHHHHHH", catalog_blocks * 512, 1, catalog_blocks, 0, 0, 0, 0)
    disk[1024:1536] = m
    bits = bytearray(512)
    for b in range(1, at[0]):
        bits[b // 8] |= 0x80 >> b % 8
    disk[1536:2048] = bits
    return bytes(disk)
