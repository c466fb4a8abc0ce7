"""File archives: NuFX, Binary II, AppleSingle and ACU, from the published formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

from pomona.functions.codecs import FORMATS, compress, crc16, expand, unsqueeze
from pomona.sources.filesystems import entry, pack_prodos_date, prodos_date

NUFILE, NUFX = bytes((0x4E, 0xF5, 0x46, 0xE9, 0x6C, 0xE5)), bytes((0x4E, 0xF5, 0x46, 0xD8))
BINARY2 = b"\x0aGL"
#: How far an archive may lie behind other headers.
JUNK = 1024
#: Thread classes and kinds of data threads.
CLASSES = {0: "message", 1: "control", 2: "data", 3: "filename"}
DATA_KINDS = {0: "data", 1: "disk", 2: "rsrc"}


# --- NuFX


def nufx_date(raw: bytes) -> tuple[datetime | None, str]:
    """Eight bytes: second, minute, hour, year - 1900, day - 1, month - 1, filler, weekday; with its state."""
    if not any(raw):
        return None, "none"
    s, m, h, y, d, mo = raw[:6]
    year = y + (2000 if y < 40 else 1900)
    try:
        out = datetime(year, mo + 1, d + 1, h, m, s)
    except ValueError:
        return None, "invalid"
    return (out, "ok") if year >= 1969 else (None, "invalid")


def pack_nufx_date(when: datetime | None) -> bytes:
    if when is None:
        return bytes(8)
    return bytes((when.second, when.minute, when.hour, when.year % 100 if when.year >= 2000 else when.year - 1900, when.day - 1, when.month - 1, 0, when.isoweekday() % 7 + 1))


def find_nufx(data: bytes) -> int:
    """Where the archive starts; other headers may stand before it."""
    at = data.find(NUFILE, 0, JUNK + 6)
    if at < 0:
        at = data.find(NUFILE, 0x2EE5, 0x2EE5 + 6)
    if at < 0:
        raise ValueError("no NuFX archive")
    return at


def read_nufx(data: bytes) -> Iterator[dict]:
    """One dictionary per record: header values, `threads` (class, kind, format, crc, lengths, payload), `status`."""
    at = find_nufx(data)
    head = data[at : at + 48]
    if len(head) < 48 or crc16(head[8:]) != int.from_bytes(head[6:8], "little"):
        raise ValueError("the master header's CRC is wrong")
    count = int.from_bytes(head[8:12], "little")
    at += 48
    for ordinal in range(count):
        if data[at : at + 4] != NUFX:
            yield dict(ordinal=ordinal, status="damaged", error="no record where one must stand", path="", threads=[])
            return
        if at + 58 > len(data):
            yield dict(ordinal=ordinal, status="damaged", error="a record header is cut", path="", threads=[])
            return
        size = int.from_bytes(data[at + 6 : at + 8], "little")
        _, _, version, n, file_sys, info, access, kind, extra, storage = struct.unpack_from("<HHHIHHIIIH", data, at + 4)
        created, modified, archived = (nufx_date(data[at + o : at + o + 8]) for o in (32, 40, 48))
        # the attributes end with the name's length
        name_len = int.from_bytes(data[at + size - 2 : at + size], "little")
        name_at = at + size
        threads_at = name_at + name_len
        if size < 58 or threads_at + 16 * n > len(data):
            yield dict(ordinal=ordinal, status="damaged", error="a record header is cut", path="", threads=[])
            return
        header = data[at + 6 : threads_at + 16 * n]
        good = crc16(header) == int.from_bytes(data[at + 4 : at + 6], "little")
        name = data[name_at : name_at + name_len]
        threads, body = [], threads_at + 16 * n
        for i in range(n):
            cls, fmt, knd, crc, eof, comp = struct.unpack_from("<HHHHII", data, threads_at + 16 * i)
            payload = data[body : body + comp]
            body += comp
            threads.append(dict(thread_idx=i, thread_class=cls, kind=knd, format=fmt, crc16=crc, eof=eof, comp_eof=comp, payload=payload, whole=len(payload) == comp))
            if cls == 3 and not name:
                name = payload[:eof]
        sep = chr(info & 0xFF)
        yield dict(
            ordinal=ordinal, status="ok" if good else "damaged", error=None if good else "the record header's CRC is wrong", path=name.decode("mac_roman"), path_raw=name, fssep=sep, file_sys=file_sys, access=access, file_type=kind, aux_type=extra,
            storage=storage, version=version, created=created[0], created_state=created[1], modified=modified[0], modified_state=modified[1], archived=archived[0], threads=threads,
        )
        at = body


def thread_bytes(thread: dict, storage: int = 512) -> bytes:
    """A thread's contents, its CRC checked where it has one."""
    size = thread["eof"]
    if thread["thread_class"] == 2 and thread["kind"] == 1 and not size:
        size = storage * 512
    out = expand(thread["payload"], thread["format"], size)
    if thread["crc16"] and thread["thread_class"] == 2 and crc16(out, 0xFFFF) != thread["crc16"]:
        raise ValueError("the thread's CRC is wrong")
    return out


def record_entry(record: dict) -> dict:
    """What a catalogue shows of a record: its kind, lengths, first packed format and comments."""
    threads = record["threads"]
    data = [t for t in threads if t["thread_class"] == 2]
    kinds = [DATA_KINDS.get(t["kind"], "?") for t in data]
    # the last of resource fork and disk image decides; a plain file only if nothing else did
    kind = "unknown"
    for k in kinds:
        kind = {"rsrc": "forked", "disk": "disk"}.get(k, "file" if kind == "unknown" else kind)
    if any(t["thread_class"] == 1 and t["kind"] == 0 for t in threads):
        kind = "directory"
    length = lambda k: next((t["eof"] for t, x in zip(data, kinds) if x == k), None)
    packed = next((FORMATS.get(t["format"], "unknown") for t in data if t["format"]), "stored")
    disk = next((t for t, x in zip(data, kinds) if x == "disk"), None)
    comments = [t for t in threads if t["thread_class"] == 0 and t["kind"] == 1]
    return entry(
        path=record["path"], fssep=record.get("fssep", ":"), record_kind=kind, file_type=record.get("file_type", 0), aux_type=record.get("aux_type", 0), access=record.get("access", 0), created=record.get("created"), modified=record.get("modified"),
        data_len=(disk["eof"] or record["storage"] * 512) if disk else length("data") or 0, rsrc_len=length("rsrc"), packed_len=sum(t["comp_eof"] for t in data), format=packed,
        quality="good" if record["status"] == "ok" and all(t["whole"] for t in threads) else "damaged", has_data="data" in kinds, has_rsrc="rsrc" in kinds, has_disk_image="disk" in kinds, has_comment=bool(comments), comment_nonempty=any(t["eof"] for t in comments),
    )


def write_nufx(files: list[dict], kind: int = 3, when: datetime | None = None) -> bytes:
    """An archive of files (path, data, rsrc, disk, comment, file_type, aux_type, access, created, modified), packed with a thread format.

    Version 3 records; each path is kept in a filename thread. A file's `packed` has threads of an archive by part (data,
    rsrc, disk) that hold what these parts do; those in that format already are written as they are.
    """
    out = bytearray()
    for f in files:
        threads, payloads = [], []

        def add(cls: int, knd: int, data: bytes, fmt: int = 0, room: int = 0, crc: bool = False, eof: int | None = None) -> None:
            ready = f.get("packed", {}).get(DATA_KINDS[knd]) if cls == 2 else None
            ready = ready if ready and fmt and ready["format"] == fmt and ready["whole"] else None
            used, packed = (fmt, ready["payload"]) if ready else compress(data, fmt)
            packed = packed.ljust(room, b"\0")
            threads.append(struct.pack("<HHHHII", cls, used, knd, crc16(data, 0xFFFF) if crc else 0, len(data) if eof is None else eof, len(packed)))
            payloads.append(packed)

        name = f["path"].encode("mac_roman", "replace")
        add(3, 0, name, room=max(32, len(name)))
        if f.get("comment") is not None:
            add(0, 1, f["comment"].encode("mac_roman", "replace"), room=200)
        if f.get("disk") is not None:
            add(2, 1, f["disk"], kind, crc=True)
        if f.get("data") is not None:
            add(2, 0, f["data"], kind, crc=True)
        if f.get("rsrc") is not None:
            add(2, 2, f["rsrc"], kind, crc=True)
        storage = 512 if f.get("disk") is not None else 5 if f.get("rsrc") is not None else 1
        kind_extra = (0, len(f["disk"]) // 512) if f.get("disk") is not None else (f.get("file_type", 0), f.get("aux_type", 0))
        body = struct.pack("<HHIHHIIIH", 60, 3, len(threads), 1, ord(f.get("fssep", "/")), f.get("access", 0xE3), *kind_extra, storage)
        body += pack_nufx_date(f.get("created")) + pack_nufx_date(f.get("modified")) + pack_nufx_date(when) + bytes(2) + bytes(2) + b"".join(threads)
        # what follows the attributes: no name in the header
        out += NUFX + crc16(body).to_bytes(2, "little") + body + b"".join(payloads)
    rest = len(files).to_bytes(4, "little") + pack_nufx_date(when) * 2 + (2).to_bytes(2, "little") + bytes(8) + (48 + len(out)).to_bytes(4, "little") + bytes(6)
    return NUFILE + crc16(rest).to_bytes(2, "little") + rest + bytes(out)


# --- Binary II


def read_binary2(data: bytes) -> Iterator[dict]:
    """128-byte headers, each followed by its file in whole blocks; members named .QQ are squeezed."""
    at = 0
    if len(data) < 128:
        raise ValueError("no Binary II file")
    while at + 128 <= len(data):
        h = data[at : at + 128]
        if h[:3] != BINARY2 or h[18] != 2:
            if at == 0:
                raise ValueError("no Binary II file")
            return
        size = int.from_bytes(h[20:23], "little") | h[116] << 24
        name = h[24 : 24 + min(h[23], 64)].decode("ascii", "replace")
        body = data[at + 128 : at + 128 + size]
        directory = h[7] == 0x0D or h[4] == 0x0F
        out = entry(path=name, fssep="/", record_kind="directory" if directory else "file", access=h[3], file_type=h[4], aux_type=int.from_bytes(h[5:7], "little") | int.from_bytes(h[109:111], "little") << 16, modified=prodos_date(h[10:14]), created=prodos_date(h[14:18]), data_len=size, packed_len=size, format="stored")
        out["data"] = body
        if len(body) < size:
            out["quality"] = "damaged"
        elif body[:2] == b"\x76\xff" and name.upper().endswith(".QQ"):
            try:
                out["data"] = unsqueeze(body[body.index(0, 4) + 1 :])
                out |= {"format": "squeeze", "data_len": len(out["data"]), "path": name[:-3]}
            except ValueError:
                out["quality"] = "damaged"
        yield out
        at += 128 + (0 if directory else -(-size // 128) * 128)
        if h[127] == 0:
            return


def write_binary2(files: list[dict]) -> bytes:
    out = bytearray()
    for i, f in enumerate(files):
        data, name = f.get("data", b""), f["path"].encode("ascii")[:64]
        h = bytearray(128)
        h[:3], h[3], h[4] = BINARY2, f.get("access", 0xE3), f.get("file_type", 6)
        h[5:7], h[7], h[8:10] = (f.get("aux_type", 0) & 0xFFFF).to_bytes(2, "little"), 1, (-(-len(data) // 512)).to_bytes(2, "little")
        h[10:14], h[14:18] = pack_prodos_date(f.get("modified")), pack_prodos_date(f.get("created"))
        h[18], h[20:23], h[23] = 2, len(data).to_bytes(4, "little")[:3], len(name)
        h[24 : 24 + len(name)], h[126], h[127] = name, 1, len(files) - 1 - i
        out += h + data + bytes(-len(data) % 128)
    return bytes(out)


# --- AppleSingle


def read_applesingle(data: bytes, name: str = "") -> dict:
    """Version 1 or 2, either byte order: one file of several parts."""
    for order in (">", "<"):
        magic, version = struct.unpack_from(order + "II", data)
        if magic == 0x00051600 and version in (0x00010000, 0x00020000):
            break
    else:
        raise ValueError("no AppleSingle file")
    (n,) = struct.unpack_from(order + "H", data, 24)
    parts = {}
    for i in range(n):
        kind, at, size = struct.unpack_from(order + "III", data, 26 + 12 * i)
        parts[kind] = data[at : at + size]
    out = entry(path=parts.get(3, name.encode()).decode("mac_roman"), format="stored", data=parts.get(1), rsrc=parts.get(2), data_len=len(parts.get(1, b"")), rsrc_len=len(parts[2]) if 2 in parts else None, packed_len=len(parts.get(1, b"")) + len(parts.get(2, b"")))
    if 2 in parts:
        out["record_kind"] = "forked"
    if len(parts.get(11, b"")) >= 8:  # ProDOS attributes
        out["access"], out["file_type"], out["aux_type"] = struct.unpack_from(order + "HHI", parts[11])
    elif len(parts.get(9, b"")) >= 8:  # Finder attributes
        out["file_type"], out["aux_type"] = struct.unpack_from(">II", parts[9])
    if len(parts.get(8, b"")) >= 8:  # seconds from 2000
        made, changed = struct.unpack_from(order + "ii", parts[8])
        out["created"], out["modified"] = (datetime.fromtimestamp(946684800 + x) if x != -(1 << 31) else None for x in (made, changed))
    if 4 in parts:
        out["comment"] = parts[4].decode("mac_roman")
    return out


def write_applesingle(f: dict) -> bytes:
    parts = [(3, f["path"].encode("mac_roman", "replace")), (11, struct.pack(">HHI", f.get("access", 0xE3), f.get("file_type", 0), f.get("aux_type", 0)))]
    parts += [(k, f[n]) for k, n in ((1, "data"), (2, "rsrc")) if f.get(n) is not None]
    at, heads = 26 + 12 * len(parts), b""
    for kind, body in parts:
        heads += struct.pack(">III", kind, at, len(body))
        at += len(body)
    return struct.pack(">II16xH", 0x00051600, 0x00020000, len(parts)) + heads + b"".join(b for _, b in parts)


# --- ACU


def read_acu(data: bytes) -> Iterator[dict]:
    """A 20-byte master header with the count and ``fZink``, then 54-byte file headers with names and data."""
    if data[2:4] != b"\1\0" or data[4:9] != b"fZink":
        raise ValueError("no ACU archive")
    at = 20
    for _ in range(int.from_bytes(data[:2], "little")):
        h = data[at : at + 54]
        if len(h) < 54:
            return
        packed, size, n = int.from_bytes(h[18:22], "little"), int.from_bytes(h[38:42], "little"), int.from_bytes(h[50:52], "little")
        name = data[at + 54 : at + 54 + n].decode("ascii", "replace")
        body = data[at + 54 + n : at + 54 + n + packed]
        directory = h[32] == 0x0D
        out = entry(path=name, fssep="/", record_kind="directory" if directory else "file", access=int.from_bytes(h[22:24], "little"), file_type=int.from_bytes(h[24:26], "little"), aux_type=int.from_bytes(h[26:30], "little"), created=prodos_date(h[42:46]), modified=prodos_date(h[46:50]), data_len=size, packed_len=packed, format="squeeze" if h[1] == 3 else "stored")
        try:
            out["data"] = body if h[1] == 0 else unsqueeze(body)
            if h[1] not in (0, 3) or len(body) < packed:
                raise ValueError("unknown or cut data")
        except ValueError:
            out["quality"] = "damaged"
        yield out
        at += 54 + n + packed


def write_acu(files: list[dict]) -> bytes:
    out = bytearray(len(files).to_bytes(2, "little") + b"\1\0fZink" + bytes(11))
    for f in files:
        data = f.get("data", b"")
        used, body = compress(data, 1)
        h = bytearray(54)
        h[1] = 3 if used else 0
        h[10:12], h[18:22] = (-(-len(data) // 512)).to_bytes(2, "little"), len(body).to_bytes(4, "little")
        h[22:24], h[24:26], h[26:30] = f.get("access", 0xE3).to_bytes(2, "little"), f.get("file_type", 6).to_bytes(2, "little"), f.get("aux_type", 0).to_bytes(4, "little")
        h[32], h[38:42] = 2, len(data).to_bytes(4, "little")
        h[42:46], h[46:50] = pack_prodos_date(f.get("created")), pack_prodos_date(f.get("modified"))
        name = f["path"].encode("ascii")
        h[50:52] = len(name).to_bytes(2, "little")
        out += h + name + body
    return bytes(out)
