"""Changed containers as new ones: archives packed anew, files added, moved and renamed, images converted, copied and edited.

Every function takes a container's bytes and gives the new ones; nothing is changed in place, so an edit that fails leaves
what was there. `changed` applies one to a DataFrame of files, one container as one row of work.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame

from pomona.functions.nibbles import reorder
from pomona.sources import archives, disk, filesystems, more_filesystems

#: What can be set for the writing of an archive.
VALUES = {"packing": 3, "allow_duplicates": False, "junk_paths": False, "only_newer": False, "policy": "never", "keep_damaged": False, "separator": "/", "comment_room": 200, "when": None}


def values(**changes) -> dict:
    """VALUES with changes; unknown names and packings are refused."""
    if unknown := changes.keys() - VALUES.keys():
        raise ValueError(f"no such values: {sorted(unknown)}")
    out = VALUES | changes
    if out["packing"] not in archives.FORMATS or out["policy"] not in ("never", "always", "maybe", "must"):
        raise ValueError("a value that has no meaning")
    return out


# --- archives


def archive_paths(data: bytes) -> list[str]:
    """The paths of an archive's records, whose threads are left as they are."""
    return [r["path"] for r in archives.read_nufx(data)]


def archive_files(data: bytes, keep_damaged: bool = False, wanted: Callable[[str], bool] | None = None, packed: bool = False) -> list[dict]:
    """An archive's records as files that write_nufx takes, their threads expanded and checked.

    wanted: which paths, else all; other records' threads are not expanded. packed: the threads go along as they are, for
    write_nufx to keep those in the format it is asked for.
    """
    out = []
    for r in archives.read_nufx(data):
        if r["status"] != "ok" and not keep_damaged:
            raise ValueError(r["error"])
        if wanted and not wanted(r["path"]):
            continue
        f = dict(path=r["path"], fssep=r.get("fssep") or "/", file_type=r.get("file_type", 0), aux_type=r.get("aux_type", 0), access=r.get("access", 0xE3), created=r.get("created"), modified=r.get("modified"))
        for t in r["threads"]:
            part = archives.DATA_KINDS.get(t["kind"]) if t["thread_class"] == 2 else "comment" if (t["thread_class"], t["kind"]) == (0, 1) else None
            if part is None:
                continue
            try:
                body = archives.thread_bytes(t, r.get("storage", 0))
            except (ValueError, OSError):
                if not keep_damaged:
                    raise
                continue
            f[part] = body.rstrip(b"\0").decode("mac_roman") if part == "comment" else body
            if packed:
                f.setdefault("packed", {})[part] = t
        out.append(f)
    return out


def rewrapped(old: bytes, archive: bytes) -> bytes:
    """A new archive behind what stood before the old one; the length in a Binary II header is set anew."""
    at = archives.find_nufx(old)
    head = bytearray(old[:at])
    if head[:3] != archives.BINARY2 or at < 128:
        return bytes(head) + archive
    n = len(head) - 128 + len(archive)
    head[20:23], head[116], head[8:10] = n.to_bytes(4, "little")[:3], n >> 24 & 0xFF, (-(-n // 512) & 0xFFFF).to_bytes(2, "little")
    return bytes(head) + archive + bytes(-n % 128)


def wrapped(archive: bytes, name: str) -> bytes:
    """An archive as the only member of a Binary II file."""
    return archives.write_binary2([dict(path=name, data=archive, file_type=0xE0, aux_type=0x8002)])


def recompressed(data: bytes, packing: int = 3) -> bytes:
    """Every thread packed anew; contents, names and attributes stay."""
    return rewrapped(data, archives.write_nufx(archive_files(data), packing))


def laundered(data: bytes, packing: int | None = None) -> bytes:
    """A clean copy: records that can't be read go, threads that can are kept, unknown kinds are dropped, wrappers too."""
    files = [f for f in archive_files(data, keep_damaged=True) if any(f.get(k) is not None for k in ("data", "rsrc", "disk", "comment"))]
    return archives.write_nufx(files, 3 if packing is None else packing)


def thread_crcs(data: bytes) -> list[tuple[str, int, int]]:
    """(path, kind, CRC) of all data threads, from their contents."""
    out = []
    for r in archives.read_nufx(data):
        out += [(r["path"], t["kind"], archives.crc16(archives.thread_bytes(t, r.get("storage", 0)), 0xFFFF)) for t in r["threads"] if t["thread_class"] == 2]
    return out


def added(data: bytes | None, files: list[dict], options: dict | None = None) -> tuple[bytes, list[tuple[str, str]]]:
    """(archive, what became of each file): added, replaced, skipped or ask, by the policy for names that are there already.

    Names are the same without regard to case. Without an archive a new one is made.
    """
    o = options or values()
    have = archive_files(data, o["keep_damaged"], packed=True) if data is not None else []
    place = {f["path"].lower(): i for i, f in enumerate(have)}
    done = []
    for f in files:
        f = dict(f, path=f["path"].rsplit("/", 1)[-1] if o["junk_paths"] else f["path"].replace("/", o["separator"]), fssep=o["separator"])
        i = None if o["allow_duplicates"] else place.get(f["path"].lower())
        if i is None:
            if o["policy"] == "must":
                raise ValueError(f"nothing to overwrite: {f['path']}")
            place[f["path"].lower()] = len(have)
            have.append(f)
            done.append((f["path"], "added"))
            continue
        old, new = have[i].get("modified"), f.get("modified")
        if o["only_newer"] and not (old is not None and new is not None and old < new) or o["policy"] == "never":
            done.append((f["path"], "skipped"))
        elif o["policy"] == "maybe":
            done.append((f["path"], "ask"))
        else:
            have[i] = f
            done.append((f["path"], "replaced"))
    out = archives.write_nufx(have, o["packing"], o["when"])
    return (rewrapped(data, out) if data is not None else out), done


def without(data: bytes, paths: list[str]) -> bytes:
    doomed = {p.lower() for p in paths}
    rest = archive_files(data, wanted=lambda path: path.lower() not in doomed, packed=True)
    if not rest:
        raise ValueError("an archive must keep a record")
    return rewrapped(data, archives.write_nufx(rest))


def commented(data: bytes, path: str, comment: str | None) -> bytes:
    """One record's comment set, or dropped with None."""
    files = archive_files(data, packed=True)
    hit = [f for f in files if f["path"].lower() == path.lower()]
    if not hit:
        raise ValueError(f"no record {path}")
    hit[0].pop("comment", None)
    if comment is not None:
        hit[0]["comment"] = comment
    return rewrapped(data, archives.write_nufx(files))


def transferred(source: bytes, target: bytes | None, paths: list[str] | None = None, options: dict | None = None) -> tuple[bytes, list[tuple[str, str]]]:
    """Files of one archive, all or some, added to another."""
    wanted = None if paths is None else {p.lower() for p in paths}
    return added(target, archive_files(source, wanted=None if wanted is None else lambda path: path.lower() in wanted, packed=True), options)


class _Short(ValueError):
    pass


def stream_records(read: Callable[[int], bytes]) -> Iterator[dict]:
    """Records of an archive that can only be read forwards: `read(n)` gives the next bytes, fewer only at the end.

    Each record comes as read_nufx gives it, as soon as its last thread is there.
    """

    def need(n: int) -> bytes:
        got = bytearray()
        while len(got) < n:
            part = read(n - len(got))
            if not part:
                raise _Short("the archive ends early")
            got += part
        return bytes(got)

    head = need(6)
    for _ in range(archives.JUNK):
        if head[-6:] == archives.NUFILE:
            break
        head += need(1)
    else:
        raise ValueError("no NuFX archive")
    master = need(42)
    count = int.from_bytes(master[2:6], "little")
    if archives.crc16(master[2:]) != int.from_bytes(master[:2], "little"):
        raise ValueError("the master header's CRC is wrong")
    one = bytearray(archives.NUFILE + master)
    one[8:12] = (1).to_bytes(4, "little")
    one[6:8] = archives.crc16(bytes(one[8:])).to_bytes(2, "little")
    for ordinal in range(count):
        try:
            start = need(58)
            size, n = int.from_bytes(start[6:8], "little"), int.from_bytes(start[10:14], "little")
            if start[:4] != archives.NUFX or size < 58:
                raise _Short("no record where one must stand")
            rest = need(size - 58)
            rest += need(int.from_bytes((start + rest)[-2:], "little") + 16 * n)
            threads = rest[len(rest) - 16 * n :]
            payload = need(sum(struct.unpack_from("<I", threads, 16 * i + 12)[0] for i in range(n)))
        except _Short as e:
            yield dict(ordinal=ordinal, status="damaged", error=str(e), path="", threads=[])
            return
        (record,) = archives.read_nufx(bytes(one) + start + rest + payload)
        yield record | {"ordinal": ordinal}


# --- images


def converted_image(name: str, data: bytes, to: str, comment: str = "", volume: int = 254) -> bytes:
    """An image in another format: po, do, d13, 2mg, dc42, nib, app, ddd, hdv, shk, or po.gz and po.zip.

    Formats that keep no more than sectors lose what else the old one held; those that can't hold the disk are refused.
    """
    image, _ = disk.open_image(name, data)
    kind, _, outer = to.partition(".")
    body = image.data
    floppy = len(body) == 143360 and image.sectors == 16
    in_order = lambda order: replace(image, data=reorder(body, order, image.order), order=order) if image.order and image.order != order else image
    if kind in ("do", "nib", "app", "ddd") and not floppy:
        raise ValueError(f"{to} holds 140K disks alone")
    if kind == "po":
        out = in_order("prodos").data if floppy else body
    elif kind == "do":
        out = in_order("dos").data
    elif kind == "d13":
        if len(body) != 116480:
            raise ValueError("not a disk of 13 sectors")
        out = body
    elif kind == "2mg":
        out = disk.write_2mg(in_order("prodos") if floppy else image, comment)
    elif kind == "dc42":
        out = disk.write_dc42(in_order("prodos") if floppy else image, comment or "image")
    elif kind == "nib":
        out = disk.write_nibbles(image, volume)
    elif kind == "app":
        out = disk.write_trackstar(image, comment, volume)
    elif kind == "ddd":
        out = disk.write_ddd(image, volume)
    elif kind == "hdv":
        out = disk.write_hdv(in_order("prodos") if floppy else image)
    elif kind == "shk":
        out = archives.write_nufx([dict(path=name.rsplit("/", 1)[-1].rsplit(".", 1)[0], disk=in_order("prodos").data if floppy else body)], 3)
    else:
        raise ValueError(f"no format {to}")
    return disk.wrap(out, {"gz": "gzip", "zip": "zip", "": None}[outer], f"image.{kind}")


def archived_images(data: bytes) -> list[tuple[str, bytes]]:
    """(name, blocks) of the disk images in an archive."""
    return [(f["path"], f["disk"]) for f in archive_files(data, keep_damaged=True) if f.get("disk") is not None]


def copied_volume(source: bytes, target: bytes, start: int = 0) -> bytes:
    """The blocks of one volume written over another from a block on; a larger one than there is room for is refused."""
    at = start * 512
    if at + len(source) > len(target):
        raise ValueError("the volume doesn't fit")
    return target[:at] + source + target[at + len(source) :]


def zeroed(image: disk.Image) -> disk.Image:
    return replace(image, data=bytes(len(image.data)), bad=set())


def with_sector(image: disk.Image, track: int, number: int, data: bytes, fs_order: str = "dos") -> disk.Image:
    """A new image with one sector written."""
    if len(data) != 256 or not (0 <= track < image.tracks and 0 <= number < image.sectors):
        raise ValueError(f"no sector {track}/{number}, or not 256 bytes")
    at = disk.skew(number, fs_order, image.order) if image.sectors == 16 and image.order else number
    at = (track * image.sectors + at) * 256
    return replace(image, data=image.data[:at] + data + image.data[at + 256 :], bad=image.bad - {(track, number)})


def with_block(image: disk.Image, number: int, data: bytes, fs_order: str = "prodos") -> disk.Image:
    """A new image with one block written; on 16-sector tracks of another order, as two sectors."""
    if len(data) != 512 or not 0 <= number < image.blocks:
        raise ValueError(f"no block {number}, or not 512 bytes")
    if image.order in (None, fs_order):
        return replace(image, data=image.data[: number * 512] + data + image.data[number * 512 + 512 :])
    t, s = divmod(number, 8)
    return with_sector(with_sector(image, t, 2 * s, data[:256], fs_order), t, 2 * s + 1, data[256:], fs_order)


def edited(image: disk.Image, edits: list[tuple]) -> disk.Image:
    """Edits in order: ("block", number, offset, bytes), ("sector", track, number, offset, bytes) or ("track", number, bytes)."""
    for kind, *where, data in edits:
        if kind == "block":
            number, offset = where
            old = image.block(number)
            image = with_block(image, number, (old[:offset] + data + old[offset + len(data) :])[:512] if offset + len(data) <= 512 else b"")
        elif kind == "sector":
            track, number, offset = where
            old = image.sector(track, number)
            image = with_sector(image, track, number, (old[:offset] + data + old[offset + len(data) :])[:256] if offset + len(data) <= 256 else b"")
        elif kind == "track":
            (track,) = where
            if len(data) != 256 * image.sectors:
                raise ValueError("not a whole track")
            for s in range(image.sectors):
                image = with_sector(image, track, s, data[256 * s : 256 * s + 256])
        else:
            raise ValueError(f"no edit {kind}")
    return image


def edited_2mg(data: bytes, comment: str | None = None, creator: bytes | None = None, volume: int | None = None, locked: bool | None = None) -> bytes:
    """A 2IMG file with other properties; what isn't given stays. A negative volume drops the number."""
    head = list(disk._2MG.unpack_from(data))
    if head[0] != b"2IMG":
        raise ValueError("not a 2IMG file")
    offset, length = head[7], head[8] or len(data) - head[7]
    body, old = data[offset : offset + length], data[head[9] : head[9] + head[10]] if head[9] else b""
    extra = data[head[11] : head[11] + head[12]] if head[11] else b""
    text = old if comment is None else comment.encode("mac_roman", "replace")
    flags = head[5]
    if volume is not None:
        flags = (flags & ~0x1FF) | (0x100 | volume & 0xFF if volume >= 0 else 0)
    if locked is not None:
        flags = flags & 0x7FFFFFFF | (1 << 31 if locked else 0)
    head[1], head[5], head[7], head[8] = creator or head[1], flags, 64, len(body)
    at = 64 + len(body)
    head[9], head[10] = (at, len(text)) if text else (0, 0)
    head[11], head[12] = (at + len(text), len(extra)) if extra else (0, 0)
    return disk._2MG.pack(*head) + body + text + extra


#: Length of a track, and of the run that marks its start, in halves of a track that two disks hold.
SST_TRACK, SST_SYNC = 6656, 0x7F


def merged_sst(first: bytes, second: bytes) -> bytes:
    """Two disks that hold raw tracks in turns (DOS order), as one image of disk bytes.

    Odd tracks lie in sectors 15 to 4 and make a track's first 3072 bytes, even ones in 13 to 0; the longest run of 7F
    then is brought to the track's start, and all top bits are set.
    """
    out = bytearray(35 * SST_TRACK)
    for i, body in enumerate((first, second)):
        if len(body) != 143360:
            raise ValueError("not a 140K disk")
        image = disk.Image(body, "dos")
        for t in range(35):
            virtual = t + 35 * i
            numbers, at = (range(15, 3, -1), 0) if virtual & 1 else (range(13, -1, -1), 12 * 256)
            part = b"".join(image.sector(t, s) for s in numbers)
            at += virtual // 2 * SST_TRACK
            out[at : at + len(part)] = part
    for t in range(35):
        track = bytes(out[t * SST_TRACK : (t + 1) * SST_TRACK])
        runs, start = [], None
        for i, b in enumerate(track):
            if b == SST_SYNC:
                start = i if start is None else start
            elif start is not None:
                runs.append((i - start, -start))
                start = None
        turn = -max(runs)[1] if runs else 0
        out[t * SST_TRACK : (t + 1) * SST_TRACK] = bytes(b | 0x80 for b in track[turn:] + track[:turn])
    return bytes(out)


def created(kind: str, blocks: int = 280, name: str = "NEW.DISK", volume: int = 254) -> bytes:
    """A new disk: an empty ProDOS, Pascal or DOS volume, or blank."""
    if kind == "ProDOS":
        return filesystems.build_prodos(name, [], blocks)
    if kind == "Pascal":
        return filesystems.build_pascal(name[:7], [], blocks)
    if kind == "DOS":
        return filesystems.build_dos([], volume, blocks // 8)
    if kind == "blank":
        return bytes(blocks * 512)
    raise ValueError(f"{kind} is not written")


def volume_files(fs) -> list[dict]:
    """A volume's files as its builder takes them, folders too."""
    letters = {kind: letter for letter, kind in reversed(filesystems.DOS.TYPES.values())}  # the first letter of a type
    kinds = {v: k for k, v in reversed(filesystems.Pascal.KINDS.items())}
    out = []
    for e in fs.entries():
        if e["quality"] == "damaged":
            raise ValueError("a damaged volume is not written")
        f = dict(path=e["path"], data=e["data"], rsrc=e["rsrc"], file_type=e["file_type"], aux_type=e["aux_type"], access=e["access"], created=e["created"], modified=e["modified"], record_kind=e["record_kind"])
        if fs.name == "DOS":
            f |= dict(kind=letters.get(e["file_type"], "B"), locked=e["access"] == 0x21)
        elif fs.name == "Pascal":
            f["kind"] = kinds.get(e["file_type"], 5)
        out.append(f)
    return out


def rebuilt(image: disk.Image, change: Callable[[list[dict]], list[dict]], name: str | None = None) -> disk.Image:
    """An image with its volume built anew after a change to its files, as large as it was, maybe with another name.

    For DOS volumes the name is the volume's number. Boot blocks are kept. HFS volumes are written without folders and dates.
    """
    fs = filesystems.open_filesystem(image)
    if fs is None or fs.name not in ("ProDOS", "DOS", "Pascal", "HFS"):
        raise ValueError("no volume that is written")
    files = change(volume_files(fs))
    if fs.name == "HFS":
        if any(f.get("record_kind") == "directory" or ":" in f["path"] for f in files):
            raise ValueError("an HFS volume with folders is not written")
        data, order = more_filesystems.build_hfs(name or fs.volume, files, image.blocks), "prodos"
    elif fs.name == "ProDOS":
        data, order = filesystems.build_prodos(name or fs.volume, files, fs.total), "prodos"
    elif fs.name == "Pascal":
        data, order = filesystems.build_pascal(name or fs.volume, files, image.blocks), "prodos"
    else:
        if fs.image.sectors != 16:
            raise ValueError("no volume that is written")
        data, order = filesystems.build_dos(files, int(name) if name else fs.vtoc[6], image.tracks), "dos"
    if fs.name == "DOS":
        old = reorder(image.data, "dos", fs.image.order) if fs.image.order else image.data
        data = old[: 3 * 16 * 256] + data[3 * 16 * 256 :]
    else:
        old = reorder(image.data, "prodos", fs.image.order) if fs.image.order else image.data
        data = old[:1024] + data[1024:]
    data = data.ljust(len(image.data), b"\0")
    if fs.image.order and len(data) % 4096 == 0 and fs.image.order != order:
        data = reorder(data, fs.image.order, order)
    return replace(image, data=data, order=fs.image.order)


def with_directory(image: disk.Image, path: str) -> disk.Image:
    """A new folder on a ProDOS volume."""

    def change(files: list[dict]) -> list[dict]:
        if any(f["path"].lower() == path.lower() for f in files):
            raise ValueError(f"{path} exists")
        return [*files, dict(path=path, record_kind="directory")]

    return rebuilt(image, change)


def deleted(image: disk.Image, paths: list[str]) -> disk.Image:
    """A volume without some files; a folder goes with all it holds."""
    doomed = [p.lower() for p in paths]
    return rebuilt(image, lambda files: [f for f in files if not any(f["path"].lower() == d or f["path"].lower().startswith(d + "/") for d in doomed)])


def with_files(image: disk.Image, files: list[dict], overwrite: bool = False) -> disk.Image:
    """A volume with files added; names that are there already are refused or replaced."""

    def change(have: list[dict]) -> list[dict]:
        new = {f["path"].lower() for f in files}
        if not overwrite and (clash := [f["path"] for f in have if f["path"].lower() in new]):
            raise ValueError(f"{clash[0]} exists")
        return [f for f in have if f["path"].lower() not in new] + files

    return rebuilt(image, change)


def changed(files: DataFrame, change: Callable[[str, bytes], bytes], rename: Callable[[str], str] | None = None) -> DataFrame:
    """(path, content, status, error) of containers after a change of each; where it fails, the content stays as it was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    if content is None:
                        raise ValueError("no content")
                    rows.append((rename(path) if rename else path, change(path, bytes(content)), "changed", None))
                except (ValueError, OSError, IndexError, KeyError, struct.error) as e:
                    rows.append((path, None if content is None else bytes(content), "failed", str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "content", "status", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, status string, error string")
