"""Near-duplicate groups by SuperMinHash, banding, verification on full sets, and union-find.

1. Each text becomes its set of hashed five-word shingles and a SuperMinHash signature: per element a
   random permutation's ranks, whose j-th draw only counts for its bin if nothing smaller is there, and
   which stops for a text as soon as every bin holds a smaller rank than any later draw can have.
2. Texts with equal sets are one class (their similarity is 1); from here on only one representative
   per class takes part.
3. Bands of some values each (see `banding`) are hashed into buckets. In a bucket every member is compared with the
   smallest id, its hub, alone (linear, whatever the bucket's size), on full sets. Verified links are merged.
4. Buckets whose members still belong to several groups are finished exactly: small ones by their pairs across
   groups, large ones in pairs of bounded blocks. A bucket's largest group is never compared with itself,
   so a large group of copies costs its members once for each block of the rest; a local union-find skips
   what is already linked, and only links that merge two groups leave the task.
5. All links together are merged by star contraction, a distributed union-find.

At similarity 0.85 a pair misses all 32 bands of 8 with probability 4e-5, at 0.9 with 2e-8; at 0.8, where a
caller asks for that, it misses all 42 bands of 6 with 3e-6.
Nothing that grows with the documents goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pomona.llm.common import GOLDEN, by_ids, hash_bytes, mix, shared_checkpoint, text_slices, words

SHINGLE, PERCENT = 5, 85
#: Values of a signature at most, and how often a pair at the threshold itself may share no band.
VALUES, MISS = 256, 1e-4
#: Buckets up to SMALL members are finished by pairs; larger ones in blocks of about BLOCK members.
SMALL, BLOCK = 8, 256
#: Pairs with one hub that meet its set in one task.
HUB_PAIRS = 512
#: A class of equal sets is large from this share of all rows on, and a bucket hot from this share of all members on, so
#: there are at most so many; what belongs to them is joined by broadcast, as a shuffle would bring each to one task.
LARGE_CLASSES, HOT_BUCKETS, HOT_MEMBERS = 10_000, 100_000, 512
#: Elements whose permutations are held at once.
LANES = 150_000
_P = np.uint64(0x9E3779B97F4A7C55)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct hashed shingles, one after another, and how many each has."""
    offsets, ids, distinct = words(texts)
    h = hash_bytes(distinct)[ids]
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    padded = np.r_[h, np.zeros(size, np.uint64)]
    for j in range(size):
        rolled = rolled * _P + padded[j : j + n]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        k = b - a
        if k >= size:
            s = np.sort(rolled[a : b - size + 1])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        elif k:  # fewer words than a shingle has: the whole sequence, told apart by its length
            x = np.uint64(k)
            for w in h[a:b]:
                x = mix(np.array([x]) * _P + w)[0]
            s = np.array([x], np.uint64)
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def banding(percent: int) -> tuple[int, int]:
    """Bands and the values of each for pairs from `percent` on: the longest bands that miss few enough at it."""
    for rows in range(VALUES, 1, -1):
        bands = VALUES // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return bands, rows
    return VALUES, 1


def superminhash(elements: np.ndarray, sizes: np.ndarray, m: int = VALUES) -> np.ndarray:
    """Signatures (texts, m) of sets laid one after another; a value is rank << 48 | 48 random bits."""
    if m > VALUES:
        raise ValueError(f"at most {VALUES} values")
    out = np.full((len(sizes), m), np.iinfo(np.uint64).max, np.uint64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LANES, "right")))
        a, b = int(ends[first] - sizes[first]), int(ends[last - 1])
        _sign(elements[a:b], np.repeat(np.arange(last - first), sizes[first:last]), out[first:last], m)
        first = last
    return out


def _sign(x: np.ndarray, owner: np.ndarray, sig: np.ndarray, m: int) -> None:
    flat, perm = sig.reshape(-1), None
    for j in range(m):
        if not len(x):
            return
        u = mix(x + np.uint64((j + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((u & np.uint64(0xFFFF)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        if j == 0:
            bins, first = k, k
        else:
            if perm is None:  # Fisher-Yates state, only for texts that need a second draw
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
                rows = np.arange(len(x))
                perm[rows, 0], perm[rows, first] = first, 0
            rows = np.arange(len(x))
            bins = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = bins
        np.minimum.at(flat, owner * m + bins, np.uint64(j) << np.uint64(48) | u >> np.uint64(16))
        # early stop: no later draw can be below (j + 1) << 48
        open_texts = sig.max(1) >= np.uint64(j + 1) << np.uint64(48)
        keep = open_texts[owner]
        if not keep.all():
            x, owner = x[keep], owner[keep]
            if perm is None:
                first = first[keep]
            else:
                perm = perm[keep]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, (texts, bands)."""
    v = sig.reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
    for r in range(rows):
        key = mix(key * _P + v[:, :, r])
    return key


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, raw) -> id, n, h1, h2 (128 bits of the set), bands."""
    n_bands, n_rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "raw"):
            elements, sizes = shingle_sets(b.column("raw"))
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sizes), n_bands), np.uint64)
            sums = np.zeros((2, len(sizes)), np.uint64)
            if len(full):
                starts = (np.cumsum(sizes) - sizes)[full]
                keys[full] = band_keys(superminhash(elements, sizes[full], n_bands * n_rows), n_bands, n_rows)
                for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    sums[i, full] = np.add.reduceat(mix(elements ^ np.uint64(salt)), starts)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * n_bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), bands], names=["id", "n", "h1", "h2", "bands"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, h1 long, h2 long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, raw) -> id, h1, sh: the whole set, and the class it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "raw"):
            elements, sizes = shingle_sets(b.column("raw"))
            ends, h1 = np.r_[0, np.cumsum(sizes)], np.zeros(len(sizes), np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                h1[full] = np.add.reduceat(mix(elements ^ np.uint64(0x5851F42D4C957F2D)), ends[:-1][full])
            sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(h1.view(np.int64)), sets], names=["id", "h1", "sh"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, h1 long, sh array<long>")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): each linked node and the smallest id of its component, by star contraction."""
    e = shared_checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        # large star: every node's larger neighbours, and it, point to the least of its neighbourhood
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # small star: every node's smaller neighbours, and it, point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", "low")).where("u <> v").distinct()
        e = shared_checkpoint(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. `parts`: tasks among which pairs with the same b are dealt."""
    s = sets.select("id", "sh")
    hubs = pairs.groupBy("b").agg(F.max("parts").alias("parts")).select(F.col("b").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = s.join(hubs, "id").select(F.col("id").alias("b"), "part", F.col("sh").alias("sb"))
    left = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts").join(s.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a")
    out = left.join(right, ["b", "part"])
    near = F.size("sa") * 100 >= F.size("sb") * percent
    near &= F.size("sb") * 100 >= F.size("sa") * percent
    common = F.size(F.array_intersect("sa", "sb"))
    return out.where(near).where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def _stars(members: DataFrame) -> DataFrame:
    """(rep, hub, size) -> different pairs (a, b) of members and hubs, with `parts` for _verified."""
    parts = F.ceil(F.col("size") / HUB_PAIRS).cast("int")
    return members.where("rep <> hub").groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).agg(F.max(parts).alias("parts"))


def _by_bucket(members: DataFrame, table: DataFrame, hot: int) -> DataFrame:
    """Members (bucket, size, ...) joined with a table of one row a bucket that has its size too.

    Buckets from `hot` members on are few enough to be broadcast.
    """
    cold = members.where(F.col("size") < hot).join(table.where(F.col("size") < hot).drop("size"), "bucket")
    return cold.unionByName(members.where(F.col("size") >= hot).join(F.broadcast(table.where(F.col("size") >= hot).drop("size")), "bucket"))


def _members(rows: DataFrame, hot: int) -> DataFrame:
    """rows (rep, bucket) -> those of buckets with several members, with the bucket's hub (its smallest member) and size."""
    full = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    large = full.where(F.col("size") >= hot)
    in_large = rows.join(F.broadcast(large), "bucket")
    rest = rows.join(F.broadcast(large.select("bucket")), "bucket", "left_anti").join(full.where(F.col("size") < hot), "bucket")
    return shared_checkpoint(rest.unionByName(in_large))


def _apart(members: DataFrame, comps: DataFrame, hot: int) -> DataFrame:
    """Members (bucket, rep, size) of the buckets that still hold several groups, with their group `comp`."""
    m = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    several = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("size").alias("size")).where("lo <> hi").select("bucket", "size")
    return shared_checkpoint(_by_bucket(m, several, hot).select("bucket", "rep", "size", "comp"))


def _common_sizes(sa: list[np.ndarray], sb: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of incidence matrices in slices of columns."""
    values, codes = np.unique(np.concatenate([*sa, *sb]), return_inverse=True)
    rows = np.repeat(np.arange(len(sa) + len(sb)), [len(s) for s in [*sa, *sb]])
    seen = np.bincount(codes, minlength=len(values)) > 1  # what only one set has can't be common
    place = np.cumsum(seen) - 1
    rows, codes = rows[seen[codes]], place[codes[seen[codes]]]
    out = np.zeros((len(sa), len(sb)), np.int64)
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    for c in range(0, int(seen.sum()), 4096):
        lo, hi = np.searchsorted(codes, [c, c + 4096])
        m = np.zeros((len(sa) + len(sb), 4096), np.float32)
        m[rows[lo:hi], codes[lo:hi] - c] = 1
        out += (m[: len(sa)] @ m[len(sa) :].T).astype(np.int64)
    return out


def block_links(ids: list, comps: list, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links between two blocks (or within one) that merge groups not merged before."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = np.flatnonzero(blocks == blocks.min())
    right = left if blocks.min() == blocks.max() else np.flatnonzero(blocks != blocks.min())
    common = _common_sizes([sets[i] for i in left], [sets[i] for i in right])
    sizes = np.array([len(s) for s in sets], np.int64)
    near = common * 100 >= (sizes[left][:, None] + sizes[right] - common) * percent
    out = []
    for i, j in zip(*np.nonzero(near)):
        a, b = int(left[i]), int(right[j])
        x, y = find(comps[a]), find(comps[b])
        if x != y:
            parent[x] = y
            out.append((ids[a], ids[b]))
    return out


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links), kept.

    percent: two texts are linked from this Jaccard similarity of their shingles on, in hundredths.
    Defined cases: null text or text without words has no set (n_shingles 0) and is linked with nothing;
    rows with a null key are linked with nothing and have a null component_id, and are kept; rows that
    share a key are one document, linked with what any of its texts is; repeated rows stay rows; an
    empty table gives an empty result; other columns are ignored. Keys may be of any orderable type.
    """
    docs = df.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"))
    base = shared_checkpoint(signatures(docs, percent))
    some = base.where("n > 0 and id is not null")
    reps = some.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "bands")).alias("x"), F.count(F.lit(1)).alias("c")).select("h1", "h2", "n", "c", F.col("x.id").alias("rep"), F.col("x.bands").alias("bands"))
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    n_rows = some.count()
    hot = max(HOT_MEMBERS, n_rows * banding(percent)[0] // HOT_BUCKETS)
    members = _members(rows, hot)
    stars = shared_checkpoint(_stars(members))
    ids = members.select(F.col("rep").alias("id"))
    sets = shared_checkpoint(full_sets(by_ids(docs, ids, "left_semi")))
    links = shared_checkpoint(_verified(stars, sets, percent))
    m = _apart(members.select("bucket", "rep", "size"), components(links), hot)
    small = m.where(F.col("size") <= SMALL).select("bucket", "rep", "comp")
    pairs = small.join(small.select("bucket", F.col("rep").alias("b"), F.col("comp").alias("comp_b")), "bucket").where("rep > b and comp <> comp_b")
    pairs = pairs.select(F.col("rep").alias("a"), "b").distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti").withColumn("parts", F.lit(1))
    more = _verified(pairs, sets, percent).union(_large_links(m.where(F.col("size") > SMALL), sets, percent, hot))
    final = components(links.union(more))
    # back to classes, then to rows
    classes = reps.select("h1", "h2", "n", "c", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", "c", F.coalesce("comp", "rep").alias("component_id"))
    # large classes of equal sets are few, as each holds a share of all rows, so their rows need no shuffle to one key
    same, rows_of_class = ["h1", "h2", "n"], max(1000, n_rows // LARGE_CLASSES)
    large = classes.where(F.col("c") >= rows_of_class).select(*same, F.col("component_id").alias("large_id"))
    some = some.join(F.broadcast(shared_checkpoint(large)), same, "left")
    named = some.where("large_id is null").join(classes, same).select("id", "n", "component_id").union(some.where("large_id is not null").select("id", "n", "large_id")).union(base.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")))
    return named.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _large_links(m: DataFrame, sets: DataFrame, percent: int, hot: int) -> DataFrame:
    """Links inside large buckets, each pair of blocks in a task of its own; a bucket's largest group is not paired with itself."""
    kind = dict(m.dtypes)["rep"]
    groups = m.groupBy("bucket", "comp", "size").count().groupBy("bucket", "size").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("n"))
    blocks = lambda c: F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int")
    groups = groups.select("bucket", "size", F.col("top.comp").alias("top"), blocks(F.col("top.count")).alias("top_blocks"), blocks(F.col("n") - F.col("top.count")).alias("rest_blocks"))
    m = _by_bucket(m, groups, hot).withColumn("in_top", F.col("comp") == F.col("top"))
    # blocks 0 .. rest_blocks - 1 hold the rest, those from rest_blocks on the largest group
    block = F.when(F.col("in_top"), F.col("rest_blocks") + F.pmod(F.xxhash64("rep", "bucket"), F.col("top_blocks"))).otherwise(F.pmod(F.xxhash64("rep", "bucket"), F.col("rest_blocks"))).cast("int")
    others = F.when(F.col("in_top"), F.sequence(F.lit(0), F.col("rest_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest_blocks") + F.col("top_blocks") - 1))
    m = m.withColumn("block", block)
    to = F.transform(others, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    m = m.select("bucket", "rep", "comp", "block", F.explode(to).alias("to")).join(sets.select(F.col("id").alias("rep"), "sh"), "rep").select("bucket", "to.i", "to.j", "rep", "comp", "block", "sh")

    def run(t: pa.Table) -> pa.Table:
        sets_of = t.column("sh").combine_chunks()
        flat, at = sets_of.flatten().to_numpy(), sets_of.offsets.to_numpy()
        at = at - at[0]
        found = block_links(t.column("rep").to_pylist(), t.column("comp").to_pylist(), t.column("block").to_numpy(), [flat[a:b] for a, b in zip(at[:-1], at[1:])], percent)
        return pa.table({"a": pa.array([x for x, _ in found], t.column("rep").type), "b": pa.array([y for _, y in found], t.column("rep").type)})

    return m.groupBy("bucket", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")
