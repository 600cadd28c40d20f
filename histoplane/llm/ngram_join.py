"""Near-duplicate join on word n-gram sets: every pair with Jaccard similarity of at least a threshold.

Prefix filtering in rare-first order. All n-grams get one global order, by approximate document
frequency (a count sketch over all documents, as large as the table asks for) and then by hash; any order
gives exact results, a rare-first one keeps the buckets small. Two sets that are similar enough share an n-gram
among the first ``n - ceil(t * n) + 1`` of each. The documents of one such n-gram form a bucket; of buckets
with the same members one stays, for the others hold the same pairs:

1. Star round: each bucket's members against the one that stands in most buckets, after length and positional filters;
   each distinct pair is verified once, on whole sets, with suffix filters ahead of the intersection.
2. Cross round: the links found so far give components. In buckets that still hold several components,
   each member outside its leader's component is paired with the members of every other component
   (length and positional filters again, and bits that bound how far the sets differ) and verified. Members of one component need no further pair,
   so a group of k near copies costs about k verifications rather than k * k, and no link that would
   join two components is missed. ``linked_pairs`` verifies these pairs too and returns every link.

Suffix filters: 1024 bits of a set, each toggled by the hashes that fall on it, bound the difference of two sets within the
join; bits that grow with the set (``parities``) bound it again ahead of verification, and the halves around a pivot a third time.

Texts with equal sets are one class from the start (``set_key``; 64-bit hashes throughout). Hot n-grams
are split by a salt, with a second star round over the salted leaders, and into blocks in the cross round. Nothing is
capped or sampled. Texts never enter a shuffle: n-grams are recomputed in three scans, prefix entries travel as
packed arrays, and only the sets of documents in some candidate pair are moved.

Nulls and blanks: a null, empty or all-blank text has an empty set, ``n_shingles`` 0, and links with
nothing. Rows that repeat an id stay separate rows and get their class each. A null id gets the class
of its text; ``component_id`` is null only where no member of the class has an id. Other columns of the
input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, drop_cut, partitions_for, read_table, release_shuffles, table_bytes, trim_memory
from .components import connected_components
from .shingles import set_key, shingles

#: Counters of the frequency sketch: one for each 16 bytes of the table, between these powers of two. Only the order depends on them.
SKETCH_BITS = (20, 24)
BLOCK_BITS = 16
#: Bits of the filter that tells which sets are wanted: 32 for each key, between these powers of two. It only spares work.
FILTER_BITS = (20, 28)
#: Prefix entries of a part and parts of a partition; members of a bucket from which it is split by a salt.
ENTRIES_PER_PART = 100_000
PARTS_PER_PARTITION = 8
HOT_BUCKET = 200_000
#: Members of a bucket that one block of the cross round holds.
CROSS_BLOCK = 2_000
#: Partners that are verified against one copy of a set.
PARTNERS_PER_GROUP = 1_000
#: Bits that bound a difference within the cross round, in words of 64; ``parities`` has as many at least.
WORDS = 16
#: Keys that a task remembers so as not to write one set's entries again and again.
REMEMBERED = 200_000
PROFILE = ["doc_id", "n", "key", "mark", "block", "counts"]
PROFILE_SCHEMA = "doc_id long, n long, key long, mark binary, block int, counts binary"
ENTRY = np.dtype([("key", "<i8"), ("pos", "<i4")])


def required_overlap(a, b, percent: int):
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-(percent * n) // 100) + 1


def parities(sh: np.ndarray) -> bytes:
    """Two to four bits for each hash of a set, 1024 at least, each toggled by the hashes that fall on it."""
    slots = max(64 * WORDS, 1 << (2 * len(sh)).bit_length())
    odd = np.bincount((sh & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def difference_bound(a: bytes, b: bytes) -> int:
    """No more than the number of hashes that only one of the two sets has."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def _remember(seen: set[int], key: int) -> bool:
    """Whether this task has just had the key; what it remembers is bounded."""
    if key in seen:
        return True
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(key)
    return False


def _passing(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (a, b, n, m) in enumerate(zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if n + m - difference_bound(a.as_py(), b.as_py()) >= 2 * required_overlap(n, m, percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (0, 1, 4, 5)], names=["u", "v", "n1", "n2"])

    return run


def _bounded(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` whose signatures allow the overlap, with the sizes of both sets: a suffix filter over the whole sets."""
    left = marks.select(F.col("key").alias("u"), F.col("mark").alias("a"), F.col("n").alias("n1"))
    right = marks.select(F.col("key").alias("v"), F.col("mark").alias("b"), F.col("n").alias("n2"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b", "n1", "n2").mapInArrow(_passing(percent), "u long, v long, n1 long, n2 long")


def _profile(k: int, bits: int):
    def run(batches):
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        mask = np.uint64(len(sketch) - 1)
        held: list[np.ndarray] = []
        size = 0

        def flush():
            if held:
                np.add.at(sketch, (np.concatenate(held) & mask).astype(np.int64), np.uint32(1))
                held.clear()

        for batch in batches:
            sizes, keys, marks = [], [], []
            for text in batch.column(1):
                sh = shingles(text.as_py(), k)
                sizes.append(len(sh))
                marks.append(parities(sh) if len(sh) else None)
                keys.append(set_key(sh) if len(sh) else None)
                held.append(sh)
                size += len(sh)
                if size > 500_000:
                    flush()
                    size = 0
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=PROFILE)
        flush()
        for i, block in enumerate(np.split(sketch, 1 << (bits - BLOCK_BITS))):
            if block.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())], names=PROFILE)
        del sketch
        trim_memory()

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 255 steps, each an eighth of a doubling, at least 1 where there is any: what the order needs, in a byte."""
    return np.minimum(np.round(8 * np.log2(counts.astype(np.float64) + 1)), 255).astype(np.uint8)


def _counts_of(levels: np.ndarray) -> np.ndarray:
    return np.exp2(levels.astype(np.float64) / 8) - 1


def _add_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            add = np.frombuffer(zlib.decompress(counts), dtype=np.uint32).astype(np.uint64)
            total[block] = total[block] + add if block in total else add
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([_levels(x).tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def _part_of(gram: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    x = (gram ^ (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _prefixes(sketch, k: int, percent: int, hot: int, parts: int):
    """Prefix entries, packed: for each part the n-grams, salts, keys and positions as arrays behind one another."""

    def packed(grams, salts, keys, places):
        gram, salt, key, pos = (np.concatenate(x) for x in (grams, salts, keys, places))
        part = _part_of(gram, salt, parts)
        order = np.argsort(part, kind="stable")
        part, gram, salt, key, pos = (x[order] for x in (part, gram, salt, key, pos))
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        # positions and salts are mostly small: their low halves, then their high ones, which compress to nothing
        bodies = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)]):
            small = np.stack([pos[a:b], salt[a:b]]).view(np.uint16).reshape(2, b - a, 2)
            bodies.append(gram[a:b].tobytes() + key[a:b].tobytes() + small.transpose(0, 2, 1).tobytes())
        for i in range(0, len(bodies), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(part[first[i : i + 1000]]), pa.array(bodies[i : i + 1000], pa.binary())], names=["part", "body"])

    def run(batches):
        levels = sketch.value
        mask = np.uint64(len(levels) - 1)
        seen: set[int] = set()
        grams, salts, keys, places, held = [], [], [], [], 0
        for batch in batches:
            for text in batch.column(0):
                sh = shingles(text.as_py(), k)
                n = len(sh)
                if not n:
                    continue
                key = set_key(sh)
                if _remember(seen, key):
                    continue
                p = prefix_length(n, percent)
                level = levels[sh & mask]
                first = np.lexsort((sh, level))[:p]
                salted = np.ceil(_counts_of(level[first]) / hot).astype(np.int64)
                grams.append(sh[first])
                salts.append(np.where(salted > 1, (key % np.maximum(salted, 1)) + 1, 0).astype(np.int32))
                keys.append(np.full(p, key, dtype=np.int64))
                places.append(np.arange(p, dtype=np.int32))
                held += p
                if held > 500_000:
                    yield from packed(grams, salts, keys, places)
                    grams, salts, keys, places, held = [], [], [], [], 0
        if grams:
            yield from packed(grams, salts, keys, places)
        del grams, salts, keys, places
        trim_memory()

    return run


def _unpacked(body: bytes):
    n = len(body) // 24
    small = np.frombuffer(body, dtype=np.uint16, offset=16 * n).reshape(2, 2, n).transpose(0, 2, 1)
    pos, salt = np.ascontiguousarray(small).view(np.int32).reshape(2, n)
    return np.frombuffer(body, dtype=np.uint64, count=n), np.frombuffer(body, dtype=np.int64, count=n, offset=8 * n), pos, salt


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _buckets(batches):
    """Packed entries, sorted by part -> buckets of n-grams with several keys: two hashes of the keys, the n-gram, its salt and the members."""

    def of(bodies):
        gram, key, pos, salt = (np.concatenate(x) for x in zip(*map(_unpacked, bodies)))
        order = np.lexsort((pos, key, salt, gram))
        gram, key, pos, salt = (x[order] for x in (gram, key, pos, salt))
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]) | (key[1:] != key[:-1])
        gram, key, pos, salt = (x[new] for x in (gram, key, pos, salt))
        start = np.ones(len(gram), dtype=bool)
        start[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(gram)))
        held = (size > 1) | (salt[first] > 0)
        if not held.any():
            return None
        u = key.view(np.uint64)
        marks = [np.add.reduceat(_mixed(u, seed), first) for seed in (1, 2)]
        # a salted bucket is a part of its n-gram's: it stays by itself
        marks = [np.where(salt[first] > 0, _mixed(gram[first] + salt[first].astype(np.uint64), 3 + i), m).view(np.int64)[held] for i, m in enumerate(marks)]
        members = np.empty(len(key), dtype=ENTRY)
        members["key"], members["pos"] = key, pos
        bodies = [members[a : a + n].tobytes() for a, n in zip(first[held].tolist(), size[held].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(marks[0]), pa.array(marks[1]), pa.array(gram[first][held].view(np.int64)), pa.array(salt[first][held]), pa.array(bodies, pa.binary())], names=["s1", "s2", "gram", "salt", "body"])

    now, bodies = None, []
    for batch in batches:
        for part, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            if part != now and bodies:
                if out := of(bodies):
                    yield out
                bodies = []
            now = part
            bodies.append(body.as_py())
    if bodies and (out := of(bodies)):
        yield out
    trim_memory()


def _members(batches):
    for batch in batches:
        bodies = [b.as_py() for b in batch.column(2)]
        size = np.array([len(b) // ENTRY.itemsize for b in bodies], dtype=np.int64)
        flat = np.frombuffer(b"".join(bodies), dtype=ENTRY)
        gram, salt = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), size) for i in (0, 1))
        for i in range(0, len(flat), 100_000):
            at = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(salt[at], pa.int32()), pa.array(flat["key"][at]), pa.array(flat["pos"][at])], names=["gram", "salt", "key", "pos"])


def _may_link(n1: str, p1: str, n2: str, p2: str, percent: int):
    """Length and positional filter as a condition."""
    a, i, b, j = (F.col(x).cast("long") for x in (n1, p1, n2, p2))
    length = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    # what stands before the shared n-gram can still overlap by the smaller of the two positions
    best = F.least(i, j) + 1 + F.least(a - i - 1, b - j - 1)
    return length & (best * (100 + percent) >= (a + b) * percent)


def _sets(wanted, k: int, again: bool):
    """The sets of wanted keys, each a few times in a task at most; ``part`` tells the tasks' copies apart."""

    def batch_of(keys, blobs, part):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(blobs, pa.binary())], names=["key", "part", "grams"])

    def run(batches):
        bits = wanted.value
        part = TaskContext.get().partitionId()
        part = -1 - part if again else part
        seen: set[int] = set()
        keys, blobs, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                sh = shingles(text.as_py(), k)
                if not len(sh):
                    continue
                key = set_key(sh)
                if not all(bits[at >> 3] >> (at & 7) & 1 for at in _slots(key, 8 * len(bits))) or key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                blobs.append(sh.tobytes())
                held += len(blobs[-1])
                if held > 8_000_000:
                    yield batch_of(keys, blobs, part)
                    keys, blobs, held = [], [], 0
        if keys:
            yield batch_of(keys, blobs, part)
        trim_memory()

    return run


def _slots(key: int, size: int) -> tuple[int, int]:
    return key & (size - 1), (key >> 32) & (size - 1)


def _filter_bits(size: int):
    """A filter's 64 KB blocks that hold any of the keys."""

    def run(batches):
        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            key = batch.column(0).to_numpy()
            bits[key & (size - 1)] = True
            bits[(key >> 32) & (size - 1)] = True
        for i, block in enumerate(np.split(np.packbits(bits, bitorder="little"), max(1, size >> 19))):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())], names=["block", "bits"])

    return run


def _or_bits(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            add = np.frombuffer(zlib.decompress(bits), dtype=np.uint8)
            total[block] = total[block] | add if block in total else add
    for block, bits in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])


def overlap_at_least(a: np.ndarray, b: np.ndarray, need: int) -> int | None:
    """Size of the intersection of two sorted sets, None if below ``need``; the halves around a pivot bound it first."""
    if min(len(a), len(b)) < need:
        return None
    pivot = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, pivot))
    if min(i, j) + min(len(a) - i, len(b) - j) < need:
        return None
    if len(b) < len(a):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    n = int(np.count_nonzero(b[at] == a))
    return n if n >= need else None


def _verify(percent: int):
    def run(batches):
        group = held = None
        for batch in batches:
            us, vs = [], []
            for u, lot, v, grams in zip(*(batch.column(i) for i in range(4))):
                if v.as_py() is None:
                    group, held = (u.as_py(), lot.as_py()), np.frombuffer(grams.as_py(), dtype=np.uint64)
                    continue
                assert group == (u.as_py(), lot.as_py())
                other = np.frombuffer(grams.as_py(), dtype=np.uint64)
                if overlap_at_least(held, other, required_overlap(len(held), len(other), percent)) is not None:
                    us.append(group[0])
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        trim_memory()

    return run


def _sets_of(keys: DataFrame, texts: DataFrame, k: int, again: bool) -> DataFrame:
    """``key, part, grams`` of every key of ``keys(key)`` and of a few more: a filter picks them in the scan."""
    size = 1 << min(max(FILTER_BITS[0], (32 * keys.count()).bit_length()), FILTER_BITS[1])
    blocks = keys.mapInArrow(_filter_bits(size), "block int, bits binary").repartition(max(1, size >> 19), "block").mapInArrow(_or_bits, "block int, bits binary")
    found = dict(blocks.collect())  # at most 512 blocks of 64 KB
    step = min(size, 1 << 19) // 8
    wanted = keys.sparkSession.sparkContext.broadcast(b"".join([bytes(found.get(i, bytes(step))) for i in range(max(1, size >> 19))]))
    return cut(texts.mapInArrow(_sets(wanted, k, again), "key long, part int, grams binary"), "op2-sets")


def _keys_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v, n1, n2)``, distinct, whose sets are similar enough. A set with many partners is sent once for each group of them."""
    moved = pairs.agg(F.sum(8 * (F.col("n1") + F.col("n2")))).first()[0] or 0
    home = sets.groupBy("key").agg(F.min("part").alias("home"))
    load = pairs.groupBy("u").agg(F.count("*").alias("partners"))
    pairs = pairs.join(load, "u").select("u", F.pmod(F.xxhash64("v"), F.ceil(F.col("partners") / PARTNERS_PER_GROUP)).cast("int").alias("lot"), "v")
    at_u = home.select(F.col("key").alias("u"), F.col("home").alias("u_part"))
    at_v = home.select(F.col("key").alias("v"), F.col("home").alias("v_part"))
    pairs = pairs.join(at_u, "u").join(at_v, "v")
    left = pairs.select("u", "u_part", "lot").distinct().join(sets, (F.col("u") == F.col("key")) & (F.col("u_part") == F.col("part"))).select("u", "lot", F.lit(None).cast("long").alias("v"), "grams")
    right = pairs.join(sets, (F.col("v") == F.col("key")) & (F.col("v_part") == F.col("part"))).select("u", "lot", "v", "grams")
    both = left.unionByName(right).repartition(partitions_for(pairs.sparkSession, moved), "u", "lot").sortWithinPartitions("u", "lot", F.col("v").asc_nulls_first())
    return both.mapInArrow(_verify(percent), "u long, v long")


class _Candidates(NamedTuple):
    profile: DataFrame  #: a row for each document: doc_id, n, key
    whole: DataFrame  #: what ``profile`` reads, to be deleted in the end
    members: DataFrame  #: gram, salt, key, pos, n, m: buckets with several keys, one of those with the same keys
    kept: DataFrame  #: what ``members`` reads
    marks: DataFrame  #: key, n, m, mark of the keys in some bucket


def _candidates(docs: DataFrame, id_col: str, texts: DataFrame, text_col: str, k: int, percent: int, hot: int) -> _Candidates:
    spark = docs.sparkSession
    bits = min(max(SKETCH_BITS[0], (table_bytes(docs) // 16).bit_length()), SKETCH_BITS[1])
    whole = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_profile(k, bits), PROFILE_SCHEMA), "op2-profile")
    rows = whole.where("block is null")

    entries = rows.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100) + 1"))).first()[0] or 0
    levels = np.zeros(1 << bits, dtype=np.uint8)
    blocks = whole.where("block is not null").select("block", "counts").repartition(min(1 << (bits - BLOCK_BITS), partitions_for(spark, 0)), "block")
    for block, counts in blocks.mapInArrow(_add_blocks, "block int, counts binary").collect():  # at most 256 blocks of 64 KB
        levels[block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.frombuffer(counts, dtype=np.uint8)
    sketch = spark.sparkContext.broadcast(levels)

    split = max(partitions_for(spark, 0), -(-entries // (ENTRIES_PER_PART * PARTS_PER_PARTITION)))
    packed = texts.mapInArrow(_prefixes(sketch, k, percent, hot, split * PARTS_PER_PARTITION), "part int, body binary")
    buckets = packed.repartition(split, "part").sortWithinPartitions("part").mapInArrow(_buckets, "s1 long, s2 long, gram long, salt int, body binary")
    one_of_each = buckets.groupBy("s1", "s2").agg(F.min(F.struct("gram", "salt", "body")).alias("b")).select("b.gram", "b.salt", "b.body")
    members = cut(one_of_each.mapInArrow(_members, "gram long, salt int, key long, pos int"), "op2-members")
    sketch.unpersist()
    release_shuffles(spark)

    load = members.groupBy("key").agg(F.count("*").alias("m"))
    sets = rows.where("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("mark").alias("mark"))
    marks = cut(sets.join(load, "key"), "op2-marks")
    return _Candidates(rows.select("doc_id", "n", "key"), whole, members.join(marks.select("key", "n", "m"), "key"), members, marks)


def _words(batches):
    """The first ``WORDS`` longs that the bits of each key fold to."""
    for batch in batches:
        words = np.array([_folded(np.frombuffer(m.as_py(), dtype=np.uint64), WORDS) for m in batch.column(1)], dtype=np.uint64).reshape(batch.num_rows, WORDS).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(w) for w in np.ascontiguousarray(words.T)]], names=["key", *[f"b{i}" for i in range(WORDS)]])


def _with_words(members: DataFrame, marks: DataFrame) -> DataFrame:
    words = marks.select("key", "mark").mapInArrow(_words, "key long, " + ", ".join(f"b{i} long" for i in range(WORDS)))
    return members.join(words, "key")


def _alike(percent: int):
    """That the bits of columns b0.. and b0_2.. allow the overlap of sets of sizes n and n_2."""
    differ = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"b{i}_2"))) for i in range(1, WORDS)), F.bit_count(F.col("b0").bitwiseXOR(F.col("b0_2"))))
    both = F.col("n").cast("long") + F.col("n_2")
    return (both - differ) * (100 + percent) >= both * (2 * percent)


def _other(members: DataFrame) -> DataFrame:
    return members.select(*[F.col(c).alias(f"{c}_2") for c in members.columns])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, hot: int = HOT_BUCKET, with_component: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, class_key, component_id``, and on demand ``component``, a class key of the component; see the module's text."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    rows, _, members, kept, marks = _candidates(docs, id_col, texts, text_col, k, percent, hot)
    # the member that stands in most buckets leads: in a group of near copies that is the one nearest to all
    lead = members.groupBy("gram", "salt").agg(F.max(F.struct("m", "key", "n", "pos")).alias("t"))
    lead = lead.select("gram", "salt", F.col("t.key").alias("lkey"), F.col("t.n").alias("ln"), F.col("t.pos").alias("lpos"), F.col("t.m").alias("lm"))
    buckets = cut(members.drop("m").join(lead, ["gram", "salt"]), "op2-buckets")

    near = _may_link("n", "pos", "ln", "lpos", percent)
    star = buckets.where("key <> lkey").where(near).select(F.least("key", "lkey").alias("u"), F.greatest("key", "lkey").alias("v"))
    leaders = buckets.where("salt > 0").select("gram", "lkey", "ln", "lpos", "lm").distinct()
    top = leaders.groupBy("gram").agg(F.max(F.struct("lm", "lkey", "ln", "lpos")).alias("t")).select("gram", F.col("t.lkey").alias("key"), F.col("t.ln").alias("n"), F.col("t.lpos").alias("pos"))
    second = leaders.join(top, "gram").where("key <> lkey").where(near).select(F.least("key", "lkey").alias("u"), F.greatest("key", "lkey").alias("v"))
    pairs = cut(star.unionByName(second).distinct(), "op2-pairs")

    likely = cut(_bounded(pairs, marks, percent), "op2-likely")
    sets = _sets_of(_keys_of(likely), texts, k, False)
    links = cut(_verified(likely, sets, percent), "op2-links")
    release_shuffles(spark)
    comp = connected_components(links)

    at = comp.withColumnRenamed("node", "key")
    named = buckets.join(at, "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    lead = at.select(F.col("key").alias("lkey"), F.col("component").alias("lc"))
    named = cut(named.join(lead, "lkey", "left").withColumn("lcomp", F.coalesce("lc", "lkey")).drop("lc", "lkey", "ln", "lpos", "lm"), "op2-named")
    away = named.where("comp <> lcomp").unionByName(_salted_away(named)).distinct()
    # only n-grams that hold several components, in blocks
    blocks = named.groupBy("gram").agg(F.ceil(F.count("*") / CROSS_BLOCK).cast("int").alias("blocks")).join(away.select("gram").distinct(), "gram", "left_semi")
    cols = ["gram", "key", "n", "pos", "comp"]
    there = _with_words(named.join(blocks, "gram").select(*cols, F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")), marks)
    away = _with_words(away.join(blocks, "gram").select(*cols, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), marks)
    cross = away.join(_other(there), (F.col("gram") == F.col("gram_2")) & (F.col("block") == F.col("block_2")) & (F.col("comp") != F.col("comp_2")) & _alike(percent) & _may_link("n", "pos", "n_2", "pos_2", percent))
    cross = cross.select(F.least("key", "key_2").alias("u"), F.greatest("key", "key_2").alias("v")).distinct()
    cross = cut(cross.join(pairs, ["u", "v"], "left_anti"), "op2-cross")
    likely2 = cut(_bounded(cross, marks, percent), "op2-likely")
    release_shuffles(spark)
    done = [kept, buckets, pairs, likely, links, named, cross, likely2, sets, marks]
    if likely2.take(1):
        missing = _keys_of(likely2).join(sets.select("key").distinct(), "key", "left_anti")
        more_sets = _sets_of(missing, texts, k, True)
        more = cut(_verified(likely2, sets.unionByName(more_sets), percent), "op2-links")
        done += [more_sets, more]
        release_shuffles(spark)
        if more.take(1):
            drop_cut(comp)
            comp = connected_components(links.unionByName(more))

    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id")).join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    extra = ["component"] if with_component else []
    named_classes = cut(classes.join(least, "component").select("key", "component_id", *extra), "op2-classes")
    for old in (*done, comp):
        drop_cut(old)
    release_shuffles(spark)
    with_class = rows.join(named_classes, "key", "left")
    return with_class.select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *extra)


def _salted_away(named: DataFrame) -> DataFrame:
    """Members of salted buckets of n-grams whose buckets' leaders lie in several components."""
    split = named.where("salt > 0").groupBy("gram").agg(F.min("lcomp").alias("a"), F.max("lcomp").alias("b")).where("a <> b")
    return named.where("salt > 0").join(split, "gram").where("comp <> a").select(named.columns)


def linked_pairs(docs: DataFrame, text_col: str = "text", k: int = 5, percent: int = 75, hot: int = HOT_BUCKET) -> DataFrame:
    """``u, v``, u < v: the class keys (``class_key`` of ``near_duplicates``) of every two different sets that are similar enough, once each.

    Every pair of a bucket that passes the filters is verified, so a group of k near copies costs up to k * (k - 1) / 2
    verifications, as many as it can have links. Rows of one class are links to each other and have no row here.
    """
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    _, whole, members, kept, marks = _candidates(docs.select(F.lit(None).cast("long").alias("__id"), text_col), "__id", texts, text_col, k, percent, hot)
    members = _with_words(members.drop("m", "salt"), marks)  # the salts of one n-gram are joined too
    pairs = members.join(_other(members), (F.col("gram") == F.col("gram_2")) & (F.col("key") < F.col("key_2")) & _alike(percent) & _may_link("n", "pos", "n_2", "pos_2", percent))
    pairs = cut(pairs.select(F.col("key").alias("u"), F.col("key_2").alias("v")).distinct(), "op2-pairs")
    likely = cut(_bounded(pairs, marks, percent), "op2-likely")
    sets = _sets_of(_keys_of(likely), texts, k, False)
    links = cut(_verified(likely, sets, percent), "op2-links")
    for old in (whole, kept, marks, pairs, likely, sets):
        drop_cut(old)
    return links


def _class_keys(k: int):
    """Adds the class key of the text in the last column, in its place."""

    def run(batches):
        for batch in batches:
            sets = [shingles(text.as_py(), k) for text in batch.columns[-1]]
            keys = pa.array([set_key(sh) if len(sh) else None for sh in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], keys], names=[*batch.schema.names[:-1], "__class"])

    return run


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """The documents whose id is the smallest of their component, with their own columns; blank texts all stay.

    Rows that repeat an id are decided each by its own text: of those that share the component one class stays, and of its
    rows that with the smallest text; equal blank texts of one id are one. Rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, k, with_component=True).where("doc_id is not null")
    found = cut(found.select("doc_id", "class_key", "component", (F.col("component_id") < F.col("doc_id")).alias("gone")), "op2-found")
    repeated = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col))
    gone = found.where("gone").select(F.col("doc_id").alias(id_col)).distinct()
    if not repeated.take(1):
        return docs.join(gone, id_col, "left_anti").select(docs.columns)
    once = docs.join(gone.unionByName(repeated), id_col, "left_anti").select(docs.columns)

    stays = found.where("not gone").join(repeated.withColumnRenamed(id_col, "doc_id"), "doc_id", "left_semi").groupBy("doc_id", "component").agg(F.min("class_key").alias("class_key"))
    stays = stays.select(F.col("doc_id").alias("__id"), F.col("class_key").alias("__stays"))
    again = docs.join(repeated, id_col, "left_semi").select(*docs.columns, F.col(text_col).cast("binary").alias("__text"))
    again = again.mapInArrow(_class_keys(k), StructType([*docs.schema.fields, StructField("__class", LongType())]))
    again = again.join(stays, (F.col(id_col) == F.col("__id")) & F.col("__class").eqNullSafe(F.col("__stays"))).select(*docs.columns, "__class")
    again = again.dropDuplicates([id_col, "__class", text_col])
    smallest = Window.partitionBy(id_col, "__class").orderBy(text_col)
    again = again.withColumn("__n", F.row_number().over(smallest)).where("__n = 1 or __class is null").select(docs.columns)
    return once.unionByName(again)


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.v FROM r JOIN l ON l.u = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
