"""N-gram Jaccard self-join with multiple-global-order filtering, down to connected components.

Two texts link when the Jaccard similarity of their sets of distinct five-word shingles is at
least 0.8. A set of n shingles that links must share one of its first n - ceil(0.8 n) + 1
shingles with its partner, under any order of all shingles that both sides use. The steps:

1. One pass gives each text its set size, a key (a 64-bit hash of the set, so that equal sets are
   one node from here on), its prefixes under the second and third order, an odd sketch of the
   set, and mergeable counts of frequent shingles.
2. First order: frequent shingles last, then by hash. These prefixes are shuffled by shingle; a
   shingle with several sets of sizes that may link makes one star: each set against the hub, the set that
   consists most of frequent shingles.
3. A lower bound of the difference from the odd sketches rules out most candidates of the first order and
   the size bound. The filters of all orders are intersected: a candidate must share a prefix shingle under
   the second and under the third order too. No set has been fetched up to here.
4. Verification: the exact intersection of the sets, which are taken up again for the surviving pairs only.
5. Verified links give components. A second round takes the pairs of different components under
   one shingle, so no link between components is missed; they pass the same filters and the same
   verification. A shingle of two sets has made its only pair in the first round. With A and B elements between two sets and their hub, the two sets differ in at
   least |A - B| elements, and in at least as many as the bits in which their folded odd sketches
   differ; pairs that this rules out are never made, and groups that are already one component
   make no pairs at all. A large group is dealt out in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import scratch_tables, small_batches, written
from folioscope.llm.components import components
from folioscope.llm.words import LOWER, SPACED, Words, blocks, grams, mix

SHINGLE, PERCENT = 5, 80
#: Frequent shingles kept (at most): 9 bytes each are broadcast.
FREQUENT = 1 << 20
#: A shingle counted more often is dealt over as many tasks as its count holds this number. One that
#: no task has seen twice is not counted; it has one row of each task at most.
VERY_FREQUENT = 2048
#: Sets of one group that meet in one block of the second round: outside its largest component, and all.
X_BLOCK, Y_BLOCK = 4096, 1024
#: Prefix rows that a task packs together, and rows of one part of the shingles on average.
CHUNK_ROWS, PART_ROWS = 1 << 20, 1 << 18
#: Pairs of one hub that meet in one block, to which the hub's set is sent once.
PAIR_BLOCK = 4096
#: Bits of the filter that spares texts without a candidate the third pass; it only saves work.
FILTER_BITS = 1 << 26
#: Longs of a folded sketch in the second round (2,048 bits); it only saves pairs.
FOLDED = 32
#: Odd multipliers that define the second and third order.
ORDERS = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))
_FORTY = np.uint64((1 << 40) - 1)
#: In place of a salt: only two sets have the shingle.
TWO_SETS = -1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block.

    A text of 1 to 4 words has one shingle, its whole sequence; without words it has none.
    """
    data = LOWER[data]
    w = Words(data, offsets, SPACED)
    h, first = w.hashes(data), w.first.tolist()
    g = grams(h, SHINGLE)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(g[a : b - SHINGLE + 1])
        elif b > a:
            yield grams(h[a:b], b - a)[:1] ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def set_key(t: np.ndarray) -> int:
    """A 64-bit hash of a set: equal sets have equal keys."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(t ^ ORDERS[0]).sum(dtype=np.uint64) + np.uint64(len(t))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def odd_sketch(t: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of elements fall on i; about one bit for each element."""
    bits = 64
    while bits < len(t):
        bits *= 2
    return np.packbits(np.bincount((t & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of elements in one set only. The longer sketch is folded onto the shorter."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def may_link(differ: int, na: int, nb: int) -> bool:
    """100 x shared >= 80 x union, in terms of the number of elements in one set only."""
    return (200 - PERCENT * 2) * (na + nb) >= (200 + PERCENT * 2) * differ


def order_bits(n: int) -> int:
    """Bits that a prefix value of a set of ``n`` keeps: so many that prefixes without a common shingle seldom meet."""
    return min(48, 14 + prefix_length(n).bit_length())


def order_prefix(t: np.ndarray, factor: np.uint64) -> bytes:
    """The prefix of a set under one of the hash orders: the upper bits of its smallest values, as steps of 16 bits.

    Equal shingles have equal values, so sets that share a prefix shingle share one of these. A step of
    65,535 or more is written as 65,535 and what remains.
    """
    p = prefix_length(len(t))
    x = np.sort(np.partition(t * factor, p - 1)[:p]) >> np.uint64(64 - order_bits(len(t)))
    steps = np.diff(x.astype(np.int64), prepend=0)
    long = steps // 65535
    out = np.full(int(long.sum()) + p, 65535, np.uint16)
    out[np.arange(p) + np.cumsum(long)] = steps % 65535
    return out.tobytes()


def prefix_values(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def prefixes_meet(a: bytes, na: int, b: bytes, nb: int) -> bool:
    """Whether two prefixes share a value, at the bits that both have."""
    bits = min(order_bits(na), order_bits(nb))
    x, y = prefix_values(a) >> (order_bits(na) - bits), prefix_values(b) >> (order_bits(nb) - bits)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return bool((y[at] == x).any())


def shared_elements(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


class Frequent:
    """Counts of frequent shingles by Misra-Gries: at most ``most`` counters, and a shingle that
    makes up more than 1 / most of all is always among them."""

    def __init__(self, most: int = FREQUENT):
        self.most, self.pending, self.size = most, [], 0
        self.token, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, t: np.ndarray) -> None:
        self.pending.append(t)
        self.size += len(t)
        if self.size > 2 * self.most:
            self.settle()

    def settle(self) -> None:
        token, count = np.unique(np.concatenate([*self.pending, np.zeros(0, np.uint64)]), return_counts=True)
        both = np.concatenate([self.token, token])
        self.token, at = np.unique(both, return_inverse=True)
        self.count = np.bincount(at, np.concatenate([self.count, count]), len(self.token)).astype(np.int64)
        if len(self.token) > self.most:
            self.count -= np.partition(self.count, -self.most - 1)[-self.most - 1]
            self.token, self.count = self.token[self.count > 0], self.count[self.count > 0]
        self.pending, self.size = [], 0


_PROFILE = pa.schema(
    [
        ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("sketch", pa.binary()), ("second", pa.binary()), ("third", pa.binary()),
        ("token", pa.int64()), ("many", pa.int64()),
    ]
)
_PROFILE_DDL = "doc_id long, row long, n long, key long, sketch binary, second binary, third binary, token long, many long"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and at the end a row for each shingle that came more than once in this task.

    Sketch and prefixes stand on the first row of each set in the task only.
    """
    counts, seen = Frequent(), set()
    for batch in batches:
        ids, of_row = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        rows = []
        for lo, hi, data, offsets in blocks(batch.column(1)):
            for doc_id, row, t in zip(ids[lo:hi], of_row[lo:hi], shingle_sets(data, offsets), strict=True):
                key = set_key(t) if len(t) else None
                if key is None or key in seen:
                    rows.append((doc_id, row, len(t), key, None, None, None))
                    continue
                seen.add(key)  # copies of a set are one node and count once
                counts.add(t)
                rows.append((doc_id, row, len(t), key, odd_sketch(t), *(order_prefix(t, factor) for factor in ORDERS)))
        if rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PROFILE, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], schema=_PROFILE)
    counts.settle()
    again = counts.count > 1
    token, many = counts.token[again].view(np.int64), counts.count[again]
    for lo in range(0, len(token), 1 << 16):
        part = token[lo : lo + (1 << 16)]
        none = [pa.nulls(len(part), f.type) for f in list(_PROFILE)[:7]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(part), pa.array(many[lo : lo + (1 << 16)])], schema=_PROFILE)


def frequent_shingles(profile: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and levels (log2 of the count) of about ``most`` shingles, the most frequent ones."""
    counted = written(profile.where("token is not null").groupBy("token").agg(F.floor(F.log2(F.sum("many"))).cast("int").alias("level")), "frequent")
    by_level = dict(counted.groupBy("level").count().collect())
    kept, chosen = 0, F.lit(False)
    for level in sorted(by_level, reverse=True):
        some = F.col("level") == level
        if kept + by_level[level] > most:
            # of the last level as many as fit, by hash
            some = some & (F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < int((most - kept) / by_level[level] * (1 << 30)))
        chosen, kept = chosen | some, kept + by_level[level]
        if kept > most:
            break
    got = counted.where(chosen).toPandas()
    order = np.argsort(got["token"].to_numpy().view(np.uint64), kind="stable")
    return got["token"].to_numpy().view(np.uint64)[order], got["level"].to_numpy().astype(np.uint8)[order]


_PARTS = pa.schema([("part", pa.int32()), ("body", pa.binary())])
_PARTS_DDL = "part int, body binary"
#: Bytes of what is kept of a shingle, of a set's number in a block, and of a salt; of a key, a size and a centrality.
_ROW_BYTES, _SET_BYTES = (6, 4, 4), (8, 4, 2)
#: A shingle's 48 bits times the first, modulo 2^48, is its image; times the second it is itself again.
_IMAGE, _BITS48 = np.uint64(0x9E3779B97F4B), np.uint64((1 << 48) - 1)
_TOKEN = np.uint64(pow(int(_IMAGE), -1, 1 << 48))


def _spread(out: np.ndarray, begin: np.ndarray, count: np.ndarray, width: int, values: np.ndarray) -> None:
    """Write the lowest ``width`` bytes of ``values`` in planes: for each block all highest bytes first, then the next ones.

    Block b has ``count[b]`` values and begins at byte ``begin[b]``; equal planes compress well.
    """
    first, many = np.repeat(begin, count), np.repeat(count, count)
    within = np.arange(len(values)) - np.repeat(np.cumsum(count) - count, count)
    for plane in range(width):
        out[first + plane * many + within] = (values >> np.uint64(8 * (width - 1 - plane))).astype(np.uint8)


def _gathered(raw: np.ndarray, at: int, count: int, width: int) -> np.ndarray:
    planes = raw[at : at + count * width].reshape(width, count)
    out = np.zeros(count, np.uint64)
    for plane in planes:
        out = out << np.uint64(8) | plane
    return out


def pack_parts(token: np.ndarray, salt: np.ndarray, owner: np.ndarray, key: np.ndarray, n: np.ndarray, central: np.ndarray, parts: int) -> pa.RecordBatch:
    """Prefix rows dealt to parts by shingle and salt, one block of bytes for each part.

    ``owner`` numbers the sets, whose ``key``, size and centrality stand once in a block, in steps of the keys.
    Of a shingle 48 bits are kept, in steps: equal ones stay equal, and a few that fall together only make
    candidates. A part has a range of the shingles' images, so that steps don't grow with the number of parts.
    """
    image = (token >> np.uint64(16)) * _IMAGE & _BITS48
    part = (image >> np.uint64(24)) * np.uint64(parts) >> np.uint64(24)
    part = np.where(salt > 0, mix(image ^ (salt.astype(np.uint64) << np.uint64(48))) % np.uint64(parts), part).astype(np.int64)
    by_key = np.argsort(key.view(np.uint64))
    place = np.empty(len(key), np.int64)
    place[by_key] = np.arange(len(key))
    key, n, central, owner = key.view(np.uint64)[by_key], n[by_key], central[by_key], place[owner]
    order = np.lexsort((image, part))
    part, image, salt, owner = part[order], image[order], salt[order], owner[order]
    names, first, rows = np.unique(part, return_index=True, return_counts=True)
    step = np.diff(image, prepend=np.uint64(0))
    step[first] = image[first]
    pairs, which = np.unique(part << 32 | owner, return_inverse=True)
    sets = np.bincount(np.searchsorted(names, pairs >> 32), minlength=len(names))
    first_set = np.cumsum(sets) - sets
    local = which - np.repeat(first_set, rows)
    of = (pairs & 0xFFFFFFFF).astype(np.int64)
    key_step = np.diff(key[of], prepend=np.uint64(0))
    key_step[first_set] = key[of][first_set]
    length = 8 + sum(_SET_BYTES) * sets + sum(_ROW_BYTES) * rows
    offsets = np.concatenate([[0], np.cumsum(length)])
    out, at, one = np.zeros(offsets[-1], np.uint8), offsets[:-1].copy(), np.ones(len(names), np.int64)
    columns = [(one, 4, rows), (one, 4, sets), *zip([sets] * 3, _SET_BYTES, (key_step, n[of], central[of]), strict=True), *zip([rows] * 3, _ROW_BYTES, (step, local, salt), strict=True)]
    for count, width, values in columns:
        _spread(out, at, count, width, values.astype(np.int64).view(np.uint64) if values.dtype != np.uint64 else values)
        at += width * count
    codec = pa.Codec("zstd", compression_level=1)
    bodies = [out[lo : lo + 8].tobytes() + codec.compress(out[lo + 8 : hi].tobytes(), asbytes=True) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(bodies, pa.binary())], schema=_PARTS)


def unpack_part(body: bytes) -> tuple[np.ndarray, ...]:
    """token, salt, key, n, central of each row of a block."""
    rows, sets = (int(_gathered(np.frombuffer(body, np.uint8), at, 1, 4)[0]) for at in (0, 4))
    raw = np.frombuffer(pa.Codec("zstd").decompress(body[8:], sum(_SET_BYTES) * sets + sum(_ROW_BYTES) * rows, asbytes=True), np.uint8)
    at, got = 0, []
    for count, width in (*((sets, w) for w in _SET_BYTES), *((rows, w) for w in _ROW_BYTES)):
        got.append(_gathered(raw, at, count, width))
        at += count * width
    key, n, central, step, local, salt = got
    local, key = local.astype(np.int64), np.cumsum(key, dtype=np.uint64).view(np.int64)
    return np.cumsum(step, dtype=np.uint64) * _TOKEN & _BITS48, salt.astype(np.int64), key[local], n.astype(np.int64)[local], central.astype(np.int64)[local]


def _prefixes(batches: Iterator[pa.RecordBatch], token: np.ndarray, level: np.ndarray, parts: int, chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Prefix shingles of each distinct set of this task, under the first order, packed by part."""
    maybe = np.zeros(1 << 22, bool)
    maybe[(token >> np.uint64(42)).astype(np.int64)] = True
    seen: set[int] = set()
    very = int(math.log2(VERY_FREQUENT))
    any_key = lambda key: int(mix(np.array([key], np.int64).view(np.uint64))[0] >> np.uint64(16))
    held: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        sizes = [len(x[0]) for x in held]
        key, n, central = (np.array([x[k] for x in held], np.int64) for k in (2, 3, 4))
        return pack_parts(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.repeat(np.arange(len(held)), sizes), key, n, central, parts)

    for batch in batches:
        for _, _, data, offsets in blocks(batch.column(1)):
            for t in shingle_sets(data, offsets):
                n = len(t)
                key = set_key(t) if n else 0
                if not n or key in seen:
                    continue
                seen.add(key)
                p = prefix_length(n)
                size += p
                often = np.flatnonzero(maybe[(t >> np.uint64(42)).astype(np.int64)])
                if len(often):
                    at = np.minimum(np.searchsorted(token, t[often]), len(token) - 1)
                    often, at = often[token[at] == t[often]], at[token[at] == t[often]]
                if not len(often):
                    held.append((t[:p], np.zeros(p, np.int64), key, n, 0))
                else:
                    rank = np.zeros(n, np.uint8)
                    rank[often] = level[at] + 1
                    first = np.argsort(rank, kind="stable")[:p]
                    # a level is one less than the rank; each more of it doubles the salts
                    salts = np.int64(1) << np.maximum(rank[first].astype(np.int64) - 1 - very, 0)
                    salt = np.where(salts > 1, 1 + (any_key(key) & (salts - 1)), 0)
                    held.append((t[first], salt, key, n, int(1000 * rank.mean())))
                if size >= chunk_rows:
                    yield packed()
                    held.clear()
                    size = 0
    if held:
        yield packed()


_SHARED = pa.schema([("token", pa.int64()), ("salt", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("hub", pa.struct([("central", pa.int64()), ("key", pa.int64()), ("n", pa.int64())]))])
_SHARED_DDL = "token long, salt long, key long, n long, hub struct<central:long,key:long,n:long>"


def shared_in_part(part: pa.Table) -> pa.Table:
    """The rows of one part whose shingle several sets have: token, salt, key, n and the shingle's hub, the most central set.

    A set that came in several tasks counts once. Where the sizes leave a gap that no link can span, the sets
    on its sides are told apart as if they had different shingles: each range of sizes has a hub of its own,
    and one with a single set is gone. A very frequent shingle is dealt by its salt, so its rows meet in many
    parts; a salt is kept whole, even if it has one set here, as others may have more. Rows of two sets alone
    have TWO_SETS as their salt: these sets are one pair, that of the star.
    """
    token, salt, key, n, central = (np.concatenate(c) for c in zip(*[unpack_part(b.as_py()) for b in part.column("body")], strict=True))
    order = np.lexsort((key, n, salt, token))
    token, salt, key, n, central = (x[order] for x in (token, salt, key, n, central))
    new, again = np.ones(len(token), bool), np.zeros(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
    again[1:] = ~new[1:] & (key[1:] == key[:-1])
    gap = np.zeros(len(token), bool)
    gap[1:] = ~new[1:] & (salt[1:] == 0) & (n[:-1] * 100 < n[1:] * PERCENT)
    # a size is less than 2^32, so a shingle has a hundred ranges at most
    ranges = np.cumsum(gap)
    ranges -= ranges[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    token, new = token << np.uint64(8) | ranges.astype(np.uint64), new | gap
    token, salt, key, n, central, new = (x[~again] for x in (token, salt, key, n, central, new))
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    sets = np.bincount(group)[group]
    kept = (sets > 1) | (salt > 0)
    salt = np.where((sets == 2) & (salt == 0), TWO_SETS, salt)
    best = np.maximum.reduceat(central, first)
    # of the most central ones the last, which has the largest size and key
    hub = np.maximum.reduceat(np.where(central == best[group], np.arange(len(key)), -1), first)[group][kept]
    hubs = pa.StructArray.from_arrays([pa.array(central[hub]), pa.array(key[hub]), pa.array(n[hub])], fields=list(_SHARED.field("hub").type))
    return pa.Table.from_arrays([pa.array(token[kept].view(np.int64)), pa.array(salt[kept]), pa.array(key[kept]), pa.array(n[kept]), hubs], schema=_SHARED)


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _one_hub(shared: DataFrame) -> DataFrame:
    """token, key, n, hub, hub_n with one hub for each shingle.

    The hubs of a shingle's salts are compared, and the best goes back to each salt, so the rows
    of a very frequent shingle stay dealt out. A row for each salt is written, as later steps read
    the hubs several times and their plans would each hold this comparison.
    """
    salted = shared.where("salt > 0")
    each = salted.groupBy("token", "salt").agg(F.max("hub").alias("hub"))
    best = each.groupBy("token").agg(F.max("hub").alias("hub"))
    by_salt = written(each.select("token", "salt").join(best, "token"), "jaccard-salts")
    rows = shared.where("salt = 0").select("token", "key", "n", "hub").unionByName(salted.drop("hub").join(by_salt, ["token", "salt"]).select("token", "key", "n", "hub"))
    return rows.select("token", "key", "n", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n"))


def _differ_at_most(lower_bound: Column, na: Column, nb: Column) -> Column:
    """Whether sets that differ in so many elements can link."""
    return (na + nb) * (200 - PERCENT * 2) >= lower_bound * (200 + PERCENT * 2)


def _stars(hubs: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) of a hub and a set that shares a shingle with it."""
    return hubs.where((F.col("hub") != F.col("key")) & _sizes_allow(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()


def _between_components(hubs: DataFrame, rows: DataFrame, roots: DataFrame, near_hub: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of sets that share a shingle, lie in different components and may link.

    Sets at a known distance from their hub meet once under the hub, whatever number of its
    shingles they share; others meet under each shingle. The members of a group's largest
    component meet only the rest.
    """
    away = near_hub.select(F.col("a").alias("hub"), F.col("b").alias("key"), "differ")
    # one row for each hub and set, however many shingles they share
    members = hubs.select("hub", "key", "n").distinct().join(away, ["hub", "key"], "left").withColumn("differ", F.when(F.col("hub") == F.col("key"), 0).otherwise(F.col("differ")))
    members = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    members = written(members.select("hub", "key", "n", "root", "differ"), "jaccard-members")
    by_hub = members.where("differ is not null").withColumnRenamed("hub", "place")
    # shingles all of whose sets are at a known distance are done with their hub
    afar = members.where("differ is null").select("hub", "key")
    open_ = _maybe_among(hubs.select("token", "hub", "key"), afar, "hub", "key").join(afar, ["hub", "key"]).select("token").distinct()
    open_ = written(open_, "jaccard-open")
    by_token = _maybe_among(hubs.select("token", "hub", "key"), open_, "token").join(open_, "token").join(members, ["hub", "key"])
    # read twice: for the places' components, and for the members of mixed ones
    by_token = written(by_token.select(F.col("token").alias("place"), "key", "n", "root", "differ"), "jaccard-by-token")
    return _pairs_within(by_hub, rows, True).unionByName(_pairs_within(by_token, rows, False)).distinct()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sketch as longs, folded to FOLDED at most, and folded once more for a partner of half its length."""
    for batch in batches:
        bits, half = [], []
        for raw in batch.column(1).to_pylist():
            x = np.frombuffer(raw, "<i8")
            while len(x) > FOLDED:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            bits.append(x)
            half.append(x[: len(x) // 2] ^ x[len(x) // 2 :] if len(x) > 1 else x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64())), pa.array(half, pa.list_(pa.int64()))], names=["key", "bits", "half"])


def _bits_apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _pairs_within(members: DataFrame, rows: DataFrame, known: bool) -> DataFrame:
    """Pairs (a, b) of one place and different components that no bound rules out.

    With ``known``, all distances to the hub are; else at least one of a pair's is not. The
    members outside a place's largest component meet all of its members, block by block.
    """
    per_root = members.groupBy("place", "root").agg(F.count(F.lit(1)).alias("count"), F.bit_xor(F.xxhash64("key")).alias("xor"), F.sum(F.xxhash64("key", F.lit(1)) % (1 << 40)).alias("sum"))
    same = [F.bit_xor("xor").alias("xor"), F.sum("sum").alias("sum")]
    places = per_root.groupBy("place").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.max("count").alias("most"), F.sum("count").alias("all"), F.count(F.lit(1)).alias("roots"), *same)
    # places with the same members make the same pairs: one of them is enough
    places = places.where("roots > 1").groupBy("all", "xor", "sum").agg(F.min_by(F.struct("place", "major", "most"), "place").alias("p")).select("all", "p.*")
    # one row for each mixed place: Spark broadcasts it by its measured size, and else splits skewed partitions
    blocks_of = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    places = written(places.select("place", "major", blocks_of(F.col("all") - F.col("most"), X_BLOCK).alias("x_blocks"), blocks_of(F.col("all"), Y_BLOCK).alias("y_blocks")), "jaccard-places")
    members = written(members.join(places, "place"), "jaccard-mixed")
    bits = _facts(rows, members.select("key"), ("sketch",)).mapInArrow(_folded, "key long, bits array<long>, half array<long>")
    members = written(members.join(bits, "key"), "jaccard-bits")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("key"), F.col(f"{own}_blocks")).cast("int")
        return side.withColumn(f"{own}_at", mine).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))

    x, y = dealt(members.where("root <> major"), "x", "y").alias("x"), dealt(members, "y", "x").alias("y")

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    met = (c("x", "place") == c("y", "place")) & (c("x", "x_at") == c("y", "x_at")) & (c("x", "y_at") == c("y", "y_at"))
    once = (c("y", "root") == c("y", "major")) | (c("x", "key") < c("y", "key"))
    may = _sizes_allow(c("x", "n"), c("y", "n"))
    if known:
        may = may & _differ_at_most(F.abs(c("x", "differ") - c("y", "differ")), c("x", "n"), c("y", "n"))
    else:
        may = may & (c("x", "differ").isNull() | c("y", "differ").isNull())
    # sets of so like sizes have sketches of one length, or one of twice the other's
    longer = F.size(c("x", "bits")) - F.size(c("y", "bits"))
    apart = F.when(longer == 0, _bits_apart(c("x", "bits"), c("y", "bits"))).when(longer > 0, _bits_apart(c("x", "half"), c("y", "bits"))).otherwise(_bits_apart(c("x", "bits"), c("y", "half")))
    may = may & _differ_at_most(apart, c("x", "n"), c("y", "n"))
    pairs = x.join(y, met & (c("x", "root") != c("y", "root")) & once & may)
    return pairs.select(F.least(c("x", "key"), c("y", "key")).alias("a"), F.greatest(c("x", "key"), c("y", "key")).alias("b"))


def _facts(rows: DataFrame, keys: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """key and some columns of the sets ``keys``; ``row`` is the least of a set's rows.

    The keys are written first: where they measure as small Spark broadcasts them. Of more keys a bit
    each is broadcast, so that in either case only the rows of these sets move, and a few others.
    """
    keys = written(keys.distinct(), "jaccard-keys")
    facts = [F.min("row").alias("row") if c == "row" else F.first(c, ignorenulls=True).alias(c) for c in names]
    # an inner join, as Spark would take a semi join before the bits
    return _maybe_among(rows, keys, "key").join(keys, "key").groupBy("key").agg(*facts)


def _maybe_among(rows: DataFrame, some: DataFrame, *on: str) -> DataFrame:
    """The rows that may have a partner in ``some`` by the columns ``on``: each row of ``some`` sets one of
    FILTER_BITS bits at most, and the bits are broadcast. It only saves shuffled rows; a join follows.
    """
    bits, most = 1 << 16, 16 * some.count()
    while bits < min(FILTER_BITS, most):
        bits *= 2
    slot = F.pmod(F.xxhash64(*on), F.lit(bits))
    word = F.shiftright(slot, 6).cast("int")
    mark = F.lit(1).cast("long")
    table = some.select(word.alias("word_"), (slot % 64).cast("int").alias("bit")).groupBy("word_").agg(F.bit_or(F.call_function("shiftleft", mark, "bit")).alias("bits_"))
    hit = F.call_function("shiftright", F.col("bits_"), (slot % 64).cast("int")).bitwiseAND(mark) == 1
    return rows.join(F.broadcast(table), word == F.col("word_")).where(hit).select(*rows.columns)


def _in_blocks(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, ...) with a ``block`` of their set a, and (a, blocks) of the sets with more than one block."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAIR_BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    many = written(many, "jaccard-blocks")
    block = F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"), F.lit(0))
    return pairs.join(many, "a", "left").withColumn("block", block).drop("blocks"), many


def _to_blocks(side: DataFrame, many: DataFrame) -> DataFrame:
    """What is known of each set a, once for each of its blocks."""
    return side.join(many, "a", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")


def _sides(pairs: DataFrame, rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The pairs (a, b) with columns of both sets; those of a are sent once for each block of its pairs."""
    sets = _facts(rows, pairs.select(F.explode(F.array("a", "b")).alias("key")), names)
    one, two = (sets.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ab")
    pairs, many = _in_blocks(pairs)
    return pairs.join(two, "b").join(_to_blocks(one, many), ["a", "block"])


def _in_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets share a prefix shingle under the second and the third order."""
    for batch in batches:
        na, nb, *prefixes = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "second_a", "second_b", "third_a", "third_b"))
        ok = [prefixes_meet(x, i, y, j) and prefixes_meet(u, i, v, j) for i, j, x, y, u, v in zip(na, nb, *prefixes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in _MET], names=list(_MET)).filter(pa.array(ok, pa.bool_()))


_MET = ("a", "b", "n_a", "n_b", "row_a", "row_b")
_NEAR_DDL = "a long, b long, n_a long, n_b long, row_a long, row_b long"


def in_all_orders(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix shingle under the second and the third order too, with the size
    and a row of both sets."""
    return _sides(pairs, rows, ("n", "row", "second", "third")).mapInArrow(_in_orders, _NEAR_DDL)


def _by_sketch(batches: Iterator[pa.RecordBatch], slack: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb, sa, sb = (batch.column(i).to_pylist() for i in (2, 3, 6, 7))
        ok = [may_link(-(-sketch_distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) // slack), i, j) for x, y, i, j in zip(sa, sb, na, nb, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(6)], names=["a", "b", "n_a", "n_b", "row_a", "row_b"]).filter(pa.array(ok, pa.bool_()))


def _packed(t: np.ndarray) -> bytes:
    """The upper 40 bits of each hash, in order."""
    return (t >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        differ, link = [], []
        for i in range(batch.num_rows):
            a, b = _unpacked(batch.column(4)[i].as_py()), _unpacked(batch.column(5)[i].as_py())
            differ.append(na[i] + nb[i] - 2 * shared_elements(a, b))
            link.append(may_link(differ[-1], na[i], nb[i]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(differ, pa.int64()), pa.array(link, pa.bool_())], names=["a", "b", "differ", "link"])


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, filter_bits: int, slack: int = 1) -> DataFrame:
    """(a, b, differ, link) for the pairs that pass all orders and the sketch bound, relaxed by a factor of ``slack``.

    Only the texts of pairs that passed both are taken up again. Sketches are shorter than prefixes and rule
    out most pairs, so they are compared first, and prefixes sent for the pairs that are left.
    """
    pairs = written(pairs, "jaccard-pairs")
    sketches = _sides(pairs, rows, ("n", "row", "sketch")).select("a", "b", "n_a", "n_b", "row_a", "row_b", "sketch_a", "sketch_b")
    pairs = written(sketches.mapInArrow(lambda it: _by_sketch(it, slack), _NEAR_DDL).select("a", "b"), "jaccard-pairs")
    near = in_all_orders(pairs, rows)
    near = written(near, "jaccard-near")
    tokens = _tokens_of(texts, near, filter_bits)
    # the tokens of one row stand for all copies of its set; few sets are hubs, so each side takes its own
    one, two = (tokens.where(f"for_{x}").select(F.col("key").alias(x), F.col("row").alias(f"row_{x}"), F.col("tokens").alias(f"t_{x}")) for x in "ab")
    near, many = _in_blocks(near)
    both = near.join(two, ["b", "row_b"]).join(_to_blocks(one, many), ["a", "block", "row_a"]).select("a", "b", "n_a", "n_b", "t_a", "t_b")
    return both.mapInArrow(_by_sets, "a long, b long, differ long, link boolean").dropDuplicates(["a", "b"])


def _needed_filter(needed: DataFrame, bits: int) -> np.ndarray:
    """A bit for each slot that a needed row falls on; at most bits / 64 rows come to the driver."""
    slot = F.pmod(F.col("row"), F.lit(bits))
    words = needed.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("bits"))
    got = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[got["at"].to_numpy().astype(np.int64)] = got["bits"].to_numpy().astype(np.int64)
    return out


_TOKENS_DDL = "key long, row long, tokens binary, for_a boolean, for_b boolean"


def _tokens(batches: Iterator[pa.RecordBatch], wanted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for_a, for_b = (np.unpackbits(w.view(np.uint8), bitorder="little").astype(bool) for w in wanted)
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        slot = batch.column(3).to_numpy()
        batch = batch.filter(pa.array(for_a[slot] | for_b[slot]))
        slot = batch.column(3).to_numpy()
        of_row, sides, rows = batch.column(2).to_pylist(), list(zip(for_a[slot].tolist(), for_b[slot].tolist(), strict=True)), []
        for lo, hi, data, offsets in blocks(batch.column(1)):
            for row, t, side in zip(of_row[lo:hi], shingle_sets(data, offsets), sides[lo:hi], strict=True):
                if len(t) and row not in seen:  # repeated rows give one
                    seen.add(row)
                    rows.append((set_key(t), row, _packed(t), *side))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "row", "tokens", "for_a", "for_b"])


def _tokens_of(texts: DataFrame, near: DataFrame, filter_bits: int) -> DataFrame:
    """The tokens of the rows ``row_a`` and ``row_b`` of some pairs, and of a few others that share a filter slot."""
    bits, most = 1 << 16, 16 * near.count()
    while bits < min(filter_bits, most):
        bits *= 2
    wanted = [_needed_filter(near.select(F.col(c).alias("row")), bits) for c in ("row_a", "row_b")]
    slotted = texts.withColumn("slot", F.pmod("row", F.lit(bits)))
    return written(slotted.mapInArrow(lambda it: _tokens(it, wanted), _TOKENS_DDL), "jaccard-tokens")


def _row_of(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: id and text. Rows equal in both are copies of one row."""
    return F.xxhash64(doc_id, text)


def _assigned(docs: DataFrame, frequent: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): doc_id, row, n, key of each row, and for each set (key) the root of its component,
    its number of rows, and the first of them as struct(without id, doc_id, row)."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", _row_of(F.col("doc_id"), F.col("text")).alias("row"))
    profile = written(texts.mapInArrow(_profile, _PROFILE_DDL), "jaccard-profile")
    rows = profile.where("token is null")
    token, level = frequent_shingles(profile, frequent)
    packed = rows.where("sketch is not null").agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0] or 0
    parts, chunk_rows = max(16, -(-int(packed) // PART_ROWS)), CHUNK_ROWS
    prefixes = texts.mapInArrow(lambda it: _prefixes(it, token, level, parts, chunk_rows), _PARTS_DDL)
    shared = written(prefixes.groupBy("part").applyInArrow(shared_in_part, _SHARED_DDL), "jaccard-shared")
    sets = rows.where("key is not null").select("row", "n", "key", "sketch", "second", "third")
    hubs = _one_hub(shared.where(F.col("salt") != TWO_SETS))
    twos = shared.where(F.col("salt") == TWO_SETS).select("token", "key", "n", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n"))
    # what a round has stored goes as soon as its links are written
    with scratch_tables(docs.sparkSession) as keep:
        checked = keep(_verified(_stars(hubs.unionByName(twos)), sets, texts, filter_bits, slack=2), "jaccard-checked")
    with scratch_tables(docs.sparkSession) as keep:
        roots = keep(components(checked.where("link")), "jaccard-roots")
    with scratch_tables(docs.sparkSession) as keep:
        more = keep(_verified(_between_components(hubs, sets, roots, checked), sets, texts, filter_bits).where("link").select("a", "b"), "jaccard-more")
    # the first round's components go on as stars
    links = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more)
    roots = components(links).withColumnRenamed("node", "key")
    rows = rows.select("doc_id", "row", "n", "key")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    sets = rows.where("key is not null").groupBy("key").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows"))
    return rows, sets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def near_duplicate_components(docs: DataFrame, frequent: int = FREQUENT, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for each row of ``docs``.

    A null or empty text, or one without words, has no shingles, links with nothing and is its
    own component. Equal sets always link, so exact copies are one component. Rows with the
    same doc_id stay, each with the component of its own text. A null doc_id takes part, but
    is never the smallest. An empty table gives an empty result; other columns are ignored.

    Sets are held by 64-bit hashes of shingles and of whole sets, and compared by 40 bits of
    each shingle in the last step; a wrong link needs a collision there.
    """
    rows, sets = _assigned(docs, frequent, filter_bits)
    smallest = sets.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    by_key = sets.select("key", "root").join(smallest, "root").select("key", "component_id")
    return rows.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of its smallest doc_id.

    Rows are told apart by doc_id and text: rows that share an id but not a component all stay, as
    each stands for its own. A null id is larger than all others; ties go by a hash of the
    text, and of rows equal in id and text the one with the least other columns stays (they must
    be orderable). A text without words links with nothing, so all such rows stay, repeated ones
    too. An empty table gives an empty result; columns may have any names.

    The rows to drop are written first, so that Spark knows their size: it broadcasts them if
    they are few, and else shuffles the texts once.
    """
    rows, sets = _assigned(docs, FREQUENT, FILTER_BITS)
    per_root = sets.groupBy("root").agg(F.min("first").alias("kept"), F.sum("rows").alias("size")).where("size > 1")
    grouped = written(rows.select("row", "key").join(sets.select("key", "root").join(per_root, "root").select("key", F.col("kept.row").alias("kept")), "key").groupBy("row", "kept").count(), "jaccard-grouped")
    # repeated rows of a kept one go too: they are dropped here, and one of them comes back below
    dropped = written(grouped.where("row <> kept or count > 1").select(F.col("row").alias(_mark(docs))), "jaccard-dropped")
    repeated = written(grouped.where("row = kept and count > 1").select(F.col("row").alias(_mark(docs))), "jaccard-repeated")
    row = _row_of(docs["doc_id"], docs["text"])
    kept = docs.join(dropped, row == dropped[_mark(docs)], "left_anti")
    if repeated.isEmpty():
        return kept
    twins = docs.join(repeated, row == repeated[_mark(docs)])
    one = twins.groupBy(_mark(docs)).agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("r"))
    return kept.unionByName(one.select("r.*"))


def _mark(docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    name = "row_mark"
    while name in docs.columns:
        name += "_"
    return name
