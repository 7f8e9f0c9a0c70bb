"""Pairs of similar sets without comparing all pairs: size-banded tiles of sets that share a key, bitmaps.

Sets are 64-bit hashes.  Sets that share a key (of a minhash band, or an element of their prefixes, which
is exact) meet in tiles.  Every key is cut into bands of size and these into tiles of bounded size, and only
tiles whose sizes can match are paired, so no task holds a whole hot key and no set is dropped.  Inside a
tile, sizes and bit counts bound the overlap from above; only pairs the bound lets through leave the
tile, to be decided exactly.  A bitmap is as wide as its set is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.joins import skew_join
from quern.session import cut

#: Bits of the smallest bitmap; others have the power of two that is at least twice their set.
BITS = 256
#: Sets in one side of a tile at most, and bytes of their bitmaps.
TILE = 512
TILE_BYTES = 1 << 25
#: Partners that one task compares with the set of one class.
PARTNERS = 1000

_MIX1, _MIX2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def bands_for(threshold: float, permutations: int = 160, miss: float = 0.0001) -> tuple[int, int]:
    """(bands, rows) with the most rows at which a pair at the threshold shares no band with probability at most ``miss``."""
    best = (permutations, 1)
    for rows in range(1, permutations + 1):
        bands = permutations // rows
        if (1 - threshold**rows) ** bands <= miss:
            best = (bands, rows)
    return best


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return (
        (rng.integers(0, 2**32, (n, 1), dtype=np.uint64) | np.uint64(1)).astype(np.uint32),
        rng.integers(0, 2**32, (n, 1), dtype=np.uint64).astype(np.uint32),
    )


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of the minhash bands of a set of well-mixed uint64 hashes, one int64 a band."""
    a, b = _permutations(bands * rows)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 4096):
        np.minimum(low, (h[None, at : at + 4096] * a + b).min(axis=1), out=low)
    key = np.arange(1, bands + 1, dtype=np.uint64) * BASE
    for r in range(rows):
        key = mixed(key * BASE + low[r::rows].astype(np.uint64))
    return key.view(np.int64)


def prefix_keys(hashes: np.ndarray, threshold: float) -> np.ndarray:
    """The least elements of a sorted set, as many as make two sets at or above the threshold share one; exact, but a share of the set."""
    n = len(hashes)
    return hashes[: n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0].view(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash of a set, by its lowest bits."""
    width = max(BITS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else BITS
    on = np.zeros(width, dtype=np.uint8)
    on[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    # Bit i of the map is bit i of a little-endian number, so halves fold onto one another by or.
    return np.packbits(on, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap as words of 64 bits, narrowed to ``width`` bits; bits that differ still stand for elements of one set only."""
    return np.bitwise_or.reduce(np.frombuffer(bits, dtype="<u8").reshape(-1, width // 64), axis=0)


def tiles(sketched: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``tile, side, cls, n, bits``: who meets whom; ``sketched`` (cls, n, bands, bits) has one row a set.

    Each key is cut by size: sets of band b, with n in [r^b, r^(b+1)) for r = 1/threshold, can only match
    bands b and b+1, and the sets of a band are dealt to tiles of at most ``tile`` by hash.  Pairs of
    different tiles get a tile of their own, with sides 0 and 1; side null means that all pairs of the
    tile count.  A tile without a pair isn't made.  Of keys with the same members one is enough.
    """
    band = F.floor(F.ln("n") / float(np.log(1 / threshold)) + 1e-9).cast("int")
    keyed = sketched.filter("n > 0").select("cls", "n", band.alias("band"), F.explode("bands").alias("key"))
    # A key has a row a band and a band a power of 1/threshold, so the lists below are short.
    each = keyed.groupBy("key", "band").agg(
        F.count("*").alias("m"), F.sum(F.shiftright(F.xxhash64("cls"), 40)).alias("who"), F.bit_xor(F.xxhash64("cls")).alias("also")
    )
    keys = each.groupBy("key").agg(
        F.sum("m").alias("m"), F.sum("who").alias("who"), F.bit_xor("also").alias("also"), F.map_from_entries(F.collect_list(F.struct("band", "m"))).alias("sizes")
    ).filter("m > 1")
    meets = F.exists(F.map_entries("sizes"), lambda e: (e["value"] > 1) | F.array_contains(F.map_keys("sizes"), e["key"] + 1))
    # Similar sets share most of their keys.
    keys = keys.filter(meets).groupBy("m", "who", "also").agg(F.min_by(F.struct("key", "sizes"), "key").alias("k")).select("k.key", "k.sizes", "m")
    met = skew_join(keyed, cut(keys, "keys"), "key", "m")

    def dealt(b: Column) -> Column:
        """Tiles of a band: by number of sets, and by the bytes of their bitmaps (at most 2 x 2 / 8 bytes an element)."""
        most = F.pow(F.lit(1 / threshold), b + 1) / 2 + BITS // 8
        rows = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_BYTES) / most)))
        return F.ceil(F.try_element_at("sizes", b) / rows).cast("int")

    b = F.col("band")
    met = met.select("key", "cls", "n", "band", F.try_element_at("sizes", b).alias("m"), dealt(b).alias("s"), dealt(b + 1).alias("s_up"), dealt(b - 1).alias("s_down"))
    met = met.withColumn("t", F.pmod(F.xxhash64("cls"), F.col("s")).cast("int"))
    t = F.col("t")

    def pair(b: Column, t: Column, b2: Column, t2: Column) -> Column:
        return F.xxhash64("key", b, t, b2, t2)

    same = F.when(
        F.col("m") > 1,
        F.transform(
            F.sequence(F.lit(0), F.col("s") - 1),
            lambda o: F.struct(pair(b, F.least(t, o), b, F.greatest(t, o)).alias("tile"), F.when(o != t, (o < t).cast("int")).alias("side")),
        ),
    )
    above = F.when(
        F.col("s_up").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.col("s_up") - 1), lambda o: F.struct(pair(b, t, b + 1, o).alias("tile"), F.lit(0).alias("side"))),
    )
    below = F.when(
        F.col("s_down").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.col("s_down") - 1), lambda o: F.struct(pair(b - 1, o, b, t).alias("tile"), F.lit(1).alias("side"))),
    )
    none = F.array().cast("array<struct<tile:bigint,side:int>>")
    whole = met.select(F.inline(F.concat(*[F.coalesce(x, none) for x in (same, above, below)])), "cls", "n")
    # Bitmaps join last, so that the sets that meet nobody never move theirs.
    return whole.join(sketched.select("cls", "bits"), "cls").select("tile", "side", "cls", "n", "bits")


def _candidates(threshold: float):
    """Pairs of a tile that size and bit counts let through; rows come sorted by tile."""
    need = threshold / (1 + threshold)

    def pairs(tile: np.ndarray, side: np.ndarray, cls: np.ndarray, n: np.ndarray, bits: np.ndarray):
        i = np.arange(len(tile))
        step = 1
        while True:
            i = i[i + step < len(tile)]
            i = i[tile[i] == tile[i + step]]
            if not len(i):
                return
            j = i + step
            ok = (side[i] < 0) | (side[i] != side[j])
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok &= (low >= threshold * high) & (cls[i] != cls[j])
            x, y = i[ok], j[ok]
            block = max(64, (1 << 20) // bits.shape[1])
            for at in range(0, len(x), block):
                p, q = x[at : at + block], y[at : at + block]
                differ = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                both = n[p] + n[q]
                keep = (both - differ) / 2 >= need * both - 1e-9
                p, q = p[keep], q[keep]
                if len(p):
                    yield np.minimum(cls[p], cls[q]), np.maximum(cls[p], cls[q])
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            tile, side = t.column("tile").to_numpy(), t.column("side").fill_null(-1).to_numpy()
            cls, n = t.column("cls").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            # Bitmaps of a tile are compared at the width of the narrowest.
            widths = 8 * pc.binary_length(t.column("bits")).to_numpy().astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            narrow = np.repeat(np.minimum.reduceat(widths, first), np.diff(first, append=len(tile)))
            maps = t.column("bits")
            for width in np.unique(narrow).tolist():
                at = np.flatnonzero(narrow == width)
                bits = np.stack([folded(maps[i].as_py(), width) for i in at.tolist()])
                for a, b in pairs(tile[at], side[at], cls[at], n[at], bits):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            ids = t.column("tile").to_numpy()
            # The last tile of a batch may go on in the next; a tile has at most two sides of bounded size.
            first = int(np.searchsorted(ids, ids[-1], side="left")) if ids[0] <= ids[-1] else 0
            yield from work(t.slice(0, first).combine_chunks())
            rest = t.slice(first).combine_chunks()
        if rest is not None:
            yield from work(rest)

    return run


def candidates(sketched: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``a, b`` (a < b) of the classes that meet in a tile and pass its bounds."""
    met = tiles(sketched, threshold, tile)
    sorted_ = met.repartition("tile").sortWithinPartitions("tile")
    return sorted_.mapInArrow(_candidates(threshold), "a bigint, b bigint").distinct()


def _exact(threshold: float, elements: Callable[[pa.Scalar], np.ndarray]):
    """Rows (a, b, v) of a group: first the one with b null, whose v is the set of a, then its partners'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            cls, other = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            rows: list[tuple[int, int, float]] = []
            for i, v in enumerate(batch.column("v")):
                own = elements(v)
                if other[i] is None:
                    held = own
                    continue
                both = len(np.intersect1d(held, own, assume_unique=True))
                sim = both / max(1, len(held) + len(own) - both)
                if sim >= threshold:
                    rows.append((cls[i], other[i], sim))
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "sim"])

    return run


def decided(pairs: DataFrame, sets: DataFrame, threshold: float, elements: Callable[[pa.Scalar], np.ndarray]) -> DataFrame:
    """``a, b, sim`` of the pairs (a, b) at or above the threshold, by intersecting sorted arrays.

    ``sets`` (cls, v) has one row a class; ``elements`` gives the sorted distinct hashes that v stands for.
    A pair goes to the class with more pairs, which meets its partners in groups of at most about
    PARTNERS, so that its own set travels once a group and is made once.
    """
    ends = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("m"))
    ends = cut(ends, "degrees")
    a, b = (ends.select(F.col("cls").alias(c), F.col("m").alias(f"m{c}"), F.col("m").alias("_w")) for c in "ab")
    known = skew_join(skew_join(pairs, a, "a", "_w"), b, "b", "_w")
    busy = (F.col("ma") > F.col("mb")) | ((F.col("ma") == F.col("mb")) & (F.col("a") < F.col("b")))
    known = known.select(
        F.when(busy, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(busy, F.col("b")).otherwise(F.col("a")).alias("b"), F.ceil(F.greatest("ma", "mb") / PARTNERS).alias("s")
    )
    known = cut(known.withColumn("part", F.pmod(F.xxhash64("b"), F.col("s"))).drop("s"), "grouped")
    right = known.join(sets.select(F.col("cls").alias("b"), "v"), "b")
    left = known.select("a", "part").distinct().join(sets.select(F.col("cls").alias("a"), "v"), "a").withColumn("b", F.lit(None).cast("long"))
    rows = left.select("a", "part", "b", "v").unionByName(right.select("a", "part", "b", "v"))
    met = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = met.select("a", "b", "v").mapInArrow(_exact(threshold, elements), "a bigint, b bigint, sim double")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
