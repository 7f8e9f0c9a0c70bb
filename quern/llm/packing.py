"""Problem 7: items into containers of fixed capacity with little room left over.

Sizes are whole numbers up to the capacity, so the instance is its histogram: at most ``capacity``
rows whatever the number of items.  On the histogram the driver fixes, by the dominance criterion of
Martello and Toth, every set that provably belongs to some best packing, then packs the remainder by
best fit, largest first.  All items of a size are handled in one step (``c`` equal items in ``m``
containers), so the plan is short; items are then matched to it by their rank within their size.

Defined cases: an item of size 0 takes no room and gets no container (null); an item above the
capacity is divided into full containers and one remainder, and no other item is divided; equal
items may trade places; repeated rows are items of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import bucket_bits, running_sum
from quern.session import cut

CAPACITY = 4096
#: Rows of the plan that are broadcast at most; a longer plan is joined by shuffling.
BROADCAST_PLAN = 200_000


class Plan:
    """Containers numbered from 0 and, for each size, which ranks go to which of them."""

    def __init__(self, histogram: list[tuple[int, int]], capacity: int) -> None:
        self.capacity = capacity
        self.histogram = sorted((s, n) for s, n in histogram if n > 0)
        self.left = dict(self.histogram)
        self.sizes = sorted(self.left)
        self.seen: dict[int, int] = defaultdict(int)
        #: (size, lo, hi, first container, items of it per container)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.containers = 0
        self.fixed = 0
        self._reduce()
        self.fixed = self.containers
        self._best_fit()

    def least(self) -> int:
        """A number of containers that no packing of the items can go below (the bound L2 of Martello and Toth).

        For each a up to half the capacity: items above capacity - a are alone, those above half the capacity
        are apart, and of the others from a on what doesn't fit beside the latter needs containers of its own.
        """
        c = self.capacity
        best = -(-sum(s * n for s, n in self.histogram) // c)
        for a in [0, *(s for s, _ in self.histogram if 2 * s <= c)]:
            alone = sum(n for s, n in self.histogram if s > c - a)
            apart = [(s, n) for s, n in self.histogram if c - a >= s and 2 * s > c]
            small = sum(s * n for s, n in self.histogram if a <= s and 2 * s <= c)
            beside = sum(n for _, n in apart) * c - sum(s * n for s, n in apart)
            best = max(best, alone + sum(n for _, n in apart) + max(0, -(-(small - beside) // c)))
        return best

    def _put(self, size: int, first: int, containers: int, each: int) -> None:
        n, lo = containers * each, self.seen[size]
        self.rows.append((size, lo, lo + n, first, each))
        self.seen[size] = lo + n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def _largest(self, most: int, but: int) -> int:
        """Largest item of at most ``most`` besides one of size ``but``; 0 if there is none."""
        i = bisect_right(self.sizes, most) - 1
        while i >= 0:
            if self.sizes[i] != but or self.left[but] > 1:
                return self.sizes[i]
            i -= 1
        return 0

    def _smallest(self, n: int, but: int) -> list[int]:
        """The n smallest items besides one of size ``but``."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - (s == but))
            if len(out) == n:
                break
        return out

    def _best_pair(self, room: int, but: int) -> int:
        """Largest sum of two items (besides one of size ``but``) within the room; 0 if there is none."""
        free = [s for s in self.sizes if self.left[s] - (s == but) > 0]
        best, i, j = 0, 0, len(free) - 1
        while i <= j:
            if free[i] + free[j] > room:
                j -= 1
            elif i == j and self.left[free[i]] - (free[i] == but) < 2:
                break
            else:
                best = max(best, free[i] + free[j])
                i += 1
        return best

    def _fix(self, *sets: int) -> None:
        """Closes as many containers as the items of the set allow."""
        need = defaultdict(int)
        for s in sets:
            need[s] += 1
        m = min(self.left[s] // k for s, k in need.items())
        for s, k in need.items():
            self._put(s, self.containers, m, k)
        self.containers += m

    def _reduce(self) -> None:
        """Largest first: containers that provably are part of some packing of least size.

        With ``k`` the largest item that fits beside ``j``, the set {j, k} dominates if it is full, if
        nothing or only one item fits beside j, or if no three fit and no two together exceed k.
        """
        for j in reversed(list(self.sizes)):
            while j in self.left:
                room = self.capacity - j
                k = self._largest(room, j)
                if not k:
                    self._fix(j)
                    continue
                few = self._smallest(3, j)
                two = sum(few[:2]) if len(few) >= 2 else room + 1
                three = sum(few) if len(few) == 3 else room + 1
                if k == room or two > room or (three > room and self._best_pair(room, j) <= k):
                    self._fix(j, k)
                else:
                    break

    def _best_fit(self) -> None:
        """Each item to the open container with the least room that holds it, else to a new one."""
        rooms: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)

        def add(room: int, first: int, n: int) -> None:
            if n and room:
                if not open_[room]:
                    insort(rooms, room)
                open_[room].append((first, n))

        for size in reversed(list(self.sizes)):
            while size in self.left:
                at = bisect_left(rooms, size)
                if at < len(rooms):
                    room = rooms[at]
                    first, n = open_[room].pop()
                    if not open_[room]:
                        rooms.pop(at)
                else:
                    room, first = self.capacity, self.containers
                    n = -(-self.left[size] // (room // size))
                    self.containers += n
                each, count = room // size, self.left[size]
                full = min(n, count // each)
                if full:
                    self._put(size, first, full, each)
                    add(room - each * size, first, full)
                if full < n and count - full * each > 0:
                    rest = count - full * each
                    self._put(size, first + full, 1, rest)
                    add(room - rest * size, first + full, 1)
                    full += 1
                add(room, first + full, n - full)


def pack(sized: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """``key, piece, begin, tokens, container`` of every piece, and the plan."""
    spark = sized.sparkSession
    items = sized.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n")).withColumn(
        "_full", F.when(F.col("_n") > capacity, F.floor(F.col("_n") / capacity)).otherwise(0).cast("long")
    )
    items = items.withColumn("_rest", F.col("_n") - F.col("_full") * capacity)
    # At most `capacity` rows reach the driver, whatever the number of items.
    histogram = [(r[0], r[1]) for r in items.filter("_rest > 0").groupBy("_rest").count().collect()]
    plan = Plan(histogram, capacity)
    rows = spark.createDataFrame(plan.rows, "size bigint, lo bigint, hi bigint, first bigint, each bigint")
    if len(plan.rows) <= BROADCAST_PLAN:
        rows = F.broadcast(rows)
    bits = bucket_bits(max((n for _, n in histogram), default=0))
    ranked = running_sum(items.filter("_rest > 0"), ["_rest"], ["_key"], F.lit(1), "_rank", bits)
    rest = ranked.join(rows, F.col("_rest") == F.col("size")).filter("_rank > lo and _rank <= hi")
    rest = rest.select(
        "_key",
        F.col("_full").alias("piece"),
        (F.col("_full") * capacity).alias("begin"),
        F.col("_rest").alias("tokens"),
        (F.col("first") + F.floor((F.col("_rank") - 1 - F.col("lo")) / F.col("each"))).alias("container"),
    )
    big = items.filter("_full > 0").withColumn("_all", F.lit(0))
    big = running_sum(big, ["_all"], ["_key"], F.col("_full"), "_end", 8)
    full = big.select("_key", (F.col("_end") - F.col("_full")).alias("_at"), F.posexplode(F.sequence(F.lit(1), F.col("_full"))).alias("_i", "_"))
    full = full.select(
        "_key",
        F.col("_i").cast("long").alias("piece"),
        (F.col("_i") * capacity).cast("long").alias("begin"),
        F.lit(capacity).cast("long").alias("tokens"),
        (F.lit(plan.containers) + F.col("_at") + F.col("_i")).alias("container"),
    )
    none = items.filter("_n <= 0").select(
        "_key", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("container")
    )
    out = rest.unionByName(full).unionByName(none)
    return out.select(F.col("_key").alias(key), "piece", "begin", "tokens", "container"), plan


def report(packed: DataFrame, plan: Plan, capacity: int = CAPACITY) -> DataFrame:
    """``containers, tokens, unused, fill, least, fixed``.

    ``least`` is a number no packing can go below; ``fixed`` the share of the containers that are full
    parts of divided items or were fixed by dominance, so that only the others could be packed better.
    """
    each = packed.filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("used"))
    whole = F.col("containers") - plan.containers
    return each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens")).select(
        "containers",
        "tokens",
        (F.col("containers") * capacity - F.col("tokens")).alias("unused"),
        (F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0))).alias("fill"),
        F.greatest(whole + plan.least(), F.ceil(F.col("tokens") / capacity)).alias("least"),
        ((whole + plan.fixed) / F.nullif("containers", F.lit(0))).alias("fixed"),
    )


def pack_texts(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, **tokenizer: str) -> tuple[DataFrame, Plan]:
    """Packs texts by their size in tokens; each text is encoded once."""
    from quern.llm.bpe import sizes

    return pack(cut(sizes(docs, key, text, "tokens", **tokenizer), "sizes"), key, "tokens", capacity)
