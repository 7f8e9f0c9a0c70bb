"""Problem 1: train, validation and test splits that keep related entries together.

Related: the same source and id, or the same stored record, transitively.  Entries are reduced to
entities (a source and id, or a lone entry), entities that meet in a record are joined by
distributed union-find, and whole groups go, largest first, to the split furthest below its target.

Entities and records are told apart by 128 bits.  An entity, record or group of very many entries never
gathers its rows in one task: its partner in a join is broadcast (``skew_join``), everything else is a
partial aggregate.

Defined cases: an entry without id joins only through its records; one without records only through
its id; a null or blank source is the directory two levels above the file ('' if there is none);
repeated rows count once; entries with a null idx are left out; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.components import components
from quern.operators.joins import HOT_ROWS, skew_join
from quern.operators.prefix import bucket_bits, running_sum
from quern.operators.quota import fill_targets
from quern.session import cut

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def strip(c: Column) -> Column:
    """Without white space around, of any kind."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def entry_source() -> Column:
    """Source of an index entry: its own, tidied, or the directory two levels above its file."""
    own = F.lower(strip(F.col("source")))
    file = F.coalesce(F.col("file_path"), F.try_element_at("parts", F.lit(1))["file_path"])
    above = F.regexp_extract(F.coalesce(file, F.lit("")), r"([^/]+)/[^/]*/[^/]*$", 1)
    return F.when(own.isNull() | (own == ""), above).otherwise(own)


def entities(entries: DataFrame) -> DataFrame:
    """``idx, entity, also, pair, records`` of each entry: keys of what it belongs to and points to; ``also`` is the second half of the entity's."""
    own = F.when(F.col("file_path").isNotNull() & F.col("byte_offset").isNotNull(), F.array(F.struct("file_path", "byte_offset")))
    parts = F.filter("parts", lambda p: p["file_path"].isNotNull() & p["byte_offset"].isNotNull())
    none = F.array().cast("array<struct<file_path:string,byte_offset:bigint>>")
    records = F.concat(F.coalesce(own, none), F.coalesce(parts, none))
    named = F.col("id").isNotNull() & (strip(F.col("id")) != "")

    def key(n: int) -> Column:
        return F.when(named, F.xxhash64(F.lit(n), F.lit("id"), "_src", "id")).otherwise(F.xxhash64(F.lit(n), F.lit("idx"), "idx"))

    return (
        entries.filter("idx is not null")
        .withColumn("_src", entry_source())
        .select(
            "idx",
            key(1).alias("entity"),
            key(2).alias("also"),
            F.when(named, F.xxhash64(F.lit("id"), "_src", "id")).otherwise(F.xxhash64(F.lit("none"), "_src")).alias("pair"),
            F.transform(F.array_distinct(records), lambda r: F.struct(*[F.xxhash64(F.lit(n), r["file_path"], r["byte_offset"]).alias(f"r{n}") for n in (1, 2)])).alias("records"),
        )
    )


def settled(keyed: DataFrame) -> DataFrame:
    """``keyed`` without ``also``; entities that share a number but not ``also`` get numbers of their own."""
    clash = cut(keyed.groupBy("entity").agg(F.min("also").alias("lo"), F.max("also").alias("hi")).filter("lo <> hi").select("entity", F.lit(True).alias("_x")), "clash")
    if not clash.limit(1).count():
        return keyed.drop("also")
    other = keyed.join(clash, "entity", "left").withColumn("entity", F.when(F.col("_x"), F.xxhash64("entity", "also")).otherwise(F.col("entity"))).drop("_x")
    return settled(cut(other.select(keyed.columns), "entities"))


def links(keyed: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """Entities that meet in a record, as edges to the record's smallest entity.

    Records are grouped with partial aggregation; only those of several entities are kept, so a
    record that a third of the rows points to costs one row a task.
    """
    meets = keyed.select("entity", F.explode("records").alias("record")).distinct()
    shared = meets.groupBy("record").agg(F.min("entity").alias("first"), F.max("entity").alias("last"), F.count("*").alias("_w")).filter("first <> last")
    return skew_join(meets, cut(shared.select("record", "first", "_w"), "shared"), "record", "_w", hot).filter("entity <> first").select("entity", "first")


def grouped(entries: DataFrame, max_task_edges: int | None = None, hot: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries: ``idx, entity``; entities: ``entity, root, n``; groups: ``root, first_idx, size, is_case, m``), repeated rows once.

    ``n`` is the number of entries of an entity, ``m`` that of entities of a group.
    """
    keyed = settled(cut(entities(entries), "entities"))
    roots = components(links(keyed, hot), **({"max_task_edges": max_task_edges} if max_task_edges else {}))
    own = keyed.groupBy("idx").agg(F.min("entity").alias("entity"), F.min("pair").alias("pair"))
    own = cut(own, "entries")
    each = own.groupBy("entity").agg(
        F.min("idx").alias("low"), F.count("*").alias("n"), F.min("pair").alias("p0"), F.max("pair").alias("p1")
    )
    rooted = each.join(roots.withColumnRenamed("node", "entity"), "entity", "left").withColumn(
        "root", F.coalesce("root", "entity")
    )
    rooted = cut(rooted, "rooted")
    whole = rooted.groupBy("root").agg(
        F.min("low").alias("first_idx"), F.sum("n").alias("size"), (F.min("p0") != F.max("p1")).alias("is_case"), F.count("*").alias("m")
    )
    return own.select("idx", "entity"), rooted.select("entity", "root", "n"), cut(whole, "groups")


def _told(own: DataFrame, of: DataFrame, groups: DataFrame, hot: int) -> DataFrame:
    """The columns of ``groups`` (root, m, ...) for each entry."""
    each = cut(skew_join(of, groups, "root", "m", hot).drop("root"), "told")
    return skew_join(own, each, "entity", "n", hot).drop("entity")


def found(entries: DataFrame, max_task_edges: int | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """``first_idx, idx`` of every entry but the first of each group with several (source, id)."""
    own, of, groups = grouped(entries, max_task_edges, hot)
    cases = groups.filter("is_case").select("root", "first_idx", "m")
    return _told(own, of, cases, hot).filter("idx <> first_idx").select("first_idx", "idx")


def assign(entries: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS, max_task_edges: int | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """``idx, first_idx, split`` of every entry."""
    spark = entries.sparkSession
    own, of, groups = grouped(entries, max_task_edges, hot)
    # One row a distinct size of a group: fewer than the square root of twice the number of entries.
    histogram = [(r[0], r[1]) for r in groups.groupBy("size").count().collect()]
    total = sum(s * n for s, n in histogram)
    plan = fill_targets(histogram, [share * total for _, share in splits])
    rows = [(s, splits[i][0], lo, hi) for s, i, lo, hi in plan]
    placed = spark.createDataFrame(rows, "size bigint, split string, lo bigint, hi bigint")
    bits = bucket_bits(max((n for _, n in histogram), default=0))
    ranked = running_sum(groups, ["size"], ["root"], F.lit(1), "rank", bits)
    # The plan has a row a size and split, so it is as small as the histogram; most groups have one of a few sizes.
    where = ranked.join(F.broadcast(placed), "size").filter("rank > lo and rank <= hi").select("root", "first_idx", "split", "m")
    return _told(own, of, cut(where, "where"), hot).select("idx", "first_idx", "split")


def shares(assigned: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """``split, target, entries, share``: what was asked for and what was reached."""
    asked = assigned.sparkSession.createDataFrame([(n, float(s)) for n, s in splits], "split string, target double")
    got = assigned.groupBy("split").agg(F.count("*").alias("entries"))
    # One row a split: the window holds as many rows as there are splits.
    return (
        asked.join(got, "split", "left")
        .withColumn("entries", F.coalesce("entries", F.lit(0)))
        .crossJoin(F.broadcast(got.agg(F.sum("entries").alias("all"))))
        .select("split", "target", "entries", (F.col("entries") / F.col("all")).alias("share"))
    )
