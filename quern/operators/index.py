"""The chunk index: continuation pairs, flags, statistics, upsampling, packing of short orphans, document splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import strip
from quern.operators.prefix import bucket_bits, md5_rank, running_sum_by
from quern.session import cut

def entries_once(entries: DataFrame) -> DataFrame:
    """One row an idx (repeated rows are identical), written once; null split and tokens are 0, null source and id ''."""
    own = entries.filter("idx is not null").dropDuplicates(["idx"]).select(
        "idx", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce("split", F.lit(0)).alias("split"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        "file_path", "byte_offset", "parts",
    )
    # Neighbours need it several times: to cut it into ranges, to order those, and for the result.
    return cut(own, "once")


def tidy_source() -> Column:
    """Source of an entry in lower case without white space around; where it is blank, the directory two levels above its file."""
    own = F.lower(strip(F.col("source")))
    file = F.coalesce(F.col("file_path"), F.try_element_at("parts", F.lit(1))["file_path"])
    above = F.regexp_extract(F.coalesce(file, F.lit("")), r"([^/]+)/[^/]*/[^/]*$", 1)
    return F.when(own.isNull() | (own == ""), above).otherwise(own)


def with_next(entries: DataFrame) -> DataFrame:
    """Adds ``next_idx, next_split``: the next entry of the document (source, id) in the order (split, idx), null at its end.

    All entries are cut into ranges of (source, id, split, idx); the last of a range looks up the first of the
    next one.  So neither a document nor a split of one is ever ordered in one task, however many rows it has.
    """
    order = ["source", "id", "split", "idx"]
    # Written, so that a row stays in its range.
    ranged = cut(entries.select(*order).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranged = ranged.withColumn("_n", F.lead(F.struct(*order)).over(Window.partitionBy("_part").orderBy(*order)))
    # One row a range: as many as there are shuffle partitions.
    firsts = ranged.groupBy("_part").agg(F.min(F.struct(*order)).alias("_f"))
    after = firsts.select("_part", F.lead("_f").over(Window.orderBy("_part")).alias("_f"))
    both = ranged.join(F.broadcast(after), "_part").withColumn("_n", F.coalesce("_n", "_f"))
    same = (F.col("_n.source") == F.col("source")) & (F.col("_n.id") == F.col("id"))
    found = both.filter(same).select("source", "id", "idx", F.col("_n.idx").alias("next_idx"), F.col("_n.split").alias("next_split"))
    return entries.join(found, ["source", "id", "idx"], "left").select(*entries.columns, "next_idx", "next_split")


def pairs(entries: DataFrame) -> DataFrame:
    """``src_idx, tgt_idx``: neighbours of a document whose splits differ by exactly 1."""
    return with_next(entries).filter("next_split = split + 1").select(F.col("idx").alias("src_idx"), F.col("next_idx").alias("tgt_idx"))


def flagged(entries: DataFrame, previous: bool = False) -> DataFrame:
    """Adds ``has_next, has_prev, orphan``; with ``previous`` also ``prev_idx, prev_tokens`` of the predecessor, null where there is none."""
    own = with_next(entries).withColumn("has_next", F.coalesce(F.col("next_split") == F.col("split") + 1, F.lit(False)))
    before = [F.col("idx").alias("prev_idx"), F.col("tokens").alias("prev_tokens")] if previous else []
    targets = own.filter("has_next").select(F.col("next_idx").alias("idx"), F.lit(True).alias("has_prev"), *before)
    own = own.drop("next_idx", "next_split").join(targets, "idx", "left").withColumn("has_prev", F.coalesce("has_prev", F.lit(False)))
    return own.withColumn("orphan", ~(F.col("has_next") | F.col("has_prev")))


def source_stats(flags: DataFrame) -> DataFrame:
    """One row a source: entries, tokens, merged entries, entries with a predecessor, pairs, documents, mean chunks of the longer ones."""
    docs = flags.groupBy("source", "id").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum(F.col("parts").isNotNull().cast("int")).alias("m"),
        F.sum(F.col("has_prev").cast("int")).alias("p"), F.sum(F.col("has_next").cast("int")).alias("x"),
    )
    return docs.groupBy("source").agg(
        F.sum("n").alias("entries"), F.sum("t").alias("tokens"), F.sum("m").alias("merged"), F.sum("p").alias("has_prev"), F.sum("x").alias("pairs"),
        F.count("*").alias("docs"), F.sum((F.col("n") > 1).cast("int")).alias("multi_docs"),
        F.round(F.avg(F.when(F.col("n") > 1, F.col("n"))), 6).alias("mean_chunks"), F.round(F.sum("x") / F.sum("n"), 6).alias("next_share"),
    )


def upsample(entries: DataFrame, ratios: dict[str, int]) -> DataFrame:
    """Repeats the entries of a source; copy n >= 1 has ``__up{n}`` behind its id, so its pairs stay its own."""
    n = F.lit(1)
    for source, ratio in ratios.items():
        if ratio >= 2:
            n = F.when(F.col("source") == source, F.lit(ratio)).otherwise(n)
    copies = entries.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    return copies.withColumn("id", F.when(F.col("copy") > 0, F.concat("id", F.lit("__up"), F.col("copy"))).otherwise(F.col("id")))


def split_documents(docs: DataFrame, group: str, key: str, val: float, test: float, seed: str = "42", bits: int | None = None) -> DataFrame:
    """``group, key, part``: per group, the first max(1, n x val) documents in md5 order are val, the next n x test are test.

    ``docs`` has one row a document.  Ranks are distributed over buckets of bounded size (``bits`` of the hash,
    by the largest group unless given); a group with one document is val.
    """
    sizes = cut(docs.groupBy(group).agg(F.count("*").alias("_n")), "sizes")
    if bits is None:
        bits = bucket_bits(sizes.agg(F.max("_n")).first()[0] or 0)
    ranked = md5_rank(docs.select(group, key), [group], F.concat_ws("|", F.lit(seed), group, key), [key], "_r", bits).join(sizes, group)
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * val))
    n_test = F.least(F.floor(F.col("_n") * test), F.greatest(F.col("_n") - n_val, F.lit(0)))
    part = F.when(F.col("_r") <= n_val, "val").when(F.col("_r") <= n_val + n_test, "test").otherwise("train")
    return ranked.select(group, key, part.alias("part"))


def _next_starts(end: np.ndarray, begin: np.ndarray, cap: int) -> np.ndarray:
    """For a group that starts at row i, the first row of the next group (next-fit: items while the sum is within the cap)."""
    j = np.searchsorted(end, begin + cap, side="right")
    return np.maximum(j, np.arange(len(end)) + 1)


#: Blocks whose links one task follows.
FAN = 256


def next_fit(items: DataFrame, group: str, order: str, size: str, cap: int, width: int = 100_000, block: int = 256, fan: int = FAN) -> DataFrame:
    """Adds ``pack``: the ``order`` value of the first item of the container that next-fit puts a row into.

    Items of a group, in order, fill a container while their sum is within the cap.  Where a container
    begins depends on all before it, so it is resolved by blocks: from each row that can open a
    container near the beginning of a block, the block is walked to the row that opens a container in
    the next.  These links are composed over ``fan`` blocks at a time, level by level, until one task
    holds a group's; then the rows that open blocks are found level by level downwards, and each
    block assigns its rows.  A block spans ``block`` x cap of the running sum; no task holds more than a
    block or the links of ``fan`` blocks.  Sizes null or below 1 count 1.
    """
    # An item above the cap is alone however large it is.
    own = items.withColumn("_s", F.least(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(1)), F.lit(cap + 1)).cast("long"))
    own = running_sum_by(own, [group], F.floor(F.col(order) / width), [F.col(order)], F.col("_s"), "_end")
    own = own.withColumn("_begin", F.col("_end") - F.col("_s")).withColumn("_block", F.floor(F.col("_begin") / (block * cap)))
    own = cut(own, "nextfit")
    slim = own.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col("_begin").alias("b"), F.col("_end").alias("e"), F.col("_block").alias("k"))
    # Rows a container of the block before may still take belong to both blocks, and so does the first row after them.
    reach = slim.filter((F.col("k") > 0) & (F.col("b") <= F.col("k") * (block * cap) + cap + 1))
    both = slim.withColumn("at", F.col("k")).unionByName(reach.withColumn("at", F.col("k") - 1))
    kind = dict(slim.dtypes)["g"]
    link = f"g {kind}, k bigint, b bigint, to bigint"

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b", kind="stable")
        at, g = int(pdf["at"].iloc[0]), pdf["g"].iloc[0]
        b, e, k = pdf["b"].to_numpy(), pdf["e"].to_numpy(), pdf["k"].to_numpy()
        inside, n = k == at, len(b)
        # Each row's first row outside the block, by pointer doubling; n stands for the end.
        jump = np.append(np.where(inside, _next_starts(e, b, cap), np.arange(n)), n)
        while not np.array_equal(further := jump[jump], jump):
            jump = further
        opens = np.flatnonzero(inside & (b <= max(b[inside][0] if inside.any() else 0, at * block * cap + cap + 1)))
        to = jump[opens]
        return pd.DataFrame({"g": g, "k": at, "b": b[opens], "to": np.where(to < n, b[np.minimum(to, n - 1)], -1)})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        """From each row that can open the first of the blocks to the row that opens the block after the last."""
        go = dict(zip(pdf["b"].tolist(), pdf["to"].tolist()))
        starts = pdf.loc[pdf["k"] == pdf["k"].min(), "b"].tolist()
        out = []
        for b in starts:
            to = b
            while to in go:
                to = go[to]
            out.append(to)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "k": int(pdf["up"].iloc[0]), "b": starts, "to": out})

    def opened(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows that open the blocks, followed from the row that opens the first of them."""
        go, block_of = dict(zip(pdf["b"].tolist(), pdf["to"].tolist())), dict(zip(pdf["b"].tolist(), pdf["k"].tolist()))
        g, b, out = pdf["g"].iloc[0], int(pdf["entry"].iloc[0]), []
        while b in go:
            out.append((g, block_of[b], b))
            b = go[b]
        return pd.DataFrame(out, columns=["g", "k", "entry"])

    levels = [cut(both.groupBy("g", "at").applyInPandas(links, link), "links")]
    most = levels[0].agg(F.max("k")).first()[0] or 0
    while most >= fan:
        upper = levels[-1].withColumn("up", F.floor(F.col("k") / fan))
        levels.append(cut(upper.groupBy("g", "up").applyInPandas(composed, link), "links"))
        most //= fan
    entries = levels[-1].groupBy("g").agg(F.min("b").alias("entry")).withColumn("up", F.lit(0).cast("long"))
    for level in reversed(levels):
        # At the top all blocks of a group are one task's.
        own_links = level.withColumn("up", F.floor(F.col("k") / fan))
        entries = own_links.join(entries, ["g", "up"]).groupBy("g", "up").applyInPandas(opened, f"g {kind}, k bigint, entry bigint")
        entries = cut(entries, "entries").withColumnRenamed("k", "up")
    entries = entries.withColumnRenamed("up", "k")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b", kind="stable")
        b, e, entry = pdf["b"].to_numpy(), pdf["e"].to_numpy(), pdf["entry"].to_numpy()[0]
        go = _next_starts(e, b, cap)
        start = np.full(len(b), -1)
        i = int(np.searchsorted(b, entry)) if entry >= 0 else len(b)
        while i < len(b):
            start[i : go[i]] = i
            i = go[i]
        # Rows before the entry are in a container that the block before opened.
        o = pdf["o"].to_numpy()
        return pd.DataFrame({"g": pdf["g"], "o": o, "k": pdf["k"], "b": b, "first": np.where(start >= 0, o[np.maximum(start, 0)], -1)})

    known = slim.join(entries, ["g", "k"], "left").fillna({"entry": -1})
    done = cut(known.groupBy("g", "k").applyInPandas(assign, f"g {kind}, o bigint, k bigint, b bigint, first bigint"), "assigned")
    # A block is wider than a container, so each opens one, and its last may reach into the next block only.
    tail = done.filter("first >= 0").groupBy("g", "k").agg(F.max(F.struct("b", "first")).alias("t"))
    before = tail.select("g", (F.col("k") + 1).alias("k"), F.col("t.first").alias("before"))
    done = done.join(before, ["g", "k"], "left").withColumn("pack", F.when(F.col("first") >= 0, F.col("first")).otherwise(F.col("before")))
    done = done.select(F.col("g").alias(group), F.col("o").alias(order), "pack")
    return own.drop("_s", "_end", "_begin", "_block").join(done, [group, order])


def pack_orphans(flags: DataFrame, threshold: int = 2048, cap: int = 3500) -> DataFrame:
    """Short orphans merged by next-fit per source: ``idx, source, id, split, tokens, items``.

    ``flags`` as ``flagged`` gives them.  A merged entry has the idx of its first item, the id
    ``merged_{idx}``, split 0 and the sum of tokens; others stay as they are (items 1).
    """
    short = flags.filter(F.col("orphan") & (F.col("tokens") < threshold)).select("idx", "source", "id", "split", "tokens")
    rest = flags.filter(~(F.col("orphan") & (F.col("tokens") < threshold))).select("idx", "source", "id", "split", F.col("tokens").cast("long"), F.lit(1).cast("long").alias("items"))
    packed = next_fit(short, "source", "idx", "tokens", cap).groupBy("source", "pack").agg(
        F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.min("id").alias("id"), F.min("split").alias("split")
    )
    merged = F.col("items") > 1
    packed = packed.select(
        F.col("pack").alias("idx"), "source", F.when(merged, F.concat(F.lit("merged_"), F.col("pack"))).otherwise(F.col("id")).alias("id"),
        F.when(merged, 0).otherwise(F.col("split")).alias("split"), "tokens", "items",
    )
    return rest.unionByName(packed)


def task(idx: Column, has_prev: Column, epoch: int) -> Column:
    """Rotation of tasks: with a predecessor reconstruction and continuation, without next-token and reconstruction."""
    odd = F.pmod(idx + epoch, F.lit(2)) == 1
    return F.when(has_prev, F.when(odd, "continuation").otherwise("reconstruction")).otherwise(F.when(odd, "reconstruction").otherwise("ntp"))


def ends_text(task_: Column, merged: Column, has_next: Column) -> Column:
    """Whether a sample ends with the end sign: never if merged, always for reconstruction, else at the document's end."""
    return F.when(merged, False).when(task_ == "reconstruction", True).otherwise(~has_next)
