"""Problem 2: groups of texts that are the same but for small edits.

Similarity is the Jaccard index of the sets of character sequences (grams) of the tidied texts.

1.  Exact copies collapse into classes by a hash of the tidied text (128 bits decide); the rest works on classes.
2.  One pass over the texts gives each class its number of grams, a hashed bitmap of them, as wide as they
    are many, and its keys: minhash bands, of which a pair at the threshold 0.7 shares none with probability
    (1 - 0.7^4)^40 < 2e-5 and a pair at 0.8 with 1e-9, or, in the exact mode, the prefix of its
    sorted grams, of which a pair at the threshold shares at least one.
3.  Classes that share a key meet in size-banded tiles: each key is cut into bands of size and these into
    tiles of bounded size, and only tiles whose sizes can match are paired, so no task holds a whole hot
    key and none of its classes is dropped.
4.  Inside a tile, sizes and then bit counts bound the overlap from above: every bit that differs
    stands for a gram that only one of the two has.  Only pairs the bound lets through leave the tile.
5.  Those are decided by intersecting their sorted gram arrays.  Pairs are grouped by their busier class,
    whose text travels once for all its partners.

Defined cases: null or empty texts and texts shorter than a gram have no grams, no class and no partner;
repeated rows count once; a text of an id that has several texts counts for that id; rows without
id are left out; columns beyond the two aren't read; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import narrow, whole_text
from quern.operators.components import components
from quern.operators.joins import skew_join
from quern.operators.tiles import BASE, PARTNERS, TILE, band_keys, bitmap, candidates, decided, mixed, prefix_keys
from quern.session import cut

GRAM = 8
THRESHOLD = 0.7
BANDS, ROWS = 40, 4

def grams(text: str, k: int = GRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the sequences of k characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * BASE + points[i : i + n] + np.uint64(1)
    return np.unique(mixed(h))


def tidy(c: Column) -> Column:
    """Narrow, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(narrow(c)), r"[^\p{L}\p{N}]+", "")


def classed(docs: DataFrame) -> DataFrame:
    """``id, cls, also, text`` (tidied) of the documents (id, text); ``cls`` and ``also`` are hashes of the text."""
    own = docs.filter("id is not null").select("id", tidy(F.coalesce("text", F.lit(""))).alias("text"))
    return own.select("id", F.xxhash64("text").alias("cls"), F.xxhash64(F.lit(1), "text").alias("also"), "text")


def _sketch(threshold: float, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, maps = [], [], []
            for t in b.column("text"):
                g = grams(t.as_py())
                n.append(len(g))
                keys.append(prefix_keys(g, threshold) if exact else band_keys(g, BANDS, ROWS) if len(g) else np.zeros(0, dtype=np.int64))
                maps.append(bitmap(g))
            ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)))
            rest = [pa.array(n, pa.int32()), lists, pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "cls", "also", "row")] + rest, ["id", "cls", "also", "row", "n", "bands", "bits"])

    return run


def sketches(texts: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """``id, cls, also, row, n, bands, bits`` of each row of ``texts`` (as ``classed`` gives them); ``row`` names the row once it is written."""
    kind = texts.schema["id"].dataType.simpleString()
    own = texts.withColumn("row", F.monotonically_increasing_id())
    return own.mapInArrow(_sketch(threshold, exact), f"id {kind}, cls bigint, also bigint, row bigint, n int, bands array<bigint>, bits binary")


def settled(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, one row a class: ``cls, row``) with a class for each text: where two texts have one ``cls``, all their rows get another."""
    heads = sketched.filter("n > 0").groupBy("cls").agg(F.min("row").alias("row"), F.min("also").alias("lo"), F.max("also").alias("hi"))
    heads = cut(heads, "heads")
    clash = heads.filter("lo <> hi").select("cls", F.lit(True).alias("_x"))
    if not clash.limit(1).count():
        return sketched, heads.select("cls", "row")
    other = sketched.join(clash, "cls", "left").withColumn("cls", F.when(F.col("_x"), F.xxhash64("cls", "also")).otherwise(F.col("cls"))).drop("_x")
    return settled(cut(other.select(sketched.columns), "sketches"))


def _grams(v: pa.Scalar) -> np.ndarray:
    return grams(v.as_py())


def similar(docs: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links: ``a, b, sim`` of different classes; members: ``id, cls``, cls null without grams) of ``docs`` (id, text)."""
    sketched, heads = settled(cut(sketches(classed(docs), threshold, exact), "sketches"))
    members = sketched.select("id", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).distinct()
    # Rows that stand for no class are few, so the sketches needn't be shuffled to leave them out.
    rest = cut(sketched.select("row").join(heads.select("row"), "row", "left_anti"), "copies")
    once = sketched.join(rest, "row", "left_anti")
    pairs = cut(candidates(once.select("cls", "n", "bands", "bits"), threshold, tile), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    # One document stands for each class, so that only those texts are tidied again.  Written, so that Spark
    # knows the size and need not shuffle the documents for a short list.
    ids = cut(once.select("id", "row", "cls", "also").join(wanted, "cls"), "ids")
    ids = ids.select("id", F.col("cls").alias("of"), F.col("also").alias("_a"))
    texts = classed(docs.join(ids.select("id").distinct(), "id", "left_semi")).join(ids, "id").filter("also = _a").select(F.col("of").alias("cls"), "text")
    texts = cut(texts.dropDuplicates(["cls"]).select("cls", F.col("text").alias("v")), "texts")
    return cut(decided(pairs, texts, threshold, _grams), "links"), members


def _blocks(members: DataFrame) -> DataFrame:
    """``cls, s, t, id``: members of classes dealt to ``s`` blocks of about PARTNERS members each."""
    sizes = cut(members.groupBy("cls").agg(F.count("*").alias("_w"), F.ceil(F.count("*") / PARTNERS).cast("int").alias("s")), "sizes")
    return skew_join(members, sizes, "cls", "_w").withColumn("t", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))


def found(docs: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, exact: bool = False) -> DataFrame:
    """``id_a, id_b`` of all pairs of ids at or above the threshold, copies included.

    The pairs of a class, or of two, are made block by block, so that no task makes more than PARTNERS^2 of them.
    """
    links, members = similar(docs, threshold, tile, exact)
    own = cut(_blocks(members.filter("cls is not null")), "members")
    sizes = own.select("cls", "s").distinct()
    # A class with several members is linked to itself.
    loops = own.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    both = links.select("a", "b").unionByName(loops)
    both = both.join(sizes.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    both = both.withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("sa") - 1))).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)))
    both = both.filter("a <> b or ta <= tb").select("a", "ta", "b", "tb")
    x = own.select(F.col("cls").alias("a"), F.col("t").alias("ta"), F.col("id").alias("x"))
    y = own.select(F.col("cls").alias("b"), F.col("t").alias("tb"), F.col("id").alias("y"))
    return both.join(x, ["a", "ta"]).join(y, ["b", "tb"]).filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id, class, links, group`` of every document with an id.

    ``class``: the exact copies; ``links``: other classes at or above the threshold; ``group``: the
    smallest class reached over links.  A document without grams has neither class nor group, and 0 links.
    """
    links, members = similar(docs, threshold)
    ends = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    roots = components(links.select("a", "b")).select(F.col("node").alias("cls"), "root")
    linked = cut(ends.join(roots, "cls", "left"), "linked")
    linked = linked.join(members.groupBy("cls").agg(F.count("*").alias("_w")), "cls")
    own = members.join(linked.select("cls"), "cls", "left_anti").withColumns({"links": F.lit(0).cast("long"), "root": F.col("cls")})
    tied = skew_join(members, cut(linked, "weighed"), "cls", "_w").select("id", "cls", "links", F.coalesce("root", "cls").alias("root"))
    return own.select("id", "cls", "links", "root").unionByName(tied).select("id", F.col("cls").alias("class"), "links", F.col("root").alias("group"))


def novel_texts(novels: DataFrame) -> DataFrame:
    """``id, text`` of novels: the non-empty pages in numeric order."""
    return novels.select(F.col("meta.id").alias("id"), whole_text(F.col("texts"), "").alias("text"))
