"""Exact and near duplicates of documents, and which of them to keep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fields as X
from quern.functions.text import strip
from quern.operators.components import components
from quern.operators.joins import skew_join
from quern.operators.tiles import BASE, band_keys, bands_for, bitmap, candidates, decided, mixed
from quern.session import cut
from quern.sources.readers import pages_map

SHINGLE = 5
THRESHOLD = 0.8
MARKERS = ["ISBN", "©", "(C)", "(c)"]


def exact_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, first, copies``: the smallest key with the same text (by md5) and how many share it; null texts are one text."""
    own = df.select(F.col(key).alias("k"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    heads = own.groupBy("h").agg(F.min("k").alias("first"), F.count("*").alias("copies"))
    return own.join(heads, "h").select(F.col("k").alias(key), "first", "copies")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order; empty for a null text."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(tokens, lambda x: F.xxhash64(x))


def runs_of(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of runs of words; all words are one run where there are fewer."""
    if not len(h):
        return np.zeros(0, np.uint64)
    own, n = mixed(h.view(np.uint64)), min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out = out * BASE + own[j : j + len(out)]
    return np.unique(mixed(out))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    column = batch.column(1)
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [runs_of(flat[a:b], words) for a, b in zip(ends[:-1], ends[1:])]


def _class_of(s: np.ndarray) -> int:
    """One number for a set."""
    return int(mixed((s * BASE + np.arange(len(s), dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def _classes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_class_of(s) for s in _sets(batch, words)], pa.int64())], ["k", "cls"])

    return run


def _sketch(bands: int, rows: int, words: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch, words)
            cls = [_class_of(s) for s in sets]
            cols = [batch.column(0), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            cols += [_lists([band_keys(s, bands, rows) for s in sets]), pa.array([bitmap(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["k", "cls", "n", "bands", "bits"])

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_class_of(s) for s in sets], pa.int64()), _lists(sets)], ["k", "own", "s"])

    return run


SKETCH = "k bigint, cls bigint, n int, bands array<bigint>, bits binary"


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``k, w``: key and word hashes of the texts that have words."""
    return df.select(F.col(key).alias("k"), word_hashes(F.col(text)).alias("w")).filter("k is not null and size(w) > 0")


def _elements(v: pa.Scalar) -> np.ndarray:
    return v.values.to_numpy(zero_copy_only=False).view(np.uint64)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct elements; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def near_copies(df: DataFrame, key: str, text: str, words: int = SHINGLE) -> DataFrame:
    """``key, first, copies``: the smallest key with the same set of runs of words and how many share it.

    All who share a set are at similarity 1, and each has the partners that ``near_pairs`` has for ``first``.
    Texts without words aren't here.
    """
    own = _keyed(df, key, text)
    own = cut(own.mapInArrow(_classes(words), f"k {dict(own.dtypes)['k']}, cls bigint"), "members")
    heads = own.groupBy("cls").agg(F.min("k").alias("first"), F.count("*").alias("copies"))
    return own.join(heads, "cls").select(F.col("k").alias(key), "first", "copies")


def near_classes(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, words: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``k, cls`` of every text, texts with equal sets of runs of words being one class, and
    ``a, b, ka, kb, sim`` of the pairs of classes (with their smallest keys) that reach the threshold.

    Members of a class have similarity 1 to one another and the links of their class.  Texts without
    words are of one class where they are equal but for white space around them, and have no links.
    """
    own = _keyed(df, key, text)
    kind = dict(own.dtypes)["k"]
    sketched = cut(own.mapInArrow(_sketch(*bands_for(threshold), words), SKETCH.replace("k bigint", f"k {kind}", 1)), "sketches")
    firsts = cut(sketched.groupBy("cls").agg(F.min("k").alias("k")), "firsts")
    once = cut(sketched.join(firsts, ["cls", "k"], "left_semi").dropDuplicates(["cls"]), "classes")
    pairs = cut(candidates(once, threshold), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    ids = cut(firsts.join(wanted, "cls"), "ids")
    sets = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(ids.select("k"), "k", "left_semi")
    # A key with several texts has several sets; the class tells which of them is meant.
    sets = sets.select("k", word_hashes(F.col("t")).alias("w")).mapInArrow(_set_rows(words), f"k {kind}, own bigint, s array<bigint>")
    sets = cut(sets.join(ids, "k").filter("own = cls").dropDuplicates(["cls"]).select("cls", F.col("s").alias("v")), "sets")
    near = decided(pairs, sets, threshold, _elements)
    a, b = (firsts.select(F.col("cls").alias(c), F.col("k").alias(f"k{c}")) for c in "ab")
    near = near.join(a, "a").join(b, "b").select("a", "b", "ka", "kb", "sim")
    bare = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter(r"k is not null and not t rlike r'[\p{L}\p{N}]'")
    return sketched.select("k", "cls").union(bare.select("k", F.xxhash64(strip(F.col("t"))))), cut(near, "near")


def near_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, words: int = SHINGLE) -> DataFrame:
    """``src, dst, sim`` (src < dst) of texts whose sets of runs of words reach the threshold.

    Texts with equal sets stand as one, by their smallest key (``near_copies`` tells who they are);
    texts without words have no partner.  A pair at the threshold shares no minhash band with
    probability 0.0001; what shares one is decided exactly, on the sets of the candidates alone.
    """
    _, near = near_classes(df, key, text, threshold, words)
    return near.select(F.least("ka", "kb").alias("src"), F.greatest("ka", "kb").alias("dst"), F.round("sim", 2).alias("sim"))


def marks_of(text: Column) -> Column:
    """How many of the markers of a complete book a text has."""
    return sum((F.coalesce(F.contains(text, F.lit(m)), F.lit(False)).cast("int") for m in MARKERS), F.lit(0))


def score_of(marks: Column, words: Column, most: Column) -> Column:
    """+1 for each marker, plus words against a quarter of the group's most (at least 1)."""
    return F.round(marks + F.when(words == 0, 0.0).otherwise(words / F.greatest(F.floor(most / 4), F.lit(1))), 9)


def marker_score(text: Column, words: Column, most: Column) -> Column:
    """``score_of`` a text."""
    return score_of(marks_of(text), words, most)


def best_of_group(df: DataFrame, group: str, order: str, text: str, words: Column) -> DataFrame:
    """``group, order`` of the best-scored row of each group, the first of equals."""
    own = df.select(group, order, F.col(text).alias("t"), words.alias("w"))
    most = own.groupBy(group).agg(F.max("w").alias("m"))
    scored = own.join(most, group).select(group, order, marker_score(F.col("t"), F.col("w"), F.col("m")).alias("s"))
    best = scored.groupBy(group).agg(F.max(F.struct("s", (-F.col(order)).alias("o"))).alias("b"))
    return best.select(group, (-F.col("b.o")).alias(order), F.col("b.s").alias("score"))


#: Edges of a component that one task decides; larger components are peeled by rounds first.
TASK_EDGES = 500_000


def _stars(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, center`` of nodes of ``edges`` (a, b): the greedy one-hop clusters in the order of the nodes; a node that isn't named is a center.

    A node becomes a center if all smaller neighbours went to other centers, else it goes to its smallest
    neighbour that is a center.  Rounds decide all nodes for which that is known already; what
    remains in components that one task can hold is decided there, in order.
    """
    # (a, b, open): a is undecided, b is undecided (open) or a center.
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    left = cut(both.withColumn("open", F.lit(True)), "stars")
    done = []

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        center: dict[int, int] = {}
        for a, b, is_open in zip(pdf["a"], pdf["b"], pdf["open"]):
            near.setdefault(a, []).append(b)
            if not is_open:
                center[b] = b
        given = set(center)
        for a in sorted(near):
            low = min((b for b in near[a] if b < a and center.get(b) == b), default=a)
            center[a] = low
        out = [(a, c) for a, c in center.items() if a not in given]
        return pd.DataFrame(out, columns=["node", "center"]).astype("int64")

    while True:
        roots = components(left.select("a", "b"))
        rooted = left.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        sizes = cut(rooted.groupBy("root").agg(F.count("*").alias("m")), "sizes")
        large = sizes.filter(F.col("m") > task_edges)
        small = rooted.join(F.broadcast(large.select("root")), "root", "left_anti")
        done.append(cut(small.groupBy("root").applyInPandas(decide, "node bigint, center bigint"), "decided"))
        # At most (edges / task_edges) components are large.
        if not large.limit(1).count():
            break
        left = cut(rooted.join(F.broadcast(large.select("root")), "root", "left_semi").drop("root"), "stars")
        lows = left.groupBy("a").agg(F.min(F.struct("b", "open")).alias("m"))
        known = lows.filter((F.col("a") < F.col("m.b")) | ~F.col("m.open"))
        known = cut(known.select(F.col("a").alias("node"), F.least("a", "m.b").alias("center")), "decided")
        done.append(known)
        rest = left.join(known.select(F.col("node").alias("a")), "a", "left_anti")
        to = known.select(F.col("node").alias("b"), (F.col("node") == F.col("center")).alias("_c"))
        rest = rest.join(to, "b", "left").filter("_c is null or _c").withColumn("open", F.col("open") & F.col("_c").isNull())
        left = cut(rest.select("a", "b", "open"), "stars")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def star_select(edges: DataFrame, nodes: DataFrame, members: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """``id, kept, cluster``: greedy selection in order of id, one hop.

    Each undecided document forms a cluster with its undecided neighbours; the best score (the first of
    equals) is kept and the others go.  ``nodes``: (id, marks, words), the score being marks and the words
    against a quarter of the cluster's most (``marker_score``); nulls are 0.  Nodes without edges are kept.

    ``members`` (id, cls) are documents that are linked to all others of their class; ``edges`` (src, dst) are
    then between classes.  A class is decided at once, with its first document, so it stands as one
    row however many documents it has.  Nodes without a class are clusters of their own.
    """
    own = nodes.select("id", F.coalesce("marks", F.lit(0)).alias("marks"), F.coalesce("words", F.lit(0)).alias("words"))
    of = own.select("id", F.col("id").alias("cls")) if members is None else members.select("id", "cls")
    heads = cut(of.groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("_w")), "heads")
    a, b = (heads.select(F.col("cls").alias(c), F.col("first").alias(n)) for c, n in (("src", "a"), ("dst", "b")))
    # Clusters are numbered by the first document of their center's class.
    ranks = edges.join(a, "src").join(b, "dst").select("a", "b")
    kind = dict(own.dtypes)["id"]
    if kind == "bigint":
        centers = _stars(ranks, task_edges)
    else:
        # Documents of another type are numbered in their order, those with edges alone.
        ends = ranks.select(F.col("a").alias("x")).union(ranks.select(F.col("b").alias("x"))).distinct()
        # A global sort's partitions are ranges in order, so these numbers follow it.
        numbered = cut(ends.orderBy("x").select("x", F.monotonically_increasing_id().alias("n")), "numbers")
        by = lambda c: numbered.select(F.col("x").alias(c), F.col("n").alias(f"n{c}"))
        centers = _stars(ranks.join(by("a"), "a").join(by("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")), task_edges)
        centers = centers.join(numbered.select(F.col("n").alias("node"), F.col("x").alias("xn")), "node").join(numbered.select(F.col("n").alias("center"), F.col("x").alias("xc")), "center")
        centers = centers.select(F.col("xn").alias("node"), F.col("xc").alias("center"))
    placed = heads.join(centers.withColumnRenamed("node", "first"), "first", "left").select("cls", F.coalesce("center", "first").alias("cluster"), "_w")
    in_cluster = skew_join(of, cut(placed, "placed"), "cls", "_w").groupBy("id").agg(F.min("cluster").alias("cluster"))
    scored = own.join(in_cluster, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    most = scored.groupBy("cluster").agg(F.max("words").alias("most"), F.count("*").alias("_w"))
    scored = skew_join(scored, cut(most, "most"), "cluster", "_w").withColumn("score", score_of(F.col("marks"), F.col("words"), F.col("most")))
    # Greatest score, then smallest id: the smallest of (-score, id).
    best = scored.groupBy("cluster").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return scored.select("id", "cluster").join(best.select(F.col("b.id").alias("id"), F.lit(True).alias("_k")), "id", "left").select("id", F.col("_k").isNotNull().alias("kept"), "cluster")


def bm25_scores(terms: DataFrame, pairs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``src, dst, score`` of each of the ``pairs`` (src, dst): BM25 both ways, the weights of either side multiplied term by term.

    ``terms``: (k, term, tf) of all documents, which give the statistics.  Pairs without a common term have
    0; only the given pairs are formed.
    """
    size = terms.groupBy("k").agg(F.sum("tf").alias("len"))
    whole = size.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df_ = terms.groupBy("term").agg(F.count("*").alias("df"))
    # `whole` is one row.
    weighted = terms.join(df_, "term").join(size, "k").crossJoin(F.broadcast(whole))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    weighted = weighted.select("k", "term", idf.alias("idf"), tf.alias("w"))
    src = weighted.select(F.col("k").alias("src"), "term", "idf", F.col("w").alias("ws"))
    dst = weighted.select(F.col("k").alias("dst"), "term", F.col("w").alias("wd"))
    once = pairs.select("src", "dst").distinct()
    got = once.join(src, "src").join(dst, ["dst", "term"]).groupBy("src", "dst").agg(F.round(F.sum(F.col("idf") * F.col("ws") * F.col("wd")), 6).alias("score"))
    return once.join(got, ["src", "dst"], "left").select("src", "dst", F.coalesce("score", F.lit(0.0)).alias("score"))


def survivors(docs: DataFrame, kept: DataFrame, titles: DataFrame, removed: tuple[str, ...] = (), mark: str = "[PAGE_SEP]") -> DataFrame:
    """``meta, texts`` of the documents (id, text) that stay: ``kept`` (id, kept) as ``star_select`` gives it.

    The literals ``removed`` are deleted, the language is that of the middle (Korean without Hangul being
    Chinese), pages are cut at the mark and their words counted; a title that ``titles`` (id, title) doesn't
    have is Unknown.
    """
    own = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).join(kept.filter("kept").select("id").distinct(), "id").dropDuplicates(["id"])
    text = F.col("text")
    for literal in removed:
        text = F.replace(text, F.lit(literal), F.lit(""))
    sample = X.middle(F.col("text"))
    own = own.withColumn("text", text).withColumn("pages", pages_map(F.col("text"), mark)).withColumn("lang", X.fix_language(X.script_language(sample), sample))
    own = own.join(titles.select("id", "title").dropDuplicates(["id"]), "id", "left")
    meta = F.struct(
        F.col("id").alias("id"), F.coalesce("title", F.lit("Unknown")).alias("title"), F.col("lang").alias("language"), F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("source_filename"),
        F.col("pages.total_words").alias("total_words"), F.col("pages.total_pages").alias("total_pages"),
    )
    return own.select(meta.alias("meta"), F.col("pages.texts").alias("texts"))


def first_by(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_r = 1").drop("_r")
