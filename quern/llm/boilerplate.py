"""Problem 3: lines repeated across one site's documents.

1.  Duplicate documents collapse: documents of a site with the same tidied pages are one cluster, and only
    one of them has its lines counted, with the number of the cluster's documents as weight.
2.  Each line is counted over distinct clusters.  By weight that counts documents, as ``found`` needs it.
    ``cleaned`` counts clusters and dates instead, and for it near copies (problem 2, across all sites) are
    one cluster as well: a republished work is one witness with one date, its first.
3.  Pages lose the lines found, each page for itself, by its site, document, key and text.

Lines are compared by a 64-bit hash of their tidied form within their site: 10^12 lines, each against some
thousand repeated lines of its site, give a false match with a probability below 10^-3.  Tidied: full-width
forms narrowed, lower case, white space removed, the document's own title and runs of digits replaced by signs.

Defined cases: null and empty pages have no lines but come out as they are; blank lines don't count and
stay; a null or ``Unknown`` title is not replaced; a null site is a site of its own; pages whose key is no
number count and are cleaned, and their places have a null number; documents without id count for no line
but are cleaned of their site's lines; repeated rows count and come out once; several versions of one page
are each cleaned for themselves; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import SPACE, narrow
from quern.llm import neardup
from quern.session import cut

MIN_DOCS = 4
MIN_SHARE = 0.2
#: Dates on which a line must occur for ``cleaned``, each cluster having one.
MIN_DATES = 2
TITLE_SIGN, DIGIT_SIGN = "\u0001", "\u0002"
#: Repeated lines (16 bytes each) that are broadcast at most; more are joined by shuffling.
BROADCAST_LINES = 1_000_000


def tidy(c: Column) -> Column:
    """Narrow, lower case, without white space but line ends."""
    return F.regexp_replace(F.lower(narrow(c)), f"[{SPACE}&&[^\\n]]+", "")


def line_hashes(page: Column, title: Column) -> Column:
    """Hash of each line of a page, null for blank lines."""
    own = F.when(title.isNull() | (title == "Unknown"), F.lit("")).otherwise(F.regexp_replace(tidy(title), "\\n", ""))
    text = tidy(page)
    text = F.when(own == "", text).otherwise(F.replace(text, own, F.lit(TITLE_SIGN)))
    lines = F.split(F.regexp_replace(text, "[0-9]+", DIGIT_SIGN), "\n", -1)
    return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x)))


def pages_of(novels: DataFrame) -> DataFrame:
    """``site, id, title, date, key, text`` of all pages of novels, null and empty ones too."""
    return novels.select(
        F.coalesce("site", F.lit("")).alias("site"),
        F.col("meta.id").alias("id"),
        F.col("meta.title").alias("title"),
        F.to_date("crawled_at").alias("date"),
        F.explode(F.map_entries("texts")).alias("_e"),
    ).select("site", "id", "title", "date", F.col("_e.key").alias("key"), F.col("_e.value.text").alias("text"))


def hashed(pages: DataFrame) -> DataFrame:
    """``site, id, date, key, version, lines`` of the pages that have text, written once and read by all passes.

    ``lines`` is an array of hashes; ``version`` tells apart several texts of one page.
    """
    own = pages.filter("text is not null and text <> ''")
    return cut(own.select("site", "id", "date", "key", F.xxhash64("text").alias("version"), line_hashes(F.col("text"), F.col("title")).alias("lines")), "lines")


def clusters(lines: DataFrame) -> DataFrame:
    """``site, id, cluster``: documents of a site with the same tidied pages are one cluster.

    A document's fingerprint (128 bits) is the exclusive or of the hashes of its pages, a partial aggregate,
    so no document is gathered in one place; repeated rows of a page count once.
    """
    once = lines.filter("id is not null").select("site", "id", *[F.xxhash64(F.lit(n), "key", "lines").alias(f"h{n}") for n in (1, 2)]).distinct()
    prints = once.groupBy("site", "id").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"))
    return prints.select("site", "id", F.struct("c1", "c2").alias("cluster"))


def collapsed(lines: DataFrame, of: DataFrame) -> DataFrame:
    """Adds ``cluster, weight`` to the lines of one document a cluster; those of its copies are left out.

    ``of`` as ``clusters`` gives it.  The document that stands for a cluster comes out of a partial
    aggregate, so a cluster of any number of copies is one row a task.
    """
    heads = of.groupBy("site", "cluster").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    return lines.join(heads, ["site", "id"])


def repeated(lines: DataFrame, near: DataFrame | None = None, by_cluster: bool = True, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_dates: int = 1) -> DataFrame:
    """``site, line, docs``: lines in at least ``min_docs`` and ``min_share`` of a site's clusters, on ``min_dates`` dates.

    With ``by_cluster`` off a cluster weighs as many documents as it has.  ``near`` (id, group) makes clusters
    of near copies.  A cluster has one date for a line, the first on which it shows it.
    """
    of = cut(clusters(lines), "clusters")
    first = lines.groupBy("site", "id").agg(F.min("date").alias("first"))
    if near is not None:
        if not by_cluster:
            raise ValueError("near copies have different lines, so they can't be counted by weight")
        of = of.join(near.select("id", "group").distinct(), "id", "left").withColumn("cluster", F.when(F.col("group").isNull(), F.col("cluster")).otherwise(F.struct(F.col("group").alias("c1"), F.lit(0).cast("long").alias("c2"))))
        own = lines.join(of.select("site", "id", "cluster"), ["site", "id"]).withColumn("weight", F.lit(1))
    else:
        own = collapsed(lines, of)
        # The copies are left out, but their dates aren't: a cluster's date is its first.
        first = of.join(first, ["site", "id"]).groupBy("site", "cluster").agg(F.min("first").alias("first"))
    each = F.count("*") if by_cluster else F.sum("weight")
    sizes = (of.select("site", "cluster").distinct() if by_cluster else of).groupBy("site").agg(F.count("*").alias("all"))
    seen = own.select("site", "cluster", "weight", "date", F.explode(F.array_distinct("lines")).alias("line")).filter("line is not null")
    seen = seen.groupBy("site", "line", "cluster").agg(F.max("weight").alias("weight"), F.min("date").alias("date"))
    if min_dates > 1 and near is None:
        seen = seen.drop("date").join(first.withColumnRenamed("first", "date"), ["site", "cluster"])
    counts = seen.groupBy("site", "line").agg(each.alias("docs")).filter(F.col("docs") >= min_docs)
    if min_dates > 1:
        dates = seen.select("site", "line", "date").distinct().groupBy("site", "line").agg(F.count("date").alias("dates"))
        counts = counts.join(dates.filter(F.col("dates") >= min_dates), ["site", "line"])
    return counts.join(sizes, "site").filter(F.col("docs") >= F.col("all") * min_share).select("site", "line", "docs")


def places(lines: DataFrame, bad: DataFrame) -> DataFrame:
    """``site, id, key, version, line_no`` of every place of a repeated line, each place once."""
    bad = cut(bad.select("site", "line"), "repeated")
    few = bad.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    at = lines.select("site", "id", "key", "version", F.posexplode("lines").alias("line_no", "line")).filter("line is not null")
    return at.join(F.broadcast(bad) if few else bad, ["site", "line"]).select("site", "id", "key", "version", "line_no").distinct()


def found(novels: DataFrame) -> DataFrame:
    """``id, page, line_no`` of repeated lines in novels; documents are told apart by meta.id, as the task defines it."""
    lines = hashed(pages_of(novels))
    at = places(lines, repeated(lines, by_cluster=False)).filter("id is not null")
    return at.select("id", F.col("key").try_cast("int").alias("page"), "line_no").distinct()


def cleaned(novels: DataFrame, min_dates: int = MIN_DATES) -> DataFrame:
    """``site, id, page, text`` of every page (STRING key) without the lines repeated over clusters and dates.

    A page of nothing else becomes empty.
    """
    pages = pages_of(novels)
    lines = hashed(pages)
    near = neardup.groups(neardup.novel_texts(novels)).select("id", "group")
    drop = places(lines, repeated(lines, cut(near, "near"), min_dates=min_dates))
    return without_places(pages, drop)


def without_places(pages: DataFrame, drop: DataFrame) -> DataFrame:
    """``site, id, page, text`` of ``pages`` (as ``pages_of`` gives them), each once, without the places of ``drop``."""
    # A null id or version is no key of an equi-join, so they get a sign of their own.
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_id", F.coalesce("id", F.lit(""))).withColumn("_no", F.col("id").isNull())

    numbers = keyed(drop).groupBy("site", "_id", "_no", "key", "version").agg(F.collect_set("line_no").alias("_drop"))
    own = keyed(pages.withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))).dropDuplicates(["site", "_id", "_no", "key", "version"])
    both = own.join(numbers, ["site", "_id", "_no", "key", "version"], "left").withColumn("_lines", F.split("text", "\n", -1))
    # The numbers that stay, by a hash set; then one look-up a line.
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("_lines"), i)), "\n")
    return both.select("site", "id", F.col("key").alias("page"), F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept).alias("text"))
