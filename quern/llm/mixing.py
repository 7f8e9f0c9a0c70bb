"""Problem 5: sources combined in target shares of the total size, small ones repeated up to a cap.

Every entry gets a hash-random key; within its source, entries in the order of that key get the
prefix sums of their tokens (distributed: the key's top bits cut a source into buckets); a source
gives whole epochs and then the entries whose prefix sum stays within what is left of its budget.

Budget: share x total, at most max_repeats x own tokens.  Whether a source is short comes out of the draw:
every entry was drawn as often as it may be, and what was reached is still below share x total.

Defined cases: null, 0 and negative tokens count 0 and such entries are not drawn; repeated rows (same idx)
count once; a target without entries is reported with 0 and is short; a source without target is not drawn
(but counts in the total); null shares, null or negative repeats are 0; of several targets of one source the
greatest share counts; an empty index gives an empty mix, in which nothing is short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.splits import entry_source, strip
from quern.operators.prefix import bucket_bits, running_sum
from quern.session import cut


def sized(entries: DataFrame) -> DataFrame:
    """``idx, source, tokens``, each idx once."""
    own = entries.filter("idx is not null").select(
        "idx", entry_source().alias("source"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens")
    )
    return own.groupBy("idx").agg(F.min(F.struct("source", "tokens")).alias("v")).select("idx", "v.source", "v.tokens")


def budgets(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: ``source, target_share, max_repeats, own, wish, budget, epochs, rest``.

    ``entries`` as ``sized`` gives them.  The sums are partial aggregates; one row a source remains.
    """
    own = entries.groupBy("source").agg(F.sum("tokens").alias("own"))
    total = own.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("total"))
    wanted = targets.select(
        F.lower(strip(F.col("source"))).alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("max_repeats"),
    )
    wanted = wanted.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("v")).select("source", "v.*")
    # `total` is one row.
    both = wanted.join(own, "source", "left").withColumn("own", F.coalesce("own", F.lit(0))).crossJoin(F.broadcast(total))
    wish = F.col("target_share") * F.col("total")
    cap = F.col("max_repeats") * F.col("own")
    return (
        both.withColumn("wish", wish)
        .withColumn("budget", F.least(F.floor(wish), cap).cast("long"))
        .withColumn("epochs", F.when(F.col("own") > 0, F.floor(F.col("budget") / F.greatest("own", F.lit(1)))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("own"))
    )


def mix(entries: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(drawn: ``idx, source, tokens, copies``; report: one row a target, with what was reached)."""
    own = cut(sized(entries), "sized")
    plan = cut(budgets(own, targets), "budgets")
    most = own.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    drawable = own.filter("tokens > 0").join(F.broadcast(plan.select("source").distinct()), "source", "left_semi") if _small(plan) else own.filter("tokens > 0")
    summed = running_sum(drawable, ["source"], ["idx"], F.col("tokens"), "upto", bucket_bits(most), seed)
    quota = plan.select("source", "epochs", "rest", "max_repeats")
    drawn = summed.join(F.broadcast(quota) if _small(plan) else quota, "source")
    drawn = drawn.withColumn("copies", F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("long"))
    drawn = cut(drawn.select("idx", "source", "tokens", "copies", (F.col("copies") < F.col("max_repeats")).alias("more")), "drawn")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.max("copies").alias("most_copies"), F.max("more").alias("more"))
    report = plan.join(got, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    report = report.withColumn("short", ~F.coalesce("more", F.lit(False)) & (F.col("reached") < F.col("wish")))
    whole = report.agg(F.sum("reached").alias("_all"))
    report = report.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "own", "budget", "reached", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(F.col("_all") > 0, F.col("reached") / F.col("_all")).otherwise(0.0).alias("share"), "short",
    )
    return drawn.filter("copies > 0").drop("more"), report


def _small(plan: DataFrame, rows: int = 10_000) -> bool:
    """Whether the targets are few enough to be broadcast; counted, not assumed."""
    return plan.limit(rows + 1).count() <= rows
