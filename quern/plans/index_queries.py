"""Queries over the chunk index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import index as I
from quern.registry import Registry
from quern.tables import table

R = Registry()
E = """e AS (SELECT idx, min(coalesce(source, '')) AS source, min(coalesce(id, '')) AS id, min(coalesce(split, 0)) AS split, min(coalesce(tokens, 0)) AS tokens, min(parts IS NOT NULL) AS merged
  FROM index_entries WHERE idx IS NOT NULL GROUP BY idx),
  l AS (SELECT *, lead(idx) OVER w AS n_idx, lead(split) OVER w AS n_split FROM e WINDOW w AS (PARTITION BY source, id ORDER BY split, idx)),
  p AS (SELECT idx AS src_idx, n_idx AS tgt_idx FROM l WHERE n_split = split + 1),
  f AS (SELECT e.*, x.src_idx IS NOT NULL AS has_next, y.tgt_idx IS NOT NULL AS has_prev FROM e LEFT JOIN p x ON x.src_idx = e.idx LEFT JOIN p y ON y.tgt_idx = e.idx)"""


def once(spark, d):
    return I.entries_once(table(spark, d, "index_entries"))


@R.query("continuation_pairs", f"WITH {E} SELECT * FROM p")
def continuation_pairs(spark, d):
    return I.pairs(once(spark, d))


@R.query("has_prev_next", f"WITH {E} SELECT idx, has_prev, has_next, NOT (has_prev OR has_next) AS orphan FROM f")
def has_prev_next(spark, d):
    return I.flagged(once(spark, d)).select("idx", "has_prev", "has_next", "orphan")


@R.query(
    "index_stats",
    f"""WITH {E}, d AS (SELECT source, id, count(*) AS n, sum(tokens) AS t, count(*) FILTER (merged) AS m, count(*) FILTER (has_prev) AS pr, count(*) FILTER (has_next) AS x FROM f GROUP BY source, id)
    SELECT source, sum(n)::BIGINT AS entries, sum(t)::BIGINT AS tokens, sum(m)::BIGINT AS merged, sum(pr)::BIGINT AS has_prev, sum(x)::BIGINT AS pairs, count(*) AS docs, count(*) FILTER (n > 1) AS multi_docs,
      round(avg(n) FILTER (n > 1), 6) AS mean_chunks, round(sum(x) / sum(n), 6) AS next_share FROM d GROUP BY source""",
)
def index_stats(spark, d):
    return I.source_stats(I.flagged(once(spark, d)))


@R.query(
    "upsample_source",
    f"""WITH {E} SELECT source, id || CASE WHEN c > 0 THEN '__up' || c ELSE '' END AS id, split, idx, c::INT AS copy FROM e, LATERAL (SELECT unnest(range(0, CASE source WHEN 'games' THEN 3 WHEN 'code' THEN 2 ELSE 1 END)) AS c)""",
)
def upsample_source(spark, d):
    return I.upsample(once(spark, d), {"games": 3, "code": 2, "math": 1}).select("source", "id", "split", "idx", "copy")


@R.query(
    "document_split",
    f"""WITH {E}, d AS (SELECT DISTINCT source, id FROM e), n AS (SELECT source, count(*) AS n, greatest(1, floor(count(*) * 0.02))::BIGINT AS v FROM d GROUP BY source),
    r AS (SELECT d.source, d.id, n.n, n.v, row_number() OVER (PARTITION BY d.source ORDER BY left(md5('42|' || d.source || '|' || d.id), 15), d.id) AS r FROM d JOIN n ON n.source = d.source)
    SELECT source, id, CASE WHEN r <= v THEN 'val' WHEN r <= v + least(floor(n * 0.02), greatest(n - v, 0)) THEN 'test' ELSE 'train' END AS part FROM r""",
)
def document_split(spark, d):
    return I.split_documents(once(spark, d).select("source", "id").distinct(), "source", "id", 0.02, 0.02)


@R.query("stratified_split_counts", f"WITH r AS ({R.sql['document_split']}) SELECT source, part, count(*) AS docs FROM r GROUP BY source, part")
def stratified_split_counts(spark, d):
    return document_split(spark, d).groupBy("source", "part").agg(F.count("*").alias("docs"))


@R.query(
    "pack_short_orphans",
    f"""WITH RECURSIVE {E}, o AS (SELECT idx, source, id, split, greatest(tokens, 1) AS s, tokens, row_number() OVER (PARTITION BY source ORDER BY idx) AS r FROM f WHERE NOT (has_prev OR has_next) AND tokens < 2048),
    g AS (SELECT source, r, idx, id, split, tokens, s AS used, idx AS pack FROM o WHERE r = 1
      UNION ALL SELECT o.source, o.r, o.idx, o.id, o.split, o.tokens, CASE WHEN g.used + o.s <= 3500 THEN g.used + o.s ELSE o.s END, CASE WHEN g.used + o.s <= 3500 THEN g.pack ELSE o.idx END FROM g JOIN o ON o.source = g.source AND o.r = g.r + 1),
    m AS (SELECT source, pack AS idx, count(*) AS items, sum(tokens)::BIGINT AS tokens, min(id) AS id, min(split) AS split FROM g GROUP BY source, pack)
    SELECT idx, source, CASE WHEN items > 1 THEN 'merged_' || idx ELSE id END AS id, CASE WHEN items > 1 THEN 0 ELSE split END AS split, tokens, items FROM m
    UNION ALL SELECT idx, source, id, split, tokens::BIGINT, 1 FROM f WHERE has_prev OR has_next OR tokens >= 2048""",
)
def pack_short_orphans(spark, d):
    return I.pack_orphans(I.flagged(once(spark, d)))


TASK = "CASE WHEN has_prev THEN CASE WHEN (idx + 1) % 2 = 1 THEN 'continuation' ELSE 'reconstruction' END ELSE CASE WHEN (idx + 1) % 2 = 1 THEN 'reconstruction' ELSE 'ntp' END END"


@R.query(
    "task_rotation",
    f"WITH {E}, t AS (SELECT *, {TASK} AS task FROM f) SELECT idx, task, CASE WHEN merged THEN false WHEN task = 'reconstruction' THEN true ELSE NOT has_next END AS eos FROM t",
)
def task_rotation(spark, d):
    own = I.flagged(once(spark, d)).withColumn("task", I.task(F.col("idx"), F.col("has_prev"), 1))
    return own.select("idx", "task", I.ends_text(F.col("task"), F.col("parts").isNotNull(), F.col("has_next")).alias("eos"))
