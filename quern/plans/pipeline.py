"""The whole way of a corpus: articles, novels and documents to chunks, neighbours and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fields as X
from quern.functions.text import whole_text
from quern.operators import articles as A
from quern.operators import chunk, dedup
from quern.operators import index as I
from quern.plans.article_queries import BEST, latest_articles, latest_comments, sql_article, sql_judged, sql_strip
from quern.plans.text_queries import CHARS, LEAST, NOVEL, sql_chunks
from quern.registry import Registry
from quern.session import cut
from quern.tables import table

R = Registry()
LEAST_SQL = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST.items()) + " ELSE 100 END"


def texts(spark, d):
    """``source, id, text``: articles that pass the rules, cleaned, with their best comments; novels of 4,000 characters under their titles; documents of enough characters."""
    passed = A.judged(latest_articles(spark, d), clean_all=False).filter("reason = 'passed'").withColumn("content", F.col("clean"))
    articles = A.article_texts(passed, latest_comments(spark, d)).select(F.lit("articles").alias("source"), F.col("cvid").cast("string").alias("id"), "text")
    novels = table(spark, d, "novels").filter("meta.id is not null").groupBy(F.col("meta.id").alias("id")).agg(F.min(F.struct(whole_text(F.col("texts")).alias("t"), F.col("meta.title").alias("title"))).alias("v"))
    novels = novels.filter(X.long_enough(F.col("v.t"), LEAST["novels"])).select(F.lit("novels").alias("source"), "id", X.with_title(F.col("v.title"), F.col("v.t"), always=True).alias("text"))
    least = F.lit(100)
    for k, v in LEAST.items():
        least = F.when(F.col("source") == k, v).otherwise(least)
    docs = table(spark, d, "documents").filter(X.long_enough(F.col("text"), 1) & (F.length("text") >= least))
    docs = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("string").alias("id"), "text")
    return articles.unionByName(novels).unionByName(docs)


@R.query(
    "corpus_pipeline",
    f"""WITH RECURSIVE {BEST}, {sql_judged('jc')}, {NOVEL.replace('min(t) AS t', 'min(t) AS t, min(title) AS title').replace('SELECT meta.id AS id,', 'SELECT meta.id AS id, meta.title AS title,')},
    p AS (SELECT * EXCLUDE (content) FROM j WHERE reason = 'passed'), ar AS ({sql_article('clean', 'p')}),
    tx AS (SELECT 'articles' AS source, CAST(cvid AS VARCHAR) AS id, x AS text FROM ar
      UNION ALL SELECT 'novels', id, CASE WHEN title IS NOT NULL AND title <> '' THEN title || chr(10) || chr(10) || t ELSE t END FROM n WHERE length(t) >= {LEAST['novels']} AND {sql_strip('t')} <> ''
      UNION ALL SELECT coalesce(source, ''), CAST(doc_id AS VARCHAR), text FROM documents WHERE text IS NOT NULL AND {sql_strip('text')} <> '' AND length(text) >= {LEAST_SQL}),
    f AS (SELECT min(source || '|' || id) AS k, text FROM tx GROUP BY text), {sql_chunks('f', 'k', CHARS)},
    ee AS (SELECT split_part(k, '|', 1) AS source, k, tokens, lead(split) OVER (PARTITION BY k ORDER BY split) IS NOT NULL AS has_next, split > 0 AS has_prev FROM ch),
    dd AS (SELECT source, k, count(*) AS n, sum(tokens) AS t, count(*) FILTER (has_prev) AS pr, count(*) FILTER (has_next) AS x FROM ee GROUP BY source, k)
    SELECT source, sum(n)::BIGINT AS entries, sum(t)::BIGINT AS tokens, 0 AS merged, sum(pr)::BIGINT AS has_prev, sum(x)::BIGINT AS pairs, count(*) AS docs, count(*) FILTER (n > 1) AS multi_docs,
      round(avg(n) FILTER (n > 1), 6) AS mean_chunks, round(sum(x) / sum(n), 6) AS next_share FROM dd GROUP BY source""",
)
def corpus_pipeline(spark, d):
    """Texts of all kinds, exact copies dropped, cut into chunks of 512 characters, neighbours paired, reported by source."""
    keyed = cut(texts(spark, d).withColumn("k", F.concat_ws("|", "source", "id")), "texts")
    first = dedup.exact_copies(keyed, "k", "text").filter("k = first").select("k")
    pieces = chunk.chunks(keyed.join(first, "k"), ["source", "id"], "text", chunk.CharTokenizer(), 512)
    # Numbers that are fixed with the table; only their order inside a document matters, and split decides that.
    entries = cut(pieces.drop("text").withColumn("idx", F.monotonically_increasing_id()), "entries")
    return I.source_stats(I.flagged(entries.withColumn("parts", F.lit(None).cast("array<struct<file_path:string,byte_offset:bigint>>"))))
