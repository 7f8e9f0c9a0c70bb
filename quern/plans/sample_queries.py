"""Queries that mix, sample, batch and report; joins over the star schema; streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quern.functions.text import is_blank
from quern.operators import batch as B
from quern.operators import chunk, dedup, joins, mix
from quern.operators import index as I
from quern.operators.articles import comment_edges
from quern.operators.prefix import running_sum_by
from quern.plans.article_queries import COMMENTS, JUDGED, LATEST, ROOTS, latest_articles, latest_comments, scores, sql_strip
from quern.plans.index_queries import TASK, once
from quern.plans.index_queries import E as ENTRIES
from quern.plans.text_queries import CHARS, sql_chunks
from quern.registry import Registry
from quern.session import cut, scratch
from quern.streaming import clean as S
from quern.tables import table

R = Registry()


@R.query("mix_shuffle_shards", "SELECT doc_id, place, (place - 1) // 500 AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY left(md5('42|' || doc_id), 15), doc_id) AS place FROM documents)")
def mix_shuffle_shards(spark, d):
    docs = mix.shuffled(table(spark, d, "documents").select("doc_id"), F.col("doc_id").cast("string"), ["doc_id"])
    return mix.shards(docs, "place", 500).select("doc_id", "place", "shard")


@R.query("bernoulli_val", "SELECT doc_id FROM documents WHERE ('0x' || left(md5('42|' || doc_id), 8))::BIGINT < 214748364")
def bernoulli_val(spark, d):
    return table(spark, d, "documents").filter(mix.hash_split(F.col("doc_id").cast("string"), 0.05)).select("doc_id")


@R.query("interleave", "SELECT doc_id, source, line, (line - 1) // 100 AS turn FROM (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS line FROM documents)")
def interleave(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return mix.interleaved(docs, "source", "doc_id", 100, 1000).select("doc_id", "source", "line", "turn")


@R.query("union_text", "SELECT origin, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'articles', content FROM articles UNION ALL SELECT 'comments', content FROM comments) GROUP BY origin")
def union_text(spark, d):
    parts = [("documents", table(spark, d, "documents"), "text"), ("articles", table(spark, d, "articles"), "content"), ("comments", table(spark, d, "comments"), "content")]
    return mix.union_text(parts).groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


TIER = "CASE WHEN p_retailprice > 1500 THEN 'a' WHEN p_retailprice > 1200 THEN 'b' WHEN p_retailprice > 1000 THEN 'c' ELSE 'd' END"


@R.query(
    "tiered_budget_sample",
    f"""WITH t AS (SELECT p_partkey, p_brand, {TIER} AS tier, p_size FROM part), u AS (SELECT *, sum(p_size) OVER (PARTITION BY p_brand, tier ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS used FROM t)
    SELECT p_partkey, p_brand, tier, used::BIGINT AS used FROM u WHERE used <= CASE tier WHEN 'a' THEN 200 WHEN 'b' THEN 200 ELSE 300 END""",
)
def tiered_budget_sample(spark, d):
    price = F.col("p_retailprice")
    tier = F.when(price > 1500, "a").when(price > 1200, "b").when(price > 1000, "c").otherwise("d")
    own = table(spark, d, "part").select("p_partkey", "p_brand", tier.alias("tier"), "p_size")
    quota = F.when(F.col("tier").isin("a", "b"), 200).otherwise(300)
    return mix.budget_sample(own, ["p_brand", "tier"], "p_partkey", F.col("p_size"), quota).select("p_partkey", "p_brand", "tier", "used")


#: Nine ranges with gaps between them.
RANGES = [(25_000 * n, 25_000 * n + 19_999, f"part{n}") for n in range(1, 10)]


@R.query("range_bucket_join", "SELECT o_orderkey, 'part' || (v // 25000) AS name FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders) WHERE v BETWEEN 25000 AND 249999 AND v % 25000 <= 19999")
def range_bucket_join(spark, d):
    ranges = spark.createDataFrame(RANGES, "lo bigint, hi bigint, name string")
    own = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("v"))
    return joins.range_join(own, "v", ranges, 50_000).select("o_orderkey", "name")


@R.query("scored_articles", "SELECT DISTINCT cvid FROM articles WHERE cvid IN (SELECT cvid FROM predictions)")
def scored_articles(spark, d):
    return table(spark, d, "articles").select("cvid").distinct().join(table(spark, d, "predictions"), "cvid", "left_semi")


@R.query("unscored_articles", "SELECT DISTINCT cvid FROM articles WHERE cvid IS NOT NULL AND cvid NOT IN (SELECT cvid FROM predictions WHERE cvid IS NOT NULL)")
def unscored_articles(spark, d):
    return table(spark, d, "articles").filter("cvid is not null").select("cvid").distinct().join(table(spark, d, "predictions"), "cvid", "left_anti")


@R.query("title_lookup", f"WITH a AS ({LATEST}), c AS ({COMMENTS}), n AS (SELECT DISTINCT meta.id AS id, meta.title AS title FROM novels) SELECT DISTINCT e.id, coalesce(n.title, 'Unknown') AS title FROM (SELECT DISTINCT id FROM index_entries WHERE source = 'novels' AND id IS NOT NULL) e LEFT JOIN n ON n.id = e.id")
def title_lookup(spark, d):
    return _titled(spark, d, F.col("source"))


def _titled(spark, d, source):
    ids = table(spark, d, "index_entries").filter((source == "novels") & F.col("id").isNotNull()).select("id").distinct()
    titles = table(spark, d, "novels").select(F.col("meta.id").alias("id"), F.col("meta.title").alias("title")).distinct()
    return ids.join(titles, "id", "left").select("id", F.coalesce("title", F.lit("Unknown")).alias("title")).distinct()


@R.query(
    "title_lookup_tidied",
    """WITH n AS (SELECT DISTINCT meta.id AS id, meta.title AS title FROM novels), e AS (SELECT DISTINCT id FROM index_entries WHERE id IS NOT NULL AND
      CASE WHEN source IS NULL OR trim(source) = '' THEN regexp_extract(coalesce(file_path, parts[1].file_path, ''), '([^/]+)/[^/]*/[^/]*$', 1) ELSE lower(trim(source)) END = 'novels')
    SELECT DISTINCT e.id, coalesce(n.title, 'Unknown') AS title FROM e LEFT JOIN n ON n.id = e.id""",
)
def title_lookup_tidied(spark, d):
    """Of every novel in the index, however its source is written."""
    return _titled(spark, d, I.tidy_source())


@R.query("keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500")
def keyset_page(spark, d):
    return joins.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 500)


TURNS = f"WITH {ROOTS}, v AS (SELECT parent_rpid AS k, rpos AS n, CASE WHEN rpos % 2 = 0 THEN 'user' ELSE 'assistant' END AS r, coalesce(content, '') AS t FROM replies)"


def turns(spark, d):
    _, replies = comment_edges(latest_articles(spark, d), latest_comments(spark, d))
    return replies.select(F.col("parent_rpid").alias("k"), F.col("rpos").alias("n"), F.when(F.col("rpos") % 2 == 0, "user").otherwise("assistant").alias("r"), F.col("content").alias("t"))


@R.query("chat_none", f"{TURNS} SELECT k, string_agg(t, chr(10) ORDER BY n) || chr(10) AS prompt FROM v GROUP BY k")
def chat_none(spark, d):
    return B.chat(turns(spark, d), "k", "n", "r", "t", "none")


@R.query("chat_chatml", f"{TURNS} SELECT k, string_agg('<|im_start|>' || r || chr(10) || t || '<|im_end|>', chr(10) ORDER BY n) || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM v GROUP BY k")
def chat_chatml(spark, d):
    return B.chat(turns(spark, d), "k", "n", "r", "t", "chatml")


@R.query("chat_simple", f"{TURNS} SELECT k, string_agg(CASE r WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || t, chr(10) ORDER BY n) || chr(10) || 'Assistant:' AS prompt FROM v GROUP BY k")
def chat_simple(spark, d):
    return B.chat(turns(spark, d), "k", "n", "r", "t", "simple")


@R.query(
    "few_shot",
    f"""WITH a AS ({LATEST}), q AS (SELECT cvid, coalesce(title, '') AS q, coalesce(category_name, '') AS l FROM a), s AS (SELECT * FROM q ORDER BY cvid LIMIT 2),
    p AS (SELECT string_agg(q || chr(10) || '答案：' || l, chr(10) || chr(10) ORDER BY cvid) AS p FROM s)
    SELECT q.cvid, p.p || chr(10) || chr(10) || q.q || chr(10) || '答案：' AS text, q.l AS label FROM q, p WHERE q.cvid NOT IN (SELECT cvid FROM s)""",
)
def few_shot(spark, d):
    own = latest_articles(spark, d).select("cvid", F.coalesce("title", F.lit("")).alias("q"), F.coalesce("category_name", F.lit("")).alias("l"))
    return B.few_shot(own, "cvid", "q", "l")


@R.query(
    "exact_match_accuracy",
    "WITH p AS (SELECT cvid, min(predict) AS predict FROM predictions GROUP BY cvid), s AS (SELECT regexp_extract(predict, '([0-9])\\s*,\\s*([0-9])', 1) AS a, regexp_extract(predict, '([0-9])\\s*,\\s*([0-9])', 2) AS b FROM p) "
    "SELECT round(avg(CASE WHEN a <> '' AND a = b THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s",
)
def exact_match_accuracy(spark, d):
    return scores(spark, d).agg(F.round(B.exact_match(F.col("quality"), F.col("domain")), 6).alias("accuracy"))


@R.query(
    "topk_topp_filter",
    """WITH v AS (SELECT vec_id, unnest(range(0, 64))::INT AS tok, unnest(embedding)::DOUBLE / 0.1 AS x FROM embeddings), k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM v),
    e AS (SELECT vec_id, tok, x, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM k WHERE r <= 10), q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS q FROM e),
    b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY vec_id ORDER BY x DESC, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q)
    SELECT vec_id, tok, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS prob FROM b WHERE b <= 0.8""",
)
def topk_topp_filter(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("tok", "x")).withColumn("x", F.col("x").cast("double"))
    return B.top_k_top_p(own, "vec_id", "tok", "x", 10, 0.8, 0.1)


@R.query("perplexity_by_group", "SELECT event_type, round(exp(least(avg(value / 50), 100)), 6) AS perplexity FROM events GROUP BY event_type")
def perplexity_by_group(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(B.perplexity(F.col("value") / 50), 6).alias("perplexity"))


@R.query("contribution_pct", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(100 * sum(value) / (SELECT sum(value) FROM events), 4) AS pct FROM events GROUP BY event_type")
def contribution_pct(spark, d):
    return B.contributions(table(spark, d, "events"), "event_type", "value")


@R.query("energy_share", "SELECT event_type, round(sum(value * value), 4) AS energy, round(sum(value * value) / (SELECT sum(value * value) FROM events), 6) AS share FROM events GROUP BY event_type")
def energy_share(spark, d):
    return B.energy_shares(table(spark, d, "events"), "event_type", "value")


@R.query("lr_schedule", "SELECT event_id, round(CASE WHEN event_id < 1000 THEN 0.0 WHEN event_id < 1500 THEN 0.001 * (event_id - 1000) / 500 ELSE 0.001 END, 9) AS lr FROM events")
def lr_schedule(spark, d):
    return table(spark, d, "events").select("event_id", F.round(B.learning_rate(F.col("event_id"), F.lit(0.001), 1000, 500), 9).alias("lr"))


#: Tokens of context and of target of a sample, as in training.
CONTEXT_MOST = TARGET_MOST = 4096


@R.query(
    "training_samples",
    f"""WITH {ENTRIES}, t AS (SELECT f.*, {TASK} AS task, p.src_idx FROM f LEFT JOIN p ON p.tgt_idx = f.idx), s AS (SELECT t.*, b.tokens AS src_tokens FROM t LEFT JOIN e b ON b.idx = t.src_idx),
    i AS (SELECT idx, task, src_idx, (CASE WHEN merged THEN false WHEN task = 'reconstruction' THEN true ELSE NOT has_next END)::INT AS eos, (task = 'reconstruction')::INT AS ae,
      greatest(tokens, 0) AS n, greatest(src_tokens, 0) AS m, idx % 40000 + 1 AS a, src_idx % 40000 + 1 AS b FROM s),
    c AS (SELECT *, CASE task WHEN 'reconstruction' THEN least(n, {CONTEXT_MOST}) WHEN 'continuation' THEN least(m, {CONTEXT_MOST}) ELSE 1 END AS context,
      CASE task WHEN 'reconstruction' THEN a WHEN 'continuation' THEN b ELSE 0 END AS c, least(n, {TARGET_MOST} - eos - ae) AS body FROM i)
    SELECT idx, task, CASE WHEN task = 'continuation' THEN src_idx END AS src_idx, context::INT AS context, (CASE WHEN context > 0 THEN c END)::INT AS context_first, (CASE WHEN context > 0 THEN c + context - 1 END)::INT AS context_last,
      (body + eos + ae)::INT AS inputs, (CASE WHEN ae = 1 THEN 50001 WHEN body > 0 THEN a WHEN eos = 1 THEN 50002 END)::INT AS input_first,
      (CASE WHEN eos = 1 THEN 50002 WHEN body > 0 THEN a + body - 1 WHEN ae = 1 THEN 50001 END)::INT AS input_last FROM c""",
)
def training_samples(spark, d):
    """Samples at the limits of training, from each entry's whole length and its true predecessor.

    The tables hold no texts of the entries, so the ids of an entry are a run of numbers that begins at
    its own place; nothing behind a limit is ever read, so the run ends there.
    """
    own = I.flagged(once(spark, d), previous=True).withColumn("task", I.task(F.col("idx"), F.col("has_prev"), 1))
    own = own.withColumn("eos", I.ends_text(F.col("task"), F.col("parts").isNotNull(), F.col("has_next")))

    def ids(idx, tokens):
        first = F.pmod(idx, F.lit(40000)).cast("int") + 1
        n = F.least(tokens.cast("int"), F.lit(max(CONTEXT_MOST, TARGET_MOST)))
        return F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))

    s = B.sample(F.col("task"), ids(F.col("idx"), F.col("tokens")), ids(F.col("prev_idx"), F.col("prev_tokens")), F.col("eos"), 50001, 50002, 0, TARGET_MOST, CONTEXT_MOST)
    context, inputs = F.col("s.context_ids"), F.col("s.input_ids")
    own = own.select("idx", "task", F.when(F.col("task") == "continuation", F.col("prev_idx")).alias("src_idx"), s.alias("s"))
    return own.select(
        "idx", "task", "src_idx", F.size(context).alias("context"), F.get(context, F.lit(0)).alias("context_first"), F.get(context, F.size(context) - 1).alias("context_last"),
        F.size(inputs).alias("inputs"), F.get(inputs, F.lit(0)).alias("input_first"), F.get(inputs, F.size(inputs) - 1).alias("input_last"),
    )


#: Sign of reconstruction, end and padding behind the code points.
AE, END, PAD = 1_114_112, 1_114_113, 1_114_114
IDS = "list_transform(range(1, length({0}) + 1), lambda i: unicode(substr({0}, i, 1)))"


@R.query(
    "training_texts",
    f"""WITH RECURSIVE {sql_chunks('documents', 'doc_id', CHARS)}, n AS (SELECT doc_id, split, text, row_number() OVER (ORDER BY doc_id, split) - 1 AS idx FROM ch),
    l AS (SELECT *, lead(split) OVER w IS NOT NULL AS has_next, split > 0 AS has_prev, lag(text) OVER w AS before FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY split)),
    t AS (SELECT *, {TASK} AS task FROM l), i AS (SELECT *, {IDS.format('text')} AS ids, CASE WHEN before IS NULL THEN [] ELSE {IDS.format('before')} END AS b, task = 'reconstruction' OR NOT has_next AS eos, task = 'reconstruction' AS rec FROM t),
    o AS (SELECT *, list_concat(ids[1:4096 - eos::INT - rec::INT], CASE WHEN eos THEN [{END}] ELSE [] END) AS body FROM i)
    SELECT doc_id, split, task, array_to_string(CASE task WHEN 'reconstruction' THEN ids[1:4096] WHEN 'continuation' THEN b[1:4096] ELSE [{PAD}] END, ' ') AS context,
      md5(array_to_string(CASE WHEN rec THEN list_concat([{AE}], body) ELSE body END, ' ')) AS inputs, md5(array_to_string(CASE WHEN rec THEN list_concat([-100], body) ELSE body END, ' ')) AS labels FROM o""",
)
def training_texts(spark, d):
    """Samples of the chunks of documents, with the predecessor's text as context; a token is a code point."""
    own = _chunked(table(spark, d, "documents").select("doc_id", F.lit("documents").alias("source"), "text"))
    flags = I.flagged(own, previous=True).withColumn("task", I.task(F.col("idx"), F.col("has_prev"), 1))
    flags = flags.withColumn("eos", I.ends_text(F.col("task"), F.col("parts").isNotNull(), F.col("has_next")))
    before = own.select(F.col("idx").alias("prev_idx"), F.col("text").alias("before"))
    both = flags.join(before, "prev_idx", "left")

    def ids(text):
        return F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda x: F.ascii(x))

    none = F.array().cast("array<int>")
    s = B.sample(F.col("task"), ids(F.col("text")), F.when(F.col("before").isNull(), none).otherwise(ids(F.col("before"))), F.col("eos"), AE, END, PAD, TARGET_MOST, CONTEXT_MOST)
    told = both.select(F.col("id").cast("bigint").alias("doc_id"), "split", "task", s.alias("s"))

    def line(c):
        return F.array_join(c, " ")

    return told.select("doc_id", "split", "task", line("s.context_ids").alias("context"), F.md5(line("s.input_ids")).alias("inputs"), F.md5(line("s.labels")).alias("labels"))


def _chunked(docs):
    """``idx, source, id, split, tokens, text, parts`` of chunks of 512 characters; idx counts them in the order of doc_id and split."""
    made = cut(chunk.chunks(docs, ["doc_id", "source"], "text", chunk.CharTokenizer(), 512), "chunks")
    sizes = made.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))
    upto = running_sum_by(sizes, ["_all"], F.floor(F.col("doc_id") / 100_000), [F.col("doc_id")], F.col("n"), "upto")
    return made.join(upto.select("doc_id", (F.col("upto") - F.col("n")).alias("_first")), "doc_id").select(
        (F.col("_first") + F.col("split")).alias("idx"), "source", F.col("doc_id").cast("string").alias("id"), "split", "tokens", "text",
        F.lit(None).cast("array<struct<file_path:string,byte_offset:bigint>>").alias("parts"),
    )


SLOTS = "('0x' || left(md5('42|' || {0}), 8))::BIGINT % 8 + 1"


@R.query(
    "memory_slots",
    f"WITH {ENTRIES}, t AS (SELECT *, {TASK} AS task FROM f) SELECT idx, task, CASE task WHEN 'ntp' THEN 0 ELSE {SLOTS.format('idx')} END AS slots, CASE task WHEN 'ntp' THEN 0 ELSE {SLOTS.format('(idx // 8)')} END AS batch_slots, task AS told FROM t",
)
def memory_slots(spark, d):
    """Memory slots of a sample by itself and by its batch of eight, and the task as it is told from slots and first id."""
    own = I.flagged(once(spark, d)).withColumn("task", I.task(F.col("idx"), F.col("has_prev"), 1))
    own = own.withColumn("slots", B.sample_slots(F.col("task"), F.col("idx"), 8)).withColumn("first", F.when(F.col("task") == "reconstruction", AE).otherwise(1))
    return own.select("idx", "task", "slots", B.sample_slots(F.col("task"), F.floor(F.col("idx") / 8), 8).alias("batch_slots"), B.task_of(F.col("slots"), F.col("first"), AE).alias("told"))


@R.query(
    "reply_jaccard",
    f"""WITH c AS ({COMMENTS}), w AS (SELECT rpid, parent, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS s FROM c)
    SELECT a.rpid, round(CASE WHEN len(a.s) + len(b.s) = 0 THEN 1 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 2) AS sim FROM w a JOIN w b ON b.rpid = a.parent""",
)
def reply_jaccard(spark, d):
    """Word sets of each reply and the comment it answers."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("content", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    own = latest_comments(spark, d).select("rpid", "parent", words.alias("s"))
    other = own.select(F.col("rpid").alias("parent"), F.col("s").alias("t"))
    return own.join(other, "parent").select("rpid", F.round(dedup.jaccard(F.col("s"), F.col("t")), 2).alias("sim"))


@R.query(
    "pad_collate",
    """WITH e AS (SELECT event_id, event_id // 8 AS b, (user_id % 7 + 1)::INT AS n FROM events), m AS (SELECT *, max(n) OVER (PARTITION BY b) AS w FROM e)
    SELECT event_id, array_to_string(list_concat(list_transform(range(0, w - n), lambda i: 0), range(1, n + 1)), ',') AS context_ids, array_to_string(list_concat(range(1, n + 1), list_transform(range(0, w - n), lambda i: -100)), ',') AS labels,
      repeat('0', (w - n)::INT) || repeat('1', n) AS context_mask FROM m""",
)
def pad_collate(spark, d):
    ids = F.sequence(F.lit(1), F.pmod("user_id", F.lit(7)).cast("int") + 1)
    own = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 8).alias("b"), ids.alias("context_ids"), ids.alias("input_ids"), ids.alias("labels"))
    out = B.pad_batch(own, "b", "context_ids", "input_ids", "labels", 0)
    return out.select("event_id", F.array_join("context_ids", ",").alias("context_ids"), F.array_join("labels", ",").alias("labels"), F.array_join("context_mask", "").alias("context_mask"))


@R.query("left_truncate", "SELECT event_id, array_to_string(range(greatest(user_id % 20 + 1 - 5, 0) + 1, user_id % 20 + 2), ',') AS ids FROM events")
def left_truncate(spark, d):
    ids = F.sequence(F.lit(1), (F.pmod("user_id", F.lit(20)) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.array_join(B.tail(ids, F.lit(5)), ",").alias("ids"))


def _stream(spark, d, name):
    """A table as a stream: its folder, or the folder of its one file."""
    at = f"{d}/{name}.parquet"
    schema = table(spark, d, name).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(at) if os.path.isdir(at) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@R.query("stream_windowed_counts", "SELECT date_trunc('hour', ts)::TIMESTAMPTZ AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    rows = S.windowed_counts(_stream(spark, d, "events"), "ts", "event_type", "value", delay="0 seconds")
    return S.drain(spark, rows, scratch(spark, "windows"), "complete").withColumn("total", F.round("total", 4))


@R.query("stream_clean", f"WITH {JUDGED.replace(LATEST, 'SELECT * FROM articles')} SELECT cvid, reason, length(clean) AS chars FROM j")
def stream_clean(spark, d):
    rows = S.cleaned_stream(_stream(spark, d, "articles")).select("cvid", "reason", F.length("clean").alias("chars"))
    return S.drain(spark, rows, scratch(spark, "stream"))


@R.query(
    "stream_first_seen",
    "SELECT DISTINCT event_type, date_trunc('day', ts)::TIMESTAMPTZ AS day FROM events",
)
def stream_first_seen(spark, d):
    """The first event of each type and day, within a watermark longer than the table."""
    rows = _stream(spark, d, "events").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp"))).withColumn("k", F.concat_ws("|", "event_type", F.col("day").cast("string")))
    return S.drain(spark, S.first_seen(rows, "ts", "k", "400 days"), scratch(spark, "seen")).select("event_type", "day")


@R.query(
    "corpus_report",
    f"""WITH RECURSIVE d0 AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL AND {sql_strip('text')} <> '' GROUP BY text), {sql_chunks('d0', 'doc_id', CHARS)},
    e AS (SELECT coalesce(t.source, '') AS source, ch.doc_id, ch.tokens, lead(split) OVER (PARTITION BY ch.doc_id ORDER BY split) IS NOT NULL AS has_next, split > 0 AS has_prev FROM ch JOIN documents t ON t.doc_id = ch.doc_id),
    d AS (SELECT source, doc_id, count(*) AS n, sum(tokens) AS t, count(*) FILTER (has_prev) AS pr, count(*) FILTER (has_next) AS x FROM e GROUP BY source, doc_id)
    SELECT source, sum(n)::BIGINT AS entries, sum(t)::BIGINT AS tokens, 0 AS merged, sum(pr)::BIGINT AS has_prev, sum(x)::BIGINT AS pairs, count(*) AS docs, count(*) FILTER (n > 1) AS multi_docs,
      round(avg(n) FILTER (n > 1), 6) AS mean_chunks, round(sum(x) / sum(n), 6) AS next_share FROM d GROUP BY source""",
)
def corpus_report(spark, d):
    docs = table(spark, d, "documents").filter(~is_blank(F.col("text")))
    first = dedup.exact_copies(docs, "doc_id", "text").filter("doc_id = first").select("doc_id")
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").join(first, "doc_id")
    return I.source_stats(I.flagged(_chunked(own).drop("text")))
