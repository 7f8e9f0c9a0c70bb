"""Queries over documents and novels: fields, words, sentences, copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fields as X
from quern.functions.terms import STOP, terms
from quern.functions.text import is_blank, pages_in_order, whole_text
from quern.operators import chunk, dedup
from quern.operators.articles import BLOCKED, is_spam
from quern.operators.waterfall import first_failing
from quern.plans.article_queries import SPACE, latest_comments, sql_any, sql_strip
from quern.registry import Registry
from quern.sources.readers import pages_map
from quern.tables import table

R = Registry()
#: Words of lines that belong to a site and not to a book.
WATERMARKS = ["电子书搜索下载", "录入：", "24小时内删除", "公众号", "QQ", "微信", "如果你不知道读什么书", "免费电子书", "多看阅读器", "资源分享", "幻剑书盟", "轻之国度"]
LEAST = {"novels": 4000, "games": 1000, "general": 100, "math": 50, "code": 50, "moegirl": 50}


@R.query("title_prepend", f"SELECT doc_id, md5(CASE WHEN title IS NOT NULL AND title <> '' AND {sql_strip('split_part(text, chr(10), 1)')} <> title THEN title || chr(10) || chr(10) || text ELSE text END) AS h FROM documents")
def title_prepend(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.with_title(F.col("title"), F.col("text"))).alias("h"))


@R.query("doc_id_fallback", "SELECT doc_id, coalesce(nullif(title, ''), md5(text)) AS id FROM documents")
def doc_id_fallback(spark, d):
    return table(spark, d, "documents").select("doc_id", X.id_or_hash(F.col("title"), F.col("text")).alias("id"))


@R.query(
    "length_gate",
    f"SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND {sql_strip('text')} <> '' AND length(text) >= CASE source "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST.items())
    + " ELSE 100 END GROUP BY source",
)
def length_gate(spark, d):
    docs = table(spark, d, "documents")
    least = F.lit(100)
    for k, v in LEAST.items():
        least = F.when(F.col("source") == k, v).otherwise(least)
    return docs.filter(~is_blank(F.col("text")) & (F.length("text") >= least)).groupBy("source").agg(F.count("*").alias("n"))


@R.query(
    "document_waterfall",
    f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR {sql_strip('text')} = '' THEN 'blank' WHEN length(text) < 100 THEN 'short'
    WHEN length(text) - length(replace(text, chr(10), '')) > 0.05 * length(text) THEN 'high_newline' ELSE 'passed' END AS reason FROM documents) GROUP BY reason""",
)
def document_waterfall(spark, d):
    n = F.length("text")
    rules = [
        ("blank", is_blank(F.col("text"))),
        ("short", n < 100),
        ("high_newline", n - F.length(F.replace("text", F.lit("\n"), F.lit(""))) > 0.05 * n),
    ]
    return table(spark, d, "documents").select(first_failing(rules).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@R.query(
    "word_count_mixed_script",
    r"""SELECT doc_id, coalesce(len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Nl}_]+'), lambda w: regexp_full_match(w, '\p{Latin}+')))
    + length(regexp_replace(text, '[^\p{Han}\p{Hiragana}\p{Katakana}]', '', 'g')), 0) AS words FROM documents""",
)
def word_count_mixed_script(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_words(F.col("text")).cast("bigint").alias("words"))


NOVEL = """n AS (SELECT id, min(t) AS t FROM (SELECT meta.id AS id, array_to_string(list_transform(list_sort(list_transform(list_filter(map_entries(texts), lambda e: e.value.text IS NOT NULL AND e.value.text <> ''),
  lambda e: {'o': CAST(e.key AS INTEGER), 't': e.value.text})), lambda e: e.t), chr(10) || chr(10)) AS t FROM novels WHERE meta.id IS NOT NULL) GROUP BY id)"""


@R.query("novel_text", f"WITH {NOVEL} SELECT id, length(t) AS chars, md5(t) AS h FROM n")
def novel_text(spark, d):
    own = table(spark, d, "novels").filter("meta.id is not null").groupBy(F.col("meta.id").alias("id")).agg(F.min(whole_text(F.col("texts"))).alias("t"))
    return own.select("id", F.length("t").alias("chars"), F.md5("t").alias("h"))


@R.query(
    "language_fix",
    r"""SELECT doc_id, CASE WHEN lang = 'ko' AND NOT regexp_matches(s, '\p{Hangul}') THEN 'zh' ELSE lang END AS lang FROM
    (SELECT doc_id, lang, CASE WHEN length(text) > 2000 THEN substr(text, length(text) // 2 + 1, 2000) ELSE text END AS s FROM documents)""",
)
def language_fix(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fix_language(F.col("lang"), X.middle(F.col("text"))).alias("lang"))


@R.query("sentence_counts", "SELECT doc_id, len(regexp_extract_all(text, '[^。！？…；!?;.\n]*[。！？…；!?;.\n]|[^。！？…；!?;.\n]+')) AS n FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(chunk.sentence_array(F.col("text"))).alias("n"))


@R.query("exact_copies", "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first, count(*) OVER (PARTITION BY coalesce(text, '')) AS copies FROM documents")
def exact_copies(spark, d):
    return dedup.exact_copies(table(spark, d, "documents"), "doc_id", "text")


@R.query(
    "marked_lines",
    "WITH w AS (SELECT doc_id, text, regexp_matches(text, '" + "|".join(WATERMARKS) + "') AS hit FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, md5(CASE WHEN length(text) < 1024 AND hit THEN NULL ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), "
    "lambda x: CASE WHEN regexp_matches(x, '" + "|".join(WATERMARKS) + "') THEN nullif(regexp_extract(x, '第[零一二三四五六七八九十]+章.*$'), '') ELSE x END), lambda x: x IS NOT NULL), chr(10)) END) AS h FROM w",
)
def marked_lines(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(X.without_marked_lines(F.col("text"), WATERMARKS)).alias("h"))


@R.query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@R.query(
    "wiki_format",
    """SELECT doc_id, md5('URL: https://wiki.example/' || replace(title, ' ', '_') || chr(10) || chr(10) || title || chr(10) || chr(10) || text) AS h
    FROM documents WHERE source = 'moegirl' AND title IS NOT NULL AND text IS NOT NULL AND NOT starts_with(text, '#重定向 [[')""",
)
def wiki_format(spark, d):
    docs = table(spark, d, "documents").filter("source = 'moegirl'")
    page = X.wiki_page(F.concat(F.lit("[wiki]"), F.col("title")), F.col("text"), "https://wiki.example/")
    return docs.select("doc_id", page.alias("p")).filter("p is not null").select("doc_id", F.md5("p").alias("h"))


@R.query("qa_format", "SELECT event_id, 'URL: ' || coalesce(json_extract_string(props, '$.url'), '') || chr(10) || chr(10) || event_type || chr(10) || chr(10) || CAST(user_id AS VARCHAR) AS text FROM events")
def qa_format(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", X.question_answer(F.col("event_type"), F.col("user_id").cast("string"), F.col("props")).alias("text"))


@R.query(
    "path_fields",
    r"""WITH p AS (SELECT DISTINCT regexp_replace(file_path, '^/corpus/', '') AS path FROM index_entries WHERE file_path IS NOT NULL UNION SELECT DISTINCT regexp_extract(file_path, '[^/]+$') FROM index_entries WHERE file_path IS NOT NULL),
    q AS (SELECT path, string_split(path, '/') AS l, regexp_replace(regexp_extract(path, '[^/]+$'), '\.[^.]*$', '') AS stem FROM p),
    c AS (SELECT *, split_part(l[2], '@', 1) AS game, regexp_replace(split_part(stem, '@', 1), '(_zh|_cn|_f)+$', '', 'i') AS chapter FROM q)
    SELECT path, CASE WHEN len(l) >= 2 THEN game || ' - ' || chapter ELSE replace(stem, '_', ' ') END AS title,
      CASE WHEN len(l) >= 2 THEN regexp_replace(l[1] || '_' || game || '_' || chapter, '[^\p{L}\p{N}_\-]', '_', 'g') ELSE stem END AS id FROM c""",
)
def path_fields(spark, d):
    """Paths below the corpus folder, and lone files."""
    files = table(spark, d, "index_entries").filter("file_path is not null").select("file_path").distinct()
    paths = files.select(F.regexp_replace("file_path", "^/corpus/", "").alias("path")).union(files.select(F.regexp_extract("file_path", "[^/]+$", 0))).distinct()
    f = X.path_fields(F.col("path"))
    return paths.select("path", f["title"].alias("title"), f["id"].alias("id"))


def sql_runs(key: str, text: str, docs: str) -> str:
    """CTEs for pairs of texts of the table ``docs`` by runs of five words, texts with the same runs standing as one."""
    return f"""w AS (SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {docs} WHERE {text} IS NOT NULL),
  s AS (SELECT {key}, list_sort(list_distinct(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: array_to_string(t[i:i+4], ' ')))) AS s FROM w WHERE len(t) > 0),
  one AS (SELECT min({key}) AS k, s FROM s GROUP BY s), u AS (SELECT k, unnest(s) AS x FROM one),
  n AS (SELECT k, len(s) AS n FROM one), bb AS (SELECT a.k AS src, b.k AS dst, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2)"""


RUNS = sql_runs("doc_id", "text", "documents")
NEAR = "SELECT src, dst, round(c / (x.n + y.n - c), 2) AS sim FROM bb JOIN n x ON x.k = src JOIN n y ON y.k = dst WHERE c / (x.n + y.n - c) >= 0.8"


@R.query("near_pairs", f"WITH {RUNS} {NEAR}")
def near_pairs(spark, d):
    return dedup.near_pairs(table(spark, d, "documents"), "doc_id", "text")


@R.query("near_copies", f"WITH {RUNS} SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS first, count(*) OVER (PARTITION BY s) AS copies FROM s")
def near_copies(spark, d):
    return dedup.near_copies(table(spark, d, "documents"), "doc_id", "text")


@R.query("near_pairs_novels", f"WITH {NOVEL.replace('n AS (', 'n0 AS (', 1)}, {sql_runs('id', 't', 'n0')} {NEAR}")
def near_pairs_novels(spark, d):
    return dedup.near_pairs(novels_once(spark, d), "id", "t")


def novels_once(spark, d):
    own = table(spark, d, "novels").filter("meta.id is not null")
    return own.groupBy(F.col("meta.id").alias("id")).agg(F.min(whole_text(F.col("texts"))).alias("t"), F.min("meta.title").alias("title"))


WORDS = R.sql["word_count_mixed_script"]


def sql_star(docs: str) -> str:
    """CTEs that end in ``sel`` (k, cluster, kept): the greedy selection among the table ``docs`` (k, t), document by document."""
    marks = " + ".join(f"contains(coalesce(t, ''), '{m}')::INT" for m in dedup.MARKERS)
    words = r"coalesce(len(list_filter(regexp_extract_all(t, '[\p{L}\p{M}\p{Nd}\p{Nl}_]+'), lambda w: regexp_full_match(w, '\p{Latin}+'))) + length(regexp_replace(t, '[^\p{Han}\p{Hiragana}\p{Katakana}]', '', 'g')), 0)"
    return f"""sw AS (SELECT k, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS l FROM {docs} WHERE t IS NOT NULL),
    ss AS (SELECT k, list_distinct(list_transform(range(1, greatest(len(l) - 4, 1) + 1), lambda i: array_to_string(l[i:i+4], ' '))) AS s FROM sw WHERE len(l) > 0),
    su AS (SELECT k, unnest(s) AS x, len(s) AS n FROM ss), sb AS (SELECT a.k AS a, b.k AS b, count(*) AS c, min(a.n) AS an, min(b.n) AS bn FROM su a JOIN su b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2),
    s0 AS (SELECT k, {sql_strip("coalesce(t, '')")} AS t FROM {docs} WHERE NOT regexp_matches(coalesce(t, ''), '[\\p{{L}}\\p{{N}}]')),
    se AS (SELECT a, b FROM sb WHERE c / (an + bn - c) >= 0.8 UNION ALL SELECT p.k, q.k FROM s0 p JOIN s0 q ON q.t = p.t AND p.k <> q.k),
    sn AS MATERIALIZED (SELECT a AS k, list(b) AS near, row_number() OVER (ORDER BY a) AS r FROM se GROUP BY a),
    sg AS (SELECT 0::BIGINT AS r, []::STRUCT(k VARCHAR, c VARCHAR)[] AS got, []::VARCHAR[] AS taken
      UNION ALL SELECT sn.r, CASE WHEN list_contains(taken, sn.k::VARCHAR) THEN [] ELSE list_transform(list_filter(list_concat([sn.k], near), lambda x: NOT list_contains(taken, x::VARCHAR)), lambda x: {{'k': x::VARCHAR, 'c': sn.k::VARCHAR}}) END,
        CASE WHEN list_contains(taken, sn.k::VARCHAR) THEN taken ELSE list_concat(taken, list_transform(list_filter(list_concat([sn.k], near), lambda x: NOT list_contains(taken, x::VARCHAR)), lambda x: x::VARCHAR)) END FROM sg JOIN sn ON sn.r = sg.r + 1),
    sp AS (SELECT p.k, p.c FROM (SELECT unnest(got) AS p FROM sg)),
    sc AS (SELECT d.k, coalesce(p.c, d.k::VARCHAR) AS cluster, {marks} AS m, {words} AS w FROM {docs} d LEFT JOIN sp p ON p.k = d.k::VARCHAR),
    sel AS (SELECT k, cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(m + CASE WHEN w = 0 THEN 0 ELSE w / greatest(top // 4, 1) END, 9) DESC, k) = 1 AS kept FROM (SELECT *, max(w) OVER (PARTITION BY cluster) AS top FROM sc))"""


@R.query("dedup_star_select", f"WITH RECURSIVE sd AS (SELECT doc_id AS k, text AS t FROM documents), {sql_star('sd')} SELECT k AS doc_id, cluster::BIGINT AS cluster, kept FROM sel")
def dedup_star_select(spark, d):
    return _selected(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "cluster", "kept")


def _selected(docs, key, text):
    members, near = dedup.near_classes(docs, key, text)
    nodes = docs.select(F.col(key).alias("id"), dedup.marks_of(F.col(text)).alias("marks"), X.count_words(F.col(text)).alias("words"))
    return dedup.star_select(near.select(F.col("a").alias("src"), F.col("b").alias("dst")), nodes, members.withColumnRenamed("k", "id"))


SURVIVOR_LANG = r"""CASE WHEN s IS NULL OR greatest(ko, ja + zh, en) = 0 OR en = greatest(ko, ja + zh, en) THEN 'en' WHEN ko = greatest(ko, ja + zh, en) THEN CASE WHEN ko = 0 THEN 'zh' ELSE 'ko' END WHEN ja * 10 > ja + zh THEN 'ja' ELSE 'zh' END"""


def sql_script(x: str) -> str:
    """Counts of the letters of four scripts."""
    def n(p: str) -> str:
        return f"length(regexp_replace({x}, '[^{p}]', '', 'g'))"

    return f"{n(chr(92) + 'p{Hangul}')} AS ko, {n(chr(92) + 'p{Hiragana}' + chr(92) + 'p{Katakana}')} AS ja, {n(chr(92) + 'p{Han}')} AS zh, {n(chr(92) + 'p{Latin}')} AS en"


@R.query(
    "dedup_survivors",
    f"""WITH RECURSIVE {NOVEL.replace('min(t) AS t', 'min(t) AS t, min(title) AS title').replace('SELECT meta.id AS id,', 'SELECT meta.id AS id, meta.title AS title,')}, sd AS (SELECT id AS k, t FROM n), {sql_star('sd')},
    v AS (SELECT id, title, replace(t, chr(13) || chr(10), chr(10)) AS t FROM n JOIN sel ON sel.k = n.id AND sel.kept),
    x AS (SELECT *, CASE WHEN length(t) > 2000 THEN substr(t, length(t) // 2 + 1, 2000) ELSE t END AS s FROM v), y AS (SELECT *, {sql_script('s')} FROM x)
    SELECT id, coalesce(title, 'Unknown') AS title, {SURVIVOR_LANG} AS language, id || '.txt' AS source_filename, 1 AS total_pages, length(t) AS chars, md5({sql_strip('t')}) AS h FROM y""",
)
def dedup_survivors(spark, d):
    """The novels that stay, as documents with metadata, carriage returns before line feeds deleted."""
    own = novels_once(spark, d)
    kept = _selected(own, "id", "t").select("id", "kept")
    out = dedup.survivors(own.select("id", F.replace("t", F.lit("\r\n"), F.lit("\n")).alias("text")), kept, own.select("id", "title"))
    body = F.element_at("texts", "0")["text"]
    chars = own.select(F.col("id").alias("key"), F.length(F.replace("t", F.lit("\r\n"), F.lit("\n"))).alias("chars"))
    out = out.select("meta.*", F.md5(body).alias("h")).join(chars, F.col("id") == F.col("key"))
    return out.select("id", "title", "language", "source_filename", "total_pages", "chars", "h")


@R.query(
    "bm25_replies",
    """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rpid ORDER BY publish_time DESC NULLS LAST, likes DESC NULLS LAST) AS rn_ FROM comments WHERE rpid IS NOT NULL) WHERE rn_ = 1),
    t AS (SELECT rpid AS k, term, count(*) AS tf FROM (SELECT rpid, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM c) GROUP BY 1, 2),
    z AS (SELECT k, sum(tf) AS len FROM t GROUP BY k), g AS (SELECT count(*) AS n, avg(len) AS mean FROM z), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    w AS (SELECT t.k, t.term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) AS w FROM t JOIN z ON z.k = t.k JOIN f ON f.term = t.term, g),
    p AS (SELECT c.rpid AS src, c.parent AS dst FROM c WHERE c.parent <> 0)
    SELECT p.src, p.dst, coalesce(round(s, 6), 0) AS score FROM p LEFT JOIN (SELECT p.src, p.dst, sum(a.idf * a.w * b.w) AS s FROM p JOIN w a ON a.k = p.src JOIN w b ON b.k = p.dst AND b.term = a.term GROUP BY 1, 2) x ON x.src = p.src AND x.dst = p.dst""",
)
def bm25_replies(spark, d):
    """Each reply against the comment it answers."""
    own = latest_comments(spark, d)
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    terms = own.select(F.col("rpid").alias("k"), F.explode(words).alias("term")).groupBy("k", "term").agg(F.count("*").alias("tf"))
    return dedup.bm25_scores(terms, own.filter("parent <> 0").select(F.col("rpid").alias("src"), F.col("parent").alias("dst")))


BOOK_MOST, BOOK_LEAST = 1024, 512


@R.query(
    "book_samples",
    f"""WITH RECURSIVE p AS (SELECT DISTINCT meta.id AS id, coalesce(meta.title, '') AS title, CAST(e.key AS INTEGER) AS page, e.value.text AS t FROM (SELECT meta, unnest(map_entries(texts)) AS e FROM novels WHERE meta.id IS NOT NULL) WHERE e.value.text IS NOT NULL AND e.value.text <> ''),
    l AS (SELECT id, title, page, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i, false AS stop FROM p UNION ALL SELECT id, title, page, '', 1000000000, true FROM p),
    o AS (SELECT *, length(x) AS c, length(title) + 2 AS base, row_number() OVER (PARTITION BY id ORDER BY page, i) AS r FROM l),
    g AS (SELECT id, 0::BIGINT AS r, min(base) AS n, 0 AS sample, 0 AS held, false AS used FROM o GROUP BY id
      UNION ALL SELECT o.id, o.r,
        CASE WHEN o.stop THEN CASE WHEN g.n >= {BOOK_LEAST} AND held > 0 THEN base ELSE g.n END WHEN held > 0 AND g.n + c > {BOOK_MOST} THEN base + c ELSE g.n + c END,
        CASE WHEN o.stop THEN sample + (g.n >= {BOOK_LEAST} AND held > 0)::INT ELSE sample + (held > 0 AND g.n + c > {BOOK_MOST})::INT END,
        CASE WHEN o.stop THEN CASE WHEN g.n >= {BOOK_LEAST} THEN 0 WHEN held > 0 THEN held + 1 ELSE 0 END ELSE CASE WHEN held > 0 AND g.n + c > {BOOK_MOST} THEN 0 ELSE held END + (c > 0)::INT END,
        CASE WHEN o.stop THEN g.n < {BOOK_LEAST} AND held > 0 ELSE c > 0 END
      FROM g JOIN o ON o.id = g.id AND o.r = g.r + 1),
    s AS (SELECT g.id, sample, min(title) AS title, string_agg(x, chr(10) ORDER BY g.r) AS t FROM g JOIN o ON o.id = g.id AND o.r = g.r WHERE used GROUP BY g.id, sample)
    SELECT id, sample, length(title || chr(10) || chr(10) || {sql_strip('t')})::INT AS tokens, md5(title || chr(10) || chr(10) || {sql_strip('t')}) AS h FROM s""",
)
def book_samples(spark, d):
    """Lines of the novels packed into samples of 1,024 characters."""
    own = table(spark, d, "novels").filter("meta.id is not null").select(F.col("meta.id").alias("id"), F.col("meta.title").alias("title"), F.transform(pages_in_order(F.col("texts")), lambda x: x["text"]).alias("x"))
    return chunk.packed_books(own.distinct(), "id", "title", "x", chunk.CharTokenizer(), BOOK_MOST, BOOK_LEAST).select("id", "sample", "tokens", F.md5("text").alias("h"))


@R.query("title_always", "SELECT doc_id, md5(CASE WHEN title IS NOT NULL AND title <> '' THEN title || chr(10) || chr(10) || text ELSE text END) AS h FROM documents")
def title_always(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.with_title(F.col("title"), F.col("text"), always=True)).alias("h"))


@R.query("script_language", f"SELECT doc_id, {SURVIVOR_LANG.replace('CASE WHEN ko = 0 THEN ' + chr(39) + 'zh' + chr(39) + ' ELSE ' + chr(39) + 'ko' + chr(39) + ' END', chr(39) + 'ko' + chr(39))} AS lang FROM (SELECT *, {sql_script('s')} FROM (SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, length(text) // 2 + 1, 2000) ELSE text END AS s FROM documents))")
def script_language(spark, d):
    return table(spark, d, "documents").select("doc_id", X.script_language(X.middle(F.col("text"))).alias("lang"))


@R.query("json_meta", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_meta(spark, d):
    own = table(spark, d, "events").select("event_id", X.json_meta(F.col("props"), ("url", "k")).alias("m"))
    return own.filter("m is not null").select("event_id", "m.k")


@R.query("repo_meta", "SELECT doc_id, site AS repo_name, title AS path, n_chars AS stars, lang FROM documents WHERE source = 'code'")
def repo_meta(spark, d):
    own = table(spark, d, "documents").filter("source = 'code'")
    return own.select("doc_id", X.repo_meta(F.col("site"), F.col("title"), F.col("n_chars"), F.col("lang")).alias("m")).select("doc_id", "m.*")


@R.query("json_ready", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_totalprice FROM orders")
def json_ready(spark, d):
    return X.json_ready(table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice")))


@R.query("plain_times", "SELECT DISTINCT publish_time, replace(publish_time, 'T', ' ') AS plain FROM articles")
def plain_times(spark, d):
    return table(spark, d, "articles").select("publish_time", X.plain_time(F.col("publish_time")).alias("plain")).distinct()


@R.query(
    "page_map",
    r"""WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, len(l) AS pages, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS page FROM p)
    SELECT doc_id, pages, CAST(page AS VARCHAR) AS page, md5("""
    + sql_strip("x")
    + r""") AS h, len(list_filter(regexp_extract_all(x, '[\p{L}\p{M}\p{Nd}\p{Nl}_]+'), lambda w: regexp_full_match(w, '\p{Latin}+'))) + length(regexp_replace(x, '[^\p{Han}\p{Hiragana}\p{Katakana}]', '', 'g')) AS words FROM u""",
)
def page_map(spark, d):
    own = table(spark, d, "documents").filter("text is not null").select("doc_id", pages_map(F.col("text"), "\n\n").alias("p"))
    return own.select("doc_id", F.col("p.total_pages").alias("pages"), F.explode("p.texts").alias("page", "v")).select("doc_id", "pages", "page", F.md5("v.text").alias("h"), F.col("v.words").cast("bigint").alias("words"))


@R.query("spam_documents", f"""SELECT doc_id FROM documents WHERE {sql_any("lower(coalesce(title, '') || ' ' || left(coalesce(text, ''), 500))", BLOCKED)}""")
def spam_documents(spark, d):
    return table(spark, d, "documents").filter(is_spam(F.col("title"), F.col("text"))).select("doc_id")


@R.query(
    "group_score_argmax",
    f"""WITH w AS ({WORDS}), x AS (SELECT t.site, t.doc_id, t.text, w.words, max(w.words) OVER (PARTITION BY t.site) AS m FROM documents t JOIN w ON w.doc_id = t.doc_id WHERE t.site IS NOT NULL),
    s AS (SELECT site, doc_id, round((contains(coalesce(text, ''), 'ISBN'))::INT + (contains(coalesce(text, ''), '©'))::INT + (contains(coalesce(text, ''), '(C)'))::INT + (contains(coalesce(text, ''), '(c)'))::INT
      + CASE WHEN words = 0 THEN 0 ELSE words / greatest(m // 4, 1) END, 9) AS score FROM x)
    SELECT site, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, doc_id) AS r FROM s) WHERE r = 1""",
)
def group_score_argmax(spark, d):
    docs = table(spark, d, "documents").filter("site is not null")
    return dedup.best_of_group(docs, "site", "doc_id", "text", X.count_words(F.col("text")))


WORD = r"[\p{L}\p{N}_]"
#: A word, or one other sign that isn't white space.
TOKEN = WORD + r"+|[^\p{L}\p{N}_\t-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Of a text $x: its tokens, its hard cuts, 1 where its first token and the last of $w before it are one; and the limit.
CHARS = ("length($x)", "regexp_extract_all($x, '(?s).{1,512}')", "0", 512)
WORDS_256 = (
    f"len(regexp_extract_all($x, '{TOKEN}'))",
    f"""list_transform(range(0, (len(regexp_extract_all($x, '{TOKEN}')) + 255) // 256),
      lambda i: array_to_string(regexp_extract_all($x, '(?:^{SPACE}*)?(?:{TOKEN}){SPACE}*')[256 * i + 1:256 * i + 256], ''))""",
    f"CASE WHEN regexp_matches($w, '{WORD}$') AND regexp_matches($x, '^{WORD}') THEN 1 ELSE 0 END",
    256,
)


def sql_chunks(docs: str, key: str, unit: tuple[str, str, str, int]) -> str:
    """CTEs that end in ``ch`` (key, split, tokens, text): the chunks of the table ``docs`` (key, text)."""
    count, hard, joint, most = unit

    def parts(name: str, source: str, keys: str, list_: str, n: str, separator: str = "''") -> str:
        """The elements of a list with their numbers, all but the last with the separator."""
        return f"""{name}l AS (SELECT {keys}, {list_} AS l FROM {source}),
    {name}u AS (SELECT {keys}, unnest(l) AS x, generate_subscripts(l, 1) AS {n}, len(l) AS m FROM {name}l),
    {name} AS (SELECT *, {count.replace('$x', 'x')} AS c FROM (SELECT {keys}, {n}, x || CASE WHEN {n} < m THEN {separator} ELSE '' END AS x FROM {name}u) WHERE x <> '')"""

    sentence = "regexp_extract_all(x, '[^。！？…；!?;.\n]*[。！？…；!?;.\n]|[^。！？…；!?;.\n]+')"
    return f"""{parts('c1', f"(SELECT * FROM {docs} WHERE text <> '')", key, "string_split(text, chr(10) || chr(10))", 'i1', "chr(10) || chr(10)")},
    {parts('c2', f"(SELECT * FROM c1 WHERE c > {most})", f"{key}, i1", "string_split(x, chr(10))", 'i2', "chr(10)")},
    {parts('c3', f"(SELECT * FROM c2 WHERE c > {most})", f"{key}, i1, i2", sentence, 'i3')},
    {parts('c4', f"(SELECT * FROM c3 WHERE c > {most})", f"{key}, i1, i2, i3", hard.replace('$x', 'x'), 'i4')},
    bl AS (SELECT {key}, i1, 0 AS i2, 0 AS i3, 0 AS i4, x, c FROM c1 WHERE c <= {most} UNION ALL SELECT {key}, i1, i2, 0, 0, x, c FROM c2 WHERE c <= {most}
      UNION ALL SELECT {key}, i1, i2, i3, 0, x, c FROM c3 WHERE c <= {most} UNION ALL SELECT {key}, i1, i2, i3, i4, x, c FROM c4),
    bn AS (SELECT {key}, x, c, row_number() OVER w AS r, coalesce({joint.replace('$x', 'x').replace('$w', 'lag(x) OVER w')}, 0) AS j FROM bl WINDOW w AS (PARTITION BY {key} ORDER BY i1, i2, i3, i4)),
    bo AS (SELECT {key}, r, x, c, sum(c - j) OVER (PARTITION BY {key} ORDER BY r) AS upto FROM bn),
    go AS (SELECT {key}, r, c AS n, 0 AS split, c - upto AS f FROM bo WHERE r = 1
      UNION ALL SELECT {key}, r, CASE WHEN w > {most} THEN c ELSE w END, split + (w > {most})::INT, CASE WHEN w > {most} THEN c - upto ELSE f END FROM
        (SELECT b.{key}, b.r, b.c, b.upto, g.split, g.f, CASE WHEN n + b.c > {0.9 * most} AND n + b.c <= {most} THEN b.upto + g.f ELSE n + b.c END AS w FROM go g JOIN bo b ON b.{key} = g.{key} AND b.r = g.r + 1)),
    ch AS (SELECT {key}, split, {count.replace('$x', 'text')}::INT AS tokens, text FROM (SELECT g.{key}, split::INT AS split, string_agg(x, '' ORDER BY g.r) AS text FROM go g JOIN bo b ON b.{key} = g.{key} AND b.r = g.r GROUP BY g.{key}, split))"""


@R.query("chunk_chars", f"WITH RECURSIVE {sql_chunks('documents', 'doc_id', CHARS)} SELECT ch.doc_id, source, split, tokens, md5(ch.text) AS h FROM ch JOIN documents t ON t.doc_id = ch.doc_id")
def chunk_chars(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("text"))
    return chunk.chunks(docs, ["doc_id", "source"], "text", chunk.CharTokenizer(), 512).select("doc_id", "source", "split", "tokens", F.md5("text").alias("h"))


@R.query("chunk_words", f"WITH RECURSIVE {sql_chunks('documents', 'doc_id', WORDS_256)} SELECT doc_id, split, tokens, md5(text) AS h FROM ch")
def chunk_words(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return chunk.chunks(docs, ["doc_id"], "text", chunk.RegexTokenizer(), 256).select("doc_id", "split", "tokens", F.md5("text").alias("h"))


@R.query("chunk_totals", "SELECT doc_id, length(text) AS chars FROM documents WHERE text IS NOT NULL AND text <> ''")
def chunk_totals(spark, d):
    return chunk_chars(spark, d).groupBy("doc_id").agg(F.sum("tokens").alias("chars"))


@R.query(
    "language_terms",
    rf"""WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(lower(lang), '^(zh|ja)') THEN regexp_extract_all(coalesce(text, ''), '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]|[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\P{{L}}]+|\p{{N}}+')
      ELSE list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]', '', 'g'), '{SPACE}+'), lambda w: w <> '' AND NOT list_contains(string_split('{STOP}', ' '), w)) END AS l FROM documents)
    SELECT doc_id, len(l) AS n, md5(array_to_string(l, ' ')) AS h FROM t""",
)
def language_terms(spark, d):
    """Terms by language, before stemming."""
    docs = table(spark, d, "documents")
    got = docs.select("doc_id", terms(F.col("text"), F.col("lang"), stemmed=False).alias("l"))
    return got.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", " ")).alias("h"))


@R.query("stemmed_terms")
def stemmed_terms(spark, d):
    """The whole step, stems too."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(terms(F.col("text"), F.col("lang")), " ").alias("terms"))
