"""Queries over articles, comments and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.fields import normal_answer, parse_prediction, parse_tags
from quern.functions.html import COMMON, clean_html
from quern.operators import articles as A
from quern.operators.batch import exact_match
from quern.operators.joins import zip_join
from quern.operators.waterfall import confusion, reason_counts
from quern.registry import Registry
from quern.tables import table

R = Registry()
SPACE = r"[\t-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    for name, sign in COMMON:
        x = "replace({}, '{}', '{}')".format(x, name.replace("'", "''"), sign.replace("'", "''"))
    x = f"""regexp_replace({x}, '<img[^>]*\\balt=["'']([^"'']*)["''][^>]*>', '\\1', 'g')"""
    x = f"regexp_replace({x}, '<a\\b[^>]*>([^<]*)</a>', '\\1', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    x = f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"
    return sql_strip(x)


def sql_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cvid ORDER BY add_ts DESC NULLS LAST, views DESC NULLS LAST, likes DESC NULLS LAST, favourites DESC NULLS LAST) AS rn_ FROM articles WHERE cvid IS NOT NULL) WHERE rn_ = 1"
COMMENTS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rpid ORDER BY publish_time DESC NULLS LAST, likes DESC NULLS LAST) AS rn_ FROM comments WHERE rpid IS NOT NULL) WHERE rn_ = 1"
TAGS = """CASE WHEN tags IS NOT NULL AND starts_with(trim(tags), '[') AND json_valid(tags) THEN
  list_filter(list_transform(json_extract(tags, '$[*]'), lambda e: CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.name') ELSE json_extract_string(e, '$') END), lambda e: e IS NOT NULL)
  ELSE []::VARCHAR[] END"""
def sql_judged(c: str = "c") -> str:
    """CTEs ``c`` and ``j``: the table ``a`` of articles with ``clean`` and ``reason``."""
    return f"""
  {c} AS (SELECT *, {sql_clean('content')} AS clean FROM a),
  j AS (SELECT *, CASE
    WHEN content IS NULL OR {sql_strip('content')} = '' THEN 'empty'
    WHEN coalesce(words, 0) < 300 THEN 'short'
    WHEN coalesce(views, 0) < 20 THEN 'low_view'
    WHEN coalesce(likes, 0) < 0 THEN 'low_like'
    WHEN {sql_any("lower(coalesce(title, '') || ' ' || left(coalesce(content, ''), 500))", A.BLOCKED)} THEN 'spam'
    WHEN length(clean) < 150 THEN 'short_after_clean'
    WHEN length(clean) - length(replace(clean, chr(10), '')) > 0.5 * length(clean) THEN 'high_newline'
    ELSE 'passed' END AS reason FROM {c})"""


JUDGED = f"a AS ({LATEST}), {sql_judged()}"


def latest_articles(spark, d):
    return A.latest(table(spark, d, "articles"), "cvid", ["add_ts", "views", "likes", "favourites"])


def latest_comments(spark, d):
    return A.latest(table(spark, d, "comments"), "rpid", ["publish_time", "likes"], in_place=False)


def scores(spark, d):
    p = table(spark, d, "predictions").groupBy("cvid").agg(F.min("predict").alias("predict"))
    return p.withColumn("p", parse_prediction(F.col("predict"))).select("cvid", "p.quality", "p.domain")


@R.query("clean_waterfall", f"WITH {JUDGED} SELECT cvid, reason, length(clean) AS clean_chars, md5(clean) AS clean_md5 FROM j")
def clean_waterfall(spark, d):
    return A.judged(latest_articles(spark, d)).select("cvid", "reason", F.length("clean").alias("clean_chars"), F.md5("clean").alias("clean_md5"))


@R.query("clean_reason_counts", f"WITH {JUDGED} SELECT reason, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM j), 4) AS pct FROM j GROUP BY reason")
def clean_reason_counts(spark, d):
    return reason_counts(A.judged(latest_articles(spark, d), clean_all=False))


@R.query(
    "clean_counters",
    f"""WITH {JUDGED} SELECT count(*) AS total, count(*) FILTER (reason = 'passed') AS passed, count(*) FILTER (reason IN ('short', 'short_after_clean')) AS short, count(*) FILTER (reason = 'low_view') AS low_view,
      count(*) FILTER (reason = 'low_like') AS low_like, count(*) FILTER (reason = 'off_subject') AS off_subject, count(*) FILTER (reason = 'spam') AS spam, count(*) FILTER (reason IN ('empty', 'json_error', 'high_newline')) AS other,
      coalesce((SELECT sum(length(to_json(o)))::BIGINT FROM (SELECT * EXCLUDE (rn_, clean, reason) REPLACE (clean AS content, length(clean) AS words) FROM j WHERE reason = 'passed') o), 0) AS chars FROM j""",
)
def clean_counters(spark, d):
    return A.counters(A.judged(latest_articles(spark, d), clean_all=False))


@R.query("html_clean", f"SELECT cvid, min({sql_clean('content')}) AS text FROM articles WHERE cvid IS NOT NULL GROUP BY cvid")
def html_clean(spark, d):
    return table(spark, d, "articles").filter("cvid is not null").groupBy("cvid").agg(F.min(clean_html(F.col("content"))).alias("text"))


@R.query(
    "keyword_category_filter",
    f"""WITH a AS ({LATEST}), t AS (SELECT cvid, category_name, lower(coalesce(title, '') || ' ' || array_to_string({TAGS}, ' ')) AS t FROM a)
    SELECT cvid, coalesce(category_name IN ({', '.join(f"'{c}'" for c in A.CATEGORIES)}), false) OR {sql_any('t', [k.lower() for k in A.KEYWORDS])} AS on_subject FROM t""",
)
def keyword_category_filter(spark, d):
    return latest_articles(spark, d).select("cvid", A.on_subject(F.col("title"), F.col("tags"), F.col("category_name")).alias("on_subject"))


@R.query("spam_filter", f"""WITH a AS ({LATEST}) SELECT cvid FROM a WHERE {sql_any("lower(coalesce(title, '') || ' ' || left(coalesce(content, ''), 500))", A.BLOCKED)}""")
def spam_filter(spark, d):
    return latest_articles(spark, d).filter(A.is_spam(F.col("title"), F.col("content"))).select("cvid")


@R.query("tag_list_parse", f"WITH a AS ({LATEST}) SELECT cvid, array_to_string({TAGS}, '|') AS names, len({TAGS}) AS n FROM a")
def tag_list_parse(spark, d):
    names = parse_tags(F.col("tags"))
    return latest_articles(spark, d).select("cvid", F.array_join(names, "|").alias("names"), F.size(names).alias("n"))


PREDICT = """p AS (SELECT cvid, min(predict) AS predict FROM predictions GROUP BY cvid),
  s AS (SELECT cvid, try_cast(nullif(regexp_extract(predict, '([0-9])\\s*,\\s*([0-9])', 1), '') AS INTEGER) AS quality,
        try_cast(nullif(regexp_extract(predict, '([0-9])\\s*,\\s*([0-9])', 2), '') AS INTEGER) AS domain FROM p)"""


@R.query("prediction_parse", f"WITH {PREDICT} SELECT cvid, quality, domain FROM s")
def prediction_parse(spark, d):
    return scores(spark, d)


@R.query("score_join_filter", f"WITH a AS ({LATEST}), {PREDICT} SELECT a.cvid, a.words, s.quality AS quality_score, s.domain AS domain_score FROM a JOIN s ON s.cvid = a.cvid WHERE s.quality = 1")
def score_join_filter(spark, d):
    good = scores(spark, d).filter("quality = 1")
    return latest_articles(spark, d).join(good, "cvid").select("cvid", "words", F.col("quality").alias("quality_score"), F.col("domain").alias("domain_score"))


@R.query("class_shares", f"WITH {PREDICT} SELECT quality, domain, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM s), 4) AS pct FROM s GROUP BY quality, domain")
def class_shares(spark, d):
    return reason_counts(scores(spark, d).withColumn("r", F.struct("quality", "domain")), "r").select("r.quality", "r.domain", "n", "pct")


@R.query(
    "positional_zip_join",
    f"""WITH a AS (SELECT cvid, row_number() OVER (ORDER BY cvid) AS pos FROM ({LATEST})), {PREDICT}, q AS (SELECT quality, row_number() OVER (ORDER BY cvid) AS pos FROM s)
    SELECT a.pos, a.cvid, q.quality FROM a JOIN q ON q.pos = a.pos""",
)
def positional_zip_join(spark, d):
    right = scores(spark, d).select(F.col("cvid").alias("other"), "quality")
    return zip_join(latest_articles(spark, d).select("cvid"), right, "cvid", "other", 1000).select("pos", "cvid", "quality")


@R.query(
    "confusion_metrics",
    f"""WITH {JUDGED}, {PREDICT}, b AS (SELECT j.reason = 'passed' AS k, s.quality = 1 AS g FROM j JOIN s ON s.cvid = j.cvid WHERE s.quality IS NOT NULL),
    n AS (SELECT count(*) AS rows, count(*) FILTER (k AND g) AS tp, count(*) FILTER (k AND NOT g) AS fp, count(*) FILTER (NOT k AND g) AS fn FROM b)
    SELECT rows, round(1 - (tp + fp) / rows, 6) AS filter_rate, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(fn / (tp + fn), 6) AS false_kill FROM n""",
)
def confusion_metrics(spark, d):
    both = A.judged(latest_articles(spark, d), clean_all=False).join(scores(spark, d), "cvid")
    return confusion(both, F.col("reason") == "passed", F.col("quality") == 1)


ROOTS = f"""a AS ({LATEST}), c AS ({COMMENTS}),
  l AS (SELECT cvid, unnest(from_json(comment_ids, '["VARCHAR"]')) AS i, generate_subscripts(from_json(comment_ids, '["VARCHAR"]'), 1) - 1 AS pos FROM a WHERE comment_ids IS NOT NULL AND json_valid(comment_ids)),
  roots AS (SELECT l.cvid, l.pos, c.* FROM l JOIN c ON c.rpid = try_cast(l.i AS BIGINT)),
  m AS (SELECT rpid AS parent_rpid, unnest(from_json(comment_ids, '["VARCHAR"]')) AS i, generate_subscripts(from_json(comment_ids, '["VARCHAR"]'), 1) - 1 AS rpos FROM c WHERE comment_ids IS NOT NULL AND json_valid(comment_ids)),
  replies AS (SELECT m.parent_rpid, m.rpos, c.* FROM m JOIN c ON c.rpid = try_cast(m.i AS BIGINT))"""


@R.query("comment_tree", f"WITH {ROOTS} SELECT r.cvid, r.pos, r.rpid, x.rpos, x.rpid AS reply_rpid FROM roots r LEFT JOIN replies x ON x.parent_rpid = r.rpid")
def comment_tree(spark, d):
    roots, replies = A.comment_edges(latest_articles(spark, d), latest_comments(spark, d))
    under = replies.select("parent_rpid", "rpos", F.col("rpid").alias("reply_rpid"))
    return roots.join(under, roots["rpid"] == under["parent_rpid"], "left").select("cvid", "pos", "rpid", "rpos", "reply_rpid")


BEST = f"""{ROOTS},
  b AS (SELECT *, row_number() OVER (PARTITION BY cvid ORDER BY coalesce(likes, 0) DESC, pos) AS k FROM (SELECT *, {sql_strip("coalesce(content, '')")} AS body FROM roots) WHERE length(body) >= 10),
  x AS (SELECT *, row_number() OVER (PARTITION BY parent_rpid ORDER BY coalesce(likes, 0) DESC, rpos) AS k
        FROM (SELECT *, regexp_replace({sql_strip("coalesce(content, '')")}, '^回复 @.+? :', '') AS body FROM replies) WHERE length(body) >= 10 AND parent = parent_rpid),
  u AS (SELECT parent_rpid, string_agg('  └─ ' || coalesce(author_name, 'Unknown') || ': ' || replace(body, chr(10), ' '), chr(10) ORDER BY k) AS under FROM x WHERE k <= 2 GROUP BY parent_rpid),
  best AS (SELECT b.cvid, string_agg(coalesce(author_name, 'Unknown') || ': ' || replace(body, chr(10), ' ') || coalesce(chr(10) || u.under, ''), chr(10) ORDER BY b.k) AS comments
        FROM b LEFT JOIN u ON u.parent_rpid = b.rpid WHERE b.k <= 5 GROUP BY b.cvid)"""


@R.query("top5_top2_comments", f"WITH {BEST} SELECT cvid, comments FROM best")
def top5_top2_comments(spark, d):
    return A.best_comments(latest_articles(spark, d), latest_comments(spark, d))


LINE = """CASE WHEN tags IS NULL OR tags = '' THEN NULL WHEN starts_with(trim(tags), '[') AND json_valid(tags) THEN
  array_to_string(list_transform(json_extract(tags, '$[*]'), lambda e: CASE WHEN json_type(e) = 'OBJECT' THEN CAST(e AS VARCHAR) ELSE json_extract_string(e, '$') END), ',') ELSE tags END"""


def sql_article(content: str, rows: str) -> str:
    """Header, content and best comments of each of the rows, as ``cvid, x``."""
    return f"""SELECT h.cvid, h.t || chr(10) || chr(10) || CASE WHEN m = '' THEN chr(10) ELSE m || chr(10) || chr(10) END || h.body
      || coalesce(chr(10) || chr(10) || '---' || chr(10) || '评论：' || chr(10) || best.comments, '') AS x
      FROM (SELECT cvid, {sql_strip(content)} AS body, {sql_strip("coalesce(title, '')")} AS t, concat_ws(' | ', nullif(publish_time, ''), nullif(author_name, ''), {LINE}) AS m FROM {rows}) h
      LEFT JOIN best ON best.cvid = h.cvid WHERE h.body IS NOT NULL AND h.body <> ''"""


@R.query("article_text", f"WITH {BEST} SELECT cvid, length(x) AS chars, md5(x) AS text_md5 FROM ({sql_article('content', 'a')})")
def article_text(spark, d):
    out = A.article_texts(latest_articles(spark, d), latest_comments(spark, d))
    return out.select("cvid", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


LEVELS = f"""{ROOTS}, subs AS (SELECT r.parent_rpid, r.rpos, r.rpid, s.rpos AS spos, s.rpid AS sub_rpid FROM replies r JOIN replies s ON s.parent_rpid = r.rpid)"""


@R.query("comment_levels", f"WITH {LEVELS} SELECT r.cvid, r.pos, r.rpid AS root_rpid, s.rpos, s.rpid, s.spos, s.sub_rpid FROM roots r JOIN subs s ON s.parent_rpid = r.rpid")
def comment_levels(spark, d):
    roots, _, third = A.comment_levels(latest_articles(spark, d), latest_comments(spark, d))
    root = roots.select("cvid", "pos", F.col("rpid").alias("root_rpid"))
    return root.join(third, root["root_rpid"] == third["parent_rpid"]).select("cvid", "pos", "root_rpid", "rpos", "rpid", "spos", "sub_rpid")


@R.query(
    "merged_articles",
    f"""WITH {LEVELS}, x AS (SELECT parent_rpid, rpid, string_agg(CAST(sub_rpid AS VARCHAR), ' ' ORDER BY spos) AS t FROM subs GROUP BY parent_rpid, rpid),
    y AS (SELECT r.parent_rpid, string_agg(CAST(r.rpid AS VARCHAR) || ':' || coalesce(author_name, '') || '(' || coalesce(x.t, '') || ')', ' ' ORDER BY r.rpos) AS t FROM replies r LEFT JOIN x ON x.rpid = r.rpid AND x.parent_rpid = r.parent_rpid GROUP BY r.parent_rpid),
    z AS (SELECT cvid, count(*) AS n, md5(string_agg(CAST(r.rpid AS VARCHAR) || ':' || coalesce(content, '') || '[' || coalesce(y.t, '') || ']', ' ' ORDER BY r.pos)) AS h FROM roots r LEFT JOIN y ON y.parent_rpid = r.rpid GROUP BY cvid)
    SELECT a.cvid, coalesce(n, 0) AS n, coalesce(h, md5('')) AS h FROM a LEFT JOIN z ON z.cvid = a.cvid""",
)
def merged_articles(spark, d):
    """Articles with their comments, replies and the replies to those nested in them, told by a fingerprint."""
    out = A.merged_articles(latest_articles(spark, d), latest_comments(spark, d))

    def listed(of, text):
        return F.array_join(F.transform(of, text), " ")

    def text(c):
        return F.coalesce(c, F.lit(""))

    third = lambda r: F.concat(r["rpid"].cast("string"), F.lit(":"), text(r["author_name"]), F.lit("("), listed(r["replies"], lambda s: s["rpid"].cast("string")), F.lit(")"))
    first = lambda c: F.concat(c["rpid"].cast("string"), F.lit(":"), text(c["content"]), F.lit("["), listed(c["replies"], third), F.lit("]"))
    return out.select("cvid", F.size("comments").alias("n"), F.md5(listed(F.col("comments"), first)).alias("h"))


THREADS = f"""{ROOTS}, k AS (SELECT rpid, author_name AS "to" FROM c WHERE author_name IS NOT NULL),
  e AS (SELECT r.*, k."to", CASE WHEN k."to" IS NULL THEN content ELSE regexp_replace(content, '@.+:', '@' || k."to" || ':', 'g') END AS told FROM replies r LEFT JOIN k ON k.rpid = r.parent),
  under AS (SELECT parent_rpid AS at, rpos + 1 AS n, rpid AS next, concat_ws(' ', coalesce(author_name, '无名'), nullif(replace(publish_time, 'T', ' '), '')) || chr(10) || CASE WHEN "to" IS NOT NULL AND NOT starts_with(told, '回复 @') THEN '回复 @' || "to" || ':' || told ELSE told END AS t FROM e),
  b1 AS (SELECT cvid, pos, 0 AS a, 0 AS b, rpid AS at, concat_ws(' ', coalesce(author_name, '无名'), nullif(replace(publish_time, 'T', ' '), '')) || chr(10) || content AS t FROM roots),
  b2 AS (SELECT cvid, pos, n AS a, 0 AS b, next AS at, under.t FROM b1 JOIN under ON under.at = b1.at), b3 AS (SELECT cvid, pos, a, n AS b, next AS at, under.t FROM b2 JOIN under ON under.at = b2.at),
  threads AS (SELECT cvid, string_agg(t, chr(10) || chr(10) ORDER BY pos, a, b, t) AS thread FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3) WHERE t IS NOT NULL GROUP BY cvid)"""


@R.query("comment_threads", f"WITH {THREADS} SELECT cvid, length(thread) AS chars, md5(thread) AS h FROM threads")
def comment_threads(spark, d):
    out = A.thread_texts(latest_articles(spark, d), latest_comments(spark, d))
    return out.select("cvid", F.length("thread").alias("chars"), F.md5("thread").alias("h"))


NAMES = """CASE WHEN tags IS NOT NULL AND starts_with(trim(tags), '[') AND json_valid(tags) THEN
  list_transform(json_extract(tags, '$[*]'), lambda e: CASE WHEN json_type(e) = 'OBJECT' THEN CAST(e AS VARCHAR) ELSE json_extract_string(e, '$') END) ELSE []::VARCHAR[] END"""
BLOCKED = ", ".join(f"'{w}'" for w in A.BLOCKED)


@R.query(
    "labelled_articles",
    f"""WITH {THREADS}, n AS (SELECT *, {NAMES} AS names FROM a), f AS (SELECT * FROM n WHERE words >= 512 AND content <> '' AND NOT coalesce(title IN ({BLOCKED}), false) AND NOT list_has_any(names, [{BLOCKED}])),
    h AS (SELECT cvid, {sql_strip("concat_ws(chr(10) || chr(10), 'URL: ' || coalesce(link, ''), '标题: ' || coalesce(title, ''), '作者: ' || coalesce(author_name, ''), '发布日期: ' || coalesce(publish_time, ''), content, CASE WHEN len(names) > 0 THEN '标签: ' || array_to_string(names, ', ') ELSE '' END)")} AS t FROM f),
    w AS (SELECT h.cvid, concat_ws(chr(10) || chr(10), h.t, {sql_strip('thread')}) AS x FROM h LEFT JOIN threads ON threads.cvid = h.cvid)
    SELECT cvid, length(x) AS chars, md5(x) AS h FROM w""",
)
def labelled_articles(spark, d):
    out = A.labelled_texts(latest_articles(spark, d), latest_comments(spark, d))
    return out.select("cvid", F.length("text").alias("chars"), F.md5("text").alias("h"))


@R.query(
    "answers_match",
    "SELECT round(avg(coalesce(translate(split_part(predict, chr(10), 1), '《》 　·', '') = q || ',' || d, false)::INT), 6) AS accuracy FROM "
    "(SELECT predict, regexp_extract(predict, '([0-9])\\s*,\\s*([0-9])', 1) AS q, regexp_extract(predict, '([0-9])\\s*,\\s*([0-9])', 2) AS d FROM predictions)",
)
def answers_match(spark, d):
    """Predictions whose normalised first line is the pair that was read from them, of all with one."""
    p = table(spark, d, "predictions").select("predict", parse_prediction(F.col("predict")).alias("p"))
    label = F.concat_ws(",", F.col("p.quality").cast("string"), F.col("p.domain").cast("string"))
    return p.select(normal_answer(F.col("predict")).alias("a"), label.alias("l")).agg(F.round(exact_match(F.col("a"), F.col("l")), 6).alias("accuracy"))
