"""Articles and their comments: latest rows, rule filter, comment tree, text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.fields import any_of, json_list, parse_tags, plain_time, tags_line
from quern.functions.html import clean_html
from quern.functions.text import is_blank, strip
from quern.operators.waterfall import first_failing
from quern.session import cut, is_small

# Categories and words of the subject; words of pages to be dropped.
CATEGORIES = [
    "动漫杂谈", "动画", "漫画", "轻小说", "游戏", "手游", "单机游戏", "网络游戏", "Vtuber", "综合", "影视杂谈", "番剧", "MAD·AMV",
    "国产动画", "新番导视", "旧番补档", "动画综合", "单机联机", "MUGEN", "电子竞技", "GMV", "SS",
]
#: One more word of the list is the name of the site the articles come from; give it with ``keywords``.
KEYWORDS = [
    "番剧", "动漫", "动画", "漫画", "轻小说", "galgame", "视觉小说", "二次元", "acg", "acgn", "ova", "oad", "剧场版", "特摄", "假面骑士",
    "奥特曼", "战队", "b站", "京阿尼", "骨头社", "ufotable", "mappa", "a1", "key社", "type-moon", "fate", "原神", "崩坏", "明日方舟", "米哈游",
    "任天堂", "索尼", "微软", "steam", "epic", "ubisoft", "新番", "补番", "追番", "入坑", "安利", "神作", "萌", "燃", "治愈", "致郁", "声优", "cv",
    "作画", "演出", "脚本", "监督", "分镜", "角色", "人设", "cp", "本命", "推", "waifu", "老公", "老婆", "cos", "cosplay", "同人", "圣地巡礼", "痛车",
    "手办", "模型", "鬼灭", "咒术", "进击的巨人", "间谍过家家", "电锯人", "孤独摇滚", "re0", "无职转生", "辉夜", "五等分", "刀剑神域",
    "魔法禁书目录", "某科学的超电磁炮", "约会大作战", "初音未来", "洛天依", "v家", "东方project", "舰c", "碧蓝航线",
]
BLOCKED = ["流量卡", "壁纸", "动漫壁纸", "美图"]


def latest(rows: DataFrame, key: str, order: list[str], in_place: bool = True) -> DataFrame:
    """One row a key: the greatest in ``order`` (nulls first; a hash of the remaining columns decides ties); null keys are left out.

    Of rows read from files only key, order and a hash are shuffled, to find the rows that lose against
    another of their key; those, mostly few, are then taken out by file and row, so that long columns
    never move.  Other rows are compared whole, by a partial aggregate.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    own = rows.filter(F.col(key).isNotNull())
    rank = [*order, F.xxhash64(*rest).alias("_h")] if rest else order
    placed = None
    if in_place:
        try:
            placed = own.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        except AnalysisException:
            pass
    if placed is None or is_small(rows):
        best = own.groupBy(key).agg(F.max(F.struct(*rank, F.struct(*rest).alias("_r"))).alias("_v"))
        return best.select(key, *[F.col(f"_v.{c}").alias(c) for c in order], *[F.col(f"_v._r.{c}").alias(c) for c in rest]).select(rows.columns)
    slim = placed.select(key, "_file", "_row", F.struct(*rank, "_file", "_row").alias("_v"))
    best = slim.groupBy(key).agg(F.max("_v").alias("_b"), F.count("*").alias("_n")).filter("_n > 1")
    losers = slim.join(best.select(F.col(key).alias("_k"), "_b"), F.col(key) == F.col("_k")).filter("_file <> _b._file or _row <> _b._row").select("_file", "_row")
    # Written, so that Spark knows how short the list is.
    return placed.join(cut(losers, "losers"), ["_file", "_row"], "left_anti").select(rows.columns)


def on_subject(title: Column, tags: Column, category: Column, categories: list[str] = CATEGORIES, keywords: list[str] = KEYWORDS) -> Column:
    """Whether the category is one of the list, or a keyword is part of the lower-case title and tags."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(parse_tags(tags), " ")))
    return F.coalesce(category.isin(categories), F.lit(False)) | any_of(text, [k.lower() for k in keywords])


def is_spam(title: Column, content: Column, words: list[str] = BLOCKED) -> Column:
    """Whether a blocked word is part of the lower-case title and first 500 raw characters."""
    return any_of(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, 500))), words)


def judged(
    articles: DataFrame, min_words: int = 300, min_views: int = 20, min_likes: int = 0, subject: bool = False, newline_share: float = 0.5, clean_all: bool = True
) -> DataFrame:
    """Adds ``clean`` (text of the content) and ``reason``; null words, views and likes count 0.

    With ``clean_all`` off only the rows that reach the rules about the cleaned text are cleaned; ``clean``
    is null for the others.
    """
    n = F.length("clean")
    before = [
        ("empty", is_blank(F.col("content"))),
        ("short", F.coalesce("words", F.lit(0)) < min_words),
        ("low_view", F.coalesce("views", F.lit(0)) < min_views),
        ("low_like", F.coalesce("likes", F.lit(0)) < min_likes),
        *([("off_subject", ~on_subject(F.col("title"), F.col("tags"), F.col("category_name")))] if subject else []),
        ("spam", is_spam(F.col("title"), F.col("content"))),
    ]
    after = [
        ("short_after_clean", n < min_words // 2),
        ("high_newline", (n - F.length(F.replace("clean", F.lit("\n"), F.lit("")))) > newline_share * n),
    ]
    if clean_all:
        return articles.withColumn("clean", clean_html(F.col("content"))).withColumn("reason", first_failing(before + after))
    own = articles.withColumn("reason", first_failing(before))
    own = own.withColumn("clean", F.when(F.col("reason") == "passed", clean_html(F.when(F.col("reason") == "passed", F.col("content")))))
    return own.withColumn("reason", F.when(F.col("reason") == "passed", first_failing(after)).otherwise(F.col("reason")))


def counters(judged_rows: DataFrame) -> DataFrame:
    """One row: ``total, passed, short, low_view, low_like, off_subject, spam, other, chars``.

    ``short`` counts both rules about length, ``other`` the empty ones, broken ones and those of many line ends;
    ``chars`` is the length of the output as compact JSON, with the cleaned text and its length as content and words.
    """

    def n(*names: str) -> Column:
        return F.sum(F.col("reason").isin(*names).cast("long"))

    out = judged_rows.drop("clean", "reason", "content", "words").columns
    row = F.struct(*out, F.col("clean").alias("content"), F.length("clean").alias("words"))
    chars = F.sum(F.when(F.col("reason") == "passed", F.length(F.to_json(row, {"ignoreNullFields": "false"}))))
    return judged_rows.agg(
        F.count("*").alias("total"), n("passed").alias("passed"), n("short", "short_after_clean").alias("short"), n("low_view").alias("low_view"), n("low_like").alias("low_like"),
        n("off_subject").alias("off_subject"), n("spam").alias("spam"), n("empty", "json_error", "high_newline").alias("other"), F.coalesce(chars, F.lit(0)).alias("chars"),
    )


def id_list(c: Column) -> Column:
    """Ids of a JSON list of strings, up to the first that is no whole number; empty for anything else."""
    ids = F.transform(F.from_json(c, "array<string>"), lambda x: x.try_cast("bigint"))
    bad = F.array_position(F.transform(ids, lambda x: x.isNull().cast("int")), 1)
    kept = F.when(bad > 0, F.slice(ids, F.lit(1), (bad - 1).cast("int"))).otherwise(ids)
    return F.coalesce(kept, F.array().cast("array<bigint>"))


def comment_edges(articles: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots: ``cvid, pos, rpid, ...``; replies: ``parent_rpid, rpos, rpid, ...``) in the order of the id lists.

    Ids without a comment are left out.  Both are equi-joins on the comment's id, so nothing is held
    in memory whole and a popular article is never one row.
    """
    one = comments.select("rpid", "content", "author_name", "likes", "parent", "comment_ids", "publish_time")
    roots = articles.select("cvid", F.posexplode(id_list(F.col("comment_ids"))).alias("pos", "rpid")).join(one, "rpid")
    listed = one.select(F.col("rpid").alias("parent_rpid"), F.posexplode(id_list(F.col("comment_ids"))).alias("rpos", "rpid"))
    return roots, listed.join(one.drop("comment_ids"), "rpid")


def comment_levels(articles: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges of three levels: (roots and replies as ``comment_edges`` gives them; ``rpid, parent_rpid, rpos, sub_rpid, spos`` of replies to replies)."""
    roots, replies = comment_edges(articles, comments)
    under = replies.select(F.col("parent_rpid").alias("rpid"), F.col("rpos").alias("spos"), F.col("rpid").alias("sub_rpid"))
    return roots, replies, replies.select("parent_rpid", "rpos", "rpid").join(under, "rpid")


def merged_articles(articles: DataFrame, comments: DataFrame, fields: tuple[str, ...] = ("content", "author_name", "likes", "parent")) -> DataFrame:
    """``articles`` with ``comments``: an array of structs (rpid, the fields, replies), two levels of replies deep, in the order of the id lists.

    Built from the leaves up, one equi-join a level; ids without a comment are left out, no ids give an
    empty array.  An article with its comments is one row of the result, so it has to fit one; the levels
    as edges (``comment_levels``) have no such bound.
    """
    one = comments.select("rpid", *fields)
    listed = comments.select(F.col("rpid").alias("of"), F.posexplode(id_list(F.col("comment_ids"))).alias("pos", "rpid"))

    def gather(edges: DataFrame, key: str, nodes: DataFrame, out: str) -> DataFrame:
        """``key, out``: the nodes behind the edges (key, pos, rpid), in order."""
        node = F.struct("pos", F.struct(*nodes.columns).alias("n"))
        return edges.join(nodes, "rpid").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["n"]).alias(out))

    def level(below: DataFrame) -> DataFrame:
        """Comments with their replies."""
        kids = gather(listed, "of", below, "replies").withColumnRenamed("of", "rpid")
        return one.join(kids, "rpid", "left").withColumn("replies", F.coalesce("replies", F.array()))

    roots = articles.select("cvid", F.posexplode(id_list(F.col("comment_ids"))).alias("pos", "rpid"))
    whole = gather(roots, "cvid", level(level(one)), "comments")
    return articles.join(whole, "cvid", "left").withColumn("comments", F.coalesce("comments", F.array()))


def without_reply_prefix(c: Column) -> Column:
    """The text of a reply without the leading mention."""
    return F.regexp_replace(c, "^回复 @.+? :", "")


def best_comments(articles: DataFrame, comments: DataFrame, top: int = 5, top_replies: int = 2, least: int = 10) -> DataFrame:
    """``cvid, comments``: the lines of the best comments of each article, best first, each with its best replies.

    Best: most likes (null is 0), then the earlier place.  Comments and replies need ``least`` characters;
    a reply counts only if its parent is the comment.  Line ends become spaces; a null author is Unknown.
    """
    roots, replies = comment_edges(articles, comments)
    likes = F.coalesce("likes", F.lit(0))
    author = F.coalesce("author_name", F.lit("Unknown"))
    body = strip(F.coalesce("content", F.lit("")))
    # Only the best survive the partial aggregate: the limit is the feature.
    picked = roots.withColumn("body", body).filter(F.length("body") >= least)
    line = F.concat(author, F.lit(": "), F.replace("body", F.lit("\n"), F.lit(" ")))
    picked = _top(picked.select("cvid", (-likes).alias("a"), F.col("pos").alias("b"), "rpid", line.alias("line")), ["cvid"], ["a", "b", "rpid", "line"], top)
    inner = replies.withColumn("body", without_reply_prefix(body)).filter((F.length("body") >= least) & (F.col("parent") == F.col("parent_rpid")))
    rline = F.concat(F.lit("  └─ "), line)
    best = inner.select("parent_rpid", (-likes).alias("ra"), F.col("rpos").alias("rb"), rline.alias("rline"))
    best = _top(best, ["parent_rpid"], ["ra", "rb", "rline"], top_replies).groupBy("parent_rpid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ra", "rb", "rline"))), lambda x: x["rline"]), "\n").alias("under")
    )
    both = picked.join(best, picked["rpid"] == best["parent_rpid"], "left")
    whole = F.concat_ws("\n", "line", "under")
    listed = F.array_sort(F.collect_list(F.struct("a", "b", whole.alias("t"))))
    return both.groupBy("cvid").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("comments"))


def _top(df: DataFrame, group: list[str], cols: list[str], k: int) -> DataFrame:
    """The k smallest rows of a group in the order of ``cols``; Spark turns the rank limit into one per task before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*cols))).filter(F.col("_r") <= k).drop("_r")


def header(title: Column, time: Column, author: Column, tags: Column) -> Column:
    """Title, blank line, time, author and tags (those there are), blank line."""
    parts = F.concat_ws(" | ", F.nullif(time, F.lit("")), F.nullif(author, F.lit("")), tags_line(tags))
    return F.concat(strip(F.coalesce(title, F.lit(""))), F.lit("\n\n"), F.when(parts == "", F.lit("\n")).otherwise(F.concat(parts, F.lit("\n\n"))))


def article_texts(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """``cvid, text``: header, content and best comments of every article with content."""
    best = best_comments(articles, comments)
    head = header(F.col("title"), F.col("publish_time"), F.col("author_name"), F.col("tags"))
    body = strip(F.col("content"))
    tail = F.coalesce(F.concat(F.lit("\n\n---\n评论：\n"), F.col("comments")), F.lit(""))
    return articles.filter(~is_blank(F.col("content"))).join(best, "cvid", "left").select("cvid", F.concat(head, body, tail).alias("text"))


def thread_texts(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """``cvid, thread``: all comments of an article, each with its replies and theirs behind it, one block a comment.

    A block is author, time (if there is one) and content.  In a reply the mention names the author of the
    comment it answers, and stands in front if it was missing.  Comments without content are left out, their
    replies aren't; a null author is 无名.  A thread is one row of the result, so it has to fit one.
    """
    roots, replies = comment_edges(articles, comments)
    name = F.concat_ws(" ", F.coalesce("author_name", F.lit("无名")), F.nullif(plain_time(F.col("publish_time")), F.lit("")))
    known = comments.filter("author_name is not null").select(F.col("rpid").alias("parent"), F.col("author_name").alias("to"))
    answered = replies.join(known, "parent", "left")
    told = F.when(F.col("to").isNull(), F.col("content")).otherwise(
        F.regexp_replace("content", F.lit("@.+:"), F.concat(F.lit("@"), F.regexp_replace("to", r"([\\$])", r"\\$1"), F.lit(":")))
    )
    told = F.when(F.col("to").isNotNull() & ~told.startswith("回复 @"), F.concat(F.lit("回复 @"), "to", F.lit(":"), told)).otherwise(told)
    under = answered.select(F.col("parent_rpid").alias("at"), (F.col("rpos") + 1).alias("n"), F.col("rpid").alias("next"), F.concat(name, F.lit("\n"), told).alias("t"))
    zero = F.lit(0)
    tops = roots.select("cvid", "pos", zero.alias("a"), zero.alias("b"), F.col("rpid").alias("at"), F.concat(name, F.lit("\n"), F.col("content")).alias("t"))
    second = tops.drop("t").join(under, "at").select("cvid", "pos", F.col("n").alias("a"), "b", F.col("next").alias("at"), "t")
    third = second.drop("t").join(under, "at").select("cvid", "pos", "a", F.col("n").alias("b"), F.col("next").alias("at"), "t")
    blocks = tops.unionByName(second).unionByName(third).filter("t is not null")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "a", "b", "t")))
    return blocks.groupBy("cvid").agg(F.array_join(F.transform(in_order, lambda x: x["t"]), "\n\n").alias("thread"))


def labelled_texts(articles: DataFrame, comments: DataFrame, least: int = 512, blocked: list[str] = BLOCKED) -> DataFrame:
    """``cvid, text``: labelled header lines, content, tags and the whole thread of the articles of at least ``least`` words.

    Articles without content are left out, and those whose title is, or whose tags hold, a blocked word.
    Null header fields are ''; tags that are no list are none.
    """
    tags = F.coalesce(json_list(F.col("tags")), F.array().cast("array<string>"))
    fields = [("URL: ", "link"), ("标题: ", "title"), ("作者: ", "author_name"), ("发布日期: ", "publish_time")]
    head = [F.concat(F.lit(name), F.coalesce(c, F.lit(""))) for name, c in fields]
    line = F.when(F.size(tags) > 0, F.concat(F.lit("标签: "), F.array_join(tags, ", "))).otherwise("")
    kept = (F.col("words") >= least) & (F.col("content") != "") & ~F.coalesce(F.col("title").isin(blocked), F.lit(False)) & ~F.exists(tags, lambda t: F.coalesce(t.isin(blocked), F.lit(False)))
    body = strip(F.concat_ws("\n\n", *head, "content", line))
    threads = thread_texts(articles.filter(kept), comments)
    return articles.filter(kept).join(threads, "cvid", "left").select("cvid", F.concat_ws("\n\n", body, strip("thread")).alias("text"))
