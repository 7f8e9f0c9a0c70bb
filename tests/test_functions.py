"""Expressions on small literal rows."""

import html
import re

from pyspark.sql import functions as F

from quern.functions import fields as X
from quern.functions.html import clean_html, unescape
from quern.functions.text import is_blank, narrow, pages_in_order, strip, whole_text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


def test_strip_takes_every_white_space(spark):
    assert one(spark, "　\x1c a b \n", strip) == "a b"
    assert [one(spark, v, is_blank) for v in (None, "", " 　\n", "x")] == [True, True, True, False]


def test_narrow(spark):
    assert one(spark, "ＡＢｃ１！　。", narrow) == "ABc1! 。"


def test_pages_in_numeric_order(spark):
    texts = {"10": (1, "c"), "2": (1, "b"), "0": (0, ""), "1": (0, None), "x": (1, "z")}
    kind = "map<string,struct<words:int,text:string>>"
    assert [tuple(p) for p in one(spark, texts, pages_in_order, kind)] == [(2, "b"), (10, "c"), (None, "z")]
    assert one(spark, texts, whole_text, kind) == "b\n\nc\n\nz"
    assert one(spark, {}, whole_text, kind) == "" and one(spark, None, whole_text, kind) is None


def test_clean_html(spark):
    cases = {
        None: "",
        "a&lt;b&gt;c": "ac",
        '<p>x <a href="#">l</a><img src="i" alt="P"> <img src="j">y</p>': "x lP y",
        "<a><b>z</b></a>": "z",
        "<script>s()</script>\n\n\n\nq  r &amp;amp;": "s()\n\nq r &amp;",
        "x<!": "x<!",
    }
    for raw, want in cases.items():
        assert one(spark, raw, clean_html) == want, raw
    # Every entity, not only the common ones; escaped once is decoded once.
    for raw in ("&eacute;&#20013;&amp;", "&#x4e2d;&ndash;&times;", "&amp;eacute; &quot;", "&copy 1 &notit; &bogus;", "a & b &; &#0;", "&nbsp;x"):
        assert one(spark, raw, unescape) == html.unescape(raw), raw
    assert one(spark, "&#60;b&#62;x&#x3c;/b&gt;&rsquo;", clean_html) == "x’"


def test_tags(spark):
    cases = {None: [], "": [], "a,b": [], '["a","b"]': ["a", "b"], '[{"name":"n"},{"x":1}]': ["n"], "[broken": []}
    for raw, want in cases.items():
        assert one(spark, raw, X.parse_tags) == want, raw
    assert [one(spark, v, X.tags_line) for v in ('["a", "b"]', "a,b", "", None, "[x")] == ["a,b", "a,b", None, None, "[x"]


def test_predictions(spark):
    cases = {"1, 0": (1, 0), "10,1": (0, 1), "<think>\n</think>\n0 , 1": (0, 1), "n/a": (None, None), None: (None, None), "": (None, None)}
    for raw, want in cases.items():
        assert tuple(one(spark, raw, X.parse_prediction)) == want, raw


def test_words_and_languages(spark):
    cases = {"Hello, wörld 你好": 4, "abc中 def1 x_y": 1, None: 0, "": 0, "カタ かな 漢": 5}
    for raw, want in cases.items():
        assert one(spark, raw, X.count_words) == want, raw
    assert one(spark, "漢字だけ", lambda c: X.fix_language(F.lit("ko"), c)) == "zh"
    assert one(spark, "한글", lambda c: X.fix_language(F.lit("ko"), c)) == "ko"
    assert [one(spark, v, X.script_language) for v in ("hello", "你好吗", "これは日本", "한글", "", None)] == ["en", "zh", "ja", "ko", "en", "en"]
    assert one(spark, "a" * 10 + "b" * 10, lambda c: X.middle(c, 10)) == "b" * 10


def test_paths_titles_and_ids(spark):
    assert tuple(one(spark, "co/ga me@1/x/ch 漢@2_zh.txt", X.path_fields)) == ("ga me - ch 漢", "co_ga_me_ch_漢")
    assert tuple(one(spark, "a_b.txt", X.path_fields)) == ("a b", "a_b")
    assert tuple(one(spark, "c/g/c1_zh_f.txt", X.path_fields)) == ("g - c1", "c_g_c1")
    assert one(spark, "T\nx", lambda c: X.with_title(F.lit("T"), c)) == "T\nx"
    assert one(spark, "T\nx", lambda c: X.with_title(F.lit("T"), c, True)) == "T\n\nT\nx"
    assert one(spark, "x", lambda c: X.with_title(F.lit(None).cast("string"), c)) == "x"
    assert one(spark, "", lambda c: X.id_or_hash(c, F.lit("t"))) == "e358efa489f58062f10dd7316b65649e"
    assert one(spark, "{bad", X.json_meta) is None and tuple(one(spark, '{"url":"u"}', X.json_meta)) == ("u", None)


def test_line_filters(spark):
    drop = lambda c: X.without_marked_lines(c, ["QQ", "公众号"], 10)
    assert one(spark, "QQ群 第三章 起点\n正文正文正文\n公众号", drop) == "第三章 起点\n正文正文正文"
    assert one(spark, "QQ 1", drop) is None and one(spark, None, drop) is None
    assert one(spark, "《a b》·c\nd", X.normal_answer) == "abc"


def test_wiki_page(spark):
    page = lambda c: X.wiki_page(c, F.lit("t"), "u/")
    assert one(spark, "[x]a b", page) == "URL: u/a_b\n\na b\n\nt"
    assert one(spark, "plain", page) is None
    assert re.match("URL: ", one(spark, "i", lambda c: X.question_answer(c, c, c)))


def test_json_ready(spark):
    df = spark.sql("select date'2024-01-02' d, timestamp'2024-01-02 03:04:05' t, 1.50bd x, cast('é' as binary) b, X'ff' c, 7 n")
    assert tuple(X.json_ready(df).first()) == ("2024-01-02", "2024-01-02T03:04:05", 1.5, "é", None, 7)
    lit = F.lit
    assert tuple(df.select(X.repo_meta(lit("r"), lit("p"), lit(3), lit("py")).alias("m")).first()["m"]) == ("r", "p", 3, "py")


def test_terms():
    from quern.functions.terms import porter

    stems = {
        "caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
        "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "hopefulness": "hope", "sensibiliti": "sensibl", "electrical": "electr",
        "goodness": "good", "replacement": "replac", "adoption": "adopt", "bowdlerize": "bowdler", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "漢字": "漢字",
    }
    assert {w: porter(w) for w in stems} == stems


def test_terms_by_language(spark):
    from quern.functions.terms import terms

    df = spark.createDataFrame([("The cats' toys, running!", "en"), ("漢字とkana 12", "zh-cn"), (None, "ja"), (None, None), ("the", None)], "t string, l string")
    assert [r[0] for r in df.select(terms(F.col("t"), F.col("l"))).collect()] == [["cat", "toi", "run"], ["漢", "字", "と", "kana", "12"], [], [], []]
    assert df.select(terms(F.col("t"), F.col("l"), stemmed=False)).first()[0] == ["cats", "toys", "running"]


def test_ids_and_times(spark):
    df = spark.createDataFrame([("a", 3), ("", 4), (None, 5)], "id string, n long")
    assert [r[0] for r in df.select(X.id_or_line(F.col("id"), F.lit("s"), F.col("n"))).collect()] == ["a", "s_4", "s_5"]
    assert [r[0] for r in df.select(X.prefixed_id(F.col("id"), F.col("n"))).collect()] == ["a_3", "_4", "_5"]
    assert one(spark, "2020-01-01T10:00", X.plain_time) == "2020-01-01 10:00"
    assert tuple(one(spark, "co/x.txt", X.path_fields)) == ("x.txt - x", "co_x_txt_x")
