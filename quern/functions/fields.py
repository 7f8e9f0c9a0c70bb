"""Fields of records: tags, predictions, titles, ids, metadata, languages, word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import is_blank, strip


def json_list(c: Column) -> Column:
    """A JSON list in a string as array of strings; null for anything else."""
    return F.when(strip(c).startswith("["), F.from_json(c, "array<string>"))


def parse_tags(c: Column) -> Column:
    """Names in a JSON list of strings or of objects with a name; an empty array for anything else."""
    name = F.transform(json_list(c), lambda t: F.when(t.startswith("{"), F.get_json_object(t, "$.name")).otherwise(t))
    return F.coalesce(F.filter(name, lambda t: t.isNotNull()), F.array().cast("array<string>"))


def tags_line(c: Column) -> Column:
    """Tags as one string: a JSON list comma-joined, anything else as it is, null for null and ''."""
    listed = F.array_join(F.transform(json_list(c), lambda t: t), ",")
    return F.when(c.isNull() | (c == ""), None).otherwise(F.coalesce(listed, c))


def parse_prediction(c: Column) -> Column:
    """Struct (quality, domain): the first two single digits parted by a comma, else two comma-parted whole numbers, else nulls."""
    q, d = (F.regexp_extract(c, r"([0-9])\s*,\s*([0-9])", i) for i in (1, 2))
    parts = F.split(c, ",")
    both = [strip(F.try_element_at(parts, F.lit(i))).try_cast("int") for i in (1, 2)]
    plain = [F.when(both[0].isNotNull() & both[1].isNotNull(), b) for b in both]
    return F.struct(
        F.when(q != "", q.try_cast("int")).otherwise(plain[0]).alias("quality"),
        F.when(d != "", d.try_cast("int")).otherwise(plain[1]).alias("domain"),
    )


def first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def with_title(title: Column, text: Column, always: bool = False) -> Column:
    """The text with its title in front; unless ``always``, only if the first line isn't the title already."""
    has = title.isNotNull() & (title != "")
    if not always:
        has = has & (strip(first_line(text)) != title)
    return F.when(has, F.concat(title, F.lit("\n\n"), text)).otherwise(text)


def plain_time(c: Column) -> Column:
    """A time in a string with a space for the T between date and time."""
    return F.replace(c, F.lit("T"), F.lit(" "))


def id_or_line(given: Column, stem: Column, line: Column) -> Column:
    """The given id, or ``{stem}_{line}`` where it is null or empty."""
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(stem, F.lit("_"), line.cast("string")))


def prefixed_id(prefix: Column, given: Column) -> Column:
    """``{prefix}_{id}``, as code files are named by language; null parts are ''."""
    return F.concat(F.coalesce(prefix, F.lit("")), F.lit("_"), F.coalesce(given.cast("string"), F.lit("")))


def id_or_hash(given: Column, text: Column) -> Column:
    """The given id, or the md5 of the text where it is null or empty."""
    return F.coalesce(F.nullif(given, F.lit("")), F.md5(text))


def count_words(c: Column) -> Column:
    """Whole words of Latin letters, plus Han, Hiragana and Katakana characters; 0 for null.

    Latin letters next to other letters or digits aren't a word.
    """
    latin = F.regexp_count(c, F.lit(r"(?U)\b\p{IsLatin}+\b"))
    wide = F.regexp_count(c, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"))
    return F.coalesce(latin + wide, F.lit(0))


def middle(c: Column, n: int = 2000) -> Column:
    """``n`` characters from the middle on, where the text is longer."""
    return F.when(F.length(c) > n, F.substring(c, (F.floor(F.length(c) / 2) + 1).cast("int"), n)).otherwise(c)


def fix_language(lang: Column, sample: Column) -> Column:
    """Korean without a Hangul character is Chinese."""
    return F.when((lang == "ko") & ~sample.rlike(r"\p{IsHangul}"), F.lit("zh")).otherwise(lang)


def script_language(sample: Column) -> Column:
    """Language by script: ko, ja, zh or en, from the counts of Hangul, kana, Han and Latin letters; 'en' for none."""
    ko, ja, zh, en = (F.regexp_count(sample, F.lit(f"[{p}]")) for p in (r"\p{IsHangul}", r"\p{IsHiragana}\p{IsKatakana}", r"\p{IsHan}", r"\p{IsLatin}"))
    most = F.greatest(ko, ja + zh, en)
    return (
        F.when(sample.isNull() | (most == 0) | (en == most), "en")
        .when(ko == most, "ko")
        .when(ja * 10 > ja + zh, "ja")
        .otherwise("zh")
    )


def path_fields(path: Column) -> Column:
    """Struct (title, id) of a relative path company/game[@x]/.../chapter[@x][_zh|_cn|_f].txt; a lone file gives its stem."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    company, game = F.element_at(parts, 1), F.split_part(F.try_element_at(parts, F.lit(2)), F.lit("@"), F.lit(1))
    chapter = F.regexp_replace(F.split_part(stem, F.lit("@"), F.lit(1)), r"(?i)(_zh|_cn|_f)+$", "")
    deep = F.size(parts) >= 2
    return F.struct(
        F.when(deep, F.concat(game, F.lit(" - "), chapter)).otherwise(F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"),
        F.when(deep, F.regexp_replace(F.concat_ws("_", company, game, chapter), r"(?U)[^\w\-]", "_")).otherwise(stem).alias("id"),
    )


def json_meta(meta: Column, names: tuple[str, ...] = ("url", "date")) -> Column:
    """Struct of string fields of a JSON object; null if the JSON is broken or has none of them."""
    got = [F.get_json_object(meta, f"$.{n}").alias(n) for n in names]
    return F.when(F.coalesce(*got).isNotNull(), F.struct(*got))


def wiki_page(title: Column, text: Column, base: str) -> Column:
    """A wiki page as text: titles ``[..]name`` only, redirects away; null for the others."""
    name = F.regexp_replace(title, r"^[^\]]*\]", "")
    keep = title.startswith("[") & title.contains("]") & ~text.startswith("#重定向 [[")
    url = F.concat(F.lit(base), F.replace(name, F.lit(" "), F.lit("_")))
    return F.when(keep, F.concat(F.lit("URL: "), url, F.lit("\n\n"), name, F.lit("\n\n"), text))


def question_answer(instruction: Column, response: Column, metadata: Column) -> Column:
    """URL, instruction and response as one text; parts that are null are ''."""
    url = F.coalesce(F.get_json_object(metadata, "$.url"), F.lit(""))
    return F.concat(F.lit("URL: "), url, F.lit("\n\n"), F.coalesce(instruction, F.lit("")), F.lit("\n\n"), F.coalesce(response, F.lit("")))


def normal_answer(c: Column) -> Column:
    """First line of an answer without book title marks, spaces and middle dots."""
    return F.translate(first_line(c), "《》 　·", "")


def without_marked_lines(text: Column, words: list[str], short: int = 1024) -> Column:
    """Drops lines with one of the words; of those with a chapter heading, keeps what begins there.

    A text under ``short`` characters with one of the words is dropped whole (null).
    """
    marked = "|".join("\\Q" + w + "\\E" for w in words)
    lines = F.transform(
        F.split(text, "\n", -1), lambda x: F.when(x.rlike(marked), F.nullif(F.regexp_extract(x, "第[零一二三四五六七八九十]+章.*$", 0), F.lit(""))).otherwise(x)
    )
    kept = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    return F.when(~((F.length(text) < short) & text.rlike(marked)), kept)


def any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words is a part of the text (false for null)."""
    return F.coalesce(text.rlike("|".join("\\Q" + w + "\\E" for w in words)), F.lit(False))


def long_enough(text: Column, least: int) -> Column:
    """Not blank and at least ``least`` code points."""
    return ~is_blank(text) & (F.length(text) >= least)


def repo_meta(repo: Column, path: Column, stars: Column, lang: Column) -> Column:
    """Metadata of a code file under the names the chunks use."""
    return F.struct(repo.alias("repo_name"), path.alias("path"), stars.alias("stars"), lang.alias("lang"))


def json_ready(df: DataFrame) -> DataFrame:
    """Columns as JSON can hold them: dates and times as ISO 8601, decimals as doubles, bytes as text (null if they are none)."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "binary":
            c = F.try_validate_utf8(c.cast("string"))
        out.append(c.alias(name))
    return df.select(*out)
