"""Readers: JSON lines, texts of unknown encoding, EPUB, tables, with positions where they matter."""

from __future__ import annotations

import io
import re
import zipfile
from html import unescape
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import is_blank, strip
from quern.operators.prefix import running_sum_by
from quern.session import cut


def _glob(spark: SparkSession, path: str) -> str:
    """A folder means all files below it; a missing path is an error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return path


def listing(spark: SparkSession, folders: list[str], suffix: str = ".jsonl") -> list[str]:
    """Files with the suffix directly in each folder, sorted by name, folder by folder; missing folders are skipped."""
    jvm, out = spark.sparkContext._jvm, []
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.getFileStatus(p).isDirectory():
            names = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isFile())
            out += [f"{folder.rstrip('/')}/{n}" for n in names if n.endswith(suffix)]
    return out


def jsonl(spark: SparkSession, path: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """JSON lines of a file or of all files below a folder, with ``_corrupt`` for lines that are no JSON.

    Blank lines are skipped; broken bytes become U+FFFD.  Nothing is inferred.
    """
    own = f"{schema}, _corrupt string"
    reader = spark.read.option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    at = _glob(spark, path)
    return (reader.option("pathGlobFilter", pattern) if not at.endswith(".jsonl") else reader).schema(own).json(at)


def jsonl_by_folder(spark: SparkSession, root: str, schema: str, skip: str = "formatted", pattern: str = "*.jsonl") -> DataFrame:
    """JSON lines of root/{lang}/*.jsonl, with ``lang``; one folder name is skipped, and of ``key=value`` the value counts."""
    rows = spark.read.schema(schema).json(f"{_glob(spark, root)}/*/{pattern}").withColumn("lang", F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]+$", 1))
    return rows.filter(F.col("lang") != skip)


def plain_path(c: Column) -> Column:
    """The path of a file URL: no scheme in front of a local path, no escapes."""
    raw = F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(raw, "^file:/+", "/")


def _as_given(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``_path, _given``: the full path of each file and the path it was given by; a row a path of the list the driver holds anyway."""
    jvm, rows = spark.sparkContext._jvm, []
    for given in paths:
        p = jvm.org.apache.hadoop.fs.Path(given)
        full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
        rows.append((re.sub("^file:/+", "/", full), given))
    return spark.createDataFrame(rows, "_path string, _given string").dropDuplicates(["_path"])


def lines_at(spark: SparkSession, paths: str | list[str], number: bool = False) -> DataFrame:
    """``file_path, byte_offset, line`` of text files: the byte at which each line begins; with ``number`` also ``line_no`` from 0.

    ``file_path`` is a file's path as it was given, or its full path where a folder was given.
    Files are read in splits.  A line's offset is the sum of the lengths before it: in its split by a
    window, and over the splits of a file by their totals.  A byte order mark at the beginning of a file
    belongs to no line but counts in the offsets.
    """
    paths = [paths] if isinstance(paths, str) else paths
    for p in paths:
        _glob(spark, p)
    if not paths:
        return spark.createDataFrame([], "file_path string, byte_offset long, line string" + (", line_no long" if number else ""))
    rows = spark.read.option("lineSep", "\n").text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"), (F.octet_length("value") + 1).cast("long").alias("_n"), F.col("value").alias("line"),
    )
    # Written, so that the order inside a split is fixed.
    rows = cut(rows, "lines")
    # What the lines don't account for is a mark of three bytes at the beginning; a missing last line end makes one byte too many.
    marks = rows.groupBy("file_path").agg((F.max("_size") - F.sum("_n")).alias("_rest")).select("file_path", F.when(F.col("_rest") >= 2, 3).otherwise(0).alias("_mark"))
    out = running_sum_by(rows, ["file_path"], F.col("_split"), [F.col("_at")], F.col("_n"), "_end")
    if number:
        out = running_sum_by(out, ["file_path"], F.col("_split"), [F.col("_at")], F.lit(1), "_no").withColumn("line_no", F.col("_no") - 1).drop("_no")
    out = out.join(marks, "file_path")
    # A carriage return before the line end is no part of the line.
    line = F.regexp_replace("line", "\\r$", "")
    out = out.join(F.broadcast(_as_given(spark, paths)), F.col("file_path") == F.col("_path"), "left").withColumn("file_path", F.coalesce("_given", "file_path"))
    return out.select("file_path", (F.col("_end") - F.col("_n") + F.col("_mark")).alias("byte_offset"), line.alias("line"), *(["line_no"] if number else []))


def index_scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Index entries of chunk files: ``idx, source, id, split, tokens, file_path, byte_offset``.

    idx follows the order of the paths and then of the offsets.  Blank and broken lines are skipped, but
    count in the offsets; a missing source is the folder two levels up, other fields have defaults.
    """
    numbered = spark.createDataFrame([(n, p) for n, p in enumerate(paths)], "_file long, file_path string")
    # One row a path of the list the driver holds anyway.
    rows = lines_at(spark, paths).join(F.broadcast(numbered), "file_path")
    got = F.from_json("line", "source string, id string, split int, tokens int, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = rows.filter(~is_blank(F.col("line"))).withColumn("_v", got).filter("_v is not null and _v._bad is null")
    above = F.regexp_extract("file_path", r"([^/]+)/[^/]*/[^/]*$", 1)
    rows = rows.select(
        "_file", "file_path", "byte_offset", F.coalesce("_v.source", above).alias("source"), F.coalesce("_v.id", F.lit("")).alias("id"),
        F.coalesce("_v.split", F.lit(0)).alias("split"), F.coalesce("_v.tokens", F.lit(0)).alias("tokens"),
    ).withColumn("_all", F.lit(0))
    # Cells of a megabyte, in the order of file and offset.
    cell = F.col("_file") * F.lit(1 << 40) + F.floor(F.col("byte_offset") / (1 << 20))
    rows = running_sum_by(rows, ["_all"], cell, [F.col("_file"), F.col("byte_offset")], F.lit(1), "idx")
    return rows.select((F.col("idx") - 1).alias("idx"), "source", "id", "split", "tokens", "file_path", "byte_offset")


def read_parts(entries: DataFrame, lines: DataFrame, text: str = "text") -> DataFrame:
    """``idx, text``: the stored text of each entry; the parts of a merged one joined by a blank line, empty ones skipped."""
    one = F.when(F.col("parts").isNotNull(), F.col("parts")).otherwise(F.array(F.struct("file_path", "byte_offset")))
    each = entries.select("idx", F.posexplode(one).alias("n", "p")).select("idx", "n", "p.file_path", "p.byte_offset")
    body = lines.select("file_path", "byte_offset", F.get_json_object("line", f"$.{text}").alias("t"))
    got = each.join(body, ["file_path", "byte_offset"]).filter("t is not null and t <> ''")
    return got.groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8, else GB18030, else Latin-1; line ends of any kind become a line feed."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8-sig", "gb18030", "latin-1"):
            try:
                return raw.decode(name).replace("\r\n", "\n").replace("\r", "\n")
            except UnicodeDecodeError:
                continue
        return ""

    return content.map(one)


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``path, name, text`` of text files of unknown encoding below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(_glob(spark, path))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return files.select("path", name.alias("name"), decode_text("content").alias("text"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; unreadable ones are rows with ``_corrupt``."""
    reader = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    return reader.option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(_glob(spark, path))


def csv_index(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of a CSV file with a header, as strings."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(_glob(spark, path)).select(*columns)


def parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of all Parquet files below a folder; the others aren't read."""
    return spark.read.option("recursiveFileLookup", "true").parquet(_glob(spark, path)).select(*columns)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, batch: int = 10_000, **options: str) -> DataFrame:
    """A database table read in ranges of its key, one range a task; credentials come as options."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", batch)
    reader = reader.option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return reader.options(**options).load()


def keyset_pages(df: DataFrame, key: str, path: str, after: int, size: int) -> int:
    """Copies the rows with a key above ``after`` as JSON lines, page by page in the order of the key; gives the last key copied.

    Each page is one folder below ``path`` named by its first bound, so a stopped copy goes on from the last
    key.  Meant for sources that only answer to ranges; a table Spark can read is read whole (``jdbc_table``).
    """
    # JSON fields are told apart by case, columns aren't.
    key = next(c for c in df.columns if c.lower() == key.lower())
    while True:
        page = df.filter(F.col(key) > after).orderBy(key).limit(size)
        page.write.mode("overwrite").json(f"{path}/after={after}")
        last = df.sparkSession.read.schema(f"{key} bigint").json(f"{path}/after={after}").agg(F.max(key)).first()[0]
        if last is None:
            return after
        after = last


_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br", "section", "article", "blockquote", "ul", "ol", "table", "body", "title"}
_SILENT = {"script", "style", "rt", "rp", "head"}
PAGE_BREAK = "\n[PAGE_SEP]\n"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data)


def page_text(markup: str) -> str:
    """Text of a page: a line a block, without scripts, styles and ruby readings."""
    parser = _Text()
    parser.feed(re.sub(r"<(script|style|rt|rp)\b([^>]*)/>", "", markup))
    parser.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in unescape("".join(parser.out)).split("\n"))
    return "\n".join(x for x in lines if x)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(raw: bytes) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        # A misspelt namespace attribute is the usual fault of such files.
        return ElementTree.fromstring(re.sub(rb"\bmlns(:\w+)?=", rb"xmlns\1=", re.sub(rb"\bxmlns", b"mlns", raw)))


def epub_text(raw: bytes) -> str | None:
    """Pages of a book in reading order, joined by page marks; pages that fail are left out, None if the book can't be opened."""
    try:
        book = zipfile.ZipFile(io.BytesIO(raw))
        container = _xml(book.read("META-INF/container.xml"))
        root = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        package = _xml(book.read(root))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        return None
    items = {e.get("id"): e for e in package.iter() if _local(e.tag) == "item"}
    pages = []
    for ref in (e for e in package.iter() if _local(e.tag) == "itemref"):
        item = items.get(ref.get("idref"))
        if item is None or "html" not in (item.get("media-type") or ""):
            continue
        try:
            data = book.read(normpath(join(dirname(root), item.get("href"))))
        except KeyError:
            continue
        charset = re.search(rb"(?:encoding|charset)=[\"']?([\w-]+)", data[:400])
        try:
            markup = data.decode(charset.group(1).decode() if charset else "utf-8")
        except (LookupError, UnicodeDecodeError):
            markup = data.decode("gb18030", errors="replace")
        text = page_text(markup)
        if text:
            pages.append(text)
    return PAGE_BREAK.join(pages)


def epubs(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, text`` of the EPUB books below a folder; text is null for those that can't be opened."""

    @F.pandas_udf(T.StringType())
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: None if raw is None else epub_text(bytes(raw)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(_glob(spark, path))
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.epub$", 1).alias("name"), read("content").alias("text"))


def pages_map(text: Column, mark: str = "[PAGE_SEP]") -> Column:
    """Struct (texts, total_words, total_pages) of a text with page marks: a map page number -> (words, text)."""
    from quern.functions.fields import count_words

    parts = F.transform(F.split(text, "\\Q" + mark + "\\E", -1), lambda x: strip(x))
    pages = F.transform(parts, lambda x, i: F.struct(i.cast("string").alias("key"), F.struct(count_words(x).alias("words"), x.alias("text")).alias("value")))
    total = F.aggregate(pages, F.lit(0), lambda a, x: a + x["value"]["words"])
    return F.struct(F.map_from_entries(pages).alias("texts"), total.alias("total_words"), F.size(pages).alias("total_pages"))


def quiz_blocks(lines: DataFrame, number: str = "n", line: str = "line") -> DataFrame:
    """``block, question, options, answer`` of stanzas of lines.

    A stanza begins at a line with the question mark word; a line with the answer word ends its options;
    every other line after the question is an option.  Blank lines and lines before the first stanza
    don't count.  ``block`` counts from 1.
    """
    own = lines.select(F.col(number).alias("n"), strip(F.col(line)).alias("t"), F.lit(0).alias("_all")).filter("t <> ''")
    own = running_sum_by(own, ["_all"], F.floor(F.col("n") / 100_000), [F.col("n")], F.col("t").startswith("题目：").cast("int"), "block").filter("block > 0")
    t = F.col("t")
    rest = ~t.startswith("题目：") & ~t.startswith("答案：") & (t != "选项：")
    return own.groupBy("block").agg(
        F.max(F.when(t.startswith("题目："), strip(F.substring(t, 4, 1 << 30)))).alias("question"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(rest, F.struct("n", "t")))), lambda x: x["t"]), "\n").alias("options"),
        F.coalesce(F.max_by(F.when(t.startswith("答案："), strip(F.substring(t, 4, 1 << 30))), F.when(t.startswith("答案："), F.col("n"))), F.lit("")).alias("answer"),
    )
