"""Readers and writers: tables written through each writer, read through each reader, compared with the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import fields as X
from quern.functions.text import pages_in_order
from quern.operators import chunk
from quern.operators import index as I
from quern.plans.article_queries import LATEST, latest_articles
from quern.plans.text_queries import CHARS, sql_chunks
from quern.registry import Registry
from quern.session import scratch
from quern.sources import readers, writers
from quern.tables import table

R = Registry()


@R.query("io_json_lines", "SELECT doc_id, title, md5(text) AS h, n_chars FROM documents")
def io_json_lines(spark, d):
    """B1, A1 and A2: JSON lines, written and read from a folder."""
    writers.write_jsonl(table(spark, d, "documents").select("doc_id", "title", "text", "n_chars"), at := scratch(spark, "lines"))
    rows = readers.jsonl(spark, at, "doc_id long, title string, text string, n_chars long", "*.json")
    return rows.filter("_corrupt is null").select("doc_id", "title", F.md5("text").alias("h"), "n_chars")


@R.query("io_parquet_to_json", "SELECT doc_id, lang, length(text) AS chars FROM documents")
def io_parquet_to_json(spark, d):
    """All Parquet files of a folder as JSON lines, then some columns of Parquet again."""
    writers.parquet_to_jsonl(spark, f"{d}/documents.parquet", at := scratch(spark, "union"))
    rows = readers.jsonl(spark, at, "doc_id long, lang string, text string, n_chars long", "*.json")
    rows.select("doc_id", "lang", "text").write.parquet(back := scratch(spark, "columns"))
    return readers.parquet_columns(spark, back, ["doc_id", "lang", "text"]).select("doc_id", "lang", F.length("text").alias("chars"))


@R.query("io_by_folder", "SELECT doc_id, source AS lang, coalesce(source, '') || '_' || doc_id AS id FROM documents WHERE source IS NOT NULL")
def io_by_folder(spark, d):
    """A folder a key, the key read from the folder, ids prefixed with it."""
    docs = table(spark, d, "documents").filter("source is not null").select("doc_id", "source", "text")
    writers.write_by_key(docs, at := scratch(spark, "folders"), "source")
    rows = readers.jsonl_by_folder(spark, at, "doc_id long, text string", pattern="*.json")
    return rows.select("doc_id", "lang", X.prefixed_id(F.col("lang"), F.col("doc_id")).alias("id"))


@R.query("io_json_documents", "SELECT DISTINCT meta.id AS id, meta.title AS title, cardinality(texts) AS pages FROM novels WHERE meta.id IS NOT NULL")
def io_json_documents(spark, d):
    """Documents with nested fields by language, read as JSON documents."""
    own = table(spark, d, "novels").filter("meta.id is not null").select("meta", "texts", F.coalesce("meta.language", F.lit("none")).alias("lang"))
    writers.write_by_key(own, at := scratch(spark, "documents"), "lang")
    rows = spark.read.schema("meta struct<id:string,title:string>, texts map<string,struct<words:int,text:string>>").json(at)
    return rows.select("meta.id", "meta.title", F.size("texts").alias("pages")).distinct()


@R.query("io_shards", "SELECT doc_id, (doc_id // 500)::BIGINT AS shard, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1 AS line FROM documents")
def io_shards(spark, d):
    """Shards of fixed size, each a file in order, read with line numbers."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 500).alias("shard"))
    writers.write_shards(docs, at := scratch(spark, "shards"), "shard", "doc_id")
    folders = [f"{at}/{n}" for n in _folders(spark, at)]
    lines = readers.lines_at(spark, readers.listing(spark, folders, ".json"), number=True)
    shard = F.regexp_extract("file_path", "shard=([0-9]+)/", 1).cast("bigint")
    return lines.select(F.get_json_object("line", "$.doc_id").cast("bigint").alias("doc_id"), shard.alias("shard"), F.col("line_no").alias("line"))


def _folders(spark, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory())


@R.query(
    "io_index_scan",
    f"WITH RECURSIVE {sql_chunks('documents', 'doc_id', CHARS)} SELECT CAST(ch.doc_id AS VARCHAR) AS id, coalesce(t.source, '') AS source, split, tokens, md5(ch.text) AS h FROM ch JOIN documents t ON t.doc_id = ch.doc_id",
)
def io_index_scan(spark, d):
    """Chunk files listed and scanned for entries with byte offsets, stored, and their texts read by offset."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("source", F.lit("")).alias("source"), "text")
    writers.write_jsonl(chunk.chunks(docs, ["source", "id"], "text", chunk.CharTokenizer(), 512), at := scratch(spark, "chunks"))
    paths = readers.listing(spark, [at, f"{at}-missing"], ".json")
    found = readers.index_scan(spark, paths).withColumn("parts", F.lit(None).cast("array<struct<file_path:string,byte_offset:bigint>>"))
    writers.write_index(found, I.pairs(found), kept := scratch(spark, "index"))
    entries = spark.read.parquet(f"{kept}/entries")
    texts = readers.read_parts(entries, readers.lines_at(spark, paths))
    return entries.join(texts, "idx").select("id", "source", "split", "tokens", F.md5("text").alias("h"))


@R.query("io_line_ids", "SELECT coalesce(nullif(title, ''), 'pages_' || (row_number() OVER (ORDER BY doc_id) - 1)) AS id, doc_id FROM documents WHERE text IS NOT NULL")
def io_line_ids(spark, d):
    """A4 and C17: records without a title are named by their file and line."""
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", "title")
    rows = rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    writers.write_jsonl(rows, at := scratch(spark, "pages"))
    # The parts of the file are in the order of the records; a line's number counts over all of them.
    lines = readers.lines_at(spark, readers.listing(spark, [at], ".json"), number=True)
    ends = lines.groupBy("file_path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(ends.select("file_path", before.alias("before")), "file_path").withColumn("line_no", F.col("line_no") + F.col("before"))
    v = F.from_json("line", "doc_id long, title string")
    return lines.select(v.alias("v"), "line_no").select(X.id_or_line(F.col("v.title"), F.lit("pages"), F.col("line_no")).alias("id"), "v.doc_id")


@R.query("io_csv_index", f"WITH a AS ({LATEST}) SELECT CAST(cvid AS VARCHAR) AS cvid, title FROM a WHERE title IS NOT NULL AND title <> ''")
def io_csv_index(spark, d):
    """A CSV index with a header, some columns of it."""
    own = latest_articles(spark, d).filter("title is not null and title <> ''").select("cvid", "words", "title")
    own.write.option("header", "true").option("escape", '"').csv(at := scratch(spark, "csv"))
    return readers.csv_index(spark, at, ["cvid", "title"])


@R.query("io_predictions", "SELECT cvid, predict FROM predictions")
def io_predictions(spark, d):
    """Predictions as JSON lines."""
    writers.write_jsonl(table(spark, d, "predictions"), at := scratch(spark, "predictions"))
    return readers.jsonl(spark, at, "cvid long, predict string", "*.json").select("cvid", "predict")


@R.query(
    "io_texts",
    "SELECT DISTINCT meta.id AS title, md5(regexp_replace(replace(replace(e.value.text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\x{FEFF}', '')) AS h "
    "FROM (SELECT meta, unnest(map_entries(texts)) AS e FROM novels WHERE meta.id IS NOT NULL) WHERE e.key = '1' AND e.value.text IS NOT NULL AND e.value.text <> ''",
)
def io_texts(spark, d):
    """A text file a novel (its first page), read with its name as title and one kind of line end."""
    pages = table(spark, d, "novels").filter("meta.id is not null").select(F.col("meta.id").alias("id"), F.inline(pages_in_order(F.col("texts")))).filter("page = 1")
    writers.write_texts(pages.select("id", "text").distinct(), at := scratch(spark, "texts"), "id", "text")
    rows = readers.texts(spark, at)
    return rows.select(F.regexp_extract("path", "id=([^/]+)/", 1).alias("title"), F.md5(F.regexp_replace("text", r"\n\z", "")).alias("h"))


@R.query(
    "io_neighbours",
    """SELECT CAST(idx AS VARCHAR) AS key, array_to_string(list_sort(list(o)), ',') AS near FROM (SELECT s.o_custkey + 1 AS idx, CAST(s.o_orderkey AS VARCHAR) AS o FROM orders s) GROUP BY idx""",
)
def io_neighbours(spark, d):
    """Pairs as adjacency lists."""
    pairs = table(spark, d, "orders").select((-F.col("o_custkey") - 1).alias("src"), F.col("o_orderkey").alias("dst"), F.lit(1.0).alias("sim"))
    writers.write_neighbours(pairs, at := scratch(spark, "near"))
    rows = spark.read.schema("key long, near array<struct<other:long,sim:double>>").json(at).filter("key < 0")
    names = F.array_sort(F.transform("near", lambda x: x["other"].cast("string")))
    return rows.select((-F.col("key")).cast("string").alias("key"), F.array_join(names, ",").alias("near"))


@R.query("io_json_lengths", "SELECT doc_id, length(to_json({'doc_id': doc_id, 'title': title, 'text': text})) AS n FROM documents WHERE title IS NOT NULL AND text IS NOT NULL")
def io_json_lengths(spark, d):
    """B2: lengths of rows as compact JSON."""
    docs = table(spark, d, "documents").filter("title is not null and text is not null").select("doc_id", "title", "text")
    return docs.select("doc_id", writers.json_length(docs).alias("n"))


@R.query("io_keyset", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100")
def io_keyset(spark, d):
    """A table copied page by page from a given key on, stopped after its end."""
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    size = max(1000, -(-own.count() // 4))
    readers.keyset_pages(own, "o_orderkey", at := scratch(spark, "keyset"), 100, size)
    return spark.read.schema("o_orderkey long, o_custkey long").option("recursiveFileLookup", "true").json(at)


@R.query(
    "io_quiz",
    f"""WITH a AS ({LATEST}), q AS (SELECT cvid, row_number() OVER (ORDER BY cvid) AS block, 'q' || cvid AS question, coalesce(CAST(words AS VARCHAR), 'none') AS o1, CAST(mid AS VARCHAR) AS o2, 'a' || (cvid % 7) AS answer FROM a)
    SELECT block, question, o1 || chr(10) || o2 AS options, answer FROM q""",
)
def io_quiz(spark, d):
    """Stanzas of lines as questions, options and answers."""
    a = latest_articles(spark, d)
    lines = [F.concat(F.lit("题目：q"), F.col("cvid").cast("string")), F.lit("选项："), F.coalesce(F.col("words").cast("string"), F.lit("none")), F.col("mid").cast("string"), F.lit(""), F.concat(F.lit("答案：a"), (F.col("cvid") % 7).cast("string"))]
    own = a.select("cvid", F.posexplode(F.array(*lines)).alias("pos", "line")).select((F.col("cvid") * len(lines) + F.col("pos")).alias("n"), "line")
    return readers.quiz_blocks(own)
