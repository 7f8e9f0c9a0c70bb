"""Readers, writers and streams on files made here."""

import json
import zipfile

from pyspark.sql import functions as F

from quern.operators import index as I
from quern.sources import readers, writers
from quern.streaming import clean as S


def test_json_lines_with_offsets(spark, tmp_path):
    folder = tmp_path / "games" / "formatted"
    folder.mkdir(parents=True)
    lines = ['{"source":"s","id":"é","split":0,"tokens":3,"text":"漢"}', "", "{broken", '{"id":"b","text":""}', '{"id":"c","text":"zz"}']
    (folder / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    at = str(folder / "a.jsonl")
    offsets, n = [], 0
    for x in lines:
        offsets.append(n)
        n += len(x.encode()) + 1
    got = [(r["idx"], r["source"], r["id"], r["byte_offset"]) for r in readers.index_scan(spark, [at]).orderBy("idx").collect()]
    assert got == [(0, "s", "é", offsets[0]), (1, "games", "b", offsets[3]), (2, "games", "c", offsets[4])]
    entries = spark.createDataFrame(
        [(0, at, offsets[0], None), (1, None, None, [(at, offsets[0]), (at, offsets[3]), (at, offsets[4])])],
        "idx long, file_path string, byte_offset long, parts array<struct<file_path:string,byte_offset:long>>",
    )
    assert sorted(map(tuple, readers.read_parts(entries, readers.lines_at(spark, at)).collect())) == [(0, "漢"), (1, "漢\n\nzz")]
    rows = readers.jsonl(spark, str(tmp_path), "id string, text string").collect()
    assert sum(r["_corrupt"] is not None for r in rows) == 1 and {r["id"] for r in rows} == {"é", "b", "c", None}


def test_folders_of_languages(spark, tmp_path):
    for lang in ("py", "formatted", "go"):
        (tmp_path / lang).mkdir()
        (tmp_path / lang / "x.jsonl").write_text('{"content":"c"}\n')
    assert sorted(r["lang"] for r in readers.jsonl_by_folder(spark, str(tmp_path), "content string").collect()) == ["go", "py"]


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文\r\n行".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("ü\rx".encode())
    assert dict((r["name"], r["text"]) for r in readers.texts(spark, str(tmp_path)).collect()) == {"a": "中文\n行", "b": "ü\nx"}


def test_epub(spark, tmp_path):
    container = '<container><rootfiles><rootfile full-path="OPS/fb.opf"/></rootfiles></container>'
    opf = '<package mlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="no.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="n"/><itemref idref="a"/></spine></package>'
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("META-INF/container.xml", container)
        z.writestr("OPS/fb.opf", opf)
        z.writestr("OPS/a.xhtml", "<html><body><div><p>one &amp; <b>two</b></p><script>no()</script></div></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><p><ruby>漢<rt>かん</rt></ruby>字</p></body></html>")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    got = {r["name"]: r["text"] for r in readers.epubs(spark, str(tmp_path)).collect()}
    assert got == {"x": "漢字\n[PAGE_SEP]\none & two", "bad": None}
    pages = spark.createDataFrame([(got["x"],)], "t string").select(readers.pages_map(F.col("t")).alias("p")).first()["p"]
    assert pages["total_pages"] == 2 and pages["total_words"] == 4 and pages["texts"]["1"]["text"] == "one & two"


def test_quiz(spark):
    lines = ["lead", "题目：q1", "选项：", "A", "B", "答案：A", "", "题目：q2", "C", "答案：", "题目：q3"]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    got = sorted(tuple(r) for r in readers.quiz_blocks(df).collect())
    assert got == [(1, "q1", "A\nB", "A"), (2, "q2", "C", ""), (3, "q3", "", "")]


def test_tables(spark, tmp_path):
    (tmp_path / "i.csv").write_text('zid,title,x\n1,"a, b",2\n')
    assert [tuple(r) for r in readers.csv_index(spark, str(tmp_path / "i.csv"), ["zid", "title"]).collect()] == [("1", "a, b")]
    (tmp_path / "d.json").write_text('{"meta":\n{"id":"7"}}')
    assert readers.json_documents(spark, str(tmp_path / "d.json"), "meta struct<id:string>").first()["meta"]["id"] == "7"
    df = spark.createDataFrame([(i, "ab"[i % 2], i // 2) for i in range(6)], "k int, lang string, shard int")
    writers.write_by_key(df, str(tmp_path / "by"), "lang")
    writers.write_shards(df, str(tmp_path / "sh"), "shard", "k")
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"lang=a", "lang=b"}
    one = next((tmp_path / "sh" / "shard=1").glob("*.json")).read_text().splitlines()
    assert [json.loads(x)["k"] for x in one] == [2, 3]
    entries = spark.createDataFrame([(0, "s", "a", 0, 5), (1, "s", "a", 1, 5)], "idx long, source string, id string, split int, tokens int")
    entries = entries.withColumn("parts", F.lit(None).cast("array<struct<file_path:string,byte_offset:long>>"))
    assert writers.write_index(entries, I.pairs(entries), str(tmp_path / "ix")) == {"entries": 2, "pairs": 1}


def test_streams(spark, tmp_path):
    schema = "cvid long, title string, content string, words int, views long, likes long"
    spark.createDataFrame([(1, "t", "正" * 400, 400, 50, 1), (2, "t", None, 1, 1, 1)], schema).write.parquet(str(tmp_path / "in"))
    out = S.drain(spark, S.cleaned_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    assert sorted((r["cvid"], r["reason"]) for r in out.collect()) == [(1, "passed"), (2, "empty")]
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "b")], "ts string, k string").selectExpr("cast(ts as timestamp_ntz) ts", "k")
    rows.write.parquet(str(tmp_path / "ev"))
    seen = S.drain(spark, S.first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev")), "ts", "k"), str(tmp_path / "seen"))
    assert sorted(r["k"] for r in seen.collect()) == ["a", "b"]


def test_jdbc_table_and_keyset_pages(spark, tmp_path):
    """An embedded database in memory; a copy that goes on where it stopped."""
    url, own = "jdbc:derby:memory:quern;create=true", spark.range(1, 101).selectExpr("id AS k", "id * 2 AS v")
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    own.write.jdbc(url, "t", mode="overwrite", properties=driver)
    got = readers.jdbc_table(spark, url, "t", "K", 1, 101, 3, **driver)
    assert got.rdd.getNumPartitions() == 3 and sorted(tuple(r) for r in got.collect()) == [(i, 2 * i) for i in range(1, 101)]
    at = str(tmp_path / "pages")
    assert readers.keyset_pages(got, "K", at, 10, 40) == 100
    read = lambda: sorted(r[0] for r in spark.read.schema("k long").option("recursiveFileLookup", "true").json(at).collect())
    assert read() == list(range(11, 101))
    more = own.unionByName(spark.range(101, 106).selectExpr("id AS k", "id * 2 AS v"))
    assert readers.keyset_pages(more, "K", at, 100, 40) == 105 and read() == list(range(11, 106))


def test_offsets_with_marks_and_carriage_returns(spark, tmp_path):
    (tmp_path / "b c+1.jsonl").write_bytes("\ufeff{\"a\":1}\r\n\r\n{\"a\":\"漢\"}".encode())
    (tmp_path / "a.jsonl").write_bytes(b"x\ny\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "no.txt").write_bytes(b"z")
    paths = readers.listing(spark, [str(tmp_path / "none"), str(tmp_path)])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.jsonl", "b c+1.jsonl", "empty.jsonl"]
    got = sorted((r["file_path"].rsplit("/", 1)[1], r["line_no"], r["byte_offset"], r["line"]) for r in readers.lines_at(spark, paths, number=True).collect())
    assert got == [("a.jsonl", 0, 0, "x"), ("a.jsonl", 1, 2, "y"), ("b c+1.jsonl", 0, 3, '{"a":1}'), ("b c+1.jsonl", 1, 12, ""), ("b c+1.jsonl", 2, 14, '{"a":"漢"}')]
    assert readers.lines_at(spark, []).count() == 0


def test_neighbour_lists_and_texts(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.95), ("b", "c", 0.8)], "src string, dst string, sim double")
    writers.write_neighbours(pairs, str(tmp_path / "near"))
    lists = {r["key"]: [(x["other"], x["sim"]) for x in r["near"]] for r in spark.read.json(str(tmp_path / "near")).collect()}
    assert lists == {"a": [("c", 0.95), ("b", 0.9)], "b": [("a", 0.9), ("c", 0.8)], "c": [("a", 0.95), ("b", 0.8)]}
    writers.write_texts(spark.createDataFrame([("n1", "a\nb"), ("n2", None)], "n string, t string"), str(tmp_path / "texts"), "n", "t")
    assert sorted((r["path"].rsplit("n=", 1)[1][:2], r["text"]) for r in readers.texts(spark, str(tmp_path / "texts")).collect()) == [("n1", "a\nb\n"), ("n2", "\n")]
