"""The pN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import boilerplate, bpe, mixing, neardup, packing, pieces, spam, splits
from quern.registry import Registry
from quern.tables import table

R = Registry()

# SQL: full-width ASCII forms and the ideographic space as the plain characters; white space of any kind.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " "
SPACE = r"[\t-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PAGES = """SELECT site, meta.id AS id, meta.title AS title, e.key AS key, e.value.text AS text
  FROM (SELECT site, meta, unnest(map_entries(texts)) AS e FROM novels WHERE meta.id IS NOT NULL) WHERE e.value.text IS NOT NULL AND e.value.text <> ''"""


def sql_tidy(x: str) -> str:
    return f"regexp_replace(lower(translate({x}, '{WIDE}', '{PLAIN}')), '{SPACE}+', '', 'g')"


P2_SQL = f"""
    WITH t AS (SELECT DISTINCT id, regexp_replace(lower(translate(t, '{WIDE}', '{PLAIN}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t
      FROM (SELECT id, string_agg(text, '' ORDER BY CAST(key AS INTEGER)) AS t FROM (SELECT DISTINCT id, key, text FROM ({PAGES})) GROUP BY id)),
    g AS (SELECT DISTINCT id, substr(t, i, 8) AS g FROM (SELECT id, t, unnest(range(1, length(t) - 6)) AS i FROM t WHERE length(t) >= 8)),
    n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
    c AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
    SELECT x AS id_a, y AS id_b FROM c JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE c >= 0.7 * (p.n + q.n - c)"""

P3_SQL = f"""
    WITH p AS (SELECT DISTINCT coalesce(site, '') AS site, id, title, CAST(key AS INTEGER) AS page, text FROM ({PAGES})),
    l AS (SELECT site, id, title, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM p),
    k AS (SELECT site, id, page, line_no, CASE WHEN title IS NULL OR title = 'Unknown' OR {sql_tidy('title')} = '' THEN {sql_tidy('line')}
      ELSE replace({sql_tidy('line')}, {sql_tidy('title')}, chr(1)) END AS x FROM l),
    d AS (SELECT site, id, page, line_no, regexp_replace(x, '[0-9]+', chr(2), 'g') AS x FROM k WHERE x <> ''),
    s AS (SELECT site, count(DISTINCT id) AS n FROM p GROUP BY site),
    b AS (SELECT d.site, x FROM d JOIN s ON s.site = d.site GROUP BY d.site, x, n HAVING count(DISTINCT id) >= 4 AND count(DISTINCT id) >= 0.2 * n)
    SELECT DISTINCT id, page, line_no::INTEGER AS line_no FROM d JOIN b ON b.site = d.site AND b.x = d.x"""

P4_SQL = f"""
    WITH i AS (SELECT 'article' AS kind, CAST(cvid AS VARCHAR) AS item_id, content AS t FROM articles WHERE cvid IS NOT NULL
      UNION SELECT 'novel', id, string_agg(text, chr(10) || chr(10) ORDER BY CAST(key AS INTEGER)) FROM (SELECT DISTINCT id, key, text FROM ({PAGES})) GROUP BY id),
    o AS (SELECT kind, item_id, list_max(list_transform(string_split(regexp_replace(regexp_replace(t, '([\n。！？!?…；])', '\\1' || chr(3), 'g'), '\\.({SPACE})', '.' || chr(3) || '\\1', 'g'), chr(3)), lambda x: length(x))) AS most
      FROM i WHERE length(t) > 2000)
    SELECT kind, item_id, 'oversized' AS need FROM o UNION ALL SELECT kind, item_id, 'unbroken' FROM o WHERE most > 2000"""


@R.query("p1_found")
def p1_found(spark, d):
    return splits.found(table(spark, d, "index_entries"))


@R.query("p1_split")
def p1_split(spark, d):
    return splits.assign(table(spark, d, "index_entries"))


@R.query("p1_shares")
def p1_shares(spark, d):
    return splits.shares(splits.assign(table(spark, d, "index_entries")))


@R.query("p2_found", P2_SQL)
def p2_found(spark, d):
    return neardup.found(neardup.novel_texts(table(spark, d, "novels")))


@R.query("p2_groups")
def p2_groups(spark, d):
    return neardup.groups(neardup.novel_texts(table(spark, d, "novels")))


@R.query("p3_found", P3_SQL)
def p3_found(spark, d):
    return boilerplate.found(table(spark, d, "novels"))


P3_CLEAN_SQL = f"""
    WITH RECURSIVE pairs AS MATERIALIZED ({P2_SQL}), e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
    tc AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON e.a = tc.b), root AS (SELECT a AS id, least(a, min(b)) AS root FROM tc GROUP BY a),
    v AS (SELECT DISTINCT coalesce(site, '') AS site, meta.id AS id, meta.title AS title, crawled_at::DATE AS day, x.key AS page, x.value.text AS text FROM (SELECT site, meta, crawled_at, unnest(map_entries(texts)) AS x FROM novels)),
    p AS (SELECT v.*, coalesce(r.root, v.id) AS cluster FROM v LEFT JOIN root r ON r.id = v.id),
    l AS (SELECT site, id, title, day, page, cluster, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM p WHERE text IS NOT NULL AND text <> ''),
    k AS (SELECT *, CASE WHEN title IS NULL OR title = 'Unknown' OR {sql_tidy('title')} = '' THEN {sql_tidy('line')} ELSE replace({sql_tidy('line')}, {sql_tidy('title')}, chr(1)) END AS y FROM l),
    d AS (SELECT *, regexp_replace(y, '[0-9]+', chr(2), 'g') AS x FROM k),
    n AS (SELECT site, count(DISTINCT cluster) AS n FROM p WHERE id IS NOT NULL AND text IS NOT NULL AND text <> '' GROUP BY site),
    f AS (SELECT site, x, cluster, min(day) AS day FROM d WHERE id IS NOT NULL AND x <> '' GROUP BY site, x, cluster),
    b AS (SELECT f.site, x FROM f JOIN n ON n.site = f.site GROUP BY f.site, x, n HAVING count(*) >= 4 AND count(*) >= 0.2 * n AND count(DISTINCT day) >= 2),
    c AS (SELECT d.site, d.id, d.page, d.text, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (b.x IS NULL), '') AS clean FROM d LEFT JOIN b ON b.site = d.site AND b.x = d.x GROUP BY d.site, d.id, d.page, d.text)
    SELECT site, id, page, clean AS text FROM c UNION ALL SELECT DISTINCT site, id, page, text FROM v WHERE text IS NULL OR text = ''"""


@R.query("p3_clean", P3_CLEAN_SQL)
def p3_clean(spark, d):
    return boilerplate.cleaned(table(spark, d, "novels"))


P3_REPUBLISHED_SQL = f"""
    WITH n AS (SELECT coalesce(site, '') AS site, min(meta.id) AS id, count(DISTINCT meta.id) AS n FROM novels WHERE meta.id IS NOT NULL GROUP BY 1),
    own AS (SELECT DISTINCT n.site, n.n, p.id, p.title, CAST(p.key AS INTEGER) AS page, p.text FROM ({PAGES}) p JOIN n ON n.site = coalesce(p.site, '') AND n.id = p.id),
    f AS ({P3_SQL})
    SELECT o.site, o.page, c.c AS copy, md5(array_to_string(list_filter(list_transform(range(0, len(string_split(o.text, chr(10)))), lambda i: CASE WHEN list_contains(coalesce(x.l, []), i::INTEGER) THEN NULL ELSE string_split(o.text, chr(10))[i + 1] END), lambda t: t IS NOT NULL), chr(10))) AS h
    FROM own o LEFT JOIN (SELECT id, page, list(line_no) AS l FROM f GROUP BY id, page) x ON x.id = o.id AND x.page = o.page, LATERAL (SELECT unnest(range(1, greatest(4, ceil(n / 4))::BIGINT + 1)) AS c) c"""


@R.query("p3_republished", P3_REPUBLISHED_SQL)
def p3_republished(spark, d):
    """Each site publishes its first novel again under so many ids, on as many days, that they are a fifth of its novels and at least four.

    By ids all their lines would be repeated; by clusters and dates only those are taken out that were before.
    """
    own = table(spark, d, "novels").filter("meta.id is not null")
    first = own.groupBy(F.coalesce("site", F.lit("")).alias("_site")).agg(F.min("meta.id").alias("_id"), F.count_distinct("meta.id").alias("_n"))
    picked = own.join(first, (F.coalesce("site", F.lit("")) == F.col("_site")) & (F.col("meta.id") == F.col("_id")))
    copies = picked.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(4).cast("long"), F.ceil(F.col("_n") / 4)))))
    copies = copies.withColumn("meta", F.col("meta").withField("id", F.concat("meta.id", F.lit("#"), F.col("_c").cast("string")))).withColumn("crawled_at", F.col("crawled_at") + F.make_dt_interval(F.col("_c").cast("int")))
    out = boilerplate.cleaned(own.unionByName(copies.select(own.columns)))
    return out.join(boilerplate.pages_of(copies).filter("text <> ''").select("site", "id", F.col("key").alias("page")).distinct(), ["site", "id", "page"], "left_semi").select(
        "site", F.col("page").cast("int").alias("page"), F.substring_index("id", "#", -1).cast("long").alias("copy"), F.md5("text").alias("h")
    )


@R.query("p4_found", P4_SQL)
def p4_found(spark, d):
    return pieces.found(pieces.corpus_items(table(spark, d, "articles"), table(spark, d, "novels")))


@R.query("p4_pieces")
def p4_pieces(spark, d):
    items = pieces.corpus_items(table(spark, d, "articles"), table(spark, d, "novels"))
    return pieces.cut_items(pieces.once(items), with_text=True)


@R.query("p4_token_pieces")
def p4_token_pieces(spark, d):
    """Pieces of at most 512 tokens of the public tokenizer, each repeating 32 of the one before."""
    items = pieces.corpus_items(table(spark, d, "articles"), table(spark, d, "novels"))
    return pieces.cut_items(pieces.once(items), pieces.TOKEN_LIMIT, pieces.TOKEN_OVERLAP, "tokens", with_text=True)


@R.query(
    "p5_found",
    r"""
    WITH e AS (
      SELECT idx, min(CASE WHEN source IS NULL OR trim(source) = '' THEN regexp_extract(coalesce(file_path, parts[1].file_path, ''), '([^/]+)/[^/]*/[^/]*$', 1)
                           ELSE lower(trim(source)) END) AS source,
             min(greatest(coalesce(tokens, 0), 0)) AS tokens
      FROM index_entries WHERE idx IS NOT NULL GROUP BY idx),
    own AS (SELECT source, sum(tokens) AS own FROM e GROUP BY source)
    SELECT m.source FROM mix_targets m LEFT JOIN own o ON o.source = m.source
    WHERE m.target_share * (SELECT sum(tokens) FROM e) > m.max_repeats * coalesce(o.own, 0)""",
)
def p5_found(spark, d):
    _, report = mixing.mix(table(spark, d, "index_entries"), table(spark, d, "mix_targets"))
    return report.filter("short").select("source")


@R.query("p5_mix")
def p5_mix(spark, d):
    return mixing.mix(table(spark, d, "index_entries"), table(spark, d, "mix_targets"))[0]


@R.query("p5_shares")
def p5_shares(spark, d):
    return mixing.mix(table(spark, d, "index_entries"), table(spark, d, "mix_targets"))[1]


@R.query("p6_ids")
def p6_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


@R.query("p7_pack")
def p7_pack(spark, d):
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", "text")[0]


@R.query("p7_report")
def p7_report(spark, d):
    return packing.report(*packing.pack_texts(table(spark, d, "documents"), "doc_id", "text"))


@R.query("p8_found")
def p8_found(spark, d):
    return spam.found(table(spark, d, "documents"))


@R.query("p8_scores")
def p8_scores(spark, d):
    return spam.scored(table(spark, d, "documents"))
