"""Operators against literal results and plain Python."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import articles as A
from quern.operators import batch as B
from quern.operators import chunk, components, dedup, joins, mix, prefix, quota, waterfall
from quern.operators import index as I


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_sum_is_whole_at_any_bucket_count(spark):
    random.seed(1)
    data = [(i, "hot" if i % 3 else f"g{i % 5}", random.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, g string, v int")
    for bits in (0, 1, 5):
        got = {r["id"]: r["s"] for r in prefix.running_sum(df, ["g"], ["id"], F.col("v"), "s", bits).collect()}
        ends = {}
        for i, g, _ in data:
            ends[g] = max(ends.get(g, 0), got[i])
        assert ends == {g: sum(v for _, h, v in data if h == g) for g in {x[1] for x in data}}
    ranks = [r["r"] for r in prefix.md5_rank(df, [], F.col("id").cast("string"), ["id"], "r", 4).collect()]
    assert sorted(ranks) == list(range(1, 501))
    assert prefix.running_sum(df.limit(0), ["g"], ["id"], F.col("v"), "s", 3).count() == 0


def test_components_agree_however_they_are_merged(spark):
    random.seed(2)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(260)] + [(7, 7), (None, 3)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in parent if find(x) != x)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for limit in (10_000, 64, 8):
        assert rows(components.components(df, max_task_edges=limit, fan_in=2)) == want
    # One root of nearly all nodes, reached over another hub.
    hub = spark.createDataFrame([(5, i) for i in range(10, 200)] + [(3, 5), (3, 300), (300, 301)], "a long, b long").repartition(7)
    assert rows(components.components(hub, max_task_edges=16, fan_in=2)) == [(i, 3) for i in [5, *range(10, 200), 300, 301]]
    assert rows(components.components(df.limit(0))) == []


def test_quota_in_bulk_is_the_greedy_rule():
    random.seed(3)
    for _ in range(60):
        hist = [(s, random.randint(1, 90)) for s in random.sample(range(1, 40), 6)]
        total = sum(s * n for s, n in hist)
        targets = [0.8 * total, 0.15 * total, 0.05 * total]
        short, want = list(targets), {}
        for s, n in sorted(hist, reverse=True):
            for _ in range(n):
                i = max(range(3), key=lambda j: (short[j], -j))
                short[i] -= s
                want[s, i] = want.get((s, i), 0) + 1
        got = {}
        for s, i, lo, hi in quota.fill_targets(hist, targets):
            got[s, i] = got.get((s, i), 0) + hi - lo
        assert got == want


def test_waterfall(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "k int, v int")
    rules = [("none", F.col("v").isNull()), ("low", F.col("v") < 10)]
    out = df.withColumn("reason", waterfall.first_failing(rules))
    assert rows(out.select("k", "reason")) == [(1, "none"), (2, "low"), (3, "passed")]
    assert rows(waterfall.reason_counts(out)) == [("low", 1, 33.3333), ("none", 1, 33.3333), ("passed", 1, 33.3333)]


ARTICLE = "cvid long, title string, content string, words int, views long, likes long, tags string, category_name string, publish_time string, author_name string, comment_ids string"


def test_article_rules(spark):
    body = "正" * 400
    data = [
        (1, "t", body, 400, 20, 0, "[]", "动画", None, None, None),
        (2, "t", body, 299, 20, 0, None, None, None, None, None),
        (3, "t", body, 300, 19, 0, None, None, None, None, None),
        (4, "壁纸", body, 300, 20, 0, None, None, None, None, None),
        (5, None, "x" * 495 + "美图" + body, 900, 20, None, None, None, None, None, None),
        (6, "t", "x" * 500 + "美图" + body, 900, 20, None, None, None, None, None, None),
        (7, "t", " 　", 300, 20, 0, None, None, None, None, None),
        (8, "t", None, None, None, None, None, None, None, None, None),
        (9, "t", "<p>" + "</p><p>" * 100, 300, 20, 0, None, None, None, None, None),
        (10, "t", "a\n" * 160, 300, 20, 0, None, None, None, None, None),
        (11, "t", "ab\n\nc" * 60, 300, 20, 0, None, None, None, None, None),
    ]
    got = dict(rows(A.judged(spark.createDataFrame(data, ARTICLE)).select("cvid", "reason")))
    want = {1: "passed", 2: "short", 3: "low_view", 4: "spam", 5: "spam", 6: "passed", 7: "empty", 8: "empty", 9: "short_after_clean", 10: "passed", 11: "passed"}
    assert got == want


def test_comment_tree_and_text(spark):
    arts = spark.createDataFrame(
        [(1, "T ", "body", 1, 1, 1, '["a"]', None, "2020", "me", '["10","11","99","12"]'), (2, None, "b2", 1, 1, 1, None, None, None, None, "not json"), (3, "x", " ", 1, 1, 1, None, None, None, None, None)],
        ARTICLE,
    )
    com = spark.createDataFrame(
        [
            (10, "ten chars!!", "A", 1, 0, '["20","21"]'), (11, "short", "B", 99, 0, "[]"), (12, "twelve\nchars here", None, 5, 0, "broken"),
            (20, "回复 @A :0123456789", "R", None, 10, None), (21, "回复 @A :012345678", "S", 9, 10, None),
        ],
        "rpid long, content string, author_name string, likes long, parent long, comment_ids string",
    ).withColumn("publish_time", F.lit(None).cast("string"))
    roots, replies = A.comment_edges(arts, com)
    assert rows(roots.select("cvid", "pos", "rpid")) == [(1, 0, 10), (1, 1, 11), (1, 3, 12)]
    assert rows(replies.select("parent_rpid", "rpos", "rpid")) == [(10, 0, 20), (10, 1, 21)]
    texts = dict(rows(A.article_texts(arts, com)))
    assert texts[1] == "T\n\n2020 | me | a\n\nbody\n\n---\n评论：\nUnknown: twelve chars here\nA: ten chars!!\n  └─ R: 0123456789"
    assert texts[2] == "\n\n\nb2" and 3 not in texts
    threads = dict(rows(A.thread_texts(arts, com)))
    assert threads == {1: "A\nten chars!!\n\nR\n回复 @A:0123456789\n\nS\n回复 @A:012345678\n\nB\nshort\n\n无名\ntwelve\nchars here"}
    # A third level, times, a comment without content whose replies stay.
    deep = [(10, None, "A", '["20"]', 0, "t0"), (20, "x @q: y", "R", '["30"]', 10, "2020-01-01T10:00:00"), (30, "z", None, "[]", 20, "")]
    deep = spark.createDataFrame(deep, "rpid long, content string, author_name string, comment_ids string, parent long, publish_time string").withColumn("likes", F.lit(None).cast("long"))
    assert dict(rows(A.thread_texts(arts, deep))) == {1: "R 2020-01-01 10:00:00\n回复 @A:x @A: y\n\n无名\n回复 @R:z"}
    whole = {r["cvid"]: r["comments"] for r in A.merged_articles(arts, deep).collect()}
    assert whole[2] == whole[3] == [] and [c["rpid"] for c in whole[1]] == [10]
    assert whole[1][0]["replies"][0]["replies"][0]["rpid"] == 30 and whole[1][0]["replies"][0]["content"] == "x @q: y"
    _, _, third = A.comment_levels(arts, deep)
    assert rows(third.select("parent_rpid", "rpid", "spos", "sub_rpid")) == [(10, 20, 0, 30)]
    arts = arts.withColumn("words", F.lit(600)).withColumn("link", F.lit("L"))
    got = dict(rows(A.labelled_texts(arts, deep)))
    assert got[1] == "URL: L\n\n标题: T \n\n作者: me\n\n发布日期: 2020\n\nbody\n\n标签: a\n\nR 2020-01-01 10:00:00\n回复 @A:x @A: y\n\n无名\n回复 @R:z"
    assert got[2].endswith("b2") and A.labelled_texts(arts, deep, blocked=["T ", "a"]).filter("cvid = 1").count() == 0
    ids = spark.createDataFrame([('["1","x","2"]',), ("[]",), (None,)], "c string").select(A.id_list(F.col("c")))
    assert [r[0] for r in ids.collect()] == [[1], [], []]


def test_latest_keeps_one_row_a_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, None, "c"), (None, 1, "d")], "k long, n int, t string")
    assert rows(A.latest(df, "k", ["n"])) == [(1, 9, "b"), (2, None, "c")]


def test_joins(spark):
    left = spark.createDataFrame([(5, "a"), (1, "b"), (9, "c"), (None, "d")], "o long, x string")
    right = spark.createDataFrame([(70, "p"), (20, "q")], "r long, y string")
    assert rows(joins.zip_join(left, right, "o", "r", 4).select("pos", "x", "y")) == [(1, "b", "q"), (2, "a", "p")]
    values = spark.createDataFrame([(0,), (9,), (10,), (25,), (None,)], "v long")
    ranges = [(0, 9, "a"), (10, 24, "b")]
    assert rows(joins.range_join(values, "v", spark.createDataFrame(ranges, "lo long, hi long, name string"), 7).select("v", "name")) == [(0, "a"), (9, "a"), (10, "b")]
    assert [r[0] for r in values.select(joins.range_bucket(F.col("v"), ranges)).collect()] == ["a", "a", "b", None, None]
    assert [r[0] for r in joins.keyset_page(values, "v", 0, 2).collect()] == [9, 10]


ENTRY = "idx long, source string, id string, split int, tokens int, file_path string, byte_offset long, parts array<struct<file_path:string,byte_offset:long>>"


def entries(spark, data):
    return spark.createDataFrame([(*d, None, None, None) for d in data], ENTRY)


def test_pairs_cross_spans_gaps_and_repeats(spark):
    data = [(0, "s", "a", 0, 5), (1, "s", "a", 1, 5), (2, "s", "a", 1, 5), (3, "s", "a", 2, 5), (4, "s", "a", 5, 5), (5, "s", "b", 4095, 5), (6, "s", "b", 4096, 5), (7, "t", "a", 1, 5), (7, "t", "a", 1, 5)]
    own = I.entries_once(entries(spark, data))
    assert rows(I.pairs(own)) == [(0, 1), (2, 3), (5, 6)]
    flags = {r["idx"]: (r["has_prev"], r["has_next"], r["orphan"]) for r in I.flagged(own).collect()}
    assert flags[1] == (True, False, False) and flags[4] == (False, False, True) and flags[7] == (False, False, True)
    assert sum(r["pairs"] for r in I.source_stats(I.flagged(own)).collect()) == 3


def test_neighbours_in_a_hot_split(spark):
    """A third of the rows in one split of one document: still one order, and ranges that cut it."""
    data = [(i, "s", "", 0, 1) for i in range(200)] + [(200 + i, "s", "d", i // 2, 1) for i in range(300)] + [(900, "s", "", 1, 1)]
    own = I.entries_once(entries(spark, data))
    want, order = [], sorted((d[2], d[3], d[0]) for d in data)
    for (i, a, x), (j, b, y) in zip(order, order[1:]):
        want += [(x, y)] if i == j and b == a + 1 else []
    assert rows(I.pairs(own)) == sorted(want) and (199, 900) in want
    got = {r["idx"]: r["next_idx"] for r in I.with_next(own).collect()}
    assert len(got) == 501 and all(got[i] == i + 1 for i in range(199)) and got[900] is None


def test_next_fit_by_blocks_is_next_fit(spark):
    random.seed(4)
    for block, fan, seed in ((2, 2, 1), (3, 3, 2), (256, 256, 3)):
        random.seed(seed)
        data = [(i, random.choice("xxxy"), random.choice([0, 1, 3, 20, 40, 60, 100, 130, 900])) for i in random.sample(range(1000), 300)]
        want = {}
        for g in "xy":
            used, first = 0, None
            for i, _, s in sorted(d for d in data if d[1] == g):
                s = max(1, s)
                if first is None or used + s > 100:
                    used, first = 0, i
                used += s
                want[i] = first
        df = spark.createDataFrame(data, "o long, g string, s int")
        got = {r["o"]: r["pack"] for r in I.next_fit(df, "g", "o", "s", 100, width=50, block=block, fan=fan).collect()}
        assert got == want, (block, seed)
    assert I.next_fit(spark.createDataFrame([], "o long, g string, s int"), "g", "o", "s", 100).count() == 0


def test_split_upsample_tasks(spark):
    docs = spark.createDataFrame([("a", str(i)) for i in range(100)] + [("b", "only")], "source string, id string")
    parts = {(r[0], r[1]): r[2] for r in I.split_documents(docs, "source", "id", 0.1, 0.05).collect()}
    assert sorted(parts.values()).count("val") == 11 and sorted(parts.values()).count("test") == 5 and parts["b", "only"] == "val"
    up = I.upsample(entries(spark, [(0, "a", "i", 0, 1), (1, "b", "j", 0, 1)]), {"a": 3, "z": 9})
    assert rows(up.select("idx", "id")) == [(0, "i"), (0, "i__up1"), (0, "i__up2"), (1, "j")]
    own = spark.createDataFrame([(0, True), (1, True), (0, False), (1, False)], "idx long, p boolean")
    assert [r[0] for r in own.select(I.task(F.col("idx"), F.col("p"), 0)).collect()] == ["reconstruction", "continuation", "ntp", "reconstruction"]


def test_chunks_lose_nothing(spark):
    random.seed(5)
    texts = ["".join(random.choice("ab。\n！ .") for _ in range(random.randint(1, 400))) for _ in range(40)] + ["para\n\nnext\n\n" * 20, "x" * 500]
    for most in (10, 64):
        for tokens in (chunk.CharTokenizer(), chunk.RegexTokenizer(r"[ab]|[^ab]")):
            for t in texts:
                out = chunk.chunk_text(t, tokens, most)
                assert "".join(out) == t and all(0 < tokens.count(c) <= most for c in out)
    df = spark.createDataFrame([(1, "ab。cd"), (2, ""), (3, None)], "k int, t string")
    assert rows(chunk.chunks(df, ["k"], "t", chunk.CharTokenizer(), 3)) == [(1, 0, 3, "ab。"), (1, 1, 2, "cd")]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chunk.sentence_array(F.col("t"))).collect()]
    assert got == [chunk.sentences(t) for t in texts]


def test_book_samples():
    tokens = chunk.CharTokenizer()
    out = chunk.pack_lines(["aaa\nbbb\nccc", "dd"], "T", tokens, 12, 100)
    assert all(s.startswith("T\n\n") for s in out) and "".join(s[3:] for s in out).replace("\n", "") == "aaabbbcccdd"
    assert all(len(s.replace("\n", "")) + 2 <= 12 for s in out)
    # A text that isn't enough goes on behind a blank line; lines without tokens are left out; the last sample may be short.
    assert chunk.pack_lines(["a\n\nb", "c"], "T", tokens, 100, 50) == ["T\n\na\nb\n\nc"]
    assert chunk.pack_lines(["aaaa", "b"], "T", tokens, 100, 7) == ["T\n\naaaa", "T\n\nb"] and chunk.pack_lines(["", "\n"], "T", tokens, 9, 1) == []


def test_packed_books(spark):
    df = spark.createDataFrame([(1, "T", ["a", None, "b"], "x"), (2, None, ["c"], "x"), (3, "E", None, "x"), (4, "E", [], "x")], "k long, title string, texts array<string>, sample string")
    out = chunk.packed_books(df, "k", "title", "texts", chunk.CharTokenizer(), 100, 50)
    assert rows(out) == [(1, 0, 7, "T\n\na\n\nb"), (2, 0, 3, "\n\nc")]


def test_chunks_by_counts_that_do_not_add_up():
    """Against the definition in plain words, with a tokenizer whose counts merge at the joints."""

    class Merging:
        def count(self, text):
            return len(re.findall(r"aab|ab|ba|[^ab]|a+|b", text))

    def plain(text, most, count):
        blocks = []
        for p in re.findall(r"(?s).*?\n\n|.+$", text):
            for line in [p] if count(p) <= most else re.findall(r"[^\n]*\n|[^\n]+", p):
                for s in [line] if count(line) <= most else chunk.sentences(line):
                    while count(s) > most:
                        n = max(k for k in range(1, len(s) + 1) if k == 1 or all(count(s[:j]) <= most for j in range(1, k + 1)))
                        blocks.append(s[:n])
                        s = s[n:]
                    blocks.append(s)
        out, held, n = [], "", 0
        for block in filter(None, blocks):
            estimate = n + count(block)
            exact = count(held + block) if estimate > 0.9 * most else estimate
            if estimate > most or exact > most:
                out += [held] if held else []
                held, n = block, count(block)
            else:
                held, n = held + block, exact
        return out + [held] if held else out

    random.seed(9)
    for _ in range(300):
        text = "".join(random.choice("aaabb .。\n") for _ in range(random.randint(0, 120)))
        most = random.randint(3, 12)
        got = chunk.chunk_text(text, Merging(), most)
        assert "".join(got) == text
        if "\n\n\n" not in text:
            assert got == plain(text, most, Merging().count), (text, most)


def test_chunks_by_a_public_tokenizer():
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer here")
    tokens = chunk.FileTokenizer(path)
    random.seed(10)
    text = " ".join(random.choice(["the", "unbelievable", "漢字仮名", "x1", "<|endoftext|>"]) + random.choice(["", ".", "\n", "\n\n"]) for _ in range(400))
    out = chunk.chunk_text(text, tokens, 60)
    assert "".join(out) == text and all(tokens.count(c) <= 60 for c in out) and tokens.count("<|endoftext|>") > 1


def test_exact_and_near_copies(spark):
    random.seed(6)
    words = [f"w{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(120)]
    docs = [(i, " ".join(base[:k] + ["new"] + base[k + 1 :])) for i, k in enumerate((3, 60, 118))]
    docs += [(10 + i, " ".join(random.choice(words) for _ in range(100))) for i in range(30)] + [(50, docs[0][1]), (60, ""), (61, None), (62, "one two")]
    df = spark.createDataFrame(docs, "k long, t string")
    sets = {}
    for k, t in docs:
        w = (t or "").split()
        s = frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
        if s:
            sets.setdefault(s, k)
    ks = sorted((k, s) for s, k in sets.items())
    want = sorted((a, b, round(len(s & u) / len(s | u), 2)) for a, s in ks for b, u in ks if a < b and len(s & u) / len(s | u) >= 0.8)
    assert len(want) == 3
    assert rows(dedup.near_pairs(df, "k", "t")) == want
    copies = {r["k"]: (r["first"], r["copies"]) for r in dedup.exact_copies(df, "k", "t").collect()}
    assert copies[50] == (0, 2) and copies[61] == (60, 2)
    nodes = spark.createDataFrame([(0, 1, 0), (1, 5, 0), (2, 2, 0), (10, None, None)], "id long, marks int, words long")
    edges = dedup.near_pairs(df, "k", "t")
    assert rows(dedup.star_select(edges, nodes).select("id", "kept")) == [(0, False), (1, True), (2, False), (10, True)]
    # Keys of another type are ordered as they are.
    names = df.select(F.concat(F.lit("n"), (F.col("k") + 100).cast("string")).alias("k"), "t")
    assert [r[0] for r in rows(dedup.near_pairs(names, "k", "t"))] == [f"n{a + 100}" for a, _, _ in want]
    nodes = nodes.withColumn("id", F.concat(F.lit("n"), (F.col("id") + 100).cast("string")))
    assert rows(dedup.star_select(dedup.near_pairs(names, "k", "t"), nodes).select("id", "kept")) == [("n100", False), ("n101", True), ("n102", False), ("n110", True)]


def test_near_copies_name_every_member(spark):
    """Texts that differ only in case, marks, white space or repeated passages, and their link to a third."""
    text = " ".join("abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(60))
    docs = [(1, text), (2, text.upper()), (3, text.replace(" ", ",\n")), (4, text + " more"), (5, "a b c d e a b c d e a b c d e"), (6, "a b c d e a b c d e"), (7, "!"), (8, None)]
    df = spark.createDataFrame(docs, "k int, t string")
    assert rows(dedup.near_copies(df, "k", "t")) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 2), (6, 5, 2)]
    assert rows(dedup.near_pairs(df, "k", "t")) == [(1, 4, 0.98)]


def test_copies_go_with_their_class(spark):
    """Against the greedy rule over all documents, copies included."""
    random.seed(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        base = [random.choice(words) for _ in range(120)]
        texts += [base[:k] + ["new"] + base[k + 1 :] for k in (3, 60, 118)]
    texts += [[random.choice(words) for _ in range(100)] for _ in range(6)]
    docs = [(i, " ".join(t if i % 5 else [w.upper() for w in t])) for i, t in enumerate(random.choice(texts[: 1 + n % len(texts)]) for n in range(90))]
    docs += [(90 + i, " ".join(texts[3])) for i in range(45)] + [(200, ""), (201, " \n"), (202, None), (203, "…"), (204, "…"), (205, "!!")]
    score = {k: (random.randint(0, 2), random.choice([0, 3, 40, 90])) for k, _ in docs}
    sets = {}
    for k, t in docs:
        w = (t or "").lower().split()
        sets[k] = frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([t and t.strip() or ""])
    want = {}
    for a in sorted(sets):
        if a in want:
            continue
        cluster = [a, *(b for b in sorted(sets) if b != a and b not in want and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)]
        most = max(score[x][1] for x in cluster)
        best = max(cluster, key=lambda x: (score[x][0] + score[x][1] / max(1, most // 4), -x))
        want |= {x: x == best for x in cluster}
    members, near = dedup.near_classes(spark.createDataFrame(docs, "k long, t string"), "k", "t")
    nodes = spark.createDataFrame([(k, *v) for k, v in score.items()], "id long, marks int, words int")
    got = dedup.star_select(near.select(F.col("a").alias("src"), F.col("b").alias("dst")), nodes, members.withColumnRenamed("k", "id"))
    assert rows(got.select("id", "kept")) == sorted(want.items())


def test_stars_by_rounds_are_the_greedy_ones(spark):
    random.seed(11)
    edges = {tuple(sorted(random.sample(range(60), 2))) for _ in range(90)} | {(100 + i, 101 + i) for i in range(12)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for a in sorted(near):
        if a not in want:
            want |= {x: a for x in [a, *(b for b in near[a] if b not in want)]}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    # A node that isn't named is a center of its own.
    for most in (dedup.TASK_EDGES, 6):
        assert {n: n for n in want} | dict(rows(dedup._stars(df, most))) == want


def test_dedup_star_select_keeps_one_copy(spark, tmp_path):
    """The registered query: of a text, its copies and a better near copy, only the best stays."""
    from quern.plans.text_queries import dedup_star_select

    text = " ".join("abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(60))
    docs = [(1, text), (2, text), (3, text.upper()), (4, text + " more"), (5, "alone of its kind"), (6, "alone of its kind"), (7, "…"), (8, "…"), (9, "!")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(dedup_star_select(spark, str(tmp_path)).select("doc_id", "kept")) == [(1, False), (2, False), (3, False), (4, True), (5, True), (6, False), (7, True), (8, False), (9, True)]


def test_hot_buckets_lose_no_pair(spark):
    """Tiles of four sets: every pair still meets."""
    from quern.operators import tiles

    base = list(range(100, 200))
    data = [(i, base[: 100 - i % 7] + [1000 + i]) for i in range(40)]
    df = spark.createDataFrame(data, "k long, s array<long>")
    sketched = df.select("k", "s").mapInArrow(dedup._sketch(8, 2), dedup.SKETCH).cache()
    of = {r["cls"]: r["k"] for r in sketched.collect()}
    got = {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in tiles.candidates(sketched, 0.8, tile=4).collect()}
    want = {(a, b) for a, s in data for b, t in data if a < b and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.8}
    assert want and want <= got


def test_bitmaps_bound_and_prefixes_meet():
    import numpy as np

    from quern.operators import tiles

    rng = np.random.default_rng(5)
    for n in (1, 7, 300, 5000, 60_000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        x, y = tiles.bitmap(a), tiles.bitmap(b)
        width = 8 * min(len(x), len(y))
        assert 8 * len(x) >= 2 * n
        for w in {width, max(tiles.BITS, width // 4)}:
            differ = int(np.bitwise_count(tiles.folded(x, w) ^ tiles.folded(y, w)).sum())
            assert differ <= len(np.setxor1d(a, b))
        sim = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert not sim or set(tiles.prefix_keys(a, sim)) & set(tiles.prefix_keys(b, sim))
    assert len(tiles.prefix_keys(np.zeros(0, np.uint64), 0.7)) == 0


def test_skew_join_with_a_hot_key(spark):
    from quern.operators.joins import skew_join

    left = spark.createDataFrame([(i % 5 if i < 50 else 7, i) for i in range(200)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("m")).withColumn("x", F.col("k") * 2).filter("k <> 3")
    want = rows(left.join(right.drop("m"), "k"))
    assert rows(skew_join(left, right, "k", "m", hot=20)) == rows(skew_join(left, right, "k", "m")) == want


def test_scores(spark):
    df = spark.createDataFrame([("g", 1, "x ISBN"), ("g", 2, "a b c d e f g h"), ("g", 3, "a b c d e f g h"), ("h", 4, None)], "g string, o int, t string")
    words = F.coalesce(F.size(F.split("t", " ")), F.lit(0))
    best = {r["g"]: r["o"] for r in dedup.best_of_group(df, "g", "o", "t", F.when(F.col("t").isNull(), 0).otherwise(words)).collect()}
    assert best == {"g": 2, "h": 4}
    terms = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "c", 1)], "k int, term string, tf int")
    import math

    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 2)], "src int, dst int")
    got = {(r["src"], r["dst"]): r["score"] for r in dedup.bm25_scores(terms, pairs).collect()}
    side = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (5 / 3)))
    assert got == {(1, 2): round(math.log(1.5 / 2.5 + 1) * side(1, 3) * side(1, 1), 6), (1, 3): 0.0}


def test_survivors(spark):
    docs = spark.createDataFrame([(1, "drop me\n한글 a[PAGE_SEP]b c"), (2, "x"), (3, None)], "id long, text string")
    kept = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, kept boolean")
    titles = spark.createDataFrame([(1, "T"), (1, "T")], "id long, title string")
    got = {r["meta"]["id"]: r for r in dedup.survivors(docs, kept, titles, ("drop me\n",)).collect()}
    assert set(got) == {1, 3} and got[3]["meta"]["title"] == "Unknown" and got[3]["meta"]["total_words"] == 0
    assert got[1]["meta"].asDict() == {"id": 1, "title": "T", "language": "en", "source_filename": "1.txt", "total_words": 3, "total_pages": 2}
    assert got[1]["texts"]["0"]["text"] == "한글 a" and got[1]["texts"]["1"]["words"] == 2


def test_mixing(spark):
    df = spark.createDataFrame([(i, f"f{i % 2}") for i in range(10)], "k long, f string")
    placed = mix.shards(mix.shuffled(df, F.col("k").cast("string"), ["k"]), "place", 4)
    assert sorted(r["place"] for r in placed.collect()) == list(range(1, 11)) and {r["shard"] for r in placed.collect()} == {0, 1, 2}
    assert {r["turn"] for r in mix.interleaved(df, "f", "k", 2, 3).collect()} == {0, 1, 2}
    assert mix.shuffled(df, F.col("k").cast("string"), ["k"]).exceptAll(mix.shuffled(df, F.col("k").cast("string"), ["k"], bits=3)).count() == 0
    used = mix.budget_sample(df, ["f"], "k", F.col("k"), F.lit(6), width=2)
    assert rows(used.select("k")) == [(0,), (1,), (2,), (3,), (4,)]


def test_batches(spark):
    df = spark.createDataFrame([(0, [1], [5, 6]), (0, [1, 2, 3], [7])], "b int, c array<int>, i array<int>").withColumn("l", F.col("i"))
    out = sorted((r.asDict() for r in B.pad_batch(df, "b", "c", "i", "l", 0).collect()), key=lambda r: r["c"])
    assert out[0]["c"] == [0, 0, 1] and out[0]["context_mask"] == [0, 0, 1] and out[0]["i"] == [5, 6]
    assert out[1]["i"] == [7, 0] and out[1]["l"] == [7, -100] and out[1]["input_mask"] == [1, 0]
    one = spark.createDataFrame([([1, 2, 3, 4], True)], "ids array<int>, e boolean")
    for task, want in (("ntp", ([0], [1, 2, 9], [1, 2, 9])), ("reconstruction", ([1, 2], [8, 1, 9], [-100, 1, 9])), ("continuation", ([7], [1, 2, 9], [1, 2, 9]))):
        s = one.select(B.sample(F.lit(task), F.col("ids"), F.array(F.lit(7)), F.col("e"), 8, 9, 0, 3, 2).alias("s")).first()["s"]
        assert tuple(s) == want, task
    tails = one.select(*[B.tail(F.col("ids"), F.lit(n)) for n in (0, 2, 9)]).first()
    assert [list(x) for x in tails] == [[1, 2, 3, 4], [3, 4], [1, 2, 3, 4]]


def test_samples_have_whole_lengths_and_true_predecessors(spark, tmp_path):
    from quern.plans.sample_queries import training_samples

    data = [(0, "s", "a", 0, 5000), (1, "s", "b", 0, 20), (2, "s", "a", 1, 7000), (3, "s", "b", 1, None), (4, "s", "b", 2, 30), (6, "s", "a", 2, 40)]
    entries(spark, data).write.parquet(str(tmp_path / "index_entries.parquet"))
    assert rows(training_samples(spark, str(tmp_path))) == [
        (0, "reconstruction", None, 4096, 1, 4096, 4096, 50001, 50002),
        (1, "ntp", None, 1, 0, 0, 20, 2, 21),
        (2, "continuation", 0, 4096, 1, 4096, 4096, 3, 4098),
        (3, "reconstruction", None, 0, None, None, 2, 50001, 50002),
        (4, "continuation", 3, 0, None, None, 31, 5, 50002),
        (6, "continuation", 2, 4096, 3, 4098, 41, 7, 50002),
    ]


def test_titles_of_sources_however_written(spark, tmp_path):
    from quern.plans.sample_queries import title_lookup_tidied

    sources = [("a", "novels", None), ("b", "Novels", None), ("c", "\u3000NOVELS ", None), ("d", None, "data/novels/x/1.jsonl"), ("e", " ", "novels/x/1.jsonl"), ("f", "games", "novels/x/1.jsonl"), (None, "novels", None)]
    spark.createDataFrame([(i, s, k, 0, 1, f, None, None) for i, (k, s, f) in enumerate(sources)], ENTRY).write.parquet(str(tmp_path / "index_entries.parquet"))
    spark.createDataFrame([(("b", "B"),), (("c", "C"),), (("f", "F"),)], "meta struct<id:string,title:string>").write.parquet(str(tmp_path / "novels.parquet"))
    assert rows(title_lookup_tidied(spark, str(tmp_path))) == [("a", "Unknown"), ("b", "B"), ("c", "C"), ("d", "Unknown"), ("e", "Unknown")]


def test_prompts_and_logits(spark):
    talk = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "system", None)], "k int, n int, r string, t string")
    assert B.chat(talk, "k", "n", "r", "t", "simple").first()[1] == "User: a\nAssistant: b\nAssistant:"
    assert B.chat(talk, "k", "n", "r", "t", "none").first()[1] == "a\nb\n\n"
    assert B.chat(talk, "k", "n", "r", "t", "chatml").first()[1].endswith("<|im_start|>system\n<|im_end|>\n<|im_start|>assistant\n")
    logits = spark.createDataFrame([(0, i, x) for i, x in enumerate([3.0, 3.0, 1.0, 0.0])], "k int, tok int, x double")
    assert rows(B.top_k_top_p(logits, "k", "tok", "x", 1, 1.0)) == [(0, 0, 0.5), (0, 1, 0.5)]
    assert rows(B.top_k_top_p(logits, "k", "tok", "x", 0, 0.3)) == [(0, 0, 1.0)]
    shots = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(3)], "o int, q string, a string")
    assert rows(B.few_shot(shots, "o", "q", "a")) == [(2, "q0\n答案：a0\n\nq1\n答案：a1\n\nq2\n答案：", "a2")]
    rates = spark.range(0, 40, 10).select(B.learning_rate(F.col("id"), F.lit(1.0), 10, 20))
    assert [r[0] for r in rates.collect()] == [0.0, 0.0, 0.5, 1.0]
