"""The operators for training data: brute force, exact round trips, and the defined edge cases."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import boilerplate, bpe, mixing, neardup, packing, pieces, spam, splits


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Problem 1: splits

ENTRY = "idx long, source string, id string, tokens int, file_path string, byte_offset long, parts array<struct<file_path:string,byte_offset:long>>, root long, entity string"


def entry(idx, source, id, file=None, at=None, parts=None, tokens=1):
    return (idx, source, id, tokens, file, at, parts, 99, "clash")


ENTRIES = [
    entry(0, "A ", "x", "/c/a/f/1", 0), entry(1, "a", "x", "/c/a/f/1", 5), entry(2, "b", "y", "/c/b/f/1", 0), entry(3, "a", "m", None, None, [("/c/a/f/1", 5), ("/c/b/f/1", 0)]),
    entry(4, None, "z", "/c/q/f/1", 7), entry(5, " ", " ", "/c/q/f/1", 7), entry(6, "b", None, "/c/b/f/1", 9), entry(7, "b", "", "/c/b/f/1", 9), entry(8, None, None),
    entry(2, "b", "y", "/c/b/f/1", 0), entry(None, "b", "y", "/c/b/f/1", 0), entry(9, "b", "Y", "/c/b/f/2", 0), entry(10, "c", None), entry(11, "c", None),
]


def test_split_groups(spark, monkeypatch):
    df = spark.createDataFrame(ENTRIES, ENTRY)
    # 0-3 over an id and records; 4 and 5 over a record, as (q, z) and (q, none); 6 and 7 are one pair.
    assert rows(splits.found(df)) == [(0, 1), (0, 2), (0, 3), (4, 5)]
    assert rows(splits.found(df, max_task_edges=1)) == rows(splits.found(df)) == rows(splits.found(df, hot=1))
    assert rows(splits.assign(df, hot=1)) == rows(splits.assign(df))
    # Entities that share a number are told apart.
    monkeypatch.setattr(splits, "entities", lambda e, f=splits.entities: f(e).withColumn("entity", F.lit(7).cast("long")))
    assert rows(splits.found(df)) == [(0, 1), (0, 2), (0, 3), (4, 5)]
    monkeypatch.undo()
    out = {r["idx"]: (r["first_idx"], r["split"]) for r in splits.assign(df).collect()}
    assert len(out) == 12 and len({out[i] for i in range(4)}) == 1 and out[6] == out[7] and out[10][0] != out[11][0]
    assert splits.found(df.limit(0)).count() == 0 and splits.assign(df.limit(0)).count() == 0


def test_split_shares(spark):
    df = spark.createDataFrame([entry(i, "s", str(i // 7 if i < 140 else i)) for i in range(1000)], ENTRY)
    got = {r["split"]: r["share"] for r in splits.shares(splits.assign(df)).collect()}
    assert got == {"train": 0.8, "validation": 0.1, "test": 0.1}


# Problem 2: near duplicates


def brute_pairs(docs, threshold=0.7):
    sets = {}
    for i, t in docs:
        own = "".join(c for c in (t or "").lower() if c.isalnum())
        if i is not None and len(own) >= 8:
            sets[i] = {own[k : k + 8] for k in range(len(own) - 7)}
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))


def test_near_duplicates(spark, monkeypatch):
    random.seed(1)
    base = ["".join(random.choice("abcdefgh 漢字仮名。") for _ in range(n)) for n in (30, 300, 3000)]
    docs = [(f"r{i}", "".join(random.choice("abcdefgh") for _ in range(random.randint(0, 400)))) for i in range(40)]
    for n, text in enumerate(base):
        for k in range(9):
            edited = list(text)
            for _ in range(k * len(text) // 120):
                edited[random.randrange(len(edited))] = random.choice("xyz")
            docs.append((f"b{n}{k}", "".join(edited)))
        docs.append((f"c{n}", text.upper() + "!"))
    docs += [("n", None), ("e", ""), ("s", "short"), ("t", "short"), docs[0], (None, base[1])]
    df = spark.createDataFrame([(*d, "extra") for d in docs], "id string, text string, cls string")
    want = brute_pairs(docs)
    assert len(want) > 20
    assert rows(neardup.found(df)) == want
    assert rows(neardup.found(df, tile=4)) == want
    assert rows(neardup.found(df, exact=True)) == want
    groups = {r["id"]: r for r in neardup.groups(df).collect()}
    assert all(groups[a]["group"] == groups[b]["group"] for a, b in want) and set(groups) == {d[0] for d in docs} - {None}
    assert all(groups[i]["class"] is groups[i]["group"] is None and groups[i]["links"] == 0 for i in "nest")
    # Texts that share a class by hash are told apart, and blocks of two members make all pairs.
    monkeypatch.setattr(neardup, "PARTNERS", 2)
    monkeypatch.setattr("quern.operators.tiles.PARTNERS", 2)
    monkeypatch.setattr(neardup, "classed", lambda d, f=neardup.classed: f(d).withColumn("cls", F.pmod("cls", F.lit(3)).cast("long")))
    assert rows(neardup.found(df)) == want
    assert neardup.found(df.limit(0)).count() == 0


# Problem 3: repeated lines

NOVEL = "site string, meta struct<id:string,title:string>, texts map<string,struct<words:int,text:string>>, crawled_at timestamp, line string"


def novel(site, id, title, *pages, day=1):
    import datetime

    return (site, (id, title), {str(i): (0, p) for i, p in enumerate(pages)}, datetime.datetime(2024, 1, day), "clash")


def test_repeated_lines(spark):
    data = [novel("s", str(i), f"Ti {i}", f"own line {'abcdefgh'[i]}\r\nＲead  TI {i} at page {i}!\n\n", None, "", day=1 + i) for i in range(6)]
    data += [data[0], novel("t", "9", None, "Read X"), novel("s", None, "Ti 8", "own\nread ti 8 at page 8!"), ("s", ("7", None), None, None, "")]
    data += [("s", ("0", "Ti 0"), {"x": (0, "keyless\nRead Ti 0 at page 5!"), "0": (0, "another version")}, None, ""), novel("u", "0", "Ti 0", "own line a\nRead TI 0 at page 0!")]
    df = spark.createDataFrame(data, NOVEL)
    assert sorted(map(tuple, boilerplate.found(df).collect()), key=repr) == [("0", 0, 1), ("0", None, 1), *((str(i), 0, 1) for i in range(1, 6))]
    out = sorted((tuple(r) for r in boilerplate.cleaned(df).collect()), key=repr)
    # Null and empty pages, pages without id, with another key, in other versions and of the same id elsewhere all come out, once.
    want = [("s", str(i), "0", f"own line {'abcdefgh'[i]}\r\n\n") for i in range(6)] + [("s", str(i), "1", None) for i in range(6)] + [("s", str(i), "2", "") for i in range(6)]
    want += [("s", None, "0", "own"), ("s", "0", "0", "another version"), ("s", "0", "x", "keyless"), ("t", "9", "0", "Read X"), ("u", "0", "0", "own line a\nRead TI 0 at page 0!")]
    assert out == sorted(want, key=repr)
    assert boilerplate.found(df.limit(0)).count() == 0 and boilerplate.cleaned(df.limit(0)).count() == 0


def test_republished_works_are_one_witness(spark):
    story = "\n".join(f"line {w} of a story about {v}" for w, v in zip("abcdefghijklmnop", "zyxwvutsrqponmlk"))
    # The same work under six ids with small edits, and a legal notice of everyone's.
    data = [novel("s", f"r{i}", None, f"{story}\nedition {'uvwxyz'[i]}\nall rights reserved", day=1 + i) for i in range(6)]
    data += [novel("s", f"o{i}", None, f"{''.join(random.Random(i).choices('abcdefghijk ', k=300))}\nall rights reserved", day=1 + i) for i in range(6)]
    df = spark.createDataFrame(data, NOVEL)
    assert boilerplate.found(df).count() == 6 * 16 + 12
    clean = {r["id"]: r["text"] for r in boilerplate.cleaned(df).collect()}
    assert clean["r0"] == f"{story}\nedition u" and all("reserved" not in t for t in clean.values())
    # On one day alone nothing is boilerplate.
    day = df.withColumn("crawled_at", F.lit("2024-01-01").cast("timestamp"))
    assert all("reserved" in r["text"] for r in boilerplate.cleaned(day).collect())


def test_lines_by_clusters_and_dates(spark):
    """A copy that is republished on another day is neither a document nor a date of its own."""
    own = [("s", i, d, "0", 1, [1, 10 + c]) for i, c, d in (("a", 1, "2020-01-01"), ("b", 2, "2020-01-01"), ("c", 3, "2020-01-01"), ("d", 4, "2020-01-01"), ("e", 4, "2020-01-09"))]
    lines = spark.createDataFrame(own, "site string, id string, date string, key string, version long, lines array<long>").withColumn("date", F.to_date("date"))
    assert rows(boilerplate.repeated(lines, min_docs=4)) == [("s", 1, 4)]
    assert rows(boilerplate.repeated(lines, min_docs=4, min_dates=2)) == []
    # By weight a cluster counts all its documents, though only one has its lines counted.
    assert rows(boilerplate.repeated(lines, by_cluster=False, min_docs=4)) == [("s", 1, 5)]
    near = spark.createDataFrame([("a", 5), ("b", 5), ("c", 6)], "id string, group long")
    assert rows(boilerplate.repeated(lines, near, min_docs=1)) == [("s", 1, 3), ("s", 11, 1), ("s", 12, 1), ("s", 13, 1), ("s", 14, 1)]
    assert rows(boilerplate.repeated(lines, near, min_docs=1, min_dates=2)) == []


def test_copies_weigh_as_many_as_they_are(spark):
    same = spark.createDataFrame([novel("s", str(i), None, "all the same", "twice") for i in range(6)], NOVEL)
    assert boilerplate.found(same).count() == 12
    assert {r["text"] for r in boilerplate.cleaned(same, min_dates=1).collect()} == {"all the same", "twice"}


# Problem 4: pieces


@pytest.mark.parametrize("unit", ["chars", "bytes", "words", "tokens"])
def test_pieces(unit):
    random.seed(2)
    enc = bpe.Encoder(bpe.vocabulary_bytes()) if unit == "tokens" else None
    for _ in range(150):
        text = "".join(random.choice("ab 漢😀.。\n") for _ in range(random.randint(0, 300))) + "x" * random.choice([0, 0, 90])
        limit, overlap = random.randint(8, 60), random.randint(0, 7)
        cuts, stretch = pieces.spans(text, limit, overlap, unit, enc)
        sums = pieces.prefix_sums(text, unit, enc)
        assert len(sums) == len(text) + 1 and (np.diff(sums) >= 0).all()
        size = lambda a, b: int(sums[b] - sums[a])
        assert [c[1] for c in cuts] == sorted({c[1] for c in cuts}) and (not text or cuts[0][0] == 0 and cuts[-1][1] == len(text))
        ends = set(pieces.boundaries(text).tolist()) if text else set()
        for (b1, e, hard), (b2, _, _) in zip(cuts, cuts[1:]):
            assert b2 <= e and (hard or e in ends) and (unit == "tokens" or size(b2, e) >= min(overlap, size(b1 + 1, e)) - (unit != "chars") * 4)
        if unit == "tokens":
            # Each piece is within the limit when it is encoded alone.
            assert sums[-1] == enc.size(text) and all(enc.size(text[b:e]) <= limit for b, e, _ in cuts)
        else:
            assert all(size(b, e) <= limit for b, e, _ in cuts)
        assert not text or stretch == max(size(a, b) for a, b in zip([0, *sorted(ends)], sorted(ends)))


def test_piece_rows(spark):
    items = [("k", "1", "a" * 30), ("k", "2", "short."), ("k", "3", ""), ("k", "4", None), ("k", "5", "ab。" * 9), ("k", "1", "a" * 30)]
    df = spark.createDataFrame([(*i, 0) for i in items], "kind string, item_id string, text string, piece int")
    assert rows(pieces.found(df, 10, 2)) == [("k", "1", "oversized"), ("k", "1", "unbroken"), ("k", "5", "oversized")]
    out = [(r["item_id"], r["begin"], r["end"], r["hard"]) for r in pieces.cut_items(df, 10, 2).orderBy("item_id", "piece").collect()]
    assert ("2", 0, 6, False) in out and ("5", 0, 9, False) in out and ("5", 7, 15, False) in out and ("1", 0, 10, True) in out
    assert pieces.cut_items(df.limit(0)).count() == 0
    for unit, limit in (("chars", 10), ("tokens", 8)):
        got = pieces.cut_items(pieces.once(df), limit, 2, unit, with_text=True).orderBy("item_id", "piece").collect()
        texts = {i[1]: i[2] for i in items}
        assert all(r["text"] == texts[r["item_id"]][r["begin"] : r["end"]] for r in got) and {r["item_id"] for r in got} == {"1", "2", "5"}
        assert len({(r["item_id"], r["piece"]) for r in got}) == len(got)


# Problem 5: mixing


def test_mix(spark):
    data = [entry(i, "A" if i < 100 else "b", str(i), tokens=10) for i in range(110)] + [entry(0, "A", "0", tokens=10), entry(200, "a", None, tokens=None), entry(201, "z", None, tokens=-5), entry(202, "z", "q", tokens=0)]
    targets = spark.createDataFrame([("a", 0.5, 1, 1), ("B", 0.3, 2, 1), ("none", 0.2, 3, 1), ("q", None, None, 1)], "source string, target_share double, max_repeats int, own int")
    drawn, report = mixing.mix(spark.createDataFrame(data, ENTRY), targets)
    got = {r["source"]: r.asDict() for r in report.collect()}
    assert got["a"]["reached"] == 550 and not got["a"]["short"]
    assert got["b"]["reached"] == 200 and got["b"]["most_copies"] == 2 and got["b"]["short"] and got["none"]["short"] and not got["q"]["short"]
    assert abs(sum(r["share"] for r in got.values()) - 1) < 1e-9
    assert {r["copies"] for r in drawn.filter("source = 'b'").collect()} == {2} and drawn.filter("source = 'a'").count() == 55
    drawn, report = mixing.mix(spark.createDataFrame([], ENTRY), targets)
    assert drawn.count() == 0 and {(r["reached"], r["short"]) for r in report.collect()} == {(0, False)}


def test_short_follows_the_draw(spark, monkeypatch):
    data = spark.createDataFrame([entry(i, "a" if i < 5 else "b", str(i), tokens=10) for i in range(100)], ENTRY)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("b", 0.1, 9)], "source string, target_share double, max_repeats int")
    short = lambda: {r["source"] for r in mixing.mix(data, targets)[1].filter("short").collect()}
    assert short() == {"a"} and mixing.mix(data, targets)[1].count() == 2
    own = mixing.running_sum
    # A draw that leaves entries out has not drawn all it may.
    monkeypatch.setattr(mixing, "running_sum", lambda df, *a: own(df, *a).withColumn("upto", F.lit(1 << 40)))
    monkeypatch.setattr(mixing, "budgets", lambda e, t, f=mixing.budgets: f(e, t).withColumn("epochs", F.lit(0).cast("long")))
    assert short() == set()


# Problem 6: tokenizer

TEXTS = ["", "Hello  world's\n\n text", "<|endoftext|> x", "漢字仮名ーンド龍契士の魔", "😀é́ﬁ", "a" * 3000, " " * 50 + "b", "\x1c\x1d\x85​", "日本語テキスト123", "'S 's", "ÿþ" * 40, "0" * 700]


def test_ids_agree_with_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    random.seed(3)
    texts = TEXTS + ["".join(chr(random.choice([32, 10, 39, random.randint(33, 0x2FFF), random.randint(0x3000, 0xD7FF), random.randint(0x10000, 0x2FFFF)])) for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (0, "", "x")], "doc_id long, text string, ids string")
    want = {i: own.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = bpe.encode(df, "doc_id", "text").collect()
    assert len(got) == len(texts) + 2 and all(list(r["ids"]) == want.get(r["doc_id"], []) for r in got)
    assert all(r["tokens"] == len(want.get(r["doc_id"], [])) for r in bpe.sizes(df, "doc_id", "text").collect())
    back = bpe.decode(spark, bpe.encode(df.filter("doc_id is not null"), "doc_id", "text"), "ids").collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in back)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_merges_follow_the_definition():
    ranks = bpe.parse_ranks(bpe.vocabulary_bytes())

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            low = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)) if len(parts) > 1 else (1 << 30, 0)
            if low[0] == 1 << 30:
                return [ranks[p] for p in parts]
            i = low[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    random.seed(4)
    for _ in range(200):
        piece = bytes(random.choice(b"abtheing \xe4\xb8\xad\xe3\x83") for _ in range(random.randint(1, 60)))
        assert bpe.merge(piece, ranks) == plain(piece)


# Problem 7: packing


def contents(df, capacity):
    held = {}
    for r in df.filter("container is not null").collect():
        held.setdefault(r["container"], []).append(r["tokens"])
    assert all(sum(v) <= capacity for v in held.values()) and sorted(held) == list(range(len(held)))
    return held


def test_pack(spark):
    random.seed(5)
    sizes = [random.choice([1, 2, 3, 5, 8, 13, 40, 60, 61, 99, 100, 101, 230, 300]) for _ in range(400)] + [0, None]
    df = spark.createDataFrame([(i, s, 7) for i, s in enumerate(sizes)] + [(0, sizes[0], 7)], "doc_id long, tokens int, container int")
    out, plan = packing.pack(df, capacity=100)
    held = contents(out, 100)
    total = sum(s or 0 for s in sizes) + sizes[0]
    assert sum(map(sum, held.values())) == total and len(held) <= -(-total // 100) * 1.03 + 1
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert all(len(p) == (1 if i == 0 else 0) + max(1, -(-(sizes[i] or 0) // 100)) or i == 0 for i, p in by.items()) and by[400][0]["container"] is None
    told = packing.report(out, plan, 100).first()
    assert told["unused"] == 100 * len(held) - total and plan.fixed > 0 and 0 < told["fixed"] <= 1 and total / 100 <= told["least"] <= told["containers"]
    assert packing.pack(df.limit(0), capacity=100)[0].count() == 0


def test_reduction_keeps_the_optimum():
    """Small instances against exhaustive search: what dominance fixes costs no container."""

    def least(items, capacity):
        best = [len(items)]

        def go(rest, bins):
            if len(bins) >= best[0]:
                return
            if not rest:
                best[0] = len(bins)
                return
            s, rest = rest[0], rest[1:]
            for i, b in enumerate(bins):
                if b + s <= capacity and b not in bins[:i]:
                    go(rest, [*bins[:i], b + s, *bins[i + 1 :]])
            go(rest, [*bins, s])

        go(sorted(items, reverse=True), [])
        return best[0]

    random.seed(6)
    for _ in range(150):
        items = [random.randint(1, 20) for _ in range(9)]
        plan = packing.Plan([(s, items.count(s)) for s in set(items)], 20)
        fixed = {}
        for s, lo, hi, first, each in plan.rows:
            if first < plan.fixed:
                fixed[s] = fixed.get(s, 0) + hi - lo
        rest = list(items)
        for s, n in fixed.items():
            for _ in range(n):
                rest.remove(s)
        assert plan.fixed + (least(rest, 20) if rest else 0) == least(items, 20)
        assert plan.least() <= least(items, 20) <= plan.containers


# Problem 8: spam


def test_spam_pages(spark):
    random.seed(7)
    names = ["".join(random.choice("AEIBDK") + random.choice("aeiou") for _ in range(2)).capitalize() for _ in range(30)]
    things, places = (["".join(random.choice("bdklmnrst") + random.choice("aeiou") for _ in range(3)) for _ in range(n)] for n in (300, 100))
    say = [
        lambda: f"{random.choice(names)} left the {random.choice(things)} near the {random.choice(places)}, and nobody asked why.",
        lambda: f"If the {random.choice(things)} breaks, {random.choice(names)} will want it back before the {random.choice(places)} closes.",
        lambda: f'"You forgot my {random.choice(things)}," said {random.choice(names)} quietly.',
        lambda: f"There were {random.randint(2, 99)} steps from the {random.choice(places)} to the old {random.choice(things)}.",
    ]
    docs = [(i, " ".join(random.choice(say)() for _ in range(30))) for i in range(60)]
    bad = [
        (100, " ".join(f"cheap {random.choice(things[:5])} sale, best {random.choice(things[:5])} price," for _ in range(60))),
        (101, "\n".join(f"www.{random.choice(things)}{i}.example/{random.choice(places)}.html" for i in range(60))),
        (102, "\n".join(f"{random.choice(things)} SKU:{random.randint(1, 99999)} Size:L Color:red Stock:{i}" for i in range(60))),
        (103, "".join(f"#{random.choice(things)}{random.choice(places)}" for _ in range(120))),
    ]
    edge = [(200, None), (201, ""), (202, " \n"), (203, "ok"), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs + bad + edge], "doc_id long, text string, share string")
    assert {r[0] for r in spam.found(df).collect()} == {100, 101, 102, 103}
    assert spam.found(df.limit(0)).count() == 0 and spam.found(df.filter("doc_id >= 200")).count() == 0
    scores = {r["doc_id"]: r for r in spam.scored(df).collect()}
    assert len(scores) == len(docs + bad) + 4 and scores[200]["share"] is None and scores[201]["tokens"] == 0 and scores[203]["tokens"] == 1
    short = spark.createDataFrame([(1, "www.a.example/x http://b.example/y", "x"), (2, "see www.a.example", "x"), (3, "a word", "x")], "doc_id long, text string, share string")
    assert {r[0] for r in spam.found(short).collect()} == {1, 2}


def test_a_token_of_any_length_is_weighed_whole(spark):
    df = spark.createDataFrame([(1, "x" * 1_000_000 + ", " + "www.a.example/" + "y" * 400_000)], "doc_id long, text string")
    stored = spam.tokenised(df, "doc_id", "text").first()
    assert sum(int.from_bytes(stored["chars"][i : i + 4], "little") for i in range(0, len(stored["chars"]), 4)) >= 1_400_000
    assert abs(spam.scored(df).first()["links"] - 400_014 / 1_400_015) < 1e-3


def test_classes_of_long_and_odd_texts():
    tell = spam.Classifier()
    texts = ["", "x", "a" * 100_000, "\0", "漢" * 50, "한국어를 말한다", "<|im_end|>", "𠀀😀", "see map(v) or a.example/x"]
    out = tell(texts)
    assert len(out) == len(texts) and all(len(c) == len(n) for c, n in out)
    assert int(out[2][1].sum()) == 100_000 and list(out[8][0]).count(spam.LINK) == 1
