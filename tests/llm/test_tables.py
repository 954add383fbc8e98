"""The operators that SQL can express, and edge cases of all that read small tables."""

from __future__ import annotations

import hashlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from check_all import compare, connect
from slotwatch.llm import chat, decontaminate, html_text, mixing, queries, warc

ODD = [
    (1, "one two three", "a"), (1, "one two three", "a"), (2, None, "a"), (3, "", None), (None, "x y", None),
    (4, "w " * 20_000, "hot"), (5, "　 é", "b"), (6, "a b", ""), (7, "a b", "hot"), (7, "a b c", "hot"),
]


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def sql_rows(con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    return names, sorted(res.fetchall(), key=repr)


def same(spark, tmp_path, name, rows, schema, query):
    import duckdb

    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    names, want = sql_rows(con, queries.ORACLE_SQL[query])
    got = queries.QUERIES[query](spark, path).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    return got


def test_mix_of_odd_rows(spark, tmp_path):
    rows = [(i, t, s, 1, 2) for i, t, s in ODD]
    got = same(spark, tmp_path, "documents", rows, "doc_id bigint, text string, source string, copies int, target int", "op1_pareto_mix")
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got)


def test_mix_comes_near_its_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 37 + 1), f"s{i % 4 if i % 3 else 0}") for i in range(3000)], "doc_id bigint, text string, source string")
    by = {}
    for r in mixing.mix(docs).collect():
        t = by.setdefault(r.source, [0, r.target, 0])
        t[0] += r.copies * r.size
        t[2] = max(t[2], r.size)
    assert len(by) == 4 and all(abs(taken - target) <= size for taken, target, size in by.values())
    assert mixing.mix(docs.limit(0)).count() == 0
    kept = mixing.mixed_documents(docs)
    assert kept.columns == ["doc_id", "text", "source", "mix_copies"] and kept.where("mix_copies < 1").count() == 0


def test_chat_of_odd_turns(spark, tmp_path):
    rows = [
        (1, 0, "system", "be <|im_end|> brief <!| <!!|", 1), (1, 1, "user", None, 1), (1, 2, "assistant", "a\r\n<|im_start|>", 1),
        (2, None, "assistant", "first", 1), (2, 1, None, "no role", 1), (2, 1, None, "no role", 1), (2, 5, "odd\nrole", "t", 1),
        (None, 1, "user", "who", 1), (3, 0, "user", "", 1),
        *[(4, i, ("user", "assistant")[i % 2], "long " * (10 + 90 * (i % 7)), 1) for i in range(60)],
        *[(5, i, ("system", "user", "assistant")[i % 3], "s " * 60, 1) for i in range(30)],
    ]
    same(spark, tmp_path, "conversations", rows, "conv_id bigint, turn bigint, role string, text string, window int", "op10_chat_windows")


def _turns_of(window):
    return [p.split("\n", 1) for p in window.text.removesuffix("<|im_end|>\n").removeprefix("<|im_start|>").split("<|im_end|>\n<|im_start|>")]


def test_chat_windows_keep_their_budget(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "w " * (5 + i % 40)) for i in range(200)]
    rows += [(2, i, "system" if i % 50 == 3 else ("user", "assistant")[i % 2], f"{i} " * (5 + i % 20)) for i in range(200)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    repeated = 0
    for w in chat.chat_windows(turns, budget=200, history=60).collect():
        assert sum(len(text.split()) + chat.TURN_TOKENS for _, text in _turns_of(w)) <= 200
        repeated += w.n_context
    assert repeated > 20
    assert chat.chat_windows(turns.limit(0)).count() == 0


def test_chat_windows_retain_the_last_system_turn(spark):
    rows = [(1, None, "user", "early"), (1, 0, "system", "be brief")] + [(1, i, ("assistant", "user")[i % 2], "w " * 90) for i in range(1, 20)]
    rows += [(1, 20, "system", "be long"), *[(1, i, ("assistant", "user")[i % 2], "v " * 90) for i in range(21, 40)]]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = sorted(chat.chat_windows(turns).collect(), key=lambda w: w.window)
    assert [w.window for w in windows] == list(range(len(windows)))
    current = None
    for w in windows:
        said = _turns_of(w)
        if current and said[0][0] != "system":
            raise AssertionError(said[0])
        if current and w.n_context:
            assert said[0][1] == current
        current = next((text for role, text in reversed(said) if role == "system"), current)
    assert current == "be long"


def test_chat_windows_part_equal_rows(spark):
    turns = spark.createDataFrame([(1, 1, "user", "w " * 300)] * 2 + [(1, 2, "assistant", "ok")], "conv_id bigint, turn bigint, role string, text string")
    windows = sorted(chat.chat_windows(turns).collect(), key=lambda w: w.window)
    assert [(w.window, len(_turns_of(w)) - w.n_context) for w in windows] == [(0, 1), (1, 1), (2, 1)]


def test_warc_of_odd_pages(spark, tmp_path):
    long = "<p>" + "ö" * 700
    rows = [
        (1, "http://WWW.a.org/x y?q=é#f", long, "k"), (9, "http://a.org/", long, "k"), (5, None, long, "k"), (2, "http://a.org/", "short", "k"),
        (3, "http://a.org/", "short", "k"), (4, "u", None, "k"), (6, "", "", "k"), (7, "ftp://b:80/\n\r\n", "z" * 1000, "k"), (8, "%20 ", "z" * 1000, "k"),
        (10, "http://a.org/", "y" * 999, "k"), (11, "http://a.org/", "y" * 999, "k"), (12, "x", "v" * 300_000, "k"),
    ]
    got = same(spark, tmp_path, "pages", rows, "page_id bigint, url string, html string, key string", "op4_warc_index")
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {1: 9, 5: 9, 7: 8}


def test_warc_index_spans_blocks_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"page {i}") for i in range(100)], "page_id bigint, url string, html string")
    a, x = str(tmp_path / "a"), str(tmp_path / "x")
    directory = warc.write_index(warc.write_archives(pages, a), x)
    assert directory.count() > 20
    keys = pages.select(warc.capture_key(pages.url, pages.page_id).alias("key"))
    got = warc.read_captures(keys.unionAll(keys.limit(5)), directory, a, x).collect()
    assert {r.page_id: r.payload_digest for r in got} == {i: hashlib.sha1(f"page {i}".encode()).hexdigest() for i in range(100)}
    assert warc.read_captures(spark.createDataFrame([("zz)/ -",), ("",)], "key string"), directory, a, x).count() == 0


def test_records_are_plain_warc():
    member = warc.record(7, "http://a.org/\n", "é".encode(), "00" * 20, None)
    fields, payload = warc.parse_record(member)
    assert payload == "é".encode() and fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://a.org/%0A"


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies on this site, please agree to all of them</div>
<article><h1>Title &amp; more</h1><p>One  two<br>three <b>four</b> &lt;five&gt;</p><aside>Side note of some length here</aside><p>Yes.</p>
<form><input name=q><button>Send</button></form><ul><li>first<li>second</ul><p hidden>not shown</p></article>
<section id="comments"><p>A long reader comment that says very much about nothing at all, again and again.</p></section>
<div class="ad">Buy this now</div><footer>&copy; 2026 Someone</footer></body></html>"""


def test_article_of_a_page():
    assert html_text.main_text(PAGE) == "Title & more\nOne two three four <five>\nYes.\nfirst\nsecond"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<p>", ""), ("<article>bare &#x41;&nbsp; text", "bare A text"), ("<article><p>a < b</p>", "a < b"),
        ("<article><p title='>'>x</p><p class=\"open>y</p>", "x\ny"), ("<article><p>x</p><!-- open", "x"), ("<article><p>x<script>y", "x"),
    ],
)
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


STORY = "<h1>Of the town</h1><p>" + "The council met on Monday and spoke about the bridge. " * 5 + "</p><p>Short end.</p>"
SAID = "Of the town\n" + ("The council met on Monday and spoke about the bridge. " * 5).strip() + "\nShort end."
AROUND = (
    "<header><a href=/>Home</a></header><nav><a href=/a>News</a></nav>",
    "<div class='sidebar'>Most read this week in our paper</div><footer>All rights of the paper</footer>",
)


@pytest.mark.parametrize(
    "layout",
    [
        "<div class='layout with-sidebar'>{0}<article>{2}</article>{1}</div>", "{0}<article class='no-skip'>{2}</article>{1}",
        "{0}<div class='post comments-open'><article>{2}</article></div>{1}", "<form>{0}<article>{2}</article>{1}</form>",
        "{0}<div class='share-holder-news'><main>{2}</main></div>{1}", "<body class='has-banner hidden'>{0}<article>{2}</article>{1}</body>",
        "{0}<article>{2}<aside>Read on in our great archive</aside></article><section id=comments>"
        + "<article class=comment><p>" + "I was there and it was not so at all. " * 4 + "</p></article>" * 3 + "</section>{1}",
        "{0}<main><div class='post comments-open'><article>{2}</article></div><section id=comments>"
        + "<article class=comment><p>" + "I was there and it was not so at all. " * 4 + "</p></article>" * 3 + "</section></main>{1}",
        "{0}<div class='page sidebar-left'><article>{2}</article></div><div class=related><article><h2><a href=x>Another story</a></h2></article></div>{1}",
        "{0}<article>{2}</article><div class=related><article><a href=x>Another story</a></article><article><a href=y>One more</a></article></div>{1}",
    ],
)
def test_wrappers_named_like_furniture(layout):
    assert html_text.main_text(layout.format(*AROUND, STORY)) == SAID


@pytest.mark.parametrize("headline", ["", "<header><h1>The paper</h1></header>", "<h1><a href=/>The paper</a></h1>"])
@pytest.mark.parametrize("wrap", ["layout with-sidebar", "post comments-open", "no-skip", "share-holder-news"])
def test_wrappers_of_pages_without_an_article(wrap, headline):
    body = "The council met on Monday and spoke for a long time about the bridge over the river. "
    page = f"{headline}{AROUND[0]}<div class='{wrap}'><p>{body * 2}</p><p>{body * 3}</p></div>{AROUND[1]}"
    assert html_text.main_text(page) == (body * 2).strip() + "\n" + (body * 3).strip()


def test_tree_weighs_words_and_links():
    used = set()

    def walk(node):
        if not isinstance(node, int):
            used.add(html_text.FEATURES[node[0]])
            walk(node[2]), walk(node[3])

    walk(html_text.TREE)
    assert {"link", "words"} <= used and len(used) >= 5


def test_html_query_on_odd_rows(spark, tmp_path):
    rows = [(1, "u", "<article>a</article>", "x", 1), (1, "u", "<article>a</article>", "x", 1), (2, None, None, "x", 1), (None, "v", "", None, 1)]
    rows.append((3, "w", "<article>" + "<p>b " * 30_000, "x", 1))
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r.page_id), str(r.url), r.text[:2], r.n_chars) for r in html_text.op3_html_text(spark, str(tmp_path)).collect())
    assert got == [("1", "u", "a", 1), ("1", "u", "a", 1), ("2", "None", "", 0), ("3", "w", "b\n", 59_999), ("None", "v", "", 0)]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert html_text.op3_html_text(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("page", ["<" * 100_000, "<a href='" * 30_000, "<!--" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<b " * 60_000, "&" * 100_000])
def test_odd_pages_are_linear(page):
    import time

    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 8


def test_pages_without_an_article_use_words_and_links():
    body = "A paragraph of the story that goes on for quite a while, as paragraphs of main text do on most pages. "
    page = f"<div><a href=x>Home</a></div><div><a href=y>News of today</a></div><p>{body * 2}</p><p>{body}</p><div><a href=z>Next</a></div>"
    assert html_text.main_text(page).count("A paragraph") == 3 and "Home" not in html_text.main_text(page)


def test_every_labelled_block_is_learned():
    assert sum(html_text.classify(r[:-1]) != r[-1] for r in html_text.LABELLED) == 0


def test_decontamination_equals_brute_force(spark):
    import random
    import re
    from collections import Counter

    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 5, 6, 15, 15, 24, 40, 56))] + [(20, None), (21, " ")]
    items.append((22, items[3][1]))
    docs = [(0, None), (1, ""), (None, items[4][1])]
    for k in range(120):
        w = items[k % 8][1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([word()], [], [w[at], word()]))
        text = [word() for _ in range(rng.randrange(60))] + w + [word() for _ in range(rng.randrange(60))]
        docs.append((10 + k, " ".join(text).upper() if k % 5 == 0 else "\n".join(text)))
    docs.append(docs[-1])
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    exact, best = set(), {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            x = words(it)
            for a in range(max(1, len(w) - len(x) + 1)) if x and w else ():
                p, q = bag(w[a : a + len(x)]), bag(x)
                s = sum((p & q).values()) / sum((p | q).values())
                if s >= 0.75:
                    best[(d, i)] = max(s, best.get((d, i), 0))
                if s == 1:
                    exact.add((d, i))
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, n int")
    bench = spark.createDataFrame([(*i, "w") for i in items], "item_id bigint, text string, w string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame, bench).collect()}
    assert exact <= set(got) <= set(best)
    assert len(set(best) - set(got)) <= 0.02 * len(best)
    assert all(got[k] == 1.0 for k in exact)
    bad = {d for d, _ in got}
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0


def test_decontamination_near_the_limit(spark):
    import random

    rng = random.Random(75)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    items, docs = [], []
    # Words at the end replaced up to the limit: similarities 0.754 and 0.756, the last word repeated or not.
    for k in range(400):
        n, cut = ((54, 7), (40, 5))[k % 2]
        head = [word() for _ in range(n - cut)]
        tail = [word()] * cut if k % 4 > 1 else [word() for _ in range(cut)]
        items.append((k, " ".join(head + tail)))
        docs.append((k, " ".join([word() for _ in range(9)] + head + [word() for _ in range(cut + 9)])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert all(r.doc_id == r.item_id and 0.75 <= r.similarity < 0.8 for r in got)
    assert len(got) >= 0.995 * len(docs)


def test_decontamination_broadcasts_nothing_that_grows_with_documents(spark, monkeypatch):
    import random

    from slotwatch.operators import sizing

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(4)]
    docs = [(k, " ".join([*(word() for _ in range(9)), items[k % 4][1] if k % 3 else word(), *(word() for _ in range(9))])) for k in range(90)]
    docs += [(None, items[0][1]), (None, None), (None, "no item"), docs[1], docs[0]]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    checked, broadcast = [], []
    fits, mark = sizing.fits_broadcast, F.broadcast
    # As if there were more rows than may be broadcast: joins that check their size shuffle.
    monkeypatch.setattr(sizing, "fits_broadcast", lambda small, *a, **b: checked.append(small.columns) or False)
    monkeypatch.setattr(decontaminate, "fits_broadcast", fits)
    monkeypatch.setattr(F, "broadcast", lambda df: broadcast.append(df.columns) or mark(df))
    want = {(d, i) for d, t in docs for i, x in items if t and x in t}
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()]
    assert set(got) == want and len(got) == len(want)
    kept = decontaminate.clean(frame, bench)
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in frame.collect() if not any(x in (r.text or "") for _, x in items))
    assert all(c == ["gram", "offset", "n"] for c in checked) and checked
    assert all(c in (["_piece", "_bits"], ["item_id", "n", "item_shingles"]) for c in broadcast) and broadcast


def test_a_screen_leaves_out_only_rows_without_a_mark(spark):
    rows = spark.range(20000).withColumn("h", F.xxhash64("id"))
    marked = rows.where("id % 97 = 0").select("id", "h")
    got = decontaminate.screened(rows, marked, ["id", "h"])
    assert got.columns == ["id", "h", "_maybe"] and got.count() == 20000
    assert got.where("id % 97 = 0 and not _maybe").count() == 0
    assert got.where("id % 97 <> 0 and _maybe").count() < 20
    assert decontaminate.screened(rows, marked.limit(0), ["id", "h"]).where("_maybe").count() == 0


def test_blocks_find_all_within_the_radius(spark):
    import random

    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(i, 20 + i % 2, rng.getrandbits(64), rng.getrandbits(64)) for i in range(60)]
    prints, want = set(), set()
    for k in range(600):
        _, n, *fps = rng.choice(items)
        for b in rng.sample(range(64), rng.randrange(22)):
            fps[k % 2] ^= 1 << b
        fps[1 - k % 2] = rng.getrandbits(64)
        prints.add((n, *fps))
    for n, a, b in prints:
        want |= {(n, signed(a), signed(b), i) for i, m, x, y in items if n == m and min((a ^ x).bit_count(), (b ^ y).bit_count()) <= 15}
    index = spark.createDataFrame([(i, n, signed(x), signed(y)) for i, n, x, y in items], "item_id bigint, n int, fp0 bigint, fp1 bigint")
    rows = spark.createDataFrame([(n, signed(a), signed(b)) for n, a, b in prints], "n int, fp0 bigint, fp1 bigint")
    assert {tuple(r) for r in decontaminate.near_items(rows, index).collect()} == want and len(want) > 300
