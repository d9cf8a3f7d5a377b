import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import extraction, lines, minhash, mixing, packing, quality, search, secrets, substrings, vectors
from quarrylens.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import same
from . import brute


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("where", ["edge", "middle"])
def test_agrees_with_sql(spark, name, where, request):
    folder = request.getfixturevalue(where)
    assert same(QUERIES[name](spark, folder), folder, ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


# 1 mixing


def test_mixing_reaches_targets(spark, middle):
    rows = QUERIES["op1_mix_sources"](spark, middle).toPandas()
    assert set(rows["taken"] / rows["size"].clip(lower=1)) <= {0, 1, 2}
    source = table(spark, middle, "documents").select("doc_id", "source").toPandas()
    by = rows.merge(source).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), longest=("size", "max"))
    assert (by["target"] <= 2 * by["size"] + 1e-6).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1
    assert ((by["taken"] - by["target"]).abs() <= by["longest"]).all()
    assert by["taken"].sum() <= 1.5 * by["size"].sum() + 1e-6


def test_mixed_rows_follow_the_plan(spark, edge):
    docs = table(spark, edge, "documents")
    plan = mixing.mix_plan(docs)
    want = Counter()
    for r in plan.groupBy("key").agg(F.sum("copies").alias("n")).collect():
        want[r["key"]] += r["n"]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = Counter(r[0] for r in out.select(mixing.shuffle_key(out)).collect())
    assert got == +want


# 2 quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = quality.scored(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    y, s = rows["quality"].to_numpy(), rows["score"].to_numpy()
    order = s.argsort().argsort() + 1
    n = (y == 1).sum()
    assert (order[y == 1].sum() - n * (n + 1) / 2) / (n * (y == 0).sum()) > 0.98
    assert (rows["predicted"] == y).mean() > 0.97
    assert ((s - y) ** 2).mean() < 0.03  # calibrated


def test_scores_of_odd_rows(spark, edge):
    docs, labels = table(spark, edge, "documents"), table(spark, edge, "labels")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    none = quality.scored(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns


def test_scores_ignore_everything_but_text(spark, edge):
    docs, labels = table(spark, edge, "documents"), table(spark, edge, "labels")
    before = {(r["doc_id"], round(r["score"], 9)) for r in quality.scored(docs, labels).collect()}
    after = {(r["doc_id"], round(r["score"], 9)) for r in quality.scored(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")}), labels).collect()}
    assert before == after


def test_pooled_sums_of_a_small_table(spark):
    """Index and context vectors word by word, against the table and the pooled rows."""
    from quarrylens.llm._words import hash_spans

    texts = ["the cat sat on the mat", "", "a b a b", "the dog sat", None]
    hash_of = lambda w: hash_spans(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))
    index = lambda w, salt: quality._index(hash_of(w), np.array([0]), 1, salt)[0]
    table_of = np.zeros((quality.CONTEXTS, quality.CONTEXT_DIMENSIONS))
    place = lambda w: int(hash_of(w)[0]) % quality.CONTEXTS

    def entries(word):
        out, h = np.zeros(quality.CONTEXT_DIMENSIONS), int(quality.mix(hash_of(word) ^ np.uint64(0x55))[0])
        for _ in range(quality.ENTRIES):
            out[h % quality.CONTEXT_DIMENSIONS] += 1 if h >> 20 & 1 else -1
            h = int(quality.mix(np.array([h], np.uint64))[0])
        return out

    for text in texts:
        w = (text or "").split()
        for left, right in zip(w, w[1:]):
            table_of[place(left)] += entries(right)
            table_of[place(right)] += entries(left)
    want = table_of / np.maximum(np.linalg.norm(table_of, axis=1, keepdims=True), 1e-9)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    got = np.frombuffer(bytes(quality.context_vectors(docs).first()["contexts"]), np.float32).reshape(want.shape)
    assert np.allclose(got, want, atol=1e-6)
    for text in texts[:4]:
        data = np.frombuffer(text.encode(), np.uint8)
        sums = quality.summed(data, np.array([0, len(data)]), got)[0]
        w, d = text.split(), quality.DIMENSIONS
        assert np.allclose(sums[:d], sum((index(x, 0x11) for x in w), np.zeros(d)))
        assert np.allclose(sums[d : 2 * d], sum((index(x[-3:], 0x22) for x in w), np.zeros(d)))
        assert np.allclose(sums[4 * d : 4 * d + quality.CONTEXT_DIMENSIONS], sum((want[place(x)] for x in w), np.zeros(quality.CONTEXT_DIMENSIONS)), atol=1e-5)
        assert sums[-10:][:4].tolist() == [len(w), len(data), sum(map(len, w)), sum(x == y for x, y in zip(w, w[1:]))]


def test_long_texts_are_pooled_as_in_one_piece(monkeypatch):
    """At both sides of a piece's size, with borders inside repeated words, and a word longer than a piece."""
    rng = np.random.default_rng(4)
    contexts = rng.normal(size=(quality.CONTEXTS, quality.CONTEXT_DIMENSIONS)).astype(np.float32)
    whole = [" ".join(rng.choice(["la", "Wort,", "é漢字", "x1"], 900)), "la " * 700, "w" * 3000 + " end end " + "\n" * 900 + "v" * 2000, " " * 3000, "  la" + " " * 1500 + "la  "]
    for size in (64, 1000, 1024):
        monkeypatch.setattr(quality, "SLICE_BYTES", size)
        for text in whole:
            data = np.frombuffer(text.encode(), np.uint8)
            one = quality.summed(data, np.array([0, len(data)]), contexts)
            assert np.allclose(quality.long_text_sums(data, contexts), one, rtol=1e-4, atol=2e-2)
            exact = [*range(4 * quality.DIMENSIONS), *range(one.shape[1] - 10, one.shape[1])]
            assert (quality.long_text_sums(data, contexts)[0, exact] == one[0, exact]).all()


# 3 extraction

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a> tagline of the site that is quite long and would count as text otherwise</header>
<div class="cookie-notice">We use cookies on this site, in a notice that is long enough to look like a paragraph.</div>
<div id="content"><h1>Head &amp; line</h1><p>First   paragraph,
 long enough to be recognised as the main text of the page, surely.<p>Second <b>para</b>graph &lt;ok&gt;.
<div class="ad">Buy this thing now, it is really good and costs next to nothing at all today only.</div>
<p>Short.</p><form><input><p>Name</p></form></div>
<aside><p>Related stories that are long enough to be a paragraph of text, if one were to count.</p></aside>
<div class="comments"><p>Reader says this is a nice article and goes on about it for quite some while.</p></div>
<footer>&copy; someone</footer></body></html>"""


def test_main_text():
    assert extraction.main_text(PAGE) == "Head & line\nFirst paragraph, long enough to be recognised as the main text of the page, surely.\nSecond paragraph <ok>.\nShort."
    article = "<nav><ul><li><a>x</a></ul></nav><article><header><h1>T</h1></header><p>a<br>b<ul><li>c<li>d</ul><!-- no --><section class='comments'>bad</section>e</article><p>" + "foot " * 40
    assert extraction.main_text(article) == "T\na b\nc\nd\ne"
    assert extraction.main_text("&amp;amp; &#65;&eacute;") == "&amp; Aé"
    assert extraction.main_text("") == "" and extraction.main_text("<div class=ad>x") == ""
    assert extraction.main_text("<article><p>a</p></article><article class='comment'><p>b</p></article><article class='notice-board-story'>c</article><div style='display: none'>d</div>") == "a\nc"
    assert extraction.main_text("<article><p>a<p data-class='ad'>b<p class=ads-by>c</p>d</article>") == "a\nb\nd"
    assert extraction.distribution([1, 2, 3, 4], 2) == [1, 3, 5, 7]


def test_text_outside_articles():
    text, cards = "A paragraph of the main text that is long enough to surge on its own, surely.", "<article><a href=/>Title</a><p>Teaser.</p></article>" * 3
    page = f"<html><body>{{}}<div id=story><p>{text}<p>Short.<p>{text}</div>{{}}</body></html>"
    main = f"{text}\nShort.\n{text}"
    assert extraction.main_text(page.format("", cards)) == extraction.main_text(page.format(cards, "")) == main
    assert extraction.main_text(page.format("<article><p>One.</p></article>", "")) == "One.\n" + main
    assert extraction.main_text(page.format(f"<article><h1>T</h1><p>{text}</p></article>", cards)) == f"T\n{text}\n{main}"
    assert extraction.main_text(f"<body>{cards}</body>") == "\n".join(["Title", "Teaser."] * 3)


@pytest.mark.parametrize("name", ["page has-sidebar", "with-sidebar", "content-sidebar-wrap", "no-ads", "share-prices", "copyright-reform", "related", "share", "notice", "alert widget"])
def test_wrappers_of_the_text(name):
    text = "A paragraph of the main text that is long enough to surge on its own, surely."
    ad = "<div class=ad>Buy this.</div>"
    for inner in (f"<article><h1>T</h1><p>{text}</p></article>", f"<main><h1>T</h1><p>{text}</p></main>", f"<h1>T</h1><p>{text}</p>"):
        assert extraction.main_text(f"<body>{ad}<div class='{name}'>{inner}</div><footer>f</footer></body>") == f"T\n{text}"


def test_noise_beside_the_text():
    text = "A paragraph of the main text that is long enough to surge on its own, surely."
    page = f"<body><article><p>{text}</p></article>{{}}</body>"
    for name in ("cookie-bar", "sidebar-left", "related-posts", "main-nav", "ads-by", "advert1", "comment-list", "share"):
        assert extraction.main_text(page.format(f"<div class={name}><article>{text} {text}</article></div>")) == text
    assert extraction.main_text(page.format(f"<div class=stock-share-prices>{text}</div>")) == f"{text}\n{text}"


def test_markup_that_is_not_well_formed():
    assert extraction.main_text('<p>Hello <a title="x>link</a> text</p>') == "Hello link text"
    assert extraction.main_text('<p title="x>Hello <a href="y">link</a> text</p>') == "Hello link text"
    assert extraction.main_text("<p title='a > b' data-x=\"<b>c</b>\">Hello</p><img alt='a>b'/>there") == "Hello\nthere"
    assert extraction.main_text("<p class=it's>Hello</p>") == "Hello"
    story = "A story of the page that is long enough to surge on its own, as it should be."
    assert extraction.main_text(f"<div class='article-comment-free share-price-story'><article><p>{story}</p></article></div><div class=related>Other stories</div>") == story
    # references count as the characters they stand for, indentation not at all
    assert extraction.page_lines("<p>\n      &eacute;&amp;   <a href=/>link</a> b</p>")[1] == [4]


def test_pages_without_article(spark):
    """Brute force: a region's text goes from the first to the last run of three lines (or fewer) that holds enough."""
    import random

    rng = random.Random(9)
    rows, want, trimmed = [], [], 0
    for n in range(80):
        html, regions = ["<body>"], []
        for _ in range(rng.randrange(1, 6)):
            sizes = [rng.choice([2, 5, 18, 70, 200]) for _ in range(rng.randrange(1, 9))]
            regions.append([("w" * (k - 1)) + str(rng.randrange(10)) for k in sizes])
            html.append("<table><tr><td>" + "".join(f"<p>{t}</p>" for t in regions[-1]) + "</td></tr></table><nav><a href=/>menu</a></nav>")
        runs = [[(sum(map(len, x[i:j])), i, j) for i in range(len(x)) for j in range(i + 1, min(len(x), i + 3) + 1)] for x in regions]
        least, kept = min(60, max(x[0] for run in runs for x in run)), []
        for texts, run in zip(regions, runs):
            full = [(i, j) for total, i, j in run if total >= least]
            if full:  # the widest of the runs that end where one first holds enough
                end = min(j for _, j in full)
                kept += texts[max(end - 3, 0) : min(len(texts), max(i for i, _ in full) + 3)]
                trimmed += len(texts) - len(texts[max(end - 3, 0) : min(len(texts), max(i for i, _ in full) + 3)])
        rows.append((n, "u", "".join(html) + "</body>"))
        want.append("\n".join(kept))
    got = extraction.extracted(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == want and len(set(want)) > 70 and trimmed > 20


def test_surge_and_dive_decide():
    long = "A paragraph of the main text that is long enough to surge on its own, surely."
    letters = "".join(f"<p>{x}</p>" for x in "abcdefghij" * 20)
    page = f"<body><div class=xq7>{letters}<p>{long}</p>{letters}</div></body>"
    assert extraction.main_text(page) == f"i\nj\n{long}\na\nb"
    assert extraction.main_text(page, window=1) == long
    assert extraction.main_text(page, surge=5000) == extraction.main_text(page, surge=len(long) + 2)
    # in articles a factor lowers the threshold; it doesn't take its place
    article = f"<body><article><h1>T</h1>{'<p>short</p>' * 6}<p>{long * 4}</p>{'<p>x</p>' * 6}</article></body>"
    assert len(extraction.main_text(article).split("\n")) == 14
    assert extraction.main_text(article, surge=5000).split("\n") == ["short", "short", long * 4, "x", "x"]
    assert extraction.main_text(article, prior=1) == extraction.main_text(article, surge=60 * 20)


def test_boxes_told_by_what_they_hold():
    text = "<p>" + "A paragraph of the main text that is long enough to surge on its own, surely. " * 4 + "</p>"
    want = extraction.main_text(f"<article>{text}</article>")
    menu = "<div class=xq1><ul><li><a href=#a>First part</a><li><a href=#b>Second part</a><li><a href=#c>Third</a></ul></div>"
    said = "".join(f"<div class=xq3><a href=/u{k}>Reader {k}</a> <time>today</time><p>It is so, and I say so at some length.</p></div>" for k in range(3))
    for box in (menu, f"<p class=xq2><a href=/a>one</a>, <a href=/b>two</a>, <a href=/c>three</a></p>", f"<div class=xq4>{said}<form><input></form></div>", f"<ol class=xq5>{said}</ol><form><textarea>x</textarea></form>"):
        assert extraction.main_text(f"<article>{text}{box}</article>") == want
        assert extraction.main_text(f"<body><div class=xq6>{text}{box}</div></body>") == want
    # no form: it may be anything; two links: a line like others
    assert "Reader 1" in extraction.main_text(f"<article>{text}<div class=xq4>{said}</div></article>")
    assert extraction.main_text(f"<article>{text}<p><a href=/>one</a> <a href=/>two</a></p></article>") == want + "\none two"
    chapters = "".join(f"<section class=xq8><h2><a href=#{k}>Chapter {k}</a></h2>{text}</section>" for k in range(3))
    assert extraction.main_text(f"<article><div>{chapters}</div><form><input></form></article>").count("Chapter") == 3


def test_math_and_long_values():
    assert extraction.main_text("<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is here.</p></article>") == "Energy E=m is here."
    for n in (60_000, 65_537, 2_000_000):
        image = "data:image/svg+xml," + "<path d='0'/>" * (n // 13)
        assert extraction.main_text(f'<article><p>Before.</p><img src="{image}" alt=x><p>After.</p></article>') == "Before.\nAfter."


def test_pages(spark, edge, middle):
    rows = extraction.extracted(table(spark, edge, "pages")).collect()
    assert len(rows) == 9 and all(r["n_chars"] == len(r["text"]) for r in rows)
    by = {r["page_id"]: r["text"] for r in rows}
    assert by[0] == by[None] == "T\nSome text." and by[3] == by[4] == "" and by[5] == "plain" and by[7] == "<<<>>> & A"
    assert len(by[6]) == 5 * 50_000 - 1
    import html
    import re

    changed = 0
    for r in table(spark, middle, "pages").join(extraction.extracted(table(spark, middle, "pages")).select("page_id", "text"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r["text"] == "\n".join(x for x in blocks if x)
        changed += extraction.main_text(r["html"], surge=5000) != r["text"]
    assert changed > 0  # the threshold decides


# 4 near-duplicates


@pytest.mark.parametrize(("size", "percent", "more"), [(3, 85, {}), (5, 80, {"family": 2})])
def test_near_duplicates(spark, edge, middle, size, percent, more):
    for folder in (edge,) if more else (edge, middle):  # the pipeline's test has the others
        rows = documents(spark, folder)
        want, sizes = brute.near_duplicates(rows, size, percent)
        got = minhash.near_duplicates(table(spark, folder, "documents"), shingle=size, percent=percent, **more).collect()
        assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, n) for (i, _), n in zip(rows, sizes))
        assert all(r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"]) for r in got)


def test_crowded_family(spark):
    """Near copies over several blocks, linked in chains."""
    import random

    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(400):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(8)):
            w[k] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want, _ = brute.near_duplicates(rows, 3, 85)
    for family in (1024, 0):  # as one family, and by buckets where that is less work
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=3, percent=85, block=64, family=family).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 5


def test_regular_texts_do_not_collide(spark):
    """A Thue-Morse word and its complement in otherwise equal texts (equal under sums of powers)."""
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[:30], x, *base[30:]]) for x in (morse, other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["n_removed"] for r in substrings.repeated_passages(docs, 35).collect()] == [0, 0]
    assert all(r["kept"] for r in minhash.near_duplicates(docs, shingle=3, percent=99).collect())
    # words as letters: windows that are such sequences
    letters = [" ".join(x[k : k + 64]) for x in (morse, other) for k in (0,)]
    docs = spark.createDataFrame(list(enumerate(letters)), "doc_id bigint, text string")
    want = [x[1] for x in brute.passages(letters, 35)]
    assert [r["n_removed"] for r in substrings.repeated_passages(docs, 35).orderBy("doc_id").collect()] == want


def test_one_of_each(spark, edge):
    docs = table(spark, edge, "documents")
    kept = minhash.one_of_each(docs, shingle=3, percent=85)
    assert kept.columns == docs.columns
    want, _ = brute.near_duplicates(documents(spark, edge), 3, 85)
    rows = {(i, t) for i, t in documents(spark, edge) if i is None or want[i] == i}  # of equal rows one
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(rows)
    twice = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (1, "a b c d"), (None, "x y"), (None, "x y"), (2, "other words")], "doc_id bigint, text string")
    assert Counter(map(tuple, minhash.one_of_each(twice).collect())) == Counter([(1, "a b c d"), (2, "e f g h"), (2, "other words"), (None, "x y")])


# 5 secrets


def test_base_spans(spark, edge, middle):
    for folder in (edge, middle):
        docs = table(spark, folder, "documents")
        got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.scanned(docs).collect())
        want = Counter()
        for i, text in documents(spark, folder):
            spans = brute.secrets(text)
            joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
            want[i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()] += 1
        assert got == want


def test_entropy_spans(spark):
    import random

    rng = random.Random(2)
    made = "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(40))
    low = "ab1" * 12
    texts = [f"🙂 x {made} y", f"{low}", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "my-example-key-" + made[:20], "Donaudampfschifffahrtsgesellschaft", "aaaaaaaaaaaaaaaaaaaa1" + made, "F00DBABE1234C0FFEE5678DEADBEEF9A", made + " token=" + made, low + made]
    rows = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    spans = [[(s["start"], s["stop"], s["ord"]) for s in r["added"]] for r in rows]
    assert spans[0] == [(4, 44, 4)] and spans[1] == spans[2] == spans[3] == spans[4] == spans[5] == [] and spans[6] == [(0, 32, 3)] and spans[7] == [(0, 40, 4)]
    for n in (0, 6, 8):
        text, least = texts[n].split()[2 if n == 0 else 0], secrets.HEX_BITS if n == 6 else secrets.OTHER_BITS
        over = [k for k, h in enumerate(brute.window_entropy(text, secrets.WINDOW)) if h >= least - 1e-9]
        shift = 4 if n == 0 else 0
        assert spans[n] == [(over[0] + shift, over[-1] + secrets.WINDOW + shift, 3 if n == 6 else 4)]


def test_very_long_candidates(spark):
    import random
    import time

    rng = random.Random(3)
    texts = ["/".join("a1" for _ in range(20_000)), "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(30_000)), " ".join("deadbeefdeadbeef" for _ in range(2_000))]
    rows = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["n_entropy"] for r in rows] == [0, 1, 0] and rows[1]["spans"] == "entropy_mixed:0:30000" and rows[2]["n_hex"] == 2_000
    # half a million matches in one text
    many = spark.createDataFrame([(1, " ".join("deadbeefdeadbeef" for _ in range(500_000)))], "doc_id int, text string")
    began = time.perf_counter()
    found = secrets.secret_spans(many).select(F.size("hex").alias("n"), F.col("hex")[499_999]["start"].alias("start"), F.size("added").alias("added")).first()
    assert tuple(found) == (500_000, 17 * 499_999, 0) and time.perf_counter() - began < 120


def test_candidates_inside_base_spans(spark):
    """Against every pair, with more spans than a run holds."""
    import random

    rng = random.Random(8)
    pieces = []
    for k in range(1_500):
        body = "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(24))
        pieces.append(rng.choice([f"token={body}", body, f"secret: {body}", "0123456789abcdef0123456789", "word"]))
    text = " ".join(pieces)
    got = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    base = [(s["start"], s["stop"]) for s in (*got["assign"], *got["access"], *got["hex"])]
    assert sorted(base) == sorted((a, b) for a, _, b in brute.secrets(text)) and len(base) > secrets.RUN
    assert got["added"] and not any(a <= s["start"] and s["stop"] <= b for s in got["added"] for a, b in base)
    bare = sum(len(p) == 24 for p in pieces)
    assert 0.9 * bare <= len(got["added"]) <= bare


def test_no_python_in_the_secret_plan(spark, middle):
    plan = QUERIES["op5_secret_scan"](spark, middle)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 6 lines


def test_lines_of_copies_go(spark, edge):
    docs = table(spark, edge, "documents")
    out = lines.without_repeats(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.filter("doc_id BETWEEN 13 AND 16").collect()}
    first = {r["doc_id"]: r["text"] for r in docs.filter("doc_id BETWEEN 13 AND 16").collect()}
    assert rows[13] == first[13] and 16 not in rows
    assert rows[14] == first[14].split("\n")[-1] and rows[15] == "x\n"
    for n in (1, 2, 3, 4, 7):
        lines.repeated_lines(docs, min_lines=n).collect()


def test_line_runs_by_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for i in range(40)]
    for least in (1, 2, 3, 5):
        seen, want = set(), {}
        for i, text in rows:
            parts = [(j, x) for j, x in enumerate(text.split("\n")) if x.strip()]
            gone = set()
            for k in range(len(parts) - least + 1):
                run = tuple(x for _, x in parts[k : k + least])
                if run in seen:
                    gone |= {j for j, _ in parts[k : k + least]}
                seen.add(run)
            want[i] = len(gone)
        got = {r["doc_id"]: r["n_removed"] for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id int, text string"), min_lines=least, min_words=None).collect()}
        assert got == want


# 7 passages


def test_passages(spark, edge, middle):
    for folder in (edge, middle):
        rows = documents(spark, folder)
        want = Counter((i, *x) for (i, _), x in zip(rows, brute.passages([t for _, t in rows], 35)))
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op7_substring_dedup"](spark, folder).collect())
        assert got == want


def test_passages_with_text(spark):
    import random

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(60)]
    for window in (3, 8, 9):
        want = {i: x for (i, _), x in zip(rows, brute.passages([t for _, t in rows], window))}
        for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id int, text string"), window).collect():
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
            assert sum(b - a for a, b in r["spans"]) == r["n_removed"]


# 8 vectors


def test_vectors(spark, edge, middle):
    for folder in (edge, middle):
        rows = [(r["vec_id"], r["embedding"]) for r in table(spark, folder, "embeddings").collect()]
        degree, pairs = brute.close_vectors([v for _, v in rows], 0.9)
        ids = [i for i, _ in rows]
        want = brute.components({i for i in ids if i is not None}, [(ids[a], ids[b]) for a, b in pairs if ids[a] is not None and ids[b] is not None])
        got = vectors.near_duplicate_vectors(table(spark, folder, "embeddings"), 0.9).collect()
        assert Counter((r["vec_id"], r["n_links"]) for r in got) == Counter(zip(ids, degree))
        assert all(r["component_id"] == want.get(r["vec_id"]) and r["kept"] == (r["vec_id"] is None or r["component_id"] == r["vec_id"]) for r in got)


def test_vector_recall(spark):
    """Groups at the threshold itself: at least 0.9 of the links, none that isn't one."""
    rng = np.random.default_rng(0)
    rows, centers = [], rng.normal(size=(150, 64))
    for i in range(1500):
        c = centers[i % 150] / np.linalg.norm(centers[i % 150])
        noise = rng.normal(size=64)
        noise -= noise @ c * c
        v = c + 0.3 * noise / np.linalg.norm(noise)
        rows.append((i, [float(x) for x in v]))
    degree, _ = brute.close_vectors([v for _, v in rows], 0.9)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.9).collect()}
    assert all(got[i] <= n for i, n in enumerate(degree))
    assert sum(degree) > 2000 and sum(got.values()) >= 0.9 * sum(degree)


def test_hot_group_of_vectors(spark):
    """A third of the rows in one group of distinct near copies, and no link lost."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x[:2000] = rng.normal(size=64) + 0.3 * x[:2000]
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.9).collect()
    assert linked.sum() > 2_000_000
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(linked.sum(1).tolist()))
    assert sum(r["component_id"] == 0 for r in got) == 2000


@pytest.mark.parametrize("noise", [0.02, 0.05, 0.2])
def test_cells_reached_hold_every_link(noise):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 16)), 20, axis=0)
    x += noise * rng.normal(size=x.shape) * np.linalg.norm(x, axis=1)[:, None] / 4
    x /= np.linalg.norm(x, axis=1)[:, None]
    centers = vectors.spherical_k_means(x, 40, 5)
    home, cells = vectors.reached(x, centers, 0.9)
    a, b = np.nonzero(x @ x.T >= 0.9)
    assert len(a) > len(x) and cells[a, home[b]].all()
    assert cells.mean() < 0.9  # and some are ruled out


# 9 packing


def test_packing(spark, edge):
    """On odd rows; the test of the pipeline's last stage has ordinary ones."""
    for folder in (edge,):
        rows = QUERIES["op9_best_fit_packing"](spark, folder).toPandas()
        got = Counter((None if i != i else int(i), *x) for i, *x in zip(rows["doc_id"], rows["piece"], rows["start"], rows["length"], rows["ids_crc32"]))
        assert got == brute.token_pieces(documents(spark, folder), packing.default_vocabulary(), 1024, 2)
        for _, part in rows.sort_values("offset").groupby("sequence_id"):
            ends = (part["offset"] + part["length"]).tolist()
            assert [0, *ends[:-1]] == part["offset"].tolist() and ends[-1] <= 1024
        assert rows["sequence_id"].nunique() <= 1.02 * -(-rows["length"].sum() // 1024) + 2


def test_sweeps_take_the_smallest_gap_that_holds():
    rng = np.random.default_rng(1)
    for capacity in (7, 64, 1024):
        counts, gaps = (Counter(int(x) for x in rng.integers(1, capacity + 1, 300)) for _ in range(2))
        plan, rest = packing.swept([(n, c, 0) for n, c in counts.items()], dict(gaps), 1)
        free, want = [[g, 0] for g in sorted(gaps.elements())], Counter()  # gap and what is in it
        for length in sorted(counts.elements(), reverse=True):  # one by one
            fits = [x for x in free if x[0] - x[1] >= length and x[1] % length == 0 and (x[1] == 0 or x[2] == length)]
            if fits:
                best = min(fits, key=lambda x: (x[0], -x[1]))
                best[1:] = [best[1] + length, length]
                want[length, best[0]] += 1
        got = Counter()
        for length, _, many, gap, _ in plan:
            got[length, gap] += many
        assert got == want
        assert all(left == counts[n] - sum(k for (length, _), k in want.items() if length == n) for n, left, _ in rest)


def test_packing_is_tight(spark, monkeypatch):
    """Against best-fit decreasing, one piece after the other; sequences ranked in one level and in two give one packing."""
    import random

    rng = random.Random(2)
    texts = [" ".join(["a"] * rng.choice([1, 3, 30, 120, 300, 500, 700])) for _ in range(400)] + [None] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = packing.packed(docs, capacity=512).toPandas()
    bins = []
    for length in sorted(rows["length"], reverse=True):
        best = min((b for b in bins if 512 - b[0] >= length), key=lambda b: 512 - b[0], default=None)
        if best:
            best[0] += length
        else:
            bins.append([length])
    assert rows.groupby("sequence_id")["length"].sum().max() <= 512
    assert rows["sequence_id"].nunique() <= 1.02 * len(bins) + 1
    monkeypatch.setattr(packing, "FEW", 0)
    again = packing.packed(docs, capacity=512).toPandas()
    assert set(map(tuple, rows.to_numpy())) == set(map(tuple, again.to_numpy()))


def test_sequences_round_trip(spark, middle):
    docs = table(spark, middle, "documents").filter("doc_id < 40")
    placed = packing.packed(docs, with_ids=True)
    total = placed.agg(F.sum("length")).first()[0]
    assert packing.sequences(placed).agg(F.sum(F.size("ids"))).first()[0] == total
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    whole = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p")).join(docs, "doc_id").collect()
    assert all(t.decode([k for p in r["p"] for k in p["ids"]][:-1]) == r["text"] for r in whole)


# 10 search


def test_pruning_is_exact(spark, middle):
    docs = table(spark, middle, "documents")
    asked = F.col("doc_id") % 50 == 0
    small = search.top_k(docs, asked, k=7, shard_words=20_000).collect()
    large = search.top_k(docs, asked, k=7).collect()
    assert Counter(map(tuple, small)) == Counter(map(tuple, large)) and len(small) > 100
