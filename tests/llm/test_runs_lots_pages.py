"""Periodic runs, lot matching and page texts against brute-force versions and written-out cases."""

from __future__ import annotations

import datetime
import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lorekeep.llm import lot_matching, page_text, periodic_runs
from lorekeep.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# Periodic runs


def brute_runs(x, least=24, times=3):
    """Every period at every stretch of matches, by comparing each word with the one a period before."""
    n, best = len(x), {}
    for q in range(1, n // times + 1):
        start = 0
        for i in range(q, n + 1):
            if i == n or x[i] != x[i - q]:
                if i - start >= max(least, times * q):
                    best.setdefault((start, i), q)
                start = i - q + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def brute_row(i, text):
    words = text.encode().split()
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (i, len(runs), *first, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (9, 4), (1, 3)])
def test_runs_of_random_texts(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(150):
        x = []
        while len(x) < rng.randrange(160):
            piece = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 12))]
            x += piece * rng.choice([1, 1, 2, 3, 5, 9])
        x = np.array(x, np.int64)
        assert periodic_runs.find_runs(x, least, times) == brute_runs(x.tolist(), least, times)


def test_runs_of_one_word_nested_and_long():
    one = np.zeros(5000, np.int64)
    assert periodic_runs.find_runs(one) == [(0, 5000, 1)]
    nested = np.array(([0] * 30 + [1]) * 40)
    assert periodic_runs.find_runs(nested) == brute_runs(nested.tolist())
    rng = np.random.default_rng(1)
    long = np.concatenate([rng.integers(0, 1 << 20, 100_000), np.tile(rng.integers(0, 1 << 20, 9_000), 12)])
    assert periodic_runs.find_runs(long) == [(100_000, 108_000, 9_000)]
    assert periodic_runs.agree(24, 3) == 4


def test_runs_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b " * 30, "x"), (None, "c " * 40, "x"), (3, "a b " * 30, "x"), (4, "é é  " * 25, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = sorted(((r["doc_id"], len(r["words"]), [tuple(x) for x in r["runs"]]) for r in periodic_runs.runs(docs).collect()), key=repr)
    assert got == sorted([(1, 0, []), (2, 0, []), (3, 60, [(0, 60, 2)]), (3, 60, [(0, 60, 2)]), (None, 40, [(0, 40, 1)]), (4, 25, [(0, 25, 1)])], key=repr)
    texts = {r["doc_id"]: r["text"] for r in periodic_runs.collapsed(docs).collect()}
    assert texts[3] == "a b" and texts[None] == "c" and texts[1] == ""
    assert periodic_runs.runs(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_op11(spark):
    texts = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_row(i, t) for i, t in texts)
    assert sum(r[1] > 0 for r in got) > 5


# Lot matching


def brute_lots(lines, sales):
    """Unit by unit and return by return, from the rules' text."""
    of = defaultdict(list)
    for s, client in sales:
        if client is not None:
            of[s].append(client)
    groups = defaultdict(lambda: ([], []))
    for s, line, item, q, amount, discount, flag, shipped in lines:
        if None in (s, item, q, amount, shipped) or q < 1:
            continue
        c, d = math.floor(100 * amount + 0.5), math.floor(100 * (discount or 0.0) + 0.5)
        day = (shipped - datetime.datetime(1970, 1, 1)).days
        h = zlib.crc32(f"{s}:{'' if line is None else line}".encode())
        for client in of[s]:
            lots, returns = groups[client, item]
            order = (s, -math.inf if line is None else line, q, c, d)
            lots.append([day, *order, q, line])
            if flag == "returned":
                returns.append((day + 1 + h % 31, *order, 1 + h % (q + 30)))
    out = []
    for (client, item), (lots, returns) in groups.items():
        for no, (rday, s, _, q, c, d, units) in enumerate(sorted(returns), 1):
            here = sorted((x for x in lots if x[0] < rday and x[6]), key=lambda x: (-x[4] / x[3], *x[:6]))
            done = piece = 0
            refund = lambda n: math.floor(n * c * (100 - d) / (100 * q)) if n * c * 100 < 2**50 else n * c * (100 - d) // (100 * q)  # noqa: B023, E731
            while done < units:
                piece += 1
                lot = here.pop(0) if here else None
                take = min(units - done, lot[6]) if lot else units - done
                back = refund(done + take) - refund(done)
                if lot:
                    used = lot[3] - lot[6]
                    lot[6] -= take
                    cost = (used + take) * lot[4] // lot[3] - used * lot[4] // lot[3]
                    out.append((client, item, no, piece, rday, s, lot[1], lot[7], take, lot[6], back, back - cost))
                else:
                    out.append((client, item, no, piece, rday, s, None, None, take, None, back, None))
                done += take
    return sorted(out, key=repr)


LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def lot_rows(seed, n, clients=3, items=2, days=12, back=0.4):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    sales = [(s, rng.choice([None, *range(clients)])) for s in range(n // 3)]
    lines = []
    for _ in range(n):
        price, q = rng.choice([5.0, 5.0, 7.5, 3.33]), rng.choice([None, 1, 2, 3, 7, 20])
        lines.append((rng.randrange(n // 3), rng.choice([None, 1, 2, 3]), rng.choice([None, *range(items)]), q, None if rng.random() < 0.05 else round(price * (q or 1), 2), rng.choice([None, 0.0, 0.05, 0.1]), "returned" if rng.random() < back else "kept", None if rng.random() < 0.05 else start + datetime.timedelta(days=rng.randrange(days))))
    return [*lines, *lines[: n // 10]], [*sales, *sales[:2]]


def pieces(spark, lines, sales, **how):
    got = lot_matching.matched(spark.createDataFrame(lines, LINES), spark.createDataFrame(sales, "sale_id long, client_id long"), **how)
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize(("seed", "limit"), [(1, 20_000), (2, 20_000), (3, 4), (4, 9), (5, 25)])
def test_lots_as_by_hand(spark, seed, limit):
    """A small limit splits nearly every busy period into bands and chunks; the pieces are the same."""
    lines, sales = lot_rows(seed, 240, days=40 if seed == 5 else 12)
    assert pieces(spark, lines, sales, limit=limit) == brute_lots(lines, sales)


def test_lots_hot_period_in_bands(spark):
    lines, sales = lot_rows(9, 900, clients=1, items=1, days=30, back=0.5)
    assert pieces(spark, lines, sales, limit=60) == brute_lots(lines, sales)


def test_lots_edges(spark):
    lines, sales = lot_rows(6, 30)
    assert pieces(spark, [], sales) == [] and pieces(spark, lines, []) == []
    day = datetime.datetime(2024, 1, 3)
    # Nothing in stock: the return comes whole as one last piece; broken rows hold nothing.
    odd = [(1, 1, 1, 5, 10.0, 0.1, "returned", day), (1, 2, 1, 0, 10.0, 0.1, "returned", day), (1, 3, 1, -4, 10.0, 0.1, "returned", day), (1, 4, 1, 5, float("nan"), 0.1, "returned", day)]
    got = pieces(spark, odd, [(1, 1)])
    assert got == brute_lots(odd[:1], [(1, 1)]) and len(got) >= 1
    wide = spark.createDataFrame(lines, LINES).selectExpr("*", "1 as client_id", "2 as period", "3 as band", "4 as day")
    plain = lot_matching.matched(wide, spark.createDataFrame(sales, "sale_id long, client_id long").selectExpr("*", "'x' as flag", "1 as item_id"))
    assert sorted((tuple(r) for r in plain.collect()), key=repr) == brute_lots(lines, sales)


@pytest.mark.skipif(not os.path.isdir(f"{SF}/../sf0.001/sales.parquet") and not os.path.exists(f"{SF}/sales.parquet"), reason="no test tables here")
def test_op12(spark):
    lines = [tuple(r) for r in spark.read.parquet(f"{SF}/sale_lines.parquet").select(*[x.split()[0] for x in LINES.split(", ")]).collect()]
    sales = [tuple(r) for r in spark.read.parquet(f"{SF}/sales.parquet").select("sale_id", "client_id").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_lot_matching"](spark, SF).collect()), key=repr)
    assert got == brute_lots(lines, sales) and len(got) > 500


# Page texts

PAGES = {
    # Marked containers of every kind around an article with short blocks, links, lists and references.
    """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body class="has-sidebar">
<header id="top"><h1>Site name</h1><p>A slogan that is quite long, longer than many a paragraph of the page.</p></header>
<nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav>
<div class="cookie-notice">We use cookies to make this page better. Do you agree? <button>Yes</button></div>
<main><article class="post no-comments"><header class="article-header"><h1>Head</h1><p>By A</p></header>
<p>One &lt;b&gt;   two\n three&nbsp;<b>four</b> <a href=/y>five</a>.<br>six<p>Short.
<ul><li>first item<li>second <i>item</i></ul><script>if (a < b) x("</p>")</script>
<div class="ad">Buy <b>now</b>, it is cheap and good and this is a very long advert indeed.</div>
<p>Last <!-- no <p>comment</p> --> one<span class="share-buttons">Share <span>this</span></span> ends.</article>
<aside><p>Other things that one could read, at length and without end, on and on.</p></aside>
<section id="comments"><p>I liked this very much, thank you so much for writing all of it down.</p></section></main>
<form><p>Name and address and much else that one has to give here</p><input></form><footer>&copy; 2024 &middot; words and words</footer></body></html>""": ["Head", "One <b> two three four five. six", "Short.", "first item", "second item", "Last one ends."],
    # No article element: the region of dense lines and what its element holds beside them.
    "<html><body><div id=w><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></div><div id=c><h2>Title here</h2>"
    + "<p>A long paragraph of words that goes on for a while, with a comma, and an end of it.</p><p>So.</p>" * 3
    + "</div><div id=f><a href=4>About</a> <a href=5>Imprint</a></div></body></html>": ["Title here", *["A long paragraph of words that goes on for a while, with a comma, and an end of it.", "So."] * 3],
    # Straight in the body.
    "<body><p><a href=1>Home</a></p><h1>Up</h1><p>Some words that make up a paragraph of the text.</p><p>And then more words that make up another paragraph.</p><p><a href=2>Next</a></p>": ["Up", "Some words that make up a paragraph of the text.", "And then more words that make up another paragraph."],
    # Classes that say what an article is about, or what a wrapper has, do not take them out; an article that is a comment goes.
    '<body class="single"><div class="main comments-open"><article class="post tag-ad category-promo"><h2>On adverts</h2><p>What they say of themselves.</p></article><section class="replies"><article class="comment by-reader"><p>Nice, and here is a long answer to it all.</p></article></section></div></body>': ["On adverts", "What they say of themselves."],
    '<main><p class="notice">Our terms have changed, please read them again before you go on.</p><div role="alert">Offline</div><table><tr><td><h3>Cell</h3><p>The text stands in a table here, and there is a bit of it.</p></td><td class="sidebar">Links and more links</td></tr></table></main>': ["Cell", "The text stands in a table here, and there is a bit of it."],
    # The heading stands beside the element that holds the text.
    "<div class=wrap><div class=left><ul><li><a href=1>Link one</a></li><li><a href=2>Link two</a></li></ul></div><div class=mid><h1>T</h1><div class=body><p>The first paragraph has a good many words in it.</p><p>So has the second one, or nearly as many.</p></div></div></div>": ["T", "The first paragraph has a good many words in it.", "So has the second one, or nearly as many."],
    "": [],
    "<html><body><nav>only a menu</nav></body></html>": [],
    "just text, no tags": ["just text, no tags"],
    "<p>kept<!-- never closed <p>gone": ["kept"],
    "<p>kept</p><a href='unfinished": ["kept"],
    "<article><p>a</p></article><div class=ad>much longer advert text than the article has</div>": ["a"],
    "<article><p>&#233;&eacute;&amp;amp; &unknown; &#x1F600;</p></article>": ["éé&amp; &unknown; \U0001f600"],
    "<article><![CDATA[x]]><p>b</p><?pi?></article></div></b></article>": ["b"],
}


@pytest.mark.parametrize("html", PAGES)
def test_page(html):
    assert page_text.content(html) == PAGES[html]


def test_page_parts():
    assert np.allclose(page_text.smoothed(np.array([5.0, 5.0, 5.0, 5.0])), 5.0)
    assert 1 < page_text.threshold(np.array([0.0, 0.5, 1.0, 90.0, 100.0, 80.0])) < 80


@pytest.mark.parametrize("html", ["<a " * 100_000, "<!--" * 200_000, "<div>" * 50_000 + "x" + "</p>" * 50_000, "<p>word " * 50_000, "&" * 300_000, "<![" * 100_000, "</" * 100_000])
def test_page_odd_and_long(html):
    page_text.content(html)  # ends soon


def test_pages_table(spark):
    body = "<article><p>x\ny</p><p>" + "long words " * 100_000 + "</p></article>"
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "v", body, 1), (None, "v", body, 1)], "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in page_text.extracted(df).collect()), key=repr)
    want = "x y\n\n" + ("long words " * 100_000).strip()
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", want, len(want)), (None, "v", want, len(want))], key=repr)
    assert page_text.extracted(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_op13(spark):
    """The test pages keep their text in one article element between menu, advert and footer."""
    import html as references
    import re

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op13_page_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        source = re.search("<article>(.*)</article>", pages[r["page_id"]]["html"], re.DOTALL).group(1)
        blocks = re.split("<(?:/?p|/?h1)>", source.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
        want = "\n\n".join(x for x in (" ".join(references.unescape(b).split()) for b in blocks) if x)
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))
