"""Language model, repeated strings, main text of pages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import katz, main_text, repeats
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_discounts():
    d = katz.discounts(np.array([0, 1000, 400, 200, 120, 80, 60]))
    assert d[0] == 0 and (0 < d[1:]).all() and (d[1:] < 1).all()
    # counts of counts that give no valid discount, and none at all
    assert katz.discounts(np.array([0, 5, 50, 1, 0, 0, 0])).tolist() == [0, 0.5, 0.75, 2.5 / 3, 3.5 / 4, 4.5 / 5]
    assert katz.discounts(np.zeros(7)).tolist() == [0, 0.5, 0.75, 2.5 / 3, 3.5 / 4, 4.5 / 5]


@pytest.mark.parametrize("size", [katz.BLOCK_BYTES, 30000])
def test_katz(spark, size):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200").repartition(3)
    want, sums = brute.katz([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], katz.discounts)
    assert sums == pytest.approx([1.0] * len(sums), abs=1e-9)
    got = katz.score_texts(df, block_bytes=size).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][4:], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_edges(edge_docs, edge_rows, no_docs):
    got = katz.score_texts(edge_docs).collect()
    assert len(got) == len(edge_rows) and all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(1 + len(brute.WORD.findall(t or "")) for _, t in edge_rows)
    assert katz.score_texts(no_docs).count() == 0
    number = next(i for i in range(6, 60) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = katz.score_texts(edge_docs.where(f"doc_id = {number}")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.score) for r in alone] == [(True, 0, 0, 0.0)]


def repeated_texts():
    rng = random.Random(5)
    voc = [f"w{k}" for k in range(300)] + ["é", "ab"]
    passages = [" ".join(rng.choice(voc) for _ in range(rng.randint(10, 80))) for _ in range(25)]
    rows = []
    for i in range(200):
        text = []
        for _ in range(rng.randint(0, 5)):
            kind, p = rng.random(), rng.choice(passages)
            text.append(p if kind < 0.45 else p[rng.randrange(len(p)):] if kind < 0.55 else "xy " * rng.randint(10, 200)
                        if kind < 0.6 else "a" * rng.randint(50, 600) if kind < 0.63
                        else " ".join(rng.choice(voc) for _ in range(rng.randint(1, 60))))
        rows.append((i, " ".join(text)))
    return rows + [(900, None), (901, ""), (902, rows[3][1]), (3, rows[3][1])]


def removed(df, length, **sizes):
    return sorted((tuple(r) for r in repeats.remove_repeats(df, length, **sizes).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


@pytest.mark.parametrize("length,hot,segment,block", [
    (200, 2000, 2 << 20, 16 << 20), (200, 3, 2 << 20, 16 << 20), (200, 0, 1000, 20000), (64, 2000, 1500, 20000)])
def test_repeats(spark, length, hot, segment, block):
    rows = repeated_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(df, length, hot=hot, segment=segment, block_bytes=block) == brute.remove_repeats(rows, length)


def test_repeats_edges(edge_docs, edge_rows, no_docs):
    assert removed(edge_docs, 200) == brute.remove_repeats(edge_rows, 200)
    assert removed(no_docs, 200) == []


def test_suffix_sort():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    start, group = rng.permutation(3900), rng.integers(0, 7, 3900)
    order = repeats.sort_suffixes(data, repeats.PrefixHashes(data), start, group, 50)
    keys = [(group[i], data[start[i]:start[i] + 50].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(3900))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body><header><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do, and more of them.</div>
%s
<aside><p>Sidebar text, quite long, with a comma or two, and words.</p></aside>
<form><p>Your name, your mail, your wishes, all of it here.</p><button>Send</button></form>
<div id="comments"><div class="comment"><p>First! I think this is great, really, truly, and so on.</p></div></div>
<footer>&copy; 2024, the site, all rights, reserved.</footer></body></html>"""
ARTICLE = ("<h1>A  title</h1><!-- ad --><p>The first&nbsp;paragraph, with <b>bold</b> and <a href='x>y'>a link</a>, is long enough."
           "<p>The second &lt;one&gt;,\n  broken over lines, ends<br>here.</p><div class=\"ad\">Buy now, buy more!</div>"
           "<ul><li>one thing</li><li>another</li></ul><p style='display:none'>hidden, hidden</p><p>Short.</p>")
MAIN = ("A title\nThe first paragraph, with bold and a link, is long enough.\nThe second <one>, broken over lines, ends here.\n"
        "one thing\nanother\nShort.")


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div class='post'>%s</div></main>", "<div class='content'>%s</div>"])
def test_main_text(wrap):
    assert main_text.main_text(PAGE % (wrap % ARTICLE)) == MAIN


@pytest.mark.parametrize("wrap", [
    "<article class='post type-post tag-python'>%s</article>", "<div class='entry-content has-sidebar'>%s</div>",
    "<div class='content no-sidebar'>%s</div>", "<div class='main-content with-sidebar'>%s</div>",
    "<article class='comments-open post'>%s</article>", "<div class='content-sidebar-wrap'><div class='content'>%s</div></div>",
    "<article class='post sidebar'>%s</article>", "<div class='promo' itemprop='articleBody'>%s</div>",
    "<div id='search-page'><article>%s</article></div>", "<div class='category-legal post'>%s</div>"])
def test_main_text_class_names(wrap):
    assert main_text.main_text(PAGE % (wrap % ARTICLE)) == MAIN


def test_main_text_long_noise():
    """Noise longer than the article's paragraphs stays out."""
    long = "Words of others, long and with commas, again and again, more of them, and more. " * 4
    for noise in ("<div class='cookie-notice'><p>%s</p></div>", "<div class='sidebar'><p>%s</p></div>",
                  "<section id='comments'><article class='comment'><p>%s</p></article></section>",
                  "<article><p>One of ours, in full.</p><article class='comment-body'><p>%s</p></article></article>"):
        got = main_text.main_text(PAGE % ("<div class='content'>" + ARTICLE * 3 + "</div>" + noise % long))
        assert "Words of others" not in got and got


LONG = "<p>A paragraph of the article, long enough, with marks, and a <a href=x>link</a> as well.</p>"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<article><header>%s</div></article>"])
def test_main_text_linked_blocks(wrap):
    head, parts = "<h1><a href=t>The title</a></h1>", LONG + "<h2><a href=s>A part</a></h2>" + LONG
    sources = "<h2>Sources</h2><ol><li><a href=1>The first source</a></li><li><a href=2>The second</a></li></ol>"
    if "header" in wrap:
        head, wrap = head + "</header><div class='body'>", "<article><header>%s</div></article>"
    text = "A paragraph of the article, long enough, with marks, and a link as well."
    assert main_text.main_text(PAGE % (wrap % (head + parts + sources))).split("\n") == [
        "The title", text, "A part", text, "Sources", "The first source", "The second"]


def test_main_text_lists_outside():
    """Lists of links go at the border of a container and stay amid its text."""
    links = "<ul><li><a href=1>%s one</a></li><li><a href=2>%s two</a></li></ul>"
    page = PAGE % ("<div class='content'>" + links % ("top", "top") + "<h2><a href=x>Title</a></h2>" + LONG
                   + links % ("mid", "mid") + LONG + links % ("end", "end") + "</div>" + links % ("out", "out"))
    got = main_text.main_text(page).split("\n")
    assert [t for t in got if not t.startswith("A paragraph")] == ["Title", "mid one", "mid two"]
    cells = "<table><tr><td class='left'><a href=1>Home page</a></td><td class='text'>A cell, with text, that is the article, of some length.</td></tr></table>"
    assert main_text.main_text(cells) == "A cell, with text, that is the article, of some length."


def made_page(rng):
    """A page without links in its text: nested containers, some of them articles."""
    def text(most):
        return "".join(rng.choice(["word", "é&amp;x", "<b>bold</b>", "long-ish word", "a<br>b"]) + rng.choice([" ", ", ", ". ", "  "])
                       for _ in range(rng.randint(1, most)))

    def part(depth):
        kind = rng.random()
        if depth < 3 and kind < 0.35:
            tag, name = rng.choice(["div", "section", "div"]), rng.choice(["", " class=box", " class='body wide'", " class=col"])
            return f"<{tag}{name}>" + "".join(part(depth + 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"
        if kind < 0.45:
            return "<ul>" + "".join(f"<li>{text(6)}" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind < 0.55:
            return f"<blockquote><p>{text(30)}</p></blockquote>"
        return f"<h2>{text(4)}</h2>" if kind < 0.65 else f"<p>{text(40)}" + rng.choice(["", "</p>"])

    body = "".join(part(0) for _ in range(rng.randint(1, 6)))
    if rng.random() < 0.4:
        body = f"<article>{body}</article>" + "".join(part(1) for _ in range(rng.randint(0, 3)))
    return f"<html><head><title>{text(3)}</title></head><body><nav><ul><li><a href=x>{text(3)}</a></ul></nav>{body}<footer>{text(20)}</footer></body></html>"


def test_main_text_against_plain_version(spark):
    rng = random.Random(8)
    for page in [made_page(rng) for _ in range(400)]:
        assert main_text.main_text(page) == brute.main_text(page), page
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.select("page_id", "html").collect()}
    got = main_text.extract(pages).collect()
    assert len(got) == len(html) and all(r.text == brute.main_text(html[r.page_id]) for r in got)


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just, some text", "just, some text"), ("<p>a < b, c", "a < b, c"),
    ("<p>open <b>bold<p>next", "open bold\nnext"), ("<article><p>one<!-- two", "one"), ("<script>x", ""), ("<p>a</p><", "a\n<"),
    ("<nav>only a menu</nav>", "")])
def test_main_text_edges(page, want):
    assert main_text.main_text(page) == want


def test_extract(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE % ARTICLE, "x"), (1, "u", PAGE % ARTICLE, "x"), (2, None, None, None), (3, "v", "<p>é" + "<i>x</i>" * 5000, "y")],
        "page_id long, url string, html string, text string")
    got = main_text.extract(pages).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, len(MAIN)), (1, len(MAIN)), (2, 0), (3, 5001)]
    assert main_text.extract(pages.limit(0)).count() == 0
