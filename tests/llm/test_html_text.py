"""Main text of pages: what goes, what stays, both passes, edge cases."""

from __future__ import annotations

import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from adlayer.llm import html_text as h

DATA = "/root/testdata/sf0.01"
PROSE = "It was the first of many days that they had spent in the old house by the sea, and there was not a word of it in the book that he wrote for his friends when all of this was over and the rest of them had gone to where they came from. " * 2


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body>{body}</body></html>"


def test_what_goes():
    body = f"""<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div id=sidebar><p>{PROSE}</p></div>
    <article><h1>Title &amp; more</h1><p>{PROSE}<p>Short.<br>Line<script>x()</script></p><div class="ad">Buy</div><form><p>{PROSE}</p></form><aside>{PROSE}</aside><section id="comments"><p>{PROSE}</p></section><!-- <p>hidden</p> --></article>
    <footer>&copy; x</footer><noscript><p>{PROSE}</p></noscript>"""
    assert h.main_text(page(body)) == "\n\n".join(["Title & more", PROSE.strip(), "Short. Line"])


def test_white_space_and_references():
    assert h.main_text(page("<article><p>a&nbsp;&#65;\n\t b&lt;i&gt; c</p><p> \n </p></article>")) == "a A b<i> c"


def test_blocks_without_an_article():
    body = f"<div>menu item</div><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p><div><a href=x>{PROSE}</a></div><div>tail</div>"
    assert h.main_text(page(body)) == "\n\n".join([PROSE.strip(), "Short one.", PROSE.strip()])


def plain_second_pass(blocks, labels, marked):
    """By looking outwards from each block, step by step."""
    out = []
    for i, (block, label) in enumerate(zip(blocks, labels)):
        if label != "undecided":
            out.append(label)
            continue
        said = block.text.endswith((".", "!", "?")) or len(block.text) >= 70
        edge = "good" if marked or said else "bad"
        left = next(((k, labels[i - k]) for k in range(1, i + 1) if labels[i - k] != "undecided"), (i + 1, edge))
        right = next(((k, labels[i + k]) for k in range(1, len(labels) - i) if labels[i + k] != "undecided"), (len(labels) - i, edge))
        if marked and not block.link_chars:
            out.append("good")
        elif block.tag in ("h1", "h2"):
            out.append(right[1])
        elif left[0] == right[0] and left[1] != right[1]:
            out.append("good" if marked or said else "bad")
        else:
            out.append(min(left, right, key=lambda x: x[0])[1])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["good", "bad", "undecided", "undecided"]), st.sampled_from(["p", "h2", "li"]), st.sampled_from(["x", "x.", "y" * 80]), st.booleans()), max_size=12), st.booleans())
def test_second_pass_against_plain_code(rows, marked):
    blocks = [h.Block(tag, text, int(link), marked) for _, tag, text, link in rows]
    labels = [r[0] for r in rows]
    assert h.second_pass(blocks, labels, marked) == plain_second_pass(blocks, labels, marked)


def test_second_pass_takes_the_nearest_neighbours():
    b = [h.Block("p", "x", 0, False)] * 6
    assert h.second_pass(b, ["good", "undecided", "undecided", "undecided", "bad", "undecided"], False) == ["good", "good", "bad", "bad", "bad", "bad"]
    assert h.second_pass([h.Block("h2", "x", 0, False), *b[:1]], ["undecided", "good"], False) == ["good", "good"]


def test_first_pass_labels():
    assert h.first_pass(h.Block("p", PROSE, 0, False)) == "good"
    assert h.first_pass(h.Block("p", PROSE, len(PROSE), False)) == "bad"
    assert h.first_pass(h.Block("p", "short", 0, False)) == "undecided"
    assert h.first_pass(h.Block("p", "xyzzy " * 40, 0, False)) == "bad"
    assert h.first_pass(h.Block("p", "xyzzy " * 40, 0, True)) == "undecided"


def test_markup_in_scripts_and_comments():
    assert h.main_text(page('<script>var a = "<!--";</script><article><p>Kept.</p></article>')) == "Kept."
    assert h.main_text(page("<!-- <script> --><article><p>Kept.</p></article><!-- </script> -->")) == "Kept."
    assert h.main_text(page("<article><p>Short.</p><p>see <a href=x>a long link text</a></p></article>")) == "Short.\n\nsee a long link text"


def test_wrappers_stay():
    article = f"<article><h1>T</h1><p>{PROSE}</p></article>"
    want = f"T\n\n{PROSE.strip()}"
    for body in (f"<div id=page class='site has-sidebar'>{article}</div>", f"<form action=x>{article}</form>", f"<div class='post comments-open no-footer'>{article}</div>", f"<div class='social widget'>{article}<p>tail</p></div>", f"<form><h1>T</h1><p>{PROSE}</p></form>"):
        assert h.main_text(page(body)) == want, body
    assert h.main_text(page(f"{article}<section id=comments><article class=comment><p>{PROSE * 9}</p></article></section>")) == want
    assert h.main_text(page(f"<article><p>Few words.</p></article><div class=ad>{PROSE}</div>")) == "Few words."


def test_other_languages():
    italian = "Nel mezzo di un giorno di pioggia la gente di tutta la citta si era messa a correre verso la piazza, e non si sapeva che cosa la spingesse; di certo la paura e la voglia di vedere, la curiosita di chi non si ferma. "
    japanese = "これは長い文章の例である。私は毎日本を読むのが好きで、図書館の本はとても多い。その中の一つを友人に渡すと、彼はそれを見て笑った。空の色は青く、風の音は静かである。"
    for text in (italian, japanese):
        assert h.main_text(page(f"<div>menu</div><p>{text * 2}</p><p>{text}</p>")) == f"{(text * 2).strip()}\n\n{text.strip()}"


def test_without_the_article_tag(spark):
    """By the rules alone: nearly all blocks, no page empty."""
    kept = total = 0
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        whole = h.main_text(r["html"]).split("\n\n")
        out = h.main_text(r["html"].replace("<article>", "<div>").replace("</article>", "</div>"))
        assert out
        kept, total = kept + len(set(whole) & set(out.split("\n\n"))), total + len(set(whole))
    assert kept > 0.93 * total


def test_broken_pages():
    for body in ("", "<", "<p", "a < b > c", "</div></p>", "<div class='ad'>never closed", "<script>never closed", "<!-- never closed", "<p>" * 3000 + "x"):
        assert isinstance(h.main_text(body), str)
    assert h.main_text(None) == "" and h.main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("word") == 20_000


def test_all_pages_of_a_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    got = h.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", rows[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:h1|p)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_tables(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", page("<article><p>x</p></article>"))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in h.extract(pages).collect()) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "x", 1)]
    assert h.extract(pages.where("false")).count() == 0


LONG = "The story of the town is told here in a long sentence that goes on for some time, and that is what it says. "


def test_wrappers_named_for_comments():
    """A wrapper of the page, or of its article, stays; a section of comments goes, also one with articles of its own."""
    body = f"<h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p>"
    want = h.main_text(f"<article>{body}</article>")
    assert LONG.strip() in want
    assert h.main_text(f'<div id="page-comments"><article>{body}</article></div>') == want
    assert h.main_text(f'<div class="single comments"><article>{body}</article></div>') == want
    assert LONG.strip() in h.main_text(f'<div class="single comments">{body}</div>')
    remarks = f'<ol class="comments"><li class="comment"><article><p>{LONG.replace("story", "remark")}</p></article></li></ol>'
    assert h.main_text(f"<article>{body}</article>{remarks}") == want
    assert "remark" not in h.main_text(f"<div>{body}{body}</div>" + remarks.replace("article", "div"))
    assert "remark" not in h.main_text(f'<article>{body}<div class="comments"><p>{LONG.replace("story", "remark")}</p></div></article>')


def test_formulas_and_odd_attributes_stay_in_place():
    page = f"<article><p>{LONG}It is <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation encoding='t'>x+1</annotation></math> here.</p><p data-x=it's title=\"a > b\">{LONG}</p></article>"
    assert h.main_text(page) == f"{LONG}It is x+1 here.\n\n{LONG.strip()}"
