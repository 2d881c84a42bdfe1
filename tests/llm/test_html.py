import html
import random
import re
import time

from lintmill.llm.html_extract import extract, extract_text, learn, weights_of
from lintmill.llm.queries import op9_html_extraction

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no</p>";</script><style>p{}</style></head><body><nav><ul><li><a href="/x">Home page</a></li>'
    "<li><a href='/y'>About us and more words</a></li></ul></nav><div class=\"ad\">Buy these fine things now at once and more</div>%s"
    "<footer>&copy; someone &middot; all words reserved</footer></body></html>"
)


def test_finds_the_article():
    body = "<article><h1>Big &amp; small</h1><p>One  two\n three <b>four</b>, five<br>six &lt;seven&gt;.</p><div class='ads'>advert words here</div><p></p><p>The last of all, &eacute;nd</p></article>"
    weights = weights_of({})
    assert extract(PAGE % body, weights) == "Big & small\nOne two three four, five six <seven>.\nThe last of all, énd"


def test_short_article_wins_over_longer_boilerplate():
    assert extract(PAGE % "<article><p>Tiny text</p></article>", weights_of({})) == "Tiny text"


def test_cut_and_odd_pages():
    weights = weights_of({})
    assert extract("", weights) == extract("<p></p>", weights) == extract("<nav>a b</nav>", weights) == ""
    assert extract('<article><p>One two three</p><p>four &am', weights) == "One two three\nfour &am"
    assert extract('<article><p>One two</p><a href="cut', weights) == "One two"
    assert extract("<p>a < b and c > d</p>", weights) == "a < b and c > d"
    assert extract("<script>var x = '<p>no</p>'", weights) == ""
    assert len(extract("<p>" + "word " * 200_000, weights)) == 999_999


def test_learned_weights_drop_unknown_boilerplate(spark):
    page = "<body><div class='qz7'>Odd box of words</div><article><p>%s</p></article></body>"
    pages = spark.createDataFrame([(i, page % ("text of page %d " % i * 20)) for i in range(30)], "page_id long, html string")
    weights = learn(pages)
    assert weights["div.qz7"] < -weights[""]
    other = spark.createDataFrame([(1, "<div class='qz7'>Odd box of words</div><p>Plain page</p>"), (2, None), (3, "")], "page_id long, html string")
    assert {r.page_id: r.text for r in extract_text(other, weights=weights).collect()} == {1: "Plain page", 2: "", 3: ""}
    assert extract_text(pages.where("false")).count() == 0


def test_query_against_the_marked_articles(spark, given):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{given}/pages.parquet").collect()}
    for row in op9_html_extraction(spark, given).collect():
        found = re.search(r"<article>(.*?)(</article>|\Z)", pages[row.page_id] or "", re.S)
        body = re.sub(r"<[a-zA-Z/][^>]*\Z", "", found[1] if found else "")
        blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>", "\x01", body.replace("<br>", " "))).split("\x01")
        expected = "\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))
        assert (row.text, row.n_chars) == (expected, len(expected))


def test_weights_of_more_than_20000_features(spark, monkeypatch):
    import lintmill.llm.html_extract as module

    many = "".join(f"<div id='p%d-{k}'>some more words here</div>" for k in range(1100))
    page = "<body>%s<article><p>%s</p></article></body>"
    rows = [(i, page % ("<div class='qz7'>Odd box</div>" * (i == 0) + many.replace("%d", str(i)), "text of page %d " % i * 2000)) for i in range(20)]
    rows.append((99, "<div class='qz7'>Odd box</div><p>Plain page</p>"))
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert got[99] == "Plain page" and got[3] == " ".join(["text of page 3"] * 2000)
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == got


WORDS = "alpha beta gamma delta été one two three four five".split()


def made_page(rnd, labelled=True):
    """A page with menus of plain links and an article of links, lists and nested inline elements; and the article's text."""

    def inline(depth=0):
        words = " ".join(rnd.choices(WORDS, k=rnd.randint(1, 6)))
        if depth < 3 and rnd.random() < 0.5:
            tag, attributes = rnd.choice([("a", ' href="/x?a=1&amp;b=2"'), ("a", " title='a > b'"), ("b", ""), ("span", ' class="w3"'), ("em", ""), ("a", ' href="/open')])
            inner, text = inline(depth + 1)
            return f"{words} <{tag}{attributes}>{inner}</{tag}> end", f"{words} {text} end"
        return words, words

    blocks, texts = [], []
    for _ in range(rnd.randint(3, 8)):
        body, text = inline()
        kind = rnd.choice(["<p>%s</p>", "<p>%s", "<p><a>%s</a></p>", "<ul><li>%s</ul>", "<h2>%s</h2>", "<blockquote><p>%s</p></blockquote>", "<div><span>%s</span></div>"])
        blocks.append(kind % body)
        texts.append(text)
    article = "article" if labelled else "section"
    menus = ["<div><a href='/m'>Menu words here now</a> <a>and more of them</a></div>" for _ in range(rnd.randint(2, 5))]
    page = f"<html><body>{''.join(menus)}<{article}>{''.join(blocks)}<div class='comments'><p>A reader says this</p></div></{article}>{menus[0]}</body></html>"
    return page, "\n".join(texts)


def test_articles_are_kept_whole(spark):
    rnd = random.Random(7)
    made = [made_page(rnd) for _ in range(120)]
    made += made[:5]
    pages = spark.createDataFrame([(i, page, "x") for i, (page, _) in enumerate(made)], "page_id long, html string, text string")
    rows = extract_text(pages).collect()
    assert len(rows) == len(made) and {r.page_id: r.text for r in rows} == {i: text for i, (_, text) in enumerate(made)}


def test_links_count_for_the_region_only():
    weights = {"": 1.0, "a": -4.0, "div": -0.5}
    page = "<div><a>menu one</a> <a>menu two</a></div><section><p><a>first</a></p><p>%s <a>a link</a> here</p><p><a>last words</a></p></section>"
    assert extract(page % ("plain words " * 9), weights) == "first\n" + "plain words " * 9 + "a link here\nlast words"


def test_deep_pages_take_linear_time():
    weights = weights_of({})
    for tag in ("<b>", "<div>", "<i>w ", "<p><b>", "<li>", "</b>", '<a href="x'):
        started = time.perf_counter()
        text = extract("<article><p>one two</p>" + tag * 50_000 + "</u>" * 50_000 + "<hr>" * 50_000 + "<p>tail words</p>", weights)
        assert time.perf_counter() - started < 20 and (tag[-1] == "x" or text.endswith("tail words"))
    assert extract("<a 'b\"c " * 50_000, weights) == ""


def test_open_quotes():
    weights = weights_of({})
    assert extract('<article><p>One <a href="x>two</a> and three</p><p title=\'>four</p></article>', weights) == "One two and three\nfour"
    assert extract("<article><p>One <a title='a > \"b\"' href=\"/y\">two</a></p></article>", weights) == "One two"
