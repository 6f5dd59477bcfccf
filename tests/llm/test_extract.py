import html
import itertools
import random
import re

from cutloom.llm import extract
from cutloom.tables import table

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site name</h1></header><div id="cookie-notice">We use cookies. Accept them all.</div><nav><a href=x>Home</a></nav>
<div class="layout"><div class="content"><h2>Story title</h2><p class=byline>By someone</p><p>First paragraph of the <b>story</b> with an &eacute;t&eacute; and a <a href="x">link</a>, long enough
 to   be content.</p><div class="ad">Buy now!</div><p>Short one.</p><p>Another long paragraph of the story,<br>which goes on until it ends here.</p>
<form><label>Email</label><input name=q><button>Subscribe</button></form></div><aside><h3>Related</h3><ul><li><a href=a>One thing</a><li><a href=b>Another</a></ul></aside></div>
<section id="comments"><article class="comment"><p>I really like this long story, it was a pleasure to read it.</p></article></section><footer>&copy; 2020 Site</footer><script>var a="<p>no</p>";</script></body></html>"""


def test_page():
    assert extract.main_text(PAGE).split("\n") == ["Story title", "First paragraph of the story with an été and a link, long enough to be content.", "Short one.", "Another long paragraph of the story,", "which goes on until it ends here."]


def test_article_keeps_all_and_only_its_text():
    page = '<!DOCTYPE html><body><nav>a b</nav><!-- <p>x</p> --><div class="ad">Buy it now.</div><article><h1>A&amp;B&amp;amp;</h1><p><b>One<br><p>Of.<p>x &lt; y</p><p hidden>no</p><div class="comments"><p>Nice text, really.</p></div></article><footer>&copy; z</footer>'
    assert extract.main_text(page) == "A&B&amp;\nOne\nOf.\nx < y"


def test_broken_and_empty_pages():
    for page in (None, "", "<p", "<!--", "<script>x", "<a href='", "</p></p>", "&", "<nav>" * 500, "<a " + "x" * 100_000, "<a b='" * 20_000):
        assert extract.main_text(page) == ""
    assert extract.main_text("<" * 50_000) == "<" * 50_000  # no markup, so text
    assert extract.main_text("<article><p <b>One is here.</b><p title='a > b'>Two is here.<p title=\"x>Three is here.") == "One is here.\nTwo is here.\nThree is here."
    assert extract.main_text("<article>" + "<p>A paragraph that is here.</p>" * 3000).count("\n") == 2999


def test_minimum_cut_is_minimal():
    pick = random.Random(4)
    for _ in range(300):
        n = pick.randint(1, 9)
        z = [pick.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, pick.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if pick.random() < 0.5]
        cost = lambda side: sum(abs(x) for x, s in zip(z, side, strict=True) if (x > 0) != bool(s)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        assert abs(cost(extract.minimum_cut(z, edges)) - min(map(cost, itertools.product([0, 1], repeat=n)))) < 1e-9


LINE = "A paragraph of the story that says something at some length, and then goes on."
LINKS = "<a href=a>Home</a> <a href=b>News</a>"
WHOLE = {
    f'<form id="aspnetForm"><nav>{LINKS}</nav><div><h1>Title</h1><p>{LINE}</p><p>Short.</p></div><footer>&copy; x</footer></form>': ["Title", LINE, "Short."],
    f'<form id="aspnetForm"><nav>{LINKS}</nav><article><h1>Title</h1><p>{LINE}</p><p>Short.</p></article><footer>&copy; x</footer></form>': ["Title", LINE, "Short."],
    f'<div class="elementor-widget"><h1>Title</h1></div><div class="elementor-widget"><p>{LINE}</p><p>Short</p></div><div class="sidebar"><p>Read our other things too.</p></div>': ["Title", LINE, "Short"],
    f'<article><h1>Title</h1><p>{LINE}</p><section class="related-work"><h2>Related work</h2><p>{LINE}</p><p>Few did.</p></section></article>': ["Title", LINE, "Related work", LINE, "Few did."],
    f'<article><h1>Title</h1><p>{LINE}</p><div class="discussion"><h2>Discussion</h2><p>{LINE}</p><p>Yes</p></div></article>': ["Title", LINE, "Discussion", LINE, "Yes"],
    "<article><p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><title>a</title><text>b</text></svg> here.</p></article>": ["We have x=2 and ab here."],
    f'<div class="content has-sidebar"><div class="post"><h1>Title</h1><p>{LINE}</p></div><div class="sidebar"><p>Buy our things now, they are good.</p></div></div>': ["Title", LINE],
    f"<div>{LINKS}</div><div><h1>Title</h1><p>{LINE}</p><p>No</p><p>{LINE}</p></div><div><a href=c>Imprint</a></div>": ["Title", LINE, "No", LINE],
    f'<article><h1>Title</h1><p>Tiny one.</p></article><div id="comments"><div class="comment"><p>{LINE * 4}</p></div></div>': ["Title", "Tiny one."],
    f'<article><h1>Title</h1><ul>{"<li>thing</li>" * 30}</ul><ul>{"<li><a href=q>Other story</a></li>" * 8}</ul><aside><p>{LINE}</p></aside><p><a href=x>Download all of it</a></p></article>': ["Title", *["thing"] * 30, "Download all of it"],
}


def test_whole_articles_and_nothing_else():
    for page, lines in WHOLE.items():
        assert extract.main_text(f"<html><body>{page}</body></html>").split("\n") == lines


def alone(page):
    """The text by the blocks' and elements' own odds, without any edge."""
    elements, blocks = extract.parsed(page)
    return "\n".join(b.text for b in blocks if b.odds + elements[b.element].odds >= 0)


def test_the_cut_decides():
    flips = [0, 0]
    for page, lines in WHOLE.items():
        for block in extract.labelled(page):
            flips[block.content] += block.content != (block.odds >= 0)
    assert min(flips) > 3  # to boilerplate, to content
    assert sum(alone(page).split("\n") == lines for page, lines in WHOLE.items()) < len(WHOLE) / 2


def test_given_pages_are_their_articles(spark, sf):
    pages = table(spark, sf, "pages").collect()
    flips = 0
    for row in pages:
        inside = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        parts = re.split(r"<[^>]*>", re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", inside))
        want = [" ".join(html.unescape(x).split()) for x in parts]
        assert extract.main_text(row["html"]) == "\n".join(filter(None, want))
        flips += sum(b.content != (b.odds >= 0) for b in extract.labelled(row["html"]))
    assert flips > len(pages) / 2


def test_large_pages():
    parts = "".join(f"<p>{LINE}</p><p>No {i}</p>" for i in range(2000))
    assert extract.main_text(f"<nav>{LINKS * 50}</nav><div>{parts}</div>").count("\n") == 3999
    assert extract.main_text("<div>" * 5000 + LINE) == LINE


def test_report(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars").repartition(3)
    got = extract.page_report(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == sorted((r[0] or 0, len(extract.main_text(r[2]))) for r in rows)
    assert extract.page_report(pages.limit(0)).count() == 0


SPACELESS = {
    "<nav><a href='/'>首页</a> <a href='/n'>新闻</a></nav><div><h1>标题</h1><p>今年春天，城里的老图书馆在修缮三年之后重新开放，第一天就有两千多名读者走进大门。</p><p>馆长说，最难的不是搬书，而是让旧书架重新站稳。</p></div><footer><a href='/c'>联系我们</a> 版权所有</footer>": [
        "标题", "今年春天，城里的老图书馆在修缮三年之后重新开放，第一天就有两千多名读者走进大门。", "馆长说，最难的不是搬书，而是让旧书架重新站稳。"],
    "<nav><a href='/'>ホーム</a> <a href='/n'>ニュース</a></nav><div><h1>古い図書館</h1><p>町の古い図書館が三年の改修を終えて、この春ふたたび開館した。初日には二千人をこえる人が訪れた。</p><p>館長は「本を運ぶより、棚を立て直すほうが難しかった」と話した。</p></div><footer><a href='/c'>お問い合わせ</a></footer>": [
        "古い図書館", "町の古い図書館が三年の改修を終えて、この春ふたたび開館した。初日には二千人をこえる人が訪れた。", "館長は「本を運ぶより、棚を立て直すほうが難しかった」と話した。"],
}


def test_scripts_without_spaces():
    for page, lines in SPACELESS.items():
        assert extract.main_text(f"<html><body>{page}</body></html>").split("\n") == lines
