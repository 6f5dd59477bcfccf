"""Main text of web pages by minimum-cut labelling.

A page is a tree of elements with blocks of text in it. A classifier gives blocks (by their text) and elements (by tag and words of class, id and
role, for each block inside) the costs of calling them content and of calling them boilerplate: the capacities of their edges to the two
terminals. A block is tied to its element, an element to the one around it, and a block to the next one by edges that cost if their labels differ,
so whatever an element says reaches its blocks through the cut only, up to the capacity on the way: a
block that stands out keeps its own label, and one that does not takes its surroundings'. A minimum cut is the cheapest
labelling; the blocks on the content side, in page order, are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not shown as text, up to their end tag (a title is text inside a drawing).
RAW = frozenset(["script", "style", "noscript", "template", "iframe", "object", "canvas", "audio", "video", "title", "textarea", "annotation", "annotation-xml"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
#: Elements that run inside a block; all others part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mspace mstyle semantics svg g text tspan path title desc".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
BODY = frozenset(["article", "main"])

#: Log-odds of content that a tag gives for each block inside its element.
TAGS = {"article": 2.8, "main": 2.8, "nav": -3.0, "aside": -3.0, "footer": -3.0, "header": -2.5, "head": -3.0, "menu": -3.0, "dialog": -3.0, "form": -2.8, "fieldset": -2.8, "button": -2.8, "select": -2.8}
#: Log-odds that words of class, id and role attributes give; of several the least counts.
WORDS = (
    (-4.0, "comment comments commentlist disqus replies respond responses"),
    (-3.0, "ad ads adv advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs byline complementary consent contentinfo cookie cookies copyright dialog disclaimer"),
    (-3.0, "footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promotion recommended reply share sharing"),
    (-3.0, "sidebar signup social sponsor sponsored subscribe subscription tags toc toolbar topbar"),
    (-1.5, "header hidden search"),
    (-1.0, "discussion related"),
    (1.5, "article body content entry main post story text"),
)
WORD_ODDS = {word: odds for odds, words in reversed(WORDS) for word in words.split()}
#: From here on words or tags name something that is no part of an article even if it stands in one.
FOREIGN = -2.0
#: Reader comments: no share of a page's text makes them its article.
COMMENTS = -4.0
#: A form, sidebar or the like that holds so much of a page's plain text is a wrapper round the page.
WRAPPER_SHARE = 0.6

#: A comment or declaration; a tag; a tag with a quote that does not end, or that the next one or the page's end cuts off. Loops never give back
#: what they took, so a broken page is read in one pass.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/><]*+)((?:[^><\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/><]*+)([^><]*+)(?:>|(?=<)|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME = re.compile(r"[a-z]+")
NO_SPACE = re.compile(r"\S")

#: Log-odds that a block is content by its text: to begin with, by length, closing sign, shares of linked letters and of odd signs, few words, tag.
BIAS, LENGTH, STOP, LINKED, ODD, FEW, PARAGRAPH, HEADING, ITEM, COPYRIGHT = -0.6, 0.55, 0.5, -1.6, -1.0, -0.3, 0.3, 0.4, -0.1, -1.5
#: Letters of scripts that are written without spaces; one says about as much as so many Latin ones. Kana, Han, Hangul and full-width forms; Thai to Khmer.
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003134f]")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003134f]")
LETTERS_OF_WIDE = 3
#: Signs that close a sentence, in several scripts.
CLOSING = ".!?:\"'»”…。！？：」』）．؟۔।॥"
ODD_SIGN = re.compile(r"[^\w\s.,;:!?'\"()’”“»«、。，；：！？「」『』（）《》・·؟۔।॥-]")
#: What a page without markup has for each block.
PLAIN = 1.0
#: Costs of different labels: of a block and its element; of an element and the one around it, for each block inside, if they are parts of one
#: text, and if the one around may well hold different things; of two blocks in a row.
TO_ELEMENT, TO_PARENT, TO_PLACE, TO_NEXT = 2.4, 1.6, 0.25, 0.2
#: Elements that hold the parts of one text; so do all inside an article that are not foreign to it.
LEAVES = HEADINGS | frozenset(["p", "li", "dt", "dd", "td", "th", "pre", "caption", "figcaption"])  # with one block they are that block
TEXT_PARTS = frozenset(["p", "ul", "ol", "dl", "li", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "blockquote", "pre", "figure", "section", "hgroup"])


@dataclass
class Element:
    tag: str
    parent: int
    odds: float  # what its tag and words say
    blocks: int = 0  # inside, at any depth
    branches: int = 0  # blocks and elements with blocks right below
    letters: int = 0  # not linked, inside
    body: bool = False  # whether an article or main element is inside
    joined: bool = False  # whether it and the element around are parts of one text


@dataclass
class Block:
    text: str
    element: int
    odds: float
    letters: int  # not linked
    content: bool = False


def shown(attributes: str) -> bool:
    """Whether an element with these attributes is shown."""
    for found in ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), (found[2] or "").strip("\"'").lower()
        if name == "hidden" and not found[2] or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return False
    return True


def odds_of(tag: str, attributes: str) -> float:
    """What a tag and the words of its class, id and role say of each block inside."""
    words: set[str] = set()
    for found in ATTRIBUTE.finditer(attributes) if attributes and tag not in ("html", "body") else ():
        if found[1].lower() in ("class", "id", "role"):
            words.update(NAME.findall((found[2] or "").lower()))
    said = [WORD_ODDS[w] for w in words if w in WORD_ODDS]
    by_words = min(said, default=0.0)
    by_tag = TAGS.get(tag, 0.0)
    return min(by_words, by_tag) if min(by_words, by_tag) < 0 else max(by_words, by_tag)


def text_odds(text: str, tag: str, link_share: float) -> float:
    wide = 0 if text.isascii() else len(WIDE.findall(text))
    z = BIAS + LENGTH * min(math.log1p((len(text) + (LETTERS_OF_WIDE - 1) * wide) / 20), 3.5) + LINKED * link_share + ODD * len(ODD_SIGN.findall(text)) / len(text)
    if text[-1] in CLOSING:
        z += STOP
    elif text.count(" ") < 2 and (text.isascii() or len(UNSPACED.findall(text)) < 8):
        z += FEW
    if tag in HEADINGS:
        z += HEADING
        z += HEADING * (tag == "h1")
    elif tag == "p":
        z += PARAGRAPH
    elif tag in ("li", "td", "th", "dt", "dd"):
        z += ITEM
    if text[0] == "©" or text[:9].lower() == "copyright":
        z += COPYRIGHT
    return z


def parsed(page: str) -> tuple[list[Element], list[Block]]:
    """The elements of a page, each after the one around it (the page itself first), and its blocks in order."""
    elements, blocks = [Element("", 0, 0.0)], []
    stack: list[tuple[str, int]] = [("", 0)]  # tag, number of the nearest parting element
    texts: list[str] = []
    letters = linked = links = drawing = 0

    def close() -> None:
        nonlocal letters, linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                number = stack[-1][1]
                blocks.append(Block(text, number, text_odds(text, elements[number].tag, linked / max(1, letters)), letters - linked))
            texts.clear()
        letters = linked = 0

    def say(raw: str) -> None:
        nonlocal letters, linked
        text = html.unescape(raw) if "&" in raw else raw
        if texts or NO_SPACE.search(text):
            texts.append(text)
            n = len(text)
            letters += n
            linked += n if links else 0

    at, end = 0, len(page)
    while at < end:
        tag = TAG.search(page, at)
        if not tag:
            say(page[at:])
            break
        if tag.start() > at:
            say(page[at : tag.start()])
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name not in INLINE:
                close()
            if name == "a" and links:
                links -= 1
            if name == "svg" and drawing:
                drawing -= 1
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    if stack[-1][1] != stack[depth - 1][1]:
                        close()
                    del stack[depth:]
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break  # an inline end tag does not close a block
            continue
        hidden = bool(attributes) and name not in VOID and name not in ("html", "body") and not attributes.endswith("/") and not shown(attributes)
        if name in RAW and not (name == "title" and drawing):
            ended = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = ended.end() if ended else end
            continue
        if name not in INLINE:
            close()
        if name in VOID or attributes.endswith("/"):
            continue
        odds = odds_of(name, attributes)
        parts = name not in INLINE or odds <= FOREIGN or hidden
        if parts and name in INLINE:
            close()
        links += name == "a"
        drawing += name == "svg"
        if name == "p":  # a paragraph ends where the next begins
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    del stack[depth:]
                    break
                if stack[depth][0] not in INLINE:
                    break
        if parts:
            around = stack[-1][1]
            elements.append(Element(name, around, -math.inf if hidden or elements[around].odds == -math.inf else odds))
        stack.append((name, len(elements) - 1 if parts else stack[-1][1]))
    close()
    return elements, [b for b in blocks if elements[b.element].odds != -math.inf]


def weighed(elements: list[Element], blocks: list[Block]) -> None:
    """Counts what is inside each element, and takes back the odds of those that stand round the article or, as articles, in foreign parts."""
    for b in blocks:
        own = elements[b.element]
        own.blocks += 1
        own.branches += 1
        own.letters += b.letters
    for k in range(len(elements) - 1, 0, -1):
        e = elements[k]
        around = elements[e.parent]
        around.blocks += e.blocks
        around.branches += e.blocks > 0
        around.letters += e.letters
        around.body |= e.body or e.blocks > 0 and e.tag in BODY and e.odds > 0
    page = elements[0]
    page.odds = PLAIN if len(elements) == 1 else 0.0
    inside, foreign = [False] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        wraps = e.body or not page.body and e.odds > COMMENTS and e.letters > WRAPPER_SHARE * page.letters
        if e.odds < 0 and wraps or e.tag == "header" and inside[e.parent] and e.odds == TAGS["header"]:
            e.odds = 0.0
        if e.odds > 0 and foreign[e.parent]:
            e.odds = 0.0
        e.joined = FOREIGN < e.odds <= 0 and (inside[e.parent] or e.tag in TEXT_PARTS)
        inside[k] = inside[e.parent] or e.odds > 0
        foreign[k] = foreign[e.parent] or e.odds <= FOREIGN


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the costs of blocks against their scores and of edges with two labels.

    A block whose score outweighs all its edges keeps its sign in a minimum cut; it is settled first and
    its edges become scores of its neighbours. Among the others the maximum flow is found by blocking flows.
    """
    n = len(scores)
    z, near = list(scores), [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(z[i]) >= sum(near[i].values()):
            label[i] = z[i] >= 0
            for j, w in near[i].items():
                z[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, flow_sides([z[i] for i in rest], rest, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def flow_sides(z: list[float], nodes: list[int], near: list[dict[int, float]]) -> list[bool]:
    """True for each node on the source's side of a minimum cut."""
    number = {x: k for k, x in enumerate(nodes)}
    n = len(nodes)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [{number[j]: w for j, w in near[x].items()} for x in nodes] + [{}, {}]
    for k, score in enumerate(z):
        if score > 0:
            room[source][k], room[k][source] = score, 0.0
        else:
            room[k][sink], room[sink][k] = -score, 0.0
    while True:
        level = {source: 0}
        line = deque([source])
        while line:
            u = line.popleft()
            for v, c in room[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    line.append(v)
        if sink not in level:
            return [k in level for k in range(n)]
        ways = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                steps = list(zip(path, path[1:], strict=False))
                least = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= least
                    room[b][a] = room[b].get(a, 0.0) + least
                cut = next(k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-12)
                del path[cut + 1 :]
                continue
            for v in ways[u]:
                if level.get(v) == level[u] + 1 and room[u].get(v, 0.0) > 1e-12:
                    path.append(v)
                    break
            else:
                path.pop()
                level[u] = -1  # no way on from here in this round


def graph(elements: list[Element], blocks: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Scores and edges of the cut: the blocks first, then the elements that say something or hold more than one thing. What hangs in
    others is tied to the node above by the least tie on the way."""
    scores, edges, node, tie = [b.odds for b in blocks], [], [-1] * len(elements), [TO_ELEMENT] * len(elements)
    for k, e in enumerate(elements):
        up = node[e.parent] if k else -1
        way = min(TO_PARENT if e.joined else TO_PLACE, tie[e.parent])
        if not e.blocks or not e.odds and e.branches < 2:
            node[k], tie[k] = up, tie[e.parent] if e.tag in LEAVES else way
            continue
        node[k] = len(scores)
        scores.append(e.odds * e.blocks)
        if up >= 0:
            edges.append((up, node[k], way * e.blocks))
    for i, b in enumerate(blocks):
        if node[b.element] >= 0:
            edges.append((node[b.element], i, tie[b.element]))
        if i:
            edges.append((i - 1, i, TO_NEXT))
    return scores, edges


def labelled(page: str | None) -> list[Block]:
    """The blocks of a page with their labels."""
    if not page:
        return []
    elements, blocks = parsed(page)
    weighed(elements, blocks)
    for block, content in zip(blocks, minimum_cut(*graph(elements, blocks)), strict=False):
        block.content = content
    return blocks


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in labelled(page) if b.content)


def with_main_text(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page as column ``out``: content blocks in page order, joined by a line feed.

    Character references are decoded, white space in a block becomes one space. Null, empty and textless pages give an empty text;
    broken markup is read as far as it goes, very long pages whole; repeated rows give the same; an empty table stays empty; other columns pass
    through (one named ``out`` is replaced). No shuffle.
    """

    @F.arrow_udf("string")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py()) for x in batch], pa.string())

    return pages.withColumn(out, read(F.col(page)))


def page_report(pages: DataFrame) -> DataFrame:
    """For each row: page_id, url, text, n_chars."""
    return with_main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
