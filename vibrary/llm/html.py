"""Main text of web pages.

A page becomes a flat list of text blocks. Each block has its word count and link density, those of the block
before and after it, and whether the elements around it are of a kind or name that holds page furniture or an
article. A decision tree over these eight numbers, trained on the blocks of the labelled pages below, tells
article text from the rest. Some of these pages are written out; most are put together by rule from kinds of blocks, with
names that tell what a block is, with some of them, or with none, so that the tree must go by words and links.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: Attributes end at a "<" outside quotes, as where a tag was not closed; such a tag ends at the next ">". So no place is read again from many others.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|svg|math|iframe|noscript|head|title|select|textarea|button|object)\b[^>]*>"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>"
    r"|<(?P<closes>/)?(?P<broken>[a-zA-Z][a-zA-Z0-9]*)[^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
#: Elements without text of their own, up to their end tag. Those that are not closed lose their tag only, but for these:
TO_THE_END = frozenset("script style template textarea".split())
#: A second start tag of these says that the first is not closed.
FLAT = frozenset("iframe noscript select button".split())
RAW_END = {k: re.compile(rf"</{k}\s*>" + (rf"|<{k}\b" if k in FLAT else ""), re.I) for k in (*TO_THE_END, *FLAT, "svg", "math", "title", "object")}
#: What can stand in a head; any other tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold blocks; what they say of their content counts until they end.
HOLDERS = frozenset("address article aside body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
FURNITURE_KINDS = frozenset("aside dialog footer form header menu nav fieldset".split())
ARTICLE_KINDS = frozenset("article main".split())
FURNITURE = re.compile(
    r"(?:^|[\s_\"'=-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disqus|footer|form|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation"
    r"|newsletter|notices?|pagination|popup|promo|promoted|related|replies|respond|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|tags|toolbar|warning|widget)(?=$|[\s_\"'0-9-])",
    re.I,
)
ARTICLE = re.compile(r"(?:^|[\s_\"'=-])(?:article|articlebody|blogpost|content|entry|main|post|story|text)(?=$|[\s_\"'-])", re.I)
NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


def blocks(html: str | None) -> list[tuple[str, float, int, int]]:
    """Text, link density, furniture around (0/1), article around (0/1) of each block that has text, in page order."""
    found: list[tuple[str, float, int, int]] = []
    around: list[tuple[str, int, int]] = []  # kind of holder; furniture and article so far
    open_kinds: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link = False

    def end_block() -> None:
        words = "".join(parts).split()
        if words:
            _, furniture, article = around[-1] if around else ("", 0, 0)
            found.append((" ".join(words), len("".join(linked).split()) / len(words), furniture, article))
        parts.clear()
        linked.clear()

    def text(raw: str) -> None:
        if raw:
            raw = unescape(raw)
            parts.append(raw)
            if in_link:
                linked.append(raw)

    def after_raw(kind: str, tag: str) -> int | None:
        """Where the element ends whose start tag ends at at; None if it is not closed."""
        if kind in ("svg", "math") and tag.endswith("/>"):
            return at
        if kind not in open_ended:
            end = RAW_END[kind].search(html, at)
            if end and end[0].startswith("</"):
                return end.end()
            if not end:
                open_ended.add(kind)  # nor is any later one
        return len(html) if kind in TO_THE_END else None

    html = html or ""
    at, last = 0, html.rfind(">") + 1  # behind it nothing is a tag but an open comment
    in_head = False
    open_ended: set[str] = set()
    while at < last and (m := TOKEN.search(html, at, last)):
        before = html[at : m.start()]
        in_head = in_head and not before.strip()
        if not in_head:
            text(before)
        at = len(html) if m[0].startswith("<!--") and not m[0].endswith("-->") else m.end()
        raw, name = (m["raw"] or "").lower(), (m["name"] or m["broken"] or "").lower()
        close = m["close"] or m["closes"]
        if raw == "head":
            end_block()
            in_head = True
            continue
        in_head = in_head and (raw or name or "meta") in IN_HEAD
        if raw and (raw != "title" or in_head):
            end = after_raw(raw, m[0])
            if end is not None:
                at = end
                continue
        name = name or raw
        if in_head or not name:
            continue
        if name in INLINE:
            if name == "a":
                in_link = not close
                if linked and in_link:
                    linked.append(" ")
            continue
        end_block()
        in_link = False
        if name not in HOLDERS:
            continue
        if close:
            while open_kinds[name]:
                ended = around.pop()[0]
                open_kinds[ended] -= 1
                if ended == name:
                    break
        else:
            _, furniture, article = around[-1] if around else ("", 0, 0)
            names = " ".join(x.strip("\"'") for x in NAMED.findall(m["attrs"] or "")) if name != "body" else ""
            named_article = bool(ARTICLE.search(names)) or name in ARTICLE_KINDS
            holds = name in FURNITURE_KINDS and not (name == "header" and article) or bool(FURNITURE.search(names)) and name not in ARTICLE_KINDS
            open_kinds[name] += 1
            around.append((name, int(furniture or holds), int(article or named_article and not holds)))
    rest = html[at:].partition("<!--")[0] if at >= last else html[at:last] + html[last:].partition("<!--")[0]
    text(rest)
    end_block()
    return found


def features(found: list[tuple[str, float, int, int]]) -> list[list[float]]:
    """Words and link density of the block before, the block and the block after; furniture and article around."""
    own = [(float(min(len(t.split()), 1000)), d) for t, d, _, _ in found]
    near = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [[*near[i], *near[i + 1], *near[i + 2], float(f[2]), float(f[3])] for i, f in enumerate(found)]


#: Pages, and for each of their blocks whether it is article text (1) or not (0).
LABELLED = (
    ("<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></nav><div class=ad>Buy our fine new shoes today and save.</div>"
     "<article><h1>Rain ends a long dry summer</h1><p>After nine weeks without a drop, rain fell on the valley last night and farmers could rest at last.</p><p>Good.</p>"
     "<p>The river rose by a hand, said <a href=/k>the keeper</a> of the lock, and more is to come.</p></article><footer>&copy; 2020 Valley News. All rights reserved.</footer></body>", "000011110"),
    ("<body><article><h1>One</h1><p>Two.</p><p>Three words here.</p></article><footer>&copy; a.example</footer></body>", "1110"),
    ("<body><header><h1>The Daily Page</h1><p>News since 1890</p></header><main><h2>Bread prices</h2><p>Bread costs more than it did a year ago, and bakers blame the price of flour and of gas.</p>"
     "<aside><h3>Read more</h3><a href=/1>Ten kinds of bread</a></aside><p>They hope for a better harvest.</p><ul><li>Rye: 3.20<li>Wheat: 2.90</ul></main>"
     "<section id=comments><h3>Comments</h3><p>Anna: I bake my own bread now and so should everybody who has the time for it, really.</p><p>Bo: Same here.</p></section></body>", "001100111000"),
    ("<body><div id=menu><a href=/>Start</a> <a href=/a>About</a></div><div class=content><p>A plain page without an article element, whose text sits in a division named content.</p>"
     "<p>It has a second paragraph.</p><form><p>Your name</p><p>Your mail, which we will never give to anybody else</p></form></div><div class=sidebar><p>This week we look at gardens and what grows there.</p></div></body>", "011000"),
    ("<body><div class='cookie-notice'>We use cookies to make this site better for you. By going on you accept them all.</div><article><header><h1>Bees</h1><p>By Kim</p></header>"
     "<p>Bees sleep at night.</p><div class='related-posts'><a href=/w>Wasps</a><a href=/h>Hornets do not sleep</a></div><p>Some sleep in flowers, holding each other by the feet, until the sun is up.</p></article></body>", "011101"),
    ("<body><div class=wrap><p><a href=/1>First</a> | <a href=/2>Second</a> | <a href=/3>Third</a></p><p>This text stands in a page with no hints at all, yet it is long, it has no links and it reads like prose, so it is what the page is about.</p>"
     "<p>The next paragraph is much the same: a run of words in sentences, long enough to tell it from the labels and the slogans that stand around it.</p><p><a href=/t>Top</a></p><p>Contact us</p></div></body>", "01100"),
    ("<body><div class=post><h2>On <a href=/c>cats</a></h2><p><a href=/p>Cats</a> and <a href=/d>dogs</a>.</p><p>Yes.</p></div><div class=widget>Most read this month: the old mill and its last miller</div><div class='footer'>Imprint and terms of use of this site</div></body>", "11100"),
    ("<body><nav>Menu</nav><div class=banner>Half price until Sunday, only in our shop near the bridge, so hurry and bring your friends along to it</div><article><p>Short.</p></article><aside>Sponsored: a long talk about money with people who have a lot of it and want some more</aside></body>", "0010"),
)


def said(r: random.Random, least: int, most: int, links: int = 0) -> str:
    """Words, so many of them from the start linked."""
    words = ["".join(r.choices("aeioustrnlmd", k=r.randint(2, 9))) for _ in range(r.randint(least, most))]
    return (f"<a href=/x>{' '.join(words[:links])}</a> " if links else "") + " ".join(words[links:])


def made_page(r: random.Random) -> tuple[str, str]:
    """A page put together from kinds of blocks, and its blocks' labels."""
    names = r.choice(("all", "all", "furniture", "article", "none"))
    labels: list[int] = []

    def block(tag: str, text: str, label: int) -> str:
        labels.append(label)
        return f"<{tag}>{text}</{tag}>"

    def held(tag: str, name: str, kind: str, body: str) -> str:
        return f"<{tag} class={name}>{body}</{tag}>" if names in ("all", kind) else f"<div class=c{r.randint(1, 99)}>{body}</div>"

    def links(name: str, least: int, most: int) -> str:
        return held(r.choice(("nav", "div")), name, "furniture", "<ul>" + "".join(block("li", said(r, k, k, k), 0) for k in (r.randint(1, 5) for _ in range(r.randint(least, most)))) + "</ul>")

    def aside(name: str, least: int, most: int, most_words: int) -> str:
        return held("div", name, "furniture", "".join(block("p", said(r, 3, most_words), 0) for _ in range(r.randint(least, most))))

    hinted = names in ("all", "furniture")  # without names, only what words and links can tell stands beside the article
    head = links("menu", 3, 8)
    if hinted and r.random() < 0.5:
        head += aside("cookie-notice", 1, 1, 25)
    body = block("h1", said(r, 2, 9), 1)
    if hinted and r.random() < 0.5:
        head += body
        labels[-1], body = 0, ""  # the site's name stands before the article
        head = held("header", "header", "furniture", head)
        body = block("h2", said(r, 2, 9), 1)
    for _ in range(r.randint(2, 6)):
        n = r.random()
        if n < 0.6:
            body += block("p", said(r, 12, 90, r.choice((0, 0, 0, 1, 2))), 1)
        elif n < 0.75 and names in ("all", "article"):
            body += block("p", said(r, 3, 6, r.choice((0, 0, 1, 2))) if r.random() < 0.8 else said(r, 1, 3), 1)
        elif n < 0.85:
            body += block("blockquote", said(r, 12, 40), 1)
        elif names in ("all", "article"):
            body += "<ul>" + "".join(block("li", said(r, 3, 12), 1) for _ in range(r.randint(2, 4))) + "</ul>"
        if hinted and r.random() < 0.15:
            body += aside(r.choice(("ad", "related", "newsletter")), 1, 2, 30)
        elif r.random() < 0.1:
            body += block("p", said(r, 3, 8, 8), 0) if not hinted else links("related", 1, 3)
    foot = ""
    if hinted:
        for name, least, most, most_words in (("comments", 2, 5, 60), ("sidebar", 1, 3, 30)):
            if r.random() < 0.5:
                foot += aside(name, least, most, most_words)
    if r.random() < 0.7:  # else the page is cut off
        foot += links("footer", 1, 5) + held("footer", "footer", "furniture", block("p", said(r, 2, 9), 0))
    return f"<body>{head}{held('article', 'content', 'article', body)}{foot}</body>", "".join(map(str, labels))


def labelled_pages(made: int = 300, seed: int = 7) -> list[tuple[str, str]]:
    """The labelled table: the pages written out above and so many that are put together."""
    r = random.Random(seed)
    return [*LABELLED, *(made_page(r) for _ in range(made))]


def labelled_rows() -> list[tuple[list[float], int]]:
    rows = []
    for page, labels in labelled_pages():
        found = features(blocks(page))
        assert len(found) == len(labels), (len(found), labels, blocks(page))
        rows += [(x, int(y)) for x, y in zip(found, labels, strict=True)]
    return rows


def train_tree(spark: SparkSession, depth: int = 8) -> tuple:
    """A decision tree as nested tuples (feature, threshold, left, right), a leaf as 0 or 1."""
    table = spark.createDataFrame([(Vectors.dense(x), float(y)) for x, y in labelled_rows()], ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=2, seed=1).fit(table)

    def nested(node) -> tuple | int:  # noqa: ANN001
        if node.subtreeDepth() == 0:
            return int(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), nested(node.leftChild()), nested(node.rightChild())

    return nested(model._call_java("rootNode"))


def is_article(tree: tuple | int, x: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def main_text(html: str | None, tree: tuple | int) -> str:
    found = blocks(html)
    return " ".join(b[0] for b, x in zip(found, features(found), strict=True) if is_article(tree, x))


def extract(pages: DataFrame, tree: tuple | int) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    A null or empty html has the empty text, as has a page without article text. Repeated rows and null ids
    or urls get rows of their own, other columns are left out, an empty table gives an empty result. Pages are
    read whole; a cut-off page ends its open elements.
    """

    def make(rows: dict) -> dict:
        texts = [main_text(h, tree) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), make, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train_tree(spark))
