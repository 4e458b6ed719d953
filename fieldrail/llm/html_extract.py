"""Main text of HTML pages: a conditional random field over leaf blocks, decoded by Viterbi.

Labelled pages.  Pages whose markup names one article label themselves: blocks in it are its text, but for those
that stand in menus, forms or comments inside it.  A bounded sample of them (``Bound``) is learned from, each as it
is and in ``Bound.layouts`` other layouts: the same blocks under other elements and names, with headers, menus, notices,
adverts, sidebars, forms, comments and footers made from the sample's own words.  So the field doesn't
depend on the one element that labels came from.

Every block of every page is then labelled from the features of its ancestors, its own text and its neighbours.
Pages stay where they are: no shuffle, and one page is held at a time.

Defined results: null or empty HTML has the text ''; a null url stays null; repeated rows are extracted each; a
table without self-labelled pages gives a field without weights, which keeps all blocks; white space is what
Unicode takes for it; a tag that is cut off at the end of a page is no text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_hashes
from .crf import Field, fit, viterbi
from .dom_blocks import BITS, Block, Node, blocks, root, text_features

#: Features of paths that are kept by a worker before it starts anew.
PATHS = 1 << 14


@dataclass(frozen=True)
class Bound:
    """How many pages a field is fitted on, of at most so many bytes each; other layouts of each."""

    pages: int = 160
    page_bytes: int = 24_000
    layouts: int = 4


#: Elements and names inside an article that aren't its text.
_ASIDE = frozenset("nav aside footer form menu dialog search".split())
_ARTICLE = re.compile(r"<article(?=[\s/>])", re.I)
_CONTENT = "content post entry-content article-body story main-content post-content text page-content articleBody blog-post body-copy".split()
_ADS = "ad ads advert advertisement banner sponsored promo ad-slot adbox".split()
_NOTICES = "cookie-notice cookie-banner notice alert consent gdpr popup newsletter subscribe message".split()
_SIDES = "sidebar widget related widget-area recommended more-stories trending tags".split()
_COMMENTS = "comments comment-list responses disqus reader-comments discussion".split()
_FOOTS = "footer site-footer copyright legal bottom".split()
_HEADS = "header site-header masthead top branding".split()
_MENUS = "menu nav navbar navigation breadcrumbs main-menu toolbar".split()


def own_labels(found: list[Block], page: str) -> list[int] | None:
    """Labels that the page's own markup gives its blocks; None if it doesn't name one article with text and something beside it."""
    if len(_ARTICLE.findall(page)) != 1:
        return None
    out = []
    for block in found:
        inner, node = [], block.node
        while node is not None and node.tag != "article":
            inner.append(node.tag)
            node = node.parent
        out.append(int(node is not None and not _ASIDE & set(inner)))
    return out if 0 < sum(out) < len(out) else None


def layout(r: random.Random, title: str, text: list[tuple[str, str]], other: list[str], strange: list[str]) -> str:
    """A page with (tag, text) blocks as its article, and the rest made from other blocks and strange paragraphs.

    ``data-main`` marks what is text; features don't read it.
    """
    few = lambda a, b: [r.choice(other) for _ in range(r.randint(a, b))] if other else []
    e = html.escape

    def box(names: list[str], inner: str, tags: tuple[str, ...] = ("div",), attribute: str = "") -> str:
        tag = r.choice(tags)
        name = r.choice(names)
        named = f' {r.choice(["class", "class", "id"])}="{name}"' if tag == "div" or r.random() < 0.4 else ""
        return f"<{tag}{named}{attribute}>{inner}</{tag}>"

    def menu() -> str:
        items = "".join(f'<li><a href="#">{e(x[:40])}</a></li>' for x in few(2, 8))
        return box(_MENUS, f"<ul>{items}</ul>", ("nav", "div", "div"))

    def advert() -> str:
        return box(_ADS, "".join(f"<p>{e(x)}</p>" if r.random() < 0.5 else e(x) for x in few(1, 2) or ["ad"]), ("div", "div", "aside"), ' data-main="0"')

    def comments() -> str:
        tag = r.choice(("div", "div", "li", "article"))
        each = "".join(f'<{tag} class="comment"><{r.choice(["p", "div"])} class="{r.choice(["author", "meta", "byline"])}">{e(" ".join(x.split()[:2]))}</p><p>{e(x)}</p></{tag}>' for x in (r.choice(strange or ["no"]) for _ in range(r.randint(1, 4))))
        return box(_COMMENTS, f"<h3>{r.choice(['Comments', 'Responses', 'Discussion', e((few(1, 1) or ['Comments'])[0][:20])])}</h3>{each}", ("div", "section"), ' data-main="0"')

    def form() -> str:
        return f'<form data-main="0"><label>{e((few(1, 1) or ["Name"])[0][:20])}</label><input><p>{r.choice(["Subscribe", "Search", "Send", "Leave a reply", "Log in"])}</p><button>OK</button></form>'

    def side() -> str:
        inner = "".join(f'<li><a href="#">{e(x[:60])}</a></li>' for x in few(1, 5))
        told = f"<p>{e(r.choice(strange))}</p>" if strange and r.random() < 0.4 else ""
        return box(_SIDES, f"<h3>{e((few(1, 1) or ['More'])[0][:30])}</h3><ul>{inner}</ul>{told}", ("aside", "div", "div", "section"), ' data-main="0"')

    def notice() -> str:
        said = r.choice(["We use cookies to improve this site.", "Please accept our terms.", "Sign up for our newsletter!", *(x[:90] for x in few(1, 2))])
        return box(_NOTICES, f"<p>{e(said)}</p><button>OK</button>", ("div", "div", "section", "dialog"), ' data-main="0"')

    inner, often = [], r.choice((0, 0.05, 0.2))
    for k, (tag, x) in enumerate(text):
        if 0 < k and r.random() < often:
            inner.append(r.choice((advert, side, form, notice))())
        tag = tag if tag in ("h1", "h2", "h3") else r.choices((tag, "p", "div", "blockquote", "li", "h2"), (12, 6, 1, 1, 1, 0.3))[0]
        said = e(x)
        if r.random() < 0.1 and " " in x:
            a, b = x.split(" ", 1)
            said = f'<a href="#">{e(a)}</a> {e(b)}'
        inner.append(f"<ul><li>{said}</li></ul>" if tag == "li" else f"<{tag}>{said}</{tag}>")
    late = "".join(f() for f in (comments, form, side) if r.random() < 0.4)
    inside = late if r.random() < 0.5 else ""
    how = r.random()
    body = "".join(inner) + inside
    if how < 0.25:
        body = f'<article data-main="1">{body}</article>'
    elif how < 0.4:
        body = f'<main data-main="1">{body}</main>'
    elif how < 0.9:
        body = box(_CONTENT, body, ("div", "div", "section", "td" if r.random() < 0.2 else "div"), ' data-main="1"')
    else:
        body = f'<div data-main="1">{body}</div>'
    if r.random() < 0.3:
        body = f'<div class="{r.choice(["wrapper", "container", "page", "row", "layout"])}">{body}{side() if r.random() < 0.4 else ""}</div>'
    head = "".join(f() for f in (lambda: box(_HEADS, f"<p>{e((few(1, 1) or ['Site'])[0][:40])}</p>" + (menu() if r.random() < 0.5 else ""), ("header", "div")), menu, notice, advert) if r.random() < 0.6)
    tail = "".join(f() for f in (lambda: "" if inside else late, side, advert, notice) if r.random() < 0.5)
    foot = box(_FOOTS, "".join(f"<p>{e(x)}</p>" if r.random() < 0.4 else f"&copy; {e(x)}" for x in few(1, 2)), ("footer", "footer", "div")) if r.random() < 0.85 else ""
    return f'<html><head><title>{e(title)}</title></head><body data-main="0">{head}{body}{tail}{foot}</body></html>'


def labelled(pages: list[str], layouts: int) -> tuple[list[list[list[int]]], list[list[int]]]:
    """(features, labels) of self-labelled pages and of their other layouts."""
    held = []
    for page in pages:
        found, title = blocks(page, root())
        own = own_labels(found, page)
        if own:
            held.append((found, title, own))
    sequences, labels = [], []

    def put(found: list[Block], title: str, own: list[int]) -> None:
        if found:
            sequences.append([features + sorted(b.node.inside) + list(b.node.own()) for b, features in zip(found, text_features(found, title))])
            labels.append(own)

    for k, (found, title, own) in enumerate(held):
        put(found, title, own)
        text = [(b.node.tag, b.text) for b, y in zip(found, own) if y]
        other = [b.text for b, y in zip(found, own) if not y]
        strange = [b.text for b, y in zip(*held[k - 1][::2]) if y and len(b.text) > 40]
        for j in range(layouts):
            r = random.Random(1000 * k + j)
            some = text if r.random() < 0.7 else text[: r.randint(1, 4)]
            made, name = blocks(layout(r, title, some, other, strange[:20]), root())
            put(made, name, [b.node.main or 0 for b in made])
    return sequences, labels


def train(pages: DataFrame, bound: Bound = Bound(), id_col: str = "page_id", html_col: str = "html") -> Field:
    """A field of the pages that label themselves, of a sample in the order of hashes of their ids."""
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    named = slim.filter(F.col("id").isNotNull() & (F.octet_length("html") <= bound.page_bytes) & F.col("html").contains("<article"))
    chosen = least_hashes(named.select("id").distinct(), bound.pages)
    few = pages.sparkSession.createDataFrame([(i,) for i in chosen], "id long")
    rows = sorted(named.join(F.broadcast(few), "id").groupBy("id").agg(F.min("html").alias("html")).collect(), key=lambda row: row.id)
    return fit(*labelled([row.html for row in rows], bound.layouts), features=1 << BITS)


class Extractor:
    """A field with what it has worked out of paths; one a task."""

    def __init__(self, field: Field) -> None:
        self.field, self.weight = field, field.weight.tolist()
        self.top, self.nodes = root(), 0

    def _path(self, node: Node) -> float:
        if node.score is None:
            node.score = sum(self.weight[k] for k in node.inside) + sum(self.weight[k] for k in node.own())
            self.nodes += 1
        return node.score

    def labels(self, page: str) -> tuple[list[Block], list[int]]:
        if self.nodes > PATHS:
            self.top, self.nodes = root(), 0
        found, title = blocks(page, self.top)
        weight = self.weight
        return found, viterbi([self._path(b.node) + sum(weight[k] for k in f) for b, f in zip(found, text_features(found, title))], self.field)

    def text(self, page: str) -> str:
        found, own = self.labels(page)
        return "\n\n".join(b.text for b, y in zip(found, own) if y)


def with_main_text(pages: DataFrame, field: Field, name: str = "text", html_col: str = "html") -> DataFrame:
    """pages with a column of their main texts in place of the HTML; all rows and other columns stay."""
    shared = pages.sparkSession.sparkContext.broadcast(field)
    rest = [c for c in pages.columns if c != html_col]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Extractor(shared.value)
        for batch in batches:
            texts = [made.text(page.as_py() or "") for page in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], schema.names)

    return pages.select(*rest, html_col).mapInArrow(run, schema)


def main_texts(pages: DataFrame, bound: Bound = Bound(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) a page."""
    slim = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    made = with_main_text(slim, train(pages, bound, id_col, html_col), "text", html_col)
    return made.withColumn("n_chars", F.length("text").cast("long"))
