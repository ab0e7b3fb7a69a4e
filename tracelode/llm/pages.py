"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags.  Each block has
features of its ancestors (tags, words of class and id), of its text (length, share of
linked text, closing mark, interface words) and of its place.  The field is trained on
labelled pages that ``labelled_pages`` composes from many layouts (no labelled table comes
with the data), and Viterbi decodes a page's blocks together.

Defined cases: null html counts as empty and gives the empty text; malformed markup is
read leniently (unclosed elements end with their parents, stray end tags are ignored);
repeated rows each get a row; an empty table gives an empty result; columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import byte_chunks, texts_of

BITS = 16
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|template|textarea|title|noscript|svg|iframe|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)""", re.DOTALL | re.IGNORECASE)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same group ends when left open.
CLOSED_BY = {"p": None, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Words of interfaces that are no article text.
INTERFACE = frozenset("about accept account ad advertisement archive careers cart close comment comments contact cookie cookies copyright disclaimer download email faq follow help home imprint join less login logout menu more next newsletter password policy prev previous privacy read register related reply reserved rights rss search share sign sitemap skip sponsored submit subscribe terms top trending tweet username".split())
_PLAIN_WORD = re.compile(r"[^\W\d_]+")


class Node:
    """An open element.  It keeps what it adds to its ancestors and not what they have, so that a deep page costs its length."""

    __slots__ = ("block", "fresh_names", "fresh_tag", "names", "parent", "place", "tag")

    def __init__(self, tag: str, names: frozenset[str], parent: Node | None, fresh_tag: bool, fresh_names: tuple[str, ...]):
        self.tag, self.names, self.parent, self.fresh_tag, self.fresh_names = tag, names, parent, fresh_tag, fresh_names
        #: The nearest element that is not inline, this one included.
        self.block: str = tag if tag not in INLINE else parent.block if parent else "body"
        self.place = -1

    def features(self) -> list[str]:
        """Of the element itself, beyond its ancestors'."""
        return [f"in={self.tag}"] * (self.fresh_tag and self.tag not in INLINE) + [f"name={w}" for w in self.fresh_names]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    node: Node | None

    @property
    def tag(self) -> str:
        return self.node.block if self.node else "body"

    def path(self) -> Iterator[Node]:
        """The block's element and its ancestors, innermost first."""
        node = self.node
        while node:
            yield node
            node = node.parent

    @property
    def ancestors(self) -> tuple[str, ...]:
        return tuple(n.tag for n in self.path())[::-1]

    @property
    def names(self) -> frozenset[str]:
        return frozenset(w for n in self.path() for w in n.fresh_names)


def name_words(attributes: str) -> frozenset[str]:
    found = set()
    for a, b, c in _NAMES.findall(attributes):
        found.update(w for w in _SPLIT.split(_CAMEL.sub(" ", a or b or c).lower()) if len(w) > 1)
    return frozenset(found)


def blocks_of(html: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    blocks: list[Block] = []
    stack: list[Node] = []
    # how many open elements have a tag, or a word in their names
    tags: Counter[str] = Counter()
    names: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, text.count(" ") + 1, sum(len(x.split()) for x in linked), stack[-1] if stack else None))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if tags["a"]:
            linked.append(text)

    def push(tag: str, words: frozenset[str]) -> None:
        stack.append(Node(tag, words, stack[-1] if stack else None, not tags[tag], tuple(sorted(w for w in words if not names[w]))))
        tags[tag] += 1
        names.update(words)

    def pop() -> str:
        node = stack.pop()
        tags[node.tag] -= 1
        for w in node.names:
            names[w] -= 1
        return node.tag

    for m in _MARKUP.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m.group(3)
        if not name:
            if m.group(1) and m.group(1).lower() not in ("svg",):
                parts.append(" ")
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if m.group(2):
            # a stray end tag ends nothing
            while tags[name] and pop() != name:
                pass
        elif name not in VOID and not m.group(4).endswith("/"):
            if name not in INLINE:
                ends = {"p", *(CLOSED_BY.get(name) or ())}
                while stack and (stack[-1].tag in INLINE or stack[-1].tag in ends):
                    if stack[-1].tag in INLINE and not any(tags[t] for t in ends):
                        break
                    pop()
            push(name, name_words(m.group(4)) if m.group(4) else frozenset())
    if at < len(html):
        add(html[at:])
    flush()
    return blocks


@lru_cache(maxsize=100_000)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def _grade(value: float, bounds: tuple) -> int:
    return sum(value >= b for b in bounds)


def own_features(blocks: list[Block]) -> list[list[str]]:
    """Features of each block of a page besides those of its ancestors."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        link = _grade(b.linked / max(1, b.words), (0.01, 0.3, 0.7))
        size = _grade(b.words, (2, 5, 10, 25, 75))
        own = ["any", f"tag={b.tag}", f"size={size}", f"link={link}", f"end={b.text[-1] in '.!?…'}", f"size={size}|link={link}", f"place={_grade(i / n, (0.1, 0.9))}", f"mark={any(c in b.text for c in '©®')}"]
        if b.words <= 40:
            own += [f"ui={w}" for w in sorted({x.lower() for x in _PLAIN_WORD.findall(b.text)} & INTERFACE)]
        out.append(own)
    return out


def feature_numbers(blocks: list[Block]) -> list[list[int]]:
    """Feature numbers of each block of a page, as many as it has, in an order that does not depend on the process."""
    return [[_bucket(x) for x in (*own, *sorted(f for node in b.path() for f in node.features()))] for b, own in zip(blocks, own_features(blocks), strict=True)]


def block_scores(weights: np.ndarray, blocks: list[Block]) -> np.ndarray:
    """The summed weights of each block's features.

    Ancestors' sums are told once for each element and handed down, so blocks deep in a page do not walk up it.
    """
    sums: list[float] = []
    out = np.empty(len(blocks))
    for i, (b, own) in enumerate(zip(blocks, own_features(blocks), strict=True)):
        fresh = []
        node = b.node
        while node and node.place < 0:
            fresh.append(node)
            node = node.parent
        for node in reversed(fresh):
            node.place = len(sums)
            sums.append((sums[node.parent.place] if node.parent else 0.0) + sum(float(weights[_bucket(f)]) for f in node.features()))
        out[i] = (sums[b.node.place] if b.node else 0.0) + sum(float(weights[_bucket(f)]) for f in own)
    return out


def labelled_pages(n: int, seed: int = 7) -> Iterator[list[tuple[str, int]]]:
    """Pages as lists of (html piece, label): 1 where the piece is main text, 0 elsewhere."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b c d f g h l m n p r s t v w st ch th".split() for b in "a e i o u an er in on".split()]

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def prose(most: int = 5) -> str:
        return " ".join(words(3, 18).capitalize() + rng.choice(".....?!") for _ in range(rng.randint(1, most)))

    def ui() -> str:
        return " ".join(rng.sample(sorted(INTERFACE), rng.randint(1, 3))).capitalize() if rng.random() < 0.5 else words(1, 3)

    def links(k: int) -> list[tuple[str, int]]:
        shape = rng.choice([("<ul>", '<li><a href="#">{}</a></li>', "</ul>"), ("<div>", '<a href="#">{}</a> ', "</div>"), ("", '<div><a href="#">{}</a></div>', "")])
        return [(shape[0], 0), *((shape[1].format(ui()), 0) for _ in range(k)), (shape[2], 0)]

    def boilerplate(kind: str) -> list[tuple[str, int]]:
        def attribute(choices: str) -> str:
            name = rng.choice(choices.split())
            return f' {rng.choice(["class", "id", "class"])}="{name}{rng.choice(["", "", "-box", "-inner", " wide"])}"'

        if kind == "menu":
            tag, at = rng.choice([("nav", ""), ("div", attribute("nav menu navbar breadcrumbs navigation topbar toolbar"))])
            return [(f"<{tag}{at}>", 0), *links(rng.randint(2, 8)), (f"</{tag}>", 0)]
        if kind == "header":
            tag, at = rng.choice([("header", ""), ("div", attribute("header masthead site-header banner logo"))])
            return [(f"<{tag}{at}>", 0), (f"<{rng.choice(['div', 'p', 'h2'])}>{words(1, 6)}", 0), *(links(3) if rng.random() < 0.5 else []), (f"</{tag}>", 0)]
        if kind == "footer":
            tag, at = rng.choice([("footer", ""), ("footer", ""), ("div", attribute("footer colophon site-footer copyright legal"))])
            return [(f"<{tag}{at}>", 0), (f"{rng.choice(['', '<p>'])}{rng.choice(['&copy; ', '', '2024 '])}{words(1, 4)} &middot; {prose(2)}", 0), *(links(3) if rng.random() < 0.4 else []), (f"</{tag}>", 0)]
        if kind == "sidebar":
            tag, at = rng.choice([("aside", ""), ("div", attribute("sidebar related widget recommended aside trending popular tags"))])
            return [(f"<{tag}{at}>", 0), (f"<h3>{ui()}</h3>", 0), *(links(4) if rng.random() < 0.6 else [(f"<p>{prose(2)}</p>", 0)]), (f"</{tag}>", 0)]
        if kind == "advert":
            tag = rng.choice(["div", "div", "section", "ins"])
            return [(f"<{tag}{attribute('ad ads advert advertisement banner promo sponsored sponsor adsense')}>", 0), (f"{rng.choice(['', '<p>'])}{prose(3)}", 0), (f"</{tag}>", 0)]
        if kind == "notice":
            tag = rng.choice(["div", "div", "section"])
            return [(f"<{tag}{attribute('cookie notice alert consent newsletter subscribe popup modal gdpr paywall message')}>", 0), (f"<p>{prose(2)}</p>", 0), (f"<button>{ui()}</button>", 0), (f"</{tag}>", 0)]
        if kind == "form":
            return [(f"<form{rng.choice(['', attribute('search login contact')])}>", 0), (f"<label>{ui()}</label><input name=q>", 0), (f"<p>{words(2, 8)}</p>", 0), (f"<select><option>{ui()}</option><option>{ui()}</option></select>", 0), (f"<button>{ui()}</button></form>", 0)]
        if kind == "share":
            return [(f"<div{attribute('share social follow pagination pager meta-links author-links')}>", 0), *links(3), ("</div>", 0)]
        out = [(f"<{(tag := rng.choice(['div', 'section', 'ol']))}{attribute('comments comment discussion responses replies disqus reader-comments')}>", 0)]
        if rng.random() < 0.6:
            out.append((f"<h{(k := rng.choice('234'))}>{ui()}</h{k}>", 0))
        for _ in range(rng.randint(1, 5)):
            inner = rng.choice(["div", "li", "article", "p"])
            out += [(f'<{inner}{rng.choice(["", attribute("comment reply response")])}>', 0), (rng.choice(["{}", "<p>{}</p>", "<b>" + words(1, 2) + "</b> {}"]).format(prose(3)), 0), (f"</{inner}>", 0)]
        return [*out, (f"</{tag}>", 0)]

    def main_text() -> list[tuple[str, int]]:
        out = []
        if rng.random() < 0.85:
            head = prose(1) if rng.random() < 0.5 else words(2, 10)
            wrap = rng.random() < 0.15
            out += [("<header>", 0)] * wrap + [(f"<h1>{head}</h1>", 1)] + [("</header>", 0)] * wrap
        for _ in range(rng.randint(0 if out else 1, rng.choice([2, 12]))):
            kind = rng.random()
            if kind < 0.62:
                text = prose(6) if rng.random() < 0.8 else words(1, 2).capitalize() + "."
                if rng.random() < 0.08:
                    text = text.replace(" ", " | ")
                if rng.random() < 0.25:
                    text = text.replace(" ", ' <a href="/x">', 1) + "</a>"
                out.append((rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>", "<div>{}</div>"]).format(text), 1))
            elif kind < 0.74:
                out.append((rng.choice(["<h2>{}</h2>", "<h3>{}</h3>"]).format(words(1, 8)), 1))
            elif kind < 0.84:
                out += [("<ul>", 0), *((f"<li>{words(1, 12)}</li>", 1) for _ in range(rng.randint(2, 5))), ("</ul>", 0)]
            elif kind < 0.9:
                out.append((rng.choice(["<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>"]).format(prose(2)), 1))
            elif kind < 0.95:
                out += [("<table><tr>", 0), *((f"<td>{words(1, 4)}</td>", 1) for _ in range(rng.randint(2, 6))), ("</tr></table>", 0)]
            elif rng.random() < 0.7:
                out += boilerplate(rng.choice(["advert", "share", "sidebar", "notice"]))
        return out

    for _ in range(n):
        clutter = rng.choice([0.0, 0.2, 0.45, 0.45, 0.6])
        before = [boilerplate(k) for k in ("menu", "header", "advert", "notice", "form", "share") if rng.random() < clutter]
        after = [boilerplate(k) for k in ("footer", "sidebar", "comments", "share", "advert", "form", "menu", "notice") if rng.random() < clutter]
        rng.shuffle(before)
        rng.shuffle(after)
        tag, at = rng.choice([("article", "")] * 6 + [("main", "")] * 3 + [("div", ' class="content"'), ("div", ' id="post"'), ("div", ' class="entry-content"'), ("div", ' class="article-body"'), ("div", ' class="story"'), ("section", ' class="text"'), ("td", ""), ("", ""), ("div", "")])
        inside = main_text() + (boilerplate("comments") if rng.random() < 0.12 else [])
        body = [(f"<{tag}{at}>", 0), *inside, (f"</{tag}>", 0)] if tag else inside
        yield [("<html><body>", 0), *(x for part in before for x in part), *body, *(x for part in after for x in part), ("</body></html>", 0)]


MARK = "\ue000"


def labelled_blocks(page: list[tuple[str, int]]) -> tuple[list[Block], list[int]]:
    """Blocks of a composed page and their labels; a private mark before each main text carries the label through the parser."""
    html = "".join(re.sub(r"(^|>)(?=[^<>]*\w)", rf"\1{MARK}", piece) if label else piece for piece, label in page)
    blocks = blocks_of(html)
    labels = [int(MARK in b.text) for b in blocks]
    for b in blocks:
        b.text = b.text.replace(MARK, "").strip() or "-"
    return blocks, labels


def train(pages: int = 1500, seed: int = 7) -> crf.Model:
    """The field from ``pages`` composed pages; the same for the same arguments."""
    features, labels, lengths = [], [], []
    for page in labelled_pages(pages, seed):
        blocks, own = labelled_blocks(page)
        features += feature_numbers(blocks)
        labels += own
        lengths.append(len(own))
    sizes = np.array(lengths, dtype=np.int64)
    return crf.fit(crf.Features.of(features), np.array(labels, dtype=np.int64), crf.Chains(np.cumsum(sizes) - sizes, sizes), 1 << BITS, rounds=80)


def main_texts(model: crf.Model, pages: list[str]) -> list[str]:
    """The main text of each page: its main blocks, joined by a line break."""
    each = [blocks_of(p) for p in pages]
    sizes = np.array([len(b) for b in each], dtype=np.int64)
    delta = np.concatenate([block_scores(model.weights, blocks) for blocks in each]) if each else np.empty(0)
    starts = np.cumsum(sizes) - sizes
    labels = model.viterbi(delta, crf.Chains(starts, sizes))
    return ["\n".join(b.text for b, y in zip(blocks, labels[s : s + len(blocks)], strict=True) if y) for blocks, s in zip(each, starts.tolist(), strict=True)]


def extract(pages: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())  # an array of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "html"):
            texts = main_texts(shared.value, texts_of(batch, "html"))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(work, "page_id long, url string, text string, n_chars long")
