"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags. Each block has features of its ancestors' tags and
class words and of its text; a two-state chain, trained on labelled pages, is decoded by Viterbi, and the blocks labelled
main make up the text. Blocks within an element that cannot hold main text (scripts, styles, forms) are not made at all.

The labelled pages are written by training_pages(), in many layouts; the model is a few hundred weights.

Defined cases: a null or empty page, and one without main blocks, has the empty text; unclosed and stray tags are mended
as browsers do for paragraphs, list items and table cells; a tag or quote that never ends is text; very long and very deeply
nested pages take time in proportion to their length; a form that opens the page before any text holds blocks like any
element (some sites put the whole page in one); repeated rows are pages of their own; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead title head tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
DROP = frozenset("script style textarea noscript template iframe svg math head title select button form object canvas audio video datalist".split())
#: What an opening tag closes, if it is open nearer than the stop tags.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"html", "body", "head", "title"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_IS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_STOP = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_WORDS = re.compile(r"[a-z]+")
_ZEROS, _LONG = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


class Block:
    """A leaf block. score: weight of its ancestors' features; features: these by name, only where no weights are given."""

    __slots__ = ("features", "linked", "mark", "score", "text")

    def __init__(self, text: str, linked: int, score: float = 0.0, features: frozenset = frozenset(), mark: str | None = None):
        self.text, self.linked, self.score, self.features, self.mark = text, linked, score, features, mark


class Scanner:
    """Tags of a page from left to right; no character is looked at more than a few times, whatever the page holds."""

    def __init__(self, page: str):
        self.page, self.none = page, {}

    def find(self, what: str, at: int) -> int:
        """Place of what from at on, or -1; once there is none it is not searched for again."""
        if what in self.none and at >= self.none[what]:
            return -1
        to = self.page.find(what, at)
        if to < 0:
            self.none[what] = at
        return to

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """Those of a tag, the place behind it, and whether it closes itself. A quote without end does not quote."""
        page, out = self.page, []
        while True:
            gap = _GAP.match(page, at).end()
            closes = gap > at and page[gap - 1] == "/"
            if gap >= len(page):
                return out, len(page), closes
            if page[gap] == ">":
                return out, gap + 1, closes
            at = _KEY.match(page, gap).end()
            key, value = page[gap:at], ""
            if m := _IS.match(page, at):
                at = m.end()
                quote = page[at : at + 1]
                to = self.find(quote, at + 1) if quote in ('"', "'") and quote else -1
                if to >= 0:
                    value, at = page[at + 1 : to], to + 1
                else:
                    to = _BARE.match(page, at).end()
                    value, at = page[at:to], to
            out.append((key, value))


class _Open:
    """The open elements, with what is asked of them kept up to date: last places by tag, links, and the features' weight."""

    def __init__(self, weights: dict[str, float] | None):
        self.weights, self.tags, self.undo, self.marks = weights, [], [], []
        self.places: dict[str, list[int]] = {}
        self.present: dict[str, int] = {}
        self.score, self.dropped, self.inner = 0.0, 0, 0

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] if self.places.get(t) else -1 for t in tags), default=-1)

    def push(self, tag: str, names: str, mark: str | None, drop: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        own = set()
        if tag not in ("html", "body"):
            own.add(f"in={tag}")
        own.update(f"class={w}" for w in _WORDS.findall(names))
        self.undo.append((own, self.score, drop))
        for f in own:
            n = self.present.get(f, 0)
            if not n and self.weights:
                self.score += self.weights.get(f, 0.0)
            self.present[f] = n + 1
        self.inner += tag not in ("html", "body")
        self.tags.append(tag)
        self.marks.append(mark or (self.marks[-1] if self.marks else None))
        self.dropped += drop

    def pop(self) -> None:
        tag = self.tags.pop()
        self.places[tag].pop()
        self.inner -= tag not in ("html", "body")
        own, self.score, drop = self.undo.pop()
        for f in own:
            self.present[f] -= 1
        self.marks.pop()
        self.dropped -= drop


def leaf_blocks(page: str, weights: dict[str, float] | None = None) -> list[Block]:
    """The leaf blocks with text, in page order. Time and memory grow with the page's length alone, not with its nesting."""
    out: list[Block] = []
    scan, open_ = Scanner(page), _Open(weights)
    held: list[str] = []
    links: list[int] = []  # the depths at which links are open
    linked = 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a and not open_.dropped:
            held.append(page[a:b])
            if links:
                linked += b - a

    def end() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            if "&#" in raw:
                raw = _LONG.sub("\ufffd", _ZEROS.sub("&#", raw))
            shown = " ".join(unescape(raw).split())
            if shown:
                tag = open_.tags[-1] if open_.tags else ""
                if weights is None:
                    out.append(Block(shown, linked, 0.0, frozenset([f"own={tag}", *(f for f, n in open_.present.items() if n)]), open_.marks[-1] if open_.marks else None))
                else:
                    out.append(Block(shown, linked, open_.score + weights.get(f"own={tag}", 0.0)))
            held.clear()
        linked = 0

    def close(depth: int) -> None:
        if len(open_.tags) > depth:
            end()
            while len(open_.tags) > depth:
                open_.pop()
            while links and links[-1] > depth:
                links.pop()

    at, n = 0, len(page)
    while at < n:
        lt = scan.find("<", at)
        if lt < 0:
            text(at, n)
            break
        text(at, lt)
        sign = page[lt + 1 : lt + 2]
        if sign in ("!", "?"):
            comment = page.startswith("<!--", lt)
            to = scan.find("-->", lt + 2) if comment else scan.find(">", lt)
            if to < 0:
                if comment:
                    break
                text(lt, lt + 1)
                at = lt + 1
            else:
                at = to + (3 if comment else 1)
            continue
        ends = sign == "/"
        m = _NAME.match(page, lt + 1 + ends)
        if not m:
            to = scan.find(">", lt) if ends else -1
            if to >= 0:  # a stray end: a comment to browsers
                at = to + 1
            else:
                text(lt, lt + 1)
                at = lt + 1
            continue
        if scan.find(">", m.end()) < 0:  # never closed: no tag
            text(lt, m.end())
            at = m.end()
            continue
        tag = m[0].lower()
        attrs, at, alone = scan.attributes(m.end())
        if ends:
            if tag == "a":
                if links:
                    links.pop()
            elif tag in BLOCK or tag in DROP or tag in RAW:
                if (depth := open_.last(tag)) >= 0:
                    close(depth)
                elif tag in BLOCK:
                    end()
            elif tag == "br":
                held.append(" ")
            continue
        if tag in BLOCK:
            if tag in ENDS_P and (depth := open_.last("p")) >= 0 and depth > open_.last("td", "th", "table", "button"):
                close(depth)
            if tag in CLOSES:
                own, stops = CLOSES[tag]
                if (depth := open_.last(*own)) > open_.last(*stops):
                    close(depth)
            end()
        if tag in VOID:
            held.append(" ")
            continue
        if tag == "a":
            links.append(len(open_.tags))
            continue
        if tag not in BLOCK and (alone or tag not in DROP and tag not in RAW):
            continue
        names = " ".join(v for k, v in attrs if k.lower() in ("class", "id", "role")).lower()
        # a form around the whole page, before any text of it, is no form to a reader
        drop = tag in DROP and not (tag == "form" and not out and not open_.inner)
        open_.push(tag, names, next((v for k, v in attrs if k == "data-y"), None), drop)
        if tag in RAW:
            stop = _STOP[tag].search(page, at)
            to = stop.start() if stop else n
            text(at, to)
            at = to
    close(0)
    end()
    return out


# -- features and the chain -------------------------------------------------------------------------------------------


def text_features(b: Block) -> list[str]:
    t = b.text
    n, words = len(t), t.count(" ") + 1
    out = [f"length={min(8, n.bit_length())}", f"words={min(6, words.bit_length())}", f"links={min(4, 5 * b.linked // max(1, n))}"]
    if t[-1] in ".!?…":
        out.append("stop")
    if "©" in t or "·" in t:
        out.append("sign")
    return out


class Chain:
    """Two states, 0 beside and 1 main; weight of a feature: of state 1 against 0."""

    def __init__(self, weights: dict[str, float], step: np.ndarray):
        self.weights, self.step = weights, step

    def main(self, blocks: list[Block]) -> list[bool]:
        """Viterbi, over blocks that were cut with this chain's weights."""
        if not blocks:
            return []
        get, (s00, s01), (s10, s11) = self.weights.get, *self.step.tolist()[:1], *self.step.tolist()[1:]
        u = [b.score + sum(get(f, 0.0) for f in text_features(b)) + get("bias", 0.0) for b in blocks]
        a, c, back = 0.0, u[0], []
        for x in u[1:]:
            from_a, from_c = a + s00 >= c + s10, a + s01 > c + s11
            back.append((not from_a, not from_c))
            a, c = max(a + s00, c + s10), max(a + s01, c + s11) + x
        out = [c > a]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def trained(pages: list[list[Block]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """By the gradient of the log likelihood, forward and backward over each page, AdaGrad steps; marks are the labels."""
    names: dict[str, int] = {}
    data = []
    for blocks in pages:
        rows = [[names.setdefault(f, len(names)) for f in ["bias", *sorted(b.features), *text_features(b)]] for b in blocks]
        data.append((rows, np.array([b.mark == "1" for b in blocks], np.int64)))
    w, step = np.zeros(len(names)), np.zeros((2, 2))
    gw, gs = np.full(len(names), 1e-3), np.full((2, 2), 1e-3)
    order = random.Random(1)
    for _ in range(rounds):
        order.shuffle(data)
        for rows, y in data:
            n = len(y)
            u = np.array([[0.0, w[r].sum()] for r in rows])
            f, b = np.zeros((n, 2)), np.zeros((n, 2))
            f[0] = u[0]
            for i in range(1, n):
                f[i] = u[i] + np.logaddexp(f[i - 1, 0] + step[0], f[i - 1, 1] + step[1])
            for i in range(n - 2, -1, -1):
                x = b[i + 1] + u[i + 1]
                b[i] = np.logaddexp(step[:, 0] + x[0], step[:, 1] + x[1])
            z = np.logaddexp(*f[-1])
            p = np.exp(f[:, 1] + b[:, 1] - z)
            d = np.zeros(len(names))
            for i, r in enumerate(rows):
                d[r] += y[i] - p[i]
            ds = np.zeros((2, 2))
            for i in range(1, n):
                ds[y[i - 1], y[i]] += 1
                ds -= np.exp(f[i - 1][:, None] + step + (u[i] + b[i])[None, :] - z)
            d -= decay * w
            gw += d * d
            gs += ds * ds
            w += rate * d / np.sqrt(gw)
            step += rate * ds / np.sqrt(gs)
    return Chain({f: float(w[k]) for f, k in names.items()}, step)


# -- labelled pages ---------------------------------------------------------------------------------------------------

_SOUNDS = "a an ar be co da de do el en er es fi ga ha in is ja ka la le li ma mo na ne no on or pa re ri ro sa se si so ta te ti to un va ve vi".split()


def training_pages(n: int = 160, seed: int = 5) -> list[str]:
    """Pages whose elements carry data-y="1" on main text and "0" on all else."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(_SOUNDS, k=rng.randint(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda: (words(3, 18).capitalize() + rng.choice([".", ".", ".", "!", "?", " ***", ""]))
    prose = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
    out = []
    for _ in range(n):
        links = lambda k: "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(k))
        flat = lambda k: " | ".join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(k))
        many = rng.randint(3, 9)
        beside = {
            "nav": lambda m=many: rng.choice([f'<nav data-y="0"><ul>{links(m)}</ul></nav>', f'<div class="{rng.choice(["nav", "navbar", "menu", "main-menu", "breadcrumb"])}" data-y="0">{flat(m)}</div>', f'<ul class="menu" data-y="0">{links(m)}</ul>', f'<div id="navigation" role="navigation" data-y="0"><ul>{links(m)}</ul></div>']),
            "header": lambda: rng.choice([f'<header data-y="0"><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>', f'<div class="{rng.choice(["header", "site-header", "masthead", "banner"])}" data-y="0">{words(2, 5)}</div>', f'<div id="header" data-y="0"><a href="/">{words(1, 2)}</a></div>']),
            "footer": lambda: rng.choice([f'<footer data-y="0">&copy; {word()}.example.com &middot; {sentence()}</footer>', f'<div class="{rng.choice(["footer", "site-footer", "bottom"])}" data-y="0"><p>{prose()}</p><p>&copy; {words(1, 3)}</p></div>', f'<footer data-y="0"><p>{sentence()}</p><ul>{links(3)}</ul></footer>', f'<div id="footer" data-y="0">{words(3, 9)}</div>']),
            "aside": lambda: rng.choice([f'<aside data-y="0"><h3>{words(1, 3)}</h3><p>{prose()}</p></aside>', f'<div class="{rng.choice(["sidebar", "widget", "related", "side", "sidebar-right"])}" data-y="0"><h4>{words(1, 3)}</h4><ul>{links(4)}</ul><p>{sentence()}</p></div>']),
            "notice": lambda: f'<div class="{rng.choice(["cookie", "notice", "cookie-banner", "alert", "popup", "newsletter", "subscribe", "consent"])}" data-y="0"><p>{prose()}</p></div>',
            "ad": lambda: rng.choice([f'<div class="{rng.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo"])}" data-y="0">{prose()}</div>', f'<!-- ad --><div class="ad" data-y="0">{sentence()}</div>', f'<div id="ad-{word()}" data-y="0"><p>{prose()}</p></div>']),
            "comments": lambda: rng.choice([f'<section class="comments" data-y="0"><h2>{words(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(rng.randint(1, 5))) + "</section>", '<ol class="comment-list" data-y="0">' + "".join(f"<li><b>{word()}</b><p>{prose()}</p></li>" for _ in range(rng.randint(1, 4))) + "</ol>", f'<div id="comments" data-y="0"><p>{prose()}</p><p>{prose()}</p></div>']),
            "form": lambda: f'<form data-y="0"><p>{words(2, 6)}</p><input name="q"><button>{word()}</button></form>',
            "share": lambda: f'<div class="{rng.choice(["share", "social", "tags", "meta", "byline"])}" data-y="0">{flat(3)}</div>',
        }
        body = [f'<h1 data-y="1">{words(2, 9)}</h1>'] if rng.random() < 0.85 else []
        for _ in range(rng.choice([0, 1, 2, 4, 6, 10, 20])):
            body.append(rng.choices([
                f'<p data-y="1">{prose()}' + rng.choice(["</p>", "</p>", "</p>", ""]), f'<p data-y="1"><b>{prose()}<br>', f'<h2 data-y="1">{words(1, 6)}</h2>', '<ul data-y="1">' + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>",
                f'<blockquote data-y="1"><p>{prose()}</p></blockquote>', f'<pre data-y="1">{words(4, 20)}</pre>', f'<table data-y="1"><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>', f'<div data-y="1">{prose()} <a href="/x">{word()}</a></div>', f'<figure data-y="1"><img src="x"><figcaption>{words(3, 9)}</figcaption></figure>', f'<p data-y="1">{word()}.</p>',
            ], [12, 3, 2, 1, 1, 0.5, 0.5, 1, 0.5, 2])[0])
        if len(body) > 2 and rng.random() < 0.4:
            body.insert(rng.randint(1, len(body)), beside[rng.choice(["ad", "share", "form", "aside"])]())
        tag = rng.choices(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content"><div class="post">{}</div></div>', '<section class="article-body">{}</section>', '<article class="entry">{}</article>'], [6, 2, 2, 2, 1, 1, 1])[0]
        before = [k for k in ("notice", "header", "nav", "ad", "share") if rng.random() < 0.55]
        after = [k for k in ("comments", "aside", "ad", "form", "nav", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        page = "".join(beside[k]() for k in before) + tag.format("".join(body)) + "".join(beside[k]() for k in after)
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{page}" + rng.choice(["</body></html>", ""]))
    return out


@lru_cache(1)
def model() -> Chain:
    return trained([b for b in map(leaf_blocks, training_pages()) if b])


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page or "", chain.weights)
    return "\n\n".join(b.text for b, y in zip(blocks, chain.main(blocks), strict=True) if y)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    own = model()
    sent = pages.sparkSession.sparkContext.broadcast((own.weights, own.step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(*sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                own = batch.slice(lo, 500)
                texts = [main_text(x, chain) for x in own.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(load(spark, sf_dir, "pages"))
