"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is split into leaf blocks: runs of text between block-level tags. Each block is described by
its ancestors' tags, by words in their class, id and role, and by its text (length, link density,
punctuation). Ancestors count by place: below the nearest element that looks like an article's
container, that element itself, or above it; and in a class like entry-comments the last telling word
says what it is. A chain of two states, article and other, is trained by gradient ascent on the log
likelihood over labelled pages and decoded by Viterbi. The labelled pages are TRAIN_PAGES pages
laid out by labelled_pages(): layouts of many kinds, with the label of every block known.

Defined results: null and empty pages have an empty text; broken markup is read as far as it goes
(an unfinished tag ends the page, unclosed elements end with their parent); repeated rows get the
same result each; pages of any length are read whole; an empty table gives an empty result; extract()
replaces columns named text and n_chars, other columns pass through.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphlens.llm.common import extended, fresh, read_table

TRAIN_PAGES = 2000
SEED = 11
ARTICLE, OTHER = 1, 0

#: Elements whose content is no text.
SKIPPED = frozenset("script style noscript template textarea select svg math iframe object canvas audio video title head option datalist".split())
#: Elements whose content is read up to their end tag, whatever it holds.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening block element ends.
ENDED = frozenset("p dt dd li option tr td th".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: An attribute without quotes at the end of a tag: a slash is its own.
UNQUOTED = re.compile(r"=\s*[^\s\"']*/$")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Words of class, id and role that are told apart, by group.
HINTS = {
    "ad": "ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion promoted doubleclick",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs",
    "side": "sidebar side aside widget rail complementary",
    "related": "related recommended recommendations trending popular teaser",
    "more": "more continue",
    "share": "share sharing social follow tags",
    "comment": "comment comments respond reply replies disqus discussion feedback",
    "foot": "footer foot contentinfo copyright legal colophon",
    "head": "header masthead topbar logo branding",
    "notice": "notice cookie cookies consent gdpr alert popup modal dialog overlay toast paywall warning",
    "form": "form newsletter subscribe signup login search subscription poll",
    "meta": "meta byline author date timestamp",
    "main": "main article post entry story hentry articlebody",
    "box": "content body text page container wrapper wrap inner",
}
#: Words that make a class a state of what it stands on (has-sidebar, header-image-on) and not a part of the page.
STATES = frozenset("has with no without on off open closed enabled disabled".split())
HINT_OF = {word: group for group, words in HINTS.items() for word in words.split()}
ANCESTORS = frozenset("nav footer header aside article main form ul ol table section figure blockquote button details dialog address h1 h2 h3 h4 h5 h6 pre".split())


class Marks(NamedTuple):
    container: str  # article, main, box or empty
    found: tuple[str, ...]


def leaf_blocks(page: str) -> list[tuple[str, list[str]]]:
    """(text, features) of the leaf blocks, in page order; texts are decoded and their white space is single."""
    out: list[tuple[str, list[str]]] = []
    stack: list[tuple[str, Marks]] = []
    open_tags: Counter[str] = Counter()
    place = Place()
    parts: list[str] = []
    linked = skipping = 0
    tag_of = ""

    def flush() -> None:
        nonlocal linked, parts
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            out.append((text, block_features(text, linked, tag_of, place)))
        parts, linked = [], 0

    def pop() -> None:
        nonlocal skipping
        tag, own = stack.pop()
        open_tags[tag] -= 1
        skipping -= tag in SKIPPED
        place.leave(own)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not skipping:
            parts.append(page[at:stop])
            if open_tags["a"]:
                linked += stop - at
            if len(parts) == 1 or not tag_of:
                tag_of = next((t for t, _ in reversed(stack) if t not in INLINE), "")
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag or (m[5] and not m[0].endswith(">")):
            continue
        inline = tag in INLINE
        if not inline:
            tag_of = tag_of or next((t for t, _ in reversed(stack) if t not in INLINE), "")
            flush()
            tag_of = ""
        elif tag == "br" and not skipping:
            parts.append(" ")
        if closing:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or attributes.endswith("/") and not UNQUOTED.search(attributes):
            continue
        if not inline and tag in ENDED or tag in ("div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "blockquote", "aside", "nav", "footer"):
            while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE and open_tags["p"] or stack[-1][0] == tag and tag in ENDED):
                pop()
        own = element_marks(tag, attributes)
        stack.append((tag, own))
        open_tags[tag] += 1
        place.enter(own)
        skipping += tag in SKIPPED
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    return out


def token_mark(token: str) -> str | None:
    """What one class, id or role says: the last telling word, unless it is only a box; mixed if an article's word leads it, state if it is a state."""
    words = [w.lower() for w in WORD_PARTS.findall(token)]
    groups = [HINT_OF[w] for w in words if w in HINT_OF]
    telling = [g for g in groups if g != "box"]
    if not groups:
        return None
    if not telling:
        return "box"
    if telling[-1] != "main" and not STATES.isdisjoint(words):
        return f"state={telling[-1]}"
    return f"mixed={telling[-1]}" if telling[-1] != "main" and telling[0] == "main" else telling[-1] if telling[-1] == "main" else f"hint={telling[-1]}"


def element_marks(tag: str, attributes: str) -> Marks:
    """What an element says of the blocks below it, and whether it looks like an article's container."""
    found, container = set(), ""
    if tag in ("article", "main"):
        container = tag
    elif tag in ANCESTORS:
        found.add(f"in={tag}")
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("hidden", "aria-hidden") and value.lower() != "false":
                found.add("hint=hidden")
            for token in value.split():
                if mark := token_mark(token):
                    if mark in ("main", "box"):
                        container = container if container and mark == "box" else container or mark
                    else:
                        found.add(mark)
    if container == "box" and any(m.startswith(("hint=", "mixed=")) for m in found):
        container = ""  # a box of something else
    return Marks(container, tuple(found))


class Place:
    """The marks of all open elements, those since the innermost container counted apart."""

    def __init__(self) -> None:
        self.every: Counter[str] = Counter()
        self.below: list[Counter[str]] = [Counter()]
        self.own: list[tuple[str, ...]] = [()]

    def enter(self, marks: Marks) -> None:
        if marks.container:
            self.below.append(Counter())
            self.own.append((f"kind={marks.container}", *marks.found))
        else:
            self.below[-1].update(marks.found)
        self.every.update(marks.found)
        if marks.container:
            self.every[f"in={marks.container}"] += 1

    def leave(self, marks: Marks) -> None:
        self.every.subtract(marks.found)
        if marks.container:
            self.every[f"in={marks.container}"] -= 1
            self.below.pop()
            self.own.pop()
        else:
            self.below[-1].subtract(marks.found)


def block_features(text: str, linked: int, tag: str, place: Place) -> list[str]:
    words = text.count(" ") + 1
    size = next(i for i, most in enumerate((2, 5, 10, 25, 60, 1 << 60)) if words <= most)
    share = min(3, int(4 * linked / max(1, len(text))))
    heading = tag[:1] == "h" and tag[1:].isdigit()
    out = ["bias", f"words={size}", f"links={share}", f"tag={tag}", f"end={text[-1] in '.!?:;…”\"'}"]
    if "©" in text or "copyright" in text[:200].lower():
        out.append("copyright")
    below = {m for m, n in place.below[-1].items() if n > 0}
    if len(place.own) > 1:
        own = set(place.own[-1])
        above = {m for m, n in place.every.items() if n > (m in below) * place.below[-1][m] + (m in own)} - {f"in={place.own[-1][0][5:]}"}
        out += ["inside", *(f"below&{m}" for m in below), *(f"own&{m}" for m in own), *(f"above&{m}" for m in above)]
        out += [f"below&{m}&heading={heading}" for m in below if m.startswith(("hint=", "mixed=")) or m in ("in=header", "in=footer")]
        if not below:
            out += [f"own&plain&{m}" for m in own if m.startswith("kind=")]
        if "hint=more" in below or "mixed=more" in below:
            out.append(f"inside&more&links={share}")
    else:
        out += [f"outside&words={size}", f"outside&tag={tag}", *(f"bare&{m}" for m in below)]
        if not below:
            out += [f"bare&tag={tag}", f"bare&links={share}"]
    return out


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> Iterator[list[tuple[list[str], int]]]:
    """Pages of many layouts, as (features, label) of their blocks. Article blocks hold a mark that no other has."""
    rng = random.Random(seed)
    mark = "①"
    mains, boxes = HINTS["main"].split(), HINTS["box"].split()
    others = [g for g in HINTS if g not in ("main", "box")]

    def prose(least: int, most: int) -> str:
        return " ".join("".join(rng.choice("abcdefghilmnoprstuvéä") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(least, most))) + rng.choice((".", ".", ".", "!", ""))

    def block(tag: str, least: int, most: int, good: bool) -> str:
        inner = prose(least, most)
        if rng.random() < 0.15:
            inner = f"<b>{inner}"
            inner += rng.choice(("</b>", "<br>", ""))
        if rng.random() < 0.1:
            inner += f' <a href="#">{prose(1, 3)}</a>'
        return f"<{tag}>{mark if good else ''}{inner}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>")

    def links(k: int) -> str:
        if rng.random() < 0.3:
            return rng.choice((" ", " | ", "")).join(f"<a href=/{i}>{prose(1, 3)}</a>" for i in range(k)) or prose(1, 3)
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def hinted(group: str, tags: tuple[str, ...] = ("div",)) -> tuple[str, str]:
        tag, word = rng.choice(tags), rng.choice(HINTS[group].split())
        style = rng.choice((word, word, f"{word}-box", f"js-{word}", f"c_{word} wide", f"{word}-{rng.choice(boxes)}", f"{rng.choice(mains)}-{word}", f"{rng.choice(mains)}-{word}", f"site-{word}"))
        return f'<{tag} {rng.choice(("class", "id"))}="{style}">', f"</{tag}>"

    def wrapped(pair: tuple[str, str], *inner: str) -> str:
        return pair[0] + "".join(inner) + pair[1]

    def boxed(inner: str) -> str:
        """Sometimes in a box of its own."""
        return f'<div class="{rng.choice(boxes)}">{inner}</div>' if rng.random() < 0.25 else inner

    def topics() -> str:
        """Classes of a container that tell what a text is about, or a state."""
        word = rng.choice(HINTS[rng.choice(others)].split())
        return " ".join(rng.sample((f"{word}-{nonsense()}", f"tag-{word}", f"category-{word}", f"has-{word}", f"{word}-on", f"post-{rng.randint(1, 99)}"), rng.randint(1, 3)))

    def nonsense() -> str:
        return "".join(rng.choice("bcdfgklmnz") for _ in range(5))

    def theme() -> tuple[str, str]:
        """A wrapper around the article and more, whose class names a part that it is not."""
        word, main = rng.choice(HINTS[rng.choice(others)].split()), rng.choice(mains)
        return f'<div class="{rng.choice((f"{main}-{word}-wrap", f"{main}-{word}", f"has-{word}", f"with-{word}-{nonsense()}", f"{main}-{word}-{nonsense()}-on", f"no-{word}"))}">', "</div>"

    def noise() -> str:
        kind = rng.choice(("ad", "side", "related", "more", "share", "notice", "form", "nav", "foot", "aside", "plainform"))
        if kind == "aside":
            return "<aside>" + block("p", 3, 50, False) + links(rng.randint(1, 4)) + "</aside>"
        if kind == "plainform":
            return "<form><label>" + prose(1, 4) + "</label><input><button>" + prose(1, 2) + "</button>" + block("p", 3, 20, False) + "</form>"
        inner = {"nav": lambda: links(rng.randint(2, 7)), "share": lambda: links(3), "more": lambda: f'<a href="/m">{prose(1, 4)}</a>' + links(rng.randint(0, 3)), "related": lambda: links(4) + block("p", 4, 20, False) if rng.random() < 0.7 else "".join("<article>" + block("h3", 2, 8, False) + block("p", 4, 30, False) + "</article>" for _ in range(2))}.get(kind, lambda: block(rng.choice(("p", "span", "div")), 2, 60, False))
        return wrapped(hinted(kind, ("div", "section", "aside")), boxed(inner()))

    def comments() -> str:
        one = lambda: wrapped(rng.choice((("<div>", "</div>"), ("<article>", "</article>"), ('<article class="comment">', "</article>"), hinted("comment"), ("", ""))), boxed(block(rng.choice(("p", "p", "li", "div")), 2, 60, False)))
        return wrapped(hinted("comment", ("div", "section")), (block("h3", 1, 4, False) if rng.random() < 0.3 else ""), *(one() for _ in range(rng.randint(1, 4))))

    def container(tags: tuple[str, ...]) -> tuple[str, str]:
        tag, word = rng.choice(tags), rng.choice(mains + boxes)
        style = rng.choice((word, word, f"{word}-box", f"c_{word} wide", f"{rng.choice(mains)}-{rng.choice(boxes)}", f"{rng.choice(mains)} {topics()}"))
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{style}">', f"</{tag}>"

    def article(bare: bool) -> str:
        out = [block("h1", 3, 12, True)] if rng.random() < 0.85 else []
        if out and not bare and rng.random() < 0.2:  # a title in the article's own header
            out = ["<header>" + out[0] + (block("p", 3, 30, True) if rng.random() < 0.3 else "") + "</header>"]
        elif out and not bare and rng.random() < 0.15:  # or in a part named for its look
            out = [f'<div class="{rng.choice(("banner", "masthead", "header", "hero", rng.choice(mains) + "-header", rng.choice(mains) + "-title", "title-banner"))}">' + out[0] + "</div>"]
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 12))):
            x = rng.random()
            if x < 0.72:
                out.append(block("p", 1, 90, True))
            elif x < 0.8:
                out.append(block(rng.choice(("h2", "h3")), 1, 8, True))
            elif x < 0.86:
                out.append("<ul>" + "".join(block("li", 1, 25, True) for _ in range(rng.randint(1, 5))) + "</ul>")
            elif x < 0.9:
                out.append("<blockquote>" + block("p", 5, 40, True) + "</blockquote>")
            elif x < 0.93:
                out.append("<table><tr>" + block("td", 1, 6, True) + block("td", 1, 6, True) + "</tr></table>")
            elif x < 0.94:
                out.append(block("pre", 5, 30, True))
            elif x < 0.965:  # the rest of a text, behind a link to it
                out.append(wrapped(hinted("more"), *(block("p", 1, 60, True) for _ in range(rng.randint(1, 3)))))
            else:
                out.append(noise())
        if not bare and rng.random() < 0.25:
            out.append(comments())
        return "".join(out)

    for _ in range(n):
        pair = rng.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), container(("div", "section")), container(("div", "article")), container(("div", "article"))))
        if (x := rng.random()) < 0.25:
            pair = ("<div>", "</div>") if x < 0.1 else ("", "")
        around = theme() if pair[0] not in ("", "<div>") and rng.random() < 0.25 else ("", "")
        page = ["<html><body>"]
        if rng.random() < 0.5:
            page.append(wrapped(rng.choice((("<header>", "</header>"), hinted("head"))), boxed(block(rng.choice(("p", "h1", "div")), 1, 10, False))))
        if rng.random() < 0.9:
            page.append(wrapped(rng.choice((("<nav>", "</nav>"), hinted("nav"))), links(rng.choice((0, 1, 2, 3, 5, 7, 9)))))
        page += [noise() for _ in range(rng.randint(0, 3))]
        inner = wrapped(pair, article(pair[0] in ("", "<div>")))
        page.append(wrapped(around, *([noise()] if around[0] and rng.random() < 0.4 else []), inner, *([comments()] if around[0] and rng.random() < 0.4 else [])))
        page += [noise() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.5:
            page.append(comments())
        if rng.random() < 0.9:
            page.append(wrapped(rng.choice((("<footer>", "</footer>"), ("<footer>", "</footer>"), hinted("foot"))), boxed(rng.choice(("&copy; ", "", "Copyright ")) + prose(2, 25)), links(rng.randint(0, 4)) if rng.random() < 0.4 else ""))
        blocks = leaf_blocks("".join(page))
        if blocks:
            yield [(f, ARTICLE if mark in t else OTHER) for t, f in blocks]


def design(pages: list) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the features, the (place, feature) pairs of all blocks, and the labels, -1 beyond a page's end."""
    names = {f: i for i, f in enumerate(sorted({f for p in pages for fs, _ in p for f in fs}))}
    longest = max(map(len, pages))
    rows, cols, y = [], [], np.full((len(pages), longest), -1)
    for i, p in enumerate(pages):
        for j, (fs, label) in enumerate(p):
            y[i, j] = label
            rows += [i * longest + j] * len(fs)
            cols += [names[f] for f in fs]
    return names, np.array(rows), np.array(cols), y


def gradient(w: np.ndarray, trans: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the log likelihood of all pages: what the labels hold of each feature and pair, less what the model expects."""
    real, longest = y >= 0, y.shape[1]
    both = real[:, :-1] & real[:, 1:]
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    unary = np.bincount(rows, weights=w[cols], minlength=y.size).reshape(y.shape)
    u = np.stack([np.zeros_like(unary), unary], axis=2)
    alpha, beta = np.zeros(u.shape), np.zeros(u.shape)
    alpha[:, 0] = u[:, 0]
    for t in range(1, longest):
        nxt = np.logaddexp(alpha[:, t - 1, 0:1] + trans[0], alpha[:, t - 1, 1:2] + trans[1]) + u[:, t]
        alpha[:, t] = np.where(real[:, t, None], nxt, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        x = u[:, t + 1] + beta[:, t + 1]
        prev = np.logaddexp(trans[:, 0] + x[:, 0:1], trans[:, 1] + x[:, 1:2])
        beta[:, t] = np.where(real[:, t + 1, None], prev, 0)
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
    p_article = np.exp(alpha + beta - log_z)[:, :, 1]
    edge = np.exp(alpha[:, :-1, :, None] + trans[None, None] + (u + beta)[:, 1:, None, :] - log_z[..., None])
    grad_w = np.bincount(cols, weights=((y == 1) - p_article).ravel()[rows] * real.ravel()[rows], minlength=len(w))
    return grad_w, gold_pairs - edge[both].sum(axis=0)


@lru_cache(maxsize=4)
def train(n: int = TRAIN_PAGES, seed: int = SEED, steps: int = 100, rate: float = 0.15, ridge: float = 1e-4) -> tuple[dict[str, float], tuple[float, float, float, float]]:
    """(weight of each feature for ARTICLE over OTHER, transition scores other-other, other-article, article-other, article-article)."""
    pages = list(labelled_pages(n, seed))
    names, rows, cols, y = design(pages)
    w, trans = np.zeros(len(names)), np.zeros((2, 2))
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        grad_w, grad_t = (g / len(pages) - ridge * v for g, v in zip(gradient(w, trans, rows, cols, y), (w, trans), strict=True))
        for k, (value, grad) in enumerate(((w, grad_w), (trans, grad_t))):
            moment[2 * k] += 0.1 * (grad - moment[2 * k])
            moment[2 * k + 1] += 0.01 * (grad * grad - moment[2 * k + 1])
            value += rate * (moment[2 * k] / (1 - 0.9**step)) / (np.sqrt(moment[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return {f: float(w[i]) for f, i in names.items()}, tuple(trans.ravel().tolist())


def viterbi(unary: list[float], trans: tuple[float, float, float, float]) -> list[int]:
    """The best states of a chain; unary: score of ARTICLE over OTHER. Ties go to ARTICLE."""
    if not unary:
        return []
    other, article = 0.0, unary[0]
    back = []
    for u in unary[1:]:
        a, b = (article + trans[2] >= other + trans[0]), (article + trans[3] >= other + trans[1])
        back.append((a, b))
        other, article = (article + trans[2] if a else other + trans[0]), (article + trans[3] if b else other + trans[1]) + u
    state = int(article >= other)
    out = [state]
    for pair in reversed(back):
        state = int(pair[state])
        out.append(state)
    return out[::-1]


def main_text(page: str | None, model: tuple[dict[str, float], tuple[float, float, float, float]]) -> str:
    blocks = leaf_blocks(page or "")
    weights, trans = model
    states = viterbi([sum(weights.get(f, 0.0) for f in fs) for _, fs in blocks], trans)
    return " ".join(text for (text, _), s in zip(blocks, states, strict=True) if s == ARTICLE)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add text and n_chars to pages, in place of the html and of columns of these names."""
    keep = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    model = pages.sparkSession.sparkContext.broadcast(train())
    source = fresh(pages, "_html")
    src = pages.select(*keep, pages[column].alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, model.value) for x in b.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return src.mapInArrow(run, extended(pages.select(*keep), "text string, n_chars long"))


def op1_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
