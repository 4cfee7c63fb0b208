"""Main text of web pages by a linear-chain conditional random field.

A page's leaf blocks (text between block-level tags) form the chain.  A block's features are
its ancestors' tags, kinds of words in their class and id, and form of its text.  Weights are
fitted by maximum likelihood on labelled pages, a fixed number that `labelled_pages` makes
from layouts of all sorts; a page is decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, short_batches

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")
_RAW = frozenset("script style noscript template textarea svg iframe object select title".split())
#: Of these the text is not markup, so an unclosed one runs to the page's end; an unclosed other one is passed over.
_RAW_TEXT = frozenset("script style textarea iframe title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_TAGS = "article main nav header footer aside form ul ol li p h1 h2 h3 h4 h5 h6 table td th blockquote pre figure figcaption section div dialog a button b dl dd address details".split()
#: Kinds of class and id words.
_KINDS = {
    "ad": r"\bads?\b|advert|sponsor|promo|banner",
    "comment": r"comment|disqus|repl(?:y|ies)|discussion",
    "menu": r"\bnav|menu|breadcrumb|toolbar|\btabs?\b|pagination|pager",
    "side": r"side-?bar|aside|widget|related|recommend|\brail\b|trending",
    "foot": r"foot|copyright|legal",
    "head": r"\bheader\b|masthead|\btop-?bar|\blogo\b|site-title",
    "notice": r"cookie|consent|notice|alert|modal|popup|gdpr|overlay|paywall",
    "form": r"form|search|login|signup|subscribe|newsletter",
    "share": r"share|social|follow",
    "body": r"article|content|\bpost\b|entry|story|\bbody\b|\bmain\b|\btext\b",
}
_KINDS = {k: re.compile(v, re.I) for k, v in _KINDS.items()}
_NAMES = (
    ["bias", "first", "last", "short", "medium", "long", "stop", "mark", "links", "some_links", "digits", "separators"]
    + [f"in_{t}" for t in _TAGS] + [f"own_{t}" for t in _TAGS] + [f"kind_{k}" for k in _KINDS] + [f"near_{k}" for k in _KINDS]
)
_PLACE = {n: i for i, n in enumerate(_NAMES)}


def _words_of(attributes: str) -> str:
    return " ".join(" ".join(filter(None, m)) for m in _ATTR.findall(attributes)) if attributes else ""


@lru_cache(maxsize=4096)
def _kinds_of(words: str) -> tuple[str, ...]:
    return tuple(k for k, p in _KINDS.items() if p.search(words)) if words else ()


class _Tags:
    """Ends of tags, each found in time that its own length bounds."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def end(self, at: int) -> int:
        """Place behind the tag's ">" outside quotes, or 0 if there is none.

        A quote that nothing closes, or a tag that quotes keep open to the page's end, ends at
        the first ">"; after one such tag quotes are no longer heeded.
        """
        page, k = self.page, at
        if at > self.last[">"]:
            return 0
        while self.quotes:
            found = _STOP.search(page, k)
            if not found:
                self.quotes = False
            elif found[0] == ">":
                return found.end()
            elif found.start() >= self.last[found[0]]:
                break
            else:
                k = page.index(found[0], found.end()) + 1
        return page.index(">", at) + 1


def blocks(page: str) -> list[tuple[str, list[int]]]:
    """(text, features) of the leaf blocks in page order; blank ones are left out.

    Time is in proportion to the page: an open element holds the features of all its
    ancestors, so none are walked, and only void elements close themselves.
    """
    out: list[tuple[str, list[int]]] = []
    stack: list[tuple[str, frozenset, frozenset]] = []  # tag, features of it and all above, kinds of its own
    places: dict[str, list[int]] = {}
    text: list[str] = []
    linked = 0
    begun: tuple = ()
    unclosed: set[str] = set()

    def close() -> None:
        nonlocal linked, begun
        flat = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if flat:
            out.append((flat, _features(flat, begun, linked)))
        text.clear()
        linked, begun = 0, ()

    def cut(depth: int) -> None:
        for tag, _, _ in stack[depth:]:
            places[tag].pop()
        del stack[depth:]

    def add(piece: str) -> None:
        nonlocal linked, begun
        if not text or not begun:
            begun = tuple(stack[-2:])
        text.append(piece)
        if places.get("a"):
            linked += len(piece.strip())

    at, end, tags = 0, len(page), _Tags(page)
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            add(page[at:stop])
            at = stop
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?") and at < tags.last[">"]:
            at = page.index(">", at) + 1
            continue
        name = _NAME.match(page, at)
        stop = tags.end(name.end()) if name else 0
        if not stop:
            add("<")
            at += 1
            continue
        tag, attributes = name[1].lower(), page[name.end() : stop - 1]
        closing = page[at + 1] == "/"
        at = stop
        if closing:
            if tag not in _INLINE:
                close()
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in _RAW:
            if tag in unclosed or (tag == "svg" and attributes.endswith("/")):
                continue
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if found:
                at = found.end()
            elif tag in _RAW_TEXT:
                at = end
            else:
                unclosed.add(tag)
            continue
        if tag == "br":
            text.append(" ")
        if tag not in _INLINE:
            close()
            if places.get("p") and tag not in _VOID:
                cut(places["p"][0])
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                cut(len(stack) - 1)
        if tag not in _VOID:
            kinds = frozenset(_kinds_of(_words_of(attributes)))
            own = {f"in_{tag}", *(f"kind_{k}" for k in kinds)}
            above = stack[-1][1] if stack else frozenset()
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, above if own <= above else above | (own & _PLACE.keys()), kinds))
    close()
    return out


def _features(flat: str, ancestors: tuple, linked: int) -> list[int]:
    n = flat.count(" ") + 1
    names = {"bias", "short" if n < 6 else "medium" if n < 20 else "long"}
    if flat[-1] in ".!?…\"”»":
        names.add("stop")
    if flat[0] in "©®" or "©" in flat:
        names.add("mark")
    share = linked / max(1, len(flat))
    if share > 0.6:
        names.add("links")
    elif share > 0.1:
        names.add("some_links")
    if sum(c.isdigit() for c in flat[:40]) > 8:
        names.add("digits")
    if " | " in flat or " · " in flat or " » " in flat:
        names.add("separators")
    if ancestors:
        names |= ancestors[-1][1]
        names.add(f"own_{ancestors[-1][0]}")
        for _, _, kinds in ancestors:
            names.update(f"near_{k}" for k in kinds)
    return sorted(_PLACE[x] for x in names if x in _PLACE)


def labelled_pages(n: int = 320, seed: int = 11) -> list[tuple[list[list[int]], list[int]]]:
    """(features, labels) of n made pages; a label is 1 for a block of the main text."""
    rng = random.Random(seed)
    syllables = "an ber co del en fi gra hu in jo ka li mo nu or pe qui ra so ti un ve wa xi yo zu".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + "."

    def phrase(high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(1, high)))

    def pick(*of: str) -> str:
        return rng.choice(of)

    def prose(p: str = "p") -> str:
        body = " ".join(sentence(1, 16) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.2:
            body = f'{body} <a href="/x">{word()}</a> {sentence(2, 9)}'
        if rng.random() < 0.15:
            body = f"<b>{body}<br>"
            return f"<{p}>{body}"
        return f"<{p}>{body}</{p}>"

    def links(m: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{phrase(3)}</a></li>' for i in range(m)) + "</ul>"

    good, bad = "\x01", "\x02"

    def main() -> str:
        parts = [f"<h1>{phrase(9)}</h1>"] + [prose() for _ in range(rng.randint(1, 9))]
        for extra in (f"<h2>{phrase(5)}</h2>", f"<blockquote>{prose()}</blockquote>", f"<ul><li>{sentence(3, 9)}</li><li>{sentence(3, 9)}</li></ul>",
                      f"<ol><li>{phrase(8)}</li></ol>", f"<table><tr><td>{word()}</td><td>{word()}</td></tr></table>", f"<pre>{sentence(3, 9)}</pre>",
                      f"<section>{prose()}</section>", f"<div>{prose()}</div>", f"<figure><figcaption>{sentence(3, 8)}</figcaption></figure>", f"<h3>{phrase(4)}</h3>"):
            if rng.random() < 0.22:
                parts.insert(rng.randint(1, len(parts)), extra)
        for junk in (
            f'<div class="{pick("ad", "advert", "sponsored", "promo-box")}">{sentence(2, 12)}</div>', f'<aside class="{pick("related", "sidebar", "widget")}">{sentence(2, 12)}{links(3)}</aside>',
            f'<div class="{pick("share", "social-links")}">{links(3)}</div>', f'<form class="{pick("newsletter", "subscribe-form", "search")}">{phrase(6)} <button>{word()}</button></form>',
            f'<div class="{pick("notice", "alert", "cookie-banner")}">{sentence(3, 12)}</div>', f'<section class="{pick("comments", "comment-list", "discussion")}"><h3>{phrase(2)}</h3><p>{sentence(3, 14)}</p><p>{sentence(3, 14)}</p></section>',
            f'<header><span>{phrase(4)}</span></header>', f'<footer>{phrase(6)}</footer>', f"<aside><p>{sentence(4, 16)}</p></aside>", f"<nav>{links(3)}</nav>",
        ):
            if rng.random() < 0.12:
                parts.insert(rng.randint(1, len(parts)), bad + junk + good)
        return good + "".join(parts) + bad

    def outside(kind: str) -> str:
        return {
            "nav": lambda: f"<nav>{links(rng.randint(2, 8))}</nav>",
            "menu": lambda: f'<div class="{pick("menu", "navbar", "top-menu", "breadcrumb")}">{links(rng.randint(2, 8))}</div>',
            "header": lambda: f'<{(t := pick("header", "div"))} class="{pick("header", "masthead", "site-header")}"><p>{phrase(5)}</p><a href="/">{word()}</a></{t}>',
            "ad": lambda: f'<div class="{pick("ad", "ads", "advert", "ad-slot", "sponsor")}">{" ".join(sentence(1, 9) for _ in range(rng.randint(1, 4)))}</div>',
            "side": lambda: f'<{(t := pick("aside", "div"))} class="{pick("sidebar", "widget", "related")}"><h4>{phrase(3)}</h4>{links(3)}<p>{sentence(4, 18)}</p></{t}>',
            "notice": lambda: f'<div class="{pick("cookie", "notice", "consent", "alert")}"><p>{sentence(4, 18)}</p><button>{word()}</button></div>',
            "form": lambda: f'<form><label>{phrase(3)}</label><p>{sentence(2, 9)}</p><button>{word()}</button></form>',
            "comments": lambda: f'<{(t := pick("div", "section"))} class="{pick("comments", "comment-thread", "replies")}"><h3>{phrase(2)}</h3>' + "".join(f'<div class="comment"><b>{word()}</b><p>{sentence(4, 20)}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{t}>",
            "foot": lambda: f'<{(t := pick("footer", "div"))} class="{pick("footer", "site-footer")}">&copy; {word()}.example &middot; {sentence(3, 12)}{links(2) if rng.random() < 0.4 else ""}</{t}>',
            "foot2": lambda: f"<footer>&copy; {word()} &middot; {sentence(3, 12)}</footer>",
        }[kind]()

    pages = []
    for _ in range(n):
        head = [k for k in ("header", "notice", "nav", "menu", "ad", "form") if rng.random() < 0.4]
        tail = [k for k in ("ad", "side", "comments", "form", "notice", "nav") if rng.random() < 0.4] + [pick("foot", "foot2")]
        box = pick('article', 'article', 'main', 'div class="content"', 'div id="main-content"', 'div class="post entry"', 'section class="story"')
        body = "".join(map(outside, head)) + f"<{box}>{main()}</{box.split()[0]}>" + "".join(map(outside, tail))
        if rng.random() < 0.3:
            body = f'<div class="{pick("page", "wrapper", "container")}">{body}</div>'
        # The marks switch the label and are not text: they are cut before features are made.
        state, features, labels = 0, [], []
        for flat, own in blocks(re.sub("([\x01\x02])", r"<hr>\1<hr>", body)):
            if flat in (good, bad):
                state = int(flat == good)
            else:
                features.append(own)
                labels.append(state)
        pages.append((features, labels))
    return pages


@lru_cache(maxsize=1)
def train(n: int = 320, steps: int = 220, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and transitions (2, 2) of greatest likelihood, by Adam."""
    pages = [p for p in labelled_pages(n) if p[0]]
    longest = max(len(f) for f, _ in pages)
    x = np.zeros((len(pages), longest, len(_NAMES)))
    y = np.zeros((len(pages), longest), int)
    mask = np.zeros((len(pages), longest), bool)
    for i, (features, labels) in enumerate(pages):
        for t, own in enumerate(features):
            x[i, t, own] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    flat, onehot = x.reshape(-1, len(_NAMES)), np.eye(2)[y]
    both = mask[:, 1:, None, None] * (onehot[:, :-1, :, None] * onehot[:, 1:, None, :])
    w, a = np.zeros((len(_NAMES), 2)), np.zeros((2, 2))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, a)]
    for step in range(1, steps + 1):
        s = (flat @ w).reshape(len(pages), longest, 2)
        forward, backward = np.empty_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        for t in range(1, longest):
            new = s[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + a, axis=1)
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(a[None] + (s[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None, None]
        own = np.exp(forward + backward - total) * mask[..., None]
        pair = np.exp(forward[:, :-1, :, None] + a + (s[:, 1:] + backward[:, 1:])[:, :, None, :] - total[..., None]) * mask[:, 1:, None, None]
        grads = (
            flat.T @ ((onehot * mask[..., None] - own).reshape(-1, 2)) / len(pages) - decay * w,
            (both - pair).sum(axis=(0, 1)) / len(pages) - decay * a,
        )
        for p, g, (m, v) in zip((w, a), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, a


def viterbi(features: list[list[int]], w: np.ndarray, a: np.ndarray) -> list[int]:
    """The best labels of a page's blocks; ties go to label 0."""
    if not features:
        return []
    (a00, a01), (a10, a11) = a.tolist()
    back: list[tuple[int, int]] = []
    z = o = 0.0
    for t, own in enumerate(features):
        s0, s1 = w[own].sum(axis=0).tolist()
        if t:
            from0, from1 = int(o + a10 > z + a00), int(o + a11 > z + a01)
            back.append((from0, from1))
            z, o = s0 + (o + a10 if from0 else z + a00), s1 + (o + a11 if from1 else z + a01)
        else:
            z, o = s0, s1
    path = [int(o > z)]
    for pair in reversed(back):
        path.append(pair[path[-1]])
    return path[::-1]


def main_text(page: str, w: np.ndarray, a: np.ndarray) -> str:
    found = blocks(page)
    labels = viterbi([f for _, f in found], w, a)
    return "\n\n".join(t for (t, _), y in zip(found, labels, strict=True) if y)


def html_extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", training_pages: int = 320) -> DataFrame:
    """Adds text_col, the main text: its blocks in page order, joined by two line ends.

    Null or empty html, or none found: an empty string.  Broken markup is read as far as it
    goes, and very long pages in time in proportion to their length.  A column called text_col
    is replaced; each row gives one; repeated rows are read alike; empty: empty.
    """
    short_batches(pages.sparkSession)
    pages = pages.drop(text_col)
    w, a = train(training_pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py() or "", w, a) for x in batch.column(batch.schema.names.index(html_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return pages.mapInArrow(run, extended(pages.schema, f"`{text_col}` string"))
