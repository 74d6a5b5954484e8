"""HTML extraction: flat text blocks, classified by a decision tree on densities of a block and its neighbours.

A page becomes a flat list of text blocks: runs of text between block-level tags (and line breaks). Features of a
block: its words, its share of words inside links, the same of the blocks before and after it, the words of the
largest block nearby, whether it is a heading, whether it ends like a sentence, and what the elements around it are
named after, if anything (navigation, article, footer and the like). A CART tree, trained on the small labelled table
below, keeps the blocks of the main text: where names say nothing, word counts and link densities decide, and they
overrule a name that merely hints at content. Scripts, styles, comments, and what browsers don't show never become
blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.common import frugal

# Element names of HTML and their roles.
BLOCK = frozenset("address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video audio".split())
#: Elements whose content is never text of the page; the first four hold no markup and end only at their end tag.
TEXT_ONLY = frozenset("script style textarea title".split())
RAW = TEXT_ONLY | frozenset("noscript template svg math iframe object canvas select button noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("title meta link base script style noscript template".split())
OUT = frozenset("nav footer aside form menu dialog fieldset header head".split())
IN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names that name a role, words that may stand beside them, and those that make them something else.
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header hidden legal masthead menu modal nav navbar navigation newsletter notice notification popup promo promoted related reply replies respond share sharing sidebar signup sitemap social sponsor sponsored subscribe subscription toolbar widget widgets".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
IN_WORDS = frozenset("article body content entry main post story text".split())
BESIDE = frozenset("area article author bar block blog body bottom box buttons col column container content entry gdpr global group holder icons inner item items left links list main module outer page panel post posts primary reader right row secondary section site slot story text thread top unit user wrap wrapper".split())
MODIFIERS = frozenset("has is no non not on with without".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
#: Roles as the tree sees them.
OUTSIDE, UNKNOWN, HINTED, INSIDE = -1.0, 0.0, 0.5, 1.0
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*$")


@lru_cache(maxsize=4096)
def named_role(name: str) -> tuple[float, bool]:
    """(role, whether it is readers' comments) that one class or id name gives: all its parts must be role words or
    words that go beside them, so that "cookie-notice" and "footer-7" are outside, "legal-news" and "has-sidebar" not."""
    parts = _PART.findall(name)
    telling = [p for p in parts if p not in BESIDE]
    if not parts or MODIFIERS & set(parts):
        return UNKNOWN, False
    if telling and all(p in OUT_WORDS for p in telling):
        return OUTSIDE, not COMMENTS.isdisjoint(telling)
    return (HINTED, False) if not telling and not IN_WORDS.isdisjoint(parts) else (UNKNOWN, False)


def _role(tag: str, name: str) -> tuple[float, bool]:
    """(role, hard) of a start tag; a hard one holds for an article in it too."""
    if name in IN:
        found, hard = INSIDE, False
    elif name in OUT:
        found, hard = OUTSIDE, name in ("nav", "footer", "aside", "dialog", "menu")
    else:
        found, hard = UNKNOWN, False
    if len(tag) > len(name) + 2:
        seen = {}
        for key, *values in _ATTR.findall(tag, len(name) + 1):
            seen.setdefault(key.lower(), next((v for v in values if v), "").lower())
        if "hidden" in seen or seen.get("aria-hidden") == "true" or _UNSEEN.search(seen.get("style", "")):
            return OUTSIDE, True
        if name in ("html", "body"):
            return UNKNOWN, False
        if seen.get("role") in OUT_ROLES:
            return OUTSIDE, True
        if seen.get("role") in IN:
            found = INSIDE
        for one in (*seen.get("class", "").split(), *seen.get("id", "").split()):
            role, readers = named_role(one)
            if readers or role == OUTSIDE and found != INSIDE:
                return OUTSIDE, True
            if role == HINTED and found == UNKNOWN:
                found = HINTED
    return found, hard


def _standing(open_: list[tuple[str, float, bool]]) -> float:
    """The role of text inside the open elements: the innermost that says something, but an article in a hard outside
    element is outside, and a header in an article is its own, not the site's."""
    for i in range(len(open_) - 1, -1, -1):
        name, role, hard = open_[i]
        if role == OUTSIDE and not (name == "header" and not hard and any(r == INSIDE for _, r, _ in open_[:i])):
            return OUTSIDE
        if role == INSIDE:
            return OUTSIDE if any(h for _, _, h in open_[:i]) else INSIDE
    return HINTED if any(r == HINTED for _, r, _ in open_) else UNKNOWN


def blocks(page: str) -> list[tuple[str, int, int, float, int]]:
    """(text, words, words in links, role, heading) of each block with text."""
    out: list[tuple[str, int, int, float, int]] = []
    open_: list[tuple[str, float, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    role, heading, in_link = UNKNOWN, 0, False

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                links = len(html.unescape(" ".join(linked)).split())
                out.append((text, len(text.split()), links, role, heading))
            parts.clear()
            linked.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            if in_link:
                linked.append(page[at:end])
        if not m:
            break
        tag, at = m.group(), m.end()
        name = _NAME.match(tag)
        if not name:
            continue
        name, shut, alone = name.group(1).lower(), tag[1] == "/", tag.endswith("/>")
        if name in BLOCK:
            close()
        if shut:
            # an end tag closes the nearest open element of its name; one without a start is skipped
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
        else:
            if name not in HEAD_ONLY and any(x[0] == "head" for x in open_):  # its end tag may be left out
                open_ = open_[: [x[0] for x in open_].index("head")]
            if name in RAW and not (alone and name not in TEXT_ONLY):
                stop = re.compile(rf"</{name}(?=[\s>/]|$)", re.I).search(page, at)
                if stop or name in TEXT_ONLY:
                    cut = page.find(">", stop.start()) if stop else -1
                    at = cut + 1 if cut >= 0 else n
                    continue
            if name not in VOID and not alone:
                if name in ("p", "li") and open_ and open_[-1][0] == name:
                    open_.pop()
                open_.append((name, *_role(tag, name)))
        role = _standing(open_)
        heading = int(any(x[0] in HEADINGS for x in open_[-3:]))
        in_link = any(x[0] == "a" for x in open_)
    close()
    return out


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "largest_near", "role", "heading", "sentence")


def block_features(page: list[tuple[str, int, int, float, int]]) -> np.ndarray:
    n = len(page)
    words = np.array([b[1] for b in page], float)
    density = np.array([b[2] for b in page], float) / np.maximum(words, 1)
    pad = lambda x, k: np.concatenate([np.zeros(max(k, 0)), x, np.zeros(max(-k, 0))])[max(-k, 0) : max(-k, 0) + n] if n else x
    near = np.max([pad(words, k) for k in (-2, -1, 0, 1, 2)], axis=0) if n else words
    ends = np.array([b[0].rstrip("\"'”’»)")[-1:] in ".!?…:" for b in page], float)
    return np.column_stack([words, density, pad(words, 1), pad(density, 1), pad(words, -1), pad(density, -1), near, [b[3] for b in page], [b[4] for b in page], ends]) if n else np.zeros((0, len(FEATURES)))


#: The labelled table: one line a page, its blocks in order as elements[.class]:words(s: ends as a sentence, l: all in
#: links, m: half in links) and + for main text, - for the rest. Written by hand after common page layouts; half of
#: the pages have no telling names, and some names mislead.
LABELLED = (
    "nav:6l- h1:8+ p:60s+ p:45s+ p:3s+ p:80s+ footer:9-",
    "nav>li:1l- nav>li:1l- nav>li:2l- div.ad:8s- article>h1:7+ article>p:90s+ article>p:2s+ article>p:1s+ article>p:150s+ footer:12s-",
    "header:4- article>p:1+ article>p:4+ article>p:30s+ article>p:12+ aside:25s- aside:6l- footer:20s-",
    "div.menu:9l- div.content:70s+ div.content:20s+ div.comments:35s- div.comments:60s- div.footer:14-",
    "div.cookie-notice:30s- h1:6+ p:40s+ li:9+ li:11+ li:8s+ p:55s+ form:5- form:14s-",
    "p:4l- p:2l- p:120s+ h2:4+ p:70s+ p:3l- p:5l- p:2-",
    "div:5l- div:50s+ div:65s+ div:12s+ div.sidebar:40s- div.related:10l- div:4-",
    "main>h1:5+ main>p:25s+ main>p:3+ main>p:9l+ main>p:33s+ div.newsletter:18s- footer:30s- footer:5l-",
    "article>h1:10+ article>p:16l+ article>p:400s+ article>p:1+ article>td:2+ article>td:2+ section.comments:80s- section.comments:2l- section.comments:55s-",
    "header:9s- header:25s- nav:20- p:35s+ p:28s+ aside:90s- p:44s+ footer:60s-",
    "div:2l- div:1- div:3- p:22s+ p:31s+ p:18+ div:2- div:1l-",
    "div.post:5+ div.post:75s+ div.ad:40s- div.ad:70s- div.post:40s+ div.share:4l- div.share:6-",
    "li:1l- li:1l- li:2l- li:1l- h1:9+ p:45s+ p:52s+ p:7s+ p:38s+ li:6l- li:8l- li:7l- li:9l- p:5-",
    "div:3- div:2l- div:2l- div:4l- h1:6+ div:60s+ div:44s+ h2:3+ div:80s+ div:12l- div:11l- div:14l- div:9-",
    "div.content:7l- div.content:9l- div.content:8l- div.content:11l- div.content:65s+ div.content:48s+ div.content:6l- div.content:10l-",
    "div.main:2l- div.main:3l- div.main>h1:7+ div.main:90s+ div.main:8s+ div.main:34s+ div.main:12l- div.main:14l-",
    "td:1l- td:1l- td:1l- td:110s+ td:35s+ td:70s+ td:2l- td:2l- td:6-",
    "p:12m- p:9m- p:8m- h1:5+ p:55s+ p:40s+ p:14m+ p:61s+ p:10m- p:13m- p:9m-",
    "div.text:3l- div.text:4l- div.text:5l- p:30s+ p:26s+ p:41s+ div.text:7l- div.text:9l- div:3-",
    "div:20l- div:18l- div:25l- div:75s+ div:33s+ div:90s+ div:30l- div:22l- div:8-",
    "h2:3l- p:6l- h2:4l- p:8l- p:7l- p:58s+ p:47s+ p:64s+ h2:3l- p:9l- p:6l-",
    "article>p:25s+ article>li:4l+ article>li:6l+ article>li:5l+ article>p:37s+ aside:35s- nav:4l-",
    "div:1- div:1l- div:1l- div:2l- p:200s+ p:180s+ p:15s+ p:220s+ div:1l- div:2- div:3-",
    "article>h1:3+ article>p:8+ article>p:5s+ article>p:2+ footer:5-",
    "nav:5l- article>p:1+ article>p:2s+",
    "nav>li:1l- nav>li:3l- div.ad:12s- article>h1:12+ article>p:6+ article>p:9+ article>p:14s+",
    "main>h1:2+ main>p:7s+ main>p:1+ main>p:4s+",
    "article>h1:5+ article>p:18s+ article>p:70s+",
    "article>p:3+ article>p:1l+ article>p:2+ footer:30s-",
    "article>h1:4+ article>p:30s+ article>p:6+",
    "nav:4l- article>p:13+ article>p:2+ article>p:1+",
    "main>p:20s+ main>li:5+ main>li:3+ p:4-",
    "p:12s+",
    "div:9s+",
    "p:14s+ p:11s+",
    "h1:4+ p:35s+ p:60s+ p:40s+",
    "div:1l- div:2l- h1:7+ div:28s+ div:90s+",
    "li:2l- li:2l- h1:3+ p:50s+ p:3s+ p:25s+",
    "h1:6+ p:15s+ p:19s+ p:11s+ p:2- p:1l-",
    "div:1l- div:1l- div:3l- h2:5+ div:18s+ div:14s+ div:16s+ div:3-",
    "div.story>h1:8+ div.story:42s+ div.story:5s+ div.story:9s+ div.story:70s+ div.promo:22s- div.story:31s+ div.subscribe:16s-",
)


def _labelled() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in LABELLED:
        rows = []
        for block in page.split():
            tags, pattern = block[:-1].split(":")
            k = int(re.match(r"\d+", pattern).group())
            open_ = []
            for element in tags.split(">"):
                name, _, cls = element.partition(".")
                open_.append((name, *_role(f'<{name} class="{cls}">' if cls else f"<{name}>", name)))
            links = k if "l" in pattern else (k + 1) // 2 if "m" in pattern else 0
            rows.append(("word " * (k - 1) + ("word." if "s" in pattern else "word"), k, links, _standing(open_), int(open_[-1][0] in HEADINGS)))
            y.append(int(block[-1] == "+"))
        x.append(block_features(rows))
    return np.concatenate(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2):
    """A CART tree by Gini impurity: (feature, threshold, low side, high side) or a leaf's share of ones."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
            if least <= i <= len(y) - least:
                a, b = ones[i - 1] / i, (ones[-1] - ones[i - 1]) / (len(y) - i)
                cost = i * a * (1 - a) + (len(y) - i) * b * (1 - b)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, (v[i] + v[i - 1]) / 2)
    if best is None:
        return float(y.mean())
    _, f, at = best
    low = x[:, f] <= at
    return f, at, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@lru_cache(maxsize=1)
def trained_tree():
    return grow(*_labelled())


def classify(x: np.ndarray, tree=None) -> np.ndarray:
    tree = trained_tree() if tree is None else tree
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, at, low, high = tree
    out, side = np.empty(len(x)), x[:, f] <= at
    out[side], out[~side] = classify(x[side], low), classify(x[~side], high)
    return out


def main_text(page: str | None) -> str:
    """The main text of a whole page: its kept blocks joined by one space; empty if the page is null, empty or has none."""
    if not page:
        return ""
    page = _CUT_TAG.sub("", page)  # a page cut within a tag
    flat = blocks(page)
    keep = classify(block_features(flat)) >= 0.5
    return " ".join(b[0] for b, k in zip(flat, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; rows are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    few = pages.select("page_id", "url", "html")
    return few.mapInArrow(frugal(run), few.drop("html").schema.add("text", "string").add("n_chars", "long"))
