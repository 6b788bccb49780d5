"""Operator 4: main text of web pages by a decision tree over flat text blocks.

A page is cut into flat blocks at block-level tags. A block is described by its words and link density, those of
its two neighbours on either side, its own tag, and whether an open container names itself as article or as
something else (menu, advert, comments, form...). A decision tree, trained on a small labelled table of pages
built by a rule, says which blocks are main text; those are joined in page order.

Nulls: a null or empty page has an empty text. Scripts, styles, titles, templates, text areas and the like that
are never closed are read as browsers do: the rest of the page belongs to them. A head needs no end tag, as what can
stand in it has no text of the page. A button, list of choices or drawing that is never closed ends at the next tag of
a block. Repeated rows are read each; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sievework.llm.common import table, texts_of

#: Tags that end an element of phrases that was left open.
_BREAK = r"</?(?:address|article|aside|blockquote|body|center|d[dlt]|details|div|fieldset|figcaption|figure|footer|form|h[1-6r]|header|hgroup|html|li|main|menu|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?=[\s/>])"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(?:svg|math)\b[^>]*/>"
    r"|<(svg|object|select|button|math|canvas)\b[^>]*>(?:(?:(?!<\2\b).)*?</\2\s*>|.*?(?:</\2\s*>|(?=" + _BREAK + r")|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KINDS = {"p": 1, "blockquote": 1, "pre": 1, **{f"h{i}": 2 for i in range(1, 7)}, "li": 3, "dd": 3, "dt": 3, "td": 4, "th": 4, "figcaption": 4, "caption": 4}
_APART = frozenset("nav footer aside form menu dialog fieldset".split())
_BODY = frozenset("article main".split())
_PAGE = frozenset("html head body".split())
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_APART_NAMES = re.compile(r"(?<![a-z])(?:ads?|adverts?|advertisements?|banner|breadcrumbs?|captcha|comments?|comment-list|consent|contentinfo|cookies?|copyright|discussion|disqus|dialog|footer|form|gdpr|legal|login|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|recommended|related|replies|reply|responses|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|tags|toolbar|topbar|widget|alert|complementary)(?![a-z])", re.I)
_HEAD_NAMES = re.compile(r"(?<![a-z])(?:header|masthead)(?![a-z])", re.I)
_BODY_NAMES = re.compile(r"(?<![a-z])(?:article|articlebody|article-body|body-text|content|entry|main|post|post-body|story|text)(?![a-z])", re.I)
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("apart", "body", "kind", "linked", "text", "words")

    def __init__(self, text: str, linked: int, kind: int, body: bool, apart: bool):
        self.text, self.kind, self.body, self.apart = text, kind, body, apart
        self.words = text.count(" ") + 1
        self.linked = min(1.0, linked / self.words)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    held: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open containers: tag, in an article, in something else
    kind, link = 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                _, body, apart = stack[-1] if stack else ("", False, False)
                out.append(Block(text, linked, kind, body, apart))
            held.clear()
            linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if link:
                linked += len(text.split())

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[4] or m[7] or "").lower()
        if not tag:
            if m[1] or m[2]:
                held.append(" ")
            continue
        closing, attributes = bool(m[3] or m[6]), m[5] or m[8] or ""
        if tag == "a":
            link = not closing
        elif tag == "br":
            held.append(" ")
        elif tag not in _INLINE:
            flush()
            link = False
            kind = 0 if closing else _KINDS.get(tag, 0)
            if tag in _VOID or tag in _KINDS and "=" not in attributes and not closing:
                continue
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            else:
                _, body, apart = stack[-1] if stack else ("", False, False)
                names = " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)).replace("_", "-")
                outside = tag in _APART or bool(names and _APART_NAMES.search(names)) or (not body and (tag == "header" or bool(names and _HEAD_NAMES.search(names))))
                inside = tag in _BODY or bool(names and _BODY_NAMES.search(names))
                stack.append((tag, (body or inside) and tag not in _PAGE, (apart or outside) and tag not in _PAGE))
    say(page[at:])
    flush()
    return out


FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "words_before2", "words_after2", "kind", "body", "apart", "sign", "stop", "page_body")
_SIGN = re.compile(r"[©®]|\(c\) \d{4}|all rights reserved", re.I)


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    n = len(found)
    words = np.array([0, 0, *[b.words for b in found], 0, 0], float)
    linked = np.array([0, 0, *[b.linked for b in found], 0, 0], float)
    own = np.array([(b.kind, b.body, b.apart, _SIGN.search(b.text) is not None, b.text[-1] in ".!?…:;\"”»") for b in found], float).reshape(n, 5)
    body = np.full((n, 1), float(any(b.body for b in found)))
    near = [words[2 : n + 2], linked[2 : n + 2], words[1 : n + 1], linked[1 : n + 1], words[3 : n + 3], linked[3 : n + 3], words[:n], words[4 : n + 4]]
    return np.hstack([np.stack(near, 1).reshape(n, 8), own, body])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4) -> list:
    """A decision tree by Gini impurity: [feature, limit, at most limit, above] or the share of label 1."""
    share = float(y.mean())
    if not depth or len(y) < 2 * least or share in (0.0, 1.0):
        return [share]
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (at <= len(y) - least)]
        if len(at):
            p, q = ones[at - 1], ones[-1] - ones[at - 1]
            cost = p * (1 - p / at) + q * (1 - q / (len(y) - at))
            i = int(np.argmin(cost))
            if cost[i] < best[0]:
                best = (cost[i], f, float((v[at[i] - 1] + v[at[i]]) / 2))
    if best[1] < 0:
        return [share]
    low = x[:, best[1]] <= best[2]
    return [best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)]


def predict(tree: list, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(node) == 1:
            out[rows] = node[0]
        else:
            low = x[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


MARK = "\x02"


def labelled_pages(n: int = 240, seed: int = 7) -> list[str]:
    """The small labelled table: pages of varied layouts whose main-text blocks begin with MARK."""
    rng = np.random.default_rng(seed)

    def some(low: int, high: int, stop: bool = True) -> str:
        k = int(np.exp(rng.uniform(np.log(low), np.log(high))))
        words = ["".join(rng.choice(list("aeioulnrstdmc"), rng.integers(2, 10))) for _ in range(k)]
        return " ".join(words).capitalize() + ("." if stop else "")

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{some(1, 3, rng.random() < 0.2)}</a></li>' for i in range(rng.integers(low, high))) + "</ul>"

    def apart() -> list[str]:
        return [
            f"<aside><h3>{some(1, 4, False)}</h3>{links(2, 6)}<p>{some(4, 30)}</p></aside>",
            f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "banner"])}">{some(2, 30)}</div>',
            f'<div class="{rng.choice(["cookie-notice", "consent", "notice", "newsletter", "promo"])}"><p>{some(5, 40)}</p> <a href="/x">{some(1, 3, False)}</a></div>',
            f"<form><label>{some(1, 4, False)}</label><input name=q><p>{some(3, 14)}</p></form>",
            f'<div class="sidebar"><h3>{some(1, 3, False)}</h3>{links(3, 7)}</div>',
            f'<div class="share"><a href="/1">{some(1, 2, False)}</a> <a href="/2">{some(1, 2, False)}</a></div>',
            f"<div>{some(1, 4, False)} <a href='/r'>{some(2, 8, False)}</a> <a href='/s'>{some(2, 8, False)}</a></div>",
        ]

    def paragraph() -> str:
        text = some(1, 120)
        kind = rng.random()
        if kind < 0.08:
            return f"<h2>{MARK}{some(1, 8, False)}</h2>"
        if kind < 0.14:
            return "<ul>" + "".join(f"<li>{MARK}{some(2, 25)}</li>" for _ in range(rng.integers(2, 5))) + "</ul>"
        if kind < 0.18:
            return f"<blockquote>{MARK}{text}</blockquote>"
        if kind < 0.3:
            return f'<p>{MARK}{text} <a href="/z">{some(1, 4, False)}</a> {some(2, 30)}</p>'
        return f"<p>{MARK}{'<b>' * (kind > 0.9)}{text}" + ("</p>" if rng.random() < 0.85 else "<br>")

    pages = []
    for _ in range(n):
        layout = rng.random()
        inner = f"<h1>{MARK}{some(2, 14, False)}</h1>" + "".join(paragraph() + (str(rng.choice(apart()[:6])) if rng.random() < 0.06 else "") for _ in range(rng.integers(1, 14)))
        if layout < 0.45:
            inner = f"<article>{inner}</article>"
        elif layout < 0.6:
            inner = f"<main>{inner}</main>"
        elif layout < 0.8:
            inner = f'<div class="{rng.choice(["content", "post", "entry-content", "story"])}">{inner}</div>'
        else:
            inner = f"<div>{inner}</div>"
        parts = []
        if rng.random() < 0.5:
            parts.append(f"<header><div>{some(1, 5, False)}</div>{links(0, 4)}</header>")
        if rng.random() < 0.85:
            parts.append(f"<nav>{links(3, 9)}</nav>" if rng.random() < 0.7 else links(3, 9))
        parts += [str(x) for x in rng.choice(apart(), rng.integers(0, 3))]
        parts.append(inner)
        parts += [str(x) for x in rng.choice(apart(), rng.integers(0, 3))]
        if rng.random() < 0.35:
            parts.append(f'<{"section" if rng.random() < 0.5 else "div"} class="comments"><h3>{some(1, 3, False)}</h3>' + "".join(f"<p>{some(3, 80)}</p>" for _ in range(rng.integers(1, 5))) + "</section></div>")
        if rng.random() < 0.85:
            parts.append(f"<footer>&copy; {some(1, 3, False)} &middot; {some(3, 25)}</footer>" if rng.random() < 0.8 else f"<div>&copy; {some(1, 4, False)} {links(0, 3)}</div>")
        pages.append("<html><body>" + "".join(parts) + "</body></html>")
    return pages


def labelled_table(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        for b in found:
            y.append(float(MARK in b.text))
            b.text = b.text.replace(MARK, "").strip() or " "
        x.append(features(found))
    return np.vstack(x), np.array(y)


@cache
def trained() -> tuple[list]:
    return (grow(*labelled_table(labelled_pages())),)


def extract(page: str, tree: list) -> str:
    found = blocks(page)
    if not found:
        return ""
    main = predict(tree, features(found)) >= 0.5
    return "\n\n".join(b.text for b, keep in zip(found, main, strict=True) if keep)


def main_texts(pages: DataFrame, tree: list) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                texts = [extract(h, tree) for h in texts_of(part, "html")]
                keep = [part.column(part.schema.get_field_index(c)) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"), trained()[0])


QUERIES = {"op4_html_extraction": op4}
