"""Operator 9. Main text of web pages by a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's elements by how they nest.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag (left) ends an open element (right) unless one of BARRIERS is between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
BARRIERS = frozenset("article aside body div dl figure footer form header html main nav ol section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([A-Za-z][^\s/>]*)[^>]*>"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([A-Za-z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
#: Words of class, id and role that say what an element is for.
PURPOSES = {
    "ad": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion adsense adslot",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip",
    "head": "header head masthead topbar titlebar site-title logo branding",
    "foot": "footer foot copyright legal contentinfo colophon imprint",
    "side": "sidebar side aside widget widgets related recommended recommendations complementary rail trending popular more teaser",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe subscription paywall dialog disclaimer warning message",
    "comment": "comment comments commentlist disqus reply replies respond discussion reactions responses",
    "form": "form search searchbox login signup signin register contact",
    "share": "share sharing social follow tags tag meta byline author bio",
    "content": "content article post entry story main body text articlebody post-content entry-content prose page-content",
}
PURPOSE = {w: k for k, words in PURPOSES.items() for w in words.split()}


#: What elements are for by themselves.
MEANING = {"nav": "nav", "menu": "nav", "header": "head", "head": "head", "footer": "foot", "aside": "side", "form": "form", "dialog": "notice", "noscript": "notice", "article": "content", "main": "content"}


@dataclass(slots=True)
class Around:
    """An open element, with what all elements around a text say: block tags and links, purposes, the innermost purpose and block."""

    tag: str
    tags: frozenset[str]
    purposes: frozenset[str]
    inner: str
    block: str

    def within(self, tag: str, own: frozenset[str]) -> Around:
        """An element inside this one. Sets are shared while nothing is added, so depth costs nothing."""
        counts = tag in BLOCK or tag == "a"
        tags = self.tags | {tag} if counts and tag not in self.tags else self.tags
        purposes = self.purposes if own <= self.purposes else self.purposes | own
        says = {*own, MEANING.get(tag, "")} - {""}
        return Around(tag, tags, purposes, min(says - {"content"} or says) if says else self.inner, tag if counts else self.block)


@dataclass(slots=True)
class Leaf:
    """Text between two block boundaries: decoded, one space for white space; what is around it; characters inside links."""

    text: str
    around: Around
    linked: int


def _purposes(attributes: str) -> frozenset[str]:
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            for w in value.split():
                for part in (w, *re.split(r"[-_]+", w)):
                    if part in PURPOSE:
                        found.add(PURPOSE[part])
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            found.add("hidden")
    return frozenset(found)


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks of a page in order, without empty ones; scripts, styles, text fields and comments give none.

    Time follows the page's length however broken it is: a tag's end is looked for only before the last
    `>`, open elements are found by their tag, and what is around a text is kept on the stack.
    """
    out: list[Leaf] = []
    stack = [Around("", frozenset(), frozenset(), "nothing", "")]
    places: dict[str, list[int]] = {}  # of open elements, by tag
    barriers: list[int] = [0]
    pieces: list[str] = []
    linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            pieces.append(t)
            linked += len(t) * bool(places.get("a"))

    def flush() -> None:
        nonlocal linked, pieces
        if pieces:
            t = " ".join("".join(pieces).split())
            if t:
                out.append(Leaf(t, stack[-1], linked))
            pieces, linked = [], 0

    def close(k: int) -> None:
        if any(x.tag in BLOCK for x in stack[k:]):
            flush()
        for x in stack[k:]:
            places[x.tag].pop()
            if x.tag in BARRIERS:
                barriers.pop()
        del stack[k:]

    at, last = 0, page.rfind(">") + 1
    while m := TOKEN.search(page, at, last):
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if places.get(tag):
                close(places[tag][-1])
            elif tag in BLOCK:
                flush()
            continue
        if not (tag := (m[2] or m[4] or "").lower()):
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
                break
            continue
        attributes = m[3] or m[5] or ""
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                if not at:
                    at = len(page)
                    break
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        k = max((places[t][-1] for t in (*ENDS.get(tag, ()), "p" if tag in BLOCK else "") if places.get(t)), default=-1)
        if k > (barriers[-2] if tag == "body" and stack[barriers[-1]].tag == "html" else barriers[-1]):
            close(k)
        if tag in BLOCK:
            flush()
        if tag not in VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in BARRIERS:
                barriers.append(len(stack))
            stack.append(stack[-1].within(tag, _purposes(attributes)))
    rest = page[at:]
    text(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    flush()
    return out


def feature_row(b: Leaf) -> list[str]:
    """Of a block: its ancestors' tags, their purposes, and what its text is like."""
    words, around = b.text.count(" ") + 1, b.around
    row = ["bias", "inside " + around.inner, *[f"in {t}" for t in around.tags], *[f"for {p}" for p in around.purposes], f"tag {around.block}"]
    share = b.linked / max(1, len(b.text))
    row.append("links " + ("none" if not b.linked else "some" if share < 0.5 else "most"))
    row.append(f"words {min(6, words.bit_length())}")
    row.append("stop" if b.text[-1] in ".!?:;\"'”’…)" else "open")
    if re.search("©|copyright|all rights reserved|cookie", b.text, re.I):
        row.append("says legal")
    return row


def features(blocks: list[Leaf]) -> list[list[str]]:
    return [feature_row(b) for b in blocks]


# ---------------------------------------------------------------- labelled pages

_SYLLABLES = "an ba co de er fi go ha in jo ka lu me no on pa qui ra si te un ver wo ya zu é ß ñ".split()
#: Pages that the model learns from, and passes of its optimiser.
LABELLED_PAGES, PASSES = 600, 240


def labelled_pages(n: int = LABELLED_PAGES, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Pages of many layouts with invented words, and for each leaf block whether it is main text.

    Layouts mark the article by elements, by classes and ids, or not at all; they put menus, headers,
    adverts, notices, forms, related links and reader comments around the article and some inside it,
    and leave end tags out as real pages do.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))

    def words(a: int, b: int) -> str:
        style = r.random()
        ws = [word() for _ in range(r.randint(a, b))]
        ws[0] = ws[0].title()
        if style < 0.08:
            ws = [w.upper() + "!!" for w in ws]
        elif style < 0.16:
            ws = [w + r.choice(("###", "***", "%%%", "$$$")) for w in ws]
        return " ".join(ws)

    pages = []
    for _ in range(n):
        labels: list[bool] = []
        keep: list[bool] = [False]

        def leaf(a: int, b: int, stop: bool = False) -> str:
            labels.append(keep[-1])  # noqa: B023
            return words(a, b) + "." * (stop and r.random() < 0.75)

        def boiler(make) -> str:
            keep.append(False)  # noqa: B023
            s = make()
            keep.pop()  # noqa: B023
            return s

        def links(a: int, b: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/{word()}">{leaf(1, 3)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

        def marked(tag: str, purpose: str) -> str:
            w = r.choice(PURPOSES[purpose].split())
            return f'{tag} {r.choice(("class", "id", "class", "id", "role"))}="{r.choice(("", "site-", "c-", "box "))}{w}"'

        def around(purpose: str) -> str:
            tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "comment": "section", "notice": "div", "ad": "div", "share": "div"}[purpose]
            tag = "noscript" if purpose == "notice" and r.random() < 0.3 else tag if r.random() < 0.6 else r.choice(("div", "section"))
            bare = tag == "noscript" or tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.7
            inner = {
                "nav": lambda: links(2, 7),
                "head": lambda: (f"<h1>{leaf(1, 4)}</h1>" if r.random() < 0.5 else "") + f"<p>{leaf(2, 8)}</p>",
                "foot": lambda: f"&copy; {leaf(2, 9, True)}" if r.random() < 0.6 else f"<p>{leaf(3, 14, True)}</p>",
                "side": lambda: f"<h3>{leaf(1, 3)}</h3>" + (links(2, 5) if r.random() < 0.6 else f"<p>{leaf(5, 40, True)}</p>"),
                "form": lambda: f"<label>{leaf(1, 4)}</label><input name=q><button>{leaf(1, 2)}</button>",
                "comment": lambda: "".join(f"<div><b>{word()}</b> <p>{leaf_after()}</p></div>" for _ in range(r.randint(1, 5))),
                "notice": lambda: f"<p>{leaf(5, 25, True)}</p>" if r.random() < 0.5 else leaf(4, 18, True),
                "ad": lambda: leaf(3, 14, True),
                "share": lambda: links(2, 4) if r.random() < 0.5 else leaf(2, 6),
            }[purpose]

            def leaf_after() -> str:
                labels.append(False)  # noqa: B023  the name before the <p> is a block of its own
                return leaf(4, 40, True)

            return boiler(lambda: f"<{tag if bare else marked(tag, purpose)}>{inner()}</{tag}>")

        def article() -> str:
            s = f"<{r.choice(('h1', 'h1', 'h2'))}>{leaf(1, 12)}</h1>" if r.random() < 0.85 else ""
            s = s.replace("</h1>", "</h2>") if s.startswith("<h2") else s
            for _ in range(r.randint(1, 9)):
                x = r.random()
                if x < 0.7:
                    s += f"<p>{leaf(1, 90, True)}" + ("</p>" if r.random() < 0.8 else "")
                elif x < 0.76:
                    s += f"<p><b>{leaf(2, 40, True)}<br>"
                elif x < 0.82:
                    s += f"<h{(k := r.randint(2, 4))}>{leaf(1, 6)}</h{k}>"
                elif x < 0.88:
                    s += "<ul>" + "".join(f"<li>{leaf(1, 20, True)}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
                elif x < 0.90:
                    s += f"<blockquote>{leaf(4, 30, True)}</blockquote>"
                elif x < 0.91:
                    s += f"<table><tr><td>{leaf(1, 4)}</td><td>{leaf(1, 6)}</td></tr></table>"
                else:
                    s += around(r.choice(("ad", "ad", "side", "share", "form", "notice", "nav", "comment")))
            if r.random() < 0.12:
                s += around("comment")
            if r.random() < 0.08:
                s += around("foot")
            return s

        if r.random() < 0.12:  # a fragment
            keep.append(True)
            pages.append((f"<article>{article()}</article>", labels))
            continue
        s = "<!DOCTYPE html><html><head>"
        if r.random() < 0.9:
            s += boiler(lambda: f"<title>{leaf(1, 12)}</title>")
        s += "<style>p{margin:0}</style></head><body>"
        for p, chance in (("head", 0.4), ("nav", 0.8), ("notice", 0.25), ("ad", 0.5), ("form", 0.15), ("share", 0.1)):
            if r.random() < chance:
                s += around(p)
        keep.append(True)
        x = r.random()
        if x < 0.6:
            s += f"<{'main' if (m := r.random() < 0.2) else 'article'}>{article()}</{'main' if m else 'article'}>"
        elif x < 0.68:  # a page laid out as a table
            bar = boiler(lambda: f"<{marked('td', r.choice(('nav', 'side', 'ad')))}>{links(1, 6)}</td>") if r.random() < 0.8 else ""
            s += f"<table><tr>{bar}<{marked('td', 'content') if r.random() < 0.6 else 'td'}>{article()}</td></tr></table>"
        elif x < 0.90:
            s += f"<{marked(r.choice(('div', 'section')), 'content')}><div>{article()}</div></div>"
        else:
            s += f"<div>{article()}</div>"
        keep.pop()
        for p, chance in (("share", 0.15), ("comment", 0.35), ("side", 0.4), ("ad", 0.25), ("nav", 0.1), ("notice", 0.1), ("foot", 0.85)):
            if r.random() < chance:
                s += around(p)
        s += "</body></html>" if r.random() < 0.8 else ""
        pages.append((s, labels))
    return pages


@dataclass
class Crf:
    """Two labels; weights of features for main text, of label pairs, and of the first label."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]

    def decode(self, rows: Iterable[list[str]]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi; none for no blocks."""
        get = self.weights.get
        off, on = self.start
        back: list[tuple[bool, bool]] = []
        i = -1
        for i, row in enumerate(rows):
            own = sum(get(f, 0.0) for f in row)
            if i:
                (a, b), (c, d) = self.pairs
                back.append((off + a < on + c, off + b < on + d))
                off, on = max(off + a, on + c), max(off + b, on + d)
            on += own
        if i < 0:
            return []
        labels = [on > off]
        for x in reversed(back):
            labels.append(x[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[bool]]], passes: int = PASSES, l2: float = 1e-4) -> Crf:
    """Weights of the greatest conditional likelihood, by full-batch gradient steps over padded pages."""
    names = sorted({f for rows, _ in pages for row in rows for f in row})
    index = {f: i for i, f in enumerate(names)}
    n, t = len(pages), max(len(rows) for rows, _ in pages)
    x = np.zeros((n, t, len(names)), np.float32)
    y, mask = np.zeros((n, t), np.int64), np.zeros((n, t))
    for i, (rows, labels) in enumerate(pages):
        for j, (row, label) in enumerate(zip(rows, labels, strict=True)):
            x[i, j, [index[f] for f in row]] = 1
            y[i, j], mask[i, j] = label, 1
    flat = x.reshape(n * t, -1)
    both, on = mask[:, 1:] * mask[:, :-1], mask.T > 0
    w, pair, start = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    seen_pair = np.array([[(both * ((y[:, :-1] == a) & (y[:, 1:] == b))).sum() for b in (0, 1)] for a in (0, 1)])
    seen_start = np.array([(y[:, 0] == a).sum() for a in (0, 1)])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, pair, start)]
    for step in range(1, passes + 1):
        own = np.ones((t, n, 2))
        own[:, :, 1] = np.exp(np.clip((flat @ w.astype(np.float32)).reshape(n, t).T, -50, 50)) * on + ~on
        step_on, step_off = np.exp(pair), np.eye(2)
        forward, backward = np.ones((t, n, 2)), np.ones((t, n, 2))
        forward[0] = np.exp(start) * own[0]
        for j in range(1, t):
            f = np.where(on[j, :, None], forward[j - 1] @ step_on, forward[j - 1] @ step_off) * own[j]
            forward[j] = f / f.sum(1, keepdims=True)
        for j in range(t - 2, -1, -1):
            g = own[j + 1] * backward[j + 1]
            g = np.where(on[j + 1, :, None], g @ step_on.T, backward[j + 1])
            backward[j] = g / g.sum(1, keepdims=True)
        p = forward * backward
        p = (p / p.sum(2, keepdims=True)).transpose(1, 0, 2)
        joint = forward[:-1, :, :, None] * step_on * (own * backward)[1:, :, None, :]
        joint = joint / joint.sum((2, 3), keepdims=True) * on[1:, :, None, None]
        grads = [flat.T @ ((y - p[:, :, 1]) * mask).reshape(-1) / n - l2 * w, (seen_pair - joint.sum((0, 1))) / n - l2 * pair, (seen_start - p[:, 0].sum(0)) / n - l2 * start]
        for value, grad, (m, v) in zip((w, pair, start), grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(dict(zip(names, w.tolist(), strict=True)), tuple(map(tuple, pair.tolist())), tuple(start.tolist()))  # type: ignore[arg-type]


@lru_cache(1)
def model() -> Crf:
    """The model of this module's labelled pages, the same in every process."""
    return fit([(features(leaves(s)), labels) for s, labels in labelled_pages()])


def main_text(page: str | None, crf: Crf) -> str:
    """The page's main text: its blocks in order, one space between; empty if it has none."""
    blocks = leaves(page or "")
    return " ".join(b.text for b, on in zip(blocks, crf.decode(map(feature_row, blocks)), strict=True) if on)


def extracted(df: DataFrame, page: str = "html", crf: Crf | None = None) -> DataFrame:
    """df without its html, with text (string, empty if none) and n_chars (long, code points).

    The model is some hundred weights, fitted on the driver from a fixed number of generated pages, and
    each page is done by itself, in time that follows its length. Null and empty pages have an empty text;
    broken markup is read as it stands; text in math, svg, object, iframe, template and noscript elements
    is text like any other, which the model judges; repeated rows are done alike; an empty table gives an empty one. Columns of df named text or
    n_chars are replaced.
    """
    crf = crf or model()

    @F.pandas_udf("string")
    def read(pages):
        return pages.map(lambda p: main_text(p, crf))

    keep = [f"`{c}`" for c in df.columns if c not in (page, "text", "n_chars")]
    d = df.select(*keep, read(F.coalesce(F.col(page).cast("string"), F.lit(""))).alias("text"))
    return d.withColumn("n_chars", F.length("text").cast("bigint"))


def op9_crf_blocks(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
