"""Main-text extraction with a recurrent block labeller (operator 5).

A page becomes the sequence of its leaf blocks in page order; a block's vector hashes its tag path (tags, classes, ids
and roles of its ancestors) and its words. A bidirectional LSTM in numpy reads the whole sequence, so that every block
is classified with document-wide context. The weights are trained on pages that `sample_page` composes, whose labels
hold by construction: some with telling class names, some with random ones or none. Training is seeded, so every run has
the same model.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_DIMS, EXTRA_DIMS, HIDDEN = 128, 5, 16
#: Blocks whose vectors exist at once.
PIECE = 16_384

#: Fixed values of the markup language. RAW elements hold no markup; the text of HIDDEN ones is not part of a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded semantics annotation svg g text tspan".split())
RAW = frozenset("script style textarea iframe".split())
HIDDEN_TAGS = frozenset("select datalist template".split())
CLOSES = {
    "p": "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "option": ["option"],
}
_SHUT_BY = {t: tuple(k for k, v in CLOSES.items() if t in v) for t in {t for v in CLOSES.values() for t in v}}
_WALLS = frozenset("ul ol dl table div section article main body".split())
_FLOWING = INLINE | MATH

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|[\"'][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_END_OF = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

#: What training pages call their parts: shells of menus, headers, footers, sidebars, notices, adverts, forms, comments, articles.
_CHROME = {
    "nav": ['<nav>%s</nav>', '<div class="menu">%s</div>', '<div id="navigation" role="navigation">%s</div>', '<div class="breadcrumbs">%s</div>'],
    "head": ['<header>%s</header>', '<div class="header">%s</div>', '<div id="masthead">%s</div>'],
    "foot": ['<footer>%s</footer>', '<div class="footer">%s</div>', '<div id="footer" role="contentinfo">%s</div>'],
    "side": ['<aside>%s</aside>', '<div class="sidebar">%s</div>', '<div id="sidebar">%s</div>', '<div class="related">%s</div>', '<section class="widget">%s</section>'],
    "note": ['<div class="cookie-notice">%s</div>', '<div class="notice">%s</div>', '<div class="banner" role="alert">%s</div>', '<div class="newsletter subscribe">%s</div>', '<div class="share social">%s</div>', '<noscript>%s</noscript>'],
    "ad": ['<div class="ad">%s</div>', '<div class="advert">%s</div>', '<div class="ads sponsored">%s</div>', '<div class="promo">%s</div>'],
    "form": ['<form>%s</form>', '<form class="search"><label>%s</label><button>Go</button></form>', '<div class="login"><form>%s</form></div>'],
    "talk": ['<section id="comments">%s</section>', '<div class="comments">%s</div>', '<ol class="comment-list"><li class="comment">%s</li></ol>', '<div class="comment reply">%s</div>'],
}
_MAIN = ['<article>%s</article>', '<main>%s</main>', '<main><article>%s</article></main>', '<div class="content">%s</div>', '<div class="post entry">%s</div>', '<div id="content" role="main">%s</div>', '<section class="article body">%s</section>', '<div class="text story">%s</div>']
_NAMES = sorted({w for shells in [*_CHROME.values(), _MAIN] for shell in shells for m in _ATTRIBUTE.finditer(shell) for w in _NAME.findall(m[2])})
_TAGS = sorted({*VOID, *_FLOWING, *_SHUT_BY, *_WALLS, *CLOSES, *"html head title body aside nav header footer figure figcaption blockquote pre form button label noscript h1 h2 h3 h4 h5 h6 span center caption thead tbody tfoot fieldset details summary".split()})
#: The place of each tag and name in the vector of a path; other tags share one place, other names have none.
_PLACE = {w: i for i, w in enumerate(["<", *("<" + t for t in _TAGS), *("." + n for n in _NAMES)])}
PATH_DIMS = len(_PLACE)
WIDTH = 2 * PATH_DIMS + WORD_DIMS + EXTRA_DIMS


def _hash(word: str, dims: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % dims


@lru_cache(maxsize=65_536)
def _places(tag: str, attributes: str) -> tuple[int, ...]:
    """Places of an element's tag and of its class, id and role words."""
    words = [w for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return (_PLACE.get("<" + tag, 0), *(_PLACE["." + w] for w in words if "." + w in _PLACE))


class _Element:
    """An open element: path counts the tags and names of all its ancestors and its own, each up to 2."""

    __slots__ = ("flowing", "hidden", "index", "open", "own", "path", "run", "tag", "wall")

    def __init__(self, tag: str, own: tuple[int, ...], above: _Element | None):
        self.tag, self.own, self.open = tag, own, True
        self.path = bytearray(above.path) if above else bytearray(PATH_DIMS)
        for k in own:
            self.path[k] = min(2, self.path[k] + 1)
        self.index = above.index + 1 if above else 0
        self.flowing = tag in _FLOWING
        self.run = (above.run if above else 0) + (not self.flowing)  # flowing elements of one run have one number
        self.wall = self.index if tag in _WALLS else above.wall if above else -1
        self.hidden = tag in HIDDEN_TAGS or (above.hidden if above else False)


class Block(NamedTuple):
    """A leaf block: tags and names on its path, its text, characters of it inside links, tag and names of its own element."""

    path: bytearray
    text: str
    linked: int
    own: tuple[int, ...]


_ROOT = _Element("", (), None)


def blocks(page: str) -> list[Block]:
    """Every leaf block that has text, in page order, in time linear in the page.

    Broken markup is read on: unclosed elements end with their parent, stray end tags are ignored, an unclosed comment,
    tag, script or style runs to the end of the page.
    """
    out: list[Block] = []
    stack = [_ROOT]
    alive: dict[str, list[_Element]] = {}
    held: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append(Block(stack[-1].path, text, linked, stack[-1].own))
            held.clear()
        linked = 0

    def drop(size: int) -> None:
        """Close the elements of the stack from this index on, and closed ones that then are on top."""
        while len(stack) > size or not stack[-1].open:
            gone = stack.pop()
            if gone.open:
                alive[gone.tag].pop()

    while at < len(page):
        m = _MARKUP.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not stack[-1].hidden:
            held.append(piece)
            if alive.get("a"):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not stack[-1].hidden:
                held.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        if tag == "br":
            held.append(" ")
            continue
        if m[1]:
            same = alive.get(tag)
            if not same:
                continue
            if tag in _FLOWING:
                if same[-1].run == stack[-1].run:  # not from outside of the block
                    same.pop().open = False
                    drop(len(stack))
            else:
                flush()
                drop(same[-1].index)
            continue
        if tag in RAW:
            end = _END_OF[tag].search(page, at)
            at = at if m[0].endswith("/>") else end.end() if end else len(page)
            continue
        empty = tag in VOID or tag in _FLOWING and m[0].endswith("/>")
        if tag not in _FLOWING:
            flush()
            if shut := max((alive[t][-1].index for t in _SHUT_BY.get(tag, ()) if alive.get(t)), default=0):
                if shut > stack[-1].wall:
                    drop(shut)
            while stack[-1].flowing:  # an unclosed inline element doesn't reach into the next block
                drop(len(stack) - 1)
        if not empty:
            stack.append(_Element(tag, _places(tag, m[3]), stack[-1]))
            alive.setdefault(tag, []).append(stack[-1])
    flush()
    return out


def vectors(page_blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row per block: its path, its own element, hashed words, lengths, link share, end of sentence, place in the page.

    The blocks may be a stretch of a page of `total` blocks that begins with number `first`.
    """
    x = np.zeros((len(page_blocks), WIDTH), np.float32)
    total = total or len(page_blocks)
    if page_blocks:
        x[:, :PATH_DIMS] = np.frombuffer(b"".join(b.path for b in page_blocks), np.uint8).reshape(-1, PATH_DIMS)
    for i, (_, text, linked, own) in enumerate(page_blocks):
        for k in own:
            x[i, PATH_DIMS + k] = 1
        words = text.lower().split(" ")
        share = 0.4 / math.sqrt(len(words))
        for w in words:
            x[i, 2 * PATH_DIMS + _hash(w, WORD_DIMS)] += share
        x[i, 2 * PATH_DIMS + WORD_DIMS :] = (math.log1p(len(words)) / 4, math.log1p(len(text)) / 6, min(1.0, linked / len(text)), text[-1] in ".!?…", (first + i + 1) / total)
    np.minimum(x, 3.0, out=x)
    return x


# -- the network -------------------------------------------------------------
def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _scan(drive: np.ndarray, mask: np.ndarray, w: dict, side: str, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, HIDDEN) of one direction from its inputs' products; masked steps carry the state on."""
    steps, batch, _ = drive.shape
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out, trace = np.zeros((steps, batch, HIDDEN), np.float32), [None] * steps
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = drive[t] + h @ w["wh" + side]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        now = f * c + i * g
        tanh = np.tanh(now)
        if keep:
            trace[t] = (h, c, i, f, o, g, tanh)
        c = m * now + (1 - m) * c
        h = m * o * tanh + (1 - m) * h
        out[t] = h
    return out, trace


def _drive(x: np.ndarray, w: dict, side: str) -> np.ndarray:
    return x @ w["wx" + side] + w["b" + side]


def forward(x: np.ndarray, mask: np.ndarray, w: dict) -> np.ndarray:
    """Logits (time, batch) that a block belongs to the main text."""
    return _logits([_drive(x, w, side) for side in "fb"], (x @ w["wo"][2 * HIDDEN :])[:, :, 0], mask, w)


def _logits(drives: list[np.ndarray], direct: np.ndarray, mask: np.ndarray, w: dict) -> np.ndarray:
    states = [_scan(d, mask, w, side)[0] @ w["wo"][k * HIDDEN : (k + 1) * HIDDEN] for k, (d, side) in enumerate(zip(drives, "fb", strict=True))]
    return states[0][:, :, 0] + states[1][:, :, 0] + direct + w["bo"]


def _long(page: list[Block], w: dict) -> np.ndarray:
    """forward() of one page whose vectors don't exist at once."""
    pieces = []
    for a in range(0, len(page), PIECE):
        x = vectors(page[a : a + PIECE], a, len(page))[:, None, :]
        pieces.append((*(_drive(x, w, side) for side in "fb"), (x @ w["wo"][2 * HIDDEN :])[:, :, 0]))
    f, b, direct = (np.concatenate(p) for p in zip(*pieces, strict=True))
    return _logits([f, b], direct, np.ones((len(page), 1), np.float32), w)[:, 0]


def _gradients(x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: dict) -> dict:
    steps = len(x)
    hf, tf = _scan(_drive(x, w, "f"), mask, w, "f", True)
    hb, tb = _scan(_drive(x, w, "b"), mask, w, "b", True)
    both = np.concatenate([hf, hb, x], axis=2)
    err = (_sigmoid((both @ w["wo"])[:, :, 0] + w["bo"]) - y) * mask / mask.sum()
    g = {"wo": np.einsum("tbk,tb->k", both, err)[:, None], "bo": err.sum()[None]}
    up = err[:, :, None] * w["wo"][None, None, :, 0]
    for side, trace, first in (("f", tf, 0), ("b", tb, HIDDEN)):
        wx, wh = np.zeros_like(w["wx" + side]), np.zeros_like(w["wh" + side])
        bias = np.zeros_like(w["b" + side])
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
            h, c, i, f, o, gg, tanh = trace[t]
            m = mask[t][:, None]
            dh = dh + up[t][:, first : first + HIDDEN]
            own = dh * m
            dn = dc * m + own * o * (1 - tanh**2)
            dz = np.concatenate([dn * gg * i * (1 - i), dn * c * f * (1 - f), own * tanh * o * (1 - o), dn * i * (1 - gg**2)], axis=1)
            wx += x[t].T @ dz
            wh += h.T @ dz
            bias += dz.sum(axis=0)
            dh = dz @ w["wh" + side].T + dh * (1 - m)
            dc = dn * f + dc * (1 - m)
        g |= {"wx" + side: wx, "wh" + side: wh, "b" + side: bias}
    return g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


# -- training pages ----------------------------------------------------------
_SYLLABLES = "ba con de er fi gra ho in jo ka lu men no or pra qui ra sto ti un ver wi xa yo zen ä é ñ".split()
_SAID = {
    "note": "we use cookies accept settings privacy policy subscribe newsletter sign up agree close enable javascript".split(),
    "ad": "sponsored advertisement buy now offer sale shop free trial learn more".split(),
    "talk": "reply said comment posted ago report like thanks great".split(),
    "foot": "copyright rights reserved terms privacy contact imprint".split(),
    "side": "related popular recent posts read more archive tags share follow".split(),
    "head": "home search login menu contact about".split(),
    "nav": "home news sport about contact next previous".split(),
    "form": "email password name search send submit".split(),
}


def sample_page(rng: random.Random, named: float = 0.65) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks (1: main text).

    Pages are named with a share of `named`: classes and ids say what an element is for. All others have random names or
    none, so that only tags, words, links, lengths and order tell their blocks apart.
    """
    speaks = rng.random() < named
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) + rng.choice(["", "-x", "__y", "2"])
    attributes = lambda: rng.choice(["", f' class="{name()}"', f' class="{name()} {name()}"', f' id="{name()}"'])

    def words(low: int, high: int, kind: str = "") -> str:
        own = _SAID.get(kind)
        pick = lambda: rng.choice(own) if own and rng.random() < 0.4 else word()
        return " ".join(pick() + rng.choice(["", "", "", ",", " |", "&amp;", "!!"]) for _ in range(rng.randint(low, high)))

    def wrapped(inner: str, most: int = 3) -> str:
        for _ in range(rng.randint(0, most)):
            tag = rng.choice(["div", "div", "div", "section", "span-box", "center"])
            inner = f"<{tag}{attributes()}>{inner}</{tag}>"
        return inner

    def shell(kind: str) -> str:
        if speaks or kind == "form":
            return rng.choice(_CHROME[kind])
        return wrapped(f"<div{attributes()}>%s</div>", 2).replace("%s", "\0").replace("%", "%%").replace("\0", "%s")

    def chrome(kind: str) -> tuple[str, int]:
        around = shell(kind)
        if kind == "nav" or kind in ("side", "foot", "head") and rng.random() < (0.4 if speaks else 0.8):
            n = rng.randint(1 if speaks else 3, 9)
            item, of = rng.choice([("<li%s><a href='/%s'>%s</a></li>", "<ul%s>%s</ul>"), ("<div%s><a href='/%s'>%s</a></div>", "<div%s>%s</div>"), ("<p%s><a href='/%s'>%s</a></p>", "<div%s>%s</div>")])
            if speaks:
                item, of = "<li%s><a href='/%s'>%s</a></li>", "<ul%s>%s</ul>"
            own = "" if speaks else attributes()
            return around % (of % (own, "".join(item % (own, i, words(1, 4 if kind != "side" else 9, kind)) for i in range(n)))), n
        if kind == "form":
            return around % words(1, 6, kind), 2 if "<button>" in around else 1
        if kind == "foot" and rng.random() < 0.6 or kind == "foot" and not speaks:
            return around % (rng.choice(["&copy; ", "&copy; 2024 ", ""] if speaks else ["&copy; "]) + words(2, 60 if speaks else 20, kind) + rng.choice(["", "."])), 1
        if kind == "talk" and not speaks:
            n = rng.randint(1, 5)
            return around % ("<h3>%s</h3>" % rng.choice(["Comments", f"{n} comments"]) + "".join(f"<div{(a := attributes())}><div><a href='#'>{words(1, 2)}</a> {i} hours ago</div><p>{words(2, 30, kind)}</p><div><a href='#'>Reply</a></div></div>" for i in range(n))), 1 + 3 * n
        if kind in ("note", "ad") and not speaks:
            return around % (words(2, 14, kind) + f"<div><a href='/go'>{words(1, 2, kind)}</a></div>"), 2
        if kind in ("side", "head") and not speaks:
            n = rng.randint(1, 4)
            return around % (f"<h4>{words(1, 2, kind)}</h4>" + "".join(f"<div><a href='/x'>{words(2, 9)}</a></div>" for _ in range(n))), n + 1
        n = rng.randint(1, 4)
        inner = "".join(rng.choice(["<p>%s.</p>", "<div>%s</div>", "<p><a href='#'>%s</a></p>", "<h3>%s</h3><!-- x -->"]) % words(2, 40 if kind in ("talk", "side") else 15, kind) for _ in range(n))
        if n == 1 and rng.random() < 0.7:
            inner = words(1, 40, rng.choice([kind, ""])) + rng.choice(["", "."])
        return around % inner, n

    def story() -> tuple[str, int]:
        parts, n = [], 0
        if rng.random() < 0.8 or not speaks:
            parts.append(f"<h1{attributes() if not speaks else ''}>{words(2, 12)}</h1>")
            n += 1
        body = rng.choice(["p", "p", "p", "div"]) if not speaks else "p"
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 30])):
            kind = rng.random()
            if kind < 0.02:  # a line that repeats
                k = rng.randint(2, 20)
                parts.append(f"<p>{words(1, 3)}.</p>" * k)
                n += k
                continue
            if kind < 0.7:
                form = rng.choice(["<p>%s.</p>", "<p><b>%s.<br>", "<p>%s", "<p><em>%s</em>.</p>", "<p>%s <a href='/x'>x</a>.</p>", "<p>%s <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p>"] if body == "p" else ["<div>%s.</div>"])
                parts.append(form % words(1 if speaks else 6, 120))
            elif kind < 0.8:
                parts.append("<h{0}>{1}</h{0}>".format(rng.randint(2, 4), words(1, 8)))
            elif kind < 0.9:
                k = rng.randint(1, 4)
                parts.append("<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(k)) + "</ul>")
                n += k - 1
            else:
                parts.append(rng.choice(["<blockquote>%s</blockquote>", "<pre>%s</pre>", "<table><tr><td>%s</td></tr></table>", "<div>%s</div>", "<figure><figcaption>%s</figcaption></figure>"]) % words(2, 40))
            n += 1
        return "".join(parts), n

    page, labels = [f"<!DOCTYPE html><html><head><title>{words(2, 12)}</title><script>x='</p>'</script></head><body>"], [0]
    for kind in rng.sample(["nav", "head", "note", "ad", "form", "side"], rng.randint(0 if speaks else 1, 4)):
        text, n = chrome(kind)
        page.append(text)
        labels += [0] * n
    inner, n = story()
    own = [1] * n
    for _ in range(rng.choice([0, 0, 1, 2]) if speaks else 0):  # chrome within the article's element, after or between its blocks
        extra, k = chrome(rng.choice(["ad", "note", "talk", "nav", "form", "side"]))
        more, j = story() if rng.random() < 0.5 else ("", 0)
        inner, own = inner + extra + more, own + [0] * k + [1] * j
    if speaks:
        page.append(rng.choice(_MAIN) % inner)
    else:
        head, _, rest = inner.partition("</h1>")
        page.append(wrapped(head + "</h1>" + wrapped(rest, 2), 3))
    labels += own
    for kind in rng.sample(["talk", "side", "ad", "foot", "foot", "nav"], rng.randint(0, 4)):
        text, n = chrome(kind)
        page.append(text)
        labels += [0] * n
    return "".join(page) + "</body></html>", labels


@lru_cache(maxsize=2)
def train(pages: int = 800, epochs: int = 12, seed: int = 7) -> dict:
    """Weights after Adam with falling steps on composed pages whose blocks and labels agree in number."""
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    data = []
    while len(data) < pages:
        page, labels = sample_page(draw)
        own = blocks(page)
        if len(own) == len(labels):
            data.append((vectors(own), np.array(labels, np.float32)))
    w = {"wo": rng.normal(0, 0.1, (2 * HIDDEN + WIDTH, 1)), "bo": np.zeros(1)}
    for side in "fb":
        w |= {"wx" + side: rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)), "wh" + side: rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)), "b" + side: np.zeros(4 * HIDDEN)}
        w["b" + side][HIDDEN : 2 * HIDDEN] = 1
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    data.sort(key=lambda d: len(d[1]))
    groups = [data[i : i + 40] for i in range(0, len(data), 40)]
    for _ in range(epochs):
        for j in rng.permutation(len(groups)):
            x, mask = _padded([d[0] for d in groups[j]])
            y = np.zeros(mask.shape, np.float32)
            for k, d in enumerate(groups[j]):
                y[: len(d[1]), k] = d[1]
            step += 1
            for k, g in _gradients(x, mask, y, w).items():
                g = np.clip(g, -1, 1) + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] = (w[k] - 0.02 * (1 - step / (epochs * len(groups) + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def label(pages: list[list], w: dict, cells: int = 60_000) -> list[np.ndarray]:
    """Booleans per block: main text or not. Pages are batched by length, at most about `cells` blocks at once."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order and len(pages[order[-1]]) > PIECE:
        out[order[-1]] = _long(pages[order[-1]], w) > 0
        order.pop()
    at = 0
    while at < len(order):
        take = max(1, min(len(order) - at, 256))
        while take > 1 and take * len(pages[order[at + take - 1]]) > cells:
            take //= 2
        pick = order[at : at + take]
        logits = forward(*_padded([vectors(pages[i]) for i in pick]), w)
        for j, i in enumerate(pick):
            out[i] = logits[: len(pages[i]), j] > 0
        at += take
    return out


def extract(html: Column, spark) -> Column:
    """The main text of each whole page: its labelled blocks in page order, joined by an empty line.

    Null, empty and blank pages give the empty text. Equal pages have equal texts. A very long page takes time in proportion
    to its length and memory of some 600 bytes a block.
    """
    shared = spark.sparkContext.broadcast(train())  # weights of fixed size

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for array in batches:
            texts: list[str] = []
            for at in range(0, len(array), 512):
                pages = [blocks(p) if p else [] for p in array.slice(at, 512).to_pylist()]
                texts += ["\n\n".join(b[1] for b, keep in zip(p, own, strict=True) if keep) for p, own in zip(pages, label(pages, w), strict=True)]
            yield pa.array(texts, pa.string())

    return run.asNondeterministic()(html)  # evaluated once, also where its length is asked for


def extract_pages(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """df with the main text of each page and its length in code points. Columns of these names are replaced; rows that
    repeat stay as they are, an empty table gives an empty one."""
    return df.withColumn(text, extract(F.col(html), df.sparkSession)).withColumn("n_chars", F.length(text).cast("long"))
