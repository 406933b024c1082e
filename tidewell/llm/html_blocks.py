"""Main text of HTML pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks.  Each block is read as a vector of its tag path (tags, class and id
words, hashed), its words (hashed) and a few measures; a bidirectional LSTM in numpy reads the whole sequence and labels
every block as article or not.  The network is trained here, on pages generated from many layouts."""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that never hold text blocks, that have no end tag, that stay inside a block, and end tags
# that may be left out (an opening tag on the left closes an open one on the right).
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "select", "textarea", "head", "title", "annotation", "annotation-xml"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
# Elements of formulas, which stand within a line
INLINE |= set("math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mspace mpadded mphantom menclose merror annotation annotation-xml".split())
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTED = re.compile(r"[>\"']")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Tags of a page whose quotes may go wrong before its quotes are no longer heeded.
BROKEN = 8
LABELS = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label|hidden|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"[\s ]+")


TAG_BITS, WORD_BITS, MEASURES = 256, 32, 8
INPUT = TAG_BITS + WORD_BITS + MEASURES
HIDDEN = 16


class _Slots(dict):
    """Hashed places of words, remembered."""

    def __init__(self, size: int, clean):
        self.size, self.clean = size, clean

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(self.clean(word), 5) % self.size
        return found


_TAG_SLOT, _WORD_SLOT = _Slots(TAG_BITS, str), _Slots(WORD_BITS, lambda w: w.lower().strip(".,:;!?"))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, "") and ("open" or "close", tag, attributes) in page order; comments, declarations and what silent
    elements hold are left out.  Broken markup never raises, and each character is looked at a bounded number of times."""
    at, n, broken, cdata = 0, len(page), 0, True
    while at < n:
        start = page.find("<", at)
        if start < 0 or (close := page.find(">", start)) < 0:
            yield "text", page[at:] if not page.startswith("<!--", start) or start < 0 else page[at:start], ""
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            yield "text", page[at:start], ""
            at = n if end < 3 else end
            continue
        if cdata and page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            cdata = end >= 0
            if cdata:
                yield "text", page[at:start], ""
                at = end + 3
                continue
        if page[start + 1] in "!?":
            yield "text", page[at:start], ""
            at = close + 1
            continue
        back = page[start + 1] == "/"
        name = NAME.match(page, start + 1 + back)
        if not name:
            yield "text", page[at : start + 1], ""
            at = start + 1
            continue
        yield "text", page[at:start], ""
        if broken < BROKEN:
            k = name.end()
            while (m := QUOTED.search(page, k)) and m[0] != ">":
                k = page.find(m[0], m.end()) + 1
                if not k:
                    break
            if m and k:
                close = m.start()
            else:
                broken += 1
        tag, rest = name[0].lower(), page[name.end() : close]
        at = close + 1
        yield "close" if back else "open", tag, rest
        if not back and tag in RAW and tag in SILENT:
            end = ENDS[tag].search(page, at)
            yield "close", tag, ""
            at = end.end() if end else n


class _Stack:
    """The open elements, with what blocks need to know of them kept as counts."""

    def __init__(self):
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}  # of each tag, where it is open
        self.outer: list[int] = []  # where elements are open that are not inline
        self.counts = [0] * TAG_BITS
        self.slots = self.depth = self.silent = 0  # slots: a bit for each place with a count

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        k = len(self.open)
        self.open.append((tag, names))
        self.at.setdefault(tag, []).append(k)
        self.silent += tag in SILENT
        if tag not in INLINE:
            self.outer.append(k)
            self._count(tag, names, 1)

    def _count(self, tag: str, names: tuple[str, ...], by: int) -> None:
        self.depth += by * (1 + len(names))
        for w in (tag, *names):
            k = _TAG_SLOT[w]
            self.counts[k] += by
            if self.counts[k] == (by > 0):  # from or to none
                self.slots ^= 1 << k

    def pop(self) -> None:
        tag, names = self.open.pop()
        self.at[tag].pop()
        self.silent -= tag in SILENT
        if tag not in INLINE:
            self.outer.pop()
            self._count(tag, names, -1)

    def last(self, tags) -> int:
        """Where the innermost of some elements is open, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def blocks(page: str | None) -> list[tuple[str, bytes, int, int]]:
    """(text, places of the path, elements of the path, characters in links) of each leaf block in page order.  The path has
    the open tags and, after a dot, the words of their class, id and role.  Text of silent elements is left out."""
    out, stack, parts, linked = [], _Stack(), [], 0

    def flush():
        nonlocal parts, linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        if text:
            out.append((text, stack.slots.to_bytes(TAG_BITS // 8, "little"), stack.depth, linked))
        parts, linked = [], 0

    def pop(upto: int):
        if stack.outer and stack.outer[-1] >= upto:
            flush()
        while len(stack.open) > upto:
            stack.pop()

    for kind, what, rest in tokens(page or ""):
        if kind == "text":
            if what and not stack.silent:
                parts.append(what)
                linked += len(what) if stack.at.get("a") else 0
        elif kind == "close":
            k = stack.last((what,))
            if k >= 0 and not (what in INLINE and stack.outer and stack.outer[-1] > k):
                pop(k)
        else:
            if what not in INLINE:
                if what == "body" and stack.at.get("head"):
                    pop(stack.at["head"][0])
                if what in CLOSES_P and (k := stack.last(("p",))) > stack.last(("td", "th", "button")):
                    pop(k)
                if what in CLOSES and (k := stack.last(CLOSES[what])) > stack.last(SCOPES.get(what, ())):
                    pop(k)
                flush()
            elif what in ("br", "img", "wbr"):
                parts.append("" if what == "wbr" else " ")
            if what in VOID or rest.rstrip().endswith("/") and what not in INLINE and what not in CLOSES_P:
                continue
            names = tuple("." + w for x in LABELS.finditer(rest) for w in WORD.findall((x[1] or x[2] or x[3] or "").lower())) if "=" in rest else ()
            stack.push(what, names)
    flush()
    return out


def vectors(found: list[tuple[str, bytes, int, int]], first: int = 0, last: int | None = None) -> np.ndarray:
    """A row of features for each block, or for those of a part of a page."""
    total, found = len(found), found[first:last]
    x = np.zeros((len(found), INPUT), np.float32)
    packed = np.frombuffer(b"".join(slots for _, slots, _, _ in found), np.uint8).reshape(-1, TAG_BITS // 8)
    x[:, :TAG_BITS] = np.unpackbits(packed, axis=1, bitorder="little")
    slot, k = _WORD_SLOT.__getitem__, TAG_BITS + WORD_BITS
    for i, (text, _, depth, linked) in enumerate(found):
        words = text.split(" ")
        x[i, TAG_BITS:k] = np.bincount(list(map(slot, words)), minlength=WORD_BITS) / math.sqrt(len(words))
        x[i, k:] = (
            math.log1p(len(text)) / 6, min(1, linked / len(text)), text[-1] in ".!?\"'", math.log1p(depth) / 3,
            (first + i) / total, sum(map(text.count, ".,")) * 10 / (len(text) + 10), "©" in text or "|" in text, len(words) > 12,
        )
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, w, u, b, state=None):
    """Hidden states of an LSTM over x (pages, blocks, features) from a state on, what the backward pass needs, and the last
    state."""
    p, n, _ = x.shape
    h, c = state or (np.zeros((p, HIDDEN), np.float32), np.zeros((p, HIDDEN), np.float32))
    z, kept, out = x @ w + b, [], np.empty((p, n, HIDDEN), np.float32)
    for t in range(n):
        a = z[:, t] + h @ u
        i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN :])
        before, c = (h, c), f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        kept.append((i, f, o, g, tc, *before))
        out[:, t] = h
    return out, kept, (h, c)


def _lstm_grad(x, u, kept, dout):
    p, n, _ = x.shape
    dz, du = np.empty((p, n, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((p, HIDDEN), np.float32), np.zeros((p, HIDDEN), np.float32)
    for t in range(n - 1, -1, -1):
        i, f, o, g, tc, h0, c0 = kept[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate((dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
        dz[:, t], du, dh, dc = da, du + h0.T @ da, da @ u.T, dc * f
    return np.einsum("pni,pnj->ij", x, dz, optimize=True), du, dz.sum((0, 1))


def _reverse(x, lengths):
    out = np.zeros_like(x)
    for i, n in enumerate(lengths):
        out[i, :n] = x[i, :n][::-1]
    return out


#: Blocks of a page that are held as vectors at a time.
PART = 4096


def scores(pages: list[list[tuple]], model: dict) -> list[np.ndarray]:
    """Log-odds of being article text for each block of each page.  Pages of like length are read together, long ones alone
    and in parts, each from the state in which the part before or after it ends."""
    out: list = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    while order and len(pages[order[-1]]) > PART:
        i = order.pop()
        out[i] = _long_scores(pages[i], model)
    while order:
        take = max(1, min(128, 40_000 // len(pages[order[-1]])))
        group, order = order[-take:], order[:-take]
        x, lengths = _padded([vectors(pages[i]) for i in group])
        f = _lstm(x, model["wf"], model["uf"], model["bf"])[0]
        r = _reverse(_lstm(_reverse(x, lengths), model["wr"], model["ur"], model["br"])[0], lengths)
        y = f @ model["vf"] + r @ model["vr"] + x @ model["vx"] + model["c"]
        for k, i in enumerate(group):
            out[i] = y[k, : lengths[k]]
    return out


def _long_scores(page: list[tuple], model: dict) -> np.ndarray:
    y, starts, state = np.zeros(len(page), np.float32), range(0, len(page), PART), None
    for at in starts:
        x = vectors(page, at, at + PART)[None]
        f, _, state = _lstm(x, model["wf"], model["uf"], model["bf"], state)
        y[at : at + PART] = (f @ model["vf"] + x @ model["vx"] + model["c"])[0]
    state = None
    for at in reversed(starts):
        x = vectors(page, at, at + PART)[None, ::-1]
        r, _, state = _lstm(x, model["wr"], model["ur"], model["br"], state)
        y[at : at + PART] += (r @ model["vr"])[0, ::-1]
    return y


def _padded(pages):
    lengths = [len(p) for p in pages]
    x = np.zeros((len(pages), max(lengths), INPUT), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
    return x, lengths


# --- training pages: an article among the furniture of many layouts

_SYLLABLES = "an ba co de el fi go ha in jo ka le mo no or pa qui ra so te un va we xi yo za sch ing tion ment al er ou é ü ñ ß".split()
_FURNITURE = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "links", "pagination", "pager", "toc", "skip"],
    "header": ["header", "masthead", "site-header", "banner", "branding", "logo", "topbar", "top"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "foot"],
    "aside": ["sidebar", "aside", "related", "widget", "recommended", "popular", "trending", "tags", "archive", "rail", "more"],
    "notice": ["cookie", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "paywall", "banner"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "teaser"],
    "form": ["form", "search", "newsletter", "subscribe", "subscription", "login", "signup", "contact"],
    "comments": ["comments", "comment", "comment-list", "replies", "discussion", "disqus", "responses", "reviews", "commentlist"],
    "social": ["share", "social", "sharing", "follow"],
}
_MAIN = ["article", "content", "main", "post", "entry", "entry-content", "post-body", "story", "text", "article-body", "body", "page", "prose"]
_OUTER = ["wrap", "container", "wrapper", "page", "layout", "row", "col", "grid", "site", "root", ""]
_STOCK = {
    "nav": ["Home", "About", "Contact", "News", "Next", "Previous", "Menu", "Products", "Blog"],
    "footer": ["All rights reserved", "© 2023 Example", "Privacy policy", "Terms of use", "Imprint"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies", "Please enable JavaScript", "Dismiss"],
    "advert": ["Advertisement", "Sponsored content", "Buy now and save 50%", "Special offer", "Shop now"],
    "form": ["Subscribe", "Search", "Your email address", "Sign up for our newsletter", "Submit", "Log in"],
    "comments": ["Reply", "Leave a comment", "3 comments", "Great post, thanks!", "posted 2 days ago", "Anonymous says:"],
    "social": ["Share this", "Tweet", "Follow us", "Facebook"],
    "aside": ["Related articles", "Read more", "Most popular", "Tags", "You may also like"],
    "header": ["Example News", "The Daily", "Welcome", "Est. 1990"],
}


def training_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page, and for each of its blocks whether it is article text."""
    truth: list[bool] = []

    def word():
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def sentence(n):
        w = [word() for _ in range(n)]
        junk = r.choice(["", "", "", "###", "%%%"])
        return (" ".join(x + junk for x in w)).capitalize() + r.choice([".", ".", ".", "!", ""])

    def prose():
        return " ".join(sentence(r.randint(1, 18)) for _ in range(r.choice([1, 1, 2, 4, 8])))

    def named(kind, tags):
        tag = r.choice(tags)
        if tag in ("nav", "footer", "header", "aside", "form", "article", "main") and r.random() < 0.6:
            return tag, ""
        label = r.choice(_FURNITURE.get(kind) or _MAIN)
        return tag, f' {r.choice(["class", "class", "id"])}="{label}{r.choice(["", "", "-inner", " box", "_1"])}"'

    def block(tag, text, main, attrs=""):
        truth.append(main)
        inner = f"<b>{text}</b>" if r.random() < 0.1 else text
        end = "" if tag in ("p", "li") and r.random() < 0.1 else f"</{tag}>"
        return f"<{tag}{attrs}>{inner}{end}"

    def furniture(kind):
        tags = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "div", "section", "p", "aside"])
        tag, attrs = named(kind, tags)
        if tag in ("nav", "footer", "header", "aside", "form") and kind in ("notice", "advert", "social"):
            attrs = f' class="{r.choice(_FURNITURE[kind])}"'
        if tag in ("ul", "ol"):
            attrs = attrs or f' class="{r.choice(_FURNITURE[kind])}"'
            return f"<{tag}{attrs}>" + "".join(block("li", f'<a href="/{word()}">{r.choice(_STOCK[kind] + [word()])}</a>' if kind == "nav" else prose(), False) for _ in range(r.randint(1, 7))) + f"</{tag}>"
        if tag == "p":
            return block("p", r.choice(_STOCK[kind] + [sentence(6)]), False, attrs)
        if r.random() < 0.3:
            truth.append(False)
            return f"<{tag}{attrs}>{r.choice(_STOCK[kind] + [sentence(r.randint(1, 12)), prose()])}</{tag}>"
        inner = []
        for _ in range(r.randint(1, 6)):
            t = r.choice(["p", "p", "div", "span", "h3", "li", "li"] if kind != "nav" else ["li", "li", "a", "div"])
            s = r.choice(_STOCK[kind]) if r.random() < 0.4 else (prose() if kind in ("comments", "aside", "notice", "advert") else sentence(r.randint(1, 9)))
            if kind in ("nav", "aside", "footer", "social") and r.random() < 0.6:
                s = f'<a href="/{word()}">{s}</a>'
            if t in ("span", "a"):
                t = "div"
            if t == "li":
                inner.append("<ul>" + block("li", s, False) + "</ul>")
            else:
                inner.append(block(t, s, False, f' class="{r.choice(_FURNITURE[kind])}"' if r.random() < 0.2 else ""))
        return f"<{tag}{attrs}>{''.join(inner)}</{tag}>"

    def article():
        tag, attrs = named("main", ["article", "article", "article", "main", "main", "div", "section"])
        out = [f"<{tag}{attrs}>"]
        if r.random() < 0.8:
            out.append(block(r.choice(["h1", "h1", "h2"]), sentence(r.randint(2, 10)), True))
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13, 20])):
            k = r.random()
            if k < 0.75:
                out.append(block("p", prose(), True))
            elif k < 0.82:
                out.append(block(r.choice(["h2", "h3", "blockquote", "pre", "figcaption"]), sentence(r.randint(1, 8)), True))
            elif k < 0.9:
                out.append("<ul>" + "".join(block("li", prose(), True) for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.94:
                out.append("<table>" + "".join("<tr>" + block("td", word(), True) + block("td", sentence(3), True) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            else:
                out.append(furniture(r.choice(["advert", "social", "aside", "form", "notice"])))
        return "".join(out) + f"</{tag}>"

    before = [furniture(k) for k in r.sample(["nav", "header", "notice", "advert", "form", "nav"], r.randint(0, 4))]
    first = len(truth)
    left = [furniture("aside")] if r.random() < 0.2 else []
    body = [article()]
    after = [furniture(k) for k in r.sample(["comments", "comments", "aside", "advert", "social", "form", "nav"], r.randint(0, 4))] + ([furniture("footer")] if r.random() < 0.8 else [])
    del first
    page = "".join(before + left + body + after)
    for _ in range(r.randint(0, 2)):
        label = r.choice(_OUTER)
        page = f"<div{f' class={chr(34)}{label}{chr(34)}' if label else ''}>{page}</div>"
    return f"<html><head><title>{word()}</title></head><body>{page}</body></html>", truth


@lru_cache(4)
def train(pages: int = 2400, rounds: int = 24, seed: int = 3) -> dict:
    """The network's weights, the same on every call: fitted with Adam to pages of training_page."""
    r, state = random.Random(seed), np.random.RandomState(seed)
    data = []
    while len(data) < pages:
        page, truth = training_page(r)
        found = blocks(page)
        if len(found) == len(truth) and found:
            data.append((vectors(found), np.array(truth, np.float32)))
    data.sort(key=lambda d: len(d[0]))
    groups = []
    for at in range(0, len(data), 64):
        part = data[at : at + 64]
        x, lengths = _padded([d[0] for d in part])
        y, mask = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
        for k, (_, t) in enumerate(part):
            y[k, : len(t)], mask[k, : len(t)] = t, 1
        groups.append((x, lengths, y, mask))
    m = {k: (state.randn(INPUT, 4 * HIDDEN) / 8).astype(np.float32) for k in ("wf", "wr")} | {k: (state.randn(HIDDEN, 4 * HIDDEN) / 4).astype(np.float32) for k in ("uf", "ur")}
    m |= {k: np.zeros(4 * HIDDEN, np.float32) for k in ("bf", "br")} | {k: (state.randn(HIDDEN) / 4).astype(np.float32) for k in ("vf", "vr")} | {"vx": np.zeros(INPUT, np.float32), "c": np.zeros(1, np.float32)}
    one, two, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(rounds):
        for g in state.permutation(len(groups)):
            x, lengths, y, mask = groups[g]
            # some tag and class words are hidden, so that words, links and neighbours are learned too
            x = x.copy()
            x[:, :, :TAG_BITS] *= state.rand(len(x), 1, TAG_BITS) > 0.05
            back = _reverse(x, lengths)
            f, kf, _ = _lstm(x, m["wf"], m["uf"], m["bf"])
            b, kb, _ = _lstm(back, m["wr"], m["ur"], m["br"])
            r_ = _reverse(b, lengths)
            d = (_sigmoid(f @ m["vf"] + r_ @ m["vr"] + x @ m["vx"] + m["c"]) - y) * mask / mask.sum()
            grad = {"vf": np.einsum("pnh,pn->h", f, d), "vr": np.einsum("pnh,pn->h", r_, d), "vx": np.einsum("pni,pn->i", x, d), "c": d.sum(keepdims=True).reshape(1)}
            grad["wf"], grad["uf"], grad["bf"] = _lstm_grad(x, m["uf"], kf, d[:, :, None] * m["vf"])
            grad["wr"], grad["ur"], grad["br"] = _lstm_grad(back, m["ur"], kb, _reverse(d[:, :, None] * m["vr"], lengths))
            step += 1
            rate = 0.01 * (0.1 if epoch >= rounds * 3 // 4 else 1)
            for k, v in grad.items():
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.99 * two[k] + 0.01 * v * v
                m[k] = (m[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def main_texts(pages: list[str | None], model: dict) -> list[str]:
    found = [blocks(p) for p in pages]
    told = scores(found, model)
    return ["\n".join(t for (t, *_), s in zip(b, y) if s > 0) for b, y in zip(found, told)]


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages: the blocks labelled as article, each with its white space
    made single, in page order, joined by line ends.  Null or empty html, and pages without article text, give an
    empty text.  The model's few weights go out with the tasks."""
    model = train() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
