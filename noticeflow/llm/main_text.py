"""HTML main text: a linear-chain CRF over the leaf blocks of a page.

A page is cut into leaf blocks, the stretches of text between block-level tags.
A block's features are its ancestors' tags and the words of their class, id and
role attributes, and figures of its text: length, share of linked text,
punctuation, place.  A chain of two labels (article or not) over the blocks is
trained on labelled pages by maximum likelihood and decoded by Viterbi.

The labelled pages are made by a seeded rule (``labelled_pages``): page layouts
drawn part by part, with and without semantic tags, well formed and not.

Defined results: NULL and empty pages have empty text; unclosed comments,
scripts and tags end the page; nothing is dropped or capped inside the chosen
blocks; nesting may be of any depth; repeated rows get equal texts; an empty
table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAGES = 400
EPOCHS = 12
SEED = 11
SQUASH = 0.02                          # L2 penalty

# How HTML elements take part.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr "
                   "q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea "
                    "select option button datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main menu nav ol p pre section table ul li".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("ul ol dl table body html".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECE = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int                        # characters inside links
    tag: str
    marks: tuple[str, ...]             # ancestors' tags and attribute words


def attribute_words(rest: str) -> set[str]:
    out = set()
    for found in NAMES.finditer(rest):
        value = found[1] or found[2] or found[3] or ""
        out.update(PIECE.findall(CAMEL.sub(" ", value).lower()))
    return out


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; texts decoded, white space runs as one space."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    active: Counter = Counter()
    depth: Counter = Counter()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            clean = " ".join(html.unescape("".join(text)).split())
            if clean:
                tag = next((t for t, _ in reversed(stack) if t not in INLINE), "body")
                out.append(Block(clean, linked, tag, tuple(active)))
            text.clear()
        linked = 0

    def pop() -> None:
        name, marks = stack.pop()
        depth[name] -= 1
        for m in marks:
            active[m] -= 1
            if not active[m]:
                del active[m]

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not any(depth[s] for s in SKIPPED if s in depth):
            text.append(piece)
            if depth["a"]:
                linked += len(piece.strip())

    at = 0
    while at < len(page):
        found = TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, close, rest = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if name not in INLINE:
            flush()
        elif name == "br":
            add(" ")
        if close:
            if depth[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        ended = SAME.get(name, set()) | ({"p"} if name in CLOSES_P else set())
        if ended and any(depth[e] for e in ended):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in SCOPE or (stack[k][0] not in INLINE and name in SAME):
                    break
        if name in VOID or rest.endswith("/") and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        words = attribute_words(rest) if "=" in rest else set()
        marks = (f"t:{name}", *(f"w:{w}" for w in sorted(words)))
        stack.append((name, marks))
        depth[name] += 1
        active.update(marks)
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Feature names of every block."""
    out = []
    n = len(found)
    longest = max((len(b.text) for b in found), default=1)
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        size = sum(words >= c for c in (3, 6, 12, 25, 60))
        share = min(1.0, b.linked / max(1, len(b.text)))
        last = b.text[-1]
        f = [*b.marks, f"in:{b.tag}", f"size:{size}", f"link:{(share > 0) + (share > .3) + (share > .8)}",
             f"end:{'s' if last in '.!?…' else 'p' if not last.isalnum() else 'w'}",
             f"comma:{min(2, b.text.count(','))}", "first" if k == 0 else "last" if k == n - 1 else "mid",
             f"place:{min(3, 4 * k // n)}"]
        if "©" in b.text or "®" in b.text:
            f.append("copyright")
        if len(b.text) == longest:
            f.append("longest")
        if k and found[k - 1].tag == b.tag:
            f.append("same-tag")
        f.append(f"size:{size}&in:{b.tag}")
        out.append(f)
    return out


@dataclass
class Chain:
    """Weights of the two-label chain: label 1 against label 0, and steps between labels."""
    names: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray                  # steps[from][to]; row 2: start

    def emissions(self, rows: list[list[str]]) -> list[float]:
        get, w = self.names.get, self.weights
        return [float(sum(w[i] for name in row if (i := get(name)) is not None)) for row in rows]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best label sequence (Viterbi); ties go to label 0."""
        if not rows:
            return []
        s = self.steps.tolist()
        e = self.emissions(rows)
        zero, one = s[2][0], s[2][1] + e[0]
        back = []
        for x in e[1:]:
            from_zero = (zero + s[0][0] >= one + s[1][0], zero + s[0][1] >= one + s[1][1])
            back.append(from_zero)
            zero, one = max(zero + s[0][0], one + s[1][0]), max(zero + s[0][1], one + s[1][1]) + x
        label = int(one > zero)
        out = [label]
        for from_zero in reversed(back):
            label = 0 if from_zero[label] else 1
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS) -> Chain:
    """Maximum likelihood by forward-backward and adaptive gradient steps, page by page."""
    count = Counter(name for rows, _ in pages for row in rows for name in set(row))
    names = {name: i for i, name in enumerate(sorted(n for n, c in count.items() if c >= 3))}
    coded = [([np.array(sorted({names[f] for f in row if f in names}), np.int64) for row in rows], np.array(y))
             for rows, y in pages if rows]
    w, steps = np.zeros(len(names)), np.zeros((3, 2))
    seen_w, seen_s = np.full(len(names), 1e-3), np.full((3, 2), 1e-3)
    order = random.Random(SEED)
    for _ in range(epochs):
        order.shuffle(coded)
        for rows, y in coded:
            n = len(rows)
            e = np.array([w[r].sum() for r in rows])
            emit = np.stack([np.zeros(n), e], axis=1)
            ahead = np.empty((n, 2))
            ahead[0] = steps[2] + emit[0]
            for k in range(1, n):
                ahead[k] = np.logaddexp(ahead[k - 1][0] + steps[0], ahead[k - 1][1] + steps[1]) + emit[k]
            behind = np.zeros((n, 2))
            for k in range(n - 2, -1, -1):
                t = steps[:2] + emit[k + 1] + behind[k + 1]
                behind[k] = np.logaddexp(t[:, 0], t[:, 1])
            total = np.logaddexp(ahead[-1][0], ahead[-1][1])
            p = np.exp(ahead + behind - total)
            grad_s = np.zeros((3, 2))
            grad_s[2] = p[0] - np.eye(2)[y[0]]
            if n > 1:
                joint = np.exp(ahead[:-1, :, None] + steps[:2] + (emit + behind)[1:, None, :] - total)
                grad_s[:2] = joint.sum(axis=0)
                np.add.at(grad_s, (y[:-1], y[1:]), -1.0)
            miss = p[:, 1] - y
            used = np.concatenate(rows)
            grad = np.zeros(len(w))
            np.add.at(grad, used, np.repeat(miss, [len(r) for r in rows]))
            touched = np.unique(used)
            g = grad[touched] + SQUASH * w[touched] / 10
            seen_w[touched] += g * g
            w[touched] -= 0.5 * g / np.sqrt(seen_w[touched])
            seen_s += grad_s ** 2
            steps -= 0.5 * grad_s / np.sqrt(seen_s)
    return Chain(names, w, steps)


# Attribute words and phrases that the labelled pages draw from.
SHELL = {
    "header": (("header", "masthead", "site-header", "top-bar", "branding", "banner"), ("Daily Post", "The Example Times",
               "Your local paper since 1921", "Home of good reading", "Today's edition")),
    "nav": (("nav", "menu", "navbar", "navigation", "breadcrumbs", "main-menu", "nav-links", "toc"), ("Home", "News",
            "Sports", "Contact us", "About", "Culture", "Archive", "Log in", "Sign up", "Next page")),
    "ad": (("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "adsbygoogle",
            "sponsor"), ("Sponsored", "Advertisement", "Buy one, get one free.", "Save 50% on all shoes today!",
                         "Our partner offers cheap flights.")),
    "side": (("sidebar", "aside", "widget", "related", "recommended", "right-column", "trending", "popular", "teaser",
              "share", "social", "tags", "author-box", "rail", "side"),
             ("Most read", "Related stories", "You may also like", "Share this", "Follow us", "Popular this week")),
    "notice": (("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "gdpr", "newsletter",
                "cookie-banner", "paywall", "warning", "message", "overlay", "dialog", "announcement"),
               ("We use cookies to improve your visit. Read our privacy policy.", "Please enable JavaScript.",
                "Subscribe now to read on.", "This site has moved.", "Accept all cookies")),
    "form": (("form", "search", "subscribe", "login", "contact-form", "signup"), ("Your email address", "Search",
             "Send", "Subscribe to our letter", "Password", "Remember me")),
    "comments": (("comments", "comment", "comment-list", "replies", "discussion", "responses", "disqus-thread",
                  "reader-comments", "comment-body", "feedback"), ("3 comments", "Reply", "Join the discussion",
                                                                   "Leave a comment", "anna42 wrote:")),
    "footer": (("footer", "site-footer", "bottom", "colophon", "copyright", "legal", "page-footer"),
               ("© 2024 Example Ltd.", "All rights reserved.", "Imprint", "Privacy", "Terms of use",
                "© www.example.org · made with care")),
}
MAIN = ("article", "content", "post", "entry-content", "main", "story", "article-body", "post-body", "text", "page",
        "body-copy", "main-content")


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """The leaf blocks of ``n`` pages and their labels.

    Each text begins with a private-use character that says its label; it is
    read back from the blocks and taken out.
    """
    rng = random.Random(seed)
    syllables = ("ba", "ko", "ri", "ten", "mo", "sal", "ver", "du", "lin", "ga", "tor", "es", "ni", "pra", "hol", "shu",
                 "mé", "ü", "ña", "ost")

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int = 4, high: int = 18) -> str:
        words = [word() + ("," if rng.random() < .12 else "") for _ in range(rng.randint(low, high))]
        return " ".join(words).strip(",").capitalize() + rng.choice((".", ".", ".", ".", "!", "?", ""))

    def prose() -> str:
        size = rng.choice((1, 1, 1, 2, 3, 5, 9))
        text = " ".join(sentence(rng.choice((1, 3, 4)), 18) for _ in range(size))
        if rng.random() < .3:
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(("<b>x</b>", ' <a href="/a">more</a> ', "&amp;", "<em>y</em>", "<br>")) + text[at:]
        return text

    def el(tag: str, inner: str, names: tuple[str, ...] = (), closed: bool = True) -> str:
        made = ""
        if names:
            made = f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"'
        if rng.random() < .1:
            made += f' data-x="{rng.randint(1, 99)}"'
        return f"<{tag}{made}>{inner}" + (f"</{tag}>" if closed else "")

    def good(text: str) -> str:
        return "\ue001" + text

    def bad(text: str) -> str:
        return "\ue000" + text

    def links(phrases: tuple[str, ...]) -> str:
        items = [f'<a href="/{word()}">{bad(rng.choice((rng.choice(phrases), word(), sentence(2, 6))))}</a>'
                 for _ in range(rng.randint(1, 7))]
        kind = rng.random()
        if kind < .6:
            return "<ul>" + "".join(el("li", i, closed=rng.random() < .9) for i in items) + "</ul>"
        return "".join(el(rng.choice(("div", "p")), i) for i in items)

    def shell(kind: str) -> str:
        names, phrases = SHELL[kind]
        tag = {"header": "header", "nav": "nav", "ad": "div", "side": "aside", "notice": "div", "form": "form",
               "comments": "section", "footer": "footer"}[kind]
        semantic = rng.random() < .6 and kind not in ("ad", "notice")
        inner = []
        for _ in range(rng.randint(1, 3)):
            pick = rng.random()
            if kind == "nav" or (kind in ("side", "footer", "header") and pick < .4):
                inner.append(links(phrases))
            elif kind == "form":
                inner.append(el(rng.choice(("label", "p", "div")), bad(rng.choice(phrases))) + '<input name="q">')
            elif kind == "comments" and pick < .75:
                inner.append(el(rng.choice(("li", "div", "article")), el("p", bad(prose())), names if pick < .3 else ()))
            elif kind in ("ad", "notice", "side", "footer") and pick < .75:
                inner.append(el(rng.choice(("p", "div", "span")), bad(rng.choice((prose(), sentence(), rng.choice(phrases))))))
            else:
                inner.append(el(rng.choice(("p", "div", "h3", "h2", "h1") if kind == "header" else ("p", "div", "h3")),
                                bad(rng.choice(phrases))))
        if kind in ("ad", "footer") and rng.random() < .5:
            inner = [bad(rng.choice((sentence(), *phrases)))]
        body = "".join(inner)
        if semantic:
            return el(tag, body, names if rng.random() < .4 else ())
        return el(rng.choice(("div", "div", "section", "aside") if kind != "ad" else ("div", "div", "aside", "ins", "section")),
                  body, names)

    def article() -> str:
        parts = []
        title = el("h1", good(sentence(3, 9))) if rng.random() < .85 else ""
        if title and rng.random() < .2:
            title = el("header", title)
        for _ in range(rng.randint(1, 12)):
            pick = rng.random()
            if pick < .7:
                parts.append(el("p", good(prose()), closed=rng.random() < .85))
            elif pick < .76:
                parts.append("<p><b>" + good(sentence(2, 8)) + "<br>")
            elif pick < .82:
                parts.append(el(rng.choice(("h2", "h3")), good(sentence(2, 7))))
            elif pick < .88:
                parts.append("<ul>" + "".join(el("li", good(sentence(2, 12))) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif pick < .92:
                parts.append(el("blockquote", el("p", good(prose()))))
            elif pick < .95:
                parts.append(el("pre", good(sentence(3, 9))))
            elif pick < .97:
                parts.append("<table><tr>" + el("td", good(word())) + el("td", good(sentence(1, 4))) + "</tr></table>")
            else:
                parts.append(el("div", good(prose())))
        for kind, chance in (("ad", .15), ("side", .12), ("form", .06), ("notice", .06)):
            if rng.random() < chance:
                parts.insert(rng.randint(0, len(parts)), shell(kind))
        if rng.random() < .12:
            parts.append(shell("comments"))
        body = title + "".join(parts)
        pick = rng.random()
        if pick < .55:
            return el("article", body, MAIN if rng.random() < .3 else ())
        if pick < .65:
            return el("main", body)
        if pick < .92:
            return el(rng.choice(("div", "div", "section", "td")), body, MAIN)
        return body

    out = []
    for k in range(n):
        before = [s for s in ("header", "nav", "notice", "ad", "form", "side") if rng.random() < .45]
        after = [s for s in ("ad", "side", "comments", "form", "nav", "notice") if rng.random() < .35] + \
            (["footer"] if rng.random() < .8 else [])
        rng.shuffle(before)
        body = "".join(map(shell, before)) + ("" if rng.random() < .03 else article()) + "".join(map(shell, after))
        page = (f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{a:b}}</style>"
                f"<script>var a=\"</p>\";</script></head><body>{body}</body></html>")
        found = blocks(page)
        labels = [int("\ue001" in b.text) for b in found]
        for b in found:
            b.text = b.text.replace("\ue001", "").replace("\ue000", "").strip() or "."
        out.append((found, labels))
    return out


def train(n: int = PAGES, seed: int = SEED) -> Chain:
    return fit([(features(found), y) for found, y in labelled_pages(n, seed)])


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, chain.decode(features(found))) if y)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page of (page_id, url, html)."""
    chain = train() if chain is None else chain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, chain) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
