"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into blocks: runs of text that no block-level tag interrupts, each with its ancestors' tags,
class and id words, and the share of its text inside links. A block's features are those words and
properties of its text and place; neighbouring blocks' labels (article or not) are tied by transition
weights. The weights are fitted by maximum likelihood with forward-backward sums on labelled pages, and
Viterbi finds the best labels of a page. No table holds labelled pages, so `labelled_pages` makes them
from a seed: pages of many layouts around invented prose, each article block marked.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES, SEED = 700, 7
MARK = "data-article"

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup svg math time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands inside is not markup, or is never shown.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe")
#: Of these the ones that hold markup: without an end tag they are read as any element.
INERT = frozenset(("noscript", "template"))
#: Elements that are often left open. One whose next tag of its kind is no end tag reaches to the next block at most.
HOLDERS = frozenset("button select object canvas video audio noscript template".split())
CHOICES = frozenset("option optgroup".split())
FOREIGN = frozenset(("svg", "math"))
#: Start tags that end an svg or math element.
BREAKS = frozenset("address article aside b big blockquote body br button center code dd div dl dt em embed fieldset figure footer form h1 h2 h3 h4 h5 h6 head "
                   "header hr i img li main menu nav ol p pre ruby s section small span strike strong sub sup table tt u ul var video".split())
#: A start tag ends open elements of these kinds, up to the nearest scope.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol table div section article main aside nav header footer body form blockquote dl".split())
#: Where a tag (with its slash), comment or declaration may begin, and what ends a tag's name.
BEGIN = re.compile(r"<(?:[!?]|(/?)[a-zA-Z])")
NAME_END = re.compile(r"[\s/>]|\Z")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
STOP = re.compile(r"[>\"']")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
SAME = {t: re.compile(rf"<(/?){t}\b", re.I) for t in HOLDERS}
WORDS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Tree:
    """Paths of tags, each kept once: a path is a number, 0 the empty one. Blocks and open elements share them, so depth costs nothing twice."""

    def __init__(self, known: frozenset[str] | None = None):
        self.known, self.number = known, {}
        self.parent, self.tag, self.within, self.article = [0], [""], [frozenset()], [False]

    def child(self, path: int, tag: str) -> int:
        got = self.number.get((path, tag))
        if got is None:
            got = self.number[path, tag] = len(self.tag)
            self.parent.append(path)
            self.tag.append(tag)
            own = self.within[path]  # tags of a path (of those that are known, if given)
            self.within.append(own if tag in own or self.known is not None and tag not in self.known else own | {tag})
            self.article.append(self.article[path] or tag in ("article", "main"))
        return got

    def tags(self, path: int) -> tuple[str, ...]:
        out = []
        while path:
            out.append(self.tag[path])
            path = self.parent[path]
        return tuple(reversed(out))


@dataclass
class Block:
    text: str
    tree: Tree
    place: int                # its path of block-level tags
    names: frozenset[str]     # words of its ancestors' classes and ids (of those that are known, if given)
    named: bool               # whether they have any
    linked: float
    marked: bool = False

    @property
    def path(self) -> tuple[str, ...]:
        return self.tree.tags(self.place)


@dataclass
class Element:
    """An open element, with what it and its ancestors have."""

    tag: str
    place: int
    names: frozenset[str]
    named: bool
    marked: bool
    inline: bool = field(default=False)


class Reader:
    """Tags of a page in order. A page whose tags all end is read by the pattern. From the first that doesn't, ends are looked for by hand: of the quotes that
    an endless tag would have to pass, each is remembered, so no stretch of the page is gone over for every tag that begins in it."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.broken = False
        self.dead: set[int] = set()  # quotes after which no tag that is open there ends
        self.stop = -1               # the next quote or bracket after the place last asked about
        self.name = -1               # the end of the name last asked about
        self.failed = -1             # the end of a name after and in which no attributes begin that end

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag; the name of a comment or declaration is empty."""
        page = self.page
        while (m := BEGIN.search(page, at)) is not None:
            start = m.start()
            if m[1] is None:
                return start, OTHER.match(page, start).end(), "", "", ""
            if not self.broken:
                whole = TAG.match(page, start)
                if whole:
                    return start, whole.end(), whole[1], whole[2], whole[3]
                self.broken = True
            if self.name < m.end():
                self.name = NAME_END.search(page, m.end()).start()
            name = self.name
            if name != self.failed:
                end = self.end(self.next_stop(name))
                if end < 0:  # a name may hold quotes; the attributes may begin with one of them
                    for q in [k for k in range(m.end(), name) if page[k] in "\"'"][::-1]:
                        name, end = q, self.end(q)
                        if end >= 0:
                            break
                if end >= 0:
                    return start, end, m[1], page[m.end() - 1:name], page[name:end - 1]
                self.failed = self.name
            at = start + 1
        return None

    def next_stop(self, at: int) -> int:
        """The first quote or bracket from `at` on; asked with rising `at`."""
        if self.stop < at:
            found = STOP.search(self.page, at)
            self.stop = found.start() if found else len(self.page)
        return self.stop

    def end(self, k: int) -> int:
        """Where a tag ends whose attributes have the quote or bracket at k; -1 if nowhere."""
        page, passed = self.page, []
        while k < len(page):
            if page[k] == ">":
                return k + 1
            close = page.find(page[k], k + 1) if k not in self.dead else -1
            passed.append(k)
            if close < 0:
                break
            found = STOP.search(page, close + 1)
            k = found.start() if found else len(page)
        self.dead.update(passed)
        return -1


def names_in(attrs: str) -> frozenset[str]:
    """Words of class, id and role, and `hidden`."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return frozenset()
    out = {p.lower() for m in WORDS.finditer(attrs) for p in PARTS.findall(m[1] or m[2] or m[3] or "")}
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", attrs):
        out.add("hidden")
    return frozenset(out)


def blocks(page: str, names: frozenset[str] | None = None, tags: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order; broken and unclosed markup is read as far as it goes. The time and room this takes grow with the page's length,
    whatever is left open in it and however deep; of ancestors' names and tags only `names` and `tags` are kept, if given."""
    out: list[Block] = []
    tree = Tree(tags)
    stack: list[Element] = []
    parts: list[str] = []
    linked = links = 0
    where: dict[str, list[int]] = {}  # places in the stack of each tag
    bounds: list[int] = []   # of block-level elements
    scopes: list[int] = []   # of scopes
    barriers: list[int] = [] # of scopes and holders
    loose: list[int] = []    # of holders without an end tag
    foreign: list[int] = []  # and of svg and math
    ahead: dict[str, tuple[int, bool]] = {}  # next tag of a holder's kind: where, and whether it is an end tag
    reader = Reader(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                e = stack[-1] if stack else ROOT
                out.append(Block(text, tree, e.place, e.names, e.named, min(1.0, linked / len(text)), e.marked))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    def push(tag: str, attrs: str, inline: bool = False) -> None:
        above, own, k = stack[-1] if stack else ROOT, names_in(attrs), len(stack)
        kept = own if names is None else own & names
        stack.append(Element(tag, above.place if inline else tree.child(above.place, tag), above.names if kept <= above.names else above.names | kept,
                             above.named or bool(own), above.marked or MARK in attrs, inline))
        where.setdefault(tag, []).append(k)
        if not inline:
            bounds.append(k)
        if tag in SCOPES:
            scopes.append(k)
        if tag in SCOPES or tag in HOLDERS:
            barriers.append(k)

    def close(k: int) -> None:
        nonlocal links
        if bounds and bounds[-1] >= k:
            flush()
        for e in stack[k:]:
            links -= e.tag == "a"
            where[e.tag].pop()
        del stack[k:]
        for held in (bounds, scopes, barriers, loose, foreign):
            while held and held[-1] >= k:
                held.pop()

    def top(held: list[int] | None) -> int:
        return held[-1] if held else -1

    def closed(tag: str) -> bool:
        if ahead.get(tag, (-1, False))[0] < at:
            found = SAME[tag].search(page, at)
            ahead[tag] = (found.start(), bool(found[1])) if found else (len(page), False)
        return ahead[tag][1]

    at = 0
    while at < len(page):
        got = reader.next(at)
        if got is None:
            take(page[at:] if not page.startswith("<", at) or not re.match(r"</?[a-zA-Z!]", page[at:at + 3]) else "")
            break
        start, end, slash, name, attrs = got
        if start > at:
            take(page[at:start])
        at = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            k = top(where.get(tag))
            if k >= 0 and (tag not in INLINE or k > top(bounds)):
                close(k)
            elif tag not in INLINE and not foreign:
                flush()
            continue
        if foreign and tag in BREAKS:
            close(foreign[0])
        if foreign and attrs.rstrip().endswith("/"):
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in RAW_END:
            finish = RAW_END[tag].search(page, at, reader.last + 1) if tag not in INERT or closed(tag) else None
            if finish or tag not in INERT:
                at = finish.end() if finish else len(page)
                if not foreign:
                    flush()
                continue
        if tag in HOLDERS and not foreign:
            if tag in ("button", "select") and top(where.get(tag)) > top(scopes):  # a button ends the one before it, as a select does
                close(top(where[tag]))
            flush()
            if not closed(tag):
                loose.append(len(stack))
            push(tag, attrs)
            continue
        inline = tag in INLINE or bool(foreign)
        if not inline:
            flush()
            if loose and tag not in CHOICES and tag not in VOID:
                close(loose[0])
            ends = ENDS.get(tag, frozenset())
            while (k := max(top(where.get(t)) for t in (*ends, "p"))) > top(barriers):
                close(k)
                ends = ends - {tag}
                if not ends:
                    break
            while stack and stack[-1].inline:  # an inline element left open doesn't reach into the next block
                close(len(stack) - 1)
        if tag in VOID or attrs.rstrip().endswith("/") and inline:
            continue
        if tag in FOREIGN:
            foreign.append(len(stack))
        push(tag, attrs, inline)
        links += tag == "a"
    flush()
    return out


ROOT = Element("", 0, frozenset(), False, False)


def features(found: list[Block]) -> Iterator[list[str]]:
    """Names of each block's features, block by block."""
    n = len(found)
    sizes = [len(b.text) for b in found]
    total = sum(sizes) or 1
    before = 0
    for i, b in enumerate(found):
        text, words = b.text, b.text.count(" ") + 1
        ends = sum(text.count(c) for c in ".!?")
        tree, place = b.tree, b.place
        above = tree.parent[place]
        own = ["bias", f"tag:{tree.tag[place]}", f"words:{min(7, words.bit_length())}", f"linked:{round(b.linked * 4)}",
               f"sentences:{min(4, ends)}", f"last:{'.' if text[-1] in '.!?:' else ',' if text[-1] == ',' else 'x'}",
               f"place:{4 * before // total}", f"index:{min(i, 3)}", f"left:{min(n - 1 - i, 3)}"]
        own.append(f"parent:{tree.tag[above] + '>' if above else ''}{tree.tag[place]}:{'named' if b.named else ''}")
        own += [f"in:{t}" for t in tree.within[above]]
        own += [f"name:{w}" for w in b.names]
        if i:
            own.append(f"same:{tree.parent[found[i - 1].place] == above}")
            own.append(f"before:{min(7, (sizes[i - 1] // 6).bit_length())}")
        if i + 1 < n:
            own.append(f"after:{min(7, (sizes[i + 1] // 6).bit_length())}")
        if "©" in text or "(c)" in text.lower():
            own.append("copyright")
        if not tree.article[place]:
            own.append("no article")
        yield own
        before += sizes[i]


@dataclass
class Chain:
    weights: dict[str, float]  # of the label article against the other
    step: np.ndarray           # (2, 2) from label, to label

    @cached_property
    def known(self) -> tuple[frozenset[str], frozenset[str]]:
        """Names and tags of ancestors that have a weight."""
        return tuple(frozenset(f[len(kind):] for f in self.weights if f.startswith(kind)) for kind in ("name:", "in:"))

    def labels(self, found: list[Block]) -> list[bool]:
        """Viterbi."""
        get = self.weights.get
        gain = [sum([get(f, 0.0) for f in own]) for own in features(found)]
        (nn, ny), (yn, yy) = self.step.tolist()
        no, yes, back = 0.0, gain[0] if gain else 0.0, []
        for g in gain[1:]:
            a, b, c, d = no + nn, yes + yn, no + ny, yes + yy
            back.append((a < b, c < d))
            no, yes = max(a, b), max(c, d) + g
        label = no < yes
        out = [label]
        for from_no, from_yes in reversed(back):
            label = from_yes if label else from_no
            out.append(label)
        return out[::-1] if gain else []


def train(pages: list[list[Block]], rounds: int = 150, ridge: float = 0.5, rate: float = 0.15) -> Chain:
    """Maximum likelihood with a ridge, by Adam; all pages go through the forward-backward sums together."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in own] for own in features(p)] for p in pages]
    n, longest = len(pages), max(map(len, pages))
    page = np.concatenate([np.full(sum(map(len, r)), i) for i, r in enumerate(rows)])
    place = np.concatenate([np.repeat(np.arange(len(r)), [len(x) for x in r]) for r in rows])
    feature = np.array([f for r in rows for own in r for f in own])
    real = np.zeros((n, longest), bool)
    truth = np.zeros((n, longest), np.int64)
    for i, p in enumerate(pages):
        real[i, :len(p)] = True
        truth[i, :len(p)] = [b.marked for b in p]
    theta = np.zeros(len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    pair = real[:, 1:]
    np.add.at(seen, (truth[:, :-1][pair], truth[:, 1:][pair]), 1)
    for t in range(1, rounds + 1):
        w, step = theta[:-4], theta[-4:].reshape(2, 2)
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = np.bincount(page * longest + place, w[feature], n * longest).reshape(n, longest)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for k in range(1, longest):
            new = np.logaddexp.reduce(forward[:, k - 1, :, None] + step, axis=1) + score[:, k]
            forward[:, k] = np.where(real[:, k, None], new, forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(step + (score[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(real[:, k + 1, None], new, 0)
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        yes = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None]) * real
        grad = np.empty_like(theta)
        miss = truth - yes
        grad[:-4] = np.bincount(feature, miss[page, place], len(names))
        joint = np.exp(forward[:, :-1, :, None] + step + (score + backward)[:, 1:, None, :] - whole[:, None, None, None]) * pair[:, :, None, None]
        grad[-4:] = (seen - joint.sum(axis=(0, 1))).ravel()
        grad -= ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Chain({f: float(theta[i]) for f, i in names.items()}, theta[-4:].reshape(2, 2).copy())


# Words that pages give to the parts of their layout; used to make training pages, not to decide.
ROLES = {
    "main": "content article post entry story main text body page detail", "nav": "nav menu navbar navigation breadcrumb topbar tabs",
    "header": "header masthead top brand logo", "footer": "footer bottom copyright legal foot", "side": "sidebar aside widget related rail more recommended",
    "ad": "ad ads advert advertisement sponsor promo banner", "notice": "cookie notice consent alert popup newsletter subscribe modal message",
    "comment": "comments comment reply discussion responses respond", "form": "form search login signup contact", "share": "share social tools meta tags",
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.other = random.Random(seed + 1)
        self.syllables = ["".join((self.r.choice("bdfghklmnprstvwz"), self.r.choice("aeiouäé"), self.r.choice(["", "n", "r", "s", "t"]))) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b))).capitalize()

    def prose(self, a: int, b: int) -> str:
        text = " ".join(self.words(1, 16) + self.r.choice([".", ".", ".", "?", ",", ""]) for _ in range(self.r.randint(a, b)))
        odd = self.r.random()  # some text is tabular or broken
        return text.replace(" ", self.r.choice([" | ", "$$$ ", " * "])) if odd < 0.06 else text

    def attrs(self, role: str) -> str:
        if self.r.random() < 0.3:
            return ""
        name = self.r.choice(ROLES[role].split())
        name += self.r.choice(["", "", f"-{self.word()}", "-box", "-wrapper"])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 4)}</a>'

    def listing(self, a: int, b: int) -> str:
        return f"<ul>{''.join(f'<li>{self.link()}</li>' for _ in range(self.r.randint(a, b)))}</ul>"

    def controls(self) -> str:
        def words(n: int) -> str:
            return " ".join("".join(self.other.choices(self.syllables, k=2)) for _ in range(self.other.randint(1, n)))

        tag = self.other.choice(["", "", "select", "video", "audio", "object", "canvas"])
        inner = "".join(f"<option>{words(3)}" for _ in range(self.other.randint(1, 5))) if tag == "select" else words(9).capitalize() + self.other.choice(["", "."])
        return f"<{tag}>{inner}</{tag}>" if tag else ""

    def nav(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "header"])
        inner = self.listing(3, 9) if self.r.random() < 0.7 else " | ".join(self.link() for _ in range(self.r.randint(2, 7)))
        return f"<{tag}{self.attrs('nav')}>{inner}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(["header", "div"])
        return f"<{tag}{self.attrs('header')}>{self.r.choice(['<p>', '<h2>', '<h1>', '<span>'])}{self.words(1, 5)}{self.r.choice(['', '<p>' + self.words(2, 7)])}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(["footer", "footer", "div"])
        inner = self.r.choice([f"&copy; {self.word()}.example &middot; {self.prose(1, 3)}", f"<p>&copy; 2024 {self.words(1, 4)}</p>{self.listing(2, 5)}",
                               f"<p>{self.prose(1, 2)}</p><p>{self.link()} {self.link()}</p>", self.prose(1, 2)])
        return f"<{tag}{self.attrs('footer')}>{inner}</{tag}>"

    def side(self) -> str:
        tag = self.r.choice(["aside", "aside", "div", "section"])
        inner = self.r.choice([self.listing(2, 7), f"<p>{self.prose(1, 3)}</p>", f"<p>{self.words(2, 8)}</p>{self.listing(2, 4)}", self.prose(1, 3)])
        return f"<{tag}{self.attrs('side')}>{self.r.choice(['', f'<h3>{self.words(1, 3)}</h3>'])}{inner}</{tag}>"

    def ad(self) -> str:
        name = self.r.choice(ROLES["ad"].split())
        inner = self.r.choice([self.prose(1, 4), self.link(), f"<p>{self.prose(1, 3)}</p>", self.words(2, 9)])
        return f'<div {self.r.choice(["class", "id"])}="{name}{self.r.choice(["", "-box", "-" + self.word()])}">{inner}</div>'

    def notice(self) -> str:
        name = self.r.choice(ROLES["notice"].split())
        tag = self.r.choice(["div", "div", "section", "p", "aside"])
        inner = self.prose(1, 3) if tag == "p" else self.r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p><p>{self.link()}</p>"])
        return f'<{tag} class="{name}{self.r.choice(["", "-bar", "-box"])}"{self.r.choice(["", "", " role=alert"])}>{inner}</{tag}>'

    def form(self) -> str:
        return (f"<form{self.attrs('form')}><label>{self.words(1, 3)}</label><input name=q>{self.r.choice(['', f'<p>{self.prose(1, 2)}</p>'])}"
                f"{self.controls()}<button>{self.word()}</button></form>")

    def comments(self) -> str:
        tag, item = self.r.choice([("section", "div"), ("div", "div"), ("ol", "li"), ("div", "article"), ("ul", "li")])
        own = "".join(f"<{item}{self.r.choice(['', ' class=comment', ' class=\"comment-body\"'])}>{self.r.choice(['', f'<b>{self.word()}</b> ', f'<h4>{self.word()}</h4>'])}"
                      f"{self.r.choice(['<p>', ''])}{self.prose(1, 4)}</{item}>" for _ in range(self.r.randint(1, 5)))
        return f'<{tag} {self.r.choice(["class", "id"])}="{self.r.choice(ROLES["comment"].split())}{self.r.choice(["", "-list", "-area"])}">{self.r.choice(["", f"<h3>{self.words(1, 3)}</h3>"])}{own}</{tag}>'

    def marked(self, tag: str, text: str) -> str:
        end = "" if tag in ("p", "li") and self.r.random() < 0.2 else f"</{tag}>"
        if self.r.random() < 0.25:
            at = len(text) // 2
            text = f"{text[:at]}<{self.r.choice(['b', 'em', 'span'])}>{text[at:]}" if self.r.random() < 0.3 else f"{text[:at]}{self.link()}{text[at:]}"
        return f"<{tag} {MARK}>{text}{self.r.choice(['', '', '<br>'])}{end}"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<{(h := r.choice(['h1', 'h1', 'h2']))} {MARK}>{r.choice([self.words(2, 10), self.prose(1, 3)])}</{h}>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12])):
            kind = r.random()
            if kind < 0.72:
                out.append(self.marked("p", self.prose(1, r.choice([1, 2, 4, 9, 14]))))
            elif kind < 0.80:
                out.append(f"<{(h := r.choice(['h2', 'h3']))} {MARK}>{self.words(1, 7)}</{h}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(self.marked("li", self.r.choice([self.words(2, 9), self.prose(1, 2)])) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote>{self.marked('p', self.prose(1, 3))}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr>{self.marked('td', self.words(1, 3))}{self.marked('td', self.words(1, 3))}</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.96:
                out.append(self.ad())
            else:
                out.append(self.r.choice([self.side, self.notice, self.form])())
        if r.random() < 0.08:
            out = [f"<div {MARK}>{self.prose(2, 8)}</div>"]
        tag = r.choice(["article"] * 5 + ["main", "div", "section", "div"])
        body = f"<{tag}{self.attrs('main')}>{''.join(out)}</{tag}>"
        return body if r.random() < 0.7 else f"<div{self.attrs('main')}>{body}</div>"

    def page(self) -> str:
        r = self.r
        top = [f() for f, p in ((self.notice, 0.25), (self.header, 0.4), (self.nav, 0.85), (self.form, 0.2), (self.ad, 0.5), (self.side, 0.2)) if r.random() < p]
        end = [f() for f, p in ((self.comments, 0.4), (self.side, 0.35), (self.ad, 0.3), (self.notice, 0.15), (self.form, 0.15), (self.nav, 0.1), (self.footer, 0.9)) if r.random() < p]
        if r.random() < 0.2:
            r.shuffle(top)
        return (f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>"
                f"{''.join(top)}{self.article()}{''.join(end)}</body></html>")


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[list[Block]]:
    made = _Maker(seed)
    return [b for b in (blocks(made.page()) for _ in range(n)) if b]


@cache
def trained(n: int = PAGES, seed: int = SEED) -> Chain:
    return train(labelled_pages(n, seed))


def main_text(page: str | None, chain: Chain) -> str:
    """The article's blocks, one to a line."""
    found = blocks(page or "", *chain.known)
    return "\n".join(b.text for b, label in zip(found, chain.labels(found)) if label)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text (empty if a page has none), n_chars of every row of `pages` (page_id, url, html).
    Null html counts as empty; markup may be broken or unclosed. A long page takes time and room in proportion to its length. Repeated
    rows stay repeated; an empty table gives an empty result; other columns are ignored, whatever their names."""
    chain = chain or trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, chain) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
