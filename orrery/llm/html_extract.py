"""Main text of pages: a linear-chain conditional random field over the leaf blocks of the page's tree.

A block's features are the tags, roles and words of class and id of the elements above it, and figures of its text:
length, share of links, sentence marks, place in the page. Two labels, main text or not; the transition has one
weight set for neighbours in one element and one for others. The field is trained on annotated pages by the exact
gradient of the likelihood, and decoded by Viterbi. Labelled pages are HTML whose main elements carry an attribute
`data-main`; `dressed_pages` makes them from a bounded sample of the pages themselves.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm.html_blocks import Block, Element, blocks

BITS = 12
WIDTH = 1 << BITS
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.!?](?:\s|$)")


def _id(text: str) -> int:
    return zlib.crc32(text.encode()) & (WIDTH - 1)


def path_features(path: tuple[Element, ...]) -> list[int]:
    """Of the elements above a block; words of names count wherever they stand, tags also as the nearest one."""
    some = {"bias"}
    for k, e in enumerate(path):
        some.add(f"tag {e.tag}")
        if k:
            some.add(f"under {path[k - 1].tag} {e.tag}")
        some.update(f"name {w.lower()}" for w in WORD.findall(e.names))
        if e.role:
            some.add(f"role {e.role.lower()}")
    if path:
        some.add(f"leaf {path[-1].tag}")
        some.update(f"leaf name {w.lower()}" for w in WORD.findall(path[-1].names))
    return sorted({_id(x) for x in some})


def text_shape(block: Block, k: int, n: int) -> tuple[int, ...]:
    """Figures of a block's text, in steps: length, links, sentence marks, capitals, first character, place."""
    t = block.text
    words, size = t.count(" ") + 1, len(t)
    marks = len(MARKS.findall(t))
    share = 3 * min(block.linked, size) // size
    place = 0 if n < 4 else 4 * k // n + 1
    first = 0 if t[0].isalpha() else 1 if t[0].isdigit() else 2 if t[0] in "©|·»›" else 3
    return min(words, 128).bit_length(), share, min(marks, 3), int(t[-1] in ".!?:;,"), first, place


def shape_features(shape: tuple[int, ...]) -> list[int]:
    return sorted({_id(f"text {i} {x}") for i, x in enumerate(shape)} | {_id(f"text {shape[0]} {shape[1]} {shape[2]}")})


def together(a: Block, b: Block) -> int:
    """1 if both stand directly in one element, up to the leaf's own."""
    return int(a.path[:-1] == b.path[:-1])


@dataclass
class Model:
    weights: np.ndarray  # WIDTH: of main text over the rest
    step: np.ndarray  # 2 (together) x 2 (from) x 2 (to)

    def __post_init__(self) -> None:
        self.paths: dict[tuple[Element, ...], float] = {}
        self.shapes: dict[tuple[int, ...], float] = {}

    def scores(self, page: list[Block]) -> list[float]:
        """Of each block, main text over the rest, before its neighbours are seen. Sums by path and shape are kept for the next block."""
        out = []
        for k, b in enumerate(page):
            if (p := self.paths.get(b.path)) is None:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                p = self.paths[b.path] = float(self.weights[path_features(b.path)].sum())
            if (s := self.shapes.get(x := text_shape(b, k, len(page)))) is None:
                s = self.shapes[x] = float(self.weights[shape_features(x)].sum())
            out.append(p + s)
        return out

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi; ties go to main text."""
        if not page:
            return []
        step = self.step.tolist()
        scores = self.scores(page)
        rest, main = 0.0, scores[0]
        back: list[tuple[int, int]] = []
        for k in range(1, len(page)):
            s = step[together(page[k - 1], page[k])]
            to_rest, to_main = (rest + s[0][0], main + s[1][0]), (rest + s[0][1], main + s[1][1])
            back.append((int(to_rest[1] >= to_rest[0]), int(to_main[1] >= to_main[0])))
            rest, main = max(to_rest), max(to_main) + scores[k]
        label = int(main >= rest)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]


def fit_blocks(pages: list[list[Block]], labels: list[list[bool]], rounds: int = 200, l2: float = 0.5) -> Model:
    """Maximises the likelihood of labelled pages less a penalty of squares, by forward-backward and Adam."""
    some = [(p, y) for p, y in zip(pages, labels, strict=True) if p]
    model = Model(np.zeros(WIDTH), np.zeros((2, 2, 2)))
    if not some:
        return model
    some.sort(key=lambda x: -len(x[0]))
    n, longest = len(some), len(some[0][0])
    size = np.array([len(p) for p, _ in some])
    y, same = np.zeros((longest, n), np.int64), np.zeros((longest, n), np.int64)
    row, feature = [], []
    for j, (p, labelled) in enumerate(some):
        for k, b in enumerate(p):
            y[k, j] = labelled[k]
            same[k, j] = together(p[k - 1], b) if k else 0
            for f in path_features(b.path) + shape_features(text_shape(b, k, len(p))):
                row.append(k * n + j)
                feature.append(f)
    row_, feature_ = np.array(row), np.array(feature)
    live = np.arange(longest)[:, None] < size  # by place, pages
    w = np.zeros(WIDTH + 8)
    first, second, page = np.zeros_like(w), np.zeros_like(w), np.arange(n)
    for t in range(1, rounds + 1):
        step = w[WIDTH:].reshape(2, 2, 2)
        score = np.bincount(row_, weights=w[feature_], minlength=longest * n).reshape(longest, n)
        emit = np.stack([np.zeros_like(score), score], axis=2)
        ahead, after = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        ahead[0] = emit[0]
        for k in range(1, longest):
            m = int(live[k].sum())
            ahead[k, :m] = emit[k, :m] + np.logaddexp.reduce(ahead[k - 1, :m, :, None] + step[same[k, :m]], axis=1)
        for k in range(longest - 2, -1, -1):
            m = int(live[k + 1].sum())
            after[k, :m] = np.logaddexp.reduce(step[same[k + 1, :m]] + (emit[k + 1, :m] + after[k + 1, :m])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead[size - 1, page], axis=1)
        one = np.where(live, np.exp(ahead[..., 1] + after[..., 1] - total), 0)
        g = np.zeros_like(w)
        g[:WIDTH] = np.bincount(feature_, weights=(np.where(live, y, 0) - one).reshape(-1)[row_], minlength=WIDTH)
        for k in range(1, longest):
            m = int(live[k].sum())
            both = np.exp(ahead[k - 1, :m, :, None] + step[same[k, :m]] + (emit[k, :m] + after[k, :m])[:, None, :] - total[:m, None, None])
            at = WIDTH + 4 * same[k, :m]
            for a in range(2):
                for b in range(2):
                    g += np.bincount(at + 2 * a + b, weights=((y[k - 1, :m] == a) & (y[k, :m] == b)) - both[:, a, b], minlength=len(w))
        g = (g - l2 * w) / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w + 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(w[:WIDTH], w[WIDTH:].reshape(2, 2, 2))


def fit_pages(pages: Iterable[str], annotation: str = "data-main", **options: float) -> Model:
    """fit_blocks of annotated pages: a block is main text if the innermost annotated element above it says "1"."""
    read = [blocks(p, annotation) for p in pages]
    return fit_blocks(read, [[next((e.main for e in reversed(b.path) if e.main), "0") == "1" for b in p] for p in read], **options)


def sample_pages(pages: DataFrame, most: int = 200, longest: int = 1 << 16, html_col: str = "html") -> list[str]:
    """At most `most` different pages of at most `longest` characters, by a hash of the page: the bound of what the fit reads."""
    rows = pages.select(F.col(html_col).cast("string").alias("html")).filter(F.col("html").isNotNull() & (F.char_length("html") <= longest))
    named = rows.select(F.xxhash64(F.lit("sample"), "html").alias("h"), "html")
    least = [r.h for r in named.select("h").distinct().orderBy("h").limit(most).collect()]  # hashes alone, so that no pages travel
    chosen = named.filter(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html"))  # at most `most` rows
    return [r.html for r in sorted(chosen.collect(), key=lambda r: r.h)]


class Dresser:
    """Annotated pages in many layouts from blocks of real ones."""

    #: Words of class and id that pages use; the layouts draw from them.
    MAIN = "content main article post entry story body text page single".split()
    MENU = "menu nav navbar navigation topnav breadcrumb tabs links".split()
    HEAD = "header masthead banner top topbar branding logo".split()
    FOOT = "footer bottom copyright legal colophon".split()
    SIDE = "sidebar side aside widget related recommended popular trending rail".split()
    ADS = "ad ads advert advertisement sponsored promo promotion banner".split()
    NOTE = "cookie consent notice alert gdpr popup modal banner message warning".split()
    TALK = "comments comment reply replies discussion responses reviews disqus feedback".split()
    FORM = "search login signup newsletter subscribe form contact".split()
    SHARE = "share social tags byline meta author".split()
    ROLES = {"navigation": MENU, "banner": HEAD, "contentinfo": FOOT, "complementary": SIDE}
    ANY = "wrapper container row col inner box block section outer grid left right clearfix".split()

    def __init__(self, prose: list[str], short: list[str], seed: int):
        self.r, self.prose, self.short = random.Random(seed), prose or ["Some words of a text that goes on, and then ends."], short or ["Home", "More"]

    def some(self, few: int, many: int) -> range:
        return range(self.r.randint(few, many))

    def line(self) -> str:
        words = self.r.choice(self.prose if self.r.random() < 0.5 else self.short).split()
        at = self.r.randrange(len(words))
        return " ".join(words[at : at + self.r.randint(1, 5)])

    def sentence(self) -> str:
        words = self.r.choice(self.prose).split()
        at, n = self.r.randrange(len(words)), self.r.randint(5, 40)
        return (" ".join(words[at : at + n]).rstrip(".,") + self.r.choice((".", ".", "!", ""))).capitalize()

    def names(self, kind: list[str]) -> str:
        words = [self.r.choice(kind)]
        if self.r.random() < 0.2:
            words.append(self.r.choice(("reader", "user", "site", "page", "main", "list", "item", "text", "title", "area")))
        if self.r.random() < 0.4:
            words.append(self.r.choice(self.ANY))
        if self.r.random() < 0.2:
            words.append(f"c{self.r.randrange(99)}")
        self.r.shuffle(words)
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice((" ", "-", "_")).join(words)}"'

    def box(self, tag: str, kind: list[str], inside: str, plain: float = 0.3) -> str:
        """inside, within the element that has a meaning of its own or a div with a telling name, both or a name less one."""
        own = tag != "div" and self.r.random() < 0.6
        role = next((r for r, k in self.ROLES.items() if k is kind), "")
        name = f' role="{role}"' if role and self.r.random() < 0.15 else "" if own and self.r.random() < plain else self.names(kind)
        t = tag if own else self.r.choice(("div", "div", "section"))
        return f"<{t}{name}>{inside}</{t}>"

    def links(self) -> str:
        plain = self.r.random() < 0.2
        items = [self.line() if plain else f'<a href="/{self.r.randrange(999)}">{self.line()}</a>' for _ in self.some(2, 9)]
        kind = self.r.random()
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if kind < 0.6 else " | ".join(items) if kind < 0.8 else "".join(f"<p>{x}</p>" for x in items)

    def paragraph(self, text: str) -> str:
        if self.r.random() < 0.25:
            words = text.split(" ")
            k = self.r.randrange(len(words))
            words[k] = self.r.choice(('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>")).format(words[k])
            text = " ".join(words)
        return f"<p>{text}" if self.r.random() < 0.15 else f"<p><b>{text}<br>" if self.r.random() < 0.1 else f"<p>{text}</p>"

    def article(self) -> str:
        level = self.r.choice("112")
        title = f"<h{level}>{self.line() if self.r.random() < 0.5 else self.sentence()}</h{level}>"
        out = [f"<header{self.names(self.HEAD + self.MAIN) if self.r.random() < 0.4 else ''}>{title}</header>" if self.r.random() < 0.25 else title] if self.r.random() < 0.85 else []
        for _ in self.some(1, 9):
            kind = self.r.random()
            text = self.r.choice(self.prose) if self.r.random() < 0.6 else self.sentence() if self.r.random() < 0.7 else self.line()
            if kind < 0.72:
                out.append(self.paragraph(text))
            elif kind < 0.78:
                out.append(f"<h{self.r.randint(2, 4)}>{self.line()}</h2>")
            elif kind < 0.84:
                out.append(self.r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f"<li>{self.sentence()}</li>" for _ in self.some(2, 5))))
            elif kind < 0.88:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<table><tr><th>{self.line()}<th>{self.line()}<tr><td>{self.line()}<td>{self.line()}</table>")
            elif kind < 0.94:
                out.append(f"<pre>{text}</pre>")
            else:
                out.append(f"<div>{text}</div>")
        for _ in self.some(0, 2):
            out.insert(self.r.randint(1, len(out)), self.beside(inside=True).replace(">", ' data-main="0">', 1))
        if self.r.random() < 0.08:  # no element of its own around it
            return "".join(x if "data-main" in x[: x.index(">")] else x.replace(">", ' data-main="1">', 1) for x in out)
        t = self.r.choice(("article", "article", "main", "div", "div", "section", "td"))
        name = self.r.choice((' role="main"', ' role="article"')) if self.r.random() < 0.05 else self.names(self.MAIN) if t in ("div", "section") and self.r.random() < 0.9 or self.r.random() < 0.3 else ""
        inside = f'<{t}{name} data-main="1">{"".join(out)}</{t}>'
        if t == "td":
            inside = f"<table><tr><td>{self.links()}</td>{inside}</tr></table>"
        for _ in self.some(0, 2):
            inside = f"<div{self.names(self.ANY + self.MAIN)}>{inside}</div>" if self.r.random() < 0.8 else f"<main>{inside}</main>"
        return inside

    def talk(self) -> str:
        each = self.r.choice(("<li{}>{}</li>", "<div{}>{}</div>", "<article{}>{}</article>", "<section{}>{}</section>"))
        notes = "".join(each.format(self.names(self.TALK + ["reader", "user"]) if self.r.random() < 0.7 else "", f"<p>{self.line()}</p>" * self.r.randint(0, 1) + "".join(f"<p>{self.sentence()}</p>" for _ in self.some(1, 2))) for _ in self.some(1, 5))
        return self.box("div", self.TALK, self.heading() + (f"<ul>{notes}</ul>" if each.startswith("<li") else notes))

    def heading(self) -> str:
        level = self.r.randint(2, 4)
        return self.r.choice(("", f"<h{level}>{self.line()}</h{level}>"))

    def form(self) -> str:
        return f"<form{self.names(self.FORM) if self.r.random() < 0.5 else ''}><p>{self.sentence()}</p><label>{self.line()}</label><input name=q><button>{self.line()}</button></form>"

    def beside(self, inside: bool = False) -> str:
        kind = self.r.random()
        text = "".join(f"<p>{self.sentence()}</p>" for _ in self.some(1, 2)) if self.r.random() < 0.5 else self.sentence()
        if kind < 0.35:
            return self.box("div", self.ADS, text)
        if kind < 0.5:
            return self.box("aside", self.SIDE, self.r.choice((self.heading() + text, self.heading() + self.links())))
        if kind < 0.62:
            return self.form()
        if kind < 0.77:
            return self.box("div", self.SHARE, self.r.choice((self.links(), self.line(), self.line())))
        return self.box("div", self.NOTE, self.heading() + text) if kind < 0.9 or inside else self.box("div", self.ADS, self.links())

    def page(self) -> str:
        top = [self.box("header", self.HEAD, self.r.choice((self.line(), f"<h1>{self.line()}</h1>", f"<p>{self.sentence()}</p>", self.links())))] if self.r.random() < 0.5 else []
        top += [self.box("nav", self.MENU, self.links() if self.r.random() < 0.9 else self.line()) for _ in self.some(0, 2)]
        top += [self.beside() for _ in self.some(0, 2)]
        self.r.shuffle(top)
        end = [self.beside() for _ in self.some(0, 2)] + [self.talk() for _ in self.some(0, 1)]
        foot = self.box("footer", self.FOOT, self.r.choice((f"&copy; {self.line()} &middot; {self.sentence()}", f"<p>{self.sentence()}</p>", self.links()))) if self.r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.line()}</title></head><body>{''.join(top)}{self.article()}{''.join(end)}{foot}" + self.r.choice(("</body></html>", ""))


def dressed_pages(pages: list[str], number: int = 1200, seed: int = 5) -> list[str]:
    """`number` annotated pages in drawn layouts, with paragraphs and short texts of the given pages; references in them are written anew."""
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    texts = [escape(b.text) for p in pages for b in blocks(p)]
    d = Dresser([t for t in texts if t.count(" ") >= 8], [t for t in texts if t.count(" ") < 8], seed)
    return [d.page() for _ in range(number)]


SHAPE = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per row: the blocks decoded as main text, joined by one newline.

    White space inside a block is one space, as str.split() sees it; <br> is white space. Null and empty pages, and
    pages without main text, give an empty text. Cut-off pages are read to their end. Pages are judged one by one,
    so repeated rows, ids and further columns make no difference; an empty table gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, column="html"):
            texts = []
            for page in part.column("html").to_pylist():
                found = blocks(page) if page else []
                texts.append("\n".join(b.text for b, main in zip(found, model.decode(found), strict=True) if main))
            yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(read, SHAPE)
