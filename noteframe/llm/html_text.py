"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks in page order, each with its tag path (tags, class and id words)
and its words, hashed into vectors. A bidirectional LSTM reads the whole sequence both ways, so every block is
judged in the context of the document, and blocks labelled as article are kept.

The labeller is trained here on a bounded sample of the pages themselves. Where a page marks its article
(``article``, ``main``) the blocks inside are article unless an element around them is named as
something else; each such page is also varied: other container names, and boilerplate placed around
and inside the article. In a table where no page marks its article, elements named as something else
teach what is none, and the rest is taken as article. Scripts, styles and other parts that are never shown are no blocks.

Time is linear in the page: names of open elements are counted, not listed per block, and pages of very many blocks
are read piece by piece with the state of either direction carried on.

Defined results: a null or empty html gives an empty text, as does a page without article blocks; repeated
rows and rows without ``page_id`` are read like others; other columns are ignored; in an empty table
nothing is trained.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = frozenset("head script style title template noscript iframe object canvas audio video".split())
# What may stand in a head; anything else ends it, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var ruby rt rp output".split()
)
# Formulas and drawings stand within a line; their elements may end themselves.
FOREIGN = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle"
    " semantics annotation svg g text tspan path circle ellipse rect line polyline polygon use defs".split()
)
INLINE |= FOREIGN
# What an opening tag ends, up to the container in the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

ARTICLE = frozenset({"article", "main"})
# Names of elements that are not article even inside one.
OTHER = frozenset(
    "nav header footer aside form menu sidebar ad ads advert advertisement banner cookie consent notice comment comments"
    " disqus reply replies newsletter subscribe signup login share sharing social related recommended promo sponsor sponsored"
    " popup modal breadcrumb breadcrumbs pagination toolbar widget copyright button textarea select".split()
)


class Block(NamedTuple):
    """A leaf block: bits of the names around it, text, characters in links, open ``ARTICLE`` names, any ``OTHER`` name."""

    names: int
    text: str
    linked: int
    box: tuple[str, ...] = ()
    other: bool = False


PATH, WORDS, NUMBERS = 256, 64, 4
WIDTH = PATH + WORDS + NUMBERS
_places: dict[str, int] = {}


def _place(token: str) -> int:
    if token not in _places:
        if len(_places) > 200_000:
            _places.clear()
        _places[token] = zlib.crc32(token.encode("utf-8", "replace"))
    return _places[token]


def _bits(names: Iterable[str]) -> int:
    out = 0
    for name in names:
        out |= 1 << _place(name) % PATH
    return out


class _Blocks(HTMLParser):
    """Leaf blocks of one page. Every tag costs the same, however deep it stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.depths: dict[str, list[int]] = {}  # of the open elements of each tag
        self.outer: list[int] = []  # depths of the open elements that are not inline
        self.counts = [0] * PATH  # open names by place, those of ARTICLE apart
        self.names = 0
        self.boxes = dict.fromkeys(sorted(ARTICLE), 0)
        self.other = self.hidden = self.linked = 0
        self.blocks: list[Block] = []
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            box = tuple(name for name, n in self.boxes.items() if n)
            self.blocks.append(Block(self.names, text, self.linked, box, self.other > 0))
        self.parts, self.linked = [], 0

    def count(self, names: tuple[str, ...], by: int) -> None:
        for name in names:
            self.other += by * (name in OTHER)
            if name in ARTICLE:
                self.boxes[name] += by
                continue
            at = _place(name) % PATH
            self.counts[at] += by
            self.names = self.names | 1 << at if self.counts[at] else self.names & ~(1 << at)

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.outer.append(len(self.stack))
            self.count(names, 1)
        self.hidden += tag in HIDDEN
        self.stack.append((tag, names))

    def pop(self, depth: int) -> None:
        if self.outer and self.outer[-1] >= depth:
            self.flush()
        while len(self.stack) > depth:
            tag, names = self.stack.pop()
            self.depths[tag].pop()
            if tag not in INLINE:
                self.outer.pop()
                self.count(names, -1)
            self.hidden -= tag in HIDDEN

    def deepest(self, tags: Iterable[str]) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=-1)

    def end_open(self, wanted: set[str], stop: set[str]) -> None:
        depth = self.deepest(wanted)
        if depth >= 0 and depth > self.deepest(stop - wanted):
            self.pop(depth)

    def end_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self.pop(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.end_open({"head"}, set())
        elif tag not in IN_HEAD:
            self.end_head()
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if self.outer and self.stack[self.outer[-1]][0] == "p":
                self.pop(self.outer[-1])
            if tag in ENDS:
                self.end_open(*ENDS[tag])
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += re.findall(r"[a-z]+", value.lower())
        self.push(tag, tuple(names))

    def handle_startendtag(self, tag, attrs):
        if tag in HIDDEN:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in FOREIGN or tag not in INLINE):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = self.deepest((tag,))
        if depth >= 0:
            self.pop(depth)
        elif tag not in INLINE and tag not in VOID:
            self.flush()

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if not self.hidden:
            self.parts.append(data)
            if any(tag == "a" for tag, _ in self.stack[-3:]):
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in page order."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def features(page: list[Block], start: int = 0, total: int | None = None) -> np.ndarray:
    """One row per block: hashed tag path, hashed words, and its size and links. ``page`` may be a piece of a longer one."""
    total = len(page) if total is None else total
    out = np.zeros((len(page), WIDTH), np.float32)
    for k, block in enumerate(page):
        row = out[k]
        names = (block.names | _bits(block.box)).to_bytes(PATH // 8, "little")
        row[:PATH] = np.unpackbits(np.frombuffer(names, np.uint8), bitorder="little")
        words = block.text.lower().split()
        at = np.fromiter((_place(w) % WORDS for w in words), np.int64, len(words))
        row[PATH : PATH + WORDS] = np.bincount(at, minlength=WORDS) / np.sqrt(len(words))
        place = start + k
        row[PATH + WORDS :] = (np.log1p(len(words)) / 5, block.linked / len(block.text), place / 50, (total - place) / 50)
    return np.minimum(out, 3.0)


def weak_labels(page: list[Block], unmarked: bool = False) -> np.ndarray | None:
    """1 inside a marked article and outside elements named otherwise; None where nothing is marked. With ``unmarked``
    all that is not named otherwise counts as article."""
    if not unmarked and not any(b.box for b in page):
        return None
    return np.array([(unmarked or bool(b.box)) and not b.other for b in page], float)


_CONTAINERS = [("article",), ("main",), ("div", "content"), ("div", "post", "body"), ("section", "entry"), ("div", "story")]


def varied(page: list[Block], labels: np.ndarray, pool: list[Block], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page with another article container, repeated lines, and named boilerplate around and inside the article."""
    box = _CONTAINERS[rng.integers(len(_CONTAINERS))]
    names = sorted(OTHER)
    out: list[tuple[Block, float]] = []

    def boilerplate(around: tuple[str, ...]) -> None:
        name = names[rng.integers(len(names))]
        shown = (name,) if name in ("nav", "header", "footer", "aside", "form") else ("div", name)
        leaf = ((), ("p",), ("ul", "li"), ("div",), ("h", "span"))[rng.integers(5)]
        for _ in range(rng.integers(1, 5)):
            text = pool[rng.integers(len(pool))].text.split()
            at = rng.integers(len(text))
            some = " ".join(text[at : at + int(rng.integers(1, 60))])
            out.append((Block(_bits((*around, *shown, *leaf)), some, len(some) * int(rng.integers(2))), 0.0))

    # Articles also repeat short lines; now and then one does so here.
    own = np.flatnonzero(labels)
    again = int(rng.choice(own)) if len(own) and rng.random() < 0.3 else -1
    for k, (block, label) in enumerate(zip(page, labels.tolist(), strict=True)):
        if label:
            block = block._replace(names=block.names | _bits(box), box=())
        if rng.random() < 0.25:
            boilerplate(("html", "body", *(box if label else ())))
        out.append((block, label))
        if k == again:
            short = " ".join(block.text.split()[: int(rng.integers(1, 8))])
            out += [(block._replace(text=short, linked=0), label)] * int(rng.integers(2, 40))
    return [b for b, _ in out], np.array([y for _, y in out])


@dataclass(frozen=True)
class Labeller:
    """Sample bound and training settings of the block labeller."""

    sample_pages: int = 300
    sample_chars: int = 200_000  # longest page of the sample; every page is read whole when it is judged
    piece: int = 4_000  # blocks judged at once
    hidden: int = 24
    epochs: int = 6
    variants: int = 2
    rate: float = 0.01
    seed: int = 11


PLAN = Labeller()
Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


State = tuple[np.ndarray, np.ndarray]


def _lstm(
    x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, mask: np.ndarray, tape: list | None = None, state: State | None = None
) -> tuple[np.ndarray, State]:
    """Hidden states of a batch ``(pages, blocks, width)`` and the last state; masked steps keep the state. Steps are
    noted on ``tape`` for ``_lstm_back``."""
    pages, steps, _ = x.shape
    n = u.shape[0]
    h, c = np.zeros((2, pages, n), np.float32) if state is None else state
    out = np.zeros((pages, steps, n), np.float32)
    inputs = x @ w + b
    for t in range(steps):
        z = inputs[:, t] + h @ u
        i, f, o = (_sigmoid(z[:, k * n : (k + 1) * n]) for k in range(3))
        g = np.tanh(z[:, 3 * n :])
        m = mask[:, t : t + 1]
        c2 = f * c + i * g
        tanh_c = np.tanh(c2)
        if tape is not None:
            tape.append((h, c, i, f, o, g, tanh_c, m))
        h, c = m * o * tanh_c + (1 - m) * h, m * c2 + (1 - m) * c
        out[:, t] = h
    return out, (h, c)


def _lstm_back(x: np.ndarray, u: np.ndarray, tape: list, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the weights from those of the hidden states."""
    n = u.shape[0]
    dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((2, x.shape[0], n), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, o, g, tanh_c, m = tape[t]
        dh = dh + slope[:, t]
        live = dh * m
        dc2 = dc * m + live * o * (1 - tanh_c**2)
        dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), live * tanh_c * o * (1 - o), dc2 * i * (1 - g**2)], axis=1)
        du += h.T @ dz
        dz_all[:, t] = dz
        dh = dh * (1 - m) + dz @ u.T
        dc = dc * (1 - m) + dc2 * f
    flat = dz_all.reshape(-1, 4 * n)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1.0
    return x, mask


def _forward(w: Weights, x: np.ndarray, mask: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Article probability of every block. The second LSTM reads from the end; padding keeps its state empty."""
    tape_a, tape_b = tapes or (None, None)
    ahead, _ = _lstm(x, w["wa"], w["ua"], w["ba"], mask, tape_a)
    back, _ = _lstm(x[:, ::-1], w["wb"], w["ub"], w["bb"], mask[:, ::-1], tape_b)
    both = np.concatenate([ahead, back[:, ::-1]], axis=2)
    return _sigmoid(both @ w["v"] + w["c"]), both


def _forward_long(w: Weights, page: list[Block], piece: int) -> np.ndarray:
    """As ``_forward`` for one page, piece by piece: the states are carried over, the features of one piece are held."""
    n, total = w["ua"].shape[0], len(page)
    starts = range(0, total, piece)
    ahead, p = np.zeros((total, n), np.float32), np.zeros(total, np.float32)

    def read(at: int) -> tuple[np.ndarray, np.ndarray]:
        return _padded([features(page[at : at + piece], at, total)])

    state = None
    for at in starts:
        x, mask = read(at)
        out, state = _lstm(x, w["wa"], w["ua"], w["ba"], mask, state=state)
        ahead[at : at + piece] = out[0]
    state = None
    for at in reversed(starts):
        x, mask = read(at)
        out, state = _lstm(x[:, ::-1], w["wb"], w["ub"], w["bb"], mask, state=state)
        p[at : at + piece] = _sigmoid(ahead[at : at + piece] @ w["v"][:n] + out[0, ::-1] @ w["v"][n:] + w["c"])
    return p


def train(pages: list[str | None], plan: Labeller = PLAN) -> Weights | None:
    """Weights from a sample of pages; None if no page holds a block."""
    rng = np.random.default_rng(plan.seed)
    parsed = [p for p in map(blocks, pages) if p]
    marked = [(p, y) for p in parsed if (y := weak_labels(p)) is not None]
    marked = marked or [(p, weak_labels(p, unmarked=True)) for p in parsed]
    if not marked:
        return None
    pool = [b for p in parsed for b in p]
    n = plan.hidden

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    w = {"v": start(2 * n), "c": np.zeros(1, np.float32)}
    for side in "ab":
        w |= {f"w{side}": start(WIDTH, 4 * n), f"u{side}": start(n, 4 * n), f"b{side}": np.zeros(4 * n, np.float32)}
        w[f"b{side}"][n : 2 * n] = 1.0
    first, second = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for _ in range(plan.epochs):
        batch = [(features(p), y) for p, y in marked]
        for _ in range(plan.variants):
            batch += [(features(p), y) for p, y in (varied(p, y, pool, rng) for p, y in marked)]
        batch.sort(key=lambda e: len(e[1]))
        groups = [batch[k : k + 32] for k in range(0, len(batch), 32)]
        for k in rng.permutation(len(groups)):
            x, mask = _padded([e[0] for e in groups[k]])
            y = np.zeros(mask.shape, np.float32)
            for row, (_, labels) in enumerate(groups[k]):
                y[row, : len(labels)] = labels
            tape_a, tape_b = [], []
            p, both = _forward(w, x, mask, (tape_a, tape_b))
            error = (p - y) * mask / mask.sum()
            down = error[:, :, None] * w["v"]
            slopes = {"v": (both * error[:, :, None]).sum((0, 1)), "c": np.array([error.sum()])}
            for side, tape, xs, part in (("a", tape_a, x, down[:, :, :n]), ("b", tape_b, x[:, ::-1], down[:, ::-1, n:])):
                slopes[f"w{side}"], slopes[f"u{side}"], slopes[f"b{side}"] = _lstm_back(xs, w[f"u{side}"], tape, part)
            step += 1
            for name, slope in slopes.items():
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope**2
                size = np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
                w[name] = w[name] - plan.rate * first[name] / (1 - 0.9**step) / size
    return w


def main_texts(pages: list[str | None], w: Weights | None, piece: int = PLAN.piece) -> list[str]:
    """The article blocks of each page, joined by line ends."""
    parsed = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k])) if w else []
    at = 0
    while at < len(order):
        # Pages of like length together, each padded to the longest: at most ``piece`` blocks, or one page.
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(parsed[order[end]]) <= piece:
            end += 1
        group, at = order[at:end], end
        if len(parsed[group[0]]) > piece:
            probabilities = [_forward_long(w, parsed[group[0]], piece)]
        else:
            probabilities = _forward(w, *_padded([features(parsed[k]) for k in group]))[0]
        for p, k in zip(probabilities, group, strict=True):
            out[k] = "\n".join(b.text for b, keep in zip(parsed[k], p > 0.5, strict=False) if keep)
    return out


def sample(pages: DataFrame, plan: Labeller = PLAN) -> list[str]:
    """Different pages in the order of their hashes, at most ``sample_pages``: those that mark an article, or any where
    none does. Repeated pages count once; only hashes are compared before the sample is read."""
    short = pages.where(F.length("html").between(1, plan.sample_chars)).select("html", F.xxhash64("html").alias("_key"))
    marks = F.rlike("html", F.lit("(?i)<(" + "|".join(sorted(ARTICLE)) + r")[\s>]"))
    keys = short.select("_key", (~marks).alias("_unmarked")).distinct().orderBy("_unmarked", "_key").limit(plan.sample_pages).collect()
    wanted = [r["_key"] for r in keys if r["_unmarked"] == keys[0]["_unmarked"]]
    if not wanted:
        return []
    drawn = short.where(F.col("_key").isin(wanted)).groupBy("_key").agg(F.min("html").alias("html")).orderBy("_key")
    return [r["html"] for r in drawn.collect()]


def extract(pages: DataFrame, plan: Labeller = PLAN) -> DataFrame:
    """``page_id, url, text`` of every page. Only the training sample comes to the driver."""
    weights = pages.sparkSession.sparkContext.broadcast(train(sample(pages, plan), plan))

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                texts = pa.array(main_texts(part.column(2).to_pylist(), weights.value, plan.piece), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    )
