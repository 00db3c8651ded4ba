"""HTML extraction: a bidirectional LSTM in numpy labels the text blocks of a page as main text or not.

A page is read as the sequence of its leaf blocks. A block is a vector of its hashed tag path (tags, classes and ids of what it
stands in), its hashed words and a few numbers, some of them about the whole page; the network reads the sequence in both directions,
so each decision has the whole page for context. It is trained on a bounded sample of the given pages: their semantic elements give
labels, and variants of each page, with other containers, lists, tables and quotations and with notices, forms, sidebars, adverts and
comments put in, teach what such elements don't tell. Many containers and parts of the variants have a random name or none, so that
place, links, tags and shares of the text must decide.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches

#: Pages for training, at most, chosen by a hash of their key, and the longest page among them.
FIT_PAGES, FIT_CHARS = 240, 60_000
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 192, 24, 14, 16
PAGE_NUMBERS = 8
BATCH_BYTES = 4 << 20
#: Blocks that the network holds at a time, padding included.
GROUP_BLOCKS = 4096

# Elements of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template svg canvas".split())
SELF_CLOSING = frozenset(["svg"])
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Quotes count behind = only, and one that isn't closed ends with the tag.
_ATTRIBUTES = r"""((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)*+)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*){_ATTRIBUTES}(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf: its text, the names of what it stands in, from the root down, and its characters inside links."""

    text: str
    path: tuple[str, ...]
    linked: int


def _names(tag: str, attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return tag
    found = " ".join(x for m in _NAMES.findall(attributes) for x in m if x).lower()
    return f"{tag} {' '.join(_PARTS.findall(found))}" if found else tag


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page with text, in order. Scripts, styles and comments are left out; what isn't closed ends with the page."""
    out: list[Block] = []
    stack: list[str] = []
    names: list[str] = []
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, tuple(names), min(linked, len(text))))
            pieces, linked = [], 0

    def close(to: int) -> None:
        nonlocal links
        links -= stack[to:].count("a")
        del stack[to:], names[to:]

    page = page or ""
    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                text = html_lib.unescape(text) if "&" in text else text
                pieces.append(text)
                linked += len(text) if links else 0
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            if tag in stack:
                close(len(stack) - 1 - stack[::-1].index(tag))
            continue
        # an end slash counts in foreign elements only
        if tag in RAW_TAGS and not (tag in SELF_CLOSING and m[0].endswith("/>")):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK_TAGS:
            flush()
            while stack and stack[-1] in CLOSES.get(tag, ()):
                close(len(stack) - 1)
            if tag == "p" and "p" in stack and not any(t in BLOCK_TAGS and t != "p" for t in stack[len(stack) - stack[::-1].index("p"):]):
                close(len(stack) - 1 - stack[::-1].index("p"))
        elif tag == "br":
            pieces.append(" ")
        if tag not in VOID_TAGS and not m[0].endswith("/>"):
            stack.append(tag)
            names.append(_names(tag, m[3]))
            links += tag == "a"
    flush()
    return out


# --- features ------------------------------------------------------------------------------------------------------------


class _Places(dict):
    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.lower().encode())
        self[word] = place = h % WORD_DIM + (0 if h >> 16 & 1 else WORD_DIM)
        return place


class Hasher:
    """Hashed vectors of names and words, each computed once."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words = _Places()

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            v = np.zeros(PATH_DIM, np.float32)
            for depth, name in enumerate(path):
                for part in name.split():
                    h = zlib.crc32(part.encode())
                    v[h % PATH_DIM] += (1.0 if h >> 16 & 1 else -1.0) * (1.5 if depth == len(path) - 1 else 1.0)
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = v
        return v

    def text(self, text: str) -> np.ndarray:
        """Of all words of the block."""
        words = text.split()
        if len(self.words) > 200_000:
            self.words.clear()
        # a word's place, and WORD_DIM more if its sign is minus
        counts = np.bincount([self.words[w] for w in words], minlength=2 * WORD_DIM)
        return ((counts[:WORD_DIM] - counts[WORD_DIM:]) / np.sqrt(max(len(words), 1))).astype(np.float32)

    def page(self, blocks: list[Block]) -> np.ndarray:
        return self.rows(blocks, page_numbers(blocks) if blocks else np.zeros((0, PAGE_NUMBERS), np.float32))

    def rows(self, blocks: list[Block], numbers: np.ndarray) -> np.ndarray:
        """Vectors of some blocks of a page and their numbers from the whole page."""
        out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
        for i, b in enumerate(blocks):
            out[i, :PATH_DIM] = self.path(b.path)
            out[i, PATH_DIM : PATH_DIM + WORD_DIM] = self.text(b.text)
            n = len(b.text)
            out[i, -NUMBERS : -PAGE_NUMBERS] = (np.log1p(n) / 4, b.linked / n, (b.text.count(".") + b.text.count(",")) / n * 10, len(b.path) / 8, b.text[-1] in ".!?", 1.0)
        out[:, -PAGE_NUMBERS:] = numbers
        return out


def _common(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905


def page_numbers(blocks: list[Block]) -> np.ndarray:
    """What the whole page tells of each block: the shares of the unlinked text at its path and in its parent, how much of the way to
    the densest parent it goes and how far beyond, the steps shared with the blocks before and after, and its place."""
    at: dict[tuple[str, ...], int] = {}
    under: dict[tuple[str, ...], int] = {}
    for b in blocks:
        n = len(b.text) - b.linked
        at[b.path] = at.get(b.path, 0) + n
        under[b.path[:-1]] = under.get(b.path[:-1], 0) + n
    total = max(sum(at.values()), 1)
    dense = max(under, key=lambda k: (under[k], -len(k)))
    ways: dict[tuple[str, ...], tuple[float, float]] = {}
    for path in at:
        shared = _common(path, dense)
        ways[path] = shared / max(len(dense), 1), (len(path) - shared) / 4
    out, last = [], len(blocks) - 1
    for i, b in enumerate(blocks):
        before = _common(b.path, blocks[i - 1].path) / len(b.path) if i and b.path else 0.0
        after = _common(b.path, blocks[i + 1].path) / len(b.path) if i < last and b.path else 0.0
        out.append((at[b.path] / total, under[b.path[:-1]] / total, *ways[b.path], before, after, i / max(last, 1), i == last))
    return np.array(out, np.float32)


# --- the network ---------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Labeller:
    """Weights of the forward and backward LSTM and of the output."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 5) -> Labeller:
        r, d, h = np.random.default_rng(seed), PATH_DIM + WORD_DIM + NUMBERS, HIDDEN
        w = {}
        for side in "fb":
            w[f"x{side}"] = (r.standard_normal((d, 4 * h)) * 0.15).astype(np.float32)
            w[f"h{side}"] = (r.standard_normal((h, 4 * h)) * 0.2).astype(np.float32)
            w[f"c{side}"] = np.zeros(4 * h, np.float32)
            w[f"c{side}"][h : 2 * h] = 1
        w["o"] = (r.standard_normal(2 * h + d) * 0.1).astype(np.float32)
        w["b"] = np.zeros(1, np.float32)
        return Labeller(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, tape: list | None, state: list[np.ndarray] | None = None) -> np.ndarray:
        """Hidden states of (pages, blocks, features), in the order of x; beyond a page's end the state stays. state, hidden and cell,
        is where the pages begin, and is left as they end."""
        n, steps, h = len(x), x.shape[1], HIDDEN
        gates_x = x.reshape(n * steps, -1) @ self.w[f"x{side}"] + self.w[f"c{side}"]
        gates_x = gates_x.reshape(n, steps, 4 * h)
        out = np.zeros((n, steps, h), np.float32)
        hid, cell = state or (np.zeros((n, h), np.float32), np.zeros((n, h), np.float32))
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = gates_x[:, t] + hid @ self.w[f"h{side}"]
            i, f, o = (_sigmoid(g[:, k * h : (k + 1) * h]) for k in range(3))
            a = np.tanh(g[:, 3 * h :])
            new = f * cell + i * a
            tc = np.tanh(new)
            m = mask[:, t, None]
            if tape is not None:
                tape.append((t, hid, cell, i, f, o, a, tc, m))
            hid, cell = np.where(m, o * tc, hid), np.where(m, new, cell)
            out[:, t] = hid
        if state is not None:
            state[:] = hid, cell
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The log odds of each block to be main text."""
        states = [self._run(x, mask, side, None) for side in "fb"]
        return np.concatenate([*states, x], axis=2) @ self.w["o"] + self.w["b"]

    def long_scores(self, blocks: list[Block], hasher: Hasher, steps: int) -> np.ndarray:
        """scores of one page, steps blocks at a time: the backward states of all blocks are kept, a few numbers each, and the vectors
        of the blocks in hand only."""
        numbers, n = page_numbers(blocks), len(blocks)
        fresh = lambda: [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
        vectors = lambda a: hasher.rows(blocks[a : a + steps], numbers[a : a + steps])[None]
        back, out = np.zeros((n, HIDDEN), np.float32), np.zeros(n, np.float32)
        state = fresh()
        for a in reversed(range(0, n, steps)):
            x = vectors(a)
            back[a : a + steps] = self._run(x, np.ones(x.shape[:2], bool), "b", None, state)[0]
        state = fresh()
        for a in range(0, n, steps):
            x = vectors(a)
            ahead = self._run(x, np.ones(x.shape[:2], bool), "f", None, state)
            out[a : a + steps] = (np.concatenate([ahead, back[None, a : a + steps], x], axis=2) @ self.w["o"] + self.w["b"])[0]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of the blocks and its gradient, back through time."""
        tapes: dict[str, list] = {"f": [], "b": []}
        states = [self._run(x, mask, side, tapes[side]) for side in "fb"]
        features = np.concatenate([*states, x], axis=2)
        p = _sigmoid(features @ self.w["o"] + self.w["b"])
        total = mask.sum()
        loss = -float((np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / total)
        d = ((p - y) * mask / total).astype(np.float32)
        g = {"o": np.einsum("nt,ntd->d", d, features), "b": np.array([d.sum()], np.float32)}
        h = HIDDEN
        for k, side in enumerate("fb"):
            d_out = d[:, :, None] * self.w["o"][k * h : (k + 1) * h]
            d_gates = np.zeros((*x.shape[:2], 4 * h), np.float32)
            dh, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            g[f"h{side}"] = np.zeros_like(self.w[f"h{side}"])
            for t, hid, cell, i, f, o, a, tc, m in reversed(tapes[side]):
                dh = dh + d_out[:, t]
                live, dcell = np.where(m, dh, 0), np.where(m, dc, 0)
                dcell = dcell + live * o * (1 - tc * tc)
                gate = np.concatenate([dcell * a * i * (1 - i), dcell * cell * f * (1 - f), live * tc * o * (1 - o), dcell * i * (1 - a * a)], axis=1)
                d_gates[:, t] = gate
                g[f"h{side}"] += hid.T @ gate
                dh, dc = np.where(m, gate @ self.w[f"h{side}"].T, dh), np.where(m, dcell * f, dc)
            flat = d_gates.reshape(-1, 4 * h)
            g[f"x{side}"] = x.reshape(len(flat), -1).T @ flat
            g[f"c{side}"] = flat.sum(0)
        return loss, g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages as one array, and which blocks are real."""
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, PATH_DIM + WORD_DIM + NUMBERS), np.float32)
    mask = np.zeros((len(pages), steps), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


def train(pages: list[np.ndarray], labels: list[np.ndarray], *, epochs: int = 18, batch: int = 24, rate: float = 0.01, seed: int = 5) -> Labeller:
    """Adam over batches of pages of like length."""
    net, r = Labeller.fresh(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    step = 0
    for epoch in range(epochs):
        for j in r.permutation(len(groups)):
            x, mask = padded([pages[i] for i in groups[j]])
            y = np.zeros(mask.shape, np.float32)
            y[mask] = np.concatenate([labels[i] for i in groups[j]])
            _, g = net.gradients(x, mask, y)
            step += 1
            scale = min(1.0, 1.0 / (np.sqrt(sum(float((a * a).sum()) for a in g.values())) + 1e-9))
            lr = rate * (1.0 if 2 * epoch < epochs else 0.3 if 6 * epoch < 5 * epochs else 0.1)
            for k, a in g.items():
                a = a * scale
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                net.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


# --- training pages ------------------------------------------------------------------------------------------------------

# Names that pages give to their parts.
MAIN_NAMES = ["article", "main", "section class=content", "div class=post-content", "div id=content", "div class=entry", "div class=article-body", "div class=story"]
SIDE_NAMES = {
    "nav": ["nav", "div class=menu", "ul class=navigation", "div id=navbar", "div class=breadcrumb", "header"],
    "ad": ["div class=ad", "div class=advert", "aside class=sponsored", "div class=promo", "div id=ads", "div class=banner"],
    "notice": ["div class=cookie-notice", "div class=notice", "div id=consent", "div class=alert", "div role=alert", "div class=popup"],
    "form": ["form", "form class=newsletter", "form class=search", "div class=subscribe", "form id=login"],
    "sidebar": ["aside", "div class=sidebar", "div class=related", "aside class=widget", "div class=share"],
    "comments": ["section class=comments", "div id=comments", "div class=comment-list", "ol class=comments", "div class=comment", "section id=discussion class=comments"],
    "header": ["header", "div class=header", "div id=masthead", "div class=site-header"],
    "footer": ["footer", "div class=footer", "div id=footer", "div class=copyright"],
}
_SIDE_TAGS = frozenset("nav aside footer form header noscript button select textarea iframe title head label option".split())
_SIDE_WORDS = frozenset("ad ads advert advertisement banner sponsored promo menu nav navbar navigation breadcrumb footer copyright sidebar widget related comment comments cookie consent notice alert popup newsletter subscribe search share social discussion masthead".split())
_MAIN_TAGS = frozenset("article main".split())


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 inside article or main and outside what is marked as something else; none for pages without such elements."""
    parts = [{x for name in b.path for x in name.split()} for b in blocks]
    if not any(p & _MAIN_TAGS for p in parts):
        return None
    return np.array([bool(p & _MAIN_TAGS) and not p & _SIDE_TAGS and not p & _SIDE_WORDS for p in parts], np.float32)


def _named(path: tuple[str, ...], name: str) -> tuple[str, ...]:
    tag, _, rest = name.partition(" ")
    return (*path, f"{tag} {' '.join(_PARTS.findall(re.sub(r'[a-z]+=', ' ', rest)))}".strip())


def _made_up(tags: list[str], strange: list[str], r: np.random.Generator) -> str:
    """A tag with a random class or id, or with none."""
    tag = tags[int(r.integers(len(tags)))]
    if r.random() < 0.35:
        return tag
    words = _PARTS.findall(strange[int(r.integers(len(strange)))].lower()) or ["x"]
    return f"{tag} {'class' if r.random() < 0.7 else 'id'}={words[int(r.integers(len(words)))]}"


def _reshaped(main: list[Block], strange: list[str], r: np.random.Generator) -> list[Block]:
    """Main blocks, some of them as items of lists, cells, quotations or headings, and some runs in an element of their own."""
    shapes = [("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("table", "tbody", "tr", "td"), ("table", "tr", "td"), ("pre",), ("h2",), ("h3",), ("dl", "dd"), ("figure", "figcaption"), ("div",), ("ul", "li", "p")]
    out: list[Block] = []
    i = 0
    while i < len(main):
        if r.random() < 0.12:
            shape = shapes[int(r.integers(len(shapes)))]
            for b in main[i : i + int(r.integers(1, 4))]:
                i += 1
                words = b.text.split()
                # short ones too, in several items
                size = len(words) if r.random() < 0.4 else int(r.integers(2, 12))
                parts = [words[k : k + size] for k in range(0, len(words), size)][:6]
                out += [Block(" ".join(x), shape, 0) for x in parts]
            continue
        out.append(main[i])
        i += 1
    if len(out) > 2 and r.random() < 0.3:
        start = int(r.integers(0, 2))
        inner = _named((), _made_up(["div", "section", "div", "section"], strange, r))
        out = [b if k < start else Block(b.text, (*inner, *b.path), b.linked) for k, b in enumerate(out)]
    return out


def variant(blocks: list[Block], labels: np.ndarray, strange: list[str], r: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page's main blocks in another container and partly in other shapes, between other parts made of strange texts."""
    pick = lambda options: options[int(r.integers(len(options)))]
    root = pick([("html", "body"), ("html", "body"), ("html", "body", "div"), ("html", "body", "div wrapper"), ("html", "body", "div page container")])
    container = _named(root, pick(MAIN_NAMES) if r.random() < 0.5 else _made_up(["div", "div", "section", "table tr td"], strange, r))
    if container[-1].startswith("table"):
        container = (*root, "table", "tr", "td")
    main = []
    for b, y in zip(blocks, labels, strict=True):
        if y:
            places = [i for i, name in enumerate(b.path) if name.split()[0] in _MAIN_TAGS]
            main.append(Block(b.text, b.path[places[-1] + 1 :], b.linked))
    main = [Block(b.text, (*container, *b.path), b.linked) for b in _reshaped(main, strange, r)]

    def part(kind: str, path: tuple[str, ...]) -> list[Block]:
        name = pick(SIDE_NAMES[kind]) if r.random() < 0.6 else _made_up(["div", "section", "div", "ul" if kind == "nav" else "aside"], strange, r)
        path = _named(path, name)
        out = []
        for _ in range(int(r.integers(1, 7 if kind in ("nav", "comments", "sidebar") else 3))):
            words = pick(strange).split()
            n = (len(words) if r.random() < 0.5 else int(r.integers(3, 40))) if kind == "comments" else int(r.integers(1, 6)) if kind in ("nav", "form") else int(r.integers(2, 25))
            text = " ".join(words[:n])
            inner = {"nav": ("ul", "li", "a"), "comments": pick([("p",), ("div comment", "p"), ("li",)]), "form": pick([("label",), ("p",), ("button",)]), "sidebar": pick([("p",), ("ul", "li", "a")])}.get(kind, pick([(), ("p",)]))
            if text:
                out.append(Block(text, (*path, *inner), len(text) if "a" in inner else 0))
        return out

    before, after = [], []
    for kind, share in (("header", 0.5), ("nav", 0.8), ("notice", 0.5), ("ad", 0.5), ("form", 0.3)):
        before += part(kind, root) if r.random() < share else []
    for kind, share in (("comments", 0.6), ("sidebar", 0.6), ("form", 0.4), ("ad", 0.4), ("notice", 0.3), ("nav", 0.3), ("footer", 0.8)):
        after += part(kind, root) if r.random() < share else []
    out = [(b, 0) for b in before]
    for i, b in enumerate(main):
        out.append((b, 1))
        # more often at the head than farther down
        if r.random() < (0.25 if i == 0 else 0.05):
            out += [(x, 0) for x in part(pick(["ad", "notice", "sidebar", "form"]), container)]
    if r.random() < 0.3:
        out += [(x, 0) for x in part(pick(["comments", "form"]), container)]
    out += [(b, 0) for b in after]
    return [b for b, _ in out], np.array([y for _, y in out], np.float32)


def fit_blocks(known: list[tuple[list[Block], np.ndarray]], variants: int = 4) -> Labeller:
    """Trains on pages with labels and on variants of each."""
    r, hasher = np.random.default_rng(11), Hasher()
    strange = [b.text[:2000] for blocks, _ in known for b in blocks]
    xs, ys = [], []
    for blocks, y in known:
        for b, z in ((blocks, y), *(variant(blocks, y, strange, r) for _ in range(variants))):
            xs.append(hasher.page(b))
            ys.append(z)
    return train(xs, ys)


def fit_labeller(pages: DataFrame, *, fit_pages: int = FIT_PAGES, variants: int = 4, key: str = "page_id", html: str = "html") -> Labeller:
    """Trains on at most fit_pages pages of up to FIT_CHARS characters, chosen by a hash of their key; these go to the driver.

    Pages without article or main teach nothing; if there is none with them, a page of this kind is made up of fixed text.
    """
    rows = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).filter((F.length("h") > 0) & (F.length("h") <= FIT_CHARS))
    rank = F.xxhash64("k", "h")
    # the hashes first, so that no task sends pages that aren't chosen
    chosen = rows.select(rank.alias("rank")).distinct().orderBy("rank").limit(fit_pages)
    found = rows.withColumn("rank", rank).join(F.broadcast(chosen), "rank").dropDuplicates(["rank"]).orderBy("rank").select("h").collect()
    sample = [blocks_of(x["h"]) for x in found]
    known = [(b, y) for b in sample if b and (y := weak_labels(b)) is not None]
    if not known:
        page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title</h1><p>Some words of text, and more of it.</p></article><footer>End</footer></body></html>"
        known = [(b := blocks_of(page), weak_labels(b))]
    return fit_blocks(known, variants)


# --- extraction ----------------------------------------------------------------------------------------------------------


def label_pages(net: Labeller, pages: list[list[Block]], hasher: Hasher, group: int = 64, most: int = GROUP_BLOCKS) -> list[np.ndarray]:
    """Which blocks of each page are main text; pages of like length run together, up to group of them and most blocks with the
    padding, and a longer page runs alone, most blocks at a time."""
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        longest = len(pages[order[at]])
        if longest > most:
            out[order[at]] = net.long_scores(pages[order[at]], hasher, most) > 0
            at += 1
            continue
        to = at + 1
        while to < len(order) and to - at < group and (to - at + 1) * len(pages[order[to]]) <= most:
            to += 1
        part = order[at:to]
        x, mask = padded([hasher.page(pages[i]) for i in part])
        score = net.scores(x, mask)
        for j, i in enumerate(part):
            out[i] = score[j, : len(pages[i])] > 0
        at = to
    return out


def main_text(pages: DataFrame, net: Labeller, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each row of pages: the blocks that net labels as main text, joined by \\n, and its code points.

    The whole html is read; the network's memory doesn't grow with the page. Character references are decoded, and white space inside a block, line breaks too, is one space.
    A null or empty html gives an empty text; repeated rows give repeated rows; null keys and urls stay null; an empty table
    gives an empty table; other columns aren't read.
    """
    small_batches(pages.sparkSession, 500)
    weights = net.w
    hasher: list[Hasher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(weights)
        hasher[:] = hasher or [Hasher()]
        for part in by_bytes(batches, "h", BATCH_BYTES):
            found = [blocks_of(x) for x in part.column("h").to_pylist()]
            labels = label_pages(own, found, hasher[0])
            texts = ["\n".join(b.text for b, y in zip(blocks, main, strict=True) if y) for blocks, main in zip(found, labels, strict=True)]
            yield pa.record_batch([part.column("k"), part.column("u"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[key, url, "text", "n_chars"])

    kinds = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    return pages.selectExpr(f"`{key}` AS k", f"`{url}` AS u", f"`{html}` AS h").mapInArrow(run, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")
