"""HTML extraction: a bidirectional LSTM (numpy) labels every text block of a page as main text or not.

A page is cut into leaf blocks in page order. A block is read as the sum of learned vectors of the hashed
parts of its tag path (tags, classes, ids), the mean of those of its hashed words, and a few numbers. The network
reads the whole sequence in both directions, so a block's label depends on all of the document. It is
trained on the driver from a bounded sample of pages whose own markup says what is main text, and from
pages composed of their blocks in other layouts; pages are then labelled where they lie, without a shuffle.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Pages that are learned from (those whose hashes are least), the most characters that such a page has, and pages composed from their blocks.
SAMPLE_PAGES, SAMPLED_CHARS, COMPOSED_PAGES = 120, 200_000, 420
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, HIDDEN = 512, 256, 16, 8, 16
NUMBERS = 8
EPOCHS, BATCH, RATE, SEED = 14, 30, 0.02, 7
#: Blocks that are read at once; the states of longer pages go on from one such stretch to the next.
STRETCH = 512

_SKIP = ("script", "style", "noscript", "template", "svg", "title", "iframe", "object")
_SKIPPED = re.compile(r"(%s)\b" % "|".join(_SKIP), re.I)
_SKIP_LETTERS = frozenset(c for t in _SKIP for c in (t[0], t[0].upper()))
_SKIP_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SKIP}
#: A whole tag with nothing odd in it: no < before its end. It gives up at the next <, so looking for one takes no time to speak of.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>"'<]*+)(?=[\s/>])((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>""")
_NAME_ENDS, _TAG_ENDS = re.compile(r"[\s/>]"), re.compile("[>\"']")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+|\d+", re.I)
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open one of these in front of it.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What training asks about a block's surroundings.
_AROUND = frozenset(("article", "nav", "aside", "footer", "form"))
#: What is remembered of attributes and words: not those that are longer.
REMEMBERED = 200
#: Characters of pages that are parsed at once.
PARSED_CHARS = 1 << 22
_BLOCKS_IN_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[int, ...]
    link: float
    depth: int
    around: frozenset[str]


@dataclass(slots=True)
class _Open:
    """An open element, with what it and those around it say of a block's path; inline ones add nothing."""

    tag: str
    path: tuple[int, ...] = ()
    depth: int = 0
    around: frozenset[str] = frozenset()


def _path_parts(tag: str, attributes: str) -> tuple[int, ...]:
    return (_parts_known if len(attributes) <= REMEMBERED else _parts)(tag, attributes)


def _parts(tag: str, attributes: str) -> tuple[int, ...]:
    names = [tag] + [f".{n.lower()}" for m in _NAMED.finditer(attributes) for n in _NAME.findall(m[1] or m[2] or m[3] or "")]
    return tuple(zlib.crc32(n.encode()) % PATH_BUCKETS for n in names)


_parts_known = lru_cache(maxsize=50_000)(_parts)


class _Next:
    """Where a pattern comes next. A place that was looked for from further ahead isn't looked for again."""

    def __init__(self, pattern: re.Pattern, page: str):
        self.pattern, self.page, self.since, self.found = pattern, page, 0, -1

    def __call__(self, at: int) -> int:
        if not self.since <= at <= self.found:
            m = self.pattern.search(self.page, at)
            self.since, self.found = at, m.start() if m else len(self.page)
        return self.found


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Markup of a page in order: start, end, name in small letters (empty for comments, declarations and elements whose content is no text), whether it closes, attributes.

    One pass: a page of n characters takes time in proportion to n, however its tags and quotes are broken. What isn't closed
    by > outside of quotes is text; comments and elements without an end go on to the page's end.
    """
    last, quotes = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    name_end, tag_end = _Next(_NAME_ENDS, page), _Next(_TAG_ENDS, page)
    dead: set[int] = set()  # quotes that lead to no end
    at = page.find("<")
    while at >= 0:
        plain = _PLAIN.match(page, at)
        if plain and (plain[1] or plain[2][0] not in _SKIP_LETTERS or not _SKIPPED.match(plain[2])):
            yield at, plain.end(), plain[2].lower(), plain[1] == "/", plain[3]
            at = page.find("<", plain.end())
            continue
        stop, name, closes, attributes = -1, "", False, ""
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4) + 3
            stop = len(page) if stop < 3 else stop
        elif at >= last:
            at = page.find("<!--", at)  # the only markup that needs no >
            continue
        elif skipped := _SKIPPED.match(page, at + 1):
            found = _SKIP_ENDS[skipped[1].lower()].search(page, page.find(">", at) + 1)
            stop = found.end() if found else len(page)
        elif page[at + 1] in "!?":
            stop = page.find(">", at + 2) + 1
        else:
            closes = page[at + 1] == "/"
            first = at + 1 + closes
            if page[first : first + 1].isascii() and page[first : first + 1].isalpha():
                start = place = name_end(first)
                seen = []
                while True:
                    place = tag_end(place)
                    if place >= len(page):
                        break
                    if page[place] == ">":
                        name, attributes, stop = page[first:start].lower(), page[start:place], place + 1
                        break
                    if place in dead or place == quotes[page[place]]:
                        break
                    seen.append(place)
                    place = page.find(page[place], place + 1) + 1
                if stop < 0:
                    dead.update(seen)
        if stop >= 0:
            yield at, stop, name, closes, attributes
        at = page.find("<", stop if stop >= 0 else at + 1)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page: text between block tags, references decoded, white space as one space. Null and empty pages have none; a page of any length and nesting is read in one pass."""
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    outer: list[int] = []  # those of block tags
    parts: list[str] = []
    linked = 0
    links = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else _Open("")
            out.append(Block(text, top.path, min(1.0, linked / len(text)), top.depth, top.around))
        parts.clear()
        linked = 0

    def drop(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()
        while outer and outer[-1] >= i:
            outer.pop()

    at = 0
    for start, end, tag, closes, attributes in tokens(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            linked += len(piece) if links else 0
        at = end
        if not tag:
            continue
        if closes:
            if tag == "a":
                links = 0
            if tag not in _INLINE:
                close()
            if (mine := places.get(tag)) and (tag not in _INLINE or not outer or mine[-1] > outer[-1]):
                drop(mine[-1])
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in _INLINE:
            close()
            links = 0
            ends = _CLOSES.get(tag, ()) or (("p",) if tag in _BLOCKS_IN_P else ())
            for i in reversed(outer) if ends else ():
                if stack[i].tag in ends:
                    drop(i)
                    break
                if stack[i].tag not in ("td", "th", "p"):
                    break
        elif tag == "a":
            links = 1
        if tag not in _VOID:
            top = stack[-1] if stack else _Open("")
            places.setdefault(tag, []).append(len(stack))
            if tag in _INLINE:
                stack.append(_Open(tag, top.path, top.depth, top.around))
            else:
                outer.append(len(stack))
                more = tuple(dict.fromkeys(x for x in _path_parts(tag, attributes) if x not in top.path))
                stack.append(_Open(tag, top.path + more, top.depth + 1, top.around | {tag} if tag in _AROUND else top.around))
    parts.append(page[at:])
    close()
    return out


def features(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path buckets and their blocks, word buckets and their blocks, numbers."""
    n = len(blocks)
    path = [x for b in blocks for x in b.path]
    path_of = np.repeat(np.arange(n), [len(b.path) for b in blocks])
    words = [b.text.split() for b in blocks]
    word = [_word_bucket(w) for ws in words for w in ws]
    word_of = np.repeat(np.arange(n), [len(w) for w in words])
    numbers = np.zeros((n, NUMBERS), np.float32)
    for i, b in enumerate(blocks):
        size = len(b.text)
        numbers[i] = (np.log1p(size) / 6, b.link, min(1, len(words[i]) / 24), b.text[-1] in ".!?…:\"”", b.text[:1].isupper(), b.depth / 10, i / max(1, n - 1), 1.0)
    return np.array(path, np.int64), path_of, np.array(word, np.int64), word_of, numbers


def _word_bucket(word: str) -> int:
    return _bucket_known(word) if len(word) <= REMEMBERED else _bucket(word)


def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORD_BUCKETS


_bucket_known = lru_cache(maxsize=200_000)(_bucket)


class Network:
    """Embeddings, an LSTM in each direction, a logistic unit. Sequences of a batch are padded at the end."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        width = PATH_DIM + WORD_DIM + NUMBERS
        draw = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        self.p = {"path": draw(PATH_BUCKETS, PATH_DIM), "word": draw(WORD_BUCKETS, WORD_DIM), "out": draw(2 * HIDDEN + PATH_DIM, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(width, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"g{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}

    def inputs(self, f) -> np.ndarray:
        path, path_of, word, word_of, numbers = f
        n = len(numbers)
        e = np.zeros((n, PATH_DIM), np.float32)
        np.add.at(e, path_of, self.p["path"][path])
        w = np.zeros((n, WORD_DIM), np.float32)
        np.add.at(w, word_of, self.p["word"][word])
        w /= np.maximum(np.bincount(word_of, minlength=n), 1)[:, None]
        return np.concatenate([e, w, numbers], axis=1)

    @staticmethod
    def _sig(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, d: str, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """x: time x batch x width; ``state``: where the stretch read before has ended. States past a sequence's end are held at zero, so that reading backwards starts at its end."""
        steps, n = x.shape[:2]
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out, kept = np.zeros((steps, n, HIDDEN), np.float32), [None] * steps
        pre = x @ self.p[f"x{d}"] + self.p[f"g{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p[f"h{d}"]
            i, f, o = (self._sig(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            kept[t] = (h, c, i, f, o, g, tc)
            m = mask[t][:, None]
            h, c = o * tc * m, c_new * m
            out[t] = h
        return out, kept, (h, c)

    def _top(self, hf: np.ndarray, hb: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.concatenate([hf, hb, x[..., :PATH_DIM]], axis=2)
        return self._sig((top @ self.p["out"])[..., 0] + self.p["bias"]), top

    def forward(self, x: np.ndarray, mask: np.ndarray):
        hf, kf, _ = self._run(x, "f", mask)
        hb, kb, _ = self._run(x, "b", mask)
        return *self._top(hf, hb, x), kf, kb

    def _back(self, x: np.ndarray, d: str, kept: list, dh_all: np.ndarray, mask: np.ndarray, grads: dict) -> np.ndarray:
        steps, n = x.shape[:2]
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        dz_all = np.zeros((steps, n, 4 * HIDDEN), np.float32)
        dw = np.zeros_like(self.p[f"h{d}"])
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            h0, c0, i, f, o, g, tc = kept[t]
            m = mask[t][:, None]
            dh = (dh + dh_all[t]) * m
            dc = dc * m + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            dw += h0.T @ dz
            dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"h{d}"], grads[f"x{d}"], grads[f"g{d}"] = dw, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
        return dz_all @ self.p[f"x{d}"].T

    def fit(self, pages: list[tuple[list[Block], np.ndarray]]) -> Network:
        rng = np.random.default_rng(SEED)
        feats = [(features(b), y.astype(np.float32)) for b, y in pages if b]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(feats))
            order = order[np.argsort([len(feats[i][1]) // 8 for i in order], kind="stable")]
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for k in rng.permutation(len(batches)):
                part = [feats[i] for i in batches[k]]
                step += 1
                self._step(part, moments, step, RATE * (1 - epoch / EPOCHS) + 1e-3)
        return self

    def _batch(self, feats: list) -> tuple[np.ndarray, np.ndarray]:
        longest = max(len(f[4]) for f in feats)
        x, mask = np.zeros((longest, len(feats), PATH_DIM + WORD_DIM + NUMBERS), np.float32), np.zeros((longest, len(feats)), np.float32)
        for j, f in enumerate(feats):
            x[: len(f[4]), j], mask[: len(f[4]), j] = self.inputs(f), 1
        return x, mask

    def _step(self, part: list, moments: dict, step: int, rate: float) -> None:
        x, mask = self._batch([f for f, _ in part])
        y = np.zeros(mask.shape, np.float32)
        for j, (_, labels) in enumerate(part):
            y[: len(labels), j] = labels
        p, top, kf, kb = self.forward(x, mask)
        delta = ((p - y) * mask / mask.sum())[..., None]
        grads = {"out": (top.reshape(-1, top.shape[2]).T @ delta.reshape(-1, 1)), "bias": delta.sum(keepdims=True).reshape(1)}
        dtop = delta @ self.p["out"].T
        dx = self._back(x, "f", kf, dtop[..., :HIDDEN], mask, grads) + self._back(x, "b", kb, dtop[..., HIDDEN : 2 * HIDDEN], mask, grads)
        dx[..., :PATH_DIM] += dtop[..., 2 * HIDDEN :]
        grads["path"], grads["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        for j, (f, _) in enumerate(part):
            path, path_of, word, word_of, numbers = f
            np.add.at(grads["path"], path, dx[path_of, j, :PATH_DIM])
            share = np.maximum(np.bincount(word_of, minlength=len(numbers)), 1)
            np.add.at(grads["word"], word, dx[word_of, j, PATH_DIM : PATH_DIM + WORD_DIM] / share[word_of][:, None])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            m, v = moments[k]
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _stretch(self, group: list[list[Block]], at: int) -> tuple[np.ndarray, np.ndarray]:
        """What the network reads of each page's blocks from ``at`` on, STRETCH of them at most."""
        here = [(j, b[at : at + STRETCH]) for j, b in enumerate(group) if len(b) > at]
        longest = max(len(b) for _, b in here)
        x, mask = np.zeros((longest, len(group), PATH_DIM + WORD_DIM + NUMBERS), np.float32), np.zeros((longest, len(group)), np.float32)
        for j, blocks in here:
            f = features(blocks)
            f[4][:, 6] = (at + np.arange(len(blocks))) / max(1, len(group[j]) - 1)
            x[: len(blocks), j], mask[: len(blocks), j] = self.inputs(f), 1
        return x, mask

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The chance of each block to be main text. Pages of like length are read together, whole: in each direction
        the states go on from stretch to stretch."""
        out = [np.zeros(len(b), np.float32) for b in pages]
        groups: list[list[int]] = []
        for i in sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i])):
            if groups and len(groups[-1]) < 128 and (len(groups[-1]) + 1) * len(pages[i]) <= 128 * STRETCH:
                groups[-1].append(i)
            else:
                groups.append([i])
        for group in groups:
            part = [pages[i] for i in group]
            ats, state, ahead = range(0, len(part[-1]), STRETCH), None, []
            for at in ats:
                x, mask = self._stretch(part, at)
                hidden, _, state = self._run(x, "f", mask, state)
                ahead.append(hidden)
            state = None
            for k in range(len(ats) - 1, -1, -1):
                if k < len(ats) - 1:
                    x, mask = self._stretch(part, ats[k])
                hidden, _, state = self._run(x, "b", mask, state)
                p = self._top(ahead.pop(), hidden, x)[0]
                for j, i in enumerate(group):
                    n = len(pages[i][ats[k] : ats[k] + STRETCH])
                    out[i][ats[k] : ats[k] + n] = p[:n, j]
        return out


def composed(texts: list[str], links: list[str], n: int, seed: int = SEED) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Pages in many layouts, made from texts: their HTML and the (text, main or not) of their blocks in order.

    Only markup tells main text from comments, notices and sidebars here: all are drawn from the same texts.
    """
    rng = np.random.default_rng(seed)
    one = lambda options: options[int(rng.integers(len(options)))]
    out = []
    for _ in range(n):
        truth: list[tuple[str, bool]] = []

        def leaf(tag: str, text: str, main: bool, truth=truth) -> str:
            text = " ".join(text.split())
            if text:
                truth.append((text, main))
            name, _, attributes = tag.partition(" ")
            return f"<{name}{' ' if attributes else ''}{attributes}>{html.escape(text)}</{name}>"

        def wrap(tag: str, *inner: str) -> str:
            name, _, attributes = tag.partition(" ")
            return f"<{name}{' ' if attributes else ''}{attributes}>{''.join(inner)}</{name}>"

        def text(short: bool = False) -> str:
            t = one(texts)
            return " ".join(t.split()[: int(rng.integers(3, 12))]) if short else t

        def link_list(tag: str, item: str = "li") -> str:
            items = []
            for _ in range(int(rng.integers(2, 7))):
                t = one(links) if rng.random() < 0.6 else text(True)
                truth.append((" ".join(t.split()), False))
                items.append(f'<{item}><a href="/x">{html.escape(t)}</a></{item}>')
            inner = "".join(items)
            return wrap(tag, wrap("ul", inner) if item == "li" else inner)

        def aside(tags: list[str], deep: int) -> str:
            inner = [leaf(one(["h2", "h3", "p", "div"]), text(True), False)] if rng.random() < 0.5 else []
            inner += [leaf(one(["p", "p", "div", "span"]) if deep else "p", text(rng.random() < 0.4), False) for _ in range(int(rng.integers(1, 4)))]
            return wrap(one(tags), *inner)

        notice = lambda: aside(["div class=\"cookie-notice\"", "div id=\"consent\"", "div class=\"notice\"", "div class=\"alert banner\"", "section class=\"gdpr popup\"", "div role=\"alert\"", "div class=\"newsletter subscribe\"", "div class=\"paywall\""], 0)
        advert = lambda: leaf(one(["div class=\"ad\"", "div class=\"advert\"", "div class=\"ads sponsored\"", "div id=\"ad-slot\"", "aside class=\"promo\"", "div class=\"advertisement\"", "p class=\"sponsor\""]), text(rng.random() < 0.5), False)
        form = lambda: wrap(one(["form", "form class=\"search\"", "form id=\"subscribe\"", "div class=\"login-form\""]), leaf("label", text(True), False), leaf("button", text(True), False))
        share = lambda: link_list(one(["div class=\"share\"", "div class=\"social\"", "div class=\"tags meta\"", "div class=\"related\"", "section class=\"related-posts\"", "div class=\"more recommended\""]), one(["li", "span"]))
        head = []
        if rng.random() < 0.6:
            head.append(wrap(one(["header", "div class=\"header\"", "div id=\"masthead\"", "div class=\"site-header top\""]), leaf(one(["h1", "p", "div", "div class=\"logo\""]), text(True), False), *([link_list("nav")] if rng.random() < 0.4 else [])))
        if rng.random() < 0.8:
            head.append(link_list(one(["nav", "div class=\"menu\"", "div id=\"nav\"", "div class=\"navbar\"", "nav class=\"main-menu\"", "div class=\"breadcrumb\""]), one(["li", "li", "span"])))
        for make, chance in ((advert, 0.5), (notice, 0.3), (form, 0.15)):
            if rng.random() < chance:
                head.append(make())
        left = [aside(["aside", "div class=\"sidebar\"", "div id=\"sidebar\"", "div class=\"side widget\""], 1)] if rng.random() < 0.2 else []
        body = []
        if rng.random() < 0.8:
            body.append(leaf(one(["h1", "h1", "h1 class=\"title\"", "h2"]), text(True), True))
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if kind < 0.72:
                body.append(leaf(one(["p", "p", "p", "p", "div"]), text(rng.random() < 0.2), True))
            elif kind < 0.8:
                body.append(leaf(one(["h2", "h3"]), text(True), True))
            elif kind < 0.86:
                body.append(wrap(one(["ul", "ol"]), *(leaf("li", text(rng.random() < 0.6), True) for _ in range(int(rng.integers(2, 5))))))
            elif kind < 0.9:
                body.append(wrap("blockquote", leaf("p", text(), True)))
            else:
                body.append(one([advert, notice, share, form])())
        if rng.random() < 0.2:
            body.append(share())
        container = one(["article", "article", "article class=\"post\"", "main", "div class=\"content\"", "div id=\"content\"", "div class=\"post entry\"", "div class=\"article-body\"", "section class=\"story text\"", "div id=\"main\"", ""])
        middle = wrap(container, *body) if container else "".join(body)
        if container and rng.random() < 0.3:
            middle = wrap(one(["main", "div class=\"wrapper\"", "div class=\"page container\""]), middle)
        tail = []
        if rng.random() < 0.45:
            comment = lambda: wrap(one(["div class=\"comment\"", "li class=\"comment\"", "article class=\"comment\""]), *([leaf(one(["h4", "div class=\"author\"", "p class=\"meta\""]), text(True), False)] if rng.random() < 0.6 else []), leaf("p", text(rng.random() < 0.3), False))
            title = [leaf(one(["h2", "h3"]), text(True), False)] if rng.random() < 0.6 else []
            tail.append(wrap(one(["section class=\"comments\"", "div id=\"comments\"", "div class=\"comment-list\"", "ol class=\"comments discussion\"", "div class=\"responses replies\""]), *title, *(comment() for _ in range(int(rng.integers(1, 5))))))
        for make, chance in ((lambda: aside(["aside", "div class=\"sidebar\"", "div id=\"sidebar\"", "div class=\"widget\""], 1), 0.3), (share, 0.3), (advert, 0.2), (form, 0.15), (notice, 0.15)):
            if rng.random() < chance:
                tail.append(make())
        if rng.random() < 0.85:
            tail.append(one([lambda: leaf("footer", "© " + text(True), False), lambda: wrap(one(["footer", "div class=\"footer\"", "div id=\"footer\""]), leaf("p", text(True), False)), lambda: link_list("footer")])())
        out.append(("<html><body>" + "".join(head + left) + middle + "".join(tail) + "</body></html>", truth))
    return out


def train(pages: list[str], n_composed: int = COMPOSED_PAGES) -> Network:
    """Learns from pages with an ``article`` element (what is in it is main text) and from pages composed of their blocks."""
    parsed = [blocks_of(p) for p in pages]
    own = [(b, np.array([x.around == {"article"} for x in b])) for b in parsed if any("article" in x.around for x in b)]
    texts = [x.text for b in parsed for x in b if x.link < 0.5] or ["Text of a page.", "Another text, a little longer than the first one."]
    links = [x.text for b in parsed for x in b if x.link >= 0.5] or ["Home", "About"]
    made = []
    for page, truth in composed(texts, links, n_composed):
        blocks, labels, k = blocks_of(page), [], 0
        for b in blocks:  # spans side by side are one block; the first one's label holds
            labels.append(truth[k][1] if k < len(truth) else False)
            got = 0
            while k < len(truth) and got < len(b.text.replace(" ", "")):
                got += len(truth[k][0].replace(" ", ""))
                k += 1
        made.append((blocks, np.array(labels)))
    return Network().fit(own + made)


def sample(pages: DataFrame, page_html: str, rows: int = SAMPLE_PAGES, chars: int = SAMPLED_CHARS) -> list[str]:
    """At most ``rows`` different pages of at most ``chars`` characters, those whose hashes are least. Hashes are chosen first, so that only these pages leave their tasks."""
    short = pages.select(F.col(page_html).alias("h")).where(F.length("h") <= chars)
    least = short.select(F.xxhash64("h").alias("k")).distinct().orderBy("k").limit(rows)
    found = short.join(F.broadcast(least), F.xxhash64("h") == F.col("k")).groupBy("k").agg(F.min("h").alias("h"))
    return [r["h"] for r in found.orderBy("k").collect()]


def _stretches(part: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs of equal parts, at most ``most`` rows each."""
    ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    start = 0
    for end in ends:
        for at in range(start, end, most):
            yield at, min(most, end - at)
        start = end


def extract(pages: DataFrame, network: Network, page_html: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``to`` (replaced if there): main blocks in page order, joined by two line ends.

    Null and empty pages, and pages without main blocks, have an empty text. Each row is read by itself; repeated rows give
    equal texts, an empty table none.
    """
    kept = pages.drop(*([to] if to != page_html else []))
    shared = pages.sparkSession.sparkContext.broadcast(network)  # about 30,000 numbers
    field = free_name(kept, "_main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Whole pages, a few million characters of them at once.
            sizes = np.cumsum([len(h.as_py() or "") for h in whole.column(page_html)])
            part = sizes // PARSED_CHARS if len(sizes) else sizes
            for b in (whole.slice(*x) for x in _stretches(part, 512)):
                parsed = [blocks_of(h.as_py()) for h in b.column(page_html)]
                texts = ["\n\n".join(x.text for x, p in zip(blocks, chances) if p >= 0.5) for blocks, chances in zip(parsed, shared.value.label(parsed))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, field])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{types}, {field} string").withColumnRenamed(field, to)
