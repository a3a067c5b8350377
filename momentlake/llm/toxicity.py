"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel (Lodhi et al. 2002) sums over all letter sequences of one length that two strings share, gaps allowed and damped, so
an insult with inserted or missing letters still looks like itself; normalised kernels of several lengths are averaged and
raised to a power, which is a kernel again. The machine learns from labelled sentences: a sentence's strings (its words, and
runs of single letters read as one word) bear the label of its text, so a string that clean and toxic sentences share alike
tells nothing, and one that toxic sentences have more often, or that is like such strings, gets a large margin. Telling strings
are shown disguised too. A text is scored by its most suspicious strings, through logistic curves fitted to labelled
texts. Every string of every text goes through the kernel.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Letters of a subsequence, what each letter that it spans costs, and the power of the mean kernel.
ORDERS, DECAY, POWER = (2, 3), 0.7, 3
#: Letters that a string may have; longer words are read in windows that overlap by half.
WIDTH = 14
#: Landmarks among telling strings, and among others (twice: at large, and those that come closest to the margin).
TELLING_MARKS, OTHER_MARKS = 64, 16
#: Labelled rows of each class that are learned from, at most (those whose hashed ids are least).
SAMPLE_ROWS = 5_000
#: Strings of their sentences that are learned from, at most: telling ones first, then by hash.
SAMPLE_STRINGS = 30_000
RIDGE = 1e-6
#: What calling clean strings toxic costs against missing toxic ones, and the power that evens out how often strings are.
COST, FLAT = 10.0, 0.3
#: How much a disguise counts against the string itself.
DISGUISE = 1.0
#: A string is telling if the likelihood ratio of its counts (G) is at least this. It bears the counts of all strings that are like it by NEAR at least.
LEAST_G, NEAR = 20.0, 0.58
#: A text's strings that its score is read from: so many of the largest margins.
TOP = 3
PREDICT_FROM = 0.7
#: Letter sequences that are worked out at once; about what a processor's cache holds.
CHUNK = 1 << 15
#: The margin of a text without words, and the least and most that a string can have.
FLOOR, CLIP = -1.0, 1.5
#: Words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 500_000
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]{1,2}){3,}[^\W\d_](?!\S)")
_PARTS = re.compile(r"[^\W\d_]+")
_INSERTS = "xzqe"


def fold_of(doc_id: Column) -> Column:
    """Rows of fold 1 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def strings_of(word: str) -> list[str]:
    """What a word is read as: its letters in lower case, also part by part, long ones in windows."""
    parts = _PARTS.findall(word.lower())
    if len(parts) > 1:
        parts.append("".join(parts))
    return [p[i : i + WIDTH] for p in parts if len(p) > 2 for i in (range(0, max(1, len(p) - WIDTH // 2), WIDTH // 2) if len(p) > WIDTH else (0,))]


def words_in(text: str | None) -> set[str]:
    words = set((text or "").split())
    words.update("".join(_PARTS.findall(m)) for m in _SPELLED.findall(text or ""))
    return words


@lru_cache(maxsize=128)
def _tuples(n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all letter sequences of a string of ``n`` letters (order x number) and what each costs."""
    at = np.array(list(combinations(range(n), order)), np.int64).reshape(-1, order).T
    return at, (DECAY ** (at[-1] - at[0] + 1)).astype(np.float32)


def _by_length(strings: list[str], most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of strings of one length and their code points, as many at a time as CHUNK allows, ``most`` at most."""
    order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
    lengths = np.array([len(strings[i]) for i in order])
    for n in np.unique(lengths).tolist():
        same = order[np.searchsorted(lengths, n) : np.searchsorted(lengths, n, "right")]
        step = max(1, min(most, CHUNK // comb(n, min(n, max(ORDERS))))) if n else len(same)
        for at in range(0, len(same), step):
            here = same[at : at + step]
            yield np.array(here), np.frombuffer("".join([strings[i] for i in here]).encode("utf-32-le"), np.int32).reshape(len(here), n)


def _norms(codes: np.ndarray) -> np.ndarray:
    """The roots of the kernels of strings of one length with themselves (orders x strings)."""
    n, t = codes.shape
    steps = np.arange(t)
    damp = np.where(steps[None, :] > steps[:, None], DECAY ** (steps[None, :] - steps[:, None] - 1).clip(0), 0).astype(np.float32)
    same = (codes[:, :, None] == codes[:, None, :]) * np.float32(DECAY**2)
    total, ends = np.zeros((len(ORDERS), n), np.float32), same
    for o in range(1, min(max(ORDERS), t) + 1):
        if o > 1:  # a sequence goes on at any later place of both; ends is symmetric
            ahead = (ends.reshape(-1, t) @ damp).reshape(n, t, t).transpose(0, 2, 1)
            ends = same * (ahead.reshape(-1, t) @ damp).reshape(n, t, t)
        if o in ORDERS:
            total[ORDERS.index(o)] = ends.sum((1, 2))
    return np.sqrt(total)


class _Sequences:
    """Letter sequences of landmarks, numbered; ``weights``: for each order where a sequence's entries start, each one's landmark, and what that has of it, divided by its norm."""

    def __init__(self, landmarks: list[str]):
        self.letters = np.unique(np.frombuffer("".join(landmarks).encode("utf-32-le"), np.int32)) if landmarks else np.zeros(0, np.int32)
        self.n, self.numbers = len(landmarks), [None] * len(ORDERS)
        self.keys: list[np.ndarray] = []
        self.weights: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in ORDERS]
        for at, codes in _by_length(landmarks):
            norms = _norms(codes)
            for k, keys, cost in self._keys(codes):
                found[k].append((keys.ravel(), np.repeat(at, keys.shape[1]), (cost / np.maximum(norms[k], 1e-9)[:, None]).ravel()))
        for parts in found:
            keys, at, cost = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            own, number = np.unique(keys * len(landmarks) + at, return_inverse=True)  # sequence and landmark
            keys, at = np.divmod(own, max(1, len(landmarks)))
            own, starts = np.unique(keys, return_index=True)
            self.keys.append(own)
            self.weights.append((np.append(starts, len(keys)), at, np.bincount(number, cost)))
    def _keys(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each order: its number, a key for each letter sequence (strings x sequences), and their costs. Letters that no landmark has are 0."""
        if not len(self.letters):
            return
        at = np.searchsorted(self.letters, codes).clip(0, len(self.letters) - 1)
        ids, base = np.where(self.letters[at] == codes, at + 1, 0), len(self.letters) + 1
        for k, o in enumerate(ORDERS):
            if o > codes.shape[1]:
                continue
            places, cost = _tuples(codes.shape[1], o)
            keys = ids[:, places[0]]
            for row in places[1:]:
                keys = keys * base + ids[:, row]
            yield k, keys, cost

    def values(self, strings: list[str]) -> np.ndarray:
        """The kernel of each string with each landmark (strings x landmarks)."""
        out = np.zeros((len(strings), self.n), np.float32)
        for at, codes in _by_length(strings):
            norms, total = np.maximum(_norms(codes), 1e-9), np.zeros((len(at), self.n))
            for k, keys, cost in self._keys(codes):
                found = self._find(k, keys)
                rows, places = np.nonzero(found)  # sequences that a landmark has too; rows in order
                starts, marks, values = self.weights[k]
                entry = starts[found[rows, places] - 1]
                n = starts[found[rows, places]] - entry
                each = np.repeat(entry - np.cumsum(n) + n, n) + np.arange(n.sum())
                share = (cost[places] / norms[k, rows]).repeat(n) * values[each]
                total += np.bincount((rows * self.n).repeat(n) + marks[each], share, len(at) * self.n).reshape(len(at), self.n)
            out[at] = (total / len(ORDERS)) ** POWER
        return out

    def _find(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Each key's number from 1 on, 0 for those that no landmark has: by an array if it is small enough, else by binary search."""
        size = (len(self.letters) + 1) ** ORDERS[k]
        if size > 1 << 23:
            own = self.keys[k]
            at = np.searchsorted(own, keys).clip(0, len(own) - 1)
            return np.where(own[at] == keys, at + 1, 0)
        if self.numbers[k] is None:
            self.numbers[k] = np.zeros(size, np.int32)
            self.numbers[k][self.keys[k]] = np.arange(1, len(self.keys[k]) + 1)
        return self.numbers[k][keys]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """The mean of the normalised kernels of all orders, to the power POWER (a x b): 1 for equal strings, 0 where no sequence is shared."""
    return _Sequences(b).values(a)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the kernel values with the landmarks (Nyström map and hyperplane multiplied)
    bias: float
    first: tuple[float, ...] = (1.0, -3.0)  # slope of a text's largest margin, and shift
    curve: tuple[float, ...] = (1.0, *[0.0] * (TOP - 1), -3.0)  # slopes of a text's TOP margins, and shift
    _marks: _Sequences | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_marks": None}

    def margins(self, strings: list[str]) -> np.ndarray:
        """The margin of each string: the kernel machine with landmarks and weights multiplied out."""
        out = np.full(len(strings), FLOOR)
        if not strings or not self.landmarks:
            return out
        if self._marks is None:
            self._marks = _Sequences(self.landmarks)
        for i in range(0, len(strings), 8192):
            out[i : i + 8192] = np.clip(self._marks.values(strings[i : i + 8192]) @ self.weights + self.bias, FLOOR, CLIP)
        return out

    def score(self, tops: np.ndarray) -> np.ndarray:
        """The chance that a text is toxic, by its TOP margins (texts x TOP)."""
        tops = np.asarray(tops, float).reshape(-1, TOP)
        z = np.maximum(tops[:, :1] @ self.first[:-1] + self.first[-1], tops @ self.curve[:-1] + self.curve[-1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def variants(word: str) -> list[str]:
    """A word as it is disguised: a letter or two put in, one doubled or left out, in places that depend on the word alone."""
    n = len(word)
    at = range(1, n)
    once = [word[:i] + _INSERTS[(i + n) % len(_INSERTS)] + word[i:] for i in at]
    twice = [word[:i] + _INSERTS[i % len(_INSERTS)] + word[i : i + 2] + _INSERTS[(i + 3) % len(_INSERTS)] + word[i + 2 :] for i in range(1, n - 1)]
    doubled = [word[:i] + word[i - 1] + word[i:] for i in at]
    short = [word[:i] + word[i + 1 :] for i in range(1, n - 1)] if n > 5 else []
    return list(dict.fromkeys(w[:WIDTH] for w in [*once, *twice, *doubled, *short]))


def families(sketches: list[list[int]]) -> list[int]:
    """The number of each document's family: documents that share an entry of their sketches, however indirectly."""
    parent = list(range(len(sketches)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, sketch in enumerate(sketches):
        for k, x in enumerate(sketch or []):
            parent[root(i)] = root(first.setdefault((k, x), i))
    return [root(i) for i in range(len(sketches))]


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id`` and ``s``: least hashes of a text's windows of four words. Near copies share most of them, other texts none."""
    words = docs.select(doc_id, F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.xxhash64(w)).alias("h"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - 4, F.lit(0)))
    windows = words.select(doc_id, F.transform(starts, lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(4)))).alias("w"))
    return windows.select(doc_id, F.array(*(F.array_min(F.transform("w", lambda h, k=k: F.xxhash64(h, F.lit(k)))) for k in range(6))).alias("s"))


def _g(t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Twice the log of the likelihood ratio of two shares, negative where the toxic one is smaller."""
    part = lambda k, n, p: k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))
    a, b, both = t / max(toxic, 1), c / max(clean, 1), (t + c) / max(toxic + clean, 1)
    return 2 * (part(t, toxic, a) + part(c, clean, b) - part(t, toxic, both) - part(c, clean, both)) * np.sign(a - b)


def _apart(strings: list[str], most: int) -> list[str]:
    """The first string, then again and again the one that is least like those chosen."""
    if not strings:
        return []
    alike = kernel(strings, strings)
    chosen, like = [0], alike[:, 0]
    while len(chosen) < min(most, len(strings)) and like.min() < 0.9:
        chosen.append(int(like.argmin()))
        like = np.maximum(like, alike[:, chosen[-1]])
    return [strings[i] for i in chosen]


def fit(strings: list[str], t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> Model:
    """A linear machine with squared hinge loss in the Nyström space of landmarks.

    ``t`` and ``c``: of how many of the ``toxic`` and ``clean`` texts a string is. It is an example of each class, weighted by
    its share of that class's strings; a telling one's disguises are examples too.
    """
    g = _g(t, c, toxic, clean)
    telling = [strings[i] for i in np.argsort(-g, kind="stable") if g[i] >= LEAST_G]
    if not telling or not clean:
        return Model([], np.zeros(0), FLOOR)
    place = {s: i for i, s in enumerate(strings)}
    # A telling string stands for those like it: it and its disguises bear the counts of all of them.
    telling = telling[: 4 * TELLING_MARKS]
    base = kernel(strings, telling) ** (1 / POWER)
    alike = np.where(base >= NEAR, base, 0)
    up, down = t / t.sum(), COST * c / c.sum()
    near_up, near_down = alike.T @ up, alike.T @ down
    forms = [(v, j) for j, s in enumerate(telling) for v in variants(s) if v not in place]
    here, of = [place[s] for s in telling], [j for _, j in forms]
    up[here], down[here] = near_up, near_down
    up, down = np.concatenate([up, DISGUISE * near_up[of]]), np.concatenate([down, DISGUISE * near_down[of]])
    flat = np.maximum(up + down, 1e-12) ** (FLAT - 1)
    up, down = up * flat / (flat * (up + down)).sum(), down * flat / (flat * (up + down)).sum()
    marks = _apart(telling, TELLING_MARKS)
    others = [s for s, x in zip(strings, g) if x < LEAST_G]
    marks += _apart(others[: 8 * OTHER_MARKS], OTHER_MARKS)
    for again in (True, False):
        values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
        root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        x = kernel(strings + [v for v, _ in forms], marks) @ root
        weight, bias = _machine(x, up, down)
        if again:  # the clean strings that come closest are landmarks too
            f = x[: len(strings)] @ weight + bias
            hard = [strings[i] for i in np.argsort(-f, kind="stable") if g[i] < LEAST_G and t[i] * clean < 3 * c[i] * toxic + 1][: 4 * OTHER_MARKS]
            marks += _apart(hard, OTHER_MARKS)
            marks = list(dict.fromkeys(marks))
    return Model(marks, root @ weight, bias)


def _machine(x: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton's method on the squared hinge of rows that are examples of both classes, weighted: least squares over the rows inside the margin, until those stay the same."""
    design = np.column_stack([x, np.ones(len(x))]).astype(float)
    ridge, w, before = np.diag([RIDGE] * x.shape[1] + [1e-9]), np.zeros(x.shape[1] + 1), None
    for _ in range(30):
        f = design @ w
        inside = (f < 1, f > -1)
        if before is not None and all((a == b).all() for a, b in zip(inside, before)):
            break
        plus, minus = up * inside[0], down * inside[1]
        w, before = np.linalg.solve(design.T @ (design * (plus + minus)[:, None]) + ridge, design.T @ (plus - minus)), inside
    return w[:-1], float(w[-1])


def _curve(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slopes, none negative, and shift of a logistic curve, by Newton's method."""
    use = np.ones(x.shape[1], bool)
    while True:
        design, theta = np.column_stack([x[:, use], np.ones(len(x))]), np.zeros(use.sum() + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            grad = design.T @ (p - labels) / len(labels) + 1e-4 * theta
            hess = design.T @ (design * (p * (1 - p))[:, None]) / len(labels) + 1e-4 * np.eye(len(theta))
            step = np.linalg.solve(hess, grad)
            theta = theta - step / max(1, np.abs(step).max() / 2)
        if (theta[:-1] >= 0).all():
            break
        use[np.flatnonzero(use)[int(theta[:-1].argmin())]] = False
    out = np.zeros(x.shape[1] + 1)
    out[np.append(use, True)] = theta
    return out


def calibrate(model: Model, tops: np.ndarray, labels: np.ndarray) -> Model:
    """The curve over the largest margin alone and the one over all TOP margins, from labelled texts."""
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    return replace(model, first=tuple(map(float, _curve(tops[:, :1], labels))), curve=tuple(map(float, _curve(tops, labels))))


class _Margins:
    """Words' largest margins, remembered by the words' 64-bit hashes: sixteen bytes a word, whatever its length."""

    def __init__(self, model: Model):
        self.model, self.keys, self.values = model, np.zeros(0, np.int64), np.zeros(0)

    def of(self, words: set[str]) -> dict[str, float]:
        """The margins of ``words``. New ones are worked out together; when there are too many, all that was known before is forgotten."""
        listed = list(words)
        hashes = np.fromiter(map(hash, listed), np.int64, len(listed))
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(listed), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        found = np.empty(len(listed))
        found[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            found[new] = self._learned([listed[i] for i in new])
            if len(self.keys) + len(new) > CACHE_WORDS:
                self.keys, self.values = self.keys[:0], self.values[:0]
            fresh, first = np.unique(hashes[new], return_index=True)
            place = np.searchsorted(self.keys, fresh)
            self.keys, self.values = np.insert(self.keys, place, fresh), np.insert(self.values, place, found[new][first])
        return dict(zip(listed, found.tolist()))

    def _learned(self, words: list[str]) -> list[float]:
        read = [strings_of(w) for w in words]
        strings = list({s for several in read for s in several})
        margin = dict(zip(strings, self.model.margins(strings).tolist()))
        return [max(map(margin.__getitem__, several), default=FLOOR) for several in read]


def tops_of(words: set[str], margins: dict[str, float]) -> list[float]:
    """The TOP largest margins among different strings; a word is one string however it is written or followed."""
    out: dict[str, float] = {}
    for w in heapq.nlargest(8 * TOP, words, key=margins.__getitem__):
        out.setdefault("".join(_PARTS.findall(w.lower())), margins[w])
        if len(out) == TOP:
            break
    return [*out.values(), *[FLOOR] * (TOP - len(out))]


#: Of this worker: the model it has last worked with, and the words' margins.
_own: dict[bytes, _Margins] = {}


def _margins(model: Model) -> _Margins:
    key = model.weights.tobytes() + repr((model.landmarks, model.bias)).encode()
    if key not in _own:
        _own.clear()
        _own[key] = _Margins(model)
    return _own[key]


def with_tops(docs: DataFrame, model: Model, text: str = "text", to: str = "tops") -> DataFrame:
    """``docs`` with the TOP largest margins of each text's strings, largest first; FLOOR where a text, or null, has fewer. No shuffle."""
    kept = docs.drop(to)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about a hundred strings and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _margins(shared.value)
        for b in batches:
            out: list[float] = []
            for at in range(0, b.num_rows, 256):
                sets = [words_in(t.as_py()) for t in b.column(text).slice(at, 256)]
                margins = known.of(set().union(*sets))
                for s in sets:
                    out += tops_of(s, margins)
            lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * TOP, np.array(out, float))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, to])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{types}, `{to}` array<double>")


def _telling(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Whether ``_g`` of two counts is LEAST_G at least."""
    part = lambda k, n, p: k * F.log(F.greatest(p, F.lit(1e-12))) + (F.lit(n) - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    a, b, both = t / max(toxic, 1), c / max(clean, 1), (t + c) / max(toxic + clean, 1)
    return (a > b) & (2 * (part(t, toxic, a) + part(c, clean, b) - part(t, toxic, both) - part(c, clean, both)) >= LEAST_G)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``rows`` labelled rows of each class outside fold 1, and at most SAMPLE_STRINGS strings of their sentences.

    Null labels and null ids teach nothing; an id that is labelled twice counts once, as toxic if either says so. Copies of one
    text count once. Without rows of both classes the model calls nothing toxic.
    """
    usable = labels.select(labels[doc_id].alias("_id"), labels[label].cast("int").alias("_y")).where((fold_of(F.col("_id")) != 1) & F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    usable = usable.groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows) for y in (0, 1)]
    sample = docs.select(docs[doc_id].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_text")).join(F.broadcast(picked[0].unionByName(picked[1])), "_id").persist()
    try:
        # Copies share all their strings; only strings of several families of copies tell anything.
        rows_ = sketches(sample, "_id", "_text").join(F.broadcast(picked[0].unionByName(picked[1])), "_id").orderBy("_id").collect()
        family = families([r["s"] for r in rows_])
        clean, toxic = (len({f for r, f in zip(rows_, family) if r["_y"] == y}) for y in (0, 1))
        if not clean or not toxic:
            return fit([], np.zeros(0), np.zeros(0), 0, 0)
        of = docs.sparkSession.createDataFrame(list({(r["_id"], f) for r, f in zip(rows_, family)}), f"_id {sample.schema['_id'].dataType.simpleString()}, _f int")
        words = F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}{3,}"), F.lit(0))
        cuts = lambda w: F.transform(F.sequence(F.lit(0), F.when(F.length(w) > WIDTH, F.length(w) - WIDTH // 2 - 1).otherwise(0), F.lit(WIDTH // 2)), lambda i: F.substr(w, i + 1, F.lit(WIDTH)))
        seen = sample.join(F.broadcast(of), "_id").select("_y", "_f", F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct(words), cuts)))).alias("_w")).distinct()
        counts = seen.groupBy("_w").agg(F.sum("_y").alias("t"), F.sum(1 - F.col("_y")).alias("c"))
        found = counts.orderBy(~_telling(F.col("t"), F.col("c"), toxic, clean), F.xxhash64("_w"), "_w").limit(SAMPLE_STRINGS).collect()
        model = fit([r["_w"] for r in found], np.array([r["t"] for r in found], float), np.array([r["c"] for r in found], float), toxic, clean)
        scored = with_tops(sample, model, "_text").select("tops", "_y").collect()
        return calibrate(model, np.array([r["tops"] for r in scored]).reshape(-1, TOP), np.array([r["_y"] for r in scored], float))
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (such columns are replaced). Null and empty texts have a score too.

    Each row is scored by its text alone, repeated rows alike; an empty table gives no rows. A text of any length is read whole, and a
    word of any length in windows.
    """
    kept = docs.drop("score", "predicted")
    tops = free_name(kept, "_tops")
    line = lambda slopes: sum((F.lit(a) * F.get(tops, F.lit(k)) for k, a in enumerate(slopes[:-1])), F.lit(slopes[-1]))
    z = F.greatest(line(model.first), line(model.curve))
    out = with_tops(kept, model, text, tops).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int")).drop(tops)
