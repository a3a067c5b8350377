"""Token counts: a dynamic programme over prefixes gives the exact count at every prefix of a text.

A byte-pair encoding is right if and only if every two tokens that stand side by side would also come
out of encoding just those two. So the last token of each prefix follows from the last tokens of shorter
prefixes, and one pass over a word gives the count at each of its prefixes. A text's index is the sum of
its words' counts; ``prefix_index`` stores it, and a budget or a cut is then looked up in it, and nothing is encoded again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Words that a Python worker remembers before it starts afresh, and the letters of a word up to which it is remembered.
CACHE_WORDS, CACHED_LETTERS = 800_000, 64
#: Pairs of tokens that it remembers.
CACHE_PAIRS = 1_000_000
#: White space that Python's split() cuts at and the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[\\t-\\r \x85\xa0  -     　]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others get code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Counts of a word-end BPE (a ``tokenizers`` JSON file) at every prefix.

    The file must have the parts whose rules are built in here: NFC, white space and lower case as
    normalizer, a split pattern, byte letters and a suffix that marks word ends. Others raise ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path} isn't a lower-casing BPE with word ends")
        self.end = model["end_of_word_suffix"]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)")
        self.letters = _byte_letters()
        self.ascii = {b: self.letters[b] for b in range(128)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        base = [*self.letters, *(c + self.end for c in self.letters)]
        made = [a + b for a, b in pairs]
        #: Numbers by age: single letters first, then what each merge makes. A number is a rank.
        self.number = {t: i for i, t in enumerate([*base, *made])}
        if len(self.number) != len(base) + len(made):
            raise ValueError(f"{path} makes a token in two ways")
        number = self.number
        self.halves = [*((i, i) for i in range(len(base))), *((number[a], number[b]) for a, b in pairs)]
        self.merge = {x: len(base) + i for i, x in enumerate(self.halves[len(base) :])}
        self.longest = max(map(len, number))
        self.fits: dict[tuple[int, int], bool] = {}
        #: The programme's cells: a prefix's last token (its number) and its count, no word end marked.
        self.cells: dict[str, tuple[int, int]] = {}
        self.totals = _Totals(self)

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side: no merge across the seam comes before the
        merges that made the parts that touch it. Taking the younger part back shows each such moment."""
        a, b, limit = left, right, len(self.halves)
        while True:
            if self.merge.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def _ends(self, text: str) -> list[int]:
        """Counts at each byte's end of a word (in byte letters), every prefix encoded as a word of its own."""
        before = self._before(text)
        return [self._closed(text, i, before) for i in range(1, len(text) + 1)]

    def _before(self, text: str) -> list[tuple[int, int]]:
        """The programme's cells of ``text`` from the empty prefix on. A short prefix that another word has had is known; a cell
        needs no more of the text than the longest token, so that a word of any length costs in proportion to it."""
        cells, number, fits, out = self.cells, self.number, self.fits, [(-1, 0)]
        if len(cells) >= CACHE_WORDS:
            cells.clear()
        for i in range(1, len(text)):
            head = text[:i] if i <= CACHED_LETTERS else None
            if head is None or (cell := cells.get(head)) is None:
                for j in range(max(0, i - self.longest), i):
                    if (x := number.get(text[j:i])) is not None and (j == 0 or self._fits(out[j][0], x, fits)):
                        cell = (x, out[j][1] + 1)
                        break
                if head is not None:
                    cells[head] = cell
            out.append(cell)
        return out

    def _closed(self, text: str, i: int, before: list[tuple[int, int]]) -> int:
        """The count of the first ``i`` letters of ``text`` as a whole word: its last token bears the word's end."""
        number, fits, end = self.number, self.fits, self.end
        for j in range(max(0, i - self.longest), i):
            if (x := number.get(text[j:i] + end)) is not None and (j == 0 or self._fits(before[j][0], x, fits)):
                return before[j][1] + 1
        raise ValueError("a byte without a token")

    def _letters(self, word: str) -> str:
        return word.translate(self.ascii) if word.isascii() else "".join([self.letters[b] for b in word.encode()])

    def _word(self, word: str) -> list[int]:
        ends = self._ends(self._letters(word))
        return [ends[k - 1] for k in accumulate(len(c.encode()) for c in word)]

    def _fits(self, left: int, right: int, known: dict[tuple[int, int], bool]) -> bool:
        if (fit := known.get((left, right))) is None:
            if len(known) >= CACHE_PAIRS:
                known.clear()
            fit = known[left, right] = self._fit(left, right)
        return fit

    def _plain(self, text: str) -> list[int]:
        """Counts at each character of a piece without white space and special tokens, already normalised."""
        out: list[int] = []
        done = 0
        for m in self.split.finditer(text):
            word = m[0]
            if word[0] == "'" and len(word) > 2:  # an unfinished contraction is a quote and letters
                quote = self._word("'")[0]
                counts = [quote, *(quote + x for x in self._word(word[1:-1])), self._word(word)[-1]]
            else:
                counts = self._word(word)
            out += [done + x for x in counts]
            done = out[-1]
        return out

    def pieces(self, word: str) -> Iterator[tuple[str, bool]]:
        """A word's special tokens (True) and the normalised text between them."""
        at = 0
        for m in [*self.special.finditer(word), None]:
            piece = unicodedata.normalize("NFC", word[at : m.start() if m else len(word)])
            yield "".join([c.lower() for c in piece]) if not piece.isascii() else piece.lower(), False
            if m:
                yield m[0], True
                at = m.end()

    def total(self, word: str) -> int:
        """The count of a run without white space: the programme's last cells."""
        n = 0
        for piece, special in self.pieces(word):
            if special:
                n += 1
            else:
                for m in self.split.findall(piece):
                    if m == word:
                        text = self._letters(m)
                        n += self._closed(text, len(text), self._before(text))
                    else:  # the same word, with or without a comma behind it, is worked out once
                        n += self.totals[m]
        return n

    def table(self, word: str) -> tuple[int, ...]:
        """Counts at every prefix of the normalised ``word`` (a run without white space), 0 first."""
        out = [0]
        for piece, special in self.pieces(word):
            done = out[-1]
            out += [done + x for x in (self._plain(piece.lower())[:-1] if special else self._plain(piece))]
            if special:
                out.append(done + 1)
        return tuple(out)

    def words(self, text: str) -> list[str]:
        return [w for w in _SPACES.split(text) if w] if _SEPARATORS.search(text) else text.split()

    def count(self, text: str | None) -> int:
        return sum(map(self.totals.__getitem__, self.words(text or "")))

    def index(self, text: str | None) -> tuple[list[str], list[int]]:
        """The words of a text and the count at each word's end."""
        words = self.words(text or "")
        return words, list(accumulate(map(self.totals.__getitem__, words)))

    def spans(self, text: str) -> Iterator[tuple[str, int]]:
        """The words of a text and where each ends in it."""
        at = 0
        for word in self.words(text):
            at = text.index(word, at) + len(word)
            yield word, at

    def keep(self, text: str | None, budget: int) -> tuple[str, int]:
        """The longest prefix (white space between words as one space) of at most ``budget`` tokens, and its count."""
        words, ends = self.index(text)
        k = bisect_right(ends, budget)
        done = ends[k - 1] if k else 0
        head = " ".join(words[:k])
        if k < len(words):
            steps = self.table(words[k])
            n = max(i for i in range(len(steps)) if i == 0 or done + steps[i] <= budget)
            body = unicodedata.normalize("NFC", words[k])
            if n and len(steps) == len(body) + 1:
                return (head + " " if head else "") + body[:n], done + steps[n]
        return head, done


class _Totals(dict):
    """A word's count, from its table when first asked for."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.total(word)
        if len(word) <= CACHED_LETTERS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One for each Python worker; its words stay known from task to task."""
    return PrefixCounter(path)


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048, n_tokens: str = "n_tokens", over: str = "over_limit") -> DataFrame:
    """``df`` with the exact token count of ``text`` and whether it is over ``limit``. One pass, no shuffle.

    ``tokenizer``: a file that every executor has. Null and empty texts have 0 tokens. Repeated rows are
    counted each. Columns of ``df`` that have the new columns' names are replaced. An empty table gives no rows. Texts and words of any
    length are read whole, in time and memory in proportion to it.
    """
    kept = df.drop(n_tokens, over)
    field = free_name(kept, "_n")
    schema = f"{field} long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            counts = pa.array([c.count(t.as_py()) for t in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, counts], [*b.schema.names, field])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    out = kept.mapInArrow(count, f"{types}, {schema}")
    return out.withColumnRenamed(field, n_tokens).withColumn(over, F.col(n_tokens) > limit)


def prefix_index(df: DataFrame, tokenizer: str, text: str = "text", to: str = "prefix_index") -> DataFrame:
    """``df`` with the stored index of ``text`` (a column ``to``, replaced if there): an array of (``end``, ``count``), for each word the number of
    characters up to its end and the exact count of that prefix. Null and empty texts have an empty one. Written as a table, it answers
    questions about budgets and cuts (``count_at``, ``cut_at``) without encoding anything again.
    """
    kept = df.drop(to)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            ends, counts, offsets = [], [], [0]
            for t in b.column(text):
                n = 0
                for word, end in c.spans(t.as_py() or ""):
                    n += c.totals[word]
                    ends.append(end)
                    counts.append(n)
                offsets.append(len(ends))
            entries = pa.StructArray.from_arrays([pa.array(ends, pa.int32()), pa.array(counts, pa.int32())], ["end", "count"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], [*b.schema.names, to])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(index, f"{types}, `{to}` array<struct<end:int,count:int>>")


def _last(index: Column, within: Callable[[Column], Column]) -> Column:
    return F.element_at(F.filter(index, within), -1)


def count_at(index: Column, end: Column) -> Column:
    """The count of the words that end within the first ``end`` characters, by the stored index alone."""
    return F.when(F.size(F.filter(index, lambda x: x["end"] <= end)) > 0, _last(index, lambda x: x["end"] <= end)["count"]).otherwise(F.lit(0)).cast("long")


def cut_at(index: Column, budget: Column) -> Column:
    """How many characters of a text are whole words of at most ``budget`` tokens together, by the stored index alone."""
    return F.when(F.size(F.filter(index, lambda x: x["count"] <= budget)) > 0, _last(index, lambda x: x["count"] <= budget)["end"]).otherwise(F.lit(0)).cast("long")


def within_budget(df: DataFrame, tokenizer: str, budget: int, text: str = "text", to: str = "kept_text") -> DataFrame:
    """``df`` with ``text`` cut to the longest prefix of at most ``budget`` tokens (which may end inside a word; white space between words as one space), in column ``to``. Null gives an empty text."""
    kept = df.drop(to)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.keep(t.as_py(), budget)[0] for t in b.column(text)], pa.string())], [*b.schema.names, to])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(cut, f"{types}, `{to}` string")
