"""Packing: vector bin packing with the dot-product heuristic.

Each example has a demand in three dimensions - tokens, segments, loss-bearing tokens - and a sequence
has a limit in each. The open sequence takes the example whose demand has the largest dot product with
the room that is left (all in shares of the limits) among those that fit. Where texts may be cut, an
example that doesn't fit gives the tokens that do, so that sequences fill to the last token.

Examples are packed inside the task that reads them, a window at a time: nothing is shuffled, no key can
be hot, and a task that is run again gives the same rows. A sequence's id holds its partition's number.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

#: Words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 150_000
#: Words that are longer are encoded each time, so that what is remembered has a bound.
REMEMBERED_LETTERS = 64
#: Examples that are packed together. More gives a better fit and needs more memory.
WINDOW = 512
#: Each partition numbers its sequences from its number times this.
SEQUENCES_EACH = 1 << 40


class _Run(Exception):
    """A space that white space or the end follows: such a text isn't cut at its spaces."""


def choose(demands: np.ndarray, room: np.ndarray, limits: np.ndarray, left: np.ndarray) -> int:
    """The example, of those ``left``, that fits into ``room`` and has the largest dot product with it; -1 if none fits.

    ``demands``: a row for each dimension.
    """
    weight = room / limits / limits
    gain = weight @ demands
    gain[~(left & (demands[0] <= room[0]) & (demands[1] <= room[1]) & (demands[2] <= room[2]))] = -1
    best = int(gain.argmax())
    return best if gain[best] >= 0 else -1


def pack(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each example (uncut). One that is over a limit by itself gets a bin of its own."""
    limits = np.asarray(limits, float)
    demands = np.ascontiguousarray(np.asarray(demands, float).T)
    left, bins, n = np.ones(demands.shape[1], bool), np.full(demands.shape[1], -1), 0
    for i in np.flatnonzero((demands.T > limits).any(axis=1)):
        left[i], bins[i], n = False, n, n + 1
    while left.any():
        room = limits.copy()
        while (i := choose(demands, room, limits, left)) >= 0:
            left[i], bins[i] = False, n
            room -= demands[:, i]
        n += 1
    return bins


def fill(lengths: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length), examples cut where that fills a sequence.

    ``loss``: the share of an example's tokens that bear loss (a cut piece counts as many, rounded up).
    What stays open at the end, and what the limit of segments or of loss closed early, is dealt out as
    sequences whose lengths are powers of two.
    """
    size, most, most_loss = limits
    rest, at = lengths.astype(np.int64).copy(), np.zeros(len(lengths), np.int64)
    bounds = np.array(limits, float)
    demands = np.array([rest, np.ones(len(rest)), np.ceil(rest * loss)], float)
    out: list[list[tuple[int, int, int]]] = []
    left = rest > 0
    while left.any():
        room, bin_ = bounds.copy(), []
        while room[0] >= 1 and room[1] >= 1 and left.any():
            i = choose(demands, room, bounds, left)
            n = int(rest[i]) if i >= 0 else 0
            if i < 0:  # none fits whole: cut the one whose head uses the room best
                head = np.minimum(rest, np.where(loss > 0, np.floor(room[2] / np.maximum(loss, 1e-9)), rest)).clip(0, room[0])
                head[~left] = 0
                i = int(np.argmax(head))
                if (n := int(head[i])) < 1:
                    break
            bin_.append((i, int(at[i]), n))
            room -= (n, 1, np.ceil(n * loss[i]))
            at[i] += n
            rest[i] -= n
            demands[0, i], demands[2, i] = rest[i], np.ceil(rest[i] * loss[i])
            left[i] = rest[i] > 0
        if not bin_:
            raise ValueError("a limit has no room for one token")
        out += [bin_] if room[0] < 1 else _powers(bin_)
    return out


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """``pieces`` dealt out over sequences whose lengths are the powers of two in their sum."""
    total, out = sum(n for _, _, n in pieces), []
    pieces = pieces[::-1]
    for k in reversed(range(total.bit_length())):
        if total >> k & 1:
            need, seq = 1 << k, []
            while need:
                i, start, n = pieces.pop()
                took = min(n, need)
                seq.append((i, start, took))
                need -= took
                if took < n:
                    pieces.append((i, start + took, n - took))
            out.append(seq)
    return out


class WordIds:
    """Token ids of a byte-level BPE (a ``tokenizers`` JSON file), word by word.

    This kind of tokenizer always cuts before a space that a visible character follows, so the ids of a
    text are those of its words, and a word's ids are remembered. A text with runs of white space or with a special
    token goes to the library whole. New words go to a second encoder of the same merges, which is faster
    for single words; it is used only if the file's ids are in the order of its merges.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec["pre_tokenizer"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.by_word = spec["normalizer"] is None and step["type"] == "ByteLevel" and not step["add_prefix_space"] and step["use_regex"]
        letters = {c: b for b, c in enumerate(_byte_letters())}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        in_order = self.by_word and [vocab[m] for m in merges] == list(range(256, 256 + len(merges)))
        self.words = None
        if in_order:
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
            self.words = tiktoken.Encoding("words", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        self.first, self.later = _Known(self, ""), _Known(self, " ")

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.words is not None and not any(s in text for s in self.special):
            first, *later = text.split(" ")
            try:
                return self.first[first] + b"".join(map(self.later.__getitem__, later))
            except _Run:
                pass
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


class _Known(dict):
    def __init__(self, ids: WordIds, before: str):
        super().__init__()
        self.ids, self.before = ids, before

    def __missing__(self, word: str) -> bytes:
        if self.before and not word[:1].strip():
            raise _Run
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = array("I", self.ids.words.encode_ordinary(self.before + word)).tobytes()
        if len(word) <= REMEMBERED_LETTERS:
            self[word] = out
        return out


def _byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary; see ``token_counts``."""
    from .token_counts import _byte_letters as letters

    return letters()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


#: What is told of each piece besides its document's id.
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", size: int = 1024, most_segments: int = 64, closing_id: int | None = 0) -> DataFrame:
    """Pieces of whole texts in sequences of ``size`` tokens.

    A document is its ids and then ``closing_id``; every id lies in one piece. Null and empty texts are
    the closing id alone. Whole multiples of ``size`` are sequences of their own; what is left of each document is packed with
    others, every token bearing loss, at most ``most_segments`` to a sequence. A sequence that isn't full
    has a power of two as its length. Repeated rows are packed each. An empty table gives no rows. Ids of any type, null ones too, are given
    back as ``doc_id``; other columns are left out. A text of any length is encoded whole, one at a time.
    """
    id_type = docs.schema[doc_id].dataType
    own_type = to_arrow_type(id_type)
    closing = b"" if closing_id is None else array("I", [closing_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) * SEQUENCES_EACH
        ids = word_ids(tokenizer)
        rests: list[tuple[object, int, bytes, int]] = []
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal next_id
            lengths = np.array([len(r[2]) // 4 for r in rests])
            for seq in fill(lengths, np.ones(len(rests)), (size, most_segments, size)):
                offset = 0
                for i, start, n in seq:
                    doc, before, data, total = rests[i]
                    rows.append((doc, before + start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), total, next_id, offset))
                    offset += n
                next_id += 1
            rests.clear()

        def out() -> pa.RecordBatch:
            ids_, *cols = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids_, own_type), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *PIECE])

        for b in batches:
            for doc, value in zip(b.column(0).to_pylist(), b.column(1)):
                data = ids.encode(value.as_py() or "") + closing
                total = len(data) // 4
                whole = total // size
                for k in range(whole):
                    rows.append((doc, k * size, size, zlib.crc32(data[4 * size * k : 4 * size * (k + 1)]), total, next_id, 0))
                    next_id += 1
                if total > whole * size:
                    rests.append((doc, whole * size, data[4 * size * whole :], total))
                if len(rests) >= WINDOW:
                    flush()
            if len(rows) >= 10_000:
                yield out()
        flush()
        yield out()

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {id_type.simpleString()}, {', '.join(f'{c} long' for c in PIECE)}")


def pack_examples(examples: DataFrame, example_id: str, tokens: str, segments: str, loss_tokens: str, limits: tuple[int, int, int] = (4096, 64, 4096)) -> DataFrame:
    """``examples`` with a ``sequence_id``: whole examples packed under limits on tokens, segments and loss-bearing tokens.

    Made for instruction data, where an example mustn't be cut. Null demands count as 0. An example that
    is over a limit by itself has a sequence of its own. No shuffle: windows of rows are packed as they are read.
    """
    bounds = np.array(limits, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) * SEQUENCES_EACH
        for b in batches:
            for at in range(0, b.num_rows, WINDOW):
                part = b.slice(at, WINDOW)
                demands = np.nan_to_num(np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tokens", "segments", "loss")]))
                bins = pack(demands, bounds)
                yield pa.RecordBatch.from_arrays([part.column("example"), *part.columns[1:], pa.array(bins + base, pa.int64())], ["example", "tokens", "segments", "loss", "sequence_id"])
                base += int(bins.max()) + 1

    kind = examples.schema[example_id].dataType.simpleString()
    picked = examples.selectExpr(f"`{example_id}` AS example", f"CAST(`{tokens}` AS long) AS tokens", f"CAST(`{segments}` AS long) AS segments", f"CAST(`{loss_tokens}` AS long) AS loss")
    packed = picked.mapInArrow(run, f"example {kind}, tokens long, segments long, loss long, sequence_id long")
    return packed.selectExpr(f"example AS `{example_id}`", f"tokens AS `{tokens}`", f"segments AS `{segments}`", f"loss AS `{loss_tokens}`", "sequence_id")
