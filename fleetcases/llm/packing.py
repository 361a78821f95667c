"""Operator 5, vector bin packing of examples into training sequences.

A sequence has three capacities: tokens, segments (pieces) and loss-bearing tokens. The packer of a
task holds a pool of pieces and fills one sequence at a time: among the pieces that fit all
remaining capacities it takes the one whose demand vector has the largest dot product with them
(both as shares of the capacities), so a piece is placed where the scarce resource is the one it
needs least of. If none fits, a piece is cut to what is left (``cut=True``); instruction data is
packed with ``cut=False``, where an example is never split.

One pass, no shuffle: tokenizing and packing happen in the task that reads the rows, on whole
texts, so memory is the pool and the input's size only adds tasks. The last sequence of a task
that stays short is cut into lengths that are powers of two, which need no padding. Sequence ids
are the partition's number and a counter; a task run again gives the same rows.

Results for odd input: null text counts as empty and gives one piece with the end token alone; a
null id is kept; repeated rows are packed each on its own; an empty table gives an empty result;
an uncut example above a limit by itself gets a sequence of its own (``over_limit``). Columns other
than the named ones are not read.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.llm.common import slices, split_words

MAX_TOKENS, MAX_SEGMENTS, END = 4096, 128, 2
POOL, POOL_TOKENS = 2048, 1 << 21
#: words (without capitals and final stops) a worker process keeps with their ids, about 60 bytes each; a
#: setting of memory against time alone, the rows are the same
KEEP_WORDS = 1_000_000
#: bytes that are an ASCII letter or digit
ALNUM = np.isin(np.arange(256), np.frombuffer((string.ascii_letters + string.digits).encode(), np.uint8))
#: bytes of text that are tokenized together
SLICE = 8 << 20
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, loss_tokens long, sequence_length long, over_limit boolean")


def _lengths(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(words: pa.Array, size: np.ndarray) -> pa.Array:
    """The last ``size`` bytes of every word."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    cuts = np.append(0, np.cumsum(size))
    at = np.repeat(offsets[1:] - size - cuts[:-1], size) + np.arange(cuts[-1])
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()),
                                                           pa.py_buffer(data[at].tobytes())])


class WordIds:
    """Token ids of a text, word by word: in this vocabulary no token and no rule crosses ASCII
    white space, so a word's ids do not depend on its neighbours and each different word of a slice is looked
    up once. ASCII capitals are made small by the vocabulary's own normaliser, and what is neither
    letter nor digit is one run up to the next letter or digit: all final ASCII punctuation behind an ASCII
    letter or digit is a run of its own, so ``The`` and ``the),`` need no encoding once ``the`` and ``),``
    are known. Behind any other character (marks, symbols, letters that the normaliser may take apart) the
    word is encoded whole. Words and their parts stay Arrow arrays; only parts never met before become
    Python strings, for the tokenizer. Ids lie in one array; the table is emptied when it is large."""

    def __init__(self, path: str, limit: int = KEEP_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # a task has one core
        from tokenizers import Tokenizer
        self.tok, self.limit = Tokenizer.from_file(path), limit
        self._empty()

    def _empty(self) -> None:
        self.parts = pa.array([], pa.binary())
        # where a part's ids begin and how many they are
        self.place = np.zeros((0, 2), np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, new: pa.Array) -> None:
        words = [w.decode() for w in new.to_pylist()]
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        total = int(n.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * total, np.uint32)])
        self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.place = np.concatenate([self.place, np.stack([self.used + np.cumsum(n) - n, n], axis=1)])
        self.used += total
        self.parts = pa.concat_arrays([self.parts, new])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where the ids of each of the (different) parts lie, after learning those not met before."""
        found = pc.index_in(parts, self.parts)
        new = found.is_null()
        at = found.fill_null(0).to_numpy().astype(np.int64)
        unknown = new.to_numpy(zero_copy_only=False)
        if unknown.any():
            at[unknown] = len(self.parts) + np.arange(unknown.sum())
            self._learn(parts.filter(new))
        return self.place[at]

    def _stretches(self, words: pa.Array) -> np.ndarray:
        """For each word the places of its two stretches of ids: its own, and those of its final stops."""
        text = words.cast(pa.string())
        special = pc.match_substring(text, "<|")
        text = pc.if_else(special, text, pc.ascii_lower(text))
        core = pc.ascii_rtrim(text, characters=string.punctuation)
        offsets = np.frombuffer(core.buffers()[1], np.int32, len(core) + 1, core.offset * 4)
        data = np.frombuffer(core.buffers()[2] or b"\0", np.uint8)
        last = data[np.maximum(offsets[1:], 1) - 1]
        plain = ALNUM[last] & (offsets[1:] > offsets[:-1]) & ~special.to_numpy(zero_copy_only=False)
        tail = np.where(plain, _lengths(text) - _lengths(core), 0)
        core = pc.if_else(pa.array(plain), core, text).cast(pa.binary())
        ends = _ends(text.cast(pa.binary()), tail)
        both = pa.concat_arrays([core, ends]).dictionary_encode()
        place = self._places(both.dictionary)[both.indices.to_numpy()]
        place[len(core):][tail == 0] = 0
        return np.hstack([place[:len(core)], place[len(core):]])

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        flat, bounds = split_words(pa.array(texts, pa.binary()))
        coded = flat.dictionary_encode()
        if len(self.parts) > self.limit:
            self._empty()
        place = self._stretches(coded.dictionary)[coded.indices.to_numpy()]      # two stretches of ids a word
        n = place[:, 1] + place[:, 3]
        place = place.reshape(-1, 2)
        place = place[place[:, 1] > 0]
        at = np.cumsum(place[:, 1]) - place[:, 1]
        ids = self.ids[np.repeat(place[:, 0] - at, place[:, 1]) + np.arange(int(n.sum()))]
        cuts = np.append(0, np.cumsum(n))[bounds].tolist()
        end = np.array([END], np.uint32)
        return [np.concatenate([ids[a:b], end]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_TABLES: dict[str, WordIds] = {}


def word_ids(path: str, limit: int) -> WordIds:
    """The table of this worker process, kept from task to task."""
    if path not in _TABLES:
        _TABLES.clear()
        _TABLES[path] = WordIds(path, limit)
    _TABLES[path].limit = limit
    return _TABLES[path]


class Packer:
    """Pool of pieces and the sequences filled from it."""

    def __init__(self, caps: tuple[int, int, int], cut: bool, sequence: int):
        self.caps, self.cut, self.sequence = np.array(caps, np.float64), cut, sequence
        self.ids: list[tuple] = [()] * POOL          # (doc_id, ids, loss_from)
        self.start = np.zeros(POOL, np.int64)
        self.need = np.zeros((POOL, 3))              # tokens, segments, loss-bearing tokens left
        self.used = np.zeros(POOL, bool)
        self.free = list(range(POOL - 1, -1, -1))
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, loss_from: int) -> None:
        while not self.free or self.held > POOL_TOKENS:
            if not self.used.any():
                break
            self._sequence()
        i = self.free.pop()
        self.ids[i] = (doc_id, ids, loss_from)
        self.start[i], self.used[i] = 0, True
        self.need[i] = len(ids), 1, max(0, len(ids) - loss_from)
        self.held += len(ids)

    def finish(self) -> None:
        while self.used.any():
            self._sequence()

    def _room(self, i: int, left: np.ndarray) -> int:
        """How many tokens of piece i's rest fit into what is left."""
        start, (_, ids, loss_from) = int(self.start[i]), self.ids[i]
        free = max(0, loss_from - start)             # tokens before the loss-bearing ones
        return int(min(left[0], len(ids) - start, free + left[2]))

    def _sequence(self) -> None:
        left, seq, offset, over = self.caps.copy(), [], 0, False
        while left[1] >= 1 and left[0] >= 1:
            fits = self.used & (self.need[:, 0] <= left[0]) & (self.need[:, 2] <= left[2])
            score = np.where(fits, self.need @ (left / self.caps ** 2), -1.0)
            i = int(score.argmax())
            if fits[i] and not (self.cut and left[1] < 2 and left[0] > self.need[i, 0]):
                n = int(self.need[i, 0])
            elif self.cut and self.used.any():
                i = int(np.argmax(np.where(self.used, self.need[:, 0], -1.0)))
                n = self._room(i, left)
            elif not seq and self.used.any():        # uncut example above a limit by itself
                i = int(np.argmax(np.where(self.used, self.need[:, 0], -1.0)))
                n, over = int(self.need[i, 0]), True
            else:
                break
            if n <= 0:
                break
            loss = self._take(i, n, seq, offset)
            offset += n
            left -= n, 1, loss
            if over:
                break
        self._write(seq, offset, over)

    def _take(self, i: int, n: int, seq: list, offset: int) -> int:
        doc_id, ids, loss_from = self.ids[i]
        start = int(self.start[i])
        loss = max(0, start + n - max(start, loss_from))
        seq.append((doc_id, start, n, ids, offset, loss))
        self.start[i] += n
        self.need[i] -= n, 0, loss
        self.held -= n
        if self.start[i] == len(ids):
            self.used[i] = False
            self.ids[i] = ()
            self.free.append(i)
        return loss

    def _write(self, seq: list, total: int, over: bool) -> None:
        full = int(self.caps[0])
        if total >= full or over or not self.cut:
            shapes = [total]
        else:                                         # binary digits of the length
            shapes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        at = 0
        for size in shapes:
            for doc_id, start, n, ids, offset, loss in seq:
                lo, hi = max(offset, at), min(offset + n, at + size)
                if lo >= hi:
                    continue
                a, b = start + lo - offset, start + hi - offset
                first_loss = start + n - loss
                self.rows.append((doc_id, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids),
                                  self.sequence, lo - at, max(0, b - max(a, first_loss)), size, over))
            at += size
            self.sequence += 1


def pack_examples(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  loss_from_col: str | None = None, max_tokens: int = MAX_TOKENS,
                  max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, cut: bool = True,
                  keep_words: int = KEEP_WORDS) -> DataFrame:
    """One row per piece (see SCHEMA). ``loss_from_col``: number of leading tokens of an example
    that bear no loss (a prompt); without it all tokens do."""
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    loss = F.coalesce(F.col(loss_from_col).cast("long"), F.lit(0)) if loss_from_col else F.lit(0).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), loss.alias("loss_from"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.bool_() if c.endswith("boolean") else pa.int64() for c in SCHEMA.split(", ")]

    def run(it: Iterator[pa.RecordBatch]):
        words = word_ids(tokenizer_path, keep_words)
        packer = Packer((max_tokens, max_segments, max_loss), cut, TaskContext.get().partitionId() << 40)

        def out():
            cols = list(zip(*packer.rows, strict=True)) or [()] * len(names)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in it:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            ids, first = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in slices(texts, SLICE):
                for i, tokens in zip(range(lo, hi), words(texts[lo:hi]), strict=True):
                    packer.add(ids[i], tokens, first[i])
            yield out()
        packer.finish()
        yield out()
    return src.mapInArrow(run, SCHEMA)
