"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns, written

#: Bytes of words: digits, A-Z (as a-z), a-z and all of a non-ASCII character; others part words.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORDS).split() if text else []


class ItemAutomaton:
    """All substrings of the items' word sequences; tells which windows end at a word.

    ``window`` words make a window; an item with fewer words is one window as a whole.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step, self.link, self.size = [{}], [-1], [0]
        self.names: list[str] = []
        ends: dict[int, set[int]] = {}
        short: dict[int, set[int]] = {}
        self.least = window
        for name, words in items:
            if not words:
                continue
            k, last = len(self.names), 0
            self.names.append(name)
            for w in words:
                last = self._add(last, self.vocab.setdefault(w, len(self.vocab)))
                ends.setdefault(last, set()).add(k)
            if len(words) < window:
                short.setdefault(last, set()).add(k)
                self.least = min(self.least, len(words))
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for s in reversed(order):
            if s in ends and self.size[self.link[s]] >= window:
                ends.setdefault(self.link[s], set()).update(ends[s])
        #: By state: the items that its strings end in, for strings of window length and up; the short items among its suffixes.
        self.ends = {s: ks for s, ks in ends.items() if self.size[s] >= window}
        self.shorts: list[tuple] = [()] * len(self.size)
        for s in order:
            own = ((self.size[s], frozenset(short[s])),) if s in short else ()
            self.shorts[s] = (*own, *self.shorts[self.link[s]])

    def _add(self, last: int, w: int) -> int:
        step, link, size = self.step, self.link, self.size
        if w in step[last]:
            q = step[last][w]
            return q if size[q] == size[last] + 1 else self._split(last, w, q)
        new = self._state(size[last] + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = step[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, size: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        twin = self._state(self.size[p] + 1)
        self.step[twin] = dict(self.step[q])
        self.link[twin] = self.link[q]
        self.link[q] = twin
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = twin
            p = self.link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans ``[from, to)`` of hit words, and the items whose windows occur."""
        ids = np.array([-1 if i is None else i for i in map(self.vocab.get, words)], dtype=np.int64)
        if not self.names or len(ids) < self.least:
            return [], set()
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edges = np.diff(known)
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for start, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            if end - start >= self.least:
                self._run(ids[start:end].tolist(), int(start), spans, items)
        return spans, items

    def _run(self, ids: list[int], at: int, spans: list, items: set[int]) -> None:
        step, link, size, window = self.step, self.link, self.size, self.window
        state = length = 0
        for i, w in enumerate(ids, at + 1):
            while state and w not in step[state]:
                state = link[state]
                length = size[state]
            if w in step[state]:
                state = step[state][w]
                length += 1
            else:
                state = length = 0
                continue
            longest = 0
            if length >= window:
                s = state
                while size[link[s]] >= window:
                    s = link[s]
                items |= self.ends.get(s, set())
                longest = window
            for n, ks in self.shorts[state]:
                if n <= length:
                    items |= ks
                    longest = max(longest, n)
            if longest:
                a = i - longest
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i))


def blocks_of_items(items: DataFrame, id_col: str, text_col: str, window: int, most_words: int) -> Iterator[ItemAutomaton]:
    """Automata of at most about ``most_words`` words each, built as the items stream by; one at least."""
    block, n, some = [], 0, False
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    for r in rows.toLocalIterator():
        block.append((r["id"], words := words_of(r["text"])))
        n += len(words)
        if n >= most_words:
            yield ItemAutomaton(block, window)
            block, n, some = [], 0, True
    if block or not some:
        yield ItemAutomaton(block, window)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    most_words: int = 200_000,
    cut: bool = False,
) -> DataFrame:
    """``docs`` with ``_n_words long, _spans array<array<long>>, _items array<string>``.

    A window is ``window`` consecutive words of an item, or the whole of an item with fewer.
    ``_spans`` are the merged word ranges inside occurrences of windows, ``_items`` the ids,
    sorted as strings, of the items whose windows occur. Words are lower-cased in A-Z.
    Null texts have no words; items with null id, null text or no words are left out; items
    that share an id count once; repeated rows are judged alike, very long texts are read whole; without items nothing is hit;
    an empty table gives an empty one. Columns of ``docs`` that have the name of a result give way to it.

    Items are taken in blocks of ``most_words``, one automaton and one pass over the texts for each block. Between
    blocks the table is written to the shared folder, so that the driver and every task hold one automaton
    at a time. With ``cut``, the last pass puts ``_cut string``, the text without its spans, in place of the text.
    """
    blocks = blocks_of_items(items, item_id, item_text, window, most_words)
    automaton, first = next(blocks), True
    while automaton is not None:
        following = next(blocks, None)
        cuts = cut and following is None
        sent = docs.sparkSession.sparkContext.broadcast(automaton)

        def make(batch: pa.RecordBatch, sent=sent, first=first, cuts=cuts) -> list:
            model, n_words, all_spans, all_items, texts = sent.value, [], [], [], []
            old = None if first else list(zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()))
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                words = words_of(text)
                spans, found = model.scan(words)
                names = {model.names[k] for k in found}
                if old:
                    spans, names = merged([*map(tuple, old[i][0]), *spans]), names | set(old[i][1])
                n_words.append(len(words))
                all_spans.append([list(s) for s in spans])
                all_items.append(sorted(names))
                if cuts:
                    texts.append(cut_spans(text, spans) if spans else text)
            return [n_words, all_spans, all_items, *([texts] if cuts else [])]

        fields = "_n_words long, _spans array<array<long>>, _items array<string>" + (", _cut string" if cuts else "")
        docs = with_columns(docs, make, fields, drop=(text_col,) if cuts else ())
        if following is not None:
            docs = written(docs)
            sent.unpersist()
        automaton, first = following, False
    return docs


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of ``spans`` and what stands between those words."""
    data = text.encode("utf-8", "replace")
    flat = data.translate(_WORDS)
    out, at, word, pos = [], 0, 0, 0
    wanted = iter(spans)
    span = next(wanted, None)
    for token in flat.split():
        start = flat.index(token, pos)
        pos = start + len(token)
        if span and word == span[0]:
            out.append(data[at:start])
        if span and word == span[1] - 1:
            at, span = pos, next(wanted, None)
        word += 1
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", most_covered: float = 0.5, **options) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of the texts, and rows of
    which more than ``most_covered`` of the words are hit are dropped. Clean rows stay as they are, whatever their columns are called.
    """
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_in_{c}") for c in docs.columns if c != text_col])
    found = contamination(rows, items, text_col="_text", cut=True, **options)
    found = found.where(hit_words(F.col("_spans")) <= F.lit(most_covered) * F.col("_n_words"))
    return found.select(*[F.col("_cut" if c == text_col else f"_in_{c}").alias(c) for c in docs.columns])
