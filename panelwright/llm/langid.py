"""Language identification by cross-parsing against a suffix automaton of each language's text."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, with_columns

#: Codes 1 (a letter unknown to a language) and PAD never extend a match; 0 is what stands between words. Learnt letters follow.
PAD, LETTERS = 2, 3
#: Languages of more codes than this keep sparse transitions.
DENSE = 256
BLOCK = 1024


class Automata:
    """Suffix automata of the labelled texts as next-state tables over all letters that a language's text holds.

    A state is stored as its row's offset; 0 is the start, which no other state leads
    to, so reaching 0 means that no substring of the text goes on this way: a phrase ends.
    """

    def __init__(self, texts: dict[str, str]):
        letters = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
        self.codes = {c: i + LETTERS for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0])))}
        self.points = letter_points().astype(np.min_scalar_type(len(self.codes) + LETTERS))
        for c, i in self.codes.items():
            self.points[ord(c)] = i
        self.langs, self.tables, self.columns, self.sizes = [], [], [], []
        for lang in sorted(texts):
            codes = self.encode(texts[lang])
            if len(codes):
                own = np.unique(codes[codes >= LETTERS])
                columns = np.ones(len(self.codes) + LETTERS, np.int32)
                columns[0], columns[PAD], columns[own] = 0, PAD, np.arange(len(own)) + LETTERS
                self.langs.append(lang)
                self.tables.append((Dense if len(own) + LETTERS <= DENSE else Sparse)(columns[codes].tolist(), len(own) + LETTERS))
                self.columns.append(columns)
                self.sizes.append(len(codes))

    def encode(self, text: str) -> np.ndarray:
        """Lower-case letters as codes, everything between words as a single 0."""
        codes = self.points[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))] if len(codes) else codes

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        """Phrases of each column of ``blocks`` (time first, PAD after the last letter) for each language."""
        out = np.empty((len(self.langs), blocks.shape[1]), np.int64)
        for k, (table, columns) in enumerate(zip(self.tables, self.columns)):
            state, ends = np.zeros(blocks.shape[1], table.kind), np.zeros(blocks.shape[1], np.int32)
            for row in blocks:
                state = table.next(state + columns.take(row))
                ends += state == 0
            out[k] = ends
        return out


@lru_cache(maxsize=1)
def letter_points() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], np.uint8)


def suffix_steps(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the automaton of all substrings of ``codes``."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] != size[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return step


# At the end, an open phrase goes to the start and so counts; what is at the start goes to a last state and stays.
class Dense:
    """Row offsets for every state and code."""

    kind = np.int32

    def __init__(self, codes: list[int], width: int):
        step = suffix_steps(codes)
        table = np.zeros((len(step) + 1, width), np.int32)
        table[-1] = table[0, PAD] = len(step) * width
        for s, out in enumerate(step):
            for c, t in out.items():
                table[s, c] = t * width
        self.table = table.reshape(-1)

    def next(self, at: np.ndarray) -> np.ndarray:
        return self.table.take(at)


class Sparse:
    """Only the transitions there are, sorted: an alphabet of thousands of letters takes no more room than its text."""

    kind = np.int64

    def __init__(self, codes: list[int], width: int):
        step = suffix_steps(codes)
        self.end = len(step) * width
        moves = {s * width + c: t * width for s, out in enumerate(step) for c, t in out.items()} | {PAD: self.end}
        self.keys = np.array(sorted(moves), np.int64)
        self.to = np.array([moves[k] for k in self.keys.tolist()], np.int64)

    def next(self, at: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(at >= self.end, self.end, np.where(self.keys[i] == at, self.to[i], 0))


def learn(labelled: DataFrame, *, docs_per_lang: int = 120, chars_per_doc: int = 2000, chars_per_lang: int = 16_000, most_langs: int = 500) -> Automata:
    """Automata from a bounded sample of ``text, lang``: at most ``chars_per_lang`` of each, for the
    ``most_langs`` values of ``lang`` with the most distinct texts (of equal ones the first by name).

    Distinct texts of a language are taken in the order of a hash: of each a slice of ``chars_per_doc`` is used, until
    ``chars_per_lang`` is filled or the language has no more. The share drawn first holds about ``docs_per_lang`` of
    a language's distinct texts; a language that it doesn't fill is drawn again with a wider share, up to all its texts.
    Rows without text or lang are left out.
    """
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    key = hash_share([F.col("text")], "langid")
    hashed = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    most = hashed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs)
    counts = {r["lang"]: r["count"] for r in most.collect()}
    start = (F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars_per_doc, F.lit(1))) + 1).cast("int")
    piece = F.substring("text", start, F.lit(chars_per_doc)).alias("text")
    texts: dict[str, str] = {}
    shares = {lang: min(1.0, docs_per_lang / n) for lang, n in counts.items()}
    while shares:
        share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        sample = rows.where(key < share[F.col("lang")]).select("lang", key.alias("key"), F.xxhash64("text").alias("hash"), piece).distinct()
        last = Window.partitionBy("lang").orderBy("key", "text", "hash").rowsBetween(Window.unboundedPreceding, -1)
        sample = sample.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(last), F.lit(0))).where(F.col("before") < chars_per_lang + 1)
        found: dict[str, str] = {}
        for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["key"], r["text"])):
            if len(have := found.get(r["lang"], "")) < chars_per_lang:
                found[r["lang"]] = (have + "\n" + r["text"])[:chars_per_lang]
        texts |= found
        shares = {lang: min(1.0, share * 16) for lang, share in shares.items() if share < 1 and len(found.get(lang, "")) < chars_per_lang}
    return Automata(texts)


def judge(model: Automata, texts: list[str | None], most_blocks: int = 8192) -> tuple[list, list, list, list]:
    """Language, score, phrases a letter and letters of each text, in blocks of equal length."""
    pieces, owner, total = [], [], np.zeros(len(texts), np.int64)
    counts = np.zeros((len(model.langs), len(texts)), np.int64)

    def flush() -> None:
        if pieces:
            order = np.argsort([-len(p) for p in pieces], kind="stable")
            blocks = np.full((len(pieces), len(pieces[order[0]]) + 1), PAD, model.points.dtype)
            for i, k in enumerate(order):
                blocks[i, : len(pieces[k])] = pieces[k]
            got = model.phrases(np.ascontiguousarray(blocks.T))
            for lang in range(len(model.langs)):
                np.add.at(counts[lang], np.array(owner)[order], got[lang])
        pieces.clear()
        owner.clear()

    letters = [0] * len(texts)
    for i, text in enumerate(texts):
        codes = model.encode(text) if text else np.zeros(0, np.uint8)
        letters[i] = int(np.count_nonzero(codes))
        if letters[i]:
            total[i] = len(codes)
            for at in range(0, len(codes), BLOCK):
                pieces.append(codes[at : at + BLOCK])
                owner.append(i)
            if len(pieces) >= most_blocks:
                flush()
    flush()
    langs, scores, rates = [], [], []
    weight = np.array([math.log2(n + 2) for n in model.sizes])
    for i in range(len(texts)):
        if not letters[i] or not model.langs:
            langs.append("und")
            scores.append(0.0)
            rates.append(None)
            continue
        cost = counts[:, i] * weight
        best = int(np.argmin(cost))
        rest = np.delete(cost, best)
        second = float(rest.min()) if len(rest) else float(total[i] * weight[best])
        langs.append(model.langs[best])
        scores.append(float(min(1.0, second / max(second + cost[best], 1e-12))))
        rates.append(float(counts[best, i] / total[i]))
    return langs, scores, rates, letters


def identify(docs: DataFrame, model: Automata, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with ``lang_pred``, ``score``, ``phrase_rate`` and ``letters``.

    The language whose text needs the fewest phrases wins, each phrase weighing the
    logarithm of that language's sample size; equal costs go to the first name. A text is
    parsed whole, starting afresh every 1,024 letters. ``score`` is the runner-up's share of
    both costs. ``phrase_rate`` is phrases per letter. A null text, one without a letter, and any
    text when nothing was learnt are ``und`` with score 0. Repeated rows are judged alike, an empty table gives an
    empty one. A kept column with a result's name gives way to the result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    results = "lang_pred string, score double, phrase_rate double, letters int"
    stays = text_col in keep and text_col not in results
    source = text_col if stays else "_parsed"
    df = docs.select(*keep, *([] if stays else [F.col(text_col).alias(source)]))
    return with_columns(df, lambda batch: judge(sent.value, batch.column(source).to_pylist()), results, drop=() if stays else (source,))
