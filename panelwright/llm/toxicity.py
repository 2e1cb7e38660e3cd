"""Toxic spans by a linear-chain conditional random field, trained from labelled documents."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hash_share, with_columns

WORD = re.compile(r"[^\W\d_]+")
PREFIX = 4
#: Words of a run that is tagged as one chain; a longer text is several runs.
RUN = 512


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters. Where lower case changes the length, words are found in the text as it is."""
    low = (text or "").lower()
    return WORD.findall(low) if len(low) == len(text or "") else [w.lower() for w in WORD.findall(text)]


def features(word: str) -> tuple[str, ...]:
    """The word itself and, of longer words, how it begins and ends."""
    return (f"w:{word}", f"p:{word[:PREFIX]}", f"s:{word[-PREFIX:]}") if len(word) > PREFIX else (f"w:{word}",)


def association(pos: int, neg: int, all_pos: int, all_neg: int) -> tuple[float, float]:
    """Log odds of a feature for toxic documents, and the log-likelihood ratio of its table."""
    odds = math.log((pos + 0.5) / (all_pos + 1)) - math.log((neg + 0.5) / (all_neg + 1))
    n, with_f = all_pos + all_neg, pos + neg
    cells = ((pos, all_pos, with_f), (neg, all_neg, with_f), (all_pos - pos, all_pos, n - with_f), (all_neg - neg, all_neg, n - with_f))
    return odds, 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in cells if o)


class Emissions(dict):
    """Scores of words for the toxic state, computed once each."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        e = self[word] = self.bias + sum(get(f, 0.0) for f in features(word))
        return e

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


class Crf:
    """Two states, clean (0) and toxic (1); word features score state 1, transitions the change.

    ``weights`` by feature, ``bias``, ``trans`` (2 x 2, log), and ``calibration``, which turns the
    highest marginal of a document and the sum of its marginals into its score.
    """

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray):
        self.weights, self.bias, self.trans = weights, bias, trans
        self.calibration = np.array([0.0, 1.0, 1.0])
        self.emissions = Emissions(weights, bias)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"emissions": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.emissions = Emissions(self.weights, self.bias)

    def marginals(self, docs: list[list[str]], width: int = 4096) -> list[np.ndarray]:
        """Forward-backward probability of the toxic state at each word of each document, in runs of ``RUN`` words."""
        out, runs = [], []
        for words in docs:
            scored = self.emissions.of(words)
            out.append(np.zeros(len(words)))
            runs += [(out[-1][at : at + RUN], scored[at : at + RUN]) for at in range(0, len(words), RUN)]
        runs.sort(key=lambda r: len(r[1]))
        for at in range(0, len(runs), width):
            part = runs[at : at + width]
            n = np.array([len(e) for _, e in part])
            padded = np.zeros((len(part), n[-1]))
            for row, (_, e) in zip(padded, part):
                row[: len(e)] = e
            for (found, e), p in zip(part, forward_backward(padded, n, self.trans)[0]):
                found[:] = p[: len(e)]
        return out

    def scores(self, tops: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Documents' scores from their highest and summed marginals."""
        return 1 / (1 + np.exp(-np.clip(doc_features(tops, sums) @ self.calibration, -30, 30)))


def doc_features(tops: np.ndarray, sums: np.ndarray) -> np.ndarray:
    p = np.clip(tops, 1e-6, 1 - 1e-6)
    return np.stack((np.ones(len(p)), np.log(p / (1 - p)), np.log(sums + 1e-3)), axis=1)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 (rows x time) of padded rows and, if asked for, expected transitions (2 x 2).

    Messages are the ratio of state 1 to state 0, so each is one number a row.
    """
    rows, n = emit.shape
    w = np.exp(trans)
    e = np.exp(np.clip(emit, -30, 30))
    forward, backward = np.empty((n, rows)), np.ones((n, rows))
    forward[0] = e[:, 0]
    for t in range(1, n):
        r = forward[t - 1]
        forward[t] = e[:, t] * (w[0, 1] + r * w[1, 1]) / (w[0, 0] + r * w[1, 0])
    for t in range(n - 2, -1, -1):
        r = backward[t + 1] * e[:, t + 1]
        backward[t] = np.where(t + 1 < lengths, (w[1, 0] + w[1, 1] * r) / (w[0, 0] + w[0, 1] * r), 1.0)
    odds = forward * backward
    p = odds / (1 + odds)
    expected = np.zeros((2, 2))
    for t in range(n - 1 if counts else 0):
        live = t + 1 < lengths
        r = (e[:, t + 1] * backward[t + 1])[live]
        f = forward[t][live]
        joint = np.array([[np.full_like(f, w[0, 0]), w[0, 1] * r], [f * w[1, 0], f * w[1, 1] * r]])
        expected += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
    return p.T, expected


def train(texts: list[tuple[str, int]], weight: tuple[float, float] = (1.0, 1.0), clean_runs: int = 10_000) -> Crf | None:
    """A field from document labels, in the order of ``texts``; None if one of the labels is missing.

    Scores are calibrated on every second document by a field that the others give, so that
    words known by heart don't count; ``weight`` is how many documents one of either label stands for.
    """
    docs = [(words_of(t), y) for t, y in texts]
    model = fitted(docs, clean_runs=clean_runs)
    if model:
        half = fitted(docs[::2], clean_runs=clean_runs) or model
        rest = docs[1::2] if any(y for _, y in docs[1::2]) else docs
        y = np.array([y for _, y in rest], float)
        model.calibration = calibrated(doc_features(*doc_marginals(half, [w for w, _ in rest])), y, np.where(y > 0, weight[1], weight[0]))
    return model


def fitted(
    docs: list[tuple[list[str], int]], *, rounds: int = 60, seq: int = 48, clean_runs: int = 10_000,
    least_ratio: float = 20.0, least_odds: float = 3.0, least_share: float = 0.02,
) -> Crf | None:
    """Weights of the field, without calibration.

    A token of a toxic document is labelled toxic if one of its features goes with toxic
    documents by log odds and likelihood ratio and is in ``least_share`` of them; all other
    tokens are labelled clean. Gradients are expected less observed counts over sequences of ``seq`` words:
    every one with a toxic token, and of the clean ones about ``clean_runs``, chosen by a hash of their words.
    """
    all_pos = sum(y for _, y in docs)
    all_neg = len(docs) - all_pos
    if not all_pos or not all_neg:
        return None
    pos, neg = Counter(), Counter()
    for words, y in docs:
        (pos if y else neg).update({f for w in set(words) for f in features(w)})
    strong = set()
    for f, n in pos.items():
        odds, ratio = association(n, neg[f], all_pos, all_neg)
        if odds >= least_odds and ratio >= least_ratio and n >= max(3, least_share * all_pos):
            strong.add(f)
    kept = {f for f in strong} | {f for f, n in (pos + neg).items() if n >= 10}
    ids = {f: i for i, f in enumerate(sorted(kept))}
    parts = [(words[at : at + seq], y) for words, y in docs for at in range(0, len(words), seq)]
    tagged = [(part, [int(bool(y) and not strong.isdisjoint(features(w))) for w in part]) for part, y in parts]
    clean = sum(not any(t) for _, t in tagged)
    share = int(min(1.0, clean_runs / max(clean, 1)) * (1 << 32))
    seqs = [(part, t) for part, t in tagged if any(t) or zlib.crc32(" ".join(part).encode("utf-8", "replace")) <= share]
    n = len(seqs)
    lengths = np.array([len(p) for p, _ in seqs])
    tags = np.zeros((n, seq))
    where, which = [], []
    for i, (part, tag) in enumerate(seqs):
        tags[i, : len(tag)] = tag
        for t, w in enumerate(part):
            for f in features(w):
                if f in ids:
                    where.append(i * seq + t)
                    which.append(ids[f])
    where, which = np.array(where, np.int64), np.array(which, np.int64)
    live = np.arange(seq)[None, :] < lengths[:, None]
    observed = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            observed[a, b] = ((tags[:, :-1] == a) & (tags[:, 1:] == b) & live[:, 1:]).sum()
    theta = np.zeros(len(ids) + 1)
    theta[-1] = -4.0
    trans = np.zeros((2, 2))
    m, v, step = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4), 0.25
    for it in range(1, rounds + 1):
        emit = theta[-1] + np.bincount(where, theta[which], n * seq).reshape(n, seq)
        p, expected = forward_backward(emit, lengths, trans, counts=True)
        gap = ((tags - p) * live).reshape(-1)
        grad = np.concatenate((np.bincount(which, gap[where], len(ids)), [gap.sum()], (observed - expected).reshape(-1)))
        grad -= 0.05 * np.concatenate((theta, trans.reshape(-1)))
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        move = step * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.98**it)) + 1e-8)
        theta, trans = theta + move[:-4], trans + move[-4:].reshape(2, 2)
    return Crf({f: float(theta[i]) for f, i in ids.items() if abs(theta[i]) > 1e-3}, float(theta[-1]), trans - trans[0, 0])


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Coefficients of a weighted logistic regression of ``y`` on ``x``, by damped Newton steps."""
    beta = np.array([0.0, 0.5, 0.5])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * (p * (1 - p) + 1e-6)
        grad = x.T @ (weight * (y - p)) - 0.1 * (beta - [0.0, 0.5, 0.5])
        beta = beta + np.clip(np.linalg.solve((x * w[:, None]).T @ x + 0.1 * np.eye(3), grad), -1, 1)
        beta[1:] = np.maximum(beta[1:], 0.0)
    return beta


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", most_docs: int = 3000, chars: int = 4000, clean_runs: int = 10_000) -> Crf | None:
    """A field from ``docs`` (id, text) and ``labels`` (id, label): about ``most_docs`` different texts of either label.

    Texts are chosen by their hash, each once for a label however many copies it has, and a slice of ``chars`` of each
    is used; of what holds no toxic token, about ``clean_runs`` sequences, chosen by a hash (``fitted``). Only ids and hashes meet the labels; the texts of the chosen ids are then fetched by a
    broadcast of about twice ``most_docs`` rows. Null ids and texts and other labels are left out.
    """
    texts = docs.select(F.col(id_col).alias("_id"), "text", F.xxhash64("text").alias("_hash")).where("_id is not null and text is not null")
    marks = labels.select(F.col(id_col).alias("_marked"), F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    met = texts.select("_id", "_hash").join(marks, F.col("_id") == F.col("_marked"))
    known = checkpointed(met.groupBy("_hash", "label").agg(F.min("_id").alias("_id")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    shares = [min(1.0, most_docs / max(counts.get(y, 0), 1)) for y in (0, 1)]
    share = F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])
    chosen = known.where(hash_share([F.col("_hash")], "toxicity") < share).select(F.col("_id").alias("_chosen"), F.col("_hash").alias("_text"), "label")
    start = (F.pmod("_hash", F.greatest(F.length("text") - chars, F.lit(1))) + 1).cast("int")
    fetched = texts.join(F.broadcast(chosen), (F.col("_id") == F.col("_chosen")) & (F.col("_hash") == F.col("_text")))
    sample = fetched.select("_hash", "label", F.substring("text", start, F.lit(chars)).alias("text")).groupBy("_hash", "label").agg(F.min("text").alias("text"))
    rows = sorted(sample.collect(), key=lambda r: (r["_hash"], r["label"]))
    return train([(r["text"], r["label"]) for r in rows], (1 / shares[0], 1 / shares[1]), clean_runs)


def doc_marginals(model: Crf, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The highest marginal and the sum of those from 0.25 of each document."""
    return summed(model.marginals(docs))


def summed(marginals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    tops = np.array([p.max() if len(p) else 0.0 for p in marginals])
    return tops, np.array([p[p >= 0.25].sum() for p in marginals])


def spans_of(p: np.ndarray, text: str, least: float = 0.5) -> list[dict]:
    """Runs of words whose marginal is ``least`` or more, as character offsets in the text with the highest marginal."""
    if not (p >= least).any():
        return []
    found = list(WORD.finditer(text.lower()))
    found = found if len(found) == len(p) and len(text.lower()) == len(text) else list(WORD.finditer(text))
    out: list[dict] = []
    last = -2
    for k in np.flatnonzero(p >= least).tolist():
        if last == k - 1:
            out[-1] |= {"to": found[k].end(), "p": max(out[-1]["p"], float(p[k]))}
        else:
            out.append({"from": found[k].start(), "to": found[k].end(), "p": float(p[k])})
        last = k
    return out


def score(docs: DataFrame, model: Crf | None, *, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` of each row with ``score``, ``predicted`` and ``spans``.

    ``spans`` are the character ranges in the text, counted from 0 in code points, whose words are marked toxic, for rows
    with a score of ``threshold`` or more. A text is read whole, in chains of ``RUN`` words. A null or empty text, and any text when
    nothing was learnt, scores as one without a toxic word (0 when nothing was learnt). Repeated rows score alike, an empty
    table gives an empty one. A kept column with a result's name gives way to the result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select(*keep, F.col(text_col).alias("_judged"))

    def make(batch: pa.RecordBatch) -> list:
        field, texts = sent.value, batch.column("_judged").to_pylist()
        if field is None:
            return [[0.0] * len(texts), [0] * len(texts), [[] for _ in texts]]
        found = field.marginals([words_of(t) for t in texts])
        scores = field.scores(*summed(found)).tolist()
        return [scores, [int(s >= threshold) for s in scores], [spans_of(p, t) if s >= threshold and t else [] for t, s, p in zip(texts, scores, found)]]

    return with_columns(df, make, "score double, predicted int, spans array<struct<from:int,to:int,p:double>>", drop=("_judged",))
