"""Links between texts that share most of their word shingles: MinHash bands, then exact similarity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, with_columns

#: Texts of similarity 0.8 share none of 25 bands of 5 with probability (1 - 0.8**5)**25, about 5 in 100,000.
BANDS, ROWS = 25, 5
#: Texts to compare are fetched by broadcast up to this number.
MOST_SENT = 200_000
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_FACTORS = np.random.default_rng(97).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct XXH64 values of the shingles, sorted; a shorter text is one shingle, one without words has none."""
    tokens = text.encode("utf-8", "replace").translate(_LOWERED).split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    shingles = zip(*(tokens[i:] for i in range(words))) if len(tokens) >= words else [tokens]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(s), 5) for s in shingles], dtype=np.uint64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band of least values; texts of equal sets have equal keys."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        mixed = shingles[at : at + 2048, None] * _FACTORS[0]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _FACTORS[1]
        np.minimum(least, mixed.min(axis=0), out=least)
    raw = least.tobytes()
    size = ROWS * 8
    return np.array([xxhash.xxh64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def shared_parts(left: pa.ListArray, right: pa.ListArray) -> list[float]:
    """Jaccard similarity of the sets of each row."""
    out = []
    sides = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (left, right)]
    for k in range(len(left)):
        x, y = (values[at[k] : at[k + 1]] for values, at in sides)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / max(len(x) + len(y) - both, 1))
    return out


def signed(texts: list[str | None], words: int) -> tuple[list[int], list[list[int]]]:
    """Number of distinct shingles and keys of the bands of each text."""
    sizes, bands = [], []
    for text in texts:
        found = shingle_set(text, words)
        sizes.append(len(found))
        bands.append(band_keys(found))
    return sizes, bands


def sets_of(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``_hash, _set`` (shingles) for the texts with the hashes ``_want``, each fetched once."""
    wanted = checkpointed(nodes.join(wanted, F.col("_hash") == F.col("_want"), "left_semi").select(F.col("_hash").alias("_want"), F.col("_id").alias("_least")))
    sent = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted
    met = texts.join(sent, (F.col("_hash") == F.col("_want")) & F.col("_id").eqNullSafe(F.col("_least"))).select("_hash", "_text")
    made = lambda batch: [[shingle_set(t, words).view(np.int64) for t in batch.column("_text").to_pylist()]]
    return checkpointed(with_columns(met, made, "_set array<long>", drop=("_text",)).dropDuplicates(["_hash"]))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (``a, b``: hashes) whose sets have at least this Jaccard similarity."""
    side = lambda c, x: sets.select(F.col("_hash").alias(c), F.col("_set").alias(x))
    both = pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b").select("a", "b", "_x", "_y")
    parts = with_columns(both, lambda batch: [shared_parts(batch.column("_x"), batch.column("_y"))], "_part double", drop=("_x", "_y"))
    return parts.where(F.col("_part") >= similarity - 1e-12).select("a", "b")


def rare_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of rows (``_hash, at, _n, _set``) of different classes ``at`` that may reach the similarity; none that does is left out.

    Shingles are put in one order for all texts: first those that only one class has, then rare before frequent ones.
    Two sets of at least the similarity share a shingle near the start of both, at places from which enough
    shingles still follow in each. So texts with many shingles of their own meet nobody, however large
    the group that they were found in.
    """
    each, known = rows.select("_hash", "at", F.explode("_set").alias("shingle")), rows.select("_hash", "at", "_n")
    shared = each.groupBy("shingle").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("rows")).where("low != high").select("shingle", "rows")
    by = Window.partitionBy("_hash")
    met = each.drop("at").join(shared, "shingle").join(known, "_hash")
    placed = met.withColumn("_at", F.col("_n") - F.count("*").over(by) + F.row_number().over(by.orderBy("rows", "shingle")))
    least = lambda part: F.ceil(part * F.col("_n") - 1e-9)
    equal = 2 * similarity / (1 + similarity)
    start = checkpointed(placed.where(F.col("_at") <= F.col("_n") - least(similarity) + 1).withColumn("_first", F.col("_at") <= F.col("_n") - least(equal) + 1))
    mixed = start.groupBy("shingle").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low != high").select("shingle")
    start = start.join(mixed, "shingle", "left_semi")
    named = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("_hash", "at", "_n", "_at")]
    small, large = start.where("_first").select("shingle", *named(1)), start.select("shingle", *named(2))
    follow = F.least(F.col("_n1") - F.col("_at1"), F.col("_n2") - F.col("_at2")) + 1
    enough = follow >= F.ceil(equal / 2 * (F.col("_n1") + F.col("_n2")) - 1e-9)
    ordered = (F.col("_n1") < F.col("_n2")) | ((F.col("_n1") == F.col("_n2")) & (F.col("_hash1") < F.col("_hash2")))
    met = small.join(large, "shingle").where((F.col("at1") != F.col("at2")) & ordered & (F.col("_n1") >= similarity * F.col("_n2") - 1e-9) & enough)
    return met.select(F.least("_hash1", "_hash2").alias("a"), F.greatest("_hash1", "_hash2").alias("b")).distinct()


def links(texts: DataFrame, signed: DataFrame, near: DataFrame, components: Callable, words: int, similarity: float) -> DataFrame:
    """Links ``a < b`` of fingerprints that join all texts of at least this similarity which ``near`` doesn't join already.

    ``texts`` has ``_id, _text, _hash``, ``signed`` also ``fp, _n, _bands``. Distinct texts that share a band
    are candidates unless their classes are one. First each is compared with the first of
    its bucket, so a large group of near copies costs one comparison a text and bucket. The texts of buckets
    that still hold different classes are then compared where ``rare_pairs`` leaves a pair possible. Comparisons are exact.
    """
    nodes = checkpointed(signed.where("_n > 0").groupBy("_hash").agg(F.min("_id").alias("_id"), F.first("fp").alias("fp"), F.first("_n").alias("_n"), F.first("_bands").alias("_bands")))
    texts_of = nodes.select("_hash", "fp", "_n")

    def classed(rows: DataFrame, edges: DataFrame) -> DataFrame:
        roots = components(edges).withColumnRenamed("node", "fp")
        return rows.join(roots, "fp", "left").withColumn("at", F.coalesce("root", "fp")).drop("root")

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows ``key, _hash, at`` of buckets with several classes, and their bucket's first text ``lead``."""
        first = rows.groupBy("key").agg(F.min("_hash").alias("lead"), F.min("at").alias("low"), F.max("at").alias("high"))
        return rows.join(first.where("low != high").select("key", "lead"), "key")

    def of_fingerprints(found: DataFrame) -> DataFrame:
        of = lambda side: texts_of.select(F.col("_hash").alias(side), F.col("fp").alias(f"fp_{side}"))
        return found.join(of("a"), "a").join(of("b"), "b").select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()

    # Of a text and bucket only the key, the text's hash and its class move; what else is known of a text is joined once a pair.
    known = checkpointed(classed(nodes, near))
    members = checkpointed(mixed(known.select("_hash", "at", F.explode("_bands").alias("key"))))
    pairs = members.where("_hash != lead").select(F.least("_hash", "lead").alias("a"), F.greatest("_hash", "lead").alias("b")).distinct()
    of = lambda side: known.select(F.col("_hash").alias(side), F.col("at").alias(f"at_{side}"), F.col("_n").alias(f"n_{side}"))
    stars = pairs.join(of("a"), "a").join(of("b"), "b").where((F.col("at_a") != F.col("at_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (similarity - 1e-12)))
    stars = checkpointed(stars.select("a", "b"))
    sets = sets_of(members.select(F.col("_hash").alias("_want")).distinct(), texts, nodes, words)
    edges = checkpointed(of_fingerprints(similar(stars, sets, similarity)))
    again = checkpointed(classed(texts_of, near.unionByName(edges)).select("_hash", "at", "_n"))
    left = mixed(members.select("_hash", "key").join(again, "_hash").select("_hash", "at", "key")).select("_hash").distinct()
    rest = checkpointed(rare_pairs(checkpointed(again.join(left, "_hash", "left_semi")).join(sets, "_hash"), similarity))
    return edges.unionByName(checkpointed(of_fingerprints(similar(rest, sets, similarity)))).distinct()
