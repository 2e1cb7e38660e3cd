"""Near-duplicate classes by 64-bit SimHash, with pigeonring filtering of candidates, and by overlap of shingles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlap
from .common import LOWER, UPPER, checkpointed, with_columns, written

SEGMENTS, BITS = 4, 16
DISTANCE = 3
#: Fingerprints with more than this part of all rows are joined by broadcast, so there are fewer than this.
MOST_HOT = 10_000
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 values; no words: 0."""
    tokens = text.encode("utf-8", "replace").translate(_LOWERED).split() if text else []
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    elif words == 3:
        shingles = [b"%b %b %b" % s for s in zip(tokens, tokens[1:], tokens[2:])]
    else:
        shingles = [b" ".join(s) for s in zip(*(tokens[i:] for i in range(words)))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype=">u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` without the text, with ``fp``, the fingerprint as a signed long."""

    def make(batch: pa.RecordBatch) -> list:
        fps = np.array([fingerprint(t, words) for t in batch.column(text_col).to_pylist()], dtype=np.uint64)
        return [fps.view(np.int64)]

    return with_columns(docs, make, "fp long", drop=(text_col,))


def signatures(docs: DataFrame, words: int, overlap_words: int) -> DataFrame:
    """``docs`` without ``_text``, with ``fp`` and what ``overlap.links`` needs: shingles ``_n`` and ``_bands``."""

    def make(batch: pa.RecordBatch) -> list:
        texts = batch.column("_text").to_pylist()
        sizes, bands = overlap.signed(texts, overlap_words)
        return [np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64), sizes, bands]

    return with_columns(docs, make, "fp long, _n int, _bands array<long>", drop=("_text",))


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * (i % SEGMENTS)).bitwiseAND(0xFFFF)


def chain_keys(fp: Column) -> Column:
    """Keys that two fingerprints share if a chain of three segments stays within its budgets.

    With 4 segments and 3 differing bits at most, some chain of neighbouring segments has
    no difference in its first segment, one at most in the first two, and two at most in the
    first three. Then either the second segment agrees whole, or one of its halves and
    one half of the third do: five keys of 32 bits for each start, none lost.
    """
    keys = []
    for i in range(SEGMENTS):
        a, b, c = segment(fp, i), segment(fp, i + 1), segment(fp, i + 2)
        pairs = [b] + [
            x.bitwiseAND(0xFF) * 256 + y.bitwiseAND(0xFF)
            for x in (b, F.shiftright(b, 8))
            for y in (c, F.shiftright(c, 8))
        ]
        for j, pair in enumerate(pairs):
            keys.append((F.lit(i * len(pairs) + j).cast("long") * (1 << 32)) + a * 65536 + pair)
    return F.array(*keys)


def ring_passes(x: Column, y: Column) -> Column:
    """Whether some chain's cumulative differences stay within 0, 1, 2 and 3 bits."""
    diff = [F.bit_count(segment(x, i).bitwiseXOR(segment(y, i))) for i in range(SEGMENTS)]
    starts = []
    for i in range(SEGMENTS):
        sums = [sum((diff[(i + k) % SEGMENTS] for k in range(1, n)), diff[i]) for n in range(1, SEGMENTS + 1)]
        starts.append(reduce(lambda p, q: p & q, [s <= n * DISTANCE // SEGMENTS for n, s in enumerate(sums, 1)]))
    return reduce(lambda p, q: p | q, starts)


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints at 3 or fewer differing bits.

    ``fps`` has one row for each distinct ``fp``. Candidates share a 32-bit key of
    ``chain_keys``, so a bucket is a 2**32th of the fingerprints for each key, however many
    copies there are of a text; the ring filter and the full check are part of the join.
    """
    keyed = fps.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    near = ring_passes(F.col("a"), F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of the links ``a, b``; nodes that links join, however far apart, have one root.

    By local contraction: each round puts the nodes in a new order, that of a hash, and merges every node into the
    first node within two links; links between merged nodes go on to the next round. The last of a round's
    nodes in that order always goes, so it ends, and as the order is random most nodes go, even on a long path:
    rounds grow with the logarithm of the nodes. Every round is written to the shared folder; a checkpoint would carry
    on the constraints of the plans before it, which multiply from round to round.
    """
    links = edges.where("a != b").select("a", "b")
    ends = written(links.union(links.select("b", "a")).distinct())
    roots = ends.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    number = 0
    while ends.limit(1).count():
        number += 1
        place = F.struct(F.xxhash64(F.lit(number), "b").alias("order"), F.col("b").alias("node"))
        own = F.struct(F.xxhash64(F.lit(number), "a").alias("order"), F.col("a").alias("node"))
        near = ends.groupBy("a").agg(F.min(place).alias("near")).select(F.col("a").alias("b"), F.least("near", own).alias("near"))
        into = written(ends.join(near, "b").groupBy("a").agg(F.min("near")["node"].alias("into")))
        moved = ends.join(into, "a").select(F.col("into").alias("from"), "b").join(into.withColumnsRenamed({"a": "b"}), "b")
        ends = written(moved.where("from != into").select(F.col("from").alias("a"), F.col("into").alias("b")).distinct())
        known = into.withColumnRenamed("a", "root")
        roots = written(roots.join(known, "root", "left").select("node", F.coalesce("into", "root").alias("root")))
    return roots


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float | None = None, overlap_words: int = 5
) -> DataFrame:
    """``id_col, fp, component_id`` for every row: the smallest id reachable over linked fingerprints.

    Rows with equal fingerprints are linked, so a repeated row is in one class with itself, and null,
    empty and blank texts (fingerprint 0) are one class. A null id is a row like
    any other but never names a class, unless it has no other row. Other columns are ignored, texts are read whole, and
    an empty table gives an empty one.
    With ``similarity``, texts whose sets of ``overlap_words``-word shingles have at least that Jaccard
    similarity are linked as well (``overlap``).
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if similarity is None:
        marked = checkpointed(fingerprints(source, text_col="_text", words=words))
    else:
        source = source.withColumn("_hash", F.xxhash64("_text"))
        signed = checkpointed(signatures(source, words, overlap_words))
        marked = signed.select("_id", "fp")
    fps = checkpointed(marked.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("rows")))
    near = links(fps)
    if similarity is not None:
        near = checkpointed(near)
        near = near.unionByName(overlap.links(source, signed, near, components, overlap_words, similarity))
    roots = components(near)
    least = fps.join(roots, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("least").alias("named"))
    named = roots.join(least, "root").select("node", "named")
    classes = fps.join(named, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("named", "least").alias("component_id"), "rows")
    classes, share = checkpointed(classes), F.lit(marked.count() / MOST_HOT)
    hot = F.broadcast(classes.where(F.col("rows") > share).select(F.col("fp").alias("hot"), F.col("component_id").alias("hot_id")))
    split = marked.join(hot, F.col("fp") == F.col("hot"), "left")
    frequent = split.where("hot is not null").select(F.col("_id").alias(id_col), "fp", F.col("hot_id").alias("component_id"))
    rest = split.where("hot is null").join(classes.where(F.col("rows") <= share), "fp")
    return frequent.unionByName(rest.select(F.col("_id").alias(id_col), "fp", "component_id"))


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float | None = None, overlap_words: int = 5
) -> DataFrame:
    """The rows of ``docs`` whose id names their class; of rows that share that id, one.

    A class without any id keeps one row of each text.
    """
    found = checkpointed(near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity, overlap_words=overlap_words))
    kept_id = next(f"_kept{'_' * k}" for k in range(99) if f"_kept{'_' * k}" not in {c.lower() for c in docs.columns})
    named = found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias(kept_id)).agg(F.count("*").alias("_rows"))
    same = F.col(id_col) == F.col(kept_id)
    kept = docs.join(named.select(kept_id), same, "left_semi")
    twice = named.where("_rows > 1").select(kept_id)
    if twice.limit(1).count():
        kept = kept.join(twice, same, "left_anti").unionByName(docs.join(twice, same, "left_semi").dropDuplicates([id_col]))
    if found.where("component_id is null").limit(1).count():
        kept = kept.unionByName(docs.where(F.col(id_col).isNull()).dropDuplicates([text_col]))
    return kept
