"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written

WORD = r"[^\x20\x09-\x0D]+"
#: A table of partitions and sources with more rows than this isn't broadcast but joined by shuffle.
MOST_PARTS = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source, the same in every run."""
    name = F.concat(F.when(source.isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(source, F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from one row for each source.

    Sources in code point order, null last, take ``weights`` in turn. They divide ``share``
    of all sizes by weight; a target stops at ``most`` times its source's size and the
    excess is divided again among the others. That ends where every source gets its cap or its
    weight times one level, so the level is read off the sources in order of cap over weight:
    the first whose share of what is left is under its cap sets it. The table has a row for each source.
    """
    weigh = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", weigh[F.col("_k") % len(weights)]).withColumn("_cap", F.lit(most) * F.col("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upward = Window.orderBy(F.col("_cap") / F.col("_w"), "_k")
    ranked = ranked.withColumn("_left", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("_level", F.col("_left") / F.sum("_w").over(upward.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_free", F.col("_level") * F.col("_w") < F.col("_cap"))
    first = F.min_by(F.when(F.col("_free"), F.col("_level")), F.when(F.col("_free"), F.col("_cap") / F.col("_w"))).over(every)
    target = F.coalesce(F.least("_cap", first * F.col("_w")), F.col("_cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: list[str] | None = None,
    seed: int = 29,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """The columns ``keep`` (the id, if not given) of every row with ``_size, _source_size, _target, _copies``.

    Every document of a source expects ``target / source_size`` copies. Within a source, in
    order of size and id, the expected copies are summed up to each document, the source's
    offset is added, and a copy is taken for each integer crossed; so no document has more
    than ``most`` copies, rounded up, and the words taken differ from the target by about
    one longest document. The position within a source comes from a range partitioning by
    source, size and id: the place in the partition plus the totals of the partitions
    before, so a source of any size is spread over tasks. Those totals, at most a row for each partition
    and one for each source, are broadcast up to ``MOST_PARTS`` rows and joined by shuffle beyond. The targets are
    worked out in one task over a row for each source. A null source is one
    of the sources; rows without words count with size 0; equal rows may swap places; a text counts whole; an empty table gives
    an empty one. A kept column with a result's name gives way to the result.
    """
    keep = [c for c in keep or [id_col] if c.lower() not in ("_size", "_source_size", "_target", "_copies")]
    rows = docs.select(
        *[F.col(c).alias(f"_in_{c}") for c in keep], F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size")
    )
    order = [F.col("_source").asc_nulls_last(), F.col("_size").asc(), F.col("_id").asc_nulls_last()]
    narrow = all(docs.schema[c].dataType.simpleString() != "string" for c in keep)
    # The range bounds are sampled from the rows: of a narrow table words are counted once, not twice.
    rows = checkpointed(rows) if narrow else rows
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = (checkpointed if narrow else written)(placed.withColumn("_part", F.shiftright("_at", 33)))

    parts = checkpointed(
        placed.groupBy("_part", "_source").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"), F.min("_at").alias("_first"))
    )
    sizes = parts.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").cast("double").alias("source_size"))
    goal = targets(sizes, weights=weights, share=share, most=most)
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    known = parts.join(goal, F.col("_source").eqNullSafe(F.col("source"))).select(
        F.col("_part").alias("_p"), F.col("_source").alias("_s"), "_before", "source_size", "target", offset(F.col("_source"), seed).alias("_u")
    )
    known = F.broadcast(known) if parts.count() <= MOST_PARTS else known
    joined = placed.join(known, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("_at") + F.col("_before")
    copies = F.floor(F.col("_u") + each * (place + 1)) - F.floor(F.col("_u") + each * place)
    return joined.select(
        *[F.col(f"_in_{c}").alias(c) for c in keep],
        F.col("_size"),
        F.col("source_size").cast("long").alias("_source_size"),
        F.col("target").alias("_target"),
        copies.alias("_copies"),
    )


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it, whatever its columns are called."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    taken = mix(docs.toDF(*own.values()), keep=list(own.values()), id_col=own[id_col], text_col=own[text_col], source_col=own[source_col], **options)
    repeated = taken.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*[F.col(c).alias(name) for name, c in own.items()])
