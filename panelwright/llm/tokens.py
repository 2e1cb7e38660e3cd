"""Token counts by counting pieces once for each distinct pre-token."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_columns, written

SPACE = "▁"
#: Longer pre-tokens, in characters, are never sent to all tasks nor counted on the way to it.
LONGEST = 48


def pre_tokens(text: str) -> list[str]:
    """Spaces with the other characters that follow them, after the space that the model puts in front.

    No piece of the model goes on from another character to a space (``splits_at_spaces``),
    so the merges of one pre-token never touch those of the next and the counts add up.
    """
    if not text:
        return []
    parts = text.replace(SPACE, " ").split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for part in parts[:-1]:
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    out.append(" " * spaces + parts[-1])
    return out


def splits_at_spaces(pieces: list[str]) -> bool:
    return not any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:]))


@lru_cache(maxsize=4)
def loaded(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    if not splits_at_spaces(pieces):
        raise ValueError("the model has pieces that go on over a space; pre-tokens can't be counted alone")
    return model


def piece_counts(path: str, words: list[str]) -> list[int]:
    """Pieces of each pre-token; the model adds the one space that was taken off it in front, but not to nothing."""
    return [len(x) or 1 for x in loaded(path).encode(words, num_threads=1)]


def count_tokens(docs: DataFrame, path: str, *, keep: list[str], text_col: str = "text", common: int = 200_000, least: int = 8) -> DataFrame:
    """The columns ``keep`` of each row with ``_bytes`` (UTF-8) and ``_tokens``.

    ``path`` is the model's, the same on every machine. Each distinct pre-token is encoded
    once. Those of ``LONGEST`` characters at most that some task meets ``least`` times, the ``common`` most frequent of them
    at most, are sent to all tasks, which is 38 MB of text at most (200,000 of 48 characters of 4 bytes), and are summed where the
    text is read. All others, long runs without a space among them, go, with the row and how often it has them, to the task that holds the
    pre-token; there each is encoded once, and the products are summed by row. A row
    is told apart by its place in the input, so repeated rows and null ids are counted
    each for itself. Null and empty texts have 0 bytes and 0 tokens.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                if text:
                    seen.update(p for p in pre_tokens(text) if len(p) <= LONGEST)
                if len(seen) > 500_000:
                    yield counted(seen)
                    seen = Counter()
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        often = [(w, n) for w, n in seen.items() if n >= least]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["word", "n"])

    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*[F.col(c).alias(f"_in_{c}") for c in keep], F.col(text_col).alias("_text"))
    words = rows.select("_text").mapInArrow(frequent, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(common).select("word")
    known = {r["word"]: r["pieces"] for r in with_columns(top, lambda b: [piece_counts(path, b.column("word").to_pylist())], "pieces int").collect()}
    sent = spark.sparkContext.broadcast(known)

    def sums(batch: pa.RecordBatch) -> list:
        have, total, rare = sent.value.get, [], []
        for text in batch.column("_text").to_pylist():
            parts = pre_tokens(text) if text else []
            got = [have(p) for p in parts]
            if None in got:
                rare.append(list(Counter(p for p, n in zip(parts, got) if n is None).items()))
                total.append(sum(filter(None, got)))
            else:
                rare.append([])
                total.append(sum(got))
        return [total, [[{"word": w, "n": n} for w, n in r] for r in rare]]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces = None, 0
        for batch in batches:
            run = batch.column("word").dictionary_encode()
            each = run.dictionary.to_pylist()
            if each and each[0] == last:
                counts = [pieces, *piece_counts(path, each[1:])]
            else:
                counts = piece_counts(path, each)
            if each:
                last, pieces = each[-1], counts[-1]
            total = pc.multiply(pa.array(counts, pa.int64()).take(run.indices), batch.column("n"))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), total], names=["_row", "_tokens"])

    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bytes", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long"))
    summed = written(with_columns(rows, sums, "_known long, _rare array<struct<word:string,n:long>>", drop=("_text",)))
    rare = summed.select("_row", F.inline("_rare")).repartition("word").sortWithinPartitions("word")
    rest = rare.mapInArrow(products, "_row long, _tokens long").groupBy(F.col("_row").alias("_of")).agg(F.sum("_tokens").alias("_rest"))
    joined = summed.drop("_rare").join(rest, F.col("_row") == F.col("_of"), "left")
    tokens = F.col("_known") + F.coalesce("_rest", F.lit(0))
    return joined.select(*[F.col(f"_in_{c}").alias(c) for c in keep], "_bytes", tokens.alias("_tokens"))
