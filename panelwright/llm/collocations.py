"""Phrases that keep together, mined with a bidirectional FM-index of each shard's word ids."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, give_back, rows_of_a_batch, small_batches, with_columns, written

#: Words and ends of pieces, in order.
TOKEN = re.compile(r"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")
ENDS = frozenset(".,;:!?\n\x0b\x0c\r")
#: How far a phrase's hash turns the hash of each of its words.
TURNS = (7, 23)
#: Longest phrase, and so how many words of context an index sorts by.
DEPTH = 3
#: Words of a language that have a code, at most: a code takes 16 bits.
CODES = 1 << 16
#: What tasks find of phrases, as ``Blocks`` has it.
FOUND = "lang string, bucket int, heads array<int>, tails array<short>, ns array<int>, phrases array<string>"


@dataclass
class Nodes:
    """Phrases of one length: the rows of both indexes that begin with each (its words read forwards, and backwards), how many, and its words."""

    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray
    words: list[np.ndarray]

    def take(self, which: np.ndarray) -> Nodes:
        return Nodes(self.forward[which], self.backward[which], self.size[which], [w[which] for w in self.words])


class HalfIndex:
    """Places sorted by their next ``DEPTH`` words, the word before each (the transform), and where a step back by it leads.

    Phrases of up to ``DEPTH`` words are all that is asked for, so words further on need not decide the order.
    """

    def __init__(self, ids: np.ndarray, words: int):
        key, top = ids.astype(np.int64), words
        for k in range(1, DEPTH):
            if top > (1 << 62) // words:
                key = np.unique(key, return_inverse=True)[1]
                top = int(key.max()) + 1
            key, top = key * words + np.roll(ids, -k), top * words
        order = np.argsort(key, kind="stable")
        self.before = ids[order - 1]
        by_word = np.argsort(self.before, kind="stable")
        self.back = np.empty(len(ids), np.int64)
        self.back[by_word] = np.arange(len(ids))


class PhraseIndex:
    """A bidirectional index of word ids; 0 ends a piece, and the first and last id are 0."""

    def __init__(self, ids: np.ndarray, words: int):
        self.n_words = words
        self.halves = HalfIndex(ids, words), HalfIndex(ids[::-1], words)
        self.counts = np.bincount(ids, minlength=words)

    def single(self) -> Nodes:
        """All words that occur."""
        first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        word = np.flatnonzero(self.counts[1:]) + 1
        return Nodes(first[word], first[word], self.counts[word], [word])

    def extended(self, nodes: Nodes, *, left: bool) -> Nodes:
        """Every phrase with each word that stands before (or after) it: all intervals of ``nodes`` are extended at once.

        In the one index the step back gives the interval, in the other the interval is cut in the order of words.
        """
        half = self.halves[0 if left else 1]
        low, other = (nodes.forward, nodes.backward) if left else (nodes.backward, nodes.forward)
        total = int(nodes.size.sum())
        node = np.repeat(np.arange(len(low)), nodes.size)
        start = np.cumsum(nodes.size) - nodes.size
        row = np.arange(total) + np.repeat(low - start, nodes.size)
        word = half.before[row]
        key = node * self.n_words + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, total))
        of, word = key[begin] // self.n_words, key[begin] % self.n_words
        stepped, cut = half.back[row[order[begin]]], other[of] + begin - start[of]
        rest = [w[of] for w in nodes.words]
        found = Nodes(stepped, cut, size, [word, *rest]) if left else Nodes(cut, stepped, size, [*rest, word])
        return found.take(word > 0)


def phrase_hash(lang: Column, *words: Column) -> Column:
    """A number of one or two words that tasks work out from the hashes of words alone."""
    turned = lambda h, n: F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n))
    out = F.xxhash64(lang)
    for word, turn in zip(words, TURNS):
        out = out.bitwiseXOR(turned(F.xxhash64(word), turn))
    return out


def mixed(lang: str, hashes: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """``phrase_hash`` of phrases by the ids of their words."""
    out = np.full(len(words[0]), hash_of(lang), np.uint64)
    for word, turn in zip(words, TURNS):
        out ^= (hashes[word] << np.uint64(turn)) | (hashes[word] >> np.uint64(64 - turn))
    return out


def hash_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 42)


class Ids(dict):
    """What stands between spaces, and the 32-bit ids of its words, from 1 on as they come, and of its ends of pieces, 0."""

    def __init__(self) -> None:
        self.words, self.ids = [""], {}

    def __missing__(self, between: str) -> bytes:
        out = array("i")
        for token in TOKEN.findall(between):
            if token[0] in ENDS:
                out.append(0)
            else:
                found = self.ids.setdefault(token, len(self.words))
                if found == len(self.words):
                    self.words.append(token)
                out.append(found)
        self[between] = found = out.tobytes()
        return found


class Shard:
    """The words of texts of one language, as they come."""

    def __init__(self, lang: str):
        self.lang, self.known, self.ids = lang, Ids(), bytearray(4)

    def __len__(self) -> int:
        return len(self.ids) // 4

    def add(self, text: str) -> None:
        self.ids += b"".join(map(self.known.__getitem__, text.split(" ")))
        self.ids += bytes(4)

    def row(self) -> pa.RecordBatch:
        ids = np.frombuffer(self.ids, np.int32)
        counts = np.bincount(ids, minlength=len(self.known.words))[1:].tolist()
        cols = [pa.array([self.lang]), pa.array([bytes(self.ids)], pa.binary()), pa.array([self.known.words[1:]], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "ids", "words", "counts"])


@dataclass
class Kept:
    """A shard as it was kept."""

    lang: str
    names: pa.Array
    index: PhraseIndex
    hashes: np.ndarray

    @staticmethod
    def read(row: dict) -> Kept:
        words = ["", *row["words"]]
        return Kept(row["lang"], pa.array(words, pa.string()), PhraseIndex(np.frombuffer(row["ids"], np.int32).astype(np.int64), len(words)), np.array([*map(hash_of, words)], np.uint64))

    def frequent(self, bits: np.ndarray, nodes: Nodes, *at: int) -> Nodes:
        """Nodes whose words at these places have their bit set."""
        place = (mixed(self.lang, self.hashes, *[nodes.words[i] for i in at]) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
        return nodes.take((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool))

    def found(self, nodes: Nodes, common: dict[str, pa.Array], blocks: Blocks) -> Iterator[pa.RecordBatch]:
        """Rows of ``FOUND`` of nodes: phrases of common words only go into blocks, as one number each, the others as they are."""
        code = np.full(len(self.names), -1)
        if self.lang in common:
            code = pc.fill_null(pc.index_in(self.names, value_set=common[self.lang]), -1).to_numpy().astype(np.int64)
        key, coded = np.zeros(len(nodes.size), np.int64), np.ones(len(nodes.size), bool)
        for w in nodes.words:
            key, coded = key << 16 | code[w], coded & (code[w] >= 0)
        rest = nodes.take(~coded)
        bucket = blocks.bucket(mixed(self.lang, self.hashes, *rest.words))
        order = np.argsort(bucket, kind="stable")
        phrase = pc.binary_join_element_wise(*[self.names.take(pa.array(w[order])) for w in rest.words], " ")
        yield from blocks.rows(self.lang, bucket[order], rest.size[order], phrases=phrase)
        yield from blocks.add(self.lang, key[coded], nodes.size[coded])


class Blocks:
    """Counts of phrases of ``n_words`` common words, by the codes of the words, added up over the shards of a task and dealt to buckets.

    A row of ``FOUND`` has a bucket's phrases in arrays: 4 bytes for two codes, 2 for a third one, and the count, instead of the phrase and its language.
    About ``most`` phrases are held; the language with the most goes first.
    """

    def __init__(self, n_words: int, buckets: int, most: int):
        self.n_words, self.buckets, self.most = n_words, buckets, most
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        """Buckets by the hashes' upper half."""
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.uint16)

    def add(self, lang: str, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        if lang in self.held:
            key, n = (np.concatenate(both) for both in zip(self.held.pop(lang), (key, n)))
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.held[lang] = key[begin], np.add.reduceat(n[order], begin)
        while sum(len(k) for k, _ in self.held.values()) > self.most:
            yield from self.out(max(self.held, key=lambda x: len(self.held[x][0])))

    def rest(self) -> Iterator[pa.RecordBatch]:
        for lang in [*self.held]:
            yield from self.out(lang)

    def out(self, lang: str) -> Iterator[pa.RecordBatch]:
        key, n = self.held.pop(lang)
        bucket = self.bucket(key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(bucket, kind="stable")
        key = key[order]
        tails = (key & 0xFFFF).astype(np.uint16).view(np.int16) if self.n_words == DEPTH else None
        yield from self.rows(lang, bucket[order], n[order], heads=(key >> 16 * (self.n_words - 2)).astype(np.uint32).view(np.int32), tails=tails)

    def rows(self, lang: str, bucket: np.ndarray, n: np.ndarray, **arrays: np.ndarray | pa.Array | None) -> Iterator[pa.RecordBatch]:
        """Rows of ``FOUND`` of phrases in the order of their buckets; arrays that are not given are empty."""
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(bucket))
        for at in range(0, len(begin), 64):
            b, e = begin[at : at + 64], end[at : at + 64]
            cols = [pa.repeat(lang, len(b)), pa.array(bucket[b].astype(np.int32))]
            for name, type_ in (("heads", pa.int32()), ("tails", pa.int16()), ("ns", pa.int32()), ("phrases", pa.string())):
                values = n if name == "ns" else arrays.get(name)
                given = values is not None
                values = pa.array(values[b[0] : e[-1]], type_) if given else pa.array([], type_)
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(b, e[-1]) - b[0] if given else np.zeros(len(b) + 1), pa.int32()), values))
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "bucket", "heads", "tails", "ns", "phrases"])


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Texts gathered by language into shards of about ``most`` words; while several languages share the bound the largest one goes first."""
    open_: dict[str, Shard] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
            shard = open_.setdefault(lang, Shard(lang))
            before = len(shard)
            shard.add(text)
            held += len(shard) - before
            if held > most:
                full = max(open_.values(), key=len)
                held -= len(full)
                del open_[full.lang]
                yield full.row()
    yield from (shard.row() for shard in open_.values())
    give_back()


def bits_of(rows: DataFrame, hash_: Column, n: int) -> np.ndarray:
    """A set of ``n`` bits with one set for each row's hash."""
    places = rows.select((hash_.bitwiseAND(F.lit(n - 1)) + 1).alias("_p"))
    parts = places.groupBy(F.bitmap_bucket_number("_p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("bits"))
    bits = np.zeros(n // 8, np.uint8)
    for r in parts.collect():
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def commonest(one: DataFrame, most: int) -> dict[str, pa.Array]:
    """``most`` of the commonest words or somewhat fewer, by language, at most ``CODES`` of each; a word's place is its code."""
    level, rank, held = F.floor(F.log2("n") * 8), None, 0
    for r in sorted(one.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            break
        rank = r["level"]
    words = one.where(level >= rank if rank is not None else F.lit(False)).select("lang", F.col("phrase").alias("word"), "n").toArrow()
    words = words.sort_by([("lang", "ascending"), ("n", "descending"), ("word", "ascending")]).combine_chunks()
    lang = words.column("lang").dictionary_encode().combine_chunks()
    begin = np.flatnonzero(np.diff(lang.indices.to_numpy(), prepend=-1))
    end = np.append(begin[1:], len(words))
    return {of: pa.array(words.column("word").slice(b, min(e - b, CODES)).to_pylist(), pa.string()) for of, b, e in zip(lang.dictionary.to_pylist(), begin, end)}


def named(batch: pa.RecordBatch, common: dict[str, pa.Array], n_words: int) -> pa.Array:
    """The phrases of rows with ``lang, heads, tails, phrases``, whose codes become words."""
    head, tail = (pc.fill_null(batch.column(c), 0).to_numpy().astype(np.int64) for c in ("heads", "tails"))
    codes = [head >> 16 & CODES - 1, head & CODES - 1, tail & CODES - 1][:n_words]
    lang, out = batch.column("lang").dictionary_encode(), batch.column("phrases")
    for i, of in enumerate(lang.dictionary.to_pylist()):
        mine = pc.and_(pc.equal(lang.indices, i), batch.column("heads").is_valid())
        if pc.any(mine).as_py():
            which = mine.to_numpy(zero_copy_only=False)
            out = pc.replace_with_mask(out, mine, pc.binary_join_element_wise(*[common[of].take(pa.array(c[which])) for c in codes], " "))
    return out


def phrases(
    docs: DataFrame, *, text_col: str, lang_col: str, least: int, shard_words: int, filter_bits: int, common_words: int = 1 << 18, buckets: int = 512, merged: int = 1 << 21,
) -> tuple[DataFrame, DataFrame]:
    """``lang, n_words, phrase, n`` of all words and phrases of two and three with ``n`` of at least ``least``, and ``lang, n`` of all words.

    Texts are read once: each task gathers them in shards of word ids, which are kept. The counts of words are added up, then those of pairs
    and then of three words, from an index of each shard. Phrases are enumerated only where all their words, and of three
    words either pair, can have ``least``: for each frequent word's and pair's hash a bit is set in a set of fixed size that is sent to
    the tasks. It lets some others through, and loses none. Three words are enumerated from the middle one, to the left and then to the right.

    Most phrases consist of a language's commonest words. About ``common_words`` of these in all are sent to the tasks and have codes, so that a phrase
    of them is shuffled as 4 or 6 bytes and its count, after a task has added up about ``merged`` of them; the others are shuffled as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("_lang"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    shards = written(rows.mapInArrow(lambda batches: gathered(batches, shard_words), "lang string, ids binary, words array<string>, counts array<long>"), group_bytes=4 << 20)

    def kept_counts(counts: DataFrame, n_words: int) -> DataFrame:
        return written(counts.where(F.col("n") >= least).select("lang", F.lit(n_words).alias("n_words"), "phrase", "n"))

    counted = shards.select("lang", F.inline(F.arrays_zip(F.col("words").alias("phrase"), F.col("counts").alias("n"))))
    totals = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    one = kept_counts(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), 1)
    first = spark.sparkContext.broadcast(bits_of(one, phrase_hash(F.col("lang"), F.col("phrase")), filter_bits))
    common = spark.sparkContext.broadcast(commonest(one, common_words))

    def summed(found: DataFrame) -> DataFrame:
        # Grouped where the buckets are dealt to: no second shuffle.
        each = found.repartition("lang", "bucket").select("lang", "bucket", F.inline(F.arrays_zip("heads", "tails", "ns", "phrases")))
        by = each.groupBy("lang", "bucket", "heads", "tails", "phrases").agg(F.sum("ns").alias("n"))
        return written(by.where(F.col("n") >= least).drop("bucket"))

    def with_names(counts: DataFrame, n_words: int) -> DataFrame:
        return kept_counts(with_columns(counts, lambda batch: [named(batch, common.value, n_words)], "phrase string", drop=("heads", "tails", "phrases")), n_words)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(2, buckets, merged)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Kept.read(row)
                single = shard.frequent(first.value, shard.index.single(), 0)
                yield from shard.found(shard.frequent(first.value, shard.index.extended(single, left=False), 1), common.value, blocks)
        yield from blocks.rest()
        give_back()

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(3, buckets, merged)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Kept.read(row)
                single = shard.frequent(first.value, shard.index.single(), 0)
                two = shard.frequent(second.value, shard.index.extended(single, left=True), 0, 1)
                yield from shard.found(shard.frequent(second.value, shard.index.extended(two, left=False), 1, 2), common.value, blocks)
        yield from blocks.rest()
        give_back()

    kept = shards.select("lang", "ids", "words")
    with rows_of_a_batch(spark, 1):
        coded = summed(kept.mapInArrow(pairs, FOUND))
    two = with_names(coded, 2)
    word = F.split("phrase", " ")
    second = spark.sparkContext.broadcast(bits_of(two, phrase_hash(F.col("lang"), word[0], word[1]), filter_bits))
    with rows_of_a_batch(spark, 1):
        coded = summed(kept.mapInArrow(triples, FOUND))
    three = with_names(coded, 3)
    return one.unionByName(two).unionByName(three), totals


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), in whole numbers of up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast(({wide(a)} * {wide(a)} * 1000000) div ({wide(left)} * {wide(right)}) as bigint)")


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, within: int = 50,
    shard_words: int = 600_000, filter_bits: int = 1 << 26,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two or three words of each language.

    A phrase has ``a >= least`` occurrences within pieces. Of its cuts into a first and a rest the one with the lowest score counts, the
    first among equals. A phrase goes if a longer one around it has ``within`` percent of its occurrences. Best first: by score, ``a``,
    and the bytes of the phrase. Each copy of a row counts; null texts have no words and a null language is ``und``.

    A common word begins a large share of all phrases: the joins with counts of parts are plain ones, whose skewed partitions Spark splits. The
    ``top`` rows are chosen within partitions first. ``filter_bits`` is a power of two.
    """
    found, totals = phrases(docs, text_col=text_col, lang_col=lang_col, least=least, shard_words=shard_words, filter_bits=filter_bits)
    some = found.where("n_words > 1").select("lang", "n_words", "phrase", F.col("n").alias("a"))
    word = F.split("phrase", " ")
    join = lambda i, n: F.array_join(F.slice(word, i, n), " ")
    k = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    cuts = some.select("*", k).select("*", join(F.lit(1), F.col("k")).alias("_first"), join(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("_rest"))
    known = found.where("n_words < 3")
    for part, name in (("_first", "l"), ("_rest", "r")):
        counts = known.select(F.col("lang"), F.col("phrase").alias(part), F.col("n").alias(name))
        cuts = cuts.join(counts, ["lang", part])
    cuts = cuts.withColumn("score", score_of("a", "l", "r"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n_words")).alias("_b")).select("lang", "phrase", "_b.*")
    longer = some.where(F.col("n_words") == DEPTH).select("lang", F.explode(F.array(join(F.lit(1), F.lit(2)), join(F.lit(2), F.lit(2)))).alias("phrase"), F.col("a").alias("_around"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("_around").alias("_around"))
    free = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("_around").isNull() | (F.col("_around") * 100 < F.col("a") * within))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
