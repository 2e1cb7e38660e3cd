"""Vector codes, sentence pieces and collocations against plain versions, the library, and awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from panelwright.llm import codes, collocations, pieces, queries
from test_llm import LONG, ODD, SF, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def table():
    return pieces.PrefixTable(pieces.vocabulary(PATH))


def test_trees_find_the_first_nearest_entry_and_its_sums():
    rng = np.random.RandomState(1)
    for n, width, spread in ((1, 3, 5), (40, 4, 3), (3000, 4, 90), (2500, 2, 6), (900, 4, 0)):
        x = (rng.randn(n, width) * spread).astype(np.int64)
        points, repeats = np.unique(x, axis=0, return_counts=True)
        tree, order = codes.grown(points, repeats)
        assert sorted(order) == list(range(len(points))) and (tree.points == points[order]).all()
        entries = np.concatenate([x[rng.randint(0, n, 20)], x[:1], x[:1]])
        code, count, total = codes.owned(codes.Tree.read(tree.packed(), width), entries)
        want = codes.squared(tree.points, entries).argmin(axis=1)
        assert (code == want).all() and (count == np.bincount(want, weights=tree.repeats, minlength=22)).all()
        sums = np.zeros((22, width), np.int64)
        np.add.at(sums, want, tree.points * tree.repeats[:, None])
        assert (sums == total).all()
        inside = tree.children[:, 0] >= 0
        left, right = tree.children[inside].T
        assert (tree.count[inside] == tree.count[left] + tree.count[right]).all() and (tree.total[inside] == tree.total[left] + tree.total[right]).all()


def plain_codes(vectors, parts, entries, rounds):
    """Codes, errors and books of (id, vector) by whole distance tables."""
    kept = [(i, np.clip(np.floor(256 * np.array(v, np.float64)), -(1 << 24), 1 << 24).astype(np.int64)) for i, v in vectors]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))[:entries]
    dim = len(kept[0][1])
    books, out, error = [], [[] for _ in kept], [0] * len(kept)
    for p in range(parts):
        s = slice(p * dim // parts, (p + 1) * dim // parts)
        x, book = np.array([v[s] for _, v in kept]), np.array([v[s] for _, v in first])
        for step in range(rounds + 1):
            d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            if step < rounds:
                for e in set(near):
                    book[e] = x[near == e].sum(axis=0) // (near == e).sum()
        books.append(book)
        for i, e in enumerate(near):
            out[i].append(int(e))
            error[i] += int(d[i, e])
    return Counter((i, bytes(c), e) for (i, _), c, e in zip(kept, out, error)), books


@pytest.mark.parametrize("dim,parts,entries,block", [(8, 4, 6, 50), (7, 3, 64, 4096), (3, 5, 2, 7)])
def test_codes_equal_whole_distance_tables(spark, dim, parts, entries, block):
    rng = np.random.RandomState(2)
    data = [(int(i) if i % 11 else None, [float(v) for v in rng.choice([-1.5, 0.1, 0.3, 2.0], dim)] if i % 3 else [0.25] * dim) for i in range(150)]
    data += [(3, [1e300] * dim), (4, [-70000.0] * dim)]
    bad = [(900, None), (901, []), (902, [0.5] * (dim + 1)), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [None] * dim)]
    table = spark.createDataFrame([(i, v, "c", 1.5) for i, v in data + bad], "vec_id long, embedding array<double>, _code string, _vec double")
    found, books = codes.compress(table, keep=["vec_id", "_vec"], parts=parts, entries=entries, block=block)
    want, plain = plain_codes(data, parts, entries, 2)
    assert Counter((r["vec_id"], bytes(r["_code"]), r["_error"]) for r in found.collect()) == want
    assert all((a == b).all() for a, b in zip(books, plain)) and {r["_vec"] for r in found.collect()} == {1.5}
    nothing, none = codes.compress(table.where("vec_id > 899 and vec_id <> 902 and vec_id <> 901"), keep=["vec_id"])
    assert nothing.count() == 0 and none == []


def test_code_query_on_the_given_vectors(spark):
    got = {r["vec_id"]: r for r in queries.op11_vector_codes(spark, SF).collect()}
    have = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want, books = plain_codes([(r["vec_id"], r["embedding"]) for r in have], 16, 64, 2)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    of_label = Counter()
    for r in have:
        of_label[r["label"]] += got[r["vec_id"]]["error"]
    assert Counter((i, bytes.fromhex(r["code"]), r["error"]) for i, r in got.items()) == want
    assert all(got[r["vec_id"]]["label_error"] == of_label[r["label"]] and got[r["vec_id"]]["codebooks_sha256"] == digest for r in have)


def test_pieces_equal_the_library(spark, model, table):
    random.seed(3)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["".join(random.choices(" ▁ab\n\t\x00é漢😀<>ﬁthe²" + "aaaa    .,", k=random.randint(0, 60))) for _ in range(3000)]
    texts += [c * k for c in (" ", "a", "=", "▁", "\n", "漢", "ё") for k in (1, 2, 3, 15, 16, 17, 33, 64)] + ["<s></s><unk><0x0A>", LONG, "x" * 50_000]
    names = [model.id_to_piece(i).replace("▁", " ") for i in range(259, model.get_piece_size())]
    texts += ["".join(random.choices(names, k=5)) for _ in range(3000)]
    want = model.encode([t or "" for t in texts], num_threads=1)
    assert [np.frombuffer(table.encode(t), np.int32).tolist() for t in texts] == want
    lists = pieces.id_lists([np.array(w, np.int32).tobytes() for w in want])
    decoded = pieces.decode_lists(table.words, pieces.pa.array(table.words.surface, pieces.pa.binary()), np.array(table.words.opens), lists)
    assert decoded == model.decode(want)
    odd = [[random.choice([*range(262), random.randrange(32000)]) for _ in range(random.randint(0, 8))] for _ in range(5000)]
    assert [pieces.decoded(table.words, x) for x in odd] == [model.decode(x) for x in odd]


def test_neighbours_go_together_as_merging_says(table):
    random.seed(4)
    tokens = list(table.text)
    for _ in range(20000):
        text = table.text[random.choice(tokens)]
        if random.random() < 0.5 and len(text) > 1:
            k = random.randint(1, len(text) - 1)
            a, b = table.words.tokens.get(text[:k]), table.words.tokens.get(text[k:])
        else:
            a, b = random.choice(tokens), random.choice(tokens[:3000])
        if a is not None and b is not None:
            assert table.together(a, b) == (table.plain(table.text[a] + table.text[b]) == [a, b])


def test_one_token_ends_each_prefix(table):
    for text in (" the thermonuclear cat's", "  internationalisation,,", "aaaaaaa"):
        last = table.last_tokens(text)
        for k in range(1, len(text) + 1):
            assert table.ids(text[:k])[-1] == last[k]


def test_piece_columns_of_awkward_rows(spark, model, monkeypatch):
    docs = rows(spark, [*ODD, "a▁b  c", "日本\n語" * 3000]).withColumn("_ids", F.lit("clash")).withColumn("_text", F.lit(1))
    found = pieces.decode_ids(pieces.encode_texts(docs, PATH, keep=["doc_id", "key", "_text"]), PATH)
    want = {r["doc_id"]: model.encode(r["text"] or "", add_eos=True) for r in docs.collect()}
    got = found.collect()
    assert {r["doc_id"]: list(r["_ids"]) for r in got} == want and {r["key"] for r in got} == {"k"}
    assert {r["doc_id"]: r["_decoded"] for r in got} == {i: model.decode(x) for i, x in want.items()}
    assert pieces.encode_texts(docs.limit(0), PATH, keep=["doc_id"]).count() == 0
    lists = spark.createDataFrame([([1, 264, 2],), (None,), ([],), ([264, None],), ([99999],), ([3 + 0xC3],), ([28705, 3 + 0x41],)], "_ids array<int>")
    assert [r["_decoded"] for r in pieces.decode_ids(lists, PATH).collect()] == ["a", None, "", None, None, "�", "A"]
    for name in ("KEPT_WORDS", "KEPT_PAIRS", "KEPT_STEPS"):
        monkeypatch.setattr(pieces, name, 3)
    small = pieces.PrefixTable(pieces.vocabulary(PATH))
    for text in ("one two, three four.", "five  six\nseven", "eight nine ten eleven"):
        assert np.frombuffer(small.encode(text), np.int32).tolist() == model.encode(text)


def test_piece_query_on_the_given_texts(spark, model):
    got = {r["doc_id"]: r for r in queries.op12_sentence_pieces(spark, SF).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = model.encode(r["text"] or "", add_eos=True)
        assert tuple(got[r["doc_id"]])[1:] == (len(ids), digest(" ".join(map(str, ids))), digest(model.decode(ids)))


def plain_counts(texts):
    counts = Counter()
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            for k in (1, 2, 3):
                counts.update(zip(*[words[i:] for i in range(k)]))
    return counts


def plain_collocations(data, least, top):
    out = []
    for lang in {lang or "und" for lang, _ in data}:
        f = plain_counts([t for x, t in data if (x or "und") == lang])
        n = sum(v for p, v in f.items() if len(p) == 1)
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in some.items():
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            around = [b for q, b in some.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if not any(100 * b >= 50 * a for b in around):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_phrase_intervals_extend_both_ways():
    random.seed(5)
    texts = ["".join(random.choices(["a ", "b ", "c ", "dd ", ". ", "é\t", "a"], k=200)) for _ in range(30)]
    shard = collocations.Shard("x")
    for t in texts:
        shard.add(t)
    kept = collocations.Kept.read(shard.row().to_pylist()[0])
    index = kept.index
    one = index.single()
    left, right = index.extended(one, left=True), index.extended(one, left=False)
    name = kept.names.to_pylist()
    of = lambda nodes: {tuple(name[w[i]] for w in nodes.words): int(nodes.size[i]) for i in range(len(nodes.size))}
    want = plain_counts(texts)
    size = lambda k: {p: v for p, v in want.items() if len(p) == k}
    assert of(one) == size(1) and of(left) == of(right) == size(2)
    assert of(index.extended(left, left=False)) == of(index.extended(right, left=True)) == of(index.extended(left, left=True)) == size(3)


@pytest.mark.parametrize("shard_words,filter_bits", [(40, 1 << 15), (100_000, 1 << 26)])
def test_collocations_equal_a_plain_count(spark, shard_words, filter_bits):
    random.seed(6)
    words = ["The", "cat", "sat", "on", "mat x", "é", "|", "1.5", "a,b", "dog\tran", "x\ny"]
    data = [(random.choice(["en", "de", None]), " ".join(random.choices(words[: random.randint(2, 11)], k=random.randint(0, 60)))) for _ in range(120)]
    data += [("en", None), (None, ""), ("fr", "hot hot hot"), ("en", "the cat sat on the mat " * 400)] + [("de", "copy of a copy of it")] * 50
    docs = spark.createDataFrame([(i, lang, t, 1) for i, (lang, t) in enumerate(data)], "doc_id int, lang string, text string, n int")
    got = collocations.collocations(docs, least=10, top=15, shard_words=shard_words, filter_bits=filter_bits)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(data, 10, 15)
    assert collocations.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("common_words,merged", [(0, 100), (6, 1), (14, 20), (100, 1 << 21)])
def test_phrases_of_common_and_of_other_words_are_counted_alike(spark, common_words, merged):
    random.seed(9)
    words = ["the", "cat", "sat", "on", "é", "|", "1-5", "x" * 40, "ab"]
    data = [(random.choice(["en", "de", None]), " ".join(random.choices(words[: random.randint(2, 9)], k=random.randint(0, 60)))) for _ in range(90)]
    docs = spark.createDataFrame(data, "lang string, text string")
    found, _ = collocations.phrases(docs, text_col="text", lang_col="lang", least=3, shard_words=300, filter_bits=1 << 15, common_words=common_words, buckets=5, merged=merged)
    want = []
    for lang in ("en", "de", "und"):
        f = plain_counts([t for x, t in data if (x or "und") == lang])
        want += [(lang, len(p), " ".join(p), n) for p, n in f.items() if n >= 3]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def shuffled_bytes(spark, first):
    """Bytes of the shuffles of stages from ``first`` on, and the number of the next stage."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    each = [(s.stageId(), s.shuffleWriteBytes()) for s in map(stages.apply, range(stages.size()))]
    return sum(n for i, n in each if i >= first), max([-1, *(i for i, _ in each)]) + 1


def test_phrases_of_collocations_are_not_shuffled_as_text(spark):
    rng = np.random.RandomState(3)
    words = np.array([f"word{i}" for i in range(250)])
    texts = [" ".join(words[rng.randint(0, 250, 500)]) for _ in range(500)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    _, first = shuffled_bytes(spark, 0)
    collocations.phrases(docs, text_col="text", lang_col="lang", least=2, shard_words=10_000, filter_bits=1 << 26)
    assert shuffled_bytes(spark, first)[0] < 2 * sum(map(len, texts))


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 9_000_000_011, 4_000_000_009
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations.score_of("a", "l", "r")).first()
    assert row[0] == 10**6 * a * a // (l * r)


def test_hashes_of_phrases_are_the_engine_s(spark):
    pairs = [("the", "cat"), ("é", "|"), ("x" * 50, "y")]
    table = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in table.select(collocations.phrase_hash(F.lit("en"), F.col("a"), F.col("b"))).collect()]
    hashes = np.array([collocations.hash_of(w) for p in pairs for w in p], np.uint64)
    mine = collocations.mixed("en", hashes, np.array([0, 2, 4]), np.array([1, 3, 5]))
    assert [int(h) for h in mine.astype(np.int64)] == got


def test_long_pre_tokens_are_counted_and_not_sent(spark, model, monkeypatch):
    from pyspark import SparkContext

    from panelwright.llm import tokens

    random.seed(7)
    long_ = ["".join(chr(random.randrange(0x4E00, 0x9FA0)) for _ in range(20_000)) for _ in range(4)]
    texts = [t for t in long_ for _ in range(9)] + ["the cat sat"] * 9 + [None, ""]
    sent = []
    real = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or real(self, value))
    got = tokens.count_tokens(rows(spark, texts), PATH, keep=["doc_id"]).collect()
    assert {r["doc_id"]: r["_tokens"] for r in got} == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    assert [k for k in sent if isinstance(k, dict)] == [{"the": 1, "cat": 1, "sat": 1}]
