"""Whole results of queries and of the pipeline against plain Python, and rows that are hard to deal with."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import ann, decontam, langid, queries, sharding, simhash, toxicity, url_filter
from test_llm import LONG, ODD, SF, brute_hits, longest_phrases, rows


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def brute_rule(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for spec in ("com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"):
        at, start = spec.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and len(spec) > len(best or ""):
            best = spec
    return host, path, best


def test_url_verdicts_against_plain_python(spark):
    got = {r["page_id"]: r for r in queries.op1_url_filter(spark, SF).collect()}
    pages = table(spark, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        rule = brute_rule(p["url"])
        assert (r["host"], r["path"], r["rule"]) == rule
        fixed = {"com/": "allow", "www.example.com/en/": "allow"}.get(rule[2], "block" if rule[2] else None)
        assert r["verdict"] == (fixed or ("block" if r["score"] >= 0.5 else "allow")) and 0 <= r["score"] <= 1


def test_urls_of_many_copies_and_rare_labels_are_learnt(spark):
    few = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "http://a.net/es/x").otherwise("http://b.com/y").alias("url"), (F.col("id") % 2 == 0).cast("double").alias("label"))
    pages = spark.createDataFrame([(1, "http://a.net/q"), (2, "http://b.com/q" * 5000)], "page_id long, url string")
    assert url_filter.judge_urls(pages, few, queries.URL_RULES, max_train=2, trees=2).count() == 2
    one = few.where("label = 1")
    assert {r["verdict"] for r in url_filter.judge_urls(pages, one, []).collect()} == {"block"}


def test_language_against_plain_cross_parsing():
    random.seed(3)
    samples = {"a": "".join(random.choices("abcde  ", k=900)), "b": "".join(random.choices("cdefg  ", k=700)), "c": "".join(random.choices("abxyz  ", k=500))}
    model = langid.Automata(samples)
    clean = {k: re.sub(r"[^a-z]+", " ", v) for k, v in samples.items()}
    texts = ["".join(random.choices("abcdefgxyzQ .,1", k=random.randint(1, 300))) for _ in range(60)] + ["a" * 50, "é", "1 2"]
    langs, scores, rates, letters = langid.judge(model, texts)
    for t, lang, score, rate, n in zip(texts, langs, scores, rates, letters):
        assert n == sum(c.isalpha() for c in t)
        if not n:
            assert (lang, score) == ("und", 0.0)
            continue
        plain = re.sub(r"[^a-zé]+", " ", t.lower())
        cost = {k: longest_phrases(clean[k], plain) * math.log2(len(clean[k]) + 2) for k in samples}
        best = min(sorted(cost), key=cost.get)
        rest = min(v for k, v in cost.items() if k != best)
        assert lang == best and abs(score - rest / (rest + cost[best])) < 1e-9
        assert abs(rate - longest_phrases(clean[best], plain) / len(plain)) < 1e-9


def test_toxicity_scores_against_plain_messages():
    random.seed(5)
    weights = {f"w:{w}": random.uniform(-3, 3) for w in ("river", "stone", "cloud", "foul", "bad")}
    model = toxicity.Crf(weights, -1.0, np.array([[0.0, -1.5], [-0.5, 1.0]]))
    for n in (1, 7, 600, 1300):
        words = random.choices(["river", "stone", "cloud", "foul", "bad", "other"], k=n)
        want = []
        for at in range(0, n, toxicity.RUN):
            e = [math.exp(-1.0 + weights.get(f"w:{w}", 0.0)) for w in words[at : at + toxicity.RUN]]
            w = np.exp(model.trans)
            fore, back = [np.array([1.0, e[0]])], [np.ones(2)]
            for x in e[1:]:
                f = (fore[-1] @ w) * [1.0, x]
                fore.append(f / f.sum())
            for x in reversed(e[1:]):
                b = w @ (back[0] * [1.0, x])
                back.insert(0, b / b.sum())
            want += [(f * b)[1] / (f * b).sum() for f, b in zip(fore, back)]
        p = model.marginals([words])[0]
        assert np.allclose(p, want)
        tops, sums = toxicity.summed([p])
        assert abs(tops[0] - max(want)) < 1e-9 and abs(sums[0] - sum(x for x in want if x >= 0.25)) < 1e-6


def brute_shards(data, shards=24, whole=0.02):
    """(id, size, crc, shard, slot) of each (id, text), from one sorted list."""
    keyed = []
    for i, t in data:
        raw = (t or "").encode()
        h = xxhash.xxh64_intdigest(raw, 42)
        keyed.append((zlib.crc32(raw), h - (1 << 64) if h >> 63 else h, i is None, i or 0, len(raw) + 8, i))
    keyed.sort(key=lambda k: k[:4])
    total, before, start, last, out, slots = sum(k[4] for k in keyed), 0, 0, None, [], Counter()
    for k in keyed:
        start = start if k[:2] == last else before
        last = k[:2]
        shard = max(start, before - int(whole * total / shards)) * shards // total
        out.append((k[5], k[4], k[0], shard, slots[shard]))
        slots[shard] += 1
        before += k[4]
    return out


def test_shards_against_one_sorted_list(spark):
    random.seed(13)
    texts = [*ODD, *[f"text {i} " * random.randint(0, 30) for i in range(700)], *["copies of one text"] * 400]
    docs = rows(spark, texts, [None if i % 97 == 0 else i for i in range(len(texts))]).withColumn("_shard", F.lit(9))
    got = [tuple(r) for r in sharding.assign(docs, keep=["doc_id", "_shard"]).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(brute_shards([(r["doc_id"], r["text"]) for r in docs.collect()]), key=key)


@pytest.mark.parametrize("order", ["random", "adverse"])
def test_components_of_long_paths_end(spark, order):
    ids = list(range(1500))
    random.Random(2).shuffle(ids) if order == "random" else None
    path = list(zip(ids, ids[1:])) + [(5000, 5001), (5001, 5001), (6000, 6000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert len({got[i] for i in ids}) == 1 and got[5000] == got[5001] != got[0] and set(got.values()) <= set(got)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_whose_names_clash_stay(spark):
    names = ["_cut", "_spans", "_items", "_n_words", "_kept", "_rows", "lang_pred", "letters", "_text", "_row", "_copy", "_id"]
    docs = rows(spark, ["the cat sat on the mat and looked", "a b c d e f g h i j k l m n o p q r s t u v w x y z"])
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    bench = spark.createDataFrame([(1, "c d e f g h i j k l")], "item_id long, text string")
    cut = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}
    assert cut[1]["text"] == "a b  m n o p q r s t u v w x y z" and all(cut[1][n] == n for n in names)
    assert simhash.keep_one(docs.union(docs)).count() == 2 and simhash.keep_one(docs).columns == docs.columns
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == 2
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and all(r["_row"] == "_row" for r in mixed.collect())


def test_nearest_against_brute_force_where_every_file_is_read(spark):
    rng = np.random.RandomState(4)
    data = [(i, [float(x) for x in rng.randn(8).round(2)]) for i in range(300)]
    data += [(1000 + i, data[0][1]) for i in range(200)] + [(2000, [1.0, 2.0]), (2001, []), (data[7][0], data[7][1]), (2050, data[3][1])]
    full = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(full, F.col("vec_id") % 50 == 0, pivots=16, post=2, probe=16, block=64, asks=2, rerank=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["ranked"] > 0
    usable = {i: np.array(v) for i, v in data if len(v) == 8}
    asked = [i for i in usable if i % 50 == 0]
    assert set(got) == set(asked)
    for q in asked:
        cos = {i: float((usable[q] * v).sum() / (np.sqrt((usable[q] ** 2).sum()) * np.sqrt((v * v).sum()))) for i, v in usable.items() if i != q}
        best = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        assert [i for i, _ in got[q]] == best and np.allclose([s for _, s in got[q]], [cos[i] for i in best])


def brute_cut(text, items):
    """The text without hit words, or None if most of its words are hit."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = list(word.finditer(low))
    words, hit = [m[0] for m in found], set()
    for wins, k in items:
        hit |= {p for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in wins for p in range(i, i + k)}
    if len(hit) > 0.5 * len(words):
        return None
    out, at = "", 0
    for i, m in enumerate(found):
        if i in hit:
            out += text[at : m.start()] if i - 1 not in hit else ""
            at = m.end()
    return out + text[at:]


def brute_copies(docs):
    """How often the mix takes each of (id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append(d)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size(d["text"]) for d in by[s]) for s in names}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} or {s: level * weight[s] for s in free}
        left -= sum(2.0 * total[s] for s in full)
        free = free - full if full else set()
    out = []
    for s in names:
        name = ("-" if s is None else "+" + s) + "|29"
        u = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32
        each = target[s] / total[s] if total[s] else 0.0
        for k, d in enumerate(sorted(by[s], key=lambda d: (size(d["text"]), d["doc_id"]))):
            out += [d] * (math.floor(u + each * (k + 1)) - math.floor(u + each * k))
    return out


def test_pipeline_against_plain_python(spark):
    docs = [r.asDict() for r in table(spark, "documents").collect()]
    model = langid.learn(table(spark, "documents").where(~corpus_pipeline.held_out(F.col("doc_id"))))
    langs, _, rates, letters = langid.judge(model, [d["text"] for d in docs])
    docs = [d | {"lang": d["lang"] or g} for d, g, r, n in zip(docs, langs, rates, letters) if g != "und" and not (r > 0.6 and n >= 40)]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ([x for x in d["text"].lower().split()] for d in docs)]
    fps = [simhash.fingerprint(d["text"]) for d in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d["doc_id"]), d["doc_id"])
    docs = [d for i, d in enumerate(docs) if least[find(i)] == d["doc_id"]]
    items = []
    for r in table(spark, "benchmark").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        if w:
            k = min(10, len(w))
            items.append(({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, k))
    docs = [d | {"text": t, "n_chars": len(t)} for d in docs if (t := brute_cut(d["text"], items)) is not None]
    taken = brute_copies(docs)
    shards = Counter((i, shard, slot) for i, _, _, shard, slot in brute_shards([(d["doc_id"], d["text"]) for d in taken]))
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got) == shards
    known = {d["doc_id"]: d for d in docs}
    for r in got:
        assert {c: r[c] for c in ("text", "lang", "source", "n_chars")} == {c: known[r["doc_id"]][c] for c in ("text", "lang", "source", "n_chars")}


def test_pipeline_of_no_documents(spark, tmp_path):
    table(spark, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_contamination_of_long_and_brute_texts(spark):
    item = "one two three four five six seven eight nine ten"
    text = f"{LONG} {item} {LONG}"
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    r = decontam.contamination(rows(spark, [text]), bench).select("_n_words", "_spans", "_items").first()
    n, hit, names = brute_hits(f"{item} x", [(5, item)])
    assert (hit, names) == (10, ["5"]) and sum(b - a for a, b in r["_spans"]) == 10 and r["_items"] == ["5"] and r["_n_words"] == 2 * len(LONG.split()) + 10
