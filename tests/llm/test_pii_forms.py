"""Surrogates of whole forms, of ranges of addresses, and of names by the corpus's evidence."""

import ipaddress
import random
import re

from pyspark.sql import functions as F

from panelwright.llm import pii
from test_llm import rows


def made_for(spark, entities):
    return {r["entity"]: r["made"] for r in pii.surrogates("k", spark.createDataFrame([(e,) for e in entities], "entity string")).collect()}


def test_names_end_where_the_corpus_says(spark):
    texts = ["Mr. Jones Monday left. Mr. Jones left", "Mr. Adam Jones came with Mrs. Jones", "Frau Weber Heute kam. Frau Weber ging.", "Mr. Paul Smith spoke. Mr. Smith agreed.", "Mr. Kent Brown and Mr. Kent and Mr. Brown", "Mr. Anna Petrov and Mr. Anna"]
    got = {r["doc_id"]: r["_text"] for r in pii.replace_pii(rows(spark, texts), "k", keep=["doc_id"]).collect()}
    found = re.fullmatch(r"Mr\. (\w+) Monday left\. Mr\. (\w+) left", got[0])
    assert found and found[1] == found[2] != "Jones"
    assert re.fullmatch(rf"Mr\. \w+ {found[1]} came with Mrs\. {found[1]}", got[1])
    found = re.fullmatch(r"Frau (\w+) Heute kam\. Frau (\w+) ging\.", got[2])
    assert found and found[1] == found[2] != "Weber"
    found = re.fullmatch(r"Mr\. \w+ (\w+) spoke\. Mr\. (\w+) agreed\.", got[3])
    assert found and found[1] == found[2] != "Smith"
    # Both words stand alone somewhere: the last one is the surname, and a given name from the lists stays one.
    assert re.fullmatch(r"Mr\. [\w-]+ (\w+) and Mr\. \w+ and Mr\. \1", got[4])
    assert re.fullmatch(r"Mr\. [\w-]+ \w+ and Mr\. \w+", got[5]) and "Petrov" not in got[5]


def test_every_number_of_a_full_form_gets_one_of_its_own(spark):
    made = made_for(spark, [f"phone|55{i:05}" for i in range(100_000)])
    assert len(set(made.values())) == 100_000 and all(m[:2] == "55" and len(m) == 7 and m != e[6:] for e, m in made.items())
    entities = {f"phone|44{i:04}" for i in random.Random(1).sample(range(10_000), 2000)} | {f"card|4{i:03}{c}" for i in range(400) for c in [-sum((d * 2 - 9 * (d > 4)) if k % 2 else d for k, d in enumerate(map(int, reversed(f"4{i:03}0")))) % 10]}
    made = made_for(spark, entities)
    assert len({(e[:4], m) for e, m in made.items()}) == len(entities)
    assert all(sum((d * 2 - 9 * (d > 4)) if k % 2 else d for k, d in enumerate(map(int, reversed(m)))) % 10 == 0 and m[0] == "4" for e, m in made.items() if e.startswith("card"))


def test_roomy_forms_avoid_the_corpus(spark):
    random.seed(2)
    entities = {f"ssn|{random.randrange(10**9):09}" for _ in range(3000)} | {f"key|AKIA{''.join(random.choices('ABCDEF0123456789', k=16))}" for _ in range(500)} | {f"phone|2125{random.randrange(10**6):06}" for _ in range(3000)}
    made = made_for(spark, entities)
    assert set(made) == entities and len(set(made.values())) == len(entities)
    assert not {f"{e.split('|')[0]}|{m}" for e, m in made.items()} & entities
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t))
    assert all(shape(e.split("|")[1]) == shape(m) for e, m in made.items())


def test_addresses_stay_in_their_ranges_and_apart(spark):
    random.seed(3)
    pick = lambda net, n: {str(net[random.randrange(net.num_addresses)]) for _ in range(n)}
    ranges = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")]
    have = {net: pick(net, 1500) for net in ranges}
    made = made_for(spark, [f"ip|{a}" for some in have.values() for a in some])
    for net, some in have.items():
        mine = {a: made[f"ip|{a}"] for a in some}
        assert all(ipaddress.ip_address(m) in net and m != a for a, m in mine.items()) and len(set(mine.values())) == len(some)
    public = {str(ipaddress.ip_address(random.randrange(1 << 24, 223 << 24))) for _ in range(3000)} | {"172.15.0.1", "172.32.0.1", "169.253.1.1", "192.167.3.4", "8.8.8.8"}
    public = {a for a in public if not any(ipaddress.ip_address(a) in n for n in ranges)}
    made = made_for(spark, [f"ip|{a}" for a in public])
    assert len(set(made.values())) == len(public) and not any(ipaddress.ip_address(m) in n for m in made.values() for n in ranges)
    assert all(0 < int(m.split(".")[0]) < 224 for m in made.values())


def test_domains_keep_apart(spark):
    domains = [f"{a}{b}.{c}x.org" for a in "abcdefgh" for b in "ij" for c in "klm"]
    made = made_for(spark, [f"email|{u}@{d}" for d in domains for u in ("u", "v")])
    of = {}
    for e, m in made.items():
        of.setdefault(e.split("@")[1], set()).add(m.split("@")[1])
    assert all(len(x) == 1 for x in of.values()) and len({min(x) for x in of.values()}) == len(domains) and not {min(x) for x in of.values()} & {d for d in domains if min(of[d]) == d}


def luhn_ok(digits):
    return sum((d * 2 - 9 * (d > 4)) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def account_ok(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def test_whole_texts_against_plain_rules(spark):
    """Each entity found by plain patterns of this test has one surrogate of its own kind everywhere, and what is around stays."""
    random.seed(4)
    fill = ["on the river", "and then", "we said", "12 apples", "version 1.2", "it cost 4.50"]

    def card():
        body = "4" + "".join(random.choices("0123456789", k=14))
        return next(body + c for c in "0123456789" if luhn_ok(body + c))

    def account():
        inside = "".join(random.choices("0123456789", k=18))
        return next(f"DE{c:02}{inside}" for c in range(100) if account_ok(f"DE{c:02}{inside}"))

    cards, accounts = [card() for _ in range(6)], [account() for _ in range(6)]
    phones = [f"+1 212 555 {random.randrange(10**4):04}" for _ in range(6)]
    names, mails = ["Stone", "Rivers", "Field", "Woods"], [f"{u}@mail{k}.com" for u in ("ann", "bob") for k in range(3)]
    forms = {
        "card": (cards, [lambda c: c, lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4)), lambda c: "-".join(c[i : i + 4] for i in range(0, 16, 4))]),
        "iban": (accounts, [lambda a: a, lambda a: " ".join(a[i : i + 4] for i in range(0, 22, 4))]),
        "phone": (phones, [lambda p: p, lambda p: p.replace(" ", "-"), lambda p: p.replace(" ", ".")]),
        "name": (names, [lambda n: f"Mr. {n}", lambda n: f"Mr {n}"]),
        "email": (mails, [lambda m: m, lambda m: m.upper()]),
    }
    plan = [[(random.choice(fill), kind, entity, random.choice(forms[kind][1])(entity)) for _ in range(5) for kind in [random.choice(list(forms))] for entity in [random.choice(forms[kind][0])]] for _ in range(60)]
    texts = [" ; ".join(f"{f} ; {w}" for f, _, _, w in p) + " ." for p in plan]
    got = {r["doc_id"]: (r["_text"], r["_found"]) for r in pii.replace_pii(rows(spark, texts), "k", keep=["doc_id"]).collect()}
    seen = {}
    bare = lambda kind, w: w.lower() if kind == "email" else w.split(" ")[-1] if kind == "name" else re.sub("[^0-9A-Za-z]", "", w)
    for i, p in enumerate(plan):
        parts = got[i][0][:-2].split(" ; ")
        assert parts[::2] == [f for f, _, _, _ in p] and got[i][1] == 5
        for new, (_, kind, entity, written) in zip(parts[1::2], p):
            seen.setdefault((kind, entity), set()).add(bare(kind, new))
            assert re.sub("[0-9A-Za-z]", "", new) == re.sub("[0-9A-Za-z]", "", written) or kind in ("name", "email")
    assert all(len(v) == 1 for v in seen.values())
    made = {k: min(v) for k, v in seen.items()}
    assert len({(k[0], m) for k, m in made.items()}) == len(made) and not any(m == bare(k[0], forms[k[0]][1][0](k[1])) for k, m in made.items())
    assert all(luhn_ok(m) for k, m in made.items() if k[0] == "card") and all(account_ok(m) and m[:2] == "DE" for k, m in made.items() if k[0] == "iban")
    again = pii.replace_pii(rows(spark, texts).withColumn("text", F.concat("text", F.lit("x"))), "k", keep=["doc_id"]).where("doc_id = 3").first()
    assert again["_text"] == got[3][0] + "x"
