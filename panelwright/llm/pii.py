"""Keyed surrogates for personal data, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, written

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа")
GIVEN = {
    ("m", "latin"): ("Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oscar", "Paul"),
    ("f", "latin"): ("Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helga", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Инна", "Мария", "Ольга"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "ga", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "ra", "re", "ro", "sa", "se", "ta", "te", "to", "va", "ve", "vo", "za"),
    "cyrillic": ("ба", "бо", "ва", "во", "га", "да", "до", "ка", "ко", "ла", "ло", "ма", "мо", "на", "но", "па", "ра", "ро", "са", "та", "то", "ха", "ша", "за"),
}

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: In this order: of two that begin at one place, the first is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"(?<=[=:\"']|[=:]\s|[=:]\s\s)(?<=\b(?i:password|passwd|pwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_\-]{8,}",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d\-])(?:\d{4}[ \-]?){3}\d{1,7}(?![\d\-])|(?<![\d\-])3\d{3}[ \-]?\d{6}[ \-]?\d{5}(?![\d\-])",
    "phone": r"(?<![\w+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "name": rf"(?<!\p{{L}})(?:{'|'.join((*MALE, *FEMALE))})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Types whose surrogates have the same length and signs in the same places, so that there are only so many.
FIXED = ("card", "phone", "ssn", "iban", "key")
#: A form of these that has more entities than its possible surrogates by this is crowded.
ROOM = 8


def may_match(text: Column) -> Column:
    """False only for texts without what every pattern needs: a cheap look before the patterns themselves."""
    titled = [text.contains(t + end) for t in (*MALE, *FEMALE) for end in (" ", ". ")]
    secret = (text.contains("=") | text.contains(":")) & text.rlike(r"(?i:password|passwd|pwd|secret|token|api_key|apikey)\s{0,2}[=:]")
    return reduce(lambda a, b: a | b, [text.rlike("[0-9]"), text.contains("@"), text.contains("AKIA"), *titled, secret])


def kind_of(found: Column) -> Column:
    """The type of a match, from how it looks."""
    return (
        F.when(found.contains("@"), "email")
        .when(found.rlike(r"^AKIA[0-9A-Z]{16}$"), "key")
        .when(found.rlike(rf"^{PATTERNS['ip'].replace('(?<![\\d.])', '').replace('(?!\\.?\\d)', '')}$"), "ip")
        .when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(found.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .when(found.rlike(r"^(?:\d{4}[ \-]?){3}\d{1,7}$|^3\d{3}[ \-]?\d{6}[ \-]?\d{5}$"), "card")
        .when(found.rlike(r"^\+\d|^\(\d{3}\)|^\d{3}[.\-]\d{3}[.\-]\d{4}$"), "phone")
        .when(found.rlike(rf"^(?:{'|'.join((*MALE, *FEMALE))})\.? \p{{Lu}}"), "name")
        .otherwise("secret")
    )


def name_words(found: Column) -> Column:
    """The words after the title."""
    return F.split(F.regexp_extract(found, r"^\S+ (.+)$", 1), " ")


def entities_of(found: Column, cut: Column | None = None) -> Column:
    """``type|entity`` strings of a match: what is written in other ways is one entity.

    E-mails count without case, numbers without separators; a name's last word is a
    surname and the word before it a given name of the title's gender. Of a name in ``cut`` (lower-cased words) the first word is a
    surname, and the second isn't part of it. A run of digits or an account number whose check
    digits are wrong is no entity.
    """
    kind = kind_of(found)
    gender = F.when(found.rlike(rf"^(?:{'|'.join(FEMALE)})\.? "), "f").otherwise("m")
    words = name_words(found)
    whole = F.lit(True) if cut is None else ~F.array_contains(cut, F.lower(F.array_join(words, " ")))
    last = F.when(whole, F.element_at(words, -1)).otherwise(F.element_at(words, 1))
    surname = F.concat(F.lit("surname|"), F.lower(last))
    given = F.concat(F.lit("given-"), gender, F.lit("|"), F.lower(F.element_at(words, 1)))
    plain = F.when(kind == "email", ascii_lower(found)).when(kind.isin("card", "phone", "ssn", "iban"), F.regexp_replace(found, "[^0-9A-Za-z]", "")).otherwise(found)
    none = F.array().cast("array<string>")
    return (
        F.when((kind == "card") & (luhn(plain, F.length(plain)) != 0), none)
        .when((kind == "iban") & (account_rest(plain) != 1), none)
        .when(kind != "name", F.array(F.concat(kind, F.lit("|"), plain)))
        .when((F.size(words) > 1) & whole, F.array(surname, given))
        .otherwise(F.array(surname))
    )


def surnames_before_words(matches: DataFrame) -> DataFrame:
    """``pair`` (lower-cased) of the names of two words whose first is a surname followed by another word that begins a sentence or is a noun.

    The corpus tells: the first word stands alone after a title somewhere, and the second never does; and the first is no
    known given name. ``matches`` has ``match``. Each distinct pair is looked at once.
    """
    names = matches.where(kind_of(F.col("match")) == "name").select(F.lower(F.array_join(name_words(F.col("match")), " ")).alias("pair")).distinct()
    alone = names.where(~F.col("pair").contains(" ")).select(F.col("pair").alias("alone"))
    known = sorted({w.lower() for some in GIVEN.values() for w in some})
    two = names.where(F.col("pair").contains(" ")).withColumn("_a", F.substring_index("pair", " ", 1)).withColumn("_b", F.substring_index("pair", " ", -1)).where(~F.col("_a").isin(*known))
    return two.join(alone, F.col("_a") == F.col("alone"), "left_semi").join(alone, F.col("_b") == F.col("alone"), "left_anti").select("pair")


def digest(key: str, entity: Column, attempt: Column) -> Column:
    return F.sha2(F.concat(F.lit(key + "|"), attempt.cast("string"), F.lit("|"), entity), 512)


def kept_in_front(kind: Column) -> Column:
    """Characters of the ``FIXED`` types that stay, or are check digits made anew."""
    return F.when(kind == "card", 1).when(kind == "phone", 2).when(kind.isin("iban", "key"), 4).otherwise(0)


def drawn_from(key: str, entities: DataFrame) -> DataFrame:
    """``entity, attempt`` with what their surrogates are made of.

    ``moved`` is the next one of the form after the open part of a ``FIXED`` type, or after an e-mail's domain without its ending.
    """
    rows = entities.select("entity", "attempt", F.substring_index("entity", "|", 1).alias("kind"), F.expr("substr(entity, instr(entity, '|') + 1)").alias("text"))
    kind, text = F.col("kind"), F.col("text")
    domain = F.substring_index(text, "@", -1)
    ending = F.substring_index(domain, ".", -1)
    kept = kept_in_front(kind)
    size = F.length(text) - kept - F.when(kind == "card", 1).otherwise(0)
    mail = kind == "email"
    open_ = F.when(mail, F.substr(domain, F.lit(1), F.length(domain) - F.length(ending) - 1)).when(kind.isin(*FIXED), F.substr(text, kept + 1, size))
    # A domain is replaced alike in all of its addresses, whatever their attempt.
    front = F.when(mail, F.concat(F.lit("domain|"), ending)).otherwise(F.concat_ws("|", kind, F.col("attempt").cast("string"), F.substr(text, F.lit(1), kept)))
    rows = rows.withColumns({"stream": digest(key, F.col("entity"), F.col("attempt")), "domain": domain, "_open": open_, "_front": front})
    return rows.withColumn("moved", F.when(F.col("_open").isNotNull(), moved_on(key, F.col("_open"), F.col("_front")))).drop("_open", "_front")


def drawn(stream: Column, i: Column) -> Column:
    """The i-th number (from 0) of a digest, 0 to 65535, used again after 31."""
    return F.conv(F.substr(stream, (i % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def pick(letters: str, h: Column) -> Column:
    return F.substr(F.lit(letters), h % len(letters) + 1, F.lit(1))


def like(stream: Column, text: Column, skip: Column | int = 0, hexed: Column | bool = False) -> Column:
    """Digits for digits and letters for letters, in the same case; ``skip`` characters in front stay."""

    def one(i: Column) -> Column:
        c, h = F.substr(text, i, F.lit(1)), drawn(stream, i - 1)
        h = h + F.conv(F.substr(stream, F.lit(125), F.lit(2)), 16, 10).cast("int") * ((i - 1) / F.lit(31)).cast("int")
        return (
            F.when(i <= skip, c)
            .when(c.between("0", "9"), pick("0123456789", h))
            .when(c.between("a", "z"), F.when(F.lit(hexed) if isinstance(hexed, bool) else hexed, pick("abcdef", h)).otherwise(pick(LOWER, h)))
            .when(c.between("A", "Z"), pick(UPPER, h))
            .otherwise(c)
        )

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise("")


def turned(text: Column, stream: Column, sign: int) -> Column:
    """Each digit and letter moved on (or back) among its like by the numbers of a digest; other characters stay."""

    def one(i: Column) -> Column:
        c, h = F.substr(text, i, F.lit(1)), drawn(stream, i - 1) * sign
        move = lambda letters: F.substr(F.lit(letters), F.pmod(F.instr(F.lit(letters), c) - 1 + h, F.lit(len(letters))) + 1, F.lit(1))
        return F.when(c.between("0", "9"), move("0123456789")).when(c.between("a", "z"), move(LOWER)).when(c.between("A", "Z"), move(UPPER)).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise("")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def moved_on(key: str, text: Column, tweak: Column) -> Column:
    """The next one after ``text`` in a keyed order of all texts with digits and letters in the same places.

    A Feistel network gives the order: in each round one half is moved by a digest of the other, so two texts never have one successor, none is
    its own, and there is no search, however many are in use. ``tweak`` gives other orders.
    """
    stream = lambda k, half: F.sha2(F.concat_ws("|", F.lit(key), tweak, k.cast("string"), half), 512)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    there = lambda at, k: pair(at["b"], turned(at["a"], stream(k, at["b"]), 1))
    back = lambda at, k: pair(turned(at["b"], stream(k, at["a"]), -1), at["a"])
    half = F.floor(F.length(text) / 2).cast("int")
    first = pair(F.substr(text, F.lit(1), half), F.substr(text, half + 1, F.length(text)))
    next_ = lambda t: F.concat(F.substr(t, F.lit(1), F.length(t) - 1), turned(F.substr(t, F.length(t), F.lit(1)), F.lit("0001"), 1))
    size = F.length(text) - half

    def end(at: Column) -> Column:
        # After an even number of rounds the halves are where they were.
        return once(pair(at["a"], next_(at["b"])), lambda x: F.aggregate(F.sequence(F.lit(3), F.lit(0), F.lit(-1)), x, back))

    found = once(F.aggregate(F.sequence(F.lit(0), F.lit(3)), first, there), end)
    return F.when(size > 0, once(found, lambda x: F.concat(x["a"], x["b"]))).otherwise(text)


def luhn(digits: Column, n: Column) -> Column:
    """The Luhn sum modulo 10 of ``n`` digits, the last of which counts once."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def account_rest(text: Column) -> Column:
    """An account number modulo 97, its first four characters moved to the end and letters counted from 10: 1 if its check digits are right."""
    turned = F.concat(F.substr(text, F.lit(5), F.length(text)), F.substr(text, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        c = F.substr(turned, i, F.lit(1))
        digit = c.between("0", "9")
        return F.when(digit, acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def from_list(words: tuple[str, ...], h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), h % len(words) + 1)


def surrogate() -> Column:
    """The replacement, from the columns of ``drawn_from``: of the same type and form, another one for each attempt.

    Later attempts lengthen names, e-mail addresses and secrets, so that short ones don't run out. The types in ``FIXED`` have the next one in a keyed order
    of their form, so that two of them never have one surrogate at the same attempt.

    A card number keeps its first digit and its Luhn remainder, a phone number its first two digits,
    an account number keeps its country and has right check digits, a key keeps its prefix, a hexadecimal secret stays so,
    an e-mail's domain keeps its ending and is replaced as one, by one that no other domain has. Names keep gender and script.
    """
    kind, text, stream, domain, attempt = (F.col(c) for c in ("kind", "text", "stream", "domain", "attempt"))
    n = F.length(text)
    h = [drawn(stream, F.lit(i)) for i in range(8)]

    moved = F.col("moved")
    ending = F.substring_index(domain, ".", -1)
    longer = F.substr(stream, F.lit(65), F.greatest(attempt - 3, F.lit(0)))
    email = F.concat(like(stream, F.substring_index(text, "@", 1)), longer, F.lit("@"), moved, F.lit("."), ending)

    body = F.concat(F.substr(text, F.lit(1), F.lit(1)), moved, F.lit("0"))
    card = F.concat(F.substr(body, F.lit(1), n - 1), ((luhn(text, n) - luhn(body, n) + 10) % 10).cast("string"))

    inside = moved
    country = F.substr(text, F.lit(1), F.lit(2))
    iban = F.concat(country, F.lpad((98 - account_rest(F.concat(country, F.lit("00"), inside))).cast("string"), 2, "0"), inside)

    script = F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    by_script = lambda make: F.when(script == "cyrillic", make("cyrillic")).otherwise(make("latin"))
    syllables = lambda s, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: from_list(SYLLABLES[s], drawn(stream, i - 1))), "")
    more = F.least(attempt, F.lit(20))
    surname = by_script(lambda s: F.initcap(syllables(s, more + 4)))
    given = lambda g: by_script(
        lambda s: F.concat(from_list(GIVEN[g, s], h[0]), F.when(more > 0, F.concat(F.lit("-"), F.initcap(syllables(s, more + 2)))).otherwise(""))
    )
    return (
        F.when(kind == "email", email)
        .when(kind == "card", card)
        .when(kind == "ssn", moved)
        .when(kind == "phone", F.concat(F.substr(text, F.lit(1), F.lit(2)), moved))
        .when(kind == "key", F.concat(F.substr(text, F.lit(1), F.lit(4)), moved))
        .when(kind == "iban", iban)
        .when(kind == "surname", surname)
        .when(kind == "given-m", given("m"))
        .when(kind == "given-f", given("f"))
        .otherwise(F.concat(like(stream, text, 0, text.rlike("^[0-9a-f]+$")), longer))
    )


def dressed(found: Column, plain: Column) -> Column:
    """``plain`` with the separators and the case of ``found``."""
    marks = F.regexp_replace(plain, "[^0-9A-Za-z]", "")

    def step(acc: Column, i: Column) -> Column:
        c, new = F.substr(found, i, F.lit(1)), F.substr(marks, acc["k"] + 1, F.lit(1))
        takes = c.rlike("[0-9A-Za-z]")
        return F.struct(
            F.concat(acc["out"], F.when(~takes, c).when(c.between("A", "Z"), F.upper(new)).otherwise(new)).alias("out"),
            (acc["k"] + F.when(takes, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(found)), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]


#: First octets of addresses that are neither private nor special, nor begin a private range.
PUBLIC = tuple(str(o) for o in range(1, 224) if o not in (10, 127, 169, 172, 192))


def address(key: str, text: Column) -> Column:
    """The surrogate of an address: the next one in a keyed order of its range, so that addresses keep apart however many there are.

    10/8, 127/8, 172.16/12, 192.168/16 and 169.254/16 stay within themselves. Of the rest of 169/8, 172/8 and 192/8 the first two octets stay, of
    0/8 and 224/3 the first. All others are one range of their first octets and the other three.
    The order is a Feistel network over what the range leaves open. A surrogate may be an address that the corpus has as well.
    """
    octets = F.transform(F.split(text, r"\."), lambda o: o.cast("int"))

    def found(o: Column) -> Column:
        twelve = (o[0] == 172) & o[1].between(16, 31)
        bits = F.when(twelve, 20).when(o[0].isin(169, 172, 192), 16).otherwise(24)
        range_ = F.when(twelve, F.lit("172.16")).when(o[0].isin(169, 172, 192), F.concat_ws(".", o[0].cast("string"), o[1].cast("string")))
        range_ = range_.when(o[0].isin(*map(int, PUBLIC)), F.lit("public")).otherwise(o[0].cast("string"))
        number = F.when(bits == 20, ((o[1] - 16) * 256 + o[2]) * 256 + o[3]).when(bits == 16, o[2] * 256 + o[3]).otherwise((o[1] * 256 + o[2]) * 256 + o[3])
        size = F.when(bits == 20, 1024).when(bits == 16, 256).otherwise(4096)
        return once(F.struct(o.alias("o"), bits.alias("bits"), range_.alias("range"), number.alias("n"), size.alias("size")), moved)

    def moved(x: Column) -> Column:
        size = x["size"]

        def mark(number: Column, half: Column) -> Column:
            text = F.concat_ws("|", F.lit(key), x["range"], number.cast("string"), half.cast("string"))
            return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(4)), 16, 10).cast("int") % size

        pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
        there = lambda at, k: pair(at["b"], at["a"].bitwiseXOR(mark(k, at["b"])))
        back = lambda at, k: pair(at["b"].bitwiseXOR(mark(k, at["a"])), at["a"])
        halves = lambda n: pair(n / size, n % size)
        after = once(F.aggregate(F.sequence(F.lit(0), F.lit(3)), halves(x["n"]), there), lambda at: (at["a"] * size + at["b"] + 1) % (size * size))
        new = once(once(after, lambda n: F.aggregate(F.sequence(F.lit(3), F.lit(0), F.lit(-1)), halves(n), back)), lambda at: at["a"] * size + at["b"])
        return once(new, lambda n: shown(x, n))

    def shown(x: Column, n: Column) -> Column:
        octet = lambda i: (F.shiftright(n, 8 * i) % 256).cast("string")
        o, places = x["o"], F.array(*[F.lit(p) for p in PUBLIC])
        turn = F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("first"), n.cast("string")), 256), F.lit(1), F.lit(4)), 16, 10).cast("int")
        first = F.when(x["range"] == "public", F.get(places, F.pmod(F.array_position(places, o[0].cast("string")).cast("int") - 1 + turn, F.lit(len(PUBLIC))))).otherwise(o[0].cast("string"))
        second = F.when(x["bits"] == 16, o[1].cast("string")).when(x["bits"] == 20, (F.shiftright(n, 16) + 16).cast("string")).otherwise(octet(2))
        return F.concat_ws(".", first, second, octet(1), octet(0))

    return once(octets, found)


def crowded(entities: DataFrame) -> DataFrame:
    """``entity`` of the ``FIXED`` types whose form has more than one entity for ``ROOM`` possible surrogates."""
    kind, text = F.substring_index("entity", "|", 1), F.expr("substr(entity, instr(entity, '|') + 1)")
    kept = kept_in_front(kind)
    mask = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    open_ = F.substr(mask, kept + 1, F.length(mask) - kept - F.when(kind == "card", 1).otherwise(0))
    start = F.when(kind == "iban", F.substr(text, F.lit(1), F.lit(2))).otherwise(F.substr(text, F.lit(1), kept))
    places = F.exp(F.length(F.regexp_replace(open_, "[^0]", "")) * F.log(F.lit(10.0)) + F.length(F.regexp_replace(open_, "[^aA]", "")) * F.log(F.lit(26.0)))
    forms = entities.where(kind.isin(*FIXED)).select("entity", F.concat_ws("|", kind, start, open_).alias("form"), places.alias("places"))
    full = forms.groupBy("form").agg(F.count("*").alias("n"), F.first("places").alias("places")).where(F.col("n") * ROOM > F.col("places")).select("form")
    return forms.join(full, "form", "left_semi").select("entity")


def surrogates(key: str, entities: DataFrame) -> DataFrame:
    """``entity, made`` with a surrogate of its own for each of the corpus's entities.

    An entity goes on to its next attempt if its surrogate belongs to another entity already, by an earlier attempt
    or as the first by name, or is itself one of the corpus's entities of its type. Only entities that are still open are tried again.
    Addresses (``address``) and entities of crowded forms need no attempts and no such check: an order of all of their form gives each its own. In other
    forms at most a quarter of the possible surrogates is ever in use, and names, e-mails and secrets grow longer, so each attempt
    settles most of what is open, and the rounds grow with the logarithm of the entities.
    """
    kind = F.substring_index("entity", "|", 1)
    full = written(crowded(entities))
    made = drawn_from(key, full.withColumn("attempt", F.lit(0))).select("entity", surrogate().alias("made"))
    done = [entities.where(kind == "ip").select("entity", address(key, F.substring_index("entity", "|", -1)).alias("made"), F.lit(None).cast("string").alias("form"))]
    done.append(made.withColumn("form", F.lit(None).cast("string")))
    open_ = entities.where(kind != "ip").join(full, "entity", "left_anti").withColumn("attempt", F.lit(0))
    while True:
        lowered = F.when(F.col("kind").isin("surname", "given-m", "given-f"), F.lower("made")).otherwise(F.col("made"))
        made = drawn_from(key, open_).withColumn("made", surrogate())
        made = written(made.select("entity", "attempt", "made", F.concat("kind", F.lit("|"), lowered).alias("form")))
        taken = [d.select(F.col("form").alias("taken")) for d in done[2:]] + [entities.select(F.col("entity").alias("taken"))]
        free = made.groupBy("form").agg(F.min("entity").alias("owner"))
        for forms in taken:
            free = free.join(forms, F.col("form") == F.col("taken"), "left_anti")
        done.append(written(made.join(free, "form").where("entity = owner").select("entity", "made", "form")))
        open_ = written(made.join(done[-1].select(F.col("entity").alias("settled")), F.col("entity") == F.col("settled"), "left_anti").select("entity", (F.col("attempt") + 1).alias("attempt")))
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done).select("entity", "made")


def replace_pii(docs: DataFrame, key: str, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with ``_text`` and ``_found`` (the number of matches).

    Every match of ``PATTERNS`` gives way to a surrogate that depends on the key, on the entity and, where surrogates
    clash, on the corpus; one entity has one surrogate in all documents and in all its spellings. Surrogates are
    checked against each other and against the entities of the whole corpus (``surrogates``). Texts are searched once: the
    table is written to the shared folder with what was found. Only rows with a match are shuffled: their distinct
    entities are joined to their surrogates, gathered by row and put in place. Null texts
    stay null; texts without a match stay as they are, very long ones are read whole; repeated rows are changed alike; an empty
    table gives an empty one. A kept column with a result's name gives way to the result.
    """
    keep = [c for c in keep if c.lower() not in ("_text", "_found")]
    rows = docs.select(*[F.col(c).alias(f"_in_{c}") for c in keep], F.col(text_col).alias("_text"))
    none = F.array().cast("array<string>")
    found = F.when(may_match(F.col("_text")), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0)))
    rows = written(rows.withColumn("_m", F.coalesce(found, none)).withColumn("_row", F.monotonically_increasing_id()))
    hit = rows.where(F.size("_m") > 0)
    # Names of two words whose second isn't part of them, by row.
    named = hit.select("_row", F.explode("_m").alias("match")).where(kind_of(F.col("match")) == "name")
    cuts = written(surnames_before_words(named))
    of_row = named.select("_row", F.lower(F.array_join(name_words(F.col("match")), " ")).alias("pair")).distinct().join(cuts, "pair").groupBy(F.col("_row").alias("_cut_row")).agg(F.collect_set("pair").alias("_cut"))
    marked = hit.join(of_row, F.col("_row") == F.col("_cut_row"), "left").drop("_cut_row").withColumn("_cut", F.coalesce("_cut", none))
    marked = marked.withColumn("_e", F.transform("_m", lambda m: entities_of(m, F.col("_cut")))).withColumn("_n", F.size(F.filter("_e", lambda e: F.size(e) > 0)))

    own = marked.select("_row", F.explode(F.array_distinct(F.flatten("_e"))).alias("entity"))
    made = surrogates(key, written(own.select("entity").distinct()))
    pairs = own.join(made, "entity").groupBy(F.col("_row").alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct("entity", "made"))).alias("_made"))
    found = marked.where("_n > 0").join(pairs, F.col("_row") == F.col("_of"))

    def placed(match: Column, ids: Column) -> Column:
        kind = F.substring_index(F.get(ids, 0), "|", 1)
        first, title = F.element_at("_made", F.get(ids, 0)), F.regexp_extract(match, r"^(\S+ )", 1)
        given = F.when(F.size(ids) > 1, F.concat(F.element_at("_made", F.try_element_at(ids, F.lit(-1))), F.lit(" "))).otherwise("")
        rest = F.when((F.size(ids) == 1) & (F.size(name_words(match)) > 1), F.concat(F.lit(" "), F.element_at(name_words(match), -1))).otherwise("")
        alike = kind.isin("email", "card", "phone", "ssn", "iban") & ((kind != "email") | (F.length(first) == F.length(match)))
        return F.when(F.size(ids) == 0, match).when(kind == "surname", F.concat(title, given, first, rest)).when(alike, dressed(match, first)).otherwise(first)

    parts = F.split("_text", ANY, -1)
    found = found.withColumn("_new", F.zip_with("_m", "_e", placed))
    text = F.array_join(F.zip_with(parts, F.col("_new"), lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    names = [F.col(f"_in_{c}").alias(c) for c in keep]
    changed = found.select(*names, text.alias("_text"), F.col("_n").alias("_found"))
    same = rows.where(F.size("_m") == 0).unionByName(marked.where("_n = 0").select(*rows.columns))
    return same.select(*names, "_text", F.lit(0).alias("_found")).unionByName(changed)
