"""Rated statements in articles: finding them, judging them, one observation an article."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cues and patterns of the rating vocabulary.
ARTICLE_MARKER = "指数估值数据"
GLOBAL_MARKER = "美股指数估值数据"
CURRENT_CUES = ("截止到收盘", "截至收盘", "截止收盘", "今天大盘", "今日大盘", "今天市场", "今日市场", "目前", "当前", "今天回到", "今日回到", "又回到", "回到")
HISTORICAL_CUES = ("当时", "比如", "例如", "历史", "此前", "之前", "曾经", "过去", "熊市",
    "2024年", "2023年", "2022年", "2021年", "2020年", "2019年", "2018年", "2017年", "2016年", "2015年", "2014年", "2013年", "2012年")
BOILERPLATE_CUES = ("1星为泡沫阶段", "5星为投资价值最高阶段", "不同星级代表的含义", "5星级-5.9星级", "4星级-4.9星级", "3星级-3.9星级")
NONCURRENT_CUES = (
    "上周", "上个月", "昨天", "昨日", "前天", "此前", "之前", "当时", "曾经", "历史", "最低点", "最高点", "距离", "还没有出现", "没有出现", "如果",
    "假如", "假设", "才能", "才回到", "才会回到", "收盘基础上", "没到", "没有到", "未到", "未回到", "没有彻底回到", "出现过", "两次", "最低", "最高",
)
INTRADAY_CUES = ("中午收盘", "午间收盘", "上午收盘", "盘中", "一度")
CHINESE = {"一": 1.0, "二": 2.0, "三": 3.0, "四": 4.0, "五": 5.0, "六": 6.0}
BODY_PATTERNS = {
    "arabic_half": r"(?<!\d)([1-5])\s*星半",
    "arabic": r"(?<![\d.])([1-6](?:\.\d)?)\s*星(?!半)(?:级)?",
    "chinese_half": r"([一二三四五])\s*星半",
    "chinese": r"([一二三四五六])\s*星(?!半)(?:级)?",
}
TITLE_PATTERN = {"compact_title": r"(?<!\d)([1-5]\d)\s*星(?:级)?"}
RANGE = r"(?:[1-6](?:\.\d)?|[一二三四五六])\s*星(?:级)?\s*[-–—~～至到]\s*(?:[1-6](?:\.\d)?|[一二三四五六])"
PRECISE = r"(?<![\d.\-–—~～至])(?<!\d到)[1-5](?:\.\d)?(?!\s*[-–—~～至到])\s*星(?:级)?"
CLOSING = r"(?:截止到(?:下午)?收盘|截至(?:下午)?收盘|截止(?:下午)?收盘|到(?:下午)?收盘(?:的时候)?|(?:下午)?收盘(?:时|后)?)"
REALTIME_PATTERNS = (
    ("closing_statement", CLOSING + r"[^。！？\n]{0,120}?(?:回到|回到了|降到|升到)\s*" + PRECISE, 1.0),
    ("closing_statement", CLOSING + r"[^。！？\n]{0,120}?" + PRECISE, 1.0),
    ("fine_current_statement", r"(?:如果细一些计算[,，]?\s*)?(?:目前|当前)[^。！？\n]{0,30}?(?:算是|精确(?:是|为)?|约为|大约是)\s*[1-5]\.\d(?:\s*星(?:级)?)?", 0.998),
    ("today_market_statement", r"(?:今天|今日)(?:大盘|A股|市场)[^。！？\n]{0,140}?" + PRECISE, 0.995),
    ("current_state_statement", r"(?:目前|当前)(?:还是|仍然|仍|依然)?(?:在|处于)\s*" + PRECISE, 0.992),
    ("opening_state_statement", r"(?:还在|回到|回到了|重回|达到|涨到|上涨到|摸到|摸到了)\s*" + PRECISE, 0.99),
)
#: Words of which a text needs one for a pattern to match.
NEEDED = {
    "closing_statement": ("收盘",),
    "fine_current_statement": ("目前", "当前"),
    "today_market_statement": ("今天", "今日"),
    "current_state_statement": ("目前", "当前"),
    "opening_state_statement": ("还在", "回到", "达到", "涨到", "摸到"),
}
APPROX_RANGE = r"([1-5](?:\.\d)?)\s*[-–—~～至到]\s*([1-5](?:\.\d)?)\s*星(?:级)?"
NEAR_THRESHOLD = r"距离\s*([1-5](?:\.\d)?)\s*星(?:级)?\s*很接近"
MARKET_CLOSED = r"A股没有交易[^。！？\n]{0,60}"
DATED = r"目前\s*(\d{4})年(\d{1,2})月(\d{1,2})日[^。！？\n]{0,80}?市场在\s*" + PRECISE


@dataclass(frozen=True)
class Vocabulary:
    """What makes an article a daily one, and which phrases raise a generic statement's confidence."""

    marker: str = ARTICLE_MARKER
    global_marker: str = GLOBAL_MARKER
    generic_cues: tuple[str, ...] = ("今天几星",)
    opening: int = 3000
    context: int = 140


def any_of(text: Column, cues: tuple[str, ...]) -> Column:
    return text.rlike("|".join(c.replace(".", r"\.") for c in cues))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used: a lambda's argument isn't copied by the optimizer."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str) -> Column:
    """All matches as (start, found), start counted from 0: the lengths of what stands between them add up to it."""
    pattern = f"(?U){pattern}"
    empty = F.array().cast("array<struct<start:int,found:string>>")

    def step(acc: Column, one: Column) -> Column:
        start = acc["at"] + F.length(one["between"])
        return F.struct((start + F.length(one["found"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), one["found"].alias("found")))).alias("out"))

    def walked(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda f, b: F.struct(f.alias("found"), b.alias("between")))
        return F.when(F.size(found) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]).otherwise(empty)

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walked)


def star_value(pattern: str, found: Column) -> Column:
    body = (BODY_PATTERNS | TITLE_PATTERN)[pattern]
    group = F.regexp_extract(found, body.replace(r"(?<!\d)", "").replace(r"(?<![\d.])", "").replace("(?!半)", ""), 1)
    numeral = F.element_at(F.create_map(*[F.lit(x) for k, v in CHINESE.items() for x in (k, v)]), group)
    if pattern == "compact_title":
        return F.try_divide(group.try_cast("double"), F.lit(10.0))
    return (numeral if pattern.startswith("chinese") else group.try_cast("double")) + (0.5 if pattern.endswith("half") else 0.0)


def relation(title: Column, context: Column, in_title: Column, vocabulary: Vocabulary) -> Column:
    titled = in_title & title.contains(vocabulary.marker) & title.contains("回到")
    return (
        F.when(any_of(F.concat_ws(" ", title, context), BOILERPLATE_CUES) | context.rlike(f"(?U){RANGE}"), "range_or_rule")
        .when(titled, "realtime")
        .when(any_of(context, HISTORICAL_CUES), "historical")
        .when(any_of(context, CURRENT_CUES), "realtime")
        .otherwise("generic")
    )


def confidence(title: Column, context: Column, in_title: Column, kind: Column, vocabulary: Vocabulary) -> Column:
    titled = in_title & title.contains(vocabulary.marker) & title.contains("回到")
    joined = F.concat_ws(" ", title, context)
    return (
        F.when(kind == "range_or_rule", 0.20)
        .when(kind == "historical", 0.55)
        .when((kind == "realtime") & titled, 0.99)
        .when((kind == "realtime") & any_of(context, ("截止到收盘", "截至收盘", "截止收盘")), 0.995)
        .when((kind == "realtime") & any_of(context, ("今天大盘", "今日大盘")), 0.99)
        .when((kind == "realtime") & any_of(context, ("目前", "当前")), 0.96)
        .when(kind == "realtime", 0.93)
        .when(any_of(joined, vocabulary.generic_cues), 0.82)
        .when(title.contains(vocabulary.marker), 0.72)
        .when(joined.contains("星级"), 0.62)
        .otherwise(0.45)
    )


def candidates(articles: DataFrame, vocabulary: Vocabulary = Vocabulary(), *, least: float = 1.0, most: float = 6.0) -> DataFrame:
    """Every rating mention in titles and texts of ``article_id, publish_date, title, text``, with relation and confidence.

    If the articles say which of them are canonical (``is_canonical`` or ``duplicate_of``), others are left out. One scan: the mentions of
    an article are an array until its repetitions are gone. ``ranked`` puts the table in its order.
    """
    if known := [c for c in ("is_canonical", "duplicate_of") if c in articles.columns]:
        articles = articles.where(is_canonical(*[F.col(c) if c in known else F.lit(None) for c in ("is_canonical", "duplicate_of")]))
    base = articles.select("article_id", "publish_date", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))

    def mentions(location: str, name: str, pattern: str) -> Column:
        def one(m: Column) -> Column:
            end = m["start"] + F.length(m["found"])
            return F.struct(F.lit(location).alias("location"), F.lit(name).alias("pattern"), m["start"].alias("start"), end.alias("end"), star_value(name, m["found"]).alias("star"))

        found = F.transform(matches(F.col(location), pattern), one)
        return F.when(F.col(location).contains("星"), F.filter(found, lambda m: F.coalesce(m["star"].between(least, most), F.lit(False)))).otherwise(F.filter(found, lambda m: F.lit(False)))

    key = lambda m: F.struct(m["location"], m["start"], m["end"], m["star"])
    every = F.concat(*[mentions(where, n, p) for where, patterns in (("title", BODY_PATTERNS | TITLE_PATTERN), ("text", BODY_PATTERNS)) for n, p in patterns.items()])
    first = once(every, lambda found: once(F.transform(found, key), lambda keys: F.filter(found, lambda m, i: F.array_position(keys, key(m)) == i + 1)))
    rows = base.select("*", F.inline(first))
    left = F.greatest(F.col("start") - vocabulary.context, F.lit(0))
    titled = F.col("location") == "title"
    around = squeezed(F.substr("text", left + 1, F.col("end") + vocabulary.context - left))

    def judged(context: Column) -> Column:
        kind = relation(F.col("title"), context, titled, vocabulary)
        return once(kind, lambda k: F.struct(context.alias("context"), k.alias("relation"), confidence(F.col("title"), context, titled, k, vocabulary).alias("confidence")))

    # Out of an array, so that a filter on what is judged isn't moved before it and judges twice.
    details = F.inline(F.array(once(F.when(titled, F.trim("title")).otherwise(around), judged)))
    return rows.select("article_id", "publish_date", "title", "location", "pattern", "start", "end", "star", details)


def ranked(found: DataFrame) -> DataFrame:
    """Candidates by date, null last, then the most confident, then by article and place."""
    return found.orderBy(F.asc_nulls_last("publish_date"), F.desc("confidence"), "article_id", "location", "start")


def is_canonical(flag: Column, duplicate_of: Column) -> Column:
    """The flag where there is one, else whether the article is no duplicate."""
    return F.coalesce(flag.cast("boolean"), F.coalesce(duplicate_of.cast("string"), F.lit("")) == "")


def is_daily(title: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    return F.coalesce(title.contains(vocabulary.marker) & ~title.contains(vocabulary.global_marker), F.lit(False))


def opening(text: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """The text after its first line, line ends made alike, cut to the opening's length."""
    alike = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|[\r\u000b\u000c\u001c-\u001e\u0085  ]", "\n")
    body = lambda lines: F.when(lines.contains("\n"), F.regexp_replace(lines, r"^[^\n]*\n", "")).otherwise("")
    return F.substring(once(alike, body), 1, vocabulary.opening)


def is_valid(prefix: Column, method: str, published: Column) -> Column:
    """Whether the sentence up to a match speaks of the day itself and of the close."""
    cue = F.replace(prefix, F.lit("如果细一些计算"), F.lit("")) if method == "fine_current_statement" else prefix
    day = r"(\d{1,2})月(\d{1,2})(?:[、,，~～-]\d{1,2})?日"
    month, dom = F.regexp_extract(prefix, day, 1).try_cast("int"), F.regexp_extract(prefix, day, 2).try_cast("int")
    same = F.coalesce((month == F.month(published)) & (dom == F.dayofmonth(published)), F.lit(False))
    valid = ~any_of(cue, NONCURRENT_CUES) & ~prefix.rlike(r"20\d{2}年") & (~prefix.rlike(day) | same) & ~any_of(prefix, ("中午", "上午收盘"))
    return valid if method == "closing_statement" else valid & ~any_of(prefix, INTRADAY_CUES)


def valid_matches(head: Column, method: str, pattern: str, published: Column) -> Column:
    """The valid matches in order; the sentence up to each is worked out once."""

    def with_prefix(m: Column) -> Column:
        before = F.regexp_extract(F.substr(head, F.lit(1), m["start"]), r"[^。！？\n]*$", 0)
        return F.struct(m["found"].alias("found"), squeezed(F.concat(before, m["found"])).alias("prefix"))

    found = F.transform(matches(head, pattern), with_prefix)
    return F.filter(found, lambda m: is_valid(m["prefix"], method, published))


def observation(title: Column, text: Column, published: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """One exact rating of an article as (star, evidence, method, confidence), or null.

    Patterns are tried in order of strength; the last valid match of a pattern counts, of
    the weakest the first. A dated statement anywhere counts last, if it names the article's own date.
    A pattern's matches are only gathered in texts that hold a word it needs and match it. Filter rows by ``observed``: a plain
    filter on this column would be moved before it and work it out twice.
    """
    number = lambda found: F.regexp_extract(found, r"([1-5](?:\.\d)?)(?:\s*星(?:级)?)?$", 1).try_cast("double")

    def made(method: str, sure: float):
        return lambda m: F.struct(number(m["found"]).alias("star"), squeezed(m["found"]).alias("evidence"), F.lit(method).alias("method"), F.lit(sure).alias("confidence"))

    def picked(valid: Column, method: str, sure: float, place: int, needed: Column) -> Column:
        return F.when(needed, F.try_element_at(F.transform(F.slice(valid, place, 1), made(method, sure)), F.lit(1)))

    def tried(head: Column) -> list[Column]:
        out = []
        for method, pattern, sure in REALTIME_PATTERNS:
            words = NEEDED[method]
            needed = reduce(lambda a, b: a | b, [head.contains(w) for w in words]) & head.rlike(f"(?U){pattern}")
            needed = needed if method == "fine_current_statement" else needed & head.contains("星")
            out.append(picked(valid_matches(head, method, pattern, published), method, sure, 1 if method == "opening_state_statement" else -1, needed))
        return out

    part = lambda m, i: F.regexp_extract(m["found"], r"目前\s*(\d{4})年(\d{1,2})月(\d{1,2})日", i).try_cast("int")
    own = lambda m: F.coalesce((part(m, 1) == F.year(published)) & (part(m, 2) == F.month(published)) & (part(m, 3) == F.dayofmonth(published)), F.lit(False))
    whole = F.coalesce(text, F.lit(""))
    dated = picked(F.filter(matches(whole, DATED), own), "dated_current_statement", 0.985, 1, whole.contains("市场在"))
    return F.when(is_daily(title, vocabulary), F.coalesce(once(opening(text, vocabulary), lambda head: F.coalesce(*tried(head))), dated))


def observed(articles: DataFrame, keep: list[str], vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``keep`` with ``star, evidence, method, confidence`` of the articles (``title, text, publish_date``) that have an exact rating."""
    one = observation(F.col("title"), F.col("text"), F.col("publish_date"), vocabulary)
    return articles.select(*keep, F.inline(F.array_compact(F.array(one))))


def reason(text: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """The reason of ``review`` alone: the opening is worked out once, and nothing is extracted."""
    said = lambda head: reduce(lambda a, b: a.when(head.rlike(f"(?U){b[0]}"), b[1]), [(APPROX_RANGE, "approximate_range"), (NEAR_THRESHOLD, "near_threshold_only")], F.when(head.rlike(f"(?U){MARKET_CLOSED}"), "market_closed_no_new_target"))
    return once(opening(text, vocabulary), lambda head: said(head).otherwise("no_exact_text_evidence"))


def review(title: Column, text: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Why a daily article has no exact value: (reason, range_low, range_high, reference_star, evidence)."""
    head = opening(text, vocabulary)
    found = {n: F.regexp_extract(head, f"(?U){p}", 0) for n, p in (("closed", MARKET_CLOSED), ("range", APPROX_RANGE), ("near", NEAR_THRESHOLD))}
    low, high = (F.regexp_extract(head, f"(?U){APPROX_RANGE}", i).try_cast("double") for i in (1, 2))
    return F.struct(
        F.when(found["closed"] != "", "market_closed_no_new_target").when(found["range"] != "", "approximate_range").when(found["near"] != "", "near_threshold_only").otherwise("no_exact_text_evidence").alias("reason"),
        F.least(low, high).alias("range_low"),
        F.greatest(low, high).alias("range_high"),
        F.regexp_extract(head, f"(?U){NEAR_THRESHOLD}", 1).try_cast("double").alias("reference_star"),
        F.when(found["closed"] != "", squeezed(found["closed"])).when(found["range"] != "", squeezed(found["range"])).when(found["near"] != "", squeezed(found["near"])).otherwise(F.substring(squeezed(head), 1, 240)).alias("evidence"),
    )
