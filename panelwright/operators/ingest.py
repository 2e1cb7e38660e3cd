"""From files to a table of canonical articles."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = (".md", ".html", ".htm", ".json", ".txt")


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``relative_path, suffix, stem, size_bytes, sha256, article_id, raw`` of the files under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.substring_index(F.col("path"), base.split(":", 1)[-1] + "/", -1)
    files = files.withColumn("relative_path", rel).withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    files = files.where(F.col("suffix").isin(*suffixes)).withColumn("stem", F.regexp_extract("relative_path", r"([^/]+?)\.[^./]+$", 1))
    return files.select(
        "relative_path", "suffix", "stem", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
        F.substring(F.sha1(F.col("relative_path").cast("binary")), 1, 20).alias("article_id"), F.decode("content", "UTF-8").alias("raw"),
    )


#: A date in brackets, maybe with a time, and the title after it. Fixed value.
DATED_NAME = r"\[(\d{4}-\d{2}-\d{2})(?:-\d{4})?\](.+)"


def path_parts(stem: Column, parent: Column) -> tuple[Column, Column]:
    """Date and title from a file's name, or else from its folder's; a file of neither has no date, and its name as the title."""
    name = F.when(stem.rlike(DATED_NAME), stem).when(parent.rlike(DATED_NAME), parent)
    return F.regexp_extract(name, DATED_NAME, 1), F.coalesce(F.trim(F.regexp_extract(name, DATED_NAME, 2)), F.trim(stem))


def article_key(stem: Column) -> Column:
    return F.regexp_replace(stem, r"(?U)\s+", "")


def first_json(raw: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{n}"), F.lit("")) for n in names])


class Page(HTMLParser):
    """Title, url and text of a page: scripts and styles dropped, text nodes stripped and joined by line ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.heads: dict[str, str] = {}
        self.parts: list[str] = []
        self.skip, self.inside, self.done = 0, "", set()

    def handle_starttag(self, tag, attrs):
        pairs = dict(attrs)
        if tag == "meta":
            for kind in ("property", "name"):
                if pairs.get(kind) and pairs.get("content"):
                    self.meta.setdefault(f"{kind}={pairs[kind]}", pairs["content"])
        self.skip += tag in ("script", "style", "noscript")
        if tag in ("h1", "title") and tag not in self.done:
            self.inside = tag

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript") and self.skip > 0
        if tag == self.inside:
            self.inside = ""
            self.done.add(tag)

    def handle_data(self, data):
        if not self.skip and (text := data.strip()):
            self.parts.append(text)
            if self.inside:
                self.heads[self.inside] = f"{self.heads.get(self.inside, '')} {text}".strip()


def parse_page(html: str | None) -> tuple:
    page = Page()
    try:
        page.feed(html or "")
        page.close()
        named = [page.meta.get(k) for k in ("property=og:title", "property=twitter:title", "name=twitter:title")]
        title = next((t for t in (*named, page.heads.get("h1"), page.heads.get("title")) if t), None)
        return title, page.meta.get("property=og:url"), "\n".join(page.parts), None
    except Exception as e:  # a page that can't be parsed is kept and marked
        return None, None, f"[PARSE_ERROR] {e}", str(e)


def pages_text(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``title, source_url, text, error`` of each page, parsed once in Arrow batches."""
    schema = pages.select(*keep).schema.add("title", "string").add("source_url", "string").add("text", "string").add("error", "string")

    def run(batches):
        for batch in batches:
            got = [parse_page(h) for h in batch["_html"]]
            out = batch[keep].copy()
            for i, c in enumerate(("title", "source_url", "text", "error")):
                out[c] = pd.Series([g[i] for g in got], dtype=object, index=out.index)
            yield out

    return pages.select(*keep, F.col(html).alias("_html")).mapInPandas(run, schema)


def parsed(files: DataFrame) -> DataFrame:
    """Articles of scanned files: embedded title and date, else those of the path; a page's text for HTML."""
    pages = pages_text(files.where(F.col("suffix").isin(".html", ".htm")), "raw", ["relative_path"])
    pages = pages.select(F.col("relative_path").alias("_path"), F.col("title").alias("_title"), F.col("source_url").alias("_url"), F.col("text").alias("_text"), F.col("error").alias("_error"))
    rows = files.join(pages, F.col("relative_path") == F.col("_path"), "left")
    parent = F.regexp_extract("relative_path", r"([^/]+)/[^/]+$", 1)
    path_date, path_title = path_parts(F.col("stem"), parent)
    md, js = F.col("suffix").isin(".md", ".markdown"), F.col("suffix") == ".json"
    h1 = F.nullif(F.regexp_extract("raw", r"(?m)^\s*#\s+(.+?)\s*$", 1), F.lit(""))
    day = F.regexp_extract_all(F.substring("raw", 1, 1500), F.lit(r"\d{4}年\d{2}月\d{2}日"), F.lit(0))
    md_date = F.translate(F.try_element_at(day, F.lit(1)), "年月日", "--")
    broken = js & F.try_parse_json("raw").isNull()
    text = F.when(broken, "[PARSE_ERROR] malformed JSON").when(js, F.coalesce(first_json(F.col("raw"), ("text", "content", "body", "article")), F.col("raw"))).otherwise(F.coalesce("_text", "raw"))
    return rows.select(
        "article_id", article_key(F.col("stem")).alias("article_key"), "relative_path", "suffix", "size_bytes", "sha256",
        F.coalesce(F.when(md, md_date), F.when(js, first_json(F.col("raw"), ("publish_date", "date", "published_at", "time"))), path_date).alias("publish_date"),
        F.coalesce(F.when(md, h1), F.when(js, first_json(F.col("raw"), ("title", "name"))), F.col("_title"), path_title).alias("title"),
        text.alias("text"), F.coalesce(F.when(js, first_json(F.col("raw"), ("source_url", "url", "link"))), F.col("_url")).alias("source_url"),
        (F.col("_error").isNotNull() | broken).alias("failed"),
    )


def canonical(articles: DataFrame) -> DataFrame:
    """Adds ``duplicate_of``, ``is_canonical``, ``canonical_article_id`` and inherited urls.

    A later file with the same hash points to the first in path order. Of one key, the row
    without a parse error, with the best suffix, that is no duplicate and comes first by path is canonical.
    """
    # Only hashes that occur more than once are joined, and they are combined before the shuffle: any number of files may be alike.
    same = articles.groupBy(F.col("sha256").alias("_hash")).agg(F.count("*").alias("_n"), F.min_by("article_id", F.split("relative_path", "/")).alias("_first")).where("_n > 1")
    rows = articles.join(same.drop("_n"), F.col("sha256") == F.col("_hash"), "left").drop("_hash")
    rows = rows.withColumn("duplicate_of", F.when(F.col("_first") != F.col("article_id"), F.col("_first"))).drop("_first")
    order = F.when(F.col("suffix").isin(".md", ".markdown"), 0).when(F.col("suffix").isin(".html", ".htm"), 1).when(F.col("suffix") == ".json", 2).otherwise(3)
    by = Window.partitionBy("article_key")
    ranked = by.orderBy(F.col("failed"), order, F.col("duplicate_of").isNotNull(), "relative_path")
    rows = rows.withColumn("is_canonical", F.row_number().over(ranked) == 1).withColumn("canonical_article_id", F.first("article_id").over(ranked))
    whole = by.orderBy(F.split("relative_path", "/")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("source_url", F.coalesce("source_url", F.first("source_url", ignorenulls=True).over(whole)))


def manifest(articles: DataFrame) -> DataFrame:
    return articles.drop("text")


def counts(articles: DataFrame) -> DataFrame:
    """One row: files, canonical articles and exact duplicates; without a canonical flag all but the duplicates count."""
    duplicate = F.coalesce(F.col("duplicate_of"), F.lit("")) != ""
    flag = F.coalesce(F.col("is_canonical"), F.lit(False)) if "is_canonical" in articles.columns else ~duplicate
    return articles.agg(F.count("*").alias("files"), F.count_if(flag).alias("canonical_articles"), F.count_if(duplicate).alias("exact_duplicates"))
