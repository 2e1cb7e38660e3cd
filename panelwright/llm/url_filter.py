"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, hash_share

#: Host levels whose label statistics are features: last label, last two, last three.
SUFFIX_LEVELS = (1, 2, 3)
#: A table of suffix or path statistics with more rows than this isn't broadcast but joined by shuffle.
MOST_SENT = 100_000


@dataclass(frozen=True)
class Rule:
    """``spec`` is ``host/path``: it fits the host, its subdomains, and paths that start so."""

    spec: str
    allow: bool

    @property
    def host(self) -> str:
        return self.spec.split("/", 1)[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.spec.split("/", 1)[1] if "/" in self.spec else ""


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty if there is none."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, ascii_lower(host)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no host part."""
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, else null; equal lengths go by rule text."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.spec), r.spec)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.spec)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a short text; 0 if empty."""
    n = F.length(text)
    return F.aggregate(
        F.array_distinct(F.split(text, "")),
        F.lit(0.0),
        lambda acc, c: acc - F.when(c == "", 0.0).otherwise(
            (n - F.length(F.replace(text, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(text, c, F.lit("")))) / n)
        ),
    )


def host_suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def path_head(path: Column) -> Column:
    return F.regexp_extract(path, "^/([^/]*)", 1)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features. A null url counts as an empty one."""
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)
    count = lambda c, of=text: (F.length(of) - F.length(F.replace(of, F.lit(c), F.lit("")))).cast("double")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    digits = (n - F.length(F.translate(text, "0123456789", ""))).cast("double")
    return {
        "url_len": n.cast("double"),
        "host_len": F.length(host).cast("double"),
        "path_len": F.length(path).cast("double"),
        "depth": count("/", path),
        "labels": count(".", host),
        "hyphens": count("-", host),
        "digits": digits / F.greatest(n, F.lit(1)),
        "entropy": entropy(text),
        "params": F.when(query == "", 0.0).otherwise(count("&", query) + 1),
        "fragment": F.contains(text, F.lit("#")).cast("double"),
        "secure": text.startswith("https").cast("double"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    }


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    rules: list[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    max_train: int = 20_000,
    trees: int = 20,
    depth: int = 4,
    seed: int = 17,
    smoothing: float = 20.0,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``labelled`` has ``url`` and ``label`` (1.0: block). Statistics of host suffixes and
    first path parts cover all labelled urls; a url's own label is left out of what it
    learns from. The trees are fitted on about ``max_train`` labelled urls, half of them of either label if
    there are so many, chosen by a hash and weighted by how many they stand for. A url that is repeated with the same label
    counts once in all of this. ``score`` is the trees' probability of block; the rule's verdict wins.

    Null urls and urls without ``://`` have an empty host and path and get the trees'
    verdict. Repeated rows are judged alike, an empty table gives an empty one. Without labelled urls of both kinds, the
    verdict is the one kind there is, or allow. Very long urls are read whole. Other columns of ``pages`` are ignored.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = base.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = labelled.select("url", F.col("label").cast("double").alias("label")).where("url is not null and label is not null").distinct()
    known = known.select("url", "label", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))

    known = checkpointed(known)
    n, blocked = known.agg(F.count("*"), F.sum("label")).first()
    prior = (blocked or 0.0) / n if n else 0.0
    base = base.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    if n and 0 < blocked < n:
        groups = {f"suffix{k}": host_suffix(F.col("host"), k) for k in SUFFIX_LEVELS} | {"head": path_head(F.col("path"))}
        keys = F.explode(F.array(*[F.struct(F.lit(g).alias("kind"), c.alias("key")) for g, c in groups.items()]))
        stats = checkpointed(
            known.select(keys.alias("g"), "label").groupBy("g.kind", "g.key").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
        )
        sizes = {r["kind"]: r["count"] for r in stats.groupBy("kind").count().collect()}
        names = [*lexical(F.lit(""), F.lit(""), F.lit("")), *groups]

        def featured(df: DataFrame, own: bool) -> DataFrame:
            df = df.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
            for g, c in groups.items():
                one = stats.where(F.col("kind") == g).select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("blocked").alias("_b"))
                one = F.broadcast(one) if sizes.get(g, 0) <= MOST_SENT else one
                df = df.withColumn("_g", c).join(one, F.col("_g") == F.col("_key"), "left")
                less_n, less_b = (F.lit(1), F.col("label")) if own else (F.lit(0), F.lit(0.0))
                rate = (F.coalesce("_b", F.lit(0.0)) - less_b + smoothing * prior) / (F.coalesce("_n", F.lit(0)) - less_n + smoothing)
                df = df.withColumn(g, rate).drop("_g", "_key", "_n", "_b")
            return df

        shares = [min(1.0, max_train / 2 / m) for m in (n - blocked, blocked)]
        share = F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])
        sample = known.where(hash_share([F.col("url")], f"urls{seed}") < share)
        pack = VectorAssembler(inputCols=names, outputCol="features")
        rows = checkpointed(featured(sample, True).select("label", (1 / share).alias("weight"), *names))
        trees_of = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=seed, weightCol="weight")
        fitted = trees_of.fit(pack.transform(rows).select("features", "label", "weight"))
        scored = fitted.transform(pack.transform(featured(base, False)))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    else:
        scored = base.withColumn("score", F.lit(float(prior)))
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for rule in rules:
        verdict = F.when(F.col("rule") == rule.spec, F.lit("allow" if rule.allow else "block")).otherwise(verdict)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
