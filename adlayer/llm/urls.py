"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

All of it is DataFrame functions and Spark's own tree learner. The trees are
trained on labelled URLs; of those that come from rules, the rule is the label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, AUTHORITY, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; pattern: host and path as one string, the host ending at the first slash."""

    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        own, slash, rest = self.pattern.partition("/")
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)


def rule_for(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(verdict, pattern) of the longest rule that fits, else null; of equally long ones the first listed."""
    ordered = sorted(rules, key=lambda r: -len(r.pattern))
    return F.coalesce(*(F.when(r.fits(host, path), F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))) for r in ordered), F.lit(None).cast("struct<verdict:string,pattern:string>"))


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c))) / size
    parts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: share(c) * F.log2(share(c)))
    return -F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.translate(text, what, ""))


LEXICAL = ["url_length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digits", "host_hyphens", "marks", "parameters", "query_length", "has_fragment", "secure", "host_entropy", "path_entropy", "longest_label"]
FEATURES = [*LEXICAL, "suffix_seen", "suffix_block_share", "section_seen", "section_block_share"]


def with_lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, ...) with the lexical features; null urls count as empty."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    made = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(F.rtrim(path, F.lit("/")), "/"),
        "labels": F.size(F.split(host, r"\.")),
        "digit_share": _count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": _count(host, "0123456789"),
        "host_hyphens": _count(host, "-"),
        "marks": _count(path, "-_.%~"),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "has_fragment": url.contains("#").cast("int"),
        "secure": url.startswith("https").cast("int"),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
    }
    return urls.withColumns({k: v.cast("double") for k, v in made.items()})


@dataclass
class UrlModel:
    """trees: None where the training rows have one label or none; that label (block or not) then holds for all.

    suffixes: (suffix, n, blocked), sections: (suffix, section, n, blocked), of labelled rows that the trees haven't seen.
    """

    trees: GBTClassificationModel | None
    suffixes: DataFrame
    sections: DataFrame
    prior: float


def section_of(path: Column) -> Column:
    """The first part of a path."""
    return F.substring_index(F.ltrim(path, F.lit("/")), "/", 1)


def fit(labelled: DataFrame, max_rows: int = 20_000, trees: int = 15, depth: int = 4, seed: int = 5) -> UrlModel:
    """Learn from labelled (url, host, path, label): label 1 is block, 0 allow, others are left out.

    Half of the rows, by a hash of the url, give the statistics of suffixes and
    of sections (suffix and first part of the path), the other half trains the
    trees: a row's own label is in no feature of its own. max_rows bounds the
    rows that the trees are trained on; the statistics take all of their half.
    """
    rows = labelled.where("label in (0, 1)").select("url", "host", "path", F.col("label").cast("double").alias("label"))
    half = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(2)) == 0
    placed = rows.withColumn("suffix", suffix_of(F.col("host"))).withColumn("section", section_of(F.col("path")))
    sections = stage(placed.groupBy("suffix", "section").agg(F.count_if(half).alias("n"), F.sum(F.when(half, F.col("label")).otherwise(0.0)).alias("blocked"), F.count("*").alias("every"), F.sum("label").alias("every_blocked")), "sections")
    total, blocked = sections.agg(F.sum("every"), F.sum("every_blocked")).first()
    prior = (blocked or 0.0) / total if total else 0.0
    suffixes = sections.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    sections = sections.select("suffix", "section", "n", "blocked")
    if not total or blocked in (0, total):
        return UrlModel(None, suffixes, sections, prior)
    sample = bounded_sample(rows.where(~half), F.col("url"), max_rows)
    ready = stage(_ready(sample, suffixes, sections, prior).select("label", *FEATURES), "training")
    if ready.select("label").distinct().count() < 2:
        return UrlModel(None, suffixes, sections, prior)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready).select("label", "features")
    learner = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, checkpointInterval=-1, maxMemoryInMB=64)
    return UrlModel(learner.fit(data), suffixes, sections, prior)


def _ready(urls: DataFrame, suffixes: DataFrame, sections: DataFrame, prior: float) -> DataFrame:
    """urls (url, host, path, ...) with all features. What a section hasn't shown comes from its suffix, and that from all rows."""
    made = with_lexical(urls).withColumn("_suffix", suffix_of(F.col("host"))).withColumn("_section", section_of(F.col("path")))
    of_suffix = suffixes.select(F.col("suffix").alias("_suffix"), F.col("n").alias("_n"), F.col("blocked").alias("_blocked"))
    of_section = sections.select(F.col("suffix").alias("_suffix"), F.col("section").alias("_section"), F.col("n").alias("_m"), F.col("blocked").alias("_held"))
    joined = made.join(of_suffix, "_suffix", "left").join(of_section, ["_suffix", "_section"], "left").fillna(0, ["_n", "_blocked", "_m", "_held"])
    share = (F.col("_blocked") + 2 * prior) / (F.col("_n") + 2)
    joined = joined.withColumns({"suffix_seen": F.log1p("_n"), "suffix_block_share": share, "section_seen": F.log1p("_m"), "section_block_share": (F.col("_held") + 2 * share) / (F.col("_m") + 2)})
    return joined.drop("_suffix", "_section", "_n", "_blocked", "_m", "_held")


def judge(urls: DataFrame, rules: list[Rule], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for each row of urls (page_id, url), repeated rows included.

    rule: the pattern of the longest rule that fits, or null; verdict: the
    rule's, else block if the trees' probability of a block, block_score, is at
    least threshold, else allow. Null urls and those without `://` have an
    empty host and path and are judged by the trees like any other. Other
    columns of urls are left out, whatever their names.
    """
    split = urls.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumn("_rule", rule_for(rules, F.col("host"), F.col("path")))
    if model.trees is None:
        scored = split.withColumn("block_score", F.lit(float(model.prior)))
    else:
        ready = _ready(split, model.suffixes, model.sections, model.prior)
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready)
        scored = model.trees.transform(assembled).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("_rule.pattern").alias("rule"), verdict.alias("verdict"), "block_score")


def labelled_by(rules: list[Rule], urls: DataFrame) -> DataFrame:
    """(url, host, path, label) of the distinct urls that a rule decides."""
    split = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("_rule", rule_for(rules, F.col("host"), F.col("path"))).where("_rule is not null")
    return ruled.select("url", "host", "path", (F.col("_rule.verdict") == "block").cast("int").alias("label"))
