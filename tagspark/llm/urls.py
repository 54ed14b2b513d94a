"""URL filters by path-template trees.

Per host, paths are a tree of segments. Segments that vary by their form (numbers, long hex
strings) are wildcards from the start. Level by level, a branch stays apart only if its share of
bad labels differs significantly from that of its parent, on its host or, as a host may have few
labels, on all hosts taken together; all others are merged into a wildcard `*`. Siblings that are
apart on the same side of their parent and do not differ from each other are merged too, into `*-`
or `*+`. A template is rejected if the share of good labels below it is too low. That share is
smoothed by those of its host and of the same template on all hosts, and these by that of all
labels. Rules on hosts and paths come before the templates.

The tree is built on counts per distinct masked path, so a host that holds a third of the pages
is a few rows, and only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.operators.joins import split_lookup
from tagspark.sources.staging import stage

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Holds for `host` and its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Templates:
    # Segments looked at; what is deeper is one wildcard.
    depth: int = 4
    # Labels a branch needs, and how many standard deviations it must be off, to stay apart.
    min_labels: int = 20
    z: float = 3.0
    # Labels that the parent's share of good ones counts for.
    smoothing: float = 10.0
    # Least share of good labels.
    purity: float = 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_for(rules: list[UrlRule], host: Column, path: Column) -> Column:
    """`(rule, verdict)` of the longest rule that fits, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        best = F.when(fits, found).otherwise(best)
    return best


def masked_segments(path: Column, depth: int) -> Column:
    """Segments with numbers and long hex strings masked, `depth` of them at most."""
    masked = F.regexp_replace(F.regexp_replace(path, "[0-9]+", "#"), "[0-9a-fA-F#-]{16,}", "#")
    segments = F.array_remove(F.split(masked, "/"), "")
    return F.when(
        F.size(segments) > depth, F.concat(F.slice(segments, 1, depth - 1), F.array(F.lit("**")))
    ).otherwise(segments)


def differs(l: Column, g: Column, p: Column, settings: Templates) -> Column:
    """Whether `g` good ones of `l` labels are too far from the share `p`."""
    off = F.abs(g - l * p) - 0.5
    return F.coalesce((l >= settings.min_labels) & (off > settings.z * F.sqrt(l * p * (1 - p))), F.lit(False))


def named_branches(children: DataFrame, settings: Templates) -> DataFrame:
    """`(_branch, _name)` of `children (_parent, _shape, _child, l, g)`, stored.

    `_shape` names the template above, whatever its host.
    """
    sums = (F.sum("l").alias("l"), F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"))

    def pooled(key: str, rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        counts = stage(rows.groupBy(key).agg(*sums), name)
        return counts, counts.select(key, F.col("l").alias(f"{name}_l"), F.col("g").alias(f"{name}_g"))

    rows = children.withColumn("_kind", F.xxhash64("_shape", "_child"))
    parents, own = pooled("_parent", rows, "own")
    kinds, kind = pooled("_kind", rows, "kind")
    shapes, shape = pooled("_shape", rows, "shape")
    for counts, dim, key in ((parents, own, "_parent"), (kinds, kind, "_kind"), (shapes, shape, "_shape")):
        rows = split_lookup(rows, dim, key, "_child" if key != "_kind" else "_parent", counts=(counts, "n"))
    here, there = F.try_divide("own_g", "own_l"), F.try_divide("shape_g", "shape_l")
    alone = differs(F.col("l"), F.col("g"), here, settings)
    together = differs(F.col("kind_l"), F.col("kind_g"), there, settings)
    below = F.when(alone, F.col("g") < F.col("l") * here).otherwise(F.col("kind_g") < F.col("kind_l") * there)
    apart = stage(
        rows.filter(alone | together).select(
            "_parent", "_child", "l", "g", F.when(below, "-").otherwise("+").alias("_side")
        ),
        "apart",
    )
    sides = apart.groupBy("_parent", "_side").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.sum("g"), F.sum("l")).alias("p")
    )
    sides = sides.select(F.xxhash64("_parent", "_side").alias("_group"), "n", "p")
    named = split_lookup(apart.withColumn("_group", F.xxhash64("_parent", "_side")), sides, "_group", "_child")
    single = (F.col("n") == 1) | differs(F.col("l"), F.col("g"), F.col("p"), settings)
    name = F.when(single, F.col("_child")).otherwise(F.concat(F.lit("*"), "_side"))
    return stage(named.select(F.xxhash64("_parent", "_child").alias("_branch"), name.alias("_name")), "named")


def build_templates(leaves: DataFrame, settings: Templates) -> DataFrame:
    """`(host, segments, template, labelled, good)` from `(host, segments, labelled, good)`."""
    grown = leaves.withColumn("template", F.array().cast("array<string>"))
    for level in range(1, settings.depth + 1):
        # The parent is the host and the template so far; what has no such segment ends there.
        here = stage(
            grown.withColumn("_child", F.get("segments", F.lit(level - 1)))
            .withColumn("_parent", F.xxhash64("host", "template"))
            .withColumn("_branch", F.xxhash64("_parent", "_child")),
            "branches",
        )
        children = here.filter("_child is not null").groupBy("_parent", "_child").agg(
            F.first(F.xxhash64("template")).alias("_shape"), F.sum("labelled").alias("l"), F.sum("good").alias("g")
        )
        named = named_branches(stage(children, "children"), settings)
        # Only branches that stand apart have a name of their own.
        grown = (
            here.join(named, "_branch", "left")
            .withColumn(
                "template",
                F.when(F.col("_child").isNull(), F.col("template")).otherwise(
                    F.concat("template", F.array(F.coalesce("_name", F.lit("*"))))
                ),
            )
            .select("host", "segments", "labelled", "good", "template")
        )
    return grown


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: list[UrlRule], settings: Templates = Templates()
) -> DataFrame:
    """`(page_id, host, path, rule, verdict, template, purity)`, one row per row of `pages`.

    `labelled (page_id, good)` has the pages with a label; a page with several is good if all of
    them are, and null ones do not count. Null urls and urls without "://" have an empty host and
    path. Repeated rows are judged alike, each on its own, and their label counts for each; an
    empty table gives an empty one. Other columns of `pages` are not looked at.
    """
    marks = labelled.groupBy("page_id").agg(F.bool_and(F.col("good").cast("boolean")).cast("int").alias("_good"))
    parsed = stage(
        pages.select(
            "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
        )
        .withColumn("segments", masked_segments(F.col("path"), settings.depth))
        .join(marks, "page_id", "left"),
        "urls",
    )
    leaves = parsed.groupBy("host", "segments").agg(
        F.count("_good").alias("labelled"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good")
    )
    grown = stage(build_templates(leaves, settings), "grown")
    everything = grown.agg(F.sum("good").alias("g"), F.sum("labelled").alias("l")).first()
    overall = ((everything["g"] or 0) + 1) / ((everything["l"] or 0) + 2)

    def smoothed(below: Column | float) -> Column:
        return (F.col("g") + settings.smoothing * below) / (F.col("l") + settings.smoothing)

    sums = (F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    # What a host has on the whole, and what a template has on all hosts.
    grown = grown.withColumn("_shape", F.xxhash64("template"))
    hosts = grown.groupBy("host").agg(*sums).select("host", smoothed(F.lit(overall)).alias("_host_purity"))
    shapes = grown.groupBy("_shape").agg(*sums).select("_shape", smoothed(F.lit(overall)).alias("_shape_purity"))
    own = stage(grown.groupBy("host", "template", "_shape").agg(*sums), "own-templates")
    templates = (
        split_lookup(own.join(hosts, "host"), shapes, "_shape", "host")
        .select("host", "template", smoothed((F.col("_host_purity") + F.col("_shape_purity")) / 2).alias("purity"))
    )
    templates = stage(templates, "templates")
    judged = stage(
        grown.join(templates, ["host", "template"]).select(
            F.xxhash64("host", "segments").alias("_leaf"),
            F.concat(F.col("host"), F.lit("/"), F.array_join("template", "/")).alias("template"),
            "purity",
        ),
        "judged",
    )
    found = rule_for(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("purity") < settings.purity, "block").otherwise("allow")
    # A path that a third of all pages have is one leaf.
    return (
        split_lookup(parsed.withColumn("_leaf", F.xxhash64("host", "segments")), judged, "_leaf", "page_id")
        .withColumn("_rule", found)
        .select(
            "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", method).alias("verdict"), "template", "purity",
        )
    )
