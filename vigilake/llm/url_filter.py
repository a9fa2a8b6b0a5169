"""URL filter: hand-written rules first, then templates of each host's paths.

Per host, paths form a tree of segments. Going down from the root, a segment stays
itself only if enough of its parent's pages have it; others become wildcards of their
shape (runs of digits and long hexadecimal become `#`, the rest `*`). Sibling leaves of
one last-token shape whose labelled share of blocked pages does not differ beyond a
Hoeffding bound are merged; inner branches, and leaves without labels, are not. A merged template is rejected if its purity,
`(blocked + s * prior) / (labelled + s)`, reaches the threshold; pages that a rule
decides are the labelled ones. Pages without a rule get their template's verdict.

Every level is one aggregation of distinct (host, path) counts, so a hot host is
combined before it is shuffled. Siblings of one parent are at most `1 / min_share`
literals and a few shapes.

Defined cases. A null url, and one without `://`, has an empty host and path. Pages
with equal host and path share everything. Templates with fewer than `min_labelled`
labelled pages are allowed. Segments below `max_depth` are one wildcard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import ascii_lower, stored

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SMALL_ROWS = 100_000
END = ""


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule `host/path` that fits: its host or a subdomain, and the path's start."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def _shape(segment: Column) -> Column:
    digits = F.regexp_replace(segment, "[0-9a-f]{16,}|[0-9]+", "#")
    return F.when(F.instr(digits, "#") > 0, F.concat(F.lit("<"), F.substring(digits, 1, 24), F.lit(">"))).otherwise("*")


def _met(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(F.broadcast(other) if other.count() <= SMALL_ROWS else other, keys, "left")


def learn_templates(
    paths: DataFrame, max_depth: int = 6, min_share: float = 0.02, min_pages: int = 20
) -> DataFrame:
    """Adds `template`, an array of tokens, to distinct `host, path, n, blocked, allowed`."""
    pieces = F.slice(F.split("path", "/"), 2, max_depth)
    rows = paths.withColumn("segments", pieces).withColumn(
        "deeper", F.size(F.split("path", "/")) - 1 > max_depth
    ).withColumn("template", F.array().cast("array<string>"))
    for level in range(max_depth):
        rows = stored(rows.withColumn("segment", F.get("segments", F.lit(level))))
        if rows.where(F.col("segment").isNotNull()).isEmpty():
            break
        here = rows.groupBy("host", "template", "segment").agg(F.sum("n").alias("pages"))
        parent = stored(here.groupBy("host", "template").agg(F.sum("pages").alias("all_pages")))
        literal = stored(
            _met(here, parent, ["host", "template"])
            .where((F.col("pages") >= min_pages) & (F.col("pages") >= min_share * F.col("all_pages")))
            .where(F.col("segment").isNotNull() & ~F.col("segment").rlike("[0-9]"))
            .select("host", "template", "segment", F.lit(True).alias("literal"))
        )
        token = F.when(F.col("segment").isNull(), F.lit(None)).when(F.col("literal"), F.col("segment")).otherwise(
            _shape(F.col("segment"))
        )
        rows = _met(rows, literal, ["host", "template", "segment"]).withColumn("token", token).withColumn(
            "template",
            F.when(F.col("token").isNull(), F.col("template")).otherwise(F.array_append("template", F.col("token"))),
        ).drop("segment", "literal", "token")
    return rows.withColumn(
        "template", F.when(F.col("deeper"), F.array_append("template", F.lit("**"))).otherwise(F.col("template"))
    ).drop("segments", "deeper", "segment")


def merge_branches(templates: DataFrame, confidence: float = 0.05) -> DataFrame:
    """`host, template, blocked, labelled` pooled over similar sibling branches, for every template.

    Siblings with labelled pages are put in order of their blocked share; one joins
    the group of the one before it unless they differ by more than the bound allows.
    """
    bound = math.sqrt(0.5 * math.log(2 / confidence))
    branch = F.when(F.size("template") > 0, F.slice("template", 1, F.greatest(F.size("template") - 1, F.lit(0))))
    sizes = templates.withColumn("labelled", F.col("blocked") + F.col("allowed")).withColumn(
        "parent", F.coalesce(branch, F.array().cast("array<string>"))
    )
    # what usually follows the branch: the last token's shape stands for its pages
    sizes = sizes.withColumn("next", F.regexp_replace(F.coalesce(F.element_at("template", -1), F.lit("")), "[^<>#*]+", "a"))
    share = F.col("blocked") / F.col("labelled")
    siblings = Window.partitionBy("host", "parent", "next").orderBy(share, "template")
    apart = F.abs(share - F.lag(share).over(siblings)) > bound * (
        1 / F.sqrt("labelled") + 1 / F.sqrt(F.lag("labelled").over(siblings))
    )
    grouped = (
        sizes.where(F.col("labelled") > 0).withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
        .withColumn("branch", F.sum("apart").over(siblings))
    )
    whole = Window.partitionBy("host", "parent", "next", "branch")
    return grouped.select(
        "host", "template", F.sum("blocked").over(whole).alias("blocked"), F.sum("labelled").over(whole).alias("labelled")
    )


def filter_urls(
    pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url",
    smoothing: float = 5.0, threshold: float = 0.5, min_labelled: int = 10,
) -> DataFrame:
    """`page_id, host, path, rule, verdict, template, purity`; `rules` maps a rule to block or allow."""
    url = F.col(url_col)
    parted = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    parted = stored(parted.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)))
    said = F.create_map(*[F.lit(x) for pair in sorted(rules.items()) for x in pair])[F.col("rule")]
    paths = (
        parted.groupBy("host", "path").agg(
            F.count("*").alias("n"), F.sum((said == "block").cast("int")).alias("blocked"),
            F.sum((said == "allow").cast("int")).alias("allowed"),
        ).fillna(0, ["blocked", "allowed"])
    )
    placed = stored(learn_templates(paths))
    templates = stored(placed.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]))
    total = templates.agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).first()
    blocked, allowed = total["b"] or 0, total["a"] or 0
    prior = blocked / (blocked + allowed) if blocked + allowed else 0.0
    purity = (F.col("blocked") + smoothing * prior) / (F.col("labelled") + smoothing)
    judged = stored(merge_branches(templates).select(
        "host", "template", purity.alias("purity"),
        ((purity >= threshold) & (F.col("labelled") >= min_labelled)).alias("rejected"),
    ))
    verdicts = stored(_met(placed.select("host", "path", "template"), judged, ["host", "template"]))
    answer = F.coalesce(said, F.when(F.col("rejected"), "block").otherwise("allow"))
    return _met(parted, verdicts, ["host", "path"]).select(
        "page_id", "host", "path", "rule", answer.alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity",
    )
