"""URL filter: rules by host and path, then a path-template tree per host whose templates are
judged by the smoothed purity of their labelled pages.

Built-in functions only: the tree is grown level by level as grouped sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.llm.common import lower_ascii, store

# (verdict, host, path): fits the host and its subdomains, if the path starts with the rule's.
Rule = tuple[str, str, str]
MOST_RULES = 1_000
WILD = "*"
# Levels that all paths go through.
ALL_TOGETHER = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?" or "#", A-Z lower-cased; path: from there up to
    "?" or "#". Both are empty for null or without "://"."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.coalesce(F.substr(url, F.length(after) + F.lit(4)), F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text (host and path), and its verdict; nulls without one.

    The rules are part of the plan, so their number is bounded.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        text = F.when(fits, F.lit(name + start)).otherwise(text)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def path_segments(path: Column) -> Column:
    """The segments of a path. A segment with a digit is variable (page numbers, dates, hashes)
    and becomes a wildcard."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.lit(WILD)).otherwise(s))


def template_tree(shapes: DataFrame, least_pages: int, similar: float) -> DataFrame:
    """Add `template` to shapes (host, segments, pages, labelled, bad).

    Level by level, below each template of a host: a segment on fewer than `least_pages` pages
    is variable; the others are compared with the pages of all their siblings, and those whose
    share of bad pages lies within `similar` standard errors of the siblings' are merged into
    the wildcard branch. What differs stays a branch of its own. The tree grows as long as some
    path has a further segment. Beyond the first levels, paths leave it early where nothing below
    can be a branch (too few pages, or a single path): the rest of these is wildcards.
    """
    rows = shapes.withColumn("template", F.lit(""))
    deepest = shapes.agg(F.max(F.size("segments"))).first()[0] or 0
    key, ended = ["host", "template"], []
    for level in range(1, deepest + 1):
        segment = F.try_element_at("segments", F.lit(level))
        rows = store(rows.withColumn("segment", segment), "paths")
        if level > ALL_TOGETHER:
            below = rows.where("segment is not null").groupBy(*key).agg(F.sum("pages").alias("all_pages"), F.count(F.lit(1)).alias("paths"))
            below = below.where((F.col("all_pages") >= least_pages) & (F.col("paths") > 1)).select(*[F.col(c).alias(f"_{c}") for c in key])
            on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in key], F.col("segment").isNotNull())
            parted = store(rows.join(below, on, "left"), "parted")
            rest = F.repeat(F.lit("/" + WILD), F.greatest(F.size("segments") - (level - 1), F.lit(0)))
            ended.append(parted.where("_host is null").select(*shapes.columns, F.concat("template", rest).alias("template")))
            rows = parted.where("_host is not null").select(*shapes.columns, "template", "segment")
            if rows.isEmpty():
                rows = rows.drop("segment")
                break
        sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "bad")]
        child = rows.where("segment is not null").groupBy(*key, "segment").agg(*sums)
        parent = child.groupBy(*key).agg(*[F.sum(c).alias(f"all_{c}") for c in ("labelled", "bad")])
        rate = F.when(F.col("all_labelled") > 0, F.col("all_bad") / F.col("all_labelled")).otherwise(0.0)
        error = F.sqrt(F.col("labelled") * rate * (1 - rate))
        apart = F.abs(F.col("bad") - F.col("labelled") * rate) > F.lit(similar) * error
        own = (F.col("pages") >= least_pages) & (F.col("labelled") > 0) & apart
        branch = (
            child.join(parent, key).where(own & (F.col("segment") != WILD))
            .select(*[F.col(c).alias(f"_{c}") for c in [*key, "segment"]])
        )
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in [*key, "segment"]])
        name = F.when(F.col("_segment").isNotNull(), F.col("segment")).otherwise(F.lit(WILD))
        grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), name))
        rows = rows.join(branch, on, "left").select(*shapes.columns, grown.alias("template"))
    return reduce(DataFrame.unionAll, ended, rows)


def judge(
    pages: DataFrame, id: str = "page_id", url: str = "url", bad: str = "bad", *, rules: Sequence[Rule] = (),
    least_pages: int = 5, similar: float = 2.0, prior: float = 10.0, purity: float = 0.5,
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, template, and the
    smoothed purity of the template.

    The longest fitting rule decides. Otherwise the page's template does: its share of good
    pages among the labelled ones (`bad` is 0 or 1, null is unlabelled), smoothed with `prior`
    pages at the share of all labelled pages, must be at least `purity`. Without labels every
    template is allowed. Null urls and those without "://" have an empty host and path and
    make one template. Repeated rows count and come back as often as they are there. Extra
    columns are not looked at. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(bad).cast("long").alias("bad"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    base = (
        base.select("page_id", "bad", host.alias("host"), path.alias("path"))
        .withColumn("segments", path_segments(F.col("path")))
        .withColumn("rule", rule).withColumn("said", said)
    )
    base = store(base, "urls")
    shapes = base.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    shapes = store(template_tree(shapes, least_pages, similar), "templates")
    total = shapes.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad")).first()
    share = 1 - total.bad / total.n if total.n else 1.0
    good = F.col("good") + F.lit(prior * share)
    judged = (
        shapes.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum(F.col("labelled") - F.col("bad")).alias("good"))
        .select("host", "template", (good / (F.col("n") + F.lit(float(prior)))).alias("purity"))
    )
    per_shape = shapes.select("host", "segments", "template").join(judged, ["host", "template"])
    verdict = F.coalesce("said", F.when(F.col("purity") >= purity, F.lit("allow")).otherwise(F.lit("block")))
    return base.join(per_shape, ["host", "segments"]).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"
    )
