"""URL filter by rules and by a tree of path templates.

Rules are hand-written (verdict, host, path) triples; one fits its host and all subdomains if the url's path starts
with its path, and the longest fitting one decides. Other urls are judged by the template tree of their host:

1. Level by level, the path segments below a node are counted over all pages. A value with at least ``support`` pages
   and the share ``share`` of its node stays a literal branch; all others are variable and become a wildcard: ``#``
   for digits (with an extension or not), ``*`` else. Levels from ``depth`` on are one segment.
2. Literal siblings that are statistically similar are merged: Cramer's V between their distributions over (shape of
   the next segment, label) of at most ``similar``, the larger branches first.
3. A template is rejected if its labelled purity, smoothed towards the share of bad labels over all pages with
   ``strength`` pseudo-pages, is at least ``purity``; labels may cover a small sample of the pages.

Counts are aggregated before they meet, so a host with a third of all pages is a handful of rows for each node; a
node has at most 1 / share literal branches, and those alone are compared. Pages find their branch over salted keys.
Each level is written to the shared folder.

Rows: null urls and urls without ``://`` have empty host and path and are allowed (no tree is grown for them);
repeated rows and repeated page ids are each judged; null labels count as unlabelled; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.exact_dedup import ascii_lower
from millrace.llm.salting import salted_join

Rule = tuple[str, str, str]
#: (verdict, host, path): the rules of the registered query.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased and the path; both empty for null or where there is no ``://``."""
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.when(found, ascii_lower(host)).otherwise(""), F.when(found, path).otherwise("")


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, else nulls. For hand-written lists: one test per rule."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def _shape(segment: Column) -> Column:
    return F.when(segment.isNull(), "").when(segment.rlike(r"^[0-9]+(\.[a-z]+)?$"), "#").otherwise("*")


def _merged(similar: float):
    """For one node: each literal branch and the name of the group of similar branches that it joins."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="value", columns="kind", values="n", aggfunc="sum", fill_value=0)
        counts = table.to_numpy(float)
        order = np.lexsort((table.index.to_numpy(), -counts.sum(axis=1)))
        groups: list[tuple[np.ndarray, list[str]]] = []
        for k in order:
            for g, (total, names) in enumerate(groups):
                if _cramers_v(total, counts[k]) <= similar:
                    groups[g] = (total + counts[k], [*names, table.index[k]])
                    break
            else:
                groups.append((counts[k], [table.index[k]]))
        pairs = [(v, names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}") for _, names in groups for v in names]
        out = pd.DataFrame(pairs, columns=["value", "branch"])
        out.insert(0, "node", rows["node"].iloc[0])
        out.insert(0, "host", rows["host"].iloc[0])
        return out

    return run


def _cramers_v(a: np.ndarray, b: np.ndarray) -> float:
    both = np.stack([a, b])
    both = both[:, both.sum(axis=0) > 0]
    if both.shape[1] < 2:
        return 0.0
    expected = both.sum(axis=1, keepdims=True) * both.sum(axis=0) / both.sum()
    return float(np.sqrt(((both - expected) ** 2 / expected).sum() / both.sum()))


def url_templates(
    pages: DataFrame, *, depth: int = 4, support: int = 20, share: float = 0.02, similar: float = 0.1
) -> DataFrame:
    """``pages`` (page_id, host, path, label and others) with the column template.

    label: 1 bad, 0 good, null unlabelled.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    cut = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(F.array_join(F.slice(parts, depth, 1 << 20), "/"))))
    rows = pages.withColumn("_parts", F.coalesce(cut, parts)).withColumn("_node", F.lit(""))
    for level in range(depth):
        here, after = F.get("_parts", F.lit(level)), F.get("_parts", F.lit(level + 1))
        counted = rows.filter(here.isNotNull()).select(
            "host", F.col("_node").alias("node"), here.alias("value"),
            F.concat_ws(":", _shape(after), F.coalesce(F.col("label").cast("string"), F.lit("-"))).alias("kind"),
        ).groupBy("host", "node", "value", "kind").agg(F.count(F.lit(1)).alias("n"))
        by_value = counted.groupBy("host", "node", "value").agg(F.sum("n").alias("n_value"))
        by_node = by_value.groupBy("host", "node").agg(F.sum("n_value").alias("n_node"))
        literal = by_value.join(by_node, ["host", "node"]).filter(
            (F.col("n_value") >= support) & (F.col("n_value") >= share * F.col("n_node"))
        ).select("host", "node", "value")
        branches = (
            counted.join(literal, ["host", "node", "value"])
            .groupBy("host", "node")
            .applyInPandas(_merged(similar), "host string, node string, value string, branch string")
        )
        named = scratch.written(branches, "branches").select(
            F.col("host").alias("_h"), F.col("node").alias("_k"), F.col("value").alias("_v"), "branch"
        )
        fits = (F.col("host") == F.col("_h")) & (F.col("_node") == F.col("_k")) & (here == F.col("_v"))
        step = F.concat("_node", F.lit("/"), F.coalesce("branch", _shape(here)))
        rows = scratch.written(
            salted_join(rows, fits, F.col("_parts"), named, "left").withColumn("_node", F.when(here.isNull(), F.col("_node")).otherwise(step)).drop("_h", "_k", "_v", "branch"),
            "templates",
        )
    return rows.drop("_parts").withColumnRenamed("_node", "template")


def template_purity(labelled: DataFrame, *, strength: float = 8.0) -> DataFrame:
    """host, template, pages, labelled pages and smoothed purity of each template."""
    stats = labelled.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count("label").alias("n_labelled"), F.sum(F.coalesce("label", F.lit(0))).alias("n_bad")
    )
    totals = labelled.agg(F.avg("label").alias("rate")).first()
    prior = totals.rate if totals.rate is not None else 0.0
    purity = (F.col("n_bad") + F.lit(strength * prior)) / (F.col("n_labelled") + F.lit(strength))
    return stats.withColumn("purity", purity)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    labels: DataFrame | None = None,
    *,
    url: str = "url",
    key: str = "page_id",
    strength: float = 8.0,
    purity: float = 0.8,
    **tree: float,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page.

    ``labels`` (page_id, label: 1 bad, 0 good) are the tree's; where they are missing, the rules' verdicts label
    the pages they fit. ``tree``: depth, support, share, similar of :func:`url_templates`.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    name, said = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_said", said)
    if labels is None:
        rows = rows.withColumn("label", F.when(F.col("_said") == "block", 1).when(F.col("_said") == "allow", 0))
    else:
        known = labels.groupBy(F.col(key).alias("_p")).agg(F.max("label").cast("int").alias("label"))
        rows = rows.join(known, F.col("page_id") == F.col("_p"), "left").drop("_p")
    grown = url_templates(rows, **tree)
    stats = template_purity(grown, strength=strength)
    bad = stats.filter((F.col("purity") >= purity) & (F.col("host") != ""))
    bad = bad.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "purity")
    method = F.when(F.col("_h").isNotNull(), "block").otherwise("allow")
    joined = salted_join(grown, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), F.col("path"), bad, "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_said", method).alias("verdict"), "template", "purity")
