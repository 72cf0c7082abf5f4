"""URL filter: explicit host and path rules, and below them a path-template tree judged by labels.

Every url becomes (host, path segments). A segment that looks like an id (digits, long hex, a digit-bearing
slug, or a file name made of digits) is a wildcard at once. Then, level by level, the children of a node
whose labelled share of good pages doesn't differ from that of their siblings together are merged into one
wildcard branch (two-proportion z test; too few labels means no difference), down to the deepest path there is.
Levels at which all paths of a node go on alike are settled together, so each branching is one small written step over
the paths that reach it. A page's template is its path
in the merged tree; the template is rejected if its smoothed purity, (good + a * prior) / (n + a) with the
parent's purity as the prior, falls below a threshold. Main path: DataFrame functions only; counts are
pre-aggregated to distinct (host, template) before any tree step, so a hot host costs no hot task; pages get
their template back in a merge join, of which Spark splits the partition of a hot path.

Rules come first: a rule fits its host and all subdomains if the path starts with its path, and the longest
(host length, then path length) wins; ties go to block.

Defined cases: a null url or one without `://` has empty host and path; it is judged by the template of the
empty host; a very long or deep url is one path, and the tree has as many levels; labels may be missing for any page (no labels at all: every page is allowed); a null page_id is
kept; repeated rows are judged alike; an empty table stays empty; further columns of pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelore.llm.common import materialise

#: Levels of the registered SQL; the operator has no such bound.
DEPTH = 3
Z = 2.58
SMOOTHING = 20.0
MIN_PURITY = 0.6
#: The fixed rules of the query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, both null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]), r[2] != "block"))
    name = verdict = F.lit(None).cast("string")
    for r in reversed(order):
        name = F.when(fits(host, path, r), r[0] + r[1]).otherwise(name)
        verdict = F.when(fits(host, path, r), r[2]).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """All segments of a path, ids generalised to `*`."""
    found = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(found, lambda x: F.when(x.rlike(r"^\d+(\.\w+)?$|^[0-9a-fA-F-]{8,}$|\d.*\d.*\d"), "*").otherwise(x))


def common_prefix(a: Column, b: Column) -> Column:
    """The elements that two arrays begin with alike."""
    n = F.least(F.size(a), F.size(b))
    alike = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, i).eqNullSafe(F.get(b, i)))
    first = F.array_position(F.when(n > 0, alike).otherwise(F.array(F.lit(False))), F.lit(False)).cast("int")
    return F.slice(a, F.lit(1), F.when(first == 0, n).otherwise(first - 1))


def merge_step(nodes: DataFrame) -> DataFrame:
    """`nodes` (host, s, t, n, good), t with the merged first segments, gets the next branching; `done` where t is whole.

    All paths with one (host, t) move on together. What they all begin with has no siblings and is settled at once, as is the
    rest of a path that is alone; then the children at the first difference are merged, those with nothing of
    their own into `*`. A path that ends there counts as a child of its parent. Only the aggregate of children
    meets over their parent.
    """
    at = F.size("t")
    nodes = nodes.withColumn("rest", F.slice("s", at + 1, F.greatest(F.lit(0), F.size("s") - at)))
    least, most = F.min("rest"), F.max("rest")  # what these share, all between them in order share too
    whole = nodes.groupBy("host", "t").agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), F.count("*").alias("all_paths"), common_prefix(least, most).alias("prefix"))
    named = lambda n, parts: F.when(n >= 5, parts).otherwise(F.transform(parts, lambda x: F.lit("*")))
    single = F.col("all_paths") == 1
    nodes = nodes.join(whole, ["host", "t"]).withColumns({"child": F.coalesce(F.get("rest", F.size("prefix")), F.lit("")), "t": F.concat("t", named(F.col("all_n"), F.when(single, F.col("rest")).otherwise(F.col("prefix"))))})
    kids = nodes.filter(~single).groupBy("host", "t", "child").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.first("all_n").alias("all_n"), F.first("all_good").alias("all_good"))
    others_n, others_good = F.col("all_n") - F.col("n"), F.col("all_good") - F.col("good")
    share = F.try_divide  # Spark may compute these before the conditions on n, so a division by zero is null
    pooled = share(F.col("all_good"), F.col("all_n"))
    spread = F.sqrt(pooled * (1 - pooled) * (share(F.lit(1), F.col("n")) + share(F.lit(1), others_n)))
    gap = F.abs(share(F.col("good"), F.col("n")) - share(others_good, others_n))
    z = F.when((F.col("n") >= 5) & (others_n >= 5) & (spread > 0), share(gap, spread)).otherwise(0.0)
    alone = others_n == 0
    new = F.when((z >= Z) | (alone & (F.col("n") >= 5)), F.col("child")).otherwise("*")
    mapping = kids.select("host", "t", "child", new.alias("new"))
    ended = single | (F.col("child") == "")
    out = nodes.join(mapping, ["host", "t", "child"], "left")
    return out.select("host", "s", F.when(ended, F.col("t")).otherwise(F.concat("t", F.array("new"))).alias("t"), "n", "good", ended.alias("done"))


def template_tree(typed: DataFrame) -> DataFrame:
    """`typed` (host, s, n, good), a row for each (host, s), with the merged template t, its purity and counts."""
    active = typed.withColumn("t", F.slice("s", 1, 0))
    whole = []
    while not active.isEmpty():  # a round for each branching of the deepest path
        step = materialise(merge_step(active), "level")
        whole.append(step.filter("done").drop("done"))
        active = step.filter("not done").drop("done")
    nodes = active
    for part in whole:
        nodes = nodes.unionByName(part)
    total = nodes.agg(F.sum("n").alias("n0"), F.sum("good").alias("good0"))
    purity = F.when(F.col("n0") > 0, F.col("good0") / F.col("n0")).otherwise(1.0)
    by_host = nodes.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    leaves = nodes.groupBy("host", "t").agg(F.sum("n").alias("tn"), F.sum("good").alias("tgood")).join(by_host, "host").join(F.broadcast(total))  # one row
    host_purity = (F.col("hgood") + SMOOTHING * purity) / (F.col("hn") + SMOOTHING)
    leaves = leaves.withColumn("purity", F.round((F.col("tgood") + SMOOTHING * host_purity) / (F.col("tn") + SMOOTHING), 9))
    return nodes.drop("n", "good").join(leaves.select("host", "t", "tn", "tgood", "purity"), ["host", "t"])


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_purity: float = MIN_PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. `labels`: page_id, good (0 or 1)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("s", segments(F.col("path")))
    marks = labels.groupBy("page_id").agg(F.max("good").cast("long").alias("good"))
    counted = parts.join(marks, "page_id", "left").groupBy("host", "s").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    tree = template_tree(materialise(counted, "urls"))
    name, fixed = rule_columns(F.col("host"), F.col("path"), rules)
    template = F.concat(F.lit("/"), F.array_join("t", "/"))
    own = F.when(F.col("purity") < min_purity, "block").otherwise("allow")
    return parts.join(tree.hint("merge"), ["host", "s"], "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(fixed, own).alias("verdict"), template.alias("template"), "purity")
