"""URL filters (operator 6): fixed rules, and for the rest a path-template tree per host.

Paths become templates level by level. A segment is first generalised by its form (runs of digits), then by statistics:
rare children of a node with many children become a wildcard, and sibling branches whose counts below them (rest of the
path, label) do not differ from all siblings' by a chi-squared test, and whose labelled shares are close, merge into one. A template is rejected when the
smoothed share of bad labels among its labelled pages is high. Labels come from the rules and from a list of words in
path segments, so they differ within a host; what a template without labels is taken for comes from its parent's share, from
the same template on all other hosts, and from words in the host's name, none of which decides alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqedge.llm.common import ascii_lower, cut, quoted, table

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words (between dots, hyphens, underscores or the ends) that make a host suspect, and that label a page
#: whose path has them as bad.
BAD_HOST_WORDS = ["ads", "adult", "casino", "cheap", "free", "poker", "porn", "spam"]
BAD_PATH_WORDS = ["adult", "betting", "casino", "jackpot", "poker", "porn", "spam", "xxx"]


@dataclass(frozen=True)
class Tree:
    """levels: depth of the tree (deeper segments count as part of the last one). fan, support: children with fewer than
    ``support`` pages are variable where a node has more than ``fan``. strength, prior: pseudo-counts and their bad share
    in the smoothed purity; every page without label weighs ``doubt`` more pseudo-counts. apart: labelled shares that
    differ by more keep siblings apart, however few their pages. suspect: prior of hosts with a bad word. reject: least
    purity."""

    levels: int = 4
    fan: int = 12
    support: int = 8
    strength: float = 1.0
    prior: float = 0.25
    doubt: float = 0.1
    apart: float = 0.2
    suspect: float = 0.75
    reject: float = 0.6
    bad_words: list[str] = field(default_factory=lambda: list(BAD_HOST_WORDS))
    bad_path_words: list[str] = field(default_factory=lambda: list(BAD_PATH_WORDS))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    return rule, said


def _level(shapes: DataFrame, d: int, tree: Tree) -> DataFrame:
    """Generalise segment ``d`` of the templates ``t`` of (host, shape, t, n, bad, good)."""
    parent = F.concat_ws("/", F.slice("t", 1, d - 1)) if d > 1 else F.lit("")
    rest = F.expr(f"concat_ws('/', slice(t, {d + 1}, greatest(size(t), 1)))")
    here = shapes.withColumns({"up": parent, "seg": F.coalesce(F.try_element_at("t", F.lit(d)), F.lit("")), "rest": rest})
    # rare children of a wide node
    child = here.groupBy("host", "up", "seg").agg(F.sum("n").alias("c"))
    wide = child.groupBy("host", "up").agg(F.count("*").alias("fan")).filter(F.col("fan") > tree.fan).select("host", "up")
    rare = child.filter(F.col("c") < tree.support).join(wide, ["host", "up"], "left_semi").select("host", "up", "seg", F.lit(True).alias("rare"))
    here = here.join(rare, ["host", "up", "seg"], "left").withColumn("seg", F.when(F.col("rare") & (F.col("seg") != ""), "*").otherwise(F.col("seg"))).drop("rare")
    here = cut(here, "url-level")
    # chi-squared of each child's cells against all siblings': sum o^2 / e - n, over the cells that occur
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("o")) for k, c in (("bad", "bad"), ("good", "good"))],
                              F.struct(F.lit("none").alias("kind"), (F.col("n") - F.col("bad") - F.col("good")).alias("o"))))
    cells = here.select("host", "up", "seg", F.xxhash64("rest").alias("rest"), kinds.alias("x")).select("host", "up", "seg", "rest", "x.kind", "x.o").filter(
        "o > 0").groupBy("host", "up", "seg", "rest", "kind").agg(F.sum("o").alias("o"))
    pooled = cells.groupBy("host", "up", "rest", "kind").agg(F.sum("o").alias("pool"))
    share = lambda kind, name: F.sum(F.when(F.col("kind") == kind, F.col("o")).otherwise(0)).alias(name)
    totals = cells.groupBy("host", "up").agg(F.sum("o").alias("all"), share("bad", "all_bad"), share("good", "all_good"), F.count_distinct("seg").alias("fan"), F.count_distinct("rest", "kind").alias("cells"))
    own = cells.groupBy("host", "up", "seg").agg(F.sum("o").alias("c"), share("bad", "c_bad"), share("good", "c_good"))
    ratio = F.col("o") * F.col("o") * F.col("all") / (F.col("c") * F.col("pool"))
    test = (cells.join(pooled, ["host", "up", "rest", "kind"]).join(own, ["host", "up", "seg"]).join(totals, ["host", "up"])
            .filter(" and ".join(f"abs(c_{k} / c - all_{k} / all) <= {tree.apart}" for k in ("bad", "good")))
            .groupBy("host", "up", "seg", "c", "fan", "cells").agg(F.sum(ratio).alias("s")))
    free = F.col("cells") - 1
    merged = test.filter((F.col("fan") > 1) & (F.col("s") - F.col("c") <= free + 3 * F.sqrt(2 * free)) & (F.col("seg") != "")).select(
        "host", "up", "seg", F.lit(True).alias("merged"))
    out = here.join(merged, ["host", "up", "seg"], "left").withColumn("seg", F.when(F.col("merged"), "*").otherwise(F.col("seg")))
    head = F.slice("t", 1, d - 1) if d > 1 else F.array().cast("array<string>")
    t = F.when(F.size("t") < d, F.col("t")).otherwise(F.concat(head, F.array("seg"), F.expr(f"slice(t, {d + 1}, size(t))")))
    return cut(out.select("host", "shape", t.alias("t"), "n", "bad", "good"), "url-level")


def templates(parsed: DataFrame, tree: Tree) -> DataFrame:
    """(host, shape, template, purity, rejected) from rows (host, shape, bad, good: 0 or 1)."""
    shapes = parsed.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    parts = F.split(F.regexp_replace("shape", "^/", ""), "/")
    t = F.when(F.size(parts) <= tree.levels, parts).otherwise(F.concat(F.slice(parts, 1, tree.levels - 1), F.array(F.concat_ws("/", F.expr(
        f"slice(split(regexp_replace(shape, '^/', ''), '/'), {tree.levels}, size(split(shape, '/')))")))))
    shapes = cut(shapes.withColumn("t", t).select("host", "shape", "t", "n", "bad", "good"), "url-shapes")
    for d in range(1, tree.levels + 1):
        shapes = _level(shapes, d, tree)
    up = F.concat(F.lit("/"), F.concat_ws("/", F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))))
    named = shapes.withColumn("template", F.concat(F.lit("/"), F.concat_ws("/", "t"))).withColumn("up", up)
    sums = lambda by, **more: named.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")], *[x.alias(k) for k, x in more.items()])
    own = sums(["host", "template"], up=F.min("up"))
    # back-off: the host's name, the parent (its pages without label count as the name says), the template elsewhere
    name = F.when(F.col("host").rlike(word_pattern(tree.bad_words)), tree.suspect).otherwise(tree.prior)
    parent = sums(["host", "up"]).select("host", "up", ((F.col("bad") + name * (F.col("n") - F.col("bad") - F.col("good") + tree.strength)) / (F.col("n") + tree.strength)).alias("above"))
    world = sums(["template"]).select("template", *[F.col(c).alias("all_" + c) for c in ("n", "bad", "good")])
    there = own.join(parent, ["host", "up"]).join(world, "template")
    other = {c: F.col("all_" + c) - F.col(c) for c in ("n", "bad", "good")}
    far = other["bad"] + other["good"] + tree.strength + tree.doubt * (other["n"] - other["bad"] - other["good"])
    elsewhere = (other["bad"] + tree.prior * (far - other["bad"] - other["good"])) / far
    prior = F.when(other["n"] > 0, (name + F.col("above") + elsewhere) / 3).otherwise((name + F.col("above")) / 2)
    weight = F.col("bad") + F.col("good") + tree.strength + tree.doubt * (F.col("n") - F.col("bad") - F.col("good"))
    judged = there.withColumn("purity", (F.col("bad") + prior * (weight - F.col("bad") - F.col("good"))) / weight)
    judged = judged.select("host", "template", "purity", (F.col("purity") >= tree.reject).alias("rejected"))
    return cut(named.select("host", "shape", "template").join(judged, ["host", "template"]), "url-templates")


def word_pattern(words: list[str]) -> str:
    return r"(^|[/._-])(" + "|".join(words) + r")([/._-]|$)"


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, tree: Tree = Tree()) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) per input row.

    A null url, or one without ``://``, has an empty host and path; all such pages are one template. Repeated rows and
    equal or null keys are judged one by one; an empty table gives no rows; other columns play no part.
    """
    host, path = host_path(quoted(url))
    parsed = pages.select(quoted(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "said": said, "shape": F.regexp_replace("path", "[0-9]+", "#")})
    label = F.coalesce(F.col("said"), F.when(F.lower("path").rlike(word_pattern(tree.bad_path_words)), "block"), F.lit(""))
    known = templates(parsed.select("host", "shape", (label == "block").cast("long").alias("bad"), (label == "allow").cast("long").alias("good")), tree)
    verdict = F.coalesce(F.col("said"), F.when(F.col("rejected"), "block").otherwise("allow"))
    return parsed.join(known, ["host", "shape"], "left").select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op6_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
