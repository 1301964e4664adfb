"""URL filter: rules first, then trust and distrust carried over the graph of hosts.

A rule is a host and a path.  It fits that host and its subdomains where the path starts with the rule's; the
longest fitting rule decides.  Pages that no rule fits are judged by their host.  Trust starts at hosts with allowed pages
and follows links (personalised PageRank); distrust starts at hosts with blocked pages and goes against links, to
those who link there.  A host's links are the absolute ones in its pages; besides, each host is tied both ways to the
domains above it, down to two labels.  A host is blocked when distrust is more than ``MAX_DISTRUST`` of both together.

Edges are counted per pair of hosts before they meet, so a host with a third of all pages is a few rows; ranks are
sums with a map-side part.  Only hosts are iterated, pages come back once.

Defined cases: null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed, as are hosts that
neither trust nor distrust reaches; null html has no links; repeated rows are judged each for itself (and their
links count each); an empty table gives no rows; only named columns are read and added names avoid theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditloom.llm.common import fresh
from auditloom.plans.lineage import cut

#: Rounds, the share of rank that restarts at the seeds, rounds between writes, the bound on distrust.
ROUNDS, RESTART, PER_WRITE, MAX_DISTRUST = 12, 0.25, 4, 0.5
#: Absolute and protocol-relative targets of links.
TARGET = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; ``rules``: verdict, host, path."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")))


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """src, dst, n: links between different hosts and ties to the domains above."""
    links = (pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(TARGET), F.lit(1)))).alias("to"))
             .select("src", F.translate("to", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    links = links.where("src <> dst and src <> '' and dst <> ''")
    every = pages.select(F.col(host).alias("h")).union(links.select("dst")).where("h <> ''").distinct()
    labels = F.split("h", r"\.")
    above = every.select("h", F.explode(F.filter(
        F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
        lambda x: F.instr(x, ".") > 0)).alias("up"))
    ties = above.select(F.col("h").alias("src"), F.col("up").alias("dst"), F.lit(1).alias("n"))
    ties = ties.union(ties.select("dst", "src", "n"))
    return links.union(ties).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, trust, distrust.  ``seeds``: kind (trust or distrust), node, mass (sums to 1 per kind)."""
    way = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    total = way.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    way = cut(way.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    seeds = cut(seeds)
    start = seeds.select("kind", "node", (F.col("mass") * RESTART).alias("mass"))
    rank = seeds
    for k in range(ROUNDS):
        moved = (rank.withColumnRenamed("node", "src").join(way, ["kind", "src"])
                 .select("kind", F.col("dst").alias("node"), (F.col("mass") * F.col("share") * (1 - RESTART)).alias("mass")))
        rank = moved.union(start).groupBy("kind", "node").agg(F.sum("mass").alias("mass"))
        if (k + 1) % PER_WRITE == 0:
            rank = cut(rank)
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0))
    return rank.groupBy(F.col("node").alias("host")).agg(part("trust").alias("trust"), part("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], keep: list[str], url: str = "url", html: str = "html") -> tuple[DataFrame, dict[str, str]]:
    """Columns ``keep`` with host, path, rule, verdict, trust, distrust, and the names these were given."""
    parts = ("host", "path", "rule", "verdict", "trust", "distrust")
    names = dict(zip(parts, fresh(pages.columns, *parts), strict=True))
    host, path = host_and_path(F.col(url))
    m, src = fresh([*pages.columns, *names.values()], "match", "node")
    rows = pages.withColumns({names["host"]: host, names["path"]: path}).withColumn(m, matched(F.col(names["host"]), F.col(names["path"]), rules))
    seeds = (rows.where(F.col(m)["verdict"].isNotNull())
             .groupBy(F.when(F.col(m)["verdict"] == "allow", "trust").otherwise("distrust").alias("kind"), F.col(names["host"]).alias("node"))
             .agg(F.count(F.lit(1)).alias("pages")))
    total = seeds.groupBy("kind").agg(F.sum("pages").alias("total"))
    seeds = seeds.join(F.broadcast(total), "kind").select("kind", "node", (F.col("pages") / F.col("total")).alias("mass"))  # two rows
    found = cut(propagate(host_edges(rows, names["host"], html), seeds)).toDF(src, names["trust"], names["distrust"])
    out = rows.select(*keep, names["host"], names["path"], m).join(found, F.col(names["host"]) == F.col(src), "left")
    t, d = (F.coalesce(F.col(names[x]), F.lit(0.0)) for x in ("trust", "distrust"))
    own = F.when(d > MAX_DISTRUST * (t + d), "block").otherwise("allow")
    return out.select(*keep, names["host"], names["path"], F.col(m)["rule"].alias(names["rule"]),
                      F.coalesce(F.col(m)["verdict"], own).alias(names["verdict"]), t.alias(names["trust"]), d.alias(names["distrust"])), names
