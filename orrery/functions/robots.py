"""robots.txt as columns: the rules for an agent are folded out of the lines once per file; paths are then only compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE = "struct<at: int, agents: array<string>, allow: boolean, path: string>"
STATE = f"struct<at: int, agents: array<string>, open: boolean, rules: array<{RULE}>>"


def rules(text: Column, agent: str = "*") -> Column:
    """array<struct<at, agents, allow, path>> for an agent: the rules of the first group that names it, else of the first for all.

    A group is a stretch of User-agent lines and the rules after it; comments and blank lines do not count. An empty
    Disallow allows everything. A missing or empty file has no rules.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    key = lambda x: F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1))))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    used = F.filter(lines, lambda x: F.contains(x, F.lit(":")) & key(x).isin("user-agent", "allow", "disallow"))

    def step(s: Column, x: Column) -> Column:
        named, path = F.lower(value(x)), value(x)
        rule = F.struct(s["at"].alias("at"), s["agents"].alias("agents"), ((key(x) == "allow") | (path == "")).alias("allow"), path.alias("path"))
        group = F.struct(F.when(s["open"], s["at"]).otherwise(s["at"] + 1).alias("at"), F.when(s["open"], F.concat(s["agents"], F.array(named))).otherwise(F.array(named)).alias("agents"), F.lit(True).alias("open"), s["rules"].alias("rules"))
        ruled = F.struct(s["at"].alias("at"), s["agents"].alias("agents"), F.lit(False).alias("open"), F.when(F.size(s["agents"]) > 0, F.concat(s["rules"], F.array(rule))).otherwise(s["rules"]).alias("rules"))
        return F.when(key(x) == "user-agent", group).otherwise(ruled)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast(f"array<{RULE}>").alias("rules"))
    found = F.aggregate(used, start.cast(STATE), lambda s, x: step(s, x).cast(STATE))["rules"]
    every = lambda r: F.array_contains(r["agents"], "*")
    first = lambda some: F.filter(some, lambda r: r["at"] == F.get(some, F.lit(0))["at"])
    own = F.filter(found, lambda r: ~every(r) & F.exists(r["agents"], lambda a: F.contains(F.lit(agent.lower().split("/")[0]), a)))
    return F.when(F.size(own) > 0, first(own)).otherwise(first(F.filter(found, every)))


def allowed(found: Column, path: Column) -> Column:
    """Whether rules allow a path: the first one that it starts with decides, else it is allowed."""
    return F.coalesce(F.get(F.filter(found, lambda r: F.startswith(path, r["path"])), F.lit(0))["allow"], F.lit(True))


def sitemaps(text: Column) -> Column:
    """Addresses in Sitemap lines, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
