"""URL filter: rules where they fit, else an empirical-Bayes reputation of the host.

Pages that a rule decides are the labelled outcomes (1: blocked). Each level's block rate has a beta
prior around the mean of the level above (all -> suffix -> registered domain -> host). Its strength is
estimated from the spread of the level's groups by moments. A page that no rule fits is blocked where
the lower posterior bound of its host's block rate (mean less z standard deviations of the beta posterior) is above the
limit; a host without outcomes has the wide posterior of the levels above it.

Everything is DataFrame operations. Counts are combined before the shuffle into one row for each host, written
once; the levels above are made from these. What comes back to the pages is joined by host, and sent to all
executors only where there are at most MOST_BROADCAST hosts; else a host with very many pages is split by the adaptive
join. Up to MOST_RULES rules are part of the plan; more are joined by the host's suffixes.

Null URLs, and those without ``://``, have an empty host and path and no rule. Of rules that tie in length
the last by host, path and verdict wins. Repeated rows each get a verdict; an empty table gives none; other columns are not read. A suffix is the last
label of the host and a registered domain the last two (``suffixes`` names longer public suffixes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import Scratch

MOST_RULES = 500
MOST_BROADCAST = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a scheme."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def match(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct<rule,verdict> of the longest (host, path, verdict) rule that fits, else null."""
    out: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def level_keys(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    suffix = F.substring_index(host, ".", -1)
    for name in sorted(suffixes, key=len):
        suffix = F.when((host == name) | host.endswith(f".{name}"), name).otherwise(suffix)
    extra = F.size(F.split(suffix, r"\.")) + 1
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) <= extra, host).otherwise(F.array_join(F.slice(labels, -extra, extra), "."))
    return domain, suffix


def strength(groups: DataFrame, least: float = 2.0, most: float = 200.0) -> DataFrame:
    """One row: the beta prior's weight by moments, from (n, bad) of a level's groups, within [least, most]."""
    g = groups.where("n > 0").select("n", (F.col("bad") / F.col("n")).alias("rate"))
    m = g.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rate")).alias("bad"), F.sum(F.col("n") * F.col("rate") * F.col("rate")).alias("sq"), F.count("*").alias("k"))
    mean = F.col("bad") / F.col("n")
    spread = F.greatest(F.col("sq") / F.col("n") - mean * mean, F.lit(1e-9))
    within = mean * (1 - mean) * F.col("k") / F.col("n")
    between = F.greatest(spread - within, F.lit(1e-9))
    return m.select(F.coalesce(F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(least)), F.lit(most)), F.lit(most)).alias("weight"))


def matched_by_join(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``fit`` as ``match`` gives it: each host gets the rules of its suffixes, of which the longest whose path fits is taken."""
    table = rows.sparkSession.createDataFrame(rules, "name string, prefix string, verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    entry = F.struct((F.length("name") + F.length("prefix")).alias("size"), "name", "prefix", "verdict")
    of_host = rows.select("host").distinct().select("host", F.explode(suffixes).alias("name")).join(table, "name").groupBy("host").agg(F.collect_list(entry).alias("__rules"))
    best = F.array_max(F.filter("__rules", lambda r: F.col("path").startswith(r["prefix"])))
    fit = F.when(best.isNotNull(), F.struct(F.concat(best["name"], best["prefix"]).alias("rule"), best["verdict"].alias("verdict")))
    return rows.join(of_host, "host", "left").withColumn("fit", fit).drop("__rules")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", limit: float = 0.5, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """id, host, path, rule, verdict, block_rate and block_bound (posterior mean and lower bound for the host)."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", match(rules, F.col("host"), F.col("path")).alias("fit")) if len(rules) <= MOST_RULES else matched_by_join(rows, rules)
    domain, suffix = level_keys(F.col("host"), suffixes)
    # one row for each host; the rest of the work is on these
    hosts = rows.groupBy("host").agg(F.count("fit").alias("n"), F.count_if(F.col("fit.verdict") == "block").alias("bad"))
    hosts = scratch.save(hosts.select("*", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # one job for the few numbers that describe the levels
    rate = (F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)
    facts = hosts.agg(rate.cast("double").alias("x"), F.count("*").alias("rows")).withColumn("level", F.lit("all"))
    for name, level in (("top", tops), ("domain", domains), ("host", hosts)):
        facts = facts.unionByName(strength(level).select(F.col("weight").alias("x"), F.lit(0).cast("long").alias("rows"), F.lit(name).alias("level")))
    known = {r["level"]: r for r in facts.collect()}

    def shrunk(level: DataFrame, name: str, up: Column) -> DataFrame:
        weight = F.lit(known[name]["x"])
        return level.withColumns({"mean": (F.col("bad") + weight * up) / (F.col("n") + weight), "weight": weight})

    tops = shrunk(tops, "top", F.lit(known["all"]["x"])).select("suffix", F.col("mean").alias("up"))
    domains = shrunk(domains.join(tops, "suffix"), "domain", F.col("up")).select("domain", F.col("mean").alias("up"))
    few = known["all"]["rows"] <= MOST_BROADCAST
    # there are at most as many domains as hosts
    hosts = shrunk(hosts.join(F.broadcast(domains) if few else domains, "domain"), "host", F.col("up"))
    size = F.col("n") + F.col("weight")
    hosts = hosts.select("host", F.col("mean").alias("block_rate"), (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("block_bound"))
    judged = rows.join(F.broadcast(hosts) if few else hosts, "host", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("block_bound") > limit, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "block_rate", "block_bound")
