"""robots.txt as a table of rules, and whether URLs are allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import urls as U


def robots_lines(files: DataFrame) -> DataFrame:
    """files(robots_url, content) -> robots_url, line, field, value of lines that say something."""
    raw = files.select("robots_url", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("line", "raw"))
    clean = U.trimmed(F.regexp_replace("raw", "#.*$", ""))
    out = raw.withColumn("_c", clean).where(F.col("_c").rlike("^[A-Za-z-]+ *:"))
    return out.select("robots_url", "line", F.lower(U.trimmed(F.regexp_extract("_c", "^[^:]*", 0))).alias("field"), U.trimmed(F.regexp_extract("_c", "^[^:]*:(.*)$", 1)).alias("value"))


def robots_rules(files: DataFrame) -> DataFrame:
    """origin, agent (lower case), allow, path for each rule; a group's agents are the User-agent lines before it.

    Windows run within a file, which a fetcher bounds."""
    order = Window.partitionBy("robots_url").orderBy("line")
    said = robots_lines(files).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    starts = (F.col("field") == "user-agent") & (F.lag("field").over(order).isNull() | (F.lag("field").over(order) != "user-agent"))
    said = said.withColumn("_start", starts.cast("int")).withColumn("group", F.sum("_start").over(order))
    agents = said.where("field = 'user-agent'").select("robots_url", "group", F.lower("value").alias("agent")).distinct()
    rules = said.where("field in ('allow', 'disallow') and group > 0").select("robots_url", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    out = rules.where("path != ''").join(agents, ["robots_url", "group"])
    return out.select(U.origin("robots_url").alias("origin"), "agent", "allow", "path").distinct()


def crawl_delays(files: DataFrame) -> DataFrame:
    """origin, agent, delay_s: the first Crawl-delay of each agent."""
    order = Window.partitionBy("robots_url").orderBy("line")
    said = robots_lines(files).withColumn("agent", F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(order))
    found = said.where("field = 'crawl-delay' and agent is not null").select(U.origin("robots_url").alias("origin"), "agent", "line", F.expr("try_cast(value as double)").alias("delay_s"))
    return found.where("delay_s is not null").groupBy("origin", "agent").agg(F.min_by("delay_s", "line").alias("delay_s"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    return robots_lines(files).where("field = 'sitemap' and value != ''").select("robots_url", F.col("value").alias("sitemap_url")).distinct()


def rule_regex(path: Column | str) -> Column:
    """A rule's path as a regular expression: * is anything, $ at the end is the end."""
    p = F.col(path) if isinstance(path, str) else path
    escaped = F.regexp_replace(p, r"([\\.\[\]{}()+?^|])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(escaped, r"\$$", ""), r"\*", ".*")
    body = F.regexp_replace(body, r"\$", r"\\\$")
    return F.concat(F.lit("(?s)^"), body, F.when(p.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def robots_allowed(requests: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """requests (all rows, columns kept) with robots_allowed: the longest rule that fits decides, allow wins ties; no
    rule: allowed. Rules of the agent's own group, else of *.

    Distinct (origin, path) pairs meet the rules of their origin; a host that a third of the rows has is met once per
    distinct URL, and per URL only the best rule is kept while they are counted up."""
    name = agent.lower()
    own = rules.where(F.col("agent") != "*").where(F.lit(name).contains(F.col("agent"))) if agent != "*" else rules.limit(0)
    # Of several groups that are meant, the most specific: the longest name.
    best = own.groupBy("origin").agg(F.max(F.length("agent")).alias("_n"))
    own = own.join(best, "origin").where(F.length("agent") == F.col("_n")).drop("_n")
    rest = rules.where("agent = '*'").join(own.select("origin").distinct(), "origin", "left_anti")
    used = own.unionByName(rest).select("origin", "allow", "path", rule_regex("path").alias("_re"))
    keyed = requests.withColumn("_o", U.origin(url)).withColumn("_p", U.let(U.parsed(url), lambda p: F.concat(F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), p["query"])))
    asked = keyed.where("_o is not null").select("_o", "_p").distinct()
    hit = asked.join(used, asked["_o"] == used["origin"]).where(F.expr("_p rlike _re"))
    best = hit.groupBy("_o", "_p").agg(F.max_by("allow", F.struct(F.length("path"), F.col("allow"))).alias("_a"))
    return keyed.join(best, ["_o", "_p"], "left").withColumn("robots_allowed", F.coalesce("_a", F.lit(True))).select(*requests.columns, "robots_allowed")

