"""Fetch-log decisions over archived pages: usable pages, outcomes, what still needs fetching, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import urls

ROBOTS_UNREACHABLE = "robots_unreachable"
ROBOTS_DISALLOW = "robots_disallow"


def usable(status: Column, body: Column) -> Column:
    """A page is usable when it answered 200 and has a body."""
    return F.coalesce((status == 200) & body.isNotNull(), F.lit(False))


def outcomes(homes: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome per store and scan from its home page: `home_failed`, `not_platform`, `scanned`, or `exception`.

    `homes` has status, skip_reason, html, is_platform and, where a step failed, `error`.
    """
    ok = usable(F.col("status"), F.col("html")) & F.col("skip_reason").isNull()
    state = (
        F.when(F.col("error").isNotNull(), "exception")
        .when(~ok, "home_failed")
        .when(~F.coalesce("is_platform", F.lit(False)), "not_platform")
        .otherwise("scanned")
    )
    return homes.select(*keys, state.alias("outcome"))


def outcome_counts(per_store: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Run statistics: scanned, skipped (home failed), not on the platform, failures."""
    return per_store.groupBy(*(by or [])).agg(
        F.count_if(F.col("outcome") == "scanned").alias("scanned"),
        F.count_if(F.col("outcome") == "home_failed").alias("skipped"),
        F.count_if(F.col("outcome") == "not_platform").alias("not_platform"),
        F.count_if(F.col("outcome") == "exception").alias("failures"),
    )


def undetermined(stores: DataFrame) -> DataFrame:
    """Stores whose platform verdict is still open, in domain order."""
    return stores.where(F.col("is_platform").isNull()).orderBy("domain")


def latest_fetch(log: DataFrame, fetch_ord: str = "fetch_ord") -> DataFrame:
    """The last log row per (scan_date, panel_version, url), whatever its outcome."""
    keys = ["scan_date", "panel_version", "url"]
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), fetch_ord).alias("r"))
    return picked.select(*keys, "r.*")


def cached_bodies(log: DataFrame, fetch_ord: str = "fetch_ord") -> DataFrame:
    """The last same-day 200 answer with a body per (url, day)."""
    good = log.where(usable(F.col("status"), F.col("html"))).withColumn("fetched_on", F.to_date("fetched_at"))
    rest = [c for c in good.columns if c not in ("url", "fetched_on")]
    picked = good.groupBy("url", "fetched_on").agg(F.max_by(F.struct(*rest), fetch_ord).alias("r"))
    return picked.select("url", "fetched_on", "r.*")


def frontier_dedupe(frontier: DataFrame, log: DataFrame) -> DataFrame:
    """Frontier rows (scan_date, panel_version, url) that need a fetch: not logged in the scan, no same-day body."""
    logged = log.select("scan_date", "panel_version", "url")
    bodies = cached_bodies(log).select("url", F.col("fetched_on").alias("scan_date"))
    return frontier.join(logged, ["scan_date", "panel_version", "url"], "left_anti").join(bodies, ["url", "scan_date"], "left_anti")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """Robots bodies (host, status, body) to one row per rule: host, rule_ord, path, allow, crawl_delay.

    Agent lines open a group, rules fill it, an empty line closes it. The first group naming the agent
    applies, else the first `*` group. A host whose body could not be read has no rules here.
    """
    readable = robots.where((F.col("status") >= 200) & (F.col("status") < 300) & F.col("body").isNotNull())
    parsed = F.transform(
        F.split("body", r"\r\n|\r|\n"),
        lambda x: F.struct(
            F.when(x == "", "blank")
            .otherwise(F.lower(F.trim(F.regexp_extract(x, r"^([^:#]*):", 1))))
            .alias("field"),
            F.trim(F.regexp_extract(x, r"^[^:#]*:([^#]*)", 1)).alias("value"),
        ),
    )
    known = F.filter(parsed, lambda r: r["field"].isin("blank", "user-agent", "allow", "disallow", "crawl-delay"))
    no_rows = F.array().cast("array<struct<group:int,field:string,value:string>>")
    zero = F.struct(F.lit(0).alias("group"), F.lit("closed").alias("state"), no_rows.alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        is_agent, is_blank = r["field"] == "user-agent", r["field"] == "blank"
        opens = is_agent & (acc["state"] != "agents")
        # A group cut off by an empty line before any rule is abandoned: its agents get no rules.
        group = acc["group"] + opens.cast("int")
        row = F.struct(group.alias("group"), r["field"].alias("field"), r["value"].alias("value"))
        kept = is_agent | (~is_blank & (acc["state"] != "closed"))
        return F.struct(
            group.alias("group"),
            F.when(is_blank, "closed").when(is_agent, "agents").when(kept, "rules").otherwise(acc["state"]).alias("state"),
            F.when(kept, F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"]).alias("rows"),
        )

    folded = readable.select("host", F.aggregate(known, zero, step, lambda acc: acc["rows"]).alias("_all"))
    ruled = F.transform(F.filter("_all", lambda r: r["field"] != "user-agent"), lambda r: r["group"])
    numbered = folded.withColumn("_ruled", ruled).select(
        "host", F.filter("_all", lambda r: F.array_contains(F.col("_ruled"), r["group"])).alias("rows")
    )
    wanted = agent.split("/")[0].lower()

    def group_of(name_test) -> Column:
        named = F.filter("rows", lambda r: (r["field"] == "user-agent") & name_test(F.lower(r["value"])))
        return F.array_min(F.transform(named, lambda r: r["group"]))

    mine = F.coalesce(
        group_of(lambda v: (v != "*") & (v != "") & F.lit(wanted).contains(v)), group_of(lambda v: v == "*")
    )
    chosen = numbered.withColumn("_mine", mine)
    own = chosen.select("host", F.filter("rows", lambda r: r["group"] == F.col("_mine")).alias("rows"))
    delay = F.get(F.filter("rows", lambda r: r["field"] == "crawl-delay"), F.lit(0))["value"]
    delay = F.when(delay.rlike(r"^[0-9]+$"), delay.try_cast("double"))
    rules = F.filter("rows", lambda r: r["field"].isin("allow", "disallow"))
    listed = own.select("host", delay.alias("crawl_delay"), F.posexplode_outer(rules).alias("rule_ord", "r"))
    return listed.select(
        "host",
        "rule_ord",
        F.col("r.value").alias("path"),
        # An empty disallow allows everything.
        ((F.col("r.field") == "allow") | (F.col("r.value") == "")).alias("allow"),
        "crawl_delay",
    )


def admit(frontier: DataFrame, rules: DataFrame, reachable_hosts: DataFrame) -> DataFrame:
    """Frontier URLs with `allowed`, `reason` and `crawl_delay`: the first rule whose path prefixes the URL's path decides.

    Hosts whose robots file could not be read are allowed with the reason `robots_unreachable`. Rules are
    gathered per host into one row (a robots file is at most a few hundred lines), so the join is one row
    per host and a host's URLs may be split over tasks.
    """
    per_host = rules.groupBy("host").agg(
        F.max("crawl_delay").alias("crawl_delay"),
        F.array_sort(
            F.collect_list(F.when(F.col("rule_ord").isNotNull(), F.struct("rule_ord", "path", "allow")))
        ).alias("_rules"),
    )
    known = reachable_hosts.select("host").distinct().join(per_host, "host", "left").withColumn("_known", F.lit(True))
    asked = frontier.withColumn("host", urls.host_of(F.col("url")))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = asked.withColumn("_path", F.when(path == "", "/").otherwise(path))
    joined = asked.join(known, "host", "left")
    first = F.get(
        F.filter(
            F.coalesce("_rules", F.array().cast("array<struct<rule_ord:int,path:string,allow:boolean>>")),
            lambda r: F.col("_path").startswith(r["path"]) | (r["path"] == "*"),
        ),
        F.lit(0),
    )
    allowed = F.coalesce(first["allow"], F.lit(True))
    return joined.select(
        *frontier.columns,
        "host",
        (F.col("_known").isNull() | allowed).alias("allowed"),
        F.when(F.col("_known").isNull(), ROBOTS_UNREACHABLE).when(~allowed, ROBOTS_DISALLOW).alias("reason"),
        "crawl_delay",
    )
