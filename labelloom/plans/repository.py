"""Store queries: latest versions, search, details, dashboards, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, at: str, *tie: str) -> DataFrame:
    """The last stored row per key (null times first, ties by the given columns).

    A partial aggregate finds the winner on narrow rows, so a hot key is no hot task.
    """
    v = F.struct(F.coalesce(F.col(at).cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800))).alias("_at"), F.xxhash64(*tie).alias("_h"))
    s = rows.where(F.col(key).isNotNull()).withColumn("_v", v)
    last = s.groupBy(key).agg(F.max("_v").alias("_v"))
    return s.join(last, [key, "_v"], "left_semi").dropDuplicates([key]).drop("_v")


def search(scans: DataFrame, text: str | None = None, verdict: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of scans, newest first: any-case search in name and category, equality on verdict."""
    s = scans
    if text:
        s = s.where(F.col("product_name").ilike(f"%{text}%") | F.col("category").ilike(f"%{text}%"))
    if verdict:
        s = s.where(F.col("verdict") == verdict)
    s = s.select("scan_id", "created_at", "product_name", "category", "verdict", "n_violations")
    return s.orderBy(F.desc("created_at"), "scan_id").offset(offset).limit(limit)


def latest_by_code(scans: DataFrame, code: Column) -> DataFrame:
    """(code, scan_id, created_at): the newest scan of each code, leading zeros ignored."""
    s = scans.select(F.regexp_replace(code, "^0+", "").alias("code"), "scan_id", "created_at").where("code <> ''")
    return s.groupBy("code").agg(F.max(F.struct("created_at", "scan_id")).alias("m")).select("code", "m.scan_id", "m.created_at")


def details(scans: DataFrame, actions: DataFrame) -> DataFrame:
    """(scan_id, product_name, n_actions, last_action, history): scans with what people did, in order."""
    w = F.array_sort(F.collect_list(F.struct("acted_at", "action_id", "action_taken")))
    acts = actions.groupBy("scan_id").agg(F.count("*").alias("n_actions"), F.max(F.struct("acted_at", "action_id", "action_taken")).alias("m"), w.alias("h"))
    history = F.concat_ws(">", F.transform("h", lambda x: x["action_taken"]))
    return scans.join(acts, "scan_id", "left").select("scan_id", "product_name", F.coalesce("n_actions", F.lit(0)).alias("n_actions"), F.col("m.action_taken").alias("last_action"), F.coalesce(history, F.lit("")).alias("history"))


def top_rules(findings: DataFrame, n: int = 15) -> DataFrame:
    """The rules with most violations; the citation is the least one."""
    return findings.where("outcome = 'VIOLATION'").groupBy("rule_id").agg(F.min("citation").alias("citation"), F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(n)


def daily(scans: DataFrame, days: int = 30) -> DataFrame:
    """(day, n, bad) of the last days with scans."""
    d = F.date_format("created_at", "yyyy-MM-dd")
    return scans.groupBy(d.alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "non_compliant").alias("bad")).orderBy(F.desc("day")).limit(days)


def last_event_open(events: DataFrame, key: str, at: str, tie: str, opening: Column, closing: Column) -> DataFrame:
    """(key, is_open): whether the last opening event of a key has no closing one after it."""
    t = F.struct(at, tie)
    return events.groupBy(key).agg(F.max(F.when(opening, t)).alias("o"), F.max(F.when(closing, t)).alias("c")).select(key, (F.col("o").isNotNull() & (F.col("c").isNull() | (F.col("o") > F.col("c")))).alias("is_open"))


def credentials(users: DataFrame, registry: DataFrame, uid: str, name: str) -> DataFrame:
    """Registry rows that match a typed uid (any case, trimmed) and name (any case), active ones only."""
    u = users.select(F.upper(F.trim(uid)).alias("_u"), F.lower(F.trim(name)).alias("_n")).distinct()
    r = registry.where("status = 'active'").withColumn("_u", F.upper(F.trim("uid"))).withColumn("_n", F.lower(F.trim("full_name")))
    return r.join(u, ["_u", "_n"], "left_semi").drop("_u", "_n")


def expired(scans: DataFrame, as_of: str, days: int) -> DataFrame:
    """Scans older than so many days at a given day."""
    return scans.where(F.col("created_at") < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))


def retained(findings: DataFrame, gone: DataFrame) -> DataFrame:
    """Findings whose scan stays; actions are kept apart and always stay."""
    return findings.join(gone.select("scan_id").distinct(), "scan_id", "left_anti")


def unmatched(findings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Findings that nobody acted on."""
    return findings.join(reviewed.select("scan_id", "rule_id").distinct(), ["scan_id", "rule_id"], "left_anti")


def ranked_views(findings: DataFrame) -> DataFrame:
    """(scan_id, n_shown, worst, rules): a scan's findings without the inapplicable, worst first."""
    order = F.when(F.col("outcome") == "VIOLATION", 0).when(F.col("outcome") == "INDETERMINATE", 1).otherwise(2)
    sev = F.upper(F.trim("severity"))
    rank = F.when(sev == "CRITICAL", 0).when(sev == "MAJOR", 1).otherwise(2)
    f = findings.where("outcome <> 'NOT_APPLICABLE'").select("scan_id", order.alias("o"), rank.alias("r"), "rule_id").distinct()
    lists = F.array_sort(F.collect_list(F.struct("o", "r", "rule_id")))
    out = f.groupBy("scan_id").agg(F.count("*").alias("n_shown"), F.min(F.struct("o", "r", "rule_id")).alias("m"), lists.alias("l"))
    return out.select("scan_id", "n_shown", F.col("m.rule_id").alias("worst"), F.array_join(F.transform("l", lambda x: x["rule_id"]), ",").alias("rules"))


def verdicts(findings: DataFrame) -> DataFrame:
    """(scan_id, n_violation, n_undecided, n_ok, compliant): three-valued; null while anything is undecided."""
    f = findings.select("scan_id", "rule_id", "outcome").distinct()
    c = f.groupBy("scan_id").agg(F.count_if(F.col("outcome") == "VIOLATION").alias("n_violation"), F.count_if(F.col("outcome") == "INDETERMINATE").alias("n_undecided"), F.count_if(F.col("outcome") == "COMPLIANT").alias("n_ok"))
    return c.withColumn("compliant", F.when(F.col("n_violation") > 0, False).when(F.col("n_undecided") > 0, None).when(F.col("n_ok") > 0, True))


def first_finding(findings: DataFrame) -> DataFrame:
    """The first recorded finding per scan and rule."""
    w = Window.partitionBy("scan_id", "rule_id").orderBy("recorded_at", "finding_id")
    return findings.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
