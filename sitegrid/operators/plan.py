"""Planning tables: weekly plan, workload, URL plan, production order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .audit import severity_rank, stage_rank
from .ranking import running, top_per_key

KEY = ["run_id", "site"]


def effort_points(effort: str = "effort") -> Column:
    return reduce(lambda c, kv: c.when(F.col(effort) == kv[0], kv[1]), V.EFFORT_POINTS.items(),
                  F.when(F.lit(False), 0)).otherwise(3)


def build_plan(findings: DataFrame, points_per_week: int = 10, start: str = "2026-01-05",
               by: list[str] = KEY) -> DataFrame:
    """Stage, then severity, then effort; weeks filled in order, an item that does
    not fit opens the next one.

    A site has at most one finding per rule, so its ordered list is a small
    array and the filling is a fold over it.
    """
    by = list(by)
    item = F.struct(stage_rank().alias("s"), severity_rank().alias("v"), effort_points().alias("p"), "rule")
    lists = findings.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(1).alias("week"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("weeks"))

    def place(acc: Column, x: Column) -> Column:
        opens = (acc["used"] > 0) & (acc["used"] + x["p"] > points_per_week)
        week = F.when(opens, acc["week"] + 1).otherwise(acc["week"])
        used = F.when(opens, x["p"]).otherwise(acc["used"] + x["p"])
        return F.struct(week.alias("week"), used.alias("used"), F.concat(acc["weeks"], F.array(week)).alias("weeks"))

    folded = lists.withColumn("w", F.aggregate("items", zero, place)["weeks"])
    rows = folded.select(*by, F.posexplode(F.arrays_zip("items", "w")).alias("n", "z")).select(
        *by, (F.col("n") + 1).alias("position"), F.col("z.items.rule").alias("rule"),
        F.col("z.items.p").alias("points"), F.col("z.w").alias("week"))
    info = findings.select(*by, "rule", "stage", "severity", "effort", "owner")
    return rows.join(info, [*by, "rule"]).withColumn(
        "week_start", F.date_format(F.date_add(F.lit(start).cast("date"), (F.col("week") - 1) * 7), "yyyy-MM-dd"))


def plan_stages(plan: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Per stage: items, points, first and last week, and whether it blocks."""
    return plan.groupBy(*by, "stage").agg(
        F.count("*").alias("items"), F.sum("points").alias("points"), F.min("week").alias("first_week"),
        F.max("week").alias("last_week"), F.bool_or(F.col("severity").isin("Critical", "High")).alias("blocking"))


def workload(findings: DataFrame, assignments: DataFrame, people: DataFrame) -> DataFrame:
    """Points, items and weeks of work per person; work assigned to nobody comes
    under a NULL person. ``assignments``: rule, person; ``people``: person, capacity."""
    owned = findings.withColumn("points", effort_points()).join(assignments.select("rule", "person"), "rule", "left")
    load = owned.groupBy("person").agg(F.sum("points").alias("points"), F.count("*").alias("items"))
    named = people.select("person", "capacity").join(load, "person", "left").fillna(0, ["points", "items"])
    nobody = load.filter(F.col("person").isNull()).select(
        "person", F.lit(None).cast(people.schema["capacity"].dataType).alias("capacity"), "points", "items")
    out = named.select("person", "capacity", "points", "items").unionByName(nobody)
    weeks = F.when(F.col("capacity") > 0, F.round(F.col("points") / F.col("capacity"), 1))
    return out.withColumn("weeks", weeks).withColumn(
        "note", F.when(F.col("person").isNull(), "unassigned").when(weeks.isNull(), "no capacity")
        .when(weeks > 3, "queue").when(weeks > 0, "sprint").otherwise("free"))


def suggest_assignee(findings: DataFrame, people: DataFrame) -> DataFrame:
    """First person (by name) whose role is the finding's owner."""
    first = people.groupBy(F.col("role").alias("owner")).agg(F.min("person").alias("person"))
    return findings.join(first, "owner", "left")


# --- new sites -----------------------------------------------------------------------------

def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "['’]", ""), "&", "and")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-|-$", "")


def cluster_template(label: Column, intent: Column) -> Column:
    t = F.lower(F.concat_ws(" ", label, intent))
    out = F.when(F.lit(False), "")
    for name, rx, also in V.CLUSTER_TEMPLATES:
        cond = t.rlike(rx)
        out = out.when((cond | (intent == also)) if also else cond, name)
    return out.otherwise("article")


def cluster_url_plan(clusters: DataFrame, origin: str = "https://example.com") -> DataFrame:
    """Section hubs, pillars and spokes with URL, depth and template.
    ``clusters``: label, intent, pages."""
    base = reduce(lambda c, kv: c.when(F.col("template") == kv[0], kv[1]), V.TEMPLATE_BASE.items(),
                  F.when(F.lit(False), "")).otherwise("")
    schema = reduce(lambda c, kv: c.when(F.col("template") == kv[0], kv[1]), V.TEMPLATE_SCHEMA.items(),
                    F.when(F.lit(False), "")).otherwise("")
    c = clusters.withColumn("template", cluster_template(F.col("label"), F.col("intent"))).withColumns({
        "base": base, "schema": schema,
        "n": F.greatest(F.lit(1), F.coalesce("pages", F.lit(1))).cast("int")})
    prefix = F.concat(F.lit(origin), F.when(F.col("base") == "", F.lit("")).otherwise(
        F.concat(F.lit("/"), F.col("base"))), F.lit("/"), slug(F.col("label")), F.lit("/"))
    depth = F.when(F.col("base") == "", 1).otherwise(2)
    spokes = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    pages = c.select("label", "template", "schema", "base", prefix.alias("root"), depth.alias("d"), "n", spokes).select(
        F.when(F.col("i") == 0, F.col("root")).otherwise(
            F.concat("root", F.lit("subtopic-"), F.col("i").cast("string"), F.lit("/"))).alias("url"),
        "label", "template",
        F.when(F.col("i") > 0, "spoke").when(F.col("n") > 1, "pillar").otherwise("standalone").alias("role"),
        F.when(F.col("i") > 0, F.col("d") + 1).otherwise(F.col("d")).alias("depth"), "schema",
        F.when(F.col("i") > 0, F.col("root")).when(F.col("base") == "", F.lit(f"{origin}/")).otherwise(
            F.concat(F.lit(f"{origin}/"), F.col("base"), F.lit("/"))).alias("links_to"))
    hubs = c.filter(F.col("base") != "").groupBy("template", "base").agg(F.count("*").alias("k")).filter(
        "k > 1").select(
        F.concat(F.lit(f"{origin}/"), F.col("base"), F.lit("/")).alias("url"), F.lit("").alias("label"),
        F.concat("template", F.lit("-index")).alias("template"), F.lit("section").alias("role"),
        F.lit(1).alias("depth"), F.lit("BreadcrumbList,CollectionPage").alias("schema"),
        F.lit(f"{origin}/").alias("links_to"))
    return pages.unionByName(hubs).withColumn("too_deep", F.col("depth") > 3)


def production_order(clusters: DataFrame, pages_per_week: int = 2, by: list[str] = ()) -> DataFrame:
    """Clusters by 3 x winnability + 2 x value - difficulty, each taking the next
    whole weeks. ``clusters``: by..., label, pages, winnability, value, difficulty."""
    by = list(by)

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(3)) if c in clusters.columns else F.lit(3)

    size = F.coalesce(F.nullif(F.col("pages"), F.lit(0)), F.lit(1))
    scored = clusters.withColumns({
        "score": n("winnability") * 3 + n("value") * 2 - n("difficulty"),
        "weeks": F.ceil(size / F.lit(pages_per_week)).cast("bigint")}).withColumn("_o", -F.col("score"))
    if not by:
        scored = scored.withColumn("_k", F.lit(0))
    out = running(scored, by or ["_k"], ["_o", "label"], F.col("weeks"), "_end")
    return out.select(*by, "label", size.alias("pages"), "score",
                      (F.col("_end") - F.col("weeks") + 1).alias("start_week"), F.col("_end").alias("end_week"))


def first_items(plan: DataFrame, n: int = 3, by: list[str] = KEY) -> DataFrame:
    return top_per_key(plan, list(by), [F.col("position")], n)
