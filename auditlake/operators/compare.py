"""Gates, health, baselines and differences of check results (name, passed, score, threshold, severity, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: check -> (metric, comparison, default threshold), in the order of evaluation of the report.
GATES = {
    "crap": ("avg_crap", "<=", 30.0), "debt": ("total", "<=", 100.0), "doc_coverage": ("coverage_pct", ">=", 50.0), "complexity": ("violations", "<=", 0.0), "taint": ("violations_count", "<=", 0.0), "duplication": ("total_groups", "<=", 5.0),
    "riskmap": ("risk_score", "<=", 10.0), "coupling": ("avg_fan_out", "<=", 5.0), "propcov": ("coverage_percentage", ">=", 0.0), "fuzz": ("fuzzable_functions", "<=", 0.0), "linelen": ("violations", "<=", 0.0), "halstead": ("files_exceeding_bugs_threshold", "<=", 0.0),
    "secrets": ("findings_count", "<=", 0.0), "deadcode": ("total_findings", "<=", 10.0), "sast": ("total_findings", "<=", 0.0), "crypto": ("total_findings", "<=", 0.0), "licenses": ("violations", "<=", 0.0), "outdated": ("major_behind", "<=", 0.0),
    "typecov": ("files_below_threshold", "<=", 0.0), "vulnscan": ("critical_and_high", "<=", 0.0), "cohesion": ("violations", "<=", 5.0), "comments": ("files_below_threshold", "<=", 0.0), "errhandle": ("total_findings", "<=", 50.0),
}
SECURITY, COMPLIANCE = ("taint", "secrets", "sast", "crypto", "vulnscan"), ("licenses", "sbom")
FIXES = {
    "crap": "Cover complex functions with tests or split them.", "debt": "Turn markers into tracked issues.", "doc_coverage": "Document public items.", "complexity": "Split functions with many branches.", "taint": "Keep sensitive values out of logs.", "duplication": "Extract what functions share.",
    "riskmap": "Simplify files that change often.", "coupling": "Depend on fewer modules.", "propcov": "State properties for functions.", "fuzz": "Write harnesses for functions that read raw input.", "linelen": "Split long functions and files.", "halstead": "Split dense files.", "secrets": "Move secrets to the environment.",
    "deadcode": "Remove what nothing uses.", "sast": "Validate input before it is used.", "crypto": "Use current algorithms.", "licenses": "Replace denied packages.", "outdated": "Update major versions.", "typecov": "Annotate functions.", "vulnscan": "Update vulnerable packages.", "cohesion": "Split structs by their fields.",
    "comments": "Explain what isn't obvious.", "errhandle": "Handle errors where they occur.",
}


def gate(metric: Column, op: str, threshold: float) -> Column:
    return metric <= threshold if op == "<=" else metric >= threshold


def check(name: str, summary: DataFrame, threshold: float | None = None, metric: str | None = None) -> DataFrame:
    """One row (name, passed, score, threshold) from a one-row summary."""
    column, op, default = GATES[name]
    t = default if threshold is None else float(threshold)
    m = F.coalesce(F.col(metric or column).cast("double"), F.lit(0.0))
    return summary.select(F.lit(name).alias("name"), gate(m, op, t).alias("passed"), m.alias("score"), F.lit(t).alias("threshold"))


def average_verdict(score: Column, most: float) -> Column:
    """pass, warning up to 1.5 times the limit, error beyond."""
    return F.when(score <= most, "pass").when(score <= 1.5 * most, "warning").otherwise("error")


def weight(name: Column) -> Column:
    return F.when(name.isin(*SECURITY), 3).when(name.isin(*COMPLIANCE), 2).otherwise(1)


def health(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(score, grade): passed weight in percent, whole numbers; without checks 100 and A."""
    w = weight(F.col("name"))
    total, good = F.sum(w), F.sum(F.when(F.col("passed"), w).otherwise(0))
    g = checks.groupBy(*(by or [])).agg(F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(100).cast("long")).otherwise(F.floor(good * 100 / F.nullif(total, F.lit(0)))).cast("long").alias("score"))
    s = F.col("score")
    return g.withColumn("grade", F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 65, "C").when(s >= 50, "D").otherwise("F"))


def fixes(checks: DataFrame) -> DataFrame:
    """(name, suggestion) of failed checks."""
    table = F.create_map(*[F.lit(x) for k, v in FIXES.items() for x in (k, v)])
    return checks.where("NOT passed").select("name", table[F.col("name")].alias("suggestion")).where("suggestion IS NOT NULL")


def new_findings(now: DataFrame, before: DataFrame) -> DataFrame:
    """Findings whose (file, line, rule_id) the baseline hasn't; without a file only the rule counts."""
    key = lambda d: d.withColumn("__k", F.coalesce(F.concat_ws(":", F.col("file"), F.col("line").cast("string"), "rule_id"), F.col("rule_id")) if {"file", "line"} <= set(d.columns) else F.col("rule_id"))
    keyed = lambda d: key(d).withColumn("__k", F.when(F.col("file").isNull(), F.col("rule_id")).otherwise(F.col("__k"))) if "file" in d.columns else key(d)
    return keyed(now).join(keyed(before).select("__k"), "__k", "left_anti").drop("__k")


def report_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(name, change): fixed, broken, same, new or gone for each check of either report."""
    b, n = before.select("name", F.col("passed").alias("b")), now.select("name", F.col("passed").alias("n"))
    change = F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "gone").when(~F.col("b") & F.col("n"), "fixed").when(F.col("b") & ~F.col("n"), "broken").otherwise("same")
    return b.join(n, "name", "full_outer").select("name", change.alias("change"))


def regressions(before: DataFrame, now: DataFrame) -> DataFrame:
    """Checks that passed and don't any more."""
    return report_diff(before, now).where("change = 'broken'").select("name")


def lost_tools(before: DataFrame, now: DataFrame) -> DataFrame:
    """Tools that succeeded before and don't now."""
    return before.where("success").select("tool").distinct().join(now.where("success").select("tool"), "tool", "left_anti")


OFFENDER_KEYS = ("items", "violations", "functions", "findings", "files", "groups")


def offenders(checks: DataFrame, top: int = 5) -> DataFrame:
    """(name, n, item): the first items of the first array among ``OFFENDER_KEYS`` in a check's details (a JSON string)."""
    arrays = [F.from_json(F.get_json_object("details", f"$.{k}"), "array<string>") for k in OFFENDER_KEYS]
    first = F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])
    return checks.select("name", F.posexplode(F.slice(first, 1, top)).alias("n", "item"))


def history_last(history: DataFrame, n: int = 10, order: str = "ts") -> DataFrame:
    """The last n runs, oldest first (a report; the limit is the feature)."""
    return history.orderBy(F.desc(order), F.desc("run_id")).limit(n).orderBy(order, "run_id")


def changed_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that are new or whose modification time or size differs from the cache (path, last_modified, size)."""
    c = cache.select(F.col("path").alias("file"), F.col("last_modified").alias("__m"), F.col("size").alias("__s"))
    d = files.join(c, "file", "left")
    return d.where(F.col("__m").isNull() | (F.col("__m") != F.col("last_modified")) | (F.col("__s") != F.col("size"))).drop("__m", "__s")


def islands(rows: DataFrame, key: str = "file", line: str = "line") -> DataFrame:
    """(key, first, last) of runs of consecutive lines; null lines are a run of their own.

    One shuffle and one sort serve all windows, and nothing is hashed: a task holds its sorted rows, which Spark spills.
    """
    from pyspark.sql import Window

    w, x = Window.partitionBy(key).orderBy(line), F.col(line)
    d = rows.select(key, line).withColumns({"prev": F.lag(line).over(w), "any": F.lag(F.lit(True)).over(w)})
    d = d.where(F.col("any").isNull() | ~F.equal_null("prev", line)).drop("any").withColumn("next", F.lead(line).over(w))
    begins, ends = F.col("prev").isNull() | (F.col("prev") < x - 1), F.col("next").isNull() | x.isNull() | (x < F.col("next") - 1)
    d = d.select(key, line, begins.alias("begins"), ends.alias("ends")).where("begins OR ends").withColumn("next", F.lead(line).over(w))
    return d.where("begins").select(key, x.alias("first"), F.when(F.col("ends"), x).otherwise(F.col("next")).alias("last"))
