"""Mutation testing without foreign programs: mutants, mutation points, scores of recorded runs, and what a change reaches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.files import rows_of_files
from auditlake.functions.lines import extension, lines_in_context, occurrences
from auditlake.functions.lineage import cut

SWAPS = [("+", "-"), ("-", "+"), ("*", "/"), ("/", "*"), ("==", "!="), ("!=", "=="), (">", "<"), ("<", ">"), (">=", "<="), ("<=", ">="), ("&&", "||"), ("||", "&&")]
BOOLEANS = [("true", "false"), ("false", "true")]
BOUNDARIES = [(" < ", " <= "), (" <= ", " < "), (" >= ", " > "), (" > ", " >= ")]
BITS = [(" ^ ", " | "), (" | ", " & "), (" << ", " >> "), (" >> ", " << "), (" & ", " | "), (" | ", " ^ ")]
ARITHMETIC = [(f"{a}_{op}", f"{b}_{op}") for a, b in (("wrapping", "checked"), ("saturating", "wrapping"), ("checked", "wrapping")) for op in ("add", "sub", "mul")]
#: (strategy, pattern, replacement, all occurrences)
MUTATORS = [("swap", a, b, True) for a, b in SWAPS] + [("boolean", a, b, True) for a, b in BOOLEANS] + [("boundary", a, b, False) for a, b in BOUNDARIES] + [("bitwise", a, b, False) for a, b in BITS] + [("arithmetic", a, b, True) for a, b in ARITHMETIC]


def mutants(files: DataFrame, limit: int | None = 5) -> DataFrame:
    """(id, file, line, strategy, description, mutated) of Rust lines, by mutator and line in each file; at most ``limit`` a file.

    Comment lines aren't mutated.  Ids number the mutants of each file.
    """
    x = F.col("text")

    def once(a: str, b: str) -> Column:
        at = F.locate(a, x)
        return F.concat(F.substring(x, F.lit(1), at - 1), F.lit(b), F.substring(x, at + len(a), F.length(x)))

    found = F.array_compact(F.array(*[
        F.when(F.contains(x, F.lit(a)), F.struct(F.lit(k).alias("k"), F.lit(s).alias("strategy"), F.lit(f"{a.strip()} -> {b.strip()}").alias("description"), (F.replace(x, F.lit(a), F.lit(b)) if every else once(a, b)).alias("mutated")))
        for k, (s, a, b, every) in enumerate(MUTATORS)
    ]))
    d = lines_in_context(files, exts=["rs"]).where(~F.startswith("t", F.lit("//"))).select("file", "line", F.explode(found).alias("m")).select("file", "line", "m.*")
    d = d.withColumn("id", F.row_number().over(Window.partitionBy("file").orderBy("k", "line")))
    return (d if limit is None else d.where(F.col("id") <= limit)).select("id", "file", "line", "strategy", "description", "mutated")


POINTS = {
    "py": ["==", "!=", "<=", ">=", " < ", " > ", " and ", " or ", "True", "False", " + ", " - ", " * ", " / "], "js": ["===", "!==", "==", "!=", "<=", ">=", "&&", "||", "true", "false", " + ", " - "],
    "go": ["==", "!=", "<=", ">=", "&&", "||", "true", "false", " + ", " - "], "java": ["==", "!=", "<=", ">=", "&&", "||", "true", "false", " + ", " - "],
}


def mutation_points(files: DataFrame) -> DataFrame:
    """(file, points): occurrences of what could be mutated, in languages without a runner."""
    ext = extension(F.col("file"))
    total = F.lit(0).cast("long")
    for lang, patterns in POINTS.items():
        here = ext.isin("js", "ts", "mjs", "tsx") if lang == "js" else ext == lang
        total = F.when(here, sum((occurrences(F.col("source"), F.lit(p)) for p in patterns), F.lit(0).cast("long"))).otherwise(total)
    return files.select("file", total.alias("points"))


def mutation_summary(results: DataFrame) -> DataFrame:
    """Counts and killed share in percent of a results table (id, file, line, status)."""
    n = F.count("*")
    count = lambda s: F.count_if(F.col("status") == s)
    return results.agg(n.alias("total_mutants"), *[count(s).alias(s) for s in ("killed", "survived", "timeout", "error")], F.when(n == 0, 0.0).otherwise(count("killed") / F.nullif(n, F.lit(0)) * 100.0).alias("mutation_score"))


# --- what a change reaches ------------------------------------------------------------------------


def ranges_of(source: str) -> list[tuple[str, int, int]]:
    """(function, first line, last line) by running sums of braces; of equal names the last counts."""
    out, current, depth = {}, None, 0
    for n, raw in enumerate(source.removesuffix("\n").split("\n"), 1):
        t = raw.strip()
        m = re.match(r"(?:pub(?:\([^)]*\))? )?(?:async |const |unsafe )*fn (\w+)", t)
        if m:
            current, depth = (m[1], n), t.count("{") - t.count("}")
        elif current:
            depth += t.count("{") - t.count("}")
        if current and depth <= 0:
            out[current[0]] = (current[1], n)
            current = None
    return [(k, a, z) for k, (a, z) in out.items()]


def function_ranges(files: DataFrame) -> DataFrame:
    d = files.where(extension(F.col("file")) == "rs").select("file", "source")
    return rows_of_files(d, "file string, name string, first bigint, last bigint", lambda f, s: [(f, *r) for r in ranges_of(s)], "file", "source")


def changed_functions(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """(file, name) of functions that a changed region (file, start_line, end_line) overlaps; a region's file may be the end of the path."""
    h = hunks.select(F.col("file").alias("h"), "start_line", "end_line", F.element_at(F.split("file", "/"), -1).alias("base"))
    r = ranges.withColumn("base", F.element_at(F.split("file", "/"), -1))  # the same last name makes it an equi-join
    on = (F.col("first") <= F.col("end_line")) & (F.col("start_line") <= F.col("last")) & F.endswith("file", F.col("h"))
    return r.join(h, "base").where(on).select("file", "name").distinct()


def calls(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(caller, callee) within each file: the callee's name stands before a bracket or a double colon, or behind &mut, on a line of the caller."""
    lines = lines_in_context(files, exts=["rs"]).where(~F.startswith("t", F.lit("//")) & ~F.startswith("t", F.lit("let "))).select("file", "line", "text")
    words = F.array_union(F.regexp_extract_all("text", F.lit(r"(\w+)(?=\(|::)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"&mut (\w+)"), F.lit(1)))
    named = lines.select("file", "line", F.explode(words).alias("callee"))
    caller = ranges.select("file", F.col("name").alias("caller"), "first", "last")
    known = ranges.select("file", F.col("name").alias("callee"))
    d = named.join(known, ["file", "callee"]).join(caller, "file").where((F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last")) & (F.col("caller") != F.col("callee")))
    return d.select("caller", "callee").distinct()


def affected(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, name): each seed and its transitive callers; each round joins only what the one before found."""
    known = cut(seeds.select(F.col("name").alias("seed"), "name").distinct())
    front = known
    while True:
        front = cut(front.join(edges, front.name == edges.callee).select("seed", F.col("caller").alias("name")).distinct().join(known, ["seed", "name"], "left_anti"))
        if front.isEmpty():
            return known
        known = cut(known.unionByName(front))


def reduction(mutants_: DataFrame, ranges: DataFrame, reached: DataFrame) -> DataFrame:
    """Mutants within affected functions, and the share of mutants that need no run, in percent."""
    hit = mutants_.join(ranges.join(reached.select("name").distinct(), "name", "left_semi"), "file").where((F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last"))).select("file", "id").distinct()
    total, left = mutants_.agg(F.count("*").alias("total")), hit.agg(F.count("*").alias("kept"))
    return total.crossJoin(left).withColumn("reduction_pct", F.when(F.col("total") == 0, 0.0).otherwise((F.col("total") - F.col("kept")) / F.nullif(F.col("total"), F.lit(0)) * 100.0))
