"""Inputs as relations: source trees, version-control logs, coverage, manifests, reports."""

from __future__ import annotations

import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.lines import extension, has

SKIPPED = ("target", "node_modules", "fixtures")
REPORT = "passed boolean, path string, checks array<struct<name:string,passed:boolean,score:double,threshold:double,message:string,details:string,severity:string,help:string,rule_id:string>>, summary string"
BATCH = "run_id string, started_at string, duration_ms bigint, tools array<struct<tool:string,success:boolean,duration_ms:bigint,error:string>>, summary string"
HISTORY = "ts bigint, run_id string, passed bigint, failed bigint, tools map<string,struct<success:boolean,duration_ms:bigint>>"


def source_files(spark: SparkSession, path: str, recursive: bool = False, exts: list[str] | None = None) -> DataFrame:
    """(file, source, last_modified, size) of a tree; skips build, vendored and hidden folders below ``path``.

    Texts that aren't UTF-8 are dropped.  Without ``recursive`` only top-level files are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    d = reader.load(path)
    file = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    root = str(Path(path).resolve()) if "://" not in path else path.rstrip("/")
    inner = F.regexp_replace(F.substring(file, len(root) + 1, 1 << 20), r"^/", "")
    parts = F.slice(F.split(inner, "/"), 1, F.greatest(F.size(F.split(inner, "/")) - 1, F.lit(0)))
    d = d.where(~F.exists(parts, lambda p: p.isin(*SKIPPED) | F.startswith(p, F.lit("."))))
    if exts is not None:
        d = d.where(extension(file).isin(exts))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return d.select(file.alias("file"), text.alias("source"), F.unix_timestamp("modificationTime").alias("last_modified"), F.col("length").alias("size")).where("source IS NOT NULL")


def ignored(file: Column, patterns: list[str]) -> Column:
    """Whether a path matches one: ``dir/`` (a component), ``*.ext``, ``**/x``, a glob, or a name (of the file, a component or the path's end)."""
    out = F.lit(False)
    for p in (x.strip() for x in patterns):
        if not p or p.startswith("#"):
            continue
        quoted = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else ("\\" + c if c in r"\.+()[]{}^$|" else c) for c in p.removeprefix("**/").removesuffix("/"))
        if p.endswith("/"):
            rule = F.rlike(file, F.lit(f"(^|/){quoted}/"))
        elif p.startswith("*."):
            rule = F.endswith(file, F.lit(p[1:]))
        else:
            rule = F.rlike(file, F.lit(f"(^|/){quoted}(/|$)"))
        out = out | rule
    return out


def churn(log: DataFrame, since: Column | None = None) -> DataFrame:
    """(file, churn) of a log (commit, author, ts, file); hidden paths don't count."""
    d = log.where(~F.startswith("file", F.lit(".")) & (F.col("file") != ""))
    return (d if since is None else d.where(F.col("ts") >= since)).groupBy("file").agg(F.count("*").alias("churn"))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(file, start_line, end_line) of unified diffs given as (diff, n, text) lines in order n."""
    w = Window.partitionBy("diff").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("file", F.last(F.nullif(F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.+)$", 1), F.lit("")), True).over(w))
    g = lambda k: F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", k)
    d = d.where(F.startswith("text", F.lit("@@"))).select("file", g(1).try_cast("long").alias("start_line"), F.coalesce(F.nullif(g(2), F.lit("")).try_cast("long"), F.lit(1)).alias("k"))
    return d.where((F.col("k") > 0) & F.col("start_line").isNotNull()).select("file", "start_line", (F.col("start_line") + F.col("k") - 1).alias("end_line"))


def demangled(name: Column) -> Column:
    """The last path element of a Rust v0 symbol (_R...), else the name itself."""
    def last(x: str | None) -> str | None:
        if x is None or not x.startswith("_R"):
            return x
        parts, k = [], 2
        while k < len(x):
            if x[k].isdigit():
                z = k
                while z < len(x) and x[z].isdigit():
                    z += 1
                size, z = int(x[k:z]), z + (x[z : z + 1] == "_")
                parts.append(x[z : z + size])
                k = z + size
            else:
                k += 1
        return parts[-1] if parts else x

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(last)

    return F.when(F.startswith(name, F.lit("_R")), run(name)).otherwise(name)


def lcov(lines: DataFrame) -> DataFrame:
    """(function, line, hits) of LCOV lines (text): hits of equal names are added, and mangled names count under both."""
    t = F.col("text")
    fn = lines.where(F.startswith(t, F.lit("FN:"))).select(F.regexp_extract(t, r"^FN:(\d+),(.*)$", 2).alias("function"), F.regexp_extract(t, r"^FN:(\d+),", 1).try_cast("long").alias("line"), F.lit(0).cast("long").alias("hits"))
    da = lines.where(F.startswith(t, F.lit("FNDA:"))).select(F.regexp_extract(t, r"^FNDA:(\d+),(.*)$", 2).alias("function"), F.lit(None).cast("long").alias("line"), F.regexp_extract(t, r"^FNDA:(\d+),", 1).try_cast("long").alias("hits"))
    d = fn.unionByName(da).where("function <> ''")
    d = d.select(F.explode(F.array_distinct(F.array("function", demangled(F.col("function"))))).alias("function"), "line", "hits")
    return d.groupBy("function").agg(F.min("line").alias("line"), F.sum("hits").alias("hits"))


def cargo_lock(lines: DataFrame) -> DataFrame:
    """(package, version, license, ecosystem) of lock files given as (file, line, text)."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = F.btrim("text")
    d = lines.withColumn("block", F.sum((t == "[[package]]").cast("int")).over(w)).where("block > 0")
    value = lambda k: F.max(F.when(F.startswith(t, F.lit(f"{k} =")), F.regexp_extract(t, r'"([^"]*)"', 1)))
    g = d.groupBy("file", "block").agg(value("name").alias("package"), value("version").alias("version"))
    return g.where("package IS NOT NULL AND version IS NOT NULL").select("package", "version", F.lit(None).cast("string").alias("license"), F.lit("rust").alias("ecosystem"))


def cargo_licenses(lines: DataFrame) -> DataFrame:
    """(package, license) of the [package] sections of manifests (file, line, text); of equal names the last file counts."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = F.btrim("text")
    d = lines.withColumn("section", F.last(F.when(F.startswith(t, F.lit("[")), t), True).over(w)).where("section = '[package]'")
    value = lambda k: F.max(F.when(F.rlike(t, F.lit(rf"^{k}\s*=")), F.regexp_extract(t, r'"([^"]*)"', 1)))
    g = d.groupBy("file").agg(value("name").alias("package"), value("license").alias("license")).where("package IS NOT NULL AND license IS NOT NULL")
    return g.groupBy("package").agg(F.max_by("license", "file").alias("license"))


def npm_lock(docs: DataFrame) -> DataFrame:
    """Packages of lock files (value): ``packages`` by path, else ``dependencies`` by name."""
    s = "struct<version:string,license:string>"
    d = docs.select(F.from_json("value", f"packages map<string,{s}>, dependencies map<string,{s}>").alias("j"))
    d = d.select(F.explode(F.coalesce(F.col("j.packages"), F.col("j.dependencies"))).alias("path", "p")).where("path <> ''")
    return d.select(F.regexp_replace("path", r"^.*node_modules/", "").alias("package"), F.coalesce("p.version", F.lit("?")).alias("version"), F.col("p.license").alias("license"), F.lit("node").alias("ecosystem"))


def npm_manifest(docs: DataFrame) -> DataFrame:
    """Dependencies of package.json texts (value), without the caret or tilde of their versions."""
    d = docs.select(F.explode(F.from_json("value", "dependencies map<string,string>")["dependencies"]).alias("package", "v"))
    return d.select("package", F.regexp_replace("v", r"^[\^~]+", "").alias("version"), F.lit(None).cast("string").alias("license"), F.lit("node").alias("ecosystem"))


def requirements(lines: DataFrame) -> DataFrame:
    """Packages of requirement lines (text); comments, options and blanks are no packages."""
    t = F.btrim("text")
    d = lines.where((t != "") & ~F.startswith(t, F.lit("#")) & ~F.startswith(t, F.lit("-")))
    name = F.btrim(F.regexp_extract(t, r"^([^=<>!~;\[ ]+)", 1))
    version = F.coalesce(F.nullif(F.regexp_extract(t, r"[=<>!~]=?\s*([\w.*+-]+)", 1), F.lit("")), F.lit("unknown"))
    return d.select(name.alias("package"), version.alias("version"), F.lit(None).cast("string").alias("license"), F.lit("python").alias("ecosystem")).where("package <> ''")


def check_report(spark: SparkSession, path: str) -> DataFrame:
    """Checks of reports, a row each."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path).select("path", F.explode("checks").alias("c")).select("path", "c.*")


def batch_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCH).option("multiLine", True).json(path).select("run_id", F.explode("tools").alias("t")).select("run_id", "t.*")


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def thresholds(text: str) -> dict[str, dict]:
    """Sections of a TOML configuration; unknown keys are kept, values that are negative raise ValueError."""
    out = {k: v for k, v in tomllib.loads(text).items() if isinstance(v, dict)}
    for section, values in out.items():
        for key, v in values.items():
            if isinstance(v, (int, float)) and not isinstance(v, bool) and v < 0:
                raise ValueError(f"{section}.{key} is negative")
    return out


def project_kinds(files: DataFrame) -> DataFrame:
    """Distinct ecosystems by marker files."""
    f = F.element_at(F.split("file", "/"), -1)
    kind = F.when(f.isin("Cargo.toml", "Cargo.lock"), "rust").when(f == "package.json", "node").when(f.isin("requirements.txt", "pyproject.toml", "setup.py", "Pipfile"), "python").when(f == "go.mod", "go")
    return files.select(kind.alias("ecosystem")).where("ecosystem IS NOT NULL").distinct()


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "SparkSession", "Window", "F", "Path", "tomllib", "pd", "annotations", "extension", "has")]
