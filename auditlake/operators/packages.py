"""Packages: licenses, bill of materials, advisories, outdated dependencies.  (package, version, license, ecosystem) in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.scalars import license_class, xml_escape

DENY = ["AGPL-3.0", "AGPL-1.0", "GPL-3.0", "GPL-2.0", "GPL-1.0"]
ECOSYSTEMS = ["rust", "node", "python"]


def classify_licenses(packages: DataFrame, deny: list[str] = DENY) -> DataFrame:
    """All packages with license_category, violation and its reason (the first denied license that the upper-cased name holds)."""
    u = F.upper(F.coalesce("license", F.lit("")))
    reason = F.lit("")
    for d in reversed(deny):
        reason = F.when(F.contains(u, F.lit(d.upper())), f"license matches {d}").otherwise(reason)
    return packages.select("package", "version", "license", license_class(F.col("license")).alias("license_category"), (reason != "").alias("violation"), reason.alias("violation_reason"), "ecosystem")


def license_findings(packages: DataFrame, deny: list[str] = DENY) -> DataFrame:
    """Violations and copyleft only."""
    return classify_licenses(packages, deny).where(F.col("violation") | F.startswith("license_category", F.lit("copyleft")))


def license_summary(packages: DataFrame, deny: list[str] = DENY) -> DataFrame:
    c = classify_licenses(packages, deny)
    kind = F.col("license_category")
    return c.agg(F.count("*").alias("packages_scanned"), F.count_if("violation").alias("violations"), F.count_if(kind == "unknown").alias("unknown_licenses"), F.count_if(F.startswith(kind, F.lit("copyleft"))).alias("copyleft"), F.count_if(kind == "permissive").alias("permissive"))


def purl(name, version, ecosystem):
    scheme = F.when(ecosystem == "rust", "cargo").when(ecosystem == "node", "npm").otherwise("pypi")
    return F.concat(F.lit("pkg:"), scheme, F.lit("/"), F.when(ecosystem == "python", F.lower(name)).otherwise(name), F.lit("@"), version)


def components(packages: DataFrame) -> DataFrame:
    """(name, version, license, ecosystem, purl): one row a purl, that of the first ecosystem."""
    eco = F.col("ecosystem")
    order = F.when(eco == "rust", 0).when(eco == "node", 1).otherwise(2)
    d = packages.select(F.col("package").alias("name"), "version", F.coalesce(F.nullif(F.col("license"), F.lit("")), F.lit("NOASSERTION")).alias("license"), "ecosystem", purl(F.col("package"), F.col("version"), eco).alias("purl"), order.alias("o"))
    w = Window.partitionBy("purl").orderBy("o", "name", "license")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").drop("o", "r")


def cyclonedx(c: DataFrame) -> DataFrame:
    """One row a component: its CycloneDX element (key orders them; the sink puts head and foot around)."""
    e = lambda n: xml_escape(F.col(n))
    value = F.concat(F.lit('    <component type="library"><name>'), e("name"), F.lit("</name><version>"), e("version"), F.lit("</version><licenses><license><name>"), e("license"), F.lit("</name></license></licenses><purl>"), e("purl"), F.lit("</purl></component>"))
    return c.select(F.col("purl").alias("key"), value.alias("value"))


def spdx(c: DataFrame) -> DataFrame:
    """One row a component: its SPDX tag-value block."""
    name = F.concat(F.lit("PackageName: "), F.col("name"), F.lit("\nSPDXID: SPDXRef-"), F.col("name"), F.lit("-"), F.col("version"), F.lit("\nPackageVersion: "), F.col("version"))
    value = F.concat(name, F.lit("\nPackageLicenseDeclared: "), F.col("license"), F.lit("\nExternalRef: PACKAGE-MANAGER purl "), F.col("purl"), F.lit("\n"))
    return c.select(F.col("purl").alias("key"), value.alias("value"))


def cvss_severity(c):
    """Severity by digits that occur in the vector; unknown without one."""
    any_of = lambda *x: F.rlike(c, F.lit("|".join(v.replace(".", r"\.") for v in x)))
    return F.when(c.isNull(), "unknown").when(any_of("9.", "10."), "critical").when(any_of("7.", "8."), "high").when(any_of("4.", "5.", "6."), "medium").otherwise("low")


def cargo_advisories(feed: DataFrame) -> DataFrame:
    """Rows of a cargo audit feed: (value string) with the whole JSON report."""
    item = "struct<package:struct<name:string,version:string>,advisory:struct<id:string,title:string,url:string,cvss:string>>"
    d = feed.select(F.explode(F.from_json("value", f"vulnerabilities struct<list:array<{item}>>")["vulnerabilities"]["list"]).alias("v"))
    c = lambda p, default: F.coalesce(F.col(p), F.lit(default))
    return d.select(
        c("v.package.name", "unknown").alias("package"), c("v.package.version", "?").alias("version"), c("v.advisory.id", "?").alias("advisory_id"), cvss_severity(F.col("v.advisory.cvss")).alias("severity"),
        c("v.advisory.title", "?").alias("title"), F.col("v.advisory.url").alias("url"), F.lit("rust").alias("ecosystem"),
    )


def npm_advisories(feed: DataFrame) -> DataFrame:
    """Rows of an npm audit feed; only causes that are objects count."""
    d = feed.select(F.explode(F.from_json("value", "vulnerabilities map<string,struct<severity:string,range:string,via:array<string>>>")["vulnerabilities"]).alias("package", "v"))
    d = d.select("package", "v.severity", "v.range", F.explode("v.via").alias("x")).where(F.startswith("x", F.lit("{")))
    g = lambda k: F.get_json_object("x", f"$.{k}")
    return d.select("package", F.coalesce("range", F.lit("?")).alias("version"), F.coalesce(g("source"), F.lit("?")).alias("advisory_id"), F.coalesce("severity", F.lit("unknown")).alias("severity"), F.coalesce(g("title"), F.lit("?")).alias("title"), g("url").alias("url"), F.lit("node").alias("ecosystem"))


def safety_advisories(feed: DataFrame) -> DataFrame:
    """Rows of a safety feed: arrays of package, specs, version, advisory, id."""
    d = feed.select(F.explode(F.from_json("value", "array<array<string>>")).alias("a"))
    g = lambda k: F.coalesce(F.get("a", F.lit(k)), F.lit("?"))
    return d.select(g(0).alias("package"), g(2).alias("version"), g(4).alias("advisory_id"), F.lit("unknown").alias("severity"), F.substring(g(3), 1, 100).alias("title"), F.lit(None).cast("string").alias("url"), F.lit("python").alias("ecosystem"))


def vulnerability_summary(v: DataFrame) -> DataFrame:
    return v.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "unknown")], F.count("*").alias("total"))


def outdated(dependencies: DataFrame) -> DataFrame:
    """(name, current, latest, major_behind): whether the latest major version is higher; versions that aren't numbers aren't behind."""
    major = lambda c: F.split(c, "[.]")[0].try_cast("long")
    return dependencies.select("name", "current", "latest", F.coalesce(major(F.col("latest")) > major(F.col("current")), F.lit(False)).alias("major_behind"))
