"""Outputs: reports, SARIF, graphs, bills of materials, history.  Large results are written by tasks; summaries by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scalars import approximate_date


def ndjson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def report_json(items: DataFrame, summary: DataFrame, name: str = "findings") -> DataFrame:
    """One row: {name: [items], "summary": {...}} (for results that fit one document)."""
    i = items.agg(F.collect_list(F.struct(*items.columns)).alias(name))
    return i.crossJoin(summary.select(F.struct(*summary.columns).alias("summary"))).select(F.to_json(F.struct(name, "summary"), {"ignoreNullFields": "false"}).alias("value"))


def check_lines(checks: DataFrame) -> DataFrame:
    """Failed checks as JSON lines: a line for each item of ``details.items``, or one for the check."""
    items = F.from_json(F.get_json_object("details", "$.items"), "array<string>")
    each = F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(None).cast("string")))
    d = checks.where("NOT passed").select("name", "severity", "message", F.explode(each).alias("item"))
    return d.select(F.to_json(F.struct("name", "severity", "message", "item")).alias("value"))


LEVELS = {"critical": "error", "high": "error", "error": "error", "medium": "warning", "warning": "warning", "low": "note"}


def level(c):
    out = F.lit("note")
    for k, v in LEVELS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def sarif_results(findings: DataFrame, camel: bool = True) -> DataFrame:
    """One JSON result a finding (file, line, rule_id, severity, context), with camel-case or snake-case keys."""
    n = (lambda a, b: a) if camel else (lambda a, b: b)
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias(n("artifactLocation", "artifact_location")), F.struct(F.greatest(F.col("line"), F.lit(1)).alias(n("startLine", "start_line"))).alias("region")).alias(n("physicalLocation", "physical_location")))
    r = F.struct(F.col("rule_id").alias(n("ruleId", "rule_id")), level(F.col("severity")).alias("level"), F.struct(F.col("context").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("rule_id", F.to_json(r).alias("value"))


def sarif(findings: DataFrame, tool: str, version: str = "1.0", camel: bool = True) -> str:
    """A whole SARIF 2.1.0 log; rules are distinct and sorted."""
    rows = sarif_results(findings, camel).orderBy("rule_id", "value").collect()
    rules = ",".join(f'{{"id":"{r}"}}' for r in sorted({r.rule_id for r in rows}))
    body = ",".join(r.value for r in rows)
    return f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":[{rules}]}}}},"results":[{body}]}}]}}'


def dot(edges: DataFrame) -> DataFrame:
    """Lines of a graph of modules, each by its last path element."""
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    return edges.select(F.concat(F.lit('  "'), last("source_module"), F.lit('" -> "'), last("imported_module"), F.lit('";')).alias("value"))


def cyclonedx_document(lines: DataFrame) -> str:
    body = "\n".join(r.value for r in lines.orderBy("key").collect())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<bom xmlns="http://cyclonedx.org/schema/bom/1.4" version="1">\n  <components>\n{body}\n  </components>\n</bom>\n'


def spdx_document(blocks: DataFrame, name: str) -> str:
    head = f"SPDXVersion: SPDX-2.3\nDataLicense: CC0-1.0\nSPDXID: SPDXRef-DOCUMENT\nDocumentName: {name}\n\n"
    return head + "\n".join(r.value for r in blocks.orderBy("key").collect())


def markdown(df: DataFrame, title: str, limit: int = 30) -> str:
    """A table of the first rows (a report; the limit is the feature)."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join(out + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def html(df: DataFrame, title: str, limit: int = 30) -> str:
    from html import escape

    rows = df.limit(limit).collect()
    cells = lambda r, tag: "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in r)
    body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{cells(df.columns, 'th')}</tr>{body}</table></body></html>"


def text_table(df: DataFrame, width: int = 40, limit: int = 30) -> str:
    """Fixed columns; a longer value keeps its right end."""
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]
    cut = lambda v: v if len(v) <= width else "…" + v[1 - width :]
    rows = [df.columns, *[[cut(v) for v in r] for r in rows]]
    size = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(size[k]) for k, v in enumerate(r)).rstrip() for r in rows)


def append_history(runs: DataFrame, path: str) -> None:
    """Appends (ts, run_id, passed, failed, tools) below a folder for each month."""
    runs.withColumn("month", F.substring(approximate_date(F.col("ts")), 1, 7)).write.mode("append").partitionBy("month").json(path)
