"""The facade: analyzers by name over files(file, source), their summaries and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators import analyzers as a
from auditlake.operators import code, compare, metrics

ANALYZERS: dict[str, tuple[Callable[..., DataFrame], str]] = {}


def register_analyzer(name: str, f: Callable[..., DataFrame], about: str = "") -> None:
    """Adds ``f(files, **arguments) -> DataFrame``."""
    ANALYZERS[name] = (f, about)


for _name, _f, _about in [
    ("comments", a.comment_stats, "comment ratio of files"), ("halstead", a.halstead, "Halstead's numbers of files"), ("sast", a.sast, "risky calls"), ("crypto", a.crypto, "weak cryptography"), ("secrets", a.secrets, "hard-coded secrets"), ("debt", a.debt, "debt markers"),
    ("errhandle", a.error_handling, "swallowed errors"), ("deadcode", a.dead_code, "unused code"), ("typecov", a.type_coverage, "type annotations"), ("taint", a.taint, "sensitive values in sinks"), ("linelen", lambda files, **k: a.long_functions(code.functions(files), **k), "long functions"),
    ("long_files", a.long_files, "long files"), ("crap", lambda files, coverage=None: metrics.crap_scores(code.functions(files), coverage), "complexity against coverage"), ("complexity", lambda files: code.functions(files), "complexity of functions"),
    ("doccov", lambda files: code.doc_items(files), "documented items"), ("dupfind", lambda files, **k: metrics.duplicates(code.fingerprints(files), **k), "alike functions"), ("coupling", lambda files: metrics.coupling(metrics.workspace_edges(code.imports(files))), "fan-in and fan-out"),
    ("cohesion", metrics.cohesion, "components of structs"), ("propcov", lambda files: metrics.property_coverage(metrics.tests(files)), "property tests"),
]:
    register_analyzer(_name, _f, _about)


def list_tools() -> list[dict[str, str]]:
    return [{"name": n, "description": about} for n, (_, about) in sorted(ANALYZERS.items())]


def call(name: str, files: DataFrame, **arguments) -> DataFrame:
    if name not in ANALYZERS:
        raise KeyError(f"no analyzer {name!r}; there are {', '.join(sorted(ANALYZERS))}")
    return ANALYZERS[name][0](files, **arguments)


def functions_where(files: DataFrame, condition) -> DataFrame:
    """Functions for which a Column, SQL string or callable over the functions relation holds."""
    d = code.functions(files)
    return d.where(condition(d) if callable(condition) else condition)


def run_checks(files: DataFrame, only: list[str] | None = None, skip: list[str] | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(name, passed, score, threshold) of the gates that need nothing but files; ``only`` wins over ``skip``."""
    n = lambda df, column="total_findings": df.agg(F.count("*").alias(column))
    summaries: dict[str, Callable[[], DataFrame]] = {
        "crap": lambda: metrics.crap_summary(metrics.crap_scores(code.functions(files), skip=())), "debt": lambda: n(a.debt_check(files), "total"), "doc_coverage": lambda: metrics.doc_summary(code.doc_items(files)), "complexity": lambda: metrics.complexity_summary(code.functions(files)),
        "taint": lambda: n(a.taint(files), "violations_count"), "halstead": lambda: a.halstead_summary(a.halstead(files)), "secrets": lambda: n(a.secrets(files), "findings_count"), "deadcode": lambda: n(a.dead_code(files)), "sast": lambda: n(a.sast(files)), "crypto": lambda: n(a.crypto(files)),
        "comments": lambda: a.comment_summary(a.comment_stats(files)), "errhandle": lambda: n(a.error_handling(files)), "cohesion": lambda: metrics.cohesion_summary(metrics.cohesion(files)), "propcov": lambda: metrics.property_summary(metrics.tests(files)),
        "coupling": lambda: (lambda e: metrics.coupling_summary(metrics.coupling(e), e))(metrics.workspace_edges(code.imports(files))), "linelen": lambda: n(a.long_files(files).select("file").unionAll(a.long_functions(code.functions(files)).select("file")), "violations"),
    }
    names = [k for k in summaries if (k in only if only else k not in (skip or []))]
    out = None
    for k in names:
        row = compare.check(k, summaries[k](), (thresholds or {}).get(k))
        out = row if out is None else out.unionByName(row)
    return out
