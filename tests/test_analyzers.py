"""Analyzers on small sources of our own, and on a second formulation where one is short."""

import json
import random

import pytest
from pyspark.sql import functions as F

from auditlake import api, sources
from auditlake.functions import scalars
from auditlake.functions.lines import explode_lines
from auditlake.operators import analyzers as an
from auditlake.operators import code, compare, metrics, mutants, packages
from auditlake.plans import catalogue
from auditlake.plans.samples import SAMPLES
from auditlake.sources import sinks
from auditlake.streaming import watch


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(SAMPLES.items()), "file string, source string").cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lines(spark):
    d = spark.createDataFrame([("a", "x\r\ny\n"), ("b", ""), ("c", "\n"), ("d", "p\n\nq")], "file string, source string")
    assert rows(explode_lines(d), "file", "line", "text") == [("a", 1, "x"), ("a", 2, "y"), ("c", 1, ""), ("d", 1, "p"), ("d", 2, ""), ("d", 3, "q")]


def test_functions_and_complexity(files):
    got = {(r.file, r.name): r for r in code.functions(files).collect()}
    assert got["app/store.rs", "helper"].complexity >= 4 and got["app/store.rs", "parse"].line == got["app/store.rs", "parse"].end_line
    assert got["tool/job.py", "run"].complexity == 4 and got["tool/job.py", "later"].complexity == 3
    assert got["srv/main.go", "Load"].complexity == 3 and ("web/page.js", "greet") in got and ("tool/test_job.py", "<anonymous>") in got
    assert got["lib/Main.java", "main"].complexity == 3


def test_doc_items_imports_names(files):
    items = {(r.file, r.name): (r.kind, r.documented) for r in code.doc_items(files).collect()}
    assert items["app/store.rs", "Store"] == ("struct", True) and items["app/store.rs", "add"] == ("impl_fn", False)
    assert items["tool/job.py", "run"] == ("fn", True) and items["tool/job.py", "plain"] == ("fn", False) and items["srv/main.go", "Load"] == ("fn", True)
    imports = {(r.source_module, r.imported_module) for r in code.imports(files).collect()}
    assert imports >= {("app/store.rs", "crate::model::Item"), ("tool/job.py", "unused_name"), ("web/page.js", "./view"), ("web/page.js", "fs"), ("srv/main.go", "fmt"), ("lib/Main.java", "java.util.List")}
    edges = {tuple(r) for r in metrics.workspace_edges(code.imports(files)).collect()}
    assert ("app/store.rs", "crate::model::Item") in edges and not any(b.endswith("::*") or b.startswith("serde") for _, b in edges)
    assert "total" in {r.name for r in code.identifiers(files).where("file = 'tool/job.py'").collect()} and code.string_literals(files).where("value = 'Runs.'").count() == 1
    summary = metrics.doc_summary(code.doc_items(files)).head()
    assert summary.total_public == summary.documented + summary.undocumented and 0 < summary.coverage_pct < 100


def test_python_holds_few_files(spark):
    big = F.when(F.col("id") < 10000, "x").otherwise(F.repeat(F.lit("let ж\n"), 17000))  # the small ones fill an Arrow batch
    files = spark.range(0, 12000, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(".rs")).alias("file"), big.alias("source"))
    mb = lambda: int(open("/proc/self/statm").read().split()[1]) >> 8  # noqa: E731, SIM115
    got = code._relation(files, "id bigint, n bigint, mb bigint", lambda f, s, g: [(int(f[:-3]), len(s), mb())])
    got = got.agg(F.count_distinct("id").alias("files"), F.sum("n").alias("n"), (F.max("mb") - F.min_by("mb", "id")).alias("more")).head()
    assert (got.files, got.n) == (12000, 10000 + 2000 * 102000) and got.more < 45  # MB of the worker: a hundred files take 28, an Arrow batch took 65


def test_taint(files):
    got = rows(an.taint(files), "file", "variable", "violation_type", "severity")
    assert got == [("app/store.rs", "secret_value", "PRINT_LEAK", "high"), ("srv/main.go", "authToken", "LOG_LEAK", "high"), ("tool/job.py", "password", "PRINT_LEAK", "high"), ("web/page.js", "token", "LOG_LEAK", "high")]
    assert an.taint_of("a.rs", "// @sensitive\nlet x = f();\nlog::warn!(\"{}\", x);\n", "rs")[0][0][:4] == ("a.rs", 3, "x", "LOG_LEAK")
    assert an.taint_of("a.rs", "// @sensitive\nlet x = f();\nhash(x);\n", "rs") == ([], 1)
    assert an.taint_of("a.rs", "#[test]\nfn t() {\nlet token = 1;\nprintln!(token);\n}\n", "rs") == ([], 0)
    s = an.taint_summary(files).head()
    assert s.violations_count == 4 and s.high_severity == 4 and s.sensitive_variables_found >= 4


def test_secrets_escape_and_entropy(spark):
    d = spark.createDataFrame([("a.py", 'k = "abcdefghijklmnop\\"qrstuvwxyz0123456789ABC"\nexample_password = 1\npassword = 2\ntoken\n')], "file string, source string")
    got = an.secrets(d).collect()
    assert sorted((r.line, r.kind) for r in got) == [(1, "entropy"), (3, "pattern")]
    assert spark.range(1).select(scalars.byte_entropy(F.lit("aabb"))).head()[0] == 1.0 and spark.range(1).select(scalars.byte_entropy(F.lit(""))).head()[0] == 0.0


def test_debt_blame(spark, files):
    blame = spark.createDataFrame([("app/store.rs", r.line, "ann", 0) for r in an.debt(files).where("file = 'app/store.rs'").limit(1).collect()], "file string, line bigint, author string, author_ts bigint")
    got = an.debt(files, blame=blame)
    assert {r.author: r["items"] for r in an.debt_by(got).collect()}["ann"] == 1 and got.where("author = 'ann'").head().date == "1970-01-01"
    assert an.debt(files, only=["fixme"]).select("text").head()[0] == "ann) handle this" and an.debt_summary(got).head().total == 5


def test_duplicates_follow_the_order(spark):
    f = [("a", "f1", 1, ["IF", "LET", "RET", "CALL", "FOR"]), ("a", "f2", 9, ["IF", "LET", "RET", "CALL", "FOR", "IF"]), ("b", "g", 1, ["IF", "LET", "RET", "CALL"] + ["LET"]), ("c", "h", 1, ["WHILE", "MATCH", "ARM", "TRY", "LOOP"]), ("d", "short", 1, ["IF"])]
    d = spark.createDataFrame(f, "file string, function string, line bigint, tokens array<string>")
    free, groups = sorted((r for r in f if len(r[3]) >= 5), key=lambda r: (r[0], r[2])), []
    while free:
        a = free.pop(0)
        own = [a] + [b for b in free if len(set(a[3]) & set(b[3])) >= 0.7 * len(set(a[3]) | set(b[3]))]
        free = [b for b in free if b not in own]
        if len(own) > 1:
            groups.append({r[1] for r in own})
    got = {}
    for r in metrics.duplicates(d).collect():
        got.setdefault(r.group_id, set()).add(r.function)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups)) == [["f1", "f2", "g"]]


def test_cohesion(files):
    r = metrics.cohesion(files).head()
    assert (r.name, r.lcom4, r.methods) == ("Store", 2, 3)
    assert metrics.lcom4([("a", ["x"]), ("b", ["x", "y"]), ("c", ["y"]), ("d", [])]) == 2 and metrics.lcom4([]) == 1


def test_property_coverage_and_fuzz(spark, files):
    t = metrics.tests(files)
    s = metrics.property_summary(t).head()
    assert s.property_test_count >= 1 and s.unit_test_count >= 4
    cov = {r.name: r for r in metrics.property_coverage(t).collect()}
    assert cov["load"].has_unit_test and not cov["plain"].has_unit_test
    from auditlake.functions.lines import lines_in_context

    got = {r.name: r for r in metrics.fuzz_targets(metrics.signatures(lines_in_context(files)), spark.createDataFrame([("find",)], "name string"), code.functions(files)).collect()}
    assert got["helper"].score >= 30 + 20 + 4 and got["find"].has_harness and got["Load"].score == 20 + 30 + 4 and "size" not in got


def test_mutants_and_delta(spark):
    src = "fn a() {\n    b(1 + 2);\n}\nfn b(x: i32) -> bool {\n    x < 3 && true\n}\nfn c() {\n    a();\n}\n"
    d = spark.createDataFrame([("src/m.rs", src)], "file string, source string")
    every = mutants.mutants(d, None)
    got = {(r.line, r.description): r.mutated.strip() for r in every.collect()}
    assert got[2, "+ -> -"] == "b(1 - 2);" and got[5, "< -> <="] == "x <= 3 && true" and got[5, "true -> false"] == "x < 3 && false"
    assert mutants.mutants(d, 3).count() == 3
    ranges = mutants.function_ranges(d)
    assert rows(ranges, "name", "first", "last") == [("a", 1, 3), ("b", 4, 6), ("c", 7, 9)]
    hunks = spark.createDataFrame([("m.rs", 5, 5)], "file string, start_line bigint, end_line bigint")
    changed = mutants.changed_functions(ranges, hunks)
    assert rows(changed, "name") == [("b",)]
    edges = mutants.calls(d, ranges)
    assert rows(edges, "caller", "callee") == [("a", "b"), ("c", "a")]
    reached = mutants.affected(changed, edges)
    assert rows(reached, "name") == [("a",), ("b",), ("c",)]
    assert mutants.reduction(every, ranges, reached).head().reduction_pct >= 0
    res = spark.createDataFrame([(1, "f", 1, "killed"), (2, "f", 1, "survived")], "id int, file string, line int, status string")
    assert mutants.mutation_summary(res).head().mutation_score == 50.0


def test_sources(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_bytes(b"\xff\xfe")
    (tmp_path / "node_modules/c.py").write_text("y = 1\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/d.py").write_text("z = 1\n")
    names = lambda d: sorted(r.file.rsplit("/", 1)[1] for r in d.collect())
    assert names(sources.source_files(spark, str(tmp_path), False, ["py"])) == ["a.py"]
    assert names(sources.source_files(spark, str(tmp_path), True, ["py"])) == ["a.py", "d.py"]
    f = spark.createDataFrame([("src/a.rs",), ("gen/x.rs",), ("src/b.min.js",), ("src/deep/c.txt",)], "file string")
    assert rows(f.where(~sources.ignored(F.col("file"), ["gen/", "*.min.js", "# no", "**/c.txt"])), "file") == [("src/a.rs",)]
    lock = '[[package]]\nname = "a"\nversion = "1"\n\n[[package]]\nname = "b"\nversion = "2"\n'
    lines = explode_lines(spark.createDataFrame([("Cargo.lock", lock)], "file string, source string"))
    assert rows(sources.cargo_lock(lines), "package", "version") == [("a", "1"), ("b", "2")]
    toml = '[package]\nname = "a"\nlicense = "MIT"\n[dependencies]\nname = "z"\n'
    assert rows(sources.cargo_licenses(explode_lines(spark.createDataFrame([("Cargo.toml", toml)], "file string, source string"))), "package", "license") == [("a", "MIT")]
    npm = spark.createDataFrame([(json.dumps({"packages": {"": {}, "node_modules/l": {"version": "4", "license": "MIT"}}}),)], "value string")
    assert rows(sources.npm_lock(npm), "package", "version", "license") == [("l", "4", "MIT")]
    assert rows(sources.npm_manifest(spark.createDataFrame([('{"dependencies":{"q":"^1.2"}}',)], "value string")), "package", "version") == [("q", "1.2")]
    req = spark.createDataFrame([("a==1.0",), ("# c",), ("b >= 2",), ("c",), ("-r x",)], "text string")
    assert rows(sources.requirements(req), "package", "version") == [("a", "1.0"), ("b", "2"), ("c", "unknown")]
    diff = [(1, 1, "+++ b/x.rs"), (1, 2, "@@ -1,2 +3,4 @@"), (1, 3, "@@ -9 +20 @@"), (1, 4, "@@ -9,2 +30,0 @@")]
    assert rows(sources.diff_hunks(spark.createDataFrame(diff, "diff int, n int, text string")), "file", "start_line", "end_line") == [("x.rs", 3, 6), ("x.rs", 20, 20)]
    cov = spark.createDataFrame([("FN:3,f",), ("FNDA:2,f",), ("FNDA:1,f",), ("FNDA:0,_RNvC1a4main",)], "text string")
    assert rows(sources.lcov(cov), "function", "hits") == [("_RNvC1a4main", 0), ("f", 3), ("main", 0)]
    log = spark.createDataFrame([("a.rs",), ("a.rs",), (".hid",)], "file string")
    assert rows(sources.churn(log), "file", "churn") == [("a.rs", 2)]
    assert sources.thresholds("[crap]\nmax = 20\n") == {"crap": {"max": 20}}
    with pytest.raises(ValueError):
        sources.thresholds("[crap]\nmax = -1\n")


def test_packages_and_sinks(spark, files, tmp_path):
    cargo = json.dumps({"vulnerabilities": {"list": [{"package": {"name": "p", "version": "1"}, "advisory": {"id": "R1", "title": "t", "cvss": "CVSS:3.1/AV:N"}}, {"package": {"name": "q"}, "advisory": {}}]}})
    assert rows(packages.cargo_advisories(spark.createDataFrame([(cargo,)], "value string")), "package", "severity") == [("p", "low"), ("q", "unknown")]
    npm = json.dumps({"vulnerabilities": {"n": {"severity": "high", "range": "<2", "via": ["x", {"source": 7, "title": "t", "url": "u"}]}}})
    assert rows(packages.npm_advisories(spark.createDataFrame([(npm,)], "value string")), "package", "version", "advisory_id", "severity") == [("n", "<2", "7", "high")]
    assert rows(packages.safety_advisories(spark.createDataFrame([('[["d","<3","2.0","bad","55"]]',)], "value string")), "package", "version", "advisory_id") == [("d", "2.0", "55")]
    deps = spark.createDataFrame([("a", "1.2", "2.0"), ("b", "2.1", "2.9"), ("c", "x", "3")], "name string, current string, latest string")
    assert rows(packages.outdated(deps), "name", "major_behind") == [("a", True), ("b", False), ("c", False)]
    p = spark.createDataFrame([("a&b", "1", "MIT", "rust"), ("Py", "2", None, "python")], "package string, version string, license string, ecosystem string")
    c = packages.components(p)
    assert "a&amp;b" in sinks.cyclonedx_document(packages.cyclonedx(c)) and "pkg:pypi/py@2" in sinks.spdx_document(packages.spdx(c), "x")
    found = an.sast(files)
    log = json.loads(sinks.sarif(found, "t"))
    assert len(log["runs"][0]["results"]) == found.count() and "ruleId" in log["runs"][0]["results"][0]
    assert "rule_id" in json.loads(sinks.sarif(found, "t", camel=False))["runs"][0]["results"][0]
    assert "summary" in json.loads(sinks.report_json(found, an.severity_counts(found)).head().value)
    assert '"Item";' in sinks.dot(metrics.workspace_edges(code.imports(files))).where("value LIKE '%Item%'").head().value
    assert sinks.markdown(found, "t").startswith("# t") and "<table>" in sinks.html(found, "t") and sinks.text_table(found)
    sinks.append_history(spark.createDataFrame([(0, "r", 1, 0)], "ts bigint, run_id string, passed bigint, failed bigint"), str(tmp_path / "h"))
    assert sources.history(spark, str(tmp_path / "h")).head().run_id == "r"


def test_compare(spark):
    c = lambda *r: spark.createDataFrame(list(r), "name string, passed boolean")
    before, now = c(("a", True), ("b", False), ("c", True)), c(("a", False), ("b", True), ("d", True))
    assert rows(compare.report_diff(before, now), "name", "change") == [("a", "broken"), ("b", "fixed"), ("c", "gone"), ("d", "new")]
    assert rows(compare.regressions(before, now), "name") == [("a",)]
    assert tuple(compare.health(c(("sast", True), ("debt", False))).head()) == (75, "C") and tuple(compare.health(before.limit(0)).head()) == (100, "A")
    assert rows(compare.fixes(c(("debt", False), ("sast", True))), "name") == [("debt",)]
    d = spark.createDataFrame([("x", '{"items": [], "findings": [{"f": 1}, {"f": 2}]}')], "name string, details string")
    assert compare.offenders(d, 1).head().item == '{"f":1}'
    f = "file string, line int, rule_id string"
    assert rows(compare.new_findings(spark.createDataFrame([("a", 1, "r"), ("a", 2, "r")], f), spark.createDataFrame([("a", 1, "r")], f)), "line") == [(2,)]


def test_islands_sort_once(spark):
    r = random.Random(3)
    d = [(r.choice(["a", "b", None]), r.choice([None, r.randrange(60)])) for _ in range(400)] + [("c", 5)] * 3 + [("d", None)] * 2 + [("e", 2**63 - 1)] * 2 + [("e", 2**63 - 2), ("e", 7 - 2**63)]
    got, want = compare.islands(spark.createDataFrame(d, "file string, line bigint").repartition(3)), []
    for f in {x[0] for x in d}:
        lines = {x[1] for x in d if x[0] == f}
        want += [(f, None, None)] * (None in lines)
        lines.discard(None)
        want += [(f, x, next(y for y in range(x, x + 99) if y + 1 not in lines)) for x in lines if x - 1 not in lines]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == ["file", "first", "last"]
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    # hash maps of all rows of a task, beside the sort, took most of a task's memory
    assert "HashAggregate" not in plan and plan.count("Sort [") == plan.count("Exchange hashpartitioning") == 1


def test_facade(files):
    assert {"sast", "taint"} <= {t["name"] for t in api.list_tools()}
    assert api.call("sast", files, min_confidence="high").where("confidence <> 'high'").count() == 0
    with pytest.raises(KeyError):
        api.call("nothing", files)
    got = {r.name: r.passed for r in api.run_checks(files, only=["sast", "debt", "comments", "cohesion"]).collect()}
    assert got == {"sast": False, "debt": True, "comments": got["comments"], "cohesion": True}
    assert api.functions_where(files, "complexity > 3").count() >= 1


def test_watch(spark, tmp_path):
    src, state = tmp_path / "src", str(tmp_path / "state")
    src.mkdir()
    checks = lambda f: f.agg(F.count_if(F.col("source").contains("TODO")).alias("n")).select(F.lit("debt").alias("name"), (F.col("n") == 0).alias("passed"))

    def run():
        watch.watch(watch.changes(spark, str(src), ["py"]), checks, state, str(tmp_path / "cp"), once=True).awaitTermination()

    (src / "a.py").write_text("x\n")
    run()
    (src / "b.py").write_text("# TODO: y\n")
    run()
    assert rows(spark.read.parquet(f"{state}/changes"), "batch", "name", "change") == [(0, "debt", "new"), (1, "debt", "broken")]


def test_registered_mutants_are_whole(spark, tiny):
    got = catalogue.QUERIES["mutant_list"](spark, tiny)
    assert got.groupBy("file").count().where("count > 5").count() > 0
    assert got.count() == mutants.mutants(catalogue.corpus(spark, tiny), None).count()
