"""Metrics over functions, imports, churn and coverage: joins and aggregates, one row a function, file or module."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.files import rows_of_files
from auditlake.functions.lines import extension, has, occurrences
from auditlake.functions.scalars import crap, crap_band, risk, risk_band

#: Names that the risk score of functions leaves out.
NOT_SCORED = ("main", "output_table", "output_json", "output_ndjson", "run_self_test")


# --- complexity and coverage -----------------------------------------------------------------


def crap_scores(functions: DataFrame, coverage: DataFrame | None = None, skip=NOT_SCORED) -> DataFrame:
    """Functions with coverage (name, hits > 0: 1, else 0) and the score c² (1 - cov)³ + c in four bands."""
    d = functions.where(~F.col("name").isin(*skip)) if skip else functions
    if coverage is None:
        d = d.withColumn("coverage_pct", F.lit(0.0))
    else:
        hit = coverage.groupBy(F.col("function").alias("name")).agg(F.max((F.col("hits") > 0).cast("double")).alias("coverage_pct"))
        d = d.join(hit, "name", "left").withColumn("coverage_pct", F.coalesce("coverage_pct", F.lit(0.0)))
    score = crap(F.col("complexity"), F.col("coverage_pct"))
    d = d.select("name", "file", "line", "complexity", F.greatest(F.col("end_line") - F.col("line"), F.lit(0)).alias("line_count"), "coverage_pct", score.alias("crap_score"))
    return d.withColumn("category", crap_band(F.col("crap_score")))


def crap_summary(scores: DataFrame) -> DataFrame:
    band = lambda b: F.count_if(F.col("category") == b).alias(f"{b}_count")
    return scores.agg(
        F.count("*").alias("total_functions"), F.coalesce(F.sum("complexity"), F.lit(0)).alias("total_complexity"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("avg_complexity"),
        F.coalesce(F.avg("crap_score"), F.lit(0.0)).alias("avg_crap"), *map(band, ("crappy", "acceptable", "good", "excellent")),
    )


def complexity_summary(functions: DataFrame, least: int = 10) -> DataFrame:
    return functions.agg(F.count("*").alias("total_functions"), F.count_if(F.col("complexity") >= least).alias("violations"), F.array_sort(F.collect_set("language")).alias("languages"))


def most_complex(functions: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    return functions.where(F.col("complexity") >= least).orderBy(F.desc("complexity"), "file", "line").limit(top)


def risk_map(churn: DataFrame, functions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, churn, complexity, function_count, unsafe_count, risk_score, category, hot_functions) of changed files.

    ``churn`` is (file, churn).  With ``files`` (file, source) only those that exist count, and unsafe blocks of Rust add
    two each.  Hot functions are those of the three most complex that exceed 3.
    """
    w = Window.partitionBy("file").orderBy(F.desc("complexity"), "line")
    top = functions.withColumn("r", F.row_number().over(w))
    hot = F.transform(F.array_sort(F.collect_list(F.when((F.col("r") <= 3) & (F.col("complexity") > 3), F.struct("r", "name")))), lambda x: x["name"])
    f = top.groupBy("file").agg(F.sum("complexity").alias("complexity"), F.count("*").alias("function_count"), hot.alias("hot_functions"))
    d = churn
    if files is not None:
        unsafe = F.when(extension(F.col("file")) == "rs", occurrences(F.col("source"), F.lit("unsafe {")) + occurrences(F.col("source"), F.lit("unsafe("))).otherwise(F.lit(0).cast("long"))
        d = d.join(files.select("file", unsafe.alias("unsafe_count")), "file")
    else:
        d = d.withColumn("unsafe_count", F.lit(0).cast("long"))
    d = d.join(f, "file", "left").withColumn("complexity", F.coalesce("complexity", F.lit(0))).withColumn("function_count", F.coalesce("function_count", F.lit(0)))
    score = risk(F.col("churn"), F.col("complexity") + 2 * F.col("unsafe_count"))
    return d.select("file", "churn", "complexity", "function_count", "unsafe_count", score.alias("risk_score"), risk_band(score).alias("category"), F.coalesce("hot_functions", F.array().cast("array<string>")).alias("hot_functions"))


def risk_summary(risks: DataFrame) -> DataFrame:
    return risks.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("category").isin("DANGER", "HIGH")).alias("high_risk"), F.count_if(F.col("category") == "MEDIUM").alias("medium_risk"), F.count_if(F.col("category") == "LOW").alias("low_risk"),
        F.coalesce(F.sum("unsafe_count"), F.lit(0)).alias("total_unsafe"), F.array_sort(F.collect_list(F.when((F.col("churn") > 5) & (F.col("complexity") > 20), F.col("file")))).alias("danger_zone"),
    )


def doc_summary(items: DataFrame) -> DataFrame:
    total, good = F.count("*"), F.count_if("documented")
    kinds = [F.array(F.count_if(F.col("kind") == k), F.count_if((F.col("kind") == k) & F.col("documented"))).alias(k) for k in ("fn", "struct", "enum", "trait", "impl_fn")]
    return items.agg(total.alias("total_public"), good.alias("documented"), (total - good).alias("undocumented"), F.when(total == 0, 100.0).otherwise(good / F.nullif(total, F.lit(0)) * 100.0).alias("coverage_pct"), F.struct(*kinds).alias("by_kind"))


# --- coupling ----------------------------------------------------------------------------------


def workspace_edges(imports: DataFrame) -> DataFrame:
    """Distinct (source_module, imported_module) that may stay within the project."""
    m, rust = F.col("imported_module"), F.endswith(F.col("source_module"), F.lit(".rs"))
    own = F.startswith(m, F.lit("crate::")) | F.startswith(m, F.lit("self::")) | F.startswith(m, F.lit("super::")) | ~has(m, "::")
    return imports.where((m != "") & ~F.endswith(m, F.lit("::*")) & (~rust | own)).select("source_module", "imported_module").distinct()


def coupling(edges: DataFrame) -> DataFrame:
    """(name, fan_out, fan_in, instability) of all modules of distinct edges (source_module, imported_module)."""
    # one pass: each edge counts for both its ends, so that no join is needed
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_module").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("imported_module").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    d = ends.groupBy(F.col("e.name").alias("name")).agg(F.sum("e.o").alias("fan_out"), F.sum("e.i").alias("fan_in"))
    total = F.col("fan_out") + F.col("fan_in")
    return d.withColumn("instability", F.when(total == 0, 0.0).otherwise(F.col("fan_out") / F.nullif(total, F.lit(0))))


def coupling_summary(modules: DataFrame, edges: DataFrame, above: int = 5) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    m = modules.agg(F.count("*").alias("total_modules"), zero(F.avg("fan_in")).alias("avg_fan_in"), zero(F.avg("fan_out")).alias("avg_fan_out"), F.array_sort(F.collect_list(F.when(F.col("fan_in") + F.col("fan_out") > above, F.col("name")))).alias("most_coupled"))
    return m.crossJoin(edges.agg(F.count("*").alias("total_dependencies")))


# --- duplication ---------------------------------------------------------------------------------


def duplicates(fingerprints: DataFrame, threshold: float = 0.7, least: int = 5, order: tuple[str, ...] = ("file", "line", "function")) -> DataFrame:
    """``fingerprints`` (file, function, line, tokens) of groups of alike functions, with group and fingerprint.

    An anchor takes every later free function whose token set has at least ``threshold`` of Jaccard similarity;
    anchors come in ``order``.  Functions of one token set always go together, so the walk is over distinct
    sets: at most 2 to the 13th of them with the token kinds of ``code``, whatever the corpus.
    """
    d = fingerprints.where(F.greatest(F.size("tokens"), F.lit(1)) >= least).withColumn("set", F.array_sort(F.array_distinct("tokens")))
    sets = d.groupBy("set").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"), F.min_by(F.array_join("tokens", ";"), F.struct(*order)).alias("print")).orderBy("first").collect()
    free, group, n_groups = list(range(len(sets))), [], 0
    tokens = [set(r["set"]) for r in sets]
    while free:
        a = free.pop(0)
        own = [a] + [b for b in free if len(tokens[a] & tokens[b]) >= threshold * len(tokens[a] | tokens[b])]
        taken = set(own)
        free = [b for b in free if b not in taken]
        if sum(sets[k]["n"] for k in own) >= 2:
            n_groups += 1
            group += [(sets[k]["set"], n_groups, sets[a]["print"][:60]) for k in own]
    of = fingerprints.sparkSession.createDataFrame(group, "set array<string>, group_id int, fingerprint string")
    return d.join(F.broadcast(of), "set").select("group_id", "fingerprint", "file", "function", "line", F.lit(1.0).alias("similarity"))


def token_pairs(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, jaccard) of ids a < b whose token sets are alike, by prefix filter: a pair must share one of the rarest tokens.

    ``sets`` is (id, tokens).
    """
    each = sets.select("id", F.explode(F.array_distinct("tokens")).alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("f"))
    ranked = each.join(often, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("r"))
    d = ranked.select("id", F.transform("r", lambda x: x["t"]).alias("s"), F.size("r").alias("n"))
    prefix = (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    keyed = d.select("id", F.explode(F.slice("s", F.lit(1), prefix)).alias("t"), "n")
    a, b = keyed.alias("a"), keyed.alias("b")
    near = a.join(b, F.col("a.t") == F.col("b.t")).where((F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    x, y = d.select(F.col("id").alias("a"), F.col("s").alias("x")), d.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    j = both / (F.size("x") + F.size("y") - both)
    return near.join(x, "a").join(y, "b").select("a", "b", j.alias("jaccard")).where(F.col("jaccard") >= threshold)


# --- cohesion -----------------------------------------------------------------------------------------


def lcom4(methods: list[tuple[str, list[str]]]) -> int:
    """Connected components of methods that share a field; methods without fields stand alone."""
    if not methods:
        return 1
    up = list(range(len(methods)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    of_field: dict[str, int] = {}
    for k, (_, fields) in enumerate(methods):
        for f in fields:
            up[root(k)] = root(of_field.setdefault(f, k))
    return len({root(k) for k in range(len(methods))})


def _braces(depth: int, t: str) -> int:
    return max(0, depth + t.count("{") - t.count("}"))


def structs_of(source: str) -> list[tuple[str, int, list[tuple[str, list[str]]]]]:
    """(struct, line, methods with the fields they touch) of Rust structs of two methods at least."""
    lines, out = [x.strip() for x in source.split("\n")], []
    for i, t in enumerate(lines):
        m = re.match(r"(?:pub )?struct (\w+)", t)
        if not m:
            continue
        name, fields, depth, j = m[1], [], int("{" in t), i + 1
        while j < len(lines) and depth > 0:
            x = lines[j]
            depth = _braces(depth, x)
            if depth == 1 and ":" in x and not x.startswith(("//", "pub fn", "fn ")):
                words = re.sub(r"^(?:pub )*(?:pub\(crate\) )*", "", x.split(":")[0].strip()).split()
                if words and re.fullmatch(r"\w+", words[0]):
                    fields.append(words[0])
            j += 1
        methods: list[tuple[str, list[str]]] = []
        for k in range(i + 1, len(lines)):
            head = lines[k]
            if not ((head.startswith("impl " + name) or head.startswith("impl<")) and name in head):
                continue
            depth, current, inside = int("{" in head), None, 0
            for x in lines[k + 1 :]:
                if depth <= 0:
                    break
                depth = _braces(depth, x)
                if x.startswith(("fn ", "pub fn ", "pub(crate) fn ", "async fn ")) and "(" in x:
                    current, inside = ((x.split("(")[0].split() or [""])[-1], []), depth
                    methods.append(current)
                if current:
                    current[1].extend(f for f in fields if "self." + f in x and f not in current[1])
                    if depth < inside:
                        current = None
        if len(methods) >= 2:
            out.append((name, i + 1, methods))
    return out


def cohesion(files: DataFrame) -> DataFrame:
    """(file, name, line, lcom4, fields_accessed, methods) of Rust structs with at least two methods."""
    d = files.where((extension(F.col("file")) == "rs") & has(F.col("source"), "struct ")).select("file", "source")
    rows = lambda f, s: [(f, n, at, lcom4(ms), len({x for _, fs in ms for x in fs}), len(ms)) for n, at, ms in structs_of(s)]
    return rows_of_files(d, "file string, name string, line bigint, lcom4 bigint, fields_accessed bigint, methods bigint", rows, "file", "source")


def cohesion_summary(structs: DataFrame, most: int = 2) -> DataFrame:
    return structs.agg(F.count("*").alias("structs_analyzed"), F.count_if(F.col("lcom4") > most).alias("violations"), F.coalesce(F.avg("lcom4"), F.lit(1.0)).alias("avg_lcom"))


# --- property tests and fuzzing -------------------------------------------------------------------------

_NOT_NAMES = set("if else while for loop match fn let mut pub use mod struct enum impl trait const static type where return break continue move ref self super crate async await dyn as in true false none some ok err result option vec string str u8 u16 u32 u64 i32 i64 f32 f64 bool char box rc arc cell refcell mutex rwlock thread spawn join main".split())
_FN = {"py": r"^def ([^(\s]+)", "go": r"^func ([^(\s]+)"}


def tests_of(file: str, source: str, ext: str) -> list[tuple]:
    """Rows (kind, name, file, line, framework, unit, property tests): kinds 'prop', 'unit' and 'fn'."""
    props, units, fns = [], 0, {}
    lines = source.removesuffix("\n").split("\n") if source else []
    for n, raw in enumerate(lines, 1):
        t = raw.strip()
        if ext == "rs":
            units += t.startswith("#[test]") or "# [ test ]" in t
            for marks, name in ((("proptest!",), "proptest"), (("quickcheck!", "#[quickcheck]", "# [ quickcheck ]"), "quickcheck")):
                if any(m in t for m in marks):
                    props += [(f"{name}_{w}", n, name, w) for w in re.split(r"\W", raw) if len(w.encode()) > 3 and w.lower() not in _NOT_NAMES]
            m = re.search(r"fn ([^(\s]+)[(\s]", t) if t.startswith(("fn ", "pub fn ")) else None
            if m and m[1].lower() not in _NOT_NAMES:
                if t.startswith("fn ") and "prop" in t:
                    props.append((m[1], n, "proptest_inline", m[1]))
                fns[m[1]] = [n, False, []]
        elif ext in ("py", "pyi"):
            m = re.match(_FN["py"], t)
            test = t.startswith(("def test_", "async def test_"))
            units += test
            if m and test:
                fns.setdefault(m[1], [n, True, []])
            if "@given" in t or "@hypothesis.given" in t:
                d = re.match(_FN["py"], lines[n].strip()) if n < len(lines) else None
                if d:
                    props.append((d[1], n + 1, "hypothesis", d[1]))
                    if d[1] in fns:
                        fns[d[1]][2].append(d[1])
            if m:
                fns.setdefault(m[1], [n, False, []])
        elif ext in ("js", "mjs", "ts", "tsx", "cjs", "mts"):
            units += t.startswith(("it(", "test(", "describe("))
            by_function, by_const = re.search(r"function ([^(\s]*)", t), re.search(r"const ([^=\s]*)", t)
            if any(m in t for m in ("fc.assert", "fastCheck", "property(")):
                m = by_function if "function " in t else by_const if "const " in t and "=" in t else None
                if m:
                    props.append((m[1], n - 1, "fast-check", m[1]))
            m = by_function if t.startswith("function ") else by_const if "const " in t and "=>" in t else None
            if m:
                fns[m[1]] = [n - 1, False, []]
        elif ext == "go":
            m, test = re.match(_FN["go"], t), t.startswith("func Test")
            units += test
            if m:
                fns.setdefault(m[1], [n - 1, test, []])
    if ext == "rs":
        for name, _, _, tested in props:
            if tested in fns:
                fns[tested][2].append(name)
        for f in fns.values():
            f[1] = units > 0
    out = [("prop", name, file, n, framework, None, [tested]) for name, n, framework, tested in props]
    if units:
        out.append(("unit", None, file, units, None, None, None))
    return out + [("fn", name, file, n, None, unit, p) for name, (n, unit, p) in fns.items()]


TESTED = "rs py js mjs ts tsx go".split()


def tests(files: DataFrame) -> DataFrame:
    d = files.select("file", extension(F.col("file")).alias("ext"), "source").where(F.col("ext").isin(TESTED))
    return rows_of_files(d, "kind string, name string, file string, line bigint, framework string, unit boolean, names array<string>", tests_of, "file", "source", "ext")


def property_tests(t: DataFrame) -> DataFrame:
    return t.where("kind = 'prop'").select("name", "file", "line", "framework", F.col("names").alias("functions_tested"))


def property_coverage(t: DataFrame) -> DataFrame:
    """(name, file, line, has_property_test, has_unit_test, property_tests) by function name over all files; the first file by name gives the place."""
    g = t.where("kind = 'fn'").groupBy("name").agg(F.min(F.struct("file", "line")).alias("at"), F.bool_or(F.size("names") > 0).alias("has_property_test"), F.bool_or("unit").alias("has_unit_test"), F.array_sort(F.flatten(F.collect_list("names"))).alias("property_tests"))
    return g.select("name", "at.file", "at.line", "has_property_test", "has_unit_test", "property_tests")


def property_summary(t: DataFrame) -> DataFrame:
    c = property_coverage(t)
    a = c.agg(F.count("*").alias("total_functions"), F.count_if("has_property_test").alias("with_property_tests"), F.count_if("has_unit_test").alias("with_unit_tests"))
    b = t.agg(F.count_if(F.col("kind") == "prop").alias("property_test_count"), F.coalesce(F.sum(F.when(F.col("kind") == "unit", F.col("line"))), F.lit(0)).alias("unit_test_count"))
    pct = F.when(F.col("total_functions") == 0, 0.0).otherwise(F.col("with_property_tests") / F.nullif(F.col("total_functions"), F.lit(0)) * 100.0)
    return a.crossJoin(b).withColumn("coverage_percentage", pct)


FUZZ = {
    "rs": [(("&[u8]", "bytes"), 30), (("string", "&str"), 20), (("vec<u8>",), 25), (("path", "reader", "stream"), 10)], "py": [(("bytes",), 30), (("str",), 20), (("list",), 15)],
    "js": [(("uint8array", "buffer"), 30), (("string",), 20), (("array", "[]"), 15)], "go": [(("[]byte",), 30), (("string",), 20), (("interface",), 10)],
}
CONSTANT_FUZZ = "c cpp cc cs java php rb swift kt kts sol".split()


def fuzz_targets(signatures: DataFrame, harnesses: DataFrame | None = None, functions: DataFrame | None = None) -> DataFrame:
    """(name, file, line, params, score, is_public, complexity, has_harness) of functions worth fuzzing.

    ``signatures`` is (name, file, line, params array<string>, is_public); scores follow the parameters' types
    by the file's language, constant 10 where a language has none.
    """
    d = signatures.withColumn("ext", extension(F.col("file"))).withColumn("lang", F.when(F.col("ext").isin("js", "ts", "mjs", "tsx"), "js").otherwise(F.col("ext")))

    def worth(p):
        out = F.lit(0)
        for lang, table in FUZZ.items():
            one = F.lit(0)
            for words, score in reversed(table):
                cond = F.lit(False)
                for w in words:
                    cond = cond | F.contains(F.lower(p), F.lit(w))
                one = F.when(cond, score).otherwise(one)
            out = F.when(F.col("lang") == lang, one).otherwise(out)
        return out

    constant = F.col("ext").isin(CONSTANT_FUZZ)
    d = d.withColumn("params", F.filter("params", lambda p: p != "")).withColumn("base", F.aggregate(F.transform("params", worth), F.lit(0), lambda a, x: a + x))
    d = d.where(constant | (F.col("base") > 0))
    d = d.join(functions.groupBy("file", "name").agg(F.min_by("complexity", "line").alias("complexity")), ["file", "name"], "left") if functions is not None else d.withColumn("complexity", F.lit(None).cast("int"))
    d = d.withColumn("complexity", F.when(constant, 1).otherwise(F.coalesce("complexity", F.lit(10))))
    if harnesses is not None:
        d = d.join(harnesses.select("name").distinct().withColumn("has_harness", F.lit(True)), "name", "left").withColumn("has_harness", F.coalesce("has_harness", F.lit(False)))
    else:
        d = d.withColumn("has_harness", F.lit(False))
    full = F.col("base") + F.when((F.col("lang") == "rs") & F.col("is_public"), 10).otherwise(0) + F.size("params") * 2 + F.when((F.col("lang") == "rs") & (F.col("complexity") > 5), 5).otherwise(0)
    full = F.when(F.col("has_harness"), F.greatest(full - 5, F.lit(0))).otherwise(full)
    return d.select("name", "file", "line", F.filter("params", lambda p: worth(p) > 0).alias("params"), F.when(constant, 10).otherwise(full).alias("score"), "is_public", "complexity", "has_harness")


def signatures(lines: DataFrame) -> DataFrame:
    """(name, file, line, params, is_public) of function headers on one line; lines count from 0 here."""
    t, ext = F.col("t"), F.col("ext")
    shape = {"rs": r"^(?:pub )?(?:async )?fn ([^(\s<]+)[^(]*\((.*)\)", "py": r"^(?:async )?def ([^(\s]+)\((.*)\)", "go": r"^func (?:\([^)]*\) )?([^(\s]+)\((.*?)\)", "js": r"^function ([^(\s]+)\((.*)\)"}
    name, params = F.lit(""), F.lit("")
    for lang, p in shape.items():
        here = ext.isin("js", "ts", "mjs", "tsx") if lang == "js" else ext == lang
        name, params = F.when(here, F.regexp_extract(t, p, 1)).otherwise(name), F.when(here, F.regexp_extract(t, p, 2)).otherwise(params)
    d = lines.select(name.alias("name"), "file", (F.col("line") - 1).alias("line"), F.transform(F.split(params, ","), lambda x: F.btrim(x)).alias("params"), F.startswith(t, F.lit("pub ")).alias("is_public"))
    return d.where("name <> ''")


def harness_names(files: DataFrame) -> DataFrame:
    """Distinct words of lines with ``fuzz_target!`` in Rust files of a folder named fuzz."""
    d = files.where(F.rlike("file", F.lit(r"(^|/)fuzz/[^/]*\.rs$"))).select(F.explode(F.split("source", "\n")).alias("x")).where(has(F.col("x"), "fuzz_target!"))
    return d.select(F.explode(F.split("x", r"[^\w]")).alias("name")).where("name <> ''").distinct()


def fuzz_summary(targets: DataFrame) -> DataFrame:
    n = F.count("*")
    return targets.agg(n.alias("total_functions"), n.alias("fuzzable_functions"), F.count_if("has_harness").alias("functions_with_harnesses"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))
