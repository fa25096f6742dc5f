"""Line analyzers: files(file, source) in, findings or per-file numbers out.

Each is one scan, an explode of the file's lines with their neighbours, and filters: no shuffle
before a per-file or overall aggregate.  Rows come unordered; sort at the sink.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.files import rows_of_files
from auditlake.functions.lines import any_contains, extension, has, line_array, lines_in_context, occurrences, starts, strip
from auditlake.functions.scalars import byte_entropy, halstead_tokens, is_operator, keep_right
from auditlake.operators import rules

EXTENSIONS = {
    "sast": "rs py js ts tsx go java cs php rb", "crypto": "rs py js ts tsx go java cs php rb", "errhandle": "rs go py js ts tsx", "comments": "rs py pyi js mjs ts tsx go c h cpp cc hpp java rb swift php cs",
    "halstead": "rs py pyi js mjs ts tsx go c h cpp cc hpp cs java rb swift", "deadcode": "rs py js mjs ts tsx go c cpp java rb swift", "typecov": "py pyi js mjs cjs ts tsx mts",
    "debt": "rs py js ts go c cpp h java rb php swift", "debt_check": "rs py js ts go c cpp h java rb php swift cs", "secrets": "rs py pyi js mjs ts tsx go c h cpp cc java cs php rb swift",
    "secrets_config": "env json yaml yml toml xml ini cfg", "linelen": "rs py pyi js mjs cjs ts tsx mts go c h cpp cc cxx hpp cs java php rb swift", "taint": "rs py pyi js mjs ts tsx go c h cpp cc cxx hpp cs java php rb swift",
}
EXTENSIONS = {k: v.split() for k, v in EXTENSIONS.items()}


# --- comments, size ------------------------------------------------------------------

_SLASH = "rs c cpp cc cxx h hpp cs java js ts tsx mjs go swift".split()


def comment_stats(files: DataFrame, min_ratio: float = 0.05, exts: Iterable[str] = EXTENSIONS["comments"]) -> DataFrame:
    """Per file: code, comment and blank lines, comment ratio (1 without either), whether it is too low (over 10 lines only)."""
    ext = F.col("ext")

    def kind(t):
        comment = F.when(ext.isin(_SLASH), starts(t, "//", "/*", "*")).when(ext.isin("py", "pyi", "rb"), starts(t, "#")).when(ext == "php", starts(t, "//", "#", "/*", "*")).otherwise(starts(t, "//", "#"))
        doc = F.when(ext == "rs", starts(t, "///", "//!", "/**")).when(ext.isin("js", "ts", "tsx", "java", "cs"), starts(t, "/**", "* ", "*/")).when(ext.isin("py", "pyi"), starts(t, '"""', "'''")).otherwise(False)
        return F.when(t == "", 0).when(comment & ~doc, 1).otherwise(2)

    d = files.select("file", extension(F.col("file")).alias("ext"), "source").where(F.col("ext").isin(list(exts)))
    d = d.withColumn("kinds", F.transform(line_array(F.col("source")), lambda x: kind(strip(x))))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    d = d.select("file", count(2).alias("code_lines"), count(1).alias("comment_lines"), count(0).alias("blank_lines"), F.size("kinds").cast("long").alias("total_lines"))
    total = F.col("code_lines") + F.col("comment_lines")
    d = d.withColumn("comment_ratio", F.when(total == 0, 1.0).otherwise(F.col("comment_lines") / F.nullif(total, F.lit(0))))
    return d.withColumn("below_threshold", (F.col("comment_ratio") < min_ratio) & (total > 10))


def comment_summary(stats: DataFrame, min_ratio: float = 0.05) -> DataFrame:
    code, comment = F.coalesce(F.sum("code_lines"), F.lit(0)), F.coalesce(F.sum("comment_lines"), F.lit(0))
    return stats.agg(
        F.count("*").alias("files_scanned"), F.count_if("below_threshold").alias("files_below_threshold"), F.lit(min_ratio).alias("min_ratio_threshold"),
        F.when(code + comment == 0, 1.0).otherwise(comment / F.nullif(code + comment, F.lit(0))).alias("overall_comment_ratio"), code.alias("total_code_lines"), comment.alias("total_comment_lines"),
    )


def long_files(files: DataFrame, most: int = 500) -> DataFrame:
    """(file, lines, threshold) of files of more than ``most`` lines."""
    d = files.where(extension(F.col("file")).isin(EXTENSIONS["linelen"])).select("file", F.size(line_array(F.col("source"))).cast("long").alias("lines"))
    return d.where(F.col("lines") > most).withColumn("threshold", F.lit(most).cast("long"))


def long_functions(functions: DataFrame, most: int = 40) -> DataFrame:
    """(file, function, start_line, end_line, lines, threshold) of functions of more than ``most`` lines."""
    d = functions.select("file", F.col("name").alias("function"), F.col("line").alias("start_line"), "end_line", F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(0)).alias("lines"))
    return d.where(F.col("lines") > most).withColumn("threshold", F.lit(most).cast("long"))


# --- halstead --------------------------------------------------------------------------


def halstead(files: DataFrame, exts: Iterable[str] | None = EXTENSIONS["halstead"]) -> DataFrame:
    """Halstead's numbers of each file."""
    d = files.select("file", "source") if exts is None else files.where(extension(F.col("file")).isin(list(exts))).select("file", "source")
    d = d.select("file", halstead_tokens(line_array(F.col("source"))).alias("tokens"))
    d = d.select("file", F.filter("tokens", is_operator).alias("ops"), F.filter("tokens", lambda t: ~is_operator(t)).alias("opds"))
    size = lambda c: F.size(c).cast("long")
    d = d.select("file", size(F.array_distinct("ops")).alias("distinct_operators"), size(F.array_distinct("opds")).alias("distinct_operands"), size(F.col("ops")).alias("total_operators"), size(F.col("opds")).alias("total_operands"))
    d = d.withColumn("vocabulary", F.col("distinct_operators") + F.col("distinct_operands")).withColumn("length", F.col("total_operators") + F.col("total_operands"))
    d = d.withColumn("volume", F.when(F.col("vocabulary") > 1, F.col("length") * F.log2(F.col("vocabulary").cast("double"))).otherwise(0.0))
    d = d.withColumn("difficulty", F.when(F.col("distinct_operands") > 0, F.col("distinct_operators") / 2.0 * (F.col("total_operands") / F.nullif(F.col("distinct_operands"), F.lit(0)))).otherwise(0.0))
    d = d.withColumn("effort", F.col("difficulty") * F.col("volume"))
    return d.withColumn("bugs_estimated", F.col("volume") / 3000.0).withColumn("time_secs", F.col("effort") / 18.0)


def halstead_summary(stats: DataFrame, max_bugs: float = 2.0) -> DataFrame:
    return stats.agg(
        F.count("*").alias("files_scanned"), F.count_if(F.col("bugs_estimated") > max_bugs).alias("files_exceeding_bugs_threshold"), F.lit(max_bugs).alias("max_bugs_threshold"),
        F.coalesce(F.sum("bugs_estimated"), F.lit(0.0)).alias("total_bugs_estimated"), F.coalesce(F.avg("volume"), F.lit(0.0)).alias("avg_volume"), F.coalesce(F.avg("difficulty"), F.lit(0.0)).alias("avg_difficulty"),
    )


# --- rule scans ------------------------------------------------------------------------


def sast(files: DataFrame, min_confidence: str = "low") -> DataFrame:
    return rules.scan(lines_in_context(files, exts=EXTENSIONS["sast"]), rules.SAST, min_confidence)


def crypto(files: DataFrame) -> DataFrame:
    return rules.scan(lines_in_context(files, exts=EXTENSIONS["crypto"]), rules.CRYPTO).drop("confidence")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total_findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")])


_NOT_SECRET = ("example", "placeholder", "your_", "<your", "changeme", "test_")
#: A quoted literal; one without an end goes to the end of the line.
LITERAL = r""""(?:[^"\\]|\\.?)*(?:"|$)|'(?:[^'\\]|\\.?)*(?:'|$)"""


def secrets(files: DataFrame, min_entropy: float = 4.5, include_config: bool = False) -> DataFrame:
    """(file, line, kind, pattern, context, entropy, severity): keyword assignments and literals of high entropy."""
    lines = lines_in_context(files, exts=EXTENSIONS["secrets"] + (EXTENSIONS["secrets_config"] if include_config else []))
    return secrets_in(lines, min_entropy)


def secrets_in(lines: DataFrame, min_entropy: float = 4.5) -> DataFrame:
    low = F.lower("text")
    d = lines.where(~(any_contains(low, _NOT_SECRET) | starts(F.col("t"), "//", "#", "*"))).select("file", "line", "text", F.substring("t", 1, 80).alias("context"))
    number = None
    for k, (_, word, _s) in enumerate(rules.SECRETS):
        number = F.when(has(low, word), k) if number is None else number.when(has(low, word), k)
    k = F.col("k")
    words = d.where(has(F.col("text"), "=") | has(F.col("text"), ":")).select("*", number.alias("k")).where("k IS NOT NULL")
    words = words.select("file", "line", F.lit("pattern").alias("kind"), rules.attribute(k, [r[0] for r in rules.SECRETS]).alias("pattern"), "context", F.lit(None).cast("double").alias("entropy"), rules.attribute(k, [r[2] for r in rules.SECRETS]).alias("severity"))

    def content(x):
        q, body = F.left(x, F.lit(1)), F.regexp_replace(F.substring(x, 2, 1 << 30), r"\\.?", "")
        return F.when(F.endswith(body, q), F.substring(body, 1, F.length(body) - 1)).otherwise(body)

    quoted = d.where(has(F.col("text"), '"') | has(F.col("text"), "'"))
    literals = quoted.select("file", "line", "context", F.explode(F.transform(F.regexp_extract_all("text", F.lit(LITERAL), F.lit(0)), content)).alias("x")).where(F.octet_length("x") >= 12)
    e = literals.select("file", "line", "context", byte_entropy(F.col("x")).alias("entropy")).where(F.col("entropy") >= min_entropy)
    strange = e.select("file", "line", F.lit("entropy").alias("kind"), F.format_string("high_entropy_string (entropy=%.2f)", "entropy").alias("pattern"), "context", "entropy", F.when(F.col("entropy") >= 5.5, "high").otherwise("medium").alias("severity"))
    return words.unionByName(strange)


def debt(files: DataFrame, only: Iterable[str] | None = None, blame: DataFrame | None = None) -> DataFrame:
    """(file, line, marker_type, text[, author, date]): each line's first debt marker outside string literals.

    ``only`` keeps some marker types; ``blame`` is (file, line, author, author_ts).
    """
    lines = lines_in_context(files, exts=EXTENSIONS["debt"])
    t = F.col("t")
    inside = F.filter(F.split(t, r'(?<!\\)"', -1), lambda x, i: i % 2 == 1)
    number, texts = None, []
    names = [m for m in rules.MARKERS if only is None or m.lower() in set(only)]
    if not names:
        return lines.select("file", "line", F.lit("").alias("marker_type"), F.lit("").alias("text")).limit(0)
    for k, m in enumerate(names):
        cond = (has(t, m + ":") | has(t, m + "(") | has(t, m + " ")) & ~F.exists(inside, lambda x: F.contains(x, F.lit(m)))  # noqa: B023
        number = F.when(cond, k) if number is None else number.when(cond, k)
        texts.append(F.regexp_extract("text", m + r":*\(*\s*(.*?)\s*(?:\*/)*\)*\s*$", 1))
    k = F.col("k")
    text = F.lit(None).cast("string")
    for i, x in enumerate(texts):
        text = F.when(k == i, x).otherwise(text)
    out = lines.where(any_contains(t, names)).select("*", number.alias("k")).where("k IS NOT NULL").select("file", "line", rules.attribute(k, [m.lower() for m in names]).alias("marker_type"), text.alias("text"))
    if blame is not None:
        from auditlake.functions.scalars import approximate_date

        out = out.join(blame.select("file", "line", "author", approximate_date(F.col("author_ts")).alias("date")), ["file", "line"], "left")
    return out


def debt_summary(items: DataFrame) -> DataFrame:
    count = lambda m: F.count_if(F.col("marker_type") == m).alias(m)
    return items.agg(F.count("*").alias("total"), count("todo"), count("fixme"), count("hack"), count("xxx"))


def debt_by(items: DataFrame, column: str = "author") -> DataFrame:
    """Items of each author (null: unknown)."""
    return items.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("items"))


def debt_check(files: DataFrame) -> DataFrame:
    """The gate's own count: every marker of every line that starts as a C comment."""
    lines = lines_in_context(files, exts=EXTENSIONS["debt_check"])
    t = F.col("t")
    found = F.filter(F.array(*map(F.lit, rules.CHECK_MARKERS)), lambda m: F.contains(t, m))
    return lines.where(starts(t, "//", "/*", "*")).select("file", "line", F.explode(found).alias("marker"))


# --- error handling, dead code, types ------------------------------------------------------


def error_handling(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """(file, line, kind, context, severity) of swallowed and unhandled errors."""
    d = lines_in_context(files, exts=EXTENSIONS["errhandle"])
    t, nxt, ext = F.col("t"), F.col("next"), F.col("ext")
    if not include_tests:
        d = d.where(F.col("test_from").isNull() | (F.col("line") < F.col("test_from")))
    d = d.where(~starts(t, "//", "#"))
    finding = lambda cond, kind, severity: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    first = None
    for pattern, kind, severity in rules.ERRORS:
        s = F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
        first = F.when(has(t, pattern), s) if first is None else first.when(has(t, pattern), s)
    js, is_go = ext.isin("js", "ts", "tsx"), ext == "go"
    found = F.array_compact(F.array(
        F.when(ext == "rs", first), finding((ext == "rs") & starts(t, "let _ ="), "discard", "low"),
        finding((ext == "py") & t.isin("except:", "except Exception:", "except Exception as e:") & nxt.isin("pass", ""), "bare_except", "high"),
        finding(js & has(t, ".catch(") & (has(t, "{}") | F.endswith(t, F.lit(".catch()"))), "empty_catch", "medium"), finding(js & (t == "} catch (e) {") & (nxt == "}"), "empty_catch", "high"),
        finding(is_go & starts(t, "_ =", "_, _ ="), "discard", "medium"), finding(is_go & starts(t, "if err != nil {") & (nxt == "}"), "empty_error_handler", "high"),
    ))
    return d.select("file", "line", keep_right(t, 80).alias("context"), F.explode(found).alias("f")).select("file", "line", "f.kind", "context", "f.severity")


def error_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total_findings"), *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("unwrap", "expect", "discard", "panic")])


def dead_code(files: DataFrame, check_unreachable: bool = False) -> DataFrame:
    """(file, line, kind, context, severity) of suppressed warnings, unused imports, constant branches, dead assignments and empty blocks."""
    ext = F.col("ext")
    word = lambda c: F.regexp_replace(c, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")

    def more(ls, i, t, source):
        py = F.when(starts(t, "from "), F.regexp_extract(t, r"^from .*? import \s*([^,\s]+)", 1)).when(starts(t, "import "), F.regexp_extract(t, r"^import \s*([^,\s]+)", 1))
        inner = F.regexp_extract(t, r"^[^{}]*\{([^}]*)\}", 1)
        named = F.filter(F.transform(F.split(inner, ","), lambda x: strip(F.substring_index(strip(x), " as ", 1))), lambda x: F.rlike(x, F.lit(r"^\p{L}")))
        default = F.filter(F.array(F.btrim(F.regexp_extract(t, r"^import\s*(\S+)", 1), F.lit("*"))), lambda x: (x != "") & (x != "type"))
        names = F.when((ext == "py") & starts(t, "import ", "from "), F.filter(F.array(word(py)), lambda x: x != ""))
        names = names.when(ext.isin("js", "ts", "mjs", "tsx") & starts(t, "import ") & has(t, "from "), F.when(has(t, "{"), named).otherwise(default))
        before = F.filter(F.slice(ls, F.lit(1), i), lambda x: strip(x) != "")
        prev = F.when(t.isin("{}", "{ }") & (i > 0), F.coalesce(strip(F.get(before, F.size(before) - 1)), F.lit("")))
        unused = F.filter(names, lambda n: occurrences(source, n) <= 1)
        return {"unused": F.coalesce(F.size(unused), F.lit(0)), "prev": prev}

    d = lines_in_context(files, more, EXTENSIONS["deadcode"])
    t, prev, ctx = F.col("t"), F.col("prev"), keep_right(F.col("t"), 80)
    row = lambda kind, severity, context=ctx: F.struct(F.lit(kind).alias("kind"), context.alias("context"), F.lit(severity).alias("severity"))
    one = lambda cond, *a: F.when(cond, F.array(row(*a)))
    opens = any_contains(prev, ("fn ", "def ", "function ")) | F.endswith(prev, F.lit("else")) | F.endswith(prev, F.lit("else {"))
    parts = [
        one(any_contains(t, ("#[allow(dead_code)]", "# noqa: F401")), "allow_dead_code", "medium"),
        F.when((F.col("unused") > 0), F.array_repeat(row("unused_import", "low"), F.greatest(F.col("unused"), F.lit(0)))),
        one((ext == "rs") & starts(t, "let _ =", "let _x ="), "dead_assignment", "low"),
        one(opens, "empty_block", "low", F.concat(keep_right(prev, 40), F.lit(" → "), t)),
    ]
    if check_unreachable:
        parts += [one(t.isin("if false {", "if (false) {"), "unreachable_branch", "high"), one(t.isin("if true {", "if (true) {"), "unreachable_branch", "medium")]
    return d.select("file", "line", F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("f")).select("file", "line", "f.kind", "f.context", "f.severity")


def dead_code_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total_findings"), *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("allow_dead_code", "unused_import", "unreachable_branch", "dead_assignment", "empty_block")])


def type_coverage(files: DataFrame, min_pct: float = 0.0) -> DataFrame:
    """Per Python, TypeScript or JavaScript file with functions: how many say their types; at most 10 untyped names."""
    ext = F.col("ext")
    params = lambda t, end: F.split(F.regexp_extract(t, end, 1), ",")
    annotated = lambda ps: F.exists(ps, lambda p: (F.btrim(p) != "") & ~F.btrim(p).isin("self", "cls") & F.contains(p, F.lit(":")))

    def more(ls, i, t, source):
        docs = F.exists(F.slice(ls, F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5))), lambda x: any_contains(x, ("@param", "@returns", "@type")))
        return {"documented": F.when(starts(t, "function ", "async function ") & (i > 0), docs).otherwise(False)}

    d = lines_in_context(files, more, EXTENSIONS["typecov"])
    t = F.col("t")
    py, ts = ext.isin("py", "pyi"), ext.isin("ts", "tsx", "mts")
    named = starts(t, "function ", "async function ")
    method = ts & has(t, "): ") & (any_contains(t, ("=> {", "=> (")) | (starts(t, "async ") & has(t, "function ")) | starts(t, "public ", "private ", "protected "))
    is_fn = F.when(py, starts(t, "def ", "async def ")).otherwise(named | method)
    py_typed = (has(t, "->") & ~F.endswith(t, F.lit("-> None:"))) | annotated(params(t, r"^[^(]*\((.*)\)"))
    ts_typed = annotated(params(t, r"^[^(]*\(([^)]*)\)")) | (has(t, "): ") & ~F.endswith(t, F.lit("): void {"))) | has(t, "): void")
    typed = F.when(py, py_typed).when(ts, ts_typed).otherwise(F.col("documented"))
    name = F.when(py, F.regexp_extract(t, r"^(?:async )*(?:def )*([^(]*)", 1)).when(named, F.regexp_extract(t, r"^(?:async )*(?:function )*([^(]*)", 1)).otherwise(F.regexp_extract(t, r"^[^(]*?(\S+)\s*\(", 1))
    language = F.when(py, "Python").when(ts, "TypeScript").otherwise("JavaScript")
    d = d.where(is_fn).select("file", language.alias("language"), "line", typed.alias("typed"), name.alias("name"))
    untyped = F.slice(F.transform(F.array_sort(F.collect_list(F.when(~F.col("typed"), F.struct("line", "name")))), lambda x: x["name"]), 1, 10)
    g = d.groupBy("file", "language").agg(F.count("*").alias("total_functions"), F.count_if("typed").alias("typed_functions"), untyped.alias("untyped_functions"))
    pct = F.col("typed_functions") / F.col("total_functions") * 100.0
    return g.select("file", "language", "total_functions", "typed_functions", pct.alias("coverage_pct"), (pct < min_pct).alias("below_threshold"), "untyped_functions")


def type_summary(stats: DataFrame) -> DataFrame:
    total, typed = F.coalesce(F.sum("total_functions"), F.lit(0)), F.coalesce(F.sum("typed_functions"), F.lit(0))
    return stats.agg(F.count("*").alias("files_scanned"), F.count_if("below_threshold").alias("files_below_threshold"), F.when(total == 0, 100.0).otherwise(typed / F.nullif(total, F.lit(0)) * 100.0).alias("overall_coverage_pct"), total.alias("total_functions"), typed.alias("typed_functions"))


# --- taint -------------------------------------------------------------------------------

SENSITIVE = ("password", "secret", "token", "api_key", "apikey", "private_key", "credential", "auth_key", "access_key")
SINKS = {
    "py": [("LOG_LEAK", ("logging.", "logger.", "log.")), ("PRINT_LEAK", ("print(",)), ("DEBUG_LEAK", ("pprint", "repr("))],
    "js": [("LOG_LEAK", ("console.log", "console.warn", "console.error", "logger.", "log.info", "winston.", "bunyan.")), ("PRINT_LEAK", ("process.stdout", "process.stderr")), ("DEBUG_LEAK", ("console.debug", "console.trace"))],
    "go": [("LOG_LEAK", ("log.Print", "log.Fatal", "log.Panic", "fmt.Fprintf", "logrus.", "zap.")), ("PRINT_LEAK", ("fmt.Print", "fmt.Sprintf")), ("DEBUG_LEAK", ("fmt.Printf", "log.Printf"))],
    "rs": [
        ("LOG_LEAK", ("log::info!", "log::warn!", "log::error!", "log::debug!", "log::trace!")), ("PRINT_LEAK", ("println!", "print!", "eprintln!", "eprint!")),
        ("FILE_WRITE", ("std::fs::write", "File::create", "fs::File::create", "std::fs::OpenOptions")), ("UNFILTERED_RETURN", ("^pub fn",)), ("DEBUG_LEAK", ("dbg!", "debug!", "trace!")),
    ],
}
TAINT_LANGUAGE = {"py": "py", "pyi": "py", "js": "js", "mjs": "js", "ts": "js", "tsx": "js", "go": "go", "rs": "rs"}
TAINT_SEVERITY = {"LOG_LEAK": "high", "PRINT_LEAK": "high", "FILE_WRITE": "medium", "UNFILTERED_RETURN": "medium", "DEBUG_LEAK": "low"}


def assigned(t: str, lang: str) -> str | None:
    """The variable that a trimmed line assigns, if it is one assignment."""
    import re

    if lang == "rs":
        m = re.match(r"(?:let|const|static) +(?:mut )?([^\W]*)(?=\W)", t)
        return m[1] or None if m else None
    if lang == "py":
        left, eq, _ = t.partition("=")
        return left.strip() if eq and re.fullmatch(r"\w+", left.strip()) else None
    if lang == "js":
        m = re.match(r"(?:const|let|var) ([^=:; ]*)", t)
        return m[1].strip() or None if m else None
    if t.startswith("var ") and t[4:].split():
        return t[4:].split()[0]
    left, eq, _ = t.partition(":=")
    return left.strip() if eq and left.strip() and "," not in left else None


def taint_of(file: str, source: str, lang: str) -> tuple[list[tuple], int]:
    """Violations of one file, line by line, and how many variables are sensitive."""
    found, names = [], {}
    block = test = attribute = False
    for number, line in enumerate(source.removesuffix("\n").split("\n") if source else [], 1):
        line = line.removesuffix("\r")
        t = line.strip()
        if lang == "rs":
            if t.startswith("#[test]"):
                test = True
                continue
            if test:
                test = not t.startswith("}")
                continue
            if t.startswith("#[sensitive"):
                attribute = True
                continue
        block, attribute = block or attribute, False
        if "@sensitive" in t:
            block = True
            continue
        name = assigned(t, lang)
        if name is not None and (block or "Secret::" in t or any(k in name.lower() for k in SENSITIVE)):
            names[name] = None
            block = False
            continue
        if t:
            block = False
        hit = [n for n in names if n in line]
        if hit:
            kind = next((k for k, patterns in SINKS[lang] if any(t.startswith(p[1:]) if p[0] == "^" else p in t for p in patterns)), None)
            if kind:
                found += [(file, number, n, kind, TAINT_SEVERITY[kind], t if len(t) <= 60 else "…" + t[-59:]) for n in hit]
    return found, len(names)


TAINT_ROW = "file string, line bigint, variable string, violation_type string, severity string, context string, n_sensitive bigint"


def taint_rows(files: DataFrame) -> DataFrame:
    """Violations, and one row without a line for each file with sensitive variables; Python reads only files that can have some."""
    d = files.select("file", extension(F.col("file")).alias("ext"), "source").where(F.col("ext").isin(list(TAINT_LANGUAGE)))
    d = d.where(any_contains(F.lower("source"), SENSITIVE) | any_contains(F.col("source"), ("@sensitive", "Secret::", "#[sensitive")))

    def rows(file, ext, source):
        found, n = taint_of(file, source, TAINT_LANGUAGE[ext])
        return [(*r, None) for r in found] + [(file, None, None, None, None, None, n)]

    return rows_of_files(d, TAINT_ROW, rows, "file", "ext", "source")


def taint(files: DataFrame, min_severity: str = "low") -> DataFrame:
    """(file, line, variable, violation_type, severity, context): sensitive variables in a sink, later in the same file."""
    return taint_rows(files).where(F.col("line").isNotNull() & (rules.rank(F.col("severity")) >= rules.RANK[min_severity])).drop("n_sensitive")


def taint_summary(files: DataFrame) -> DataFrame:
    r = taint_rows(files)
    scanned = files.where(extension(F.col("file")).isin(EXTENSIONS["taint"])).agg(F.count("*").alias("total_files_scanned"))
    counts = r.agg(F.coalesce(F.sum("n_sensitive"), F.lit(0)).alias("sensitive_variables_found"), F.count("line").alias("violations_count"), *[F.count_if(F.col("severity") == s).alias(f"{s}_severity") for s in ("high", "medium", "low")])
    return scanned.crossJoin(counts)
