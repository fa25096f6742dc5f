"""Registered queries of the analyzers and the SQL they are compared with.

Every query runs over whole tables.  Texts of ``documents`` stand for files whose suffix follows their
language, beside a small code corpus of our own; numeric tables stand for churn, coverage, checks and graphs.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.lines import any_contains, explode_lines, strip
from auditlake.functions.scalars import KEYWORDS, TOKEN, license_class
from auditlake.functions.shipping import ship
from auditlake.operators import analyzers as an
from auditlake.operators import code, compare, metrics, mutants, packages, rules
from auditlake.plans.samples import SAMPLES, VALUES
from auditlake.streaming import watch

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUFFIX = {"en": "rs", "de": "py", "fr": "js", "es": "go"}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, source): all documents, and the code corpus."""
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    ext = F.coalesce(F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])[F.col("lang")], F.lit("txt"))
    d = d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file"), F.col("text").alias("source"))
    return d.unionByName(spark.createDataFrame(list(SAMPLES.items()), "file string, source string"))


FILES = f"""files AS (SELECT 'doc' || doc_id || CASE lang {" ".join(f"WHEN '{k}' THEN '.{v}'" for k, v in SUFFIX.items())} ELSE '.txt' END AS file, text AS source
FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL UNION ALL SELECT * FROM (VALUES {VALUES}) v(file, source)),
arrays AS (SELECT file, regexp_extract(file, '\\.([^./]+)$', 1) AS ext, source, string_split(regexp_replace(source, '\\r?\\n$', ''), chr(10)) AS ls FROM files WHERE source <> '')"""
LINES = FILES + """, raw AS (SELECT file, ext, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text FROM arrays),
lines AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM raw)"""
RIGHT80 = "CASE WHEN length(t) > 80 THEN '…' || right(t, 79) ELSE t END"


def among(exts) -> str:
    return "ext IN (" + ", ".join(f"'{e}'" for e in exts) + ")"


def sql_rules(table: list[tuple]) -> str:
    """CASE chain and attribute columns of a rule table."""
    lit = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {lit(r[0])}, {lit(r[1])}, {lit(r[2])}, {lit(r[3])}, {lit(r[4])}, {lit(r[5])})" for k, r in enumerate(table))
    return f"rules AS (SELECT * FROM (VALUES {rows}) r(k, rule_id, category, confidence, severity, pattern, also))"


# --- lines ---------------------------------------------------------------------------------


@query("line_stats", """
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))) AS t FROM documents WHERE text <> '')
SELECT doc_id, count(*) AS total_lines, count(*) FILTER (trim(t) = '') AS blank_lines,
       count(*) FILTER (starts_with(trim(t), '#')) AS comment_lines,
       count(*) FILTER (trim(t) <> '' AND NOT starts_with(trim(t), '#')) AS code_lines
FROM l GROUP BY doc_id""")
def line_stats(spark, sf_dir):
    lines = explode_lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    t = strip(F.col("text"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("total_lines"), F.count_if(t == "").alias("blank_lines"), F.count_if(F.startswith(t, F.lit("#"))).alias("comment_lines"), F.count_if((t != "") & ~F.startswith(t, F.lit("#"))).alias("code_lines"))


COMMENTS = LINES + """, kinds AS (SELECT file, CASE WHEN t = '' THEN 0
 WHEN (CASE WHEN ext IN ('py', 'pyi', 'rb') THEN starts_with(t, '#') WHEN ext = 'php' THEN starts_with(t, '//') OR starts_with(t, '#') OR starts_with(t, '*') OR starts_with(t, '/*')
       ELSE starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*') END)
  AND NOT (CASE WHEN ext = 'rs' THEN starts_with(t, '///') OR starts_with(t, '//!') OR starts_with(t, '/**') WHEN ext IN ('js', 'ts', 'tsx', 'java', 'cs') THEN starts_with(t, '/**') OR starts_with(t, '* ') OR starts_with(t, '*/')
       WHEN ext IN ('py', 'pyi') THEN starts_with(t, '\"\"\"') OR starts_with(t, '''''''') ELSE false END) THEN 1 ELSE 2 END AS k FROM lines WHERE """ + among(an.EXTENSIONS["comments"]) + """),
stats AS (SELECT f.file, count(k) FILTER (k = 2) AS code_lines, count(k) FILTER (k = 1) AS comment_lines, count(k) FILTER (k = 0) AS blank_lines, count(k) AS total_lines
 FROM (SELECT file FROM files WHERE regexp_extract(file, '\\.([^./]+)$', 1) IN (""" + ", ".join(f"'{e}'" for e in an.EXTENSIONS["comments"]) + """)) f LEFT JOIN kinds USING (file) GROUP BY f.file),
rated AS (SELECT *, CASE WHEN code_lines + comment_lines = 0 THEN 1.0 ELSE comment_lines::DOUBLE / (code_lines + comment_lines) END AS comment_ratio FROM stats)"""


@query("comment_stats", f"WITH {COMMENTS} SELECT *, comment_ratio < 0.05 AND code_lines + comment_lines > 10 AS below_threshold FROM rated")
def comment_stats(spark, sf_dir):
    return an.comment_stats(corpus(spark, sf_dir))


@query("comment_gate", f"WITH {COMMENTS} SELECT 'comments' AS name, count(*) FILTER (comment_ratio < 0.05 AND code_lines + comment_lines > 10) <= 0 AS passed, (count(*) FILTER (comment_ratio < 0.05 AND code_lines + comment_lines > 10))::DOUBLE AS score, 0.0::DOUBLE AS threshold FROM rated")
def comment_gate(spark, sf_dir):
    return compare.check("comments", an.comment_summary(an.comment_stats(corpus(spark, sf_dir))))


_token = TOKEN.replace("'", "''")
_words = ", ".join(f"'{w}'" for w in KEYWORDS)


@query("halstead", f"""WITH {FILES}, cut AS (SELECT file, list_transform(ls, lambda x: CASE WHEN contains(x, '//') THEN string_split(x, '//')[1] ELSE string_split(x, '#')[1] END) AS ls FROM arrays WHERE {among(an.EXTENSIONS["halstead"])}),
tok AS (SELECT file, list_transform(flatten(list_transform(ls, lambda x: regexp_extract_all(x, '{_token}'))), lambda x: CASE WHEN x[1] IN ('"', '''') THEN '__literal__' ELSE x END) AS ts FROM cut),
parts AS (SELECT file, list_filter(ts, lambda x: x IN ({_words}) OR NOT regexp_matches(x, '^[\\p{{L}}\\p{{N}}_]')) AS ops, list_filter(ts, lambda x: NOT (x IN ({_words}) OR NOT regexp_matches(x, '^[\\p{{L}}\\p{{N}}_]'))) AS opds FROM tok),
n AS (SELECT file, len(list_distinct(ops))::BIGINT AS distinct_operators, len(list_distinct(opds))::BIGINT AS distinct_operands, len(ops)::BIGINT AS total_operators, len(opds)::BIGINT AS total_operands FROM parts),
every AS (SELECT * FROM n UNION ALL SELECT file, 0, 0, 0, 0 FROM files WHERE source = '' AND regexp_extract(file, '\\.([^./]+)$', 1) IN ({", ".join(f"'{e}'" for e in an.EXTENSIONS["halstead"])})),
v AS (SELECT *, CASE WHEN distinct_operators + distinct_operands > 1 THEN (total_operators + total_operands) * log2((distinct_operators + distinct_operands)::DOUBLE) ELSE 0.0 END AS volume,
 CASE WHEN distinct_operands > 0 THEN distinct_operators / 2.0::DOUBLE * (total_operands::DOUBLE / distinct_operands) ELSE 0.0 END AS difficulty FROM every)
SELECT file, distinct_operators, distinct_operands, total_operators, total_operands, round(volume, 5) AS volume, round(difficulty, 5) AS difficulty, round(volume / 3000.0, 7) AS bugs_estimated FROM v""")
def halstead(spark, sf_dir):
    h = an.halstead(corpus(spark, sf_dir))
    return h.select("file", "distinct_operators", "distinct_operands", "total_operators", "total_operands", F.round("volume", 5).alias("volume"), F.round("difficulty", 5).alias("difficulty"), F.round("bugs_estimated", 7).alias("bugs_estimated"))


# --- rule scans ------------------------------------------------------------------------------


def scan_sql(table, exts, extra_source="") -> str:
    return f"""WITH {LINES}, {sql_rules(table)}, hits AS (SELECT file, line, t, min(k) AS k FROM lines, rules
 WHERE {among(exts)} AND NOT (starts_with(t, '//') OR starts_with(t, '#') OR starts_with(t, '*')) AND contains(t, pattern) AND (also IS NULL OR contains(t, also)) GROUP BY file, line, t)
SELECT file, line, rule_id, category, severity, {RIGHT80} AS context FROM hits JOIN rules USING (k)"""


@query("sast_findings", scan_sql(rules.SAST, an.EXTENSIONS["sast"]))
def sast_findings(spark, sf_dir):
    return an.sast(corpus(spark, sf_dir)).select("file", "line", "rule_id", "category", "severity", "context")


@query("crypto_findings", scan_sql(rules.CRYPTO, an.EXTENSIONS["crypto"]))
def crypto_findings(spark, sf_dir):
    return an.crypto(corpus(spark, sf_dir)).select("file", "line", "rule_id", "category", "severity", "context")


PAGE_RULES = rules.SAST + [("PAGE-SCRIPT-001", "xss", "low", "low", "<script", "track("), ("PAGE-LINK-001", "ssrf", "low", "low", 'href="http', None)]


@query("page_rules", f"""WITH l AS (SELECT page_id, unnest(generate_series(1, len(string_split(html, chr(10))))) AS line, unnest(string_split(html, chr(10))) AS x FROM pages WHERE html <> ''), t AS (SELECT page_id, line, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS t FROM l),
{sql_rules(PAGE_RULES)}, hits AS (SELECT page_id, line, min(k) AS k FROM t, rules WHERE NOT (starts_with(t, '//') OR starts_with(t, '#') OR starts_with(t, '*')) AND contains(t, pattern) AND (also IS NULL OR contains(t, also)) GROUP BY page_id, line)
SELECT page_id, line, rule_id, severity FROM hits JOIN rules USING (k)""")
def page_rules(spark, sf_dir):
    files = read(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.regexp_replace("html", r"\n\z", "\n\n").alias("source"))
    lines = explode_lines(files).select("file", "line", strip(F.col("text")).alias("t"))
    return rules.scan(lines, PAGE_RULES).select(F.col("file").alias("page_id"), "line", "rule_id", "severity")


_secret = " ".join(f"WHEN contains(low, '{w}') THEN {k}" for k, (_, w, _s) in enumerate(rules.SECRETS))
_secret_rows = ", ".join(f"({k}, '{n}', '{s}')" for k, (n, _, s) in enumerate(rules.SECRETS))
_literal = an.LITERAL.replace("'", "''")


@query("secret_findings", f"""WITH {LINES}, d AS (SELECT file, line, text, lower(text) AS low, left(t, 80) AS context FROM lines WHERE {among(an.EXTENSIONS["secrets"])} AND NOT (starts_with(t, '//') OR starts_with(t, '#') OR starts_with(t, '*'))),
ok AS (SELECT * FROM d WHERE NOT ({" OR ".join(f"contains(low, '{w}')" for w in an._NOT_SECRET)})),
w AS (SELECT file, line, context, CASE {_secret} END AS k FROM ok WHERE contains(text, '=') OR contains(text, ':')),
names AS (SELECT * FROM (VALUES {_secret_rows}) v(k, pattern, severity)),
lit AS (SELECT file, line, context, unnest(regexp_extract_all(text, '{_literal}')) AS x FROM ok WHERE contains(text, '"') OR contains(text, '''')),
body AS (SELECT file, line, context, x[1] AS q, regexp_replace(x[2:], '\\\\.?', '', 'g') AS b FROM lit),
con AS (SELECT file, line, context, CASE WHEN ends_with(b, q) THEN left(b, length(b) - 1) ELSE b END AS c FROM body),
num AS (SELECT file, line, context, row_number() OVER () AS id, regexp_extract_all(hex(encode(c)), '..') AS h FROM con WHERE strlen(c) >= 12),
bytes AS (SELECT id, file, line, context, unnest(h) AS b, len(h)::DOUBLE AS n FROM num), counts AS (SELECT id, file, line, context, n, b, count(*)::DOUBLE AS c FROM bytes GROUP BY ALL),
e AS (SELECT id, file, line, context, sum(-(c / n) * log2(c / n)) AS entropy FROM counts GROUP BY id, file, line, context)
SELECT file, line, 'pattern' AS kind, pattern AS pattern, context, NULL::DOUBLE AS entropy, severity FROM w JOIN names USING (k)
UNION ALL SELECT file, line, 'entropy', 'high_entropy_string', context, round(entropy, 6), CASE WHEN entropy >= 5.5 THEN 'high' ELSE 'medium' END FROM e WHERE entropy >= 3.0""")
def secret_findings(spark, sf_dir):
    s = an.secrets(corpus(spark, sf_dir), min_entropy=3.0)
    return s.select("file", "line", "kind", F.regexp_replace("pattern", r" \(entropy=.*", "").alias("pattern"), "context", F.round("entropy", 6).alias("entropy"), "severity")


_debt_case = " ".join(f"WHEN (contains(t, '{m}:') OR contains(t, '{m}(') OR contains(t, '{m} ')) AND len(list_filter(string_split(t, '\"'), lambda x, i: i % 2 = 0 AND contains(x, '{m}'))) = 0 THEN '{m}'" for m in rules.MARKERS)
_debt_text = " ".join(f"WHEN m = '{m}' THEN regexp_extract(text, '{m}:*\\(*\\s*(.*?)\\s*(?:\\*/)*\\)*\\s*$', 1)" for m in rules.MARKERS)


@query("debt_markers", f"WITH {LINES}, m AS (SELECT file, line, text, CASE {_debt_case} END AS m FROM lines WHERE {among(an.EXTENSIONS['debt'])}) SELECT file, line, lower(m) AS marker_type, CASE {_debt_text} END AS text FROM m WHERE m IS NOT NULL")
def debt_markers(spark, sf_dir):
    return an.debt(corpus(spark, sf_dir))


@query("debt_check", f"WITH {LINES}, m AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{m}{chr(39)})' for m in rules.CHECK_MARKERS)}) v(marker)) SELECT file, line, marker FROM lines, m WHERE {among(an.EXTENSIONS['debt_check'])} AND (starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*')) AND contains(t, marker)")
def debt_check(spark, sf_dir):
    return an.debt_check(corpus(spark, sf_dir))


_err_case = " ".join(f"WHEN contains(t, '{p}') THEN '{k}'" for p, k, _ in rules.ERRORS)
_err_sev = " ".join(f"WHEN '{k}' THEN '{s}'" for _, k, s in rules.ERRORS)


@query("error_handling", f"""WITH {LINES}, w AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY file ORDER BY line), '') AS nxt, min(CASE WHEN contains(t, '#[cfg(test)]') OR contains(t, 'mod tests') THEN line END) OVER (PARTITION BY file) AS test_from FROM lines WHERE {among(an.EXTENSIONS["errhandle"])}),
d AS (SELECT *, {RIGHT80} AS context FROM w WHERE (test_from IS NULL OR line < test_from) AND NOT (starts_with(t, '//') OR starts_with(t, '#'))), r AS (SELECT *, CASE {_err_case} END AS kind FROM d WHERE ext = 'rs')
SELECT file, line, kind, context, CASE kind {_err_sev} END AS severity FROM r WHERE kind IS NOT NULL
UNION ALL SELECT file, line, 'discard', context, 'low' FROM d WHERE ext = 'rs' AND starts_with(t, 'let _ =')
UNION ALL SELECT file, line, 'bare_except', context, 'high' FROM d WHERE ext = 'py' AND t IN ('except:', 'except Exception:', 'except Exception as e:') AND nxt IN ('pass', '')
UNION ALL SELECT file, line, 'empty_catch', context, 'medium' FROM d WHERE ext IN ('js', 'ts', 'tsx') AND contains(t, '.catch(') AND (contains(t, '{{}}') OR ends_with(t, '.catch()'))
UNION ALL SELECT file, line, 'empty_catch', context, 'high' FROM d WHERE ext IN ('js', 'ts', 'tsx') AND t = '}} catch (e) {{' AND nxt = '}}'
UNION ALL SELECT file, line, 'discard', context, 'medium' FROM d WHERE ext = 'go' AND (starts_with(t, '_ =') OR starts_with(t, '_, _ ='))
UNION ALL SELECT file, line, 'empty_error_handler', context, 'high' FROM d WHERE ext = 'go' AND starts_with(t, 'if err != nil {{') AND nxt = '}}'""")
def error_handling(spark, sf_dir):
    return an.error_handling(corpus(spark, sf_dir))


@query("dead_code", f"""WITH {LINES}, w AS (SELECT l.*, a.source, last_value(CASE WHEN t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY l.file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, {RIGHT80} AS context FROM lines l JOIN arrays a USING (file) WHERE l.{among(an.EXTENSIONS["deadcode"])}),
n AS (SELECT *, regexp_replace(CASE WHEN starts_with(t, 'from ') THEN regexp_extract(t, '^from .*? import \\s*([^,\\s]+)', 1) ELSE regexp_extract(t, '^import \\s*([^,\\s]+)', 1) END, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') AS name FROM w WHERE ext = 'py' AND (starts_with(t, 'import ') OR starts_with(t, 'from '))
 UNION ALL SELECT *, unnest(CASE WHEN contains(t, '{{') THEN list_filter(list_transform(string_split(regexp_extract(t, '^[^{{}}]*\\{{([^}}]*)\\}}', 1), ','), lambda x: trim(string_split(trim(x), ' as ')[1])), lambda x: regexp_matches(x, '^\\p{{L}}')) ELSE list_filter([trim(regexp_extract(t, '^import\\s*(\\S+)', 1), '*')], lambda x: x <> '' AND x <> 'type') END) FROM w WHERE ext IN ('js', 'ts', 'mjs', 'tsx') AND starts_with(t, 'import ') AND contains(t, 'from '))
SELECT file, line, 'allow_dead_code' AS kind, context, 'medium' AS severity FROM w WHERE contains(t, '#[allow(dead_code)]') OR contains(t, '# noqa: F401')
UNION ALL SELECT file, line, 'unused_import', context, 'low' FROM n WHERE name <> '' AND (length(source) - length(replace(source, name, ''))) // length(name) <= 1
UNION ALL SELECT file, line, 'dead_assignment', context, 'low' FROM w WHERE ext = 'rs' AND (starts_with(t, 'let _ =') OR starts_with(t, 'let _x ='))
UNION ALL SELECT file, line, 'empty_block', (CASE WHEN length(prev) > 40 THEN '…' || right(prev, 39) ELSE prev END) || ' → ' || t, 'low' FROM w WHERE t IN ('{{}}', '{{ }}') AND (contains(prev, 'fn ') OR contains(prev, 'def ') OR contains(prev, 'function ') OR ends_with(prev, 'else') OR ends_with(prev, 'else {{'))
UNION ALL SELECT file, line, 'unreachable_branch', context, CASE WHEN contains(t, 'false') THEN 'high' ELSE 'medium' END FROM w WHERE t IN ('if false {{', 'if (false) {{', 'if true {{', 'if (true) {{')""")
def dead_code(spark, sf_dir):
    return an.dead_code(corpus(spark, sf_dir), check_unreachable=True)


@query("type_coverage", f"""WITH {LINES}, w AS (SELECT *, coalesce(bool_or(contains(t, '@param') OR contains(t, '@returns') OR contains(t, '@type')) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS doc FROM lines WHERE {among(an.EXTENSIONS["typecov"])}),
f AS (SELECT *, CASE WHEN ext IN ('py', 'pyi') THEN 'Python' WHEN ext IN ('ts', 'tsx', 'mts') THEN 'TypeScript' ELSE 'JavaScript' END AS language, starts_with(t, 'function ') OR starts_with(t, 'async function ') AS named FROM w),
g AS (SELECT *, CASE language WHEN 'Python' THEN starts_with(t, 'def ') OR starts_with(t, 'async def ') WHEN 'TypeScript' THEN named OR (contains(t, '): ') AND (contains(t, '=> {{') OR contains(t, '=> (') OR (starts_with(t, 'async ') AND contains(t, 'function ')) OR starts_with(t, 'public ') OR starts_with(t, 'private ') OR starts_with(t, 'protected '))) ELSE named END AS is_fn FROM f),
p AS (SELECT *, string_split(CASE language WHEN 'Python' THEN regexp_extract(t, '^[^(]*\\((.*)\\)', 1) ELSE regexp_extract(t, '^[^(]*\\(([^)]*)\\)', 1) END, ',') AS ps FROM g WHERE is_fn),
q AS (SELECT file, language, CASE language WHEN 'Python' THEN (contains(t, '->') AND NOT ends_with(t, '-> None:')) OR len(list_filter(ps, lambda x: trim(x) NOT IN ('', 'self', 'cls') AND contains(x, ':'))) > 0
 WHEN 'TypeScript' THEN len(list_filter(ps, lambda x: trim(x) NOT IN ('', 'self', 'cls') AND contains(x, ':'))) > 0 OR (contains(t, '): ') AND NOT ends_with(t, '): void {{')) OR contains(t, '): void') ELSE doc END AS typed FROM p)
SELECT file, language, count(*) AS total_functions, count(*) FILTER (typed) AS typed_functions, (count(*) FILTER (typed))::DOUBLE / count(*) * 100.0 AS coverage_pct FROM q GROUP BY file, language""")
def type_coverage(spark, sf_dir):
    return an.type_coverage(corpus(spark, sf_dir)).select("file", "language", "total_functions", "typed_functions", "coverage_pct")


@query("long_files", f"WITH {FILES} SELECT file, len(ls)::BIGINT AS lines, 20::BIGINT AS threshold FROM arrays WHERE {among(an.EXTENSIONS['linelen'])} AND len(ls) > 20")
def long_files(spark, sf_dir):
    return an.long_files(corpus(spark, sf_dir), 20)


@query("mutation_points", f"WITH {FILES} SELECT file, (CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in (['js', 'ts', 'mjs', 'tsx'] if g == 'js' else [g]))}) THEN " + " + ".join(f"(length(source) - length(replace(source, '{p}', ''))) // {len(p)}" for p in ps) for g, ps in mutants.POINTS.items()) + " ELSE 0 END)::BIGINT AS points FROM (SELECT file, source, regexp_extract(file, '\\.([^./]+)$', 1) AS ext FROM files)")
def mutation_points(spark, sf_dir):
    return mutants.mutation_points(corpus(spark, sf_dir))


@query("taint_violations")
def taint_violations(spark, sf_dir):
    return an.taint(corpus(spark, sf_dir))


@query("mutant_list")
def mutant_list(spark, sf_dir):
    return mutants.mutants(corpus(spark, sf_dir), limit=None)


# --- code relations -----------------------------------------------------------------------------


@query("functions")
def functions(spark, sf_dir):
    return code.functions(corpus(spark, sf_dir))


@query("doc_coverage")
def doc_coverage(spark, sf_dir):
    return code.doc_items(corpus(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("total"), F.count_if("documented").alias("documented"))


@query("import_coupling")
def import_coupling(spark, sf_dir):
    return metrics.coupling(metrics.workspace_edges(code.imports(corpus(spark, sf_dir))))


@query("duplicate_functions")
def duplicate_functions(spark, sf_dir):
    return metrics.duplicates(code.fingerprints(corpus(spark, sf_dir)), least=2)


@query("cohesion")
def cohesion(spark, sf_dir):
    return metrics.cohesion(corpus(spark, sf_dir))


@query("property_coverage")
def property_coverage(spark, sf_dir):
    return metrics.property_coverage(metrics.tests(corpus(spark, sf_dir)))


@query("fuzz_targets")
def fuzz_targets(spark, sf_dir):
    from auditlake.functions.lines import lines_in_context

    files = corpus(spark, sf_dir)
    return metrics.fuzz_targets(metrics.signatures(lines_in_context(files)), metrics.harness_names(files), code.functions(files))


@query("languages", f"WITH {FILES}, e AS (SELECT file, lower(regexp_extract(file, '\\.([^./]+)$', 1)) AS x FROM files) SELECT file, CASE x {' '.join(f'WHEN {chr(39)}{e}{chr(39)} THEN {chr(39)}{g}{chr(39)}' for e, g in code.LANGUAGE.items())} ELSE 'Unknown' END AS language, x NOT IN ('kt', 'kts', 'vy') AND x IN ({', '.join(repr(e) for e in code.LANGUAGE)}) AS has_grammar FROM e")
def languages(spark, sf_dir):
    return code.languages(corpus(spark, sf_dir))


# --- metrics over tables ---------------------------------------------------------------------------


@query("crap_scores", """WITH c AS (SELECT l_partkey AS p, max(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS cov FROM lineitem GROUP BY 1), s AS (SELECT 'p' || p_partkey AS name, p_size::BIGINT AS complexity, coalesce(cov, 0.0)::DOUBLE AS coverage_pct FROM part LEFT JOIN c ON p = p_partkey),
r AS (SELECT *, complexity::DOUBLE * complexity * pow(1 - coverage_pct, 3) + complexity AS crap_score FROM s)
SELECT *, CASE WHEN crap_score > 30 THEN 'crappy' WHEN crap_score > 20 THEN 'acceptable' WHEN crap_score > 10 THEN 'good' ELSE 'excellent' END AS category FROM r""")
def crap_scores(spark, sf_dir):
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    fns = read(spark, sf_dir, "part").select(name("p_partkey").alias("name"), F.lit("part").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("end_line"), F.col("p_size").cast("long").alias("complexity"))
    cov = read(spark, sf_dir, "lineitem").select(name("l_partkey").alias("function"), (F.col("l_returnflag") == "R").cast("int").alias("hits"))
    return metrics.crap_scores(fns, cov).select("name", "complexity", "coverage_pct", "crap_score", "category")


@query("risk_map", """WITH c AS (SELECT 'p' || l_partkey AS file, count(*) AS churn FROM lineitem GROUP BY 1), f AS (SELECT 'p' || p_partkey AS file, p_size::BIGINT AS complexity, 1::BIGINT AS function_count FROM part),
r AS (SELECT file, churn, coalesce(complexity, 0) AS complexity, coalesce(function_count, 0) AS function_count FROM c LEFT JOIN f USING (file)), s AS (SELECT *, least(100, trunc(churn::DOUBLE * complexity::DOUBLE / 10.0)::INT) AS risk_score FROM r)
SELECT *, CASE WHEN risk_score >= 70 THEN 'DANGER' WHEN risk_score >= 40 THEN 'HIGH' WHEN risk_score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS category FROM s""")
def risk_map(spark, sf_dir):
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    churn = read(spark, sf_dir, "lineitem").groupBy(name("l_partkey").alias("file")).agg(F.count("*").alias("churn"))
    fns = read(spark, sf_dir, "part").select(name("p_partkey").alias("file"), F.col("p_name").alias("name"), F.lit(1).alias("line"), F.col("p_size").cast("long").alias("complexity"))
    return metrics.risk_map(churn, fns).select("file", "churn", "complexity", "function_count", "risk_score", "category")


@query("coupling", """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), o AS (SELECT a AS name, count(*) AS fan_out FROM e GROUP BY 1), i AS (SELECT b AS name, count(*) AS fan_in FROM e GROUP BY 1)
SELECT name, coalesce(fan_out, 0)::BIGINT AS fan_out, coalesce(fan_in, 0)::BIGINT AS fan_in, coalesce(fan_out, 0)::DOUBLE / (coalesce(fan_out, 0) + coalesce(fan_in, 0)) AS instability FROM o FULL JOIN i USING (name)""")
def coupling(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_module"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("imported_module"))
    return metrics.coupling(metrics.workspace_edges(e))


@query("token_pairs", """WITH s AS (SELECT item_id AS id, list_distinct(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark WHERE text IS NOT NULL), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w))::DOUBLE AS n, len(a.w) AS x, len(b.w) AS y FROM s a, s b WHERE a.id < b.id)
SELECT a, b, n / (x + y - n) AS jaccard FROM p WHERE n / (x + y - n) >= 0.2""")
def token_pairs(spark, sf_dir):
    return metrics.token_pairs(read(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("id"), F.split(F.lower("text"), r"\s+").alias("tokens")), 0.2)


# --- packages ------------------------------------------------------------------------------------------


LICENSE_SQL = "CASE WHEN contains(u, 'AGPL') THEN 'copyleft-strong' WHEN contains(u, 'LGPL') THEN 'copyleft-weak' WHEN contains(u, 'GPL-3') OR contains(u, 'GPL-2') OR contains(u, 'GPL-1') OR u = 'GPL' THEN 'copyleft-strong' WHEN regexp_matches(u, 'MPL|EUPL|CDDL|EPL') THEN 'copyleft-weak' WHEN regexp_matches(u, 'MIT|BSD|APACHE|ISC|ZLIB|WTFPL|PSF|CC0|UNLICENSE|0BSD|BOOST') THEN 'permissive' WHEN u IN ('', 'UNKNOWN', 'NONE') THEN 'unknown' ELSE 'other' END"


@query("license_lines", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), u AS (SELECT doc_id, x, upper(trim(x)) AS u FROM l WHERE contains(x, 'icense')) SELECT doc_id, {LICENSE_SQL} AS license_category, count(*) AS lines FROM u GROUP BY 1, 2")
def license_lines(spark, sf_dir):
    d = explode_lines(read(spark, sf_dir, "documents"), "doc_id", "text").where(any_contains(F.col("text"), ["icense"]))
    return d.groupBy("doc_id", license_class(F.col("text")).alias("license_category")).agg(F.count("*").alias("lines"))


PART_PACKAGES = "SELECT p_brand AS package, p_size::VARCHAR || '.0' AS version, CASE p_size % 6 WHEN 0 THEN 'MIT' WHEN 1 THEN 'LGPL-3.0' WHEN 2 THEN 'GPL-2.0' WHEN 3 THEN 'MPL-2.0' WHEN 4 THEN '' ELSE 'Custom' END AS license, CASE p_size % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'node' ELSE 'python' END AS ecosystem FROM part"


def part_packages(spark, sf_dir):
    s = F.col("p_size")
    lic = F.element_at(F.array(*map(F.lit, ["MIT", "LGPL-3.0", "GPL-2.0", "MPL-2.0", "", "Custom"])), (s % 6 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.concat(s.cast("string"), F.lit(".0")).alias("version"), lic.alias("license"), F.element_at(F.array(*map(F.lit, packages.ECOSYSTEMS)), (s % 3 + 1).cast("int")).alias("ecosystem"))


@query("license_findings", f"WITH p AS ({PART_PACKAGES}), u AS (SELECT *, upper(license) AS u FROM p), c AS (SELECT *, {LICENSE_SQL} AS license_category FROM u), v AS (SELECT *, CASE " + " ".join(f"WHEN contains(u, '{d}') THEN 'license matches {d}'" for d in packages.DENY) + " ELSE '' END AS violation_reason FROM c) SELECT package, version, license, license_category, violation_reason <> '' AS violation, violation_reason, ecosystem FROM v WHERE violation_reason <> '' OR starts_with(license_category, 'copyleft')")
def license_findings(spark, sf_dir):
    return packages.license_findings(part_packages(spark, sf_dir))


@query("bill_of_materials", f"WITH p AS ({PART_PACKAGES}), u AS (SELECT *, 'pkg:' || CASE ecosystem WHEN 'rust' THEN 'cargo' WHEN 'node' THEN 'npm' ELSE 'pypi' END || '/' || CASE ecosystem WHEN 'python' THEN lower(package) ELSE package END || '@' || version AS purl FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY purl ORDER BY CASE ecosystem WHEN 'rust' THEN 0 WHEN 'node' THEN 1 ELSE 2 END, package, license) AS r FROM u) SELECT package AS name, version, CASE WHEN license = '' THEN 'NOASSERTION' ELSE license END AS license, ecosystem, purl FROM r WHERE r = 1")
def bill_of_materials(spark, sf_dir):
    return packages.components(part_packages(spark, sf_dir))


# --- comparisons -----------------------------------------------------------------------------------------


@query("health_by_user", "WITH c AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'sast' WHEN 'view' THEN 'licenses' ELSE 'debt' END AS name, value > 20 AS passed FROM events), w AS (SELECT user_id, passed, CASE name WHEN 'sast' THEN 3 WHEN 'licenses' THEN 2 ELSE 1 END AS w FROM c), s AS (SELECT user_id, (sum(CASE WHEN passed THEN w ELSE 0 END) * 100 // sum(w))::BIGINT AS score FROM w GROUP BY 1) SELECT user_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade FROM s")
def health_by_user(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "sast").when(F.col("event_type") == "view", "licenses").otherwise("debt")
    return compare.health(read(spark, sf_dir, "events").select("user_id", name.alias("name"), (F.col("value") > 20).alias("passed")), ["user_id"])


@query("report_diff", "WITH d AS (SELECT o_custkey AS name, o_orderdate < TIMESTAMP '1996-01-01' AS old, o_totalprice < 150000 AS ok FROM orders), b AS (SELECT name, bool_and(ok) AS b FROM d WHERE old GROUP BY 1), n AS (SELECT name, bool_and(ok) AS n FROM d WHERE NOT old GROUP BY 1) SELECT name, CASE WHEN b IS NULL THEN 'new' WHEN n IS NULL THEN 'gone' WHEN NOT b AND n THEN 'fixed' WHEN b AND NOT n THEN 'broken' ELSE 'same' END AS change FROM b FULL JOIN n USING (name)")
def report_diff(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).alias("old"), (F.col("o_totalprice") < 150000).alias("ok"))
    side = lambda c: d.where(c).groupBy("name").agg(F.bool_and("ok").alias("passed"))
    return compare.report_diff(side("old"), side("NOT old"))


@query("new_findings", "WITH e AS (SELECT user_id::VARCHAR AS file, hour(ts) AS line, event_type AS rule_id, value > 50 AS now FROM events), b AS (SELECT DISTINCT file, line, rule_id FROM e WHERE NOT now) SELECT DISTINCT file, line::BIGINT AS line, rule_id FROM e ANTI JOIN b USING (file, line, rule_id) WHERE now")
def new_findings(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.hour("ts").cast("long").alias("line"), F.col("event_type").alias("rule_id"), (F.col("value") > 50).alias("now"))
    return compare.new_findings(e.where("now").drop("now"), e.where("NOT now").drop("now")).distinct()


@query("history_last", "SELECT event_id, user_id FROM (SELECT *, epoch(ts) AS t FROM events ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 10)")
def history_last(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("ts", F.col("event_id").cast("string").alias("run_id"), "event_id", "user_id")
    return compare.history_last(e, 10).select("event_id", "user_id")


@query("line_islands", "WITH d AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS line FROM lineitem), i AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS i FROM d) SELECT file, min(line) AS first, max(line) AS last FROM i GROUP BY file, i")
def line_islands(spark, sf_dir):
    return compare.islands(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("line")))


@query("changed_files", "SELECT d.doc_id AS file FROM documents d LEFT JOIN (SELECT doc_id, n_chars + CASE lang WHEN 'de' THEN 1 ELSE 0 END AS size FROM documents WHERE source <> 'src7') c USING (doc_id) WHERE c.doc_id IS NULL OR c.size <> d.n_chars")
def changed_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    cache = d.where("source <> 'src7'").select(F.col("doc_id").alias("path"), F.lit(1).alias("last_modified"), (F.col("n_chars") + F.when(F.col("lang") == "de", 1).otherwise(0)).alias("size"))
    return compare.changed_files(d.select(F.col("doc_id").alias("file"), F.lit(1).alias("last_modified"), F.col("n_chars").alias("size")), cache).select("file")


@query("affected_functions", "WITH RECURSIVE e AS (SELECT DISTINCT c_custkey::VARCHAR AS caller, 'n' || c_nationkey AS callee FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), a AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS name FROM region UNION SELECT a.seed, e.caller FROM a JOIN e ON a.name = e.callee) SELECT * FROM a")
def affected_functions(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = read(spark, sf_dir, "customer").select(key("", "c_custkey").alias("caller"), key("n", "c_nationkey").alias("callee")).union(read(spark, sf_dir, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey")))
    return mutants.affected(read(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("name")), e.distinct())


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return watch.windowed_counts(read(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))
