"""Literal rule scans: a rule table becomes one CASE chain, so a line's first match needs no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.lines import has
from auditlake.functions.scalars import keep_right

#: (rule_id, category, confidence, severity, pattern, second pattern or None), in order of evaluation.
SAST = [
    ("SAST-SQL-001", "sql_injection", "medium", "high", 'format!("SELECT', None), ("SAST-SQL-002", "sql_injection", "medium", "high", 'format!("INSERT', None),
    ("SAST-SQL-003", "sql_injection", "medium", "high", 'format!("UPDATE', None), ("SAST-SQL-004", "sql_injection", "medium", "high", 'format!("DELETE', None),
    ("SAST-SQL-005", "sql_injection", "high", "critical", "execute(", "format!("), ("SAST-PATH-001", "path_traversal", "medium", "high", "Path::new(", "request"),
    ("SAST-PATH-002", "path_traversal", "medium", "high", "read_to_string(", "param"), ("SAST-PATH-003", "path_traversal", "high", "critical", "../", "user"),
    ("SAST-PATH-004", "path_traversal", "low", "medium", "join(", "input"), ("SAST-CMD-001", "cmd_injection", "high", "critical", "Command::new(", "input"),
    ("SAST-CMD-002", "cmd_injection", "high", "critical", "Command::new(", "request"), ("SAST-CMD-003", "cmd_injection", "medium", "high", ".arg(", "input"),
    ("SAST-CMD-004", "cmd_injection", "high", "critical", "shell(", None), ("SAST-EVAL-001", "code_execution", "high", "critical", "eval(", None),
    ("SAST-EVAL-002", "code_execution", "high", "critical", "exec(", "input"), ("SAST-DESER-001", "unsafe_deser", "medium", "high", "from_slice(", "request"),
    ("SAST-DESER-002", "unsafe_deser", "low", "medium", "unsafe {", None), ("SAST-DESER-003", "unsafe_deser", "medium", "high", "pickle.loads(", None),
    ("SAST-SSRF-001", "ssrf", "medium", "high", "reqwest::get(", "input"), ("SAST-SSRF-002", "ssrf", "medium", "high", "fetch(", "param"),
    ("SAST-XSS-001", "xss", "medium", "high", "innerHTML", "input"), ("SAST-XSS-002", "xss", "high", "critical", "dangerouslySetInnerHTML", None),
    ("SAST-XSS-003", "xss", "medium", "high", "document.write(", None),
]
CRYPTO = [
    ("CRYPTO-HASH-001", "weak_hash", None, "high", "Md5::", None), ("CRYPTO-HASH-002", "weak_hash", None, "high", "md5(", None), ("CRYPTO-HASH-003", "weak_hash", None, "high", "hashlib.md5(", None),
    ("CRYPTO-HASH-004", "weak_hash", None, "high", "hashlib.sha1(", None), ("CRYPTO-HASH-005", "weak_hash", None, "high", "Sha1::", None),
    ("CRYPTO-HASH-006", "weak_hash", None, "high", 'MessageDigest.getInstance("MD5")', None), ("CRYPTO-HASH-007", "weak_hash", None, "high", 'MessageDigest.getInstance("SHA-1")', None),
    ("CRYPTO-RAND-001", "insecure_random", None, "high", "rand::random()", None), ("CRYPTO-RAND-002", "insecure_random", None, "high", "random.random()", None),
    ("CRYPTO-RAND-003", "insecure_random", None, "high", "Math.random()", None), ("CRYPTO-RAND-004", "insecure_random", None, "high", "new Random()", None),
    ("CRYPTO-RAND-005", "insecure_random", None, "high", "rand.Intn(", None), ("CRYPTO-IV-001", "hardcoded_iv", None, "critical", 'iv = b"', None),
    ("CRYPTO-IV-002", "hardcoded_iv", None, "critical", "let iv = [0", None), ("CRYPTO-IV-003", "hardcoded_iv", None, "critical", 'nonce = b"', None),
    ("CRYPTO-CIPHER-001", "weak_cipher", None, "critical", "AES_ECB", None), ("CRYPTO-CIPHER-002", "weak_cipher", None, "critical", '"ECB"', None),
    ("CRYPTO-CIPHER-003", "weak_cipher", None, "critical", 'Cipher.getInstance("AES")', None), ("CRYPTO-CIPHER-004", "weak_cipher", None, "high", "DES", "Cipher"),
    ("CRYPTO-CIPHER-005", "weak_cipher", None, "high", "RC4", None), ("CRYPTO-TLS-001", "tls_config", None, "high", "SSLv3", None), ("CRYPTO-TLS-002", "tls_config", None, "high", "TLSv1_0", None),
    ("CRYPTO-TLS-003", "tls_config", None, "critical", "verify=False", None), ("CRYPTO-TLS-004", "tls_config", None, "critical", "danger_accept_invalid_certs(true)", None),
    ("CRYPTO-PWD-001", "password_hash", None, "critical", "sha256(password", None), ("CRYPTO-PWD-002", "password_hash", None, "critical", "md5(password", None),
]
#: (name, keyword on the lower-cased line, severity)
SECRETS = [(n, n if k is None else k, s) for n, k, s in [
    ("password_assign", "password", "high"), ("passwd_assign", "passwd", "high"), ("secret_key", None, "high"), ("api_key", None, "high"), ("apikey", None, "high"), ("api_secret", None, "high"),
    ("auth_token", None, "high"), ("access_token", None, "high"), ("private_key", None, "high"), ("aws_secret", None, "high"), ("aws_access_key", None, "high"), ("gh_token", None, "high"),
    ("github_token", None, "high"), ("slack_token", None, "high"), ("stripe_key", None, "high"), ("twilio_auth", None, "high"), ("pem_header", "-----BEGIN", "high"), ("database_url", None, "medium"),
    ("db_password", None, "medium"), ("connection_string", None, "medium"), ("jdbc_url", "jdbc:", "medium"), ("smtp_password", None, "medium"), ("bearer_token", "bearer ", "medium"),
]]
#: (pattern, kind, severity)
ERRORS = [(".unwrap()", "unwrap", "medium"), (".expect(", "expect", "low"), ("panic!(", "panic", "high"), ("unreachable!(", "unreachable", "low"), ("todo!()", "todo", "medium"), ("unimplemented!()", "unimplemented", "medium")]
MARKERS = ["TODO", "FIXME", "HACK", "XXX", "WARN", "BUG", "OPTIMIZE"]
CHECK_MARKERS = ["TODO", "FIXME", "HACK", "XXX", "BUG"]
ADVICE = {
    "sql_injection": "bind values as parameters", "path_traversal": "resolve the path and compare it with an allowed root", "cmd_injection": "pass fixed commands and separate arguments",
    "code_execution": "do not evaluate text that users control", "unsafe_deser": "check the data before it becomes objects", "ssrf": "allow known hosts only", "xss": "escape before it enters the page",
    "weak_hash": "use SHA-256 or better", "insecure_random": "draw from the system's secure source", "hardcoded_iv": "draw a new nonce for each message", "weak_cipher": "use an authenticated cipher",
    "tls_config": "verify certificates and use TLS 1.2 or later", "password_hash": "use a slow salted password hash",
}
RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def rank(c: Column) -> Column:
    out = F.lit(0)
    for name, k in RANK.items():
        out = F.when(c == name, k).otherwise(out)
    return out


def first_rule(line: Column, rules: list[tuple], min_confidence: str | None = None) -> Column:
    """Number (0-based) of the first rule whose patterns the line contains; rules below the confidence are left out."""
    out = None
    for k, (*_, confidence, _severity, pattern, also) in enumerate(rules):
        if min_confidence and RANK.get(confidence or "", 0) < RANK[min_confidence]:
            continue
        cond = has(line, pattern) if also is None else has(line, pattern) & has(line, also)
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(None).cast("int") if out is None else out


def attribute(number: Column, values: list) -> Column:
    """values[number] as an expression."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), number)


def scan(lines: DataFrame, rules: list[tuple], min_confidence: str | None = None) -> DataFrame:
    """(file, line, rule_id, category, confidence, severity, context, remediation) of each line's first match; comment lines are skipped.

    ``lines`` has (file, line, t), t trimmed.
    """
    t = F.col("t")
    d = lines.where(~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("#")) | F.startswith(t, F.lit("*"))))
    d = d.select("file", "line", "t", first_rule(t, rules, min_confidence).alias("k")).where("k IS NOT NULL")
    k = F.col("k")
    cat = attribute(k, [r[1] for r in rules])
    return d.select(
        "file", "line", attribute(k, [r[0] for r in rules]).alias("rule_id"), cat.alias("category"), attribute(k, [r[2] for r in rules]).alias("confidence"), attribute(k, [r[3] for r in rules]).alias("severity"),
        keep_right(t, 80).alias("context"), attribute(k, [ADVICE[r[1]] for r in rules]).alias("remediation"),
    )
