"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.lines import any_contains


def byte_entropy(c: Column) -> Column:
    """Shannon entropy of a text's bytes in bits; 0 for an empty text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0))
    n = F.octet_length(c).cast("double")
    share = lambda b: F.size(F.filter(pairs, lambda y: y == b)).cast("double") / n
    return F.when(F.length(c) > 0, F.aggregate(F.array_sort(F.array_distinct(pairs)), F.lit(0.0), lambda acc, b: acc - share(b) * F.log2(share(b)))).otherwise(0.0)


def keep_right(c: Column, width: int) -> Column:
    """At most ``width`` characters; a longer text keeps its right end behind an ellipsis."""
    return F.when(F.length(c) > width, F.concat(F.lit("…"), F.right(c, F.lit(width - 1)))).otherwise(c)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty: 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def crap(complexity: Column, coverage: Column) -> Column:
    """c² (1 - cov)³ + c with the coverage ratio clamped to 0..1."""
    cov = F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage.cast("double")))
    c = complexity.cast("double")
    return c * c * F.pow(1 - cov, F.lit(3.0)) + c


def crap_band(score: Column) -> Column:
    return F.when(score > 30, "crappy").when(score > 20, "acceptable").when(score > 10, "good").otherwise("excellent")


def risk(churn: Column, effective: Column) -> Column:
    """Truncated churn times effective complexity over 10, at most 100."""
    return F.least(F.lit(100), (churn.cast("double") * effective.cast("double") / 10.0).cast("int"))


def risk_band(score: Column) -> Column:
    return F.when(score >= 70, "DANGER").when(score >= 40, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW")


def approximate_date(epoch: Column) -> Column:
    """YYYY-MM-DD by years of 365 and months of 30 days, as in the published reports (month 13 can occur)."""
    days = F.floor(epoch / 86400).cast("long")
    year, rest = F.floor(days / 365).cast("long") + 1970, F.pmod(days, F.lit(365))
    return F.format_string("%04d-%02d-%02d", year, F.floor(rest / 30).cast("long") + 1, F.pmod(rest, F.lit(30)) + 1)


LICENSE_CLASSES = [
    (("AGPL",), "copyleft-strong"), (("LGPL",), "copyleft-weak"), (("GPL-3", "GPL-2", "GPL-1"), "copyleft-strong"), (("MPL", "EUPL", "CDDL", "EPL"), "copyleft-weak"),
    (("MIT", "BSD", "APACHE", "ISC", "ZLIB", "WTFPL", "PSF", "CC0", "UNLICENSE", "0BSD", "BOOST"), "permissive"),
]


def license_class(c: Column) -> Column:
    u = F.upper(F.btrim(F.coalesce(c, F.lit(""))))
    out = None
    for k, (names, kind) in enumerate(LICENSE_CLASSES):
        cond = any_contains(u, names) | (u == "GPL" if k == 2 else F.lit(False))
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.when(u.isin("", "UNKNOWN", "NONE"), "unknown").otherwise("other")


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


KEYWORDS = "if else for while loop match switch case return break continue fn func function def let var const mut pub use import from class struct enum impl trait type interface new delete await async yield try catch finally throw raise with in as is not and or true false nil null None True False".split()
TOKEN = r""""[^"]*"?|'[^']*'?|[\p{L}\p{N}_]+|[-+*/%=<>!&|^~?:;,.()\[\]{}@][=>]?"""


def halstead_tokens(lines: Column) -> Column:
    """Operator and operand tokens of an array of lines; comments go, a quoted literal is one shared operand."""
    def of_line(x):
        code = F.when(F.contains(x, F.lit("//")), F.substring_index(x, "//", 1)).otherwise(F.substring_index(x, "#", 1))
        return F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))

    return F.transform(F.flatten(F.transform(lines, of_line)), lambda t: F.when(F.left(t, F.lit(1)).isin('"', "'"), F.lit("__literal__")).otherwise(t))


def is_operator(token: Column) -> Column:
    return token.isin(*KEYWORDS) | ~F.rlike(token, F.lit(r"^[\p{L}\p{N}_]"))
