"""Line-level building blocks: every analyzer works on ``lines(file, ext, line, text)``.

Neighbouring lines come along as columns (``next``, ``previous``, ``test_from``), taken from the
file's own array of lines before it is exploded: no window, no shuffle, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends (SQL trim() only drops blanks)."""
    return F.btrim(c, F.lit(WHITE))


def has(c: Column, needle: str) -> Column:
    return F.contains(c, F.lit(needle))


def any_contains(c: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | has(c, n)
    return out


def starts(c: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def occurrences(c: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal (0 for an empty one)."""
    return F.when(F.length(needle) > 0, F.floor((F.length(c) - F.length(F.replace(c, needle, F.lit("")))) / F.length(needle))).otherwise(0).cast("long")


def line_array(source: Column) -> Column:
    """Lines of a text: no line after a final newline, one CR before each LF goes; none for an empty text."""
    return F.when(F.length(source) > 0, F.split(F.regexp_replace(source, r"\r?\n\z", ""), r"\r?\n", -1)).otherwise(F.array().cast("array<string>"))


def extension(file: Column) -> Column:
    return F.regexp_extract(file, r"\.([^./]+)$", 1)


def explode_lines(files: DataFrame, key: str = "file", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, line, text): 1-based lines."""
    pos = F.posexplode(line_array(F.col(source))).alias("__pos", "text")
    return files.select(key, *keep, pos).select(key, *keep, (F.col("__pos") + 1).cast("long").alias("line"), "text")


TEST_MARKS = ("#[cfg(test)]", "mod tests")


def lines_in_context(files: DataFrame, more=None, exts: Iterable[str] = ()) -> DataFrame:
    """(file, ext, line, text, t, next, test_from, *more) of files with one of ``exts`` (any if none is given).

    ``t`` is the trimmed line, ``next`` the next one's ("" at the end), ``test_from`` the first line that
    opens a test block (null if none).  ``more(lines, i, t, source)`` gives further named columns.
    """
    d = files.select("file", extension(F.col("file")).alias("ext"), "source")
    if exts:
        d = d.where(F.col("ext").isin(sorted(exts)))
    d = d.withColumn("ls", line_array(F.col("source")))
    test = F.array_position(F.transform("ls", lambda x: any_contains(x, TEST_MARKS)), True)
    d = d.withColumn("test_from", F.when(test > 0, test))

    def item(x, i):
        t = strip(x)
        nxt = F.coalesce(strip(F.get(F.col("ls"), i + 1)), F.lit(""))
        rest = [c.alias(n) for n, c in more(F.col("ls"), i, t, F.col("source")).items()] if more else []
        return F.struct((i + 1).cast("long").alias("line"), x.alias("text"), t.alias("t"), nxt.alias("next"), *rest)

    return d.select("file", "ext", "test_from", F.explode(F.transform("ls", item)).alias("l")).select("file", "ext", "test_from", "l.*")
