"""Relations read from source code: functions, documented items, fingerprints, imports, identifiers, literals.

Python is parsed by its own ``ast``.  The other languages go through one tokenizer that blanks comments and
literals and matches braces; what it can't know (a call's type, macros) is left out.  A file is one row, so files are
spread over tasks without a shuffle.  Files that don't parse give no rows.

Approximations of the brace languages: a function begins at its header and ends at its matching brace; branches are
counted by keyword within it, and by ``=>`` where that opens a match arm or an arrow function; C and C++ functions have
complexity 1, since only their declarators count.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.files import rows_of_files
from auditlake.functions.lines import extension

LANGUAGE = {e: n for n, es in {
    "Rust": "rs", "Python": "py pyi", "JavaScript": "js mjs cjs", "TypeScript": "ts tsx mts", "Go": "go", "C": "c h", "Cpp": "cpp cc cxx hpp", "CSharp": "cs", "Java": "java", "Php": "php", "Ruby": "rb",
    "Swift": "swift", "Kotlin": "kt kts", "Solidity": "sol", "Vyper": "vy", "Ocaml": "ml mli",
}.items() for e in es.split()}
#: Languages that have a name but no grammar.
WITHOUT_GRAMMAR = ("Kotlin", "Vyper")
_C_LIKE = r"\b(?:if|else|for|while|do|case|catch|foreach|switch)\b|\?(?![.?])"
BRANCH = {
    "Rust": r"\b(?:if|else|while|loop|for)\b|=>|\|[^|\n]*\|(?=\s*[\w{(])", "JavaScript": r"\b(?:if|else|for|while|do|case|catch)\b|=>|\?(?![.?])", "TypeScript": r"\b(?:if|else|for|while|do|case|catch)\b|=>|\?(?![.?:])",
    "Go": r"\b(?:if|else|for|switch|case|select)\b", "CSharp": _C_LIKE + "|=>", "Java": _C_LIKE + "|->", "Php": _C_LIKE, "Swift": r"\b(?:if|guard|else|case|for|while|repeat|catch)\b", "C": None, "Cpp": None,
    "Ruby": r"\b(?:if|elsif|unless|case|for|while|until|rescue|ensure|lambda)\b", "Solidity": r"\b(?:if|else|for|while|do)\b", "Ocaml": r"\b(?:if|else|match|for|while|try)\b",
}
_METHOD = r"^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|synchronized|unsafe|export|default)\s+)*[\w<>\[\],.?: ]*?\b(\w+)\s*\([^;{}]*\)[^;{}=]*\{"
HEADER = {
    "Rust": r"\bfn\s+(\w+)", "Go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "JavaScript": r"\bfunction\b\s*\*?\s*(\w*)\s*\(|^[ \t]+(?:async\s+|static\s+|get\s+|set\s+)*(?!if|for|while|switch|catch|function|return)(\w+)\s*\([^;{}()]*\)\s*\{|(\([^()]*\)|\b\w+)\s*=>",
    "TypeScript": r"\bfunction\b\s*\*?\s*(\w*)\s*(?:<[^>]*>)?\(|^[ \t]+(?:(?:public|private|protected|async|static|readonly|get|set)\s+)*(?!if|for|while|switch|catch|function|return)(\w+)\s*\([^;{}()]*\)\s*(?::[^;{}=]+)?\{|(\([^()]*\)|\b\w+)\s*(?::\s*[\w<>\[\]]+\s*)?=>",
    "C": r"^[A-Za-z_][\w \t*]*?\b(\w+)\s*\([^;{}]*\)\s*(?=[{;])", "Cpp": r"^[ \t]*[A-Za-z_][\w \t*&:<>,~]*?\b(\w+)\s*\([^;{}]*\)[^;{}]*(?=[{;])", "Java": _METHOD, "CSharp": _METHOD,
    "Php": r"\bfunction\s+(\w+)|\bclass\s+(\w+)", "Swift": r"\bfunc\s+(\w+)", "Solidity": r"\bfunction\s+(\w+)", "Ruby": r"^[ \t]*def\s+(?:self\.)?(\w+[?!]?)", "Ocaml": r"^let\s+(?:rec\s+)?(\w+)",
}
_RESERVED = {"if", "for", "while", "switch", "catch", "return", "else", "new", "do", "function", "throw", "using", "lock", "foreach"}


def blanked(source: str, language: str) -> str:
    """The source with comments and literals turned to blanks of the same length."""
    line_comment = r"#[^\n]*" if language in ("Ruby",) else r"//[^\n]*|#[^\n]*" if language == "Php" else r"//[^\n]*"
    quotes = r'"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`' + (r"|'(?:[^'\\\n]|\\.)'" if language in ("Rust", "C", "Cpp", "Java", "CSharp", "Go") else r"|'(?:[^'\\\n]|\\.)*'")
    gone = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(line_comment + r"|/\*.*?\*/|" + quotes, gone, source, flags=re.S)


def _end(code: str, at: int) -> int:
    """Where the body that opens at or after ``at`` ends; the statement's end if none opens."""
    depth = 0
    for k in range(at, len(code)):
        c = code[k]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return k
        elif c == ";" and depth == 0:
            return k
    return len(code) - 1


def _line(code: str, at: int) -> int:
    return code.count("\n", 0, at) + 1


_PY_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.ExceptHandler, ast.Lambda)
_PY_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def python_tree(source: str) -> ast.AST | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def functions_of(source: str, language: str) -> list[tuple[str, int, int, int, str]]:
    """(name, line, end line, complexity, body) of every function, outer ones before those within."""
    out = []
    if language == "Python":
        tree = python_tree(source)
        for n in ast.walk(tree) if tree else []:
            if isinstance(n, _PY_FUNCTION):
                score = 1 + sum(isinstance(c, _PY_BRANCH) for c in ast.walk(n))
                if n.decorator_list:
                    out.append(("<anonymous>", n.decorator_list[0].lineno, n.end_lineno, score, ""))
                out.append((n.name, n.lineno, n.end_lineno, score, ast.get_source_segment(source, n) or ""))
        return sorted(out, key=lambda r: (r[1], -r[2]))
    if language not in HEADER:
        return out
    code = blanked(source, language)
    for m in re.finditer(HEADER[language], code, re.M):
        name = next((g for g in m.groups() if g and not g.startswith("(")), "") if not (m.groups()[-1:] and len(m.groups()) == 3 and m[3]) else ""
        if name in _RESERVED:
            continue
        if language == "Ruby":
            end = re.compile(r"^%s" % re.match(r"[ \t]*", m[0])[0] + r"end\b", re.M).search(code, m.end())
            stop = end.end() - 1 if end else len(code) - 1
        else:
            stop = _end(code, m.start() if m[0].rstrip().endswith("{") else m.end())
        body = code[m.start() : stop + 1]
        branches = 0 if BRANCH[language] is None else len(re.findall(BRANCH[language], code[m.end() if m[0].rstrip().endswith("=>") else m.start() : stop + 1]))
        out.append((name or "<anonymous>", _line(code, m.start() + len(m[0]) - len(m[0].lstrip())), _line(code, stop), 1 + branches, body))
    return out


# --- documentation -----------------------------------------------------------------------

DOC_MARKS = {"Rust": ("///", "/**", "//!"), "Python": ("#",), "JavaScript": ("*", "/**"), "TypeScript": ("*", "/**"), "Solidity": ("///",), "Ocaml": ("(**",)}
_ITEM = {
    "Rust": r"^\s*pub(?:\([^)]*\))?\s+(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait)\s+(\w+)", "Go": r"^(func|type)\s+(?:\([^)]*\)\s*)?(\w+)", "JavaScript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+(\w+)",
    "TypeScript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+(\w+)", "Java": r"^(?:public\s+|abstract\s+|final\s+)*(class|interface|enum)\s+(\w+)", "CSharp": r"^(?:public\s+|abstract\s+|sealed\s+|static\s+)*(class|struct|interface)\s+(\w+)",
    "C": r"^(struct|enum)\s+(\w+)\s*\{", "Cpp": r"^(class|struct|enum)\s+(\w+)", "Php": r"^(function|class|interface)\s+(\w+)", "Ruby": r"^(def|class|module)\s+(\w+)", "Swift": r"^(?:public\s+)?(func|class|struct|enum|protocol|extension)\s+(\w+)",
    "Solidity": r"^(contract|function|struct|enum|interface)\s+(\w+)", "Ocaml": r"^(let|type|module)\s+(?:rec\s+)?(\w+)",
}
KIND = {"fn": "fn", "func": "fn", "function": "fn", "def": "fn", "let": "fn", "struct": "struct", "class": "struct", "type": "struct", "contract": "struct", "module": "struct", "extension": "struct", "enum": "enum", "trait": "trait", "interface": "trait", "protocol": "trait"}


def doc_items_of(source: str, language: str) -> list[tuple[str, str, int, bool]]:
    """(kind, name, line, documented) of public items: a doc comment in the four lines above (or a docstring)."""
    lines = source.split("\n")
    marks = DOC_MARKS.get(language, ("//", "/*"))
    above = lambda n: any(x.strip().startswith(marks) for x in lines[max(0, n - 5) : n - 1])
    out = []
    if language == "Python":
        tree = python_tree(source)
        for n in tree.body if tree else []:
            if isinstance(n, (*_PY_FUNCTION, ast.ClassDef)):
                out.append(("struct" if isinstance(n, ast.ClassDef) else "fn", n.name, n.lineno, bool(ast.get_docstring(n)) or above(n.lineno)))
        return out
    if language not in _ITEM:
        return out
    code, depth, in_impl = blanked(source, language), 0, None
    for number, x in enumerate(code.split("\n"), 1):
        if language == "Rust" and in_impl is None and re.match(r"\s*impl\b", x):
            in_impl = depth
        m = re.match(_ITEM[language], x)
        if m and (language in ("Rust", "Ruby") or depth == 0):
            kind = KIND[m[1]]
            out.append(("impl_fn" if kind == "fn" and in_impl is not None else kind, m[2], number, above(number)))
        depth = max(0, depth + x.count("{") - x.count("}"))
        if in_impl is not None and depth <= in_impl and "}" in x:
            in_impl = None
    return out


# --- fingerprints, imports, names ------------------------------------------------------------

_PY_TOKEN = {ast.If: "IF", ast.While: "WHILE", ast.For: "FOR", ast.AsyncFor: "FOR", ast.Match: "MATCH", ast.match_case: "ARM", ast.Assign: "LET", ast.AnnAssign: "LET", ast.AugAssign: "LET", ast.Return: "RET", ast.Call: "CALL", ast.Lambda: "LAMBDA", ast.Try: "TRY"}
_TOKEN = [("IF", r"\bif\b"), ("ELSE", r"\belse\b"), ("WHILE", r"\bwhile\b"), ("FOR", r"\b(?:for|foreach)\b"), ("LOOP", r"\b(?:loop|do|repeat)\b"), ("MATCH", r"\b(?:match|switch|select)\b"), ("ARM", r"\bcase\b|=>"), ("LET", r"\b(?:let|var|const)\b|:="), ("RET", r"\breturn\b"), ("TRY", r"\b(?:try|catch)\b"), ("CALL", r"\b\w+\s*\("), ("BLOCK", r"\{")]
_TOKENS = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _TOKEN))


def fingerprint_of(body: str, language: str, depth: int = 20) -> list[str]:
    """Kinds of the statements of a function, in the order of a walk; deeper than ``depth`` doesn't count."""
    out: list[str] = []
    if language == "Python":
        tree = python_tree(body) or python_tree("\n".join(x[len(body) - len(body.lstrip()) :] for x in body.split("\n")))

        def walk(n, d):
            if d > depth:
                return
            if type(n) in _PY_TOKEN:
                out.append(_PY_TOKEN[type(n)])
            for c in ast.iter_child_nodes(n):
                walk(c, d + 1)
            if isinstance(n, ast.If) and n.orelse:
                out.append("ELSE")

        if tree:
            walk(tree, 0)
        return out
    for m in _TOKENS.finditer(body[body.find("{") + 1 :] if "{" in body else ""):
        if m.lastgroup != "CALL" or m[0].split("(")[0].strip() not in _RESERVED | {"match", "fn", "func", "loop"}:
            out.append(m.lastgroup)
    return out


_IMPORT = {
    "Rust": r"^\s*(?:pub\s+)?use\s+([^;]+);|^\s*extern\s+crate\s+(\w+)", "JavaScript": r"\bimport\b[^'\"\n]*\bfrom\s*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]", "TypeScript": r"\bimport\b[^'\"\n]*\bfrom\s*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]",
    "Go": r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"|^\s+(?:[\w.]+\s+)?\"([^\"]+)\"\s*$", "C": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "Cpp": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "Java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "CSharp": r"^\s*using\s+([\w.]+)\s*;",
    "Php": r"^\s*(?:use\s+([\w\\]+)|(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"])", "Ruby": r"^\s*(?:require|require_relative|load|include)\s+['\"]?([\w/.:]+)", "Swift": r"^\s*import\s+(\w+)", "Solidity": r"^\s*import\s+[^'\"\n]*['\"]([^'\"]+)['\"]", "Ocaml": r"^\s*open\s+(\w+)",
}


def imports_of(source: str, language: str) -> list[tuple[str, int]]:
    """(module, line); of ``from m import n`` in Python it is n."""
    if language == "Python":
        tree = python_tree(source)
        out = [(a.name, n.lineno) for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names] if tree else []
        return sorted(out, key=lambda r: r[1])
    if language not in _IMPORT:
        return []
    out = []
    for number, x in enumerate(source.split("\n"), 1):
        if x.strip().startswith(("//", "*", "/*")):
            continue
        out += [(next(g for g in m.groups() if g).strip(), number) for m in re.finditer(_IMPORT[language], x)]
    return out


def identifiers_of(source: str, language: str) -> list[str]:
    """Names in order, consecutive repeats once."""
    if language == "Python":
        tree = python_tree(source)
        found = [(n.lineno, n.col_offset, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name)] if tree else []
        names = [x[2] for x in sorted(found)]
    else:
        names = [w for w in re.findall(r"\b[A-Za-z_]\w*", blanked(source, language)) if w not in _RESERVED]
    return [w for k, w in enumerate(names) if not k or names[k - 1] != w]


def literals_of(source: str, language: str) -> list[str]:
    if language == "Python":
        tree = python_tree(source)
        return [n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)] if tree else []
    return [m[0][1:-1] for m in re.finditer(r'"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`', source)]


# --- as relations --------------------------------------------------------------------------------


def _relation(files: DataFrame, schema: str, rows_of) -> DataFrame:
    d = files.select("file", extension(F.col("file")).alias("ext"), "source").where(F.lower("ext").isin(list(LANGUAGE)) & F.col("source").isNotNull())
    return rows_of_files(d, schema, lambda file, ext, source: rows_of(file, source, LANGUAGE[ext.lower()]), "file", "ext", "source")


def functions(files: DataFrame) -> DataFrame:
    """(name, file, line, end_line, complexity, language)."""
    return _relation(files, "name string, file string, line bigint, end_line bigint, complexity int, language string", lambda f, s, g: [(n, f, a, z, c, g) for n, a, z, c, _ in functions_of(s, g)] if g not in WITHOUT_GRAMMAR else [])


def doc_items(files: DataFrame) -> DataFrame:
    """(file, kind, name, line, documented)."""
    return _relation(files, "file string, kind string, name string, line bigint, documented boolean", lambda f, s, g: [(f, *r) for r in doc_items_of(s, g)])


def fingerprints(files: DataFrame) -> DataFrame:
    """(file, function, line, end_line, tokens)."""
    return _relation(files, "file string, function string, line bigint, end_line bigint, tokens array<string>", lambda f, s, g: [(f, n, a, z, fingerprint_of(b, g)) for n, a, z, _, b in functions_of(s, g)])


def imports(files: DataFrame) -> DataFrame:
    """(source_module, imported_module, line)."""
    return _relation(files, "source_module string, imported_module string, line bigint", lambda f, s, g: [(f, *r) for r in imports_of(s, g)])


def identifiers(files: DataFrame) -> DataFrame:
    return _relation(files, "file string, pos int, name string", lambda f, s, g: [(f, k, w) for k, w in enumerate(identifiers_of(s, g))])


def string_literals(files: DataFrame) -> DataFrame:
    return _relation(files, "file string, pos int, value string", lambda f, s, g: [(f, k, w) for k, w in enumerate(literals_of(s, g))])


def languages(files: DataFrame) -> DataFrame:
    """(file, language, has_grammar): detection by the lower-cased suffix."""
    pairs = F.create_map(*[F.lit(x) for e, g in LANGUAGE.items() for x in (e, g)])
    g = F.coalesce(pairs[F.lower(extension(F.col("file")))], F.lit("Unknown"))
    return files.select("file", g.alias("language"), (~g.isin("Unknown", *WITHOUT_GRAMMAR)).alias("has_grammar"))
