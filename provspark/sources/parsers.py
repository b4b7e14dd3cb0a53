"""Symbols and calls of source files in seven languages: `ast` for Python (an indentation scan where it doesn't parse), one scanner for the languages with braces.

A scan first blanks what is no code, so that positions stay (`lexer`), then finds declarations by the patterns of the language, pairs braces for their ends and nests them.
Order is that of appearance; lines count from 1 and include both ends.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.sources import lexer

#: Suffix -> language.
SUFFIXES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".java": "java", ".go": "go", ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h": "cpp",
}


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    parent: Symbol | None = None


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    calls: list[tuple[str, str, int]] = field(default_factory=list)  # caller, callee, line


def suffix_of(path: str) -> str:
    name = path.rpartition("/")[2]
    return "." + name.rpartition(".")[2].lower() if "." in name else ""


def language_of(path: F.Column) -> F.Column:
    """Language by suffix, null for none."""
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.try_element_at(known, F.concat(F.lit("."), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))))


# ---- Python


def parse_python(text: str) -> Parsed:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return parse_indented(text)
    out = Parsed()

    def visit(node: ast.AST, parent: Symbol | None, caller: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                s = Symbol("class" if isinstance(child, ast.ClassDef) else "function", child.name, child.lineno, child.end_lineno or child.lineno, parent)
                out.symbols.append(s)
                visit(child, s, caller if s.kind == "class" else s.name)
                continue
            if isinstance(child, ast.Call) and caller:
                f = child.func
                callee = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if callee:
                    out.calls.append((caller, callee, child.lineno))
            visit(child, parent, caller)

    visit(tree, None, "")
    return out


def parse_indented(text: str) -> Parsed:
    """By indentation: what a file that doesn't parse still shows."""
    out, lines, open_ = Parsed(), text.splitlines(), []
    for n, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        for _, s in open_:
            s.end = n
        if m := re.match(r"\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)", line):
            s = Symbol("class" if m[1] == "class" else "function", m[2], n, n, open_[-1][1] if open_ else None)
            out.symbols.append(s)
            open_.append((depth, s))
            continue
        caller = next((s.name for _, s in reversed(open_) if s.kind == "function"), "")
        if caller:
            out.calls += [(caller, c, n) for c in re.findall(r"([A-Za-z_]\w*)\s*\(", line) if c not in ("if", "while", "for", "return", "and", "or", "not", "in")]
    return out


# ---- languages with braces

ANNOTATION = re.compile(r"@(?!interface\b)[A-Za-z_]")
_NEW = re.compile(r"\bnew\s+\Z")
MODIFIERS = re.compile(r"\s*(?:(?:public|private|protected|static|final|abstract|strictfp|sealed)\s+)*")
COMMENTS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_NO_CALL = frozenset("if for while switch return catch function func fn sizeof new typeof await match loop else do try throw delete in of impl struct class enum trait interface defer go select case where unsafe move assert yield static_assert decltype alignof using operator".split())
_WORD = r"[A-Za-z_$][\w$]*"
#: language -> [(kind, pattern whose group `name` is the symbol)]; a pattern ends before its body.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("class", rf"\b(?:abstract\s+)?class\s+(?P<name>{_WORD})[^{{;]*(?=\{{)"),
        ("function", rf"\b(?:async\s+)?function\s*\*?\s*(?P<name>{_WORD})\s*(?:<[^>]*>)?\([^{{;]*(?=\{{)"),
        ("function", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?P<name>{_WORD})\s*(?:<[^>]*>)?\([^{{;=]*\)\s*(?::[^{{;=]+)?(?=\{{)"),
        ("variable", rf"\bvar\s+(?P<name>{_WORD})"),
    ],
    "java": [
        ("class", rf"\b(?:class|interface)\s+(?P<name>{_WORD})[^{{;]*(?=\{{)"),
        ("function", rf"(?:^|(?<=[{{;}}]))[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?(?:[\w$.<>\[\],?]+\s+)?(?P<name>{_WORD})\s*\([^{{;]*\)[^{{;]*(?=[{{;])"),
    ],
    "go": [
        ("function", rf"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\([^{{]*(?=\{{)"),
        ("class", r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\s*(?=\{)"),
        ("class", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)[^\n{]+"),
    ],
    "rust": [
        ("function", r"\bfn\s+(?P<name>\w+)[^{;]*(?=[{;])"),
        ("class", r"\b(?:struct|enum|trait)\s+(?P<name>\w+)[^{;]*(?=[{;])"),
        ("impl", r"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)[^{;]*(?=\{)"),
    ],
    "cpp": [
        ("class", r"\b(?:class|struct)\s+(?P<name>\w+)\s*(?:final\s*)?(?::[^{;]*)?(?=\{)"),
        ("function", r"(?:^|(?<=[{;}]))[ \t]*(?:(?:public|private|protected)[ \t]*:[ \t]*)?(?:[\w:<>,*&~ \t]+[\s*&])?(?:\w+::)*(?P<name>~?\w+)\s*\([^(){};]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?(?=[{;])"),
    ],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]


def parse_braces(text: str, language: str) -> Parsed:
    text = text.lstrip("﻿")
    bare = lexer.code_of(text, language)
    comments_gone = COMMENTS.sub(lambda m: m[0] if m[0][0] in "\"'" else re.sub(r"[^\n]", " ", m[0]), text) if language == "java" else ""
    starts = [0, *(m.end() for m in re.finditer("\n", bare))]
    closing, open_ = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            closing[open_.pop()] = m.start()

    def line(at: int) -> int:
        lo, hi = 0, len(starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if starts[mid] <= at else (lo, mid)
        return lo + 1

    code_before = [m.end() for m in re.finditer(r"[{};]", bare)] if language == "java" else []

    def annotated(begin: int) -> int:
        """Where a declaration begins if the annotations in front of it, which are blank by now, are its own."""
        last = code_before[bisect_right(code_before, begin) - 1] if code_before and code_before[0] <= begin else 0
        mark = None if not MODIFIERS.fullmatch(bare, last, begin) else ANNOTATION.search(comments_gone, last, begin)
        return mark.start() if mark else begin

    found: dict[int, tuple[int, int, str, str, str]] = {}  # place of the name -> extent, kind, name, owner
    for kind, pattern in DECLARATIONS[language]:
        for m in re.finditer(pattern, bare, re.M):
            name = m["name"]
            if name in _NO_CALL or kind == "function" and language == "cpp" and name.isupper() or m.start("name") in found:
                continue
            behind = m[0][m.end("name") - m.start() :]
            if kind == "function" and behind.count("(") != behind.count(")"):
                continue  # a call that is handed a function
            before = m[0][: m.start("name") - m.start()].split()
            if kind == "function" and language in ("java", "cpp") and (before[:1] and before[0] in _NO_CALL or not before and bare[m.end() : m.end() + 1] == ";"):
                continue  # a statement, or a call
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            if language == "java":
                begin = annotated(begin)
            end = closing.get(m.end(), m.end()) if bare[m.end() : m.end() + 1] == "{" else m.end()
            found[m.start("name")] = (begin, end, kind, name, (m.groupdict().get("owner") or ""))
    out, stack, spans = Parsed(), [], []
    for at, (begin, end, kind, name, owner) in sorted(found.items(), key=lambda x: (x[1][0], -x[1][1])):
        while stack and stack[-1][0] < begin:
            stack.pop()
        parent = next((s for _, s in reversed(stack) if s is not None and s.kind != "variable"), None)
        s = Symbol(kind, name, line(begin), line(end), parent)
        stack.append((end, s))
        spans.append((begin, end, at, s, owner))
    first_class: dict[str, Symbol] = {}
    for *_, s, _ in spans:
        if s.kind == "class":
            first_class.setdefault(s.name, s)
    for _, _, _, s, owner in spans:
        if owner or (s.parent and s.parent.kind == "impl"):
            s.parent = first_class.get(owner or s.parent.name)
        if s.kind != "impl":
            out.symbols.append(s)
    names = {at for _, _, at, _, _ in spans}
    functions = [(b, e, s) for b, e, _, s, _ in spans if s.kind == "function"]
    for m in re.finditer(rf"({_WORD})\s*(?:::<[^>]*>)?\(", bare):
        if m.start() in names or m[1] in _NO_CALL or _NEW.search(bare, max(0, m.start() - 20), m.start()):
            continue
        about = [(e - b, s.name) for b, e, s in functions if b <= m.start() <= e]
        if about:
            out.calls.append((min(about)[1], m[1], line(m.start())))
    return out


#: language -> parser; a further language is one more entry here and in SUFFIXES.
PARSERS: dict[str, Callable[[str], Parsed]] = {"python": parse_python} | {k: (lambda text, k=k: parse_braces(text, k)) for k in DECLARATIONS}


def parse(path: str, text: str) -> Parsed:
    language = SUFFIXES.get(suffix_of(path))
    return PARSERS[language](text) if language else Parsed()


def uid_of(path: str, s: Symbol, sha: str = "") -> str:
    return f"{path}::{s.kind}::{s.name}@{s.start}" + (f"::{sha[:12]}" if sha else "")


NODES = "seq long, ordinal int, uid string, kind string, name string, file_path string, line_start int, line_end int, language string, parent_uid string, text_hash long"
CALLS = "seq long, call string, caller string, callee string, file_path string, line int"


def parse_files(files: DataFrame) -> DataFrame:
    """Symbols of files (seq, file_path, text[, sha]), in order of appearance (ordinal). One pass, one task's batch at a time."""
    import xxhash

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for seq, path, text, sha in f.itertuples(index=False):
                lines = (text or "").splitlines()
                for k, s in enumerate(parse(path, text or "").symbols):
                    held = "\n".join(lines[s.start - 1 : s.end])
                    rows.append((seq, k, uid_of(path, s, sha), s.kind, s.name, path, s.start, s.end, SUFFIXES[suffix_of(path)], uid_of(path, s.parent, sha) if s.parent else None, xxhash.xxh3_64_intdigest(held) >> 1))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return _supported(files).mapInPandas(work, NODES)


def calls_of(files: DataFrame) -> DataFrame:
    """Calls of files: (seq, call, caller, callee, file_path, line)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(seq, f"{seq}:{path}:{k}", *c[:2], path, c[2]) for seq, path, text, _ in f.itertuples(index=False) for k, c in enumerate(parse(path, text or "").calls)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CALLS.split(", ")])

    return _supported(files).mapInPandas(work, CALLS)


def _supported(files: DataFrame) -> DataFrame:
    """Files that have a parser, dealt out evenly: parsing costs far more than reading, and many small texts may come from a few parts of one table."""
    sha = F.col("sha") if "sha" in files.columns else F.lit("")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.filter(language_of(F.col("file_path")).isNotNull()).select(F.col("seq").cast("long"), "file_path", "text", sha.alias("sha")).repartition(tasks, "seq", "file_path")
