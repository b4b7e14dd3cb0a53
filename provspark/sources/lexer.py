"""Blanks what is no code out of a source text (comments, strings, arguments of annotations, directives) so that every place stays where it was.

A table for each language says what begins a token; a stack holds what the text is nested in, as a template holds code that may hold templates, an annotation holds
braces that are no blocks, and a branch of a directive repeats braces that count once.
"""

from __future__ import annotations

import re

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_STRING = r"\"(?:\\.|[^\"\\\n])*\""
_CHAR = r"'(?:\\.|[^'\\\n])*'"

#: language -> what begins each kind of token, tried in this order. `text` is blanked whole; the rest have rules of their own.
TOKENS: dict[str, tuple[tuple[str, str], ...]] = {
    "typescript": (("text", f"{_LINE}|{_BLOCK}|{_STRING}|{_CHAR}"), ("template", "`"), ("slash", "/"), ("annotation", r"@[A-Za-z_$][\w.$]*[ \t]*\(")),
    "java": (("annotation", r"@(?!interface\b)[A-Za-z_][\w.]*\s*\("), ("text", rf'{_LINE}|{_BLOCK}|"""(?:\\.|[^\\])*?"""|{_STRING}|{_CHAR}|@(?!interface\b)[A-Za-z_][\w.]*')),
    "go": (("text", f"{_LINE}|{_BLOCK}|{_STRING}|{_CHAR}|`[^`]*`"),),
    "rust": (("text", rf"{_LINE}|b?{_STRING}|b?'(?:\\(?:x[0-9A-Fa-f]{{2}}|u\{{[^}}]*\}}|.)|[^'\\\n])'"), ("raw", r"\bb?r(?P<rust>#*)\""), ("nested", r"/\*"), ("annotation", r"#!?\[")),
    "cpp": (("raw", r"\b(?:u8|[uUL])?R\"(?P<cpp>[^()\\\s]{0,16})\("), ("text", rf"{_LINE}|{_BLOCK}|{_STRING}|(?<![0-9A-Za-z_])(?:u8|[uUL])?{_CHAR}"), ("directive", r"^[ \t]*#(?:\\\n|[^\n])*")),
}
TOKENS["javascript"] = TOKENS["typescript"]
_CODE = {k: re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in rules) + r"|(?P<open>[{(\[])|(?P<close>[})\]])", re.S | re.M) for k, rules in TOKENS.items()}
_IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_NESTED = re.compile(r"/\*|\*/")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield))\s*\Z")
_DIRECTIVE = re.compile(r"\s*#\s*(\w*)")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def code_of(text: str, language: str) -> str:
    """The text with what is no code as spaces; as long as it was, line by line."""
    out: list[str] = []
    # Frames: [kind, depth]; kind is code (of a template), template or annotation. The text itself is code without a frame.
    frames: list[list] = []
    scan, at, hidden = _CODE[language], 0, 0  # hidden: annotations about this place

    def put(piece: str) -> None:
        out.append(_blank(piece) if hidden else piece)

    while at < len(text):
        if frames and frames[-1][0] == "template":
            m = _IN_TEMPLATE.search(text, at)
            end = m.end() if m else len(text)
            out.append(_blank(text[at:end]))
            at = end
            if m and m[0] == "`":
                frames.pop()
            elif m and m[0] == "${":
                frames.append(["code", 0])
            continue
        m = scan.search(text, at)
        if not m:
            put(text[at:])
            break
        put(text[at : m.start()])
        kind, at = m.lastgroup if m.lastgroup not in ("rust", "cpp") else "raw", m.end()
        if kind in ("open", "close"):
            step = 1 if kind == "open" else -1
            if frames and frames[-1][0] == "annotation":
                out.append(" ")
                frames[-1][1] += step
                if frames[-1][1] == 0:
                    frames.pop()
                    hidden -= 1
            elif frames and m[0] in "{}":
                if step < 0 and frames[-1][1] == 0:
                    frames.pop()  # the end of ${...}
                    out.append(" ")
                else:
                    frames[-1][1] += step
                    put(m[0])
            else:
                put(m[0])
            continue
        if kind == "template":
            frames.append(["template", 0])
        elif kind == "annotation":
            frames.append(["annotation", 1])
            hidden += 1
        elif kind == "slash":
            literal = _REGEX.match(text, m.start()) if _BEFORE_REGEX.search(text[max(0, m.start() - 40) : m.start()]) else None
            if not literal:
                put("/")
                continue
            at = literal.end()
        elif kind == "raw":
            closing = f'){m["cpp"]}"' if language == "cpp" else f'"{m["rust"]}'
            end = text.find(closing, at)
            at = len(text) if end < 0 else end + len(closing)
        elif kind == "nested":
            depth = 1
            while depth and (n := _NESTED.search(text, at)):
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
            at = len(text) if depth else at
        elif kind == "directive" and _DIRECTIVE.match(m[0])[1] in ("else", "elif", "elifdef", "elifndef"):
            at = _other_branches(text, at)
        out.append(_blank(text[m.start() : at]))
    return "".join(out)


def _other_branches(text: str, at: int) -> int:
    """The place behind the #endif that ends the branches beginning here."""
    depth = 1
    for m in re.compile(r"^[ \t]*#[ \t]*(if|endif)", re.M).finditer(text, at):
        depth += 1 if m[1] == "if" else -1
        if not depth:
            return m.end()
    return len(text)
