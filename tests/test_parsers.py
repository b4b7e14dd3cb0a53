"""Parsers where texts are hard to read: what looks like code and is none, and what nests."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provspark.sources import lexer
from provspark.sources.parsers import parse

CASES = {
    "annotations.java": (
        'package a;\n@Conf(names = {"x", "y}"},\n  inner = @In({1, 2}))\npublic final class Shelf<T> {\n  // void gone() {\n  @Deprecated\n  /* why { */ @Suppress({"raw{"})\n  public T take(int n) throws Gone { return find(n, \'{\'); }\n'
        '  @interface Mark { String[] value() default {}; }\n  Shelf(int k) { this.k = k; }\n  void run() { if (ready()) { spin(2); } new Job() { public void step() { spin(3); } }; }\n}\n',
        [("class", "Shelf", 2, 12, None), ("function", "take", 6, 8, "Shelf"), ("class", "Mark", 9, 9, "Shelf"), ("function", "value", 9, 9, "Mark"), ("function", "Shelf", 10, 10, "Shelf"), ("function", "run", 11, 11, "Shelf"), ("function", "step", 11, 11, "run")],
        {("take", "find", 8), ("run", "ready", 11), ("run", "spin", 11), ("step", "spin", 11)},
    ),
    "branches.cpp": (
        '#define BLOCK {\n#ifdef WIDE\nlong sum(long a) {\n#elif defined(NARROW)\n#if X\nshort sum(short a) {\n#endif\nshort sum(short a) {\n#else\nint sum(int a) {\n#endif\n  auto s = R"({ " } class No { )"; return add(a, \'}\');\n}\n'
        "int helper(int x);\nint limit = 3;\nCHECK(all, of) {\n  int x = 1;\n}\nclass HTTPLine {\n public:\n  void send();\n};\nvoid HTTPLine::send() { helper(1); }\n",
        [("function", "sum", 3, 13, None), ("function", "helper", 14, 14, None), ("class", "HTTPLine", 19, 22, None), ("function", "send", 21, 21, "HTTPLine"), ("function", "send", 23, 23, None)],
        {("sum", "add", 12), ("send", "helper", 23)},
    ),
    "lifetimes.rs": (
        "/* a /* fn b() { */ */\n#[cfg(feature = \"x{\")]\nenum Kind<'k> { One(&'k str) }\ntrait Say { fn say(&self); }\nimpl<'k> Say for Kind<'k> {\n  fn say(&self) { let q = b'{'; let r = r##\"fn no() { \"# \"##; tell(q); }\n}\n",
        [("class", "Kind", 3, 3, None), ("class", "Say", 4, 4, None), ("function", "say", 4, 4, "Say"), ("function", "say", 6, 6, "Kind")], {("say", "tell", 6)},
    ),
    "templates.ts": (
        "@Part({ html: `<a>${x ? `{${y}` : \"}\"}</a>` })\nclass View {\n  re = /[{\"/]+\\//g;\n  draw(a: number): string { return `x${this.part({ a: `${a}}` })}y{`; }\n  part(o: object): string { return o.a / 2 / 1; }\n}\neach(1, function () { return part(`}`); });\n",
        [("class", "View", 2, 6, None), ("function", "draw", 4, 4, "View"), ("function", "part", 5, 5, "View")], {("draw", "part", 4)},
    ),
    "raw.go": ("package a\n\nfunc Run(x int) int {\n\ts := `func No() {\n{`\n\treturn Help(x, '{')\n}\n", [("function", "Run", 3, 7, None)], {("Run", "Help", 6)}),
}


@pytest.mark.parametrize("path", CASES)
def test_hard_texts(path):
    text, symbols, calls = CASES[path]
    got = parse(path, text)
    assert [(s.kind, s.name, s.start, s.end, s.parent and s.parent.name) for s in got.symbols] == symbols
    assert set(got.calls) == calls


@pytest.mark.parametrize("language", sorted(lexer.TOKENS))
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("`'\"\\/*{}()[]@#$\n xR") + ["${", "//", "/*", "*/", 'R"(', ')"', 'r#"', '"#', "@A(", "#if", "\n#else\n", "\n#endif\n", '"""', "return "]), max_size=30))
def test_places_stay(language, parts):
    text = "".join(parts)
    code = lexer.code_of(text, language)
    assert len(code) == len(text) and all(c == t or (c == " " and t != "\n") for c, t in zip(code, text))


@pytest.mark.parametrize("text", ["`${" * 20_000, "@A(" * 20_000, "/*" * 20_000, 'R"(' * 20_000, "/ " * 20_000, "#if\n#else\n" * 4_000, "'" * 40_000, "{" * 40_000])
def test_broken_texts_take_little_time(text):
    import time

    began = time.perf_counter()
    for language in lexer.TOKENS:
        lexer.code_of(text, language)
    assert time.perf_counter() - began < 10
