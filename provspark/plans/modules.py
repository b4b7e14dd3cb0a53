"""Source files in seven languages, made of the rows of `part`: a text for each row, and, declared beside it by hand, the symbols and calls that are in it.

Each text holds what a parser may stumble over: braces in strings, comments, raw strings and templates, annotations with braces, directives, lifetimes, text blocks.
In a text $k stands for the part's key, $b for its brand, $t for its type; the line @BODY is repeated 1 + p_size % 5 times.
"""

from __future__ import annotations

from dataclasses import dataclass

TIMES = "cast(1 + p_size % 5 as int)"


@dataclass(frozen=True)
class Module:
    """symbols: (kind, name, first line, last line, name of the parent); calls: (caller, callee, line). Lines count as in the text here, @BODY as one."""

    language: str
    suffix: str
    text: str
    symbols: tuple[tuple[str, str, int, int, str], ...]
    calls: tuple[tuple[str, str, int], ...]

    @property
    def lines(self) -> list[str]:
        return self.text.strip("\n").split("\n")

    @property
    def body(self) -> int:
        return next(i for i, line in enumerate(self.lines, 1) if line.startswith("@BODY"))


MODULES = (
    Module("python", ".py", '''
# def gone_$k(): of $b
class Part_$k:
    """class Fake_$k: {"""

    @property
    def size_$k(self):
@BODY        x = "def no(): $t"
        return helper_$k(self)


def helper_$k(part):
    return len(part.name)
''', (("class", "Part_$k", 2, 8, ""), ("function", "size_$k", 6, 8, "Part_$k"), ("function", "helper_$k", 11, 12, "")), (("size_$k", "helper_$k", 8), ("helper_$k", "len", 12))),
    Module("typescript", ".ts", '''
// function gone_$k() { of $b
export class Part_$k {
  size_$k(a: number): string {
@BODY    let s = `{${a ? `}$t` : "{"}`;
    return `x${this.part_$k({ a: a })}y{`;
  }
  part_$k(o: object): string { return "}"; }
}
function outer_$k() { return inner_$k(`${call_$k(1)}`); }
''', (("class", "Part_$k", 2, 8, ""), ("function", "size_$k", 3, 6, "Part_$k"), ("function", "part_$k", 7, 7, "Part_$k"), ("function", "outer_$k", 9, 9, "")),
        (("size_$k", "part_$k", 5), ("outer_$k", "inner_$k", 9), ("outer_$k", "call_$k", 9))),
    Module("javascript", ".js", '''
/* function gone_$k() { $b */
function match_$k(s) {
@BODY  s = s.replace(/[{"]+$b/g, '}');
  return helper_$k(s);
}
async function helper_$k(s) { return s / 2 / 1; }
each_$k(function () { helper_$k("{"); });
''', (("function", "match_$k", 2, 5, ""), ("function", "helper_$k", 6, 6, "")), tuple([("match_$k", "replace", 3), ("match_$k", "helper_$k", 4)])),
    Module("java", ".java", '''
package parts; // class Gone_$k {
@Config(names = {"$b", "}"}, inner = @Inner({1, 2}))
public class Part_$k<T> {
  @SuppressWarnings({"unchecked", "raw{"})
  public <R> R open_$k(T x, int n) throws Error {
    String s = """
      class Fake { void no() { }
      """;
@BODY    n = n + 1;
    return helper_$k(s, '{');
  }
  @Override public int size_$k() { return count_$k(1); }
}
''', (("class", "Part_$k", 2, 13, ""), ("function", "open_$k", 4, 11, "Part_$k"), ("function", "size_$k", 12, 12, "Part_$k")), (("open_$k", "helper_$k", 10), ("size_$k", "count_$k", 12))),
    Module("go", ".go", '''
package parts

func run_$k(x int) int {
	s := `func Fake_$k() { $b`
	r := '{'
@BODY	x = x + len_$k(s)
	return help_$k(x)
}

func (p *Part_$k) size_$k() int { return 1 }

type Part_$k struct {
	n int
}
''', (("function", "run_$k", 3, 8, ""), ("function", "size_$k", 10, 10, "Part_$k"), ("class", "Part_$k", 12, 14, "")), (("run_$k", "len_$k", 6), ("run_$k", "help_$k", 7))),
    Module("rust", ".rs", '''
/* outer /* fn nested_$k() { */ $b */
#[derive(Debug, Name = "{")]
struct Part_$k<'a> { s: &'a str }
impl<'a> Part_$k<'a> {
    fn name_$k(&'a self) -> &'a str {
        let c = '{';
@BODY        let r = r#"fn no_$k() { " $t"#;
        helper_$k(self.s)
    }
}
fn helper_$k<'a>(s: &'a str) -> &'a str { s }
''', (("class", "Part_$k", 3, 3, ""), ("function", "name_$k", 5, 9, "Part_$k"), ("function", "helper_$k", 11, 11, "")), (("name_$k", "helper_$k", 8),)),
    Module("cpp", ".cpp", '''
#define OPEN_$k(x) namespace x {
#if A
int twice_$k(int a) {
#else
int twice_$k(long a) {
#endif
  const char* s = R"x(} class Fake_$k { )" )x"; // {
@BODY  a = add_$k(a, 1'000);
  return a;
}
TEST(suite, name_$k) { int x = 1; }
class Part_$k : public Base { public: int spin_$k(int n); void run_$k() { spin_$k(2); } };
int Part_$k::spin_$k(int n) { return n; }
''', (("function", "twice_$k", 3, 10, ""), ("class", "Part_$k", 12, 12, ""), ("function", "spin_$k", 12, 12, "Part_$k"), ("function", "run_$k", 12, 12, "Part_$k"), ("function", "spin_$k", 13, 13, "")),
        (("twice_$k", "add_$k", 8), ("run_$k", "spin_$k", 12))),
)


def _said(text: str) -> str:
    """SQL for a text with its marks filled in."""
    quoted = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for mark, column in (("$k", "cast(p_partkey as string)"), ("$b", "p_brand"), ("$t", "p_type")):
        quoted = quoted.replace(mark, f"' || {column} || '")
    return quoted


def _whole(m: Module) -> str:
    lines, body = m.lines, m.body
    before, after = "\n".join(lines[: body - 1]) + "\n", "\n".join(lines[body:]) + "\n"
    return f"{_said(before)} || repeat({_said(lines[body - 1].removeprefix('@BODY') + chr(10))}, {TIMES}) || {_said(after)}"


def _path(m: Module) -> str:
    return f"'src/p' || cast(p_partkey % 40 as string) || '/m' || cast(p_partkey as string) || '{m.suffix}'"


def sources() -> str:
    """(seq, file_path, text) in SQL over part."""
    which = " ".join(f"when {i} then {_path(m)}" for i, m in enumerate(MODULES)), " ".join(f"when {i} then {_whole(m)}" for i, m in enumerate(MODULES))
    return f"select p_partkey as seq, case p_partkey % {len(MODULES)} {which[0]} end as file_path, case p_partkey % {len(MODULES)} {which[1]} end as text from part"


def _line(m: Module, at: int, first: bool) -> str:
    """A line's number once @BODY is repeated; a call on that line is on each of its copies."""
    return f"cast({at} + {TIMES} - 1 as int)" if at > m.body or (at == m.body and not first) else str(at)


def symbols() -> str:
    """What parsing must find, from the declarations alone."""
    out = []
    for i, m in enumerate(MODULES):
        start = {name: (kind, _line(m, a, True)) for kind, name, a, _, _ in reversed(m.symbols)}
        for n, (kind, name, a, b, parent) in enumerate(m.symbols):
            uid = lambda kind, name, line: f"{_path(m)} || '::{kind}::' || {_said(name)} || '@' || {line}"
            above = uid(start[parent][0], parent, start[parent][1]) if parent else "cast(null as varchar)"
            out.append(f"select p_partkey as seq, {n} as ordinal, {uid(kind, name, _line(m, a, True))} as uid, '{kind}' as kind, {_said(name)} as name, {_path(m)} as file_path, {_line(m, a, True)} as line_start, {_line(m, b, False)} as line_end, '{m.language}' as language, {above} as parent_uid from part where p_partkey % {len(MODULES)} = {i}")
    return " union all ".join(out)


def calls() -> str:
    out = []
    for i, m in enumerate(MODULES):
        for caller, callee, at in m.calls:
            line = f"unnest(range({at}, {at} + {TIMES}))" if at == m.body else _line(m, at, True)
            out.append(f"select p_partkey as seq, {_said(caller)} as caller, {_said(callee)} as callee, {_path(m)} as file_path, cast({line} as int) as line from part where p_partkey % {len(MODULES)} = {i}")
    return " union all ".join(out)
