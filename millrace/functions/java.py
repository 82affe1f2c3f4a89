"""Functions over Java source that need a scan of its structure, as pandas UDFs on Arrow batches.

There is no parser here: the scanner knows literals, comments, braces and annotations. On source that
parses, spans are those of methods annotated @Test; broken source gives the spans that close.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import wraps
from itertools import accumulate

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from ..shared import ship


def vectorized(schema: str):
    """A pandas UDF that is made when it is first used: its schema can't be parsed before a session is there."""

    def wrap(f):
        made = []

        @wraps(f)
        def call(*columns):
            if not made:
                made.append(F.pandas_udf(f, returnType=schema))
            ship(SparkSession.active())
            return made[0](*columns)

        return call

    return wrap


_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_BREAKS = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_METHOD = re.compile(r"\bvoid\s+(\w+)\s*\(|\b(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{")
SPAN = "array<struct<name:string,start:int,end:int>>"


def masked(source: str) -> str:
    """The source with comments and insides of literals as blanks, every line break in its place."""
    return _TOKEN.sub(lambda m: "\n".join([" " * len(x) for x in m[0].split("\n")]), source)


def lines_of(source: str) -> list[str]:
    parts = _BREAKS.split(source)
    return parts[:-1] if parts and parts[-1] == "" else parts


_TEST, _STOP, _BRACE = re.compile(r"@Test\b"), re.compile(r"[;}]"), re.compile(r"[{}]")


def _block_end(code: str, open_: int) -> int:
    """Where the block that begins at a brace ends, or -1 if it doesn't."""
    depth = 0
    for m in _BRACE.finditer(code, open_):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


def spans_of(source: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of methods with @Test, annotations before it included, lines from 1."""
    code, out, at = masked(source), [], 0
    rows = code.split("\n")
    starts = list(accumulate((len(r) + 1 for r in rows), initial=0))
    line = lambda i: bisect_right(starts, i)
    while m := _TEST.search(code, at):
        at = m.end()
        head = _METHOD.search(code, at)
        if not head:
            break
        open_ = code.find("{", head.end() - 1)
        stop = _STOP.search(code, at)
        if open_ < 0 or (stop and stop.start() < head.start()):
            continue
        end = _block_end(code, open_)
        if end < 0:
            break
        first = line(m.start())
        while first > 1 and rows[first - 2].strip().startswith("@"):
            first -= 1
        out.append((head[1] or head[2], first, line(end)))
        at = end
    return out


_DECLARED = re.compile(r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^<>{};]*>\s+)?(?:([\w.$]+(?:\s*<[^{};()]*>)?(?:\[\])*)\s+)?([A-Za-z_$][\w$]*)\s*\(([^(){};]*)\)\s*(?:throws\s+[\w.$,\s]+)?\{")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "else", "do"}
_ANNOTATED = re.compile(r"(?:@[\w.]+(?:\([^()]*\))?\s*)+\Z")


def methods_of(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, start, end) of methods and constructors with a body, annotations included, as offsets in the source."""
    code, out, at = masked(source), [], 0
    while m := _DECLARED.search(code, at):
        at = m.end()
        if m[2] in _NOT_METHODS or m[1] in _NOT_METHODS:
            continue
        end = _block_end(code, m.end() - 1)
        if end < 0:
            continue
        before = _ANNOTATED.search(code, max(0, m.start() - 2000), m.start())
        out.append(("method" if m[1] else "constructor", m[2], before.start() if before else m.start(), end + 1))
        at = end + 1
    return out


@vectorized("array<struct<kind:string,name:string,source:string,line:int>>")
def methods(source: pd.Series) -> pd.Series:
    """Methods and constructors with a body, in order, with their first lines (from 1)."""
    each = lambda s: [{"kind": k, "name": n, "source": s[a:b], "line": s.count("\n", 0, a) + 1} for k, n, a, b in methods_of(s)]
    return source.map(lambda s: each(s) if s else [])


@vectorized("string")
def compacted(source: pd.Series, user: pd.Series) -> pd.Series:
    """The methods of a source whose names a using class's text holds, with dots between; null if there are none."""

    def one(s, u):
        parts = [s[a:b] for _, n, a, b in methods_of(s or "") if u and n in u]
        return "\n...\n".join(parts) if parts else None

    return pd.Series([one(s, u) for s, u in zip(source, user)])


_ANY_TEST = re.compile(r"@\s*(?:[\w.]+\.)?(?:Test|ParameterizedTest|RepeatedTest|TestFactory|TestTemplate)\b")


def plain_code(code: str) -> str:
    """Without comments and white space."""
    return re.sub(r"\s+", "", re.sub(r"//[^\n]*", "", re.sub(r"/\*.*?\*/", "", code, flags=re.S)))


@vectorized("struct<tests:array<struct<name:string,body:string>>,other:string>")
def suite_members(source: pd.Series) -> pd.DataFrame:
    """A suite's tests in order, their bodies without comments and white space, and what is left beside them, likewise."""

    def one(s):
        s = s or ""
        found = [(n, a, b) for _, n, a, b in methods_of(s) if _ANY_TEST.search(s[a:b]) or n.startswith("test")]
        rest, at = [], 0
        for _, a, b in found:
            rest.append(s[at:a])
            at = b
        return [{"name": n, "body": plain_code(s[a:b])} for n, a, b in found], plain_code("".join([*rest, s[at:]]))

    return pd.DataFrame([one(s) for s in source], columns=["tests", "other"])


def context_range(source: str, first: int, last: int) -> tuple[int, int]:
    """The UTF-8 byte range of lines first to last (from 1) and what belongs to them above: blank lines, then annotations and comments."""
    lines = source.splitlines(keepends=True)
    start = first - 1
    while start > 0 and not lines[start - 1].strip():
        start -= 1
    while start > 0 and lines[start - 1].strip().startswith(("@", "*", "/*", "//")):
        start -= 1
    size = [len(x.encode()) for x in lines]
    return sum(size[:start]), sum(size[: min(last, len(lines))])


def without_ranges(source: str, ranges) -> str:
    """The source without byte ranges that don't overlap."""
    data, out, at = source.encode(), [], 0
    for a, b in sorted(ranges):
        out.append(data[at:a])
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode()


@vectorized("string")
def without_tests(source: pd.Series, names: pd.Series) -> pd.Series:
    """The source without the named tests and the blank lines, annotations and comments above them."""

    def one(s, wanted):
        if s is None:
            return None
        wanted = set(wanted if wanted is not None else [])
        return without_ranges(s, [context_range(s, a, b) for n, a, b in spans_of(s) if n in wanted])

    return pd.Series([one(s, n) for s, n in zip(source, names)])


def first_break(source: str) -> int | None:
    """The line at which braces and parentheses stop fitting: of a closing one too many or of another kind, or the last line if any stays open."""
    held = []
    code = masked(source)
    for m in re.finditer(r"[{}()\[\]]", code):
        if m[0] in "{([":
            held.append(m[0])
        elif not held or held.pop() + m[0] not in ("{}", "()", "[]"):
            return code.count("\n", 0, m.start()) + 1
    return len(source.split("\n")) if held else None


MOST_SHOWN = 40


@vectorized("string")
def syntax_feedback(before: pd.Series, after: pd.Series, edits: pd.Series) -> pd.Series:
    """Why edits (array of (range, text)) broke a class: the place of the break with two lines around it,
    and for each edit the lines it removed and both sides' braces where they differ. Null if nothing broke."""

    def one(old, new, some):
        at = first_break(new or "")
        if at is None:
            return None
        lines, edited_lines, parts = (old or "").split("\n"), (new or "").split("\n"), ["The edited class no longer parses; nothing was applied."]
        show = lambda rows, a, b: "\n".join(f"{i} | {rows[i - 1]}" for i in range(a, b + 1))
        parts.append(f"It first breaks near line {at} of the edited class:\n{show(edited_lines, max(1, at - 2), min(len(edited_lines), at + 2))}")
        for e in some if some is not None else []:
            m = _RANGE.match(e["range"] or "")
            a, b = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
            if not 1 <= a <= b <= len(lines):
                continue
            last = min(b, a + MOST_SHOWN - 1)
            note = f"Lines {a}-{b} were replaced:\n{show(lines, a, last)}" + (f"\n... ({b - last} more lines)" if b > last else "")
            was, now = "\n".join(lines[a - 1 : b]), e["text"] or ""
            if (was.count("{"), was.count("}")) != (now.count("{"), now.count("}")):
                note += f"\nThey hold {was.count('{')} '{{' and {was.count('}')} '}}'; the new text holds {now.count('{')} and {now.count('}')}."
            parts.append(note)
        return "\n\n".join(parts)

    return pd.Series([one(*x) for x in zip(before, after, edits)])


@vectorized(SPAN)
def test_spans(source: pd.Series) -> pd.Series:
    return source.map(lambda s: [dict(zip(("name", "start", "end"), x)) for x in spans_of(s)] if s else [])


def _closing(source: str) -> tuple[list[str], int | None]:
    """Lines, and the last one in which the nesting came back to the type's own level."""
    lines, depth, last = lines_of(source), 0, None
    for n, text in enumerate(lines_of(masked("\n".join(lines)))):
        for c in re.findall(r"[{}]", text):
            depth += 1 if c == "{" else -1
            if c == "}" and depth == 1:
                last = n
    return lines, last


@vectorized("string")
def truncate_to_last_member(source: pd.Series) -> pd.Series:
    """Without what follows the last whole member, the type closed; unchanged if no member is whole."""

    def cut(s):
        if s is None:
            return None
        lines, last = _closing(s)
        return s if last is None else "\n".join([*lines[: last + 1], "}", ""])

    return source.map(cut)


@vectorized("struct<source:string,removed:int>")
def deduplicate_tests(source: pd.Series) -> pd.DataFrame:
    """Without later tests of a name seen before; unchanged if there are none."""

    def once(s):
        if s is None:
            return None, 0
        seen, drop, removed = set(), set(), 0
        for name, a, b in spans_of(s):
            if name in seen:
                drop.update(range(a, b + 1))
                removed += 1
            seen.add(name)
        return (s, 0) if not removed else ("\n".join(x for n, x in enumerate(lines_of(s), 1) if n not in drop) + "\n", removed)

    return pd.DataFrame([once(s) for s in source], columns=["source", "removed"])


def drop_named(source: str, names) -> str:
    names = set(names)
    gone = {n for name, a, b in spans_of(source) if name in names for n in range(a, b + 1)}
    return source if not gone else "\n".join(x for n, x in enumerate(lines_of(source), 1) if n not in gone) + "\n"


@vectorized("string")
def drop_tests(source: pd.Series, names: pd.Series) -> pd.Series:
    """Without the tests of the given names."""
    return pd.Series([None if s is None else drop_named(s, n if n is not None else []) for s, n in zip(source, names)])


_RANGE = re.compile(r"\s*(\d+)(?:\s*[-:]\s*(\d+))?\s*\Z")


def edited(source: str, edits) -> tuple[str | None, str | None]:
    """Lines of ranges replaced: (text, None) or (None, why not). Ranges name lines of the source as it
    is, from 1; they are applied from the bottom, and must lie within it and not overlap."""
    lines, spans = source.split("\n"), []
    for e in edits:
        m = _RANGE.match(e["range"] or "")
        if not m:
            return None, f"not a range of lines: {e['range']}"
        a, b = int(m[1]), int(m[2] or m[1])
        if not 1 <= a <= b <= len(lines):
            return None, f"lines {a}-{b} aren't in the text of {len(lines)} lines"
        spans.append((a, b, e["text"] or ""))
    spans.sort()
    if any(later[0] <= earlier[1] for earlier, later in zip(spans, spans[1:])):
        return None, "ranges overlap"
    for a, b, text in reversed(spans):
        lines[a - 1 : b] = text.split("\n") if text else []
    return "\n".join(lines), None


@vectorized("struct<text:string,error:string>")
def replace_lines(source: pd.Series, edits: pd.Series) -> pd.DataFrame:
    """source, array<struct<range,text>> -> the edited text or an error."""
    return pd.DataFrame([edited(s or "", e if e is not None else []) for s, e in zip(source, edits)], columns=["text", "error"])


def appended(source: str, test: str) -> tuple[str | None, str | None]:
    """A test put before the type's last brace."""
    end = masked(source).rfind("}")
    if not (test or "").strip():
        return None, "the test is empty"
    if end < 0:
        return None, "the source has no closing brace"
    return source[:end].rstrip() + "\n\n" + test.strip("\n") + "\n" + source[end:], None


def with_imports(source: str, names) -> tuple[str | None, str | None]:
    """Imports that aren't there yet, put after the last import, or after the package, or first."""
    wanted = [f"import {re.sub(r'^import +|;$', '', n.strip())};" for n in names if n and n.strip()]
    lines = source.split("\n")
    have = {x.strip() for x in lines}
    new = [x for x in dict.fromkeys(wanted) if x not in have]
    if not wanted:
        return None, "no imports are given"
    at = max([i + 1 for i, x in enumerate(lines) if re.match(r"\s*import\s", x)] or [i + 1 for i, x in enumerate(lines) if re.match(r"\s*package\s", x)] or [0])
    return "\n".join(lines[:at] + new + lines[at:]), None


def replaced(source: str, name: str, test: str) -> tuple[str | None, str | None]:
    """The one test of a name replaced."""
    found = [(a, b) for n, a, b in spans_of(source) if n == name]
    if len(found) != 1:
        return None, f"{len(found)} tests are named {name}"
    if not (test or "").strip():
        return None, "the test is empty"
    lines, (a, b) = source.split("\n"), found[0]
    return "\n".join(lines[: a - 1] + test.strip("\n").split("\n") + lines[b:]), None


@vectorized("struct<text:string,error:string>")
def append_test(source: pd.Series, test: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([appended(s or "", t) for s, t in zip(source, test)], columns=["text", "error"])


@vectorized("struct<text:string,error:string>")
def add_imports(source: pd.Series, names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([with_imports(s or "", n if n is not None else []) for s, n in zip(source, names)], columns=["text", "error"])


@vectorized("struct<text:string,error:string>")
def replace_test(source: pd.Series, name: pd.Series, test: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([replaced(s or "", n, t) for s, n, t in zip(source, name, test)], columns=["text", "error"])


def split_top(s: str) -> list[str]:
    """Parts between commas that aren't within angle brackets or parentheses."""
    out, depth, part = [], 0, ""
    for c in s:
        depth += c in "<(["
        depth -= c in ">)]"
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [x for x in [*out, part.strip()] if x]


def erased(s: str) -> str:
    """Without type arguments, however nested."""
    while (t := re.sub(r"<[^<>]*>", "", s)) != s:
        s = t
    return s.strip()


_MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "synchronized", "native", "default", "strictfp", "transient", "volatile"}
_INVOKE = re.compile(r"//\s*(?:Interface)?Method\s+(?:([\w/$]+)\.)?\"?([\w<>$]+)\"?:")


def disassembled(text: str) -> list[dict]:
    """Members of a disassembled class (as `javap -c -p` prints it), with the methods each calls and the
    types it builds."""
    out, owner = [], None
    for raw in text.split("\n"):
        line = raw.strip()
        if m := re.match(r"(?:[\w@]+\s+)*?(class|interface|enum|@interface)\s+([\w.$]+)(.*)\{", erased(line)):
            owner = m[2]
            continue
        if owner and raw[:2] == "  " and raw[2:3] not in (" ", "") and line.endswith(";"):
            body = re.sub(r"\bthrows\b.*", "", line[:-1]).strip()
            throws = split_top(m[1]) if (m := re.search(r"\bthrows\s+(.*);$", line)) else []
            head, _, params = body.partition("(")
            words = erased(head).split()
            mods = [w for w in words if w in _MODIFIERS]
            rest = [w for w in words if w not in _MODIFIERS]
            if not rest:
                continue
            name = rest[-1]
            ctor = name in (owner, owner.rsplit(".", 1)[-1])
            kind = "field" if "(" not in body else "ctor" if ctor else "method"
            out.append({
                "owner": owner, "name": name.rsplit(".", 1)[-1] if ctor else name, "kind": kind, "visibility": next((w for w in mods if w in ("public", "protected", "private")), "package"), "static": "static" in mods, "abstract": "abstract" in mods,
                "params": [erased(p) for p in split_top(params.rpartition(")")[0])], "returns": rest[-2] if len(rest) > 1 else None, "throws": [erased(t) for t in throws], "decl": line[:-1], "calls": [], "news": [],
            })
        elif out and owner:
            if " new " in f" {line} " and (m := re.search(r"//\s*class\s+\"?([\w/$]+)", line)):
                out[-1]["news"].append(m[1].replace("/", "."))
            elif "invoke" in line and (m := _INVOKE.search(line)):
                out[-1]["calls"].append({"owner": (m[1] or owner).replace("/", "."), "name": m[2]})
    for r in out:
        r["news"] = sorted(set(r["news"]))
        r["calls"] = [dict(zip(("owner", "name"), x)) for x in sorted({(c["owner"], c["name"]) for c in r["calls"]})]
    return out


@vectorized("array<struct<owner:string,name:string,kind:string,visibility:string,static:boolean,abstract:boolean,params:array<string>,returns:string,throws:array<string>,decl:string,calls:array<struct<owner:string,name:string>>,news:array<string>>>")
def class_members(text: pd.Series) -> pd.Series:
    return text.map(lambda s: disassembled(s) if s else [])
