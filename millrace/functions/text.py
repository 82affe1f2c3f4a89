"""Text and source-code functions as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FENCE = "```"
#: Names of assertions, in the order in which they are listed there.
ASSERTIONS = (
    "assertAll", "assertArrayEquals", "assertDoesNotThrow", "assertEquals", "assertFalse", "assertInstanceOf", "assertIterableEquals", "assertLinesMatch",
    "assertNotNull", "assertNotSame", "assertNotEquals", "assertNull", "assertSame", "assertThat", "assertThrows", "assertThrowsExactly",
    "assertTimeout", "assertTimeoutPreemptively", "assertTrue", "fail",
)
#: Patterns of declarations, of compiler errors and of links in comments, of test annotations.
PACKAGE = r"(?m)^\s*package\s+([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*;"
TEST_ANNOTATION = r"@\s*(?:[\w.]+\.)?(?:Test|ParameterizedTest|RepeatedTest|TestFactory|TestTemplate)\b"
DECLARATION = r"(?m)^[ \t]*(?:@(?!interface\b)[A-Za-z_$][\w$]*(?:\s*\([^)]*\))?\s*)*(?:(?:public|protected|private|abstract|final|static|strictfp|sealed|non-sealed)\s+)*(?:@interface|class|interface|enum|record)\s+([A-Za-z_$][\w$]*)\b"
CONCRETE = r"(?:public|protected|private)\s*(?:final\s+)?(?!abstract\s+)class\s+(\w+)"
COMPILER_ERROR = r"\[ERROR\]\s+(\S+\.java):\[(\d+),(\d+)\]\s*(.*)"
_ERROR_LINE = r"\A.*?\[ERROR\]\s+(\S+\.java):\[0*(\d+),0*(\d+)\]\s*(.*)\z"
DOC_LINK = r"(?:\{@link(?:plain)?\s+|@see\s+)([A-Z]\w*)"
SPACE_END, SPACE_START = r"(?U)\s+\z", r"(?U)\A\s+"


def lines(x: Column) -> Column:
    """Lines without their ends; a final line break ends the last line."""
    flat = F.regexp_replace(x, r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    return F.when(x == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.regexp_replace(flat, r"\n\z", ""), "\n", -1))


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, SPACE_END, "")


def strip(x: Column) -> Column:
    return F.regexp_replace(rstrip(x), SPACE_START, "")


def fenced(x: Column, language: str = "java") -> Column:
    return F.concat(F.lit(f"{FENCE}{language}\n"), rstrip(x), F.lit(f"\n{FENCE}"))


def strip_fence(x: Column) -> Column:
    """The longest fenced part (the first of equals); a text whose fences aren't paired stays as it is.

    Its first line goes unless it is code already.
    """
    parts = F.split(x, FENCE, -1)
    inner = F.filter(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p"))), lambda s: -s["i"] % 2 == 1)
    best = F.array_max(inner)["p"]
    first = F.substring_index(best, "\n", 1)
    code = first.contains("package") | first.contains("import") | first.contains("class")
    rest = F.when(F.instr(best, "\n") > 0, F.expr("''")).otherwise(F.lit(""))
    body = F.when(code, best).otherwise(F.when(F.instr(best, "\n") > 0, F.regexp_replace(best, r"\A[^\n]*\n", "")).otherwise(rest))
    return F.when((F.size(parts) > 1) & (F.size(parts) % 2 == 1), body).otherwise(x)


def strip_fence_lenient(x: Column) -> Column:
    """strip_fence, then without any fence lines at the start and the end; ends with a line break unless empty."""
    ls = lines(strip_fence(x))
    is_fence = lambda s: F.regexp_replace(s, SPACE_START, "").startswith(FENCE)
    state = F.aggregate(ls, F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).alias("last")), lambda a, s: F.struct((a["n"] + 1).alias("n"), F.when((a["first"] == a["n"]) & is_fence(s), a["first"] + 1).otherwise(a["first"]).alias("first"), F.when(is_fence(s), a["last"]).otherwise(a["n"] + 1).alias("last")))
    kept = F.slice(ls, state["first"] + 1, F.greatest(state["last"] - state["first"], F.lit(0)))
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise("")


def count_tests(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?m)^\s*@Test\b"))


def count_assertless(x: Column) -> Column:
    """Parts behind @Test without an assertion and without an expected exception; comments count as code."""
    calls = r"\b(?:" + "|".join(ASSERTIONS) + r")\s*\("
    expects = r"(?s)\s*\([^)]*\bexpected\s*=.*Exception\.class\b[^)]*\)"
    parts = F.split(x, "@Test", -1)
    return F.size(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: ~s.rlike(calls) & ~s.rlike(expects)))


def without_literals(x: Column) -> Column:
    """Without the insides of string and character literals and without line comments, line by line."""
    x = F.regexp_replace(x, r'"(?:\\[^\n]|[^"\\\n])*"', '""')
    x = F.regexp_replace(x, r"'(?:\\[^\n]|[^'\\\n])*'", "''")
    return F.regexp_replace(x, r"//[^\n]*", "")


def count_of(x: Column, sign: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))


def is_balanced(x: Column) -> Column:
    clean = without_literals(x)
    return (count_of(clean, "{") == count_of(clean, "}")) & (count_of(clean, "(") == count_of(clean, ")"))


def looks_terminated(x: Column) -> Column:
    return rstrip(x).endswith("}") | rstrip(x).endswith(FENCE)


def package_name(x: Column) -> Column:
    return F.regexp_extract(x, PACKAGE, 1)


def entity_name(x: Column) -> Column:
    """The first declared type, or null."""
    return F.nullif(F.regexp_extract(x, DECLARATION, 1), F.lit(""))


def qualified_name(x: Column) -> Column:
    """package.Type, or the type alone; null where no type is declared."""
    p = package_name(x)
    return F.when(p == "", entity_name(x)).otherwise(F.concat(p, F.lit("."), entity_name(x)))


def is_concrete(path: Column, content: Column) -> Column:
    """The first concrete class declared is the file's own."""
    return F.regexp_extract(content, CONCRETE, 1) == F.regexp_extract(path, r"([^/\\]+)\.\w+$", 1)


def is_implementation(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.array_contains(parts, "src") & ~F.array_contains(parts, "test")


def class_key(path: Column) -> Column:
    """The path below src/main/java without its suffix; null elsewhere."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.nullif(F.regexp_extract(p, r"(?:^|/)src/main/java/(.*)\.\w+$", 1), F.lit(""))


def simple_name(name: Column) -> Column:
    return F.regexp_extract(name, r"([^./$]*)$", 1)


def outer_name(name: Column) -> Column:
    return F.substring_index(name, "$", 1)


def visibility(modifiers: Column) -> Column:
    """The first of public, protected and private that is there, else package."""
    return F.when(F.array_contains(modifiers, "public"), "public").when(F.array_contains(modifiers, "protected"), "protected").when(F.array_contains(modifiers, "private"), "private").otherwise("package")


def accessible(vis: Column, own_package: Column, other_package: Column) -> Column:
    return (vis == "public") | ((vis != "private") & (own_package == other_package))


def numbered(x: Column) -> Column:
    """Each line behind its number, padded to one width, and a bar."""
    ls = lines(x)
    width = F.length(F.size(ls).cast("string"))
    return F.array_join(F.transform(ls, lambda s, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" | "), s)), "\n")


def drop_lines(x: Column, ranges: Column) -> Column:
    """The text without the lines of ranges (array of (start, end), from 1, both included)."""
    kept = F.filter(F.transform(lines(x), lambda s, i: F.struct((i + 1).alias("n"), s.alias("s"))), lambda l: ~F.exists(ranges, lambda r: (r["start"] <= l["n"]) & (l["n"] <= r["end"])))
    return F.array_join(F.transform(kept, lambda l: l["s"]), "\n")


def head(x: Column, n: int = 12_000) -> Column:
    """The first n characters and a notice of how many are missing."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("\n... ["), (F.length(x) - n).cast("string"), F.lit(" more characters]"))).otherwise(x)


def tail(x: Column, n: int = 4_000) -> Column:
    return F.when(F.length(x) > n, F.right(x, F.lit(n))).otherwise(x)


def _is_comment(s: Column) -> Column:
    return s.rlike(r"(?U)\A\s*(?://|/?\*)")


def without_comments(x: Column, marker: str = "####") -> Column:
    """Lines that carry the marker, whole; lines with code before a line comment, cut there; and lines
    that are no comments."""
    rows = F.transform(lines(x), lambda s: F.when(s.contains(marker), s).when(s.contains("//") & ~s.rlike(r"(?U)\A\s*//"), F.substring_index(s, "//", 1)).when(~_is_comment(s), s))
    return F.array_join(F.filter(rows, lambda s: s.isNotNull()), "\n")


def prompt_chars(x: Column, marker: str = "####") -> Column:
    """Characters, with line ends, of lines that carry the marker or are neither blank nor comments."""
    kept = F.filter(lines(x), lambda s: s.contains(marker) | (s.rlike(r"(?U)\S") & ~_is_comment(s)))
    return F.aggregate(kept, F.lit(0), lambda a, s: a + F.length(s) + 1)


def normalized(x: Column) -> Column:
    """Without comments and white space, to compare code."""
    x = F.regexp_replace(x, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(F.regexp_replace(x, r"//[^\n]*", ""), r"(?U)\s+", "")


def section(x: Column, heading: str, until: str) -> Column:
    """What stands between two headings; null where the first isn't there."""
    return F.nullif(F.regexp_extract(x, rf"(?s)\Q{heading}\E\s*(.*?)(?:\Q{until}\E|\z)", 1), F.lit(""))


def doc_links(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(DOC_LINK), F.lit(1))))


def imports(x: Column) -> Column:
    """(single, wildcard): imported names, and packages imported whole; static imports are neither."""
    single = F.regexp_extract_all(x, F.lit(r"(?m)^\s*import\s+(?!static\b)([\w.]+\w)\s*;"), F.lit(1))
    wild = F.regexp_extract_all(x, F.lit(r"(?m)^\s*import\s+(?!static\b)([\w.]+)\.\*\s*;"), F.lit(1))
    return F.struct(single.alias("single"), wild.alias("wildcard"))


#: Words that are no names in source.
RESERVED = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new "
    "package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
).split()


def identifiers(x: Column) -> Column:
    """The sorted set of names in code, without keywords, comments, literals, imports and the package line, by patterns alone; syntax.identifiers() tells them from the source's tokens."""
    clean = F.regexp_replace(F.regexp_replace(without_literals(x), r"(?s)/\*.*?\*/", ""), r"(?m)^\s*(?:import|package)\b[^;]*;", "")
    return F.array_sort(F.array_except(F.regexp_extract_all(clean, F.lit(r"(?U)\b[\p{L}_$][\w$]*"), F.lit(0)), F.array(*map(F.lit, RESERVED))))


def missing_names(used: Column, shown: Column) -> Column:
    return F.array_sort(F.array_except(used, shown))


def error_kind(m: Column) -> Column:
    """The kind of a compiler's message, the first that fits."""
    access = m.contains("private access") | m.contains("protected access") | m.contains("is not public")
    signature = m.contains("cannot be applied") | m.contains("no suitable") | m.startswith("incompatible types")
    return (
        F.when(m.startswith("cannot find symbol"), "missing symbol").when(access, "access violation")
        .when(m.startswith("unreported exception"), "uncaught checked exception").when(signature, "wrong signature/type").otherwise("other")
    )


#: What a compiler's message says of the type that was misused, the first that fits.
MISUSED = (
    r"constructor \w+ in (?:class|enum) ([\w.$]+) cannot be applied",
    r"no suitable constructor found for ([\w$]+)\(",
    r"method \w+ in (?:class|interface|enum) ([\w.$<>]+) cannot be applied",
    r"\w+(?:\([^)]*\))? has private access in ([\w.$]+)",
    r"\w+(?:\([^)]*\))? is not public in ([\w.$]+)",
    r"\w+(?:\([^)]*\))? has protected access in ([\w.$]+)",
    r"unreported exception ([\w.$]+)",
    r"incompatible types: \S+ cannot be converted to ([\w.$<>]+)",
    r"([\w.$]+) is abstract; cannot be instantiated",
)


def misused_types(output: Column) -> Column:
    """The sorted set of types that a build's errors are about: of a missing symbol the type itself, or
    the one that lacks it (told in the two lines below), of other errors the first of MISUSED."""
    ls = lines(output)
    message = r"\[ERROR\] \S+?\.java:\[\d+,\d+\] (?:error: )?(.*)"
    # each error with the two lines below it: lines are told once, not anew for each of them
    with_next = F.filter(F.arrays_zip(ls.alias("s"), F.slice(ls, F.lit(2), F.size(ls)).alias("b"), F.slice(ls, F.lit(3), F.size(ls)).alias("c")), lambda z: z["s"].rlike(message))
    told = F.transform(with_next, lambda z: F.struct(F.regexp_extract(z["s"], message, 1).alias("m"), F.concat_ws("\n", z["b"], z["c"]).alias("below")))

    def about(z: Column) -> Column:
        m, below = z["m"], z["below"]
        symbol = F.regexp_extract(below, r"symbol:\s+(?:class|variable)\s+([A-Z][\w$]*)", 1)
        place = F.regexp_extract(below, r"location:\s+(?:class|interface|variable \w+ of type)\s+([\w.$<>]+)", 1)
        place = F.when(place.endswith("Test"), "").otherwise(F.substring_index(place, "<", 1))
        others = F.coalesce(*[F.nullif(F.regexp_extract(m, p, 1), F.lit("")) for p in MISUSED], F.lit(""))
        missing = F.when(symbol != "", symbol).otherwise(place)
        return F.when(m.startswith("cannot find symbol"), missing).otherwise(F.substring_index(others, "<", 1))

    return F.array_sort(F.array_distinct(F.filter(F.transform(told, about), lambda t: t != "")))


#: A compiler stops after so many errors.
ERROR_CAP = 100


def javac_errors(output: Column) -> Column:
    """Errors of a compiler's output: array of (file, row, col, message), each once, in order."""
    # a line as one string of its parts, so that equal ones are told by hash and each is read once
    parts = F.transform(F.filter(lines(output), lambda s: s.rlike(COMPILER_ERROR)), lambda s: F.regexp_replace(s, _ERROR_LINE, "$1\x01$2\x01$3\x01$4"))
    part = lambda x, i: F.split(x, "\x01", 4)[i]
    return F.transform(F.array_distinct(parts), lambda x: F.struct(part(x, 0).alias("file"), part(x, 1).cast("int").alias("row"), part(x, 2).cast("int").alias("col"), part(x, 3).alias("message")))


def own_errors(output: Column, file_name: Column, errors: Column | None = None) -> Column:
    """(errors, truncated): the errors in files of one name, and whether the compiler stopped at its cap. errors: the output's, if they are told already."""
    errors = javac_errors(output) if errors is None else errors
    told = F.regexp_extract(output, r"(?m)^\[INFO\]\s+(\d+) errors?\s*$", 1)
    return F.struct(F.filter(errors, lambda e: F.regexp_extract(e["file"], r"([^/\\\\]+)$", 1) == file_name).alias("errors"), F.coalesce(F.try_to_number(told, F.lit("999999")) >= ERROR_CAP, F.lit(False)).alias("truncated"))


def is_test_method(source: Column, name: Column) -> Column:
    """Whether a method is a test: by one of five annotations, or by its name."""
    return source.rlike(TEST_ANNOTATION) | name.startswith("test")


def declares(kind: str, content: Column, name: Column) -> Column:
    """Whether a source declares a type of that name: kind is enum, interface, abstract class."""
    return F.regexp_like(content, F.concat(F.lit(rf"\b{kind} \Q"), name, F.lit(r"\E\b")))


def article(name: Column) -> Column:
    """The name behind `a` or `an`."""
    return F.concat(F.when(F.substring(name, 1, 1).isin("A", "E", "I", "O"), "an ").otherwise("a "), name)


def call_of(name: Column, params: Column) -> Column:
    """name(Simple, Simple), parameter types by their simple names, brackets and dots kept."""
    simple = lambda p: F.concat(F.regexp_extract(F.regexp_replace(F.trim(F.regexp_replace(p, "<.*>", "")), r"((?:\[\]|\.\.\.)+)$", ""), r"([^.$]*)$", 1), F.regexp_extract(p, r"((?:\[\]|\.\.\.)+)\s*$", 1))
    return F.concat(name, F.lit("("), F.array_join(F.transform(params, simple), ", "), F.lit(")"))


def test_path(path: Column) -> Column:
    """Where the test of a source below src/main/java is written; null for other paths."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.rlike(r"(?:^|/)src/main/java/.*\.java$"), F.regexp_replace(F.regexp_replace(p, r"(^|/)src/main/java/", "$1src/test/java/"), r"\.java$", "Test.java"))


def thrown_types(source: Column) -> Column:
    """The sorted set of types in throws clauses of methods that aren't private."""
    clean = without_literals(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""))
    heads = F.regexp_extract_all(clean, F.lit(r"([\w<>\[\], ?.@$]*)\([^(){};]*\)\s*throws\s+([\w.$,\s]+?)\s*[{;]"), F.lit(0))
    open_ = F.filter(heads, lambda h: ~h.rlike(r"\bprivate\b[^(]*\("))
    names = F.flatten(F.transform(open_, lambda h: F.split(F.regexp_extract(h, r"throws\s+([\w.$,\s]+?)\s*[{;]", 1), r"\s*,\s*")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: F.regexp_extract(n, r"([\w]+)$", 1)), lambda n: n != "")))


def compiler_feedback(ok: Column, green: Column, path: Column, output: Column) -> Column:
    """A build's result as a text; the log is compacted unless the suite is green."""
    status = F.when(~ok, "failed").when(green, "passed").otherwise("succeeded, but tests fail")
    log = F.when(ok & green, strip(output)).otherwise(compact_failure(output))
    return strip(F.concat(F.lit("Compiler node result: Maven test compilation "), status, F.lit(".\nGenerated test file: "), path, F.lit("\n\nRelevant Maven output:\n"), log))


def mutation_feedback(ok: Column, previous: Column, current: Column, delta: Column, threshold: Column, details: Column) -> Column:
    """A mutation run's result as a text: scores and what was found, or the log of a run that failed."""
    figure = lambda label, x: F.concat(F.lit(f"Mutation score {label}: "), F.format_string("%.2f", x.cast("double")), F.lit("%\n"))
    head = F.concat(F.lit("Mutation validator result: PIT mutation report generation "), F.when(ok, "succeeded.\n").otherwise("failed.\n"), figure("previous", previous), figure("current", current), figure("delta", delta))
    rest = F.concat(F.format_string("Significant improvement threshold: %.2f%%\n\n", threshold.cast("double")), F.when(ok, "Mutation details for the class under test:\n").otherwise("Maven output:\n"))
    return strip(F.concat(head, rest, strip(details)))


def content_text(x: Column) -> Column:
    """The text of a message's content: itself, or the joined texts of a JSON array of parts."""
    parts = F.from_json(x, "array<struct<type:string,text:string>>")
    return F.when(F.ltrim(x).startswith("[") & parts.isNotNull(), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(x)


def is_empty_answer(calls: Column, text: Column) -> Column:
    return (F.coalesce(F.size(calls), F.lit(0)) <= 0) & (strip(F.coalesce(text, F.lit(""))) == "")


def normalized_path(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^[A-Za-z]:", ""))


def compact_failure(x: Column, n_lines: int = 120, n_chars: int = 12_000) -> Column:
    """A build log from its first error on: so many lines and characters."""
    ls = lines(x)
    first = F.coalesce(F.array_position(F.transform(ls, lambda s: s.contains("[ERROR]")), F.lit(True)), F.lit(0))
    return F.substring(F.array_join(F.slice(ls, F.greatest(first, F.lit(1)).cast("int"), F.lit(n_lines)), "\n"), 1, n_chars)


def chat_prompt(system: Column, user: Column) -> Column:
    """A prompt in the marked-up chat form, open for the answer."""
    turn = lambda role, t: F.concat(F.lit(f"<|im_start|>{role}\n"), t, F.lit("<|im_end|>\n"))
    return F.concat(turn("system", system), turn("user", user), F.lit("<|im_start|>assistant\n"))


def token_count(x: Column) -> Column:
    """A stand-in for a tokenizer: runs of letters or digits, and single other signs. Not a BPE."""
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def fill(template: Column | str, **slots: Column) -> Column:
    """A template with {name} replaced by each slot."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def list_section(items: Column, nothing: str) -> Column:
    """Numbered items, or a sentence where there are none."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")).otherwise(nothing)


def signature(name: Column, params: Column) -> Column:
    """A member's name and the simple names of its parameters' types: what tells overloads apart in source and byte code alike."""
    return call_of(name, params)
