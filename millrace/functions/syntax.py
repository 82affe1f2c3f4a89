"""Java source as a column of nodes, and what is told from it by built-in functions.

tree() is the one function that scans text: it gives a source's declarations and names, each with its
interval in the source and the place of the declaration around it. It reads on over what it can't read,
so broken source gives the nodes that can be told. All extractors and renderers are Columns over these
arrays: they take their conditions as Columns too, so a caller's `keep` runs inside Spark's plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from . import text
from ..shared import ship

#: Words that may stand before a declaration.
MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
#: The marks and notes of rendered source.
MARKER = "not callable from the test"
PRIVATE_TAG = f"/* PRIVATE: {MARKER} */"
OMITTED = " { /* body omitted */ }"
NO_VALUE = " = /* initializer omitted */;"

TYPES = ("class", "interface", "enum", "record", "annotation")
MEMBERS = ("method", "constructor", "field", "compact")

_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|non-sealed\b|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|\.\.\.|::|->|&&|\|\||@interface\b|\S', re.S)
_RESERVED = frozenset(text.RESERVED)
_NAME = re.compile(r"[^\W\d]|\$")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_PRIMITIVE = set("boolean byte char double float int long short".split())


@lru_cache(1 << 16)
def _named(word: str) -> bool:
    return bool(_NAME.match(word)) and word not in _RESERVED


class Reader:
    """Tokens of one source, comments left out, and what is read from them."""

    def __init__(self, source: str):
        found = [(m[0], m.start()) for m in _TOKEN.finditer(source) if m[0][:2] not in ("//", "/*")]
        self.source, self.words, self.at = source, [w for w, _ in found] + [""], [a for _, a in found] + [len(source)]
        self.named = [_named(w) for w in self.words]  # told once, as each token is asked for several times
        self.decls: list[dict] = []
        self.marks: list[tuple[int, int, str, int]] = []  # regions of tokens: first, end, kind, declaration
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        """Each opening bracket's closing one; one that isn't closed ends with the source."""
        out, open_ = {}, []
        for i, w in enumerate(self.words):
            if w in _CLOSE:
                open_.append(i)
            elif w in (")", "]", "}"):
                while open_ and _CLOSE[self.words[open_[-1]]] != w and w == "}" and self.words[open_[-1]] != "{":
                    out[open_.pop()] = i  # a bracket that a block's end cuts off
                if open_ and _CLOSE[self.words[open_[-1]]] == w:
                    out[open_.pop()] = i
        return out | {i: len(self.words) - 1 for i in open_}

    def end(self, i: int) -> int:
        """Where token i ends in the source; for what isn't closed, where the last token does."""
        i = min(i, len(self.words) - 2)
        return self.at[i] + len(self.words[i]) if i >= 0 else 0

    def name(self, i: int) -> bool:
        return self.named[i]

    def angles(self, i: int, stop: int) -> int:
        """Behind the type arguments that open at i, or i if they don't close as such."""
        depth = 0
        for j in range(i, stop):
            w = self.words[j]
            depth += (w == "<") - (w == ">")
            if not depth:
                return j + 1
            if w in ("(", ")", "{", "}", ";", "=", "&&", "||") or w[0] in "\"'0123456789":
                return i
        return i

    def modifiers(self, i: int, stop: int) -> int:
        while i < stop:
            if self.words[i] == "@" and self.name(i + 1):
                i += 2
                while self.words[i] == "." and self.name(i + 1):
                    i += 2
                i = self.match[i] + 1 if self.words[i] == "(" else i
            elif self.words[i] in MODIFIERS and not (self.words[i] == "sealed" and self.words[i + 1] in ("", "(", "=", ";", ".")):
                i += 1
            else:
                break
        return i

    def declare(self, kind: str, name: str, first: int, mods_end: int, last: int, body: int, up: int, params: list[str] | None = None, returns: str | None = None) -> int:
        owner = self.decls[up] if up >= 0 else None
        mods = self.source[self.at[first] : self.end(mods_end - 1)].split() if mods_end > first else []
        seen = next((v for v in ("public", "protected", "private") if v in mods), "public" if owner and owner["kind"] in ("interface", "annotation") else "package")
        self.decls.append(
            {"kind": kind, "name": name, "begin": self.at[first], "end": self.end(last), "body": self.at[body] if body >= 0 else -1, "up": up, "depth": owner["depth"] + 1 if owner else 0, "mods": mods, "visibility": seen,
             "hidden": "private" in mods or bool(owner and owner["hidden"]), "within": [*owner["within"], up] if owner else [], "params": params, "returns": returns}
        )
        return len(self.decls) - 1

    def type_at(self, i: int, stop: int) -> str:
        w = self.words[i]
        if w in ("class", "interface", "enum") and self.name(i + 1):
            return w
        if w == "@interface" and self.name(i + 1):
            return "annotation"
        return "record" if w == "record" and i + 2 < stop and self.name(i + 1) and self.words[i + 2] in ("(", "<") else ""

    def members(self, i: int, stop: int, up: int) -> None:
        """The declarations between two tokens."""
        owner = self.decls[up] if up >= 0 else {"kind": "", "name": ""}
        while i < stop:
            if self.words[i] in ("import", "package") and up < 0:
                j = i
                while j < stop and self.words[j] != ";":
                    j += 1
                self.marks.append((i, j, "import", -1))
                i = j + 1
                continue
            first, i = i, self.modifiers(i, stop)
            mods_end = i
            kind = self.type_at(i, stop)
            if kind:
                i = self.type(kind, first, mods_end, i, stop, up)
            elif self.words[i] == "{":
                last = min(self.match[i], stop)
                if up >= 0:
                    n = self.declare("initializer", "", first, mods_end, last, i, up)
                    self.marks.append((i, last, "block", n))
                i = last + 1
            else:
                i = self.member(first, mods_end, i, stop, up, owner) if up >= 0 else i + 1

    def type(self, kind: str, first: int, mods_end: int, i: int, stop: int, up: int) -> int:
        open_ = i
        while open_ < stop and self.words[open_] not in ("{", ";"):
            open_ = self.match[open_] + 1 if self.words[open_] in ("(", "[") else open_ + 1
        has = open_ < stop and self.words[open_] == "{"
        last = min(self.match[open_], stop) if has else min(open_, stop)
        n = self.declare(kind, self.words[i + 1], first, mods_end, last, open_ if has else -1, up)
        self.marks.append((first, last, "decl", n))
        supers = next((j for j in range(i, open_) if self.words[j] in ("extends", "implements") and not self._in_angles(i, j)), None)
        if supers is not None:
            stop_at = next((j for j in range(supers, open_) if self.words[j] == "permits"), open_)
            self.marks.append((supers, stop_at, "supers", n))
        if has:
            begin = self.constants(open_ + 1, last, n) if kind == "enum" else open_ + 1
            self.members(begin, last, n)
        return last + 1

    def _in_angles(self, i: int, j: int) -> bool:
        return sum((w == "<") - (w == ">") for w in self.words[i:j]) > 0

    def constants(self, i: int, stop: int, up: int) -> int:
        """An enum's constants; returns where its other members begin."""
        while i < stop and self.words[i] != ";":
            first, i = i, self.modifiers(i, stop)
            if not self.name(i):
                i += 1
                continue
            mods_end, name, last, body = i, self.words[i], i, -1
            if self.words[i + 1] == "(":
                last = min(self.match[i + 1], stop - 1)
            if self.words[last + 1] == "{" and last + 1 < stop:
                body = last + 1
                last = min(self.match[body], stop - 1)
            self.declare("constant", name, first, mods_end, last, body, up)
            i = last + 1
        return i + 1

    def member(self, first: int, mods_end: int, i: int, stop: int, up: int, owner: dict) -> int:
        j = self.angles(i, stop) if self.words[i] == "<" else i
        begin_type = j
        while j < stop and self.words[j] not in ("(", "=", ";", ",", "{", "}", ")"):
            after = self.angles(j, stop) if self.words[j] == "<" else j
            j = after if after > j else self.match[j] + 1 if self.words[j] == "[" else j + 1
        w = self.words[j] if j < stop else ""
        name = j - 1
        while name > begin_type and self.words[name] in ("[", "]"):
            name -= 1
        torn = w == "(" and "{" in self.words[j : self.match[j]] and owner["kind"] != "annotation"
        if torn or w not in ("(", "=", ";", ",", "{") or name < begin_type or not self.name(name):
            return max(j, i) + 1 if w != "{" else min(self.match[j], stop) + 1
        returns = self.source[self.at[begin_type] : self.end(name - 1)] if name > begin_type else None
        if w == "(":
            close = min(self.match[j], stop)
            k = close + 1
            while k < stop and self.words[k] not in ("{", ";", "}"):
                k += 1
            body = k if k < stop and self.words[k] == "{" and "default" not in self.words[close:k] else -1
            if k < stop and self.words[k] == "{" and body < 0:  # the default of an annotation's element
                k = self.match[k] + 1
            last = min(self.match[k], stop) if body >= 0 else min(k, stop)
            if k < stop and self.words[k] == "}" and body < 0:
                last = k - 1
            kind = "element" if owner["kind"] == "annotation" else "method" if returns else "constructor"
            n = self.declare(kind, self.words[name], first, mods_end, last, body, up, self.parameters(j, close), returns)
            self.marks += [(first, last, "decl", n), (j, close, "params", n)] + ([(body, last, "block", n)] if body >= 0 else [])
            return last + 1
        if w == "{":
            last = min(self.match[j], stop)
            if owner["kind"] == "record" and self.words[name] == owner["name"] and not returns:
                n = self.declare("compact", self.words[name], first, mods_end, last, j, up)
                self.marks += [(first, last, "decl", n), (j, last, "block", n)]
            return last + 1
        if not returns:
            return j + 1
        last = j
        while last < stop and self.words[last] != ";":
            last = self.match[last] + 1 if self.words[last] in _CLOSE else last + 1
        last = min(last, stop - 1)
        n = self.declare("field", self.words[name], first, mods_end, last, -1, up, None, returns)
        self.marks.append((first, last, "decl", n))
        self.marks += [(k + 1, min(self.match[k + 1], last), "block", n) for k in range(j, last) if self.words[k] == "->" and self.words[k + 1] == "{"]
        return last + 1

    def parameters(self, open_: int, close: int) -> list[str]:
        out, i = [], open_ + 1
        while i < close:
            i = self.modifiers(i, close)
            begin = i
            while i < close and self.words[i] != ",":
                after = self.angles(i, close) if self.words[i] == "<" else i
                i = after if after > i else i + 1
            name = i - 1
            while name > begin and not self.name(name):
                name -= 1
            if name > begin:
                out.append(self.source[self.at[begin] : self.end(name - 1)] + self.source[self.end(name) : self.end(i - 1)].replace(" ", ""))
            i += 1
        return out

    def types_at(self) -> set[int]:
        """Tokens that stand where a type stands."""
        out, w = set(), self.words

        def chain(i: int) -> tuple[list[int], int]:
            """Names and what follows of Name.Name<...>[]...; nothing if it isn't one."""
            names, j = [], i
            while self.name(j):
                names.append(j)
                j += 1
                if w[j] == "<":
                    k = self.angles(j, len(w) - 1)
                    if k == j:
                        return [], j
                    names += [x for x in range(j, k) if self.name(x)]
                    j = k
                if w[j] == "." and self.name(j + 1):
                    j += 1
                else:
                    break
            while w[j] == "[" and w[j + 1] == "]":
                j += 2
            return names, j + 1 if w[j] == "..." else j

        for i in range(len(w) - 1):
            if not self.named[i]:
                continue
            before = w[i - 1] if i else ""
            if before in (".", "@", "::", "class", "interface", "enum", "@interface") or (before == "record" and w[i + 1] in ("(", "<")):
                continue
            names, j = chain(i)
            if not names or (w[i] == "record" and self.type_at(i, len(w))):
                continue
            listed = before == "," and i - 2 in out or before in (",", "&", "|") and self._listed(i, out)
            cast = before == "(" and w[j] == ")" and (i < 2 or not (self.name(i - 2) or w[i - 2] in (")", "]", ">", "if", "while", "switch", "super", "this", "for"))) and (self.name(j + 1) or w[j + 1] in ("(", "!", "~", "new", "this", "super") or w[j + 1][:1] in "\"'0123456789" and w[j + 1] != "")
            declared = self.name(j) and w[i] not in ("yield", "record", "sealed") and w[j] not in ("instanceof",)
            if before in ("new", "extends", "implements", "instanceof", "throws", "permits") or declared or listed or cast or (w[j] == "." and w[j + 1] == "class") or j > i + 1 and w[j - 1] in ("]", "...") or (w[j] == "|" and before == "(" and i > 1 and w[i - 2] == "catch"):
                out.update(names)
        for first, _, kind, n in self.marks:  # type parameters
            if kind == "decl":
                j = next((k for k in range(first, len(w)) if self.at[k] >= self.decls[n]["begin"] and (w[k] in ("<", "(", "{", "=", ";"))), first)
                if w[j] == "<":
                    out.update(x for x in range(j, self.angles(j, len(w) - 1)) if self.name(x))
        return out

    def _listed(self, i: int, out: set[int]) -> bool:
        """Whether the list that i is in began behind extends, implements, throws, permits or catch (."""
        j = i - 1
        while j > 0 and (self.words[j] in (",", ".", "<", ">", "&", "|", "?", "extends", "super", "[", "]") or self.name(j)):
            if self.words[j] in ("implements", "throws", "permits", "extends"):
                return True
            j -= 1
        return self.words[j] in ("implements", "throws", "permits", "extends") or self.words[j] == "(" and self.words[j - 1] == "catch"

    def names(self) -> list[dict]:
        types, out, spans = self.types_at(), [], sorted(self.marks, key=lambda m: (m[0], -m[1]))
        stack: list[tuple[int, int, str, int]] = []
        k, ends = 0, len(self.words)  # ends: the first end in the stack, till which nothing leaves it
        imported, up, region, block = False, -1, "", False
        for i in range(len(self.words) - 1):
            if not self.named[i]:
                continue
            if i > ends or k < len(spans) and spans[k][0] <= i:
                while k < len(spans) and spans[k][0] <= i:
                    stack.append(spans[k])
                    k += 1
                stack = [m for m in stack if m[1] >= i]
                ends = min((m[1] for m in stack), default=len(self.words))
                imported, block = any(m[2] == "import" for m in stack), any(m[2] == "block" for m in stack)
                up = next((m[3] for m in reversed(stack) if m[2] == "decl"), -1)
                region = next((m[2] for m in reversed(stack) if m[2] in ("block", "supers", "params")), "")
            word = self.words[i]
            if imported or word in ("sealed", "permits", "non-sealed") and self.named[i + 1] or word == "record" and self.type_at(i, len(self.words)):
                continue
            kind = "type" if i in types else "name"
            first = kind == "name" and word[:1].isupper() and (not i or self.words[i - 1] != ".")
            use = "." if first and self.words[i + 1] == "." else "::" if first and self.words[i + 1] == "::" else ""
            out.append({"kind": kind, "name": word, "use": use, "begin": self.at[i], "up": up, "region": region, "block": block})
        return out


DECL = "struct<kind:string,name:string,begin:int,end:int,body:int,up:int,depth:int,mods:array<string>,visibility:string,hidden:boolean,within:array<int>,params:array<string>,returns:string>"
NAME = "struct<kind:string,name:string,use:string,begin:int,up:int,region:string,block:boolean>"


def nodes_of(source: str) -> dict:
    r = Reader(source)
    r.members(0, len(r.words) - 1, -1)
    return {"decls": r.decls, "names": r.names()}


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_DECLS = pa.list_(pa.struct([("kind", _S), ("name", _S), ("begin", _I), ("end", _I), ("body", _I), ("up", _I), ("depth", _I), ("mods", pa.list_(_S)), ("visibility", _S), ("hidden", _B), ("within", pa.list_(_I)), ("params", pa.list_(_S)), ("returns", _S)]))
_NAMES = pa.list_(pa.struct([("kind", _S), ("name", _S), ("use", _S), ("begin", _I), ("up", _I), ("region", _S), ("block", _B)]))

#: Sources whose nodes are Python objects at a time.
SLICE = 256


def trees(sources: pa.Array) -> pa.Array:
    """tree() of an Arrow array. Equal sources are read once. Lists become arrays at once; by way of pandas each node would be converted in Python."""
    coded = sources.dictionary_encode()
    each_once = coded.dictionary if 2 * len(coded.dictionary) <= len(sources) else sources
    parts = []
    for at in range(0, max(len(each_once), 1), SLICE):
        each = [nodes_of(s) if s is not None else {"decls": [], "names": []} for s in each_once.slice(at, SLICE).to_pylist()]
        parts.append(pa.StructArray.from_arrays([pa.array([e["decls"] for e in each], _DECLS), pa.array([e["names"] for e in each], _NAMES)], ["decls", "names"]))
    out = pa.concat_arrays(parts)
    if each_once is sources:
        return out
    # a null is no word of the dictionary: it gets the nodes of an empty source
    none = pa.StructArray.from_arrays([pa.array([[]], _DECLS), pa.array([[]], _NAMES)], ["decls", "names"])
    return pa.concat_arrays([out.slice(0, len(each_once)), none]).take(coded.indices.fill_null(len(each_once)))


_made: list = []


def tree(source: Column) -> Column:
    """A source's nodes: declarations (types, members, enum constants) in their order, and names. Intervals
    are in code points, `up` is the place of the declaration around, `within` all of them from the outermost. Null gives none."""
    if not _made:
        _made.append(F.arrow_udf(trees, returnType=f"struct<decls:array<{DECL}>,names:array<{NAME}>>"))
    ship(SparkSession.active())
    return _made[0](source)


# extractors


def _set(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(names, lambda n: n["name"])))


def identifiers(t: Column) -> Column:
    """The sorted set of all names in code: not keywords, nor what comments, literals, imports and the package line hold."""
    return _set(t["names"])


def type_names(t: Column, references: bool = False) -> Column:
    """The sorted set of types named: where a type stands, and capital names with a member behind a dot
    (with references, behind :: too)."""
    return _set(F.filter(t["names"], lambda n: (n["kind"] == "type") | (n["use"] == ".") | ((n["use"] == "::") & F.lit(references))))


def _refs(t: Column, where: Callable[[Column], Column]) -> Column:
    return _set(F.filter(t["names"], lambda n: ((n["kind"] == "type") | (n["use"] != "")) & where(n)))


def _shown(t: Column, n: Column) -> Column:
    """Whether a name is in a declaration and none around it is private."""
    return (n["up"] >= 0) & ~F.coalesce(F.get(t["decls"], n["up"])["hidden"], F.lit(True))


def _in_member(t: Column, n: Column) -> Column:
    return F.get(t["decls"], n["up"])["kind"].isin(*MEMBERS)


def api_refs(t: Column) -> Column:
    """Types that a source's declarations show: supertypes, and what members that aren't private name outside of bodies."""
    return _refs(t, lambda n: _shown(t, n) & ~n["block"] & ((n["region"] == "supers") | _in_member(t, n)))


def param_refs(t: Column) -> Column:
    """Types of the parameters of members that aren't private."""
    return _refs(t, lambda n: _shown(t, n) & (n["region"] == "params") & ~n["block"])


def super_refs(t: Column) -> Column:
    """Types that top-level types extend and implement."""
    return _refs(t, lambda n: (n["region"] == "supers") & (F.get(t["decls"], n["up"])["depth"] == 0))


# renderers


def accessible(visibility: Column, same_package: Column) -> Column:
    return (visibility == "public") | ((visibility != "private") & same_package)


def cut(source: Column, begin: Column, end: Column) -> Column:
    return F.substring(source, begin + 1, end - begin)


def head(source: Column, d: Column) -> Column:
    """A declaration without its body."""
    return F.when(d["body"] < 0, cut(source, d["begin"], d["end"])).otherwise(F.rtrim(F.regexp_replace(cut(source, d["begin"], d["body"]), r"\s+$", "")))


def source_signature(d: Column) -> Column:
    """A member's name and its parameters' simple types, as text.signature() gives for byte code."""
    return text.signature(d["name"], d["params"])


Keep = Callable[[Column], Column]


def kept(t: Column, keep: Keep) -> Column:
    """For each declaration whether it is shown: members by `keep`, enum constants always, both within nested types that
    are kept themselves; types that show something (top-level ones needn't be kept)."""
    d = t["decls"]
    own = F.transform(d, lambda x: F.coalesce(keep(x), F.lit(False)))
    both = F.struct(d.alias("d"), own.alias("own"))
    # arrays are bound to names by a fold over one element, so each is made once
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    reached = lambda b, x: F.forall(x["within"], lambda w: (F.get(b["d"], w)["depth"] == 0) | F.get(b["own"], w))
    leaf = lambda b: F.transform(b["d"], lambda x, i: ((x["kind"] == "constant") | (x["kind"].isin(*MEMBERS) & F.get(b["own"], i))) & reached(b, x))
    return bound(both, lambda b: bound(F.struct(b["d"].alias("d"), leaf(b).alias("leaf")), lambda c: F.transform(c["d"], lambda x, i: F.get(c["leaf"], i) | (x["kind"].isin(*TYPES) & F.exists(F.arrays_zip(c["d"].alias("d"), c["leaf"].alias("leaf")), lambda y: y["leaf"] & F.array_contains(y["d"]["within"], i.cast("int")))))))


def rendered(source: Column, t: Column, keep: Keep, body_for: Keep) -> Column:
    """Types as texts: heads, enum constants in a line, and kept members in their order, with bodies where body_for says so; null where nothing is kept."""
    pad = lambda n: F.repeat(F.lit("    "), n)
    whole = lambda d: cut(source, d["begin"], d["end"])
    short = lambda d: F.when(F.length(whole(d)) > 200, F.concat(F.regexp_replace(F.substring_index(whole(d), "=", 1), r"\s+$", ""), F.lit(NO_VALUE))).otherwise(whole(d))
    member = lambda d: F.when(d["kind"] == "field", short(d)).when((d["body"] < 0) | F.coalesce(body_for(d), F.lit(False)), whole(d)).otherwise(F.concat(head(source, d), F.lit(OMITTED)))
    line = lambda at, s: F.struct(at.alias("at"), s.alias("line"))

    def lines(x: Column, i: Column, d: Column) -> Column:
        constants = F.transform(F.filter(d, lambda y: (y["kind"] == "constant") & (y["up"] == i.cast("int"))), lambda y: head(source, y))
        listed = F.when(F.size(constants) > 0, F.concat(pad(x["depth"] + 1), F.array_join(constants, ", "), F.lit(";")))
        # a line of its own parts top-level types
        opened = F.concat(F.when(x["depth"] == 0, F.lit("\n")).otherwise(F.lit("")), pad(x["depth"]), head(source, x), F.lit(" {"))
        of_type = F.array(line(x["begin"], opened), line(x["body"], listed), line(x["end"], F.concat(pad(x["depth"]), F.lit("}"))))
        return F.when(x["kind"].isin(*TYPES), of_type).when(x["kind"] == "constant", F.array().cast("array<struct<at:int,line:string>>")).otherwise(F.array(line(x["begin"], F.concat(pad(x["depth"]), member(x)))))

    shown = F.filter(F.transform(F.arrays_zip(t["decls"].alias("d"), kept(t, keep).alias("k")), lambda z, i: F.struct(z["d"].alias("d"), z["k"].alias("k"), i.alias("i"))), lambda z: z["k"])
    parts = F.flatten(F.transform(shown, lambda z: lines(z["d"], z["i"], t["decls"])))
    said = F.transform(F.filter(F.array_sort(parts), lambda p: p["line"].isNotNull()), lambda p: p["line"])
    return F.when(F.size(said) > 0, F.substring(F.array_join(said, "\n"), 2, 1 << 30))


def surface_view(source: Column, t: Column, same_package: Column, used: Column) -> Column:
    """Accessible members, with bodies of what a class uses."""
    return rendered(source, t, lambda d: accessible(d["visibility"], same_package), lambda d: F.array_contains(used, d["name"]))


def called_view(source: Column, t: Column, same_package: Column, called: Column, simple: Column) -> Column:
    """Only the accessible members that a class calls, with their bodies. simple: the file's type."""
    wanted = lambda d: d["kind"].isin(*TYPES) | F.array_contains(called, d["name"]) | ((d["kind"] == "constructor") & F.array_contains(called, simple))
    return rendered(source, t, lambda d: accessible(d["visibility"], same_package) & wanted(d), lambda d: F.array_contains(called, d["name"]))


def results_view(source: Column, t: Column, same_package: Column) -> Column:
    """Accessors: accessible methods of instances without parameters that give something."""
    accessor = lambda d: (d["kind"] == "method") & (F.size(d["params"]) == 0) & (d["returns"] != "void") & ~F.array_contains(d["mods"], "static")
    return rendered(source, t, lambda d: accessible(d["visibility"], same_package) & accessor(d), lambda d: F.lit(False))


def supertype_view(source: Column, t: Column, same_package: Column, used: Column, signatures: Column) -> Column:
    """What a type passes on: accessible fields, and those methods whose signatures are listed."""
    keep = lambda d: accessible(d["visibility"], same_package) & ((d["kind"] == "field") | (d["kind"] == "method") & F.array_contains(signatures, source_signature(d)))
    return rendered(source, t, keep, lambda d: F.array_contains(used, d["name"]))


def with_private_tags(source: Column, t: Column) -> Column:
    """The source with a mark before each private declaration outside of bodies."""
    marked = F.filter(t["decls"], lambda d: F.array_contains(d["mods"], "private") & d["kind"].isin(*TYPES, *MEMBERS))
    at = F.concat(F.array(F.lit(0)), F.transform(marked, lambda d: d["begin"]))
    pieces = F.transform(at, lambda a, i: cut(source, a, F.coalesce(F.get(at, i + 1), F.length(source))))
    return F.array_join(pieces, PRIVATE_TAG + " ")


def with_inherited_tag(source: Column, t: Column, inaccessible: Column) -> Column:
    """The source with a line behind its type's opening brace that names inherited members out of reach.

    inaccessible: array of (ancestor, names). Without any, or without a body, the source stays.
    """
    body = F.get(F.filter(t["decls"], lambda d: d["depth"] == 0), 0)["body"]
    said = F.array_join(F.transform(inaccessible, lambda x: F.concat(F.array_join(x["names"], ", "), F.lit(" (from "), F.element_at(F.split(x["ancestor"], r"\."), -1), F.lit(")"))), "; ")
    note = F.concat(F.lit(f"\n    /* INHERITED, {MARKER}: protected or package-private in another package: "), said, F.lit(" */"))
    return F.when((F.size(inaccessible) > 0) & (body >= 0), F.concat(F.substring(source, F.lit(1), body + 1), note, F.substring(source, body + 2, F.length(source)))).otherwise(source)


def find_type(t: Column, names: Column) -> Column:
    """The declaration of a nested type: names are those of its outer types and its own, outermost first; null if one isn't there."""
    begin = F.when(F.size(t["decls"]) >= 0, F.lit(-1))
    step = lambda up, n: F.array_position(F.transform(t["decls"], lambda d: F.coalesce(d["kind"].isin(*TYPES) & (d["name"] == n) & (d["up"] == up), F.lit(False))), True).cast("int") - 1
    at = F.aggregate(names, begin, lambda up, n: F.when((up == -2) | (step(up, n) < 0), F.lit(-2)).otherwise(step(up, n)))
    return F.when(at >= 0, F.get(t["decls"], at))


def nested_body(source: Column, t: Column, names: Column) -> Column:
    """The text of a nested type's declaration, its end included."""
    d = find_type(t, names)
    return F.when(d.isNotNull(), cut(source, d["begin"], d["end"]))
