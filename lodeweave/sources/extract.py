"""Facts of source files, by a tokenizer and per-language rules: declarations, imports, references, shapes, pragmas.

Works on tokens, not on full grammars: enough to see what a file declares, brings in, hands on and uses. A file that can't
be read to its end still gives what was found. Facts travel as one JSON text per file and become arrays in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Languages by the last extension. Fixed values.
LANGUAGES = {"js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "mts": "js", "cts": "js", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "css": "css", "scss": "css", "html": "html", "htm": "html", "json": "json"}
#: Paths of tests and of tooling, for all languages. Fixed values.
TEST_PATHS = r"(?:^|/)(?:tests?|__tests__|spec|androidTest)/|[._-](?:test|spec)\.[a-z]+$|_test\.go$|Tests?\.(?:java|kt|swift)$"
TOOLING_PATHS = r"(?:^|/)(?:scripts?|tools?|benches|examples?|build)/|(?:^|/)[\w.-]+\.config\.[cm]?[jt]s$|(?:^|/)build\.rs$|\.gradle\.kts$"

FACTS = """struct<unit:string,
declarations:array<struct<name:string,kind:string,first:int,last:int,exported:boolean,member_of:string,visibility:int,markers:array<string>,implements:string,signature_last:int,implicitly_invoked:boolean>>,
imports:array<struct<specifier:string,name:string,alias:string,line:int,reexport:boolean>>,
references:array<struct<name:string,qualifier:string,kind:string,line:int>>,
shapes:array<struct<name:string,first:int,last:int,cyclomatic:int,loc:int,tokens:array<string>,construction:boolean>>,
types:array<struct<owner:string,name:string,type:string,line:int>>,generics:array<struct<type:string,params:array<string>>>,
texts:array<struct<callee:string,text:string,line:int>>,gates:array<struct<module:string,gated:boolean,line:int>>,
pragmas:array<struct<line:int,scope:string,category:string,subject:string>>,
roots:array<struct<kind:string,name:string,confidence:int>>,dynamics:array<struct<dir:string,line:int>>,diagnostics:array<string>>"""

TOKEN = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|\"\"\".*?\"\"\")|(?P<number>\b\d[\w.]*)|(?P<name>[@#]?[A-Za-z_$][\w$]*!?)|(?P<sign>=>|->|::|\.\.\.|&&|\|\||\?\?|\?\.|[^\s\w])""", re.S)
PRAGMA = re.compile(r"weave:allow(-file)?[ \t]+([a-z-]+)(?::(\S+))?")
TYPE_WORDS = frozenset("class interface struct trait enum protocol object actor record".split())
BRANCHES = frozenset("if for while case catch when guard match && || ?? ?".split())
#: Words that are no references, in all languages and per language. Fixed values.
COMMON = frozenset("if else for while do switch case default break continue return class const new try catch finally throw this super null true false import package void static enum interface".split())
KEYWORDS = {
    "js": COMMON | set("function let var delete typeof instanceof in of export from as async await yield undefined get set extends implements type namespace public private protected readonly abstract declare keyof".split()),
    "rust": COMMON | set("fn pub use mod impl trait struct where match loop move ref mut self Self crate dyn unsafe extern let in as type async await i32 i64 u8 u32 u64 usize bool str".split()),
    "go": COMMON | set("func range go defer chan select map fallthrough nil type struct var int string bool error byte float64 make len append".split()),
    "java": COMMON | set("extends implements public private protected abstract final int long double float boolean char byte short instanceof synchronized throws record var".split()),
    "kotlin": COMMON | set("fun val var object companion override open internal sealed data init is in as when public private protected abstract".split()),
    "swift": COMMON | set("func let var guard is in as self Self init deinit protocol extension struct fileprivate private public internal open final override nil throws some any actor where".split()),
}


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Facts:
    unit: str | None = None
    declarations: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    shapes: list[dict] = field(default_factory=list)
    pragmas: list[dict] = field(default_factory=list)
    roots: list[dict] = field(default_factory=list)
    dynamics: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    generics: list[dict] = field(default_factory=list)
    texts: list[dict] = field(default_factory=list)
    gates: list[dict] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)

    def declare(self, name: str, kind: str, first: int, last: int, exported: bool, **more) -> None:
        self.declarations.append({"name": name, "kind": kind, "first": first, "last": last, "exported": exported, "member_of": None, "visibility": 2 if exported else 0, "markers": [], "implements": None, "signature_last": first, "implicitly_invoked": False} | more)

    def bring(self, specifier: str, line: int, name: str | None = None, alias: str | None = None, reexport: bool = False) -> None:
        self.imports.append({"specifier": specifier, "name": name, "alias": alias or name, "line": line, "reexport": reexport})


def tokenize(text: str, facts: Facts) -> list[Token]:
    out, line, at = [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup == "comment":
            for p in PRAGMA.finditer(m[0]):
                facts.pragmas.append({"line": line + m[0].count("\n"), "scope": "file" if p[1] else "next", "category": p[2], "subject": p[3]})
        else:
            out.append(Token(m.lastgroup, m[0], line))
    return out


def closing(tokens: list[Token], i: int) -> int:
    """Index of the bracket that closes the one at i; the last token if none does."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    open_, close = tokens[i].text, pairs[tokens[i].text]
    for j in range(i, len(tokens)):
        depth += (tokens[j].text == open_) - (tokens[j].text == close)
        if not depth:
            return j
    return len(tokens) - 1


def opening(tokens: list[Token], i: int) -> int:
    """Index of the parenthesis that the one at i closes, within 200 tokens; 0 if none is found."""
    depth = 0
    for j in range(i, max(-1, i - 200), -1):
        depth += (tokens[j].text == ")") - (tokens[j].text == "(")
        if not depth:
            return j
    return 0


def body_of(tokens: list[Token], i: int) -> tuple[int, int] | None:
    """Indices of the braces of the next body from i, on this side of the next `;` or declaration end."""
    depth = 0
    for j in range(i, len(tokens)):
        t = tokens[j].text
        if t in "([" and len(t) == 1:
            depth += 1
        elif t in ")]" and len(t) == 1:
            depth -= 1
        elif t == "{" and depth == 0:
            return j, closing(tokens, j)
        elif t == ";" and depth <= 0 or depth < 0:
            return None
    return None


def shape(facts: Facts, name: str, tokens: list[Token], start: int, stop: int, words: frozenset[str]) -> None:
    """Complexity, size and the normalised tokens of a function body."""
    body = tokens[start : stop + 1]
    plain = ["ID" if t.kind == "name" and t.text not in words else "LIT" if t.kind in ("string", "number") else t.text for t in body]
    facts.shapes.append({"name": name, "first": body[0].line, "last": body[-1].line, "cyclomatic": 1 + sum(t.text in BRANCHES for t in body), "loc": body[-1].line - body[0].line + 1, "tokens": plain, "construction": is_construction(body)})


def is_construction(body: list[Token]) -> bool:
    """Whether a whole body is one expression that builds a value: `new T(...)`, `T(...)`, `T { ... }` or `&T{...}`."""
    inner = [t for t in body[1:-1] if t.text != ";"]
    while inner and inner[0].text in ("return", "new", "&"):
        inner = inner[1:]
    k = 0
    while k + 2 < len(inner) and inner[k].kind == "name" and inner[k + 1].text in (".", "::"):
        k += 2
    if k + 1 >= len(inner) or inner[k].kind != "name" or not (inner[k].text[:1].isupper() or inner[k].text == "new") or inner[k + 1].text not in ("(", "{"):
        return False
    return closing(inner, k + 1) == len(inner) - 1


def type_text(tokens: list[Token], i: int) -> tuple[str, int]:
    """A type's name with its arguments from token i on, and the index behind it; empty if there is none."""
    while i < len(tokens) and tokens[i].text in ("&", "*", "mut", "?", "dyn", "any", "some", "var", "inout"):
        i += 1
    if i >= len(tokens) or tokens[i].kind != "name" or not tokens[i].text[:1].isupper():
        return "", i
    out, i = tokens[i].text, i + 1
    if i < len(tokens) and tokens[i].text == "<":
        depth, j = 0, i
        while j < min(len(tokens), i + 40):
            depth += (tokens[j].text == "<") - (tokens[j].text == ">")
            out += tokens[j].text
            j += 1
            if not depth:
                return out, j
        return out.split("<")[0], i
    return out, i


def types_of(facts: Facts, tokens: list[Token], language: str) -> None:
    """(owner, name, type, line): what names are known to hold or yield. owner is the type whose member it is, or null for a
    variable or parameter; parameters of generic types; string arguments of calls."""
    n = len(tokens)
    at = lambda k: tokens[k].text if 0 <= k < n else ""
    # the type whose body directly holds each token
    owners: list[str | None] = [None] * n
    stack: list[str | None] = []
    coming: str | None = None
    for i, t in enumerate(tokens):
        if t.kind == "name" and t.text in TYPE_WORDS and i + 1 < n and tokens[i + 1].kind == "name" and at(i - 1) != ".":
            coming = at(i + 1)
        elif t.kind == "name" and t.text in ("impl", "extension"):
            head = [x.text for x in tokens[i + 1 : i + 30]]
            head = head[: head.index("{")] if "{" in head else []
            coming = next((x for x in (head[head.index("for") + 1 :] if "for" in head else head) if x[:1].isupper()), None)
        elif t.text == "{":
            stack.append(coming)
            coming = None
        elif t.text == "}" and stack:
            stack.pop()
        elif t.text == ";":
            coming = None
        owners[i] = stack[-1] if stack else None

    def note(i: int, type_: str) -> None:
        facts.types.append({"owner": owners[i], "name": at(i), "type": type_, "line": tokens[i].line})

    for i, t in enumerate(tokens):
        if t.kind == "string" and at(i - 1) == "(" and i > 1 and tokens[i - 2].kind == "name":
            facts.texts.append({"callee": at(i - 2), "text": t.text[1:-1], "line": t.line})
        if t.kind != "name":
            continue
        if t.text in ("class", "interface", "struct", "trait", "enum", "protocol") and at(i + 2) == "<":
            text, _ = type_text(tokens, i + 1)
            params = [x.strip().split(":")[0].split("extends")[0].strip() for x in text.partition("<")[2].rstrip(">").split(",")]
            if params and params != [""]:
                facts.generics.append({"type": at(i + 1), "params": params})
        after = at(i + 1)
        if after in (":", "?:") and at(i + 2) != "=" or after == "?" and at(i + 2) == ":":
            found, of = type_text(tokens, i + (3 if after == "?" else 2))[0], i
        elif after == "=" and at(i + 2) == "new":
            found, of = type_text(tokens, i + 3)[0], i
        elif after == "=" and (language in ("kotlin", "swift") and at(i + 3) == "(" or language == "rust" and at(i + 3) in ("::", "{")):
            found, of = type_text(tokens, i + 2)[0], i
        elif language == "go" and after == ":" and at(i + 2) == "=":
            found, of = type_text(tokens, i + 3)[0], i
        elif language == "java" and t.text[:1].isupper() and at(i - 1) not in ("class", "interface", "enum", "new", "."):
            found, of = type_text(tokens, i)
            found = found if of < n and tokens[of].kind == "name" and at(of) not in KEYWORDS["java"] else ""
        elif language == "go" and i and t.text[:1].isupper() and tokens[i - 1].kind == "name" and at(i - 1) not in KEYWORDS["go"] and at(i - 2) != "func":
            found, of = t.text, i - 1
        elif after == "(" and owners[i] and language != "java":
            stop = closing(tokens, i + 1)
            found, of = type_text(tokens, stop + 2)[0] if at(stop + 1) in (":", "->") else "", i
        else:
            continue
        if found:
            note(of, found)


def references(facts: Facts, tokens: list[Token], skip: set[int], words: frozenset[str]) -> None:
    """Names that are used: calls, reads, types; with the name before a dot as qualifier."""
    for i, t in enumerate(tokens):
        before = tokens[i - 1].text if i else ""
        if t.kind != "name" or i in skip or t.text[0] in "@#" or (t.text in words and before not in (".", "?.", "::")):
            continue
        after = tokens[i + 1].text if i + 1 < len(tokens) else ""
        if before in (".", "?.", "::") and i > 1:
            parts, k = [], i - 2
            while True:
                if k > 0 and tokens[k].text == ")":  # a call in the chain yields what its name does
                    k = opening(tokens, k) - 1
                if k < 0 or tokens[k].kind != "name":
                    break
                parts.append(tokens[k].text)
                if k < 2 or tokens[k - 1].text not in (".", "?.", "::"):
                    break
                k -= 2
            qualifier = ".".join(reversed(parts)) if parts and tokens[k].kind == "name" else "?"
        else:
            qualifier = None
        kind = "call" if after == "(" or t.text.endswith("!") else "extend" if before in ("extends",) else "implement" if before == "implements" else "type-use" if before in (":", "->", "<", "as", "new") else "read"
        facts.references.append({"name": t.text.rstrip("!"), "qualifier": qualifier, "kind": kind, "line": t.line})


def _string(t: Token) -> str:
    return t.text[1:-1]


def javascript(text: str, facts: Facts) -> None:
    tokens, words = tokenize(text, facts), KEYWORDS["js"]
    skip: set[int] = set()
    n, i, depth, owners = len(tokens), 0, 0, []
    at = lambda k: tokens[k].text if 0 <= k < n else ""
    exported_names: set[str] = set()
    while i < n:
        t = tokens[i]
        if t.text == "{":
            depth += 1
        elif t.text == "}":
            depth -= 1
            while owners and owners[-1][1] <= i:
                owners.pop()
        if t.text == "import" and at(i + 1) == "(":
            if tokens[i + 2].kind == "string":
                spec = _string(tokens[i + 2])
                prefix = spec.split("${")[0]
                if "${" in spec and "/" in prefix:
                    facts.dynamics.append({"dir": prefix.rsplit("/", 1)[0], "line": t.line})
                elif "${" not in spec:
                    facts.bring(spec, t.line, "*")
        elif t.text == "require" and at(i + 1) == "(" and i + 2 < n and tokens[i + 2].kind == "string":
            name = at(i - 2) if at(i - 1) == "=" and tokens[i - 2].kind == "name" else None
            facts.bring(_string(tokens[i + 2]), t.line, "*", name)
        elif t.text in ("import", "export") and depth == 0:
            j, names, star = i + 1, [], False
            is_export = t.text == "export"
            if at(j) == "type" and at(j + 1) in ("{", "*"):
                j += 1
            if not is_export and j < n and tokens[j].kind == "string":
                facts.bring(_string(tokens[j]), t.line)
                i = j + 1
                continue
            if at(j) in ("{", "*") or not is_export:
                end = j
                while end < n and at(end) != ";" and not (tokens[end].kind == "string") and not (end > j and at(end) in ("import", "export")):
                    if at(end) == "{":
                        stop, k = closing(tokens, end), end + 1
                        while k < stop:
                            if tokens[k].kind == "name" and at(k) != "type":
                                name, alias = at(k), at(k)
                                if at(k + 1) == "as":
                                    alias, k = at(k + 2), k + 2
                                names.append((name, alias))
                            k += 1
                        end = stop
                        if is_export and at(end + 1) != "from":
                            exported_names |= {a for a, _ in names}
                            break
                    elif at(end) == "*":
                        star = True
                        if at(end + 1) == "as":
                            names.append(("*", at(end + 2)))
                            star, end = False, end + 2
                    elif not is_export and tokens[end].kind == "name" and at(end) not in ("from", "type"):
                        names.append(("default", at(end)))
                    end += 1
                skip |= set(range(i, min(end + 1, n)))
                if end < n and tokens[end].kind == "string":
                    spec = _string(tokens[end])
                    for name, alias in names:
                        facts.bring(spec, t.line, name, alias, is_export)
                    if star or not names:
                        facts.bring(spec, t.line, "*" if star else None, None, is_export)
                i = end + 1
                continue
        if t.text in ("function", "class", "const", "let", "var", "interface", "type", "enum") and t.kind == "name" and at(i - 1) != ".":
            j = i + 1
            while at(j) in ("*",):
                j += 1
            name = at(j) if j < n and tokens[j].kind == "name" and at(j) not in words else None
            export = "export" in (at(i - 1), at(i - 2), at(i - 3)) and depth == 0
            default = "default" in (at(i - 1), at(i - 2))
            if t.text == "type" and at(j + 1) not in ("=", "<"):
                name = None
            if name and (depth == 0 or t.text == "function"):
                found = body_of(tokens, j + 1) if t.text not in ("const", "let", "var", "type") else None
                arrow = None
                if t.text in ("const", "let", "var"):
                    for k in range(j + 1, min(j + 60, n)):
                        if at(k) == ";" or at(k) in ("const", "let", "var", "export", "import"):
                            break
                        if at(k) in ("=>", "function"):
                            arrow = body_of(tokens, k + 1) if at(k) == "function" or at(k + 1) == "{" else None
                            break
                span = found or arrow
                kind = "function" if t.text == "function" or arrow else {"const": "constant", "let": "variable", "var": "variable"}.get(t.text, t.text)
                if depth == 0:
                    facts.declare(name, kind, t.line, tokens[span[1]].line if span else t.line, export)
                    if default:
                        exported_names.add(name)
                if span and kind == "function":
                    shape(facts, name, tokens, *span, words)
                if t.text == "class" and span:
                    owners.append((name, span[1], depth + 1))
                skip.add(j)
        elif owners and depth == owners[-1][2] and t.kind == "name" and at(i + 1) == "(" and t.text not in words and at(i - 1) in ("{", "}", ";", "async", "static", "public", "private", "protected", "get", "set"):
            span = body_of(tokens, i + 1)
            private = "private" in (at(i - 1), at(i - 2))
            facts.declare(t.text, "constructor" if t.text == "constructor" else "method", t.line, tokens[span[1]].line if span else t.line, not private, member_of=owners[-1][0], implicitly_invoked=t.text in ("constructor", "toString", "toJSON", "valueOf"))
            if span:
                shape(facts, f"{owners[-1][0]}.{t.text}", tokens, *span, words)
            skip.add(i)
        elif t.text == "default" and at(i - 1) == "export" and tokens[i + 1].kind == "name" and at(i + 1) not in words:
            exported_names.add(at(i + 1))
        elif t.text == "exports" and at(i + 1) in (".", "="):
            if at(i + 1) == ".":
                exported_names.add(at(i + 2))
            elif at(i + 2) == "{":
                exported_names |= {x.text for x in tokens[i + 3 : closing(tokens, i + 2)] if x.kind == "name"}
            elif i + 2 < n and tokens[i + 2].kind == "name":
                exported_names.add(at(i + 2))
        i += 1
    for d in facts.declarations:
        if d["name"] in exported_names and not d["member_of"]:
            d["exported"], d["visibility"] = True, 2
    references(facts, tokens, skip, words)
    types_of(facts, tokens, "js")


#: Per language: declaration keywords with kinds, how a name is public, and patterns of imports and units.
RULES = {
    "rust": ({"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "constant", "static": "constant", "type": "type", "mod": "module"}, "pub"),
    "go": ({"func": "function", "type": "type", "var": "variable", "const": "constant"}, None),
    "java": ({"class": "class", "interface": "interface", "enum": "enum", "record": "class"}, "public"),
    "kotlin": ({"class": "class", "interface": "interface", "object": "object", "fun": "function", "val": "property", "var": "property"}, None),
    "swift": ({"class": "class", "struct": "struct", "enum": "enum", "protocol": "protocol", "func": "function", "var": "property", "let": "property", "actor": "class"}, "public"),
}


def braces(language: str, text: str, facts: Facts) -> None:
    """Rust, Go, Java, Kotlin and Swift: keyword declarations at the top level and in types, imports, references."""
    keywords, public = RULES[language]
    tokens, reserved = tokenize(text, facts), KEYWORDS[language]
    n, skip, owners, depth, i = len(tokens), set(), [], 0, 0
    at = lambda k: tokens[k].text if 0 <= k < n else ""

    def qualified(k: int) -> tuple[str, int]:
        parts, word = [], False
        while k < n and (at(k) in (".", "::") or at(k) == "*" or tokens[k].kind == "name" and not word):
            word = at(k) not in (".", "::")
            parts.append(at(k) if word else ".")
            k += 1
        return "".join(parts).rstrip("."), k

    while i < n:
        t = tokens[i]
        depth += (t.text == "{") - (t.text == "}")
        while owners and owners[-1][1] <= i:
            owners.pop()
        if t.text in ("package", "module") and not facts.unit and depth == 0 and t.kind == "name" and language in ("go", "java", "kotlin"):
            facts.unit, i = qualified(i + 1)
            continue
        if t.text in ("import", "use") and t.kind == "name" and depth == 0:
            if language == "go":
                stop = closing(tokens, i + 1) if at(i + 1) == "(" else i + 3
                for k in range(i + 1, min(stop + 1, n)):
                    if tokens[k].kind == "string":
                        facts.bring(_string(tokens[k]), tokens[k].line, "*", at(k - 1) if tokens[k - 1].kind == "name" and at(k - 1) != "import" else _string(tokens[k]).rsplit("/", 1)[-1])
                        if at(i + 1) != "(":
                            break
            elif language == "rust":
                path, stop = qualified(i + 1)
                if at(stop) == "{":
                    end = closing(tokens, stop)
                    for x in tokens[stop + 1 : end]:
                        if x.kind == "name" and x.text not in ("as", "self"):
                            facts.bring(path.rstrip("."), t.line, x.text)
                    stop = end
                else:
                    facts.bring(path.rpartition(".")[0] or path, t.line, path.rpartition(".")[2], at(stop + 1) if at(stop) == "as" else None, at(i - 1) == "pub")
            else:
                start = i + 2 if at(i + 1) == "static" else i + 1
                path, stop = qualified(start)
                facts.bring(path.rpartition(".")[0] if language != "swift" and "." in path else path, t.line, path.rpartition(".")[2])
            skip |= set(range(i, min(stop + 1, n)))
            i = stop + 1
            continue
        if t.text == "mod" and language == "rust" and i + 1 < n and tokens[i + 1].kind == "name" and at(i + 2) == ";":
            near = "".join(x.text for x in tokens[max(0, i - 9) : i])
            facts.bring(f"mod:{at(i + 1)}", t.line, "*", at(i + 1))
            facts.gates.append({"module": at(i + 1), "gated": bool(re.search(r"#\[cfg\(.*\btest\b.*\)\](?:pub)?$", near)), "line": t.line})
            skip.add(i + 1)
            i += 3
            continue
        if t.text == "impl" and language == "rust":
            span = body_of(tokens, i)
            names = [x.text for x in tokens[i + 1 : span[0]] if x.kind == "name" and x.text not in ("for", "where", "dyn")] if span else []
            if span and names:
                owners.append((names[-1] if "for" in [x.text for x in tokens[i:span[0]]] else names[0], span[1], depth + 1, names[0] if "for" in [x.text for x in tokens[i:span[0]]] else None))
        elif t.text in keywords and t.kind == "name" and at(i - 1) not in (".", "::"):
            j, owner = i + 1, owners[-1][0] if owners and depth == owners[-1][2] else None
            if language == "go" and t.text == "func" and at(j) == "(":
                stop = closing(tokens, j)
                owner = next((x.text for x in reversed(tokens[j:stop]) if x.kind == "name"), None)
                j = stop + 1
            if j < n and tokens[j].kind == "name" and (depth == 0 or owner):
                name = at(j)
                span = body_of(tokens, j + 1) if keywords[t.text] not in ("constant", "variable", "property") else None
                words = {x.text for x in tokens[max(0, i - 6) : i] if x.kind == "name"}
                exported = name[:1].isupper() if language == "go" else not words & {"private", "fileprivate", "internal"} if public is None else public in words or (language == "swift" and "open" in words)
                markers = [x.text for x in tokens[max(0, i - 8) : i] if x.text.startswith("@")]
                trait = owners[-1][3] if owner and owners and len(owners[-1]) > 3 else None
                facts.declare(name, "method" if owner and keywords[t.text] == "function" else keywords[t.text], t.line, tokens[span[1]].line if span else t.line, exported, member_of=owner, markers=markers, implements=trait, implicitly_invoked=trait is not None or "override" in words, visibility={"private": 0, "fileprivate": 0, "protected": 1}.get(next(iter(words & {"private", "fileprivate", "protected"}), ""), 2 if exported else 1))
                if name == "main" and keywords[t.text] == "function":
                    facts.roots.append({"kind": "production", "name": "main", "confidence": 2})
                if span and keywords[t.text] == "function":
                    shape(facts, f"{owner}.{name}" if owner else name, tokens, *span, reserved)
                elif span and keywords[t.text] not in ("module",):
                    owners.append((name, span[1], depth + 1, None))
                skip.add(j)
        elif language == "java" and owners and depth == owners[-1][2] and t.kind == "name" and at(i + 1) == "(" and t.text not in reserved and (tokens[i - 1].kind == "name" or at(i - 1) in (">", "]")) and at(i - 1) not in ("new", "return", "throw"):
            span = body_of(tokens, i + 1)
            words = {x.text for x in tokens[max(0, i - 5) : i]}
            markers = [x.text for x in tokens[max(0, i - 8) : i] if x.text.startswith("@")]
            facts.declare(t.text, "constructor" if t.text == owners[-1][0] else "method", t.line, tokens[span[1]].line if span else t.line, "public" in words, member_of=owners[-1][0], markers=markers, implicitly_invoked="@Override" in markers)
            if t.text == "main":
                facts.roots.append({"kind": "production", "name": "main", "confidence": 2})
            if span:
                shape(facts, f"{owners[-1][0]}.{t.text}", tokens, *span, reserved)
            skip.add(i)
        i += 1
    references(facts, tokens, skip, reserved)
    types_of(facts, tokens, language)


def stylesheet(text: str, facts: Facts) -> None:
    plain = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    line = lambda m: plain.count("\n", 0, m.start()) + 1
    for m in re.finditer(r"@(?:import|use|forward)\s+(?:url\()?[\"']([^\"']+)[\"']", plain):
        facts.bring(m[1], line(m))
    for m in re.finditer(r"(?m)(--[\w-]+|\$[\w-]+)\s*:|@(mixin|function)\s+([\w-]+)", plain):
        facts.declare(m[1] or m[3], "variable" if m[1] else m[2], line(m), line(m), True)
    for m in re.finditer(r"var\((--[\w-]+)|@include\s+([\w-]+)", plain):
        facts.references.append({"name": m[1] or m[2], "qualifier": None, "kind": "read" if m[1] else "call", "line": line(m)})


def markup(text: str, facts: Facts) -> None:
    for m in re.finditer(r"""<(?:script|link|img|a|source|iframe)\b[^>]*?\b(?:src|href)\s*=\s*["']([^"'#?]+)""", text, re.I):
        if not re.match(r"[a-z]+:|//", m[1]):
            facts.bring(m[1] if m[1].startswith((".", "/")) else "./" + m[1], text.count("\n", 0, m.start()) + 1)
    facts.roots.append({"kind": "production", "name": None, "confidence": 2})


def data(text: str, facts: Facts) -> None:
    try:
        json.loads(text)
    except ValueError as error:
        facts.diagnostics.append(f"not valid: {error}"[:200])


def extract(path: str, content: bytes) -> Facts | None:
    """Facts of one file; None for a language that isn't known."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if not language:
        return None
    facts, text = Facts(), (content or b"").decode("utf-8", "replace")
    try:
        if language == "js":
            javascript(text, facts)
        elif language in RULES:
            braces(language, text, facts)
        else:
            {"css": stylesheet, "html": markup, "json": data}[language](text, facts)
    except (IndexError, ValueError) as error:
        facts.diagnostics.append(f"stopped: {error}"[:200])
    return facts


def facts_of(files: DataFrame) -> DataFrame:
    """(path, content_hash, language, facts) of the files whose language is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, digest, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (facts := extract(path, content)) is not None:
                    out.append((path, digest, LANGUAGES[path.rsplit(".", 1)[-1].lower()], json.dumps(facts.__dict__)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "content_hash", "language", "facts"])

    rows = files.select("path", "content_hash", "content").mapInArrow(run, "path string, content_hash string, language string, facts string")
    return rows.withColumn("facts", F.from_json("facts", FACTS.replace("\n", "")))
