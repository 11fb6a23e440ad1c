"""Entities, methods, calls and imports of source files, a file at a time.

No grammar is at hand, so a file is read in two steps: comments and strings are
blanked out (places and lines stay), then declarations are found by pattern and
their bodies by matching braces.  Python files go through Python's own parser.

What is an entity, by language: classes are Python, JavaScript, TypeScript, Java,
C++, C# and Swift classes (Swift's structs, enums and extensions too), Rust structs
and Go type declarations (named by the underlying type, as in ``type T struct``);
functions are those outside classes.  Methods belong to their class: Rust's impl
blocks and Go's receivers find it by name, or make one.  Python's methods are
functions as well.  Verilog has modules and functions.  Other files are one entity.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

BRACED = ("rust", "javascript", "typescript", "tsx", "go", "java", "cpp", "c_sharp", "swift")


@dataclass
class Method:
    name: str
    visibility: str | None
    signature: str
    start_line: int
    end_line: int


@dataclass
class Entity:
    kind: str
    name: str
    parent: str | None
    signature: str
    start_line: int
    end_line: int
    doc: str | None = None
    calls: list[str] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)


#: (module, symbol, alias, line): ``module`` with dots, ``symbol`` where one is named
Import = tuple[str, str | None, str | None, int]

_STRINGS = {
    "rust": r'b?r(#*)"(?:.|\n)*?"\1|b?"(?:\\(?:.|\n)|[^"\\])*"|b?\'(?:\\[^\n]{1,10}?|[^\'\\\n])\'',
    "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\[^\n]{1,10}?|[^\'\\\n])\'',
    "javascript": r'"(?:\\(?:.|\n)|[^"\\\n])*"|\'(?:\\(?:.|\n)|[^\'\\\n])*\'|`(?:\\(?:.|\n)|[^`\\])*`|(?<=[(,=:\[!&|?{};])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/',
    "java": r'"""(?:\\.|(?!""")(?:.|\n))*"""|"(?:\\.|[^"\\\n])*"|\'(?:\\[^\n]{1,10}?|[^\'\\\n])\'',
    "cpp": r'R"([^(\s]*)\((?:.|\n)*?\)\1"|"(?:\\(?:.|\n)|[^"\\\n])*"|\'(?:\\[^\n]{1,10}?|[^\'\\\n])\'',
    "c_sharp": r'\$?@\$?"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\[^\n]{1,10}?|[^\'\\\n])\'',
    "swift": r'"""(?:\\.|(?!""")(?:.|\n))*"""|#"(?:.|\n)*?"#|"(?:\\.|[^"\\\n])*"',
    "verilog": r'"(?:\\.|[^"\\\n])*"',
}
_STRINGS["typescript"] = _STRINGS["tsx"] = _STRINGS["javascript"]
_MASKS = {lang: re.compile(r"//[^\n]*|/\*(?:(?!\*/)(?:.|\n))*(?:\*/|\Z)|" + s) for lang, s in _STRINGS.items()}
_NOT_LINE_END = re.compile(r"[^\n]")


def masked(source: str, lang: str) -> str:
    """The source with comments and strings blanked out, place by place."""
    if lang == "rust":  # block comments nest
        source = _nested(source)
    return _MASKS[lang].sub(lambda m: _NOT_LINE_END.sub(" ", m[0]), source)


def _nested(source: str) -> str:
    out, at = [], 0
    token = re.compile(r"//[^\n]*|/\*|" + _STRINGS["rust"])
    while m := token.search(source, at):
        if m[0] != "/*":
            out.append(source[at : m.end()])
            at = m.end()
            continue
        depth, end = 1, m.end()
        for e in re.finditer(r"/\*|\*/", source[m.end() :]):
            depth += 1 if e[0] == "/*" else -1
            if not depth:
                end = m.end() + e.end()
                break
        else:
            end = len(source)
        out += [source[at : m.start()], _NOT_LINE_END.sub(" ", source[m.start() : end])]
        at = end
    return "".join([*out, source[at:]])


class File:
    """A masked source with its lines and the ends of its blocks."""

    def __init__(self, source: str, lang: str) -> None:
        self.raw, self.lang, self.text = source, lang, masked(source, lang)
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.close: dict[int, int] = {}
        open_at: list[int] = []
        for m in re.finditer(r"[{}]", self.text):
            if m[0] == "{":
                open_at.append(m.start())
            elif open_at:
                self.close[open_at.pop()] = m.start()

    def line(self, at: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, at) - 1

    def body(self, at: int) -> tuple[int, int] | None:
        """Of what is declared at ``at``: its block, unless a ';' comes first."""
        depth = 0
        for m in re.compile(r"[(){};\[\]]").finditer(self.text, at):
            c = m[0]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif depth <= 0:
                if c == "{":
                    return m.start(), self.close.get(m.start(), len(self.text))
                return None
        return None

    def signature(self, start: int, end: int) -> str:
        """Up to the block, else the first line."""
        text = self.raw[start:end]
        cut = self.text.find("{", start, end)
        return self.raw[start:cut].rstrip() if cut >= 0 else text.split("\n", 1)[0].rstrip().removesuffix(";")

    def doc(self, at: int) -> str | None:
        """The comment that ends on the line above, its marks taken off."""
        lines = self.raw[: self.starts[self.line(at)]].split("\n")[:-1]
        out: list[str] = []
        while lines and (t := lines[-1].strip()):
            if t.startswith(("@", "#[")):  # annotations lie between
                lines.pop()
            elif t.startswith(("//", "*", "/*")) or t.endswith("*/"):
                block = t.endswith("*/") and not t.startswith("/*")
                while True:
                    t = lines.pop().strip()
                    said = re.sub(r"^(?:/{2,}!?|/\*+|\*+(?!/))\s?|\s*\*+/$", "", t).strip().strip("/*").strip()
                    if said:
                        out.append(said)
                    if not block or t.startswith("/*") or not lines:
                        break
            else:
                break
        if not out and self.lang == "go" and (m := re.search(r"(?m)((?:^//[^\n]*\n)+)package ", self.raw)):
            return "\n".join(x.lstrip("/").strip() for x in m[1].splitlines())
        return "\n".join(reversed(out)) or None

    def calls(self, start: int, end: int) -> list[str]:
        found = set()
        for m in _CALL.finditer(self.text, start, end):
            name = re.sub(r"\s+", "", m[1])
            if name not in _NO_CALL and not _DECLARES.search(self.text[max(0, m.start() - 12) : m.start()]):
                found.add(name)
        return sorted(found)


_NAME = r"[^\W\d]\w*"
_CALL = re.compile(rf"(?<![\w.:>#@])((?:{_NAME}\s*(?:\?\.|\.|::|->)\s*)*{_NAME})(?:::<[^>(){{}}]*>|<[\w\s,.<>\[\]?*&]*>)?\s*\(")
_NO_CALL = set("if for while switch match return catch fn func function class struct in and or not sizeof typeof await new loop else do try with using lock foreach guard where defer go select case assert throw super this self import require".split()) - {"super", "require"}
_DECLARES = re.compile(r"\b(?:fn|func|function|new)\s+$")

_CLASSES = {
    "rust": rf"\bstruct\s+(?P<name>{_NAME})",
    "javascript": rf"\bclass\s+(?P<name>{_NAME})",
    "java": rf"\bclass\s+(?P<name>{_NAME})",
    "cpp": rf"(?<!enum )\bclass\s+(?:[A-Z_]+\s+)?(?P<name>{_NAME})(?=[^;(){{}}]*\{{)",
    "c_sharp": rf"\bclass\s+(?P<name>{_NAME})",
    "swift": rf"\b(?:class|struct|enum|extension|actor)\s+(?!func\b|var\b|let\b)(?P<name>{_NAME}(?:\.{_NAME})*)",
}
_CLASSES["typescript"] = _CLASSES["tsx"] = _CLASSES["javascript"]
_TYPES = r"(?:[\w<>\[\],.?*&:\s]+[\s*&>\]?])"
_MODIFIERS = {
    "rust": r"(?:pub(?:\([^)]*\))?\s+|const\s+|async\s+|unsafe\s+|extern\s+)*",
    "java": r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed)\s+)*",
    "c_sharp": r"(?:(?:public|private|protected|internal|static|abstract|sealed|partial)\s+)*",
    "swift": r"(?:(?:public|private|fileprivate|internal|open|final)\s+)*",
    "javascript": r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?",
    "cpp": "",
}
_MODIFIERS["typescript"] = _MODIFIERS["tsx"] = _MODIFIERS["javascript"]
_FUNCTIONS = {
    "rust": rf"{_MODIFIERS['rust']}\bfn\s+(?P<name>{_NAME})",
    "javascript": rf"(?:async\s+)?\bfunction\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^>]*>)?\s*\(",
    "swift": rf"(?:(?:public|private|fileprivate|internal|open|final|static|class|override|mutating|@\w+)\s+)*\bfunc\s+(?P<name>{_NAME})",
    "java": rf"(?<![\w.])(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>]*>\s*)?(?!(?:return|new|else|throw|case|assert|public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|default|synchronized|native|partial|extern|unsafe|readonly)\b){_NAME}(?:\.{_NAME})*(?:<[^(){{}};]*>)?(?:\[\])*\s+(?P<name>{_NAME})\s*\([^(){{}};]*\)\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])",
    "cpp": rf"(?<![\w.>])(?:(?:static|inline|virtual|explicit|constexpr|extern|friend)\s+)*(?:(?!return\b|new\b|else\b|throw\b|delete\b){_NAME}(?:::{_NAME})*(?:<[^(){{}};]*>)?[\s*&]+)*(?P<name>(?:{_NAME}::)*~?{_NAME})\s*\((?:[^(){{}};]|\([^()]*\))*\)\s*(?:const|noexcept|override|final|->\s*[\w:<>*&\s]+|\s)*(?::[^{{;]*)?(?=\{{)",
}
_FUNCTIONS["c_sharp"] = rf"(?<![\w.])(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|extern|partial|unsafe|new|readonly)\s+)*(?!(?:return|new|else|throw|case|await|public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|default|synchronized|native|partial|extern|unsafe|readonly)\b){_NAME}(?:\.{_NAME})*(?:<[^(){{}};]*>)?(?:\[\])*\??\s+(?P<name>{_NAME})\s*(?:<[^(){{}};]*>)?\s*\([^(){{}};]*\)\s*(?:where[^{{;]*)?(?=\{{|;|=>)"
_FUNCTIONS["typescript"] = _FUNCTIONS["tsx"] = _FUNCTIONS["javascript"]
_JS_METHOD = re.compile(rf"(?<=[{{}};\n])[ \t]*(?P<mods>(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract|\*)\s+|\*)*)(?P<name>#?{_NAME})\s*(?:<[^>(){{}}]*>)?\s*\((?:[^(){{}}]|\([^()]*\))*\)\s*(?::[^{{;]*)?(?=\{{)")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "else", "do", "function", "constructor_"}


def _inside(spans: list[tuple[int, int]], at: int) -> bool:
    return any(s < at < e for s, e in spans)


def _visibility(snippet: str, name: str, before: str | None) -> str | None:
    """'pub ' makes public, '_' private; where classes and functions are declared by
    a word of their own, the nearest private or protected before it, else public."""
    if "pub " in snippet:
        return "public"
    if name.startswith(("_", "#")):
        return "private"
    if before is None:
        return None
    return "private" if "private " in before else "protected" if "protected " in before else "public"


def _braced(f: File) -> list[Entity]:
    lang, out, classes = f.lang, [], []
    find_class = re.compile(_MODIFIERS[lang] + _CLASSES[lang])
    find_function = re.compile(_FUNCTIONS[lang])
    for m in find_class.finditer(f.text):
        block = f.body(m.end())
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end = block[1] + 1 if block else (f.text.find(";", m.end()) + 1 or len(f.text))
        if lang in ("javascript", "typescript", "tsx", "java", "cpp", "c_sharp", "swift") and not block:
            continue
        e = Entity("class", m["name"], None, f.signature(start, end), f.line(start), f.line(max(start, end - 1)), f.doc(start))
        classes.append((e, block or (start, start)))
        out.append((start, e))
    for e, (s, _) in classes:
        around = [(t, c.name) for c, (t, u) in classes if t < s < u]
        e.parent = max(around)[1] if around else None
    impls = _impls(f, out) if lang == "rust" else []
    functions = []
    for m in find_function.finditer(f.text):
        if m["name"].split("::")[-1] in _KEYWORDS or m["name"] in _NO_CALL:
            continue
        block = f.body(m.end())
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end = block[1] + 1 if block else (f.text.find(";", m.end()) + 1 or len(f.text))
        functions.append((start, end, m["name"], block))
    if lang in ("javascript", "typescript", "tsx"):
        for c, (s, e) in classes:
            for m in _JS_METHOD.finditer(f.text, s, e):
                if m["name"] not in _KEYWORDS and f.text.count("{", s + 1, m.start()) == f.text.count("}", s + 1, m.start()):
                    start = m.start() + len(m[0]) - len(m[0].lstrip())
                    block = f.body(m.end())
                    if block:
                        functions.append((start, block[1] + 1, m["name"], block))
    functions = sorted(set(functions))
    bodies = [b for *_, b in functions if b]
    for start, end, name, block in functions:
        snippet, simple = f.raw[start:end], name.split("::")[-1].lstrip("~")
        owner = next((e for (s, u), e in impls if s < start < u), None)
        own = [(s, c) for c, (s, u) in classes if s < start < u]
        if owner is None and own:
            s, owner = max(own, key=lambda x: x[0])
            if any(s < b[0] < start < b[1] for b in bodies):
                continue  # a function in a method
            before = f.raw[s:start] if lang in ("javascript", "typescript", "tsx", "swift") else None
            if before is not None:
                head = f.raw[f.starts[f.line(start)] : start + len(f.signature(start, end))]
                before = head if re.search(r"\b(?:private|protected|public)\b", head) else ""
            visibility = _visibility(snippet, simple, before)
        else:
            visibility = _visibility(snippet, "", None)
        signature = f.signature(start, end)
        if owner is not None:
            owner.methods.append(Method(simple, visibility, signature, f.line(start), f.line(end - 1)))
        else:
            calls = f.calls(block[0], block[1]) if block else []
            out.append((start, Entity("function", simple, None, signature, f.line(start), f.line(max(start, end - 1)), f.doc(start), calls)))
    return [e for _, e in sorted(out, key=lambda x: x[0])]


def _impls(f: File, out: list) -> list[tuple[tuple[int, int], Entity]]:
    """Impl blocks, with the class whose methods they hold."""
    found = []
    for m in re.finditer(r"\bimpl\b\s*", f.text):
        block = f.body(m.end())
        if not block:
            continue
        head = f.text[m.end() : block[0]].split(" where ")[0]
        if head.startswith("<"):
            depth = 0
            for i, c in enumerate(head):
                depth += (c == "<") - (c == ">" and head[i - 1] != "-")
                if not depth:
                    head = head[i + 1 :]
                    break
        whole = re.split(r"\bfor\b", head)[-1].strip()
        name = re.match(r"&?\s*(?:mut\s+|dyn\s+)?(?:\w+::)*(\w+)", whole)
        name = name[1] if name else whole
        owner = next((e for _, e in out if e.kind == "class" and e.name == name), None)
        if owner is None:
            if "fn " not in f.text[block[0] : block[1]]:
                continue
            owner = Entity("class", name, None, f"impl {name}", f.line(m.start()), f.line(block[1]))
            out.append((m.start(), owner))
        found.append((block, owner))
    return found


def _go(f: File) -> list[Entity]:
    out: list[tuple[int, Entity]] = []
    types: dict[str, Entity] = {}
    for m in re.finditer(rf"(?m)^type\s+(?:(?P<name>{_NAME})|\()", f.text):
        block = f.body(m.end()) if m["name"] and "\n" not in f.text[m.end() : (f.body(m.end()) or (m.end(), 0))[0]] else None
        if not m["name"]:  # a group in parentheses
            end = f.text.find("\n)", m.end()) + 2
        else:
            end = block[1] + 1 if block else (f.text + "\n").find("\n", m.end())
        signature = f.signature(m.start(), end)
        e = Entity("class", signature.split()[-1], None, signature, f.line(m.start()), f.line(end - 1), f.doc(m.start()))
        out.append((m.start(), e))
        for n in [m["name"]] if m["name"] else re.findall(rf"(?m)^\s*({_NAME})\s+[\w*\[\]]", f.text[m.end() : end]):
            types[n] = e
    for m in re.finditer(rf"(?m)^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>{_NAME})", f.text):
        block = f.body(m.end())
        end = block[1] + 1 if block else (f.text + "\n").find("\n", m.end())
        signature = f.signature(m.start(), end)
        if m["recv"] and m["recv"].split():
            owner = re.sub(r"\[.*", "", m["recv"].split()[-1].lstrip("*"))
            if owner not in types:
                types[owner] = Entity("class", owner, None, f"type {owner} struct", f.line(m.start()), f.line(end - 1))
                out.append((m.start(), types[owner]))
            types[owner].methods.append(Method(m["name"], "public" if m["name"][0].isupper() else None, signature, f.line(m.start()), f.line(end - 1)))
        else:
            calls = f.calls(block[0], block[1]) if block else []
            out.append((m.start(), Entity("function", m["name"], None, signature, f.line(m.start()), f.line(end - 1), f.doc(m.start()), calls)))
    return [e for _, e in sorted(out, key=lambda x: x[0])]


def _verilog(f: File) -> list[Entity]:
    out = []
    modules = [(m.start(), m.end(), m[1]) for m in re.finditer(rf"\bmodule\s+({_NAME})(?:(?!\bendmodule\b)(?:.|\n))*\bendmodule\b", f.text)]
    for s, e, name in modules:
        out.append((s, Entity("class", name, None, f.raw[s:e].split(";")[0].split("\n")[0].rstrip(), f.line(s), f.line(e), f.doc(s))))
    for m in re.finditer(rf"\bfunction\s+(?:automatic\s+)?(?:\[[^\]]*\]\s*)?(?:\w+\s+(?=\w))?({_NAME})(?:(?!\bendfunction\b)(?:.|\n))*\bendfunction\b", f.text):
        own = next((x for (s, e, _), (_, x) in zip(modules, out) if s < m.start() < e), None)
        signature = m[0].split("\n")[0].rstrip().removesuffix(";")
        if own is not None:
            own.methods.append(Method(m[1], None, signature, f.line(m.start()), f.line(m.end())))
        else:
            out.append((m.start(), Entity("function", m[1], None, signature, f.line(m.start()), f.line(m.end()), f.doc(m.start()), f.calls(m.start(), m.end()))))
    return [e for _, e in sorted(out, key=lambda x: x[0])]


def _python(source: str) -> list[Entity]:
    tree = ast.parse(source)
    lines, out = source.split("\n"), []

    def above(n: int) -> str | None:
        said = []
        while n > 0 and lines[n - 1].strip().startswith("#"):
            n -= 1
            said.append(lines[n].strip().lstrip("#").strip())
        return "\n".join(reversed(said)) or None

    def called(node) -> list[str]:
        return sorted({ast.unparse(c.func) for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))})

    def visit(body, parent: str | None, owner: Entity | None) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start, end, said = n.lineno - 1, (n.end_lineno or n.lineno) - 1, lines[n.lineno - 1].strip()
                out.append(Entity("function", n.name, parent, said, start, end, ast.get_docstring(n) or above(start), called(n)))
                if owner is not None:
                    owner.methods.append(Method(n.name, "private" if n.name.startswith("_") else None, said, start, end))
                visit(n.body, parent, None)
            elif isinstance(n, ast.ClassDef):
                start = n.lineno - 1
                c = Entity("class", n.name, parent, lines[start].strip(), start, (n.end_lineno or n.lineno) - 1, ast.get_docstring(n) or above(start))
                out.append(c)
                visit(n.body, n.name, c)
            else:
                for block in ("body", "orelse", "finalbody"):
                    visit(getattr(n, block, ()) or (), parent, owner)
                for h in getattr(n, "handlers", ()) or ():
                    visit(h.body, parent, owner)

    visit(tree.body, None, None)
    return out


def entities(source: str, lang: str) -> list[Entity] | None:
    """Entities in order of place; None where the language has none."""
    try:
        if lang == "python":
            return _python(source)
        if lang == "go":
            return _go(File(source, lang))
        if lang == "verilog":
            return _verilog(File(source, lang))
        if lang in BRACED:
            return _braced(File(source, lang))
    except (SyntaxError, ValueError, RecursionError):
        return []
    return None


# imports


def base_name(module: str) -> str:
    """Last part of a path, up to its first dot."""
    return module.rsplit("/", 1)[-1].split(".", 1)[0]


def _python_imports(source: str) -> list[Import]:
    out = []
    try:
        for n in ast.walk(ast.parse(source)):
            if isinstance(n, ast.Import):
                out += [(a.name, None, a.asname, n.lineno - 1) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out += [(n.module or "", a.name if a.name != "*" else None, a.asname, n.lineno - 1) for a in n.names]
    except (SyntaxError, ValueError, RecursionError):
        for i, t in enumerate(map(str.strip, source.split("\n"))):
            if m := re.match(r"from\s+\.*([\w.]*)\s+import\s+(.*)", t):
                for part in m[2].strip("() ").split(","):
                    if p := re.match(r"(\w+)(?:\s+as\s+(\w+))?", part.strip()):
                        out.append((m[1], p[1], p[2], i))
            elif m := re.match(r"import\s+(.*)", t):
                for part in m[1].split(","):
                    if p := re.match(r"([\w.]+)(?:\s+as\s+(\w+))?", part.strip()):
                        out.append((p[1], None, p[2], i))
    return sorted(out, key=lambda x: x[3])


def _lines_of(source: str, pattern: str):
    for m in re.finditer(pattern, source):
        yield m, source.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip()))


def _js_imports(source: str) -> list[Import]:
    out: list[Import] = []

    def named(inner: str, module: str, line: int) -> None:
        for part in inner.split(","):
            if p := re.match(r"(?:type\s+)?([\w$]+)(?:\s*(?::|\bas\b)\s*([\w$]+))?", part.strip()):
                out.append((module, p[1], p[2], line))

    for m, line in _lines_of(source, r"""(?m)^[ \t]*import\s+(?:type\s+)?(?:(?P<what>[^'";]*?)\s*\bfrom\s*)?["'](?P<module>[^"']+)["']"""):
        module, what = base_name(m["module"]), (m["what"] or "").strip()
        if not what:
            out.append((module, None, None, line))
        for p in re.finditer(r"\{(?P<inner>[^}]*)\}|\*\s*as\s+(?P<star>[\w$]+)|(?P<own>[\w$]+)", what):
            if p["inner"] is not None:
                named(p["inner"], module, line)
            else:
                out.append((module, None, p["star"] or p["own"], line))
    for m, line in _lines_of(source, r"""(?m)(?:\b(?:const|let|var)\s+(?:\{(?P<inner>[^}]*)\}|(?P<own>[\w$]+))\s*=\s*(?:await\s+)?)?(?:\brequire|\bimport)\(\s*["'](?P<module>[^"']+)["']"""):
        module = base_name(m["module"])
        if m["inner"] is not None:
            named(m["inner"], module, line)
        else:
            out.append((module, None, m["own"], line))
    for m, line in _lines_of(source, r"""(?m)^[ \t]*export\s+[^'";=]*?\bfrom\s*["'](?P<module>[^"']+)["']"""):
        out.append((base_name(m["module"]), None, None, line))
    return sorted(out, key=lambda x: x[3])


def _rust_uses(tree: str, base: list[str]) -> list[tuple[list[str], str | None]]:
    """(path, alias) of the leaves of a use tree."""
    tree = tree.strip()
    if not tree:
        return []
    if "{" in tree:
        head, inner = tree.split("{", 1)
        inner = inner.rsplit("}", 1)[0]
        base = base + [x for x in head.strip().removesuffix("::").split("::") if x]
        out, depth, part = [], 0, ""
        for c in inner + ",":
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                out += _rust_uses(part, base)
                part = ""
            else:
                part += c
        return out
    path, _, alias = (x.strip() for x in tree.partition(" as "))
    parts = base + [x.strip() for x in path.split("::") if x.strip()]
    return [([x for x in parts if x != "self"] if len(parts) > 1 else parts, alias or None)]


def _rust_imports(source: str) -> list[Import]:
    text, out = masked(source, "rust"), []
    for m, line in _lines_of(text, r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+(?P<tree>[^;]+);|mod\s+(?P<mod>\w+)\s*[;{])"):
        if m["mod"]:
            out.append((m["mod"], None, None, line))
            continue
        for parts, alias in _rust_uses(m["tree"], []):
            while parts and parts[0] in ("crate", "super", "self"):
                parts = parts[1:]
            if parts and parts[-1] == "*":
                parts, alias = parts[:-1], None
                if parts:
                    out.append((".".join(parts), None, None, line))
            elif len(parts) > 1:
                out.append((".".join(parts[:-1]), parts[-1], alias, line))
            elif parts:
                out.append((parts[0], None, alias, line))
    return out


def _go_imports(source: str) -> list[Import]:
    out = []
    spec = re.compile(r"""(?m)^[ \t]*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?["`](?P<module>[^"`]+)["`]""")
    for m, line in _lines_of(source, r"""(?m)^import\s+(?:\((?P<many>[^)]*)\)|[^\n]*)"""):
        for s in spec.finditer(m[0] if not m["many"] else m["many"]):
            at = line + (m[0].count("\n", 0, m.start("many") - m.start() + s.start() + len(s[0]) - len(s[0].lstrip())) if m["many"] else 0)
            alias = s["alias"] if s["alias"] not in ("_", ".", "import") else None
            out.append((base_name(s["module"]), None, alias, at))
    return out


def _line_imports(pattern: str, made: Callable) -> Callable:
    find = re.compile(pattern)

    def run(source: str) -> list[Import]:
        return [(*made(m), i) for i, t in enumerate(source.split("\n")) if (m := find.match(t.strip()))]

    return run


def _java(m) -> tuple:
    path = m[1]
    if path.endswith(".*"):
        return path[:-2], None, None
    module, _, name = path.rpartition(".")
    return module or name, name if module else None, None


_IMPORTS: dict[str, Callable[[str], list[Import]]] = {
    "python": _python_imports,
    "javascript": _js_imports,
    "typescript": _js_imports,
    "tsx": _js_imports,
    "rust": _rust_imports,
    "go": _go_imports,
    "java": _line_imports(r"import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", _java),
    "cpp": _line_imports(r"#\s*include\s*\"([^\"]+)\"", lambda m: (base_name(m[1]), None, None)),
    "c": _line_imports(r"#\s*include\s*\"([^\"]+)\"", lambda m: (base_name(m[1]), None, None)),
    "c_sharp": _line_imports(r"(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", lambda m: (m[2], None, m[1])),
    "swift": _line_imports(r"(?:@testable\s+)?import\s+(?:(?:class|struct|func|enum|protocol)\s+)?([\w.]+)", lambda m: (m[1], None, None)),
}


def imports(source: str, lang: str) -> list[Import]:
    """What a file imports: (module with dots, symbol, alias, line from 0)."""
    return _IMPORTS.get(lang, lambda s: [])(source)
