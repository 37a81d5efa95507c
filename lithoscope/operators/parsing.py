"""Files to symbols, imports and calls.

Python is parsed with the standard library's `ast`; other languages, and Python that
does not compile, by a scanner of tokens and braces.  Both run on the executors, a
batch of files at a time, and give one row per file with nested symbols."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

SYMBOL = (
    "sym_seq:int,kind:string,name:string,start_line:int,end_line:int,decorators:array<string>,calls:array<string>,complexity:int,"
    "max_nesting_depth:int,max_loop_nesting:int,parent_class:string,base_classes:array<string>"
)
PARSED = f"job_id string, file_seq long, path string, language string, size_bytes long, loc int, source string, parse_error string, imports array<string>, symbols array<struct<{SYMBOL}>>"
MAX_CALLS = 200
ANONYMOUS = "<anonymous>"


def _symbol(kind, name, start, end, decorators=(), calls=(), complexity=1, nesting=0, loops=0, parent=None, bases=()):
    return {"kind": kind, "name": name, "start_line": start, "end_line": end, "decorators": list(decorators), "calls": list(calls)[:MAX_CALLS], "complexity": complexity, "max_nesting_depth": nesting, "max_loop_nesting": loops, "parent_class": parent, "base_classes": list(bases)}


# --- Python ------------------------------------------------------------------

_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.With, ast.AsyncWith)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)


def _children(node: ast.AST):
    """(child, whether it is the `elif` of node)."""
    tail = node.orelse[0] if isinstance(node, ast.If) and len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and node.orelse[0].col_offset == node.col_offset else None
    for c in ast.iter_child_nodes(node):
        yield c, c is tail


def _measure(root: ast.AST) -> tuple[int, int, int]:
    """Branches, depth of branches, depth of loops: an `elif` stands one level below
    the first `if` of its chain, however long the chain is."""
    count, deep, loops = 0, 0, 0
    stack = [(c, 0, 0, None) for c in ast.iter_child_nodes(root)]
    while stack:
        n, depth, loop, chain = stack.pop()
        own = depth
        if isinstance(n, _BRANCH):
            count += 1
            own = (chain if chain is not None else depth) + 1
        elif isinstance(n, ast.BoolOp):
            count += len(n.values) - 1
            own = depth + len(n.values) - 1
        loop += isinstance(n, _LOOPS)
        deep, loops = max(deep, own), max(loops, loop)
        head = chain if chain is not None else own
        for c, is_elif in _children(n):
            stack.append((c, own, loop, head if is_elif else None))
    return count, deep, loops


def _dotted(n: ast.AST) -> list[str]:
    """The identifiers of an expression, in order."""
    return [x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else x.arg for x in sorted((x for x in ast.walk(n) if isinstance(x, (ast.Name, ast.Attribute)) or isinstance(x, ast.keyword) and x.arg), key=lambda x: (x.end_lineno, x.end_col_offset) if not isinstance(x, ast.keyword) else (x.lineno, x.col_offset))]


def _python(source: str, lines: list[str]):
    tree = ast.parse(source)
    imports, symbols = [], []
    segment = lambda n: ast.get_source_segment(source, n) or ""

    def end_of(n) -> int:
        """Comments that follow, indented deeper than the statement, belong to it."""
        end, at = n.end_lineno, n.end_lineno
        while at < len(lines):
            line = lines[at]
            if line.strip():
                if not line.lstrip().startswith("#") or len(line) - len(line.lstrip()) <= n.col_offset:
                    break
                end = at + 1
            at += 1
        return end

    def walk(n, parent):
        if isinstance(n, ast.Import):
            imports.append(n.names[0].name)
        elif isinstance(n, ast.ImportFrom):
            imports.append(n.module or n.names[0].name)
        elif isinstance(n, ast.ClassDef):
            bases = [x for b in [*n.bases, *n.keywords] for x in ([b.arg] if isinstance(b, ast.keyword) and b.arg else []) + _dotted(b.value if isinstance(b, ast.keyword) else b)]
            symbols.append(_symbol("class", n.name, n.lineno, end_of(n), ["@" + segment(d) for d in n.decorator_list], parent=parent, bases=bases))
            for c in ast.iter_child_nodes(n):
                walk(c, n.name)
            return
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            body = ast.Module(body=[n], type_ignores=[])
            calls = [segment(c.func) for c in sorted((c for x in [n.args, *n.body, *([n.returns] if n.returns else [])] for c in ast.walk(x) if isinstance(c, ast.Call)), key=lambda c: (c.lineno, c.col_offset, -c.end_lineno, -c.end_col_offset))]
            own = ast.Module(body=n.body, type_ignores=[])
            own._fields = ("body",)
            count, deep, loops = _measure(own)
            del body
            symbols.append(_symbol("method" if parent else "function", n.name, n.lineno, end_of(n), ["@" + segment(d) for d in n.decorator_list], calls, 1 + count, deep, loops, parent))
            for c in ast.walk(own):  # imports within functions count too
                if isinstance(c, ast.Import):
                    imports.append(c.names[0].name)
                elif isinstance(c, ast.ImportFrom):
                    imports.append(c.module or c.names[0].name)
            return
        for c in ast.iter_child_nodes(n):
            walk(c, parent)

    walk(tree, None)
    return imports, symbols


# --- languages with braces ---------------------------------------------------

#: What a family's comments, strings and numbers look like; the first that fits counts.
_SLASHES, _QUOTED, _CHAR = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.[^'\n]*|[^'\\\n])'"
_LEXICON = {
    "javascript": (_SLASHES, _QUOTED + r"|'(?:\\.|[^'\\\n])*'", r"\d[\w.]*"),
    "java": (_SLASHES, r'"""(?:\\.|.)*?"""|' + _QUOTED + "|" + _CHAR, r"\d[\w.]*"),
    "go": (_SLASHES, _QUOTED + "|" + _CHAR + r"|`[^`]*`", r"\d[\w.]*"),
    "rust": (_SLASHES, r'b?r(?P<hashes>#*)".*?"(?P=hashes)|b?"(?:\\.|[^"\\])*"|b?' + _CHAR + r"|'[A-Za-z_]\w*", r"\d(?:\w|\.(?=\d))*"),
    "php": (_SLASHES + r"|\#(?!\[)[^\n]*|\?>.*?(?:<\?(?:php\b|=)?|\Z)|\A(?:(?!<\?).)*(?:<\?(?:php\b|=)?|\Z)", r"<<<\s*[\"']?(?P<here>\w+)[\"']?\n.*?^[ \t]*(?P=here)\b|" + r'"(?:\\.|[^"\\])*"' + r"|'(?:\\.|[^'\\])*'", r"\d[\w.]*"),
    "csharp": (_SLASHES + r"|^[ \t]*\#[^\n]*", r'\$*(?P<raw>"{3,}).*?(?P=raw)|(?:\$@|@\$?)"(?:""|[^"])*"|\$?' + _QUOTED + "|" + _CHAR, r"\d[\w.]*"),
    "c": (_SLASHES + r"|^[ \t]*\#(?![ \t]*include\b)(?:\\\n|[^\n])*", r'(?:u8|[uUL])?R"(?P<raw>[^()\\\s]*)\(.*?\)(?P=raw)"|(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"' + r"|[uUL]?'(?:\\.|[^'\\\n])+'", r"\d(?:[\w.]|'(?=\w))*"),
}
_LEXICON["cpp"] = _LEXICON["c"]
_TOKENS = {
    family: re.compile(rf"(?P<comment>{comment})|(?P<include>\#[ \t]*include[ \t]*[<\"][^>\"\n]*[>\"])|(?P<string>{string})|(?P<word>{'#?' if family == 'javascript' else ''}(?:[^\W\d]|\$)[\w$]*)|(?P<number>{number})|(?P<punct>=>|->|::|&&|\|\||\?\?|\?\.|[^\s\w])", re.S | re.M)
    for family, (comment, string, number) in _LEXICON.items()
}
#: A regular expression of JavaScript, where an operand may begin.
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_OPERAND_NEXT = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "instanceof", "yield", "await"}


def _lex(family: str, source: str, at: int = 0, stop: int | None = None):
    """(kind, text, start) of each token; what stands in `${}` comes after its template."""
    stop, rx, last = len(source) if stop is None else stop, _TOKENS[family], ("punct", "(")
    while at < stop and (m := rx.search(source, at, stop)):
        kind, text, at = m.lastgroup, m[0], max(m.end(), m.start() + 1)
        if family == "javascript" and text == "`":
            at, inner = _template(source, m.start(), stop)
            yield "string", source[m.start() : at], m.start()
            for i, j in inner:
                yield from _lex(family, source, i, j)
            last = ("string", "`")
            continue
        if family == "javascript" and text == "/" and (last[0] == "punct" and last[1] not in (")", "]", "}") or last[1] in _OPERAND_NEXT):
            if r := _REGEX.match(source, m.start(), stop):
                kind, text, at = "string", r[0], r.end()
        if family == "rust" and text.startswith("/*"):  # comments nest
            depth, at = 0, m.start()
            while at < stop:
                two = source[at : at + 2]
                depth += (two == "/*") - (two == "*/")
                at += 2 if two in ("/*", "*/") else 1
                if not depth:
                    break
        if kind == "comment":
            continue
        if family == "rust" and kind == "string" and text[0] == "'" and text[-1] != "'":
            kind = "lifetime"
        yield kind, text, m.start()
        last = (kind, text)


def _template(source: str, start: int, stop: int) -> tuple[int, list[tuple[int, int]]]:
    """The end of a template literal, and where its `${}` are."""
    at, inner = start + 1, []
    while at < stop and source[at] != "`":
        if source[at] == "\\":
            at += 2
        elif source.startswith("${", at):
            began, depth = at + 2, 0
            at = began
            while at < stop and (source[at] != "}" or depth):
                if source[at] == "`":
                    at = _template(source, at, stop)[0]
                    continue
                if source[at] in "\"'" and (q := re.compile(r"(['\"])(?:\\.|(?!\1)[^\\\n])*\1").match(source, at, stop)):
                    at = q.end()
                    continue
                depth += (source[at] == "{") - (source[at] == "}")
                at += 1
            inner.append((began, at))
            at += 1
        else:
            at += 1
    return min(at + 1, stop), inner


_CLASS_WORDS = {
    "javascript": {"class"}, "typescript": {"class", "interface"}, "tsx": {"class", "interface"}, "java": {"class", "interface", "enum"}, "go": {"type"},
    "rust": {"struct", "enum", "trait", "impl"}, "php": {"class", "interface"}, "csharp": {"class", "interface", "record"}, "cpp": {"class", "struct"}, "c": {"struct"},
}
_BRANCH_WORDS = {
    "javascript": {"if", "for", "while", "case", "catch"}, "java": {"if", "for", "while", "case", "default", "catch"}, "go": {"if", "for", "case", "select"},
    "rust": {"if", "for", "while"}, "php": {"if", "for", "foreach", "while", "switch", "catch"}, "csharp": {"if", "for", "foreach", "while", "case", "catch"},
    "cpp": {"if", "for", "while", "case", "default", "catch"}, "c": {"if", "for", "while", "case", "default"},
}
_LOOP_WORDS = {"for", "foreach", "while", "loop"}
_NOT_CALLS = {"async", "if", "for", "foreach", "while", "switch", "catch", "return", "function", "func", "fn", "match", "else", "do", "typeof", "sizeof", "throw", "new", "await", "in", "of", "super", "elseif"}
_FUNCTION_WORDS = {"javascript": "function", "typescript": "function", "tsx": "function", "go": "func", "rust": "fn", "php": "function"}


class _Scan:
    def __init__(self, language: str, source: str):
        self.language, self.family = language, {"typescript": "javascript", "tsx": "javascript"}.get(language, language)
        self.source = source
        ends = [i for i, c in enumerate(source) if c == "\n"]
        self.tokens = [(k, t, bisect_left(ends, at) + 1, at) for k, t, at in _lex(self.family, source)]  # kind, text, line, start
        self.match = self._brackets()
        self.opens = {c: o for o, c in self.match.items()}
        self.imports, self.symbols = [], []
        self.class_braces, self.initialised = set(), set()

    def _brackets(self) -> dict[int, int]:
        pairs, stack, close = {}, [], {")": "(", "]": "[", "}": "{"}
        self.within = []  # the bracket that each token stands in
        for i, (k, t, _, _) in enumerate(self.tokens):
            self.within.append(stack[-1][1] if stack else -1)
            if k != "punct":
                continue
            if t in "([{":
                stack.append((t, i))
            elif t in close:
                while stack and stack[-1][0] != close[t]:
                    stack.pop()
                if stack:
                    pairs[stack.pop()[1]] = i
        return pairs

    def text(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def end(self, i: int) -> int:
        return self.match.get(i, len(self.tokens) - 1)

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "word"

    def line(self, i: int) -> int:
        """The line in which token i ends."""
        k = self.tokens[max(0, min(i, len(self.tokens) - 1))]
        return k[2] + k[1].count("\n")

    def find(self, i: int, stop: int, marks, skip: str = "([{") -> int | None:
        """The first of some tokens at this level of brackets."""
        while i < stop:
            t = self.text(i)
            if t in marks and self.tokens[i][0] != "string":
                return i
            if self.tokens[i][0] == "punct" and t in skip:
                i = self.end(i)
            elif self.tokens[i][0] == "punct" and t in (")", "]", "}"):
                return None
            i += 1
        return None

    def after_angles(self, i: int, stop: int) -> int:
        """What follows the type parameters that begin at token i."""
        depth = 0
        braces = ("{",) if self.family == "javascript" else ()  # types may have them
        while i < stop:
            t = self.text(i)
            depth += (t == "<") - (t == ">")
            if depth <= 0 or t in (";", "}", ")", "]") or t == "{" and not braces:
                return i + (t == ">")
            i = self.end(i) + 1 if t in ("(", "[", *braces) else i + 1
        return stop

    def began(self, i: int) -> int:
        """The first token of the declaration that token i names: modifiers, annotations,
        types, but neither template parameters nor access labels."""
        first = i
        while first > 0:
            p = first - 1
            t = self.text(p)
            if t in (")", "]") and p in self.opens and self.family in ("java", "csharp", "php"):
                o = self.opens[p]
                if t == ")" and not (self.word(o - 1) and self._annotated(o - 1)):
                    break
                first = o - 1 if t == ")" or self.text(o - 1) == "#" else o
                continue
            if t == "@" and self.family != "java" or self.tokens[p][0] == "punct" and t not in ("*", "&", "&&", "<", ">", "::", ",", ".", "?", "@", "[", "]", "~") or self.tokens[p][0] == "include":
                break
            if t == "," and not any(self.text(x) == "<" for x in range(self._stretch(p), p)):
                break
            first = p
        if self.family == "cpp":
            while self.text(first) == "template":
                first = self.after_angles(first + 1, i)
        return min(first, i)

    def _stretch(self, p: int) -> int:
        while p > 0 and self.text(p - 1) not in (";", "{", "}", "(", ")"):
            p -= 1
        return p

    def _annotated(self, i: int) -> bool:
        while self.text(i - 1) == "." and self.word(i - 2):
            i -= 2
        return self.text(i - 1) == "@"

    def run(self):
        self._imports()
        self._walk(0, len(self.tokens), None)
        return self.imports, self.symbols

    def _imports(self):
        word = {"javascript": "import", "java": "import", "go": "import", "rust": "use", "php": "use", "csharp": "using"}.get(self.family)
        depth = 0
        for i, (k, t, _, at) in enumerate(self.tokens):
            if k == "include":
                self.imports.append(re.sub(r'^#include\s*|[<>"]', "", t))
            if t in "{}" and k == "punct":
                depth += 1 if t == "{" else -1
            if k == "word" and t == word and depth <= (0 if self.family in ("javascript", "java", "go", "php") else 1) and self.text(i + 1) not in ("(", "."):
                stop = next((j for j in range(i + 1, len(self.tokens)) if self.text(j) == ";" or self.tokens[j][0] == "string"), None)
                if self.family == "go" and self.text(i + 1) == "(":
                    stop = next((j for j in range(i + 2, self.end(i + 1)) if self.tokens[j][0] == "string"), None)
                if stop is None:
                    continue
                if self.tokens[stop][0] == "string":
                    self.imports.append(self.text(stop).strip("\"'`<>"))
                else:
                    raw = self.source[self.tokens[i + 1][3] : self.tokens[stop][3]].strip()
                    self.imports.append(re.sub(r"^(static|function|const)\s+", "", raw))
            elif k == "word" and t == word == "import" and self.family == "go" and self.text(i + 1) == "(":
                first = next((j for j in range(i + 2, self.end(i + 1)) if self.tokens[j][0] == "string"), None)
                if first:
                    self.imports.append(self.text(first).strip('"`'))

    def _decorators(self, i: int) -> tuple[list[str], int]:
        """Annotations or attributes that end just before token i, skipping modifiers."""
        out, j = [], i - 1
        mods = {"export", "default", "public", "private", "protected", "static", "final", "abstract", "async", "sealed", "partial", "internal", "override", "virtual", "readonly", "pub", "const"}
        while j >= 0:
            if self.text(j) in mods:
                j -= 1
                continue
            opener = self.opens.get(j) if self.text(j) in (")", "]") else None
            if self.text(j) == "]" and opener is not None and self.language in ("csharp", "php"):
                s = self.tokens[opener - 1][3] if self.text(opener - 1) == "#" else self.tokens[opener][3]
                out.insert(0, self.source[s : self.tokens[j][3] + 1])
                j = opener - (2 if self.text(opener - 1) == "#" else 1)
                continue
            head = (opener - 1 if opener is not None else j) if self.text(j) != "]" else None
            if head is not None and self.tokens[head][0] == "word":
                while self.text(head - 1) == ".":
                    head -= 2
                if self.text(head - 1) == "@":
                    end = self.tokens[j]
                    out.insert(0, self.source[self.tokens[head - 1][3] : end[3] + len(end[1])])
                    j = head - 2
                    continue
            break
        return out, j + 1

    def _bases(self, i: int, brace: int) -> list[str]:
        """Identifiers after extends, implements or a colon, up to the body."""
        if self.family in ("go", "rust"):
            return []
        i = self.after_angles(i + 2, brace) if self.text(i + 2) == "<" else i
        brace = next((j for j in range(i, brace) if self.text(j) == "where" and self.family == "csharp"), brace)
        start = next((j for j in range(i, brace) if self.text(j) in ("extends", "implements") or self.text(j) == ":" and self.family in ("csharp", "cpp", "c")), None)
        skip = {"extends", "implements", "public", "private", "protected", "virtual"}
        return [] if start is None else [t for k, t, _, _ in self.tokens[start:brace] if k == "word" and t not in skip]

    def _walk(self, i: int, stop: int, parent: str | None):
        while i < stop:
            if self.tokens[i][0] in ("word", "punct"):
                after = self._class(i, stop, parent) or self._function(i, stop, parent)
                if after:
                    i = after
                    continue
            i += 1

    def _class(self, i: int, stop: int, parent: str | None) -> int | None:
        """Takes the class that begins with token i; the token after it."""
        t, family = self.text(i), self.family
        if not self.word(i) or t not in _CLASS_WORDS[self.language] or self.text(i - 1) in (".", "->", "::", "enum", "friend") or self.text(i + 1) in ("=", ":", ",", ")", "."):
            return None
        if family == "cpp" and self.text(i - 1) in ("<", ",") or family == "javascript" and self.text(i - 1) in ("=", "(", "return"):
            return None  # a type parameter; a class expression
        named = self.word(i + 1) and t != "impl" and self.text(i + 1) not in ("extends", "implements")
        name, bases = self.text(i + 1) if named else ANONYMOUS, []
        if family == "go":
            if self.text(i + 1) == "(":
                name, last = self.text(i + 2), self.end(i + 1)
            else:
                last = i + 1
                while last + 1 < stop and (self.tokens[last + 1][2] == self.line(last) or self.text(last + 1) == "{") and self.text(last + 1) != ";":
                    last = self.end(last + 1) if self.text(last + 1) in ("{", "(", "[") else last + 1
            self.symbols.append(_symbol("class", name, self.tokens[i][2], self.line(last), parent=parent))
            return last + 1
        j = self.after_angles(i + 2, stop) if named and self.text(i + 2) == "<" else i
        j = self.find(j, stop, ("{", ";", "("), "[") if family in ("c", "cpp") else self.find(j, stop, ("{", ";"), "([")
        if j is None or self.text(j) == "(" or self.text(j) == ";" and not (family == "rust" and t == "struct" or self.language == "csharp" and t == "record"):
            return None
        decorators, first = self._decorators(i)
        own_line = self.language not in ("java", "csharp", "php") and not (decorators and family == "javascript")
        first = i if own_line else min(first, self.began(i)) if family != "javascript" else first
        last = self.end(j) if self.text(j) == "{" else j
        self.class_braces.add(j)
        self.symbols.append(_symbol("class", name, self.tokens[first][2], self.line(last), decorators, parent=parent, bases=self._bases(i, j)))
        self._walk(j + 1, last, name)
        return last + 1

    def _named_function(self, i: int, stop: int, parent: str | None) -> tuple[str | None, int] | None:
        """(name, place of the parameters) of a function that begins with token i."""
        t, family, word = self.text(i), self.family, _FUNCTION_WORDS.get(self.language)
        if self.word(i) and t == word:
            j = i + 1
            if family == "go" and self.text(j) == "(":
                j = self.end(j) + 1
            if family == "php" and self.text(j) == "&":
                j += 1
            if self.text(j) == "*":
                return None  # a generator is no function here, but what it holds is looked at
            name = self.text(j) if self.word(j) else None
            j = self.after_angles(j + bool(name), stop) if self.text(j + bool(name)) == "<" else j + bool(name)
            if family == "go" and self.text(j) == "[":
                j = self.end(j) + 1
            return (name, j) if self.text(j) == "(" and (name or family == "javascript") else None
        if family == "javascript":
            if self.word(i) and self.text(i + 1) == "=>" and t not in ("return", "case"):
                return None, i
            if t == "(":
                j = self.end(i) + 1
                if self.text(j) == "=>":
                    return None if self._is_type(i) else (None, i)
                if self.text(j) == ":" and self.language != "javascript" and self.text(i - 1) != "?":
                    arrow = self.find(j + 1, stop, ("=>", ";", ",", "=", "?"), "([{")
                    return (None, i) if arrow is not None and self.text(arrow) == "=>" else None
                return None
            j = self.after_angles(i + 1, stop) if self.text(i + 1) == "<" else i + 1
            if self.word(i) and self.text(j) == "(" and t not in _NOT_CALLS and self.text(i - 1) not in (".", "?.", "new", "@", "function"):
                body = self.end(j) + 1
                if self.text(body) == "{" and (parent or self.tokens[body][2] == self.line(body - 1)) or self.text(body) == ":" and parent and self.text(i - 1) != "?":
                    return t, j
            return None
        if family in ("java", "csharp") and self.word(i) and t not in _NOT_CALLS and self.text(i - 1) not in (".", "new", "@"):
            j = self.after_angles(i + 1, stop) if self.text(i + 1) == "<" and family == "csharp" else i + 1
            return (t, j) if self.text(j) == "(" and parent else None
        if family in ("c", "cpp") and (self.word(i) or t == "~") and t not in _NOT_CALLS and self.text(i - 1) not in (".", "->", "new", "~", "::"):
            return self._declarator(i, stop)
        return None

    def _is_type(self, i: int) -> bool:
        """Whether the `(a) => b` at token i is a type of TypeScript's, not a function."""
        before = self.text(i - 1)
        if self.language == "javascript" or before not in (":", "=", "|", "&", "<"):
            return False
        if before == "=":
            return "type" in (self.text(i - 3), self.text(self._stretch(i)))
        return before != ":" or self.within[i] in self.class_braces or self.text(i - 3) in ("const", "let", "var")

    def _declarator(self, i: int, stop: int) -> tuple[str | None, int] | None:
        """Of C and C++: an identifier, a path of them, or a destructor or operator, which
        have a name only within a path; then parameters."""
        j, path, plain = i, False, True
        while True:
            if self.text(j) == "~":
                plain, j = False, j + 1
            if not self.word(j):
                return None
            if self.text(j) == "operator":
                plain = False
                j = j + 1 if self.text(j + 1) == "(" else j
                p = self.find(j + 1, stop, ("(",), "[")
                j = p - 1 if p is not None else j
            k = j + 1
            if self.text(k) == "<" and self.family == "cpp":
                k = self.after_angles(k, stop)
            if self.text(k) == "::":
                path, j = True, k + 1
                continue
            k = j + 1
            if self.text(k) != "(":
                return None
            raw = self.source[self.tokens[i][3] : self.tokens[j][3] + len(self.tokens[j][1])]
            return (raw if path or plain else None), k

    def _body(self, params: int, stop: int, name: str | None, parent: str | None) -> tuple[int, int] | None:
        """First and last token of a function's body."""
        family = self.family
        j = (self.end(params) if self.text(params) == "(" else params) + 1
        if family == "javascript" and (self.text(j) == "=>" or name is None and self.text(j) == ":"):
            j = self.find(j, stop, ("=>",), "([{")
            if j is None:
                return None
            if self.text(j + 1) == "{":
                return j + 1, self.end(j + 1)
            return j, self._expression_end(j + 1, stop)
        marks = ("{", ";", "=", "=>", ",") if family in ("c", "cpp", "csharp", "java") else ("{", ";")
        if family == "cpp":
            marks = (*marks, ":")
        if family == "javascript" and self.text(j) == ":":  # a type, which may itself have braces
            j = j + 1 if self.text(j + 1) != "{" else self.end(j + 1) + 1
            while (angle := self.find(j, stop, ("<", "{", ";"), "([")) is not None and self.text(angle) == "<":
                j = self.after_angles(angle, stop)
        if family == "go" and self.text(j) == "(":
            j = self.end(j) + 1
        if family == "go":
            while self.text(j) in ("interface", "struct") and self.text(j + 1) == "{" or self.text(j + 1) in ("interface", "struct") and self.text(j + 2) == "{":
                j = self.end(j + 1 if self.text(j + 1) == "{" else j + 2) + 1
        at = self.find(j, stop, marks, "([")
        if at is not None and self.text(at) == ":" and family == "cpp":
            at = self._initialised(at + 1, stop)
        if at is not None and self.text(at) == "," and family in ("java", "csharp"):  # throws a, b; where T : a, b
            at = self.find(at + 1, stop, ("{", ";"), "([")
        if at is None or family in ("c", "cpp") and any(self.text(x) == "(" for x in range(j, at)) and not any(self.text(x) in ("noexcept", "throw", "->", "decltype", "requires", "__attribute__", ":") for x in range(j, at)):
            return None
        t = self.text(at)
        if t == "{":
            return at, self.end(at)
        if t == "=>" and family == "csharp":
            return at, self.find(at, stop, (";",)) or at
        if t == "=" and family == "cpp" and self.text(at + 1) in ("default", "delete"):
            return at, at + 2
        if t == ";" and parent and self.language in ("java", "csharp", "php") and name:
            return at, at  # a declaration without a body
        if t == ";" and family == "csharp" and parent:
            return at, at
        return None

    def _initialised(self, j: int, stop: int) -> int | None:
        """The body after a constructor's initialisers: a name, then a bracket, each."""
        while j < stop:
            at = self.find(j, stop, ("(", "{", ";"), "[")
            if at is None or self.text(at) == ";" or not (self.word(at - 1) or self.text(at - 1) in (">", "...")):
                return at if at is not None and self.text(at) == "{" else None
            self.initialised.add(at - 1)
            j = self.end(at) + 1
            if self.text(j) == "...":
                j += 1
            if self.text(j) == "{":
                return j
            if self.text(j) != ",":
                return None
            j += 1
        return None

    def _expression_end(self, j: int, stop: int) -> int:
        """The last token of an arrow's expression, with or without a semicolon."""
        first = j
        while j < stop:
            t = self.text(j)
            if self.tokens[j][0] == "punct" and t in (";", ",", ")", "]", "}"):
                break
            if j > first and self.tokens[j][2] > self.line(j - 1) and self.tokens[j][0] in ("word", "string") and self.tokens[j - 1][0] != "punct":
                break
            j = self.end(j) + 1 if self.tokens[j][0] == "punct" and t in ("(", "[", "{") else j + 1
        return max(first, min(j, stop) - 1)

    def _function(self, i: int, stop: int, parent: str | None) -> int | None:
        """Takes the function that begins with, or is named by, token i; the token after it."""
        found = self._named_function(i, stop, parent)
        if not found:
            return None
        name, params = found
        if self.family in ("java", "csharp") and self.text(i - 1) in ("=", "(", ",", "return", "&&", "||", "!", "?", "+"):
            return None  # a call in a field's value
        body = self._body(params, stop, name, parent)
        if not body:
            return None
        start, end = body
        if self.language in ("java", "csharp", "php", "c", "cpp"):
            first = self.began(i)
        else:
            first = i - 1 if self.text(i - 1) == "async" else i
        decorators, _ = self._decorators(i if self.family == "javascript" or self.text(i) == _FUNCTION_WORDS.get(self.language) else self._typed(i))
        calls, branches, deep, loops = self._inside(params, end)
        self.symbols.append(_symbol("method" if parent else "function", name or ANONYMOUS, self.tokens[first][2], self.line(end), decorators, calls, 1 + branches, deep, loops, parent))
        return end + 1

    def _typed(self, i: int) -> int:
        """The first token of the type before a name."""
        while i > 0 and (self.word(i - 1) or self.text(i - 1) in (".", "<", ">", ",", "?", "[", "]", "*", "&") and self.text(i - 1) != "@"):
            if self.text(i - 1) == "]" and self.opens.get(i - 1, i) < i - 2 or self.text(i - 2) == "@":
                break
            i -= 1
        return i

    def _statement_end(self, j: int, stop: int) -> int:
        """The last token of the statement that begins at token j."""
        t = self.text(j)
        if t == "{":
            return self.end(j)
        if t in ("if", "for", "foreach", "while") and self.text(j + 1) == "(":
            return self._branch_end(j, stop)
        at = self.find(j, stop, (";",))
        return stop if at is None else at

    def _branch_end(self, i: int, stop: int) -> int:
        """The last token of a branch or loop: an `if` holds its `else`."""
        t, family = self.text(i), self.family
        if t in ("case", "default"):
            at = self.find(i + 1, stop, ("case", "default"))
            while at is not None and self.text(at + 1) in ("(", ".") and self.text(at) == "default":
                at = self.find(at + 1, stop, ("case", "default"))
            outer = max((o for o, c in self.match.items() if o < i <= c and self.text(o) == "{"), default=None)
            return (at if at is not None else self.match.get(outer, stop)) - 1
        if family in ("go", "rust"):
            at = self.find(i + 1, stop, ("{",), "([")
        else:
            at = self.end(i + 1) + 1 if self.text(i + 1) == "(" else self.find(i + 1, stop, ("{", ";"), "([")
        if at is None:
            return i
        end = self._statement_end(at, stop)
        if t in ("if", "elseif") and self.text(end + 1) in ("else", "elseif"):
            more = end + 1 if self.text(end + 1) == "elseif" else end + 2
            end = self._branch_end(more, stop) if self.text(more) in ("if", "elseif") else self._statement_end(more, stop)
        return min(end, stop)

    def _inside(self, start: int, end: int):
        words, calls, count, deep, loops = _BRANCH_WORDS[self.family], [], 0, 0, 0
        opened: list[tuple[int, bool, bool]] = []  # last token, is a branch, is a loop
        for i in range(start, end + 1):
            k, t, _, at = self.tokens[i]
            opened = [o for o in opened if o[0] >= i]
            if k == "word" and (t in words or t == "loop" and self.family == "rust") and self._branches(i):
                branch = t in words
                count += branch
                opened.append((i if t in ("case", "default") and self.family == "java" else self._branch_end(i, end), branch, t in _LOOP_WORDS))
                deep, loops = max(deep, sum(o[1] for o in opened)), max(loops, sum(o[2] for o in opened))
            elif k == "punct" and t == "=>" and self.family == "rust":
                count += 1
                at_end = self.end(i + 1) if self.text(i + 1) == "{" else self.find(i + 1, end, (",",))
                opened.append((self.end(self.within[i]) - 1 if at_end is None else at_end, True, False))
                deep = max(deep, sum(o[1] for o in opened))
            elif k == "punct" and (t == "?" and self._ternary(i) or self.family == "javascript" and (t in ("&&", "||", "??") or t in ("<", ">", "+", "-", "*", "/", "%", "=", "!") and self._binary(i))):
                count += 1
                deep = max(deep, sum(o[1] for o in opened) + 1)
            if k == "word" and self._called(i):
                calls.append(self._callee(i))
        return calls, count, deep, loops

    def _branches(self, i: int) -> bool:
        """A keyword in its own place: no member, key, deleted function or tail of a `do`."""
        t, before, after = self.text(i), self.text(i - 1), self.text(i + 1)
        if before in (".", "->", "::", "=") or after == ":" and t != "default" or t == "default" and after not in (":", "->"):
            return False
        return not (t == "while" and before == "}" and self.text(self.opens.get(i - 1, 0) - 1) == "do")

    def _called(self, i: int) -> bool:
        """Whether token i is the last word of what is called."""
        t, family, after = self.text(i), self.family, self.text(i + 1)
        if family == "rust" and after == "!":
            return self.text(i + 2) in ("(", "[", "{")
        if after != "(" or i in self.initialised or t in _NOT_CALLS and not (t == "super" and family == "javascript"):
            return False
        before = self.text(self._head(i) - 1)
        if family == "rust":
            return self.text(self.end(i + 1) + 1) not in ("=>", "=", "|") and before != "fn"  # else a pattern
        if family == "csharp":
            return not (t in ("base", "this") and before == ":")
        return before not in {"java": ("@",), "go": ("func",)}.get(family, ("new", "function"))

    def _head(self, i: int) -> int:
        """Where the path or chain of calls begins that ends with token i."""
        while self.text(i - 1) in (".", "?.", "->", "::") and i > 1:
            i -= 2
            while self.text(i) in (")", "]") and i in self.opens:
                i = self.opens[i] - 1
            if not self.word(i) and self.tokens[i][0] != "string":
                return i + 1
        return i

    def _callee(self, i: int) -> str:
        """What is called; the call itself, cut short, where the grammar has no name for it."""
        head, last = self.tokens[self._head(i)], self.tokens[i]
        if self.family == "rust" and self.text(i + 1) == "!":
            whole = self.end(i + 2)
        elif self.family == "java" and self.text(self._head(i) - 1) != "new" or self.family == "php" and self.text(i - 1) in ("->", "::"):
            whole = self.end(i + 1)
        else:
            return self.source[head[3] : last[3] + len(last[1])]
        return self.source[head[3] : self.tokens[whole][3] + 1][:60]

    def _ternary(self, i: int) -> bool:
        """After an operand, and not the mark of an optional parameter, type or value."""
        if self.family in ("rust", "go") or self.family == "c" or self.text(i + 1) in (":", ",", ")", ">", "=", ";", "."):
            return False
        if not (self.tokens[i - 1][0] in ("word", "number", "string") or self.text(i - 1) in (")", "]", "}")):
            return False
        return self.family != "csharp" or self.source[self.tokens[i][3] - 1].isspace()

    def _binary(self, i: int) -> bool:
        """An operator between operands, counted at its first sign: the signs of `=>`, `+=`,
        `++`, of tags and of type arguments are none."""
        t, before, after, at = self.text(i), self.text(i - 1), self.text(i + 1), self.tokens[i][3]
        if not (self.tokens[i - 1][0] in ("word", "number", "string") and before not in _OPERAND_NEXT or before in (")", "]", "}")):
            return False
        if t in ("=", "!"):
            return after == "=" and self.source[at + 1] == "="
        if t in ("<", ">"):
            return self.source[at - 1].isspace()
        return after != "=" and not (after == t and t in "+-") and not (t == "/" and after == ">")


def parse_text(language: str, source: str) -> tuple[list[str], list[dict], str | None]:
    """imports, symbols, error.  An error leaves the file with its text only."""
    if language not in V.DEEP_LANGUAGES:
        return [], [], None
    try:
        if language == "python":
            try:
                imports, symbols = _python(source, source.splitlines())
            except (SyntaxError, ValueError):
                imports, symbols = _rough_python(source)
        else:
            imports, symbols = _Scan(language, source).run()
        for n, s in enumerate(symbols):
            s["sym_seq"] = n
        return imports, symbols, None
    except (RecursionError, IndexError) as e:
        return [], [], f"{type(e).__name__}: {e}"


def _rough_python(source: str):
    """Python that does not compile: headers by line, extent by indentation."""
    lines, imports, symbols, owners = source.splitlines(), [], [], []
    for n, line in enumerate(lines, 1):
        m = re.match(r"(\s*)(?:async\s+)?(class|def|import|from)\s+([\w.]+)(?:\s*\(([^)]*)\))?", line)
        if not m:
            continue
        indent = len(m[1])
        while owners and owners[-1][0] >= indent:
            owners.pop()
        if m[2] in ("import", "from"):
            imports.append(m[3].lstrip("."))
            continue
        if any(o[2] == "def" for o in owners):
            continue
        end = n
        for at in range(n, len(lines)):
            if lines[at].strip():
                if len(lines[at]) - len(lines[at].lstrip()) <= indent:
                    break
                end = at + 1
        parent = owners[-1][1] if owners else None
        if m[2] == "class":
            symbols.append(_symbol("class", m[3], n, end, parent=parent, bases=re.findall(r"\w+", m[4] or "")))
        else:
            symbols.append(_symbol("method" if parent else "function", m[3], n, end, parent=parent))
        owners.append((indent, m[3], m[2]))
    return imports, symbols


def parse_files(files: DataFrame) -> DataFrame:
    """PARSED rows of files."""

    def run(batches):
        for b in batches:
            got = [parse_text(l, s or "") for l, s in zip(b.column("language").to_pylist(), b.column("source").to_pylist(), strict=True)]
            fields = [(n, {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (x.split(":") for x in SYMBOL.split(","))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[2] for g in got], pa.string()), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.list_(pa.struct(fields)))],
                names=[*b.schema.names, "parse_error", "imports", "symbols"],
            )

    cols = ["job_id", "file_seq", "path", "language", "size_bytes", "loc", "source"]
    # Parsing costs far more than the few bytes that splits are made by: every core takes part.
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select(*cols).repartition(tasks, "job_id", "path").mapInArrow(run, PARSED)


class Code:
    """The tables of parsed repositories.  Every operator groups by job_id, so one
    plan analyses any number of repositories.  Bodies of symbols are slices of their
    file's lines, taken where the file's row is exploded: no join."""

    def __init__(self, parsed: DataFrame):
        self.parsed = parsed

    @property
    def files(self) -> DataFrame:
        return self.parsed.select("job_id", "file_seq", "path", "language", "size_bytes", "loc", "parse_error", F.size(F.filter("symbols", lambda s: s["kind"] == "class")).alias("num_classes"), F.size(F.filter("symbols", lambda s: s["kind"] != "class")).alias("num_functions"))

    @property
    def sources(self) -> DataFrame:
        return self.parsed.select("job_id", "file_seq", "path", "language", "source")

    @property
    def lines(self) -> DataFrame:
        x = self.parsed.select("job_id", "file_seq", "path", "language", F.posexplode(T.lines("source")).alias("line", "text"))
        return x.withColumn("line", F.col("line") + 1)

    @property
    def imports(self) -> DataFrame:
        return self.parsed.select("job_id", "file_seq", "path", F.posexplode("imports").alias("imp_seq", "raw"))

    @property
    def symbols(self) -> DataFrame:
        return self.parsed.select("job_id", "file_seq", "path", "language", F.explode("symbols").alias("s")).select("job_id", "file_seq", "path", "language", "s.*")

    @property
    def bodies(self) -> DataFrame:
        """symbols with `body`, their lines."""
        x = self.parsed.select("job_id", "file_seq", "path", "language", T.lines("source").alias("_l"), F.explode("symbols").alias("s"))
        n = F.greatest(F.lit(0), F.col("s.end_line") - F.col("s.start_line") + 1)
        return x.select("job_id", "file_seq", "path", "language", "s.*", F.slice("_l", F.greatest(F.lit(1), F.col("s.start_line")), n).alias("body"))

    @property
    def classes(self) -> DataFrame:
        return self.symbols.where("kind = 'class'")

    @property
    def functions(self) -> DataFrame:
        return self.symbols.where("kind <> 'class'")
