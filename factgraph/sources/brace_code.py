"""Structure of Rust, JavaScript, TypeScript, C# and Svelte sources: symbols, imports, calls and key accesses.

A lexer and a walk over brackets stand in for a grammar.  The state COMPLETE says that every literal and
bracket closes.  Not told apart: calls inside C# interpolated strings are not seen, names that a macro makes are not
known, and text between JSX tags is read like code.  The script of a Svelte component is read in the component's own
offsets; the component stays CONTAINER_ONLY.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Calls and subscripts that read a key.
KEY_CALLS = {
    "RUST": ("std::env::var", "env::var", "std::env::var_os", "env::var_os"),
    "CSHARP": ("Environment.GetEnvironmentVariable",),
    "JS": (),
}
KEY_SUBSCRIPTS = {"RUST": (), "CSHARP": ("ConfigurationManager.AppSettings", "ConfigurationManager.ConnectionStrings"), "JS": ("process.env",)}
#: What separates the parts of a qualified name.
SEPARATORS = {"RUST": "::", "CSHARP": ".", "JS": "."}
#: Kinds of symbols by the keyword that declares them.
RUST_TYPES = {"struct": "STRUCT", "enum": "ENUM", "trait": "TRAIT"}
JS_TYPES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM"}
CSHARP_TYPES = {"class": "CLASS", "interface": "INTERFACE", "struct": "STRUCT", "enum": "ENUM", "record": "RECORD"}
#: Words before a parenthesis that make no call.
NO_CALL = {
    "RUST": frozenset("if while for return in match loop move as fn where let mut ref impl dyn pub crate else unsafe await struct enum trait type mod use const static".split()),
    "CSHARP": frozenset("if while for foreach switch catch return typeof sizeof default checked unchecked lock fixed using when await yield in is not and or new base this do else try throw void case stackalloc out ref var async".split()),
    "JS": frozenset("if while for switch catch return typeof function await yield in of new super import this with async do else try throw void delete instanceof case var let const class interface enum".split()),
}
JS_MODIFIERS = frozenset("public private protected static readonly abstract override declare async get set accessor".split())
CSHARP_WORDS = frozenset("public private protected internal static readonly abstract override virtual sealed async partial extern unsafe new const volatile required ref file".split())

_ID = r"[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*"
_LEX = {
    "RUST": re.compile(
        r"(?P<skip>\s+|//[^\n]*)|(?P<open>/\*)|(?P<str>b?r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\[^\n']*'|\\''|(?:[^\\'\n\x80-\xff]|[\xc2-\xf4][\x80-\xbf]{1,3})'))"
        r"|(?P<id>r\#" + _ID + "|" + _ID + r")|(?P<life>'" + _ID + r")|(?P<num>\d[\w]*(?:\.\d[\w]*)?)|(?P<op>::|->|=>|&&|\|\||[^\s])"
    ),
    "CSHARP": re.compile(
        r"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/|(?<![^\n])[ \t]*\#[^\n]*)|(?P<str>\$*\"\"\"[\s\S]*?\"\"\"|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n']*'|(?:[^\\'\n\x80-\xff]|[\xc2-\xf4][\x80-\xbf]{1,3})'))"
        r"|(?P<id>@?" + _ID + r")|(?P<num>\d[\w]*(?:\.\d[\w]*)?)|(?P<op>::|->|=>|\?\.|&&|\|\||[^\s])"
    ),
    "JS": re.compile(
        r"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/|(?<![\s\S])\#![^\n]*)|(?P<str>\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')"
        r"|(?P<id>\#?" + _ID + r")|(?P<num>\d[\w]*(?:\.\d[\w]*)?)|(?P<op>=>|\?\.|&&|\|\||\.\.\.|[^\s])"
    ),
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(`|\$\{)?")
_RUST_COMMENT = re.compile(r"/\*|\*/")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield".split())
_CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def lex(src: str, lang: str, at: int = 0, stop: int | None = None) -> tuple[list[Token], bool]:
    """Tokens of ``src`` (one character a byte) and whether every literal and comment closes."""
    stop, pattern, out, whole, templates, depth = len(src) if stop is None else stop, _LEX[lang], [], True, [], 0
    while at < stop:
        if lang == "JS":
            c = src[at]
            if c == "/":
                last = out[-1] if out else None
                value = last is not None and (last.kind in ("num", "str") or last.text in (")", "]", "}") or (last.kind == "id" and last.text not in _BEFORE_REGEX))
                if not value and (m := _REGEX.match(src, at, stop)):
                    out.append(Token("str", "/", at, m.end()))
                    at = m.end()
                    continue
            if c == "`" or (c == "}" and templates and templates[-1] == depth):
                if c == "}":
                    templates.pop()
                    depth -= 1
                    out.append(Token("op", "}", at, at + 1))
                m = _TEMPLATE.match(src, at + 1, stop)
                out.append(Token("str", "`", at + (c == "}"), m.end() - (2 if m[1] == "${" else 0)))
                if m[1] == "${":
                    depth += 1
                    templates.append(depth)
                    out.append(Token("op", "${", m.end() - 2, m.end()))
                whole &= m[1] is not None
                at = m.end()
                continue
        m = pattern.match(src, at, stop)
        kind, text, end = m.lastgroup, m[0], m.end()
        if kind == "h":
            kind = "str"
        if kind == "open":  # comments of Rust nest
            level = 1
            while level and (n := _RUST_COMMENT.search(src, end, stop)):
                level, end = level + (1 if n[0] == "/*" else -1), n.end()
            if level:
                whole, end = False, stop
        elif kind == "op":
            depth += (text == "{") - (text == "}")
            whole &= text not in ("'", '"')
            out.append(Token("op", text, at, end))
        elif kind != "skip":
            out.append(Token("str" if kind == "str" else kind, text, at, end))
        at = end
    return out, whole and not templates


def mates(tokens: list[Token]) -> tuple[list[int], bool]:
    """For each opening bracket the place of its closing one (else its own place), and whether all close."""
    out, stack, whole = list(range(len(tokens))), [], True
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in _CLOSE:
            stack.append(i)
        elif t.text in (")", "]", "}"):
            while stack and _CLOSE[tokens[stack[-1]].text] != t.text:
                whole = False
                stack.pop()
            if stack:
                out[stack.pop()] = i
            else:
                whole = False
    return out, whole and not stack


class Frame(NamedTuple):
    """The scope, whether it is inside a callable, and whether functions here are members."""

    scope: tuple[str, ...] = ()
    callable: bool = False
    member: bool = False


class Reader:
    """Walks the tokens of one file; ``rows`` are (record, name, qualified_name, kind, start, end)."""

    def __init__(self, src: str, lang: str, at: int = 0, stop: int | None = None):
        self.src, self.lang, self.rows = src, lang, []
        self.sep = SEPARATORS[lang]
        self.t, closed = lex(src, lang, at, stop)
        self.mate, balanced = mates(self.t)
        self.whole = closed and balanced

    def read(self) -> Reader:
        if self.lang == "CSHARP":
            self.csharp(0, len(self.t), Frame(), False)
        else:
            self.walk(0, len(self.t), Frame())
        return self

    # tokens

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id"

    def name(self, i: int) -> str:
        return self.plain(self.t[i].text)

    @staticmethod
    def plain(text: str) -> str:
        return text.removeprefix("r#").removeprefix("@").encode("latin-1").decode("utf-8", "replace")

    def find(self, i: int, j: int, *wanted: str) -> int:
        """The first of the wanted tokens from i outside brackets, else j."""
        while i < j:
            if self.t[i].kind == "op" or self.t[i].kind == "id":
                if self.t[i].text in wanted:
                    return i
                i = self.mate[i]
            i += 1
        return j

    def angles(self, i: int, j: int) -> int:
        """The place after the angle brackets that open at i, or i if none do."""
        if self.text(i) != "<":
            return i
        depth, k = 0, i
        while k < j:
            depth += (self.text(k) == "<") - (self.text(k) == ">")
            if self.text(k) in ("(", "[", "{"):
                k = self.mate[k]
            elif self.text(k) == ";":
                return i
            k += 1
            if depth == 0:
                return k
        return i

    def ends(self, i: int, j: int) -> int:
        """The place after a JavaScript statement: after a semicolon, or where a line ends and the next cannot go on."""
        k = i
        while k < j:
            if self.text(k) == ";":
                return k + 1
            if "\n" in self.src[self.t[k - 1].end : self.t[k].start]:
                on = self.text(k) in ("|", "&", "&&", "||", ".", "?.", "?", ":", "=", "+", "-", "*", "/", "%", "=>", ",", ")", "]", "`", "(", "[", "<", "extends")
                if not on and self.text(k - 1) not in ("|", "&", "&&", "||", ".", "?", ":", "=", "+", "-", "*", "/", "%", "=>", ",", "<"):
                    return k
            if self.text(k) in (")", "]", "}"):
                return k
            k = self.mate[k] + 1
        return j

    # rows

    def symbol(self, i: int, kind: str, f: Frame, first: int, last: int) -> Frame:
        """A row for the symbol named at i, from token first to before token last; the frame of what it holds."""
        own = (*f.scope, self.name(i))
        end = self.t[max(min(last, len(self.t)) - 1, i)].end
        self.rows.append(("SYMBOL", own[-1], self.sep.join(own), kind, self.t[first].start, end))
        return Frame(own, f.callable or kind in ("FUNCTION", "METHOD"), kind in ("CLASS", "INTERFACE", "STRUCT", "ENUM", "TRAIT", "RECORD"))

    def imported(self, name: str, path: str, kind: str, first: int, last: int) -> None:
        self.rows.append(("IMPORT", self.plain(name), self.plain(path), kind, self.t[first].start, self.t[last].end))

    def chain(self, i: int) -> tuple[int, str]:
        """Where the chain of names that ends at i begins, and the chain; another receiver is written ``?``."""
        k, out = i, self.name(i)
        while k >= 2 and self.text(k - 1) in (".", "::", "?."):
            sep = "." if self.text(k - 1) == "?." else self.text(k - 1)
            if not self.is_id(k - 2):
                return k, f"?{sep}{out}"
            k, out = k - 2, f"{self.name(k - 2)}{sep}{out}"
        return k, out

    def key(self, arg: int, close: int, api: str, first: int) -> None:
        literal = close == arg + 1 and self.t[arg].kind == "str" and "`" not in self.text(arg)
        key = self.plain(re.sub(r"^[@$bcr#]*[\"']|[\"']#*$", "", self.text(arg))) if literal else ""
        self.rows.append(("KEY", key, api, "LITERAL" if literal else "DYNAMIC", self.t[first].start, self.t[close].end))

    def evidence(self, i: int, f: Frame) -> None:
        """The call or key access whose name is at i, if any."""
        if not self.is_id(i):
            return
        text, after = self.text(i), i + 1
        if self.lang == "JS" and text == "env" and self.text(after) in (".", "?.") and self.is_id(after + 1) and self.chain(i)[1] == "process.env":
            self.rows.append(("KEY", self.name(after + 1), "process.env", "LITERAL", self.t[self.chain(i)[0]].start, self.t[after + 1].end))
            return
        if self.text(after) == "[" and KEY_SUBSCRIPTS[self.lang]:
            first, name = self.chain(i)
            if name in KEY_SUBSCRIPTS[self.lang]:
                self.key(after + 1, self.mate[after], name, first)
            return
        if text in NO_CALL[self.lang] and self.text(i - 1) not in (".", "::", "?."):
            return
        if self.text(after) == "?." and self.text(after + 1) == "(":
            after += 1
        elif self.text(after) == "<" and self.lang != "RUST":
            close = self.angles(after, min(after + 40, len(self.t)))
            inside = self.t[after:close]
            after = close if all(x.kind == "id" or x.text in ("<", ">", ",", ".", "?", "[", "]", "|") for x in inside) else after
        elif self.text(after) == "::" and self.text(after + 1) == "<":
            after = self.angles(after + 1, len(self.t))
        if self.text(after) != "(":
            return
        first, name = self.chain(i)
        before, close = self.text(first - 1), self.mate[after]
        if before in ("new", "function", "fn", "let") or (self.lang == "RUST" and (self.text(close + 1) == "=>" or (before == "|" and self.text(close + 1) == "|"))):
            return
        if name in KEY_CALLS[self.lang]:
            if close > after + 1:
                self.key(after + 1, self.find(after + 1, close, ","), name, first)
            return
        self.rows.append(("CALL", self.name(i), name, self.sep.join(f.scope), self.t[first].start, self.t[close].end))

    # blocks of Rust and JavaScript

    def walk(self, i: int, j: int, f: Frame) -> None:
        item = self.rust if self.lang == "RUST" else self.js
        while i < j:
            after = item(i, j, f)
            if after is None:
                self.evidence(i, f)
                after = i + 1
            i = after

    def rust(self, i: int, j: int, f: Frame) -> int | None:
        text, nxt = self.text(i), self.text(i + 1)
        if text == "#" and nxt in ("[", "!"):
            k = i + 1 + (nxt == "!")
            return self.mate[k] + 1 if self.text(k) == "[" else None
        if not self.is_id(i) or self.text(i - 1) in (".", "::"):
            return None
        if nxt == "!" and self.text(i + 2) in ("(", "[", "{") or (text == "macro_rules" and nxt == "!"):
            return self.rust_macro(i, j, f)
        if text == "use" and self.text(i - 1) in ("", ";", "}", "{", "]", ")", "pub"):
            end = self.find(i + 1, j, ";")
            self.rust_use(i + 1, end, "")
            return end
        if text == "impl" and self.text(i - 1) in ("", ";", "}", "{", "]", "unsafe", "default"):
            return self.rust_impl(i, j, f)
        if not self.is_id(i + 1):
            return None
        first = i
        while self.text(first - 1) in ("async", "unsafe", "const", "pub", "default") or (self.text(first - 1) == ")" and self.text(first - 3) == "(" and self.text(first - 4) == "pub"):
            first -= 1 if self.text(first - 1) != ")" else 3
        if text == "mod":
            if self.text(i + 2) != "{":
                return None
            self.walk(i + 3, self.mate[i + 2], Frame((*f.scope, self.name(i + 1)), f.callable, False))
            return self.mate[i + 2] + 1
        if text in RUST_TYPES:
            end = self.find(i + 2, j, "{", ";")
            body = end < j and self.text(end) == "{"
            last = self.mate[end] + 1 if body else min(end + 1, j)
            g = self.symbol(i + 1, RUST_TYPES[text], f, first, last)
            if text == "trait":
                self.walk(i + 2, last, g)
            elif text == "struct" and body:
                self.rust_fields(end + 1, self.mate[end], g)
            elif body:
                for k in range(end + 1, self.mate[end]):
                    if self.text(k) == "{" and self.is_id(k - 1):
                        self.rust_fields(k + 1, self.mate[k], g)
            return last
        if text == "fn":
            params = self.angles(i + 2, j)
            if self.text(params) != "(":
                return None
            end = self.find(self.mate[params] + 1, j, "{", ";")
            last = self.mate[end] + 1 if self.text(end) == "{" else min(end + 1, j)
            g = self.symbol(i + 1, "METHOD" if f.member else "FUNCTION", f, first, last)
            self.walk(params, last, g._replace(member=False))
            return last
        if text == "type":
            end = self.find(i + 2, j, ";")
            if self.find(i + 2, end, "=") < end:
                self.symbol(i + 1, "TYPE_ALIAS", f, first, end + 1)
            return end
        if text in ("const", "static"):
            at = i + 1 + (nxt == "mut")
            if self.text(at + 1) != ":" or self.text(i - 1) in ("*", "<", ",", "&"):
                return None
            end = self.find(at + 1, j, ";")
            g = f if f.callable or self.text(at) == "_" else self.symbol(at, "CONSTANT", f, first, end + 1)
            self.walk(at + 1, end, g._replace(member=False))
            return end
        return None

    def rust_macro(self, i: int, j: int, f: Frame) -> int:
        """Names before a parenthesis in the arguments of a macro may be calls: they are CANDIDATE rows."""
        k = i + 2 + (self.text(i) == "macro_rules")
        close = self.mate[k]
        if self.text(i) != "macro_rules":
            for x in range(k + 1, close):
                if self.is_id(x) and self.text(x + 1) == "(" and self.text(x) not in NO_CALL["RUST"] and self.text(x - 1) not in ("fn", "struct", "enum", "trait", "!"):
                    first, name = self.chain(x)
                    self.rows.append(("CANDIDATE", self.name(x), name, self.sep.join(f.scope), self.t[first].start, self.t[self.mate[x + 1]].end))
        return close + 1

    def rust_use(self, i: int, j: int, prefix: str) -> None:
        """One row a leaf of a use tree; a star keeps its star."""
        while i < j:
            end = self.find(i, j, ",")
            at, parts = i, []
            while at < end and (self.is_id(at) or self.text(at) in ("::", "*")) and self.text(at) != "as":
                parts.append(self.text(at))
                at += 1
            path = prefix + "".join(parts)
            if at < end and self.text(at) == "{":
                self.rust_use(at + 1, self.mate[at], path)
            elif parts:
                alias = self.text(at + 1) if at < end and self.text(at) == "as" else path.removesuffix("::self").rpartition("::")[2]
                self.imported(alias, path, "GLOB" if parts[-1] == "*" else "MEMBER", i, end - 1)
            i = end + 1

    def rust_impl(self, i: int, j: int, f: Frame) -> int | None:
        at = self.angles(i + 1, j)
        body = self.find(at, j, "{", ";")
        if self.text(body) != "{":
            return None
        end = self.find(at, body, "where")
        depth, k = 0, at
        while k < end:
            depth += (self.text(k) == "<") - (self.text(k) == ">")
            if depth == 0 and self.text(k) == "for" and self.text(k + 1) != "<":
                at = k + 1
            k += 1
        while at < end and (self.text(at) in ("&", "mut", "dyn", "!") or self.t[at].kind == "life"):
            at += 1
        while self.text(at + 1) == "::" and self.is_id(at + 2):
            at += 2
        g = Frame((*f.scope, self.name(at)), f.callable, True) if self.is_id(at) else f._replace(member=True)
        self.walk(body + 1, self.mate[body], g)
        return self.mate[body] + 1

    def rust_fields(self, i: int, j: int, f: Frame) -> None:
        while i < j:
            if self.text(i) == "#":
                i = self.mate[i + 1] + 1
                continue
            first, depth, end = i, 0, i
            while end < j and (depth > 0 or self.text(end) != ","):
                depth += (self.text(end) == "<") - (self.text(end) == ">")
                end = self.mate[end] + 1
            at = i + (self.text(i) == "pub")
            at = self.mate[at] + 1 if self.text(at) == "(" else at
            if self.is_id(at) and self.text(at + 1) == ":":
                self.symbol(at, "FIELD", f, first, end)
            i = end + 1

    def js(self, i: int, j: int, f: Frame) -> int | None:
        if not self.is_id(i) or self.text(i - 1) in (".", "?."):
            return None
        text, nxt = self.text(i), self.text(i + 1)
        if text == "import" and nxt not in ("(", "."):
            return self.js_import(i, j)
        first = i - 1 if self.text(i - 1) in ("async", "abstract", "declare") else i
        if text in JS_TYPES and self.is_id(i + 1) and nxt not in ("extends", "implements", "in", "of"):
            body = self.find(i + 2, j, "{")
            if body == j:
                return None
            g = self.symbol(i + 1, JS_TYPES[text], f, first, self.mate[body] + 1)
            self.walk(i + 2, body, g)
            if text == "enum":
                self.walk(body + 1, self.mate[body], g)
            else:
                self.js_members(body + 1, self.mate[body], g, "PROPERTY" if text == "interface" else "FIELD")
            return self.mate[body] + 1
        if text in ("namespace", "module") and self.is_id(i + 1):
            body = i + 2
            while self.text(body) == "." and self.is_id(body + 1):
                body += 2
            if self.text(body) != "{":
                return None
            parts = tuple(self.name(k) for k in range(i + 1, body, 2))
            self.walk(body + 1, self.mate[body], Frame((*f.scope, ".".join(parts)), f.callable, False))
            return self.mate[body] + 1
        if text == "type" and self.is_id(i + 1) and self.text(self.angles(i + 2, j)) == "=":
            end = self.ends(i + 2, j)
            self.symbol(i + 1, "TYPE_ALIAS", f, first, end)
            return end
        if text == "function":
            at = i + 1 + (nxt == "*")
            if not self.is_id(at):
                return None
            return self.js_callable(at, at + 1, j, f, "FUNCTION", first)
        if text in ("const", "let", "var") and nxt != "enum" and (self.is_id(i + 1) or nxt in ("{", "[")):
            return self.js_bindings(i, j, f)
        if nxt == "(" and text not in NO_CALL["JS"] and self.text(self.mate[i + 1] + 1) == "{" and self.text(i - 1) in ("{", ",", "async", "get", "set", "*"):
            return self.js_callable(i, i + 1, j, f, "METHOD", i)
        return None

    def js_callable(self, at: int, after: int, j: int, f: Frame, kind: str, first: int) -> int:
        """A function or method named at ``at``: with a body, or a signature that ends its statement."""
        params = self.angles(after, j)
        k = self.mate[params] + 1
        if self.text(k) == ":":  # a return type may be an object type
            k = self.find(k + 1, j, "{", ";", ",")
            stop = self.ends(params, j)
            k = min(k, stop)
            if self.text(k) == "{" and self.text(self.mate[k] + 1) == "{":
                k = self.mate[k] + 1
        last = self.mate[k] + 1 if self.text(k) == "{" else self.ends(params, j)
        g = self.symbol(at, kind, f, first, last)
        self.walk(params, last, g._replace(member=False))
        return max(last, at + 1)

    def js_members(self, i: int, j: int, f: Frame, kind: str = "FIELD") -> None:
        while i < j:
            if self.text(i) in (";", ","):
                i += 1
                continue
            if self.text(i) == "@":
                at = i + 1
                while self.text(at + 1) == "." and self.is_id(at + 2):
                    at += 2
                end = self.mate[at + 1] + 1 if self.text(at + 1) == "(" else at + 1
                self.walk(i + 1, end, f)
                i = end
                continue
            at = i
            while (self.text(at) in JS_MODIFIERS and (self.is_id(at + 1) or self.text(at + 1) in ("[", "*", "{") or self.t[min(at + 1, j - 1)].kind == "str")) or self.text(at) == "*":
                at += 1
            named = self.is_id(at)
            after = self.mate[at] + 1 if self.text(at) == "[" else at + 1
            after += self.text(after) in ("?", "!")
            if named and self.text(self.angles(after, j)) == "(":
                i = self.js_callable(at, after, j, f, "METHOD", i)
                continue
            end = self.ends(after, j) if at < j else j
            end = self.mate[at] + 1 if self.text(at) == "{" else max(end, at + 1)
            g = self.symbol(at, kind, f, i, end) if named else f
            self.walk(at + named, end, g._replace(member=False))
            i = end

    def js_bindings(self, i: int, j: int, f: Frame) -> int:
        """Declarators of one statement; one whose value is a function or class is one."""
        end = self.ends(i + 1, j)
        found, at = [], i + 1
        while at < end:
            stop = self.find(at, end, ",", ";")
            eq = self.find(at, stop, "=")
            if self.is_id(at) and self.text(at + 1) not in ("of", "in"):
                found.append((at, self.js_value(eq + 1, stop) if eq < stop else "CONSTANT", eq, stop))
            else:
                found.append((None, "", eq, stop))
            at = stop + 1
        frames = [f if at is None or (kind == "CONSTANT" and f.callable) else self.symbol(at, kind, f, i, end) for at, kind, _, _ in found]
        for (at, kind, eq, stop), g in zip(found, frames, strict=True):
            g = g if sum(x is not f for x in frames) == 1 else f
            body = self.find(eq + 1, stop, "{")
            if kind == "CLASS" and body < stop:
                self.walk(eq + 1, body, g)
                self.js_members(body + 1, self.mate[body], g)
            else:
                self.walk(eq if at is not None else i + 1, stop, g._replace(member=False))
        return end

    def js_value(self, v: int, stop: int) -> str:
        v += self.text(v) == "async" and self.text(v + 1) != "=>"
        if self.text(v) in ("function", "class"):
            return {"function": "FUNCTION", "class": "CLASS"}[self.text(v)]
        v = self.angles(v, stop)
        if self.text(v) == "(":
            k = self.mate[v] + 1
            if self.text(k) == ":":
                k = self.find(k, stop, "=>")
            return "FUNCTION" if self.text(k) == "=>" else "CONSTANT"
        return "FUNCTION" if self.is_id(v) and self.text(v + 1) == "=>" else "CONSTANT"

    def js_import(self, i: int, j: int) -> int | None:
        k = i + 1
        while k < j and self.t[k].kind != "str" and self.text(k) not in (";", "="):
            k += 1
        if k >= j or self.t[k].kind != "str":
            return None
        path, at = self.text(k)[1:-1], i + 1
        if at == k:
            self.imported("", path, "MODULE", i, k)
        at += self.text(at) == "type" and self.text(at + 1) not in ("from", ",")
        while at < k and self.text(at) != "from":
            if self.text(at) == "*":
                self.imported(self.text(at + 2), path, "MODULE", i, k)
                at += 3
            elif self.text(at) == "{":
                x = at + 1
                while x < self.mate[at]:
                    end = self.find(x, self.mate[at], ",")
                    x += self.text(x) == "type" and end - x in (2, 4)
                    if end > x:
                        self.imported(self.text(end - 1), f"{path}:{self.text(x)}", "MEMBER", i, k)
                    x = end + 1
                at = self.mate[at] + 1
            else:
                if self.is_id(at):
                    self.imported(self.text(at), f"{path}:default", "MEMBER", i, k)
                at += 1
        return k + 1

    # declarations of C#

    def csharp(self, i: int, j: int, f: Frame, in_type: bool) -> None:
        while i < j:
            if self.text(i) in (";", "}", ","):
                i += 1
                continue
            first = i
            while self.text(i) == "[" and i < j:
                self.bodies(i + 1, self.mate[i], f)
                i = self.mate[i] + 1
            end = self.find(i, j, "{", ";", "=>", "=")
            words = [self.text(k) for k in range(i, end) if self.is_id(k)]
            kind = next((k for k in range(i, end) if self.is_id(k) and self.text(k) in CSHARP_TYPES and self.is_id(k + 1) and self.text(k - 1) not in (":", ",", "where")), None)
            if words[:1] == ["using"] or words[:2] == ["global", "using"]:
                end = self.find(i, j, ";")
                if not in_type and self.text(i + 1) != "(" and self.text(i + 1) != "var":
                    self.csharp_using(i, end)
                i = end + 1
            elif words[:1] == ["namespace"]:
                scope = (*f.scope, "".join(self.text(k) for k in range(i + 1, end)))
                if self.text(end) == "{":
                    self.csharp(end + 1, self.mate[end], Frame(scope), False)
                    i = self.mate[end] + 1
                else:
                    f, i = Frame(scope), end + 1
            elif "delegate" in words or "event" in words or "operator" in words:
                i = self.csharp_after(end, j, f)
            elif kind is not None and not any(self.text(k) == "(" for k in range(i, kind)):
                at = kind + 1 + (self.text(kind) == "record" and self.text(kind + 1) in ("struct", "class"))
                body = self.text(end) == "{"
                last = self.mate[end] + 1 if body else end + 1
                g = self.symbol(at, CSHARP_TYPES[self.text(kind)], f, first, last)
                self.bodies(at + 1, end, g)
                if body and self.text(kind) != "enum":
                    self.csharp(end + 1, self.mate[end], g, True)
                i = last
            elif in_type:
                i = self.csharp_member(first, i, end, j, f, words)
            else:
                last = self.csharp_after(end, j, f, at=i)
                i = max(last, i + 1)

    def bodies(self, i: int, j: int, f: Frame) -> None:
        for k in range(i, j):
            self.evidence(k, f)

    def csharp_after(self, end: int, j: int, f: Frame, at: int | None = None) -> int:
        """Past a block, or past a statement's semicolon; its calls are seen."""
        if self.text(end) == "{":
            last = self.mate[end] + 1
        else:
            last = self.find(end, j, ";") + 1
        self.bodies(end if at is None else at, min(last, j), f)
        return last

    def csharp_using(self, i: int, end: int) -> None:
        at = i + 1 + (self.text(i) == "global")
        at += self.text(at) == "static"
        alias = self.text(at) if self.text(at + 1) == "=" else ""
        at += 2 if alias else 0
        path = "".join(self.text(k) for k in range(at, end))
        if path:
            self.imported(alias or path.rpartition(".")[2], path, "MODULE", i, end - 1)

    def csharp_member(self, first: int, i: int, end: int, j: int, f: Frame, words: list[str]) -> int:
        k, params = i, None
        while k < end:
            if self.text(k) == "(":
                before = k - 1
                if self.text(before) == ">":
                    depth = 0
                    while before > i:
                        depth += (self.text(before) == ">") - (self.text(before) == "<")
                        before -= 1
                        if depth == 0:
                            break
                if before >= i and self.is_id(before) and self.text(before) not in CSHARP_WORDS:
                    params = (before, k)
                    break
            k = self.mate[k] + 1
        if params is not None:
            end = self.find(self.mate[params[1]] + 1, j, "{", ";", "=>")
            last = self.mate[end] + 1 if self.text(end) == "{" else self.find(end, j, ";") + 1
            g = self.symbol(params[0], "METHOD", f, first, last)
            self.bodies(params[1], min(last, j), g)
            return last
        if self.text(end) in ("{", "=>"):
            last = self.mate[end] + 1 if self.text(end) == "{" else self.find(end, j, ";") + 1
            if self.text(end) == "{" and self.text(last) == "=":
                last = self.find(last, j, ";") + 1
            indexer = "this" in words
            g = f if indexer or not self.is_id(end - 1) else self.symbol(end - 1, "PROPERTY", f, first, last)
            self.bodies(end, min(last, j), g)
            return max(last, i + 1)
        stop = self.find(i, j, ";")
        kind, at, names = "CONSTANT" if "const" in words else "FIELD", end, []
        while at <= stop:
            if self.is_id(at - 1):
                names.append(at - 1)
            comma = self.find(at, stop, ",")
            if comma >= stop:
                break
            at = comma + 2
        frames = [self.symbol(n, kind, f, first, stop + 1) for n in names if n >= i]
        self.bodies(end, stop, frames[0] if len(frames) == 1 else f)
        return stop + 1


_SCRIPT = re.compile(r"<script\b[^>]*>([\s\S]*?)</script\s*>", re.IGNORECASE)


def records(path: str, raw: bytes, language: str) -> list[tuple]:
    """Rows of one file as ``python_code.records`` gives them; CANDIDATE rows are calls that a macro may make."""
    src = raw.decode("latin-1")
    if language == "SVELTE":
        readers = [Reader(src, "JS", m.start(1), m.end(1)).read() for m in _SCRIPT.finditer(src)]
        state = "CONTAINER_ONLY"
    else:
        readers = [Reader(src, {"JAVASCRIPT": "JS", "TYPESCRIPT": "JS"}.get(language, language)).read()]
        state = "COMPLETE" if readers[0].whole or path.lower().endswith(("jsx", "tsx")) else "PARTIAL"
    return [(path, "STATUS", "", "", state, 0, len(raw))] + [(path, *row) for r in readers for row in r.rows]
