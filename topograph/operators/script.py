"""Facts of TypeScript and JavaScript text.

A tokenizer (comments, strings, templates with their expressions, regular expressions) and matching brackets stand in for a syntax tree; declarations are recognised by
their keyword where a statement may start. Covered: ESM imports and re-exports, functions, classes with methods and heritage, interfaces, type aliases, variables, and calls.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<tick>`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<punct>=>|\?\.|\.\.\.|[-+*/%&|^!=<>?:]+(?<!=>)|.)", re.S
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
WORDS = frozenset(
    "if for while switch catch return typeof function new delete void in of instanceof do else try finally throw case default break continue await yield import export super with class extends".split()
)
EXPRESSION_BEFORE = frozenset(["=", "(", ",", "[", "?", ":", "=>", "return", "typeof", "new", "await", "yield", "!", "...", "in", "of", "extends", "+", "-", "*", "&&", "||", "??", "==", "===", "!=", "!==", "case", "throw", "delete", "void"])
CLOSING = {"(": ")", "[": "]", "{": "}"}
MEMBER_WORDS = frozenset("public private protected static async readonly abstract override declare".split())


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int
    first: bool  # on its line


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    _scan(text, 0, 1, out, False)
    return out


def _scan(text: str, at: int, line: int, out: list[Token], inner: bool) -> tuple[int, int]:
    """Tokens from at on; in a template's expression up to its closing brace."""
    depth, fresh = 0, True
    while at < len(text):
        m = TOKEN.match(text, at)
        kind, word = m.lastgroup, m[0]
        if kind == "punct" and word.startswith("/") and (not out or out[-1].text in EXPRESSION_BEFORE or out[-1].text in ("{", "}", ";")) and (r := REGEX.match(text, at)):
            kind, word = "regex", r[0]
        elif kind == "punct" and len(word) > 1 and word not in ("=>", "?.", "...") and "/" in word[1:]:
            word = word[: word.index("/", 1)]
        if kind == "tick":
            at, line = _template(text, at + 1, line, out, fresh)
            fresh = False
            continue
        at += len(word)
        if kind in ("space", "comment"):
            fresh = fresh or "\n" in word
        else:
            if inner and word == "}" and depth == 0:
                return at, line
            depth += (word == "{") - (word == "}")
            out.append(Token("name" if kind == "name" else kind, word, line, fresh))
            fresh = False
        line += word.count("\n")
    return at, line


def _template(text: str, at: int, line: int, out: list[Token], fresh: bool) -> tuple[int, int]:
    out.append(Token("string", "`", line, fresh))
    while at < len(text):
        if text[at] == "`":
            return at + 1, line
        if text[at] == "\\":
            line += text[at : at + 2].count("\n")
            at += 2
        elif text.startswith("${", at):
            out.append(Token("punct", "${", line, False))
            at, line = _scan(text, at + 2, line, out, True)
            out.append(Token("punct", "}$", line, False))
        else:
            line += text[at] == "\n"
            at += 1
    return at, line


class Reader:
    def __init__(self, text: str, facts) -> None:
        self.t, self.facts = tokens(text), facts
        self.partner: dict[int, int] = {}
        open_: list[int] = []
        for i, x in enumerate(self.t):
            if x.text in CLOSING:
                open_.append(i)
            elif x.text in (")", "]", "}") and open_:
                while open_ and CLOSING[self.t[open_[-1]].text] != x.text:
                    open_.pop()
                if open_:
                    self.partner[open_[-1]] = i
                    open_.pop()
        self.functions: list[tuple[str, int, int]] = []

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def find(self, i: int, *wanted: str) -> int:
        """The next of the wanted tokens at this depth, or the end."""
        while i < len(self.t) and self.t[i].text not in wanted:
            i = self.partner.get(i, i) + 1
        return i

    def statement(self, i: int) -> bool:
        """Whether a declaration may start here."""
        p = self.text(i - 1)
        while p in ("export", "default", "async", "declare", "abstract"):
            i -= 1
            p = self.text(i - 1)
        return p not in EXPRESSION_BEFORE and p != "."

    def add(self, name: str, kind: str, start: int, end: int, parent: str | None = None) -> str:
        end = min(end, len(self.t) - 1)
        return self.facts.symbol(name, kind, self.t[start].line, self.t[end].line, parent)

    def read(self) -> None:
        for i, x in enumerate(self.t):
            if x.kind != "name" or self.text(i - 1) == ".":
                continue
            word = x.text
            if word == "import" and self.text(i + 1) not in ("(", "."):
                self.imports(i)
            elif word == "export" and self.text(i + 1) in ("*", "{", "type"):
                self.reexports(i)
            elif word == "function" and self.statement(i):
                self.function(i)
            elif word == "class" and self.is_name(i + 1) and self.statement(i):
                self.class_(i)
            elif word == "interface" and self.is_name(i + 1) and self.statement(i) and self.text(i + 2) in ("{", "extends", "<"):
                self.interface(i)
            elif word == "type" and self.is_name(i + 1) and self.statement(i) and self.text(i + 2) in ("=", "<"):
                self.add(self.text(i + 1), "type", i, self.expression_end(self.find(i + 2, "=", ";") + 1))
            elif word in ("const", "let", "var") and self.text(i - 1) != "(" and self.text(i + 1) != "enum":
                self.variables(i)
        for local, start, end in self.functions:
            self.calls(local, start, end)

    def imports(self, i: int) -> None:
        end = i + 1
        while end < len(self.t) and self.t[end].kind != "string" and self.text(end) != ";":
            end = self.partner.get(end, end) + 1
        if end >= len(self.t) or self.t[end].kind != "string":
            return
        spec, j = self.t[end].text[1:-1], i + 1
        self.facts.add("import", specifier=spec)
        if self.text(j) == "type" and self.text(j + 1) != "from" and self.text(j + 1) != ",":
            j += 1
        while j < end and self.text(j) != "from":
            if self.text(j) == "{":
                self.names(j, spec)
                j = self.partner.get(j, j)
            elif self.text(j) == "*" and self.text(j + 1) == "as":
                self.facts.add("binding", specifier=spec, imported_name="*", local_name=self.text(j + 2), is_namespace=True)
                j += 2
            elif self.is_name(j):
                self.facts.add("binding", specifier=spec, imported_name="default", local_name=self.text(j), is_namespace=False)
            j += 1

    def names(self, open_: int, spec: str) -> None:
        j, end = open_ + 1, self.partner.get(open_, open_)
        while j < end:
            if self.text(j) == "type" and self.is_name(j + 1) and self.text(j + 1) != "as":
                j += 1
            if self.is_name(j):
                renamed = self.text(j + 1) == "as"
                self.facts.add("binding", specifier=spec, imported_name=self.text(j), local_name=self.text(j + 2) if renamed else self.text(j), is_namespace=False)
                j += 2 * renamed
            j += 1

    def reexports(self, i: int) -> None:
        j = i + 1 + (self.text(i + 1) == "type")
        open_ = j if self.text(j) == "{" else None
        if self.text(j) not in ("*", "{"):
            return
        j = self.partner.get(j, j) + 1
        if self.text(j) == "as":
            j += 2
        if self.text(j) == "from" and j + 1 < len(self.t) and self.t[j + 1].kind == "string":
            spec = self.t[j + 1].text[1:-1]
            self.facts.add("import", specifier=spec)
            if open_ is not None:
                self.names(open_, spec)

    def start(self, i: int) -> int:
        while self.text(i - 1) in ("export", "default", "async", "declare", "abstract"):
            i -= 1
        return i

    def function(self, i: int) -> None:
        name = i + 1 + (self.text(i + 1) == "*")
        if not self.is_name(name):
            return
        args = self.find(name + 1, "(")
        body = self.find(self.partner.get(args, args) + 1, "{", ";")
        if self.text(body - 1) == ":":  # a type literal, not the body
            body = self.find(self.partner.get(body, body) + 1, "{", ";")
        end = self.partner.get(body, body)
        start = self.start(i)
        self.functions.append((self.add(self.text(name), "function", start, end), name + 1, end))

    def heritage(self, i: int, body: int, name: str, kind: str) -> None:
        relation = None
        while i < body:
            word = self.text(i)
            if word == "<":
                i = self.angle(i)
            elif word in ("extends", "implements"):
                relation = word if kind == "class" else "extends"
                if self.is_name(i + 1) and self.text(i + 2) not in (".", "("):
                    self.facts.heritage(name, self.text(i + 1), relation)
            elif word == "," and relation and self.is_name(i + 1) and self.text(i + 2) not in (".", "("):
                self.facts.heritage(name, self.text(i + 1), relation)
            i = self.partner.get(i, i) + 1

    def angle(self, i: int) -> int:
        """The end of a list of type parameters."""
        depth = 0
        while i < len(self.t):
            word = self.text(i)
            depth += word.count("<") - (word.count(">") if word != "=>" else 0)
            if depth <= 0:
                return i
            i = self.partner.get(i, i) + 1
        return i

    def class_(self, i: int) -> None:
        name, body = self.text(i + 1), self.find(i + 2, "{")
        end = self.partner.get(body, len(self.t) - 1)
        self.add(name, "class", self.start(i), end)
        own = self.facts.last[name]
        self.heritage(i + 2, body, own, "class")
        j = body + 1
        while j < end:
            first = j
            while self.text(j) in MEMBER_WORDS and self.text(j + 1) not in ("(", "=", ":", ";"):
                j += 1
            if self.text(j) == "@":
                j += 2
                while self.text(j) == ".":
                    j += 2
                j = self.partner.get(j, j - 1) + 1 if self.text(j) == "(" else j
                continue
            if self.text(j) in ("get", "set") and self.is_name(j + 1):
                j = self.member_end(j, end)
                continue
            star = self.text(j) == "*"
            j += star
            args = j + 1
            if self.text(args) in ("?", "!"):
                args += 1
            if self.text(args) == "<":
                args = self.angle(args) + 1
            if self.is_name(j) and self.text(args) == "(" and self.text(j) != "constructor":
                short, stop = self.text(j), self.member_end(args, end)
                local = self.add(f"{name}.{short}", "function", first, stop - 1, name)
                if short not in self.facts.last:
                    self.facts.add("alias", name=short, parent=local)
                    self.facts.last[short] = local
                self.functions.append((local, args, stop))
                j = stop
            else:
                j = self.member_end(j, end)

    def member_end(self, j: int, end: int) -> int:
        """Behind the member's body, semicolon or line."""
        while j < end:
            word = self.text(j)
            if word == ";":
                return j + 1
            if word == "{" and self.text(j - 1) not in ("=", ":", "(", ",", "=>", "?", "|", "&"):
                return self.partner.get(j, j) + 1
            j = self.partner.get(j, j) + 1
            if j < end and self.t[j].first and self.text(j) not in (".", "?", ":", "=", "=>", "|", "&", "(", "{") and self.text(j - 1) not in ("=", "=>", ",", "|", "&", ":", "?", "+", "."):
                return j
        return end

    def interface(self, i: int) -> None:
        name, body = self.text(i + 1), self.find(i + 2, "{")
        self.add(name, "interface", self.start(i), self.partner.get(body, body))
        self.heritage(i + 2, body, self.facts.last[name], "interface")

    def expression_end(self, j: int) -> int:
        """The last token of an expression."""
        last = j
        while j < len(self.t):
            word = self.text(j)
            if word in (",", ";", ")", "]", "}", "}$"):
                return last
            if j > last and self.t[j].first and not self.goes_on(j):
                return last
            last = self.partner.get(j, j)
            j = last + 1
        return last

    def goes_on(self, j: int) -> bool:
        before, here = self.t[j - 1], self.t[j]
        return (before.kind == "punct" and before.text not in (")", "]", "}", "!")) or (here.kind == "punct" and here.text not in ("{", "@", "}")) or here.text in ("as", "satisfies", "instanceof", "in")

    def variables(self, i: int) -> None:
        j = i + 1
        while self.is_name(j) or self.text(j) in ("{", "["):
            name = j if self.is_name(j) else None
            j = self.partner.get(j, j) + 1
            if self.text(j) == "!":
                j += 1
            if self.text(j) == ":":
                j += 1
                while j < len(self.t) and self.text(j) not in ("=", ",", ";") and not (self.t[j].first and not self.goes_on(j)):
                    j = self.angle(j) + 1 if self.text(j) == "<" else self.partner.get(j, j) + 1
            end, is_function, begin = j - 1, False, j
            if self.text(j) == "=":
                begin, end = j + 1, self.expression_end(j + 1)
                is_function = self.is_function(begin)
            elif self.text(j) in ("of", "in"):
                return
            if name is not None:
                local = self.add(self.text(name), "function" if is_function else "variable", name, end)
                if is_function:
                    self.functions.append((local, begin, end))
            j = end + 1
            if self.text(j) != ",":
                return
            j += 1

    def is_function(self, j: int) -> bool:
        if self.text(j) == "async" and not self.t[min(j + 1, len(self.t) - 1)].first:
            j += 1
        if self.text(j) == "function":
            return True
        if self.is_name(j):
            return self.text(j + 1) == "=>"
        if self.text(j) == "<":
            j = self.angle(j) + 1
        if self.text(j) != "(":
            return False
        j = self.partner.get(j, j) + 1
        if self.text(j) == ":":
            j += 1
            while j < len(self.t) and self.text(j) not in ("=>", ";", ","):
                j = self.angle(j) + 1 if self.text(j) == "<" else self.partner.get(j, j) + 1
        return self.text(j) == "=>"

    def calls(self, local: str, start: int, end: int) -> None:
        for i in range(start, min(end + 1, len(self.t))):
            x = self.t[i]
            if x.kind != "name" or x.text in WORDS:
                continue
            at = i + 1
            if self.text(at) == "?.":
                at += 1
            elif self.text(at) == "<":
                close = self.angle(at)
                if close < len(self.t) and all(self.t[k].kind == "name" or self.text(k) in ("<", ">", ">>", ",", "[", "]", "|", "&", ".") for k in range(at, close + 1)):
                    at = close + 1
            if self.text(at) != "(" or self.text(i - 1) in ("function", "new", "class", "interface"):
                continue
            before = self.text(i - 1)
            if x.text == "async" and self.text(self.partner.get(at, at) + 1) in ("=>", ":"):
                continue  # an arrow function
            if self.text(self.partner.get(at, at) + 1) == "{" and before not in (".", "?."):
                continue  # a method of an object or class
            if before in (".", "?."):
                if self.text(i - 2) == "this" or (self.is_name(i - 2) and self.text(i - 3) not in (".", "?.") and self.text(i - 2) not in WORDS):
                    obj = self.text(i - 2)
                    if self.text(i - 3) == "new":
                        obj = None
                    self.facts.call(local, x.text, None if obj == "this" else obj)
                else:
                    self.facts.call(local, x.text)
            else:
                self.facts.call(local, x.text)


def read(text: str, facts) -> None:
    Reader(text, facts).read()
