"""Functions of one source, with their syntax metrics.

No grammar is at hand, so this is a structural parser over tokens: it finds functions, their
nesting and the constructs in them, and rejects sources whose brackets, strings or function
headers don't close, in which an operator lacks an operand, a declaration its name, or two names
stand side by side. Complete syntax validation is beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import xxhash

from .lexer import SyntaxProblem, Token, tokens
from .spec import BY_NAME, LanguageSpec

_ASSIGN = ("=",)
_AUGMENTED = ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "&&=", "||=", "??=")
_SEPARATORS = frozenset(",;?:") | {"=>", "=", "return", "let", "const", "var", "if", "while", "else", "match", "case", "in", "of", *_AUGMENTED}
_OPEN, _CLOSE = ("(", "[", "{"), (")", "]", "}")
#: Marks that need an operand on their right, and those that can't be its beginning.
_BINARY = frozenset(("=", "==", "===", "!=", "!==", "&&", "||", "??", "+", "-", "/", "%", ">=", "<=", *_AUGMENTED))
_NO_OPERAND = frozenset((";", ")", "]", "}", ",", "=", "==", "===", "!=", "!==", "??", "/", "%", ">=", "<=", *_AUGMENTED))
#: Words that are names in places and may stand before a name.
_SOFT = frozenset("accessor asserts auto global macro_rules module of out override raw require safe satisfies union unique using target meta".split())
_MODIFIERS = ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "accessor", "declare", "*", "#")


@dataclass
class Function:
    """One function: its tokens and what is counted in them."""

    name: str
    first: int  # token indices; the body is what follows the signature
    body: int
    last: int
    exported: bool = False
    test_entry: bool = False
    doc_bytes: int = 0
    cyclomatic: int = 1
    cognitive: int = 0
    nesting: int = 0
    statements: int = 0
    identifiers: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)


class Parser:
    def __init__(self, source: str, spec: LanguageSpec):
        self.source, self.spec = source, spec
        every = tokens(source, spec.name)
        self.comments = [t for t in every if t.kind == "comment"]
        self.t = [t for t in every if t.kind not in ("comment", "line")]
        self.lines = [t for t in every if t.kind == "line"]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "mark" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "mark" and t.text in _CLOSE:
                o = stack.pop()
                self.match[o], self.match[i] = i, o
        self.starts: dict[int, Function] = {}
        self.functions: list[Function] = []
        self.classes: set[int] = set()
        self.tails: set[int] = set()
        self._find_tails()

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind != "string" else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word"

    def ident(self, i: int) -> bool:
        return self.word(i) and self.t[i].text not in self.spec.keywords

    def run(self) -> list[Function]:
        self._check()
        find = {"c": self._find_c, "rust": self._find_rust}.get(self.spec.name, self._find_script)
        find()
        for f in sorted(self.starts.values(), key=lambda f: (f.first, -f.last)):
            self.functions.append(f)
        inside = {f.first: f for f in self.functions}
        for f in self.functions:
            self._measure(f, inside)
        return self.functions

    # what can't be a source of the language

    def _check(self) -> None:
        """Raises on operators without operands, declarations without names, and names side by side."""
        name = self.spec.name
        if name == "tsx":  # text between tags looks like anything
            return
        i, n = 0, len(self.t)
        while i < n:
            t, x = self.t[i], self.text(i)
            if name == "rust" and x == "!" and self.word(i - 1) and (self.text(i + 1) in _OPEN or (self.word(i + 1) and self.text(i + 2) in _OPEN)):
                i = self.match[i + 1 if self.text(i + 1) in _OPEN else i + 2] + 1  # a macro's tokens are its own
                continue
            if name == "rust" and x == "#" and self.text(i + 1) == "[":
                i = self.match[i + 1] + 1
                continue
            row = f"on line {t.row + 1}"
            after = self.text(i + 1)
            if t.kind == "mark" and x in _BINARY and self.text(i - 1) != "operator":
                alone = i + 1 >= n or (after in _NO_OPERAND and self.t[i + 1].kind == "mark")
                if alone and not (name == "rust" and (x in ("&&", "||", "+", "-") or self.text(i - 1) == ".")):
                    raise SyntaxProblem(f"'{x}' has no right operand {row}")
            if t.kind == "word" and self.text(i - 1) not in (".", "?."):
                declares = x in ("const", "var") if name == "ts" else x == "let" if name == "rust" else x in ("int", "char", "float", "double", "long", "short")
                if declares and after in ("=", ";") and not (name == "c" and after == ";") and (name != "ts" or x != "const" or self.text(i - 1) not in ("as", "<")):
                    raise SyntaxProblem(f"a declaration has no name {row}")
                if name == "ts" and x == "let" and after == "=" and self.text(i - 1) in ("", ";", "{", "}"):
                    raise SyntaxProblem(f"a declaration has no name {row}")
                if name != "c" and self.ident(i) and self.ident(i + 1) and self.t[i + 1].row == t.row and not {x, after} & _SOFT:
                    raise SyntaxProblem(f"'{x}' and '{after}' stand side by side {row}")
            i += 1

    # where functions begin and end

    def _add(self, name: str, first: int, body: int, last: int, **more) -> None:
        self.starts[first] = Function(name, first, body, last, **more)

    def _find_c(self) -> None:
        i, n, begin = 0, len(self.t), 0
        while i < n:
            x = self.text(i)
            if x in (";", "}"):
                begin = i + 1
            elif x == "{":
                close = i - 1
                while self.text(close) == ")" and self.text(self.match[close] - 1) == "__attribute__":
                    close = self.match[close] - 2
                if self.text(close) == ")" and "=" not in (self.text(k) for k in range(begin, self.match[close])):
                    o = self.match[close]
                    # the name is the declarator's own: not one behind a pointer, nor in a declarator that returns a function
                    direct = self.ident(o - 1) and self.text(o - 2) != "*"
                    self._add(self.text(o - 1) if direct else "<anonymous>", begin, i, self.match[i], doc_bytes=self._doc(begin))
                    i = self.match[i]
                    begin = i + 1
                elif i and self.t[i - 1].kind == "string":  # extern "C" {
                    begin = i + 1
                else:  # members, enumerators or values; what follows may still be a function's result type
                    i = self.match[i]
            i += 1

    def _find_rust(self) -> None:
        public: list[tuple[int, int]] = []
        traits: list[tuple[int, int, bool]] = []
        for i, t in enumerate(self.t):
            if t.kind != "word":
                continue
            if t.text in ("impl", "mod", "trait", "fn") and (t.text != "impl" or self.text(i - 1) in ("", "}", ";", "{", "]", "unsafe", "default")):
                brace = self._body(i)
                if brace is None:
                    continue
                first = i
                while self.text(first - 1) in ("pub", "async", "unsafe", "const", "extern", "default", ")") or (first and self.t[first - 1].kind == "string" and self.text(first - 2) == "extern"):
                    if self.text(first - 1) == ")":
                        o = self.match[first - 1]
                        if self.text(o - 1) != "pub":
                            break
                        first = o
                    else:
                        first -= 1
                pub = self.text(first) == "pub"
                last = self.match[brace]
                if pub:
                    public.append((first, last))
                if t.text == "impl":
                    traits.append((i, last, any(self.text(k) == "for" and self.text(k + 1) != "<" for k in range(i, brace))))
                if t.text == "fn":
                    if not self.ident(i + 1) or self.text(i + 2) not in ("(", "<"):
                        raise SyntaxProblem("a function has no parameters")
                    around = [x for a, b, x in traits if a < i < b]
                    exported = any(a <= first <= b for a, b in public) or bool(around and around[-1])
                    self._add(self.text(i + 1), first, brace, last, exported=exported, test_entry=self._tested(first))

    def _body(self, i: int) -> int | None:
        """The brace that opens the item's body; None for a declaration."""
        k = i + 1
        while k < len(self.t):
            x = self.text(k)
            if x in ("(", "["):
                k = self.match[k]
            elif x == "{":
                return k
            elif x in (";", "}"):
                return None
            k += 1
        return None

    def _tested(self, first: int) -> bool:
        k = first - 1
        while self.text(k) == "]" and self.text(self.match[k] - 1) == "#":
            o = self.match[k]
            a = self.source[self.t[o - 1].start : self.t[k].end].strip()
            if a == "#[test]" or a.endswith("::test]") or "::test(" in a or a.startswith("#[test("):
                return True
            k = o - 2
        return False

    def _find_script(self) -> None:
        exports: list[tuple[int, int]] = []
        for i, t in enumerate(self.t):
            if t.kind == "word" and t.text == "export" and self.text(i - 1) != ".":
                exports.append((i, self._statement_end(i + 1)))
        self.exports = exports
        for i, t in enumerate(self.t):
            if t.kind == "word" and t.text == "class" and self.text(i - 1) != "." and (self.word(i + 1) or self.text(i + 1) in ("{", "<")):
                brace = self._class_body(i)
                if brace is not None:
                    self.classes.add(brace)
        for i, t in enumerate(self.t):
            if t.text == "function" and t.kind == "word" and self.text(i - 1) != ".":
                if self.text(i + 1) == "*":
                    continue
                k = i + 1
                name = ""
                if self.word(k):
                    name, k = self.text(k), k + 1
                self._with_body(i - 1 if self.text(i - 1) == "async" else i, self._type_arguments(k), name, need=True, declared=bool(name))
            elif t.text == "=>" and t.kind == "mark":
                self._arrow(i)
            elif t.text == "(" and t.kind == "mark":
                self._method(i)

    def _class_body(self, i: int) -> int | None:
        """The brace of a class; those in type arguments of its header aren't."""
        k, depth = i + 1, 0
        while k < len(self.t):
            x = self.text(k)
            if x in ("(", "[") or (x == "{" and depth > 0):
                k = self.match[k]
            elif x == "{":
                return k
            elif x in (";", ")", "]", "}") and not depth:
                return None
            depth += (x == "<") - (x == ">")
            k += 1
        return None

    def _type_arguments(self, k: int) -> int:
        if self.text(k) == "<":
            depth = 0
            while k < len(self.t):
                depth += (self.text(k) == "<") - (self.text(k) == ">")
                k += 1
                if not depth:
                    break
        return k

    def _with_body(self, first: int, paren: int, name: str, need: bool, declared: bool = False) -> bool:
        if self.text(paren) != "(":
            raise SyntaxProblem("a function has no parameters")
        k = self.match[paren] + 1
        if self.text(k) == ":":  # a result type, possibly with braces of its own
            k += 1
            while k < len(self.t) and self.text(k) not in (";", "}"):
                if self.text(k) == "{" and self.text(k - 1) not in (":", "|", "&", "<", ",", "=>"):
                    break
                k = self.match[k] + 1 if self.text(k) in _OPEN else k + 1
        if self.text(k) != "{":
            if need and self.text(k) not in (";", "", "function", "export", "}"):
                raise SyntaxProblem("a function has no body")
            return False
        alone = self.text(first - 1) in ("", "}", ";", "{", ")") if declared else False
        self._add(name or self._bound_name(first), first, k, self.match[k], exported=self._exported(first), doc_bytes=self._doc(first) if alone else 0)
        return True

    def _method(self, paren: int) -> None:
        """A method of a class or an object: generic, private, computed, string-named and generator methods too; only plain names are kept."""
        close = self.match[paren] + 1
        if self.text(close) not in ("{", ":"):
            return
        at = self._before_type_arguments(paren - 1)
        if self.text(at) == "]" and self.t[at].kind == "mark":
            first = self.match[at]
        elif at >= 0 and self.t[at].kind in ("word", "string", "number"):
            first = at
        else:
            return
        name = self.text(at) if self.word(at) and self.text(at - 1) != "#" else "<anonymous>"
        if self.word(at) and self.text(at) in ("if", "for", "while", "switch", "catch", "function", "return", "with", "super") or self.text(first - 1) in (".", "?.", "new", "function"):
            return
        while self.text(first - 1) in _MODIFIERS:
            first -= 1
        before = self.text(first - 1)
        holder = self._holder(first)
        if holder is None or self.text(holder) != "{":
            return
        in_class = holder in self.classes
        in_object = not in_class and before in ("{", ",") and self.text(holder - 1) in ("=", "(", ",", ":", "return", "=>", "[", "default")
        fresh = before in ("{", "}", ";", ",") or self.t[first - 1].row < self.t[at].row
        decorated = before == ")" and self.text(self.match[first - 1] - 2) == "@" or self.text(first - 2) == "@"
        if (in_class and (fresh or decorated)) or in_object:
            self._with_body(first, paren, name, need=False, declared=True)

    def _before_type_arguments(self, k: int) -> int:
        """``k``, or the place before the type arguments that end at it."""
        if self.text(k) not in (">", ">="):
            return k
        depth = 0
        while k >= 0:
            x = self.text(k)
            if x in _CLOSE and self.t[k].kind == "mark":
                k = self.match[k]
            elif x in (";", "{", "("):
                return -1
            depth += (x == ">") - (x == "<")
            k -= 1
            if not depth:
                return k
        return -1

    def _holder(self, i: int) -> int | None:
        k = i - 1
        while k >= 0:
            if self.text(k) in _CLOSE and self.t[k].kind == "mark":
                k = self.match[k]
            elif self.text(k) in _OPEN and self.t[k].kind == "mark":
                return k
            k -= 1
        return None

    def _arrow(self, i: int) -> None:
        k = i - 1
        if self.word(k) and self.text(k - 1) not in (":", "|", "&"):
            first, name = k, self.text(k)
        else:
            while k >= 0 and self.text(k) != ")":  # back over a result type
                if self.text(k) in (";", "{", "=", ",") and self.text(k) != "}":
                    return
                k = self.match[k] - 1 if self.text(k) in _CLOSE else k - 1
            if k < 0:
                return
            first, name = self.match[k], ""
        if self.text(first - 1) == "async":
            first -= 1
        if self.text(i + 1) == "{":
            body, last = i + 1, self.match[i + 1]
        else:
            body = last = i + 1
            while last < len(self.t) and self.text(last) not in (",", ";", ")", "]", "}"):
                if self.text(last) in _OPEN:
                    last = self.match[last]
                elif last > body and self.t[last].row > self.t[last - 1].row and self.word(last) and self.text(last - 1) not in ("=>", "&&", "||", "?", ":", "+", ".", "="):
                    break
                last += 1
            last -= 1
            if last < body:
                raise SyntaxProblem("an arrow has no body")
            if not name and body == last and self.ident(body):
                name = self.text(body)
        if self.text(first - 1) == ":" and self.text(first - 2) != ")" and not name and self._in_type(first):
            return
        self._add(name or self._bound_name(first), first, body, last, exported=self._exported(first))

    def _in_type(self, first: int) -> bool:
        """Whether ``: (…) => T`` annotates a name, as in a parameter list or a declaration."""
        return self.word(first - 2) and self.text(first - 3) in ("(", ",", "let", "const", "var", "readonly", ";", "{") and self.text(self._holder(first) or -1) != "{"

    def _bound_name(self, first: int) -> str:
        k = first - 1
        if self.text(k) == "=":
            e = k - 1
            if self.text(e) not in (";", "}"):
                b = e
                while b > 0 and self.text(b - 1) not in (";", "{", "}", ",", "(", "let", "const", "var", "readonly", "static", "private", "public", "protected") and self.t[b].row == self.t[b - 1].row:
                    b -= 1
                if self.text(b - 1) in ("let", "const", "var") or self._class_field(b):
                    return self.text(b) if self.word(b) else "<anonymous>"
                return self.source[self.t[b].start : self.t[e].end].split(":")[0].strip()
        return "<anonymous>"

    def _class_field(self, i: int) -> bool:
        return self._holder(i) in self.classes

    def _exported(self, first: int) -> bool:
        return any(a < first <= b for a, b in self.exports) or (self.text(first - 1) == "=" and self._class_field(first - 2))

    def _statement_end(self, i: int) -> int:
        k = i
        while k < len(self.t):
            if self.text(k) in _OPEN:
                brace = self.text(k) == "{"
                k = self.match[k]
                if brace and self.text(k + 1) not in (".", "(", ",", ")", "from", "=", "=>"):
                    return k
            elif self.text(k) == ";":
                return k
            k += 1
        return len(self.t) - 1

    def _doc(self, first: int) -> int:
        """Bytes of the documentation comment right before a token; only where the grammar makes it the sibling."""
        if not self.spec.comments_document or first >= len(self.t) or self.text(first - 1) in ("export", "default"):
            return 0
        low, high = (self.t[first - 1].end if first else 0), self.t[first].start
        if any(low <= x.start < high for x in self.lines):
            return 0
        near = [c for c in self.comments if low <= c.start < high]
        if not near:
            return 0
        text = near[-1].text.strip()
        if near[-1].row + near[-1].text.count("\n") + 1 < self.t[first].row:
            return 0
        return len(text.encode()) if text.startswith(("///", "/**", "//!", "/*!")) else 0

    # what is counted

    def _measure(self, f: Function, inside: dict[int, Function]) -> None:
        """Counts the function's tokens. An explicit list of parts replaces recursion; a part is at one bracket level and one depth."""
        todo = [(f.first, f.last + 1, 0, "expression")]
        while todo:
            self._part(f, inside, todo, *todo.pop())

    def _part(self, f: Function, inside: dict[int, Function], todo: list, i: int, end: int, depth: int, kind: str) -> None:
        """``kind``: statements, an expression, or a construct, which is a condition and then statements."""
        f.nesting = max(f.nesting, depth)
        operators: list[str] = []
        k = i
        fresh = kind == "statements" or (kind == "construct" and self.text(i) != "(")  # at the beginning of a statement
        while k < end:
            inner = inside.get(k)
            if inner is not None and inner is not f:
                k = inner.last + 1
                fresh = False
                continue
            t, x = self.t[k], self.text(k)
            if t.kind == "word" and x not in self.spec.keywords and not (self.text(k - 1) == "#" and self.spec.name in ("ts", "tsx")):
                f.identifiers.append(x)
                self._path(f, k)
            if x in _SEPARATORS or x in ("{", "}"):
                self._logic(f, operators)
                operators = []
            stop = self._construct(f, k, end, depth, todo) if t.kind in ("word", "mark") else None
            self._statement(f, k, fresh)
            fresh = x in (";", "{", "}") or (t.kind == "mark" and x == "=>") or (t.kind == "word" and x in ("else", "do"))
            if stop is not None:
                k, fresh = stop, True
                continue
            if t.kind == "mark" and x in ("&&", "||") and not self._closure(k):
                operators.append(x)
            if t.kind == "mark" and x in _OPEN and self.match[k] < end:
                todo.append((k + 1, self.match[k], depth, "statements" if x == "{" else "expression"))
                fresh = x == "{" or (kind == "construct" and k == i)
                k = self.match[k] + 1
                continue
            k += 1
        self._logic(f, operators)

    def _closure(self, k: int) -> bool:
        return self.spec.name == "rust" and self.text(k) == "||" and self.text(k - 1) in ("(", ",", "=", "return", "{", ";", "move", "=>", "")

    @staticmethod
    def _logic(f: Function, operators: list[str]) -> None:
        """A chain costs one, and each run of ``&&`` within a chain of ``||`` one more."""
        if not operators:
            return
        if "||" not in operators:
            f.cognitive += 1
            return
        f.cognitive += 1 + sum(1 for part in " ".join(operators).split("||") if "&&" in part)

    def _path(self, f: Function, k: int) -> None:
        if self.spec.name == "rust" and self.text(k - 1) == "::" and self.text(k + 1) != "::":
            b = k
            while self.text(b - 1) == "::" and self.word(b - 2):
                b -= 2
            f.paths.append(self.source[self.t[b].start : self.t[k].end])

    def _construct(self, f: Function, k: int, end: int, depth: int, todo: list) -> int | None:
        """Counts a branch that begins at k; its parts go to ``todo`` and the index behind it is returned if it nests."""
        x, spec, kind = self.text(k), self.spec, self.t[k].kind
        if self.text(k - 1) == "." or (kind == "word" and spec.name in ("ts", "tsx") and self.text(k + 1) == ":" and x not in ("default",)):
            return None
        rust = spec.name == "rust"
        if rust and (x == "for" and self.text(k + 1) == "<"):
            return None
        if rust and x == "if" and self._guard(k):
            return None
        tail_while = x == "while" and self._after_do(k)
        if x in spec.branches and not self._closure(k) and not (tail_while and spec.name == "c"):
            f.cyclomatic += 1
        if x in spec.structural:
            f.cognitive += 1 + depth
            if rust:
                self._arms(f, k)
            return None
        if x == "?" and spec.ternary and kind == "mark" and self.text(k + 1) not in (":", ",", ")", "=", ";"):
            stop = k + 1
            while stop < end and self.text(stop) not in (",", ";"):
                stop = self.match[stop] + 1 if self.text(stop) in _OPEN and self.t[stop].kind == "mark" else stop + 1
            f.cognitive += 1 + depth
            todo.append((k + 1, stop, depth + 1, "expression"))
            return stop
        if x not in spec.nesting or tail_while:
            return None
        flat = spec.flat_else_if and x == "if" and self.text(k - 1) == "else"
        f.cognitive += 1 if flat else 1 + depth
        deeper = depth if flat else depth + 1
        stop = self._construct_end(k, end)
        todo.append((k + 1, stop, deeper, "construct"))
        return stop

    def _guard(self, k: int) -> bool:
        b = k + 1
        while b < len(self.t) and self.text(b) not in ("{", "=>", ";", "}"):
            b = self.match[b] + 1 if self.text(b) in ("(", "[") else b + 1
        return self.text(b) == "=>"

    def _after_do(self, k: int) -> bool:
        return k in self.tails

    def _find_tails(self) -> None:
        """Each ``while`` that ends a ``do``, whose statement is a block, a construct or runs to that ``while``; inner ones first."""
        if self.spec.name == "rust":
            return
        for i, t in reversed(list(enumerate(self.t))):
            if t.kind != "word" or t.text != "do" or self.text(i - 1) in (".", "?.") or self.text(i + 1) in (":", ",", "="):
                continue
            k = i + 1
            if self.text(k) == "{" or self.text(k) in ("if", "for", "while", "do"):
                k = self._one_statement(k, len(self.t))
                k += self.text(k) == ";"  # of an inner do
            else:
                while k < len(self.t) and self.text(k) not in (";", "while", "}", ")", "]"):
                    k = self.match[k] + 1 if self.text(k) in _OPEN else k + 1
                k += self.text(k) == ";"
            if self.text(k) == "while":
                self.tails.add(k)

    def _construct_end(self, k: int, end: int) -> int:
        """The index behind a nesting construct: its condition, its block or statement, and for ``if`` its else part."""
        i = k + 1
        if self.spec.name == "rust":
            while i < end and self.text(i) != "{":
                i = self.match[i] + 1 if self.text(i) in ("(", "[") else i + 1
            i = self.match[i] + 1 if i < end else end
        else:
            if self.text(k) == "for" and self.text(i) == "await":
                i += 1
            if self.text(i) == "(":
                i = self.match[i] + 1
            i = self._one_statement(i, end)
        if self.text(k) == "if" and self.text(i) == "else":
            i += 1
            i = self._construct_end(i, end) if self.text(i) == "if" else (self.match[i] + 1 if self.text(i) == "{" else self._one_statement(i, end))
        if self.text(k) == "do" and self.text(i) == "while" and self.text(i + 1) == "(":
            i = self.match[i + 1] + 1
        return min(i, end)

    def _one_statement(self, i: int, end: int) -> int:
        if self.text(i) == "{":
            return self.match[i] + 1
        if self.text(i) in ("if", "for", "while", "do"):
            return self._construct_end(i, end)
        while i < end and self.text(i) != ";" and i not in self.tails:
            i = self.match[i] + 1 if self.text(i) in _OPEN else i + 1
        return min(i + (i not in self.tails), end)

    def _arms(self, f: Function, k: int) -> None:
        """Each arm of a match counts as an arm and as a pattern."""
        b = self._body(k)
        if b is None:
            return
        i, stop = b + 1, self.match[b]
        while i < stop:
            if self.text(i) == "=>" and self.t[i].kind == "mark":
                f.cyclomatic += 2
            i = self.match[i] + 1 if self.text(i) in _OPEN and self.t[i].kind == "mark" else i + 1

    def _statement(self, f: Function, k: int, fresh: bool) -> None:
        """Executable nodes that begin at a token: keyword statements, declarations, calls, assignments, expression statements."""
        if k <= f.body and not (k == f.body and self.text(k) != "{"):
            return
        t, x = self.t[k], self.text(k)
        rust, c = self.spec.name == "rust", self.spec.name == "c"
        if t.kind == "word" and x in ("return", "throw", "break", "continue") and not rust:
            f.statements += 1
        elif t.kind == "word" and x in ("for", "while", "do", "if", "switch", "loop", "match") and self.text(k - 1) != "." and not (x == "while" and self._after_do(k)) and not (rust and x == "if" and self._guard(k)):
            f.statements += 1
        elif t.kind == "word" and (x in ("let", "const", "var") if not c else False) and self.text(k - 1) not in ("if", "while", "("):
            f.statements += 1
        elif t.kind == "word" and x in ("await", "yield") and not rust:
            f.statements += 1
        elif t.kind == "mark" and (x in _ASSIGN and self._assigns(k) or x in _AUGMENTED and not rust):
            f.statements += 1
        elif t.kind == "mark" and x == "(" and (self.ident(k - 1) or self.text(k - 1) in (")", "]", ">", "super", "?.")) and self.text(k - 2) != "function" and self.text(k - 2) != "new":
            f.statements += 1
        elif rust and t.kind == "mark" and x == "!" and self.ident(k - 1) and self.text(k + 1) in _OPEN:
            f.statements += 1
        if fresh and t.kind in ("word", "string", "number", "mark") and x not in ("}", ")", ";", "{", "]", ","):
            plain = t.kind != "word" or x not in self.spec.keywords or x in ("this", "self", "await", "yield", "new", "delete", "super", "typeof", "void")
            if c and t.kind == "word" and (x in ("const", "static", "struct", "unsigned", "signed", "enum", "volatile") or x in ("int", "char", "float", "double", "long", "short", "bool", "size_t", "void") or (self.ident(k) and (self.ident(k + 1) or (self.text(k + 1) == "*" and self.ident(k + 2) and self.text(k + 3) in ("=", ";"))))):
                f.statements += 1  # a declaration
            elif plain and self._ends_plainly(k):
                f.statements += 1

    def _ends_plainly(self, k: int) -> bool:
        i = k
        while i < len(self.t) and self.text(i) not in (";", "}"):
            if self.text(i) == ":" and self.t[i].kind == "mark" and i == k + 1:
                return False  # a label or a key
            i = self.match[i] + 1 if self.text(i) in _OPEN and self.t[i].kind == "mark" else i + 1
        return self.text(i) == ";" or self.spec.name in ("ts", "tsx")

    def _assigns(self, k: int) -> bool:
        b = k - 1
        while b >= 0 and self.text(b) not in (";", "{", "}", "(", ","):
            if self.text(b) in ("let", "const", "var"):
                return False
            b -= 1
        c_declares = self.spec.name == "c" and (self.word(b + 1) and (self.text(b + 1) in self.spec.keywords or self.ident(b + 2)))
        return not c_declares


def normal_signature(source: str, start: int, end: int) -> str:
    return " ".join(source[start:end].split())


def parse_functions(source: str, path: str, language: str) -> list[dict]:
    """Rows of a source's functions, in the order in which they begin; raises :class:`SyntaxProblem`."""
    spec = BY_NAME[language]
    p = Parser(source, spec)
    rows = []
    for n, f in enumerate(p.run()):
        start, end = p.t[f.first].start, p.t[f.last].end
        text = source[start:end]
        body_at = p.t[f.body].start if p.text(f.body) == "{" else end
        sizes = [len(x.encode()) for x in f.identifiers + f.paths]
        rows.append({
            "file": path, "ordinal": n, "name": f.name,
            "id": f"{path}:{f.name}:{xxhash.xxh3_128_hexdigest(normal_signature(source, start, body_at).encode())}",
            "line": p.t[f.first].row + 1, "end_line": p.t[f.last].row + p.t[f.last].text.count("\n") + 1,
            "body_hash": xxhash.xxh3_128_hexdigest(text.encode()), "body_text": text,
            "cyclomatic_complexity": f.cyclomatic, "cognitive_complexity": f.cognitive, "nesting_depth": f.nesting,
            "executable_statements": f.statements, "doc_bytes": f.doc_bytes,
            "identifier_verbosity": sum(sizes) / len(sizes) if sizes else 0.0,
            "callee_names": sorted(set(f.identifiers)), "exported": f.exported, "test_entry": f.test_entry,
        })
    return rows
