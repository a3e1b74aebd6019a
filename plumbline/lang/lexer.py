"""Tokens of C, Rust and TypeScript/JavaScript sources."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, comment, mark, line (a preprocessor line)
    text: str
    start: int
    end: int
    row: int


class SyntaxProblem(ValueError):
    """The source can't be one of its language."""


_MARKS = ("<<=", ">>=", "...", "===", "!==", "**=", "&&=", "||=", "??=", "..=", "=>", "->", "::", "&&", "||", "??", "?.", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "++", "--", "<<", "**", "..")
_WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][0-9A-Fa-f_]+|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?[A-Za-z0-9_]*")
_RAW = re.compile(r'b?r(#*)"')
_CLOSER = {"(": ")", "[": "]", "{": "}"}
#: After these a slash begins a regular expression, not a division.
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => && || ?? return typeof case in of delete void throw new do else instanceof".split())


def tokens(source: str, language: str) -> list[Token]:
    """All tokens, comments included; raises :class:`SyntaxProblem` on unclosed strings, comments or brackets.

    A template is string tokens with the tokens of its interpolations between them, each in the
    marks ``[`` and ``]``, which stand for ``${`` and ``}``.
    """
    out: list[Token] = []
    stack: list[str] = []
    i, row, n = 0, 0, len(source)
    script, rust, c = language in ("ts", "tsx"), language == "rust", language == "c"
    last = ""  # text of the last token that isn't a comment

    def add(kind: str, end: int, text: str | None = None) -> None:
        nonlocal i, row, last
        text = source[i:end] if text is None else text
        out.append(Token(kind, text, i, end, row))
        row += text.count("\n")
        i = end
        if kind != "comment":
            last = text

    def add_template(begin: int) -> None:
        """The part of a template from i up to its end or its next interpolation, which is opened."""
        end, closed = _template_part_end(source, begin)
        add("string", end)
        if not closed:
            stack.append("${")
            add("mark", end + 2, "[")

    while i < n:
        ch = source[i]
        if ch in " \t\r\n\f\v﻿":
            row += ch == "\n"
            i += 1
        elif source.startswith("//", i):
            end = source.find("\n", i)
            add("comment", n if end < 0 else end)
        elif source.startswith("/*", i):
            add("comment", _comment_end(source, i, rust))
        elif c and ch == "#" and source[source.rfind("\n", 0, i) + 1 : i].strip() == "":
            end = i
            while True:
                end = source.find("\n", end)
                if end < 0:
                    end = n
                    break
                if source[end - 1] != "\\":
                    break
                end += 1
            add("line", end)
        elif rust and (m := _RAW.match(source, i)):
            end = source.find('"' + m[1], m.end())
            if end < 0:
                raise SyntaxProblem("a raw string isn't closed")
            add("string", end + 1 + len(m[1]))
        elif ch == '"' or (ch == "'" and not rust):
            try:
                add("string", _string_end(source, i, ch, rust))
            except SyntaxProblem:
                if language != "tsx":  # there it may be an apostrophe between tags
                    raise
                add("mark", i + 1)
        elif rust and ch == "'":
            m = re.compile(r"'(?:\\(?:x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f_]+\}|.)|[^'\\\n])'").match(source, i)
            add("string", m.end()) if m else add("mark", i + 1)
        elif script and ch == "`":
            add_template(i + 1)
        elif ch == "}" and stack and stack[-1] == "${":
            stack.pop()
            add("mark", i + 1, "]")
            add_template(i)
        elif script and ch == "/" and (last in _BEFORE_REGEX or not last) and not (last == "<" and language == "tsx") and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(source, i)):
            add("string", m.end())
        elif m := _WORD.match(source, i):
            add("word", m.end())
        elif ch.isdigit():
            add("number", _NUMBER.match(source, i).end())
        else:
            mark = next((x for x in _MARKS if source.startswith(x, i)), ch)
            if mark == "?." and source[i + 2 : i + 3].isdigit():
                mark = "?"
            if mark in _CLOSER:
                stack.append(_CLOSER[mark])
            elif mark in (")", "]", "}") and (not stack or stack.pop() != mark):
                raise SyntaxProblem(f"'{mark}' closes nothing on line {row + 1}")
            add("mark", i + len(mark))
    if stack:
        raise SyntaxProblem("a template isn't closed" if stack[-1] == "${" else f"'{stack[-1]}' is missing")
    return out


def _comment_end(source: str, i: int, nested: bool) -> int:
    depth, at = 1, i + 2
    while depth:
        close, inner = source.find("*/", at), source.find("/*", at)
        if close < 0:
            raise SyntaxProblem("a comment isn't closed")
        if nested and 0 <= inner < close:
            depth, at = depth + 1, inner + 2
        else:
            depth, at = depth - 1, close + 2
    return at


def _string_end(source: str, i: int, quote: str, lines: bool) -> int:
    at = i + 1
    while at < len(source) and source[at] != quote:
        if source[at] == "\n" and not lines:
            break
        at += 2 if source[at] == "\\" else 1
    if at >= len(source) or source[at] != quote:
        raise SyntaxProblem("a string isn't closed")
    return at + 1


def _template_part_end(source: str, at: int) -> tuple[int, bool]:
    """Behind the quote that ends a template, or at its next interpolation; and whether the template ends."""
    while at < len(source):
        if source[at] == "`":
            return at + 1, True
        if source.startswith("${", at):
            return at, False
        at += 2 if source[at] == "\\" else 1
    raise SyntaxProblem("a template isn't closed")
