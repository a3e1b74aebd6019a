"""What distinguishes the languages for the metrics."""

from __future__ import annotations

from dataclasses import dataclass

_TYPES = frozenset("int char float double long short unsigned signed void bool size_t".split())


@dataclass(frozen=True)
class LanguageSpec:
    """A language's extensions, its keywords, and which of them count for which metric."""

    name: str
    extensions: tuple[str, ...]
    keywords: frozenset[str]
    #: Tokens that add one to cyclomatic complexity.
    branches: frozenset[str]
    #: Keywords whose constructs nest.
    nesting: frozenset[str]
    #: Keywords whose constructs add the depth but don't nest.
    structural: frozenset[str]
    #: Whether ``else if`` continues the first ``if`` without paying for depth.
    flat_else_if: bool = True
    ternary: bool = True
    #: Whether a comment before a function can be its documentation.
    comments_document: bool = True


C = LanguageSpec(
    "c", ("c", "h"),
    frozenset("auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile while NULL __attribute__".split()) | _TYPES,
    frozenset(("if", "for", "while", "do", "case", "default", "&&", "||", "?")), frozenset(("if", "for", "while", "do")), frozenset(("switch",)),
)
RUST = LanguageSpec(
    "rust", ("rs",),
    frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while".split())
    | frozenset("i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str".split()),
    frozenset(("if", "match", "for", "while", "loop", "?")), frozenset(("if", "for", "while", "loop")), frozenset(("match",)),
    flat_else_if=False, ternary=False, comments_document=False,
)
_SCRIPT = dict(
    keywords=frozenset(
        "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface is keyof let namespace never new null number of private protected public readonly return set static string super switch symbol this throw true try type typeof unknown var void while with yield".split()
    ),
    branches=frozenset(("if", "for", "while", "do", "case", "catch", "&&", "||", "?")),
    nesting=frozenset(("if", "for", "while", "do", "catch")),
    structural=frozenset(("switch",)),
)
TYPESCRIPT = LanguageSpec("ts", ("ts", "js"), **_SCRIPT)
TSX = LanguageSpec("tsx", ("tsx", "jsx"), **_SCRIPT)

LANGUAGES = (TYPESCRIPT, TSX, RUST, C)
BY_EXTENSION = {e: s for s in reversed(LANGUAGES) for e in s.extensions}
BY_NAME = {s.name: s for s in LANGUAGES}
