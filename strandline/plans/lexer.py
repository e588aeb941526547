"""Query text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SyntaxProblem(ValueError):
    """A text that is no query; says where."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, number, string, param, symbol, end
    text: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text


_PATTERN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<name>[^\W\d]\w*)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |\$(?P<param>\w+)
    |(?P<symbol><=|>=|<>|!=|\.\.|\+=|<-|->|[-+*/%^=<>()\[\]{}:,.|])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _PATTERN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at}")
        kind, value = m.lastgroup or "", m[m.lastgroup or 0]
        if kind == "string":
            value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), value[1:-1], flags=re.DOTALL)
        if kind != "space":
            out.append(Token(kind, value, m.start(), m.end()))
        at = m.end()
    return [*out, Token("end", "", len(text), len(text))]
