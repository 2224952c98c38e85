"""Syntax trees and errors."""

from __future__ import annotations

from dataclasses import dataclass, field


class EclError(Exception):
    """Base of all errors that an expression can cause."""


class ParseError(EclError):
    """``kind`` is Syntax, Semantic, Unsupported or Limit; ``offset`` counts UTF-8 bytes."""

    def __init__(self, kind: str, offset: int, message: str):
        super().__init__(f"{kind} error at byte {offset}: {message}")
        self.kind, self.offset, self.message = kind, offset, message

    def caret(self, text: str, width: int = 60) -> str:
        """The line of the error, as far as ``width`` characters around it, and a caret below its place."""
        at = len(text.encode("utf-8", "surrogatepass")[: self.offset].decode("utf-8", "ignore"))
        begin = max(text.rfind("\n", 0, at) + 1, at - width)
        end = min(len(text) if (n := text.find("\n", at)) < 0 else n, at + width)
        return text[begin:end].replace("\t", " ") + "\n" + " " * (at - begin) + "^"


class TypeMismatch(EclError):
    """A value, field or filter of the wrong type."""


class InvalidField(EclError):
    """A member field that no selected reference set has."""


class MissingReference(EclError):
    """A concept-valued result that is not a concept of the edition."""


class SemanticError(EclError):
    """A form that has no meaning for the data it is applied to."""


class UnknownAlias(EclError):
    """An identifier scheme or dialect alias that is not configured."""


class InvalidTree(EclError):
    """A constructed tree that the parser would not make."""


class ResultLimit(EclError):
    """More results than the caller allows."""


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Concept(Node):
    id: int


@dataclass(frozen=True)
class Any(Node):
    pass


@dataclass(frozen=True)
class Identifier(Node):
    scheme: str
    code: str


@dataclass(frozen=True)
class Hierarchy(Node):
    """``op`` is one of < << <! <<! > >> >! >>! !!> !!<."""

    op: str
    of: Node


@dataclass(frozen=True)
class Members(Node):
    """``^`` with optional ``fields`` (None: plain, ("*",): all own fields) or, reversed, ``^R``; ``filters`` of all M blocks."""

    of: Node
    fields: tuple[str, ...] | None = None
    reverse: bool = False
    filters: tuple[MemberFilter, ...] = ()


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Minus(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Dotted(Node):
    of: Node
    attribute: Node


@dataclass(frozen=True)
class Refined(Node):
    of: Node
    refinement: Node


@dataclass(frozen=True)
class Filtered(Node):
    """One C or D block: ``kind`` is C or D."""

    of: Node
    kind: str
    filters: tuple[Filter, ...]


@dataclass(frozen=True)
class History(Node):
    """``profile`` is MIN, MOD, MAX or an expression that selects association reference sets."""

    of: Node
    profile: str | Node


@dataclass(frozen=True)
class Value:
    """A literal: ``kind`` is number, text, boolean or terms."""

    kind: str
    values: tuple


@dataclass(frozen=True)
class Term:
    """A search term: ``match`` (words as prefixes) or ``wild`` (parts between stars)."""

    kind: str
    text: str


@dataclass(frozen=True)
class Attribute(Node):
    name: Node
    op: str
    value: Node | Value
    least: int = 1
    most: int | None = None
    reverse: bool = False
    offset: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Group(Node):
    of: Node
    least: int = 1
    most: int | None = None


@dataclass(frozen=True)
class AllOf(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class AnyOf(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Filter:
    """``value`` depends on the field: a node, a tuple of tokens, dates (int or None), terms or dialects."""

    field: str
    op: str
    value: object


@dataclass(frozen=True)
class MemberFilter:
    """``kind`` of the value: concept, number, boolean, active, date, dateortext or text."""

    field: str
    op: str
    kind: str
    value: object


@dataclass(frozen=True)
class Dialect:
    """``refset`` is an alias or a node; ``acceptability`` None or a tuple of tokens and concept ids."""

    refset: str | Node
    acceptability: tuple | None = None
