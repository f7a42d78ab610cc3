"""Terms of the rule language. A regex is a term too: it reads symbols and copies them."""

from __future__ import annotations

from dataclasses import dataclass, field

from textloom.functions.charset import CharSet


class ProgramError(ValueError):
    """An ill-formed program, with the place of the fault."""

    def __init__(self, message: str, line: int = 0, col: int = 0):
        super().__init__(f"{message} (line {line}, column {col})" if line else message)
        self.line, self.col = line, col


@dataclass(frozen=True)
class Term:
    pass


@dataclass(frozen=True)
class Empty(Term):
    pass


@dataclass(frozen=True)
class Text(Term):
    value: str


@dataclass(frozen=True)
class Sym(Term):
    chars: CharSet


@dataclass(frozen=True)
class Seq(Term):
    items: tuple[Term, ...]


@dataclass(frozen=True)
class Alt(Term):
    items: tuple[Term, ...]


@dataclass(frozen=True)
class Repeat(Term):
    body: Term
    low: int
    high: int | None
    lazy: bool = False


@dataclass(frozen=True)
class Near(Term):
    """The body with up to `errors` edits."""

    body: Term
    errors: int


@dataclass(frozen=True)
class Drop(Term):
    body: Term


@dataclass(frozen=True)
class Call(Term):
    name: str
    line: int = field(default=0, compare=False)
    col: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Into(Term):
    """Output of the body goes to a register."""

    register: str
    body: Term


@dataclass(frozen=True)
class Emit(Term):
    """Move a register to the output."""

    register: str


@dataclass(frozen=True)
class Assign(Term):
    """A register becomes a sequence of texts and (moved) registers."""

    register: str
    items: tuple[Text | Emit, ...]


@dataclass(frozen=True)
class Source:
    """A parsed program: the rules and the names of the pipeline's stages."""

    pipeline: tuple[str, ...]
    rules: dict[str, Term] = field(hash=False)
