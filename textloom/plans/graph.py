"""Graph of a program stage: reads, actions, ordered choices, and an end.

Terms are compiled backwards from what follows them, so a call in tail position becomes an
edge and loops become cycles. Suppressed text compiles to a copy of the term that writes
nothing but still acts on registers. An approximation is laid out in layers, one for each
number of errors left.
"""

from __future__ import annotations

from dataclasses import dataclass

from textloom.functions.charset import ANY, CharSet

from .syntax import Alt, Assign, Call, Drop, Emit, Empty, Into, Near, Repeat, Seq, Source, Sym, Term, Text

METRICS, MODES = ("lcs", "hamming", "levenshtein"), ("correction", "matching", "explicit")


@dataclass
class Node:
    """kind: read (chars, copies), act (an action), alt (targets in order), end."""

    kind: str
    targets: tuple[int, ...] = ()
    chars: CharSet | None = None
    copies: bool = False
    act: object = None


#: Actions besides text (a str): COPY writes the symbol just read.
COPY, PUSH = ("copy",), ("push",)


class Graph:
    """Nodes of one stage, and the node where it starts."""

    def __init__(self, source: Source, rule: str, metric: str = "lcs", mode: str = "correction", binary: bool = False, codes: bool = False):
        if metric not in METRICS or mode not in MODES:
            raise ValueError(f"metric is one of {METRICS} and mode one of {MODES}")
        self.rules, self.metric, self.mode, self.binary, self.codes = source.rules, metric, mode, binary, codes
        self.nodes: list[Node] = []
        self.called: dict[tuple[str, bool, int], int] = {}
        self.end = self.add(Node("end"))
        self.start = self.build(Call(rule), self.end, True)

    def add(self, node: Node) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def alt(self, *targets: int) -> int:
        return self.add(Node("alt", targets))

    def act(self, what, then: int) -> int:
        return self.add(Node("act", (then,), act=what))

    def read(self, chars: CharSet, copies: bool, then: int) -> int:
        return self.add(Node("read", (then,), chars, copies))

    def build(self, term: Term, then: int, copies: bool) -> int:
        """The node that does the term and goes on to `then`."""
        if isinstance(term, Empty):
            return then
        if isinstance(term, Text):
            return self.act(self._text(term.value), then) if copies and term.value else then
        if isinstance(term, Sym):
            return self._symbol(term.chars, copies, then)
        if isinstance(term, Seq):
            for item in reversed(term.items):
                then = self.build(item, then, copies)
            return then
        if isinstance(term, Alt):
            return self.alt(*[self.build(item, then, copies) for item in term.items])
        if isinstance(term, Repeat):
            return self._repeat(term, then, copies)
        if isinstance(term, Drop):
            return self.build(term.body, then, False)
        if isinstance(term, Call):
            key = (term.name, copies, then)
            if key not in self.called:
                self.called[key] = place = self.alt()
                self.nodes[place].targets = (self.build(self.rules[term.name], then, copies),)
            return self.called[key]
        if isinstance(term, Into):
            return self.act(PUSH, self.build(term.body, self.act(("pop", term.register), then), copies))
        if isinstance(term, Emit):
            return self.act(("write", term.register), then)
        if isinstance(term, Assign):
            then = self.act(("pop", term.register), then)
            for item in reversed(term.items):
                then = self.act(("write", item.register) if isinstance(item, Emit) else self._text(item.value), then)
            return self.act(PUSH, then)
        if isinstance(term, Near):
            if not copies or term.errors < 1:
                return self.build(term.body, then, copies)
            inner = self.add(Node("end"))
            first = self.build(term.body, inner, copies)
            return _Layers(self, inner, then).start(first, term.errors)
        raise TypeError(term)

    def _text(self, value: str) -> str:
        return value.encode("utf-8").decode("latin-1") if self.binary else value

    def _symbol(self, chars: CharSet, copies: bool, then: int) -> int:
        if not self.binary:
            return self.read(chars, copies, then)
        if len(chars) == 1 and chars.low > 127:
            for byte in reversed(chr(chars.low).encode("utf-8")):
                then = self.read(CharSet.only(byte), copies, then)
            return then
        # a class is a set of bytes
        return self.read(chars & CharSet.of([(0, 255)]), copies, then)

    def _repeat(self, term: Repeat, then: int, copies: bool) -> int:
        if term.high is None:
            place = self.alt()
            body = self.build(term.body, place, copies)
            self.nodes[place].targets = (then, body) if term.lazy else (body, then)
            then = place
        else:
            for _ in range(term.high - term.low):
                body = self.build(term.body, then, copies)
                then = self.alt(then, body) if term.lazy else self.alt(body, then)
        for _ in range(term.low):
            then = self.build(term.body, then, copies)
        return then


class _Layers:
    """Copies of a body's graph by the errors left; a layer may spend one error at every symbol and at the end."""

    def __init__(self, graph: Graph, end: int, then: int):
        self.g, self.end, self.then = graph, end, then
        self.made: dict[tuple[int, int], int] = {}

    def start(self, first: int, errors: int) -> int:
        # fewer errors are preferred
        return self.g.alt(*[self.copy(first, k) for k in range(errors + 1)])

    def copy(self, at: int, left: int) -> int:
        if (at, left) not in self.made:
            self.made[at, left] = place = self.g.alt()
            self.g.nodes[place].targets = self._targets(at, left)
        return self.made[at, left]

    def _targets(self, at: int, left: int) -> tuple[int, ...]:
        g, node = self.g, self.g.nodes[at]
        if at == self.end:
            if not left or g.metric == "hamming":
                return (self.then,)
            if g.mode == "explicit":
                # all errors of the layer are to be spent
                return (g.act("D", g.read(ANY, True, self.copy(at, left - 1))),)
            return (g.read(ANY, g.mode == "matching", self.copy(at, left - 1)), self.then)
        if node.kind == "alt":
            return tuple(self.copy(t, left) for t in node.targets)
        if node.kind == "act":
            return (g.act(node.act, self.copy(node.targets[0], left)),)
        match = g.read(node.chars, node.copies, self.copy(node.targets[0], left))
        if not left:
            return (match,)
        return (match, *self._errors(at, node, left - 1))

    def _errors(self, at: int, node: Node, left: int) -> list[int]:
        g, after, again = self.g, self.copy(node.targets[0], left), self.copy(at, left)
        least = chr(node.chars.low) if node.chars else ""
        if g.mode == "explicit":
            replaced = lambda: g.read(ANY, True, g.act("R" + least, after))
            deleted = lambda: g.act("D", g.read(ANY, True, again))
            inserted = lambda: g.act("I" + least, after)
            order = {"lcs": (inserted, deleted), "hamming": (replaced,), "levenshtein": (replaced, deleted, inserted)}
        else:
            echo = g.mode == "matching" and node.copies
            repair = (lambda: g.act(least, after)) if g.mode == "correction" and node.copies else (lambda: after)
            replaced = lambda: g.read(ANY, echo, repair())
            deleted = lambda: g.read(ANY, echo, again)
            order = {"lcs": (deleted, repair), "hamming": (replaced,), "levenshtein": (replaced, deleted, repair)}
        return [make() for make in order[g.metric]]
