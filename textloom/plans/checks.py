"""Static checks: names, and recursion in tail position only."""

from __future__ import annotations

from collections.abc import Iterator

from .syntax import Alt, Call, Drop, Into, Near, ProgramError, Repeat, Seq, Source, Term


def calls(term: Term, tail: bool = True) -> Iterator[tuple[Call, bool]]:
    """Calls inside a term and whether nothing of the rule is left to do after them."""
    if isinstance(term, Call):
        yield term, tail
    elif isinstance(term, Seq):
        for k, item in enumerate(term.items):
            yield from calls(item, tail and k == len(term.items) - 1)
    elif isinstance(term, Alt):
        for item in term.items:
            yield from calls(item, tail)
    elif isinstance(term, Drop):
        yield from calls(term.body, tail)
    elif isinstance(term, (Repeat, Into, Near)):
        # what follows inside a loop, a redirection or an approximation is not the end of the rule
        yield from calls(term.body, False)


def _nested(term: Term, inside: bool, rules: dict[str, Term], seen: frozenset[str]) -> bool:
    if isinstance(term, Near):
        return inside or _nested(term.body, term.errors > 0, rules, seen)
    if isinstance(term, Call):
        return inside and term.name not in seen and _nested(rules[term.name], True, rules, seen | {term.name})
    bodies = term.items if isinstance(term, (Seq, Alt)) else (term.body,) if isinstance(term, (Repeat, Drop, Into)) else ()
    return any(_nested(b, inside, rules, seen) for b in bodies)


def check(source: Source, places: list[tuple[str, int, int]]) -> None:
    """Raise a ProgramError for the first fault."""
    first: set[str] = set()
    for name, line, col in places:
        if name in first:
            raise ProgramError(f"rule {name} is declared twice", line, col)
        first.add(name)
    at = {name: (line, col) for name, line, col in places}
    for name in source.pipeline:
        if name not in source.rules:
            raise ProgramError(f"the pipeline names {name}, which is not declared", 1, 1)
    edges = {name: list(calls(term)) for name, term in source.rules.items()}
    for found in edges.values():
        for call, _ in found:
            if call.name not in source.rules:
                raise ProgramError(f"rule {call.name} is not declared", call.line, call.col)
    reach = {name: {c.name for c, _ in found} for name, found in edges.items()}
    changed = True
    while changed:
        changed = False
        for out in reach.values():
            more = set().union(*(reach[n] for n in out)) - out if out else set()
            if more:
                out |= more
                changed = True
    for name, found in edges.items():
        for call, tail in found:
            if not tail and (call.name == name or name in reach[call.name]):
                raise ProgramError(f"rule {name} calls itself through {call.name} before its end", call.line, call.col)
    for name, term in source.rules.items():
        if _nested(term, False, source.rules, frozenset()):
            raise ProgramError(f"rule {name} has an approximation inside an approximation", *at[name])
