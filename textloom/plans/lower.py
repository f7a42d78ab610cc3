"""Lowering of a program stage to built-in Catalyst expressions, where that is equivalent.

The language resolves ambiguity on the whole input, a regex search locally. The forms
lowered here are those in which the two agree:

* template: a fixed sequence of reads and texts, over registers too, against the whole input;
* cases: ordered alternatives of templates against the whole input;
* lines: a loop of such records, each closed by a newline that no record can contain;
* tokens: a loop whose last alternative takes any symbol, so that every local choice can
  be completed. If it only maps symbols to symbols it becomes `translate`.

Patterns on which the JVM's backtracking search could explode or overflow its stack, or
whose empty loops it treats differently, are not lowered (see `guard`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.charset import ANY, CharSet

from .syntax import Alt, Assign, Call, Drop, Emit, Empty, Into, Near, Repeat, Seq, Source, Sym, Term, Text

NEWLINE = CharSet.only("\n")


class NotNative(Exception):
    """The stage has no equivalent form; the message says why."""


def inline(term: Term, rules: dict[str, Term], inside: frozenset[str] = frozenset()) -> Term:
    """The term with its calls replaced by rules; a recursive one is not native."""
    if isinstance(term, Call):
        if term.name in inside:
            raise NotNative(f"rule {term.name} is recursive")
        return inline(_loop(term.name, rules[term.name]), rules, inside | {term.name})
    if isinstance(term, Seq):
        items = [inline(i, rules, inside) for i in term.items]
        return Seq(tuple(x for i in items for x in (i.items if isinstance(i, Seq) else (i,))))
    if isinstance(term, Alt):
        items = [inline(i, rules, inside) for i in term.items]
        return Alt(tuple(x for i in items for x in (i.items if isinstance(i, Alt) else (i,))))
    if isinstance(term, Repeat):
        return Repeat(inline(term.body, rules, inside), term.low, term.high, term.lazy)
    if isinstance(term, Drop):
        return Drop(inline(term.body, rules, inside))
    if isinstance(term, Into):
        return Into(term.register, inline(term.body, rules, inside))
    if isinstance(term, Near):
        raise NotNative("approximation")
    return term


def _loop(name: str, body: Term) -> Term:
    """A rule that only calls itself at the end of its first alternatives, as a loop and what ends it."""
    items = list(body.items) if isinstance(body, Alt) else [body]
    again = [i for i in items if isinstance(i, Seq) and i.items[-1] == Call(name)]
    rest = items[len(again) :]
    if not again or items[: len(again)] != again or not rest:
        return body
    bodies = [Seq(i.items[:-1]) if len(i.items) > 2 else i.items[0] for i in again]
    loop = Repeat(bodies[0] if len(bodies) == 1 else Alt(tuple(bodies)), 0, None)
    if rest in ([Empty()], [Text("")]):
        return loop
    return Seq((loop, rest[0] if len(rest) == 1 else Alt(tuple(rest))))


def expand(term: Term, most: int = 32) -> list[Term]:
    """Straight-line terms, best first, that a term with choices that write stands for."""
    if pure(term):
        return [term]
    if isinstance(term, Alt):
        out = [x for i in term.items for x in expand(i, most)]
    elif isinstance(term, Repeat) and (term.low, term.high) == (0, 1):
        out = [Empty(), *expand(term.body, most)] if term.lazy else [*expand(term.body, most), Empty()]
    elif isinstance(term, Seq):
        out = [()]
        for item in term.items:
            out = [(*a, b) for a in out for b in expand(item, most)]
            if len(out) > most:
                raise NotNative("too many cases")
        out = [Seq(tuple(x for i in a for x in (i.items if isinstance(i, Seq) else () if isinstance(i, Empty) else (i,)))) for a in out]
    elif isinstance(term, Drop):
        out = [Drop(x) for x in expand(term.body, most)]
    elif isinstance(term, Into):
        out = [Into(term.register, x) for x in expand(term.body, most)]
    else:
        out = [term]
    if len(out) > most:
        raise NotNative("too many cases")
    return out


def pure(term: Term) -> bool:
    """Whether the term only reads (and copies) symbols."""
    if isinstance(term, (Sym, Empty)):
        return True
    if isinstance(term, (Seq, Alt)):
        return all(pure(i) for i in term.items)
    return isinstance(term, Repeat) and pure(term.body)


def nullable(term: Term) -> bool:
    if isinstance(term, Sym):
        return False
    if isinstance(term, Seq):
        return all(nullable(i) for i in term.items)
    if isinstance(term, Alt):
        return any(nullable(i) for i in term.items)
    if isinstance(term, Repeat):
        return term.low == 0 or nullable(term.body)
    if isinstance(term, (Drop, Into)):
        return nullable(term.body)
    return True


def symbols(term: Term) -> CharSet:
    """All symbols that the term can read."""
    if isinstance(term, Sym):
        return term.chars
    if isinstance(term, (Seq, Alt)):
        out = CharSet(())
        for i in term.items:
            out = out | symbols(i)
        return out
    return symbols(term.body) if isinstance(term, (Repeat, Drop, Into)) else CharSet(())


def java(term: Term) -> str:
    """A pure term that `guard` lets pass as a Java regex."""
    if isinstance(term, Empty):
        return ""
    if isinstance(term, Sym):
        return term.chars.java()
    if isinstance(term, Seq):
        return "".join(java(i) for i in term.items)
    if isinstance(term, Alt):
        return "(?:" + "|".join(java(i) for i in term.items) + ")"
    body = java(term.body)
    single = isinstance(term.body, Sym)
    lazy = "?" if term.lazy else ""
    if term.high is not None:
        count = "?" if (term.low, term.high) == (0, 1) else f"{{{term.low},{term.high}}}"
        return (body if single else f"(?:{body})") + count + lazy
    if single and term.low > 1:
        # a loop over one class runs without recursion only as * or +
        return f"{body}{{{term.low}}}{body}*{lazy}"
    count = "*" if term.low == 0 else "+" if term.low == 1 else f"{{{term.low},}}"
    # other loops recurse unless they keep what they have taken
    return body + count + lazy if single else f"(?:{body}){count}+"


#: Most rounds of a counted loop over more than one symbol: the JVM's search recurses in each.
COUNTED = 200


def guard(term: Term) -> None:
    """Refuse what the JVM's search cannot do on long texts.

    A loop over more than one symbol recurses for each round, unless it never has to go
    back; loops that share symbols with what follows are tried at every length, so there
    is one of them at most, with no other loop after it.
    """
    flags = _loops(term, CharSet(()), False)[0]
    if True in flags and flags.index(True) < len(flags) - 1:
        raise NotNative("loops that can take symbols from each other")


def _loops(term: Term, follow: CharSet, sure: bool) -> tuple[list[bool], bool]:
    """For each unbounded loop over one class, in order, whether it may have to give symbols back; and whether the term
    and what follows take any input. follow: symbols that can come next; sure: what follows takes any input."""
    if isinstance(term, (Drop, Into)):
        return _loops(term.body, follow, sure)
    if isinstance(term, Seq):
        flags: list[bool] = []
        for item in reversed(term.items):
            more, sure = _loops(item, follow, sure)
            flags = more + flags
            follow = _first(item) | follow if nullable(item) else _first(item)
        return flags, sure
    if isinstance(term, Alt):
        return [f for i in term.items for f in _loops(i, follow, sure)[0]], sure and any(nullable(i) for i in term.items)
    if not isinstance(term, Repeat):
        return [], sure and nullable(term)
    if term.high is not None:
        if term.high > (1000 if isinstance(term.body, Sym) else COUNTED):
            raise NotNative("a long counted loop")
        if isinstance(term.body, Sym):
            return [], sure and term.low == 0
        again = _first(term.body) | follow if term.high > 1 else follow
        return _loops(term.body, again, False if term.high > 1 else sure)[0] * min(term.high, 2), sure and nullable(term)
    if isinstance(term.body, Sym):
        if term.body.chars == ANY and not follow:
            return [], term.low == 0
        return [bool(term.body.chars & follow) and not sure], sure and term.low == 0
    if nullable(term.body):
        raise NotNative("a loop whose body can be empty")
    if not _decided(term, follow):
        raise NotNative("a loop that may have to go back")
    return [], sure and term.low == 0


def _decided(term: Term, follow: CharSet) -> bool:
    """Whether the next symbol always says how to go on, so that no choice is ever taken back."""
    if isinstance(term, (Drop, Into)):
        return _decided(term.body, follow)
    if isinstance(term, Seq):
        for item in reversed(term.items):
            if not _decided(item, follow):
                return False
            follow = _first(item) | follow if nullable(item) else _first(item)
        return True
    if isinstance(term, Alt):
        seen = CharSet(())
        for item in term.items:
            if nullable(item) or seen & _first(item) or not _decided(item, follow):
                return False
            seen = seen | _first(item)
        return True
    if isinstance(term, Repeat):
        if term.low == term.high:
            return not nullable(term.body) and _decided(term.body, _first(term.body) | follow)
        return not term.lazy and not nullable(term.body) and not _first(term.body) & follow and _decided(term.body, _first(term.body) | follow)
    return True


@dataclass
class Template:
    """A regex with groups and the output made of groups (int) and texts."""

    regex: str
    output: list[int | str]

    def replacement(self) -> str:
        quoted = lambda text: "".join("\\" + c if c in "\\$" or c.isdigit() else c for c in text)
        return "".join(f"${x}" if isinstance(x, int) else quoted(x) for x in self.output)


def template(term: Term, copying: bool = False) -> Template:
    """A straight-line term as a template; registers are followed symbolically."""
    guard(term)
    regex: list[str] = []
    groups = 0
    registers: dict[str, list] = {}
    buffers: list[list] = [[]]

    def move(name: str) -> list:
        return registers.get(name, []) if copying else registers.pop(name, [])

    def go(t: Term, copies: bool) -> None:
        nonlocal groups
        if isinstance(t, Empty):
            return
        if isinstance(t, Text):
            if copies:
                buffers[-1].append(t.value)
        elif pure(t):
            part = java(t)
            if copies and part:
                groups += 1
                buffers[-1].append(groups)
            regex.append(f"({part})" if copies and part else f"(?:{part})" if isinstance(t, (Alt, Repeat)) else part)
        elif isinstance(t, Seq):
            run: list[Term] = []
            for item in [*t.items, None]:
                if item is not None and pure(item) and not isinstance(item, Empty):
                    run.append(item)
                    continue
                if run:
                    go_pure(run, copies)
                    run = []
                if item is not None:
                    go(item, copies)
        elif isinstance(t, Drop):
            go(t.body, False)
        elif isinstance(t, Into):
            buffers.append([])
            go(t.body, copies)
            registers[t.register] = buffers.pop()
        elif isinstance(t, Emit):
            buffers[-1].extend(move(t.register))
        elif isinstance(t, Assign):
            value: list = []
            for item in t.items:
                value.extend(move(item.register) if isinstance(item, Emit) else [item.value])
            registers[t.register] = value
        else:
            raise NotNative("a choice or loop that writes")

    def go_pure(items: list[Term], copies: bool) -> None:
        go(items[0] if len(items) == 1 else Seq(tuple(items)), copies)

    go(term, True)
    if groups > 90:
        raise NotNative("too many groups")
    return Template("".join(regex), buffers[0])


def _whole(regex: str) -> str:
    return rf"(?s)\A(?:{regex})\z"


def _cases(items: list[Template], value: Column) -> tuple[Column, Column]:
    """(whether one of the templates takes the whole value, output of the first that does)."""
    taken, out = None, None
    for t in items:
        hit = value.rlike(_whole(t.regex))
        done = F.regexp_replace(value, F.lit(_whole(t.regex)), F.lit(t.replacement()))
        if t.output == [1] and t.regex.startswith("(") and t.regex.count("(") == 1 and t.regex.endswith(")"):
            done = value
        out = F.when(hit, done) if out is None else out.when(hit, done)
        taken = hit if taken is None else taken | hit
    return taken, out


def _alternatives(term: Term) -> list[Term]:
    return list(term.items) if isinstance(term, Alt) else [term]


def _lines(term: Term, copying: bool) -> Callable[[Column], Column]:
    if not (isinstance(term, Repeat) and (term.low, term.high, term.lazy) == (0, None, False) and isinstance(term.body, Seq)):
        raise NotNative("not a loop of records")
    *record, close = term.body.items
    keeps = close == Sym(NEWLINE)
    if not keeps and close != Drop(Sym(NEWLINE)):
        raise NotNative("records do not end in a newline")
    if any((symbols(r) & NEWLINE).ranges for r in record):
        raise NotNative("a record can contain a newline")
    body = record[0] if len(record) == 1 else Seq(tuple(record))
    cases = [template(t, copying) for t in expand(body)]

    def column(value: Column) -> Column:
        parts = F.split(value, "\n", -1)
        inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        good = (F.element_at(parts, -1) == "") & F.forall(inner, lambda x: _cases(cases, x)[0])
        done = F.transform(inner, lambda x: F.concat(_cases(cases, x)[1], F.lit("\n" if keeps else "")))
        return F.when(good, F.array_join(done, ""))

    return column


def _tokens(term: Term, copying: bool) -> Callable[[Column], Column]:
    if not (isinstance(term, Repeat) and (term.low, term.high, term.lazy) == (0, None, False)):
        raise NotNative("not a loop")
    *items, rest = _alternatives(term.body)
    if rest not in (Sym(ANY), Drop(Sym(ANY))):
        raise NotNative("the loop does not end in an alternative for any symbol")
    if any(nullable(i) for i in items):
        raise NotNative("a token can be empty")
    mapped = _mapped(items) if rest == Sym(ANY) else None
    if mapped is not None:
        return lambda value: F.translate(value, *mapped)
    cases = [template(t, copying) for t in items]
    if any(isinstance(s, Repeat) and s.lazy for i in items for s in _parts(i)):
        raise NotNative("a lazy loop inside a token")
    if len(cases) == 1 and rest == Sym(ANY):
        return lambda value: F.regexp_replace(value, F.lit("(?s)" + cases[0].regex), F.lit(cases[0].replacement()))
    if len(cases) == 1:
        c = cases[0]
        if len(c.output) == 1 and isinstance(c.output[0], int):
            return lambda value: F.array_join(F.regexp_extract_all(value, F.lit("(?s)" + c.regex), F.lit(c.output[0])), "")
    every = "(?s)" + "|".join(f"(?:{_plain(c.regex)})" for c in cases)
    if rest == Sym(ANY):
        # symbols with which no token begins are taken together
        others = ~_first(Alt(tuple(items)))
        every += (f"|{others.java()}+" if others else "") + "|."

    def column(value: Column) -> Column:
        def render(token: Column) -> Column:
            done = _cases(cases, token)[1]
            return F.coalesce(done, token if rest == Sym(ANY) else F.lit(""))

        return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(every), F.lit(0)), render), "")

    return column


def _collected(term: Term, copying: bool) -> Callable[[Column], Column]:
    """A loop of tokens that append to registers, then the registers: each register is the tokens' output of its own."""
    if not (isinstance(term, Seq) and isinstance(term.items[0], Repeat) and all(isinstance(t, (Emit, Text)) for t in term.items[1:])):
        raise NotNative("not a loop followed by registers")
    loop, tail = term.items[0], term.items[1:]
    *items, rest = _alternatives(loop.body)
    names = [t.register for t in tail if isinstance(t, Emit)]
    if copying or len(set(names)) < len(names):
        raise NotNative("a register is written twice")

    def output(name: str | None) -> Term:
        """The loop with what its tokens give to one register, or to the output."""
        out = []
        for item in items:
            parts: list[Term] = []
            for part in item.items if isinstance(item, Seq) else (item,):
                if isinstance(part, Assign) and part.register in names:
                    if part.items[0] != Emit(part.register) or any(isinstance(i, Emit) for i in part.items[1:]):
                        raise NotNative("a register is not only appended to")
                    parts.extend(part.items[1:] if part.register == name else ())
                elif isinstance(part, (Into, Emit, Assign)):
                    raise NotNative("tokens use other registers")
                else:
                    parts.append(part if name is None or not (isinstance(part, Text) or pure(part)) else Empty() if isinstance(part, Text) else Drop(part))
            out.append(Seq(tuple(p for p in parts if not isinstance(p, Empty))))
        return Repeat(Alt((*out, rest if name is None else Drop(Sym(ANY)))), loop.low, loop.high, loop.lazy)

    def counted(name: str) -> Callable[[Column], Column] | None:
        """What the loop appends to a register if each token is one symbol, by counting the symbols of the only token that does."""
        reads = [[p for p in (i.items if isinstance(i, Seq) else (i,)) if not isinstance(p, (Assign, Text))] for i in items]
        classes = [symbols(r[0]) for r in reads if len(r) == 1 and (isinstance(r[0], Sym) or isinstance(r[0], Drop) and isinstance(r[0].body, Sym))]
        if len(classes) < len(items) or any(a & b for k, a in enumerate(classes) for b in classes[:k]):
            return None
        appends = [[p for p in (i.items if isinstance(i, Seq) else (i,)) if isinstance(p, Assign) and p.register == name] for i in items]
        users = [k for k, a in enumerate(appends) if a]
        if len(users) != 1:
            return None
        text = "".join(t.value for a in appends[users[0]] for t in a.items[1:])
        return lambda value: F.repeat(F.lit(text), F.regexp_count(value, F.lit(classes[users[0]].java())))

    silent = rest == Drop(Sym(ANY)) and not any(isinstance(p, Text) or pure(p) for i in items for p in (i.items if isinstance(i, Seq) else (i,)))
    made = [] if silent else [_tokens(output(None), copying)]
    _tokens(output(names[0]) if names else loop, copying)  # the loop itself is checked even if nothing is written
    made += [(lambda value, t=t: F.lit(t.value)) if isinstance(t, Text) else counted(t.register) or _tokens(output(t.register), copying) for t in tail]
    return lambda value: F.when(value.isNotNull(), F.concat(*[form(value) for form in made]))


def _first(term: Term) -> CharSet:
    """Symbols that a term can begin with."""
    if isinstance(term, Sym):
        return term.chars
    if isinstance(term, Alt):
        out = CharSet(())
        for i in term.items:
            out = out | _first(i)
        return out
    if isinstance(term, Seq):
        out = CharSet(())
        for i in term.items:
            out = out | _first(i)
            if not nullable(i):
                break
        return out
    return _first(term.body) if isinstance(term, (Repeat, Drop, Into)) else CharSet(())


def _parts(term: Term):
    yield term
    for t in term.items if isinstance(term, (Seq, Alt)) else (term.body,) if isinstance(term, (Repeat, Drop, Into)) else ():
        yield from _parts(t)


def _plain(regex: str) -> str:
    """The regex without capturing; parentheses in it are groups only, for literals are written by code."""
    return regex.replace("(?:", "\0").replace("(", "(?:").replace("\0", "(?:")


def _mapped(items: list[Term]) -> tuple[str, str] | None:
    """Symbols and their images if every alternative replaces one symbol by one."""
    source, target = "", ""
    for item in items:
        if not (isinstance(item, Seq) and len(item.items) == 2):
            return None
        parts = {type(i): i for i in item.items}
        read, text = parts.get(Drop), parts.get(Text)
        if read is None or text is None or not isinstance(read.body, Sym) or len(read.body.chars) != 1 or len(text.value) != 1:
            return None
        symbol = chr(read.body.chars.low)
        if symbol not in source:
            source, target = source + symbol, target + text.value
    return source, target


FORMS = (("tokens", _tokens), ("collected", _collected), ("lines", _lines))


def lower(source: Source, rule: str, copying: bool = False) -> tuple[str, Callable[[Column], Column]]:
    """(name of the form, function from a column to the stage's output, null where it rejects)."""
    term = inline(Call(rule), source.rules)
    if isinstance(term, Seq) and len(term.items) == 1:
        term = term.items[0]
    why = []
    for name, form in FORMS:
        try:
            return name, form(term, copying)
        except NotNative as e:
            why.append(f"{name}: {e}")
    try:
        cases = [template(t, copying) for t in expand(term)]
    except NotNative as e:
        raise NotNative("; ".join([*why, f"template: {e}"])) from None
    return "template" if len(cases) == 1 else "cases", lambda value: _cases(cases, value)[1]


def fields(source: Source, rule: str) -> tuple[str, list[str]]:
    """(regex, names) of a record: a sequence in which the called rules are the fields."""
    term = source.rules[rule]
    regex, names = "", []
    for item in term.items if isinstance(term, Seq) else (term,):
        if isinstance(item, Text):
            continue
        body = item.body if isinstance(item, Drop) else item
        flat = inline(body, source.rules)
        if not pure(flat):
            flat = _reads(flat)
        if isinstance(item, Call):
            names.append(item.name)
            regex += f"({java(flat)})"
        else:
            regex += f"(?:{java(flat)})"
    if not names:
        raise NotNative("a record calls a rule for each field")
    guard(_reads(inline(Call(rule), source.rules)))
    return _whole(regex), names


def _reads(term: Term) -> Term:
    """The term without its output."""
    if isinstance(term, (Text, Emit, Assign)):
        return Empty()
    if isinstance(term, (Drop, Into)):
        return _reads(term.body)
    if isinstance(term, Seq):
        return Seq(tuple(_reads(i) for i in term.items))
    if isinstance(term, Alt):
        return Alt(tuple(_reads(i) for i in term.items))
    return Repeat(_reads(term.body), term.low, term.high, term.lazy) if isinstance(term, Repeat) else term


def acceptance(source: Source, rule: str) -> str:
    """A regex for the inputs that a stage accepts."""
    term = _reads(inline(Call(rule), source.rules))
    guard(term)
    return _whole(java(term))


def literal(term: Term) -> str | None:
    """The only text that a pure term reads, if there is one."""
    if isinstance(term, Empty):
        return ""
    if isinstance(term, Sym):
        return chr(term.chars.low) if len(term.chars) == 1 else None
    if isinstance(term, Seq):
        parts = [literal(i) for i in term.items]
        return None if None in parts else "".join(parts)
    return None
