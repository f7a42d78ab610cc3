"""Greedy parsing of whole inputs: lockstep over a lazily built automaton, or backtracking.

A state is the ordered list of read nodes that a prefix can be waiting at, best first; of
two paths to a node the better one is kept. Reading keeps for every live path its parent
and its actions, so the best path of an accepted input is traced back once and its
actions are run once. Time is linear in the input, whatever the program.
"""

from __future__ import annotations

from dataclasses import dataclass

from textloom.functions.charset import ANY, minterms
from textloom.plans.graph import COPY, PUSH, Graph

#: States that are kept; beyond that they are built anew.
MAX_STATES = 20_000


@dataclass(frozen=True)
class Outcome:
    """value if the input is accepted, else the place of the first symbol that no path can read (the length: the end)."""

    ok: bool
    value: str | None
    error_pos: int | None


class Registers:
    """Output buffers and registers; writing a register moves it unless `copying`."""

    def __init__(self, copying: bool = False):
        self.store: dict[str, str] = {}
        self.stack: list[list[str]] = [[]]
        self.copying = copying

    def run(self, action, symbol: str) -> None:
        if isinstance(action, str):
            self.stack[-1].append(action)
        elif action is COPY or action[0] == "copy":
            self.stack[-1].append(symbol)
        elif action is PUSH or action[0] == "push":
            self.stack.append([])
        elif action[0] == "pop":
            self.store[action[1]] = "".join(self.stack.pop())
        else:
            self.stack[-1].append(self.store.get(action[1], ""))
            if not self.copying:
                self.store[action[1]] = ""

    def flush(self) -> str:
        """Output that is final: what has been written outside all redirections."""
        out = "".join(self.stack[0])
        self.stack[0] = []
        return out


@dataclass
class _Step:
    state: int
    parents: tuple[int, ...]
    actions: tuple[tuple, ...]


class Machine:
    """One stage of a program, ready to run."""

    def __init__(self, graph: Graph, copying: bool = False):
        self.graph, self.copying = graph, copying
        self.plain = not any(n.kind == "act" and not isinstance(n.act, str) for n in graph.nodes)
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: list[dict[str, _Step | None]] = []

    def _number(self, nodes: tuple[int, ...]) -> int:
        if nodes not in self.numbers:
            self.numbers[nodes] = len(self.states)
            self.states.append(nodes)
            self.steps.append({})
        return self.numbers[nodes]

    def closure(self, starts: list[tuple[int, int, tuple]]) -> tuple[tuple[int, ...], tuple[int, ...], tuple[tuple, ...]]:
        """Waiting nodes, in order, from (node, parent, actions so far); the first path to a node wins."""
        nodes, graph, seen = self.graph.nodes, self.graph, set()
        out, parents, actions = [], [], []
        stack = [(n, p, a) for n, p, a in reversed(starts)]
        while stack:
            at, parent, path = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            node = nodes[at]
            if node.kind in ("read", "end"):
                if node.kind == "end" and at != graph.end:
                    continue
                out.append(at)
                parents.append(parent)
                actions.append(path)
            elif node.kind == "act":
                stack.append((node.targets[0], parent, (*path, node.act)))
            elif graph.codes and len(node.targets) > 1:
                stack.extend((t, parent, (*path, ("code", k))) for k, t in reversed(list(enumerate(node.targets))))
            else:
                stack.extend((t, parent, path) for t in reversed(node.targets))
        return tuple(out), tuple(parents), tuple(actions)

    def begin(self, node: int | None = None) -> tuple[int, tuple[tuple, ...]]:
        """The first state and the actions on the way to each of its nodes."""
        if node is not None:
            return self._number((node,)), ((),)
        found, _, actions = self.closure([(self.graph.start, 0, ())])
        return self._number(found), actions

    def step(self, state: int, symbol: str) -> _Step | None:
        """What reading a symbol leads to; None if no path can read it."""
        known = self.steps[state]
        if symbol in known:
            return known[symbol]
        starts, code = [], ord(symbol)
        for k, at in enumerate(self.states[state]):
            node = self.graph.nodes[at]
            if node.kind == "read" and code in node.chars:
                first: tuple = (COPY,) if node.copies else ()
                if self.graph.codes and len(node.chars) > 1:
                    first = (("code", node.chars.rank(code)),)
                starts.append((node.targets[0], k, first))
        found, parents, actions = self.closure(starts)
        if self.plain and not self.graph.codes:
            actions = tuple(_joined(a) for a in actions)
        out = _Step(self._number(found), parents, actions) if found else None
        known[symbol] = out
        return out

    def parse(self, text: str):
        """(first actions, steps, index of the accepting path in the last state), or the place of the fault."""
        if len(self.states) > MAX_STATES:
            self._reset()
        state, first = self.begin()
        path, steps = [], self.steps
        for k, symbol in enumerate(text):
            step = steps[state].get(symbol) or self.step(state, symbol)
            if step is None:
                return k
            path.append(step)
            state = step.state
        nodes = self.states[state]
        return (first, path, nodes.index(self.graph.end)) if self.graph.end in nodes else len(text)

    def trace(self, parsed, text: str) -> list[tuple[tuple, str]]:
        """The actions of the accepted path, in order, with the symbol read before them."""
        first, path, at = parsed
        out = []
        for k in range(len(path) - 1, -1, -1):
            out.append((path[k].actions[at], text[k]))
            at = path[k].parents[at]
        out.append((first[at], ""))
        out.reverse()
        return out

    def run(self, text: str) -> Outcome:
        parsed = self.parse(text)
        if isinstance(parsed, int):
            return Outcome(False, None, parsed)
        if self.plain:
            return Outcome(True, "".join([a if isinstance(a, str) else symbol for actions, symbol in self.trace(parsed, text) for a in actions]), None)
        registers = Registers(self.copying)
        for actions, symbol in self.trace(parsed, text):
            for a in actions:
                registers.run(a, symbol)
        return Outcome(True, registers.flush(), None)

    def accepts(self, text: str) -> bool:
        return not isinstance(self.parse(text), int)

    def parse_codes(self, text: str) -> list[int] | None:
        """Alternatives taken and ranks of symbols read, in order; None if the input is rejected."""
        parsed = self.parse(text)
        if isinstance(parsed, int):
            return None
        return [a[1] for actions, _ in self.trace(parsed, text) for a in actions if not isinstance(a, str) and a[0] == "code"]

    def backtrack(self, text: str) -> Outcome:
        """The same result by depth-first search that marks (node, place) once left."""
        nodes, graph, furthest = self.graph.nodes, self.graph, 0
        seen: set[tuple[int, int]] = set()
        stack: list[tuple[int, int, tuple | None]] = [(graph.start, 0, None)]
        while stack:
            at, k, path = stack.pop()
            if (at, k) in seen:
                continue
            seen.add((at, k))
            node = nodes[at]
            if node.kind == "end":
                if at == graph.end and k == len(text):
                    actions = []
                    while path is not None:
                        path, what = path
                        actions.append(what)
                    registers = Registers(self.copying)
                    for action, symbol in reversed(actions):
                        registers.run(action, symbol)
                    return Outcome(True, registers.flush(), None)
            elif node.kind == "read":
                if k < len(text) and ord(text[k]) in node.chars:
                    furthest = max(furthest, k + 1)
                    stack.append((node.targets[0], k + 1, (path, (COPY, text[k])) if node.copies else path))
            elif node.kind == "act":
                stack.append((node.targets[0], k, (path, (node.act, ""))))
            else:
                stack.extend((t, k, path) for t in reversed(node.targets))
        return Outcome(False, None, furthest)

    def alphabet(self) -> list:
        """Classes of symbols that the stage does not tell apart."""
        return minterms({n.chars for n in self.graph.nodes if n.kind == "read"} - {ANY})


def _joined(actions: tuple) -> tuple:
    out: list = []
    for a in actions:
        if isinstance(a, str) and out and isinstance(out[-1], str):
            out[-1] += a
        else:
            out.append(a)
    return tuple(out)


class Incremental:
    """A stage fed piece by piece: output is given as soon as all live paths agree on it.

    State between pieces is small and plain (see `save`): the node from which all live
    paths come, the text read since, and the registers.
    """

    def __init__(self, machine: Machine, saved: dict | None = None):
        self.machine = machine
        self.node: int | None = None
        self.pending, self.failed, self.read = "", False, 0
        self.registers = Registers(machine.copying)
        if saved:
            self.node, self.pending, self.failed, self.read = saved["node"], saved["pending"], saved["failed"], saved["read"]
            self.registers.store, self.registers.stack = dict(saved["store"]), [list(x) for x in saved["stack"]]

    def save(self) -> dict:
        return {"node": self.node, "pending": self.pending, "failed": self.failed, "read": self.read, "store": self.registers.store, "stack": self.registers.stack}

    def push(self, piece: str) -> str:
        """Read more; returns the output that is now certain, empty once the input has failed."""
        if self.failed:
            return ""
        text = self.pending + piece
        path = self._path(text)
        if path is None:
            return ""
        first, steps, state = path
        # the last place where all live paths have one ancestor
        live = set(range(len(self.machine.states[state])))
        common, at = (len(steps), next(iter(live))) if len(live) == 1 else (0, -1)
        if len(live) > 1:
            for k in range(len(steps) - 1, -1, -1):
                live = {steps[k].parents[i] for i in live}
                if len(live) == 1:
                    common, at = k, next(iter(live))
                    break
        if at < 0 or (common == 0 and self.node is not None):
            self.pending = text
            return ""
        node = self.machine.states[steps[common - 1].state][at] if common else self.machine.states[self.machine.begin(self.node)[0]][at]
        self._act(first, steps[:common], at, text)
        self.node, self.pending = node, text[common:]
        return self.registers.flush() if len(self.registers.stack) == 1 else ""

    def finish(self) -> tuple[bool, str]:
        """(accepted, rest of the output)."""
        if self.failed:
            return False, ""
        path = self._path(self.pending)
        if path is None:
            return False, ""
        first, steps, state = path
        nodes = self.machine.states[state]
        if self.machine.graph.end not in nodes:
            self.failed = True
            return False, ""
        self._act(first, steps, nodes.index(self.machine.graph.end), self.pending)
        return True, self.registers.flush()

    def _path(self, text: str):
        state, first = self.machine.begin(self.node)
        steps = []
        for symbol in text:
            step = self.machine.step(state, symbol)
            if step is None:
                self.failed = True
                return None
            steps.append(step)
            state = step.state
        return first, steps, state

    def _act(self, first, steps, at: int, text: str) -> None:
        for actions, symbol in self.machine.trace((first, steps, at), text):
            for a in actions:
                self.registers.run(a, symbol)


def summary(machine: Machine, text: str, final: bool) -> dict[int, tuple[int, ...]]:
    """For every read node the nodes that a path waiting there can be at after the text, best first.

    Summaries of consecutive chunks compose, so chunks can be read in parallel.
    """
    out = {}
    for at, node in enumerate(machine.graph.nodes):
        if node.kind != "read":
            continue
        state, alive = machine.begin(at)[0], True
        for symbol in text:
            step = machine.step(state, symbol)
            if step is None:
                alive = False
                break
            state = step.state
        if alive:
            nodes = machine.states[state]
            out[at] = tuple(n for n in nodes if (n == machine.graph.end) == final)
    return out


def between(machine: Machine, text: str, entry: int | None, leave: int) -> list[tuple[tuple, str]]:
    """The actions of the best path from one node to another over a text; entry None is the start."""
    state, first = machine.begin(entry)
    steps = []
    for symbol in text:
        step = machine.step(state, symbol)
        steps.append(step)
        state = step.state
    return machine.trace((first, steps, machine.states[state].index(leave)), text)
