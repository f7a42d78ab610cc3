"""The machine over many texts at once: rows step together through one table of symbol classes.

A step of the automaton depends on a symbol only by its class (see `minterms`), so a block
of texts becomes an array of classes, and the states of all rows are advanced by one
gather for each place. The steps taken are kept as integers; the accepted paths are traced
back in the same way, and the output of a block is put together at once. New steps of the
automaton are asked of the machine when a row first needs them. Where few rows are left
(the ends of the longest texts) they go on one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from textloom.functions.charset import TOP, minterms

from .machine import COPY, MAX_STATES, Machine, Outcome, Registers

#: Symbols of a block, and rows below which they are stepped one by one.
BLOCK, FEW = 1 << 21, 12
#: Symbols of a block whose output is put together at once.
PART = 1 << 18


def blocks(lengths: Sequence[int | None], most: int | None = None) -> Iterator[list[int]]:
    """The places of texts of these lengths, in blocks of at most BLOCK symbols (or one text) and `most` texts, the longest texts first."""
    rows = [k for k, n in enumerate(lengths) if n is not None]
    # texts of a block are of like length, so that few places have few rows
    rows.sort(key=lambda k: -lengths[k])
    at = 0
    while at < len(rows):
        size, stop = 0, at
        while stop < len(rows) and (stop == at or size + lengths[rows[stop]] <= BLOCK) and (most is None or stop - at < most):
            size += lengths[rows[stop]]
            stop += 1
        yield rows[at:stop]
        at = stop


class Batch:
    """A machine without parse codes, run over lists of texts."""

    def __init__(self, machine: Machine):
        self.machine = machine
        parts = minterms(sorted({n.chars for n in machine.graph.nodes if n.kind == "read"}, key=lambda s: s.ranges))
        self.classes = len(parts)
        self.symbols = [chr(p.low) for p in parts]
        self.class_of = np.zeros(TOP + 1, dtype=np.int16)
        for k, part in enumerate(parts):
            for a, b in part.ranges:
                self.class_of[a : b + 1] = k
        self._reset()

    def _reset(self) -> None:
        self.machine._reset()
        self.begin, self.opening = self.machine.begin()
        # by state and class: the step, -1 if it is not known, -2 if there is none
        self.table = np.full(64 * self.classes, -1, dtype=np.int32)
        # by step: the next state (its row of the table), and where its paths begin in parents and acts
        self.next, self.base, self.parents, self.acts = [0], [0], [0], [0]
        self.actions: dict[tuple, int] = {(): 0}
        self._frozen = (0, None)

    def _step(self, row: int, symbol_class: int) -> int:
        """The step from a row of the table, asked of the machine."""
        found = self.machine.step(row // self.classes, self.symbols[symbol_class])
        number = -2
        if found is not None:
            number = len(self.next)
            self.next.append(found.state * self.classes)
            self.base.append(len(self.parents))
            self.parents.extend(found.parents)
            self.acts.extend(self.actions.setdefault(a, len(self.actions)) for a in found.actions)
        while len(self.table) < len(self.machine.states) * self.classes:
            self.table = np.concatenate([self.table, np.full(len(self.table), -1, dtype=np.int32)])
        self.table[row + symbol_class] = number
        return number

    def _tables(self):
        """next, base, parents and acts as arrays."""
        if self._frozen[0] != len(self.next):
            self._frozen = (len(self.next), tuple(np.array(x, dtype=np.int64) for x in (self.next, self.base, self.parents, self.acts)))
        return self._frozen[1]

    def run(self, texts: Sequence[str | None]) -> list[Outcome | None]:
        """The outcome of each text, None for None."""
        out: list[Outcome | None] = [None] * len(texts)
        for rows in blocks([None if t is None else len(t) for t in texts]):
            for k, done in zip(rows, self._block([texts[k] for k in rows]), strict=True):
                out[k] = done
        return out

    def between(self, texts: Sequence[str], entries: Sequence[int | None], leaves: Sequence[int]) -> list[str]:
        """What the best path from one node to another writes over each text (see `machine.between`)."""
        out = [""] * len(texts)
        for rows in blocks([len(t) for t in texts]):
            for k, done in zip(rows, self._block([texts[k] for k in rows], [entries[k] for k in rows], [leaves[k] for k in rows]), strict=True):
                out[k] = done.value
        return out

    def summaries(self, texts: Sequence[str], opens: Sequence[bool]) -> list[dict[int, tuple[int, ...]]]:
        """For every read node the nodes that a path waiting there can be at after the text, the end among them, best first.

        Of a text that opens a document only the paths from the start are read, under the key -1.
        """
        nodes = [k for k, n in enumerate(self.machine.graph.nodes) if n.kind == "read"]
        out: list[dict[int, tuple[int, ...]]] = [{} for _ in texts]
        for rows in blocks([len(t) for t in texts], max(1, BLOCK // 4 // max(1, len(nodes)))):
            if len(self.machine.states) > MAX_STATES:
                self._reset()
            starts = {-1: self.begin} | {n: self.machine.begin(n)[0] for n in nodes}
            entries = [[-1] if opens[k] else nodes for k in rows]
            length = np.array([len(texts[k]) for k in rows], dtype=np.int64)
            data = np.frombuffer("".join([texts[k] for k in rows]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            path = np.repeat(np.arange(len(rows)), [len(e) for e in entries])
            state = self._meet(self.class_of[data], np.cumsum(length) - length, length, path, np.array([starts[n] for e in entries for n in e], dtype=np.int64) * self.classes)
            # texts whose paths end in the same states share one summary
            seen: dict[tuple, dict] = {}
            found, at = state.tolist(), 0
            for k, e in zip(rows, entries, strict=True):
                ends = (opens[k], *found[at : at + len(e)])
                at += len(e)
                if ends not in seen:
                    seen[ends] = {n: self.machine.states[s // self.classes] for n, s in zip(e, ends[1:], strict=True) if s >= 0}
                out[k] = seen[ends]
        return out

    def _meet(self, classes, begin, length, text, state):
        """The state of each path (its text, its first state) after its text, -1 if it cannot read it.

        Paths of a text that have come to one state go on as one. Texts are sorted by length, the longest first.
        """
        run, t, longest = np.arange(len(text)), 0, int(length.max(initial=0))
        live, follow = np.flatnonzero(length[text] > 0), self._tables()[0]
        while t < longest and len(live) > FEW:
            if length[text[live[-1]]] <= t:
                live = live[: int(np.searchsorted(-length[text[live]], -t, side="left"))]
                continue
            now = state[live] + classes[begin[text[live]] + t]
            step = self.table[now]
            if step.min() < 0:
                for row in np.unique(now[step == -1]).tolist():
                    self._step(row // self.classes * self.classes, row % self.classes)
                step, follow = self.table[now], self._tables()[0]
                state[live[step < 0]] = -1
                live, step = live[step >= 0], step[step >= 0]
            state[live] = follow[step]
            t += 1
            if (t & (t - 1) == 0 or t % 64 == 0) and len(live) > 1 and (text[live[1:]] == text[live[:-1]]).any():
                wide = len(self.machine.states) * self.classes + 1
                keys, place = np.unique(text * wide + state + 1, return_inverse=True)
                run, text, state = place[run], keys // wide, keys % wide - 1
                live = np.flatnonzero((state >= 0) & (length[text] > t))
        for r in live.tolist():
            row, low = int(state[r]), int(begin[text[r]])
            for c in classes[low + t : low + int(length[text[r]])].tolist():
                step = int(self.table[row + c])
                if step == -1:
                    step = self._step(row, c)
                if step < 0:
                    row = -1
                    break
                row = self.next[step]
            state[r] = row
        return state[run]

    def _block(self, texts: list[str], entries: list[int | None] | None = None, leaves: list[int] | None = None) -> list[Outcome]:
        """Outcomes of texts that are sorted by length, the longest first; between nodes where these are given."""
        if len(self.machine.states) > MAX_STATES:
            self._reset()
        entries = entries or [None] * len(texts)
        starts = {n: self.begin if n is None else self.machine.begin(n)[0] for n in set(entries)}
        openings = [self.opening if n is None else ((),) for n in entries]
        length = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.cumsum(length) - length
        data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        classes = self.class_of[data]
        trace = np.zeros(len(data), dtype=np.int32)
        # places up to which rows step together
        together = int(length[FEW]) if len(texts) > FEW else 0
        state, fault = self._forward(classes, begin, length, trace, together, np.array([starts[n] for n in entries], dtype=np.int64) * self.classes)
        ends = {}
        at = np.full(len(texts), -1, dtype=np.int64)
        for r in np.flatnonzero(fault < 0):
            end = (int(state[r]) // self.classes, self.machine.graph.end if leaves is None else leaves[r])
            if end not in ends:
                nodes = self.machine.states[end[0]]
                ends[end] = nodes.index(end[1]) if end[1] in nodes else -1
            at[r] = ends[end]
            if at[r] < 0:
                fault[r] = length[r]
        acts = np.zeros(len(data), dtype=np.int32)
        self._back(begin, length, trace, together, at, fault < 0, acts)
        return self._written(data, begin, length, acts, at, fault, openings)

    def _forward(self, classes, begin, length, trace, together, state):
        fault = np.full(len(length), -1, dtype=np.int64)
        live = np.flatnonzero(length > 0)
        follow = self._tables()[0]
        for t in range(together):
            if length[live[-1]] <= t:
                live = live[: int(np.searchsorted(-length[live], -t, side="left"))]
            if not len(live):
                break
            place = begin[live] + t
            now = state[live] + classes[place]
            step = self.table[now]
            if step.min() < 0:
                for row in np.unique(now[step == -1]).tolist():
                    self._step(row // self.classes * self.classes, row % self.classes)
                step = self.table[now]
                follow = self._tables()[0]
                dead = step < 0
                if dead.any():
                    fault[live[dead]] = t
                    live, place, step = live[~dead], place[~dead], step[~dead]
                    if not len(live):
                        break
            trace[place] = step
            state[live] = follow[step]
        for r in np.flatnonzero((length > together) & (fault < 0)).tolist():
            row, low = int(state[r]), int(begin[r])
            taken: list[int] = []
            for c in classes[low + together : low + int(length[r])].tolist():
                step = int(self.table[row + c])
                if step == -1:
                    step = self._step(row, c)
                if step < 0:
                    fault[r] = together + len(taken)
                    break
                taken.append(step)
                row = self.next[step]
            trace[low + together : low + together + len(taken)] = taken
            state[r] = row
        return state, fault

    def _back(self, begin, length, trace, together, at, good, acts) -> None:
        """Trace the accepted paths back: the actions of each place, and in `at` the path taken at the beginning."""
        _, base, parents, does = self._tables()
        for r in np.flatnonzero(good & (length > together)).tolist():
            low, path, done = int(begin[r]), int(at[r]), []
            for step in trace[low + together : low + int(length[r])][::-1].tolist():
                path += self.base[step]
                done.append(self.acts[path])
                path = self.parents[path]
            acts[low + together : low + int(length[r])] = done[::-1]
            at[r] = path
        rows = np.flatnonzero(good)
        many = np.searchsorted(-length[rows], -np.arange(together), side="left")
        for t in range(together - 1, -1, -1):
            here = rows[: many[t]]
            if len(here):
                place = begin[here] + t
                path = base[trace[place]] + at[here]
                acts[place] = does[path]
                at[here] = parents[path]

    def _written(self, data, begin, length, acts, at, fault, openings) -> list[Outcome]:
        kinds = list(self.actions)
        copies = np.array([len(a) > 0 and a[0] is COPY for a in kinds])
        events = np.array([any(not isinstance(x, str) and x is not COPY for x in a) for a in kinds])
        texts = ["" if e else "".join(x for x in a if isinstance(x, str)) for a, e in zip(kinds, events, strict=True)]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        pool = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        copies &= ~events
        done: list[Outcome] = []
        at_rows, row = at.tolist(), 0
        while row < len(length):
            # rows whose symbols fit one part, or a row of several parts: what a part needs does not grow with the block
            stop = row + 1
            while stop < len(length) and begin[stop] + length[stop] - begin[row] <= PART:
                stop += 1
            low, high = int(begin[row]), int(begin[stop - 1] + length[stop - 1])
            outs = []
            for r in range(row, stop):
                outs.append(Registers(self.machine.copying))
                if fault[r] < 0:
                    for a in openings[r][at_rows[r]]:
                        outs[-1].run(a, "")
            for a in range(low, max(high, low + 1), PART):
                b = min(a + PART, high)
                does = acts[a:b]
                copied = copies[does]
                # what each symbol writes, an event nothing
                wide = copied + sizes[does]
                off = np.concatenate([[0], np.cumsum(wide)])
                out = np.empty(int(off[-1]), dtype="<u4")
                some = np.flatnonzero(copied)
                out[off[some]] = data[a:b][some]
                some = np.flatnonzero(sizes[does])
                if len(some):
                    n, which = sizes[does[some]], does[some]
                    turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    out[np.repeat(off[some] + copied[some], n) + turn] = pool[np.repeat((np.cumsum(sizes) - sizes)[which], n) + turn]
                written = out.tobytes().decode("utf-32-le", "surrogatepass")
                acted = None if self.machine.plain else np.flatnonzero(events[does])
                for r in range(row, stop):
                    if fault[r] >= 0:
                        continue
                    registers = outs[r - row]
                    last, end = max(int(begin[r]), a) - a, min(int(begin[r] + length[r]), b) - a
                    if acted is not None:
                        for k in acted[np.searchsorted(acted, last) : np.searchsorted(acted, end)].tolist():
                            registers.run(written[off[last] : off[k]], "")
                            for what in kinds[does[k]]:
                                registers.run(what, chr(data[a + k]))
                            last = k
                    registers.run(written[off[last] : off[end]], "")
            for r in range(row, stop):
                done.append(Outcome(True, outs[r - row].flush(), None) if fault[r] < 0 else Outcome(False, None, int(fault[r])))
            row = stop
        return done
