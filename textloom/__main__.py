"""python -m textloom COMMAND PROGRAM [options]: programs without a cluster.

run reads standard input as one text and writes the output (exit code 1 and the place of
the fault if it is rejected); explain says how each stage would run in Spark; dot draws
the automaton of a stage. --time adds the seconds of each phase on standard error.
"""

from __future__ import annotations

import argparse
import sys
import time

from textloom.operators.program import load_program


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    parser.add_argument("command", choices=["run", "explain", "dot"])
    parser.add_argument("program", help="a file of the language, or of a regex (.re, .rx)")
    parser.add_argument("--engine", choices=["kernel", "backtrack"], default="kernel")
    parser.add_argument("--stage", type=int, default=0, help="stage to draw")
    parser.add_argument("--metric", choices=["lcs", "hamming", "levenshtein"], default="lcs")
    parser.add_argument("--mode", choices=["correction", "matching", "explicit"], default="correction")
    parser.add_argument("--time", action="store_true")
    given = parser.parse_args(arguments)
    seconds, begun = {}, time.perf_counter()

    def phase(name: str) -> None:
        nonlocal begun
        now = time.perf_counter()
        seconds[name], begun = now - begun, now

    options = {} if given.program.endswith((".re", ".rx")) else {"metric": given.metric, "mode": given.mode}
    program = load_program(given.program, **options)
    phase("compile")
    code = 0
    if given.command == "run":
        text = sys.stdin.read()
        phase("read")
        out = program.run(text, given.engine)
        phase("run")
        if out.ok:
            sys.stdout.write(out.value)
        else:
            where = "" if out.error_pos is None else f" at symbol {out.error_pos}"
            print(f"rejected{where}", file=sys.stderr)
            code = 1
    else:
        print(program.explain() if given.command == "explain" else program.to_dot(given.stage))
        phase(given.command)
    if given.time:
        for name, spent in seconds.items():
            print(f"{name}: {spent:.6f} s", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
