"""Regular-grammar text transduction over Spark DataFrames."""

from textloom.operators.program import Program, compile_program, compile_regex, load_program
from textloom.plans.syntax import ProgramError

__all__ = ["Program", "ProgramError", "compile_program", "compile_regex", "load_program"]
