from .compile import Engine
from .language import Atom, Const, Program, Query, Rule, Signature, Var, parse_atom, parse_program, parse_query, parse_rule
from .planner import UnsafeQuery, explain, plan, subsequence, variable_order

__all__ = ["Atom", "Const", "Engine", "Program", "Query", "Rule", "Signature", "UnsafeQuery", "Var", "explain", "parse_atom", "parse_program", "parse_query", "parse_rule", "plan", "subsequence", "variable_order"]
