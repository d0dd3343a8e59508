"""Rules to DataFrames: selections per atom, a connected fold of joins, and a projected head."""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.fixpoint import FixpointLimit
from lattica.operators.layers import Layers
from lattica.operators.relation import Relation
from lattica.plans.language import Atom, Const, Program, Query, Rule, Test, Var, parse_program, parse_query, parse_rule
from lattica.plans.planner import check, join_order, planned_order, without_redundant
from lattica.session import checkpointed

_TESTS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "!=": operator.ne}
_TYPES = {"long": "bigint", "int": "bigint", "u32": "bigint", "i32": "bigint", "usize": "bigint", "isize": "bigint", "string": "string", "str": "string", "double": "double", "bool": "boolean"}


class Engine:
    """Stored relations by name, functions by name, and rules over both.

    ``functions`` maps a name to a callable from input columns to one output column; the last
    argument of such an atom is the output. A null output is an undefined one.
    """

    def __init__(self, spark: SparkSession, relations: Mapping[str, DataFrame] | None = None, functions: Mapping[str, Callable[..., Column]] | None = None):
        self.spark, self.relations, self.functions = spark, dict(relations or {}), dict(functions or {})

    def atom(self, atom: Atom, stored: DataFrame | None = None) -> Relation:
        """Constants and repeated variables become filters below any join; columns take the variables' names."""
        if stored is None:
            if atom.pred not in self.relations:
                raise KeyError(f"no relation {atom.pred!r}")
            stored = self.relations[atom.pred]
        if len(stored.columns) != len(atom.args):
            raise ValueError(f"{atom.pred} has {len(stored.columns)} columns, {atom} gives {len(atom.args)}")
        df, first = stored, {}
        for column, term in zip(stored.columns, atom.args, strict=True):
            if isinstance(term, Const):
                df = df.where(F.col(column) == F.lit(term.value))
            elif term.name in first:
                df = df.where(F.col(column) == F.col(first[term.name]))
            else:
                df = df.where(F.col(column).isNotNull())
                first[term.name] = column
        if not first:
            return Relation(df.select().limit(1), ())
        return Relation(df.select(*[F.col(c).alias(v) for v, c in first.items()]), tuple(first))

    def body(self, query: Query, order: Sequence[str] | None = None, override: tuple[int, DataFrame] | None = None) -> DataFrame:
        """All bindings of the variables of ``query``; ``override`` replaces one atom's relation."""
        query = without_redundant(query) if override is None else query
        check(query, functions=self.functions)
        where = {id(a): i for i, a in enumerate(query.atoms)}
        stored = [a for a in query.atoms if not a.negated and a.pred not in self.functions]
        ranked = join_order(stored, order or planned_order(query))
        if override is not None:  # the delta is the smallest input: it goes first
            lead = query.atoms[override[0]]
            rest = join_order([a for a in stored if a is not lead], order or planned_order(query))
            ranked, bound = [lead], set(lead.variables)
            while rest:
                near = next((a for a in rest if bound & set(a.variables)), rest[0])
                rest.remove(near)
                ranked.append(near)
                bound |= set(near.variables)
        source = lambda a: override[1] if override is not None and where[id(a)] == override[0] else None
        out = self.atom(ranked[0], source(ranked[0]))
        tests, calls = list(query.tests), [a for a in query.atoms if a.pred in self.functions]
        for a in [None, *ranked[1:]]:
            if a is not None:
                out = out.join(self.atom(a, source(a)))
            out, tests, calls = self._ready(out, tests, calls)
        for a in query.atoms:
            if a.negated:
                out = self._without(out, self.atom(Atom(a.pred, a.args)))
        return out.df

    def _ready(self, out: Relation, tests: list[Test], calls: list[Atom]) -> tuple[Relation, list[Test], list[Atom]]:
        column = lambda t: F.lit(t.value) if isinstance(t, Const) else F.col(t.name)
        while ready := next((a for a in calls if all(isinstance(t, Const) or t.name in out.keys for t in a.args[:-1])), None):
            value, target = self.functions[ready.pred](*map(column, ready.args[:-1])), ready.args[-1]
            out = out.where(value == column(target)) if isinstance(target, Const) else out.extend(target.name, value, partial=True)
            calls = [a for a in calls if a is not ready]
        later = []
        for t in tests:
            if all(v in out.keys for v in t.variables):
                out = out.where(_TESTS[t.op](column(t.left), column(t.right)))
            else:
                later.append(t)
        return out, later, calls

    @staticmethod
    def _without(out: Relation, absent: Relation) -> Relation:
        if absent.keys:
            return out.antijoin(absent)
        return Relation(out.df.join(absent.df.withColumn("__one", F.lit(1)), F.lit(True), "left_anti"), out.keys)

    def query(self, query: str | Query, order: Sequence[str] | None = None) -> DataFrame:
        """Distinct bindings, columns in ``order`` (default: first occurrence)."""
        query = parse_query(query) if isinstance(query, str) else query
        columns = list(order) if order else list(dict.fromkeys(v for a in query.atoms if not a.negated for v in a.variables))
        body = self.body(query, order)
        return body.select(*columns).distinct() if columns else body.select(F.lit(True).alias("holds")).limit(1)

    def rule(self, rule: str | Rule, override: tuple[int, DataFrame] | None = None) -> DataFrame:
        """The head's tuples, always distinct; variables that the head leaves out never leak."""
        rule = parse_rule(rule) if isinstance(rule, str) else rule
        check(rule.body, rule.head, self.functions)
        body = self.body(rule.body, override=override)
        if not rule.head.args:
            return body.select(F.lit(True).alias("holds")).limit(1)
        columns = [(F.lit(t.value) if isinstance(t, Const) else F.col(t.name)).alias(f"c{i}") for i, t in enumerate(rule.head.args)]
        return body.select(*columns).distinct()

    def run(self, program: str | Program, max_rounds: int | None = None) -> dict[str, DataFrame]:
        """Extension: several rules a head, mutual recursion, and negation between strata.

        Returns the derived relations, and stores them under their names. Each stratum is evaluated
        semi-naively: a round joins the last deltas, one recursive atom at a time.
        """
        program = parse_program(program) if isinstance(program, str) else program
        for s in program.signatures:
            if s.pred not in self.relations:
                schema = ", ".join(f"c{i} {_TYPES.get(t, t)}" for i, t in enumerate(s.types))
                self.relations[s.pred] = self.spark.createDataFrame([], schema)
        out: dict[str, DataFrame] = {}
        for stratum in strata(program):
            out |= self._stratum([r for r in program.rules if r.head.pred in stratum], stratum, max_rounds)
        return out

    def _stratum(self, rules: list[Rule], heads: set[str], max_rounds: int | None) -> dict[str, DataFrame]:
        given = {h: self.relations[h] for h in heads if h in self.relations}
        inner = [(r, [i for i, a in enumerate(r.body.atoms) if a.pred in heads and not a.negated]) for r in rules]
        found: dict[str, list[DataFrame]] = {h: [] for h in heads}
        for h in heads & set(given):
            found[h].append(given[h])
        for r, recursive in inner:
            if not recursive:
                found[r.head.pred].append(self.rule(r))
        arity = {r.head.pred: max(1, len(r.head.args)) for r in rules}
        total = {h: Layers() for h in heads}
        deltas: dict[str, tuple[Relation, int]] = {}
        for h in heads:
            if found[h]:
                deltas[h] = self._new(found[h], arity[h], None)
        rounds = 0
        while any(n for _, n in deltas.values()):
            if max_rounds is not None and rounds >= max_rounds:
                raise FixpointLimit(f"no fixpoint after {rounds} rounds")
            for h, (d, n) in deltas.items():
                total[h].push(d, n)
            for h in heads:
                if total[h].layers:
                    self.relations[h] = total[h].total().df
            found = {h: [] for h in heads}
            for r, recursive in inner:
                for i in recursive:
                    pred = r.body.atoms[i].pred
                    if deltas.get(pred, (None, 0))[1] and all(r.body.atoms[j].pred in self.relations for j in recursive):
                        found[r.head.pred].append(self.rule(r, (i, deltas[pred][0].df)))
            deltas = {h: self._new(found[h], arity[h], total[h].total() if total[h].layers else None) for h in heads if found[h]}
            rounds += 1
        out = {}
        for h in heads:
            if total[h].layers:
                out[h] = self.relations[h] = total[h].total().df
            elif h in self.relations:
                out[h] = self.relations[h]
            else:
                out[h] = self.relations[h] = self.spark.createDataFrame([], ", ".join(f"c{i} bigint" for i in range(arity[h])))
        return out

    @staticmethod
    def _new(frames: list[DataFrame], arity: int, known: Relation | None) -> tuple[Relation, int]:
        names = [f"c{i}" for i in range(arity)]
        stacked = frames[0].toDF(*names)
        for f in frames[1:]:
            stacked = stacked.union(f.toDF(*names))
        new = Relation.as_set(stacked, *names)
        if known is not None:
            new = new.antijoin(known)
        new = new._with(checkpointed(new.df))
        return new, new.count()


def strata(program: Program) -> list[set[str]]:
    """Groups of mutually recursive heads, each after what it uses; negation within a group is refused."""
    heads = {r.head.pred for r in program.rules}
    uses = {h: {a.pred for r in program.rules if r.head.pred == h for a in r.body.atoms if a.pred in heads} for h in heads}
    reach = {h: set(uses[h]) for h in heads}
    changed = True
    while changed:
        changed = False
        for h in heads:
            more = set().union(*(reach[x] for x in reach[h])) - reach[h] if reach[h] else set()
            if more:
                reach[h] |= more
                changed = True
    for r in program.rules:
        for a in r.body.atoms:
            if a.negated and a.pred in heads and r.head.pred in reach[a.pred] | {a.pred}:
                raise ValueError(f"{r.head.pred} depends on its own negation through {a.pred}")
    groups: list[set[str]] = []
    for h in sorted(heads):
        group = {x for x in heads if x == h or x in reach[h] and h in reach[x]}
        if group not in groups:
            groups.append(group)
    return sorted(groups, key=lambda g: len(set().union(*(reach[h] for h in g)) | g))
