"""Secret scans with one automaton for all rules.

The rules are compiled together by subset construction and minimised; a text's bytes drive that one
automaton from end to end, once. Where it accepts a rule's head, the rule's backward automaton finds the leftmost
start behind the place and its forward automaton the longest end, so matches are those of a leftmost
greedy search, rule by rule, without overlaps.

Cases: null text is empty; a match that fails its rule's minimum is dropped and never retried; runs of
any length are scanned in linear time; an empty table gives an empty result; other columns are
ignored; rows with equal ids are scanned each.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.automata import compile_rules
from lattica.llm.common import documents, each_text, join_spans


@dataclass(frozen=True)
class Rule:
    """A match is ``head``, then any number of ``tail``.

    ``least`` is the least number of bytes of the whole match or, if ``valued``, of what is assigned.
    ``head`` alone is what the automaton first accepts, so looking back for a start never re-reads a tail.
    """

    kind: str
    head: str
    tail: str
    least: int
    valued: bool = False

    @property
    def pattern(self) -> str:
        return self.head + (f"{self.tail}*" if self.tail else "")


#: What is looked for.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]", 20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]", 24),
    Rule("github", "gh[opsur]_[A-Za-z0-9]", "[A-Za-z0-9]", 40),
    Rule("google", "AIza[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]", 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 20),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]", "[A-Za-z0-9-]", 15),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]", "[A-Za-z0-9]", 24),
)
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        # Tails would only multiply the states: a match is first accepted at the end of its head.
        self.all = compile_rules([r.head for r in rules], anywhere=True)
        self.forward = [compile_rules([r.pattern]) for r in rules]
        self.backward = [compile_rules([r.head], backward=True) for r in rules]

    def scan(self, data: bytes) -> list[tuple[int, int, str]]:
        """(start, end, kind) in bytes, in order of their first acceptance."""
        table, first, masks = self.all.table, self.all.first, self.all.rules
        done = [0] * len(self.rules)  # no match of a rule begins before
        found = []
        state = self.all.start
        for at, byte in enumerate(data):
            state = table[state | byte]
            if state >= first:
                mask = masks[state]
                for i, rule in enumerate(self.rules):
                    if mask >> i & 1 and at >= done[i]:
                        start = self._start(i, data, at, done[i])
                        if start < 0:
                            continue
                        end = self._end(i, data, start)
                        done[i] = end
                        if self._long_enough(rule, data, start, end):
                            found.append((start, end, rule.kind))
        return found

    def _start(self, i: int, data: bytes, at: int, least: int) -> int:
        dfa, state, start = self.backward[i], self.backward[i].start, -1
        while at >= least:
            state = dfa.table[state | data[at]]
            if state == dfa.dead:
                break
            if state >= dfa.first:
                start = at
            at -= 1
        return start

    def _end(self, i: int, data: bytes, at: int) -> int:
        dfa, state, end = self.forward[i], self.forward[i].start, at
        while at < len(data):
            state = dfa.table[state | data[at]]
            if state == dfa.dead:
                break
            at += 1
            if state >= dfa.first:
                end = at
        return end

    @staticmethod
    def _long_enough(rule: Rule, data: bytes, start: int, end: int) -> bool:
        if rule.valued:
            # The value begins after the keyword, then quotes, blanks and one separator, each at most as the rule has it.
            text = data[start:end]
            at = min(p for s in b":=" if (p := text.find(bytes([s]))) >= 0) + 1
            while text[at : at + 1] == b" ":
                at += 1
            at += text[at : at + 1] in (b'"', b"'")
            start += at
        return end - start >= rule.least

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """The same in code points."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.scan(data)
        if found and len(data) != len(text):
            places = sorted({p for s, e, _ in found for p in (s, e)})
            point, last, count = {}, 0, 0
            for p in places:
                count += len(data[last:p].decode("utf-8", "surrogatepass"))
                point[p], last = count, p
            found = [(point[s], point[e], k) for s, e, k in found]
        return sorted(found)


@lru_cache(maxsize=4)
def scanner_for(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once a Python worker."""
    return Scanner(rules)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base_sha256 and spans for each row."""
    kinds = tuple(r.kind for r in rules)

    def make():
        scanner = scanner_for(rules)

        def of(text: str) -> tuple:
            spans = scanner.spans(text)
            own = [s for s in spans if s[2] in base]
            counts = {k: len(list(g)) for k, g in groupby(sorted(s[2] for s in own))}
            return (*[counts.get(k, 0) for k in base], hashlib.sha256(join_spans(own, kinds).encode()).hexdigest(), join_spans(spans, kinds))

        return of

    return each_text(docs, make, ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
