"""A growing relation as few durable layers of geometrically falling sizes."""

from __future__ import annotations

from dataclasses import dataclass, field

from lattica.operators.relation import Relation, merge_all
from lattica.session import checkpointed


@dataclass
class Layers:
    """Push deltas; a layer merges into its predecessor once that is less than twice its size.

    Each tuple is thus rewritten O(log n) times, while readers union O(log n) frames.
    """

    layers: list[tuple[Relation, int]] = field(default_factory=list)
    #: Tuples in deltas must be new (sets), or combine by the semiring (bags and maps).
    disjoint: bool = True

    def push(self, delta: Relation, size: int | None = None) -> None:
        size = delta.count() if size is None else size
        if size == 0:
            return
        self.layers.append((delta, size))
        while len(self.layers) > 1 and self.layers[-2][1] < 2 * self.layers[-1][1]:
            (new, n), (old, m) = self.layers.pop(), self.layers.pop()
            merged = self._merge([old, new])
            # A union adds up its inputs' partitions: keep their number bounded.
            most = int(merged.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            merged = merged._with(checkpointed(merged.df.coalesce(most)))
            self.layers.append((merged, m + n if self.disjoint else merged.count()))

    def _merge(self, relations: list[Relation]) -> Relation:
        if self.disjoint and relations[0].kind == "set":
            out = relations[0].df
            for r in relations[1:]:
                out = out.unionByName(r.df)
            return relations[0]._with(out)
        return merge_all(relations)

    def total(self) -> Relation:
        """All tuples so far; equal ones combined."""
        if not self.layers:
            raise ValueError("nothing was pushed")
        return self._merge([r for r, _ in self.layers])

    def compress(self) -> Relation:
        out = self.total()
        out = out._with(checkpointed(out.df))
        self.layers = [(out, out.count())]
        return out
