from .fixpoint import FixpointLimit, labelled_reach, min_reachable, semi_naive, transitive_closure
from .layers import Layers
from .multiway import closing_triangles, hypercube_triangles, orient, symmetric, triangles
from .relation import Relation, merge_all, natural_join, outer_all

__all__ = ["FixpointLimit", "Layers", "Relation", "closing_triangles", "hypercube_triangles", "labelled_reach", "merge_all", "min_reachable", "natural_join", "orient", "outer_all", "semi_naive", "symmetric", "transitive_closure", "triangles"]
