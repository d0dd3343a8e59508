from .edges import edge_list, first_rows, labelled_edges, parse_cap, weighted_edges
from .tables import graph, table

__all__ = ["edge_list", "first_rows", "graph", "labelled_edges", "parse_cap", "table", "weighted_edges"]
