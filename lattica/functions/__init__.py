from .bounds import above, at_least, between_bounds
from .semiring import BOOL, COUNT, MIN, MINPLUS, Semiring

__all__ = ["BOOL", "COUNT", "MIN", "MINPLUS", "Semiring", "above", "at_least", "between_bounds"]
