"""The function library as Column functions, one module for each family."""

from . import bigint, groups, maps, numeric, options, selectors, sets, strings, values, vectors

__all__ = ["bigint", "groups", "maps", "numeric", "options", "selectors", "sets", "strings", "values", "vectors"]
