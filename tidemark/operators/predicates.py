"""Predicate trees in JSON, folded into one Column, so that Catalyst sees plain boolean algebra.

Keys that begin with '$' name registered methods; their value holds their arguments and their children.
Siblings are alternatives (or), a child narrows its parent (and): {"$a": {"$b": {}}, "$c": {}} is
(a and b) or c.  ``select`` takes methods that pick rows (as the newest n) where no predicate can: a node's rows
are what its method picks from its parent's, cut to the union of what its children pick from those.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Method = Callable[[dict], Column]


class Registry:
    """Methods by name; the first registration of a name stays."""

    def __init__(self, methods: dict[str, Method] | None = None):
        self.methods: dict[str, Method] = {}
        for name, method in (methods or {}).items():
            self.register(name, method)

    def register(self, name: str, method: Method) -> bool:
        if name in self.methods:
            return False
        self.methods[name] = method
        return True

    def fold(self, tree: dict | str | list) -> Column:
        """The Column of a tree; a list of pairs keeps repeated names apart."""
        tree = json.loads(tree, object_pairs_hook=list) if isinstance(tree, str) else tree
        return self._siblings(tree.items() if isinstance(tree, dict) else tree)

    def _siblings(self, items) -> Column:
        found = [self._node(k, v) for k, v in items if k.startswith("$")]
        return reduce(or_, found) if found else F.lit(True)

    def _node(self, name: str, value) -> Column:
        label = name[1:]
        if label not in self.methods:
            raise ValueError(f"no method {label!r}")
        items = list(value.items()) if isinstance(value, dict) else list(value or [])
        own = self.methods[label]({k: v for k, v in items if not k.startswith("$")})
        children = [(k, v) for k, v in items if k.startswith("$")]
        return own & self._siblings(children) if children else own

    def filter(self, df: DataFrame, tree: dict | str) -> DataFrame:
        return df.where(self.fold(tree))


def select(df: DataFrame, tree: dict | str, methods: dict[str, Callable[[DataFrame, dict], DataFrame]], identity: list[str]) -> DataFrame:
    """The rows of ``df`` that a tree of picking methods leaves; ``identity`` tells rows apart.  A tree without
    methods leaves all."""
    tree = json.loads(tree, object_pairs_hook=list) if isinstance(tree, str) else tree

    def siblings(rows: DataFrame, items) -> DataFrame | None:
        found = [node(rows, k[1:], v) for k, v in items if k.startswith("$")]
        return reduce(lambda a, b: a.union(b), found).dropDuplicates(identity) if len(found) > 1 else found[0] if found else None

    def node(rows: DataFrame, name: str, value) -> DataFrame:
        if name not in methods:
            raise ValueError(f"no method {name!r}")
        items = list(value.items()) if isinstance(value, dict) else list(value or [])
        own = methods[name](rows, {k: v for k, v in items if not k.startswith("$")})
        below = siblings(own, items)
        return own if below is None else own.join(below.select(*identity), identity, "left_semi")

    out = siblings(df, tree.items() if isinstance(tree, dict) else tree)
    return df if out is None else out


def standard() -> Registry:
    """Comparisons on a named field: group (min, max), same, match, in, contain."""
    field = lambda a: F.col(a["field"])
    return Registry(
        {
            "group": lambda a: (field(a) >= a["min"] if "min" in a else F.lit(True)) & (field(a) <= a["max"] if "max" in a else F.lit(True)),
            "same": lambda a: field(a) == a["value"],
            "match": lambda a: F.lower(field(a)).startswith(str(a["value"]).lower()),
            "in": lambda a: field(a).isin(a["values"]),
            "contain": lambda a: field(a).contains(a["value"]),
        }
    )


def search(tree, field: str | None = None) -> Column:
    """Search trees: an object is 'and', a list 'or'; text '[1,3]' is a closed and '(1,3)' an open interval."""
    if isinstance(tree, dict):
        parts = [search(v, k) for k, v in tree.items()]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    if isinstance(tree, list):
        return reduce(or_, [search(x, field) for x in tree]) if tree else F.lit(False)
    c = F.col(field)
    if isinstance(tree, str) and len(tree) > 2 and tree[0] in "([" and tree[-1] in ")]" and "," in tree:
        lo, hi = (float(x) for x in tree[1:-1].split(","))
        return (c >= lo if tree[0] == "[" else c > lo) & (c <= hi if tree[-1] == "]" else c < hi)
    return c == tree
