"""Closed-form measures of expressions as column expressions over the label array, and their categories."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from exprlake.functions.grammar import CODES

#: Nodes that a label adds to its children in the pure EML tree, and what it adds to the estimated cost.
EML_WEIGHT = {"x": 1, "y": 1, "1": 1, "exp": 2, "log": 6, "Add": 25, "Mul": 39}
COST_WEIGHT = {"x": 1, "y": 1, "1": 1, "exp": 3, "log": 6, "Add": 26, "Mul": 34}
#: Depth of an operator's EML tree, given the children's depths a and b.
EML_DEPTH = {"exp": "{a} + 1", "log": "{a} + 3", "Add": "greatest(9, {a} + 4, {b} + 4)", "Mul": "greatest(10, {a} + 8, {b} + 8)"}
#: Bucket labels with their upper bounds, inclusive for counts, exclusive for alpha.
AST_NODE_BUCKETS = (("1-3", 3), ("4-7", 7), ("8-15", 15), ("16-31", 31), ("32+", None))
AST_DEPTH_BUCKETS = (("0-1", 1), ("2", 2), ("3", 3), ("4", 4), ("5+", None))
EML_NODE_BUCKETS = (("1-15", 15), ("16-31", 31), ("32-63", 63), ("64-127", 127), ("128-255", 255), ("256+", None))
ALPHA_BUCKETS = (("0-<2", 2), ("2-<5", 5), ("5-<10", 10), ("10-<15", 15), ("15+", None))
FAMILIES = ("Add", "Mul", "exp", "log")


def threshold(k: int = 4, variables: int = 3) -> float:
    """The alpha below which an EML tree pays off: 1 + ln k / ln (4 l)."""
    return 1 + math.log(k) / math.log(4 * variables)


def bucket_sql(value: str, buckets, strict: bool = False) -> str:
    sign = "<" if strict else "<="
    whens = " ".join(f"WHEN {value} {sign} {high} THEN '{name}'" for name, high in buckets if high is not None)
    return f"CASE {whens} ELSE '{buckets[-1][0]}' END"


def string_step(k: str, a: str | None, b: str | None) -> str:
    """The canonical string of a place's subtree, null where there is none."""
    leaf = f"CASE {k} WHEN 1 THEN 'x' WHEN 2 THEN 'y' WHEN 3 THEN '1' END"
    if a is None:
        return leaf
    return f"CASE {k} WHEN 4 THEN concat('Add(', {a}, ', ', {b}, ')') WHEN 5 THEN concat('Mul(', {a}, ', ', {b}, ')') WHEN 6 THEN concat('exp(', {a}, ')') WHEN 7 THEN concat('log(', {a}, ')') ELSE {leaf} END"


def depth_step(k: str, a: str | None, b: str | None) -> str:
    """Depth of the pure EML tree of a place's subtree."""
    if a is None:
        return "0"
    return f"CASE {k} " + " ".join(f"WHEN {CODES[f]} THEN {EML_DEPTH[f].format(a=a, b=b)}" for f in FAMILIES) + " ELSE 0 END"


def value_step(k: str, a: str | None, b: str | None, x: float, y: float) -> str:
    """The value at x and y over the extended reals: log 0 is minus infinity, and what is undefined is not a number."""
    leaf = f"CASE {k} WHEN 1 THEN {x}D WHEN 2 THEN {y}D WHEN 3 THEN 1D END"
    if a is None:
        return leaf
    log = f"CASE WHEN {a} = 0 THEN double('-Infinity') WHEN {a} < 0 THEN double('NaN') ELSE ln({a}) END"
    return f"CASE {k} WHEN 4 THEN {a} + {b} WHEN 5 THEN {a} * {b} WHEN 6 THEN exp({a}) WHEN 7 THEN {log} ELSE {leaf} END"


def weighed(weights: dict) -> Column:
    """Sum of the labels' weights, from the counts; all leaves weigh one."""
    return F.expr(" + ".join(f"{weights[f]} * n_{f.lower()}" for f in FAMILIES) + " + n_symbols + n_constants")


def signature_sql(prefix: str = "n_") -> str:
    """Active families in fixed order, in SQL that Spark and DuckDB share."""
    parts = ", ".join(f"CASE WHEN {prefix}{f.lower()} > 0 THEN '{f}' END" for f in FAMILIES)
    return f"coalesce(nullif(concat_ws('+', {parts}), ''), 'leaf_only')"


def dominant_sql(prefix: str = "n_") -> str:
    """The most frequent family; ties are named together."""
    columns = [f"{prefix}{f.lower()}" for f in FAMILIES]
    most = f"greatest({', '.join(columns)})"
    parts = ", ".join(f"CASE WHEN {c} = {most} THEN '{f}' END" for c, f in zip(columns, FAMILIES, strict=True))
    ties = " + ".join(f"(CASE WHEN {c} = {most} THEN 1 ELSE 0 END)" for c in columns)
    return f"CASE WHEN {most} = 0 THEN 'leaf_only' WHEN {ties} > 1 THEN concat('mixed_', concat_ws('+', {parts})) ELSE concat_ws('+', {parts}) END"
