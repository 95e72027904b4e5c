"""The pure EML form: the compiler's macros as terms over one binary function, and the size of the shared DAG as a column.

A term's name is a hash of its children's names, so equal subtrees have one name. The size is counted over matrices of codes (batches), since
names made by a lambda for each row took most of a query's time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the variables and of one.
LEAVES = {1: "101L", 2: "102L", 3: "103L"}
ONE = LEAVES[3]


def pair(a: str, b: str) -> str:
    return f"xxhash64({a}, {b})"


def _exp(z: str) -> str:
    return pair(z, ONE)


def _log(z: str) -> list[str]:
    """The three terms of a logarithm, itself last."""
    inner = pair(ONE, z)
    return [inner, _exp(inner), pair(ONE, _exp(inner))]


def _sub(a: str, b: str) -> list[str]:
    return [*_log(a), _exp(b), pair(_log(a)[-1], _exp(b))]


def _add(a: str, b: str) -> list[str]:
    zero = _log(ONE)
    minus = _sub(zero[-1], b)
    return [*zero, *minus, *_sub(a, minus[-1])]


def _mul(a: str, b: str) -> list[str]:
    total = _add(_log(a)[-1], _log(b)[-1])
    return [*_log(a), *_log(b), *total, _exp(total[-1])]


def _neg(z: str) -> list[str]:
    zero = _log(ONE)
    return [*zero, *_sub(zero[-1], z)]


def _inv(z: str) -> list[str]:
    minus = _neg(_log(z)[-1])
    return [*_log(z), *minus, _exp(minus[-1])]


def _div(a: str, b: str) -> list[str]:
    inverse = _inv(b)
    return [*inverse, *_mul(a, inverse[-1])]


def _pow(a: str, b: str) -> list[str]:
    product = _mul(b, _log(a)[-1])
    return [*_log(a), *product, _exp(product[-1])]


def terms(a: str, b: str) -> dict[int, list[str]]:
    """By code of a label, SQL of the names of the terms that its macro adds over the operands a and b, the result last."""
    return {4: _add(a, b), 5: _mul(a, b), 6: [_exp(a)], 7: _log(a)}


def kinds(a: str, b: str) -> dict[str, list[str]]:
    """The same of every kind of macro, by name; unary ones use a only."""
    return {"Add": _add(a, b), "Mul": _mul(a, b), "exp": [_exp(a)], "log": _log(a), "sub": _sub(a, b), "neg": _neg(a), "inv": _inv(a), "div": _div(a, b), "pow": _pow(a, b)}


def cut(term: str) -> tuple[str, str]:
    """The operands of a pair's SQL."""
    inner, depth = term.removeprefix("xxhash64(").removesuffix(")"), 0
    for at, c in enumerate(inner):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            return inner[:at], inner[at + 2 :]
    raise ValueError(term)


def pairs(a: str, b: str) -> dict[int, list[str]]:
    """By code of a label, SQL of the pairs (id, a, b) that its macro adds over the operands a and b, inner ones first."""
    return {code: ["named_struct('id', {}, 'a', {}, 'b', {})".format(t, *cut(t)) for t in found] for code, found in terms(a, b).items()}


#: Operands in a template.
FIRST, SECOND, UNIT = -1, -2, -3


def templates() -> dict[str, list[tuple[int, int]]]:
    """By kind of macro, its pairs as data: each side is FIRST, SECOND, UNIT or the number of an earlier pair of the same template."""
    out = {}
    for kind, found in kinds("FIRST", "SECOND").items():
        steps = list(dict.fromkeys(found))
        at = {"FIRST": FIRST, "SECOND": SECOND, ONE: UNIT} | {t: k for k, t in enumerate(steps)}
        out[kind] = [tuple(at[side] for side in cut(t)) for t in steps]
    return out


def dag_nodes(codes: str) -> Column:
    """Distinct nodes of the EML form of an array of codes by place, a batch of rows at a time."""
    from exprlake.functions import batches

    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        return pa.array(batches.dag_nodes(batches.matrix(column)))

    return count(codes)


def codes(key: str) -> Column:
    """The array of codes by place that a key's expression has, a batch of keys at a time."""
    from exprlake.functions import batches

    @F.arrow_udf("array<int>")
    def draw(column: pa.Array) -> pa.Array:
        return batches.lists(batches.codes(column.to_numpy(zero_copy_only=False)))

    return draw(key)


def pure_graph(codes: str) -> Column:
    """names, nodes and refs of the pure EML DAG of an array of codes by place, a batch of rows at a time."""
    from exprlake.functions import batches

    @F.arrow_udf("names array<bigint>, nodes array<struct<id:bigint,label:string>>, refs array<struct<parent:bigint,child:bigint,at:int>>")
    def graph(column: pa.Array) -> pa.Array:
        return batches.pure_graphs(batches.matrix(column))

    return graph(codes)


def pure_slots(codes: str) -> Column:
    """The places (at) of all references of pure_graph()."""
    from exprlake.functions import batches

    @F.arrow_udf("array<int>")
    def slots(column: pa.Array) -> pa.Array:
        refs = batches.pure_graphs(batches.matrix(column)).field("refs")
        return pa.ListArray.from_arrays(refs.offsets, refs.values.field("at"))

    return slots(codes)


def macro_graph(codes: str) -> Column:
    """nodes and refs of the macro graph of an array of codes by place, a batch of rows at a time."""
    from exprlake.functions import batches

    @F.arrow_udf("nodes array<struct<id:bigint,label:string>>, refs array<struct<parent:bigint,child:bigint,at:int>>")
    def graph(column: pa.Array) -> pa.Array:
        return batches.macro_graphs(batches.matrix(column))

    return graph(codes)


def expanded(nodes: str, refs: str, second: str, kind: str) -> Column:
    """result and eml_nodes of macro graphs with one more macro on top, expanded by templates a batch of rows at a time."""
    from exprlake.functions import batches

    @F.arrow_udf("result bigint, eml_nodes bigint")
    def expand(nodes: pa.Array, refs: pa.Array, second: pa.Array, kind: pa.Array) -> pa.Array:
        return batches.expanded(nodes, refs, second.to_numpy(zero_copy_only=False), kind)

    return expand(nodes, refs, second, kind)
