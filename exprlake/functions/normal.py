"""Normal forms by identity rules, in two modes, on canonical strings.

The safe mode knows the identities of 0 and 1 in sums and products; the positive mode, valid over positive reals, adds those
of logarithm and exponential. Rules apply bottom up over the heap's places.
"""

from __future__ import annotations

from exprlake.functions import measures

MODES = ("safe", "positive_real")
#: Fixed value: nodes of zero in the pure EML form.
ZERO_NODES = 7
AST = {**dict.fromkeys(measures.EML_WEIGHT, 1), "0": 1}
EML = {**measures.EML_WEIGHT, "0": ZERO_NODES}


def step(mode: str, k: str, a: str | None, b: str | None) -> str:
    """The normal form of one place, from its code and its children's normal forms."""
    if a is None:
        return measures.string_step(k, None, None)
    add = f"CASE WHEN {a} = '0' THEN {b} WHEN {b} = '0' THEN {a} ELSE concat('Add(', {a}, ', ', {b}, ')') END"
    mul = f"CASE WHEN {a} = '0' OR {b} = '0' THEN '0' WHEN {a} = '1' THEN {b} WHEN {b} = '1' THEN {a} ELSE concat('Mul(', {a}, ', ', {b}, ')') END"
    exp, log = (f"concat('{f}(', {a}, ')')" for f in ("exp", "log"))
    if mode == "positive_real":
        inner = f"substr({a}, 5, length({a}) - 5)"
        exp = f"CASE WHEN {a} = '0' THEN '1' WHEN {a} LIKE 'log(%' THEN {inner} ELSE {exp} END"
        log = f"CASE WHEN {a} = '1' THEN '0' WHEN {a} LIKE 'exp(%' THEN {inner} ELSE {log} END"
    return f"CASE {k} WHEN 4 THEN {add} WHEN 5 THEN {mul} WHEN 6 THEN {exp} WHEN 7 THEN {log} ELSE {measures.string_step(k, None, None)} END"


def _count(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, '{part}', ''))) / {len(part)})"


def size_sql(text: str, weights: dict) -> str:
    """Weighted count of the labels in a canonical string."""
    total = " + ".join(f"{weights[f]} * {_count(text, f)}" for f in measures.FAMILIES)
    leaves = f"{weights['x']} * ({_count(text, 'x')} - {_count(text, 'exp')} + {_count(text, 'y')} + {_count(text, '1')})"
    return f"cast({total} + {leaves} + {weights['0']} * {_count(text, '0')} as bigint)"
