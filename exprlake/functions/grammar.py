"""The expression corpus that is bound to a table's keys: one symbolic expression for each key, from integer hashing.

An expression is a binary heap of at most 2 ** (MAX_DEPTH + 1) - 1 labels: the children of place p are 2p and 2p + 1, a
unary operator has the child 2p. The SQL text below is plain enough for any engine with 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable

MAX_DEPTH = 4
PLACES = 2 ** (MAX_DEPTH + 1) - 1
#: Percent cut points of the target depth, and of the labels of the full and the positive grammar.
DEPTH_CUTS = (3, 15, 37, 65)
FULL_CUTS = (("Add", 30), ("Mul", 60), ("exp", 80), ("log", 100))
POSITIVE_CUTS = (("leaf", 30), ("Add", 60), ("Mul", 85), ("exp", 100))
LEAF_PERCENT = 15


def mixed(i: str, p: str, k: int) -> str:
    """A hash of key i, place p and purpose k below 2 ** 31. The product of its two halves breaks the linear step, or else all draws would follow from a single one."""
    z = f"((({i} * 1000003 + {p} * 8191 + {k} * 7919 + 12345) % 2147483647) * 48271 % 2147483647)"
    return f"((({z} % 46337) * ({z} div 46337 + 1009) + {z}) * 69621 % 2147483647)"


def cases(value: str, cuts, last: str) -> str:
    whens = " ".join(f"WHEN {value} < {cut} THEN {then}" for then, cut in cuts)
    return f"CASE {whens} ELSE {last} END"


def target_depth(i: str) -> str:
    return cases(f"{mixed(i, '0', 9)} % 100", list(zip(range(MAX_DEPTH), DEPTH_CUTS, strict=True)), str(MAX_DEPTH))


#: Codes of the labels, as integer columns hold them; 0 is an empty place.
CODES = {"x": 1, "y": 2, "1": 3, "Add": 4, "Mul": 5, "exp": 6, "log": 7}



def drawn_sql(i: str) -> dict[str, str]:
    """SQL of what is drawn for key i: its target depth, and by place the leaf, and whether it is one by chance and which operator (percent numbers).

    The target depth comes through a lambda: Spark compiles a projection with one into small functions, and one without into a single method that is too long for
    Java's own compiler (twelve times slower)."""
    inner = range(1, (PLACES + 1) // 2)
    return {
        "target": f"get(transform(array({target_depth(i)}), t -> t), 0)",
        "leaf": f"array({', '.join(f'cast({mixed(i, str(p), 3)} % 3 + 1 as int)' for p in range(1, PLACES + 1))})",
        "chance": f"array({', '.join(f'cast({mixed(i, str(p), 1)} % 100 as int)' for p in inner)})",
        "kind": f"array({', '.join(f'cast({mixed(i, str(p), 2)} % 100 as int)' for p in inner)})",
    }


def codes_sql() -> str:
    """SQL of the array of codes by place, over the columns of drawn_sql: level by level from the root, with eight added to the codes in the positive grammar.

    A place has a code if its parent is a binary operator, or a unary one and the place even. From the target depth on, and by chance, it is a leaf. The
    positive grammar holds from a logarithm down to the next exponential."""

    def code(p: str, g: str) -> str:
        """The code of a place that there is, g being 8 in the positive grammar."""
        full = cases(f"kind[{p} - 1]", [(CODES[t], c) for t, c in FULL_CUTS[:-1]], str(CODES[FULL_CUTS[-1][0]]))
        below = cases(f"kind[{p} - 1]", [(f"leaf[{p} - 1]" if t == "leaf" else CODES[t], c) for t, c in POSITIVE_CUTS[:-1]], str(CODES[POSITIVE_CUTS[-1][0]]))
        return f"CASE WHEN {p} >= shiftleft(1, target) OR chance[{p} - 1] < {LEAF_PERCENT} THEN leaf[{p} - 1] + {g} WHEN {g} = 8 THEN {below} + 8 ELSE {full} END"

    def level(k: int) -> str:
        """The levels from k on, given those before as l0, l1, ..."""
        if k > MAX_DEPTH:
            return f"concat({', '.join(f'l{j}' for j in range(k))})"
        left = f"(2 * i + {1 << k})"
        both = f"array({code(left, 'g')}, if(u % 8 IN (4, 5), {code(f'({left} + 1)', 'g')}, 0))"
        pair = f"if(u % 8 < 4, array(0, 0), transform(array(if(u = 7 OR (u >= 8 AND u <> 14), 8, 0)), g -> {both})[0])"
        return f"transform(array(flatten(transform(l{k - 1}, (u, i) -> {pair}))), l{k} -> {level(k + 1)})[0]"

    return f"transform(transform(array(array({code('1', '0')})), l0 -> {level(1)})[0], k -> k % 8)"


def climb_sql(step: Callable[[str, str | None, str | None], str], kind: str, root: bool = False) -> str:
    """SQL of what step makes of a place's code and of its children's results, over the array codes: level by level up to the root.

    All places' results as one array, null where there is no place, or the root's only."""

    def level(k: int) -> str:
        if k < 0:
            return "l0[0]" if root else f"concat({', '.join(f'l{j}' for j in range(MAX_DEPTH + 1))})"
        last = k == MAX_DEPTH
        made = step("k", None if last else f"l{k + 1}[2 * i]", None if last else f"l{k + 1}[2 * i + 1]")
        return f"transform(array(transform(slice(codes, {1 << k}, {1 << k}), (k, i) -> if(k = 0, null, cast({made} as {kind})))), l{k} -> {level(k - 1)})[0]"

    return level(MAX_DEPTH)
