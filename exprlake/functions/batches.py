"""Draws and pure EML DAGs of many expressions at once, in numpy: a batch is one matrix of codes, a row an expression, a column a place of its heap.

Names are those of eml.pair(), level by level from the leaves, so that equal nodes of all batches have one id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from exprlake.functions import eml, sets
from exprlake.functions.grammar import CODES, DEPTH_CUTS, FULL_CUTS, LEAF_PERCENT, MAX_DEPTH, PLACES, POSITIVE_CUTS

#: Rows that are worked on at once.
ROWS = 4_096
#: Modulus of the draws, and the largest key whose draws fit 64 bits.
MODULUS, MOST_KEY = 2147483647, (2**63 - 1) // 1000003 - 1
LEAVES = {c: int(n.removesuffix("L")) for c, n in eml.LEAVES.items()}
ONE = np.uint64(LEAVES[CODES["1"]])
STEPS = {CODES[kind]: steps for kind, steps in eml.templates().items() if kind in CODES}
MOST = max(map(len, STEPS.values()))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of codes by place of a column of arrays without nulls."""
    return np.asarray(column.flatten()).reshape(-1, PLACES)


def _mixed(keys: np.ndarray, places: np.ndarray, purpose: int) -> np.ndarray:
    """grammar.mixed() of every key and place; remainders and quotients are cut towards zero, as SQL's are."""
    if keys.min(initial=0) < 0:
        rest = np.fmod
        cut = lambda x, m: (x - np.fmod(x, m)) // m
    else:
        rest = lambda x, m: x - x // m * m
        cut = np.floor_divide
    z = rest(rest(keys[:, None] * 1000003 + (places * 8191 + (purpose * 7919 + 12345)), MODULUS) * 48271, MODULUS)
    return rest((rest(z, 46337) * (cut(z, 46337) + 1009) + z) * 69621, MODULUS)


def _cased(value: np.ndarray, cuts, last) -> np.ndarray:
    """grammar.cases()."""
    return np.select([value < cut for _, cut in cuts], [then for then, _ in cuts], last)


def codes(keys: np.ndarray) -> np.ndarray:
    """The codes by place that grammar.drawn_sql() and grammar.codes_sql() draw for the keys."""
    if len(keys) and (keys.max() > MOST_KEY or keys.min() < -MOST_KEY):
        raise OverflowError(f"a key beyond {MOST_KEY}")
    wide, inner = np.arange(1, PLACES + 1), np.arange(1, PLACES // 2 + 1)
    rest = np.fmod if keys.min(initial=0) < 0 else np.remainder
    target = _cased(rest(_mixed(keys, np.zeros(1, np.int64), 9), 100), list(enumerate(DEPTH_CUTS)), MAX_DEPTH)
    leaf = rest(_mixed(keys, wide, 3), 3) + 1
    kind = rest(_mixed(keys, inner, 2), 100)
    ends = (inner >= 1 << target) | (rest(_mixed(keys, inner, 1), 100) < LEAF_PERCENT)
    full = np.where(ends, leaf[:, : len(inner)], _cased(kind, [(CODES[t], c) for t, c in FULL_CUTS[:-1]], CODES[FULL_CUTS[-1][0]]))
    below = np.where(ends, leaf[:, : len(inner)], _cased(kind, [(leaf[:, : len(inner)] if t == "leaf" else CODES[t], c) for t, c in POSITIVE_CUTS[:-1]], CODES[POSITIVE_CUTS[-1][0]]))
    out, there, positive = np.zeros((len(keys), PLACES), np.int32), np.zeros((len(keys), PLACES), bool), np.zeros((len(keys), PLACES), bool)
    there[:, 0] = True
    for level in range(MAX_DEPTH):
        at = slice((1 << level) - 1, (2 << level) - 1)
        left, right = slice(at.stop, (4 << level) - 1, 2), slice(at.stop + 1, (4 << level) - 1, 2)
        code = out[:, at] = np.where(there[:, at], np.where(positive[:, at], below[:, at], full[:, at]), 0)
        there[:, left], there[:, right] = code > 3, (code == CODES["Add"]) | (code == CODES["Mul"])
        positive[:, left] = positive[:, right] = np.where(positive[:, at], code != CODES["exp"], code == CODES["log"])
    last = slice(PLACES // 2, PLACES)
    out[:, last] = np.where(there[:, last], leaf[:, last], 0)
    return out


def lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _hashed(value: np.ndarray, seed) -> np.ndarray:
    """XXH64 of eight bytes."""
    z = (seed + P5 + np.uint64(8)) ^ (_turned(value * P2, 31) * P1)
    z = _turned(z, 27) * P1 + P4
    z = (z ^ (z >> np.uint64(33))) * P2
    z = (z ^ (z >> np.uint64(29))) * P3
    return z ^ (z >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """eml.pair(): Spark's xxhash64 of two numbers."""
    return _hashed(b, _hashed(a, np.uint64(42)))


class Pure(NamedTuple):
    """names (row, place; 0 where there is none), and the pairs of all operators by row, place and step of the template: row, id, first and second operand."""

    names: np.ndarray
    row: np.ndarray
    id: np.ndarray
    first: np.ndarray
    second: np.ndarray


def pure(codes: np.ndarray, ordered: bool = True) -> Pure:
    """Names and pairs; without ordered the pairs stand level by level."""
    names, parts = np.zeros(codes.shape, np.uint64), []
    for c, n in LEAVES.items():
        names[codes == c] = n
    for level in reversed(range(MAX_DEPTH)):
        low, high = (1 << level) - 1, (2 << level) - 1
        for code, steps in STEPS.items():
            row, at = np.nonzero(codes[:, low:high] == code)
            at += low
            sides = {eml.FIRST: names[row, 2 * at + 1], eml.SECOND: names[row, 2 * at + 2], eml.UNIT: np.full(len(row), ONE)}
            for k, (l, r) in enumerate(steps):
                sides[k] = pair(sides[l], sides[r])
                parts.append((row, (row * PLACES + at) * MOST + k, sides[k], sides[l], sides[r]))
            names[row, at] = sides[len(steps) - 1]
    row, place, *pairs = map(np.concatenate, zip(*parts, strict=True))
    if ordered:
        by = np.argsort(place)
        row, *pairs = (x[by] for x in (row, *pairs))
    return Pure(names, row, *pairs)


def once(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of every row's values, each where it stands first."""
    by = np.argsort(value, kind="stable")
    by = by[np.argsort(row[by], kind="stable")]
    r, v = row[by], value[by]
    return np.sort(by[np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])][: len(by)]])


def dag_nodes(codes: np.ndarray) -> np.ndarray:
    """Distinct nodes of every row's pure EML DAG: its pairs, the variables it has, and one, which every operator uses. Equal rows of a part are worked on once."""
    out = np.zeros(len(codes), np.int64)
    for low in range(0, len(codes), ROWS):
        part = codes[low : low + ROWS]
        _, which, same = np.unique(np.ascontiguousarray(part.astype(np.int8)).view(f"V{PLACES}").ravel(), return_index=True, return_inverse=True)
        part = part[which]
        found = pure(part, ordered=False)
        n = np.bincount(found.row[once(found.row, found.id)], minlength=len(part))
        for c in LEAVES:
            n += ((part == c) | ((part > max(LEAVES)) & (c == CODES["1"]))).any(axis=1)
        out[low : low + ROWS] = n[same]
    return out


def pure_graphs(codes: np.ndarray) -> pa.StructArray:
    """names, nodes and refs of graphs.pure_graphs(): nodes from the root on as pairs name them, pairs by place and step."""
    found = pure(codes)
    kept = once(found.row, found.id)
    row, parent, a, b = (x[kept] for x in found[1:])
    of = np.concatenate([np.arange(len(codes)), np.repeat(row, 3)])
    used = np.concatenate([found.names[:, 0], np.column_stack([parent, a, b]).ravel()])
    by = np.argsort(of, kind="stable")
    of, used = of[by], used[by]
    first = once(of, used)
    of, used = of[first], used[first].view(np.int64)
    label = np.full(len(used), len(LEAVES), np.int32)
    for k, n in enumerate(LEAVES.values()):
        label[used == n] = k
    spelt = {c: name for name, c in CODES.items()}
    labels = pa.array([*(spelt[c] for c in LEAVES), "eml"]).take(pa.array(label))
    sizes = lambda r, times=1: pa.array(np.r_[0, np.cumsum(np.bincount(r, minlength=len(codes)) * times)].astype(np.int32))
    nodes = pa.StructArray.from_arrays([pa.array(used), labels], ["id", "label"])
    ends = [np.repeat(parent, 2).view(np.int64), np.column_stack([a, b]).ravel().view(np.int64), np.tile(np.arange(2, dtype=np.int32), len(row))]
    refs = pa.StructArray.from_arrays([pa.array(x) for x in ends], ["parent", "child", "at"])
    names = pa.ListArray.from_arrays(lists(codes).offsets, pa.array(found.names.ravel().view(np.int64), mask=codes.ravel() == 0))
    return pa.StructArray.from_arrays([names, pa.ListArray.from_arrays(sizes(of), nodes), pa.ListArray.from_arrays(sizes(row, 2), refs)], ["names", "nodes", "refs"])


def firsts(codes: np.ndarray) -> np.ndarray:
    """The first place, from 1, where each place's subtree stands in its row; 0 where there is none.

    A subtree below the root has at most PLACES // 2 places of three bits, so one number holds it whole; the root's equals no other."""
    whole = np.zeros(codes.shape, np.int64)
    for r in range(1, PLACES // 2 + 1):
        width = 1 << (r.bit_length() - 1)
        below = codes[:, 2 * width + r - width - 1 :: width]  # of places 2, 3, ...
        whole[:, 1 : 1 + below.shape[1]] |= below.astype(np.int64) << (3 * (r - 1))
    whole[:, 0] = -1
    return np.where(codes > 0, (whole[:, :, None] == whole[:, None, :]).argmax(axis=2) + 1, 0)


def macro_graphs(codes: np.ndarray) -> pa.StructArray:
    """nodes and refs of graphs.macro_graphs(), by place."""
    parts = [_macro(codes[low : low + ROWS]) for low in range(0, max(1, len(codes)), ROWS)]
    return pa.concat_arrays(parts)


def _macro(codes: np.ndarray) -> pa.StructArray:
    first = firsts(codes)
    row, at = np.nonzero((first == np.arange(1, PLACES + 1)) & (codes > 0))
    code = codes[row, at]
    spelt = [{c: name for name, c in CODES.items()}.get(k) for k in range(max(CODES.values()) + 1)]
    nodes = pa.StructArray.from_arrays([pa.array(at.astype(np.int64) + 1), pa.array(spelt, pa.string()).take(pa.array(code))], ["id", "label"])
    inner = code > max(LEAVES)
    of, at, code = row[inner], at[inner], code[inner]
    child = np.column_stack([first[of, 2 * at + 1], first[of, 2 * at + 2]])
    there = np.column_stack([np.ones(len(of), bool), (code == CODES["Add"]) | (code == CODES["Mul"])]).ravel()
    sides = [np.repeat(at.astype(np.int64) + 1, 2), child.ravel().astype(np.int64), np.tile(np.arange(2, dtype=np.int32), len(of))]
    refs = pa.StructArray.from_arrays([pa.array(x[there]) for x in sides], ["parent", "child", "at"])
    sizes = lambda r: pa.array(np.r_[0, np.cumsum(np.bincount(r, minlength=len(codes)))].astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(sizes(row), nodes), pa.ListArray.from_arrays(sizes(np.repeat(of, 2)[there]), refs)], ["nodes", "refs"])


def expanded(nodes: pa.ListArray, refs: pa.ListArray, second: np.ndarray, kind: pa.Array) -> pa.StructArray:
    """result and eml_nodes of graphs.expansion(): every node of the macro graphs by its label's template, as soon as its children have names, then the kind's over the root and second."""
    graph = sets.Graphs(nodes, refs)
    child = np.full((len(graph.ids), 2), -1)
    child[np.repeat(np.arange(len(graph.ids)), np.diff(graph.start)), graph.at] = graph.child
    label = np.array(graph.names, object)[graph.label]
    name, done = np.zeros(len(label) + 1, np.uint64), np.zeros(len(label) + 1, bool)
    for spelt, c in CODES.items():
        if c in LEAVES:
            name[:-1][label == spelt], done[:-1][label == spelt] = LEAVES[c], True
    parts = [(np.arange(graph.rows), np.full(graph.rows, ONE)), (graph.row[done[:-1]], name[:-1][done[:-1]])]  # every macro uses one
    done[-1] = True  # no child

    def grown(steps, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sides = {eml.FIRST: a, eml.SECOND: b, eml.UNIT: np.full(len(row), ONE)}
        for k, (l, r) in enumerate(steps):
            sides[k] = pair(sides[l], sides[r])
            parts.append((row, sides[k]))
        return sides[len(steps) - 1]

    templates = eml.templates()
    while not done.all():
        ready = ~done[:-1] & done[child].all(axis=1)
        if not ready.any():
            raise ValueError("a macro graph with a cycle")
        for spelt in set(label[ready]):
            at = np.flatnonzero(ready & (label == spelt))
            name[at] = grown(templates[spelt], graph.row[at], name[child[at, 0]], name[child[at, 1]])
            done[at] = True
    ends = np.full((2, graph.rows), -1)
    for k, mine in enumerate((graph.ids == 1, graph.ids == second[graph.row])):
        ends[k, graph.row[mine]] = np.flatnonzero(mine)
    top, kind = np.zeros(graph.rows, np.uint64), np.array(kind.to_pylist(), object)
    for spelt in set(kind):
        at = np.flatnonzero(kind == spelt)
        top[at] = grown(templates[spelt], at, name[ends[0, at]], name[ends[1, at]])
    row, made = map(np.concatenate, zip(*parts, strict=True))
    n = np.bincount(row[once(row, made)], minlength=graph.rows)
    return pa.StructArray.from_arrays([pa.array(top.view(np.int64)), pa.array(n.astype(np.int64))], ["result", "eml_nodes"])
