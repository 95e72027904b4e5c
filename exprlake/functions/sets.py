"""Connected sets of nodes in many graph rows at once, in numpy: what patterns asks of a batch of graphs.

Nodes of all rows are numbered through; sets of one size are a matrix, a row a set, and grow by one reference at a time, each being kept once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: No path yet.
FAR = np.iinfo(np.int64).max


class Sets(NamedTuple):
    """Sets of one size: row, root, nodes in canonical order (numbers), safe, signature (place in said), and arcs sorted by set, parent and place."""

    row: np.ndarray
    root: np.ndarray
    nodes: np.ndarray
    safe: np.ndarray
    sign: np.ndarray
    said: list[str]
    of: np.ndarray
    parent: np.ndarray
    at: np.ndarray
    child: np.ndarray
    local: np.ndarray


class Graphs:
    """The nodes and references of a batch of graph rows."""

    def __init__(self, nodes: pa.ListArray, refs: pa.ListArray):
        self.rows = len(nodes)
        (n_of, n), (r_of, r) = (self._items(c) for c in (nodes, refs))
        self.ids, label = n.field("id").to_numpy(), n.field("label").dictionary_encode()
        self.label, self.names, self.row = label.indices.to_numpy(), label.dictionary.to_pylist(), n_of
        ends = [r.field(k).to_numpy() for k in ("parent", "child")]
        values, spot = np.unique(np.concatenate([self.ids, *ends]), return_inverse=True)
        key = n_of.astype(np.int64) * max(1, len(values))
        order = np.argsort(key + spot[: len(n)], kind="stable")
        known = (key + spot[: len(n)])[order]
        spots = np.split(spot[len(n) :], 2)
        parent, child = (order[np.searchsorted(known, r_of.astype(np.int64) * len(values) + s)] if len(r) else np.zeros(0, np.int64) for s in spots)
        by = np.argsort(parent, kind="stable")
        self.child, self.at = child[by], r.field("at").to_numpy()[by].astype(np.int64)
        self.start = np.searchsorted(parent[by], np.arange(len(n) + 1))
        self.into = np.bincount(child, minlength=len(n))

    @staticmethod
    def _items(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
        sizes = np.diff(np.asarray(column.offsets))
        return np.repeat(np.arange(len(column)), sizes), column.flatten()

    def arcs(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All references of the nodes: place among nodes, and number of the reference."""
        n = self.start[nodes + 1] - self.start[nodes]
        which = np.repeat(np.arange(len(nodes)), n)
        return which, np.arange(len(which)) - (np.cumsum(n) - n)[which] + self.start[nodes][which]

    def sets(self, most: int):
        """Sets of every size up to most that have a reference."""
        root = np.arange(len(self.ids))
        held = root[:, None]
        for size in range(1, most + 1):
            if size > 1:
                which, arc = self.arcs(held.ravel())
                of, child = which // (size - 1), self.child[arc]
                new = ~(held[of] == child[:, None]).any(axis=1)
                of, child = of[new], child[new]
                root, held = root[of], np.sort(np.column_stack([held[of], child]), axis=1)
                order = np.lexsort([*held.T, root])
                root, held = root[order], held[order]
                first = np.r_[True, (root[1:] != root[:-1]) | (held[1:] != held[:-1]).any(axis=1)][: len(root)]
                root, held = root[first], held[first]
            yield self._described(root, held)

    def _described(self, root: np.ndarray, held: np.ndarray) -> Sets:
        size = held.shape[1]
        out = (self.start[held + 1] > self.start[held]).any(axis=1)
        root, held = root[out], held[out]
        which, arc = self.arcs(held.ravel())
        of, parent, at, child = which // size, which % size, self.at[arc], self.child[arc]
        same = held[of] == child[:, None]
        inside, local = same.any(axis=1), same.argmax(axis=1)
        # smallest paths from the root as numbers: a digit a step, 0 behind the end
        base = int(at.max(initial=0)) + 2
        path = np.where(held == root[:, None], 0, FAR)
        o, p, c, a = of[inside], parent[inside], local[inside], at[inside]
        for _ in range(size - 1):
            came = path[o, p]
            go = came < FAR
            length = sum(((came // base**k) % base > 0).astype(np.int64) for k in range(size - 1)) if size > 1 else 0
            step = came[go] + (a[go] + 1) * base ** np.maximum(size - 2 - length[go], 0)
            np.minimum.at(path, (o[go], c[go]), step)
        order = np.argsort(path, axis=1)
        place = np.argsort(order, axis=1)
        nodes = np.take_along_axis(held, order, axis=1)
        parent, local = place[of, parent], np.where(inside, place[of, local], -1)
        by = np.lexsort((local, at, parent, of))
        of, parent, at, child, local = of[by], parent[by], at[by], child[by], local[by]
        inner = np.zeros(held.shape, np.int64)
        np.add.at(inner, (of[local >= 0], local[local >= 0]), 1)
        safe = ((self.into[nodes] == inner) | (nodes == root[:, None])).all(axis=1)
        sign, said = self._signatures(nodes, of, parent, at, local)
        return Sets(self.row[root], root, nodes, safe, sign, said, of, parent, at, child, local)

    def _signatures(self, nodes, of, parent, at, local) -> tuple[np.ndarray, list[str]]:
        size, counts = nodes.shape[1], np.bincount(of, minlength=len(nodes))
        table = np.zeros((len(nodes), size + int(counts.max(initial=0))), np.int64)
        table[:, :size] = self.label[nodes]
        table[of, size + np.arange(len(of)) - (np.cumsum(counts) - counts)[of]] = 1 + (parent * (int(at.max(initial=0)) + 1) + at) * (size + 1) + local + 1
        whole, room = np.zeros(len(nodes), np.int64), 1
        for column in table.T:
            width = int(column.max(initial=0)) + 1
            if room * width >= 1 << 62:  # exact: too many digits are numbered anew
                _, whole = np.unique(whole, return_inverse=True)
                room = len(whole) + 1
            whole, room = whole * width + column, room * width
        _, first, sign = np.unique(whole, return_index=True, return_inverse=True)
        ends = np.cumsum(counts)
        said = []
        for k in first.tolist():
            mine = range(int(ends[k] - counts[k]), int(ends[k]))
            labels = ",".join(self.names[j] for j in self.label[nodes[k]])
            inner = ",".join(f"{parent[j]}.{at[j]}>{local[j]}" for j in mine if local[j] >= 0)
            said.append("|".join((labels, inner, ",".join(f"{parent[j]}.{at[j]}" for j in mine if local[j] < 0))))
        return sign, said


def _lists(counts: np.ndarray, items: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), items)


def _structs(**columns) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _occurrences(graphs: Graphs, s: Sets, which: np.ndarray) -> dict[str, pa.Array]:
    """root, nodes, labels, inner and outer of the sets of the given numbers, in their order."""
    counts = np.bincount(s.of, minlength=len(s.nodes))
    n, size = counts[which], s.nodes.shape[1]
    of = np.repeat(np.arange(len(which)), n)
    arc = np.arange(len(of)) + (np.cumsum(counts)[which] - n - (np.cumsum(n) - n))[of]
    parent, at, local, child = (x[arc] for x in (s.parent, s.at, s.local, s.child))
    inside, by = local >= 0, s.nodes[which].ravel()
    inner = _structs(parent=parent[inside].astype(np.int32), at=at[inside].astype(np.int32), child=local[inside].astype(np.int32))
    outer = _structs(parent=parent[~inside].astype(np.int32), at=at[~inside].astype(np.int32), child=graphs.ids[child[~inside]])
    counted = lambda test: np.bincount(of[test], minlength=len(which))
    wide = np.full(len(which), size)
    labels = pa.array(graphs.names, pa.string()).take(pa.array(graphs.label[by]))
    return {"root": pa.array(graphs.ids[s.root[which]]), "nodes": _lists(wide, pa.array(graphs.ids[by])), "labels": _lists(wide, labels), "inner": _lists(counted(inside), inner), "outer": _lists(counted(~inside), outer)}


def found(nodes: pa.ListArray, refs: pa.ListArray, most: int) -> pa.ListArray:
    """The column found of patterns.occurrences()."""
    graphs = Graphs(nodes, refs)
    parts, rows = [], []
    for s in graphs.sets(most):
        parts.append(_structs(signature=pa.array(s.said, pa.string()).take(pa.array(s.sign)), **_occurrences(graphs, s, np.arange(len(s.nodes))), safe=s.safe))
        rows.append(s.row)
    row = np.concatenate(rows)
    items = pa.concat_arrays(parts).take(pa.array(np.argsort(row, kind="stable")))
    return _lists(np.bincount(row, minlength=graphs.rows), items)


#: A vocabulary as greedy replacement reads it: score and motif_id by signature.
Known = dict[str, tuple[int, str]]


class Taken(NamedTuple):
    """What greedy replacement takes of a batch: row, size, number among the sets of that size, score and motif_id, in the order of taking."""

    row: np.ndarray
    size: np.ndarray
    which: np.ndarray
    score: np.ndarray
    motif: np.ndarray


def taken(graphs: Graphs, every: list[Sets], known: Known) -> Taken:
    """Greedy replacement by patterns.replaced()'s rule. every are the graphs' sets by size.

    A candidate that is the first one left at each of its nodes is taken, and what overlaps with it goes; this is repeated until none is left, and takes
    what a scan in order takes."""
    names = np.array(sorted({m for _, m in known.values()}), object)
    at, parts, wide = {m: k for k, m in enumerate(names)}, [], len(every)
    for size, s in enumerate(every, 1):
        if size > 1:
            said = [known.get(t) for t in s.said]
            which = np.flatnonzero(s.safe & np.array([t is not None for t in said], bool)[s.sign]) if said else np.zeros(0, np.int64)
            score, motif = (np.array([0 if t is None else v(t) for t in said], np.int64)[s.sign[which]] for v in (lambda t: t[0], lambda t: at[t[1]]))
            held = np.full((len(which), wide), len(graphs.ids))
            held[:, :size] = s.nodes[which]
            parts.append((s.row[which], np.full(len(which), size), which, score, motif, s.root[which], held))
    if not parts:
        none = np.zeros(0, np.int64)
        return Taken(none, none, none, none, names[none])
    row, size, which, score, motif, root, held = map(np.concatenate, zip(*parts, strict=True))
    ids = np.r_[graphs.ids, 0][held]
    by = np.lexsort((*ids.T[::-1], motif, root, -size, -score, row))
    row, size, which, score, motif, held = (x[by] for x in (row, size, which, score, motif, held))
    left, gone, won = np.arange(len(row)), np.zeros(len(graphs.ids) + 1, bool), []
    first = np.zeros(len(graphs.ids) + 1, np.int64)
    while len(left):
        mine = held[left]
        first[mine[::-1].ravel()] = np.repeat(left[::-1], wide)  # the last one written, the first in order, stays
        best = ((first[mine] == left[:, None]) | (mine == len(graphs.ids))).all(axis=1)
        won.append(left[best])
        gone[mine[best]] = True
        gone[-1] = False
        left = left[~gone[mine].any(axis=1)]
    won = np.sort(np.concatenate([np.zeros(0, np.int64), *won]))
    return Taken(row[won], size[won], which[won], score[won], names[motif[won]])


def kept(nodes: pa.ListArray, refs: pa.ListArray, most: int, vocabularies: list[Known]) -> list[pa.ListArray]:
    """The column kept of patterns.replaced(), for each vocabulary."""
    graphs = Graphs(nodes, refs)
    every = [*graphs.sets(most)]
    return [_kept(graphs, every, taken(graphs, every, known)) for known in vocabularies]


def _kept(graphs: Graphs, every: list[Sets], t: Taken) -> pa.ListArray:
    start = np.searchsorted(graphs.row, np.arange(graphs.rows))
    parts, order = [], []
    for size, s in enumerate(every, 1):
        mine = np.flatnonzero(t.size == size)
        which = t.which[mine]
        place = s.root[which] - start[s.row[which]] + 1
        parts.append(_structs(first=-t.score[mine], second=np.full(len(mine), -size, np.int32), at=place.astype(np.int64), motif_id=pa.array(t.motif[mine].tolist(), pa.string()), **_occurrences(graphs, s, which)))
        order.append(mine)
    items = pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))
    items = _structs(**{k: items.field(k) for k in ("first", "second", "at", "root", "motif_id", "nodes", "labels", "inner", "outer")})
    return _lists(np.bincount(t.row, minlength=graphs.rows), items)


#: A motif's labels, inner (parent, at, child) and outer references (parent, at).
Template = tuple[list[str], list[tuple[int, int, int]], list[tuple[int, int]]]


def restored(nodes: pa.ListArray, refs: pa.ListArray, kept: pa.ListArray, templates: dict[str, Template]) -> tuple[np.ndarray, np.ndarray]:
    """By row: replacements whose motif is unknown or whose bindings do not fit its template, and whether the compressed graph gives back the original.

    The graph is compressed as patterns.compressed() says: nodes and references that are left, and each replacement's motif, nodes by local number and outer children.
    From these and the templates the nodes and references are made again, and compared whole."""
    rows = len(nodes)
    (n_row, n), (r_row, r), (k_row, k) = (Graphs._items(c) for c in (nodes, refs, kept))
    (l_of, local), (o_of, outer) = (Graphs._items(k.field(name)) for name in ("nodes", "outer"))
    ids = (n.field("id"), r.field("parent"), r.field("child"), k.field("root"), local, outer.field("child"))
    ids = [np.asarray(x).astype(np.int64) for x in ids]
    values, spot = np.unique(np.concatenate(ids), return_inverse=True)
    spot = np.split(spot, np.cumsum([len(x) for x in ids])[:-1])
    node, parent, child, root, local, below = (s + of.astype(np.int64) * max(1, len(values)) for s, of in zip(spot, (n_row, r_row, r_row, k_row, k_row[l_of], k_row[o_of]), strict=True))
    names = {name: i for i, name in enumerate(dict.fromkeys([*n.field("label").unique().to_pylist(), *(x for t in templates.values() for x in t[0])]))}
    coded = n.field("label").dictionary_encode()
    label = np.array([names[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    at = r.field("at").to_numpy()
    # compressed: what is left, with references to taken nodes leading to their replacement's root
    by = np.argsort(local, kind="stable")
    mine, owner = local[by], root[l_of][by]
    place = lambda x: np.minimum(np.searchsorted(mine, x), max(0, len(mine) - 1))
    held = (lambda x: mine[place(x)] == x) if len(mine) else (lambda x: np.zeros(len(x), bool))
    plain, stay = ~held(parent), ~held(node)
    to = np.where(held(child), owner[place(child)], child) if len(mine) else child
    made_nodes, made_refs = [(node[stay], label[stay])], [(parent[plain], to[plain], at[plain])]
    # undone: each replacement by its motif's template
    wide, out = np.bincount(l_of, minlength=len(k)), np.bincount(o_of, minlength=len(k))
    first, open_ = np.cumsum(wide) - wide, np.cumsum(out) - out
    ok, motif = np.zeros(len(k), bool), k.field("motif_id").dictionary_encode()
    for number, name in enumerate(motif.dictionary.to_pylist()):
        if name in templates:
            labels, inner, outside = templates[name]
            which = np.flatnonzero((motif.indices.to_numpy() == number) & (wide == len(labels)) & (out == len(outside)))
            which = which[local[first[which]] == root[which]]
            ok[which] = True
            of = lambda i, which=which: local[first[which] + i]
            made_nodes += [(of(i), np.full(len(which), names[x])) for i, x in enumerate(labels)]
            made_refs += [(of(p), of(c), np.full(len(which), a)) for p, a, c in inner]
            made_refs += [(of(p), below[open_[which] + i], np.full(len(which), a)) for i, (p, a) in enumerate(outside)]
    equal = _same(rows, len(values), (node, label), made_nodes) & _same(rows, len(values), (parent, child, at), made_refs)
    return np.bincount(k_row[~ok], minlength=rows), equal


def _same(rows: int, room: int, was: tuple, made: list[tuple]) -> np.ndarray:
    """By row, whether two lists have the same tuples, whose first number tells the row."""
    ordered = lambda columns: np.column_stack([c[np.lexsort(columns[::-1])] for c in columns])
    was, made = ordered(was), ordered([np.concatenate(c) for c in zip(*made, strict=True)])
    row = [x[:, 0] // max(1, room) for x in (was, made)]
    same = np.bincount(row[0], minlength=rows) == np.bincount(row[1], minlength=rows)
    was, made = (x[same[of]] for x, of in zip((was, made), row, strict=True))
    same[(was[:, 0] // max(1, room))[(was != made).any(axis=1)]] = False
    return same


def used(nodes: pa.ListArray, refs: pa.ListArray, most: int, vocabularies: list[Known], shown: int, templates: dict[str, Template]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """By row: nodes, nodes that each vocabulary leaves, nodes that the shown one covers, and whether its replacements can be undone."""
    graphs = Graphs(nodes, refs)
    every = [*graphs.sets(most)]
    size, left = np.bincount(graphs.row, minlength=graphs.rows), []
    for number, known in enumerate(vocabularies):
        t = taken(graphs, every, known)
        covers = np.bincount(t.row, t.size, graphs.rows).astype(np.int64)
        left.append(size - covers + np.bincount(t.row, minlength=graphs.rows))
        if number == shown:
            covered = covers
            errors, equal = restored(nodes, refs, _kept(graphs, every, t), templates)
    return size, left, covered, equal & (errors == 0)


def tallies(nodes: pa.ListArray, refs: pa.ListArray, most: int, group: np.ndarray, copies: np.ndarray):
    """(signature, size, group, split's place, support, coverage) of every motif; a row counts once for each of its copies (row, split) and group numbers rows."""
    graphs = Graphs(nodes, refs)
    groups = int(group.max(initial=0)) + 1
    for size, s in enumerate(graphs.sets(most), 1):
        cell = s.sign * groups + group[s.row]
        cells = len(s.said) * groups
        once = np.unique(s.row * max(1, cells) + cell) if cells else np.zeros(0, np.int64)
        for split in range(copies.shape[1]):
            weight = copies[:, split]
            support = np.bincount(cell, weight[s.row], cells)
            coverage = np.bincount(once % max(1, cells), weight[once // max(1, cells)], cells)
            for k in np.flatnonzero(coverage).tolist():
                yield s.said[k // groups], size, k % groups, split, int(support[k]), int(coverage[k])
