"""Expression graphs as rows: the macro graph of shared subtrees and the pure EML DAG, and the shared EML DAG of all expressions as tables.

A graph is one row: nodes (id, label) and refs (parent, child, at, the child's place among its parent's children). What is asked of one graph is
asked of its row, so that nothing shuffles; what is asked of all graphs is exploded from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.functions import eml, grammar
from exprlake.operators.corpus import distinct, settled
from exprlake.operators.stages import stage

GRAPH = ("expr_id", "split", "feature_subset")


def macro_graphs(rows: DataFrame, *carried: str) -> DataFrame:
    """expr_id, split, feature_subset, nodes, refs, root and the carried columns: a node for every distinct subtree; its id is the first place of the heap where it stands."""
    rows = settled(rows, *dict.fromkeys((*GRAPH, *carried, "codes")))
    rows = settled(rows.select(*GRAPH, *carried, eml.macro_graph("codes").alias("macro")), *GRAPH, *carried, "macro")
    rows = rows.select(*GRAPH, *carried, "macro.*").withColumn("root", F.lit(1).cast("long"))
    return settled(rows, *GRAPH, "nodes", "refs", "root", *carried)


def _names() -> str:
    """SQL of the names of all places' pure forms."""
    operators = eml.terms("{a}", "{b}")

    def step(k: str, a: str | None, b: str | None) -> str:
        leaves = " ".join(f"WHEN {c} THEN {n}" for c, n in eml.LEAVES.items())
        if a is None:
            return f"CASE {k} {leaves} END"
        return f"CASE {k} {leaves} " + " ".join(f"WHEN {c} THEN {t[-1].format(a=a, b=b)}" for c, t in operators.items()) + " END"

    return grammar.climb_sql(step, "bigint")


def pure_graphs(rows: DataFrame, *carried: str) -> DataFrame:
    """The same of the pure EML DAG: a node is a leaf or a pair, and its id is the hash of its form, so that equal nodes of all expressions have one id.

    With carried columns of rows these stay, and so does names, the ids of all places' pure forms."""
    rows = settled(rows, *GRAPH, "codes", *carried)
    rows = settled(rows.select(*GRAPH, *carried, eml.pure_graph("codes").alias("pure")), *GRAPH, *carried, "pure")
    kept = ("names", *carried) if carried else ()
    rows = rows.select(*GRAPH, *carried, "pure.*").select("*", F.col("names")[0].alias("root"))
    return settled(rows, *GRAPH, "nodes", "refs", "root", *kept)


def dag_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The EML DAG that all expressions share, as nodes (id, name, label, n_made, n_roots) and refs (parent, child, at).

    Every distinct subtree is expanded once, whatever the number of expressions that hold it. A node's id is the hash of its form, its name the smallest
    subtree#position of a macro that makes it (a leaf's is its label); n_made counts these, n_roots the expressions whose root it is."""
    rows = settled(distinct(rows)[0], "codes", "subtrees", "copies")
    rows = settled(rows.select("codes", "subtrees", "copies", F.expr(_names()).alias("names")), "codes", "subtrees", "names", "copies")
    item = "named_struct('subtree', subtrees[i], 'code', k, 'a', get(names, 2 * i + 1), 'b', get(names, 2 * i + 2))"
    macros = rows.select(F.explode(F.expr(f"array_distinct(filter(transform(codes, (k, i) -> {item}), x -> x.code > 3))")).alias("x")).select("x.*").distinct()
    listed = " ".join(f"WHEN {c} THEN array({', '.join(t)})" for c, t in eml.pairs("a", "b").items())
    made = macros.select("subtree", F.posexplode(F.expr(f"CASE code {listed} END")).alias("at", "x"))
    made = made.groupBy("x.id").agg(F.min("x.a").alias("a"), F.min("x.b").alias("b"), F.min(F.struct("subtree", "at")).alias("first"), F.count("*").alias("n_made"))
    leaf = F.explode(F.array(*(F.struct(F.expr(eml.LEAVES[c]).alias("id"), F.lit(name).alias("label")) for name, c in grammar.CODES.items() if c in eml.LEAVES)))
    roots = rows.groupBy(F.col("names")[0].alias("id")).agg(F.sum(F.expr("copies[0] + copies[1] + copies[2]")).alias("n_roots"))
    used = made.select(F.explode(F.array("a", "b")).alias("id")).unionByName(roots.select("id")).distinct()
    leaves = rows.sparkSession.range(1).select(leaf.alias("x")).select("x.*").join(used, "id", "left_semi")
    nodes = made.select("id", F.concat_ws("#", "first.subtree", "first.at").alias("name"), F.lit("eml").alias("label"), "n_made")
    nodes = nodes.unionByName(leaves.select("id", F.col("label").alias("name"), "label", F.lit(0).cast("long").alias("n_made")))
    refs = made.select(F.col("id").alias("parent"), F.posexplode(F.array("a", "b")).alias("at", "child")).select("parent", "child", "at")
    return nodes.join(roots, "id", "left").fillna(0, ["n_roots"]), refs


def named_refs(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """parent, child, at by name."""
    names = nodes.select("id", "name")
    refs = refs.join(names.select(F.col("id").alias("parent"), F.col("name").alias("of")), "parent").join(names.select(F.col("id").alias("child"), F.col("name").alias("to")), "child")
    return refs.select(F.col("of").alias("parent"), F.col("to").alias("child"), "at")


def classes(rows: DataFrame) -> DataFrame:
    """shape, n, n_expressions, first_expr: expressions whose macro graphs are the same up to the names of their variables.

    The shape is the digest of the canonical string in which the variable that stands first is x; places and ids do not enter it."""
    rows = settled(rows, "expr_id", "expression")
    plain = F.regexp_replace("expression", "exp", "E")
    swapped = F.when(F.regexp_extract(plain, "[xy]", 0) == "y", F.translate(plain, "xy", "yx")).otherwise(plain)
    groups = rows.groupBy(F.sha2(F.regexp_replace(swapped, "E", "exp"), 256).alias("shape"), "expression").agg(F.count("*").alias("c"), F.min("expr_id").alias("first_expr"))
    return groups.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("n_expressions"), F.min("first_expr").alias("first_expr"))


def _steps(listed: list[tuple[int, int]]) -> str:
    """SQL of a template's steps."""
    return "array(" + ", ".join(f"named_struct('l', {a}, 'r', {b})" for a, b in listed) + ")"


#: The kind of macro that expansion() puts on top of an expression, by its id.
KINDS = ("exp", "log", "sub", "neg", "Add", "inv", "Mul", "div", "pow")


def expansion(rows: DataFrame) -> DataFrame:
    """Per expression: kind, macro_nodes, eml_nodes (distinct ones) and whether its macro graph, expanded by templates, is what the compiler makes of it.

    On top of every macro graph stands one more macro, of each of the nine kinds in turn, over the root and its first child (the root again, if it is a
    leaf). A batch of macro graphs is expanded at a time, a node by the steps of its kind's template as soon as its children are. The compiler's name comes
    from the macros' SQL, level by level over the heap."""
    both = macro_graphs(rows, "codes")
    kind = "array(" + ", ".join(f"'{k}'" for k in KINDS) + f")[cast(pmod(expr_id, {len(KINDS)}) as int)]"
    both = both.select("expr_id", "nodes", "refs", F.expr(kind).alias("kind"), F.expr("coalesce(get(filter(refs, r -> r.parent = 1 AND r.at = 0), 0).child, 1L)").alias("second"), F.expr(_names()).alias("names"))
    both = settled(both, "expr_id", "nodes", "refs", "kind", "second", "names")
    compiled = "CASE kind " + " ".join(f"WHEN '{k}' THEN {t[-1]}" for k, t in eml.kinds("names[0]", "names[cast(second as int) - 1]").items()) + " END"
    both = both.select("expr_id", "kind", F.size("nodes").alias("size"), F.expr(compiled).alias("compiled"), eml.expanded("nodes", "refs", "second", "kind").alias("done"))
    return both.select("expr_id", "kind", (F.col("size") + 1).cast("long").alias("macro_nodes"), "done.eml_nodes", (F.col("done.result") == F.col("compiled")).alias("valid"))


def dag_values(rows: DataFrame, x: float = 1.3, y: float = 2.1) -> DataFrame:
    """name, value: what every node of the shared EML DAG is at x and y, over the extended reals; each node is made once, by the macro that gives it its name.

    A pair of a and b is exp(a) - ln(b); ln 0 is minus infinity, and the logarithm of a negative number is not a number. Distinct subtrees are evaluated by height: a level joins the
    results of those below and runs through its templates' steps; each level is written, so that there are as many rounds as operators on top of each other. A leaf's name
    is its label."""
    rows = settled(distinct(rows)[0], "codes", "subtrees")
    height = grammar.climb_sql(lambda k, a, b: "0" if a is None else f"CASE WHEN {k} IN (4, 5) THEN 1 + greatest({a}, {b}) WHEN {k} IN (6, 7) THEN 1 + {a} ELSE 0 END", "int")
    rows = settled(rows.select("codes", "subtrees", F.expr(height).alias("heights")), "codes", "subtrees", "heights")
    item = "named_struct('subtree', subtrees[i], 'code', k, 'height', heights[i], 'left', get(subtrees, 2 * i + 1), 'right', get(subtrees, 2 * i + 2))"
    found = rows.select(F.explode(F.expr(f"array_distinct(filter(transform(codes, (k, i) -> {item}), x -> x.code > 0))")).alias("x")).select("x.*").distinct()
    found = stage(found, "subtrees")
    names = {v: k for k, v in grammar.CODES.items()}
    steps = "map(" + ", ".join(f"{grammar.CODES[kind]}, {_steps(listed)}" for kind, listed in eml.templates().items() if kind in grammar.CODES) + ")"
    leaf = {"x": x, "y": y, "1": 1.0}
    known = found.where("height = 0").select("subtree", F.coalesce(*(F.when(F.col("code") == c, F.lit(leaf[n])) for c, n in names.items() if n in leaf)).alias("value"))
    known = stage(known, "values")
    out = [known.select(F.col("subtree").alias("name"), "value")]
    side = f"CASE t.{{0}} WHEN {eml.FIRST} THEN a WHEN {eml.SECOND} THEN b WHEN {eml.UNIT} THEN 1D ELSE v[t.{{0}}] END"
    pair = "exp(z.l) - CASE WHEN z.r = 0 THEN double('-Infinity') WHEN z.r < 0 THEN double('NaN') ELSE ln(z.r) END"
    made = f"aggregate(steps[code], cast(array() as array<double>), (v, t) -> concat(v, transform(array(named_struct('l', {side.format('l')}, 'r', {side.format('r')})), z -> {pair})))"
    for level in range(1, grammar.MAX_DEPTH + 1):
        a, b = (known.select(F.col("subtree").alias(side_), F.col("value").alias(name)) for side_, name in (("left", "a"), ("right", "b")))
        here = found.where(F.col("height") == level).join(a, "left").join(b, "right", "left").withColumn("steps", F.expr(steps))
        here = stage(settled(here, "subtree", "code", "a", "b", "steps").select("subtree", F.expr(made).alias("v")), "level")
        known = known.unionByName(here.select("subtree", F.element_at("v", -1).alias("value")))
        out.append(here.select("subtree", F.posexplode("v").alias("at", "value")).select(F.concat_ws("#", "subtree", "at").alias("name"), "value"))
    values = out[0]
    for part in out[1:]:
        values = values.unionByName(part)
    return values


#: How many references a label has.
ARITY = {"eml": 2, "x": 0, "y": 0, "1": 0}


def audit(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """One row about a DAG's tables (id, label, n_roots) and (parent, child, at): nodes, refs, leaves, roots, dangling, impure, wrong_arity, double_slots, orphans.

    dangling counts references with an end that is no node, impure nodes with a label outside the pure form, wrong_arity nodes with another number of
    references than their label has, double_slots places of a parent with two children, and orphans nodes that are no roots and have no parent; a DAG
    without orphans has no unreachable() nodes. An empty table gives a row of zeros."""
    arity = F.coalesce(*(F.when(F.col("label") == name, n) for name, n in ARITY.items()))
    out = refs.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("out"), F.count_distinct("at").alias("slots"))
    into = refs.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("into"))
    both = nodes.join(out, "id", "left").join(into, "id", "left").fillna(0, ["out", "slots", "into"])
    sums = both.agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("out") == 0).alias("leaves"),
        F.count_if(F.col("n_roots") > 0).alias("roots"),
        F.count_if(arity.isNull()).alias("impure"),
        F.count_if(arity.isNotNull() & (arity != F.col("out"))).alias("wrong_arity"),
        F.coalesce(F.sum(F.col("out") - F.col("slots")), F.lit(0)).alias("double_slots"),
        F.count_if((F.col("into") == 0) & (F.col("n_roots") == 0)).alias("orphans"),
    )
    ids = nodes.select("id")
    ends = refs.join(ids.select(F.col("id").alias("parent"), F.lit(1).alias("p")), "parent", "left").join(ids.select(F.col("id").alias("child"), F.lit(1).alias("c")), "child", "left")
    ends = ends.agg(F.count("*").alias("refs"), F.count_if(F.col("p").isNull() | F.col("c").isNull()).alias("dangling"))
    row = sums.join(ends)  # one row each
    return row.select("nodes", "refs", "leaves", "roots", "dangling", "impure", "wrong_arity", "double_slots", "orphans")


def unreachable(nodes: DataFrame, refs: DataFrame, rounds: int = 1_000) -> DataFrame:
    """id of the nodes of a DAG that no root leads to.

    Nodes without a parent that are no roots are peeled off with their references, until there are none. Each round is one anti-join and is written to the
    shared folder; a DAG without such nodes needs a single one."""
    left, gone = nodes.select("id", "n_roots"), None
    refs = refs.select("parent", "child")
    for _ in range(rounds):
        loose = stage(left.where("n_roots = 0").join(refs.select(F.col("child").alias("id")), "id", "left_anti").select("id"), "loose")
        if loose.isEmpty():
            break
        gone = loose if gone is None else gone.unionByName(loose)
        left = stage(left.join(loose, "id", "left_anti"), "left")
        refs = stage(refs.join(loose.select(F.col("id").alias("parent")), "parent", "left_anti"), "refs")
    else:
        raise RuntimeError(f"more than {rounds} rounds of peeling")
    return nodes.select("id").where("false") if gone is None else gone
