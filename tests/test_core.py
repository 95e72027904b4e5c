"""The corpus, its closed forms and the registered queries against their DuckDB oracles."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from exprlake.functions import measures
from exprlake.functions import given
from exprlake.operators import corpus, export, motifs
from exprlake.operators import given as given_rows
from exprlake.plans import registry
from exprlake.sources import files
from exprlake.streaming import resume

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, sizes",
    [
        ("Add(Symbol('x'), Symbol('y'))", (3, 1, 27, 9, 16)),
        ("Add(Symbol('x'), Symbol('x'))", (3, 1, 27, 9, 15)),
        ("Mul(Symbol('x'), Symbol('y'))", (3, 1, 41, 10, 23)),
        ("Mul(Symbol('x'), Symbol('x'))", (3, 1, 41, 10, 19)),
        ("log(Symbol('x'))", (2, 1, 7, 3, 5)),
        ("exp(Symbol('x'))", (2, 1, 3, 1, 3)),
        ("Pow(Symbol('x'), Integer(2))", (3, 1, 75, 18, 29)),
    ],
)
def test_published_sizes(text, sizes):
    assert given.measures(text) == sizes


def test_closed_forms_of_all_kinds():
    size = lambda text: given.measures(text)[2]
    assert [size(f"Integer({n})") for n in (0, 1, 2, 7, 64)] == [7, 1, 27, 26 * 7 - 25, 26 * 64 - 25]
    assert size("Integer(-3)") == 26 * 3 - 25 + 16
    assert size("Add(Symbol('x'), Mul(Integer(-1), Symbol('y')))") == 1 + 1 + 9
    assert size("Mul(Symbol('x'), Pow(Symbol('y'), Integer(-1)))") == 1 + 1 + 63
    assert size("Rational(2, 3)") == 27 + (26 * 3 - 25) + 24 + 39
    assert size("Float('0.5')") == size("Rational(1, 2)")


#: Texts of known constructors that make no expression.
BROKEN = ["Rational(1, 0)", "Symbol()", "Add()", "Pow(Symbol('x'))", "Integer('a')", "exp()", "Rational(1)", "Integer([1])", "Symbol(x)"]


def test_given_texts(spark):
    rows = spark.createDataFrame([(1, "Symbol('x')", None), (2, None, "exp(Symbol('y'))"), (3, "sin(Symbol('x'))", None), (4, None, None), (5, "__import__('os')", None), *((k, t, None) for k, t in enumerate(BROKEN, 6))], "index long, srepr string, expression string")
    found = {r["expr_id"]: r for r in given_rows.measured(rows).collect()}
    assert [found[k]["supported"] for k in range(1, 6)] == [True, True, False, False, False]
    assert not any(found[k]["supported"] for k in range(6, 6 + len(BROKEN)))
    assert (found[1]["eml_nodes"], found[2]["eml_nodes"], found[2]["source"], found[3]["eml_nodes"]) == (1, 3, "expression", None)


def test_corpus_equals_the_compiler(spark):
    """Sizes of the whole small corpus against the interning compiler, which knows nothing of the closed forms."""
    names = {"x": "Symbol('x')", "y": "Symbol('y')", "1": "Integer(1)"}

    def said(labels, p=1):
        label = labels[p - 1]
        return names.get(label) or f"{label}({', '.join(said(labels, c) for c in (2 * p, 2 * p + 1) if c <= 31 and labels[c - 1])})"

    rows = registry.facts_of(spark, SF).select("labels", "ast_nodes", "ast_depth", "eml_nodes", "eml_depth", "eml_dag_nodes", "value").collect()
    for r in rows[::7]:
        e = given.read(said(r["labels"]))
        terms = given.Terms()
        fold = lambda e: terms.one() if e[0] == "Number" else terms.of(e) if e[0] == "Symbol" else getattr(terms, {"Add": "add", "Mul": "mul"}.get(e[0], e[0]))(*map(fold, e[1:]))  # noqa: B023, E731
        root = fold(e)
        assert (*given.tree(e), terms.size[root], terms.depth[root], terms.shared(root)) == tuple(r[:-1])[1:]
    assert len(rows) == 1000


def test_threshold():
    assert math.isclose(measures.threshold(), 1.5578858913)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda v: None if v is None or v != v else (f"{v:.6f}" if isinstance(v, float) else str(v))
    return sorted(tuple(str(value(v)) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def once():
    """Plans of the corpora are made once for all queries here."""
    made, plain = {}, registry.facts_of
    registry.facts_of = lambda *a: made.setdefault(a[1:], None) or made.update({a[1:]: plain(*a)}) or made[a[1:]]
    yield
    registry.facts_of = plain


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_oracle(spark, duck, once, name):
    ours = registry.QUERIES[name](spark, SF).toArrow().to_pandas(integer_object_nulls=True)
    theirs = duck.execute(registry.ORACLE[name]).to_arrow_table().to_pandas(integer_object_nulls=True)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0 and canonical(ours) == canonical(theirs)


#: Queries whose result is held against plain Python instead.
NO_SQL = {"dag_values"}


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) - NO_SQL == set(registry.ORACLE)


def test_shared_size_never_exceeds_tree(spark):
    rows = registry.facts_of(spark, SF).select("eml_nodes", "eml_dag_nodes").collect()
    assert all(1 <= r["eml_dag_nodes"] <= r["eml_nodes"] for r in rows)


def test_empty_and_null_keys(spark):
    assert corpus.facts(spark.createDataFrame([], "event_id long")).select("expr_id", "eml_nodes").count() == 0
    rows = spark.createDataFrame([(None, "a"), (5, None), (5, "b")], "event_id long, labels string")
    assert [r["expr_id"] for r in corpus.facts(rows).select("expr_id").collect()] == [5, 5]


def test_measuring_needs_no_shuffle(spark):
    keys = spark.read.parquet(f"{SF}/events.parquet")
    plan = corpus.facts(keys).select("expr_id", "eml_nodes", "expression")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "struct<event_id:bigint>" in plan


def test_motifs_count_a_shared_subtree_once(spark):
    labels = ["Add", "exp", "exp", "x", None, "x", *[None] * 25]
    subtrees = ["Add(exp(x), exp(x))", "exp(x)", "exp(x)", "x", None, "x", *[None] * 25]
    rows = spark.createDataFrame([(1, "train", "nontrivial_v1", labels, subtrees)], "expr_id long, split string, feature_subset string, labels array<string>, subtrees array<string>")
    assert sorted((r["signature"], r["c"]) for r in motifs.occurrences(rows).collect()) == [("Add", 1), ("Add[left:exp,right:exp]", 1), ("exp", 1)]


def test_filters_stay_behind_the_barrier(spark):
    rows = corpus.settled(registry.facts_of(spark, SF), "expr_id", "expression", "feature_subset")
    assert rows.where("feature_subset = 'nontrivial_v1' and expression like 'log%'").count() > 0


def test_record_validation(spark):
    sound = export.records(registry.facts_of(spark, SF))
    assert export.validated(sound).where("size(errors) > 0").count() == 0
    broken = spark.createDataFrame([("g", "e", [(2, "x"), (2, "y")], [(1, 3, "x")])], sound.schema)
    assert len(export.validated(broken).first()["errors"]) == 4


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "x + y", None, 1, None), (1, "x", "Symbol('x')", 0, None)], files.EXPRESSION_SCHEMA)
    files.write_json(rows, f"{tmp_path}/a")
    assert files.read_expressions(spark, f"{tmp_path}/a", 2).count() == 2
    with pytest.raises(ValueError):
        files.read_expressions(spark, f"{tmp_path}/a", 3)
    metrics = spark.createDataFrame([(1, "x", True, 1, 1, 1.0), (2, "y", False, 1, 1, 1.0)], files.METRIC_SCHEMA)
    files.write_csv(metrics, f"{tmp_path}/b")
    assert [r["expr_id"] for r in files.read_metrics(spark, f"{tmp_path}/b").collect()] == [1]
    for kind, ddl in files.METRIC_KINDS.items():
        files.write_csv(spark.createDataFrame([], ddl), f"{tmp_path}/{kind}")
        assert files.read_metrics(spark, f"{tmp_path}/{kind}", kind).count() == 0
    files.write_json(export.records(registry.facts_of(spark, SF)), f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/c").count() == 1000


def test_metric_files_with_nulls_bad_rows_and_missing_columns(spark, tmp_path):
    names = [f.name for f in files.T.StructType.fromDDL(files.METRIC_KINDS["motif"]).fields]
    lines = [
        ",".join(["more", *reversed(names)]),
        "z,all_v1,train,true,1.5,4,true,Symbol('x'),x,1",
        "z,,,,,,true,,,2",
        "z,all_v1,train,true,much,4,true,y,y,3",
        "z,all_v1,train,true,1.5,4,false,y,y,4",
    ]
    (tmp_path / "motif.csv").write_text("\n".join(lines))
    path = str(tmp_path / "motif.csv")
    dropped = {r["index"]: r for r in files.read_metrics(spark, path, "motif", bad="drop").collect()}
    assert sorted(dropped) == [1, 2] and dropped[1]["compression_gain"] == 1.5 and dropped[2]["split"] is None
    told = {r["index"]: r["bad"] for r in files.read_metrics(spark, path, "motif", bad="report").collect()}
    assert told == {1: [], 2: [], 3: ["compression_gain"], 4: []}
    with pytest.raises(Exception, match="bad value in compression_gain"):
        files.read_metrics(spark, path, "motif").collect()
    with pytest.raises(ValueError, match="macro_graph_nodes"):
        files.read_metrics(spark, path, "macro")
    with pytest.raises(ValueError):
        files.read_metrics(spark, path, "motif", bad="ignore")


@pytest.mark.parametrize("kind", sorted(files.METRIC_KINDS))
def test_filled_metric_files_come_back(spark, tmp_path, kind):
    fields = files.T.StructType.fromDDL(files.METRIC_KINDS[kind])
    value = {"bigint": 7, "int": 3, "double": 0.1 + 0.2, "string": "a, \"b\"", "boolean": True}
    rows = [tuple(value[f.dataType.simpleString()] for f in fields), tuple(value[f.dataType.simpleString()] if f.name in ("supported", "index", "expr_id") else None for f in fields)]
    files.write_csv(spark.createDataFrame(rows, fields), f"{tmp_path}/x")
    assert sorted(map(str, files.read_metrics(spark, f"{tmp_path}/x", kind).collect())) == sorted(map(str, spark.createDataFrame(rows, fields).collect()))


def test_stream_resumes(spark, tmp_path):
    spark.range(0, 20).selectExpr("id AS event_id").write.parquet(f"{tmp_path}/in")
    resume.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    more = spark.range(10, 30).selectExpr("id AS event_id").unionByName(spark.createDataFrame([(None,), (29,), (1 << 20,)], "event_id long"))
    more.write.mode("append").parquet(f"{tmp_path}/in")
    resume.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    found = resume.rows(spark, f"{tmp_path}/out")
    assert found.count() == 31 and found.select("expr_id").distinct().count() == 31
    resume.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    assert resume.rows(spark, f"{tmp_path}/out").count() == 31


@pytest.mark.parametrize("killed", ["before", "after"])
def test_a_killed_batch_counts_once(spark, tmp_path, monkeypatch, killed):
    """The second batch dies before or after its rows' summary is there; the restarted run has the figures of one run over all keys."""
    run = lambda: resume.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    spark.range(0, 40).selectExpr("id AS event_id").write.parquet(f"{tmp_path}/in")
    run()
    spark.range(30, 90).selectExpr("id AS event_id").write.mode("append").parquet(f"{tmp_path}/in")
    plain = resume.summarise

    def dying(rows):
        if killed == "after":
            plain(rows).write.mode("overwrite").parquet(f"{tmp_path}/out/summary/batch=1")
        raise RuntimeError("killed")

    monkeypatch.setattr(resume, "summarise", dying)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(resume, "summarise", plain)
    run()
    whole = export.summary(corpus.facts(spark.range(0, 90), "id"))
    assert sorted(map(tuple, resume.summary(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, whole.collect()))
    assert resume.rows(spark, f"{tmp_path}/out").groupBy("expr_id").count().where("count > 1").count() == 0


def test_a_batch_reads_its_key_ranges_only(spark, tmp_path):
    spark.range(0, 10).selectExpr("id AS event_id").write.parquet(f"{tmp_path}/in")
    resume.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    done = spark.read.schema("expr_id long, batch long, key_range long").parquet(f"{tmp_path}/out/rows")
    batch = spark.createDataFrame([(5,), (11,)], "event_id long")
    found = resume.measured(batch, "event_id", done)
    assert [r["expr_id"] for r in found.collect()] == [11]
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString().lower() or "key_range" in found._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_shared_sizes_equal_a_walk_of_the_terms(spark):
    """Matrices of codes against the terms written out, over more rows than are worked on at once, and tasks of bounded size."""
    from exprlake.functions import batches, eml

    rows = [r["codes"] for r in registry.facts_of(spark, "/root/testdata/sf0.001").select("codes").collect()]

    def nodes(codes):
        name, seen = {}, set()
        for p in reversed(range(len(codes))):
            if codes[p] in eml.LEAVES:
                name[p] = (codes[p],)
                seen.add(name[p])
            elif codes[p]:
                sides, kind = {eml.FIRST: name[2 * p + 1], eml.SECOND: name.get(2 * p + 2), eml.UNIT: (3,)}, {4: "Add", 5: "Mul", 6: "exp", 7: "log"}[codes[p]]
                for k, (a, b) in enumerate(eml.templates()[kind]):
                    sides[k] = ids.setdefault((sides[a], sides[b]), (4, len(ids)))
                    seen |= {sides[a], sides[b], sides[k]}
                name[p] = sides[k]
        return len(seen)

    import numpy as np

    ids = {}
    plain = [nodes(c) for c in rows]
    assert batches.dag_nodes(np.array(rows * 6)).tolist() == plain * 6 and 6 * len(rows) > batches.ROWS
    assert batches.dag_nodes(np.zeros((0, 31), np.int32)).tolist() == []
    keys = spark.range(0, 5 * registry.TASK_KEYS + 1, 1, 1)
    assert registry.spread(keys).rdd.getNumPartitions() == 6 and registry.spread(keys.limit(1)).rdd.getNumPartitions() == 4


def test_draws_and_names_in_numpy_equal_sql(spark):
    """Codes of keys of both signs against the grammar's SQL, pairs against Spark's hash, and a key whose draws do not fit 64 bits."""
    import numpy as np

    from exprlake.functions import batches, eml, grammar

    most = batches.MOST_KEY
    keys = spark.range(-500, 3000).union(spark.range(10**12, 10**12 + 500)).union(spark.range(most - 1, most + 1)).selectExpr("id AS expr_id")
    drawn = grammar.drawn_sql("expr_id")
    rows = corpus.settled(keys.select("expr_id", *(F.expr(sql).alias(name) for name, sql in drawn.items())), "expr_id", *drawn)
    rows = corpus.settled(rows.select("expr_id", F.expr(grammar.codes_sql()).alias("codes")), "expr_id", "codes").collect()
    assert batches.codes(np.array([r["expr_id"] for r in rows])).tolist() == [r["codes"] for r in rows] and len(rows) == 4002
    with pytest.raises(OverflowError):
        batches.codes(np.array([most + 1]))
    assert batches.codes(np.zeros(0, np.int64)).shape == (0, 31)
    a, b = np.array([101, 103, -5, 2**62]), np.array([103, 103, 7, -(2**63)])
    found = [r[0] for r in spark.createDataFrame([*zip(a.tolist(), b.tolist(), strict=True)], "a long, b long").selectExpr(eml.pair("a", "b")).collect()]
    assert batches.pair(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist() == found


def test_columns_read_no_drawn_arrays(spark):
    """A key's codes are drawn a batch at a time: no plan holds the SQL of the draws, which took most of a query's time."""
    plan = registry.QUERIES["alpha_scatter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "48271" not in plan
