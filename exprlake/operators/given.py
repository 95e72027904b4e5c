"""Measuring expressions that were given as text: files of them, or a text column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.functions.given import FIELDS, measures


def measured(rows: DataFrame, key: str = "index", text: str = "srepr", fallback: str = "expression") -> DataFrame:
    """expr_id, source (which column was read), supported, error, ast_nodes, ast_depth, eml_nodes, eml_depth, eml_dag_nodes.

    The constructor text is preferred to the fallback column; a text that can't be read is unsupported and has no sizes. Nulls in
    both columns are unsupported too. One row in, one row out; sizes beyond 64 bits are unsupported."""
    kind = rows.schema[key].dataType.simpleString()
    names = ["expr_id", "source", "supported", "error", *FIELDS]

    def row(first: str | None, second: str | None) -> tuple:
        said = first if first is not None else second
        source = text if first is not None else fallback if second is not None else None
        try:
            found = measures(said or "")
            if max(found) >= 1 << 63:
                raise ValueError("too large")
            return source, True, None, *found
        except ValueError as error:
            return source, False, str(error), *([None] * len(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.bool_(), pa.string(), *([pa.int64()] * len(FIELDS))]
        for batch in batches:
            cols = list(zip(*map(row, batch.column(1).to_pylist(), batch.column(2).to_pylist()), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    second = F.col(fallback) if fallback in rows.columns else F.lit(None).cast("string").alias(fallback)
    return rows.select(key, text, second).mapInArrow(run, f"expr_id {kind}, source string, supported boolean, error string, " + ", ".join(f"{f} long" for f in FIELDS))


def order_texts(orders: DataFrame) -> DataFrame:
    """index, srepr: a sum, a quotient or a difference for every order, with its numbers in it."""
    a, b = (2 + F.col("o_custkey") % 97).cast("string"), (2 + F.col("o_orderkey") % 7).cast("string")
    said = {
        0: ("Add(Mul(Integer(", a, "), Symbol('x')), Pow(Symbol('y'), Integer(", b, ")))"),
        1: ("Mul(log(Symbol('x')), Pow(Integer(", a, "), Integer(-1)))"),
        2: ("Add(Mul(Symbol('x'), Integer(", b, ")), Mul(Integer(-1), Symbol('y')))"),
    }
    text = F.coalesce(*(F.when(F.col("o_orderkey") % 3 == k, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))) for k, parts in said.items()))
    return orders.select(F.col("o_orderkey").alias("index"), text.alias("srepr"))
