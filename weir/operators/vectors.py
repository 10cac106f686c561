"""Dot products of stated queries with all vectors, in blocks: a grid of cells of vectors and blocks of queries.

Vectors are dealt by a hash of their id into cells of about `CELL` rows, queries into blocks of about `BLOCK`; each is one row of packed
numbers. Every block meets every cell in a group of two rows, so that a task holds one of each, whatever the number of queries, and passes on
only the best of its products. Ids are of any type that can be sorted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CELL, BLOCK = 16384, 4096
LEAST, LEAST_ROWS = 16, 512  # small tables are cut into up to so many cells of so many rows, so that tasks share them
AT_ONCE = 256  # queries whose products a task holds


def _packed(rows: DataFrame, size: int, finer: bool) -> tuple[DataFrame, int]:
    """(number, ids, labels, dim, x) of each part of rows(id, label, v), and how many parts there are."""
    n = rows.count()
    parts = max(1, -(-n // size), min(LEAST, -(-n // LEAST_ROWS)) if finer else 1)
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("dim", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(part: pa.Table) -> pa.Table:
        ids, labels, vectors = (part.column(c).to_pylist() for c in ("id", "label", "v"))
        order = sorted(range(len(ids)), key=ids.__getitem__)  # ties go by id from here on
        x = np.array([vectors[i] for i in order], dtype=np.float64)
        lists = [pa.array([[values[i] for i in order]], pa.list_(part.schema.field(c).type)) for c, values in (("id", ids), ("label", labels))]
        return pa.Table.from_arrays([part.column("number").slice(0, 1).combine_chunks(), *lists, pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=schema.names)

    return rows.withColumn("number", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("number").applyInArrow(run, schema), parts


def _read(row: pa.Table) -> tuple[list, list, np.ndarray]:
    ids, labels, dim, x = (row.column(c)[0].as_py() for c in ("ids", "labels", "dim", "x"))
    return ids, labels, np.frombuffer(x).reshape(len(ids), dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q times x transposed, added up component by component: equal vectors get equal products wherever they stand, so that ties
    are ties (a matrix product adds in an order that depends on the place)."""
    columns, part = np.ascontiguousarray(x.T), np.empty(len(x))
    out = np.zeros((len(q), len(x)))
    for total, factors in zip(out, q, strict=True):
        for factor, column in zip(factors, columns, strict=True):
            total += np.multiply(column, factor, out=part)
    return out


def over_grid(queries: DataFrame, docs: DataFrame, work: Callable, schema: T.StructType) -> DataFrame:
    """work(query ids, products, ids, labels) for some queries and a cell at a time gives columns of the schema.

    queries: (id, v); docs: (id, label, v); rows with a null id or vector take no part. Vectors are of one length.
    """
    known = "id IS NOT NULL AND v IS NOT NULL"
    cells, n_cells = _packed(docs.filter(known), CELL, True)
    blocks, n_blocks = _packed(queries.withColumn("label", F.lit(0)).filter(known), BLOCK, False)
    # both sides' keys are of one type: Spark hashes an int and a bigint to different tasks
    left = cells.withColumnRenamed("number", "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    right = blocks.withColumnRenamed("number", "block").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_cells - 1).cast("bigint"))))
    arrow = to_arrow_schema(schema)

    def run(cell: pa.Table, block: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in arrow]
        if cell.num_rows and block.num_rows:
            (ids, labels, x), (asked, _, q) = _read(cell), _read(block)
            for at in range(0, len(asked), AT_ONCE):
                for column, more in zip(columns, work(asked[at : at + AT_ONCE], products(q[at : at + AT_ONCE], x), ids, labels), strict=True):
                    column += more
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(run, schema)
