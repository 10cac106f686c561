"""Operator 13, hard-negative mining: exact integer inner products from Kronecker-packed words.

1. Vectors of integers are dealt by a hash of their id into cells of about `cell` rows, and the anchors likewise into blocks of
   about `block` rows; cells and blocks are rows of a table, written once each. Every block meets every cell, as the stated
   search of anchors against all rows asks for: a cell is sent once for each block and a block once for each cell, both as
   packed bytes, and a task holds one of each.
2. In a task the cell's components are shifted by a bias, so that none is negative, and several candidates' components stand
   in separated fields of one wide integer; one multiplication with an anchor's (biased) component serves all of them, and
   the sums over components are taken in the packed words. Fields are as wide as the greatest sum that the bias allows, so
   that none overflows into the next. Unpacked, the bias is taken off by the sums of both vectors' components: the scores
   are exact. Words are whole numbers under 2^53 in matrix products where two fields or more fit, else Python's integers
   of `fields` fields, which take any width.
3. First round: the best rows of the anchor's own label, `positives` for each anchor and cell, then for each anchor. Second
   round: with these scores as bounds, the best rows of other labels between `low` and `high` per cent of the positive's score.

What leaves a task is a few rows for each of its anchors. Everything is exact; nothing is collected to the driver.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part; of rows with one id (equal or not)
the one with the least label, then vector, stands for it; a shorter vector counts as if it went on with zeros; ties go to
the smaller id; labels and ids may be of any type that can be sorted; integers and scores beyond 64 bits are held at the
bounds of 64 bits; an anchor without another row of its label has no row in the result, nor has a positive without
a negative; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import materialize

LOW, HIGH = 1 - (1 << 63), (1 << 63) - 1  # of 64 bits
LEAST = 32  # parts that a table of more than a few rows is cut into, so that tasks share it
ANCHORS = 64  # whose scores a task holds at once


def fixed_point(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, as a double; null where the vector or a component is null or not finite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(whole, F.transform(x, lambda c: F.floor(c * scale).cast("bigint")))


def products(anchors: np.ndarray, cell: np.ndarray, fields: int = 16) -> np.ndarray:
    """Inner products of the rows of anchors with the rows of cell (both int64, of one width), exactly; held at the bounds of 64 bits."""
    bias_a, bias_x = (max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (anchors, cell))
    dim, n = cell.shape[1], len(cell)
    width = max(1, (dim * 4 * bias_a * bias_x).bit_length())  # of dim products of components up to twice the bias
    wide = 2 * width > 53
    per = fields if wide else 53 // width
    kind = object if wide else np.float64
    shifted = np.zeros((-(-n // per) * per, dim), dtype=kind)
    shifted[:n] = cell.astype(kind) + bias_x
    words = np.zeros((len(shifted) // per, dim), dtype=kind)
    for field in range(per):  # candidate number per * word + field
        words += shifted[field::per] * (1 << width * field)
    sums = (anchors.astype(kind) + bias_a) @ words.T
    if not wide:
        sums = sums.astype(np.int64)
    mask = (1 << width) - 1
    out = np.empty((len(anchors), len(shifted)), dtype=sums.dtype)
    for field in range(per):
        out[:, field::per] = (sums >> (width * field)) & mask
    kind = object if wide else np.int64
    off_a, off_x = (m.astype(kind).sum(axis=1) for m in (anchors, cell))
    out = out[:, :n] - bias_x * off_a[:, None] - bias_a * off_x[None, :] - dim * bias_a * bias_x
    return np.clip(out, LOW, HIGH).astype(np.int64)


def _pack(rows: DataFrame, size: int, n: int, name: str, more: str = "") -> DataFrame:
    """A row for each part of about `size` of the n rows, dealt by a hash of the id (small tables are cut finer, in up to `LEAST`
    parts): number, ids, labels, dim, x (the components' bytes, 2, 4 or 8 for each), and the further column of lists."""
    parts = max(1, -(-n // size), min(LEAST, -(-n // 512)))
    extra = [f for f in rows.schema.fields if f.name == more]
    schema = T.StructType(
        [T.StructField("number", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("dim", T.IntegerType()), T.StructField("x", T.BinaryType())]
        + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in extra]
    )

    def run(part: pa.Table) -> pa.Table:
        vectors = part.column("x").combine_chunks()
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        dim = max(1, int(sizes.max()))
        x = np.zeros((part.num_rows, dim), dtype=np.int64)
        x[np.arange(dim)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
        lists = [pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in ("id", "label", *(f.name for f in extra))]
        number = part.column("number").slice(0, 1).combine_chunks()
        return pa.Table.from_arrays([number, *lists[:2], pa.array([dim], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary()), *lists[2:]], names=schema.names)

    return materialize(rows.withColumn("number", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("number").applyInArrow(run, schema), name)


def _read(row: pa.Table) -> tuple[list, list, np.ndarray]:
    ids, labels, dim, x = (row.column(c)[0].as_py() for c in ("ids", "labels", "dim", "x"))
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(x) // (len(ids) * dim)]
    return ids, labels, np.frombuffer(x, dtype=kind).astype(np.int64).reshape(len(ids), dim)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (a, b))


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores; ties by order (the rank of the id)."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((order[places], -scores[places]))[:k]]


def _met(cells: DataFrame, blocks: DataFrame, work: Callable, schema: T.StructType) -> DataFrame:
    """work(cell, block) for every cell and block; each pair is a group of two rows."""
    last = [x.agg(F.max("number")).first()[0] or 0 for x in (cells, blocks)]
    # both sides' keys are of one type: Spark hashes an int and a bigint to different tasks
    left = cells.withColumnRenamed("number", "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last[1]).cast("bigint"))))
    right = blocks.withColumnRenamed("number", "block").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last[0]).cast("bigint"))))
    arrow = to_arrow_schema(schema)

    def run(cell: pa.Table, block: pa.Table) -> pa.Table:
        columns = work(_read(cell), _read(block), block) if cell.num_rows and block.num_rows else [[] for _ in arrow]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(run, schema)


def mine(rows: DataFrame, anchors: Column, vec_id: str, label: Column, vector: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, cell: int = 16384, block: int = 16384) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors: a condition on vec_id that makes a row an anchor. A negative's score times 100 is from `low` to `high` times
    the positive's score.
    """
    numbers = fixed_point(vector, scale)
    known = rows.select(F.col(f"`{vec_id}`").alias("id"), label.alias("label"), numbers.alias("x"), anchors.alias("anchor")).filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    one = known.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("row")).select("id", "row.label", "row.x", "row.anchor")
    held = materialize(one, "vectors")
    sizes = held.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    asking = held.filter("anchor").select("id", "label", "x")
    cells = _pack(held.select("id", "label", "x"), cell, sizes["n"], "cells")
    id_type, w = held.schema["id"].dataType, Window.partitionBy("anchor_id")

    def same_label(of_cell, of_block, _) -> list[list]:
        ids, labels, x = of_cell
        order = np.argsort(np.argsort(np.array(ids, dtype=object), kind="stable"), kind="stable")
        places: dict = {}
        for i, name in enumerate(labels):
            places.setdefault(name, []).append(i)
        places = {k: np.array(v) for k, v in places.items()}
        mine_: dict = {}
        for i, name in enumerate(of_block[1]):
            mine_.setdefault(name, []).append(i)
        a, x = _same_width(of_block[2], x)
        out: list[list] = [[], [], []]
        for name, of_anchors in mine_.items():
            there = places.get(name)
            for at in range(0, len(of_anchors) if there is not None else 0, ANCHORS):
                some = of_anchors[at : at + ANCHORS]
                for i, scores in zip(some, products(a[some], x[there]), strict=True):
                    best = [p for p in _best(scores, order[there], positives + 1) if ids[there[p]] != of_block[0][i]][:positives]
                    out[0] += [of_block[0][i]] * len(best)
                    out[1] += [ids[there[p]] for p in best]
                    out[2] += [int(scores[p]) for p in best]
        return out

    first = T.StructType([T.StructField("anchor_id", id_type), T.StructField("positive_id", id_type), T.StructField("positive_score", T.LongType())])
    found = _met(cells, _pack(asking, block, sizes["anchors"], "anchors"), same_label, first)
    best = found.withColumn("n", F.row_number().over(w.orderBy(F.desc("positive_score"), "positive_id"))).filter(F.col("n") <= positives)
    bounds = best.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("positives"))

    def other_label(of_cell, of_block, block_row) -> list[list]:
        ids, labels, x = of_cell
        order = np.argsort(np.argsort(np.array(ids, dtype=object), kind="stable"), kind="stable")
        of_label = {name: i for i, name in enumerate(dict.fromkeys(labels))}
        coded = np.array([of_label[name] for name in labels])
        wanted = block_row.column("positives")[0].as_py()
        a, x = _same_width(of_block[2], x)
        out: list[list] = [[] for _ in range(5)]
        for at in range(0, len(a), ANCHORS):
            for i, scores in enumerate(products(a[at : at + ANCHORS], x), at):
                others = np.flatnonzero(coded != of_label.get(of_block[1][i], -1))
                theirs = scores[others]
                for p in wanted[i]:
                    least, most = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
                    fit = others[(theirs >= max(least, LOW)) & (theirs <= min(most, HIGH))] if least <= most else others[:0]
                    for j in fit[_best(scores[fit], order[fit], negatives)]:
                        for column, value in zip(out, (of_block[0][i], p["positive_id"], ids[j], p["positive_score"], int(scores[j])), strict=True):
                            column.append(value)
        return out

    second = T.StructType([T.StructField("anchor_id", id_type), T.StructField("positive_id", id_type), T.StructField("negative_id", id_type), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])
    met = _met(cells, _pack(asking.join(bounds, "id"), block, sizes["anchors"], "bounds", "positives"), other_label, second)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
