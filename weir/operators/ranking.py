"""Scoring and ranking: field-weighted lexical retrieval, vector scoring in blocks, top-k, windows, ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lex_tokens
from .scans import ranged, run_over
from .tables import cut
from .vectors import over_grid

K1, B = 1.4, 0.75
POSTINGS = 250_000  # in a task, some
LENGTH = "\x00"  # stands in for a token in the row of a field's length


def field_tokens(docs: DataFrame, doc_id: str, fields: Mapping[str, Column], **tokens) -> DataFrame:
    """(doc, field, token, tf, len): token counts of each field, counted within the row (no shuffle of texts)."""
    per_field = F.array(*(F.struct(F.lit(name).alias("field"), lex_tokens(c, **tokens).alias("tokens")) for name, c in fields.items()))
    rows = docs.select(F.col(doc_id).alias("doc"), F.explode(per_field).alias("f")).select("doc", "f.field", "f.tokens")
    return rows.select("doc", "field", F.size("tokens").alias("len"), F.explode_outer("tokens").alias("token")).groupBy("doc", "field", "len", "token").agg(F.count("token").alias("tf"))


def bm25f_stats(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, df) over all fields, and (field, n_docs, avg_len) with a mean of 0 taken as 1."""
    df = tokens.filter("token IS NOT NULL").select("doc", "token").distinct().groupBy("token").agg(F.count("*").alias("df"))
    per_doc = tokens.select("doc", "field", "len").distinct()
    lengths = per_doc.groupBy("field").agg(F.count("*").alias("n_docs"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("avg_len"))
    return df, lengths


def bm25f(queries: DataFrame, docs: DataFrame, fields: Mapping[str, tuple[Column, float]], query_id: str = "qid", query_text: str = "query", doc_id: str = "doc_id", **tokens) -> DataFrame:
    """(qid, doc, score, matched, matched_boost) of the documents that share a token with a query.

    score = sum over query tokens of idf * w / (K1 + w), w = sum over fields of tf * boost / ((1-B) + B * len / mean).
    matched counts query tokens found, matched_boost those found in a field with a boost over 1. Postings are
    restricted to query tokens before anything is shuffled: what is written is the postings of query tokens and a row
    for each field of a document with its length, from one pass over the texts. Postings are dealt by documents, some
    POSTINGS a task; where the tokens of the queries can be broadcast, pairs aren't shuffled at all.
    """
    wanted = queries.select(F.col(query_id).alias("qid"), F.explode(F.array_distinct(lex_tokens(F.col(query_text), **tokens))).alias("token"))
    kept = wanted.select("token").distinct().unionByName(queries.sparkSession.createDataFrame([(LENGTH,)], "token string"))
    names = list(fields)
    per_field = F.array(*(F.struct(F.lit(i).alias("i"), lex_tokens(c, **tokens).alias("tokens")) for i, (c, _) in enumerate(fields.values())))
    rows = docs.select(F.col(doc_id).alias("doc"), F.explode(per_field).alias("f")).select("doc", "f.i", F.size("f.tokens").alias("len"), F.explode(F.array_append("f.tokens", F.lit(LENGTH))).alias("token"))
    held = cut(rows.join(kept, "token", "left_semi").groupBy("doc", "i", "len", "token").agg(F.count("*").alias("tf")))
    sizes = {r["i"]: (r["n"], r["mean"] or 1.0) for r in held.filter(F.col("token") == LENGTH).groupBy("i").agg(F.count("*").alias("n"), F.avg("len").alias("mean")).collect()}
    n_docs = max((n for n, _ in sizes.values()), default=0)
    weight, boosted = F.lit(0.0), F.lit(0)
    for i, name in enumerate(names):
        boost = float(fields[name][1])
        weight = F.when(F.col("i") == i, F.col("tf") * boost / (F.lit(1 - B) + B * F.col("len") / sizes.get(i, (0, 1.0))[1])).otherwise(weight)
        boosted = F.when(F.col("i") == i, int(boost > 1)).otherwise(boosted)
    postings = held.filter(F.col("token") != LENGTH)
    df = postings.groupBy("token").agg(F.count_distinct("doc").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = cut(wanted.join(df, "token").select("qid", "token", idf.alias("idf")))  # written, so that Spark knows how small it is
    # dealt by documents: their weights, and their pairs with queries, are summed up where they are
    dealt = postings.repartition(max(queries.sparkSession.sparkContext.defaultParallelism, -(-held.count() // POSTINGS)), "doc")
    weights = dealt.groupBy("doc", "token").agg(F.sum(weight).alias("w"), F.max(boosted).alias("boosted"))
    part = F.col("idf") * F.col("w") / (K1 + F.col("w"))
    return weights.join(asked, "token").groupBy("qid", "doc").agg(F.sum(part).alias("score"), F.count("*").alias("matched"), F.sum("boosted").alias("matched_boost"))


def top_k(df: DataFrame, part: Sequence[str], score: str, k: int, tiebreak: Sequence[str], rank: str = "rank") -> DataFrame:
    """The k best rows of each group; ties by the tiebreak columns, ascending. Spark keeps k rows a task before the shuffle."""
    w = Window.partitionBy(*part).orderBy(F.col(score).desc_nulls_last(), *tiebreak)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def nominate(scored: DataFrame, part: str = "qid", floor: float = 0.45, least: int = 1) -> DataFrame:
    """Rows with norm (score over the group's greatest) and evidence at the floor or over it."""
    top = cut(scored.groupBy(part).agg(F.max("score").alias("_top")))  # one row a group: no group meets in a task
    return beside(scored, top, [part]).withColumn("norm", F.col("score") / F.col("_top")).drop("_top").filter((F.col("norm") >= floor) & (F.col("matched") >= least) & (F.col("matched_boost") >= least))


def score_pairs(queries: DataFrame, docs: DataFrame, query_id: str, query_vec: str, doc_id: str, doc_vec: str, k: int, names: tuple[str, str] = ("qid", "doc")) -> DataFrame:
    """(qid, doc, score, rank): the k documents of greatest dot product for each query; ties by doc.

    Over a grid of blocks of queries and cells of documents (see vectors): a task passes on k rows for each of its queries at most, and
    one window takes the best k of those.
    """
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_vec).alias("v"))
    held = docs.select(F.col(doc_id).alias("id"), F.lit(0).alias("label"), F.col(doc_vec).alias("v"))

    def best(asked: list, scores: np.ndarray, ids: list, _) -> list[list]:
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return [[q for q in asked for _ in range(order.shape[1])], [ids[j] for j in order.ravel().tolist()], np.take_along_axis(scores, order, axis=1).ravel().tolist()]

    schema = T.StructType([T.StructField("q", asked.schema["id"].dataType), T.StructField("d", held.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return top_k(over_grid(asked, held, best, schema), ["q"], "score", k, ["d"]).select(F.col("q").alias(names[0]), F.col("d").alias(names[1]), "score", "rank")


def best_by(queries: DataFrame, docs: DataFrame, id_col: str, vec: str, by: str) -> DataFrame:
    """(qid, item, score): for each query, the greatest dot product with any other vector of each value of `by`; rows without one take no part.

    Over the grid of score_pairs; a task passes on one row for each of its queries and values.
    """
    asked = queries.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    held = docs.select(F.col(id_col).alias("id"), F.col(by).alias("label"), F.col(vec).alias("v")).filter("label IS NOT NULL")

    def best(asked: list, scores: np.ndarray, ids: list, labels: list) -> list[list]:
        place = {i: j for j, i in enumerate(ids)}
        for row, q in enumerate(asked):
            if q in place:
                scores[row, place[q]] = -np.inf
        out: list[list] = [[], [], []]
        for value in dict.fromkeys(labels):
            top = scores[:, [j for j, x in enumerate(labels) if x == value]].max(axis=1)
            some = np.flatnonzero(np.isfinite(top)).tolist()
            for column, more in zip(out, ([asked[i] for i in some], [value] * len(some), top[some].tolist()), strict=True):
                column += more
        return out

    schema = T.StructType([T.StructField("qid", asked.schema["id"].dataType), T.StructField("item", held.schema["label"].dataType), T.StructField("score", T.DoubleType())])
    return over_grid(asked, held, best, schema).groupBy("qid", "item").agg(F.max("score").alias("score"))


def dedupe_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; rows with a null or empty key are left out."""
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).filter("_key IS NOT NULL AND _key <> ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def _counted_within(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with _at, the place of each row in the total order, counted in two passes: by range partition, then offsets.
    No partition holds more than its range."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition: a window over a few thousand rows at most
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(offsets.select("_part", "_before")), "_part").withColumn("_at", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def assign_ids(new: DataFrame, existing: DataFrame, id_col: str, prefix: str, width: int, order: Sequence[str]) -> DataFrame:
    """new with ids that go on after the greatest existing number, in the given order."""
    top = existing.agg(F.coalesce(F.max(F.expr(f"try_cast(substring({id_col}, {len(prefix) + 1}) AS bigint)")), F.lit(0)).alias("_top"))
    number = F.col("_at") + F.col("_top")
    text = number.cast("string")
    return _counted_within(new, order).join(F.broadcast(top)).withColumn(id_col, F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))).drop("_at", "_top")


def first_in_group(df: DataFrame, part: Sequence[str], order: Sequence[str], flag: str = "first") -> DataFrame:
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*part).orderBy(*order)) == 1)


def latest(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last n rows of the order (a tail limit; Spark takes them without a full sort)."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def new_high(points: DataFrame, series: DataFrame, n: int, key: str = "series", value: str = "value", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """(series, status, latest, prev_max, points) for each listed series over its last n points.

    absence: no point; baseline: one; new-high: the last point is over all before it in the window; else flat.
    """
    back = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    tail = points.withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= n)
    seen = tail.groupBy(key).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("_k") > 1, F.col(value))).alias("prev_max"), F.count("*").alias("points"))
    status = F.when(F.col("points").isNull(), "absence").when(F.col("points") == 1, "baseline").when(F.col("latest") > F.col("prev_max"), "new-high").otherwise("flat")
    return series.select(key).distinct().join(seen, key, "left").select(key, status.alias("status"), "latest", "prev_max", F.coalesce("points", F.lit(0)).alias("points"))


def mask_fences(lines: DataFrame, doc: str = "doc_id", n: str = "line_no", text: str = "line") -> DataFrame:
    """lines outside fenced blocks; the fence lines go as well. Lines with a column `fenced` (lines_of) are filtered where they
    are; for others, the lines of a document meet in a window."""
    if "fenced" in lines.columns:
        return lines.filter("NOT fenced").drop("fenced", "front")
    fence = F.col(text).rlike(r"^\s*(```|~~~)")
    before = F.sum(fence.cast("int")).over(Window.partitionBy(doc).orderBy(n))
    return lines.withColumns({"_fence": fence, "_open": before}).filter(~F.col("_fence") & (F.col("_open") % 2 == 0)).drop("_fence", "_open")


def section_items(lines: DataFrame, heading: str, item: str, doc: str = "doc_id", n: str = "line_no", text: str = "line", reset: str | None = None) -> DataFrame:
    """(doc, line_no, section, item) of lines that fit `item`, with the last heading before them; both patterns have a group.
    A line that fits `reset` and not the heading ends the section."""
    head = F.nullif(F.regexp_extract(text, heading, 1), F.lit(""))
    if reset:
        head = F.coalesce(head, F.when(F.col(text).rlike(reset), F.lit("")))
    # only headings and items are shuffled
    rows = lines.select(doc, n, head.alias("head"), F.regexp_extract(text, item, 1).alias("item")).filter("head IS NOT NULL OR item <> ''")
    section = F.last("head", ignorenulls=True).over(Window.partitionBy(doc).orderBy(n).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("section", section).filter("item <> '' AND section <> ''").select(doc, n, "section", "item")


def seconds(ts: Column) -> Column:
    """Seconds of a time with or without a zone, for differences."""
    return ts.cast("timestamp").cast("double")


def quiet_point(flows: DataFrame, quiet_s: float, part: str = "session", ts: str = "ts", ranges: int | None = None) -> DataFrame:
    """(session, quiet_at): the last flow before the first gap of quiet_s seconds or more (the end counts as a gap). A session may be
    of any size (see scans)."""
    rows = run_over(ranged(flows.select(part, ts), [part], [ts], ranges), [part], [ts], after={"_next": F.col(ts)})
    gap = seconds(F.col("_next")) - seconds(F.col(ts))
    return rows.filter(gap.isNull() | (gap >= quiet_s)).groupBy(part).agg(F.min(ts).alias("quiet_at"))


def review_queue(df: DataFrame, today: Column, review: str = "review_after", status: str = "status", id_col: str = "id") -> DataFrame:
    """df with days and overdue, pending rows first, then by days (none last) and id."""
    days = F.datediff(F.expr(f"try_to_date({review})") if dict(df.dtypes)[review] == "string" else F.col(review), today)
    out = df.withColumns({"days": days, "overdue": F.coalesce((F.col(status) == "pending") & (days <= 0), F.lit(False))})
    return out.orderBy(F.when(F.col(status) == "pending", 0).otherwise(1), F.col("days").asc_nulls_last(), id_col)


def cap_hits(hits: DataFrame, n: int = 50, part: Sequence[str] = ("gate", "file"), order: Sequence[str] = ("line", "match")) -> DataFrame:
    """The first n hits of each file and one summary row (line 0) where there are more."""
    w = Window.partitionBy(*part).orderBy(*order)
    kept = hits.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k").withColumn("total", F.lit(None).cast("long"))
    over = hits.groupBy(*part).agg(F.count("*").alias("total")).filter(F.col("total") > n)
    return kept.unionByName(over.withColumns({"line": F.lit(0).cast(dict(hits.dtypes)["line"]), "match": F.lit(None).cast("string")}), allowMissingColumns=True)


def order_findings(df: DataFrame) -> DataFrame:
    return df.orderBy("file", F.col("line").asc_nulls_first(), "rule", "unit")


def at_ranks(df: DataFrame, value: str, part: Sequence[str], places: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(part…, a column for each place): the values at the places (from 0, a function of the number of rows) of each sorted group.

    Equal values are counted to one row first; the counts are then summed up in two passes over ranges of (part, value), so
    that no task holds a group and ties don't meet in one. Nulls don't count; a null part is a group.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*part, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = cut(counted.repartitionByRange(*part, "_v").withColumn("_range", F.spark_partition_id()))
    offsets = ranged.groupBy("_range").agg(F.sum("_c").alias("_c"))
    # one row for each range: a window over a few thousand rows at most
    offsets = offsets.select("_range", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    local = F.sum("_c").over(Window.partitionBy("_range").orderBy(*part, "_v")) - F.col("_c")
    placed = cut(ranged.withColumn("_local", local).join(F.broadcast(offsets), "_range").withColumn("_before", F.col("_offset") + F.col("_local")).drop("_range", "_local", "_offset"))
    groups = placed.groupBy(*part).agg(F.min("_before").alias("_first"), F.sum("_c").alias("_n"))
    rows = beside(placed, groups, part).withColumn("_at", F.col("_before") - F.col("_first"))
    inside = lambda at: (F.col("_at") <= at(F.col("_n"))) & (at(F.col("_n")) < F.col("_at") + F.col("_c"))
    return rows.groupBy(*part).agg(*(F.max(F.when(inside(at), F.col("_v"))).alias(name) for name, at in places.items()))


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with right's columns by keys, of which nulls equal nulls; without keys, right is one row."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if not keys:
        return left.join(right)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, same, "left").drop(*(f"_r_{k}" for k in keys))


def nearest_rank(f: float) -> Callable[[Column], Column]:
    """The place min(n-1, floor(n*f)): another one than percentile_disc has for even n at 0.5."""
    return lambda n: F.least(n - 1, F.floor(n * f))


def rank_percentile(df: DataFrame, value: str, f: float, part: Sequence[str] = ()) -> DataFrame:
    """(part…, p): the value at index min(n-1, floor(n*f)) of the sorted group, or of the whole table."""
    out = at_ranks(df, value, part, {"p": nearest_rank(f)})
    return out if part else out.filter("p IS NOT NULL")


def score_with(pairs: DataFrame, start: Callable[[], Callable[[str, list[str]], list[float]]], query: str = "query", text: str = "text", batch: int = 8, out: str = "score") -> DataFrame:
    """Scorer surface: start() loads a model once a task and gives score(query, texts) -> scores; pairs go in batches of one query."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in pairs.schema.fields if f.name != out), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = start()
        for b in batches:
            qs, ts = b.column(query).to_pylist(), b.column(text).to_pylist()
            got: list[float] = []
            k = 0
            while k < len(qs):
                m = k
                while m < len(qs) and m - k < batch and qs[m] == qs[k]:
                    m += 1
                got += [float(x) for x in score(qs[k] or "", [t or "" for t in ts[k:m]])]
                k = m
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-1]), pa.array(got, pa.float64())], names=[f.name for f in schema.fields])

    return pairs.mapInArrow(run, schema)
