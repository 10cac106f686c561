"""What the corpus operators share: shared-folder tables, bindings for native expressions, hashing rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rules: space and U+0009 to U+000D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
PART_BYTES = 2_000_000  # of text that a worker turns into Python objects at once
SIEVE_BITS, SIEVE_BITS_EACH = 1 << 24, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local one is made only in local mode, where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weir-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and lost executors cost no recomputation.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weir-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it (also inside its lambdas)."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == remainder, F.lit(False))


def _parts(values: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches of values of about `most` bytes (one row at least)."""
    if not (pa.types.is_string(values.type) or pa.types.is_binary(values.type) or pa.types.is_large_string(values.type)):
        if len(values):
            yield 0, len(values)
        return
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.float64)) + 16)
    at = 0
    while at < len(values):
        n = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")) - at)
        yield at, n
        at += n


def tidy() -> None:
    """Gives back to the system what a task's objects held: Spark uses a worker again for later tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What an operator keeps in a worker between its tasks (a vocabulary, say), and how it is given up.
KEPT: dict[str, Callable[[], None]] = {}


def give_up(but: str = "") -> None:
    """Frees what other operators have kept in this worker."""
    for name in [name for name in KEPT if name != but]:
        KEPT.pop(name)()


def tidied(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """run, and tidy at the end of a task. At its start, what operators other than `keeps` have kept is given up."""

    def outer(batches: Iterator) -> Iterator:
        give_up(keeps)
        try:
            yield from run(batches)
        finally:
            tidy()

    return outer


def map_parts(rows: DataFrame, column: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str = "") -> DataFrame:
    """rows.mapInArrow with batches cut so that the column has about PART_BYTES in each. keeps: see tidied."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in _parts(whole.column(column)):
                yield whole.slice(at, n)

    return rows.mapInArrow(tidied(lambda batches: run(parts(batches)), keeps), schema)


def map_column(rows: DataFrame, column: str, start: Callable[[], Callable[[list], dict[str, pa.Array]]], added: str, keep: bool = False, keeps: str = "") -> DataFrame:
    """rows with new columns computed from one column in Arrow batches; the other columns pass through untouched.

    start() is called once a task and gives the function of some values (None for null), of about PART_BYTES at a
    time. The column itself is dropped unless keep is set; a new column takes the place of one of its name.
    """
    fields = T._parse_datatype_string(added).fields
    new = [f.name for f in fields]
    carried = [f for f in rows.schema.fields if f.name not in new and (keep or f.name != column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            made = work(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), *(made[n] for n in new)], names=[*(f.name for f in carried), *new])

    return map_parts(rows, column, run, T.StructType([*carried, *fields]), keeps)


def with_column(rows: DataFrame, column: str, start: Callable[[], Callable[[list], pa.Array]], name: str, kind: str) -> DataFrame:
    """rows with one new column computed from one column; only that one goes to Python, all others stay where they are."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_up()
        work = start()
        try:
            for whole in batches:
                made = [work(whole.slice(at, n).to_pylist()) for at, n in _parts(whole)]
                yield pa.concat_arrays(made) if made else work([])
        finally:
            tidy()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn(name, F.arrow_udf(run, kind)(F.col(f"`{column}`")))


def _marked(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """rows with `_weir_may`: false only where the key isn't in wanted (rows with a null in the key are false).

    By a bitmap of hashed keys with some SIEVE_BITS_EACH bits for each key, of SIEVE_BITS at most: what is broadcast has
    SIEVE_BITS / 64 rows, however many keys there are. (Where the bitmap is full, all rows may be wanted.)
    """
    n = wanted.count()
    bits = min(SIEVE_BITS, 1 << max(12, (SIEVE_BITS_EACH * n).bit_length()))
    place = F.pmod(F.xxhash64(*on, F.lit("sieve")), F.lit(bits))
    bitmap = wanted.select(place.alias("p")).select(F.expr("p div 64").alias("_weir_word"), F.expr("shiftleft(1L, cast(p % 64 AS int))").alias("_weir_bit")).groupBy("_weir_word").agg(F.bit_or("_weir_bit").alias("_weir_bits"))
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    may = known & F.coalesce(F.expr("(_weir_bits & shiftleft(1L, cast(_weir_p % 64 AS int))) <> 0"), F.lit(False))
    return rows.withColumn("_weir_p", place).withColumn("_weir_word", F.expr("_weir_p div 64")).join(F.broadcast(bitmap), "_weir_word", "left").withColumn("_weir_may", may).drop("_weir_word", "_weir_p", "_weir_bits")


def _through(marked: DataFrame, on: list[str]) -> DataFrame:
    """The rows that may be wanted. The key passes through the bitmap, so that a later join by it can't be moved before it."""
    return marked.withColumns({c: F.when(F.col("_weir_may"), F.col(c)) for c in on}).filter(F.col("_weir_may") & F.col(on[0]).isNotNull()).drop("_weir_may")


def sifted(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """rows less most of those whose key isn't in wanted (distinct keys), so that few are left to shuffle."""
    return _through(_marked(rows, wanted, on), on)


def without(rows: DataFrame, unwanted: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key isn't in unwanted (distinct keys); only rows that the bitmap can't clear are shuffled. Rows with a null in the key stay."""
    marked = _marked(rows, unwanted, on)
    clear = marked.filter(~F.col("_weir_may")).drop("_weir_may")
    return clear.unionByName(_through(marked, on).join(unwanted.hint("merge"), on, "left_anti").select(clear.columns))


def text_rows(docs: DataFrame, doc_id: str, text: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text (a string) and the carried columns: what a scan of the texts needs, and no other column."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *(c.alias(k) for k, c in (carry or {}).items()))
