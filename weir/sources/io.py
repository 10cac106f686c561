"""Readers and writers: labelled cases, tolerant and strict JSON lines, transcripts, file census, facts, ledgers, lockfiles."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .census import IGNORE, Census

EXPECT = "struct<domain:string,action:string,actionIn:array<string>,skills:array<string>,anySkills:array<string>,band:array<double>>"
CASE = f"id string, query string, expect {EXPECT}, tier string, provenance string, lang string, `of` string, note string"
EXTRA = "struct<to:string,dead:boolean,external:boolean,mechanism:string,shape:string,surface:string,symbol:string,ambiguous:boolean,candidates:array<string>,source:string,docrole:string>"
FACT = f"v int, unit string, kind string, name string, file string, line int, fidelity string, scope string, extractor string, extra {EXTRA}"
EVENT = "schema_version string, event string, timestamp string, work_unit_id string, duration_ms double, ok boolean, error_code string, hint_hash string, warn_count int, error_count int, failed_suites int, skipped_suites int"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of all JSON-lines files; the tier comes from the file name where a row has none."""
    df = spark.read.schema(CASE).json(path).filter("id IS NOT NULL")
    from_name = F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z0-9]+)-tier", 1))
    return df.withColumn("tier", F.coalesce("tier", F.nullif(from_name, F.lit(""))))


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row (malformed, missing)): bad lines are counted, a missing path is reported and gives no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema), spark.createDataFrame([(0, True)], "malformed long, missing boolean")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j")).select("j.*")
    return parsed.filter("_bad IS NULL").drop("_bad"), parsed.agg(F.count("_bad").alias("malformed")).withColumn("missing", F.lit(False))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts; any bad line stops the read."""
    return spark.read.schema(FACT).option("mode", "FAILFAST").json(path)


def merge_facts(base: DataFrame, *extras: DataFrame) -> DataFrame:
    """base and extras by name; a row of an extra without its required keys, or of another version, stops the job."""
    ok = F.expr("v = 1 AND unit IS NOT NULL AND kind IS NOT NULL AND file IS NOT NULL AND fidelity IS NOT NULL")
    out = base
    for e in extras:
        checked = e.filter(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a fact lacks v, unit, kind, file or fidelity")).cast("boolean")))
        out = out.unionByName(checked, allowMissingColumns=True)
    return out


MESSAGE = "type string, timestamp string, message struct<content:string>"
PART = "array<struct<type:string,text:string,name:string,input:struct<skill:string>>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, turn, ts, role, text, activated) of nested session files: text is the content or its text parts, joined."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("session"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value").filter(F.trim("value") != "")
    j = lines.withColumn("m", F.from_json("value", MESSAGE)).filter("m.type IS NOT NULL")
    content = F.col("m.message.content")
    parts = F.from_json(content, PART)
    nested = F.startswith(F.trim(content), F.lit("["))
    text = F.when(nested, F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), " ")).otherwise(content)
    skill = F.get(F.filter(parts, lambda p: (p["type"] == "tool_use") & (p["name"] == "Skill") & p["input"]["skill"].isNotNull()), F.lit(0))["input"]["skill"]
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("session").orderBy("_b", "_i"))
    return j.select("session", turn.alias("turn"), F.col("m.timestamp").alias("ts"), F.col("m.type").alias("role"), text.alias("text"), F.when(nested, skill).alias("activated"))


def file_census(spark: SparkSession, root: str, ignore: Sequence[str] = IGNORE) -> DataFrame:
    """(path, ext, bytes, kind, target, dead) of the files, folders and links below root; ignored folders go. See `census`."""
    spark.dataSource.register(Census)
    return spark.read.format(Census.name()).option("ignore", json.dumps(list(ignore))).load(root)


def availability(units: DataFrame, declared: DataFrame, key: str = "name") -> DataFrame:
    """(name, state) of the declared names: unregistered, disabled, missing, invalid or ready; a unit named twice stops the job.

    units: (name, enabled, present, valid).
    """
    one = units.groupBy(key).agg(F.first("enabled").alias("enabled"), F.first("present").alias("present"), F.first("valid").alias("valid"), F.count("*").alias("_n"))
    one = one.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("named twice: "), F.col(key).cast("string"))).cast("boolean")))
    state = F.when(F.col("_n").isNull(), "unregistered").when(~F.col("enabled"), "disabled").when(~F.col("present"), "missing").when(~F.col("valid"), "invalid").otherwise("ready")
    return declared.select(key).distinct().join(one, key, "left").select(key, state.alias("state"))


def write_facts(df: DataFrame, path: str, order: Sequence[str] = ("file", "line", "kind", "name", "unit"), single: bool = False) -> None:
    """One JSON a row, in a total order across the part files (in one file only if asked for)."""
    ordered = df.coalesce(1).sortWithinPartitions(*order) if single else df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def append_events(df: DataFrame, path: str, batch: str, ts: str = "timestamp") -> bool:
    """Appends a batch to a ledger, once: False, and nothing changes, where a batch of that name is there already.

    Rows go to a folder of their own, one folder a day in it; the batch is there from when its manifest (`_commits/NAME`, which names that
    folder) is renamed into place, which can't replace another. What a lost attempt has left has no manifest and is never read.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", batch):
        raise ValueError(f"a batch has a name of letters, digits, dots, dashes and underscores: {batch}")
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    manifest = hadoop.Path(f"{path}/_commits/{batch}")
    files = hadoop.FileContext.getFileContext(manifest.getFileSystem(conf).makeQualified(manifest).toUri(), conf)
    if files.util().exists(manifest):
        return False
    folder = f"attempt={uuid.uuid4().hex}"
    df.withColumn("day", F.to_date(F.col(ts))).write.partitionBy("day").json(f"{path}/{folder}")
    draft = hadoop.Path(f"{path}/_drafts/{folder}")
    out = draft.getFileSystem(conf).create(draft)
    try:
        out.write(json.dumps({"batch": batch, "folder": folder}).encode())
    finally:
        out.close()
    files.mkdir(manifest.getParent(), None, True)
    try:
        files.rename(draft, manifest, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Exception:
        if files.util().exists(manifest):  # another writer was first
            return False
        raise
    return True


def read_ledger(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Rows of the committed batches of a ledger, with their day and batch; none where nothing was committed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{schema}, day date, batch string")
    commits = {r["folder"]: r["batch"] for r in spark.read.schema("batch string, folder string").json(str(hadoop.toString())).collect()}
    rows = spark.read.schema(f"{schema}, day date, attempt string").option("basePath", path).json([f"{path}/{folder}" for folder in commits])
    known = spark.createDataFrame([(folder.removeprefix("attempt="), batch) for folder, batch in commits.items()], "attempt string, batch string")
    return rows.join(F.broadcast(known), "attempt").drop("attempt")


def snapshot(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """(id, value) or (id): the baseline that a later run is compared with; plain texts aren't part of it."""
    return df.select(key, *([value] if value else [])).distinct()


LOCKFILE = "source string, lockfileVersion int, packages map<string,struct<version:string,dev:boolean,optional:boolean,integrity:string,dependencies:map<string,string>>>"


def lockfile_packages(df: DataFrame) -> DataFrame:
    """(source, path, name, version, ref, integrity, dependencies) of the packages that count: with a version, not dev, not optional.

    A lockfile of version 1 has no package paths; it stops the job rather than giving an empty list.
    """
    ok = df.filter(F.when(F.coalesce(F.col("lockfileVersion") >= 2, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("lockfile version not supported: "), F.col("lockfileVersion").cast("string"))).cast("boolean")))
    rows = ok.select("source", F.explode("packages").alias("path", "p")).filter("path <> '' AND p.version IS NOT NULL AND NOT coalesce(p.dev, false) AND NOT coalesce(p.optional, false)")
    name = F.element_at(F.split("path", "(?:^|/)node_modules/"), -1)
    return rows.select("source", "path", name.alias("name"), "p.version", F.concat(name, F.lit("@"), F.col("p.version")).alias("ref"), "p.integrity", F.coalesce(F.map_keys("p.dependencies"), F.array().cast("array<string>")).alias("dependencies"))


def redact_event(df: DataFrame, hint: str = "hint", unit: str = "work_unit_id", path: str | None = None, duration: str = "duration_ms", counts: Sequence[str] = ()) -> DataFrame:
    """Private columns made safe: hint as its hash, unit ids that aren't plain as opaque hashes, absolute paths redacted,
    durations and counts not below 0."""
    u = F.trim(F.coalesce(F.col(unit), F.lit("")))
    out = {"hint_hash": F.sha2(F.coalesce(F.col(hint), F.lit("")), 256), unit: F.when(u.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"), u).otherwise(F.concat(F.lit("opaque-"), F.left(F.sha2(u, 256), F.lit(32))))}
    d = F.col(duration).try_cast("double")
    out[duration] = F.when(d.isNull() | F.isnan(d) | (d < 0) | (d == float("inf")), 0.0).otherwise(F.round(d, 3))
    for c in counts:
        n = F.col(c).try_cast("double")
        out[c] = F.when((n >= 0) & (n == F.floor(n)), n.cast("long")).otherwise(F.lit(0).cast("long"))
    if path:
        p = F.translate(F.col(path), "\\", "/")
        out[path] = F.when(p.rlike(r"^/|^[A-Za-z]:|\.\./"), "redacted").otherwise(F.nullif(p, F.lit("")))
    return df.withColumns(out).drop(hint)
