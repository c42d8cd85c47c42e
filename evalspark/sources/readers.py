"""Readers (A1-A8). Every reader takes an explicit schema where the shape is
known, so no inference pass runs over the data."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import constants as K
from evalspark.functions.text import as_text
from evalspark.operators.common import require
from evalspark.operators.configs import PRESET_FOLDERS, PRESET_SCHEMAS, Presets
from evalspark.session import cut_lineage
from evalspark.sources.places import array_objects, placed, scanned

TRAINING_SCHEMA = "instruction string, input string, output string"
SAMPLE_SCHEMA = ("id string, task string, instruction string, choices array<string>, "
                 "label string, pos bigint")


def read_training_json(spark: SparkSession, path: str) -> DataFrame:
    """A1: JSON *array* file(s) -> (pos, instruction, input, output).

    ``pos`` is the place over all files in path order. Extra keys are dropped
    by the schema; scalars arrive as strings; ``input`` defaults to ''. A row
    without ``instruction`` or ``output`` fails the job, whichever columns are
    used. A big array file is read by many tasks (``places.array_objects``).
    """
    raw = array_objects(spark, path).select(
        "pos", F.from_json("json", TRAINING_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("pos", "r.*")
    for c in ("instruction", "output"):
        raw = require(raw, F.col(c).isNotNull(), f"training row: required field '{c}' is missing")
    return raw.select("pos", "instruction", F.coalesce(F.col("input"), F.lit("")).alias("input"), "output")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType,
               mode: str = "FAILFAST") -> DataFrame:
    """A2: one JSON object per line; blank lines are skipped, a bad line fails."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_eval_samples(spark: SparkSession, path: str, limit: int | None = None,
                      tasks: Sequence[str] | None = None) -> DataFrame:
    """A3: normalised sample JSONL -> EvalSample (all fields as text), then a
    per-task head limit in source order.

    A record without ``pos`` has its line's place in its file (blank lines
    don't count); one with it keeps it. ``tasks`` keeps those tasks; where the
    folder has one part per task, only their files are read.
    """
    from evalspark.operators.normalize import head_limit

    lines = spark.read.text(path)
    if tasks is not None and "_part" in lines.columns:
        lines = lines.filter(F.col("_part").isin(*tasks))
    lines = placed(scanned(lines.filter(F.trim("value") != "")), per_file=True, out="_line")
    raw = lines.select("_line", F.from_json("value", SAMPLE_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select(
        "r.*", "_line")
    if tasks is not None:
        raw = raw.filter(F.col("task").isin(*tasks))
    samples = raw.select(
        "id", "task", "instruction",
        F.transform(F.col("choices"), lambda c: as_text(c)).alias("choices"),
        "label", F.coalesce("pos", "_line").alias("pos"))
    return head_limit(samples, limit)


def lines_with_position(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their exact 0-based position across the file(s) in
    path order: (pos BIGINT, line STRING).

    Every row knows its file and split and rows of a split come in file order,
    so a line's place is the lines of the splits before plus its own number in
    its split: only a count per split is summed, and lines stay where they are
    (``places.placed``).
    """
    return placed(scanned(spark.read.text(path).withColumnRenamed("value", "line"))).select("pos", "line")


def zip_labels(spark: SparkSession, records_path: str, labels_path: str,
               record_schema: str | T.StructType, label_col: str = "label") -> DataFrame:
    """A4: join a JSONL records file and a labels file by line position.

    Unequal lengths are an error (strict zip), as is a record line that does
    not parse: a full outer join on position, with both checked per row.
    """
    recs = lines_with_position(spark, records_path)
    labels = lines_with_position(spark, labels_path).select(
        F.col("pos").alias("_lpos"), F.col("line").alias("_label"))
    joined = require(recs.join(labels, recs["pos"] == labels["_lpos"], "full_outer"),
                     F.col("pos").isNotNull() & F.col("_lpos").isNotNull(),
                     "records and labels differ in length")
    # FAILFAST raises on a line that does not parse; the check keeps the parse
    # in every plan, whichever columns are used.
    parsed = require(joined.withColumn("_r", F.from_json("line", record_schema, {"mode": "FAILFAST"})),
                     F.col("_r").isNotNull() | F.col("_lpos").isNull(), "a record line holds no object")
    return parsed.select("pos", "_r.*", F.col("_label").alias(label_col))


def _run_dir_of(path_col):
    """Name of the folder holding a file; a ``key=value`` folder gives value."""
    folder = F.regexp_extract(path_col, r"([^/]+)/[^/]+$", 1)
    return F.regexp_replace(folder, r"^[^=]*=", "")


def _json_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame | None:
    """``run_dir`` and whole text of every file that matches; None for none."""
    try:
        text = spark.read.text(f"{root.rstrip('/')}/{pattern}", wholetext=True)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err) or "Path does not exist" in str(err):
            return None
        raise
    rows = text.select(_run_dir_of(F.col("_metadata.file_path")).alias("run_dir"), F.col("value").alias("text"))
    return rows.filter(F.trim("text") != "")


def _union_schema(texts: DataFrame, strict: bool) -> T.StructType | None:
    """The union of all keys of JSON objects, from one aggregate over their
    parsed forms. Numbers with a point are doubles; a key that is only ever
    null, or of types that don't agree, is text."""
    parse = F.parse_json if strict else F.try_parse_json
    told = texts.agg(F.schema_of_variant_agg(parse("text"))).first()[0]
    if not told.startswith("OBJECT<"):
        return None
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)|FLOAT", "DOUBLE", told.replace("OBJECT<", "STRUCT<"))
    return T.DataType.fromDDL(re.sub(r"\b(VOID|VARIANT)\b(?=[,>])", "STRING", ddl))


def _scan_json_files(spark: SparkSession, root: str, pattern: str, strict: bool) -> DataFrame | None:
    """Objects of JSON files, one a file, as columns of all keys. Files are
    read once: their texts (one per run) are kept in the checkpoint folder,
    and both the keys and the values come from there."""
    texts = _json_texts(spark, root, pattern)
    if texts is None:
        return None
    texts = cut_lineage(texts)
    schema = _union_schema(texts, strict)
    if schema is None or not schema.fields:
        return None
    if not strict:
        texts = texts.filter(F.try_parse_json("text").isNotNull())
    return texts.select("run_dir", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("_r")).select(
        *[F.col("_r").getField(f.name).alias(f.name) for f in schema.fields], "run_dir")


# A run's metrics: one named file, or the part that ``write_metrics_json`` wrote.
METRICS_FILES = "{*/metrics.json,_run=*/part-*.json}"


def read_run_metrics(spark: SparkSession, root: str, pattern: str = METRICS_FILES,
                     strict: bool = True) -> DataFrame | None:
    """A5: every run's metrics file under ``root``; the schema is the union of
    all keys. ``strict`` fails on a malformed file, otherwise such files are
    skipped. None when nothing matches."""
    return _scan_json_files(spark, root, pattern, strict)


def read_run_metadata(spark: SparkSession, root: str,
                      pattern: str = "*/run.metadata.json") -> DataFrame | None:
    """Optional per-run metadata files, keyed by run folder."""
    return _scan_json_files(spark, root, pattern, True)


SPEC_SCHEMA = T.StructType([
    T.StructField("experiment_name", T.StringType()),
    T.StructField("model", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("model_id", T.StringType()),
        T.StructField("learning_rate", T.DoubleType()), T.StructField("cutoff_len", T.LongType()),
        T.StructField("trust_remote_code", T.BooleanType())])),
    T.StructField("adapter", T.StructType([
        T.StructField("method", T.StringType()), T.StructField("scope", T.StringType()),
        T.StructField("rank", T.LongType()), T.StructField("alpha", T.LongType()),
        T.StructField("dropout", T.DoubleType()),
        T.StructField("target_modules", T.ArrayType(T.StringType()))])),
    T.StructField("runtime", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("per_device_batch_size", T.LongType()),
        T.StructField("effective_batch_size", T.LongType()),
        T.StructField("gradient_checkpointing", T.BooleanType()),
        T.StructField("use_4bit", T.BooleanType()),
        T.StructField("bnb_4bit_quant_type", T.StringType()),
        T.StructField("bnb_4bit_compute_dtype", T.StringType()),
        T.StructField("bnb_4bit_use_double_quant", T.BooleanType())])),
    T.StructField("train_data_path", T.StringType()),
    T.StructField("task_names", T.ArrayType(T.StringType())),
    T.StructField("max_train_samples", T.LongType()),
    T.StructField("val_set_size", T.LongType()),
    T.StructField("num_epochs", T.LongType()),
    T.StructField("save_steps", T.LongType()),
    T.StructField("eval_steps", T.LongType()),
    T.StructField("weight_decay", T.DoubleType()),
    T.StructField("train_on_inputs", T.BooleanType()),
    T.StructField("seed", T.LongType()),
    T.StructField("max_new_tokens", T.LongType()),
])


REQUIRED_SPEC_KEYS = (
    "experiment_name", "task_names", "model.name", "model.model_id", "model.learning_rate",
    "adapter.method", "adapter.scope", "runtime.name", "runtime.per_device_batch_size",
    "runtime.effective_batch_size", "runtime.gradient_checkpointing")


def _toml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({
            "path": pdf["path"],
            "json": [json.dumps(tomllib.loads(text)) for text in pdf["value"]],
        })


def read_run_specs(spark: SparkSession, root: str,
                   pattern: str = "*/config.snapshot.toml") -> DataFrame:
    """One spec row per run snapshot, absent keys filled with defaults. A
    snapshot without a key that has no default fails the job, as does a value
    of another type.

    Each snapshot is read whole (``wholetext`` must be passed as the
    parameter, the option alone is overridden), parsed to JSON text in an
    Arrow batch, then typed by ``from_json``.
    """
    text = spark.read.text(f"{root.rstrip('/')}/{pattern}", wholetext=True)
    text = text.select("value", F.col("_metadata.file_path").alias("path"))
    parsed = text.mapInPandas(_toml_to_json, "path string, json string")
    spec = parsed.select(_run_dir_of(F.col("path")).alias("run_dir"),
                         F.from_json("json", SPEC_SCHEMA, {"mode": "FAILFAST"}).alias("s"))
    for key in REQUIRED_SPEC_KEYS:
        spec = require(spec, F.col(f"s.{key}").isNotNull(),
                       F.concat(F.lit(f"snapshot lacks {key}: "), F.col("run_dir")))
    d = K.SPEC_DEFAULTS

    def dflt(c, key):
        return F.coalesce(c, F.lit(d[key]))

    return spec.select(
        "run_dir",
        F.col("s.experiment_name").alias("experiment_name"),
        F.col("s.model.name").alias("model_name"),
        F.col("s.model.model_id").alias("model_id"),
        F.col("s.model.learning_rate").alias("learning_rate"),
        dflt(F.col("s.model.cutoff_len"), "cutoff_len").alias("cutoff_len"),
        dflt(F.col("s.model.trust_remote_code"), "trust_remote_code").alias("trust_remote_code"),
        F.col("s.adapter.method").alias("method"),
        F.col("s.adapter.scope").alias("scope"),
        dflt(F.col("s.adapter.rank"), "rank").alias("rank"),
        dflt(F.col("s.adapter.alpha"), "alpha").alias("alpha"),
        dflt(F.col("s.adapter.dropout"), "dropout").alias("dropout"),
        F.col("s.runtime.name").alias("runtime"),
        F.col("s.runtime.per_device_batch_size").alias("per_device_batch_size"),
        F.col("s.runtime.effective_batch_size").alias("effective_batch_size"),
        F.col("s.runtime.gradient_checkpointing").alias("gradient_checkpointing"),
        dflt(F.col("s.runtime.use_4bit"), "use_4bit").alias("use_4bit"),
        dflt(F.col("s.runtime.bnb_4bit_quant_type"), "bnb_4bit_quant_type").alias(
            "bnb_4bit_quant_type"),
        dflt(F.col("s.runtime.bnb_4bit_compute_dtype"), "bnb_4bit_compute_dtype").alias(
            "bnb_4bit_compute_dtype"),
        dflt(F.col("s.runtime.bnb_4bit_use_double_quant"), "bnb_4bit_use_double_quant").alias(
            "bnb_4bit_use_double_quant"),
        F.col("s.train_data_path").alias("train_data_path"),
        F.col("s.task_names").alias("task_names"),
        F.col("s.max_train_samples").alias("max_train_samples"),
        dflt(F.col("s.val_set_size"), "val_set_size").alias("val_set_size"),
        dflt(F.col("s.num_epochs"), "num_epochs").alias("num_epochs"),
        dflt(F.col("s.save_steps"), "save_steps").alias("save_steps"),
        dflt(F.col("s.eval_steps"), "eval_steps").alias("eval_steps"),
        dflt(F.col("s.weight_decay"), "weight_decay").alias("weight_decay"),
        dflt(F.col("s.train_on_inputs"), "train_on_inputs").alias("train_on_inputs"),
        dflt(F.col("s.seed"), "seed").alias("seed"),
        dflt(F.col("s.max_new_tokens"), "max_new_tokens").alias("max_new_tokens"),
    )


def read_presets(spark: SparkSession, root: str, pattern: str = "*.toml") -> Presets:
    """I1's preset tables from folders of TOML files: ``experiments``,
    ``models`` and ``runtime`` under ``root``, one file a preset. A file's name
    without ending (or, for a part file, its folder) names the preset. A folder
    without files is an empty table; a value of another type fails the job."""
    tables = {}
    for kind, folder in PRESET_FOLDERS.items():
        schema = T.StructType.fromDDL(PRESET_SCHEMAS[kind])
        try:
            text = spark.read.text(f"{root.rstrip('/')}/{folder}/{pattern}", wholetext=True)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            tables[kind] = spark.createDataFrame([], "name string, " + PRESET_SCHEMAS[kind])
            continue
        path = F.col("_metadata.file_path")
        parsed = text.select("value", path.alias("path")).mapInPandas(_toml_to_json, "path string, json string")
        stem = F.regexp_extract("path", r"([^/]+)\.toml$", 1)
        name = F.when(stem != "", stem).otherwise(_run_dir_of(F.col("path")))
        tables[kind] = cut_lineage(parsed.select(name.alias("name"), F.from_json("json", schema, {"mode": "FAILFAST"}).alias("p"))
                                   .select("name", "p.*"))
    return Presets(**tables)


def read_results_csv(spark: SparkSession, path: str,
                     schema: str | T.StructType | None = None) -> DataFrame:
    """Headered CSV. Give a schema in production; without one numerics are
    inferred (an extra pass)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)
