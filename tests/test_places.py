"""Places of lines, and objects of array files cut into many ranges."""

from __future__ import annotations

import json
import os
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from evalspark.sources import places, readers

JOB_ERRORS = (PySparkException, Py4JJavaError)


@pytest.fixture()
def small_splits(spark):
    """Files are cut every few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


NASTY = ['plain', 'braces { } }} {{', 'quotes \\" and "quoted"', 'ends in backslash \\', '\\\\" }', '[brackets], {"a": "}"}',
         'new\nline', 'tab\t', 'é ünï 漢字 {', '', '}', '{', '"', '\\', '\\u007d']


def _records(n, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        rec = {"instruction": f"{i} " + " ".join(r.choice(NASTY) for _ in range(r.randint(0, 6))),
               "output": r.choice([*NASTY, i, True, 1.5])}
        if i % 3:
            rec["input"] = r.choice(NASTY)
        if i % 5 == 0:
            rec["extra"] = {"nested": [{"deep": "}"}, {}], "x": None}
        out.append(rec)
    return out


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("layout", [{"indent": 2}, {}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": 1}])
def test_array_file_equals_the_multiline_reader(spark, small_splits, tmp_dir, layout):
    records = _records(120)
    path = _write(tmp_dir, "train.json", json.dumps(records, **layout))
    got = readers.read_training_json(spark, path).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(records)))
    whole = spark.read.schema(readers.TRAINING_SCHEMA).option("multiLine", True).json(path).collect()
    assert [(r["instruction"], r["input"], r["output"]) for r in got] == [
        (r["instruction"], r["input"] or "", r["output"]) for r in whole]
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 20


def test_many_array_files_and_empty_ones(spark, small_splits, tmp_dir):
    parts = [_records(7, 1), [], _records(40, 3), _records(1, 4)]
    for i, records in enumerate(parts):
        _write(tmp_dir, f"{i}.json", json.dumps(records) + "\n" * (i % 2))
    got = readers.read_training_json(spark, tmp_dir).orderBy("pos").collect()
    flat = [r for part in parts for r in part]
    assert [r["instruction"] for r in got] == [r["instruction"] for r in flat]
    assert [r["pos"] for r in got] == list(range(len(flat)))


@pytest.mark.parametrize("text", ['[{"instruction": "a", "output": "b"}', '[{"instruction": "a", "output": "b}]',
                                  '[{"instruction": "a", "output": "b"}}]', '[{"instruction": "a"}]',
                                  '[{"instruction": "a", "output": "b"}, 5]', '[7, {"instruction": "a", "output": "b"}]',
                                  '{"instruction": "a", "output": "b"}'])
def test_broken_array_files_fail(spark, tmp_dir, text):
    with pytest.raises(JOB_ERRORS):
        readers.read_training_json(spark, _write(tmp_dir, "bad.json", text)).select("pos").collect()


def test_lines_keep_their_places_over_many_splits(spark, small_splits, tmp_dir):
    lines = [[f"{f}-{i} " + "x" * (i % 37) for i in range(n)] for f, n in enumerate((90, 1, 0, 300))]
    for f, part in enumerate(lines):
        _write(tmp_dir, f"{f}.txt", "".join(x + "\n" for x in part))
    got = readers.lines_with_position(spark, tmp_dir).orderBy("pos").collect()
    assert [(r["pos"], r["line"]) for r in got] == list(enumerate(x for part in lines for x in part))
    plan = readers.lines_with_position(spark, tmp_dir)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "BroadcastHashJoin" in plan
    assert "line" not in "".join(x for x in plan.splitlines() if "ExistingRDD" in x)  # lines aren't checkpointed


def test_zip_over_many_splits(spark, small_splits, tmp_dir):
    n = 200
    rec = _write(tmp_dir, "records.jsonl", "".join(json.dumps({"id": i, "t": "y" * (i % 50)}) + "\n" for i in range(n)))
    lab = _write(tmp_dir, "labels.lst", "".join(f"{i * 7}\n" for i in range(n)))
    got = readers.zip_labels(spark, rec, lab, "id bigint, t string").collect()
    assert sorted((r["pos"], r["id"], r["label"]) for r in got) == [(i, i, str(i * 7)) for i in range(n)]
    short = _write(tmp_dir, "short.lst", "".join(f"{i}\n" for i in range(n - 1)))
    with pytest.raises(JOB_ERRORS):
        readers.zip_labels(spark, rec, short, "id bigint, t string").collect()


def test_samples_with_and_without_places(spark, small_splits, tmp_dir):
    rows = [json.dumps({"id": str(i), "task": "piqa", "instruction": "q", "choices": ["a"], "label": "x"}
                       | ({"pos": 1000 + i} if i % 2 else {})) for i in range(60)]
    _write(tmp_dir, "s.jsonl", "\n\n".join(rows) + "\n")
    got = readers.read_eval_samples(spark, tmp_dir).collect()
    assert {r["id"]: r["pos"] for r in got} == {str(i): 1000 + i if i % 2 else i for i in range(60)}
    first = readers.read_eval_samples(spark, tmp_dir, limit=3).collect()
    assert sorted(r["id"] for r in first) == ["0", "2", "4"]


def test_a_shifted_split_fails(spark, tmp_dir):
    """What a second pass that packs splits otherwise would look like."""
    from pyspark.sql import functions as F
    _write(tmp_dir, "a.txt", "".join(f"{i}\n" for i in range(50)))
    rows = places.scanned(spark.read.text(tmp_dir))
    flip = F.when(F.rand(1) < 2, F.col("_m"))
    good = places.placed(rows)
    assert good.count() == 50
    counts = rows.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = rows.withColumn("_m", flip + 1).join(counts, ["_f", "_b"])
    bad = own.filter(~((F.col("_m") - F.col("_first") >= 0) & (F.col("_m") - F.col("_first") < F.col("_n"))))
    assert bad.count() == 1
