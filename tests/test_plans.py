"""Results kept under a configuration's key, and tool calls of one type, against stated results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import conversion
from tessella.plans import registry


def test_cached_tables_have_sidecars_and_survive_a_half_write(spark, tmp_path):
    df, built = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "x long, dataset_source string"), []

    def build():
        built.append(1)
        return df

    config = {"mixer": {"a": 1.0}, "seed": 3}
    path = tmp_path / registry.config_key(config)
    (path / "data").mkdir(parents=True)
    (path / "data" / "part-00000.parquet").write_bytes(b"half a file")  # a writer that was lost
    for _ in range(2):
        assert registry.cached(build, spark, str(tmp_path), config).count() == 3
    assert built == [1]
    assert json.loads((path / "config.json").read_text()) == config
    assert json.loads((path / "statistics.json").read_text()) == {"columns": ["x", "dataset_source"], "num_rows": 3, "num_rows_by_source": {"a": 2, "b": 1}}
    (path / "statistics.json").unlink()  # lost between the data and the sidecars
    registry.cached(build, spark, str(tmp_path), config)
    assert (path / "statistics.json").exists() and built == [1]


def test_a_failing_build_leaves_nothing_that_counts(spark, tmp_path):
    boom = lambda: spark.range(3).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))
    with pytest.raises(Exception, match="boom"):
        registry.cached(boom, spark, str(tmp_path), {"a": 1})
    assert registry.cached(lambda: spark.range(3), spark, str(tmp_path), {"a": 1}).count() == 3


@pytest.mark.parametrize(
    "given,want",
    [
        ({"a": 1, "b": "x", "c": True, "d": None, "e": 1.5, "f": {"g": [1, "y"]}}, {"a": "1", "b": "x", "c": "True", "d": "None", "e": "1.5", "f": "{'g': [1, 'y']}"}),
        ([1, {"a": None}], '[1, {"a": null}]'),
        ("as is", "as is"),
        (None, "null"),
        ({}, {}),
    ],
)
def test_tool_calls_as_text(spark, given, want):
    rows = [{"role": "user", "content": {"kept": [1]}}, {"role": "assistant", "tool_calls": [{"function": {"name": "é", "arguments": given}}, {"id": 2}]}, {"tool_calls": None}]
    df = spark.createDataFrame([(json.dumps(rows),), ("broken",), (None,), ("[1]",), ("[]",)], "t string")
    got = [r.m for r in df.select(conversion.tool_calls_as_text(F.col("t")).alias("m")).collect()]
    rows[1]["tool_calls"][0]["function"]["arguments"] = want
    assert json.loads(got[0]) == rows and got[1:] == [None, None, None, "[]"]
