"""Sinks, snapshots and session sizing."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from stockflow.sources import documents


def test_tune_for_input_sizes_shuffles(spark):
    from stockflow.session import tune_for_input
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        conf = tune_for_input(spark, 100 * 1024 ** 4, cores=8000)  # 100 TiB
        assert int(conf["spark.sql.shuffle.partitions"]) == 409600
        assert spark.conf.get("spark.sql.shuffle.partitions") == "409600"
        small = tune_for_input(spark, 10 * 1024 ** 2, cores=8)
        assert small["spark.sql.shuffle.partitions"] == "8"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_snapshot_never_writes_credentials(spark, tmp_path):
    users = spark.createDataFrame([(1, "Ann", "ann@example.test", "User", "secret")],
                                  "id long, name string, email string, role string, password string")
    perms = spark.createDataFrame([(1, "Sales", "Full", "Full", "Full", "Limited")],
                                  "user_id long, module string, can_view string, can_create string, "
                                  "can_edit string, can_delete string")
    path = str(tmp_path / "snap")
    documents.write_snapshot(users, perms, path)
    text = "".join(open(os.path.join(folder, f)).read()
                   for folder, _, files in os.walk(path) for f in files if f.endswith(".json"))
    assert "ann@example.test" in text and "secret" not in text and "password" not in text
    u, p = documents.read_snapshot(spark, path)
    assert u.first().email == "ann@example.test" and p.first().can_delete == "Limited"


def test_snapshot_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "snap")
    users = spark.createDataFrame([(1, "Ann", "ann@example.test", "User")], "id long, name string, email string, role string")
    perms = spark.createDataFrame([(1, "Sales")], "user_id long, module string")
    for n in range(4):
        documents.write_snapshot(users.withColumn("id", F.lit(n).cast("long")), perms.withColumn("user_id", F.lit(n).cast("long")), path)
    u, p = documents.read_snapshot(spark, path)
    assert u.first().id == p.first().user_id == 3
    broken = perms.withColumn("user_id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception):  # fails after the users are written
        documents.write_snapshot(users.withColumn("id", F.lit(9).cast("long")), broken, path)
    u, p = documents.read_snapshot(spark, path)
    assert u.first().id == p.first().user_id == 3
    documents.write_snapshot(users, perms, path)
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == 2
    with pytest.raises(FileNotFoundError):
        documents.read_snapshot(spark, str(tmp_path / "none"))


def test_stored_tables_are_released(spark):
    from stockflow.stored import release, store
    release(spark)
    kept = store(spark.range(5), "five")
    file = kept.inputFiles()[0].replace("file://", "")
    assert kept.count() == 5 and os.path.exists(file)
    assert release(spark) == 1 and release(spark) == 0 and not os.path.exists(file)


def test_summary_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id long, note string")
    path = str(tmp_path / "docs")
    documents.write_summary_json(df, path)
    lines = [ln for f in sorted(os.listdir(path)) if f.endswith(".json")
             for ln in open(os.path.join(path, f)).read().splitlines() if ln.strip()]
    assert [json.loads(ln) for ln in lines] == [{"id": 1, "note": None}]
