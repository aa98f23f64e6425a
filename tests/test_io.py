import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillmark.operators import cohort, logs
from quillmark.sources import io
from quillmark.streaming import outcomes

SCHEMA = StructType([StructField("k", IntegerType()), StructField("t", StringType())])


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q"\nb'), (2, "ü,ö"), (3, None)], SCHEMA)
    io.write_csv(rows, f"{tmp_path}/c", ["k", "t"])
    assert io.same_rows(io.read_csv(spark, f"{tmp_path}/c", SCHEMA).where("k < 3"), rows.where("k < 3"))


def test_jsonl(spark, tmp_path):
    assert io.read_jsonl(spark, f"{tmp_path}/none", SCHEMA).count() == 0
    (tmp_path / "x.jsonl").write_text('{"k": 1, "t": "a"}\nbroken\n')
    out = io.read_jsonl(spark, f"{tmp_path}/x.jsonl", SCHEMA, corrupt="bad").collect()
    assert [r.bad for r in out] == [None, "broken"]


def test_freeze(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], SCHEMA)
    io.freeze(rows, f"{tmp_path}/f")
    io.freeze(rows, f"{tmp_path}/f")
    with pytest.raises(ValueError):
        io.freeze(rows.withColumn("t", F.lit("b")), f"{tmp_path}/f")


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿x\r\ny".encode())
    manifest = spark.createDataFrame([("a.txt", "0" * 64), ("b.txt", "1" * 64)], "name string, sha256 string")
    out = {r.name: r for r in io.read_texts(spark, str(tmp_path), manifest).collect()}
    assert out["a.txt"].problem == "hash_mismatch" and out["a.txt"].text == "x\ny" and out["b.txt"].problem == "missing"


def test_digest_ignores_order(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)], SCHEMA)
    assert io.table_digest(rows).first() == io.table_digest(rows.orderBy(F.desc("k"))).first()
    assert io.table_digest(rows).first() != io.table_digest(rows.where("k > 0")).first()


def test_logs(spark):
    log = spark.createDataFrame([("r", 1, "fail"), ("r", 2, "pass"), ("r", 3, "pass"), ("q", 1, "fail")], "id string, n int, s string")
    assert sorted((r.id, r.n) for r in logs.first_per_key(log, ["id"], ["n"]).collect()) == [("q", 1), ("r", 1)]
    assert sorted((r.id, r.n) for r in logs.until_first(log, ["id"], ["n"], F.col("s") == "pass").collect()) == [("q", 1), ("r", 1), ("r", 2)]
    merged, conflicts = logs.merge_logs(log, log.where("n = 1").withColumn("s", F.lit("late")), ["id", "n"])
    assert merged.count() == 6 and sorted(r.id for r in conflicts.collect()) == ["q", "r"]


def test_no_work_crosses_folds(spark, sf_dir):
    works = io.table(spark, sf_dir, "documents").select("lang", F.concat_ws("/", "lang", "source").alias("work")).distinct()
    folds = cohort.folds_by_work(works, "lang", "work")
    assert cohort.crossing_groups(folds, ["work"]).isEmpty()
    assert {r.fold for r in folds.select("fold").distinct().collect()} == {0, 1, 2}


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    events = io.table(spark, sf_dir, "events")
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = outcomes.read_outcomes(spark, f"{tmp_path}/in", events.schema)
    outcomes.run_available(outcomes.first_outcomes(stream, "user_id", "ts", "60 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("user_id").distinct().count() == events.select("user_id").distinct().count()


def test_a_sorted_digest_sorts_nothing_in_its_one_task(spark):
    from hashlib import sha256

    from quillmark.sources.io import sorted_digest

    values = [f"{i * 7919 % 1000}:é{i}" for i in range(1000)]
    made = sorted_digest(spark.createDataFrame([(v,) for v in [*values, None]], "h string"), "h")
    assert made.first().digest == sha256("\n".join(sorted(values)).encode()).hexdigest()
    assert "Sort" not in made._jdf.queryExecution().toString()
    assert sorted_digest(spark.createDataFrame([(None,)], "h string"), "h").first().digest is None
