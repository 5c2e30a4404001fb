"""Vault keys, two sinks, co-partitioned joins, ranks of large groups, external spans."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veilspark.operators import rehydrate as H
from veilspark.operators import sinks
from veilspark.operators.ranking import with_rank
from veilspark.operators.redact import redact
from veilspark.session import checkpoint_dir
from veilspark.streaming import runner

TEXTS = [(1, "write to ann@example.com now"), (1, "write to bob@example.com now"), (2, "no values"), (3, "call ann@example.com or 212-555-0100"), (4, None)]


def _redacted(spark, rows=TEXTS, **how):
    return redact(spark.createDataFrame(rows, "doc_id long, text string"), **how)


def test_colliding_ids_get_their_own_values(spark, tmp_path):
    """Two documents share the id; the vault key tells them apart, the raw text is gone."""
    r = _redacted(spark)
    assert "text" not in r.columns and "text" in _redacted(spark, keep_text=True).columns
    a, b = str(tmp_path / "sanitized"), str(tmp_path / "vault")
    sinks.write_redacted(r, a, b)
    out = spark.read.parquet(a)
    assert all(len(x.vault_key) == 32 for x in out.where("is_valid").collect())
    got = H.rehydrate_json(H.vault_join(out.where("is_valid"), sinks.read_vault(spark, b)), "sanitized_text", "manifest_json")
    assert sorted((x.doc_id, x.rehydrated_text) for x in got.collect()) == TEXTS
    values = [v for _, t in TEXTS if t for v in re.findall(r"\S+@\S+\.com|\d{3}-\d{3}-\d{4}", t)]
    written = " ".join(str(v) for x in out.collect() for v in x)
    assert values and not any(v in written for v in values)


def test_one_key_with_different_rows_is_refused(spark):
    outputs = spark.createDataFrame([(1, "k", "<A_1>")], "doc_id long, vault_key string, t string")
    same = spark.createDataFrame([(1, "k", "m"), (1, "k", "m")], "doc_id long, vault_key string, manifest_json string")
    assert H.vault_join(outputs, same).collect()[0].manifest_json == "m"
    other = spark.createDataFrame([(1, "k", "m"), (1, "k", "n")], "doc_id long, vault_key string, manifest_json string")
    with pytest.raises(Exception, match="different rows: 1, k"):
        H.vault_join(outputs, other).collect()


def test_null_lists_are_errors_and_odd_entries_are_not_objects(spark):
    cases = [('{"placeholders": null}', H.NOT_A_LIST), ('{"placeholders": {}}', H.NOT_A_LIST), ('{"placeholders": "x"}', H.NOT_A_LIST),
             ('{"placeholders": 3}', H.NOT_A_LIST), ('  {"a": null}', None), ("null", H.NOT_AN_OBJECT), ('\n\t [{"placeholders": []}]', H.NOT_AN_OBJECT),
             ('{"placeholders": [null, 1, "s", [], {"placeholder": "<A_1>", "original": "v"}]}', None), ('"{"', H.NOT_AN_OBJECT)]
    df = spark.createDataFrame([(i, "see <A_1>", m) for i, (m, _) in enumerate(cases)], "id long, text string, m string")
    got = {r.id: (r.rehydrate_error, r.rehydrated_text) for r in H.rehydrate_json(df, "text", "m").collect()}
    assert got == {i: (e, None if e else "see v" if "original" in m else "see <A_1>") for i, (m, e) in enumerate(cases)}
    kind = "array<struct<placeholder:string,original:string,entity_type:string,start:int,end:int>>"
    typed = spark.createDataFrame([("x", (None,)), ("x", ([],)), ("x", None)], f"text string, m struct<placeholders:{kind}>")
    assert [r.rehydrate_error for r in H.rehydrate(typed, "text", "m").collect()] == [H.NOT_A_LIST, None, H.MISSING]


def test_copartitioned_join_has_no_exchange(spark):
    base = f"{checkpoint_dir(spark)}/bucketed"
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("vault_key"))
    sinks.write_bucketed(rows.withColumn("manifest_json", F.lit("{}")), "t_vault", f"{base}/v", 4)
    sinks.write_bucketed(rows.withColumn("t", F.lit("x")), "t_out", f"{base}/o", 4)
    with runner.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        j = H.vault_join(spark.table("t_out"), spark.table("t_vault"))
        assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString()
        assert j.where("manifest_json = '{}'").count() == 1000


def test_a_failed_second_write_is_made_good(spark, tmp_path):
    """The first attempt dies between the two sinks; the repeated batch leaves each row once."""
    path = runner.write_arrivals(spark, [spark.createDataFrame(TEXTS[:2], "doc_id long, text string"), spark.createDataFrame(TEXTS[2:4], "doc_id long, text string")], "docs")
    src = runner.file_stream(spark, path, spark.createDataFrame([], "doc_id long, text string").schema)
    a, b = str(tmp_path / "sanitized"), str(tmp_path / "vault")
    whole, failed = sinks.two_sinks(a, b), []

    def write(batch, batch_id):
        if batch_id == 1 and not failed:
            failed.append(1)
            batch.select("doc_id", "vault_key", "is_valid", "error", "sanitized_text", F.to_json("manifest").alias("manifest_json")) \
                .write.mode("overwrite").parquet(f"{b}/batch_id=1")
            raise RuntimeError("lost between the sinks")
        whole(batch, batch_id)

    stream = redact(src)
    with pytest.raises(Exception, match="lost between"):
        runner.run_batches(stream, write, str(tmp_path / "chk"))
    runner.run_batches(redact(src), write, str(tmp_path / "chk"))
    out, vault = spark.read.parquet(a), spark.read.parquet(b)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in vault.collect()) == [1, 1, 2, 3]
    assert "manifest_json" not in out.columns


def test_ranks_of_a_group_over_many_tasks(spark):
    rnd = random.Random(3)
    rows = [(1 if k % 2 else rnd.randint(2, 40), rnd.choice(["a", "b", None]), rnd.random(), k) for k in range(4000)] + [(None, "a", 0.5, 5000 + k) for k in range(30)]
    df = spark.createDataFrame(rows, "g int, t string, o double, k int")
    got = {r.k: r.n for r in with_rank(df, ["g", "t"], ["o", "k"], "n").collect()}
    w = Window.partitionBy("g", "t").orderBy("o", "k")
    assert got == {r.k: r.n for r in df.withColumn("n", F.row_number().over(w)).collect()}
    assert with_rank(df, ["g", "t"], ["o", "k"], "n").columns == [*df.columns, "n"]
    assert with_rank(df.limit(0), ["g"], ["o"]).count() == 0
