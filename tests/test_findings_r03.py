"""The findings of round 3, each with a test that failed before."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from ledgerlark import queries
from ledgerlark.functions import features
from ledgerlark.operators import anomalies, forest, quality, stats
from ledgerlark.plans import batch
from ledgerlark.sources import sample
from ledgerlark.tables import setting
from pyspark.sql import functions as F

from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def test_f1_shares_of_the_report_round_as_sql():
    for auto, total in ((773, 2000), (1061, 4000), (111, 4000), (9, 4000), (0, 0)):
        got = batch._link_figures({}, {"n_scores": auto, "n_alertes": total - auto, "n_manuels": 0}, {}, None)["taux_auto_pct"]
        assert got == duckdb.sql(f"select round({auto}::bigint / greatest({total}::bigint, 1) * 100, 1)").fetchall()[0][0], (auto, total)


def test_f3_constant_columns_over_uneven_parts(spark):
    for rows in (13, 21, 49):  # 60019 / rows * rows is not 60019
        df = spark.range(0, rows * 8, 1, 8).select(F.lit(60019.0).alias("a"), F.lit(0.1).alias("b"), F.col("id").alias("c"), F.lit(None).cast("double").alias("d"), F.lit(float("nan")).alias("e"))
        assert features.constant(df, list("abcde")) == ["a", "b", "d"], rows


def test_f4_histogram_edges_as_sql(spark):
    for bins, frame in ((50, pd.DataFrame({"x": [k * 0.03 for k in range(501)]})), (40, pd.DataFrame({"x": [0.5, None, 7.0]})), (50, pd.DataFrame({"x": [2.5, 2.5]}))):
        want = duckdb.sql(f"with h as (select min(x) as lo, max(x) as hi from frame) select cast(least(floor((x - lo) / ((hi - lo) / {bins})) + 1, {bins}) as int) as bin, count(*) as n from frame, h group by 1").fetchall()
        df = spark.createDataFrame([(None if pd.isna(v) else float(v),) for v in frame["x"]], "x double")
        assert sorted(tuple(r) for r in quality.equal_bins(df, "x", bins).collect()) == sorted(want)


@pytest.fixture(scope="module")
def long_ids(tmp_path_factory):
    """Events whose ids have seven digits, which the ids of transfers cut to six: up to ten share one."""
    at = tmp_path_factory.mktemp("sf")
    duckdb.sql(f"copy (select * replace (event_id + 1000000 as event_id) from '{SF}/events.parquet' union all from '{SF}/events.parquet') to '{at}/events.parquet'")
    for t in ("customer", "nation"):
        duckdb.sql(f"copy (from '{SF}/{t}.parquet') to '{at}/{t}.parquet'")
    return str(at)


def test_f1_counterparts_beyond_the_table_are_declared(spark, tmp_path):
    duckdb.sql(f"copy (select * from '{SF}/events.parquet' where event_id <= 400) to '{tmp_path}/events.parquet'")
    for t in ("customer", "nation"):
        duckdb.sql(f"copy (from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
    assert [r["declares"] for r in queries.QUERIES["batch_report"](spark, str(tmp_path)).collect()] == [17]


def test_f11_to_f13_rows_without_target_stay_where_they_were_read(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    with setting(spark, "spark.sql.adaptive.enabled", "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        parts = sample.declared(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 1000 and max(r["count"] for r in parts) < 500


RECONCILED = ["block_sizes", "linkage_quality", "pair_diagnostics", "prefix_modes", "recon_blocking", "recon_decisions", "recon_stats", "analyst_file", "recon_direct", "recon_orphans", "batch_report"]


@pytest.mark.parametrize("name", RECONCILED)
def test_f2_f5_to_f10_rows_that_share_an_id(spark, long_ids, name):
    assert differences(queries.QUERIES[name](spark, long_ids), connect(long_ids), queries.SQL[name]) == ""


def test_f14_columns_that_no_score_reads_are_not_scored(spark):
    df = spark.createDataFrame([(k, k * 7 % 13 % 3 == 0, k * 7 % 13 + 0.0, k % 5 + 0.0, 1.0) for k in range(300)], "id long, y boolean, a double, b double, c double").withColumn("y", F.col("y").cast("int"))
    seen = {}

    def run(used):
        def scored(x):
            seen[str(used)] = x.count()
            return x.withColumn("s", -F.col("a") % 3 if used != [] else F.lit(0.5))

        return sorted(tuple(r) for r in stats.permutation_importance(df, ["a", "b", "c"], "y", "id", scored, "s", used).select(F.coalesce("column", F.lit("")), F.round("pr_auc", 9), F.round("importance", 9)).collect())

    assert run(["a"]) == run(None) and len({p for _, p, _ in run(["a"])}) == 2
    assert [r[2] for r in run([])] == [0.0] * 4
    assert seen == {"None": 1200, "['a']": 600, "[]": 300}


def _walked(model, x):
    """The forest's scores by a walk of each row through each tree, in plain Python."""
    total = [0.0] * len(x)
    for t in model["trees"]:
        for i, row in enumerate(x):
            k = 0
            while t["feature"][k] >= 0:
                k = t["right"][k] if row[t["feature"][k]] >= t["threshold"][k] else t["left"][k]
            total[i] += t["path"][k]
    return [round(-(2 ** (-s / len(model["trees"]) / max(forest._c(model["size"]), 1e-9))), 9) for s in total]


@pytest.mark.parametrize(("size", "width", "trees"), [(256, 9, 40), (2, 3, 5), (1024, 1, 6), (7, 2, 30)])
def test_f15_scores_of_odd_values_are_those_of_a_walk(size, width, trees):
    r = np.random.default_rng(size)
    x = np.floor(r.random((1500, width)) ** 3 * np.array([1e6, 2, 2, 7, 31, 5, 1e3, 1e5, 3])[:width]) + 0.0
    model = forest.fit(x, trees, size)
    x = x[:300]
    x[::7, 0], x[::11, width - 1], x[::13, 0] = np.nan, np.inf, -np.inf
    assert np.abs(forest.scores(model, x, 128) - np.array(_walked(model, x))).max() <= 1.1e-9
    assert len(forest.scores(model, x[:0])) == 0
    assert len(set(forest.scores(forest.fit(np.ones((50, 2)), 3), x[:, :1].repeat(2, 1)))) == 1


def test_f15_scores_over_several_blocks_keep_their_rows(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = np.round(r.random((4000, 3)), 3)
    models = {s: forest.fit(x, 20, 64, k) for k, s in enumerate("ab")}
    rows = [(k, "abcd"[k % 4] if k % 4 < 3 else None, *map(float, v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, s string, p double, q double, r double").repartition(2)
    monkeypatch.setattr(forest, "BLOCK", 700)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "300"):
        got = {v["id"]: v["iso_score"] for v in forest.score(df, models, ["p", "q", "r"], "s").collect()}
    want = {s: forest.scores(m, x) for s, m in models.items()}
    assert got == {k: float(want[v][k]) if (v := rows[k][1]) in want else 0.0 for k in range(4000)}


def test_f15_accounts_are_counted_where_they_are_sorted(spark):
    df = sample.transfers(spark, SF).withColumn("SENDER_USER_ID", F.when(F.col("_row_id") % 9 > 0, F.col("SENDER_USER_ID"))).withColumn("CREATED_ON", F.when(F.col("_row_id") % 31 > 0, F.col("CREATED_ON")))
    for chunk in (500_000, 70):  # the second scans the larger accounts in chunks
        f = features.behaviour(df, chunk, "volume")
        got = {(v["a"], v["n"]): v["k"] for v in f.groupBy(F.col("SENDER_USER_ID").alias("a"), F.col("volume").alias("n")).agg(F.count("*").alias("k")).collect()}
        assert len(got) == 16 and all(n == k for (_, n), k in got.items())
    plain = anomalies.segmented(features.behaviour(df), (60, 65, 75)).groupBy("SEGMENT").count().collect()
    assert sorted(map(str, plain)) == sorted(map(str, anomalies.segmented(f, (60, 65, 75), "volume").groupBy("SEGMENT").count().collect()))


def test_f15_one_exchange_sorts_accounts_and_their_counterparts(spark):
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        plan = features._windowed(sample.transfers(spark, SF).limit(5).withColumn("_amount", F.lit(1.0)))._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Exchange")]
    assert top.count("Window [") + top.count("RunningWindow") > 3 and "hashpartitioning(SENDER_USER_ID" in plan and ", RECEIVER_USER_ID" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_f15_only_gaps_need_medians_and_only_kept_columns_are_written(spark):
    df = spark.createDataFrame([(1.0, None, None, 2), (3.0, 4.0, None, 2), (7.0, 6.0, None, 2)], "a double, b double, c double, d int")
    assert features.gaps(df, list("abcd")) == ["b", "c"] and features.medians(df, []) == {}
    every = features.medians(df, list("abcd"))
    some = features.medians(df, features.gaps(df, list("abcd")))
    assert features.imputed(df, some).select("a", "b", "c", F.col("d").cast("double")).collect() == features.imputed(df, every).collect()
    f = features.build(sample.transfers(spark, SF))
    f = anomalies.segmented(f, (60, 65, 75))
    columns = ["f_log_montant", "f_velocite_7j", "f_rang_tx"]
    models = forest.fit_segments(f, columns, "SEGMENT", least=1, trees=5)
    whole, few = anomalies.score(f, models, columns, 7), anomalies.score(f, models, columns, 7, keep=["TRANSFER_ID", "SEGMENT"])
    assert few.columns == ["TRANSFER_ID", "SEGMENT", "iso_score", "montant_z_segment", "RISK_SCORE", "ALERTE", "RAISON"]
    assert whole.columns == [*f.columns, *few.columns[2:]]
    z = F.round("montant_z_segment", 9).alias("z")  # its deviation is merged in any order
    assert sorted(map(str, whole.select(few.columns).withColumn("montant_z_segment", z).collect())) == sorted(map(str, few.withColumn("montant_z_segment", z).collect()))
