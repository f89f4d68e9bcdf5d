import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest

from ledgerlark.functions import features
from ledgerlark.operators import forest, graph, quality, reconcile, stats
from ledgerlark.plans import batch, registry, runs
from ledgerlark.schema import InvalidData, LeakError, clip
from ledgerlark.sources import sample, transfers
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    """(sender, receiver, time, amount, status)"""
    return spark.createDataFrame([(f"RC240101.{k}", s, r, t, a, st, "RC", 100.0, 50.0, 10.0, 20.0, k) for k, (s, r, t, a, st) in enumerate(rows)], "TRANSFER_ID string, SENDER_USER_ID string, RECEIVER_USER_ID string, CREATED_ON timestamp_ntz, TRANSACTION_AMOUNT double, TRANSFER_STATUS string, SERVICE_TYPE string, SENDER_PRE_BAL double, SENDER_POST_BAL double, RECEIVER_PRE_BAL double, RECEIVER_POST_BAL double, _row_id long")


def test_velocity_counts_ties_by_position_and_keeps_the_left_bound(spark):
    week, us = dt.timedelta(days=7), dt.timedelta(microseconds=1)
    df = frame(spark, [("a", "x", T0, 1.0, "TS"), ("a", "x", T0, 2.0, "TS"), ("b", "x", T0, 1.0, "TS"), ("b", "x", T0 + week, 1.0, "TS"), ("c", "x", T0, 1.0, "TS"), ("c", "x", T0 + week + us, 1.0, "TS")])
    got = {r["_row_id"]: r["f_velocite_7j"] for r in features.behaviour(df).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 2, 4: 1, 5: 1}


def test_unknown_senders_are_neutral_and_null_receivers_count_once(spark):
    df = frame(spark, [(None, "x", T0, 5.0, "TF"), ("nan", "y", T0, 6.0, "TS"), ("", "y", T0, 6.0, "TS"), ("a", None, T0, 1.0, "TF"), ("a", None, T0 + dt.timedelta(1), None, "TS")])
    got = {r["_row_id"]: r for r in features.behaviour(df).collect()}
    assert [got[k]["f_nb_dest_cumul"] for k in range(5)] == [1, 1, 1, 1, 1]
    assert got[0]["SENDER_USER_ID"] == "__UNKNOWN__" and got[0]["f_log_velocite_7j"] == 0
    assert got[4]["f_taux_echec_hist"] == 1.0 and got[4]["f_montant_7j"] == 1.0


def test_row_features_of_nulls(spark):
    df = frame(spark, [("a", "x", T0, None, None)]).withColumn("SERVICE_TYPE", F.lit(None).cast("string"))
    r = features.transactional(df).first()
    assert r["f_log_montant"] is None and r["f_montant_arrondi"] == 0


def test_clip_and_percent_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "x double")
    got = sorted((r["x"], r["r"]) for r in stats.percent_rank(df, "x", "r").collect() if r["x"] is not None)
    assert got == [(1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (4.0, 1.0)]
    assert df.select(clip(F.col("x"), 0, 3)).where("x is null").count() == 1


@pytest.mark.parametrize("small", [10**6, 0])
def test_quantiles_are_exact_both_ways(spark, small):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.lognormal(0, 4, 900), np.full(300, 5.0), [-1e9, 1e12]])
    rows = [(float(v), None if k % 7 == 0 else float(k % 50), "ab"[k % 2]) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    steps = [0, 0.01, 0.25, 0.5, 0.9, 0.99, 1]
    got = stats.exact_quantiles(df, ["x", "y"], steps, "g", small)
    for g in "ab":
        for k, c in enumerate(("x", "y")):
            want = np.quantile([r[k] for r in rows if r[2] == g and r[k] is not None], steps)
            assert got[g][c] == pytest.approx(want.tolist(), rel=1e-12)
    assert stats.exact_quantiles(df.limit(0), ["x"], steps, small=small) == {} and stats.quantile(df.limit(0), "x", 0.5) is None
    assert stats.exact_quantiles(df.select(F.lit(None).cast("double").alias("x")), ["x"], steps, small=small) == {None: {"x": None}}


def test_top_per_group_with_one_large_group(spark):
    df = spark.createDataFrame([(k, "a" if k % 10 else "b", float(k % 37) if k % 5 else None) for k in range(2000)], "id int, g string, s double")
    got = {r["id"] for r in stats.top_per_group(df, "g", "s", 25, "id").where("ALERTE = 1").collect()}
    rows = df.collect()
    want = set()
    for g in "ab":
        want |= {r["id"] for r in sorted([r for r in rows if r["g"] == g and r["s"] is not None], key=lambda r: (-r["s"], r["id"]))[:25]}
    assert got == want and stats.top_per_group(df, "g", "s", 25, "id").count() == 2000


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50])
def test_top_per_group_of_equal_rows(spark, n):
    rows = [("a", 1.0, 7)] * 3 + [("a", 2.0, 8)] * 2 + [("a", 0.5, 9)] * 40 + [("b", 1.0, 7)] * 2 + [("b", None, 1), (None, 1.0, 2), ("c", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, s double, t long")
    got = stats.top_per_group(df, "g", "s", n, "t")
    assert got.columns == ["g", "s", "t", "ALERTE"] and sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, rows))
    flagged = sorted(tuple(r)[:3] for r in got.where("ALERTE = 1").collect())
    want = ([("a", 2.0, 8)] * 2 + [("a", 1.0, 7)] * 3 + [("a", 0.5, 9)] * 40)[:n] + [("b", 1.0, 7)] * min(n, 2)
    assert flagged == sorted(want)


@pytest.mark.parametrize("chunk", [7, 60])
def test_large_accounts_equal_windows(spark, chunk):
    rng = np.random.default_rng(0)
    at = lambda: T0 + dt.timedelta(hours=int(rng.integers(0, 600)))  # noqa: E731  many ties
    rows = [("a" if rng.random() < 0.8 else None if rng.random() < 0.1 else f"s{rng.integers(3)}", rng.choice(["x", "y", "z", None]), at(), None if rng.random() < 0.1 else float(rng.integers(1, 9)) * 1000, rng.choice(["TS", "TF"])) for _ in range(400)]
    df = frame(spark, rows)
    df = df.unionByName(df.where("_row_id < 20"))  # repeated rows
    for f in (features.behaviour, features.behaviour_training):
        want, got = ([sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in f(df, chunk=c).collect()) for c in (10**9, chunk)])
        assert want == got


def test_chunks_have_like_sizes(spark):
    from ledgerlark.functions import scans

    df = frame(spark, [("a", f"r{k % 50}", T0 + dt.timedelta(minutes=k), 1.0, "TS") for k in range(5000)])
    few = scans.large(df, "SENDER_USER_ID", 100)
    r = scans.scanned(df, few, "SENDER_USER_ID", "CREATED_ON", "_row_id", "TRANSACTION_AMOUNT", "RECEIVER_USER_ID", F.lit(False), 100)
    assert [x["_r_n"] for x in r.orderBy("_row_id").collect()] == list(range(1, 5001))
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_a" in plan and "_chunk" in plan


def test_percent_rank_of_common_values(spark, monkeypatch):
    monkeypatch.setattr(stats, "HEAVY", 5)
    rows = [(k, 1.0 if k % 2 else float(k % 37) if k % 5 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, v double")
    values = sorted(v for _, v in rows if v is not None)
    got = {r["k"]: r["p"] for r in stats.percent_rank(df, "v", "p").collect()}
    for k, v in rows:
        want = None if v is None else (np.searchsorted(values, v) + np.searchsorted(values, v, "right") + 1) / 2 / len(values)
        assert got[k] == want or got[k] == pytest.approx(want)


def test_average_precision_and_describe(spark):
    rng = np.random.default_rng(7)
    s, y = rng.integers(0, 40, 500) / 4.0, rng.random(500) < 0.2
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    want, seen = 0.0, 0
    for t in sorted(set(s), reverse=True):
        tp = (y & (s >= t)).sum()
        want += tp / (s >= t).sum() * (tp - seen) / y.sum()
        seen = tp
    assert stats.average_precision(df, "s", "y").first()[0] == pytest.approx(want)
    row = stats.describe(df, ["s"]).first()
    assert (row["count"], row["p50"], row["max"]) == (500, np.median(s), s.max()) and row["std"] == pytest.approx(s.std(ddof=1))


def test_forest_beside_the_rule_of_deviations(spark):
    from ledgerlark.operators import commissions

    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(60)]
    rng = np.random.default_rng(5)
    rows = [(d, "RC", 100, 1e5, 0.0, 0.0, 0.01 + 0.0005 * rng.normal(), 0.02 + 0.0005 * rng.normal(), 3 + 0.1 * rng.normal()) for d in days[:-1]] + [(days[-1], "RC", 100, 1e5, 0.0, 0.0, 0.09, 0.2, 30.0)]
    agg = spark.createDataFrame(rows, "jour date, SERVICE_TYPE string, volume long, montant double, comm_paid double, comm_recv double, taux_comm_paid double, taux_comm_recv double, comm_par_tx double")
    got = {r["jour"]: r for r in commissions.fused(agg, commissions.reference(agg), trees=50).collect()}
    assert got[days[-1]]["confiance"] == 2 and got[days[-1]]["RISK_SCORE"] == 100 and len(got) == 60
    assert all(r["ALERTE"] == int(r["confiance"] > 0) and r["confiance"] == r["anomalie_zscore"] + r["anomalie_if"] for r in got.values())


def test_log_has_a_file_for_each_day(tmp_path):
    from ledgerlark.plans import log

    for _ in range(2):
        log.logger("ledgerlark.test", str(tmp_path)).info("one line")
    text = next(tmp_path.glob("*.log")).read_text(encoding="utf-8")
    assert text.count("one line") == 2 and "| INFO | ledgerlark.test |" in text


def test_bad_lines_of_a_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("A|B\n1|2\n3|4|5|6\n7|8\n", encoding="latin-1")
    assert [tuple(r) for r in transfers.read(spark, str(p), bad="drop").orderBy("A").collect()] == [("1", "2"), ("7", "8")]
    kept = {r["A"]: r["_bad"] for r in transfers.read(spark, str(p), bad="_bad").collect()}
    assert kept == {"1": None, "3": "3|4|5|6", "7": None}
    assert transfers.read(spark, str(p), limit=2).count() == 2


def test_levels_and_badges_differ_at_their_edges(spark):
    df = spark.createDataFrame([(70.0,), (85.0,), (95.0,), (101.0,)], "s double")
    assert [r[0] for r in df.select(features.risk_level(F.col("s"))).collect()] == ["Normal", "Modéré", "Élevé", None]
    assert [r[0] for r in df.select(features.badge(F.col("s"))).collect()][:3] == ["MODÉRÉ", "ÉLEVÉ", "CRITIQUE"]


def test_pagerank_sums_to_one_with_dangling_nodes(spark):
    e = spark.createDataFrame([("a", "b", 1, 1.0), ("b", "c", 1, 1.0), ("c", "a", 1, 1.0), ("a", "d", 1, 2.0)], "source string, target string, nb_tx int, montant double")
    got = {r[0]: r[1] for r in graph.pagerank(e).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["d"] > got["b"]
    assert graph.pagerank(e.limit(0)).count() == 0
    unpaid = e.withColumn("montant", F.lit(0.0))
    assert [r[1] for r in graph.pagerank(unpaid).collect()] == pytest.approx([0.25] * 4)


@pytest.mark.parametrize("accounts", [1 << 18, 700])
def test_pagerank_of_parts_equals_plain_rounds(spark, accounts):
    rng = np.random.default_rng(3)
    s, t = rng.integers(0, 2000, 9000), rng.integers(0, 2500, 9000)
    s[:2000], t[:2000] = 7, np.arange(2000)  # an account that pays all others
    e = pd.DataFrame({"source": s, "target": t, "montant": rng.random(9000)}).query("source != target").drop_duplicates(["source", "target"])
    ids, at = np.unique(e[["source", "target"]].to_numpy(), return_inverse=True)
    i, j, w, n = at.reshape(-1, 2)[:, 0], at.reshape(-1, 2)[:, 1], e.montant.to_numpy(), len(ids)
    out = np.bincount(i, w, n)
    r = np.full(n, 1 / n)
    for _ in range(200):
        r = 0.85 * (np.bincount(j, r[i] * w / out[i], n) + r[out <= 0].sum() / n) + 0.15 / n
    got = graph.pagerank(spark.createDataFrame(e), accounts=accounts, block=500).toPandas().sort_values("node")
    assert got.node.tolist() == ids.tolist() and np.abs(got.pagerank.to_numpy() - r).sum() < 1e-8


def plain_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core, label, n = near.sum(1) >= least, np.full(len(x), -1), 0
    for k in range(len(x)):
        if core[k] and label[k] < 0:
            stack = [k]
            while stack:
                p = stack.pop()
                if label[p] < 0:
                    label[p] = n
                    if core[p]:
                        stack += list(np.flatnonzero(near[p] & (label < 0)))
            n += 1
    return label.tolist()


@pytest.mark.parametrize(("d", "eps", "least", "few"), [(3, 0.6, 4, 16), (1, 0.2, 3, 16), (7, 1.5, 5, 16), (2, 0.35, 12, 1)])
def test_dbscan_equals_plain(spark, monkeypatch, d, eps, least, few):
    monkeypatch.setattr(graph, "REPRESENTATIVES", few)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, (120, d)), rng.normal(3, 0.3, (40, d)), rng.uniform(-5, 8, (40, d)), np.repeat(rng.uniform(-5, 8, (1, d)), 9, axis=0)])
    names = [f"v{k}" for k in range(d)]
    schema = ", ".join(f"{c} double" for c in names)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)] + [(900, *[None] * d), (901, *[float("nan")] * d)], f"node int, {schema}")
    got = {r["node"]: r["cluster"] for r in graph.dbscan(df, names, eps, least).collect()}
    assert got.pop(900) == got.pop(901) == -1
    assert [got[k] for k in range(len(x))] == plain_dbscan(x, eps, least)


def test_dbscan_of_one_heap_compares_few_points(spark):
    """50,000 points in two heaps that no core pair links: points of full cells are never compared one by one."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.05, (50_000, 7))
    x[40_000:, 0] += 3
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdefg")).assign(node=range(50_000)))
    seen: dict = {}
    got = graph.dbscan(df, list("abcdefg"), 1.5, 5, seen=seen).groupBy("cluster").count().collect()
    assert sorted(map(tuple, got)) == [(0, 40_000), (1, 10_000)]
    assert seen["compared"] < 500 and seen["apart"] == 0


def test_forest_ranks_an_outlier_above_inliers():
    x = np.random.default_rng(0).normal(size=(400, 3))
    s = forest.scores(forest.fit(x, 60), np.array([[0.0, 0, 0], [9.0, 9, 9]]))
    assert -1 <= s[1] < s[0] <= 0


def test_psi_of_itself_is_zero_and_edges_collapse(spark):
    df = spark.createDataFrame([(float(k % 3),) for k in range(60)], "x double")
    frozen = quality.reference(df, "x")
    assert len(frozen["bins"]) == 3 and quality.psi(df, "x", frozen) == 0
    assert quality.drift(df, {"x": frozen, "_volume": 200})["verdict_global"] == "ALERTE"


def test_validation(spark):
    df = frame(spark, [("a", "x", T0, 1.0, "TS")] * 3)
    assert quality.validate(df)["n_duplicates"] == 0
    with pytest.raises(InvalidData):
        quality.validate(df.drop("SERVICE_TYPE"))
    with pytest.raises(InvalidData):
        quality.validate(df.limit(0))


def test_leak_guard():
    from ledgerlark.operators import failure

    with pytest.raises(LeakError):
        failure.guard(["f_log_montant", "f_has_error"])


def test_reconciliation_is_complete(spark):
    out = reconcile.reconcile(sample.declared(spark, "/root/testdata/sf0.001"), {"RC": "CI"}, 3)
    reconcile.complete(reconcile.summary(out).first().asDict())


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("TRANSFER_ID|CREATED_ON|TRANSACTION_AMOUNT|SENDER_CITY\nRC1|31/12/2024 10:00:00|12.5|nan\nRC2|bad|x|Nosy Bé\n", encoding="latin-1")
    missing = transfers.convert(spark, str(p), str(tmp_path / "y.parquet"))
    rows = {r["TRANSFER_ID"]: r for r in transfers.read(spark, str(tmp_path / "y.parquet")).collect()}
    assert "SERVICE_TYPE" in missing and rows["RC1"]["TRANSACTION_AMOUNT"] == 12.5 and rows["RC1"]["SENDER_CITY"] is None
    assert rows["RC2"]["CREATED_ON"] is None and rows["RC2"]["TRANSACTION_AMOUNT"] is None and rows["RC2"]["SENDER_CITY"] == "Nosy Bé"
    with pytest.raises(InvalidData):
        transfers.read(spark, "x.xls")


def test_registry(tmp_path):
    (tmp_path / "params.json").write_text('{"a": 1}')
    (tmp_path / "params_v2.json").write_text('{"a": 2}')
    root = str(tmp_path / "models")
    one = registry.publish(root, "M4", [str(tmp_path / "params.json"), str(tmp_path / "params_v2.json")])
    two = registry.publish(root, "M4", [str(tmp_path / "params.json")])
    assert one != two and registry.params(registry.folder(root, "M4"))["a"] == 1 and registry.params(registry.folder(root, "M4", one))["a"] == 2
    assert registry.published(root) == ["M4"] and registry.ledger(root, "M4")["latest"] == two
    get = registry.Parameters({"x": 1, "y": None}, {"x": 2, "y": 3})
    assert (get("x", 0), get("y", 0), get("z", 9)) == (1, 3, 9)


def test_batch_runs_all_five_engines(spark, tmp_path):
    df = sample.transfers(spark, "/root/testdata/sf0.01")
    links = sample.declared(spark, "/root/testdata/sf0.01").select("_row_id", "RECONCILIATION_FOR")
    money = F.col("TRANSACTION_AMOUNT")
    df = df.join(links, "_row_id").withColumns({"COMMISSIONS_PAID": money * 0.01, "COMMISSIONS_RECEIVED": money * 0.02})
    from ledgerlark.operators import anomalies, commissions, failure

    f = features.behaviour(features.calendar(features.transactional(df)))
    columns = ["f_log_montant", "f_velocite_7j", "f_rang_tx"]
    model, fill = failure.fit(f, columns, rounds=2, depth=2)
    seg = features.imputed(anomalies.segmented(f), fill)
    models = forest.fit_segments(seg, columns, "SEGMENT", sample=300, trees=10)
    # everything the engines need is published, and comes back from the registry alone
    own, root = tmp_path / "own", str(tmp_path / "models")
    for name in ("m1", "m2", "m4", "m5", "m6"):
        (own / name).mkdir(parents=True)
        (own / name / "params.json").write_text(json.dumps({"FEATURE_COLS": columns, "medians": fill, "budget_alertes_jour": 7, "complementaires": {"RC": "CI"}}))
    registry.freeze_forests(models, str(own / "m1" / "forets.json"))
    registry.freeze_table(commissions.reference(commissions.daily(df)), "SERVICE_TYPE", str(own / "m4" / "stats_par_service.json"))
    (own / "m5" / "gbt.json").write_text(json.dumps(model))
    for engine, name in zip(batch.ENGINES, ("m1", "m2", "m4", "m5", "m6"), strict=True):
        registry.publish(root, registry.FOLDERS[engine], [str(p) for p in (own / name).iterdir()])
    refs = str(tmp_path / "drift.json")
    quality.save_references(df, ["TRANSACTION_AMOUNT"], refs)
    report = batch.execute(df, root, str(tmp_path), references=refs, config={"m1_fraude": {"budget_alertes_jour": 5}}, row_id="_row_id", run_id="r1")
    assert report["modeles_ok"] == sorted(batch.ENGINES), report["erreurs"]
    assert report["drift"]["verdict_global"] == "stable"
    total, rows = runs.alerts(spark, str(tmp_path), "r1", "m1_fraude", "TRANSFER_ID", 10)
    assert total == 5 * 30 and rows.count() == 10
    assert runs.history(spark, str(tmp_path)).count() == 1 and runs.running(str(tmp_path)) == []
    assert runs.drift(str(tmp_path), "r1")["verdict_global"] == "stable"
    assert runs.alerts_by_run(spark, str(tmp_path)).first()["total"] == sum(m["n_alertes"] for m in report["modeles"].values())
    text = next((tmp_path / "runs/r1/m1_fraude/alertes_csv").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("\ufeffTRANSFER_ID,") and text.count("\n") == 151
    assert report["modeles"]["m1_fraude"]["pct_alertes"] == round(150 / df.count() * 100, 4) and report["modeles"]["m1_fraude"]["budget_jour"] == 5 and sum(report["modeles"]["m1_fraude"]["segments"].values()) == df.count()
    assert report["modeles"]["m5_echec"]["seuil"] == 0.8 and 0 < report["modeles"]["m5_echec"]["proba_moyenne"] < 1 and report["modeles"]["m4_commissions"]["services_inconnus"] == []
    assert json.loads((tmp_path / "runs/r1/m6_reconciliation/stats.json").read_text())["n_a_reconcilier"] > 0 and list((tmp_path / "logs").glob("*.log"))
    # a frozen parameter goes before the default, and the configuration before both
    frozen = batch.execute(df, root, str(tmp_path), ["M1_fraude"], row_id="_row_id", run_id="r2")
    assert frozen["modeles"]["m1_fraude"]["n_alertes"] == 7 * 30
    broken = batch.execute(df, {}, str(tmp_path), ["m4_commissions", "m6_reconciliation"], row_id="_row_id", run_id="r3")
    assert broken["modeles_ko"] == ["m4_commissions"] and broken["modeles_ok"] == ["m6_reconciliation"] and "KeyError" in broken["traces"]["m4_commissions"]


def test_boosting_beats_a_plain_score_and_stops_early(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from ledgerlark.operators import failure

    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 4))
    p = 1 / (1 + np.exp(-(2 * np.sign(x[:, 0] * x[:, 1]) + x[:, 2])))
    rows = pd.DataFrame(x, columns=list("abcd")).assign(TRANSFER_STATUS=np.where(rng.random(4000) < p * 0.5, "TF", "TS"), k=range(4000))
    df = spark.createDataFrame(rows).withColumn("c", F.when(F.col("k") > 30, F.col("c")))
    train, test, columns = df.where("k < 2500"), df.where("k >= 2500"), list("abcd")
    label = (F.col("TRANSFER_STATUS") == "TF").cast("int")
    auc = lambda d: stats.roc_auc(d.select("p", label.alias("y")), "p", "y").first()[0]
    model, fill = failure.fit(train, columns, rounds=12, depth=5)
    own = auc(failure.score(test, model, columns, fill).withColumn("p", F.col("proba_echec")))
    ready = VectorAssembler(inputCols=columns, outputCol="x").transform(features.imputed(df, fill).withColumn("y", label.cast("double")))
    m = GBTClassifier(featuresCol="x", labelCol="y", maxIter=12, maxDepth=5, seed=1).fit(ready.where("k < 2500"))
    theirs = auc(m.transform(ready.where("k >= 2500")).withColumn("p", vector_to_array("probability")[1]))
    assert own > theirs - 0.01 and own > 0.7
    stopped, _ = failure.fit(train, columns, valid=test.withColumn("TRANSFER_STATUS", F.when(F.col("k") % 2 == 0, "TF").otherwise("TS")), rounds=30, patience=2)
    assert len(stopped["trees"]) < 10
    assert failure.score(test.limit(0), model, columns, fill).collect() == []
    json.loads(json.dumps(model))


def test_first_split_equals_all_splits(spark):
    from ledgerlark.operators import boosting

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 2)
    y = (x[:, 1] > 0.3).astype(float) * (rng.random(300) < 0.8)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=y, w=1.0, held=False))
    model = boosting.fit(df, list("abc"), dict.fromkeys("abc", 0.0), "y", "w", "held", rounds=1, depth=1, rate=1.0)
    g, h = y - y.mean(), np.full(300, y.mean() * (1 - y.mean()))
    best = max((sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)), -c, -cut) for c in range(3) for cut in np.unique(boosting.settled(np.percentile(x[:, c], [100 * k / 32 for k in range(1, 32)])))
        if 20 <= (left := x[:, c] <= cut).sum() <= 280)
    ((node, column, cut),) = model["trees"][0]["split"]
    assert (node, column, cut) == (0, -best[1], -best[2])
    left = x[:, column] <= cut
    assert dict(map(tuple, model["trees"][0]["value"])) == pytest.approx({1: g[left].sum() / (h[left].sum() + 1), 2: g[~left].sum() / (h[~left].sum() + 1)})


def test_failing_export_keeps_the_scores(spark, tmp_path, monkeypatch):
    def broken(*_):
        raise OSError("disk")

    monkeypatch.setattr(batch, "write_json", broken)
    df = sample.transfers(spark, "/root/testdata/sf0.001").join(sample.declared(spark, "/root/testdata/sf0.001").select("_row_id", "RECONCILIATION_FOR"), "_row_id")
    report = batch.execute(df, {}, str(tmp_path), ["m6_reconciliation"], row_id="_row_id", run_id="r")
    assert report["modeles_ok"] == ["m6_reconciliation"] and report["erreurs"] == {} and "disk" in report["exports"]["m6_reconciliation"]
    assert spark.read.parquet(str(tmp_path / "runs/r/m6_reconciliation/scores")).count() == report["modeles"]["m6_reconciliation"]["n_auto_fiable"]


def test_permutation_importance_deals_every_value_once(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = pd.DataFrame({"key": [f"k{i}" for i in range(n)], "told": rng.random(n), "idle": rng.random(n), "flat": 1.0})
    x["y"] = (x.told + 0.2 * rng.random(n) > 0.9).astype(int)
    seen = []

    def scored(df):
        seen.append(df)
        return df.withColumn("p", F.col("told") + 0.001 * F.col("idle") + F.col("flat"))

    got = {r["column"]: r for r in stats.permutation_importance(spark.createDataFrame(x), ["told", "idle", "flat"], "y", "key", scored, "p").collect()}
    assert got[None]["importance"] == 0 and got["flat"]["importance"] == 0 and abs(got["idle"]["importance"]) < 0.01
    # values that tell nothing have the share of ones as their precision
    assert got["told"]["pr_auc"] == pytest.approx(x.y.mean(), abs=0.06) and got[None]["pr_auc"] > 0.8
    dealt = seen[0].toPandas()
    assert len(dealt) == 4 * n
    told = dealt[dealt._k == 0].told.to_numpy()
    assert np.allclose(np.sort(told), np.sort(x.told)) and np.allclose(dealt[dealt._k == 1].idle.sort_values(), x.idle.sort_values())
    assert stats.permutation_importance(spark.createDataFrame(x).limit(0), ["told"], "y", "key", lambda d: d.withColumn("p", F.col("told")), "p").count() == 0
    one = stats.permutation_importance(spark.createDataFrame(x.query("y == 1").head(1)), ["told", "idle"], "y", "key", lambda d: d.withColumn("p", F.col("told")), "p").collect()
    assert [r["importance"] for r in one] == [0, 0, 0]


def test_numbered_rows_have_each_place_once(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("v"), "id")
    got = stats.numbered(df, "v", "id", name="at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(5000)) and [(r["v"], r["id"]) for r in got] == sorted((i % 7, i) for i in range(5000))


def test_best_counterpart_equals_a_search_of_the_block(spark):
    rng = np.random.default_rng(8)

    def some(n, first):
        return pd.DataFrame({"TRANSFER_ID": [f"{i}" for i in range(first, first + n)], "bloc": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1]), "prefixe": rng.choice(["TC", "CO", "XX", "RC"], n), "TRANSACTION_AMOUNT": rng.integers(0, 40, n) * 0.5 - 3, "CREATED_ON": [None if rng.random() < 0.1 else T0 + dt.timedelta(hours=int(h)) for h in rng.integers(0, 9, n)], "SENDER_USER_ID": rng.choice(["x", "y", None], n), "RECEIVER_USER_ID": rng.choice(["x", "y"], n), "_row_id": range(first, first + n)})

    kind = "TRANSFER_ID string, bloc string, prefixe string, TRANSACTION_AMOUNT double, CREATED_ON timestamp_ntz, SENDER_USER_ID string, RECEIVER_USER_ID string, _row_id long"
    pool, asked = some(300, 0), some(120, 1000)
    pool = pd.concat([pool, asked.head(20)])  # nothing is its own counterpart
    rows = [[tuple(None if v is None or v is pd.NaT else v for v in r) for r in f.astype(object).itertuples(index=False)] for f in (asked, pool)]
    want = {}
    for i, b, pre, amount, at, s, r, _ in rows[0]:
        found = [c for c in rows[1] if b is not None and c[1] == b and abs(c[3] - amount) < 1 and c[0] != i]
        for score, test in ((1, lambda c: c[2] == {"TC": "CO", "XX": "RC"}.get(pre)), (2, lambda c: None not in (s, c[5]) and (c[5], c[6]) in ((s, r), (r, s)))):
            kept = [c for c in found if test(c)]
            hit = bool(kept) and (score == 1 or len(found) > 1)
            found, want[i] = kept if hit else found, want.get(i, 1) + score * hit
        if found:
            want[i] = (min(found, key=lambda c: (None in (at, c[4]), abs(c[4] - at) if None not in (at, c[4]) else 0, c[7]))[0], want[i])
        else:
            del want[i]
    frames = [spark.createDataFrame([tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in x], kind) for x in rows]
    got = {r["TRANSFER_ID"]: (r["jumeau_propose"], r["score_criteres"]) for r in reconcile.blocked(*frames).collect()}
    assert got == want and len(got) > 60
