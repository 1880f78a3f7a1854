"""Queries: metrics over a run's log."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import batch, runlog
from assayer.operators.order import position
from assayer.plans import bundles
from assayer.plans.catalog import query, table
from assayer.plans.q_scoring import RUN, r6, run

WITH = f"""WITH {RUN}, good AS (SELECT *, row_number() OVER (ORDER BY idx) AS pos FROM occ WHERE valid AND rn = 1), allp AS (SELECT *, rn = 1 AS uq, row_number() OVER (ORDER BY idx) AS pos FROM occ)"""
#: Checkpoints over table T with budget B: every 100 rows below both, then one that sees all.
CPS = """, n AS (SELECT count(*) AS n FROM T), c0 AS (SELECT unnest(CASE WHEN least(n, B) > 100 THEN range(100, least(n, B), 100) ELSE [] END) AS cp, 0 AS last FROM n UNION ALL SELECT n, 1 FROM n),
cps AS (SELECT *, coalesce(lag(cp) OVER (ORDER BY last, cp), 0) AS before FROM c0)"""


def occurred(spark, d):
    return batch.first_occurrence(run(spark, d))


@query(f"{WITH} SELECT round(avg(valid::INT), 6) + 0.0 AS valid_ratio, round(sum((valid AND uq)::INT) / sum(valid::INT)::DOUBLE, 6) + 0.0 AS unique_ratio FROM allp")
def valid_unique_ratio(spark, d):
    return runlog.ratios(occurred(spark, d)).select(r6(F.col("valid_ratio"), "valid_ratio"), r6(F.col("unique_ratio"), "unique_ratio"))


@query(f"{WITH} SELECT idx, pos FROM (SELECT * FROM good WHERE pos <= 500)")
def preprocess_log(spark, d):
    return runlog.preprocess(occurred(spark, d), budget=500, oracle_budget=True).select("idx", "pos")


@query(f"""WITH {RUN}, b AS (SELECT *, row_number() OVER (ORDER BY idx) AS p FROM occ) SELECT idx, row_number() OVER (ORDER BY idx) AS pos FROM b WHERE p <= 500 AND valid AND rn = 1""")
def budget_limit(spark, d):
    return runlog.preprocess(occurred(spark, d), budget=500).select("idx", "pos")


@query(f"""{WITH}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC, idx) AS r FROM occ WHERE valid), k(n) AS (VALUES (1), (10), (100))
SELECT CAST(n AS INT) AS n, round(avg(score), 6) + 0.0 AS value FROM r JOIN k ON r.r <= k.n GROUP BY n""")
def top_n_avg(spark, d):
    t = runlog.top_n_avg(occurred(spark, d).where("valid"), "score")
    return t.select(F.col("n").cast("int").alias("n"), r6(F.col("value"), "value"))


def _auc_sql(t, budget, extra="0"):
    return f"""{WITH}, T AS (SELECT score, row_number() OVER (ORDER BY idx) AS pos FROM {t}) {CPS.replace('B)', f'{budget})')},
pre AS (SELECT cp, last, before, score, row_number() OVER (PARTITION BY cp, last ORDER BY score DESC, pos) AS k FROM T JOIN cps ON last = 1 OR pos <= cp), m(n) AS (VALUES (1), (10), (100)),
v AS (SELECT n, cp, last, before, avg(score) AS v FROM pre JOIN m ON k <= n GROUP BY ALL),
a AS (SELECT n, (cp - before) * (v + coalesce(lag(v) OVER (PARTITION BY n ORDER BY last, cp), 0)) / 2 + CASE WHEN last = 1 AND cp < {budget} THEN ({budget} - cp) * v * {extra} ELSE 0 END AS a FROM v)
SELECT CAST(n AS INT) AS n, round(sum(a) / {budget}, 6) + 0.0 AS value FROM a GROUP BY n"""


@query(_auc_sql("(SELECT * FROM occ WHERE valid)", 5000))
def top_n_auc(spark, d):
    s = position(run(spark, d).where("valid"), "idx")
    return runlog.top_n_auc(s, "score", 5000).select(F.col("n").cast("int").alias("n"), r6(F.col("value"), "value"))


@query(_auc_sql("good", 5000, "1"))
def top_n_auc_extrapolated(spark, d):
    s = runlog.preprocess(occurred(spark, d))
    return runlog.top_n_auc(s, "score", 5000, extrapolate=True).select(F.col("n").cast("int").alias("n"), r6(F.col("value"), "value"))


@query(f"{WITH} SELECT round(count(*) / 5000.0, 6) + 0.0::DOUBLE AS hits, round(count(DISTINCT scaffold) / 5000.0, 6) + 0.0::DOUBLE AS scaffolds FROM occ WHERE valid AND score >= 0.8::DOUBLE")
def threshold_yield(spark, d):
    s = run(spark, d).where("valid")
    a = runlog.threshold_yield(s, "score", 0.8, 5000).select(r6(F.col("value"), "hits"))
    return a.crossJoin(runlog.threshold_yield(s, "score", 0.8, 5000, "scaffold").select(r6(F.col("value"), "scaffolds")))  # one row each


def _yield_sql(flag):
    return f"""{WITH}, T AS (SELECT score, scaffold, row_number() OVER (ORDER BY idx) AS pos FROM occ WHERE valid), f AS (SELECT min(pos) AS p FROM T WHERE score >= 0.8::DOUBLE GROUP BY scaffold) {CPS.replace('B)', '20000)')},
h AS (SELECT pos, {flag} AS h FROM T), v AS (SELECT cp, last, before, sum(h) / cp::DOUBLE AS v FROM h JOIN cps ON last = 1 OR pos <= cp GROUP BY cp, last, before),
a AS (SELECT (cp - before) * (v + coalesce(lag(v) OVER (ORDER BY last, cp), 0)) / 2 + CASE WHEN last = 1 AND cp < 20000 THEN (20000 - cp) * v ELSE 0 END AS a FROM v)
SELECT round(sum(a) / 20000, 6) + 0.0 AS value FROM a"""


@query(_yield_sql("(score >= 0.8::DOUBLE)::INT"))
def yield_auc(spark, d):
    return runlog.yield_auc(position(run(spark, d).where("valid"), "idx"), "score", 0.8, 20_000).select(r6(F.col("value"), "value"))


@query(_yield_sql("(pos IN (SELECT p FROM f))::INT"))
def yield_auc_scaffold(spark, d):
    return runlog.yield_auc(position(run(spark, d).where("valid"), "idx"), "score", 0.8, 20_000, scaffold="scaffold").select(r6(F.col("value"), "value"))


@query(f"""{WITH} SELECT idx, round(avg(score) OVER (ORDER BY idx ROWS 99 PRECEDING), 12) + 0.0 AS rolling_mean, round(max(score) OVER (ORDER BY idx), 6) + 0.0 AS running_max, round(min(score) OVER (ORDER BY idx), 6) + 0.0 AS running_min FROM occ""")
def trendlines(spark, d):
    t = runlog.trends(position(run(spark, d), "idx"), "score")
    return t.select("idx", (F.round("rolling_mean", 12) + 0.0).alias("rolling_mean"), *[r6(F.col(c), c) for c in ("running_max", "running_min")])


@query(f"""{WITH} SELECT idx, scaffold, round(avg(score) OVER (PARTITION BY scaffold ORDER BY idx ROWS 9 PRECEDING), 9) + 0.0 AS rolling_mean, round(max(score) OVER (PARTITION BY scaffold ORDER BY idx), 6) + 0.0 AS running_max FROM occ""")
def trendlines_by_run(spark, d):
    t = runlog.trends(position(run(spark, d), "idx", keys=["scaffold"]), "score", 10, ["scaffold"])
    return t.select("idx", "scaffold", (F.round("rolling_mean", 9) + 0.0).alias("rolling_mean"), r6(F.col("running_max"), "running_max"))


_SUMMARY = "count(*) AS n, round(avg(score), 6) + 0.0 AS mean, round(median(score), 6) + 0.0 AS median, round(stddev_samp(score), 6) + 0.0 AS std, round(avg(valid::INT), 6) + 0.0 AS valid, round(avg(uq::INT), 6) + 0.0 AS \"unique\""


def _summary(df):
    return df.select("step", "n", *[r6(F.col(c), c) for c in ("mean", "median", "std", "valid", "unique")])


@query(f"{WITH} SELECT step, {_SUMMARY} FROM allp GROUP BY step")
def per_step_summary(spark, d):
    return _summary(runlog.per_step(occurred(spark, d), "score"))


@query(f"{WITH} SELECT (pos - 1) // 300 AS step, {_SUMMARY} FROM allp GROUP BY 1 HAVING count(*) = 300")
def per_n_summary(spark, d):
    return _summary(runlog.per_n(position(occurred(spark, d), "idx"), "score", 300))


@query(f"{WITH} SELECT CAST(floor(score / 0.1::DOUBLE) AS BIGINT) AS step, {_SUMMARY} FROM allp GROUP BY 1")
def per_range_summary(spark, d):
    return _summary(runlog.per_step(occurred(spark, d), "score", F.floor(F.col("score") / 0.1)))


@query(f"""{WITH}, f AS (SELECT idx, mol_id, score FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY idx) AS k FROM run WHERE step <= 50) WHERE k = 1),
b AS (SELECT * FROM f ORDER BY score DESC, idx LIMIT 200), u AS (SELECT * FROM b UNION ALL SELECT idx, mol_id, score FROM run WHERE step > 50),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY idx) AS k FROM u) WHERE k = 1) SELECT idx, mol_id, round(score, 6) + 0.0 AS score FROM g ORDER BY g.score DESC, idx LIMIT 100""")
def replay_topk(spark, d):
    r = run(spark, d)
    buffer = runlog.replay_top(None, r.where("step <= 50"), "score", 200)
    return runlog.replay_top(buffer, r.where("step > 50"), "score", 100).select("idx", "mol_id", r6(F.col("score"), "score"))


@query(f"{WITH} SELECT idx, scaffold, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY scaffold ORDER BY score DESC, idx) AS k FROM occ WHERE idx BETWEEN 100 AND 6000) s WHERE k = 1 ORDER BY s.score DESC, idx LIMIT 25")
def pick_top_scaffolds(spark, d):
    p = runlog.pick(run(spark, d), "score", 25, scaffold="scaffold", window=(100, 6000))
    return p.select("idx", "scaffold", r6(F.col("score"), "score"))


@query(f"{WITH}, r AS (SELECT idx, score, row_number() OVER (ORDER BY score DESC, idx) AS r, count(*) OVER () AS n FROM run) SELECT idx, round(score, 6) + 0.0 AS score FROM r WHERE r - 1 IN (SELECT round_even(k * (n - 1) / 9.0, 0)::BIGINT FROM range(10) t(k))")
def pick_range(spark, d):
    return runlog.pick(run(spark, d), "score", 10, "range").select("idx", r6(F.col("score"), "score"))


@query(f"{WITH} SELECT idx, CAST(sum((score >= 0.8::DOUBLE)::INT) OVER (ORDER BY idx) AS BIGINT) AS hits FROM run")
def cumulative_hits(spark, d):
    return runlog.cumulative_hits(position(run(spark, d), "idx"), "score", 0.8).select("idx", F.col("hits").cast("long").alias("hits"))


@query(f"{WITH} SELECT (pos - 1) // 100 AS bin, round(avg(valid::INT), 6) + 0.0 AS valid, round(avg(uq::INT), 6) + 0.0 AS \"unique\" FROM allp GROUP BY 1")
def monitor_rate(spark, d):
    rows = position(occurred(spark, d), "idx")
    rate = lambda c: r6(F.avg(F.col(c).cast("double")), c)
    return rows.groupBy(F.expr("(pos - 1) div 100").alias("bin")).agg(rate("valid"), rate("unique"))


@query("SELECT l_orderkey, l_linenumber, metric, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount FROM lineitem) UNPIVOT (value FOR metric IN (l_quantity, l_tax, l_discount))")
def melt(spark, d):
    from assayer.sources.tables import melt as long

    return long(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax", "l_discount"])


@query(f"""{WITH} SELECT scaffold AS cluster, count(*) AS members, round(avg(score), 6) + 0.0 AS mean_score, round(avg(step), 6) + 0.0 AS mean_step FROM run GROUP BY 1 HAVING count(*) >= 5 AND avg(score) >= 0.1::DOUBLE""")
def cluster_summary(spark, d):
    c = run(spark, d).groupBy(F.col("scaffold").alias("cluster")).agg(F.count("*").alias("members"), F.avg("score").alias("s"), F.avg("step").alias("t"))
    return c.where("members >= 5 and s >= 0.1").select("cluster", "members", r6(F.col("s"), "mean_score"), r6(F.col("t"), "mean_step"))


@query(f"""{WITH}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC, idx) AS r FROM good), k(n) AS (VALUES (1), (10), (100)) SELECT 'Task score' AS metric, round(avg(v), 6) + 0.0 AS value FROM (SELECT n, avg(score) AS v FROM r JOIN k ON r <= n GROUP BY n)""")
def task_score(spark, d):
    return bundles.task_score(runlog.preprocess(occurred(spark, d)), "score", "median_1").select("metric", r6(F.col("value"), "value"))


@query(f"""{WITH}, h AS (SELECT score, (step % 7) / 7.0 AS act, (scaffold % 2)::DOUBLE AS rf FROM good), one AS (SELECT count(*) FILTER (act >= 0.4) AS a, avg((act >= 0.4)::INT) AS b, avg(score) FILTER (act >= 0.4) AS c, avg((rf = 1)::INT) AS e FROM h)
SELECT 'Library N' AS metric, round(a::DOUBLE, 6) + 0.0 AS value FROM one UNION ALL SELECT 'Library yield', round(b, 6) + 0.0 FROM one UNION ALL SELECT 'Library mean score', round(c, 6) + 0.0 FROM one UNION ALL SELECT 'Library satisfied', round(e, 6) + 0.0 FROM one""")
def library_bundle(spark, d):
    s = runlog.preprocess(occurred(spark, d)).withColumns({"act": F.expr("(step % 7) / 7.0D"), "rf": F.expr("cast(scaffold % 2 as double)")})
    return bundles.library_bundle(s, "score", "act", "rf").select("metric", r6(F.col("value"), "value"))


def exploration_bundle(spark, d):
    s = runlog.preprocess(occurred(spark, d)).withColumns({"x_Cmpd1_Sim": F.col("score"), "x_Cmpd2_Sim": 1 - F.col("score")})
    return bundles.exploration_bundle(s, 5000).select("metric", r6(F.col("value"), "value"))


def _exploration_sql():
    part = []
    for n in (1, 10, 100):
        part.append(f"SELECT 'Top-{n} Avg (Exp)' AS metric, round((SELECT avg(score) FROM (SELECT score FROM good ORDER BY score DESC LIMIT {n})) * (SELECT avg(s) FROM (SELECT 1 - score AS s FROM good ORDER BY s DESC LIMIT {n})), 6) + 0.0 AS value")
    auc = lambda e: _auc_sql(f"(SELECT idx, {e} AS score FROM good)", 5000).replace("round(sum(a) / 5000, 6) + 0.0", "sum(a) / 5000")
    part.append(f"SELECT 'Top-' || n || ' AUC (Exp)', round(a.value * b.value, 6) + 0.0 FROM ({auc('score')}) a JOIN ({auc('1 - score')}) b USING (n)")
    return f"{WITH} " + " UNION ALL ".join(part)


query(_exploration_sql())(exploration_bundle)


def run_metrics(spark, d):
    log = occurred(spark, d)
    return bundles.run_metrics(log, "score", 5000, 0.8).select("metric", r6(F.col("value"), "value"))


_PRE = "p AS (SELECT *, row_number() OVER (ORDER BY idx) AS q FROM occ), good5 AS (SELECT *, row_number() OVER (ORDER BY idx) AS pos FROM p WHERE q <= 5000 AND valid AND rn = 1)"


def _run_metrics_sql():
    auc = _auc_sql("good5", 5000).replace(WITH, f"{WITH}, {_PRE}")
    yauc = lambda flag: _yield_sql(flag).replace(WITH, f"{WITH}, {_PRE}").replace("FROM occ WHERE valid)", "FROM good5)").replace("20000", "5000")
    parts = [
        "SELECT 'valid_ratio' AS metric, round(avg(valid::INT), 6) + 0.0 AS value FROM allp",
        "SELECT 'unique_ratio', round(sum((valid AND uq)::INT) / sum(valid::INT)::DOUBLE, 6) + 0.0 FROM allp",
        *[f"SELECT 'Top-{n} Avg score', round(avg(score), 6) + 0.0 FROM (SELECT score FROM good5 ORDER BY score DESC LIMIT {n})" for n in (1, 10, 100)],
        f"SELECT 'Top-' || n || ' AUC score', value FROM ({auc})",
        "SELECT 'Yield score', round(count(*) / 5000.0::DOUBLE, 6) + 0.0 FROM good5 WHERE score >= 0.8::DOUBLE",
        "SELECT 'Yield Scaffold score', round(count(DISTINCT scaffold) / 5000.0::DOUBLE, 6) + 0.0 FROM good5 WHERE score >= 0.8::DOUBLE",
        f"SELECT 'Yield AUC score', value FROM ({yauc('(score >= 0.8::DOUBLE)::INT')})",
        f"SELECT 'Yield AUC Scaffold score', value FROM ({yauc('(pos IN (SELECT p FROM f))::INT')})",
    ]
    return f"{WITH}, {_PRE} " + " UNION ALL ".join(parts)


query(_run_metrics_sql())(run_metrics)


@query(f"""{WITH} SELECT idx, round(median(score) OVER (ORDER BY idx ROWS 99 PRECEDING), 6) + 0.0 AS rolling_median FROM run""")
def rolling_median(spark, d):
    m = runlog.rolling_median(position(run(spark, d), "idx"), "score")
    return m.select("idx", r6(F.col("rolling_median"), "rolling_median"))


@query(f"""{WITH}, e AS (SELECT min(score) AS a, max(score) AS b, min(scaffold) AS c, max(scaffold) AS f FROM run), s AS (SELECT idx, ((score - a) / (b - a) + (scaffold - f) / (c - f)::DOUBLE) / 2 AS s FROM run, e)
SELECT idx, round(s, 6) + 0.0 AS page_score FROM s ORDER BY s.s DESC, idx LIMIT 50""")
def top_page(spark, d):
    p = runlog.top_page(run(spark, d), {"score": False, "scaffold": True}, 50)
    return p.select("idx", r6(F.col("page_score"), "page_score"))


@query(f"{WITH} SELECT idx, mol_id, step FROM (SELECT *, row_number() OVER (PARTITION BY scaffold, valid ORDER BY idx) AS k FROM run) WHERE k = 1")
def structure_lookup(spark, d):
    return runlog.first_rows(run(spark, d), ["scaffold", "valid"]).select("idx", "mol_id", "step")


@query("""WITH p AS (SELECT p_partkey, [p_size / 50.0::DOUBLE, (p_partkey % 7) / 7.0::DOUBLE, (p_partkey % 4) / 4.0::DOUBLE] AS x FROM part)
SELECT p_partkey, round(list_avg(x), 6) + 0.0 AS mean, round(list_median(x), 6) + 0.0 AS median, round(list_max(x), 6) + 0.0 AS best, round(((x[1] >= 0.5)::INT + (x[2] >= 0.5)::INT + (x[3] >= 0.25)::INT) / 3.0::DOUBLE, 6) + 0.0 AS hits FROM p""")
def model_predictions(spark, d):
    """Several models' predictions for a candidate, as an ensemble and as targets."""
    from assayer.functions.aggregators import ensemble, multi_target

    x = F.array(F.col("p_size") / 50.0, (F.col("p_partkey") % 7) / 7.0, (F.col("p_partkey") % 4) / 4.0)
    p = table(spark, d, "part").select("p_partkey", x.alias("x"))
    x = F.col("x")
    return p.select("p_partkey", r6(ensemble(x), "mean"), r6(multi_target(x, "median"), "median"), r6(multi_target(x, "max"), "best"), r6(multi_target(x, "mean", (0.5, 0.5, 0.25)), "hits"))
