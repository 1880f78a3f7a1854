"""Queries: transforms, aggregators, objectives, batch semantics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import aggregators, text
from assayer.functions.registry import REGISTRY, apply, best_variant
from assayer.functions.transforms import clip, transform
from assayer.operators import batch, diversity, runlog
from assayer.operators.order import position
from assayer.plans import compile as plan
from assayer.plans.catalog import query, table
from assayer.sources.objectives import parse

MODES = ("maximize", "minimize", "range")


def r6(c, name: str):
    return (F.round(c, 6) + 0.0).alias(name)


def run(spark: SparkSession, d: str) -> DataFrame:
    """`events` as a run: idx, step, mol_id, valid, score, scaffold."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("idx"), (F.expr("event_id div 100") + 1).cast("int").alias("step"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("mol_id"),
        (F.col("event_type") != "error").alias("valid"), (F.col("value") / 500.0).alias("score"), F.col("user_id").alias("scaffold"),
    )


RUN = """run AS (SELECT event_id AS idx, CAST(event_id // 100 + 1 AS INT) AS step, event_type || ':' || user_id AS mol_id,
  event_type <> 'error' AS valid, value / 500.0::DOUBLE AS score, user_id AS scaffold FROM events),
occ AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY idx) AS rn FROM run)"""
WITH_RUN = "WITH " + RUN


def _modes(spark, d, name, column, tab="lineitem", keys=("l_orderkey", "l_linenumber"), **p):
    x = F.col(column)
    return table(spark, d, tab).select(*keys, *[r6(transform(name, x, objective=m, **p), m) for m in MODES])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 6) + 0.0 AS value FROM lineitem")
def transform_raw(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(transform("raw", F.col("l_quantity")), "value"))


@query("""SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) + 0.0 AS maximize, round((l_extendedprice - hi) / (lo - hi), 6) + 0.0 AS minimize
FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)""")
def transform_norm(spark, d):
    x = table(spark, d, "lineitem")
    both = x.crossJoin(F.broadcast(x.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))))  # one row
    c = F.col("l_extendedprice")
    return both.select("l_orderkey", "l_linenumber", *[r6(transform("norm", c, objective=m, min=F.col("lo"), max=F.col("hi")), m) for m in MODES[:2]])


@query("""SELECT l_orderkey, l_linenumber,
  round(CASE WHEN l_quantity >= 40 THEN 1 WHEN l_quantity <= 10 THEN 0 ELSE (l_quantity - 10) / 30 END, 6) + 0.0 AS maximize,
  round(CASE WHEN l_quantity <= 15 THEN 1 WHEN l_quantity >= 45 THEN 0 ELSE 1 - (l_quantity - 15) / 30 END, 6) + 0.0 AS minimize,
  round(CASE WHEN l_quantity BETWEEN 15 AND 40 THEN 1 WHEN l_quantity < 15 THEN greatest(0, 1 - (15 - l_quantity) / 30) ELSE greatest(0, 1 - (l_quantity - 40) / 30) END, 6) + 0.0 AS range
FROM lineitem""")
def transform_lin_thresh(spark, d):
    return _modes(spark, d, "lin_thresh", "l_quantity", upper=40, lower=15, buffer=30)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS maximize,
  CASE WHEN l_quantity <= 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS minimize, CASE WHEN l_quantity BETWEEN 15 AND 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS range FROM lineitem""")
def transform_step(spark, d):
    return _modes(spark, d, "step", "l_quantity", upper=40, lower=15)


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount >= 0.05 THEN 1 ELSE exp(-0.5 * pow((l_discount - 0.05) / 0.03, 2)) END, 6) + 0.0 AS maximize,
  round(CASE WHEN l_discount <= 0.05 THEN 1 ELSE exp(-0.5 * pow((l_discount - 0.05) / 0.03, 2)) END, 6) + 0.0 AS minimize,
  round(exp(-0.5 * pow((l_discount - 0.05) / 0.03, 2)), 6) + 0.0 AS range FROM lineitem""")
def transform_gauss(spark, d):
    return _modes(spark, d, "gauss", "l_discount", mu=0.05, sigma=0.03)


@query("""SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.5 * (l_quantity - 40) + 5))), 6) + 0.0 AS maximize, round(1 / (1 + exp(-(0.5 * (15 - l_quantity) + 5))), 6) + 0.0 AS minimize,
  round(CASE WHEN l_quantity > 40 THEN 1 / (1 + exp(-(0.5 * (40 - l_quantity) + 5))) WHEN l_quantity < 15 THEN 1 / (1 + exp(-(0.5 * (l_quantity - 15) + 5))) ELSE 1 END, 6) + 0.0 AS range FROM lineitem""")
def transform_sigmoid(spark, d):
    return _modes(spark, d, "sigmoid", "l_quantity", upper=40, lower=15, scale=0.5)


def _props(spark, d):
    """Three transformed, clipped properties of every line."""
    x = table(spark, d, "lineitem")
    a = clip(transform("lin_thresh", F.col("l_quantity"), objective="maximize", upper=40, buffer=40))
    b = clip(transform("gauss", F.col("l_discount"), objective="minimize", mu=0.02, sigma=0.03))
    c = clip(transform("step", F.col("l_tax"), objective="range", lower=0.02, upper=0.06))
    return x.select("l_orderkey", "l_linenumber", "l_shipdate", a.alias("a"), b.alias("b"), c.alias("c"))


PROPS = """props AS (SELECT l_orderkey, l_linenumber, l_shipdate, greatest(1e-6::DOUBLE, CASE WHEN l_quantity >= 40 THEN 1 WHEN l_quantity <= 0 THEN 0 ELSE l_quantity / 40 END) AS a,
  greatest(1e-6::DOUBLE, CASE WHEN l_discount <= 0.02 THEN 1 ELSE exp(-0.5 * pow((l_discount - 0.02) / 0.03, 2)) END) AS b,
  greatest(1e-6::DOUBLE, CASE WHEN l_tax BETWEEN 0.02::DOUBLE AND 0.06::DOUBLE THEN 1.0 ELSE 0.0 END) AS c FROM lineitem)"""


def _agg(method, names=("a", "b", "c")):
    def make(spark, d):
        score = aggregators.aggregate(method, [F.col(n) for n in names], [1.0, 2.0, 0.5])
        return _props(spark, d).select("l_orderkey", "l_linenumber", r6(score, "score"))

    make.__name__ = f"agg_{method}"
    return make


for _method, _sql in {
    "amean": "(a + b + c) / 3",
    "gmean": "exp((ln(a) + ln(b) + ln(c)) / 3)",
    "wsum": "(a + 2 * b + 0.5 * c) / 3.5",
    "prod": "a * b * c",
    "wprod": "exp((ln(a) + 2 * ln(b) + 0.5 * ln(c)) / 3.5)",
}.items():
    query(f"WITH {PROPS} SELECT l_orderkey, l_linenumber, round({_sql}, 6) + 0.0 AS score FROM props")(_agg(_method))
query(f"WITH {PROPS} SELECT l_orderkey, l_linenumber, round(a, 6) + 0.0 AS score FROM props")(_agg("single", ("a",)))


def _auto(method):
    def make(spark, d):
        x = _props(spark, d).withColumn("month", F.date_trunc("month", "l_shipdate").cast("date"))
        x = aggregators.auto_aggregate(x, method, ["a", "b"], ["month"], "score")
        return x.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))

    make.__name__ = f"agg_{method}"
    return make


_AUTO = f"""WITH {PROPS}, m AS (SELECT *, CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM props),
w AS (SELECT month, sum((a < 0.5)::INT)::DOUBLE / sum((a >= 0.5)::INT) AS wa, sum((b < 0.5)::INT)::DOUBLE / sum((b >= 0.5)::INT) AS wb FROM m GROUP BY month)
SELECT month, count(*) AS n, round(sum(SCORE), 4) AS total FROM m JOIN w USING (month) GROUP BY month"""
query(_AUTO.replace("SCORE", "(a * wa + b * wb) / (wa + wb)"))(_auto("auto_wsum"))
query(_AUTO.replace("SCORE", "exp((ln(a) * wa + ln(b) * wb) / (wa + wb))"))(_auto("auto_wprod"))

SINGLE = json.dumps({
    "task": "two properties", "scoring": {"method": "gmean", "metrics": [
        {"name": "l_quantity", "weight": 1, "modifier": "lin_thresh", "parameters": {"objective": "maximize", "upper": 40, "lower": 0, "buffer": 40}},
        {"name": "l_discount", "weight": 1, "modifier": "gauss", "parameters": {"objective": "minimize", "mu": 0.02, "sigma": 0.03}}]},
})
FILTERED = json.dumps({
    "task": "weighted", "scoring": {"method": "wprod", "metrics": [
        {"name": "l_quantity", "weight": 2, "modifier": "lin_thresh", "parameters": {"objective": "maximize", "upper": 40, "lower": 0, "buffer": 40}},
        {"name": "l_discount", "weight": 1, "modifier": "gauss", "parameters": {"objective": "minimize", "mu": 0.02, "sigma": 0.03}},
        {"name": "l_tax", "modifier": "step", "filter": True, "parameters": {"objective": "range", "lower": 0.02, "upper": 0.06}},
        {"name": "l_extendedprice", "modifier": "step", "filter": True, "parameters": {"objective": "minimize", "lower": 50000}}]},
})


@query(f"""WITH {PROPS} SELECT l_orderkey, l_linenumber, round(a, 6) + 0.0 AS quantity, round(b, 6) + 0.0 AS discount, round(sqrt(a * b), 6) + 0.0 AS score FROM props""")
def score_single(spark, d):
    """The flagship: a JSON objective of two properties, compiled and scored over `lineitem`."""
    s = plan.score(table(spark, d, "lineitem"), parse(SINGLE))
    return s.select("l_orderkey", "l_linenumber", r6(F.col("lin_thresh_l_quantity"), "quantity"), r6(F.col("gauss_l_discount"), "discount"), r6(F.col("Score"), "score"))


@query(f"""WITH {PROPS}, f AS (SELECT l_orderkey, l_linenumber, a, b, c * greatest(1e-6::DOUBLE, CASE WHEN e <= 50000 THEN 1.0 ELSE 0.0 END) AS flt FROM
  (SELECT l_orderkey, l_linenumber, greatest(1e-6::DOUBLE, CASE WHEN l_quantity >= 40 THEN 1 ELSE l_quantity / 40 END) AS a, greatest(1e-6::DOUBLE, CASE WHEN l_discount <= 0.02 THEN 1 ELSE exp(-0.5 * pow((l_discount - 0.02) / 0.03, 2)) END) AS b,
   greatest(1e-6::DOUBLE, CASE WHEN l_tax BETWEEN 0.02::DOUBLE AND 0.06::DOUBLE THEN 1.0 ELSE 0.0 END) AS c, l_extendedprice AS e FROM lineitem))
SELECT l_orderkey, l_linenumber, round(flt, 6) + 0.0 AS filter, round(exp((2 * ln(a) + ln(b)) / 3) * flt, 6) + 0.0 AS score FROM f""")
def score_filtered(spark, d):
    s = plan.score(table(spark, d, "lineitem"), parse(FILTERED))
    return s.select("l_orderkey", "l_linenumber", r6(F.col("filter"), "filter"), r6(F.col("Score"), "score"))


# --- batch semantics ---------------------------------------------------------


@query(r"""SELECT p_partkey, coalesce(c, s) AS smiles, s IS NOT NULL AND trim(s) <> '' AND c IS NOT NULL AS valid, CAST(s IS NOT NULL AND trim(s) <> '' AND c IS NOT NULL AS INT) AS valid_score
FROM (SELECT p_partkey, s, nullif(lower(trim(regexp_replace(s, '\s+', ' ', 'g'))), '') AS c FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '  ' ELSE upper(p_name) || '  x' END AS s FROM part))""")
def parse_valid(spark, d):
    s = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 13 == 0, "  ").otherwise(F.concat(F.upper("p_name"), F.lit("  x")))
    return batch.parse(table(spark, d, "part").select("p_partkey", s.alias("smiles"))).select("p_partkey", "smiles", "valid", "valid_score")


@query(f"{WITH_RUN} SELECT idx, mol_id, rn = 1 AS \"unique\", rn - 1 AS occurrences FROM occ")
def first_occurrence(spark, d):
    return batch.first_occurrence(run(spark, d)).select("idx", "mol_id", "unique", "occurrences")


@query(f"{WITH_RUN} SELECT idx, mol_id, rn = 1 AS \"unique\", rn - 1 AS occurrences FROM occ WHERE step > 20")
def first_occurrence_after(spark, d):
    r = run(spark, d)
    return batch.first_occurrence_after(r.where("step > 20"), r.where("step <= 20")).select("idx", "mol_id", "unique", "occurrences")


@query(f"""{WITH_RUN}, e AS (SELECT *, valid AND rn = 1 AS ok FROM occ), s AS (SELECT step, bool_or(ok) AS anyok, min(idx) AS f FROM e GROUP BY step)
SELECT e.idx, e.step, e.mol_id FROM e JOIN s USING (step) WHERE ok OR (NOT anyok AND e.idx = s.f)""")
def score_eligible(spark, d):
    return batch.score_eligible(batch.first_occurrence(run(spark, d))).select("idx", "step", "mol_id")


@query(f"""{WITH_RUN}, f AS (SELECT mol_id, min_by(score, idx) AS first_score FROM run WHERE step <= 20 GROUP BY mol_id), n AS (SELECT mol_id, max(score) AS m FROM run WHERE step > 20 GROUP BY mol_id)
SELECT idx, b.mol_id, round(coalesce(first_score, m), 6) + 0.0 AS property FROM run b LEFT JOIN f USING (mol_id) LEFT JOIN n USING (mol_id) WHERE step > 20""")
def cache_lookup(spark, d):
    r = run(spark, d)
    log, new = r.where("step <= 20").withColumn("property", F.col("score")), r.where("step > 20")
    results = new.groupBy("mol_id").agg(F.max("score").alias("property"))
    return batch.attach_with_cache(new.select("idx", "mol_id"), results, log, ["property"]).select("idx", "mol_id", r6(F.col("property"), "property"))


@query(f"""{WITH_RUN}, res AS (SELECT mol_id, avg(score) AS m FROM run WHERE valid GROUP BY mol_id) SELECT idx, r.mol_id, round(coalesce(m, 0), 12) + 0.0 AS property FROM run r LEFT JOIN res USING (mol_id)""")
def attach_results(spark, d):
    r = run(spark, d)
    res = r.where("valid").groupBy("mol_id").agg(F.avg("score").alias("property"))
    return batch.attach_results(r.select("idx", "mol_id"), res).select("idx", "mol_id", (F.round("property", 12) + 0.0).alias("property"))


@query("""SELECT coalesce(a.k, b.k) AS mol_id, round(x, 4) + 0.0 AS x, n FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer) a FULL JOIN (SELECT o_custkey * 2 AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k""")
def merge_results(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("mol_id"), F.col("c_acctbal").alias("x"))
    b = table(spark, d, "orders").groupBy((F.col("o_custkey") * 2).alias("mol_id")).agg(F.count("*").alias("n"))
    m = batch.merge_results([a, b])
    return m.select("mol_id", (F.round("x", 4) + 0.0).alias("x"), "n")


@query(f"""{WITH_RUN}, s AS (SELECT step, min(score) AS lo, max(score) AS hi FROM run GROUP BY step),
w AS (SELECT step, least(min(lo) OVER (ORDER BY step), 0.1::DOUBLE) AS lo, greatest(max(hi) OVER (ORDER BY step), 0.9::DOUBLE) AS hi FROM s)
SELECT idx, round((score - lo) / (hi - lo), 6) + 0.0 AS normed, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM run JOIN w USING (step)""")
def extrema_running(spark, d):
    x = batch.running_extrema(run(spark, d), ["score"], start={"score": (0.1, 0.9)})
    n = transform("norm", F.col("score"), min=F.col("score_min"), max=F.col("score_max"))
    return x.select("idx", r6(n, "normed"), r6(F.col("score_min"), "lo"), r6(F.col("score_max"), "hi"))


@query(f"""{WITH_RUN} SELECT idx, round(CASE WHEN rn = 1 THEN score ELSE 0 END, 6) + 0.0 AS filtered, CASE WHEN rn = 1 THEN score ELSE 0 END = score AS passes FROM occ""")
def unique_filter(spark, d):
    r = batch.first_occurrence(run(spark, d))
    f = diversity.unique_filter(r, "score")
    return r.select("idx", r6(f, "filtered"), diversity.passes(f, F.col("score")).alias("passes"))


@query(f"""{WITH_RUN} SELECT idx, round(score * CASE WHEN rn - 1 <= 5 THEN 1 WHEN rn - 1 >= 10 THEN 0 ELSE 1 - (rn - 6) / 5.0 END, 6) + 0.0 AS filtered FROM occ""")
def occurrence_filter(spark, d):
    r = batch.first_occurrence(run(spark, d))
    return r.select("idx", r6(diversity.occurrence_filter(r, "score", 5, 5), "filtered"))


@query(f"""{WITH_RUN}, h AS (SELECT DISTINCT mol_id FROM run WHERE step <= 5) SELECT idx, mol_id FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY idx) AS k FROM run WHERE step > 5 AND valid) WHERE k = 1 AND mol_id NOT IN (SELECT mol_id FROM h)""")
def purge_history(spark, d):
    r = run(spark, d)
    return batch.purge_history(r.where("step > 5"), r.where("step <= 5")).select("idx", "mol_id")


@query(f"""{WITH_RUN}, s AS (SELECT step, count(*) AS n, sum((rn = 1)::INT) AS nu, avg(score) AS m FROM occ GROUP BY step)
SELECT step, CAST(sum(n) OVER w AS BIGINT) AS "rows", CAST(sum(nu) OVER w AS BIGINT) AS ids, round(m, 6) + 0.0 AS batch_mean, sum(n) OVER w >= 5000 OR max((m >= 0.56)::INT) OVER w = 1 AS finished FROM s WINDOW w AS (ORDER BY step)""")
def termination_report(spark, d):
    r = batch.first_occurrence(run(spark, d))
    t = runlog.termination(r, "score", budget=5000, threshold=0.56)
    return t.select("step", "rows", "ids", r6(F.col("batch_mean"), "batch_mean"), "finished")


@query(f"""{WITH_RUN}, r AS (SELECT step, score, CASE WHEN idx - (SELECT min(idx) FROM run) + 1 >= 500 THEN avg(score) OVER (ORDER BY idx ROWS 499 PRECEDING) END AS roll, idx FROM run),
s AS (SELECT step, avg(score) AS m, max_by(roll, idx) AS roll FROM r GROUP BY step) SELECT step, round(m, 6) + 0.0 AS batch_mean, round(roll, 6) + 0.0 AS rolling_mean, coalesce(m < roll, false) AS stalls FROM s""")
def early_stop(spark, d):
    r = position(run(spark, d), "idx")
    e = runlog.early_stop(r, "score")
    return e.select("step", r6(F.col("batch_mean"), "batch_mean"), r6(F.col("rolling_mean"), "rolling_mean"), "stalls")


@query(r"""SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS length, CAST(len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')) AS DOUBLE) AS words,
  round(length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) / length(p_name), 6) + 0.0 AS letter_share, round(length(regexp_replace(p_name, '[^A-Z]', '', 'g')) / length(p_name), 6) + 0.0 AS upper_share FROM part""")
def text_descriptors(spark, d):
    x = apply(table(spark, d, "part"), REGISTRY.get("TextDescriptors"), "t", "p_name")
    return x.select("p_partkey", F.col("t_length").alias("length"), F.col("t_words").alias("words"), r6(F.col("t_letter_share"), "letter_share"), r6(F.col("t_upper_share"), "upper_share"))


@query("SELECT l_orderkey, round(min(l_extendedprice), 4) AS best, arg_min(l_linenumber, (l_extendedprice, l_linenumber, l_partkey)) AS variant FROM lineitem GROUP BY l_orderkey")
def variants_best(spark, d):
    x = table(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey"))
    return best_variant(x.select("l_orderkey", "l_extendedprice", "o", F.col("l_linenumber").alias("variant")), ["l_orderkey"], "l_extendedprice", "o").select("l_orderkey", F.round("l_extendedprice", 4).alias("best"), "variant")


def canonical_names(spark, d):
    return table(spark, d, "part").select(text.canonical(F.col("p_name")).alias("name")).distinct()


query("SELECT DISTINCT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name FROM part")(canonical_names)
