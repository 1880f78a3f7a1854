"""Queries: state and files written and read back, sessions that go on, bundles, scores from fragment tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from assayer.functions import fragments
from assayer.functions.registry import ScoringFunction, apply
from assayer.operators import runlog, sets
from assayer.operators.order import position
from assayer.plans import bundles, session
from assayer.plans.catalog import query, table
from assayer.plans.q_diversity import _NAMES_SQL, _OBJECTIVE, NEAR, WALK, _folder, _logged, _vectors
from assayer.plans.q_runlog import WITH, _auc_sql, _run_metrics_sql, occurred
from assayer.plans.q_scoring import RUN, r6, run
from assayer.plans.q_sets import VEC
from assayer.sources import tables
from assayer.sources.objectives import parse

# --- objectives and sessions -------------------------------------------------


@query("SELECT * FROM (VALUES ('text_length', 1.0::DOUBLE, 'gauss', false, 'wsum', 'names'), ('near_Sim', 2.0::DOUBLE, 'raw', false, 'wsum', 'names')) v(metric, weight, modifier, is_filter, method, task)")
def objective_parsed(spark, d):
    """An objective's JSON, line breaks and tabs inside, as a row for each metric."""
    o = parse(_OBJECTIVE.replace(", ", ",\r\n\t"))
    rows = [(m.name, float(m.weight), m.modifier, bool(m.filter), o.method, o.task) for m in o.metrics]
    return spark.createDataFrame(rows, "metric string, weight double, modifier string, is_filter boolean, method string, task string")


def _batch(spark, d, k):
    b = position(table(spark, d, "part").where(F.col("p_partkey") % 4 == k).select("p_partkey", F.col("p_name").alias("smiles")), "p_partkey", "n")
    return b.select((F.col("n") - 1).cast("int").alias("batch_idx"), "smiles")


@query(_NAMES_SQL)
def session_resumed(spark, d):
    """Two batches, then a new session over the same folder for the other two."""
    folder = _folder(spark)
    first = session.Session(spark, parse(_OBJECTIVE), folder)
    for k in range(2):
        first.score_frame(_batch(spark, d, k))
    second = session.Session(spark, parse(_OBJECTIVE), folder, resume=True)
    for k in range(2, 4):
        second.score_frame(_batch(spark, d, k))
    return _logged(second.log())


_NAME_SCORE = "(greatest(1e-6, exp(-0.5 * ((length(s) - 14) / 4.0) ** 2)) + 2 * greatest(1e-6, greatest(0, 1 - levenshtein(s, 'small red box') / 13.0::DOUBLE))) / 3"


@query(f"SELECT s AS smiles, round({_NAME_SCORE}, 6) + 0.0 AS score FROM (SELECT DISTINCT p_name AS s FROM part)")
def score_only(spark, d):
    """Scores without validity, cache or log, in the order given."""
    names = sorted(r[0] for r in table(spark, d, "part").select("p_name").distinct().limit(10_000).collect())  # a batch, as a generator proposes it
    scores = session.Session(spark, parse(_OBJECTIVE), _folder(spark)).score_only(names)
    return spark.createDataFrame([(n, float(s)) for n, s in zip(names, scores)], "smiles string, score double").select("smiles", r6(F.col("score"), "score"))


@query("""WITH b AS (SELECT p_partkey % 4 AS q, p_partkey, lower(p_name) AS s FROM part), t AS (SELECT *, CASE WHEN q < 2 THEN 'names' ELSE 'names_two' END AS task FROM b)
SELECT task, count(*) AS n, count(DISTINCT s) AS n_unique, count(DISTINCT q) AS steps FROM t GROUP BY task""")
def curriculum_tasks(spark, d):
    """Two objectives one after the other: the first is finished when its budget is spent."""
    n = table(spark, d, "part").where("p_partkey % 4 < 2").count()
    one = json.loads(_OBJECTIVE) | {"budget": n}
    two = json.loads(_OBJECTIVE.replace('"names"', '"names two"'))
    s = session.Curriculum(spark, [parse(json.dumps(one)), parse(json.dumps(two))], _folder(spark))
    for k in range(4):
        s.score_frame(_batch(spark, d, k))
    log = tables.read_log(spark, s.path)
    return log.groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("smiles").alias("n_unique"), F.countDistinct("step").alias("steps"))


@query("SELECT p_partkey, round(length(p_name) * 0.5::DOUBLE, 6) + 0.0 AS own_half, CASE WHEN contains(p_name, 'red') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS own_red, length(replace(p_name, ' ', ''))::DOUBLE AS batch_size FROM part")
def custom_functions(spark, d):
    """A function of columns and one of batches, as a user adds them."""
    by_column = ScoringFunction("Own", ("half", "red"), lambda x: {"half": F.length(x) * 0.5, "red": x.contains("red").cast("double")})
    by_batch = ScoringFunction("Batch", ("size",), lambda: lambda strings: [{"size": len(s.replace(" ", ""))} for s in strings], "arrow")
    p = table(spark, d, "part")
    p = apply(apply(p, by_column, "own", "p_name"), by_batch, "batch", "p_name")
    return p.select("p_partkey", r6(F.col("own_half"), "own_half"), "own_red", "batch_size")


# --- files and state ---------------------------------------------------------


@query("SELECT trim(p_name) AS smiles, count(*) AS n FROM part GROUP BY 1")
def lines_read(spark, d):
    """Strings written a line each, compressed, and read again."""
    path = f"{_folder(spark)}/lines"
    tables.write_lines(table(spark, d, "part").select(F.col("p_name").alias("smiles")), path, compression="gzip")
    return tables.read_lines(spark, path).groupBy("smiles").agg(F.count("*").alias("n"))


@query(f"WITH {RUN} SELECT idx, step, mol_id, valid, score, 'x1' AS note FROM run")
def scores_csv(spark, d):
    """The final log as CSV with a logged constant, and read back."""
    path = f"{_folder(spark)}/scores.csv"
    tables.write_scores(run(spark, d), path, {"note": "x1"})
    return tables.read_scores(spark, path, "idx long, step int, mol_id string, valid string, score double, scaffold long, note string").drop("scaffold")


@query(f"WITH {RUN} SELECT idx, step, 'a task' AS task, 'm' AS model FROM run WHERE idx > 250")
def log_refreshed(spark, d):
    """The log by task and step, one step written twice; what a monitor that has seen rows up to 250 is missing."""
    path = f"{_folder(spark)}/log"
    log = run(spark, d).withColumn("task", F.lit("a task"))
    tables.write_step(log, path)
    tables.write_step(log.where("step = 3"), path)
    return tables.new_rows(tables.read_log(spark, path, {"model": "m"}), 250).select("idx", "step", "task", "model")


@query(f"WITH {RUN} SELECT CASE WHEN valid THEN 'good' ELSE 'bad' END AS run, count(*) AS n FROM run WHERE step > 1 OR valid GROUP BY 1")
def runs_renamed(spark, d):
    """A run renamed, another one dropped."""
    log = run(spark, d).withColumn("run", F.when(F.col("valid"), "a").when(F.col("step") == 1, "old").otherwise("b"))
    log = tables.drop_run(tables.rename_run(tables.rename_run(log, "a", "good"), "b", "bad"), "old")
    return log.groupBy("run").agg(F.count("*").alias("n"))


@query(f"WITH {RUN}, s AS (SELECT max(step)::BIGINT AS step FROM run), t AS (SELECT scaffold, mol_id, score, idx FROM run WHERE score >= 0.9::DOUBLE) SELECT t.*, s.step FROM t, s")
def state_kept(spark, d):
    """A memory table and the clock, written as state and read again."""
    path, r = f"{_folder(spark)}/state", run(spark, d)
    last = r.agg(F.max("step")).first()[0]
    tables.write_state(path, {"memory": r.where("score >= 0.9").select("scaffold", "mol_id", "score", "idx")}, {"step": last})
    state, values = tables.read_state(spark, path, ["memory"])
    return state["memory"].withColumn("step", F.lit(values["step"]).cast("long"))


@query(f"WITH {RUN}, r AS (SELECT * FROM run WHERE valid AND score >= 0.9::DOUBLE) SELECT idx, mol_id, score FROM r UNION ALL SELECT idx, mol_id, score FROM r")
def memory_files(spark, d):
    """A diversity memory as CSV and as JSON lines."""
    path = f"{_folder(spark)}/memory"
    tables.write_memory(run(spark, d).where("valid and score >= 0.9").select("idx", "mol_id", "score"), path)
    schema = "idx long, mol_id string, score double"
    return spark.read.csv(f"{path}/csv", header=True, schema=schema).unionByName(spark.read.schema(schema).json(f"{path}/json"))


@query(f"""WITH {RUN}, f AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY idx) AS k FROM run WHERE score = score), o AS (SELECT * FROM f WHERE k = 1 ORDER BY score DESC, idx LIMIT 40)
SELECT 12::BIGINT AS sampled, 12::BIGINT AS known, (SELECT count(*) FROM o) AS held""")
def replay_sampled(spark, d):
    """A replay buffer as CSV, and a sample of twelve of its rows, all of them known."""
    path = f"{_folder(spark)}/replay"
    tables.write_buffer(run(spark, d).groupBy("mol_id").agg(F.min_by("score", "idx").alias("score"), F.min("idx").alias("idx")).orderBy(F.desc("score"), "idx").limit(40), path)
    held = spark.read.csv(path, header=True, schema="mol_id string, score double, idx long")
    some = runlog.replay_sample(held, 12, 3).withColumn("here", F.lit(1))
    both = held.join(some.select("mol_id", "here"), "mol_id", "left")
    return both.agg(F.count_if(F.col("here") == 1).alias("sampled"), F.countDistinct(F.when(F.col("here") == 1, F.col("mol_id"))).alias("known"), F.count("*").alias("held"))


@query("SELECT p_partkey % 9 AS rule_id, min(p_name) AS pattern, 1 AS max, 'set ' || p_partkey % 9 % 2 AS rule_set FROM part WHERE p_partkey % 9 % 2 = 1 AND p_partkey % 9 <> 5 GROUP BY p_partkey % 9")
def rules_read(spark, d):
    """Alert rules from CSV: one set of two, an incomplete rule left out."""
    path, k = f"{_folder(spark)}/rules.csv", F.col("p_partkey") % 9
    rules = table(spark, d, "part").groupBy(k.alias("rule_id")).agg(F.min("p_name").alias("pattern"))
    rules = rules.select("rule_id", F.when(F.col("rule_id") != 5, F.col("pattern")).alias("pattern"), F.lit(1).alias("max"), F.lit("text").alias("description"), F.concat(F.lit("set "), F.col("rule_id") % 2).alias("rule_set"))
    rules.write.csv(path, header=True)
    return tables.read_rules(spark, path, ["set 1"]).select(F.col("rule_id").cast("long").alias("rule_id"), "pattern", "max", "rule_set")


@query("""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT i::INT AS i, round(avg(v), 6) + 0.0 AS mu, round(var_samp(v), 6) + 0.0 AS variance FROM u GROUP BY i""")
def moments_kept(spark, d):
    """Mean and covariance of a reference set, written and read again in place of the set."""
    path = f"{_folder(spark)}/moments"
    tables.write_moments(spark, path, *sets._moments(table(spark, d, "embeddings"), "embedding"))
    mu, sigma = tables.read_moments(spark, path)
    return spark.createDataFrame([(i, float(m), float(sigma[i, i])) for i, m in enumerate(mu)], "i int, mu double, variance double").select("i", r6(F.col("mu"), "mu"), r6(F.col("variance"), "variance"))


@query("SELECT metric, value, count(*) AS n FROM (SELECT unnest(['p_retailprice', 'p_size']) AS metric, unnest([round(p_retailprice, 2), p_size::DOUBLE]) AS value FROM part) GROUP BY ALL")
def property_distributions(spark, d):
    """The values of a set's properties, by property, each with its count."""
    v = sets.property_values(table(spark, d, "part").withColumn("p_retailprice", F.round("p_retailprice", 2)), ["p_retailprice", "p_size"])
    return v.select("metric", "value", "n")


# --- bundles -----------------------------------------------------------------


@query(f"{WITH} SELECT 'Mean of tops' AS metric, round((SELECT avg(v) FROM (" + " UNION ALL ".join(f"SELECT (SELECT avg(score) FROM (SELECT score FROM good ORDER BY score DESC LIMIT {n})) AS v" for n in (1, 10, 100)) + ")), 6) + 0.0 AS value")
def mean_of_tops(spark, d):
    return bundles.mean_of_tops(runlog.preprocess(occurred(spark, d)), "score").select("metric", r6(F.col("value"), "value"))


@query(f"{WITH} " + " UNION ALL ".join([f"SELECT 'Top-{n} Avg score' AS metric, round(avg(score), 6) + 0.0 AS value FROM (SELECT score FROM good ORDER BY score DESC LIMIT {n})" for n in (1, 10, 100)] + [f"SELECT 'Top-' || n || ' AUC score', value FROM ({_auc_sql('good', 5000)})"]))
def top_bundle(spark, d):
    return bundles.top_bundle(runlog.preprocess(occurred(spark, d)), "score", 5000).select("metric", r6(F.col("value"), "value"))


def _filtered_sql():
    passing = _run_metrics_sql().replace("row_number() OVER (ORDER BY idx) AS q FROM occ)", "row_number() OVER (ORDER BY idx) AS q FROM occ WHERE score < 0.6::DOUBLE)")
    return f"""SELECT metric, value FROM ({_run_metrics_sql()}) UNION ALL SELECT 'Low ' || metric, value FROM ({passing}) WHERE metric NOT LIKE '%ratio'
UNION ALL SELECT 'Low ratio', (SELECT round(avg((score < 0.6::DOUBLE)::INT), 6) + 0.0 FROM (WITH {RUN} SELECT * FROM occ WHERE valid AND rn = 1))"""


@query(_filtered_sql())
def filtered_metrics(spark, d):
    """The standard metrics of a run, those of the rows that pass a filter, and their share."""
    log = occurred(spark, d).withColumn("low", F.col("score") < 0.6)
    return bundles.filtered_metrics(log, "score", 5000, {"Low": "low"}, threshold=0.8).select("metric", r6(F.col("value"), "value"))


@query(f"""WITH RECURSIVE {VEC}, base AS (SELECT vec_id AS id, b FROM vec WHERE (vec_id * 7919 % 1000) / 1000.0::DOUBLE >= 0.5::DOUBLE), {NEAR.format(t="1 - 0.6::DOUBLE")}, ord AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM base), {WALK}
SELECT 'Diverse hits score' AS metric, round(count(*)::DOUBLE, 6) + 0.0 AS value FROM kept""")
def diverse_hits(spark, d):
    return bundles.hits_bundle(_vectors(spark, d), "score", threshold=0.5, distance=0.6).select("metric", r6(F.col("value"), "value"))


# --- scores from fragment tables ---------------------------------------------

_FRAG = """f AS (SELECT l_orderkey AS k, l_returnflag || l_linenumber % 4 AS frag, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT frag, ln(count(*)::DOUBLE) - 5 AS weight FROM (SELECT l_returnflag || l_linenumber % 4 AS frag FROM lineitem WHERE l_linestatus = 'O') GROUP BY frag)"""


def _fragments(spark, d):
    frag = F.concat("l_returnflag", F.col("l_linenumber") % 4).alias("fragment")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), frag, "l_linestatus")
    weights = x.where("l_linestatus = 'O'").groupBy("fragment").agg((F.ln(F.count("*").cast("double")) - 5).alias("weight"))
    return x.groupBy("k", "fragment").agg(F.count("*").alias("n")), weights


@query(f"""WITH {_FRAG}, s AS (SELECT k, sum(n * coalesce(weight, -4)) / sum(n) AS frag, count(*) AS kinds, sum(n) AS size FROM f LEFT JOIN w USING (frag) GROUP BY k),
r AS (SELECT k, frag - (pow(size, 1.005) - size) + CASE WHEN size > kinds THEN 0.5 * ln(size / kinds::DOUBLE) ELSE 0 END AS raw FROM s), t AS (SELECT k, 11 - (raw + 4 + 1) / (2.5 + 4) * 9 AS x FROM r)
SELECT k, round(least(10, greatest(1, CASE WHEN x > 8 THEN 8 + ln(greatest(x, 8) + 1 - 9 + 1e-300) ELSE x END)), 6) + 0.0 AS score FROM t""")
def fragment_ease(spark, d):
    """How easily candidates are made, 1 to 10: mean fragment weight, less for size, more for repeats."""
    counts, weights = _fragments(spark, d)
    per = counts.groupBy("k").agg(F.sum("n").alias("size"), F.count("*").alias("kinds"))
    s = fragments.mean_weight(counts, weights, "k", missing=-4.0).join(per, "k")
    return s.select("k", r6(fragments.ease(F.col("weight"), F.col("size"), F.col("kinds")), "score"))


@query(f"""WITH {_FRAG}, s AS (SELECT k, sum(n * coalesce(weight, 0)) / sum(n) * 3 AS x FROM f LEFT JOIN w USING (frag) GROUP BY k)
SELECT k, round(CASE WHEN x > 4 THEN 4 + log10(x - 4 + 1) WHEN x < -4 THEN -4 - log10(-4 - x + 1) ELSE x END, 6) + 0.0 AS score FROM s""")
def fragment_likeness(spark, d):
    """How alike candidates are to those that the weights come from, compressed beyond 4."""
    counts, weights = _fragments(spark, d)
    s = fragments.mean_weight(counts, weights, "k", missing=0.0)
    return s.select("k", r6(fragments.compressed(F.col("weight") * 3), "score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 10 - l_tax * 10 - greatest(l_linenumber * 2 - 6, 0), 6) + 0.0 AS score FROM lineitem")
def penalised_property(spark, d):
    """A property less its cost, and less what a ring has beyond six."""
    x = table(spark, d, "lineitem")
    score = fragments.penalised(F.col("l_quantity") / 10, F.col("l_tax") * 10, F.col("l_linenumber") * 2)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", r6(score, "score"))


@query("SELECT l_suppkey, (l_partkey % 16)::INT AS bit, count(*) AS n FROM lineitem GROUP BY ALL")
def folded_counts(spark, d):
    """Count prints folded to 16 places."""
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_partkey").alias("bit")).agg(F.count("*").alias("n"))
    prints = counts.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("bit", "n"))).alias("counts"))  # a row's own bits
    return prints.select("l_suppkey", F.explode(fragments.folded(F.col("counts"), 16)).alias("bit", "n")).select("l_suppkey", F.col("bit").cast("int").alias("bit"), "n")


@query(f"""WITH {RUN}, e AS (SELECT idx, score AS s1, abs(score - 0.1) AS s2, 1 - score AS s3 FROM run), m AS (SELECT idx, (s1 + s2 + s3) / 3 AS mean, sqrt(((s1 - (s1 + s2 + s3) / 3) ** 2 + (s2 - (s1 + s2 + s3) / 3) ** 2 + (s3 - (s1 + s2 + s3) / 3) ** 2) / 3) AS spread FROM e)
SELECT idx, round(mean, 6) + 0.0 AS pred, round(spread, 6) + 0.0 AS spread FROM m""")
def estimator_ensemble(spark, d):
    """Three estimators as one function of batches: their mean and spread."""
    from assayer.functions.estimators import estimator_function

    class Line:
        def __init__(self, f):
            self.f = f

        def predict(self, x):
            return self.f(x[:, 0])

    models = [Line(lambda v: v), Line(lambda v: abs(v - 0.1)), Line(lambda v: 1 - v)]
    f = estimator_function(spark, "Lines", models, lambda strings: [[float(s)] for s in strings])
    scored = apply(run(spark, d).withColumn("smiles", F.col("score").cast("string")), f, "line", "smiles")
    return scored.select("idx", r6(F.col("line_pred"), "pred"), r6(F.col("line_spread"), "spread"))


