"""Queries: diversity filters and selections, sessions and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from assayer.functions import similarity
from assayer.operators import diversity
from assayer.operators.shared import shared_folder
from assayer.plans import session
from assayer.plans.catalog import query, table
from assayer.plans.q_scoring import RUN, r6, run
from assayer.plans.q_sets import VEC, vectors
from assayer.sources.objectives import parse
from assayer.streaming import live


def _scaffold_sql(out):
    return f"""WITH {RUN}, a AS (SELECT *, min(idx) FILTER (score >= 0.3::DOUBLE) OVER (PARTITION BY scaffold, mol_id) AS fr FROM run), b AS (SELECT *, coalesce(idx = fr, false) AS r FROM a),
c AS (SELECT *, sum(r::INT) OVER (PARTITION BY scaffold ORDER BY idx) AS n FROM b)
SELECT idx, r AS recorded, CASE WHEN r THEN CAST(n AS BIGINT) ELSE 0 END AS in_bucket, round(CASE WHEN idx > fr THEN 0 WHEN r THEN score * (CASE WHEN n > 3 THEN 0 ELSE {out} END) ELSE score END, 6) + 0.0 AS filtered FROM c"""


def _scaffold(mode, out):
    def make(spark, d):
        f = diversity.scaffold_filter(run(spark, d), "score", "scaffold", "mol_id", 3, 0.3, mode)
        return f.select("idx", "recorded", F.col("in_bucket").cast("long").alias("in_bucket"), r6(F.col("filtered"), "filtered"))

    make.__name__ = f"scaffold_filter_{mode}"
    query(_scaffold_sql(out))(make)


_scaffold("binary", "1")
_scaffold("linear", "1 - n / 3.0::DOUBLE")
_scaffold("sigmoid", "1 - 1 / (1 + exp(-(2 * n / 3.0::DOUBLE - 1) / 0.15))")


@query(_scaffold_sql("1 - n / 3.0::DOUBLE") + " WHERE step > 3")
def scaffold_filter_resumed(spark, d):
    """The filter on later batches, with what earlier ones recorded as its memory."""
    r = run(spark, d)
    first = diversity.scaffold_filter(r.where("step <= 3"), "score", "scaffold", "mol_id", 3, 0.3, "linear")
    memory = first.where("recorded").select("scaffold", "mol_id", F.col("idx").alias("ord"))
    f = diversity.scaffold_filter(r.where("step > 3"), "score", "scaffold", "mol_id", 3, 0.3, "linear", memory)
    return f.select("idx", "recorded", F.col("in_bucket").cast("long").alias("in_bucket"), r6(F.col("filtered"), "filtered"))


def _vectors(spark, d):
    return vectors(spark, d).withColumnRenamed("id", "idx").withColumn("score", (F.col("idx") * 7919 % 1000) / 1000.0)


# SQL of the greedy pass: `base` has (id, b), `ord` (id, rn) the order, WALK keeps an id that no kept one is near.
_PAIR = "CASE WHEN len(x.b) + len(y.b) = 0 THEN 1 ELSE len(list_intersect(x.b, y.b))::DOUBLE / (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) END"
NEAR = f"near AS MATERIALIZED (SELECT * FROM (SELECT x.id AS a, y.id AS b, {_PAIR} AS sim FROM base x JOIN base y ON x.id <> y.id) WHERE sim >= {{t}})"
WALK = """prev AS MATERIALIZED (SELECT o.rn, o.id, list(p.id) FILTER (p.rn < o.rn) AS before FROM ord o LEFT JOIN near ON near.a = o.id LEFT JOIN ord p ON p.id = near.b GROUP BY ALL),
walk(i, ids) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT i + 1, CASE WHEN list_has_any(ids, coalesce(before, [])) THEN ids ELSE list_append(ids, id) END FROM walk JOIN prev ON prev.rn = walk.i + 1),
kept AS MATERIALIZED (SELECT unnest(ids) AS id FROM walk WHERE i = (SELECT count(*) FROM ord))"""
_BY_ID = "ord AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM base)"
_ALL = f"{VEC}, base AS (SELECT vec_id AS id, b FROM vec)"
_SE = f"WITH RECURSIVE {_ALL}, {NEAR.format(t='1 - 0.6::DOUBLE')}, {_BY_ID}, {WALK}"
_SE_CLUSTERS = f"""{_SE}, best AS (SELECT a AS id, b AS leader, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM near WHERE b IN (SELECT id FROM kept) AND a NOT IN (SELECT id FROM kept)),
cluster AS (SELECT id, leader FROM best WHERE k = 1 UNION ALL SELECT id, id FROM kept)"""


def _similar_sql(candidate):
    """The similarity filter: clusters of founders, the scaffold filter over them."""
    return f"""WITH RECURSIVE {VEC}, s AS (SELECT vec_id AS idx, b, (vec_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM vec), base AS (SELECT min(idx) AS id, b FROM s WHERE score >= 0.3::DOUBLE GROUP BY b), {NEAR.format(t='0.42::DOUBLE')}, {_BY_ID}, {WALK},
best AS (SELECT a AS id, b AS leader, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM near WHERE b < a AND b IN (SELECT id FROM kept) AND a NOT IN (SELECT id FROM kept)),
cluster AS (SELECT id, leader FROM best WHERE k = 1 UNION ALL SELECT id, id FROM kept), named AS (SELECT base.b, leader FROM base JOIN cluster USING (id)),
r AS (SELECT s.*, CASE WHEN score >= 0.3::DOUBLE THEN leader END AS cluster FROM s LEFT JOIN named ON named.b = s.b),
f AS (SELECT *, min(idx) FILTER (score >= 0.3::DOUBLE) OVER (PARTITION BY coalesce(cluster, -1), {candidate}) AS fr FROM r), g AS (SELECT *, coalesce(idx = fr, false) AS rec FROM f), h AS (SELECT *, sum(rec::INT) OVER (PARTITION BY coalesce(cluster, -1) ORDER BY idx) AS n FROM g)
SELECT idx, cluster, rec AS recorded, round(CASE WHEN idx > fr THEN 0 WHEN rec THEN score * CASE WHEN n > 3 THEN 0 ELSE 1 - n / 3.0::DOUBLE END ELSE score END, 6) + 0.0 AS filtered FROM h"""


@query(_similar_sql("b"))
def compound_similarity_filter(spark, d):
    v = _vectors(spark, d).withColumn("smiles", F.col("words")[0].cast("string"))
    f = diversity.similarity_filter(v, "score", "smiles", "words", most=3, least=0.3, similar=0.42, mode="linear")
    return f.select("idx", "cluster", "recorded", r6(F.col("filtered"), "filtered"))


@query(f"{_SE} SELECT id FROM kept")
def sphere_exclusion(spark, d):
    return diversity.sphere_exclusion(_vectors(spark, d), 0.6)


@query()
def se_diversity(spark, d):
    value = diversity.sphere_exclusion_diversity(_vectors(spark, d), 0.6, k=400)
    return spark.range(1).select(r6(F.lit(value), "value"))


@query(f"{_SE_CLUSTERS} SELECT id, leader FROM cluster")
def se_clusters(spark, d):
    return diversity.sphere_exclusion_clusters(_vectors(spark, d), 0.6)


@query(f"{_SE_CLUSTERS} SELECT leader, count(*) AS size FROM cluster GROUP BY leader ORDER BY size DESC, leader LIMIT 10")
def se_picker(spark, d):
    return diversity.pick_sizes(diversity.sphere_exclusion_sizes(_vectors(spark, d), 0.6), 10, "largest")


@query(f"""WITH RECURSIVE {_ALL}, {NEAR.format(t='0.42::DOUBLE')}, degree AS (SELECT id, count(near.a) AS d FROM base LEFT JOIN near ON near.a = base.id GROUP BY id), ord AS (SELECT id, row_number() OVER (ORDER BY d DESC, id DESC) AS rn FROM degree), {WALK},
first AS (SELECT a AS id, arg_min(o.id, o.rn) AS leader FROM near JOIN ord o ON o.id = near.b JOIN ord m ON m.id = near.a WHERE o.rn < m.rn AND o.id IN (SELECT id FROM kept) AND a NOT IN (SELECT id FROM kept) GROUP BY a)
SELECT id, leader FROM first UNION ALL SELECT id, id FROM kept""")
def butina_clusters(spark, d):
    return diversity.butina_within(_vectors(spark, d), 0.42)


@query("""WITH RECURSIVE s AS (SELECT min(p_partkey) AS id, p_name AS n FROM part GROUP BY p_name), nb AS (SELECT x.id, list(y.id) FILTER (y.id <> x.id) AS near FROM s x JOIN s y ON levenshtein(x.n, y.n) <= 3 GROUP BY x.id),
m AS (SELECT map_from_entries(list((id, coalesce(near, []::BIGINT[])))) AS of FROM nb),
w(left_, leader, members) AS (SELECT (SELECT list(id) FROM s), NULL::BIGINT, []::BIGINT[] UNION ALL
  SELECT list_filter(left_, lambda x: NOT list_contains(own, x)), top, own FROM (SELECT left_, top, list_append(list_intersect(of[top], left_), top) AS own FROM
    (SELECT left_, of, list_sort(list_transform(left_, lambda x: {'d': len(list_intersect(of[x], left_)), 'id': x}))[-1].id AS top FROM w, m WHERE len(left_) > 0)))
SELECT unnest(members) AS id, leader FROM w WHERE leader IS NOT NULL""")
def levenshtein_butina(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), "p_name").groupBy("p_name").agg(F.min("idx").alias("idx"))
    return diversity.butina(p, diversity.levenshtein_pairs(p, "p_name", 3), reordering=True)


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1) a, (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1) b WHERE a.p_partkey < b.p_partkey AND levenshtein(a.p_name, b.p_name) <= 3")
def levenshtein_pairs(spark, d):
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("idx"))
    return diversity.levenshtein_pairs(p, "p_name", 3)


@query()
def maxmin_picker(spark, d):
    picks = diversity.maxmin(_vectors(spark, d), 20)
    return spark.createDataFrame([(k, i) for k, i in enumerate(picks)], "rank int, idx long")


@query(f"""WITH RECURSIVE {VEC}, s AS (SELECT vec_id AS id, b, (vec_id * 7919 % 1000) / 1000.0::DOUBLE AS score, row_number() OVER (ORDER BY vec_id) AS rn FROM vec),
sims AS MATERIALIZED (SELECT x.id, x.rn, x.score, map_from_entries(list((y.id, {_PAIR}))) AS sim FROM s x JOIN s y ON y.id < x.id GROUP BY ALL UNION ALL SELECT id, rn, score, MAP {{}} FROM s WHERE rn = 1),
w(i, buf) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, score DOUBLE, members BIGINT)[] UNION ALL
  SELECT i + 1, CASE WHEN len(buf) < 50 THEN list_append(buf, {{'id': id, 'score': score, 'members': 0::BIGINT}}) WHEN score < low THEN buf
    WHEN top > 0.35::DOUBLE THEN list_transform(buf, lambda x, k: CASE WHEN k = list_position(near, top) THEN {{'id': x.id, 'score': greatest(x.score, score), 'members': x.members + 1}} ELSE x END)
    ELSE list_transform(buf, lambda x, k: CASE WHEN k = list_position(scores, low) THEN {{'id': id, 'score': score, 'members': 0::BIGINT}} ELSE x END) END
  FROM (SELECT *, list_max(near) AS top, list_min(scores) AS low FROM (SELECT i, buf, id, score, list_transform(buf, lambda x: sim[x.id]) AS near, list_transform(buf, lambda x: x.score) AS scores FROM w JOIN sims ON sims.rn = w.i + 1)))
SELECT c.id AS centroid, round(c.score, 6) + 0.0 AS score, c.members AS members FROM (SELECT unnest(buf) AS c FROM w WHERE i = (SELECT count(*) FROM s))""")
def diverse_buffer(spark, d):
    return diversity.diverse_buffer(_vectors(spark, d), "score", 50, 0.35).select("centroid", r6(F.col("score"), "score"), "members")


@query()
def solow_polasky(spark, d):
    return spark.range(1).select(r6(F.lit(diversity.solow_polasky(_vectors(spark, d))), "value"))


# --- sessions and streams ----------------------------------------------------

_OBJECTIVE = json.dumps({
    "task": "names", "scoring": {"method": "wsum", "metrics": [
        {"name": "text_length", "weight": 1, "modifier": "gauss", "parameters": {"objective": "range", "mu": 14, "sigma": 4}},
        {"name": "near_Sim", "weight": 2, "modifier": "raw", "parameters": {}}]},
    "scoring_functions": [
        {"name": "TextDescriptors", "run": True, "parameters": {"prefix": "text"}},
        {"name": "LevenshteinSimilarity", "run": True, "parameters": {"prefix": "near", "references": ["small red box"], "method": "max"}}],
    "diversity_filter": {"run": True, "name": "Unique", "parameters": {}},
})


def _folder(spark) -> str:
    """A new folder in the shared one that the cluster names."""
    return f"{shared_folder(spark)}/session-{uuid.uuid4().hex}"


_NAMES_SQL = """WITH b AS (SELECT p_partkey, p_partkey % 4 AS q, lower(p_name) AS s FROM part), i AS (SELECT *, row_number() OVER (ORDER BY q, p_partkey) - 1 AS idx FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY idx) AS rn FROM i)
SELECT idx, s AS smiles, rn = 1 AS "unique", rn - 1 AS occurrences, round((greatest(1e-6, exp(-0.5 * ((length(s) - 14) / 4.0) ** 2)) + 2 * greatest(1e-6, greatest(0, 1 - levenshtein(s, 'small red box') / 13.0::DOUBLE))) / 3, 6) + 0.0 AS score,
 round(CASE WHEN rn = 1 THEN (greatest(1e-6, exp(-0.5 * ((length(s) - 14) / 4.0) ** 2)) + 2 * greatest(1e-6, greatest(0, 1 - levenshtein(s, 'small red box') / 13.0::DOUBLE))) / 3 ELSE 0 END, 6) + 0.0 AS reshaped FROM o"""


def _logged(log):
    return log.select("idx", "smiles", "unique", "occurrences", r6(F.col("Score"), "score"), r6(F.col("Score (reshaped)"), "reshaped"))


@query(_NAMES_SQL)
def session_batches(spark, d):
    """Four batches of names through a session: validity, repeats, cached results, filter and log."""
    from assayer.operators.order import position

    s = session.Session(spark, parse(_OBJECTIVE), _folder(spark))
    p = table(spark, d, "part")
    for k in range(4):
        b = position(p.where(F.col("p_partkey") % 4 == k).select("p_partkey", F.col("p_name").alias("smiles")), "p_partkey", "n")
        s.score_frame(b.select((F.col("n") - 1).cast("int").alias("batch_idx"), "smiles"))
    return _logged(s.log())


@query(_NAMES_SQL.replace("ORDER BY q, p_partkey", "ORDER BY p_partkey"))
def stream_scored(spark, d):
    """The same names as a stream of one file, scored by foreachBatch; the log is as a batch's."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("smiles"))
    folder = _folder(spark)
    p.coalesce(1).write.parquet(f"{folder}/in")
    s = session.Session(spark, parse(_OBJECTIVE), f"{folder}/run")
    live.drain(live.score_stream(live.read_stream(spark, f"{folder}/in", p), s, f"{folder}/checkpoint"))
    return _logged(s.log())


@query("SELECT event_id // 100 AS bin, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) + 0.0 AS best, round(avg((event_type <> 'error')::INT), 6) + 0.0 AS valid FROM events GROUP BY 1")
def stream_monitor(spark, d):
    """The monitor's view of a streamed run, once it has drained."""
    e = table(spark, d, "events").select(F.col("event_id").alias("idx"), "value", (F.col("event_type") != "error").alias("valid"))
    folder, name = _folder(spark), f"monitor_{uuid.uuid4().hex}"
    e.write.parquet(f"{folder}/in")
    q = live.monitor(live.read_stream(spark, f"{folder}/in", e), "value").writeStream.outputMode("complete").format("memory").queryName(name).start()
    live.drain(q)
    return spark.table(name).select("bin", "n", *[r6(F.col(c), c) for c in ("mean", "best", "valid")])


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def windows_tumbling(spark, d):
    w = live.tumbling(table(spark, d, "events"), "ts", "1 day", "1 hour", {"n": F.count("*"), "total": F.round(F.sum("value"), 4) + 0.0}, by=("event_type",))
    return w.select("start", "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hour THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def windows_session(spark, d):
    w = live.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id", "1 hour", {"n": F.count("*")})
    return w.select("user_id", "start", "n")


def benchmark_tasks(spark, d):
    """Two objectives over the same names, as one row of metrics for each."""
    p = table(spark, d, "part")
    one = parse(_OBJECTIVE)
    two = parse(_OBJECTIVE.replace('"names"', '"names two"').replace("small red box", "large green crate"))
    bench = session.Benchmark(spark, [one, two], _folder(spark), budget=500)
    from assayer.operators.order import position

    rows = position(p.select("p_partkey", F.col("p_name").alias("smiles")), "p_partkey", "n").select((F.col("n") - 1).cast("int").alias("batch_idx"), "smiles")
    for s in bench:
        s.score_frame(rows)
    out = bench.summary(write=False)
    return out.select("task", r6(F.col("valid_ratio"), "valid_ratio"), r6(F.col("unique_ratio"), "unique_ratio"), r6(F.col("Top-1 Avg Score"), "top1"))


_TASKS = """round(1.0::DOUBLE, 6) + 0.0 AS valid_ratio, (SELECT round(count(DISTINCT lower(p_name)) / count(*)::DOUBLE, 6) + 0.0 FROM part) AS unique_ratio,
(SELECT round(max((greatest(1e-6, exp(-0.5 * ((length(s) - 14) / 4.0) ** 2)) + 2 * greatest(1e-6, greatest(0, 1 - levenshtein(s, 'REF') / LEN.0::DOUBLE))) / 3), 6) + 0.0 FROM (SELECT lower(p_name) AS s FROM part ORDER BY p_partkey LIMIT 500)) AS top1"""
query("SELECT 'names' AS task, " + _TASKS.replace("REF", "small red box").replace("LEN", "13") + " UNION ALL SELECT 'names_two', " + _TASKS.replace("REF", "large green crate").replace("LEN", "17"))(benchmark_tasks)


def vector_words(spark, d):
    return vectors(spark, d).select("id", F.col("words")[0].alias("word"), similarity.on_bits(F.col("words")).cast("long").alias("bits"))


query("SELECT vec_id AS id, CAST(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END AS BIGINT) AS word, CAST(n AS BIGINT) AS bits FROM (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (2::HUGEINT) ** i ELSE 0 END))::HUGEINT AS w, len(list_filter(embedding, lambda v: v > 0)) AS n FROM embeddings)".replace("(2::HUGEINT) ** i", "(1::HUGEINT << i)"))(vector_words)


@query(_similar_sql("idx % 300"))
def scaffold_similarity_filter(spark, d):
    """The similarity filter with scaffolds as founders: repeats are those of the candidate."""
    v = _vectors(spark, d).withColumns({"scaffold": F.col("words")[0].cast("string"), "smiles": (F.col("idx") % 300).cast("string")})
    f = diversity.similarity_filter(v, "score", "smiles", "words", most=3, least=0.3, similar=0.42, mode="linear", founder="scaffold")
    return f.select("idx", "cluster", "recorded", r6(F.col("filtered"), "filtered"))


@query()
def diverse_tops(spark, d):
    from assayer.operators.order import position

    got = diversity.diverse_top(position(_vectors(spark, d), "idx"), "score", 400, (1, 10, 25))
    return got.select("n", r6(F.col("avg"), "avg"), r6(F.col("auc"), "auc"))


@query()
def pick_diverse(spark, d):
    from assayer.operators.runlog import pick

    return pick(_vectors(spark, d), "score", 12, "diverse").select("idx")


@query("SELECT p_name AS k, CAST(v AS INT) AS variant, p_name || '/' || v AS name, length(p_name)::DOUBLE + v AS energy FROM (SELECT DISTINCT p_name FROM part), range(3) t(v)")
def variants_expanded(spark, d):
    from assayer.functions.registry import expand

    p = table(spark, d, "part").select(F.col("p_name").alias("k"))
    return expand(p, "k", lambda s: [{"name": f"{s}/{v}", "energy": float(len(s) + v)} for v in range(3)], {"name": "string", "energy": "double"})
