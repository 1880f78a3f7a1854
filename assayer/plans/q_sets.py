"""Queries: one candidate set against another."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import similarity, text
from assayer.operators import pareto, sets, tiles
from assayer.plans import bundles
from assayer.plans.catalog import query, table
from assayer.plans.q_scoring import RUN, r6, run

#: Set bits of every vector, as lists.
VEC = "vec AS (SELECT vec_id, label, list_filter(range(64), lambda i: embedding[i + 1] > 0) AS b FROM embeddings)"
TAN = "CASE WHEN len(x.b) + len(y.b) = 0 THEN 1 ELSE len(list_intersect(x.b, y.b))::DOUBLE / (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) END"
WORDS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')"


def vectors(spark, d):
    """`embeddings` as (id, label, words)."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", similarity.words_from_vector(F.col("embedding"), 64).alias("words"))


def _bits(words):
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", words[0], i) == 1)


def _of_first(df, column):
    """The rows of a column's smallest value, as a reference set."""
    return df.join(F.broadcast(df.agg(F.min(column).alias(column))), column, "left_semi")  # one row


@query("SELECT count(*) AS n, sum((NOT EXISTS (SELECT 1 FROM documents r WHERE r.lang <> 'en' AND r.text = g.text))::INT)::BIGINT AS n_new, round(avg((NOT EXISTS (SELECT 1 FROM documents r WHERE r.lang <> 'en' AND r.text = g.text))::INT), 6) + 0.0 AS value FROM (SELECT DISTINCT text FROM documents WHERE lang = 'en') g")
def novelty(spark, d):
    x = table(spark, d, "documents")
    return sets.novelty(x.where("lang = 'en'"), x.where("lang <> 'en'"), "text").select("n", "n_new", r6(F.col("value"), "value"))


@query("""WITH t AS (SELECT DISTINCT p_name AS k FROM part WHERE p_type = (SELECT min(p_type) FROM part)), g AS (SELECT DISTINCT p_name AS k FROM part WHERE p_size < 10) SELECT sum((k IN (SELECT k FROM g))::INT)::BIGINT AS n, round(avg((k IN (SELECT k FROM g))::INT), 6) + 0.0 AS value FROM t""")
def rediscovery(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_name", "k")
    return sets.rediscovered(p.where("p_size < 10"), _of_first(p, "p_type"), "k").select("n", r6(F.col("value"), "value"))


@query("""WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click' AND value > 400), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase' AND value > 400)
SELECT 'intersect' AS how, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'subtract', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'union', k FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_operations(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "k").where("value > 400")
    a, b = e.where("event_type = 'click'"), e.where("event_type = 'purchase'")
    parts = [sets.set_operation(a, b, "k", how).select(F.lit(how).alias("how"), "k") for how in ("intersect", "subtract", "union")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_unique, round(count(DISTINCT text) / count(*)::DOUBLE, 6) + 0.0 AS value FROM documents WHERE text IS NOT NULL")
def fraction_unique(spark, d):
    return sets.fraction_unique(table(spark, d, "documents"), "text").select("n", "n_unique", r6(F.col("value"), "value"))


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_unique, round(count(DISTINCT text) / count(*)::DOUBLE, 6) + 0.0 AS value FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 150) WHERE text IS NOT NULL")
def unique_at_k(spark, d):
    return sets.fraction_unique(table(spark, d, "documents"), "text", "doc_id", 150).select("n", "n_unique", r6(F.col("value"), "value"))


@query("SELECT count(*) AS n, sum((n_chars BETWEEN 100 AND 5000)::INT)::BIGINT AS n_pass, round(avg((n_chars BETWEEN 100 AND 5000)::INT), 6) + 0.0 AS value FROM documents")
def fraction_passing(spark, d):
    return sets.fraction_passing(table(spark, d, "documents"), F.col("n_chars").between(100, 5000)).select("n", "n_pass", r6(F.col("value"), "value"))


@query(f"SELECT key, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS key FROM benchmark) GROUP BY key")
def bag_counts(spark, d):
    return sets.bag_counts(table(spark, d, "benchmark"), text.tokens(F.col("text")))


@query(f"WITH c AS (SELECT key, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS key FROM documents) GROUP BY key) SELECT count(*) AS keys, sum(n)::BIGINT AS total, round(count(*) / sum(n)::DOUBLE, 6) + 0.0 AS value FROM c")
def richness(spark, d):
    return sets.richness(sets.bag_counts(table(spark, d, "documents"), text.tokens(F.col("text")))).select("keys", "total", r6(F.col("value"), "value"))


@query(f"""WITH a AS (SELECT key, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS key FROM documents) GROUP BY key), b AS (SELECT key, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS key FROM benchmark) GROUP BY key)
SELECT round(sum(coalesce(a.n, 0)::DOUBLE * coalesce(b.n, 0)) / sqrt(sum(coalesce(a.n, 0)::DOUBLE ** 2) * sum(coalesce(b.n, 0)::DOUBLE ** 2)), 6) + 0.0 AS value FROM a FULL JOIN b USING (key)""")
def cosine_counts(spark, d):
    a, b = (sets.bag_counts(table(spark, d, t), text.tokens(F.col("text"))) for t in ("documents", "benchmark"))
    return sets.cosine_of_counts(a, b).select(r6(F.col("value"), "value"))


@query("""WITH a AS (SELECT value AS x FROM events WHERE event_type = 'view'), b AS (SELECT value AS x FROM events WHERE event_type = 'click'),
z AS (SELECT x, sum(u) AS u, sum(v) AS v FROM (SELECT x, 1.0::DOUBLE / (SELECT count(*) FROM a) AS u, 0.0::DOUBLE AS v FROM a UNION ALL SELECT x, 0.0, 1.0::DOUBLE / (SELECT count(*) FROM b) FROM b) GROUP BY x),
w AS (SELECT x, sum(u) OVER (ORDER BY x) AS fu, sum(v) OVER (ORDER BY x) AS fv, lead(x) OVER (ORDER BY x) AS nx FROM z) SELECT round(sum(abs(fu - fv) * (nx - x)), 5) + 0.0 AS value FROM w""")
def wasserstein(spark, d):
    e = table(spark, d, "events")
    w = sets.wasserstein(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "value")
    return w.select((F.round("value", 5) + 0.0).alias("value"))


@query(f"""WITH known AS (SELECT DISTINCT unnest({WORDS_SQL}) AS k FROM benchmark), g AS (SELECT doc_id, unnest(list_distinct({WORDS_SQL})) AS k FROM documents),
s AS (SELECT doc_id, avg((known.k IS NULL)::INT) AS s FROM g LEFT JOIN known USING (k) GROUP BY doc_id) SELECT round(avg(coalesce(s, 1)), 6) + 0.0 AS value FROM documents LEFT JOIN s USING (doc_id)""")
def outlier_bits(spark, d):
    """Words stand for bits here."""
    bits = lambda t: table(spark, d, t).withColumn("bits", text.tokens(F.col("text")))
    return sets.outlier_bits(bits("documents"), bits("benchmark"), "doc_id", "bits").select(r6(F.col("value"), "value"))


@query("""WITH r AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS e FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) SELECT p_partkey, CAST(p_size BETWEEN a AND b AND p_retailprice BETWEEN c AND e AS INT) AS in_domain FROM part, r""")
def applicability_domain(spark, d):
    p = table(spark, d, "part")
    return sets.applicability_domain(p, _of_first(p, "p_brand"), ["p_size", "p_retailprice"]).select("p_partkey", "in_domain")


@query("""WITH r AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part WHERE p_brand = (SELECT min(p_brand) FROM part))
SELECT p_partkey, CAST(p_size BETWEEN m - 1.25 * s AND m + 1.25 * s AND p_retailprice BETWEEN m2 - 1.25 * s2 AND m2 + 1.25 * s2 AND p_partkey % 10 <= 6 AS INT) AS passes FROM part, r""")
def target_filter(spark, d):
    p = table(spark, d, "part").withColumn("tenth", F.col("p_partkey") % 10)
    return sets.target_filter(p, _of_first(p, "p_brand"), ["p_size", "p_retailprice"], 1.25, {"tenth": 6}).select("p_partkey", "passes")


@query("SELECT p_partkey, CAST(p_size >= 5 AND p_size <= 30 AND p_retailprice <= 980 AS INT) AS passes FROM part")
def range_filter(spark, d):
    return sets.range_filter(table(spark, d, "part"), {"p_size": (5, 30), "p_retailprice": (None, 980)}).select("p_partkey", "passes")


PATTERNS = ("ea.*er", "^The", "[0-9]{5,}", "tion\\b")


@query("SELECT doc_id, " + ", ".join(["CAST(" + " OR ".join(f"regexp_matches(text, '{p}')" for p in PATTERNS) + " AS INT) AS any_match", "CAST(" + " AND ".join(f"regexp_matches(text, '{p}')" for p in PATTERNS[:2]) + " AS INT) AS all_match"]) + " FROM documents WHERE text IS NOT NULL")
def pattern_any_all(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.match_any(t, PATTERNS).alias("any_match"), text.match_all(t, PATTERNS[:2]).alias("all_match"))


@query("SELECT doc_id, CAST(len(m) = 0 AS INT) AS passes, array_to_string(m, ',') AS matched FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{p}' END" for p in PATTERNS) + "], lambda x: x IS NOT NULL) AS m FROM documents WHERE text IS NOT NULL)")
def pattern_filter(spark, d):
    ok, names = text.pattern_filter(F.col("text"), PATTERNS)
    return table(spark, d, "documents").where("text is not null").select("doc_id", ok.alias("passes"), names.alias("matched"))


RULES = ((1, "[0-9]{4,}", 1, "digits", "a"), (2, "\\*\\*\\*", 3, "stars", "a"), (3, "[A-Z]{12,}", 0, "shouting", "b"), (4, None, 0, "broken", "a"), (5, "trash|worthless", 0, "insult", "c"))


def quality_rules_max(spark, d):
    rules = spark.createDataFrame(RULES, "rule_id int, pattern string, max int, description string, rule_set string")
    return sets.alert_rules(table(spark, d, "documents"), rules, "text", "doc_id", ("a", "c")).select("doc_id", "passes", "broken")


query("SELECT doc_id, CAST(len(m) = 0 AS INT) AS passes, array_to_string(m, ',') AS broken FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN len(regexp_extract_all(coalesce(text, ''), '{p}')) > {m} THEN '{n}' END" for _, p, m, n, s in RULES if p and s in "ac") + "], lambda x: x IS NOT NULL) AS m FROM documents)")(quality_rules_max)


@query("SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS INT) AS inside FROM customer")
def membership(spark, d):
    ref = table(spark, d, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")
    return sets.member(table(spark, d, "customer"), ref, "c_custkey").select("c_custkey", "inside")


@query()
def bloom_membership(spark, d):
    """Approximate membership; tests hold it against the exact flag."""
    ref = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey").distinct().withColumnRenamed("o_custkey", "c_custkey")
    return sets.bloom_member(table(spark, d, "customer"), sets.bloom_build(ref, "c_custkey"), "c_custkey", "c_custkey").select("c_custkey", "inside")


@query(f"""WITH {VEC}, ref AS (SELECT vec_id AS rid, b FROM vec WHERE vec_id < 5), p AS (SELECT x.vec_id, rid, len(x.b)::DOUBLE AS a, len(y.b)::DOUBLE AS b, len(list_intersect(x.b, y.b))::DOUBLE AS c, 64.0::DOUBLE AS n FROM vec x, ref y)
SELECT vec_id, rid, round(c / (a + b - c), 6) + 0.0 AS tanimoto, round(2 * c / (a + b), 6) + 0.0 AS dice, round(c / sqrt(a * b), 6) + 0.0 AS cosine, round(c / (2 * a + 2 * b - 3 * c), 6) + 0.0 AS sokal, round(c / n, 6) + 0.0 AS russel, round(c / (a + b - c), 6) + 0.0 AS onbit,
round(c * (a + b) / (2 * a * b), 6) + 0.0 AS kulczynski, round((c * (a + b) - a * b) / (a * b), 6) + 0.0 AS mcconnaughey, round(c / least(a, b), 6) + 0.0 AS asymmetric, round(c / greatest(a, b), 6) + 0.0 AS braunblanquet,
round(c / (a + b) + (n - a - b + c) / (2 * n - a - b), 6) + 0.0 AS rogotgoldberg, round((n - (a + b - 2 * c)) / n, 6) + 0.0 AS allbit FROM p""")
def similarity_measures(spark, d):
    """All twelve coefficients against a fixed reference list of five."""
    v = vectors(spark, d)
    ref = F.broadcast(v.where("id < 5").select(F.col("id").alias("rid"), F.col("words").alias("rw")))  # five rows
    m = similarity.measures(similarity.on_bits(F.col("words")), similarity.on_bits(F.col("rw")), similarity.common_bits(F.col("words"), F.col("rw")), 64)
    return v.crossJoin(ref).select(F.col("id").alias("vec_id"), "rid", *[r6(c, k.lower()) for k, c in m.items()])


@query(f"""WITH {VEC}, s AS (SELECT x.vec_id, y.vec_id AS rid, {TAN} AS t FROM vec x, vec y WHERE y.vec_id IN (0, 1, 2)) SELECT vec_id, round(max(t), 6) + 0.0 AS best, round(avg(t), 6) + 0.0 AS mean, round(avg((t >= 0.35::DOUBLE)::INT), 6) + 0.0 AS hits FROM s GROUP BY vec_id""")
def reference_similarity(spark, d):
    v = vectors(spark, d)
    refs = [F.array(*[F.lit(w) for w in r["words"]]) for r in v.where("id < 3").orderBy("id").collect()]  # the fixed reference list
    sim = lambda x, y: similarity.bit_similarity(x, y)
    best, _ = similarity.to_references(F.col("words"), refs, sim, "max")
    mean, _ = similarity.to_references(F.col("words"), refs, sim, "mean")
    hits, _ = similarity.to_references(F.col("words"), refs, sim, "mean", 0.35)
    return v.select(F.col("id").alias("vec_id"), r6(best, "best"), r6(mean, "mean"), r6(hits, "hits"))


@query(r"""WITH d AS (SELECT p_partkey, p_name, list_transform(['small red box', 'tiny blue case'], lambda r: greatest(0, 1 - levenshtein(p_name, r) / length(r)::DOUBLE)) AS s FROM part) SELECT p_partkey, round(list_max(s), 6) + 0.0 AS best, round(list_avg(s), 6) + 0.0 AS mean FROM d""")
def levenshtein_sim(spark, d):
    one = similarity.levenshtein_similarity
    refs = ["small red box", "tiny blue case"]
    best, _ = similarity.to_references(F.col("p_name"), refs, one, "max")
    mean, _ = similarity.to_references(F.col("p_name"), refs, one, "mean")
    return table(spark, d, "part").select("p_partkey", r6(best, "best"), r6(mean, "mean"))


@query("""WITH f AS (SELECT p_partkey, p_size AS c, p_size % 7 AS h, p_partkey % 5 AS o FROM part) SELECT p_partkey, round(exp((-0.5 * (c - 9.0) ** 2 - 0.5 * (CASE h WHEN 0 THEN 1 ELSE h END - 5.0) ** 2 - 0.5 * (CASE o WHEN 0 THEN 0 ELSE o END - 2.0) ** 2 - 0.5 * ((c + CASE h WHEN 0 THEN 1 ELSE h END + o - 16.0) / 2) ** 2) / 4), 6) + 0.0 AS score FROM f""")
def isomer_formula(spark, d):
    h = F.col("p_size") % 7
    formula = F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("H"), F.when(h == 0, "").otherwise(h.cast("string")), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("O"), (F.col("p_partkey") % 5).cast("string"))))
    return table(spark, d, "part").select("p_partkey", r6(similarity.isomer_score(formula, {"C": 9, "H": 5, "O": 2}), "score"))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) GROUP BY ALL),
s AS (SELECT k, sum(least(a.n, coalesce(r.n, 0))) AS c, sum(a.n) AS ta FROM a LEFT JOIN r USING (p) GROUP BY k) SELECT k, round(c / (ta + (SELECT sum(n) FROM r) - c)::DOUBLE, 6) + 0.0 AS tanimoto, round(2 * c / (ta + (SELECT sum(n) FROM r))::DOUBLE, 6) + 0.0 AS dice FROM s""")
def count_similarity(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderpriority").agg(F.count("*").cast("int").alias("n"))
    bags = per.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    ref = bags.agg(F.min_by("m", "k").alias("r"))
    both = bags.crossJoin(F.broadcast(ref))  # one row
    return both.select("k", *[r6(similarity.count_similarity(F.col("m"), F.col("r"), m), m.lower()) for m in ("Tanimoto", "Dice")])


@query(f"""WITH {VEC}, s AS (SELECT x.vec_id, y.vec_id AS r, {TAN} AS t FROM vec x, vec y WHERE x.label < 5 AND y.label >= 5) SELECT vec_id AS id, round(max(t), 6) + 0.0 AS best, arg_min(r, (-t, r)) AS best_id FROM s GROUP BY vec_id""")
def nearest_neighbour(spark, d):
    v = vectors(spark, d)
    return tiles.nearest(v.where("label < 5"), v.where("label >= 5")).select("id", r6(F.col("best"), "best"), "best_id")


@query(f"""WITH {VEC}, s AS (SELECT x.vec_id, max({TAN}) AS t FROM vec x, vec y WHERE x.label < 5 AND y.label >= 5 GROUP BY x.vec_id) SELECT round(avg(t), 6) + 0.0 AS value FROM s""")
def snn(spark, d):
    v = vectors(spark, d)
    return tiles.mean_nearest(v.where("label < 5"), v.where("label >= 5")).select(r6(F.col("value"), "value"))


@query(f"""WITH {VEC}, s AS (SELECT x.vec_id AS g, y.vec_id AS r, {TAN} > 0.45::DOUBLE AS h FROM vec x, vec y WHERE x.label < 5 AND y.label >= 5)
SELECT round((SELECT avg(h::INT) FROM (SELECT bool_or(h) AS h FROM s GROUP BY g)), 6) + 0.0 AS gen, round((SELECT avg(h::INT) FROM (SELECT bool_or(h) AS h FROM s GROUP BY r)), 6) + 0.0 AS ref""")
def analogues(spark, d):
    v = vectors(spark, d)
    return tiles.analogues(v.where("label < 5"), v.where("label >= 5"), 0.45).select(r6(F.col("gen"), "gen"), r6(F.col("ref"), "ref"))


@query(f"""WITH {VEC}, s AS (SELECT x.vec_id, avg({TAN}) AS m1, avg(({TAN}) ** 2) AS m2 FROM vec x, vec y GROUP BY x.vec_id) SELECT round(1 - avg(m1), 6) + 0.0 AS intdiv1, round(1 - avg(sqrt(m2)), 6) + 0.0 AS intdiv2 FROM s""")
def internal_diversity(spark, d):
    v = vectors(spark, d)
    one = tiles.internal_diversity(v).select(r6(F.col("value"), "intdiv1"))
    return one.crossJoin(tiles.internal_diversity(v, 2.0).select(r6(F.col("value"), "intdiv2")))  # one row each


@query(f"""WITH {VEC}, r AS (SELECT b AS known FROM vec WHERE vec_id = 0) SELECT vec_id, round(CASE WHEN len(b) = 0 THEN 1 ELSE (len(b) - len(list_intersect(b, known)))::DOUBLE / len(b) END, 6) + 0.0 AS unseen FROM vec, r""")
def unseen_bits(spark, d):
    v = vectors(spark, d).withColumn("b", _bits(F.col("words")))
    ref = F.broadcast(v.where("id = 0").select(F.col("b").alias("known")))  # one row
    return v.crossJoin(ref).select(F.col("id").alias("vec_id"), r6(text.unseen_share(F.col("b"), F.col("known")), "unseen"))


# a point's front is the length of the longest chain of points that dominate each other down to it
@query("""WITH RECURSIVE p AS (SELECT DISTINCT p_size AS x, round(p_retailprice, 2) AS y, p_brand AS g FROM part), chain(x, y, g, k) AS (SELECT x, y, g, 1 FROM p
  UNION SELECT b.x, b.y, b.g, a.k + 1 FROM chain a JOIN p b ON b.g = a.g AND a.x >= b.x AND a.y >= b.y AND (a.x > b.x OR a.y > b.y))
SELECT x, y, g, max(k)::INT AS front FROM chain GROUP BY x, y, g""")
def pareto_fronts(spark, d):
    """The front of each brand's parts."""
    p = table(spark, d, "part").select(F.col("p_size").alias("x"), F.round("p_retailprice", 2).alias("y"), F.col("p_brand").alias("g")).distinct()
    return pareto.fronts(p, ["x", "y"], ["g"]).select("x", "y", "g", "front")


# a row's level is the length of the longest chain of rows below it; the worst have none below
@query(f"""WITH RECURSIVE {RUN}, p AS MATERIALIZED (SELECT idx, step, score AS x, 1 - abs(score - 0.5::DOUBLE) * 2 AS y FROM run), below AS MATERIALIZED (SELECT a.idx AS hi, b.idx AS lo FROM p a JOIN p b ON a.step = b.step AND a.x >= b.x AND a.y >= b.y AND (a.x > b.x OR a.y > b.y)),
chain(idx, k) AS (SELECT idx, 0 FROM p UNION SELECT hi, k + 1 FROM chain JOIN below ON lo = idx), level AS (SELECT idx, max(k) AS k FROM chain GROUP BY idx),
place AS (SELECT p.*, row_number() OVER (PARTITION BY step ORDER BY k, p.idx) - 1 AS k FROM p JOIN level USING (idx)), same AS (SELECT *, first_value(k) OVER (PARTITION BY step, x, y ORDER BY idx) AS r, x >= 0.5 AND y >= 0.5 AS good FROM place),
n AS (SELECT step, sum(good::INT) AS n_good, sum((NOT good)::INT) AS n_bad FROM same GROUP BY step)
SELECT idx, same.step, round(CASE WHEN good THEN 0.5 + (r - n_bad) / greatest(1, n_good)::DOUBLE ELSE r / greatest(1, 2 * n_bad)::DOUBLE END, 6) + 0.0 AS reward FROM same JOIN n USING (step)""")
def pareto_reward(spark, d):
    """Ranks of every batch of the run as rewards; tests hold them against plain sorting."""
    r = run(spark, d).withColumn("other", 1 - F.abs(F.col("score") - 0.5) * 2)
    return pareto.reward(r, ["score", "other"]).select("idx", "step", r6(F.col("pareto_front"), "reward"))


@query("""WITH e AS (SELECT label, embedding[1]::DOUBLE * 3 AS x, embedding[2]::DOUBLE * 3 AS y, embedding[3]::DOUBLE * 3 AS z, 0.5::DOUBLE + label / 10.0::DOUBLE AS r FROM embeddings), a AS (SELECT * FROM e WHERE label < 5), b AS (SELECT * FROM e WHERE label >= 5)
SELECT count(*) AS pairs FROM a, b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < a.r + b.r - 0.4::DOUBLE""")
def steric_clashes(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select("label", *[(e["embedding"][i].cast("double") * 3).alias(c) for i, c in enumerate("xyz")], (0.5 + F.col("label") / 10.0).alias("radius"))
    return sets.neighbour_overlap(p.where("label < 5"), p.where("label >= 5"), 0.4)


@query(f"""WITH {RUN}, m AS (SELECT step, count(*) AS n, avg(score) AS v FROM run GROUP BY step) SELECT 'score' AS metric, round(sum(v * n) / sum(n), 6) + 0.0 AS value, sum(n)::BIGINT AS n FROM m""")
def cumulative_correction(spark, d):
    """The average over all batches of the run, corrected by the last after all before it."""
    calls = run(spark, d).groupBy("step").agg(F.lit("score").alias("metric"), F.avg("score").alias("value"), F.count("*").alias("n"))
    last = calls.agg(F.max("step").alias("step"))
    before = sets.corrected(None, calls.join(F.broadcast(last), "step", "left_anti"))  # one row
    state = sets.corrected(before, calls.join(F.broadcast(last), "step", "left_semi"))
    return state.select("metric", r6(F.col("value"), "value"), "n")


@query()
def frechet(spark, d):
    """Frechet distance of two halves of the vectors; tests hold it against numpy."""
    e = table(spark, d, "embeddings")
    value = sets.frechet(e.where("label < 5"), e.where("label >= 5"), "embedding")
    return spark.range(1).select(r6(F.lit(value), "value"))


@query()
def set_metrics(spark, d):
    """The intrinsic and extrinsic bundle over vectors; each of its parts has a query of its own."""
    v = vectors(spark, d).withColumns({"key": F.col("words")[0], "bits": _bits(F.col("words")), "n_bits": F.bit_count(F.col("words")[0])})
    m = bundles.set_metrics(v.where("label < 5"), {"test": v.where("label >= 5")}, "key", {"Bits": "bits"}, ["n_bits"], "words")
    return m.select("metric", r6(F.col("value"), "value"))
