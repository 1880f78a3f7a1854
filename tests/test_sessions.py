import json
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from assayer.functions.transforms import ObjectiveError
from assayer.plans import bundles, session
from assayer.plans import compile as plan
from assayer.sources import tables
from assayer.sources.objectives import load, numbered, parse, select
from assayer.streaming import live


def objective(task="words", method="wsum", budget=None, diversity=None, modifier="gauss", **more):
    metrics = [
        {"name": "text_length", "weight": 1, "modifier": modifier, "parameters": {"objective": "maximize", "mu": 6, "sigma": 2}},
        {"name": "near_Sim", "weight": 2, "modifier": "raw", "parameters": {}},
    ]
    raw = {
        "task": task,
        "scoring": {"method": method, "metrics": metrics},
        "scoring_functions": [{"name": "TextDescriptors", "run": True, "parameters": {"prefix": "text"}}, {"name": "LevenshteinSimilarity", "run": True, "parameters": {"prefix": "near", "references": ["orange"]}}],
        "diversity_filter": {"run": bool(diversity), "name": diversity, "parameters": {"nbmax": 2, "minscore": 0.1}},
        **more,
    }
    if budget:
        raw["budget"] = budget
    return json.dumps(raw, indent="\t")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain(s):
    g = 1.0 if len(s) >= 6 else math.exp(-0.5 * ((len(s) - 6) / 2) ** 2)
    return (max(1e-6, g) + 2 * max(1e-6, 1 - edits(s, "orange") / 6)) / 3


def test_objectives_are_checked():
    o = parse(objective(budget=9, starting_population="a.smi"))
    assert o.task_key == "words" and o.budget == 9 and len(o.scored) == 2 and o.functions[0].prefix == "text"
    assert parse(objective(), diversity="Unique").diversity.name == "Unique"
    for bad in (objective(method="nope"), objective(modifier="nope"), objective(method="single")):
        with pytest.raises(ObjectiveError):
            parse(bad)
    with pytest.raises(ObjectiveError):
        plan.check(o, ["text_length"])


def test_objective_files(tmp_path):
    for n in ("2_b", "10_c", "1_a"):
        (tmp_path / f"{n}.json").write_text(objective(task=f"task {n}"))
    paths = select(str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in numbered(paths)] == ["1_a.json", "2_b.json", "10_c.json"]
    assert len(select(str(tmp_path), include=["1_a", "2_b"], exclude=["2_b"])) == 1
    with pytest.raises(ObjectiveError):
        select(str(tmp_path), include=["none"])
    assert load(paths[0]).task == load("mine:10_c", {"mine": str(tmp_path)}).task == "task 10_c"
    assert load("mine:task 1_a", {"mine": str(tmp_path)}).task_key == "task_1_a"
    with pytest.raises(ObjectiveError):
        load("mine:none", {"mine": str(tmp_path)})


def test_session_scores_and_remembers(spark, tmp_path):
    s = session.Session(spark, parse(objective(diversity="Unique")), str(tmp_path / "run"), replay_size=3)
    first = s.score(["Orange", "apple", None, "orange ", ""])
    # an invalid candidate's properties are 0, and so transformed; repeats are what the filter leaves
    invalid = (math.exp(-0.5 * 3**2) + 2e-6) / 3
    assert first == pytest.approx([plain("orange"), plain("apple"), invalid, 0.0, invalid])
    second = s.score(["grape", "APPLE", "plum"])
    assert second == pytest.approx([plain("grape"), 0.0, plain("plum")])
    log = {r.idx: r for r in s.log().collect()}
    assert sorted(log) == list(range(8)) and log[6].occurrences == 1 and log[6].Score == pytest.approx(plain("apple")) and not log[6].unique
    assert [r.smiles for r in s.replay.orderBy(F.desc("wsum")).collect()][0] == "orange"
    again = session.Session(spark, parse(objective(diversity="Unique")), str(tmp_path / "run"), resume=True)
    assert (again.step, again.rows) == (2, 8) and again.score(["plum"]) == [0.0]
    assert s.score_only(["orange", "apple"]) == pytest.approx([plain("orange"), plain("apple")])
    with pytest.raises(ValueError):
        s.score(["a"], mol_ids=["x", "y"])


def test_session_with_ids_scaffolds_and_extrema(spark, tmp_path):
    s = session.Session(spark, parse(objective(diversity="Scaffold")), str(tmp_path / "a"))
    got = s.score(["orb", "orc", "ord"], mol_ids=["x", "y", "x"])
    assert got[2] == pytest.approx(0.0, abs=1e-9) and got[0] > 0 and got[1] > 0
    assert [r.occurrences for r in s.log().orderBy("idx").collect()] == [0, 0, 1]
    # the bucket of the first letter is full, also for later batches
    assert s.score(["orange"])[0] == pytest.approx(0.0)

    o = json.loads(objective())
    o["scoring"]["metrics"][0] = {"name": "text_length", "modifier": "norm", "parameters": {"objective": "maximize"}}
    o["scoring"]["method"] = "amean"
    n = session.Session(spark, parse(json.dumps(o)), str(tmp_path / "b"))
    n.score(["ab", "abcdef"])
    assert n.extrema["text_length"] == (2.0, 6.0)
    n.score(["abcdefghij", ""])
    assert n.extrema["text_length"] == (0.0, 10.0)


def test_budgets_finish_and_metrics(spark, tmp_path):
    s = session.Session(spark, parse(objective(budget=5)), str(tmp_path / "run"))
    s.score(["a", "b", "c"])
    assert not s.finished
    s.score(["d", "orange"])
    assert s.finished
    got = {r.metric: r.value for r in s.metrics().collect()}
    assert got["Top-1 Avg Score"] == pytest.approx(1.0) and got["valid_ratio"] == 1.0
    t = session.Session(spark, replace(parse(objective()), termination_threshold=0.9), str(tmp_path / "t"))
    t.score(["zzzz"])
    assert not t.finished
    t.score(["orange"])
    assert t.finished


def test_benchmark_and_curriculum(spark, tmp_path):
    bench = session.Benchmark(spark, [parse(objective("one")), parse(objective("the other"))], str(tmp_path / "bench"), budget=4)
    for s in bench:
        while not s.finished:
            s.score(["orange", "pear"])
    rows = {r.task: r for r in bench.summary().collect()}
    assert set(rows) == {"one", "the_other"} and rows["one"]["Top-1 Avg Score"] == pytest.approx(1.0)
    assert spark.read.csv(f"{tmp_path}/bench/results.csv", header=True).count() == 2
    with pytest.raises(ValueError):
        session.Benchmark(spark, [], str(tmp_path)).summary()

    c = session.Curriculum(spark, [parse(objective("1", budget=2)), parse(objective("2", budget=3))], str(tmp_path / "c"), replay_size=2)
    c.score(["orange", "pear"])
    assert c.objective.task == "2" and not c.finished and c.replay.count() == 2
    c.score(["orange"])
    assert [r.occurrences for r in c.log().collect()] == [0], "the seen-set is the task's"
    c.score(["a", "b"])
    assert c.finished and tables.read_log(spark, c.path).count() == 5


def test_stream_is_scored_once(spark, tmp_path):
    words = ["orange", "apple", "orange", "pear", "plum", "apple"]
    for k in range(3):
        spark.createDataFrame([(2 * k + i, words[2 * k + i]) for i in range(2)], "idx long, smiles string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    like = spark.createDataFrame([], "idx long, smiles string")
    s = session.Session(spark, parse(objective(diversity="Unique")), str(tmp_path / "run"))
    source = spark.readStream.schema(like.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(live.score_stream(source, s, f"{tmp_path}/checkpoint"))
    log = s.log()
    assert log.count() == 6 and log.where("unique").count() == 4
    before = sorted(map(str, log.select("smiles", "occurrences", "Score").collect()))
    # a batch that comes again replaces itself
    import shutil

    shutil.rmtree(f"{tmp_path}/checkpoint/commits")
    live.drain(live.score_stream(source, s, f"{tmp_path}/checkpoint"))
    assert sorted(map(str, s.log().select("smiles", "occurrences", "Score").collect())) == before


def test_filtered_bundles(spark):
    df = spark.createDataFrame([(i, i // 10, i % 7 > 0, i % 5 > 0, (i * 37 % 100) / 100.0, i % 3, i % 2) for i in range(60)], "idx long, step int, valid boolean, unique boolean, s double, scaffold int, ok int")
    got = {r.metric: r.value for r in bundles.filtered_metrics(df, "s", 60, {"B-CF": "ok"}, threshold=0.5).collect()}
    good = [(i * 37 % 100) / 100 for i in range(60) if i % 7 and i % 5]
    assert got["Top-1 Avg s"] == max(good) and got["Yield s"] == pytest.approx(sum(x >= 0.5 for x in good) / 60)
    assert got["B-CF Top-1 Avg s"] == max((i * 37 % 100) / 100 for i in range(60) if i % 7 and i % 5 and i % 2)
    assert 0 < got["B-CF ratio"] < 1
    q = bundles.task_quality(df, "s", "ok", 10).first().value
    best = sorted(range(60), key=lambda i: (-(i * 37 % 100), i))[:10]
    assert q == pytest.approx(sum(i % 2 for i in best) / 10) and bundles.task_quality(df, "s", "ok", 100).first().value == 0.0


def test_tables(spark, tmp_path):
    lines = spark.createDataFrame([("CCO",), (None,), ("c1ccccc1",)], "smiles string")
    tables.write_lines(lines, f"{tmp_path}/a.smi", compression="gzip")
    assert sorted(r.smiles for r in tables.read_lines(spark, f"{tmp_path}/a.smi").collect()) == ["CCO", "c1ccccc1"]
    log = spark.createDataFrame([(0, "t", 1, True, 0.5), (1, "t", 2, False, 0.25)], "idx long, task string, step int, valid boolean, s double")
    tables.write_step(log, f"{tmp_path}/log")
    tables.write_step(log.where("step = 2").withColumn("s", F.lit(0.75)), f"{tmp_path}/log")
    assert [r.s for r in tables.read_log(spark, f"{tmp_path}/log", {"seed": 1}).orderBy("idx").collect()] == [0.5, 0.75]
    tables.write_scores(log, f"{tmp_path}/scores", {"seed": 7})
    back = tables.read_scores(spark, f"{tmp_path}/scores")
    assert dict(back.dtypes)["valid"] == "boolean" and {r.seed for r in back.collect()} == {7}
    tables.write_state(f"{tmp_path}/state", {"memory": log}, {"step": 3})
    state, values = tables.read_state(spark, f"{tmp_path}/state", ["memory"])
    assert state["memory"].count() == 2 and values == {"step": 3}
    tables.write_moments(spark, f"{tmp_path}/m", [1.0, 2.0], [[1.0, 0.0], [0.0, 1.0]])
    assert tables.read_moments(spark, f"{tmp_path}/m")[1].shape == (2, 2)
    (tmp_path / "r.csv").write_text("rule_id,pattern,max,description,rule_set\n1,a,0,x,s\n2,,0,y,s\n3,b,1,z,q\n")
    assert [r.rule_id for r in tables.read_rules(spark, f"{tmp_path}/r.csv", ["s"]).collect()] == [1]
    tables.write_memory(log, f"{tmp_path}/mem")
    tables.write_buffer(log, f"{tmp_path}/buffer")
    (tmp_path / "x.mol").write_text("name\nrest")
    got = tables.read_structures(spark, f"{tmp_path}/x.mol", lambda content, name: content.decode().split("\n")[0]).first()
    assert got.smiles == "name" and got.path.endswith("x.mol")
    assert spark.read.json(f"{tmp_path}/mem/json").count() == 2
    runs = log.withColumn("run", F.lit("a"))
    assert tables.drop_run(tables.rename_run(runs, "a", "b"), "b").count() == 0 and tables.new_rows(log, 0).count() == 1
    assert tables.melt(log, ["idx"], ["s"]).count() == 2


def test_mock_generator():
    strings = [f"string{k}" for k in range(100)]
    a, b = tables.MockGenerator(strings, 1), tables.MockGenerator(strings, 1)
    one = a.sample(50)
    assert one == b.sample(50) and len(one) == 50 and None in one and len(set(one)) < 50
    assert None not in tables.MockGenerator(strings, 1, flawed=False).sample(50)


def test_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-01 00:20:00", 1), ("2024-01-01 02:00:00", 1), ("2024-01-01 00:10:00", 2)], "t string, k int").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in live.sessions(e, "t", "30 minutes", "k", "1 hour", {"n": F.count("*")}).collect()) == [1, 1, 2]
    assert live.tumbling(e, "t", "1 hour", "1 hour", {"n": F.count("*")}).count() == 2
    assert live.tumbling(e, "t", "1 hour", "1 hour", {"n": F.count("*")}, slide="30 minutes").count() == 4
