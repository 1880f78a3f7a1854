import http.server
import json
import math
import sys
import threading

import pytest
from pyspark.sql import functions as F

from assayer.functions import aggregators as A
from assayer.functions import registry as R
from assayer.functions import similarity as S
from assayer.functions import text
from assayer.functions import transforms as T

NAN, INF = float("nan"), float("inf")
EDGES = [0.0, 4.9, 5.0, 7.5, 10.0, 10.1, 15.0, 20.0, 25.0, 30.0, -INF, INF, NAN, None]


def logistic(z):
    return 0.0 if z < -700 else 1 / (1 + math.exp(-z))


def ramp(distance, buffer):
    return 1.0 if distance <= 0 else 0.0 if distance >= buffer else 1 - distance / buffer


PLAIN = {
    ("lin_thresh", "maximize"): lambda x: ramp(20 - x, 10),
    ("lin_thresh", "minimize"): lambda x: ramp(x - 10, 10),
    ("lin_thresh", "range"): lambda x: ramp(10 - x, 10) if x < 10 else ramp(x - 20, 10),
    ("step", "maximize"): lambda x: float(x >= 20),
    ("step", "minimize"): lambda x: float(x <= 10),
    ("step", "range"): lambda x: float(10 <= x <= 20),
    ("gauss", "maximize"): lambda x: 1.0 if x >= 15 else math.exp(-0.5 * ((x - 15) / 4) ** 2),
    ("gauss", "minimize"): lambda x: 1.0 if x <= 15 else math.exp(-0.5 * ((x - 15) / 4) ** 2),
    ("gauss", "range"): lambda x: math.exp(-0.5 * ((x - 15) / 4) ** 2),
    ("sigmoid", "maximize"): lambda x: logistic(2 * (x - 20) + 5),
    ("sigmoid", "minimize"): lambda x: logistic(2 * (10 - x) + 5),
    ("sigmoid", "range"): lambda x: 1.0 if 10 <= x <= 20 else logistic(2 * (20 - x) + 5) if x > 20 else logistic(2 * (x - 10) + 5),
    ("norm", "maximize"): lambda x: (x - 10) / 20,
    ("norm", "minimize"): lambda x: (x - 30) / -20,
    ("raw", "maximize"): lambda x: x,
}


@pytest.mark.parametrize("name, mode", PLAIN)
def test_transforms(spark, name, mode):
    p = {"upper": 20, "lower": 10, "buffer": 10, "mu": 15, "sigma": 4, "scale": 2}
    if name == "norm":
        p |= {"min": 10, "max": 30}
    df = spark.createDataFrame([(x,) for x in EDGES], "x double")
    for x, r in zip(EDGES, df.select(T.transform(name, F.col("x"), objective=mode, **p).alias("y")).collect()):
        if x is None:
            assert r.y is None
        elif math.isnan(x):
            assert math.isnan(r.y)
        elif math.isinf(x) and name in ("norm", "raw"):
            assert math.isinf(r.y)
        else:
            assert r.y == pytest.approx(PLAIN[name, mode](x), abs=1e-12), x


def test_transform_errors_come_before_running():
    for name, mode in (("nothing", "maximize"), ("step", "sideways"), ("norm", "range")):
        with pytest.raises(T.ObjectiveError):
            T.transform(name, F.col("x"), objective=mode, min=0, max=1)


def test_norm_without_width_and_clip(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 0.0, -3.0, NAN, None)], "x double")
    assert [r[0] for r in df.limit(2).select(T.norm(F.col("x"), min=5, max=5)).collect()] == [0.0, 0.0]
    got = [r[0] for r in df.select(T.clip(F.col("x"))).collect()]
    assert got[:3] == [1.0, 1e-6, 1e-6] and math.isnan(got[3]) and got[4] is None


def test_aggregators(spark):
    x, w = (0.2, 0.5, 0.9), (1.0, 2.0, 0.5)
    df = spark.createDataFrame([x], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    got = df.select(*[A.aggregate(m, cols, w).alias(m) for m in ("amean", "gmean", "wsum", "prod", "wprod")]).first()
    assert got.amean == pytest.approx(sum(x) / 3) and got.gmean == pytest.approx(math.prod(x) ** (1 / 3))
    assert got.wsum == pytest.approx(sum(a * b for a, b in zip(x, w)) / 3.5) and got.prod == pytest.approx(math.prod(x))
    assert got.wprod == pytest.approx(math.prod(a**b for a, b in zip(x, w)) ** (1 / 3.5))
    assert df.select(A.aggregate("gmean", [], [])).first()[0] == 1.0 and df.select(A.product([])).first()[0] == 1.0
    with pytest.raises(T.ObjectiveError):
        A.aggregate("single", cols, w)
    with pytest.raises(T.ObjectiveError):
        A.aggregate("unknown", cols, w)


def test_auto_weights(spark):
    rows = [(1, 0.1, 0.9), (1, 0.7, 0.2), (1, 0.2, 0.8), (2, 0.1, 0.2), (2, 0.2, 0.7)]
    df = spark.createDataFrame(rows, "step int, a double, b double")
    got = {(r.step, r.a): r.s for r in A.auto_aggregate(df, "auto_wsum", ["a", "b"], ["step"], "s").collect()}
    assert got[1, 0.7] == pytest.approx((0.7 * 2 + 0.2 * 0.5) / 2.5)
    assert math.isnan(got[2, 0.1]), "a column that never reaches 0.5 has infinite weight"
    w = A.auto_weights(df, ["a"], ["step"])["a"]
    assert {r.step: r.w for r in df.select("step", w.alias("w")).collect()} == {1: 2.0, 2: INF}


def test_similarity_of_bits(spark):
    df = spark.createDataFrame([([0, 5, 63, 64, 200], [0, 64, 201])], "x array<int>, y array<int>")
    df = df.select(S.words_from_bits(F.col("x"), 128).alias("x"), S.words_from_bits(F.col("y"), 128).alias("y"))
    r = df.select(S.on_bits(F.col("x")).alias("a"), S.on_bits(F.col("y")).alias("b"), S.common_bits(F.col("x"), F.col("y")).alias("c"), S.bit_similarity(F.col("x"), F.col("y"), "Dice", 128).alias("d")).first()
    assert (r.a, r.b, r.c) == (5, 3, 2) and r.d == pytest.approx(4 / 8)
    empty = spark.range(1).select(F.array(F.lit(0).cast("long")).alias("e"))
    got = empty.select(*[c.alias(k) for k, c in S.measures(S.on_bits(F.col("e")), S.on_bits(F.col("e")), S.common_bits(F.col("e"), F.col("e")), 64).items()]).first()
    assert got.Tanimoto == 0.0 and got.AllBit == 1.0


def test_isomer_and_counts(spark):
    df = spark.createDataFrame([("C9H10N2O2PF2Cl",), ("C",), ("",)], "f string")
    got = [r[0] for r in df.select(S.formula_counts(F.col("f"))).collect()]
    assert got[0] == {"C": 9, "H": 10, "N": 2, "O": 2, "P": 1, "F": 2, "Cl": 1} and got[1] == {"C": 1} and got[2] == {}
    target = {"C": 9, "H": 10, "N": 2, "O": 2, "P": 1, "F": 2, "Cl": 1}
    assert df.select(S.isomer_score(F.col("f"), target)).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        S.count_similarity(F.col("a"), F.col("b"), "Cosine")


def test_text(spark):
    df = spark.createDataFrame([("  A  b\tC ",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.canonical(F.col("s"))).collect()] == ["a b c", None, None]
    assert [r[0] for r in df.select(text.match_any(F.col("s"), ["b", "q"])).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(text.match_all(F.col("s"), ["b", "q"])).collect()] == [0, 0, 0]
    assert df.select(text.descriptors(F.col("s"))["length"]).collect()[2][0] == 0.0


def test_patterns_as_sql_engines_read_them(spark):
    df = spark.createDataFrame([("mentioné",), ("nation.",), ("nationx",), ("sea\rwater",), ("sea\nwater",), ("a\\bé",)], "s string")
    one = lambda p: [r[0] for r in df.select(text.match_any(F.col("s"), [p])).collect()]
    assert one("tion\\b") == [1, 1, 0, 0, 0, 0]
    assert one("tion\\B") == [0, 0, 1, 0, 0, 0]
    assert one("ea.*er") == [0, 0, 0, 1, 0, 0]
    assert one("a\\\\b") == one("\\Qa\\b\\E") == [0, 0, 0, 0, 0, 1]
    assert [r[0] for r in df.select(text.match_all(F.col("s"), ["tion\\b", "^m"])).collect()] == [1, 0, 0, 0, 0, 0]
    assert df.select(text.match_any(F.col("s"), []), text.match_all(F.col("s"), [])).first()[:] == (0, 1)


def test_pattern_filter_as_sql_engines_read_it(spark):
    df = spark.createDataFrame([("mentioné",), ("sea\rwater nation",), ("nationx",), (None,)], "s string")
    ok, names = text.pattern_filter(F.col("s"), ["ea.*er", "tion\\b"])
    assert [tuple(r) for r in df.select(ok, names).collect()] == [(0, "tion\\b"), (0, "ea.*er,tion\\b"), (1, ""), (1, "")]
    assert df.select(*text.pattern_filter(F.col("s"), [])).first()[:] == (1, "")


def test_registry_degrades_and_checks(spark):
    with pytest.raises(T.ObjectiveError):
        R.REGISTRY.get("Nothing")
    reg = R.Registry()
    reg.optional("Missing", lambda: __import__("no_such_library"))
    with pytest.raises(T.ObjectiveError, match="no_such_library"):
        reg.get("Missing")


def test_arrow_function_runs_once_per_string_and_fills(spark):
    f = R.ScoringFunction("Len", ("n", "odd"), lambda **_: lambda xs: [{"n": len(x)} for x in xs], "arrow", -1.0)
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, "b")], "i int, smiles string")
    got = {r.i: (r.x_n, r.x_odd) for r in R.apply(df, f, "x").collect()}
    assert got == {1: (2.0, -1.0), 2: (2.0, -1.0), 3: (-1.0, -1.0), 4: (1.0, -1.0)}


def test_command_function(spark):
    code = "import sys, json\nfor s in sys.stdin.read().split('\\n'): print(json.dumps({'n': len(s)}))"
    df = spark.createDataFrame([("abc",), ("de",)], "smiles string")
    ok = R.command_function("cmd", [sys.executable, "-c", code], ("n",))
    assert sorted(r.p_n for r in R.apply(df, ok, "p").collect()) == [2.0, 3.0]
    slow = R.command_function("cmd", [sys.executable, "-c", "import time; time.sleep(9)"], ("n",), timeout=0.3, default=0.5)
    assert {r.p_n for r in R.apply(df, slow, "p").collect()} == {0.5}


def test_http_function(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            out = json.dumps([{"n": len(s)} for s in body["smiles"]]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("abc",), ("de",)], "smiles string")
    f = R.http_function("web", f"http://127.0.0.1:{server.server_port}/", ("n",))
    assert sorted(r.p_n for r in R.apply(df, f, "p").collect()) == [2.0, 3.0]
    server.shutdown()
    gone = R.http_function("web", "http://127.0.0.1:9/", ("n",), timeout=1)
    assert {r.p_n for r in R.apply(df, gone, "p").collect()} == {0.0}


def test_best_variant(spark):
    df = spark.createDataFrame([("m", 1, -5.0), ("m", 2, -7.0), ("m", 3, -7.0), ("n", 1, None)], "mol string, v int, score double")
    got = {r.mol: (r.v, r.score) for r in R.best_variant(df, ["mol"], "score", "v").collect()}
    assert got == {"m": (2, -7.0), "n": (1, 0.0)}


def test_expand_and_failures(spark):
    def make(s):
        if s == "bad":
            raise ValueError
        return [{"name": s * 2, "e": 1.5}, {"name": s}]

    df = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "k string")
    got = sorted(tuple(r) for r in R.expand(df, "k", make, {"name": "string", "e": "double"}).collect())
    assert got == [("a", 0, "aa", 1.5), ("a", 1, "a", None)]


def test_structure_functions_need_their_toolkit():
    try:
        import rdkit  # noqa: F401
    except ImportError:
        assert "StructureDescriptors" in R.REGISTRY.missing and "rdkit" in R.REGISTRY.missing["StructureDescriptors"]
        from assayer.functions import chemistry

        with pytest.raises(ImportError):
            chemistry.producers()


def test_model_aggregates_and_own_methods(spark):
    df = spark.createDataFrame([([0.2, None, 0.8, 0.6],)], "x array<double>")
    assert df.select(A.ensemble(F.col("x"))).first()[0] == pytest.approx(1.6 / 3)
    with pytest.raises(T.ObjectiveError):
        A.multi_target(F.col("x"), "mode")
    A.register("smallest", lambda x, w: F.least(*x))
    assert spark.range(1).select(A.aggregate("smallest", [F.lit(0.3), F.lit(0.2)], [1, 1])).first()[0] == 0.2
    with pytest.raises(T.ObjectiveError):
        A.register("smallest", None)
    del A.ROW["smallest"]
