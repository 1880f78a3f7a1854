"""Secret scans: patterns, and a randomness test battery with false-discovery control.

Three patterns find labelled secrets. Beside them, every long token of an encoding
alphabet is tested for looking uniformly random: a chi-squared test over the
inferred encoding's alphabet, a runs test about the alphabet's middle and a
lag-one serial correlation. The three p-values are combined by Sidak's rule.

Random tokens have uniform p-values, ordinary ones pile up near zero. Short tokens
have little power, so each encoding and length band is its own stratum: from the
count of p-values above one half, which ordinary tokens rarely reach, the number
of random tokens is estimated, and the smallest cutoff is taken above which the
estimated share of ordinary ones is at most `rate` (q). P-values are counted in
bins, so a stratum is a fixed number of counts however many tokens it has. A token
counts once however often it occurs, and not where a labelled find covers it.

All of it is column expressions, one aggregate and one join with a table of
thresholds whose size is fixed by the number of strata.

Defined results: a null text is empty; texts without finds have counts 0, empty
spans and the digest of the empty string; very long texts are scanned whole; of
patterns that match at one place each kind has its own span; p-values of one bin are
flagged or not together; repeated rows stay; an empty table gives an empty result;
other columns, whatever their names, come back or aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import cut, let

#: The patterns of the base kinds, the group whose length counts and its least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: What a text has to contain, in lower case, for a pattern to be worth running.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "hex": ()}
#: A token of the battery: a whole run of encoding characters, 20 or more, also right after '='.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
BINS = 20


@dataclass(frozen=True)
class Encoding:
    name: str
    pattern: str
    alphabet: str


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: From the narrowest; a token belongs to the first whose pattern it matches whole.
#: Each asks for a letter and a digit, or both cases with a digit: words alone are in none.
ENCODINGS = (
    Encoding("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    Encoding("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    Encoding("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+={0,2}$", _UPPER + "234567"),
    Encoding("alnum36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _LOWER),
    Encoding("ALNUM36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGITS + _UPPER),
    Encoding("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+={0,2}$", _DIGITS + _UPPER + _LOWER),
    Encoding("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/_-]+={0,2}$", _UPPER + _LOWER + _DIGITS + "+/"),
)


def running(values: Column, zero, merge) -> Column:
    """For each value, the fold of those before it.

    In blocks of about the square root of their number, so that a text with very
    many matches doesn't take a step for every pair of them.
    """
    start = F.lit(zero)
    fold = lambda a: F.aggregate(a, start, merge)

    def of(v: Column) -> Column:
        width = F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"))
        whole = lambda i, w: F.floor(i / w).cast("int")
        blocks = lambda w: F.transform(F.sequence(F.lit(0), whole(F.greatest(F.size(v) - 1, F.lit(0)), w)), lambda k: fold(F.slice(v, k * w + 1, w)))
        return let(width, lambda w: let(blocks(w), lambda f: F.transform(v, lambda _, i: merge(fold(F.slice(f, F.lit(1), whole(i, w))), fold(F.slice(v, whole(i, w) * w + 1, i % w))))))

    return let(values, of)


def matches(text: Column, kind: str, order: int, pattern: str, hints=()) -> Column:
    """The pattern's leftmost matches that don't overlap, as array of (start, order, kind, end, found).

    The text between matches is what a split by the same pattern leaves, so the
    running length of both gives the offsets, in code points.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,found:string>>")

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (start + F.length(x["found"])).alias("end"), x["found"].alias("found"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found")), lambda x: x["found"].isNotNull())
    sizes = lambda p: F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["found"]))
    spans = let(pairs, lambda p: F.zip_with(p, running(sizes(p), 0, lambda a, n: a + n), span))
    if hints:
        low = F.lower(text)
        hit = F.lit(False)
        for h in hints:
            hit |= low.contains(h)
        return F.when(hit, spans).otherwise(empty)
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _long_enough(pattern: str, group: int, least: int):
    return lambda x: F.length(F.regexp_extract(x["found"], pattern, group)) >= least


def base_matches(text: Column) -> dict[str, Column]:
    """The base kinds' spans, without those that are too short."""
    out = {}
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        spans = matches(text, kind, order, pattern, HINTS[kind])
        out[kind] = F.filter(spans, _long_enough(pattern, group, least))
    return out


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the published rational form (error below 1e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def token_p_value(found: Column, size: Column, alphabet: Column) -> Column:
    """Sidak's p-value of the smallest of the three tests for a token over an alphabet of `size` characters."""
    half = size / F.lit(2.0)
    # positions in the alphabet; padding and the two spare characters of the other base64 style count as their twins
    plain = F.translate(F.regexp_replace(found, "=+$", ""), "-_", "+/")

    def battery(v: Column) -> Column:
        n = F.size(v).cast("double")
        moments = F.struct(n.alias("n"), (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n).alias("mean"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x).alias("square"))
        return let(moments, lambda m: let(sums(v, m), lambda r: let(z_values(m, r), p_value)))

    def sums(v: Column, m: Column) -> Column:
        rest = F.greatest(F.size(v) - 1, F.lit(1))
        pairs = F.zip_with(F.slice(v, F.lit(1), rest), F.slice(v, F.lit(2), rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.coalesce((p["a"] - m["mean"]) * (p["b"] - m["mean"]), F.lit(0.0)))
        changes = F.size(F.filter(pairs, lambda p: (p["a"] < half) != (p["b"] < half))).cast("double")
        counts = F.transform(F.array_distinct(v), lambda c: F.size(F.filter(v, lambda x: x == c)).cast("double"))
        return F.struct(lagged.alias("lagged"), changes.alias("changes"), F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c).alias("squares"))

    def z_values(m: Column, r: Column) -> Column:
        n = m["n"]
        chi = (r["squares"] * size / n - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)
        runs = F.abs((r["changes"] - (n - 1) / 2.0) / F.sqrt((n - 1) / 4.0))
        spread = m["square"] - n * m["mean"] * m["mean"]
        serial = F.when(spread > 1e-9, F.abs(r["lagged"] / spread * F.sqrt(n))).otherwise(F.lit(40.0))
        return F.array(chi, runs, serial)

    def p_value(z: Column) -> Column:
        # the first test is one-sided, the others two-sided
        tails = F.transform(z, lambda x, i: normal_tail(x) * F.when(i == 0, 1.0).otherwise(2.0))
        return 1.0 - F.pow(1.0 - F.least(F.lit(1.0), F.array_min(tails)), F.lit(3.0))

    places = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
    return let(places, battery)


def _encoding(found: Column) -> Column:
    out = F.lit(None).cast("struct<name:string,size:int,alphabet:string>")
    for e in reversed(ENCODINGS):
        mine = F.struct(F.lit(e.name).alias("name"), F.lit(len(e.alphabet)).alias("size"), F.lit(e.alphabet).alias("alphabet"))
        out = F.when(found.rlike(e.pattern), mine).otherwise(out)
    return out


def _stratum(encoding: Column, length: Column) -> Column:
    """Encoding and length band; bands double: 20-27, 28-39, 40-55, 56-79, then 80 and more."""
    band = F.when(length < 28, 0).when(length < 40, 1).when(length < 56, 2).when(length < 80, 3).otherwise(4)
    return F.concat(encoding, F.lit(":"), band.cast("string"))


def tested(text: Column) -> Column:
    """The battery's tokens of a text, as array of (start, end, stratum, bin, token): bin b holds p in [b, b+1)/BINS, token is a hash."""

    def one(x: Column) -> Column:
        return let(_encoding(x["found"]), lambda e: F.struct(x["start"].alias("start"), x["end"].alias("end"), _stratum(e["name"], F.length(x["found"])).alias("stratum"),
            F.least(F.floor(token_p_value(x["found"], e["size"], e["alphabet"]) * BINS).cast("int"), F.lit(BINS - 1)).alias("bin"), F.xxhash64(x["found"]).alias("token")))

    return F.filter(F.transform(matches(text, "random", len(BASE), TOKEN), one), lambda t: t["stratum"].isNotNull())


def cutoffs(counts: DataFrame, rate: float) -> DataFrame:
    """(stratum, least): the lowest bin that may be flagged in each stratum.

    counts: (stratum, bin, n). With r random tokens, each bin holds r / BINS of
    them; the upper half of the bins is taken to hold few others. Going down from
    the top, all bins from b on are flagged while (n - r * share) / n stays within
    `rate`, n being all tokens there; a stratum whose upper half is empty flags
    nothing.
    """
    grid = counts.select("stratum").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    full = grid.join(counts, ["stratum", "bin"], "left").fillna(0, ["n"])
    per = full.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))  # BINS entries each
    upper = F.aggregate(F.filter("bins", lambda b: b["bin"] >= BINS // 2), F.lit(0).cast("long"), lambda s, b: s + b["n"])
    per = per.withColumn("random", 2.0 * upper)

    def share(b: Column) -> Column:
        above = F.aggregate(F.filter("bins", lambda x: x["bin"] >= b["bin"]), F.lit(0).cast("long"), lambda s, x: s + x["n"])
        extra = above - F.col("random") * (BINS - b["bin"]) / BINS
        return F.struct(b["bin"].alias("bin"), (extra <= rate * above).alias("fine"))

    fine = F.filter(F.transform("bins", share), lambda x: x["fine"])
    return per.where("random > 0").select("stratum", F.coalesce(F.array_min(F.transform(fine, lambda x: x["bin"])), F.lit(BINS // 2)).alias("least"))


def _free(tokens: Column, spans: Column) -> Column:
    """The tokens that overlap none of the spans."""
    return F.filter(tokens, lambda t: ~F.exists(spans, lambda k: (k["start"] < t["end"]) & (t["start"] < k["end"])))


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Every row of `docs` as struct `row`, with `text` (null as empty) and `spans`.

    spans: array of (start, order, kind, end), sorted. The battery's spans are of
    kind random; those that overlap a base span are left out, as it stays.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    found = docs.select(F.struct("*").alias("row")).withColumn("text", text)
    base = base_matches(F.col("text"))

    def uncovered(tokens: Column) -> Column:
        known = F.transform(F.concat(*base.values()), lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end")))
        return F.when(F.size(tokens) > 0, let(known, lambda spans: _free(tokens, spans)))

    # each token counts once, however often it is copied
    counts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.explode(let(tested(F.col("text")), uncovered)).alias("t"))
    counts = counts.select("t.stratum", "t.bin", "t.token").distinct().groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    least = cutoffs(cut(counts), rate).collect()  # a row for each stratum: encodings times bands
    found = found.select("row", "text", *[F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["kind"].alias("kind"), x["end"].alias("end"))).alias(k) for k, c in base.items()])
    labelled = F.concat(*base)
    if least:
        table = F.create_map(*[F.lit(v) for r in least for v in (r["stratum"], int(r["least"]))])

        def flagged(known: Column) -> Column:
            hot = F.filter(tested(F.col("text")), lambda t: t["bin"] >= F.coalesce(F.try_element_at(table, t["stratum"]), F.lit(BINS)))
            extra = F.transform(_free(hot, known), lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("order"), F.lit("random").alias("kind"), t["end"].alias("end")))
            return F.sort_array(F.concat(known, extra))

        return found.withColumn("spans", let(labelled, flagged))
    return found.withColumn("spans", F.sort_array(labelled))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of `docs` (doc_id, text)."""
    s = scan(docs.select("doc_id", "text"), rate)
    base = F.sort_array(F.concat(*[F.col(k) for k in BASE]))
    return s.select(
        F.col("row.doc_id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").alias("n_spans"),
    )


def secrets_masked(docs: DataFrame, rate: float = 0.05, mask: str = "[SECRET]") -> DataFrame:
    """The rows of `docs` with every span replaced by `mask`, all columns as before.

    Overlapping spans are masked once, from the first start to the last end. A
    column n_chars, if there is one, is brought up to date on changed rows.
    Unchanged rows, null texts among them, come back as they were.
    """
    s = scan(docs, rate)

    text = F.col("text")
    reach = running(F.transform("spans", lambda x: x["end"]), 0, lambda a, b: F.greatest(a, b))
    piece = lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), F.lit(mask))).otherwise("")
    rest = F.substring(text, F.array_max(F.transform("spans", lambda x: x["end"])) + 1, F.length(text))
    masked = F.concat(F.array_join(F.zip_with("spans", reach, piece), ""), rest)
    s = s.select("row", F.when(F.size("spans") > 0, masked).alias("masked"))
    names = docs.columns
    kind = dict(docs.dtypes)
    out = []
    for c in names:
        old = F.col("row").getField(c)
        if c == "text":
            out.append(F.coalesce("masked", old.cast("string")).alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("masked").isNotNull(), F.length("masked").cast(kind[c])).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return s.select(*out)


def oracle_sql(rate: float = 0.05) -> str:
    """DuckDB SQL for `secret_report` over `documents` with unique doc_ids.

    Offsets are running sums over what a split by each pattern leaves. The battery's
    tokens, which the main path finds by looking around them, are whole runs of
    encoding characters here, with the '=' that follow, and none where another run
    follows these.
    """

    def found(name: str, pattern: str) -> str:
        p = pattern.replace("'", "''")
        return rf"""{name}_m AS (SELECT doc_id, unnest(f) AS found, unnest(g[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS f, regexp_split_to_array(text, '{p}') AS g FROM d)),
{name} AS (SELECT doc_id, found, coalesce(lead(gap) OVER w = '', false) AS joined, (sum(length(gap)) OVER w + sum(length(found)) OVER w - length(found))::BIGINT AS s, (sum(length(gap)) OVER w + sum(length(found)) OVER w)::BIGINT AS e FROM {name}_m WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""

    parts = [found(k, p) for k, (p, _, _) in BASE.items()] + [found("run", "[A-Za-z0-9+/_-]+=*")]
    assign = BASE["assign"][0].replace("'", "''")
    needs = {"hex": ("[0-9]", "[a-f]"), "HEX": ("[0-9]", "[A-F]"), "base32": ("[2-7]", "[A-Z]"), "alnum36": ("[0-9]", "[a-z]"), "ALNUM36": ("[0-9]", "[A-Z]")}
    every = ("[0-9]", "[a-z]", "[A-Z]")
    whole = {e.name: "^" + e.pattern.rpartition(")")[2] for e in ENCODINGS}
    test = lambda e: " AND ".join(f"regexp_matches(found, '{p}')" for p in (*needs.get(e.name, every), whole[e.name]))
    case = lambda value: "CASE " + " ".join(f"WHEN {test(e)} THEN {value(e)}" for e in ENCODINGS) + " END"
    tail = "0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(parts)},
base AS (SELECT doc_id, s, 0 AS o, 'assign' AS kind, e FROM assign WHERE length(regexp_extract(found, '{assign}', 2)) >= 6
  UNION ALL SELECT doc_id, s, 1, 'access', e FROM access UNION ALL SELECT doc_id, s, 2, 'hex', e FROM hex),
token AS (SELECT doc_id, s, e, found, {case(lambda e: f"'{e.name}'")} AS enc, {case(lambda e: f"'{e.alphabet}'")} AS alphabet FROM run WHERE regexp_matches(found, '^[A-Za-z0-9+/_-]{{20,}}={{0,2}}$') AND NOT (joined AND suffix(found, '='))),
coded AS (SELECT doc_id, s, e, found, enc || ':' || CASE WHEN length(found) < 28 THEN 0 WHEN length(found) < 40 THEN 1 WHEN length(found) < 56 THEN 2 WHEN length(found) < 80 THEN 3 ELSE 4 END AS stratum, length(alphabet)::DOUBLE AS k,
  list_transform(string_split(translate(regexp_replace(found, '=+$', ''), '-_', '+/'), ''), lambda c: (instr(alphabet, c) - 1)::DOUBLE) AS v FROM token WHERE enc IS NOT NULL),
moment AS (SELECT *, len(v)::DOUBLE AS n, list_sum(v) / len(v) AS mean, list_sum(list_transform(v, lambda x: x * x)) AS square FROM coded),
sums AS (SELECT *, coalesce(list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - mean) * (v[i + 1] - mean))), 0) AS lagged,
  len(list_filter(range(1, len(v)), lambda i: (v[i] < k / 2) <> (v[i + 1] < k / 2))) AS changes, list_sum(list_transform(list_distinct(v), lambda c: len(list_filter(v, lambda x: x = c)) ** 2)) AS squares FROM moment),
zs AS (SELECT *, (squares * k / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z1, abs((changes - (n - 1) / 2) / sqrt((n - 1) / 4)) AS z2,
  CASE WHEN square - n * mean * mean > 1e-9 THEN abs(lagged / (square - n * mean * mean) * sqrt(n)) ELSE 40 END AS z3 FROM sums),
tails AS (SELECT doc_id, s, e, found, stratum, list_transform([z1, z2, z3], lambda y: [y, abs(y), 1 / (1 + 0.3275911 * abs(y) / sqrt(2))]) AS q FROM zs),
ps AS (SELECT doc_id, s, e, found, stratum, list_transform(q, lambda y: [y[1], {tail.replace("z * z", "y[2] * y[2]").replace("t *", "y[3] *")}]) AS q FROM tails),
binned AS (SELECT doc_id, s, e, found, stratum, least(floor((1 - pow(1 - least(1, CASE WHEN q[1][1] >= 0 THEN q[1][2] ELSE 1 - q[1][2] END, 2 * q[2][2], 2 * q[3][2]), 3)) * {BINS}), {BINS - 1})::INT AS bin FROM ps),
free AS (SELECT * FROM binned b WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = b.doc_id AND x.s < b.e AND b.s < x.e)),
kinds AS (SELECT DISTINCT stratum, bin, found FROM free),
hist AS (SELECT g.stratum, g.b AS bin, count(x.bin) AS n FROM (SELECT DISTINCT stratum, b FROM kinds, range({BINS}) r(b)) g LEFT JOIN kinds x ON x.stratum = g.stratum AND x.bin = g.b GROUP BY ALL),
above AS (SELECT stratum, bin, sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) AS a, 2.0 * sum(n) FILTER (bin >= {BINS // 2}) OVER (PARTITION BY stratum) AS r FROM hist),
least_bin AS (SELECT stratum, coalesce(min(bin) FILTER (a - r * ({BINS} - bin) / {BINS} <= {rate} * a), {BINS // 2}) AS least FROM above WHERE r > 0 GROUP BY stratum),
random AS (SELECT doc_id, s, 3 AS o, 'random' AS kind, e FROM free JOIN least_bin USING (stratum) WHERE bin >= least),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM random),
joined AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, count(*) AS n,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0)::INT AS n_spans FROM d LEFT JOIN joined USING (doc_id)
"""
