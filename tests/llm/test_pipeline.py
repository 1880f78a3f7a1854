import corpus_pipeline as P
from assayer.llm import decontaminate, quality_rules, simhash
from assayer.llm.common import read
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_quality_rules import brute as brute_stats
from tests.llm.test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "source_mixing"]
    docs = read(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]

    one = P.quality(spark, docs, SF)
    kept = {r.doc_id for r in quality_rules.quality_report(docs).collect() if r.kept}
    for d, r in rows.items():
        n, _, _, _, repeat = brute_stats(r.text)
        assert d not in kept or (n >= 10 and 100 * repeat <= 20 * n)
    assert {r.doc_id for r in one.collect()} == kept

    two = P.deduplicate(spark, one, SF)
    ids = sorted(kept)
    left = {ids[k] for k in brute_kept([rows[d].text for d in ids])}
    copies = simhash.simhash_components(one).where("doc_id <> component_id").count()
    assert len(kept) - len(left) >= copies  # near copies beyond the fingerprints' reach go too
    assert {r.doc_id for r in two.collect()} == left

    three = P.decontaminate(spark, two, SF)
    leaks = {d for d, _ in brute_leaks([(d, rows[d].text) for d in sorted(left)], bench)}
    assert leaks and {r.doc_id for r in three.collect()} == left - leaks

    four = P.mask_secrets(spark, three, SF)
    assert {r.doc_id for r in four.collect()} == left - leaks
    for stage in (one, two, three, four):
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes

    five = P.mix_sources(spark, four, SF)
    got = P.run(spark, SF)
    assert got.columns == five.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, five.collect()))
    assert {r.doc_id for r in got.collect()} == left - leaks


def test_stages_on_odd_tables(spark, docs, odd, tmp_path):
    spark.createDataFrame([(1, "What is it that they do there all day long? Nobody knows.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [*odd, (None, None, None, None), (5, odd[5], "en", "src0")]):
        df = docs(rows).selectExpr("*", "1 as key", "2 as mix_slot", "map(1, 2) as extra")
        for _, stage in P.STAGES:
            out = stage(spark, df, str(tmp_path))
            assert [c for c in df.columns if c != "mix_slot"] == [c for c in out.columns if not c.startswith("mix_")]
            df = out
        assert df.count() <= len(rows)
    assert decontaminate.OVERLAP == 0.8
