"""Only findings that can restate one another are compared; norms read the findings once."""

from pitlens.operators import norms

SCHEMA = "finding_id long, entity_id long, finding_type string, document_id string, occurred_at long, summary string"


def test_what_no_other_document_shows_is_not_compared(spark):
    rows = [(1, 1, "notable_quote", "a", 1, "margin court 5"), (2, 1, "notable_quote", "b", 2, "margin court 5"), (3, 1, "notable_quote", "b", 3, "margin court 6"),
            (4, 2, "notable_quote", "c", 3, "margin court 5"), (5, 1, "guidance_change", "a", 1, "margin 7"), (6, 1, "guidance_change", "b", 1, "margin 7")]
    d = spark.createDataFrame(rows, SCHEMA)
    kept, blank = norms._comparable(d, ["entity_id", "finding_type"], "true")
    assert {r.finding_id for r in kept.collect()} == {1, 2} and not blank
    assert {r.finding_id for r in norms.restated(d).collect()} == {2}
    asked = d.unionByName(spark.createDataFrame([(7, 1, "notable_quote", "z", 9, "margin court")], SCHEMA))
    kept, blank = norms._comparable(asked, ["entity_id", "finding_type"], "true")
    assert {r.finding_id for r in kept.collect()} == {1, 2, 3, 7} and blank
    assert {r.finding_id for r in norms.restated(asked).collect()} == {2, 7}


def test_norms_read_the_findings_once(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([(1, "A", "10-K", "x", 1.0, "d"), (2, "A", "10-Q", "y", -1.0, "e")] * 8, "entity_id long, sector string, genre string, finding_type string, sign double, document_id string").write.parquet(path)
    d = spark.read.parquet(path)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (*norms.measure_norms(d).values(), *norms.measure_incidence(norms.document_counts(d)))]
    assert not any("parquet" in p for p in plans)
