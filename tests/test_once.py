"""What a scan does once: a line is parsed once, and a reader of one list opens that list's files alone."""

from tracemill import mined_queries
from tracemill.sources import transcripts


def test_a_line_is_parsed_once(spark):
    raw = ["{}", ' {"a":1} ', "\t{\"a\":2}", "[1]", "1", "", " ", '{"a":', '"{}"', "null", None]
    rows = transcripts.records(spark.createDataFrame([(n, r) for n, r in enumerate(raw)], "line int, raw string"))
    assert sorted(r.line for r in rows.collect()) == [0, 1, 2]
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson") == 1


def test_lists_have_files_of_their_own(spark, sf_dir):
    found = mined_queries.mined(spark, sf_dir)[1]
    plan = found.where("list = 'slash'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "PartitionFilters: []" not in plan.split("/evidence-")[1][:400]
