"""The pipeline, stage by stage against the operators' own results on the smallest tables."""

import corpus_pipeline
from tesserspark.llm import queries
from tesserspark.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in queries.op8_quality(spark, SF).collect() if r.kept}
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    a = materialize(one(spark, docs, SF), "t")
    assert {r.doc_id for r in a.select("doc_id").collect()} == kept and a.columns == docs.columns
    b = materialize(two(spark, a, SF), "t")
    from tesserspark.llm import decontamination, simhash
    from tests.llm.test_near_copies import brute

    # one of each group by fingerprint, and of those one of each group by five-word shingles
    text = {r.doc_id: r.text for r in a.collect()}
    heads = set(brute([(i, text[i]) for i in sorted({r.component_id for r in simhash.near_duplicates(a).collect()})]))
    assert {r.doc_id for r in b.select("doc_id").collect()} == heads and b.count() == len(heads)
    c = materialize(three(spark, b, SF), "t")
    bad = {r.doc_id for r in decontamination.decontaminate(b, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert {r.doc_id for r in c.select("doc_id").collect()} == heads - bad
    d = materialize(four(spark, c, SF), "t")
    assert d.columns == docs.columns and d.count() > 0
    e = five(spark, d, SF)
    assert e.count() == d.count() and {"shard", "slot"} <= set(e.columns)
    assert corpus_pipeline.run(spark, SF).count() == d.count()


def test_every_query_runs(spark):
    for name, query in queries.QUERIES.items():
        if name != "pipeline":
            assert query(spark, SF).count() > 0, name


def test_stages_on_empty_and_odd_tables(spark):
    """Nulls in any column, empty texts, rows that repeat in full, clashing names, and no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "a b c", "en", None, 5), (3, "a b c", "en", None, 5), (None, "a b c", "en", "s", 5)], docs.schema)
    extra = odd.selectExpr("*", "1 AS shard", "'x' AS __key", "2 AS copies", "'y' AS mark", "3 AS fp")
    for table in (odd, extra):
        for name, stage in corpus_pipeline.STAGES:
            for part in (table, table.where("false")):
                out = stage(spark, part, SF)
                rows = out.collect()
                if name != "sharding":
                    assert out.columns == table.columns
                else:
                    assert len(rows) == part.count() and {"shard", "slot"} <= set(out.columns)
                if part is not table:
                    assert rows == []
