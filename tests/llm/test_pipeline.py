import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from opsloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    """Each stage against what it says it does, on the stage before it."""
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    sizes = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF).persist()
        sizes.append((name, docs.count(), out.count()))
        assert out.columns[: len(columns)] == columns
        assert out.join(docs, "doc_id", "left_anti").isEmpty()
        docs = out
    kept = {name: (a, b) for name, a, b in sizes}
    assert kept["toxicity"][1] < kept["toxicity"][0] and kept["ngram_jaccard"][1] < kept["ngram_jaccard"][0]
    assert kept["decontaminate"][1] < kept["decontaminate"][0]
    assert kept["secret_scan"][0] == kept["secret_scan"][1] and kept["bpe"][0] == kept["bpe"][1]
    assert docs.where(~F.col("round_trip")).isEmpty()
    assert docs.where(F.col("text").rlike("[0-9a-f]{24,}")).isEmpty()
    assert docs.groupBy("text").count().where("count > 1").isEmpty()


def test_run_gives_the_last_stage(spark):
    assert pipeline.run(spark, SF).columns[-3:] == ["token_ids", "n_tokens", "round_trip"]


def test_rows_without_an_id(spark):
    docs = table(spark, SF, "documents").limit(20)
    item = table(spark, SF, "benchmark").where(F.length("text") > 60).first()["text"]
    texts = ["a text of its own that nobody else has written down so far", f"so it goes. {item} and so on"]
    nameless = [docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit(t)) for t in texts]
    docs = docs.unionByName(nameless[0]).unionByName(nameless[1])
    kept = pipeline.one_of_each_group(spark, docs, SF).where("doc_id is null")
    assert {r["text"] for r in kept.collect()} == set(texts)
    assert [r["text"] for r in pipeline.without_benchmark(spark, docs, SF).where("doc_id is null").collect()] == texts[:1]
