"""Each operator and each stage of the pipeline on nulls in any column, empty and very long texts, ties, repeated rows, empty
tables, and columns whose names clash with the operators' own."""

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from opsloom.llm import bpe, decontaminate, html_extract, jaccard_join, language_id, paragraph_dedup, quality_classifier, quality_rules, secret_scan, toxicity
from opsloom.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "plain words that go on and on. " * 8000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, LONG, "en", None, len(LONG)), (5, "same text here", None, "s", 14), (5, "same text here", None, "s", 14),
    (6, "same text here", "en", "s", None), (None, "no id", "en", "s", 5), (None, None, None, None, None), (7, "\x00퟿ é😀   <a", "de", "s", 12), (8, "!" * 5000, "xx", "s", 5000),
]
#: Names that operators use for columns of their own.
CLASHES = "_id string, _text int, _doc int, _keys string, _removals string, _toxicity string, _secrets int, _coded string, _matches int, node string, h int, token_ids string, n_tokens int, round_trip string, label int, _label int, _n int, _hash int, quality_score2 int"


@pytest.fixture(scope="module")
def odd(spark):
    names = [c.split() for c in CLASHES.split(", ")]
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return rows.select("*", *[F.lit("7").cast(kind).alias(name) for name, kind in names])


def same_rows(out, docs, added=()):
    """Each row is there, with all its columns as they were."""
    assert out.columns == docs.columns + [c for c in added if c not in docs.columns]
    key = lambda df: sorted(map(str, df.select([c for c in docs.columns if c not in added]).collect()))
    assert key(out) == key(docs)


def test_secrets(odd):
    out = secret_scan.scan(odd)
    same_rows(out, odd, ["secrets"])
    assert {tuple(r["secrets"]["spans"]) for r in out.collect()} == {()} and secret_scan.scan(odd.limit(0)).count() == 0


def test_language(odd):
    net = language_id.fit(odd)
    out = language_id.classify(odd, net)
    same_rows(out, odd, ["language"])
    assert net.languages == ("de", "en") and language_id.classify(odd.limit(0), net).count() == 0


def test_html(odd):
    out = html_extract.extract_text(odd, "text")
    same_rows(out, odd, ["main_text"])
    got = {r["doc_id"]: r["main_text"] for r in out.collect()}
    assert got[1] == got[2] == got[3] == "" and got[4] == LONG.strip() and html_extract.extract_text(odd.limit(0), "text").count() == 0


def test_bpe(odd):
    v = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    out = bpe.encode_and_decode(odd, v)
    same_rows(out, odd, ["coded"])
    assert all(r["coded"]["decoded"] == (r["text"] or "") for r in out.collect()) and bpe.encode_and_decode(odd.limit(0), v).count() == 0


#: A long text whose words differ; LONG says the same over and over, which is no passage.
VARIED = " ".join(f"w{i}" for i in range(40_000))


def test_paragraphs(odd):
    said_again = odd.unionByName(odd.where("doc_id = 4").withColumn("doc_id", F.lit(3).cast("bigint")))
    assert paragraph_dedup.clusters(odd).count() == 0 == paragraph_dedup.clusters(said_again).count()
    odd = odd.withColumn("text", F.when(F.col("doc_id") == 4, VARIED).otherwise(F.col("text")))
    assert paragraph_dedup.clusters(odd.limit(0)).count() == 0
    copies = odd.unionByName(odd.where("doc_id = 4").withColumn("doc_id", F.lit(3).cast("bigint"))).unionByName(odd.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("bigint")))
    spans = {r["doc_id"]: (r["cluster_id"], [tuple(s) for s in r["removals"]]) for r in paragraph_dedup.clusters(copies).collect()}
    assert spans == {3: (3, []), 4: (3, [(0, 40_000)])}
    left = paragraph_dedup.remove(copies, paragraph_dedup.clusters(copies))
    assert left.columns == odd.columns and left.count() == copies.count() and left.where("doc_id = 4").first()["text"] == ""


def test_paragraphs_of_text_ids(spark, odd):
    named = odd.where("doc_id = 4").select(F.explode(F.array(F.lit("b"), F.lit("a"))).alias("doc_id"), F.lit(VARIED).alias("text"))
    found = {r["doc_id"]: r for r in paragraph_dedup.clusters(named).collect()}
    assert set(found) == {"a", "b"} and {r["cluster_id"] for r in found.values()} == {"a"} and sum(bool(r["removals"]) for r in found.values()) == 1


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "plain words that go on and on"), (3, "plain words that go on and on"), (None, "same text here"), (5, "...")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(odd, items).collect()}
    assert got == {(4, 3), (5, None), (6, None)}
    assert decontaminate.matches(odd.limit(0), items).count() == 0 == decontaminate.matches(odd, items.limit(0)).count()


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (6, 0), (None, 1), (9, 1), (8, None)], "doc_id bigint, toxic int")
    out = toxicity.score(odd, toxicity.fit(odd, labels))
    same_rows(out, odd, ["toxicity"])
    assert all(0 <= r["toxicity"] <= 1 for r in out.collect()) and toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), labels)).count() == 0


def test_rules(odd):
    out = quality_rules.apply_rules(odd)
    same_rows(out, odd, ["quality"])
    assert not any(r["quality"]["kept"] for r in out.where("doc_id is null or doc_id <> 4").collect()) and quality_rules.apply_rules(odd.limit(0)).count() == 0


def test_classifier(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (6, 0), (None, 1), (9, 1), (8, None)], "doc_id bigint, quality int")
    out = quality_classifier.score(odd, quality_classifier.fit(odd, labels))
    same_rows(out, odd, ["quality_score"])
    assert all(0 <= r["quality_score"] <= 1 for r in out.collect())
    assert quality_classifier.score(odd.limit(0), quality_classifier.fit(odd.limit(0), labels)).count() == 0


def test_join(odd):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(odd).collect()), key=str)
    n = 7  # of the long text, which repeats seven words
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, n, 4), (5, 1, 5), (5, 1, 5), (6, 1, 5), (None, 1, None), (None, 0, None), (7, 1, 7), (8, 1, 8)], key=str)


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = sorted(map(str, out.select(odd.columns).collect()))
    # Near copies go but for one; nothing else here is toxic, of the benchmark, or secret.
    want = odd.where("doc_id is null or doc_id <> 6") if name == "ngram_jaccard" else odd
    assert rows == sorted(map(str, want.collect()))
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_stages_on_other_columns(spark):
    """Documents without the columns that stages don't need, and with secrets, a copy and a passage of the benchmark."""
    item = table(spark, SF, "benchmark").where(F.length("text") > 60).first()["text"]
    rows = [(1, "some words of one's own that nobody else wrote"), (2, "some words of one's own that nobody else wrote"), (3, f"before {item} after"), (4, "the token = abcdef123456 of it")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = docs
    for _, stage in pipeline.STAGES:
        out = stage(spark, out, SF)
    got = {r["doc_id"]: (r["text"], r["round_trip"], r["n_tokens"]) for r in out.collect()}
    assert set(got) == {1, 4} and got[1][0] == rows[0][1] and got[4][0] == "the [SECRET] of it" and all(ok and n for _, ok, n in got.values())
