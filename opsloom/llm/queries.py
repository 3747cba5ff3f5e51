"""The registered queries of this subpackage: thin reads of whole tables through the operators, and their SQL."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import bpe, decontaminate, html_extract, jaccard_join, language_id, paragraph_dedup, quality_classifier, quality_rules, secret_scan, toxicity
from opsloom.llm.common import fold, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col("secrets.base"), F.col("secrets.spans")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(i).__eq__)).cast("long").alias(f"n_{k}") for i, k in enumerate(secret_scan.PATTERNS)]
    digest = F.sha2(F.encode(secret_scan.listed(base), "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secret_scan.listed(spans).alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(fold("doc_id", 5) != 0))
    named = language_id.classify(docs.select("doc_id", "text"), net)
    return named.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, vocabulary)
    return coded.select(
        "doc_id",
        (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("coded.ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("coded.decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_dedup.clusters(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removals", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    words = F.aggregate("removals", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "cluster_id", F.size("removals").cast("long").alias("n_removals"), words.cast("long").alias("removed_words"), spans.alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.fit(docs.where(fold("doc_id", 3) != 1), labels.where(fold("doc_id", 3) != 1))
    scored = toxicity.score(docs.select("doc_id", "text"), grammar, out_col="score")
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words", "n_lines_removed"]
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs.where(fold("doc_id", 3) != 1), labels.where(fold("doc_id", 3) != 1))
    scored = quality_classifier.score(docs.select("doc_id", "text", "source", "lang", "n_chars"), model, out_col="score")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).alias("kept"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_language_id": op2_language_id,
        "op3_html_extract": op3_html_extract,
        "op4_bpe": op4_bpe,
        "op5_paragraph_dedup": op5_paragraph_dedup,
        "op6_decontaminate": op6_decontaminate,
        "op7_toxicity": op7_toxicity,
        "op8_quality_rules": op8_quality_rules,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "pipeline": pipeline,
    }


WORD = "'[^\\x20\\x09-\\x0D]+'"
PHRASES = ", ".join("'" + p.replace("'", "''") + "'" for p in quality_rules.PHRASES)
SIGNS = "length(l) - length(regexp_replace(l, '{}', '', 'g'))"

OP8 = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
  w as (select doc_id, t, regexp_extract_all(t, {WORD}) as ws from d),
  triples as (select doc_id, i, concat_ws(' ', ws[i], ws[i+1], ws[i+2]) as k from (select doc_id, ws, unnest(generate_series(1, len(ws)-2)) as i from w)),
  again as (select doc_id, unnest([i, i+1, i+2]) as i from (select *, count(*) over (partition by doc_id, k) as c from triples) where c > 1),
  repeated as (select doc_id, count(distinct i) as n from again group by 1),
  lines as (select doc_id, i, ls[i] as l, regexp_extract_all(ls[i], {WORD}) as lw from (select doc_id, ls, unnest(generate_series(1, len(ls))) as i from (select doc_id, string_split(t, chr(10)) as ls from d))),
  counted as (select *, cast(len(lw) as double) as n, row_number() over (partition by doc_id, l order by i) > 1 as dup, {SIGNS.format('[#*$%&|<>]')} as signs, {SIGNS.format('[A-Z]')} as capitals, {SIGNS.format('[A-Za-z]')} as letters,
    {SIGNS.format('!')} as shouts, {SIGNS.format('[|·•»→]')} as separators, len(list_distinct(lw)) as different from lines where len(lw) > 0),
  judged as (select doc_id, n, dup, dup or (signs > cast(0.3 as double)*n and (n >= 4 or signs >= n)) or (n > 3 and (capitals > 0.5*letters or shouts > cast(0.3 as double)*n or separators > cast(0.2 as double)*n))
    or (n >= 12 and not regexp_matches(l, '[.,;:!?…。]')) or (n >= 10 and different < cast(0.2 as double)*n) or (n <= 12 and len(list_filter([{PHRASES}], lambda p: contains(lower(l), p))) > 0) as gone from counted),
  kept as (select doc_id, count(*) filter (where dup) as dups, count(*) filter (where gone) as removed, cast(coalesce(sum(n) filter (where not gone), 0) as bigint) as words from judged group by 1),
  whole as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    coalesce(dups, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(words, 0) as n_kept_words, coalesce(removed, 0) as n_lines_removed
    from w left join kept k using (doc_id) left join repeated r using (doc_id))
  select *, n_words < 50 or 100*n_repeat_words > 50*n_words as base_failed, not (n_words < 50 or 100*n_repeat_words > 50*n_words) and n_kept_words >= cast(0.6 as double)*n_words as kept from whole"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP10 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORD}) as ws from documents),
  sets as (select distinct doc_id, array_to_string(ws[i:i+4], ' ') as s from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws)-4, 1))) as i from w where len(ws) > 0)),
  sizes as (select doc_id, count(*) as n from sets group by 1),
  links as (select x.a, x.b from (select p.doc_id as a, q.doc_id as b, count(*) as c from sets p join sets q on p.s = q.s and p.doc_id <> q.doc_id group by 1, 2) x
    join sizes m on m.doc_id = x.a join sizes n on n.doc_id = x.b where 100*x.c >= 75*(m.n + n.n - x.c)),
  reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b)
  select r.a as doc_id, coalesce(max(s.n), 0) as n_shingles, min(r.b) as component_id from reach r left join sizes s on s.doc_id = r.a group by 1"""


def oracle_sql() -> dict[str, str]:
    """The others' results rest on learned weights, on tokens, or on hashes, which SQL doesn't have; tests/llm holds them
    against brute force, the tokenizer library or held-out labels."""
    return {"op8_quality_rules": OP8, "op10_ngram_jaccard": OP10}
