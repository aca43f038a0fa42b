"""A training corpus from raw documents: quality, toxicity, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import minhash, packing, risk_rules, substrings, toxicity
from tillwise.llm.common import forget, session, written

#: words of a repeated passage that is cut out
PASSAGE_WORDS = 13


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents, and the column that tells their rows apart and follows doc_id. That is doc_id itself where
    it is there and no two rows share it, which one aggregate of ids finds out; otherwise a column of a new
    name, numbers in order of doc_id (nulls last) written once with the rows."""
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        return docs, "doc_id"
    key = "_row"
    while key in docs.columns:
        key = "_" + key
    return written(docs.orderBy(F.asc_nulls_last("doc_id")).withColumn(key, F.monotonically_increasing_id()), name), key


def _kept(keyed: DataFrame, key: str, verdicts: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that a verdict (key, kept) keeps, with the columns of documents."""
    gone = verdicts.where("not kept").select(F.col(key).alias("_gone"))
    # aliases keep apart columns that the documents may have under the same names
    return keyed.alias("d").join(gone.alias("g"), F.col(f"d.{key}") == F.col("g._gone"), "left_anti").select(*[F.col(f"d.`{c}`") for c in columns])


def _labelled(labels: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Labels under the key of the rows; every row of a labelled id has its label."""
    if key == "doc_id":
        return labels
    return labels.join(keyed.where("doc_id is not null").select("doc_id", key), "doc_id").drop("doc_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the certified cutoffs of their language keep.

    Every row is judged by its own whole text, rows without or with a repeated doc_id too; null and empty texts
    have no words and go. Repeated rows get one verdict each. An empty table stays empty. All columns of the
    input are kept as they are, whatever their names."""
    labels = session(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    keyed, key = _keyed(docs, "quality-rows")
    return _kept(keyed, key, risk_rules.quality_verdicts(keyed, _labelled(labels, keyed, key), id_col=key), docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose probability of `toxic` stays under the certified cut; without a certified cut all stay.

    Every row is scored by its own whole text, rows without or with a repeated doc_id too; null and empty texts have
    no features and stay. An empty table stays empty. All columns of the input are kept as they are."""
    labels = session(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    keyed, key = _keyed(docs, "toxicity-rows")
    return _kept(keyed, key, toxicity.toxicity(keyed, _labelled(labels, keyed, key), ["junk", "toxic"], "toxic", id_col=key), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest doc_id.

    Rows without a doc_id count too and come last, rows that share a doc_id are documents of their own, and equal rows
    are copies of one another. Null and empty texts are no one's copies and stay. An empty table stays empty. All
    columns of the input are kept as they are."""
    session(spark)
    keyed, key = _keyed(docs, "near-copies-rows")
    return _kept(keyed, key, minhash.near_duplicates(keyed, words_each=5, percent=80, id_col=key), docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE_WORDS words and more that a document with a smaller doc_id has, words
    joined by one space; a document of which nothing is left goes. n_chars is counted anew, other columns and
    texts that lose nothing, null and empty ones among them, stay as they are.

    Rows without a doc_id count too and come last; rows that share a doc_id are documents of their own, in any
    order. Texts of any length are cut whole. An empty table stays empty."""
    session(spark)
    keyed, key = _keyed(docs, "passages-rows")
    cut = substrings.remove_repeats(keyed, id_col=key, window=PASSAGE_WORDS, keep_text=True).where("n_removed > 0")
    cut = written(cut.select(F.col(key).alias("_cut"), "kept_text", (F.col("n_words") > F.col("n_removed")).alias("some")), "passages-cut")
    joined = keyed.alias("d").join(cut.alias("c"), F.col(f"d.{key}") == F.col("c._cut"), "left").where(F.coalesce("c.some", F.lit(True)))
    changed = F.col("c.kept_text").isNotNull()
    columns = {"text": F.coalesce("c.kept_text", "d.text"), "n_chars": F.when(changed, F.length("c.kept_text").cast("long")).otherwise(F.col("d.n_chars"))}
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(f"d.`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens, as op7 returns them: a document's ids, in
    pieces, each at its place in a sequence. Null and empty texts are one end token; rows without or with a
    repeated doc_id are documents of their own. An empty table gives no pieces; other columns are not read."""
    session(spark)
    return packing.with_crc(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096))


STAGES = [("quality rules", quality), ("toxicity", clean), ("near copies", near_copies), ("repeated passages", passages), ("packing", packed)]

#: the fitted classifier, similarity components and packing order are beyond SQL; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again before the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return docs
