"""A corpus pipeline of five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run``
writes each result as Parquet in the shared folder and rereads it for the next one.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from otelframe.llm import jaccard, language, lines, packing, secrets
from otelframe.llm.common import documents, materialize

#: Least similarity to the nearest language profile that a document needs; ordinary
#: prose is above 0.3, and texts without letters are 0.
LEAST_SCORE = 0.1


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text as ``row``: operators then meet no other
    columns, whatever those are called."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _unboxed(done: DataFrame, names: list[str], changed: Column | None = None) -> DataFrame:
    """The columns ``names`` with the new ``text``; n_chars is counted anew where the text
    was changed."""
    same = lambda c: F.col("row").getField(c)
    columns = {c: F.col("text") if c == "text" else same(c).alias(c) for c in names}
    if changed is not None and "n_chars" in names:
        columns["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(same("n_chars")).alias("n_chars")
    return done.select(*[columns[c] for c in names])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in no known language: null texts, texts without letters,
    and texts far from every profile. Profiles are learnt from the labelled documents;
    without any label only texts without letters go. Repeated rows fare alike; an empty
    table stays empty."""
    profiles = materialize(language.learn(docs))
    if profiles.isEmpty():
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rated = language.predict(_boxed(docs), profiles, {"row": F.col("row"), "text": F.col("text")})
    return _unboxed(rated.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three lines or more are deleted; documents that consisted of
    nothing else go. Rows repeated as a whole count as one document and stay; null texts
    stay; an empty table stays empty. Shorter runs go once near duplicates are told
    (``near_duplicates``): a copy that lost its long line here would not be told as one."""
    return _without_repeats(docs, None)


def _without_repeats(docs: DataFrame, words: int | None) -> DataFrame:
    """``docs`` without later repeats of lines (see ``lines.line_dedup``), and without the
    documents of which nothing is left."""
    removed = F.col("_dedup.removed") > 0
    done = lines.line_dedup(_boxed(docs), words=words)
    return _unboxed(done.where(~removed | F.coalesce(F.col("text").rlike(r"\S"), F.lit(True))), docs.columns, removed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays (null ids are
    the largest). Rows with one id and one text count as one document, rows with one id
    and different texts as several. Texts without words stay; an empty table stays empty.
    Of what stays, later repeats of fewer lines than three go too, if they hold 50 words or
    are a whole document, and with them the runs of three that only then are repeats."""
    classes = jaccard.near_duplicate_classes(docs)
    losers = materialize(classes.where(~F.col("kept")).select(F.col("doc_id").alias("l_id"), F.col("copy").alias("l_copy")).distinct())
    keyed = _boxed(docs).withColumn("copy", F.xxhash64("text"))
    kept = keyed.join(losers, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("copy") == F.col("l_copy")), "left_anti")
    return _without_repeats(materialize(_unboxed(kept, docs.columns)), lines.WORDS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, null and empty texts as they
    are. Repeated rows are masked alike and weigh once; an empty table stays empty."""
    done = secrets.redact(_boxed(docs).withColumn("before", F.xxhash64("text")))
    return _unboxed(done, docs.columns, F.xxhash64("text") != F.col("before"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens. Null texts are empty and take
    the end id alone; repeated rows are packed as often as they come; an empty table
    gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Packing has no SQL form; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
