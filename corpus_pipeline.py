"""A corpus pipeline: quality, near-duplicates, secrets, mixture, tokens; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, mixing, ngram_join, quality, secrets
from pagewright.llm.common import fold, table, written

#: Chance decides in several stages, so SQL has no equal; tests hold the stages against brute force.
ORACLE_SQL = None


def _set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with columns of these names, which an operator would replace, under other names, and the columns that bring the old ones back."""
    aside = {c: f"pagewright_aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(aside), [F.col(aside.get(c, c)).alias(c) for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject; every fifth row is not learned from.

    Null and empty texts are judged by the features of an empty text; repeated rows are judged alike; without
    positives nothing is rejected; an empty table stays empty. Columns and their order stay.
    """
    learned = fold(F.col("doc_id"), 5) != 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(learned)
    model = quality.fit(docs.select("doc_id", "text").where(learned), labels)
    rows, back = _set_aside(docs, ("score",))
    return quality.score(rows, model).where(F.col("score") >= quality.THRESHOLD).select(back)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the first in the order of the table, whose rows are numbered once, in a written table.

    Documents without words are linked with nothing and stay; of repeated rows one stays; an empty table stays
    empty. Columns and their order stay.
    """
    rows = written(docs.withColumn("pagewright_row", F.monotonically_increasing_id()), "rows")
    groups = ngram_join.join(rows.select("pagewright_row", "text"), key="pagewright_row")
    first = groups.where("id = component_id").select(F.col("id").alias("pagewright_row"))
    return rows.join(first, "pagewright_row", "left_semi").select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced, those of one owner otherwise than widely copied examples.

    n_chars, where there is one, is counted anew; null texts stay null; repeated rows are changed alike; an empty
    table stays empty. Columns and their order stay.
    """
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    Documents without words have no size and are never taken; a null source is a source; of repeated rows each
    counts; an empty table stays empty. Columns and their order stay.
    """
    rows, back = _set_aside(docs, ("size", "source_size", "target", "copies"))
    mixed = mixing.mix(rows).where("copies > 0")
    return mixed.withColumn("pagewright_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of each document, a row for each; null and empty texts have no ids; an empty table gives an empty result."""
    done = bpe.encode(docs, bpe.default_tokenizer(), decode=False, keep=["doc_id", "lang", "source"])
    return done.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
