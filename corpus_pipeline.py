"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.llm import lines, mixing, packing, shingles, toxicity
from quirelens.llm.queries import tokenizer_path
from quirelens.plans.lineage import cut, release
from quirelens.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    A null or empty text is scored like any other; repeated rows stay or go together, as do nulls in other
    columns; an empty table gives no rows; columns beyond those of documents go.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the blocks that earlier documents hold; a document that loses all of its text goes."""
    done = lines.line_dedup(docs)
    return _documents(done.filter((F.size("blocks") == 0) | (F.col("text") != "")))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id.

    SimHash links sets whose fingerprints are within three bits and the sets themselves confirm each link; since a
    fingerprint misses such copies too, whatever else shares a rare shingle is compared after that.
    """
    return shingles.one_of_each(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mixture takes it.

    Rows with a null id come last among equal sizes, a null source is a source, repeated rows are drawn each; a null
    or empty text has no size, so its row is drawn like a document of no words; an empty table gives no rows.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, every window in the proportions of the mixture.

    A null or empty text is its end token alone; repeated rows and ids are packed each; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A learned score, fingerprints and token ids have no SQL; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written down for the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)  # a table that the next one has replaced
    return STAGES[-1][1](spark, docs, sf_dir)
