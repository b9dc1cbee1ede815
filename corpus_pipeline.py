"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of documents. ``run`` writes each stage to the
shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import exact_dedup, language_id, mixing, near_dedup, pieces
from veilspan.llm.common import drop_materialized, materialize, table, written

#: SQL can't express the trained model, the sketches or the lattice search; the
#: stages are tested against brute-force versions instead.
ORACLE_SQL = None


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (a column ``id``), with the columns of
    docs; null is an id like any other. The ids grow with the corpus, so the join is
    a shuffle at every size; hashing the ids spares sorting the texts."""
    wanted = ids.select(F.col("id").alias("__id")).hint("shuffle_hash")
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__id"]), "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    return language_id.identified_only(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return _only(docs, materialize(exact_dedup.exact_dedup(docs).where("kept").select("id").distinct(), "pipeline-exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id."""
    return _only(docs, materialize(near_dedup.near_dedup(docs).where("kept").select("id").distinct(), "pipeline-near"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered over and within the files by their place in the mixture."""
    places = materialize(mixing.mix(docs).groupBy("id").agg(F.min("position").alias("__position")).withColumnRenamed("id", "__id"), "pipeline-mix")
    placed = docs.join(places.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(places["__id"]))
    position = places["__position"]
    return placed.repartitionByRange(position).sortWithinPartitions(position).select(*[docs[c] for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's best segmentation and the next ones."""
    out = pieces.encode_documents(docs)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. When a stage is written, what it has
    written on the way and the stage before it are deleted."""
    docs = table(spark, sf_dir, "documents")
    spent: list[str] = []
    for name, stage in STAGES[:-1]:
        before = set(written())
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        *inner, own = [p for p in written() if p not in before]
        drop_materialized(spark, spent + inner)
        spent = [own]
    return STAGES[-1][1](spark, docs, sf_dir)
