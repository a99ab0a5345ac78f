"""A training corpus from ``documents`` in five stages, each written as Parquet and reread as the next one's input.

Rows that repeat an id are rows of their own until near-duplicate removal, which names documents by id: all rows of an id stay or go.
Null texts count as empty, which the quality rules reject. Columns beyond those of ``documents`` travel along untouched,
whatever their names, and empty tables give empty results. After mixing, a document has a row for each of its copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.llm.bpe import encode_documents
from lumbung.llm.common import CORE, documents, hash_bits, materialise, packed, unpacked, with_maybe
from lumbung.llm.exact_dedup import first_of_each
from lumbung.llm.jaccard_join import jaccard_join
from lumbung.llm.mixing import mix
from lumbung.llm.quality_rules import quality_rules

CARRY = (*CORE, "__rest")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor an adaptive limit rejects."""
    return unpacked(quality_rules(packed(docs), CARRY).where("kept"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return unpacked(first_of_each(packed(docs)), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id in each component of five-word shingle similarity 0.8 or more."""
    joined = jaccard_join(docs, n=5, percent=80)
    gone = materialise(joined.where("component_id <> doc_id").select(joined["doc_id"].alias("__gone")).distinct(), "near-gone")
    key = F.xxhash64(F.col("__doc.doc_id").cast("bigint"))
    # documents that are surely none of them stay where they are; the others are looked up
    looked = with_maybe(docs.select(F.struct("*").alias("__doc")), key, hash_bits(gone, F.xxhash64(F.col("__gone").cast("bigint")), "near-bits"), "__maybe")
    left = looked.where("__maybe").join(gone, F.expr("CAST(__doc.doc_id AS BIGINT) = __gone"), "left_anti").select("__doc")
    return looked.where(~F.col("__maybe")).select("__doc").unionByName(left).select("__doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source repeated towards its target weight, in a global random order."""
    return unpacked(mix(packed(docs), CARRY), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source with the text's ids, their number, and the digests of ids and decoded text."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source"), outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: Byte-pair encoding and the components of a similarity join are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{number}")
    return docs
