"""A training corpus from documents: quality rules, near-dedup, decontamination, mixing, token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and reread as the next one's docs. Every stage works on all that its
predecessor kept. All but the last return the columns of documents; the last returns, from the files
that it wrote, each document's place in the token stream. A document that the mix takes several times is that many rows from then on.

Each row is a document of its own, whatever its doc_id: a verdict on one row never holds for another of the same doc_id, and
rows of null doc_id are judged as all others are. Near-dedup keeps one row of each group, of identical rows too.

Defined results. A null text is empty: as any text of fewer than 20 words it goes in the first stage. Null langs, sources and n_chars are
carried along; a null source is a source of its own. Columns other than the five of documents are dropped, whatever their names. Empty
documents, or none that are left, give an empty result of the same columns. Very long texts are whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestate.llm import decontaminate, mixing, near_dedup, quality_rules, token_ids
from tidestate.llm.common import read, scratch, stored, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame, what: str) -> DataFrame:
    """docs with a number of each row (row), written to the shared folder, so that it stays the same however often it is read."""
    return stored(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), what)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_rules(docs, read(spark, sf_dir, "labels"), carry=tuple(COLUMNS[1:])).where("kept").select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose shingles of five words are alike to 0.8, one stays: that of the least doc_id (null is last), any of its rows if they are several."""
    docs = keyed(docs, "near-rows")
    groups = near_dedup.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = groups.join(docs.select("row", "doc_id"), "row").groupBy("component_id").agg(first).select("first.row")
    return docs.join(kept, "row", "left_semi").select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return decontaminate.find(docs, read(spark, sf_dir, "benchmark"), carry=tuple(COLUMNS[1:])).where(~decontaminate.contaminated()).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Copies are dealt by doc_id and content, as row numbers depend on files."""
    docs = keyed(docs, "mix-rows")
    taken = mixing.mix(docs, "row", order=[F.col("doc_id"), F.xxhash64("text", "lang", "n_chars")])
    copies = taken.where("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    return docs.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token files."""
    path = scratch(spark, "pipeline-ids")
    token_ids.write(docs, path, tokenizer_path())
    return token_ids.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality rules", rules),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]
#: Models and coders can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for documents of sf_dir; each stage's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
