"""A pipeline over ``documents``: quality, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Between stages the rows are written as Parquet to the shared folder and read again.

The filtering stages judge rows, not ids: each row has a number, from the file and the place it is read from, and a stage
drops the numbers that it rejects. Ids may be null or repeated; a row without an id is judged like any other, and one that
shares its id stays or goes by itself. What a stage stores on its way is deleted before it returns, but for the numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe_codec import encode
from tessera.llm.common import scratch, stored
from tessera.llm.decontamination import build_index, search
from tessera.llm.jaccard_join import link
from tessera.llm.kneser_ney import classify
from tessera.llm.queries import table, tokenizer_path
from tessera.llm.secrets import redact
from tessera.session import discard, free_name, numbered

MOST_BROADCAST_ROWS = 500_000


def without(docs: DataFrame, rejected: DataFrame, row: str) -> DataFrame:
    """docs, numbered in the column row, but for the rows in rejected (stored, distinct, not null), without the numbers: a broadcast up to a checked size, else a join."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c != row]
    return docs.join(F.broadcast(rejected) if rejected.count() <= MOST_BROADCAST_ROWS else rejected, row, "left_anti").select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity under the trusted model is over the threshold of their language go."""
    row = free_name(docs, "row_number")
    docs = numbered(docs, row)
    with scratch(spark) as keep:
        judged = classify(docs, table(spark, sf_dir, "labels"), row_col=row)
        rejected = keep(stored(judged.where("not keep").select(row), "rejected"))
    return without(docs, rejected, row)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 or more on five-word shingles connect, the row with the smallest id stays (ids come
    before null, then the row number decides). Rows without words are in no group and stay."""
    row = free_name(docs, "row_number")
    docs = numbered(docs, row)
    with scratch(spark) as keep:
        linked = stored(link(docs, percent=80, n=5, id_col=row).where("n_shingles > 0"), "linked")
        groups = linked.groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1").select("component_id")
        ids = docs.select(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("number")).alias("place"))
        members = stored(linked.join(groups, "component_id").select("component_id", row).join(ids, row), "members")
        first = members.groupBy("component_id").agg(F.min("place").alias("first"))
        rejected = members.join(first, "component_id").where(F.col(row) != F.col("first.number")).select(row)
        rejected = keep(stored(rejected, "rejected"))
    return without(docs, rejected, row)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten successive words of a benchmark item go."""
    row = free_name(docs, "row_number")
    docs = numbered(docs, row)
    with scratch(spark) as keep:
        found = search(build_index(docs, id_col=row), table(spark, sf_dir, "benchmark"), window=10, slop=0)
        rejected = keep(stored(found.where("n_hit > 0").select(F.col("id").alias(row)), "rejected"))
    return without(docs, rejected, row)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by [REDACTED]; n_chars follows."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text that is left, with a digest of what they decode to."""
    coded = encode(docs, tokenizer_path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redacted),
    ("BPE encoding and decoding", tokens),
]
#: SQL can't express the language model, the components and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if before:
            discard(spark, before)
        before = docs.stored_in
    return STAGES[-1][1](spark, docs, sf_dir)
