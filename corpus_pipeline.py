"""From raw documents to packed training windows.

Quality rules (documents that the policy rejects go), line dedup (a site's boilerplate lines go), SimHash near-dedup
(one document of each group of copies and edited copies stays), mixing sources to target weights (each document is
taken as often as its source's share asks for, at least once), packing.  Each stage reads what its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.llm import line_dedup, packing, pfair_mix, rule_ledger, simhash_dedup
from meridion.session import ScratchTables, materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps, as they are; null, empty and short texts go, repeated rows go or stay alike."""
    return rule_ledger.ledger(docs).where(~rule_ledger.failed(F.col("ledger.fail_bits"))).select("row.*")


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars is that of the new text.

    Copies of a page count once, so that they keep their lines and near-dedup leaves one of them.  Null texts stay
    null, rows without a source lose nothing, repeated rows stay, texts of any length are read whole.
    """
    out = line_dedup.drop_boilerplate(docs, copies=False)
    columns = [F.col("clean").alias(c) if c == "text" else F.char_length("clean").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked as copies or edited copies, the one with the smallest id; rows without an id stay.

    Should rows of one group share that id, the one with the smallest hash of all its columns stays.  Null and empty
    texts are one group.
    """
    found = simhash_dedup.near_copies(docs)
    kept = materialize(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    out = docs.join(kept.where("n = 1"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        rows = docs.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("hash"))
        least = rows.groupBy("doc_id").agg(F.min_by("row", "hash").alias("row"))
        out = out.unionByName(least.select("row.*"))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them, in the order of its slots."""
    mixed = pfair_mix.mix(docs)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens, with their token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_site_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("mix_sources", mix_sources),
    ("pack", pack_windows),
]

#: Token ids and retrieval have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again by the next."""
    tables, docs = ScratchTables(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = tables.put(docs)
            if k:
                tables.drop(k - 1)
    return docs
