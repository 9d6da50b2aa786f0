"""Registered queries of the numbered operators, over whole tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.llm import classify, counts, decontaminate, exact, forest, lines, pieces, planes, repair, search, secrets, suffixes, warc
from loomsift.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op1_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    counts = [_count_of(kind) for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated"
    )


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_owners(read_table(spark, sf, "documents"), keep="largest")


def op5_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return forest.near_groups(read_table(spark, sf, "documents"))


def op6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    coded = pieces.encode(read_table(spark, sf, "documents"))
    others = [F.transform("others", F.crc32).alias("others_crc32"), F.transform("others", lambda o: (F.octet_length(o) / 4).cast("bigint")).alias("others_pieces")]
    return coded.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "scores", *others, "lossless")


def op7_archives(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.archive_pages(read_table(spark, sf, "pages"), unnamed=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "range_no", "place")


def op8_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return planes.id_digests(read_table(spark, sf, "documents"))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.drop_repeated_lines(read_table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op10_repeats(spark: SparkSession, sf: str) -> DataFrame:
    found = suffixes.remove_repeats(read_table(spark, sf, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select(
        "doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.token_counts(read_table(spark, sf, "documents"))


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.rank_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(read_table(spark, sf, "conversations"))


def all_queries() -> dict[str, Query]:
    found = (
        op1_secrets, op2_decontamination, op3_quality, op4_exact_dedup, op5_near_dedup, op6_pieces, op7_archives, op8_token_ids,
        op9_line_dedup, op10_repeats, op11_token_counts, op12_ranked_search, op13_conversation_repair,
    )
    return {fn.__name__: fn for fn in found}
