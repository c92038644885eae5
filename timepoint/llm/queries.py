"""The operators bound to the supplied tables, one query each, and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.llm import align, bpe, chat, decontaminate, html, licenses, merkle, ngram_join, quality, secrets, shard, simhash, warc
from timepoint.llm.common import joined_digest, table
from timepoint.llm.oracles import ORACLES as ORACLES
from timepoint.session import new_scratch


def vocabulary() -> str:
    """Place of the vocabulary file of the encoding queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    names = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    at = found.withColumn("base", base)
    return at.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), names(F.col("base")).alias("base_labels"),
        names(F.col("matches")).alias("labels"), F.coalesce(F.array_max("matches.share"), F.lit(0.0)).alias("score"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_scratch(spark, "warc")
    index = warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    # Sums of fractions, whose last bit depends on the order of adding.
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS))
    listed = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        joined_digest(listed(base)).alias("base_sha256"), F.concat_ws(",", listed(F.col("spans"))).alias("spans"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        joined_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


#: A conversation made of the template's own control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    formatted = chat.conversations(chat.messages_of_turns(turns.unionByName(own)), per_tree=1)
    read = formatted.select(
        F.expr("cast(nullif(tree, '') as bigint)").alias("conv_id"), "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """Ids of each text, and digests of them and of the text that they decode to."""
    return bpe.Coder(docs.sparkSession, path).documents(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "ids",
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


N_SHARDS = 8


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    # Equal texts lie beside each other, in the order of their ids.
    key = F.concat(shard.hex_key(F.col("text_hash")), shard.hex_key(F.col("doc_id")))
    placed = shard.histogram_sort(rows, key, F.col("size"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path
    found = align.align(spark, docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, "groups_sha256")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return merkle.audit(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered=F.coalesce(drawn, F.lit(False)))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_decontamination": op5_decontamination,
    "op6_html": op6_html,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_ngram_join": op12_ngram_join,
    "op13_merkle": op13_merkle,
}
