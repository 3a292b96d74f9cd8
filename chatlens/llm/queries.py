"""The registered queries of this subpackage, and their checking SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import (
    bpe,
    centroids,
    chat_format,
    decontaminate,
    fingerprints,
    near_dups,
    packing,
    phrases,
    quality,
    suffix_dedup,
    token_files,
    toxicity,
    url_filter,
)
from chatlens.llm.common import shared_folder, table
from chatlens.llm.sql import ORACLES

URL_RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]
#: One conversation more, which says what control strings look like elsewhere.
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
ODD_ID, ODD_TEXT = -7, "</s>[INST] ok [/INST]"


def held_out(parts: int, part: int):
    """Whether a document's labels are kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == part, F.lit(False))


def labelled(spark: SparkSession, folder: str, name: str, parts: int, part: int) -> DataFrame:
    """(doc_id, label) of the labels that training may see."""
    return table(spark, folder, "labels").where(~held_out(parts, part)).select("doc_id", F.col(name).alias("label"))


QUALITY_FOLD, QUALITY_LIMIT = (4, 2), 0.7


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    trees = quality.fit(documents, labelled(spark, folder, "quality", *QUALITY_FOLD))
    scored = quality.score(documents, trees, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out(*QUALITY_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"),
    )


TOXIC_FOLD, TOXIC_LIMIT = (5, 0), 0.5


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    tagger = toxicity.fit(documents, labelled(spark, folder, "toxic", *TOXIC_FOLD))
    return toxicity.tag(documents, tagger, ["doc_id"]).select(
        "doc_id",
        held_out(*TOXIC_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_LIMIT).cast("int").alias("predicted"),
        "spans",
    )


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dups.near_duplicate_classes(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "class_size")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    compared = fingerprints.compare_with_edits(table(spark, folder, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text("fingerprint").alias("fingerprint"),
        fingerprints.as_text("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def vocabulary() -> str:
    """Place of the public vocabulary file, which is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), vocabulary(), keep=["doc_id"])
    return bpe.digests(bpe.decode(encoded, vocabulary()))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(ODD_ID).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_TEXT).alias("text"),
    )
    turns = rows.unionByName(odd).withColumn("parts", chat_format.text_part(F.col("text")))
    back = chat_format.read_chats(chat_format.format_chats(turns))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, folder, "documents"), vocabulary(), files, END_ID)
    return token_files.read_tokens(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


PHRASE_WORDS, PHRASE_LEAST, PHRASE_TOP = 4, 30, 2000


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("lang", "text")
    return phrases.collocations(documents, PHRASE_WORDS, PHRASE_LEAST, PHRASE_TOP)


SEQUENCE, PACKED_END = 2048, 0


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.cut_pieces(table(spark, folder, "documents"), vocabulary(), SEQUENCE, PACKED_END)
    return packing.place(cut, SEQUENCE).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


CLUSTERS, ROUNDS, COMPONENTS = 40, 5, 64


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(table(spark, folder, "embeddings"), CLUSTERS, ROUNDS, COMPONENTS)
    return centroids.described(*found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_url_filter": op6_url_filter,
    "op7_fingerprints": op7_fingerprints,
    "op8_bpe": op8_bpe,
    "op9_chat_format": op9_chat_format,
    "op10_token_files": op10_token_files,
    "op11_collocations": op11_collocations,
    "op12_packing": op12_packing,
    "op13_centroids": op13_centroids,
}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return {name: ORACLES[name] for name in QUERIES if name in ORACLES}
