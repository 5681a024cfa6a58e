"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tuturan.llm import (
    bisector_clusters,
    chat_windows,
    dac_output,
    host_paths,
    lm_difference,
    merkle,
    mixing,
    packing,
    quality_cnn,
    rule_trees,
    simhash,
    token_counts,
    vector_graph,
)
from tuturan.llm.common import ship, table, write_once
from tuturan.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

END_OF_DOCUMENT, END_OF_PACKED, SEQUENCE = 0, 2, 1024


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


@query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.digest(*packing.pack(docs, tokenizer_path(), END_OF_PACKED, SEQUENCE, keep_ids=False))


@query
def op7_dac_output(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    docs = table(spark, folder, "documents")
    dac_output.write_ids(docs, path, tokenizer_path(), END_OF_DOCUMENT)
    return dac_output.read_documents(spark, path)


@query
def op1_quality_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_cnn.digest(docs, quality_cnn.fit(docs, table(spark, folder, "labels")))


@query
def op8_rule_trees(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    forest = rule_trees.fit(docs, table(spark, folder, "labels"))
    return rule_trees.judge(docs, forest, ["doc_id"])


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.link(table(spark, folder, "documents"))


@query
def op9_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.digest(table(spark, folder, "documents"))


ORACLES["op9_pfair_mixing"] = mixing.ORACLE


@query
def op3_host_paths(spark: SparkSession, folder: str) -> DataFrame:
    return host_paths.main_text(table(spark, folder, "pages"), ["page_id", "url"])


@query
def op10_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", own), (-1, 1, "assistant", own)]
    turns = turns.unionByName(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return chat_windows.digest(write_once(chat_windows.windows(turns, tokenizer_path()), "chat"))


@query
def op5_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    return vector_graph.link(table(spark, folder, "embeddings"))


@query
def op6_lm_difference(spark: SparkSession, folder: str) -> DataFrame:
    return lm_difference.difference(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_bisector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return bisector_clusters.digest(table(spark, folder, "embeddings"))


ORACLES["op11_bisector_clusters"] = bisector_clusters.ORACLE


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.digest(table(spark, folder, "documents"))


ORACLES["op12_merkle_manifest"] = merkle.ORACLE


@query
def op13_prefix_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))
