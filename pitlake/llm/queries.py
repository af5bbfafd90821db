"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm import ann, chat, decontam, divergence, html_extract, jaccard_join, line_dedup, lm, negatives, oracles, packing, pii, toxicity
from pitlake.llm.common import columns, map_batches, read_table
from pitlake.llm.token_counts import prefix_token_counts

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def crc_fold(folds: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), capacity=4096, end_id=1)


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of documents linked by three-word shingles at 90 %."""
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base spans, and all spans."""
    found = pii.find_in(read_table(spark, sf_dir, "documents"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            of = lambda kind, b=b: [sum(s["kind"] == kind for s in spans) for spans in b["base"]]
            yield {"doc_id": b["doc_id"], "n_email": of("email"), "n_ip": of("ip"), "n_card": of("card"), "n_phone": of("phone"), "base_sha256": list(map(pii.digest, b["base"])), "spans": list(map(pii.span_text, b["spans"])), "n_spans": list(map(len, b["spans"]))}

    return map_batches(found.select("doc_id", "base", "spans"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op5_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of four folds of five."""
    docs = read_table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(crc_fold(5) != 0))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", (F.coalesce(crc_fold(5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours of every hundredth vector."""
    return ann.search(read_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, with the probe conversation -7."""
    turns = columns(read_table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    tokenizer = public_tokenizers.path(BYTE_BPE)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = chat.codec(tokenizer)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv_id, ids, mask in zip(b["conv_id"], b["ids"], b["loss_mask"], strict=True):
                read, loss, chars = chat.read_back(ids, mask, c)
                said = "".join(f"{role}\n{text}\n" for role, text in read)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                for k, v in zip(out, (conv_id, len(read), sha(said), len(loss), sha(loss), chars), strict=True):
                    out[k].append(v)
            yield out

    formatted = chat.format_conversations(turns.union(extra), tokenizer)
    return map_batches(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from six folds of seven."""
    return lm.score(read_table(spark, sf_dir, "documents"), crc_fold(7) == 2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; the whole text is its own longest prefix."""
    counted = prefix_token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of test items."""
    hit = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    as_text = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return hit.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(as_text, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language ranked by divergence from each other, and the terms that set them apart."""
    return divergence.audit(read_table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after the labels of every seventh are set wrong."""
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), "vec_id % 100 = 0", positives=5, negatives=10, low=30, high=90)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that it shares with two others and a larger id keeps."""
    return line_dedup.kept_digests(read_table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_site_style_tree, op3_ngram_jaccard_join, op4_pii_spans, op5_toxicity_lexicon, op6_multi_index_hashing, op7_chat_format, op8_lm_scoring, op9_token_counts, op10_decontamination, op11_source_divergence, op12_hard_negatives, op13_line_dedup)}
ORACLE_SQL: dict[str, str] = {"op3_ngram_jaccard_join": oracles.JACCARD, "op7_chat_format": oracles.CHAT, "op10_decontamination": oracles.DECONTAMINATION, "op11_source_divergence": oracles.DIVERGENCE, "op12_hard_negatives": oracles.NEGATIVES, "op13_line_dedup": oracles.LINES}
