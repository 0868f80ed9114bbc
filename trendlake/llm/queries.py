"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chunk_dedup import repeated_chunks
from .decontaminate import contamination
from .importance import importance_scores, with_rank
from .jaccard_join import jaccard_classes
from .language_id import identify, learn, load_pieces
from .mixing import with_copies
from .periodic_runs import periodic_runs
from .quality_rules import judge
from .secret_scan import scan_secrets
from .store import shipped
from .suffix_dedup import repeated_strings
from .text_stats import let, whole_text, words
from .token_store import write_tokens
from .toxicity import learn_toxicity, predicted, score_toxicity
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The path of a public vocabulary file as installed on the machines."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark, sf_dir):
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixing(spark, sf_dir):
    return with_copies(_table(spark, sf_dir, "documents")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op3_token_store(spark, sf_dir):
    return write_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).documents()


def op4_chunk_dedup(spark, sf_dir):
    return repeated_chunks(_table(spark, sf_dir, "documents")).drop("kept")


def op5_suffix_dedup(spark, sf_dir):
    return repeated_strings(_table(spark, sf_dir, "documents")).drop("kept")


def op6_warc(spark, sf_dir):
    records = read_archives(write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_jaccard_join(spark, sf_dir):
    return jaccard_classes(_table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    pieces = load_pieces(tokenizer_file("piece_bpe_32k.model"))
    languages, log_p = learn(docs.where(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text", "lang"), pieces)
    return identify(docs, languages, log_p, pieces).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op9_decontaminate(spark, sf_dir):
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op10_secret_scan(spark, sf_dir):
    return scan_secrets(_table(spark, sf_dir, "documents"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, the words of one id in ten repeated from a place on with a period, both by the id's CRC."""
    doc_id = F.col("doc_id").cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w):
        n = F.size(w).cast("long")
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n.cast("int") - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise("")

    return docs.select(doc_id.alias("doc_id"), F.when(h % 10 == 0, let(words(whole_text()), repeated)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted_repeats(_table(spark, sf_dir, "documents")), exponent=4, least=6)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = learn_toxicity(docs, labels.where(~held_out))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


def op13_importance(spark, sf_dir):
    scored = importance_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), buckets=10_000, seed="7")
    return with_rank(scored.drop("text"), percent=25, min_words=20).drop("n_words")



def quality_base_counts(spark, sf_dir):
    """The columns of op1 that do not depend on what is learned."""
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark, sf_dir):
    """The columns of op2 that do not depend on the draw."""
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def secret_base_spans(spark, sf_dir):
    """The columns of op10 without the spans that the method adds."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES = {f.__name__: shipped(f) for f in (op1_quality_rules, op2_mixing, op3_token_store, op4_chunk_dedup, op5_suffix_dedup, op6_warc, op7_jaccard_join, op8_language_id, op9_decontaminate, op10_secret_scan, op11_periodic_runs, op12_toxicity, op13_importance, quality_base_counts, mixing_targets, secret_base_spans)}
ORACLE_SQL = oracles.ORACLE_SQL
