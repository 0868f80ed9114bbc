"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``; all but the last return the columns
of documents.  Rejected, duplicate and contaminated documents leave the corpus, the mix
repeats or leaves out documents by their sources' targets, and the last stage writes token
files and returns what they hold.
"""

from __future__ import annotations

from trendlake.llm.decontaminate import decontaminate
from trendlake.llm.jaccard_join import keep_one_each
from trendlake.llm.mixing import mix
from trendlake.llm.quality_rules import keep_good
from trendlake.llm.queries import tokenizer_file
from trendlake.llm.store import cut, shipped
from trendlake.llm.token_store import write_tokens


def quality_rules(spark, docs, sf_dir):
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard(spark, docs, sf_dir):
    """Near duplicates: five words, similarity 0.8."""
    return keep_one_each(docs, k=5, percent=80)


def benchmark_decontamination(spark, docs, sf_dir):
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark, docs, sf_dir):
    return mix(docs)


def token_output(spark, docs, sf_dir):
    return write_tokens(docs, tokenizer_file("word_bpe_49k.json")).documents()


STAGES = [
    ("quality_rules", shipped(quality_rules)),
    ("ngram_jaccard", shipped(ngram_jaccard)),
    ("benchmark_decontamination", shipped(benchmark_decontamination)),
    ("source_mix", shipped(source_mix)),
    ("token_output", shipped(token_output)),
]

#: The learned rules and the tokenizer have no SQL; a test holds near duplicates and contamination, each over all
#: documents, against brute force.  No test holds the other stages or the whole of ``run``.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each result is a written table before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
