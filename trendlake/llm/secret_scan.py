"""Secret scan: a trigram inverted index proposes documents, regular expressions verify them.

1. Each rule's regular expression gives a Boolean trigram query (``trigrams``).  Rules
   without a mandatory trigram are verified on every document.
2. The index has a posting ``(trigram, doc_id)`` for every trigram that some query
   names and the lower-cased text holds; it is written once.
3. Postings are joined with the queries and intersected: an alternative holds where as many
   of its trigrams have a posting as it names, a clause where one of its alternatives
   holds, a rule where all of its clauses do.
4. The proposals go back to the texts by doc_id, and only proposed rules are run.

Spans are code points, end exclusive.  Everything is DataFrame functions; the table of
queries is as large as the rules are.

Defined results: null text is empty and has no spans; rows with one doc_id share their
proposals, and each is verified on its own text; null ids work like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import with_perhaps
from .store import cut
from .text_stats import let, whole_text
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``group`` of the match must have ``least`` characters; shorter matches are dropped after the search."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules of the contract (fixed values), in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # [0-9a-f]+ of 32 characters or more: a maximal run either way
)

#: Further public credential formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)


def _queries(rules: tuple[Rule, ...]):
    """Rows ``(rule, clause, alternative, trigram, named)`` and the number of clauses of each rule."""
    rows, clauses = [], []
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        clauses.append(len(query))
        for k, clause in enumerate(query):
            for a, alternative in enumerate(clause):
                rows += [(r, k, a, t, len(alternative)) for t in sorted(alternative)]
    return rows, clauses


def build_index(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Postings ``trigram, doc_id`` for the trigrams that the rules' queries name."""
    wanted = sorted({t for *_, t, _ in _queries(rules)[0]})
    if not wanted:
        return docs.select(F.lit("").alias("trigram"), F.col("doc_id").cast("long").alias("doc_id")).limit(0)
    held = let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(low, t)))
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(held).alias("trigram")).distinct()


def propose(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``id, proposed`` (rule numbers) of each document that some rule's query holds for."""
    rows, clauses = _queries(rules)
    spark = index.sparkSession
    queries = spark.createDataFrame(rows, "rule int, clause int, alternative int, trigram string, named int")
    named = index.join(F.broadcast(queries), "trigram")  # as many rows as the rules' queries have
    met = named.groupBy("doc_id", "rule", "clause", "alternative").agg(F.count("*").alias("n"), F.first("named").alias("named")).where("n = named")
    by_rule = met.groupBy("doc_id", "rule").agg(F.count_distinct("clause").alias("n"))
    whole = F.element_at(F.array(*map(F.lit, clauses)), F.col("rule") + 1)
    return by_rule.where(F.col("n") == whole).groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("rule").alias("proposed"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in ``text`` as structs: gaps and matches of the same search, lengths summed up."""
    pattern = F.lit(rule.pattern)

    def placed(found):
        gaps = F.split(text, rule.pattern, -1)
        value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
        parts = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), value.alias("value"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>").alias("spans"))

        def step(state, p):
            begin = state.getField("at") + F.length(p.getField("gap"))
            end = begin + F.length(p.getField("hit"))
            span = F.array(F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind")))
            kept = F.when(F.length(p.getField("value")) >= rule.least, F.concat(state.getField("spans"), span)).otherwise(state.getField("spans"))
            return F.struct(end.alias("at"), kept.alias("spans"))

        return F.aggregate(parts, start, step, lambda s: s.getField("spans"))

    nothing = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, nothing).otherwise(placed(found)))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("end"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, base: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``n_<kind>`` of each rule, base_sha256 and spans."""
    index = cut(build_index(docs, rules), "trigram-index")
    proposed = cut(propose(index, rules), "trigram-proposals")
    full = [r for r, n in enumerate(_queries(rules)[1]) if n == 0]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # only texts that may have a proposal (a bounded bitmap tells) go through the join's shuffle
    marked = with_perhaps(texts, "doc_id", proposed.select("id"), "perhaps")
    joined = marked.where("perhaps").join(proposed, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    held = joined.select("doc_id", "text", "proposed").unionByName(marked.where("not perhaps").select("doc_id", "text", F.lit(None).cast("array<int>").alias("proposed")))
    nothing = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")

    def found(r, rule):
        spans = _spans(F.col("text"), rule, r)
        return spans if r in full else F.when(F.array_contains("proposed", r), spans).otherwise(nothing)

    by_rule = held.select("doc_id", *[found(r, rule).alias(f"s{r}") for r, rule in enumerate(rules)])
    of_rules = lambda some: F.concat(*[F.col(f"s{r}") for r in some])
    return by_rule.select(
        "doc_id", *[F.size(f"s{r}").cast("long").alias(f"n_{rule.kind}") for r, rule in enumerate(rules)],
        F.sha2(_written(of_rules([r for r, rule in enumerate(rules) if rule.kind in base])), 256).alias("base_sha256"), _written(of_rules(range(len(rules)))).alias("spans"))
