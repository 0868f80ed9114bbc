"""Quality rules: a learned decision list of threshold conjunctions, as ordered Spark conditions.

Sequential covering on labelled statistics:

* Every labelled document's measures are cut at quantiles learned from them
  (``bins`` for each measure), and equal rows of bins are counted: the ``cells`` table
  is all that the search reads, however many documents are labelled.
* A rule starts empty and grows by the threshold with the highest information gain on the
  grow part (documents whose id hashes into two of three) until it covers no good
  document or nothing gains.  It is then pruned back to the prefix with the best
  (bad - good) / (bad + good) on the prune part.
* A rule that is precise enough on both parts joins the list, what it covers is set
  aside, and the next rule is grown on the rest.

Each step is one aggregation whose result has a row for each (measure, bin).  The list is
applied as one ``CASE WHEN`` over the measures, so documents are judged in the scan.

Defined results: null text counts as empty; labels that are null or of unknown
documents teach nothing; without a bad label the list is empty and only the base
rule rejects; repeated label rows count each; columns of ``docs`` other than doc_id and
text pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import with_perhaps
from .store import cut
from .text_stats import SYMBOLS, char_count, dup_lines, let, repeated_window_words, text_lines, whole_text, words

UPPER = "[A-Z]"
MARKS = "[!?]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share"]


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.measure) > self.threshold if self.above else F.col(self.measure) <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


def _counts(text: Column) -> Column:
    """All counts of one text as a struct; its words and lines are made once."""
    def of_words(w):
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_window_words(w).alias("n_repeat_words"))

    def of_lines(x):
        return F.struct(F.size(x).cast("long").alias("n_lines"), dup_lines(x).alias("n_dup_lines"))

    return F.struct(let(words(text), of_words).alias("w"), let(text_lines(text), of_lines).alias("l"), char_count(text, SYMBOLS).alias("n_symbols"), char_count(text, UPPER).alias("n_upper"), char_count(text, MARKS).alias("n_marks"))


def with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, the base counts and the character counts that the measures need."""
    counted = docs.select(*keep, _counts(whole_text()).alias("c"))
    return counted.select(*keep, "c.w.n_words", "c.w.word_chars", "c.n_symbols", "c.l.n_dup_lines", "c.w.n_repeat_words", "c.l.n_lines", "c.n_upper", "c.n_marks")


def with_measures(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumns({
        "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "mark_share": share("n_marks", "word_chars"), "base_failed": failed})


def _cells(measured: DataFrame, labels: DataFrame, label: str, bins: int) -> tuple[DataFrame, dict[str, list[float]]]:
    """Counts by bins of all measures, part and class; and the thresholds between the bins."""
    bad = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) == 0).alias("bad"))
    rows = cut(measured.select("doc_id", *MEASURES).join(bad, "doc_id"), "quality-labelled")
    points = [k / bins for k in range(1, bins)]
    # quantiles of the whole and of the bad rows, so that a small class gets thresholds of its own
    quantiles = rows.agg(*[F.percentile_approx(m, points, 10_000).alias(m) for m in MEASURES], *[F.percentile_approx(F.when(F.col("bad"), F.col(m)), points, 10_000).alias(f"bad_{m}") for m in MEASURES]).first()
    cuts = {m: sorted({*(quantiles[m] or ()), *(quantiles[f"bad_{m}"] or ())}) for m in MEASURES}
    def bin_of(m):
        below = lambda t: t < F.col(m)
        return F.size(F.filter(F.array(*map(F.lit, cuts[m])), below)) if cuts[m] else F.lit(0)

    binned = [bin_of(m).alias(m) for m in MEASURES]
    grow = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow")
    return cut(rows.select(*binned, grow, "bad").groupBy(*MEASURES, "grow", "bad").count(), "quality-cells"), cuts


def _in_bins(condition: Condition, cuts: dict[str, list[float]]) -> Column:
    at = cuts[condition.measure].index(condition.threshold)
    return F.col(condition.measure) > at if condition.above else F.col(condition.measure) <= at


def _conjunction(conditions: list[Condition], cuts: dict[str, list[float]]) -> Column:
    return reduce(lambda a, b: a & b, (_in_bins(c, cuts) for c in conditions), F.lit(True))


def _class_counts(cells: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """Good and bad of every (measure, bin)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("b")) for m in MEASURES]))
    rows = cells.select(pairs.alias("p"), "bad", "count").groupBy("p.m", "p.b").agg(F.sum(F.when(~F.col("bad"), F.col("count")).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad"), F.col("count")).otherwise(0)).alias("bad")).collect()
    return {(r["m"], r["b"]): (r["good"], r["bad"]) for r in rows}


def _best_condition(counts, cuts, used: list[Condition]) -> tuple[float, Condition | None, int, int]:
    """The threshold with the highest gain ``p1 * (log p1/(p1+n1) - log p0/(p0+n0))``."""
    best = (0.0, None, 0, 0)
    for m in MEASURES:
        of = [counts.get((m, b), (0, 0)) for b in range(len(cuts[m]) + 1)]
        good, bad = sum(g for g, _ in of), sum(b for _, b in of)
        if not bad:
            return best
        before = math.log2(bad / (bad + good))
        low_good = low_bad = 0
        for at, threshold in enumerate(cuts[m]):
            low_good += of[at][0]
            low_bad += of[at][1]
            for above, g, b in ((False, low_good, low_bad), (True, good - low_good, bad - low_bad)):
                if b and (g, b) != (good, bad):
                    gain = b * (math.log2(b / (b + g)) - before)
                    condition = Condition(m, above, threshold)
                    if gain > best[0] + 1e-9 and condition not in used:
                        best = (gain, condition, g, b)
    return best


def learn_rules(measured: DataFrame, labels: DataFrame, label: str = "quality", bins: int = 16, max_rules: int = 8, max_conditions: int = 3, min_covered: int = 10, precision: float = 0.9) -> list[list[Condition]]:
    """The ordered rules; each is a conjunction that marks a bad document.  ``measured`` should be a written table."""
    cells, cuts = _cells(measured, labels, label, bins)
    rules: list[list[Condition]] = []
    open_ = cells
    while len(rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            counts = _class_counts(open_.where("grow").where(_conjunction(rule, cuts)))
            gain, condition, good, _ = _best_condition(counts, cuts, rule)
            if condition is None:
                break
            rule.append(condition)
            if not good:
                break
        if not rule:
            break
        covered = [_conjunction(rule[:k], cuts) for k in range(1, len(rule) + 1)]
        sums = [F.sum(F.when(c & (F.col("grow") == part) & (F.col("bad") == bad), F.col("count")).otherwise(0)).alias(f"c{k}_{int(part)}_{int(bad)}") for k, c in enumerate(covered) for part in (True, False) for bad in (True, False)]
        seen = open_.agg(*sums).first()
        value = lambda k: (seen[f"c{k}_0_1"] - seen[f"c{k}_0_0"]) / max(1, seen[f"c{k}_0_1"] + seen[f"c{k}_0_0"])
        keep = max(range(len(rule)), key=lambda k: (value(k), -k))
        bad, good = seen[f"c{keep}_0_1"] + seen[f"c{keep}_1_1"], seen[f"c{keep}_0_0"] + seen[f"c{keep}_1_0"]
        if bad < min_covered or bad < precision * (bad + good):
            break
        rules.append(rule[:keep + 1])
        open_ = open_.where(~_conjunction(rules[-1], cuts))
    return rules


def matched_rule(rules: list[list[Condition]]) -> Column:
    """The text of the first rule that holds, else null: an ordered conditional expression."""
    out = None
    for rule in rules:
        holds, name = reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(" and ".join(map(str, rule)))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return F.lit(None).cast("string") if out is None else out


def _measured(docs: DataFrame) -> DataFrame:
    """The measures of all documents as a written table (some numbers for each)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(with_measures(with_counts(ids, "doc_id")), "quality-measures")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the rule that rejected, for each row of ``docs``."""
    measured = _measured(docs)
    rule = matched_rule(learn_rules(measured, labels))
    return measured.select("doc_id", *BASE, "base_failed", rule.alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the base rule or a learned rule rejects.

    To learn, only documents that may be labelled are measured (a bounded bitmap tells); to
    judge, all are, in the scan.  No text is shuffled.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rules = learn_rules(_measured(with_perhaps(keyed, "doc_id", ids, "labelled").where("labelled")), labels)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    judged = with_measures(with_counts(held, "row")).where(~F.col("base_failed") & matched_rule(rules).isNull())
    return judged.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
