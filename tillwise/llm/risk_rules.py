"""Quality rules with cutoffs whose false rejections are bounded, by DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import WORD_BREAK, text_or_empty, written

#: rejected bad rows that outweigh one good row rejected
COST = 5
#: characters that count as symbols
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects rows whose feature, an SQL expression over the counts, is above (or, if `below`, under) a
    cutoff; cutoffs from mildest to harshest."""

    name: str
    feature: str
    cutoffs: tuple[float, ...]
    below: bool = False


#: shares of a text, so that the cutoffs hold at any length
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)),
    Rule("dup_lines", "n_dup_lines / greatest(n_text_lines, 1)", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.2, 0.175, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (40.0, 30.0, 20.0, 15.0, 12.0)),
    Rule("short_words", "word_chars / greatest(n_words, 1)", (1.5, 2.0, 2.5, 3.0), True),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
    Rule("marks", "n_marks / greatest(word_chars, 1)", (0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
)


def with_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts of each whole text; a null text is empty and has none.

    Words are runs of other than space and \\t \\n \\v \\f \\r. `n_repeat_words` counts the words inside 5-word
    windows that occur twice or more in the text: window hashes are sorted first; only a text in which two
    are equal is sorted with positions, and the covered words add up from the gaps between them."""
    base = df.select(id_col, *(keep or []), text_or_empty(text_col).alias("_text"))
    words = F.array_remove(F.split("_text", WORD_BREAK), "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("_words", words).withColumn("_lines", lines)
    w = F.col("_words")
    windows = F.when(F.size(w) >= 5, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("_windows", windows)
    base = base.withColumn("_twice", F.size("_windows") > F.size(F.array_distinct("_windows")))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("_placed", F.when(F.col("_twice"), placed))
    p = F.col("_placed")
    again = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))
    base = base.withColumn("_again", F.when(F.col("_twice"), F.sort_array(F.transform(again, lambda x: x["i"]))))
    a = F.col("_again")
    covered = F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(a, k + 1) - x, F.lit(5)))), F.lit(0), lambda s, x: s + x)
    text, joined = F.col("_text"), F.array_join("_words", "")
    return base.select(
        id_col, *(keep or []), F.size("_words").cast("long").alias("n_words"), F.length(joined).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_text_lines"),
        (F.length(joined) - F.length(F.regexp_replace(joined, r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
        (F.length(joined) - F.length(F.regexp_replace(joined, r"\p{P}", ""))).cast("long").alias("n_marks"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _grid(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(k).alias("step"), F.lit(float(c)).alias("cutoff"), _fails(r, F.lit(float(c))).alias("fails"))
                     for r in rules for k, c in enumerate(r.cutoffs)])


def _fails(rule: Rule, cutoff: Column) -> Column:
    value = F.expr(rule.feature)
    return F.coalesce(value < cutoff if rule.below else value > cutoff, F.lit(False))


def certified_cutoffs(holdout: DataFrame, stratum: str, good: str, rules: tuple[Rule, ...] = RULES, risk: float = 0.05,
                      doubt: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_false): for each stratum and rule the most useful certified cutoff.

    `holdout` has the features, the stratum and a label `good` (1: must not be rejected). A cutoff is
    certified if the exact binomial tail P(Bin(n_good, risk / rules) <= n_false) is at most
    doubt / (strata x rules), that is, if the Clopper-Pearson upper bound of its false rejections lies under
    risk / rules. Cutoffs are tested from the mildest on and testing stops at the first failure (fixed
    sequence), so no further correction is due within a rule; strata and rules share `doubt` evenly
    (Bonferroni). With probability 1 - doubt, in every stratum all rules together falsely reject at most
    `risk` of the good rows. A stratum with too few good rows certifies nothing.

    All certified cutoffs hold the bound at once, so any of them may be taken: that with most bad rows
    rejected, less `COST` for each good one, is; of equals the mildest."""
    share = risk / len(rules)
    fine = F.col("_fine") == 1
    counts = (holdout.where(F.col(good).isNotNull()).select(F.col(stratum).alias("stratum"), F.col(good).alias("_fine"), F.explode(_grid(rules)).alias("g"))
              .groupBy("stratum", "g.rule", "g.step", "g.cutoff").agg(
                  F.count_if(fine).alias("n"), F.count_if(fine & F.col("g.fails")).alias("k"), F.count_if(~fine & F.col("g.fails")).alias("bad")))
    strata = Window.partitionBy(F.lit(1))  # strata x rules x cutoffs rows
    counts = counts.withColumn("n_strata", F.size(F.collect_set("stratum").over(strata)) + F.max(F.col("stratum").isNull().cast("int")).over(strata))
    # log P(i) - log P(i - 1) = log((n - i + 1) / i) + log(share / (1 - share)); the tail sums exp of the running sum.
    # Where k / n is over the share already the tail is about a half or more, and nothing needs summing.
    odds, first = F.log(F.lit(share / (1 - share))), F.col("n") * F.log(F.lit(1 - share))
    step = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(F.col("k"), F.lit(1).cast("long"))),
        F.struct(first.alias("p"), F.exp(first).alias("s")),
        lambda s, i: F.struct((s["p"] + F.log((F.col("n") - i + 1) / i) + odds).alias("p"),
                              (s["s"] + F.exp(s["p"] + F.log((F.col("n") - i + 1) / i) + odds)).alias("s")),
        lambda s: s["s"])
    tail = F.when(F.col("k") >= F.col("n") * share, F.lit(1.0)).when(F.col("k") == 0, F.exp(first)).otherwise(step)
    passed = counts.withColumn("ok", tail <= doubt / (F.col("n_strata") * len(rules)))
    row = Window.partitionBy("stratum", "rule").orderBy("step")
    passed = passed.withColumn("ok", F.min(F.col("ok").cast("int")).over(row) == 1).where("ok")
    use = F.struct((F.col("bad") - COST * F.col("k")).alias("gain"), (-F.col("step")).alias("mild"))
    return passed.groupBy("stratum", "rule").agg(
        F.max_by("cutoff", use).alias("cutoff"), F.max_by("n", use).alias("n_good"), F.max_by("k", use).alias("n_false"))


def quality_verdicts(df: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text",
                     rules: tuple[Rule, ...] = RULES, risk: float = 0.05, doubt: float = 0.05) -> DataFrame:
    """Features, `base_failed` and `kept` of every row of `df`.

    A row is kept if it passes the base rules and no certified cutoff of its stratum rejects it. `labels`
    (id, quality 0/1) may cover any part of the rows; all labelled rows that pass the base rules are the
    holdout. A null stratum is a stratum of its own; null ids are judged but match no label; a row labelled
    twice counts once, as good if any label says so; repeated rows are judged one by one; without labels
    only the base rules reject. Other columns are not read."""
    # counts only: written once, as both the holdout and the verdicts read them; it also keeps the filters
    # below from being pushed into the array expressions, which would evaluate them many times over
    rows = written(with_features(df.withColumn("_stratum", F.col(stratum).cast("string")), id_col, text_col, ["_stratum"]), "quality-features")
    seen = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("_good"))
    holdout = rows.join(seen, rows[id_col] == seen["_id"]).where(~F.col("base_failed"))
    cutoffs = certified_cutoffs(holdout, "_stratum", "_good", rules, risk, doubt)
    found = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    # a row for each stratum; Spark broadcasts it where its measured size allows that
    judged = rows.join(found, F.col("_stratum").eqNullSafe(F.col("stratum")), "left")
    failed = F.lit(False)
    for rule in rules:
        failed = failed | F.coalesce(_fails(rule, F.col("_cutoffs")[rule.name]), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~failed).drop("stratum", "_cutoffs").withColumnRenamed("_stratum", "stratum")
