"""Quality rules as a learned decision list.

Every text gets counts (words, symbols, repeated lines, words in repeated five-word windows, ...) as built-in
column expressions. Sequential covering learns from labelled rows: a rule grows by the threshold test with the
best information gain until it covers no accepted row, is pruned from its end on rows held back from growing,
and stays if it is precise enough on both parts; what it covers is taken out and the next rule is grown. The
list is emitted as one ordered ``CASE`` expression, so scoring is a projection.

The learner runs on the driver over a bounded sample: the ``SAMPLE`` labelled documents whose hashed ids come
first. All statistics of scored documents cover whole texts.

Defined cases: a null text has no words; a document labelled both ways, or with null, is not learned from; with
no labels, or none rejected, the list is empty and keeps everything; rows that repeat are judged alike; other
columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.words import held, words_of

#: Labelled documents that the learner sees at most.
SAMPLE = 20_000
#: Thresholds tried for each measure; least share of truly rejected rows in what a rule covers; least rejected rows covered.
CUTS, PRECISION, LEAST, RULES, TESTS = 32, 0.95, 10, 16, 4
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test: shares and means, so that a rule means the same for short and long texts.
MEASURES = ["symbol_share", "mean_word", "repeat_share", "dup_lines_share", "upper_share", "shout_share", "distinct_share", "digit_share"]


def _without(text: str, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns ``own`` (the row), the counts, base_failed and the measures derived from them."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    df = df.select("own", "t", held(words_of(F.col("t"))).alias("w"))
    w, n = F.col("w"), F.size("w")
    at = lambda i: [F.get(w, i + k) for k in range(WINDOW)]
    starts = F.sequence(F.lit(0), n - WINDOW)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "own", "t", "w", lines.alias("lines"), held(n.cast("long")).alias("n_words"),
        # equal windows have equal hashes: texts with all hashes different need no closer look
        F.when(n > WINDOW, F.size(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*at(i))))) < n - WINDOW + 1).otherwise(False).alias("looks"),
    )
    ordered = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("k"), i.alias("i"))))
    df = df.select("own", "t", "w", "lines", "n_words", held(F.when(F.col("looks"), ordered)).alias("windows"))
    windows = F.col("windows")
    twin = lambda j: (F.get(windows, j)["k"] == F.get(windows, j - 1)["k"]) | (F.get(windows, j)["k"] == F.get(windows, j + 1)["k"])
    seats = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda j: F.coalesce(twin(j), F.lit(False)))
    df = df.select("own", "t", "w", "lines", "n_words", held(F.when(windows.isNotNull(), F.sort_array(F.transform(seats, lambda j: F.get(windows, j)["i"])))).alias("at"))
    found = F.col("at")
    covered = F.when(F.size(found) > 1, F.aggregate(F.sequence(F.lit(0), F.size(found) - 2), F.lit(0), lambda a, j: a + F.least(F.lit(WINDOW), F.get(found, j + 1) - F.get(found, j)))).otherwise(0) + WINDOW
    joined = F.array_join("w", "")
    df = df.select(
        "own", held(F.col("n_words")).alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        _without("t", "[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(found.isNotNull() & (F.size(found) > 0), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("w")).alias("n_distinct"),
        _without("t", "[A-Z]").alias("n_upper"), _without("t", "!").alias("n_shouts"), _without("t", "[0-9]").alias("n_digits"),
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return df.select(
        "own", *COUNTS,
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbol_share"), (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_repeat_words") / words).alias("repeat_share"), (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines_share"),
        (F.col("n_upper") / chars).alias("upper_share"), (F.col("n_shouts") / words).alias("shout_share"),
        (F.col("n_distinct") / words).alias("distinct_share"), (F.col("n_digits") / chars).alias("digit_share"),
    )


@dataclass(frozen=True)
class Test:
    """One threshold test of a rule."""

    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.measure).cast("double")
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Test, ...]


def _centred(test: Test, rows: list[tuple[list[float], bool]], j: int, out: int, hit: int) -> Test:
    """The test with its cut moved to the middle between the accepted rows left out and the rejected rows hit, if a gap parts them."""
    held = [[rows[i][0][j] * (1 if test.above else -1) for i in range(len(rows)) if bits >> i & 1] for bits in (out, hit)]
    low, high = max(held[0], default=math.inf), min(held[1], default=-math.inf)
    return Test(test.measure, test.above, (low + high) / (2 if test.above else -2)) if low < high else test


def learn_rules(rows: list[tuple[list[float], bool]], measures: list[str] = MEASURES, precision: float = PRECISION, least: int = LEAST, cuts: int = CUTS) -> list[Rule]:
    """Rules for the rejected rows of (measures, rejected); sets of rows are bits of integers. Every third row is held back for pruning."""
    n = len(rows)
    bad = sum(1 << i for i in range(n) if rows[i][1])
    good = ((1 << n) - 1) & ~bad
    held = sum(1 << i for i in range(2, n, 3))
    grown = ((1 << n) - 1) & ~held
    tests: list[tuple[Test, int]] = []
    for j, measure in enumerate(measures):
        order = sorted(range(n), key=lambda i: rows[i][0][j])
        values = [rows[i][0][j] for i in order]
        at = sorted({values[n * q // cuts] for q in range(cuts)} | {values[n * q // (8 * cuts)] for q in (1, 2, 4, 8 * cuts - 4, 8 * cuts - 2, 8 * cuts - 1)}) if n else []
        low, k = 0, 0
        for a, b in zip(at, at[1:]):  # halfway between neighbouring cuts' values
            while k < n and values[k] <= a:
                low |= 1 << order[k]
                k += 1
            cut = (values[k - 1] + values[k]) / 2 if k < n else a
            tests += [(Test(measure, False, cut), low), (Test(measure, True, cut), ((1 << n) - 1) & ~low)]
    rules: list[Rule] = []
    left = (1 << n) - 1
    while len(rules) < RULES:
        cover, rule = left, []
        while len(rule) < TESTS and (cover & good & grown):
            p, q = (cover & bad & grown).bit_count(), (cover & good & grown).bit_count()
            if not p:
                break
            now, best = math.log2(p / (p + q)), (0.0, None)
            for test, rows_in in tests:
                a = (cover & rows_in & bad & grown).bit_count()
                if a >= least // 2:
                    b = (cover & rows_in & good & grown).bit_count()
                    gain = a * (math.log2(a / (a + b)) - now)
                    if gain > best[0] + 1e-9:
                        best = (gain, (test, rows_in))
            if best[1] is None:
                break
            rule.append(best[1])
            cover &= best[1][1]
        worth = []
        for k in range(1, len(rule) + 1):
            part = left
            for _, rows_in in rule[:k]:
                part &= rows_in
            p, q = (part & bad & held).bit_count(), (part & good & held).bit_count()
            both = (part & bad).bit_count(), (part & good).bit_count()
            if both[0] >= least and (both[0] + 1) / (sum(both) + 2) >= precision and (p + 1) / (p + q + 2) >= min(precision, (p + 1) / (p + 2)):
                worth.append(((p - q) / max(1, p + q), p, -k, part))
        if not worth:
            break
        _, _, k, part = max(worth)
        rules.append(tuple(_centred(test, rows, measures.index(test.measure), left & ~rows_in & good, part & bad) for test, rows_in in rule[:-k]))
        left &= ~part
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        holds = F.lit(True)
        for test in rules[i - 1]:
            holds = holds & test.column()
        out = F.when(holds, F.lit(i)).otherwise(out)
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Learn from documents that the labels (doc_id, quality 0 or 1) tell apart and that the base rules let pass."""
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    told = told.filter("low = high").select("doc_id", (F.col("low") == 0).alias("rejected")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(told), "doc_id")
    counted = text_counts(own).filter(~F.col("base_failed")).orderBy(F.xxhash64("own.doc_id"), "own.doc_id", "n_words", "word_chars").limit(sample)
    rows = counted.select(F.array(*[F.col(m).cast("double") for m in MEASURES]).alias("m"), "own.rejected").collect()
    return learn_rules([(r.m, r.rejected) for r in rows])


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``own`` (the row), counts, base_failed, rule (the rule that rejects it, or null) and kept."""
    judged = text_counts(docs, text_col).withColumn("rule", F.when(~F.col("base_failed"), rules_column(rules)))
    return judged.select("own", *COUNTS, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
