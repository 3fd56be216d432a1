"""Quality rules learnt as a decision list, in DataFrame operations alone.

Texts are measured by built-in functions: words, lines, symbols, repetition,
case and punctuation. Sequential covering then learns from labelled rows an
ordered list of rules, each a conjunction of thresholds that says a text is
poor: a rule is grown on two thirds of the labelled rows by the condition with
the best gain, pruned on the last third, and kept if it is precise there; the
rows it covers leave, and the next is grown. Each step is one aggregation over
binned measures, whose result has features x bins rows, whatever the corpus.
The list becomes one ordered CASE expression.

Nothing in the main path runs Python on executors, and no text is exploded:
repetition is measured within each row on arrays of hashes, in n log n steps.

Defined results: a null text counts as empty, with no words, and fails the base
rule. Labels with null ratings or ids are left out; several labels of a document
count each. With no labels, or labels of one kind, no rule is learnt, and the
base rule decides alone. Repeated rows are judged each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

SPACE = "\\x20\\x09-\\x0D"
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BINS = 24
MOST_RULES = 8
MOST_CONDITIONS = 3
LEAST_COVERED = 10
LEAST_PRECISION = 0.85


def counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, and per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and further counts (all long)."""
    without = lambda c, chars: F.translate(c, chars, "")
    t = F.col("text")
    rows = df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One level of columns for each thing that later ones read more than once.
    rows = rows.withColumns({"words": F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != ""), "lines": F.filter(F.split(t, "\n"), lambda x: F.length(without(x, SPACES)) > 0), "solid": without(t, SPACES)})
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length("solid").cast("long"),
            "n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_distinct": F.size(F.array_distinct("words")).cast("long"),
            "n_marks": (F.length(t) - F.length(without(t, "!?"))).cast("long"),
            "n_upper": F.length(F.regexp_replace("solid", "[^\\p{Lu}]+", "")).cast("long"),
            "n_digits": (F.length(t) - F.length(without(t, "0123456789"))).cast("long"),
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        }
    ).drop("words", "lines", "solid", "text")
    return rows.withColumn("n_repeat_words", repeated_words(F.col("hashes"))).drop("hashes")


def repeated_words(words: Column) -> Column:
    """How many of an array's elements lie in runs of five that occur twice or more in it, as a long.

    The runs' hashes are first compared with their distinct values (no run repeats in most texts). Where some do, runs
    are sorted with their places, those equal to a neighbour keep their places, and the union of these stretches of
    five is measured.
    """
    at = lambda x, i: F.get(x, i)
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(at(words, i + k) for k in range(WINDOW))))
    again = lambda p: F.filter(p, lambda x, i: ((i > 0) & (at(p, i - 1)["h"] == x["h"])) | at(p, i + 1)["h"].eqNullSafe(x["h"]))
    places = lambda p: F.sort_array(F.transform(p, lambda x: x["i"]))
    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])
    # transform over a one-element array names a value that is used more than once.
    name = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    some = name(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0).cast("long")).otherwise(name(F.sort_array(F.transform(r, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda p: covered(places(again(p))))))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(some)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Measures that rules may test, by name.
MEASURES: dict[str, tuple[str, str]] = {
    "words": ("n_words", ""),
    "chars_a_word": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "marks_a_word": ("n_marks", "n_words"),
    "upper_a_char": ("n_upper", "word_chars"),
    "digits_a_char": ("n_digits", "word_chars"),
    "dup_lines_a_line": ("n_dup_lines", "n_lines"),
    "repeat_words_a_word": ("n_repeat_words", "n_words"),
    "distinct_words_a_word": ("n_distinct", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def measure(name: str) -> Column:
    over, under = MEASURES[name]
    return F.col(over).cast("double") if not under else F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool  # the measure is over the threshold, else at most the threshold
    threshold: float
    bin: int

    def column(self) -> Column:
        m = measure(self.measure)
        return m > self.threshold if self.above else m <= self.threshold

    def binned(self) -> Column:
        b = F.get(F.col("bins"), list(MEASURES).index(self.measure))
        return b > self.bin if self.above else b <= self.bin


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        return all_of([c.column() for c in self.conditions])

    def binned(self) -> Column:
        return all_of([c.binned() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{c.measure} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def all_of(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def learn_rules(measured: DataFrame, labels: DataFrame, key: str = "doc_id", poor: str = "poor") -> list[Rule]:
    """Learns an ordered list of rules for poor texts from ``labels`` (key, poor boolean)."""
    rated = labels.select(F.col(key).alias("k"), F.col(poor).alias("poor")).where("k is not null and poor is not null")
    values = measured.where(F.col(key).isNotNull()).join(rated, F.col(key) == F.col("k")).select(F.col(key).alias("k"), "poor", F.array(*map(measure, MEASURES)).alias("values"))
    values = materialize(values, "labelled")
    edges = bin_edges(values)
    if not edges:
        return []
    bins = F.array(*(sum((F.when(F.get("values", i) > e, 1).otherwise(0) for e in some), F.lit(0)) for i, some in enumerate(edges)))
    held = materialize(values.select("poor", bins.cast("array<int>").alias("bins"), (F.pmod(F.xxhash64("k"), F.lit(3)) == 0).alias("prune")), "binned")
    rules: list[Rule] = []
    left = held
    while len(rules) < MOST_RULES:
        rule = grow(left.where("not prune"), edges)
        if rule is None or (rule := prune(left, rule)) is None:
            return rules
        rules.append(rule)
        left = left.where(~rule.binned())
    return rules


def bin_edges(values: DataFrame) -> list[list[float]]:
    """Thresholds of each measure: quantiles of poor and of other rows, so that both are told apart finely."""
    shares = [(i + 1) / BINS for i in range(BINS - 1)]
    rows = values.groupBy("poor").agg(*(F.percentile_approx(F.get("values", i), shares, 1000).alias(f"q{i}") for i in range(len(MEASURES)))).collect()
    if len(rows) < 2:
        return []
    return [sorted({e for r in rows for e in r[f"q{i}"]}) for i in range(len(MEASURES))]


def tallies(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """(measure, bin, poor, others), one aggregation."""
    long = rows.select(F.posexplode("bins").alias("m", "b"), "poor").groupBy("m", "b").agg(F.count_if("poor").alias("p"), F.count_if(~F.col("poor")).alias("n"))
    return [(r["m"], r["b"], r["p"], r["n"]) for r in long.collect()]


def grow(rows: DataFrame, edges: list[list[float]]) -> Rule | None:
    """Adds the condition of most information gain until the rule is pure, long enough, or nothing is gained."""
    names, conditions = list(MEASURES), ()
    while len(conditions) < MOST_CONDITIONS:
        got = tallies(rows.where(all_of([c.binned() for c in conditions])))
        total_p, total_n = (sum(x[k] for x in got if x[0] == 0) for k in (2, 3))
        if not total_p or not total_n:
            break
        best, now = None, math.log2(total_p / (total_p + total_n))
        for m, some in enumerate(edges):
            by_bin = {b: (p, n) for k, b, p, n in got if k == m}
            p = n = 0
            for b, edge in enumerate(some):
                p, n = p + by_bin.get(b, (0, 0))[0], n + by_bin.get(b, (0, 0))[1]
                for above, pos, neg in ((False, p, n), (True, total_p - p, total_n - n)):
                    if pos + neg >= LEAST_COVERED and pos:
                        gain = pos * (math.log2(pos / (pos + neg)) - now)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, Condition(names[m], above, edge, b))
        if best is None or best[0] <= 1e-9:
            break
        conditions += (best[1],)
    return Rule(conditions, 0.0, 0) if conditions else None


def prune(left: DataFrame, rule: Rule) -> Rule | None:
    """Keeps the first conditions that do best on the rows held back; drops the rule if it isn't precise there."""
    prefixes = [Rule(rule.conditions[: k + 1], 0.0, 0) for k in range(len(rule.conditions))]
    sums = [F.count_if(r.binned() & F.col("poor") & (F.col("prune") == part)).alias(f"p{part}{i}") for i, r in enumerate(prefixes) for part in (False, True)]
    sums += [F.count_if(r.binned() & ~F.col("poor") & (F.col("prune") == part)).alias(f"n{part}{i}") for i, r in enumerate(prefixes) for part in (False, True)]
    got = left.agg(*sums).collect()[0]
    best = None
    for i, r in enumerate(prefixes):
        p, n = got[f"pTrue{i}"], got[f"nTrue{i}"]
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth >= best[0]:
            best = (worth, i, p, n)
    _, i, p, n = best
    covered = p + n + got[f"pFalse{i}"] + got[f"nFalse{i}"]
    precision = (p + got[f"pFalse{i}"]) / covered if covered else 0.0
    held_back = p / (p + n) if p + n else precision
    if covered < LEAST_COVERED or precision < LEAST_PRECISION or held_back < LEAST_PRECISION:
        return None
    return Rule(prefixes[i].conditions, precision, covered)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1, in one CASE expression; null if none does."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r.column(), i).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", poor: str = "poor") -> DataFrame:
    """Counts of every row, base_failed, rule (the first that holds, or null) and kept."""
    measured = materialize(counts(docs, key, text), "counts")
    rules = learn_rules(measured, labels, key, poor)
    out = measured.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
