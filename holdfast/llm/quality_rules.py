"""Quality rules: text statistics and a learned decision list, in Spark expressions alone.

``statistics`` measures every text without leaving its row. ``learn`` grows one rule after
another on labelled statistics (sequential covering): a rule is a conjunction of
thresholds, extended by the condition of highest information gain on two thirds of the
rows still uncovered, and cut back to the prefix that separates best on the other third.
The rows that a rule covers are set aside for the next one. Every step is one aggregation
to counts by statistic and threshold interval, at most ``len(MEASURES) * (CUTS + 1)`` rows.
``decision`` turns the list into one ordered CASE expression.

Defined results: a null text has no words and fails the base rule; a text of white space
likewise; repeated rows are measured each; a label of null teaches nothing; with no labels
the list is empty and the base rule alone decides; other columns are left out. Three-word
windows are compared by a 64-bit hash within a text.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import settled

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (
    "n_words",
    "mean_word",
    "symbol_share",
    "mark_share",
    "upper_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
)
CUTS = 100
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_COVERED = 5
MIN_PRECISION = 0.99


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs again; ``hashes`` has one entry a window, in order."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # transform over a one-element array names the sorted windows, so that they are made once.
    again = F.flatten(
        F.transform(
            F.array(ranked),
            lambda w: F.filter(w, lambda x, k: (F.get(w, k - 1)["h"] == x["h"]) | (F.get(w, k + 1)["h"] == x["h"])),
        )
    )
    places = F.transform(again, lambda x: x["i"])
    covered = F.flatten(F.transform(F.array(places), lambda p: F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.size(F.array_distinct(covered)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, ``base_failed`` and the measures that rules may test."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        "doc_id",
        text.alias("text"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    triples = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    hashed = cut.withColumn("hashes", F.slice(triples, 1, F.greatest(F.size("words") - 2, F.lit(0))))

    def without(characters: str) -> Column:
        return F.length("text") - F.length(F.translate("text", characters, ""))

    counted = hashed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.length("text").alias("n_chars"),
        without("!?").alias("n_marks"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_upper"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return counted.select(
        "doc_id",
        *BASE,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "n_chars").alias("symbol_share"),
        share("n_marks", "n_chars").alias("mark_share"),
        share("n_upper", "n_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        value = F.col(self.measure).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def all_hold(rule: Rule) -> Column:
    holds = F.lit(True)
    for condition in rule:
        holds &= condition.holds()
    return holds


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _place(measure: str, edges: list[float]) -> Column:
    """The measure's name and the number of edges below its value."""
    value = F.col(measure).cast("double")
    below = F.filter(F.array(*map(F.lit, edges)), lambda edge: edge < value)
    return F.struct(F.lit(measure).alias("measure"), F.size(below).alias("place"), value.alias("value"))


def _extension(rows: DataFrame, cuts: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition | None, int, int]:
    """The best further condition on the rows that the rule so far covers, and what it would cover."""
    places = [_place(measure, edges) for measure, edges in cuts.items()]
    counts = (
        rows.select("bad", F.explode(F.array(*places)).alias("at"))
        .groupBy("at.measure", "at.place")
        .agg(
            F.sum("bad").alias("p"),
            F.sum(1 - F.col("bad")).alias("n"),
            F.min("at.value").alias("low"),
            F.max("at.value").alias("high"),
        )
        .collect()
    )
    best: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for measure, edges in cuts.items():
        # Place i: value <= edge i and above the edge before.
        at = sorted((row for row in counts if row["measure"] == measure), key=lambda row: row["place"])
        p = n = 0
        for row, following in zip(at, at[1:]):
            p, n = p + row["p"], n + row["n"]
            for above, hits, misses in ((False, p, n), (True, p0 - p, n0 - n)):
                if hits >= MIN_COVERED and (gain := _gain(hits, misses, p0, n0)) > best[0]:
                    # The threshold lies midway between the values on its two sides.
                    best = (gain, Condition(measure, above, (row["high"] + following["low"]) / 2), hits, misses)
    return best


def _counts(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    sums = [F.sum(F.when(all_hold(rule), bad)) for rule in rules for bad in (F.col("bad"), 1 - F.col("bad"))]
    found = [x or 0 for x in rows.agg(*sums).first()]
    return list(zip(found[::2], found[1::2]))


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for low quality, from rows with doc_id, the measures and ``quality`` (0 or 1)."""
    rows = settled(
        labelled.where(F.col("quality").isNotNull()).select(
            *MEASURES,
            (1 - F.col("quality")).cast("long").alias("bad"),
            (F.crc32(F.concat(F.lit("prune "), F.col("doc_id").cast("string"))) % 3 == 0).alias("prunes"),
        ),
        "labelled-statistics",
    )
    points = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    edges = rows.agg(*[F.percentile_approx(F.col(m).cast("double"), points, 10_000).alias(m) for m in MEASURES]).first()
    if edges[0] is None:
        return []
    cuts = {m: sorted(set(edges[m])) for m in MEASURES}
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grow, prune = rows.where(~F.col("prunes")), rows.where("prunes")
        [(p, n)] = _counts(grow, [()])
        if p < MIN_COVERED:
            break
        rule: Rule = ()
        while n and len(rule) < MAX_CONDITIONS:
            gain, condition, hits, misses = _extension(grow.where(all_hold(rule)), cuts, p, n)
            if condition is None:
                break
            rule, p, n = (*rule, condition), hits, misses
        prefixes = [rule[:size] for size in range(1, len(rule) + 1)]
        if not prefixes:
            break
        # The shortest of the prefixes that separate best: (p - n) / (p + n) on the other rows.
        worth = [((p - n) / (p + n) if p + n else -1.0, -len(x), x, p, n) for (p, n), x in zip(_counts(prune, prefixes), prefixes)]
        _, _, rule, p, n = max(worth, key=lambda w: w[:2])
        if not p or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        rows = rows.where(~all_hold(rule))
    return rules


def decision(rules: list[Rule]) -> Column:
    """The place of the first rule that holds, from 1; null where none does."""
    first = F.when(F.lit(False), 0)
    for place, rule in enumerate(rules, 1):
        first = first.when(all_hold(rule), place)
    return first


def described(rules: list[Rule]) -> list[str]:
    return [" AND ".join(map(str, rule)) for rule in rules]


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every row, the rule that rejects it, and ``kept``."""
    measured = settled(statistics(docs), "text-statistics")
    # The list decides on what the base rule lets through, so it learns from that alone.
    rules = learn(measured.where(~F.col("base_failed")).join(labels.select("doc_id", "quality"), "doc_id"))
    rule = decision(rules)
    return measured.select(
        "doc_id", *BASE, "base_failed", (~F.col("base_failed") & rule.isNull()).alias("kept"), rule.cast("int").alias("rule")
    )
