"""Quality rules: decision lists learned from labelled statistics, all in DataFrame operations.

Sequential covering: a rule is a conjunction of thresholds that grows by information gain on one
part of the labelled rows and is pruned on another; the rows it covers go, and the next rule is
grown on the rest.  For every condition Spark counts the rows left between quantiles of each
feature, so every labelled row counts and the driver sees a table bounded by the number of bins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, narrow_reads, saved

#: Statistics that rules may use, as SQL over the measured columns.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
}
#: Quantiles of each class that become thresholds of a feature, anew for the rows left by every rule and condition.
POINTS = (0.0, 0.001, 0.005, *(k / 100 for k in range(1, 100)), 0.995, 0.999, 1.0)


def let(value: Column, use) -> Column:
    """``use(x)`` with x evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that stands twice or more in the array."""
    n = F.size(words)
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def twice(s):
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))
        return F.transform(F.filter(s, same), lambda x: x["i"])

    def total(at):
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.sort_array(windows), lambda s: let(F.array_sort(twice(s)), total))


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper); a null text is empty.

    Windows are compared by 64-bit hashes within one text; each text is worked on by sorting, so the
    time for a long one grows as n log n.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("twice")))
    # struct fields are read twice each below, so the optimiser keeps one evaluation of each struct
    parts = docs.select(
        F.col(id_column).alias("id"), by_words.alias("w"), by_lines.alias("l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    return parts.select(
        "id", "w.n_words", "w.word_chars", "n_symbols", F.col("l.twice").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.all").alias("n_lines"), "n_upper"
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that rejects; what none matches is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def number(self) -> Column:
        """The first rule that matches, from 1; null if none does."""
        found = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            matches = F.lit(True)
            for c in self.rules[k - 1]:
                matches = matches & c.column()
            found = F.when(matches, F.lit(k)).otherwise(found)
        return found


def bin_of(feature: str, cuts: list[float]) -> str:
    """SQL for how many of the sorted ``cuts`` are less than the feature, by halving."""

    def between(a: int, b: int) -> str:
        if a == b:
            return str(a)
        k = (a + b) // 2
        return f"if({feature} > {cuts[k]!r}D, {between(k + 1, b)}, {between(a, k)})"

    return between(0, len(cuts))


def next_condition(held: DataFrame) -> Condition | None:
    """The condition with the most information gain on rows (quality, features), if any gains.

    The driver gets len(POINTS) values of each class and feature, and a count for each bin between them.
    """
    found = held.groupBy("quality").agg(*[F.percentile_approx(f, list(POINTS), 10_000).alias(f) for f in FEATURES]).collect()
    if len(found) < 2:
        return None
    cuts = {f: sorted({float(x) for r in found for x in r[f]}) for f in FEATURES}
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.expr(bin_of(f, cuts[f])).alias("bin"), F.col(f).alias("value")) for f in FEATURES])
    cells = held.select("quality", F.explode(each).alias("x")).groupBy("x.feature", "x.bin", "quality").agg(F.count("*").alias("n"), F.min("x.value").alias("least"))
    sums = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
    least: dict[tuple[str, int], float] = {}
    for r in cells.collect():
        sums[r["feature"]][r["bin"]][r["quality"] != 0] += r["n"]
        at = r["feature"], r["bin"]
        least[at] = min(least.get(at, r["least"]), r["least"])
    best = (1e-9, None)
    for f in FEATURES:
        p0, n0 = (sum(s[k] for s in sums[f]) for k in (0, 1))
        below = [0, 0]
        for k in range(len(cuts[f])):
            below = [below[0] + sums[f][k][0], below[1] + sums[f][k][1]]
            for above, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                if p:
                    gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                    best = max(best, (gain, (f, above, k)), key=lambda b: b[0])
    if best[1] is None:
        return None
    f, above, k = best[1]
    # the threshold stands in the middle between the cut and the next larger value that a row has
    following = next((least[f, b] for b in range(k + 1, len(cuts[f]) + 1) if (f, b) in least), cuts[f][k])
    return Condition(f, above, (cuts[f][k] + following) / 2)


def learn(
    stats: DataFrame, labels: DataFrame, max_rules: int = 8, max_conditions: int = 4, precision: float = 0.8, id_column: str = "doc_id"
) -> DecisionList:
    """Learn which statistics mark the rows with ``quality`` 0 among those in ``stats``.

    A rule must reach ``precision``, by Laplace's estimate, on the rows that prune.
    Labels of one id count once (the lowest); rows with crc32(id as text) mod 5 = 0 are held out, 1
    prunes, the rest grow.  No labels, or labels of one kind, give an empty list.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    features = [F.expr(sql).alias(name) for name, sql in FEATURES.items()]
    rows = stats.join(known, "id").where(fold != 0).select("quality", (fold == 1).alias("prunes"), *features)
    rows = saved(rows.hint("rebalance"), "labelled")
    try:
        return DecisionList(tuple(covering(rows, max_rules, max_conditions, precision)))
    finally:
        dropped(rows)


def matching(conditions: list[Condition]) -> Column:
    held = (F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold for c in conditions)
    return reduce(and_, held, F.lit(True))


def grown(rows: DataFrame, max_conditions: int) -> list[Condition]:
    """Conditions, each the best on the rows that those before it match, until none gains."""
    conditions: list[Condition] = []
    while len(conditions) < max_conditions:
        best = next_condition(rows.where(matching(conditions)))
        if best is None:
            break
        conditions.append(best)
    return conditions


def pruned(rows: DataFrame, conditions: list[Condition]) -> tuple[list[Condition], int, int]:
    """The beginning of the rule that tells bad rows best from good ones, and how many of each it matches."""
    bad = F.col("quality") == 0
    held = [F.count(F.when(matching(conditions[:k]) & kind, 1)) for k in range(1, len(conditions) + 1) for kind in (bad, ~bad)]
    counts = list(rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(held)]).first())
    pairs = list(zip(counts[::2], counts[1::2], strict=True))
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in pairs]
    k = max(range(len(worth)), key=lambda k: (worth[k], -k))
    return conditions[: k + 1], *pairs[k]


def covering(rows: DataFrame, max_rules: int, max_conditions: int, precision: float) -> list[tuple[Condition, ...]]:
    """Rules from rows (quality, prunes, features), each grown and pruned on what those before it leave."""
    rules: list[tuple[Condition, ...]] = []
    left = rows
    while len(rules) < max_rules:
        conditions = grown(left.where(~F.col("prunes")), max_conditions)
        if not conditions:
            break
        conditions, p, n = pruned(left.where("prunes"), conditions)
        if p + 1 < precision * (p + n + 2):
            break
        rules.append(tuple(conditions))
        left = left.where(~matching(conditions))
    return rules


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule), one for each input row.

    The list is learned from labelled rows that pass the base rule.  Null, empty and wordless texts
    have no words and fail the base rule.  Null ids stay null, equal
    rows stay apart, an empty table gives no rows; other columns are ignored.

    Texts are read once: their statistics, some numbers a row, are dealt out anew and written in few
    files, from which the rules are learned and to which they are applied.
    """
    with narrow_reads(docs.sparkSession):
        stats = saved(measured(docs, id_column, text_column).hint("rebalance"), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rule = learn(stats.where(~failed), labels, id_column=id_column).number()
    return stats.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & rule.isNull()).alias("kept"), rule.alias("rule"),
    )
