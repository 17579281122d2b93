from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import quality_rules as Q

from .conftest import words


def brute(text):
    w = words(text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            again |= {k, k + 1, k + 2}
    lines, twice = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            twice += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(again)


def test_statistics(docs, no_docs, corpus, multiset):
    got = Q.measured(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert multiset(got) == multiset([(i, *brute(t)) for i, t, _ in corpus])
    assert Q.measured(no_docs).collect() == []


def test_odd_texts(spark, multiset):
    texts = ["a a a", "a a a a", "a b c a b c", "x y", "\n\n", "l\nl\n l\nl", "é#é|<", "a b a b a b", "\x1c \x85", "one\n\none\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Q.measured(df).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert multiset(got) == multiset([(k, *brute(t)) for k, t in enumerate(texts)])


def labelled(spark, n=600):
    rnd = random.Random(4)
    say = lambda n, mark: " ".join("w%d%s" % (rnd.randrange(10**6), mark) for _ in range(n))
    rows = [(k, say(rnd.randint(60, 90), "%%%" if k % 4 == 0 else ""), 0 if k % 4 == 0 else 1) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_learned_rules_separate(spark):
    df = labelled(spark)
    got = Q.quality(df.drop("quality"), df.select("doc_id", "quality"))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    assert got.join(df, "doc_id").where(F.col("kept") != (F.col("quality") == 1)).count() == 0
    rules = Q.learn(Q.measured(df), df).rules
    # the symbols make words longer as well, so either feature alone separates
    assert len(rules) == 1 and [c.feature for c in rules[0]] in (["symbol_share"], ["mean_word"])


SHARES = ("symbol_share", "upper_share", "repeat_share")


def statistics(spark, rows):
    """Statistics of rows (id, shares in the order of SHARES, quality); all are of 1000 words and characters."""
    columns = "id long, n_words long, word_chars long, n_symbols long, n_upper long, n_repeat_words long, n_dup_lines long, n_lines long"
    stats = [(i, 1000, 1000, round(1000 * a), round(1000 * b), round(1000 * c), 0, 10) for i, (a, b, c), _ in rows]
    return spark.createDataFrame(stats, columns).repartition(3), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")


def features_of(rules):
    return [sorted({c.feature for c in rule}) for rule in rules]


def verdicts(stats, rules):
    """Ids that the rules reject."""
    return {r["id"] for r in stats.where(Q.DecisionList(rules).number().isNotNull()).collect()}


def test_a_rule_of_two_conditions(spark):
    """Bad rows are full of symbols and of capitals; rows full of either alone are good."""
    rnd = random.Random(1)
    rows = []
    for i in range(1500):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append((i, (rnd.uniform(0.5, 0.9) if a else rnd.uniform(0, 0.4), rnd.uniform(0.5, 0.9) if b else rnd.uniform(0, 0.4), 0.1), int(not (a and b))))
    stats, labels = statistics(spark, rows)
    rules = Q.learn(stats, labels).rules
    assert features_of(rules) == [["symbol_share", "upper_share"]]
    bad = {i for i, _, q in rows if not q}
    assert len(verdicts(stats, rules) ^ bad) <= 0.01 * len(bad)
    # one condition can't tell them: half of what it matches is good
    assert Q.learn(stats, labels, max_conditions=1).rules == ()


def test_conditions_that_only_fit_the_growing_rows_are_pruned(spark, monkeypatch):
    """A fifth of the labels are wrong by chance, so growth goes on where pruning stops."""
    rnd = random.Random(2)
    rows = []
    for i in range(1500):
        a = rnd.random() < 0.4
        rows.append((i, (rnd.uniform(0.5, 0.9) if a else rnd.uniform(0, 0.4), rnd.random(), rnd.random()), int(not a) if rnd.random() < 0.9 else rnd.randrange(2)))
    stats, labels = statistics(spark, rows)
    kept = Q.pruned
    seen = []
    monkeypatch.setattr(Q, "pruned", lambda held, conditions: seen.append((conditions, got := kept(held, conditions))) or got)
    rules = Q.learn(stats, labels, max_rules=1).rules
    (conditions, (left, p, n)) = seen[0]
    assert len(conditions) > len(left) == len(rules[0]) and p > 5 * n
    assert rules[0][0].feature == "symbol_share" and 0.39 < rules[0][0].threshold < 0.5
    # without pruning the rule misses bad rows
    monkeypatch.setattr(Q, "pruned", lambda held, conditions: (conditions, p, n))
    whole = Q.learn(stats, labels, max_rules=1).rules
    assert len(verdicts(stats, whole)) < len(verdicts(stats, rules))


def test_a_second_rule_for_what_the_first_leaves(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        kind = rnd.choices(["good", "symbols", "capitals"], [60, 25, 15])[0]
        high, low = rnd.uniform(0.5, 0.9), rnd.uniform(0, 0.4)
        rows.append((i, (high if kind == "symbols" else low, high if kind == "capitals" else low, 0.1), int(kind == "good")))
    stats, labels = statistics(spark, rows)
    learned = Q.learn(stats, labels)
    assert features_of(learned.rules) == [["symbol_share"], ["upper_share"]]
    assert verdicts(stats, learned.rules) == {i for i, _, q in rows if not q}
    numbers = Counter(r["n"] for r in stats.select(learned.number().alias("n")).collect())
    assert set(numbers) == {1, 2, None} and numbers[1] > numbers[2]
    assert features_of(Q.learn(stats, labels, max_rules=1).rules) == [["symbol_share"]]


def test_clashing_columns_of_labels(spark):
    df = labelled(spark)
    extra = df.select("doc_id", "quality", *[F.lit(7).alias(c) for c in ("id", "prunes", "fold", "bin", "value", "feature", "n_words", "symbol_share")])
    assert Q.learn(Q.measured(df), extra).rules == Q.learn(Q.measured(df), df).rules


def test_a_defect_of_few_bad_rows_is_found(spark):
    """15 % of the bad rows are in capitals, the others full of symbols; every row has some capitals."""
    rnd = random.Random(6)

    def say(kind):
        share = rnd.uniform(0, 0.5)
        w = ["word%d" % rnd.randrange(10**6) for _ in range(rnd.randint(60, 90))]
        w = [x.capitalize() if rnd.random() < share else x for x in w]
        return " ".join(x + "%%%" if kind == "symbols" else x.upper() if kind == "capitals" else x for x in w)

    kinds = [rnd.choices(["good", "symbols", "capitals"], [75, 21, 4])[0] for _ in range(2400)]
    rows = [(k, say(kind), kind, int(kind == "good")) for k, kind in enumerate(kinds)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, quality int").repartition(3)
    got = Q.quality(df.drop("quality", "kind"), df.select("doc_id", "quality")).join(df, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    kept = {r["kind"]: (r["all"], r["kept"]) for r in got.groupBy("kind").agg(F.count("*").alias("all"), F.count(F.when(F.col("kept"), 1)).alias("kept")).collect()}
    assert kept["capitals"][0] >= 10 and kept["capitals"][1] == 0 and kept["symbols"][1] == 0
    assert kept["good"][1] >= 0.99 * kept["good"][0]


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality(docs, none).collect()
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] != failed and r["rule"] is None
    one_kind = spark.createDataFrame([(10, 1), (20, 1), (None, 0), (30, None)], "doc_id long, quality int")
    assert Q.learn(Q.measured(docs), one_kind).rules == ()


def test_no_python_in_the_plan(spark, docs):
    from millrace.plans.inspect import operators

    none = spark.createDataFrame([], "doc_id long, quality int")
    assert not [o for o in operators(Q.measured(docs)) + operators(Q.quality(docs, none)) if "Python" in o or "Arrow" in o or "Pandas" in o]
