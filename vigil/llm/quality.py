"""Quality rules: base counts of a text, and decision lists learned by sequential covering."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import SPACE, let, text_of, words_of

SYMBOLS = "[#*$%&|<>]"
FIT_ROWS = 20_000
THRESHOLDS = 48
MOST_RULES = 12
MOST_CONDITIONS = 3
PRECISION = 0.95
LEAST_ROWS = 8

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "mark_share", "upper_share", "digit_share", "repeat_share", "dup_line_share",
            "distinct_share", "word_length", "line_words"]
_COUNTS = ["_n", "_no_symbols", "_no_marks", "_no_upper", "_no_digits", "_n_lines", "_new_lines", "_distinct"]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice among ``words`` (all occurrences count)."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(
        F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def covered(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        several = let(placed, lambda p: F.filter(
            p, lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))))
        return F.aggregate(
            F.sort_array(F.transform(several, lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"])
    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``BASE``, base_failed and ``FEATURES`` in place of any columns of those names.

    The counts are those of the whole text: code points in words, characters that are symbols, lines
    with a word that equal an earlier line, and words in 3-word windows found twice or more.  Null text
    counts as empty.  All of it is column expressions over the row, without a shuffle.
    """
    taken = {*BASE, *FEATURES, "base_failed", "_text", *_COUNTS}
    names = [c for c in docs.columns if c not in taken]

    def counts(text):
        def without(pattern):
            return F.length(F.regexp_replace(text, pattern, ""))

        def of_words(words):
            lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
            return let(lines, lambda line: F.struct(
                F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.length(text).alias("_n"), without(SYMBOLS).alias("_no_symbols"), without("[!?]").alias("_no_marks"),
                without("[A-Z]").alias("_no_upper"), without("[0-9]").alias("_no_digits"),
                F.size(line).alias("_n_lines"), F.size(F.array_distinct(line)).alias("_new_lines"),
                F.size(F.array_distinct(words)).alias("_distinct"), _repeat_words(words).cast("long").alias("n_repeat_words")))
        return let(words_of(text), of_words)
    # a generator: what later filters on the counts is not pushed below them, so they are taken once
    counted = docs.select(*names, text_of().alias("_text")).select(*names, F.inline(F.array(let(F.col("_text"), counts))))
    n = {c: F.col(c) for c in ("n_words", "word_chars", "n_repeat_words", "_n", "_n_lines", "_distinct")}
    words, chars, lines = (F.greatest(n[c], F.lit(1)).cast("double") for c in ("n_words", "word_chars", "_n_lines"))
    symbols, again = (n["_n"] - F.col("_no_symbols")).cast("long"), (n["_n_lines"] - F.col("_new_lines")).cast("long")
    shares = [symbols / words, (n["_n"] - F.col("_no_marks")) / words, (n["_n"] - F.col("_no_upper")) / chars,
              (n["_n"] - F.col("_no_digits")) / chars, n["n_repeat_words"] / words, again / lines, n["_distinct"] / words,
              n["word_chars"] / words, n["n_words"] / lines]
    failed = (n["n_words"] < 50) | (100 * n["n_repeat_words"] > 50 * n["n_words"])
    return counted.select(*names, "n_words", "word_chars", symbols.alias("n_symbols"), again.alias("n_dup_lines"),
                          "n_repeat_words", failed.alias("base_failed"),
                          *[s.alias(name) for s, name in zip(shares, FEATURES)])


# ---------------------------------------------------------------- learning

@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def holds(self, row) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def _counts(rows, bad):
    n = sum(bad[i] for i in rows)
    return n, len(rows) - n


def _grow(rows, bad, table, cuts):
    """Add the condition of the highest information gain until the rule covers bad rows only."""
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS:
        p, n = _counts(rows, bad)
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (0.0, None)
        for feature in FEATURES:
            column = table[feature]
            order = sorted(rows, key=column.__getitem__)
            below = [0]
            for i in order:
                below.append(below[-1] + bad[i])
            at = 0
            for cut in cuts[feature]:
                while at < len(order) and column[order[at]] <= cut:
                    at += 1
                for above, p1, all1 in ((False, below[at], at), (True, p - below[at], len(order) - at)):
                    if p1 >= LEAST_ROWS // 2:
                        gain = p1 * (math.log2(p1 / all1) - before)
                        if gain > best[0] + 1e-12:
                            best = (gain, Condition(feature, above, cut))
        if best[1] is None:
            break
        found = best[1]
        column = table[found.feature]
        # half-way to the next value, so that rows a little beyond the cut are treated like their nearest
        under = max((column[i] for i in rows if column[i] <= found.threshold), default=found.threshold)
        over = min((column[i] for i in rows if column[i] > found.threshold), default=found.threshold)
        rule.append(Condition(found.feature, found.above, (under + over) / 2))
        rows = [i for i in rows if (column[i] > rule[-1].threshold) == found.above]
    return rule


def _covered(rule, rows, table):
    for c in rule:
        column = table[c.feature]
        rows = [i for i in rows if (column[i] > c.threshold) == c.above]
    return rows


def learn(sample: list[dict], precision: float = PRECISION) -> list[list[Condition]]:
    """An ordered list of rules, each a conjunction that names bad rows.

    ``sample`` rows have ``FEATURES`` and ``bad`` (0 or 1).  Two thirds grow a rule by gain, one third
    prunes its last conditions while that does not hurt (p - n) / (p + n); a rule is kept if it is right
    for ``precision`` of what it covers in either part, its rows leave, and the search goes on.
    """
    bad = [int(r["bad"]) for r in sample]
    table = {f: [float(r[f]) for r in sample] for f in FEATURES}
    cuts = {}
    for f in FEATURES:
        values = sorted(set(table[f]))
        picks = {values[len(values) * k // THRESHOLDS] for k in range(THRESHOLDS)} if values else set()
        ordered = sorted(table[f])
        picks |= {ordered[len(ordered) * k // THRESHOLDS] for k in range(THRESHOLDS)} if ordered else set()
        cuts[f] = sorted(picks)
    grow, prune = [i for i in range(len(sample)) if i % 3], [i for i in range(len(sample)) if i % 3 == 0]
    rules: list[list[Condition]] = []
    while len(rules) < MOST_RULES:
        rule = _grow(grow, bad, table, cuts)
        if not rule:
            break

        def worth(r):
            p, n = _counts(_covered(r, prune, table), bad)
            return (p - n) / (p + n) if p + n else -1.0
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = _counts(_covered(rule, grow, table), bad)
        p2, n2 = _counts(_covered(rule, prune, table), bad)
        if p + p2 < LEAST_ROWS or p < precision * (p + n) or p2 < precision * (p2 + n2):
            break
        rules.append(rule)
        left_grow, left_prune = set(_covered(rule, grow, table)), set(_covered(rule, prune, table))
        grow, prune = [i for i in grow if i not in left_grow], [i for i in prune if i not in left_prune]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one conditional expression: false at the first rule that holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = F.when(held, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[list[Condition]]:
    """Learn rules from at most ``fit_rows`` labelled documents (doc_id, quality 0 or 1), a bounded sample.

    The sample is that of the smallest MD5 values of doc_id, so it does not depend on the layout; only
    rows that pass the base rules teach.  Null labels are left out; without labels there are no rules.
    """
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("_quality"))
              .orderBy(F.md5(F.col("doc_id").cast("string"))).limit(fit_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")     # at most fit_rows rows
    sample = (statistics(rows).where(~F.col("base_failed"))
              .select("doc_id", *FEATURES, (F.col("_quality") == 0).cast("int").alias("bad")).collect())
    return learn(sorted((r.asDict() for r in sample), key=lambda r: (r["doc_id"], r["bad"])))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``docs`` with ``BASE``, base_failed and kept (true if neither base nor any rule rejects it).

    Nulls, empty texts and repeated rows are judged row by row; null text fails the base rules.  Columns
    of ``docs`` that have the name of a count are replaced.
    """
    rows = statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return rows.drop(*FEATURES)


def kept_rows(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return judge(docs.select("text", F.struct("*").alias("_row")), rules).where("kept").select("_row.*")
