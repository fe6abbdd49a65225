"""Quality rules as a ledger: measure once, keep failure bits, decide later.

measure() reads each text once and returns the measurements; ledger() adds one
integer whose bit b is set if rule b fails.  A policy is a versioned mask of
bits: a document is kept if it fails none of them.  A changed policy, or the
question what a rule alone costs (ablation()), needs the integer only.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words_of

WINDOW = 5
#: bit -> (name, failure as a function of the measurements). A bit never changes its meaning.
RULES = {
    0: ("few_words", lambda m: m("n_words") < 10),
    1: ("repeated_windows", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    2: ("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    3: ("long_words", lambda m: m("word_chars") > 14 * m("n_words")),
    4: ("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    5: ("repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    6: ("many_words", lambda m: m("n_words") > 1_000_000),
}
BASE = 0b11
#: version -> mask of the rules that reject. Old versions stay, for audits.
POLICIES = {1: BASE, 2: BASE | 0b0111100, 3: BASE | 0b1111100, 4: BASE | 0b0111100}
#: Length alone is no fault: since version 4, many_words is a measurement only, as in version 2.
LATEST = 4


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in some window of five that is found twice or more; overlapping windows count a word once."""
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("at")),
            lambda acc, i: F.struct((acc.sum + F.least(F.lit(WINDOW), i - acc["at"])).alias("sum"), i.alias("at")),
            lambda acc: acc.sum,
        )

    def repeated(ordered: Column) -> Column:
        same = lambda x, other: F.coalesce(x.h == F.get(ordered, other).h, F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x.i))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: covered(repeated(s))))

    return let(hashes, counted)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Null text counts as empty: all zero.  n_lines counts lines that have a
    word; a repeated line is one equal to an earlier line, separators included.
    Columns of these names that docs has already are replaced.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    words = words_of(F.col(text))

    def all_of(w: Column) -> Column:
        n = F.size(w)
        lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(plain) - F.length(F.regexp_replace(plain, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            line_counts.alias("lines"),
            _repeat_words(w, n).alias("n_repeat_words"),
        )

    found = docs.withColumn("_gl_m", let(words, all_of))
    # the struct is named in every column below, so that the optimizer keeps it as one computed value
    m = F.col("_gl_m")
    return found.withColumns(
        {
            "n_words": m.n_words,
            "word_chars": m.word_chars,
            "n_symbols": m.n_symbols,
            "n_lines": m.lines.n,
            "n_dup_lines": m.lines.dup,
            "n_repeat_words": m.n_repeat_words,
        }
    ).drop("_gl_m")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """measure(), and fail_bits: bit b is set if rule b of RULES fails."""
    measured = measure(docs, text)
    bits = [F.when(rule(F.col), F.lit(1 << b)).otherwise(F.lit(0)) for b, (_, rule) in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def passes(version: int = LATEST, bits: str = "fail_bits") -> Column:
    """True where a policy keeps the document."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[version])) == 0


def ablation(led: DataFrame, bits: str = "fail_bits") -> DataFrame:
    """For each policy and each of its rules: documents it rejects, and those only it rejects.

    One pass sums documents by failure pattern (at most 2**len(RULES) rows);
    the rest is arithmetic on the patterns.  Columns: policy, rule, failing,
    only_this, kept, kept_without.
    """
    patterns = led.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(
        *[
            F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.lit(mask).alias("mask"), F.lit(1 << b).alias("bit"))
            for v, mask in POLICIES.items()
            for b, (name, _) in RULES.items()
            if mask >> b & 1
        ]
    )
    each = patterns.select("bits", "n", F.inline(rules))
    hit = lambda mask: F.col("bits").bitwiseAND(mask)
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        total(hit(F.col("bit")) != 0).alias("failing"),
        total(hit(F.col("mask")) == F.col("bit")).alias("only_this"),
        total(hit(F.col("mask")) == 0).alias("kept"),
        total(hit(F.col("mask").bitwiseAND(F.bitwise_not("bit"))) == 0).alias("kept_without"),
    )


__all__ = ["BASE", "LATEST", "POLICIES", "RULES", "SPACE", "ablation", "ledger", "measure", "passes"]
