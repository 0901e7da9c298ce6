"""Quality rules as a ledger of failure bits and measurements, read by versioned policies.

Every rule is evaluated once per document. Its outcome is one bit of `fail_bits`, its figure a column. Policies are
masks over the bits, so another version, or leaving one rule out, reads the ledger and never the texts.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_column, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Column


@dataclass(frozen=True)
class Policy:
    """A document is kept while fewer than `tolerated + 1` of the masked bits are set."""

    version: str
    bits: tuple[int, ...]
    tolerated: int = 0

    @property
    def mask(self) -> int:
        return reduce(lambda m, b: m | 1 << b, self.bits, 0)


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_window_words(ws: Column) -> Column:
    """Words inside windows of WINDOW words that stand twice or more in the array, the first one included.

    Windows are compared by a 64-bit hash. Texts without a repeat, which are most, end at the distinct count.
    """
    def covered(windows: Column) -> Column:
        sorted_ = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def twins(s: Column) -> Column:
            alike = lambda x, i, by: F.get(s, i + by)["h"] == x["h"]
            return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(alike(x, i, -1), F.lit(False)) | F.coalesce(alike(x, i, 1), F.lit(False))), lambda x: x["i"]))
        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
        return bind(sorted_, lambda s: bind(twins(s), total))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))
        return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))

    return bind(F.transform(ws, lambda w: F.xxhash64(w)), of_hashes)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measurements of every text beside its whole row, kept in `doc`; a null text measures as an empty one."""
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: without(x, SPACES) != "")
    facts = docs.select(F.struct("*").alias("doc"), text_column(text).alias("_text")).select(
        "doc",
        bind(words(t), lambda ws: F.struct(F.size(ws).alias("n_words"), repeated_window_words(ws).alias("n_repeat_words"))).alias("w"),
        F.length(without(t, SPACES)).alias("word_chars"),
        (F.length(t) - F.length(without(t, SYMBOLS))).alias("n_symbols"),
        bind(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"))).alias("l"),
        (F.length(t) - F.length(without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_capitals"),
        (F.length(t) - F.length(without(t, "!?"))).alias("n_marks"),
    )
    whole = lambda c: F.col(c).cast("long").alias(c.split(".")[-1])
    return facts.select("doc", *map(whole, ("w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "n_capitals", "n_marks")))


def rules() -> tuple[Rule, ...]:
    n, chars = F.col("n_words"), F.col("word_chars")
    return (
        Rule(0, "too_short", n < 10),
        Rule(1, "repeated_windows", 100 * F.col("n_repeat_words") > 20 * n),
        Rule(2, "symbol_heavy", 100 * F.col("n_symbols") > 20 * n),
        Rule(3, "repeated_lines", 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        Rule(4, "capitals", 100 * F.col("n_capitals") > 50 * chars),
        Rule(5, "marks", 100 * F.col("n_marks") > 50 * n),
        Rule(6, "word_length", (chars > 30 * n) | (chars < 2 * n)),
    )


# Versions stay readable side by side; the base policy holds the two rules the contract fixes.
BASE = Policy("base", (0, 1))
POLICIES = (BASE, Policy("v1", (0, 1, 2, 3)), Policy("v2", (0, 1, 2, 3, 4, 5, 6)))
CURRENT = POLICIES[-1]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and fail_bits (bit b set: rule b fails) of every row of docs, which stays whole in `doc`.

    Rows are independent: repeated rows give repeated entries, an empty table gives none, nulls in other columns
    and columns named like a measurement stay inside `doc`.
    """
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules()))
    return measure(docs, text).withColumn("fail_bits", bits.cast("long"))


def passes(policy: Policy, bits: Column | None = None) -> Column:
    return F.bit_count((F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.tolerated


def apply_policies(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Adds kept_<version> for each policy."""
    return entries.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablations(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that fail nothing else, kept without it.

    One pass of counts over the bits, whatever the number of rules.
    """
    named = {r.bit: r.name for r in rules()}
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    counted = entries.select(masked.alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(named[b]).alias("rule"), F.lit(1 << b).cast("long").alias("m")) for b in policy.bits))).alias("r")
    rest = F.col("b").bitwiseAND(F.bitwise_not(F.col("r.m")))
    held = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return counted.select("b", "n", rule).groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule")).agg(
        held(F.col("b").bitwiseAND(F.col("r.m")) != 0).alias("n_fail"),
        held(F.col("b") == F.col("r.m")).alias("n_fail_alone"),
        held(F.bit_count(rest) <= policy.tolerated).alias("n_kept_without"),
        F.bit_or("b").alias("bits_seen"),
    )


def kept_documents(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of docs, all columns, whose text passes the policy."""
    return ledger(docs).filter(passes(policy)).select("doc.*")
