"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document: its measurement is kept and a failure sets the rule's bit in ``fail_bits``. A
policy is a version of the rule book: a mask of the bits that count. A verdict is a bitwise test of the ledger, so a
new policy, or an ablation of an old one, never reads a text again: the ledger is a table in the shared folder, with all
measurements. Ablations count its distinct bit patterns (at most 2 to the number of rules) and derive from them what each
rule removes, alone and with others.

All of it is DataFrame expressions in one pass over the texts: no shuffle, no Python. Words in repeated windows are
found by hashing each five-word window to 64 bits; only documents that have a repeated hash sort theirs.

Cases: a null text counts as empty: no words, so the rule of few words fails; repeated rows and ids give a row each;
texts are measured whole; an empty table gives an empty ledger; columns of the input are not read but for id and text,
so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import WORD, materialise, text_or_empty

#: Characters that count as symbols: fixed values.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A bit, a name and the failure as a condition on measurements."""

    bit: int
    name: str
    fails: Column


def _c(name: str) -> Column:
    return F.col(name)


def rules() -> list[Rule]:
    """The rule book; bits never change their meaning, new rules take new bits."""
    return [
        Rule(0, "few_words", _c("n_words") < 10),
        Rule(1, "repeated_words", 100 * _c("n_repeat_words") > 20 * _c("n_words")),
        Rule(2, "symbols", 10 * _c("n_symbols") > _c("n_words")),
        Rule(3, "exclamations", 4 * _c("n_exclamations") > _c("n_words")),
        Rule(4, "repeated_lines", 2 * _c("n_dup_lines") > _c("n_lines")),
        Rule(5, "capitals", 2 * _c("n_capitals") > _c("word_chars")),
        Rule(6, "word_length", (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 20 * _c("n_words"))),
    ]


#: Bits of the base, and policies by version: the mask of the bits that reject.
BASE_MASK = 0b11
POLICIES = {"base": BASE_MASK, "v1": 0b1111111}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, measurements, carried columns). ``carry`` names input columns to keep, under ``__carry`` names while at work."""
    kept = [F.col(f"`{c}`").alias(f"__carry{i}") for i, c in enumerate(carry)]
    t = docs.select(F.col(f"`{id_col}`").alias("__id"), *kept, text_or_empty(text_col).alias("__text"))
    t = t.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    t = t.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD)))
    t = t.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(_c("__hashes"), i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    t = t.withColumn("__grams", F.when(F.size("__words") >= WINDOW, windows))
    twice = F.size(F.array_distinct("__grams")) < F.size("__grams")
    t = t.withColumn("__sorted", F.when(twice, F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    near = lambda x, k: F.get(_c("__sorted"), k)["g"].eqNullSafe(x["g"])
    found = F.filter("__sorted", lambda x, k: ((k > 0) & near(x, F.greatest(k - 1, F.lit(0)))) | near(x, k + 1))
    t = t.withColumn("__starts", F.sort_array(F.transform(found, lambda x: x["i"])))
    # A window covers its words up to the next repeated window's start.
    cover = F.transform("__starts", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(_c("__starts"), k + 1), x + WINDOW) - x).cast("long"))
    without = lambda pattern: F.length("__text") - F.length(F.regexp_replace("__text", F.lit(pattern), F.lit("")))
    return t.select(
        _c("__id").alias(id_col),
        *[_c(f"__carry{i}") for i in range(len(carry))],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        without(SYMBOLS + "+").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.length("__text") - F.length(F.replace("__text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        without("[A-Z]+").cast("long").alias("n_capitals"),
    )


def judged(measured: DataFrame) -> DataFrame:
    """The rows with ``fail_bits``."""
    bits = F.lit(0).cast("long")
    for r in rules():
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def ledger(measured: DataFrame) -> DataFrame:
    """The rows with ``fail_bits``, every rule evaluated once, as a stored table: verdicts read it, never the texts."""
    return materialise(judged(measured), "quality")


def passes(policy: str) -> Column:
    """Verdict of a policy on a ledger's row."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Rows (rule, bit, n_failed, n_alone, n_kept_without): documents that fail the rule, those that only it rejects under
    the policy, and how many the policy would keep without it."""
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])).alias("bits")).agg(F.count("*").alias("n"))
    counted = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"), F.lit(1 << r.bit).cast("long").alias("flag")) for r in rules() if POLICIES[policy] >> r.bit & 1]
    each = patterns.select("bits", "n", F.explode(F.array(*counted)).alias("r")).select("bits", "n", "r.*")
    sums = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    hit = F.col("bits").bitwiseAND(F.col("flag")) != 0
    return each.groupBy("rule", "bit").agg(sums(hit).alias("n_failed"), sums(F.col("bits") == F.col("flag")).alias("n_alone"), sums((F.col("bits") == F.col("flag")) | (F.col("bits") == 0)).alias("n_kept_without"))


def keep_good(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass a policy, with all their columns.

    They go past their ledger rows in one scan: storing the ledger here would store the texts with it, as rows need not have
    a key. The row number, which is never negative, makes the filter need what the scan has numbered, so it is applied to
    the measurements and not written out into each of their uses.
    """
    cols = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"carry{i}") for i, c in enumerate(cols)])
    book = judged(measure(numbered, f"carry{cols.index(id_col)}", f"carry{cols.index(text_col)}", tuple(numbered.columns)).withColumn("__row", F.monotonically_increasing_id()))
    return book.where(passes(policy) & (F.col("__row") >= 0)).select(*[F.col(f"__carry{i}").alias(c) for i, c in enumerate(cols)])
