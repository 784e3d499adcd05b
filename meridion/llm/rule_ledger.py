"""Quality rules as a bitmask ledger (operator 3): DataFrame functions only.

Every rule is evaluated once per document; a failed rule sets its bit, and what was measured is stored beside the
bits.  A policy is a versioned mask over the bits, so that changing a policy or asking what each of its rules
removes is a bitwise aggregation over the ledger and never reads a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.session import table

# Fixed values of the contract.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"


def _over(part: str, percent: int, whole: str) -> Column:
    return 100 * F.col(f"m.{part}") > percent * F.col(f"m.{whole}")


#: Rules by bit: name and the condition under which a document fails.  Bits are never reused for another rule.
RULES: list[tuple[str, callable]] = [
    ("few_words", lambda: F.col("m.n_words") < MIN_WORDS),
    ("repeated_words", lambda: _over("n_repeat_words", MAX_REPEAT_PERCENT, "n_words")),
    ("symbols_per_word", lambda: _over("n_symbols", 10, "n_words")),
    ("short_words", lambda: F.col("m.word_chars") < 2 * F.col("m.n_words")),
    ("long_words", lambda: F.col("m.word_chars") > 12 * F.col("m.n_words")),
    ("duplicate_lines", lambda: _over("n_dup_lines", 50, "n_lines")),
    ("capitals", lambda: _over("n_capitals", 30, "word_chars")),
    ("exclamations", lambda: _over("n_exclamations", 30, "n_words")),
    ("digits", lambda: _over("n_digits", 50, "word_chars")),
]
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols_per_word", "duplicate_lines"),
    "v2": tuple(BITS),
}
POLICY = "v2"


def policy_mask(version: str) -> int:
    return sum(BITS[r] for r in POLICIES[version])


def _count_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, ledger): each row of ``docs`` as it is, and its measurements with ``fail_bits``.

    A null or empty text has no word and fails ``few_words``; repeated rows and null ids are judged like others;
    an empty table gives an empty one.  The row is kept in a struct of its own, so no column name can clash.
    """
    t = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    bare = F.btrim("t", F.lit(SPACES))
    t = t.withColumn("w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")))
    t = t.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    n = F.size("w")
    none = F.array().cast("array<bigint>")
    t = t.withColumn("g", F.when(n < WINDOW, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*(F.col("h")[i + k] for k in range(WINDOW))))))
    # Windows in the order of their hashes, only where one is there twice; equal neighbours are repeated windows.
    twice = F.size(F.array_distinct("g")) < F.size("g")
    t = t.withColumn("s", F.when(twice, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    last = F.size("s") - 1
    t = t.withColumn(
        "p",
        F.when(
            F.col("s").isNotNull(),
            F.sort_array(
                F.filter(
                    F.transform(
                        F.sequence(F.lit(0), last),
                        lambda k: F.when(
                            (k > 0) & (F.col("s")[F.greatest(k - 1, F.lit(0))]["x"] == F.col("s")[k]["x"]) | (k < last) & (F.col("s")[F.least(k + 1, last)]["x"] == F.col("s")[k]["x"]),
                            F.col("s")[k]["i"],
                        ),
                    ),
                    lambda x: x.isNotNull(),
                )
            ),
        ),
    )
    # A window covers its words up to the next repeated window, three at most.
    starts = F.size("p")
    covered = F.aggregate(F.sequence(F.lit(1), starts), F.lit(0).cast("long"), lambda a, k: a + F.when(k < starts, F.least(F.lit(WINDOW), F.get("p", k) - F.get("p", k - 1))).otherwise(WINDOW))
    lines = F.split("t", "\n")
    t = t.withColumn("l", F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    # Exploding one element keeps a filter on the bits from being pushed down and writing out all of the above each time.
    measured = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("p").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        _count_of(F.col("t"), CAPITALS).alias("n_capitals"),
        _count_of(F.col("t"), "!").alias("n_exclamations"),
        _count_of(F.col("t"), DIGITS).alias("n_digits"),
    )
    t = t.select("row", F.explode(F.array(measured)).alias("m"))
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(fails(), F.lit(BITS[name])).otherwise(0).cast("long"))
    return t.select("row", F.struct("m.*", bits.alias("fail_bits")).alias("ledger"))


def failed(bits: Column, version: str = POLICY) -> Column:
    """Whether a policy rejects a document with these bits."""
    return bits.bitwiseAND(F.lit(policy_mask(version)).cast("long")) != 0


def ablations(rows: DataFrame, versions: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """(policy, rule, n_docs, n_kept, n_failed, n_only): what each rule of each policy removes, and removes alone.

    ``rows`` has one ``fail_bits`` per document; the documents are first counted by their bits, of which there are
    no more than two to the number of rules.
    """
    counts = rows.groupBy(F.col("fail_bits").alias("bits")).agg(F.count("*").alias("n"))
    cells = [F.struct(F.lit(v).alias("policy"), F.lit(policy_mask(v)).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for v in versions for r in POLICIES[v]]
    each = counts.select("bits", "n", F.explode(F.array(*cells)).alias("c")).select("bits", "n", "c.*")
    under = F.col("bits").bitwiseAND(F.col("mask"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(under == 0)("n_kept"),
        total(under.bitwiseAND(F.col("bit")) != 0)("n_failed"),
        total(under == F.col("bit"))("n_only"),
    )


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.col("ledger.fail_bits")
    return ledger(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        *(f"ledger.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed(bits, "base").alias("base_failed"),
        (~failed(bits)).alias("kept"),
        "ledger.fail_bits",
    )


_SP = r"[\x20\x09-\x0D]"
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{_SP}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SP}+', '', 'g') <> '') AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT pos) AS n FROM rep GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SP}', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
             (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
             (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
             (length(t) - length(regexp_replace(t, '[0-9]', '', 'g')))::BIGINT AS n_digits
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
               + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
               + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
               + CASE WHEN 100 * n_capitals > 30 * word_chars THEN 64 ELSE 0 END + CASE WHEN 100 * n_exclamations > 30 * n_words THEN 128 ELSE 0 END
               + CASE WHEN 100 * n_digits > 50 * word_chars THEN 256 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
