"""Quality rules: a bitmask ledger.

``ledger`` measures every text once, evaluates every rule once on the measurements and stores one failure bit per
rule beside them. What follows needs no text any more: ``apply_policy`` keeps the rows that fail none of a versioned
policy's rules (one bitwise AND), ``ablation`` counts for every policy and rule how many rows the policy rejects, the
rule fails, and only this rule rejects, from one count per distinct bitmask. All of it is DataFrame expressions: a
text is measured within its row, without shuffle; only the ablation groups, and it pre-aggregates to bitmasks.

Repeated 8-word windows are found by 64-bit hashes of the windows. Texts whose window hashes are all distinct (most)
end there; the others sort (hash, position) pairs. Both are about n log n in the words of one text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, let

SYMBOLS = "#*$%&|<>"
#: A power of two: hashes of windows are made by doubling.
WINDOW = 8


@dataclass(frozen=True)
class QualityRule:
    """A row fails the rule if condition (SQL over the measurements) is true; bit is its place in the mask, for good."""

    name: str
    bit: int
    condition: str


BASE = [
    QualityRule("too_few_words", 0, "n_words < 20"),
    QualityRule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
]
RULES = [
    *BASE,
    QualityRule("symbol_heavy", 2, "5 * n_symbols > word_chars"),
    QualityRule("repeated_lines", 3, "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    QualityRule("long_words", 4, "word_chars > 25 * n_words"),
    QualityRule("short_words", 5, "n_words >= 20 and word_chars < 2 * n_words"),
    QualityRule("symbol_words", 6, "n_words >= 20 and 10 * n_symbols > 4 * n_words and 10 * n_symbols > word_chars"),
]
#: Versioned policies: the names of the rules that reject.
POLICIES: dict[str, Sequence[str]] = {
    "base-1": [r.name for r in BASE],
    "web-1": [r.name for r in RULES],
    "lenient-1": ["too_few_words", "repeated_windows", "symbol_heavy"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: str | Sequence[str], rules: Sequence[QualityRule] = RULES) -> int:
    names = set(POLICIES[policy] if isinstance(policy, str) else policy)
    if missing := names - {r.name for r in rules}:
        raise ValueError(f"unknown rules: {sorted(missing)}")
    return sum(1 << r.bit for r in rules if r.name in names)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes: of all windows, in order."""

    def covered(pairs: Column) -> Column:
        same = lambda x, k: (F.get(pairs, k)["h"] == x["h"])
        starts = F.array_sort(F.transform(F.filter(pairs, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x))

    sorted_pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(sorted_pairs, covered)).otherwise(F.lit(0).cast("long"))


def _doubled(hashes: Column, span: int) -> Column:
    """Hashes of twice as many words, from those of span words at each place; the last places lack words and mean nothing."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(span + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with MEASURES, all long; a null text counts as empty. Input columns of these names are replaced."""
    kept = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("__words", F.array_remove(F.split(kept, f"{BLANK}+"), ""))
    # a column for every step: what a later one uses twice is evaluated once
    out = out.withColumn("__windows", F.transform("__words", lambda w: F.xxhash64(w)))
    span = 1
    while span < WINDOW:
        out, span = out.withColumn("__windows", _doubled(F.col("__windows"), span)), 2 * span
    size = F.size("__words")
    out = out.withColumns({
        "__windows": F.slice("__windows", F.lit(1), F.greatest(size - WINDOW + 1, F.lit(0))),
        "__lines": F.filter(F.split(kept, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))),
    })
    return out.withColumns({
        "n_words": size.cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(kept, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("__windows")),
    }).drop("__words", "__windows", "__lines")


def ledger(df: DataFrame, text: str = "text", rules: Sequence[QualityRule] = RULES) -> DataFrame:
    """df with MEASURES and fail_bits (long): bit b is set if the rule with bit b fails.

    A null text is measured as an empty one. Empty texts fail by their word count. Repeated rows stay repeated; an
    empty table stays empty; input columns named like a measurement or fail_bits are replaced.
    """
    if len({r.bit for r in rules}) < len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.condition), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(df, text).withColumn("fail_bits", bits)


def passes(policy: str | Sequence[str], rules: Sequence[QualityRule] = RULES) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def apply_policy(entries: DataFrame, policy: str | Sequence[str], rules: Sequence[QualityRule] = RULES) -> DataFrame:
    """The ledger's rows that fail none of the policy's rules.

    A predicate on fail_bits alone would be pushed below the ledger, and every measurement evaluated once for each
    rule that uses it; it does not pass a row number.
    """
    numbered = entries.withColumn("__row", F.monotonically_increasing_id())
    return numbered.filter(passes(policy, rules) & (F.col("__row") >= 0)).drop("__row")


def ablation(entries: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[QualityRule] = RULES) -> DataFrame:
    """policy, rule, n_rows, n_rejected (by the policy), n_failed (the rule), n_only (rejected for this rule alone).

    One row per policy and rule of it, from one count per distinct bitmask; no row where the ledger is empty.
    """
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    steps = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.lit(mask(names, rules)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("one"))
        for p, names in policies.items() for r in rules if r.name in names
    ])
    hit = F.col("fail_bits").bitwiseAND(F.col("s.mask"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return (
        counts.withColumn("s", F.explode(steps))
        .groupBy(F.col("s.policy").alias("policy"), F.col("s.rule").alias("rule"))
        .agg(F.sum("n").alias("n_rows"), total(hit != 0).alias("n_rejected"), total(F.col("fail_bits").bitwiseAND(F.col("s.one")) != 0).alias("n_failed"), total(hit == F.col("s.one")).alias("n_only"))
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The measures of the base's rules of every document, and whether the policy keeps it. A null text has no words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base-1")).alias("base_failed"), passes("web-1").alias("kept"), "fail_bits",
    )


_CONDITIONS = " + ".join(f"(CASE WHEN {r.condition} THEN {1 << r.bit} ELSE 0 END)" for r in RULES)
#: Measurements and the bitmask in DuckDB's SQL, as the common table expression ``judged`` over a table {docs}.
LEDGER_SQL = rf"""
worded AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS rid
  FROM {{docs}}),
windows AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM worded WHERE len(w) >= 8)),
repeats AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
covered AS (
  SELECT rid, sum(least(8, coalesce(following - i, 8))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following FROM repeats) GROUP BY rid),
metrics AS (
  SELECT doc_id, worded.rid, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM worded LEFT JOIN covered ON worded.rid = covered.rid),
judged AS (SELECT *, CAST({_CONDITIONS} AS BIGINT) AS fail_bits FROM metrics)
"""
OP10_SQL = f"""
WITH {LEDGER_SQL.format(docs="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask("base-1")} <> 0 AS base_failed,
       fail_bits & {mask("web-1")} = 0 AS kept, fail_bits
FROM judged
"""
