"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its failure bits and the measurements behind them.
Versioned policies are bit masks over the ledger, so changing a policy or asking what one rule alone rejects
never reads a text again. Only DataFrame functions are used.

Defined results: null and empty texts have no words (too_few_words fails); repeated rows are judged row by row;
an empty table gives an empty ledger; extra columns pass through, and an extra column that clashes with a ledger
column is replaced by the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: name -> failure condition over the measurements; the position is the bit and is never reused.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_passages", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "2 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: i for i, (name, _) in enumerate(RULES)}
        return sum(1 << bits[r] for r in self.rules)


POLICIES = {
    "base": Policy("base", ("too_few_words", "repeated_passages")),
    "v1": Policy("v1", ("too_few_words", "repeated_passages", "symbol_heavy")),
    "v2": Policy("v2", tuple(name for name, _ in RULES)),
}


def _shift(a: Column, by: int) -> Column:
    """a without its first elements; zip_with pads the missing tail with null."""
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the MEASURES. A window of 8 words is known by a 64-bit hash built by doubling (1, 2, 4, 8 words). The columns of docs
    travel as one struct, so that no name of theirs meets one of the steps."""
    names = [c for c in docs.columns if c.lower() not in MEASURES]
    docs = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    t = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(t, WS + " ", "")
    own = ["row"]
    out = docs.select(
        *own,
        F.length(blank).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WS + " ", "")) > 0).alias("_l"),
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_h"),
    )
    out = out.select(*own, "word_chars", "n_symbols", F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size("_h").cast("long").alias("n_words"), "_h")
    keep = [*own, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    for by in (1, 2, 4):
        out = out.select(*keep, F.zip_with("_h", _shift(F.col("_h"), by), lambda a, b: F.xxhash64(a, b)).alias("_h"))
    out = out.select(*keep, F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))).alias("_h"))
    # Only documents in which some window comes twice take the sort below.
    out = out.select(*keep, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_h"))
    out = out.select(*keep, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("_s"))
    out = out.select(*keep, "_s", F.zip_with("_s", _shift(F.col("_s"), 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))).alias("_e"))
    twice = F.zip_with(
        F.zip_with("_s", "_e", lambda a, e: F.struct(a["i"].alias("i"), e.alias("e"))),
        F.concat(F.array(F.lit(False)), F.slice("_e", F.lit(1), F.size("_e") - 1)),
        lambda a, e: F.when(a["e"] | e, a["i"]),
    )
    out = out.select(*keep, F.sort_array(F.filter(twice, lambda x: x.isNotNull())).alias("_p"))
    gaps = F.zip_with("_p", _shift(F.col("_p"), 1), lambda a, b: F.when(b.isNull(), F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), b - a)))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], *MEASURES[:-1], F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and fail_bits (bit i: rule i of RULES failed)."""
    bits = " | ".join(f"shiftleft(cast(coalesce({cond}, false) as bigint), {i})" for i, (_, cond) in enumerate(RULES))
    return measure(docs, text).withColumn("fail_bits", F.expr(bits))


def apply_policy(led: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    return led.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def passing(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of docs that the policy passes, columns unchanged.

    The row number is a barrier: without it the optimizer would push the filter below the ledger and evaluate the
    measurements anew inside it, each many times over."""
    led = apply_policy(ledger(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_text"), policy, "_pass")
    return led.withColumn("_at", F.monotonically_increasing_id()).where("_pass and _at >= 0").select("_row.*")


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: documents it fails, and those it alone rejects. A count by bit pattern comes first."""
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in policy.rules])
    one = patterns.select("bits", "n", F.explode(rules).alias("r"))
    return one.groupBy(F.col("r.rule").alias("rule"), F.lit(policy.version).alias("policy")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejects_alone"),
    )


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES["base"], "_base"), POLICIES["v2"], "kept")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "n_lines", "fail_bits")


_W = r"[^\x20\x09-\x0D]+"
LEDGER_SQL = rf"""
with t as (select doc_id, coalesce(text, '') x from {{docs}}),
w as (select doc_id, x, regexp_extract_all(x, '{_W}') ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from t),
k as (select row_number() over () rid, *, len(ws) n from w),
win as (select rid, i, array_to_string(ws[i:i+7], ' ') g from (select rid, ws, unnest(generate_series(1, n - 7)) i from k)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, g) c from win) where c > 1),
cov as (select rid, sum(least(8, coalesce(nx - i, 8)))::bigint r from (select rid, i, lead(i) over (partition by rid order by i) nx from dup) group by rid),
m as (select doc_id, n::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(r, 0)::bigint n_repeat_words, k.rid from k left join cov using (rid)),
b as (select *, (case when n_words < 20 then 1 else 0 end) | (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end) | (case when 2 * n_symbols > n_words then 4 else 0 end)
  | (case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 8 else 0 end) | (case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words) then 16 else 0 end) fb from m)
"""
SQL = {"op9_quality_ledger": LEDGER_SQL.format(docs="documents") + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fb & 3) <> 0 base_failed, fb = 0 kept, n_lines, fb::bigint fail_bits from b"}
QUERIES = {"op9_quality_ledger": op9_quality_ledger}
