"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps the measurements and one long whose bit
b is set where rule b fails. A policy is a named, versioned set of rules; its verdict is one bitwise
AND against the ledger, so a new policy or an ablation never reads a text again. Ablations first
count documents by failure mask and then work on the few distinct masks.

Everything is DataFrame expressions: a narrow map over documents without shuffle; only ablations
aggregate, and they do so map-side first.

Edge cases: null or blank texts have no words and fail `few_words`; repeated rows each get a row;
an empty table gives an empty ledger; other columns are carried along if asked for, and clashing
names are avoided by a reserved prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of

P = "__q4_"


@dataclass(frozen=True)
class Rule:
    """bit: its place in the mask. fails: from the measurements (columns by name) to a boolean."""

    bit: int
    name: str
    fails: object


def _m(name: str) -> Column:
    return F.col(P + name)


#: The catalogue. Bits are never reused for another meaning; new rules get new bits.
RULES = (
    Rule(0, "few_words", lambda: _m("n_words") < 50),
    Rule(1, "repeated_windows", lambda: 100 * _m("n_repeat_words") > 50 * _m("n_words")),
    Rule(2, "symbols", lambda: 10 * _m("n_symbols") > 3 * _m("n_words")),
    Rule(3, "word_length", lambda: (_m("word_chars") < 2 * _m("n_words")) | (_m("word_chars") > 20 * _m("n_words"))),
    Rule(4, "duplicate_lines", lambda: 10 * _m("n_dup_lines") > 7 * _m("n_lines")),
    Rule(5, "capitals", lambda: 10 * _m("n_upper") > 6 * _m("word_chars")),
    Rule(6, "few_letters", lambda: 10 * _m("n_nonletters") > 6 * _m("word_chars")),
)

#: Versioned policies: name -> rules that count.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "corpus-1": tuple(r.name for r in RULES),
}
DEFAULT_POLICY = "corpus-1"


def policy_mask(policy: str) -> int:
    wanted = set(POLICIES[policy])
    return sum(1 << r.bit for r in RULES if r.name in wanted)


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """docs with the measurements as prefixed columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, n = _m("words"), _m("size")
    at = lambda k: F.slice(w, F.lit(k), F.greatest(n - 2, F.lit(0)))
    # every three-word window with its place, sorted: equal windows become neighbours
    windows = F.sort_array(F.transform(F.arrays_zip(at(1).alias("a"), at(2).alias("b"), at(3).alias("c")), lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    s, m = _m("sorted"), F.size(_m("sorted"))
    tail, head = F.slice(s, F.lit(2), F.greatest(m - 1, F.lit(0))), F.slice(s, F.lit(1), F.greatest(m - 1, F.lit(0)))
    # both members of a pair of equal neighbours start a repeated window
    twin = F.zip_with(head, tail, lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twin, lambda p: p.isNotNull()))))
    r, k = _m("starts"), F.size(_m("starts"))
    # a window covers 3 words, less where the next repeated window starts sooner
    gaps = F.zip_with(F.slice(r, F.lit(2), F.greatest(k - 1, F.lit(0))), F.slice(r, F.lit(1), F.greatest(k - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(k > 0, F.aggregate(gaps, F.lit(3), lambda acc, g: acc + g)).otherwise(0)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return (
        docs.withColumns({P + "words": words_of(t), P + "lines": lines})
        .withColumns({P + "size": F.size(w), P + "glued": F.array_join(w, "")})
        .withColumn(P + "sorted", windows)
        .withColumn(P + "starts", starts)
        .withColumns(
            {
                P + "n_words": n.cast("long"),
                P + "word_chars": F.length(_m("glued")).cast("long"),
                P + "n_symbols": _dropped(_m("glued"), "[^#*$%&|<>]+"),
                P + "n_upper": _dropped(_m("glued"), r"[^\p{Lu}]+"),
                P + "n_nonletters": _dropped(_m("glued"), r"\p{L}+"),
                P + "n_lines": F.size(_m("lines")).cast("long"),
                P + "n_dup_lines": (F.size(_m("lines")) - F.size(F.array_distinct(_m("lines")))).cast("long"),
                P + "n_repeat_words": covered.cast("long"),
            }
        )
    )


def _dropped(text: Column, others: str) -> Column:
    """Code points that remain when what matches `others` is taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_nonletters")


def _bits() -> Column:
    """Bit b is set where rule b fails."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the measurements, and fail_bits (bit b: rule b fails). One row per input row."""
    return _measured(docs.select(key, text), text).select(key, *[_m(x).alias(x) for x in MEASURES], _bits().alias("fail_bits"))


def passes(fail_bits: Column, policy: str = DEFAULT_POLICY) -> Column:
    """The verdict of a policy on ledger rows."""
    return fail_bits.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    # a column that isn't deterministic holds the filter here: pushed below the projections, it would
    # copy each measurement's expression into every rule that uses it
    row = P + "row"
    rows = _measured(docs, text).withColumns({P + "kept": passes(_bits(), policy), row: F.monotonically_increasing_id()})
    return rows.where(F.col(P + "kept") & (F.col(row) >= 0)).select(*docs.columns)


def ablations(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy
    would reject without it. One pass that counts by mask; the rest is on distinct masks."""
    mask = policy_mask(policy)
    by_mask = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    wanted = [r for r in RULES if mask >> r.bit & 1]
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in wanted])).alias("r")
    bit = F.col("r.bit")
    own = F.col("bits").bitwiseAND(bit) != 0
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return (
        by_mask.select("bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(n(own)("failed"), n(F.col("bits") == bit)("failed_alone"), n(F.col("bits").bitwiseAND(F.bitwise_not(bit)) != 0)("rejected_without"))
    )
