"""Quality rules as a bitmask ledger, in DataFrame functions alone.

`ledger` evaluates every rule once for each document and stores one failure bit per rule beside the
measurements. A policy is a version name and a mask of rules; `apply_policy` needs one bitwise AND, so a new
policy never reads texts again. `ablations` tells from the ledger what each rule of a policy costs.

Cases: a null text counts as empty (0 words, so it fails `few_words`); a null doc_id stays null; repeated rows
give repeated results; an empty table gives an empty ledger; other columns of the input, whatever their names,
are ignored. Very long texts are taken whole: all work on a document is linear or one sort of its windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: All but capital letters and ASCII punctuation and digits.
KEPT_MARKS = r"[^\p{Lu}\x21-\x40\x5B-\x60\x7B-\x7E]+"

#: Rule name -> (bit, condition on the measurements under which the rule fails). These are the rules of op9 and its SQL.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "2 * n_symbols > n_words"),
    "repeated_lines": (3, "100 * n_dup_lines > 50 * n_lines"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
    "marks": (6, "100 * n_marks > 10 * word_chars"),
    "shouting": (7, "n_upper > 60 and 100 * n_upper > 50 * word_chars"),
    "bullet_lines": (8, "n_lines > 2 and 100 * n_bullet_lines > 90 * n_lines"),
}

#: With the rules that came later, which the ledger evaluates too. Card numbers, dates and prices are no marks.
ALL_RULES = RULES | {"marks_without_digits": (9, "100 * n_plain_marks > 10 * word_chars")}

#: Policy version -> the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "marks", "shouting"),
    "v2": ("few_words", "repeated_windows", "symbols", "marks_without_digits", "shouting"),
    "strict": tuple(RULES),
}
#: The pipeline applies the current policy; op9 stays with the one that its SQL states.
CURRENT, OP9 = "v2", "v1"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_plain_marks", "n_upper", "n_bullet_lines")


def policy_mask(version: str) -> int:
    return sum(1 << ALL_RULES[name][0] for name in POLICIES[version])


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


#: Low bits of a sort key that hold a window's place; texts of more words take the wider form.
NARROW, WIDE = 20, 31


def _repeat_keys(bits: int) -> tuple[Column, Column]:
    """Sort keys of the windows, and those of them whose window occurs at least twice.

    A key is a window's hash with its place in the low bits, so one sort of primitive longs brings equal windows
    together.
    """
    high = F.lit(-1 << bits).cast("long")
    at = lambda i, d: F.get("words", i + d)
    key = lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))
    keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), key))
    near = lambda x, i: F.shiftrightunsigned(x.bitwiseXOR(F.get("keys", i)), bits) == 0
    return keys, F.filter("keys", lambda x, i: near(x, i - 1) | near(x, i + 1))


def _collided(bits: int) -> Column:
    """Whether two neighbours among the repeated keys have the same hash but other words."""
    low = F.lit((1 << bits) - 1).cast("long")
    place = lambda x: x.bitwiseAND(low).cast("int")
    at = lambda i, d: F.get("words", i + d)

    def other(x: Column, i: Column) -> Column:
        before = F.get("twice", i - 1)
        p, q = place(x), place(before)
        return (F.shiftrightunsigned(x.bitwiseXOR(before), bits) == 0) & ((at(p, 0) != at(q, 0)) | (at(p, 1) != at(q, 1)) | (at(p, 2) != at(q, 2)))

    return F.size(F.filter("twice", other)) > 0


def _exact_places() -> Column:
    """Places of the repeated windows from a sort of their words; needed only after a collision of hashes."""
    window = lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i"))
    sorted_windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))
    word = lambda x: x.getField("w")
    pairs = F.zip_with(sorted_windows, F.slice(sorted_windows, 2, F.size("words")), lambda x, y: F.when(word(x) == word(y), F.array(x.getField("i"), y.getField("i"))))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", narrow: int = NARROW, carry: bool = False) -> DataFrame:
    """(doc_id, MEASURES), one row for each row of docs; all measurements are long. With carry, the whole input row
    stands in the struct column `row` in place of doc_id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    head = F.struct(*docs.columns).alias("row") if carry else F.col(id_col).alias("doc_id")
    one = docs.select(head, text.alias("text"))
    head = "row" if carry else "doc_id"
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    two = one.select(
        head,
        "text",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace("text", KEPT_MARKS, "").alias("marks"),
    )
    n = F.size("words")
    short = n < 1 << narrow
    (keys, twice), (wide_keys, wide_twice) = _repeat_keys(narrow), _repeat_keys(WIDE)
    three = two.withColumn("keys", F.when(n < 3, F.array().cast("array<bigint>")).when(short, keys).otherwise(wide_keys))
    four = three.withColumn("twice", F.when(short, twice).otherwise(wide_twice)).drop("keys")
    place = F.when(short, F.lit((1 << narrow) - 1)).otherwise(F.lit((1 << WIDE) - 1)).cast("long")
    places = F.sort_array(F.transform("twice", lambda x: x.bitwiseAND(place).cast("int")))
    collided = F.when(short, _collided(narrow)).otherwise(_collided(WIDE))
    five = four.withColumn("places", F.when(collided, _exact_places()).otherwise(places))
    # A window that stands at place p covers p, p + 1 and p + 2; the next place cuts it short.
    covered = F.when(F.size("places") == 0, F.lit(0)).otherwise(
        F.lit(3)
        + F.aggregate(
            F.transform("places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("places", j + 1) - p, F.lit(0)))),
            F.lit(0),
            lambda total, x: total + x,
        )
    )
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.length("marks") - F.length(F.regexp_replace("marks", r"[#*$%&|<>]+", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": covered,
        "n_marks": F.length(F.regexp_replace("marks", r"\p{Lu}+", "")),
        "n_plain_marks": F.length(F.regexp_replace("marks", r"[\p{Lu}0-9]+", "")),
        "n_upper": F.length(F.regexp_replace("marks", r"[\x21-\x40\x5B-\x60\x7B-\x7E]+", "")),
        "n_bullet_lines": F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*+\x{2022}][\x20\x09-\x0D]"))),
    }
    # No filter is pushed below a generator. Pushed into the projections above, it would have them split a text again
    # for each of its words.
    whole_row = F.explode(F.array(F.struct(head, *(c.cast("long").alias(name) for name, c in counts.items())))).alias("m")
    return five.select(whole_row).select("m.*")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The measurements and fail_bits: bit ALL_RULES[name][0] is set where the rule fails."""
    bits = [F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, condition in ALL_RULES.values()]
    return measure(docs, id_col, text_col, carry=carry).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds base_failed, policy and kept to a ledger. Whatever the version, a base failure is never kept."""
    base, mask = policy_mask("base"), policy_mask(version) | policy_mask("base")
    return rows.select(
        "*",
        (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        F.lit(version).alias("policy"),
        (F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0).alias("kept"),
    )


def keep(docs: DataFrame, version: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that a policy keeps, with all their columns and no shuffle."""
    return apply_policy(ledger(docs, id_col, text_col, carry=True), version).where("kept").select("row.*")


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept, n_kept_without): for each rule of a policy, how many documents
    fail it, fail nothing else of the policy, are kept, and would be kept without the rule.

    The ledger shrinks to one row for each pattern of bits (at most 2 ** rules) before the rules unfold.
    """
    mask = policy_mask(version)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << ALL_RULES[name][0]).cast("long").alias("bit")) for name in POLICIES[version]))).alias("r")
    long = patterns.select("bits", "n", each).select("bits", "n", "r.rule", "r.bit")
    when = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    fails, only, none = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit"), F.col("bits") == 0
    return long.groupBy("rule").agg(when(fails).alias("n_failed"), when(only).alias("n_only"), when(none).alias("n_kept"), when(none | only).alias("n_kept_without")).withColumn("policy", F.lit(version))


def failure_profile(rows: DataFrame, *keys: str) -> DataFrame:
    """For each group of keys: bits that some document fails and bits that all documents fail."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_docs"), F.bit_or("fail_bits").alias("any_failed"), F.bit_and("fail_bits").alias("all_failed"))


def contract(rows: DataFrame) -> DataFrame:
    """A ledger whose fail_bits hold the rules of op9 alone."""
    return rows.withColumn("fail_bits", F.col("fail_bits").bitwiseAND(F.lit(sum(1 << bit for bit, _ in RULES.values()))))


def sql(version: str = OP9) -> str:
    """DuckDB SQL for the rows of op9."""
    if not set(POLICIES[version]) <= set(RULES):
        raise ValueError(f"policy {version} has rules that the SQL does not evaluate")
    space, mask = r"[\x20\x09-\x0D]+", policy_mask(version) | policy_mask("base")
    bits = " + ".join(f"(case when {condition} then {1 << bit} else 0 end)" for bit, condition in RULES.values())
    return rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select k, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
gram as (select k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as s from g),
twice as (select k, i from (select k, i, count(*) over (partition by k, s) as c from gram) where c > 1),
places as (select distinct k, i + unnest([0, 1, 2]) as p from twice),
covered as (select k, count(*) as n from places group by k),
m as (select w.k, doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '{space}', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols, len(lines)::bigint as n_lines,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
  (length(text) - length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')))::bigint as n_marks,
  (length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')))::bigint as n_upper,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*+\x{{2022}}][\x20\x09-\x0D]')))::bigint as n_bullet_lines
  from w left join covered using (k)),
f as (select *, ({bits})::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
  (fail_bits & {policy_mask("base")}) <> 0 as base_failed, '{version}' as policy, (fail_bits & {mask}) = 0 as kept from f"""
