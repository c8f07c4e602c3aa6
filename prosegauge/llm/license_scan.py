"""Licence scans: ordered signature rules in DataFrame functions alone.

A rule is looked up by its keyword first; only the rules whose keyword is among a document's words run, and only
where their pattern matches are its places worked out. A match is suppressed if another match that covers its words
outranks it: by tier, then by length, then by the rule's place in the table. The base phrases are counted before
suppression.

Cases: a null or empty text has no words and no labels (n_words and n_base 0, labels '', score 0, first_word and
last_word null); a null doc_id stays null; repeated rows give repeated results; an empty table gives an empty result;
other columns of the input are ignored. Ties between equal spans go to the earlier rule. Whole texts are scanned;
places are found in time linear in the text for each rule that matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.license_rules import Rule, rules

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OPEN, CLOSE = "\x01", "\x02"  # marks around a match; never part of a word
#: Score by the tier of the best match that is left.
SCORES = {5: 1.0, 4: 0.9, 3: 0.8, 2: 0.6, 1: 0.3}
#: Numbers of neighbours to look at when matches are compared; the first that is enough is taken.
REACHES = (8, 32, 128, 512)


def longest(rule: Rule) -> int:
    """No match of a rule spans more words."""
    return rule.pattern.count(" (?:") + sum(map(int, re.findall(r"\{0,(\d+)\}", rule.pattern)))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marked(rule: Column, text: Column) -> Column:
    """The words of text with OPEN before and CLOSE after each match."""
    return F.split(F.btrim(F.regexp_replace(text, rule.getField("pattern"), F.lit(f" {OPEN} $0 {CLOSE} "))), " +")


def _places(words: Column, mark: str) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, spans, kept): all matches and those left after suppression, as arrays of
    struct<start, end, tier, rule, label, base> in the order of start; words are numbered from 0, end is exclusive."""
    table = table or rules()
    # The Kelvin sign is the one other letter that lower() would make an ASCII letter.
    lower = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("K"), F.lit("§")))
    known = F.array(*(F.struct(F.lit(r.rule).alias("rule"), F.lit(r.tier).alias("tier"), F.lit(r.keyword).alias("keyword"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.base).alias("base")) for r in table))
    keywords = F.array(*(F.lit(k) for k in sorted({r.keyword for r in table})))
    words = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    gate = words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect(keywords, F.col("words")).alias("found"), F.col("words"))
    text = gate.select("doc_id", "n_words", "found", F.when(F.size("found") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).alias("spaced"))
    hit = text.select(
        "doc_id",
        "n_words",
        "spaced",
        F.when(F.col("spaced").isNull(), F.array()).otherwise(F.filter(known, lambda r: F.array_contains("found", r.getField("keyword")) & F.regexp_like("spaced", r.getField("pattern")) & (F.size("found") > 0))).alias("hits"),
    )
    marked = hit.select("doc_id", "n_words", F.transform("hits", lambda r: _let(_marked(r, F.col("spaced")), lambda w: F.struct(r.alias("r"), _places(w, OPEN).alias("a"), _places(w, CLOSE).alias("b")))).alias("marked"))

    def spans(m: Column) -> Column:
        r = m.getField("r")
        at = lambda a, k: F.struct((a - 2 * k).alias("start"), (F.get(m.getField("b"), k) - 2 * k - 1).alias("end"), *(r.getField(x).alias(x) for x in ("tier", "rule", "label", "base")))
        return F.transform(m.getField("a"), at)

    found = marked.select("doc_id", "n_words", F.sort_array(F.flatten(F.transform("marked", spans))).alias("spans"))
    far = max(longest(r) for r in table)
    size = F.size("spans")

    def enough(reach: int) -> Column:
        """Whether no match has more than `reach` others that start within the longest span after it."""
        return F.forall(F.transform("spans", lambda x, i: F.coalesce(F.get("spans", i + reach).getField("start") - x.getField("start") > far, F.lit(True))), lambda x: x)

    reach = F.when(size <= REACHES[0], size)
    for r in REACHES:
        reach = reach.when(enough(r), F.lit(r))
    near = found.withColumn("reach", reach.otherwise(size))

    def outranked(x: Column, i: Column) -> Column:
        around = F.slice("spans", F.greatest(F.lit(1), i + 1 - F.col("reach")), 2 * F.col("reach") + 1)
        long = lambda s: s.getField("end") - s.getField("start")
        return F.exists(
            around,
            lambda y: (y.getField("start") <= x.getField("start"))
            & (y.getField("end") >= x.getField("end"))
            & (
                (y.getField("tier") > x.getField("tier"))
                | ((y.getField("tier") == x.getField("tier")) & ((long(y) > long(x)) | ((long(y) == long(x)) & (y.getField("rule") < x.getField("rule")))))
            ),
        )

    return near.select("doc_id", "n_words", "spans", F.filter("spans", lambda x, i: ~outranked(x, i)).alias("kept"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score and spans
    (the matches that are left)."""
    found = matches(docs, id_col, text_col).withColumn("base", F.filter("spans", lambda s: s.getField("base")))
    names = lambda spans: F.array_distinct(F.transform(spans, lambda s: s.getField("label")))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    score = F.lit(0.0)
    for tier in sorted(SCORES):
        score = F.when(F.array_contains(F.transform("kept", lambda s: s.getField("tier")), tier), F.lit(SCORES[tier])).otherwise(score)
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0)).getField("start").cast("long").alias("first_word"),
        F.when(F.size("base") > 0, F.element_at("base", -1).getField("start").cast("long")).alias("last_word"),
        joined(names("base")).alias("base_labels"),
        joined(F.array_union(names("base"), names("kept"))).alias("labels"),
        score.alias("score"),
        F.transform("kept", lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"), s.getField("label").alias("label"))).alias("spans"),
    )


def sql() -> str:
    """DuckDB SQL for the rows of op1."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({r.rule}, {r.tier}, {quote(r.keyword)}, {quote(r.label)}, {quote(r.pattern)}, {str(r.base).lower()})" for r in rules())
    score = " ".join(f"when max(tier) = {t} then {s}" for t, s in SCORES.items())
    return rf"""
with rules(rule, tier, keyword, label, pattern, base) as (values {values}),
d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as words from documents),
t as (select k, words, ' ' || array_to_string(words, '  ') || ' ' as spaced from d where len(words) > 0),
hit as (select k, r.*, string_split_regex(trim(regexp_replace(spaced, pattern, ' ' || chr(1) || ' \0 ' || chr(2) || ' ', 'g')), ' +') as w
  from t, rules r where list_contains(words, keyword) and regexp_matches(spaced, pattern)),
p as (select k, rule, tier, label, base, list_filter(range(len(w)), lambda i: w[i + 1] = chr(1)) as a, list_filter(range(len(w)), lambda i: w[i + 1] = chr(2)) as b from hit),
s as (select k, rule, tier, label, base, a[i] - 2 * (i - 1) as s, b[i] - 2 * (i - 1) - 1 as e from (select *, unnest(range(1, len(a) + 1)) as i from p)),
kept as (select * from s x where not exists (select 1 from s y where y.k = x.k and y.s <= x.s and y.e >= x.e
  and (y.tier > x.tier or y.tier = x.tier and (y.e - y.s > x.e - x.s or y.e - y.s = x.e - x.s and y.rule < x.rule)))),
b as (select k, count(*) as n, min(s) as f, max(s) as l, string_agg(distinct label, ',' order by label) as labels from s where base group by k),
m as (select k, case {score} end as score from kept group by k),
l as (select k, string_agg(distinct label, ',' order by label) as labels from (select k, label from kept union all select k, label from s where base) group by k)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_base, f::bigint as first_word, l.l::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join (select k, n, f, l, labels as base_labels from b) l using (k) left join m using (k) left join l as al using (k)"""
