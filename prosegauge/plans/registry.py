"""Every registered query of the auditor, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex
from prosegauge.functions.everyday import everyday
from prosegauge.functions.text import ALL_WS, CLOSERS, barrier, config_hash, plainer, words_in
from prosegauge.operators import governance
from prosegauge.operators.sentences import marked, n_fewest, n_most
from prosegauge.operators.structure import Parsed
from prosegauge.plans import carriers
from prosegauge.plans.audit import audit, files, totals

Query = Callable[[SparkSession, str], DataFrame]
ONE_SCAN = ["sentence-length", "paragraph-length", "sentence-average", "complex-word"]


def _rule(rule: str, corpus: Query, key: str = "doc_id") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit(corpus(spark, sf_dir), only=[rule]).select(F.col("doc").alias(key), "line", "detail")

    return query


def acronym_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(carriers.documents(spark, sf_dir), only=["acronym-undefined"]).select(F.col("doc").alias("doc_id"), "line", "detail")


def word_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = carriers.table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(words_in(plainer(F.coalesce("text", F.lit(""))))).cast("long").alias("n_words"))


def sentence_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and words of each source. The counts of a document are worked out in its own rows."""
    corpus = carriers.table(spark, sf_dir, "documents").select(F.struct("doc_id", "source").alias("doc"), "text")
    rows = barrier(Parsed(corpus).blocks.select("doc", "text", marked(F.col("text")).alias("m")))
    return rows.groupBy(F.col("doc.source").alias("source")).agg(F.sum(n_most(F.col("m"))).cast("long").alias("n_most"), F.sum(n_fewest(F.col("m"))).cast("long").alias("n_fewest"), F.sum(words_in(F.col("text"))).cast("long").alias("n_words"))


def page_link_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit(carriers.vague_pages(spark, sf_dir), only=["link-text"])
    return rows.groupBy(F.col("doc").alias("page_id"), "detail").agg(F.count("*").alias("n"))


def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all seventeen rules by rule."""
    return totals(audit(carriers.documents(spark, sf_dir))).select(F.lit(config_hash()).alias("config_hash"), "rule", "n")


def files_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all seventeen rules by document, clean documents included."""
    corpus = carriers.documents(spark, sf_dir)
    return files(corpus, audit(corpus)).withColumnRenamed("doc", "doc_id")


def plain_rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the rules on sentences and words, which one scan and no shuffle but the count give."""
    return totals(audit(carriers.documents(spark, sf_dir), only=ONE_SCAN)).select(F.lit(config_hash()).alias("config_hash"), "rule", "n")


def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seventeen rules over all corpora; totals by corpus."""
    rows = audit(carriers.everything(spark, sf_dir))
    return rows.groupBy(F.substring_index("doc", "/", 1).alias("corpus"), "rule").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"))


NAMES = ("docs/style-guide/p", "docs/pull_request_template/p", ".github/workflows/lint", "site/training/p", "docs/Glossary-", "notes/p")


def evidence_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = carriers.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    path = F.concat(carriers.pick(NAMES, "page_id"), k.cast("string"), F.when(k % 4 == 2, ".yml").otherwise(".md"))
    found = governance.evidence(pages.select(path.alias("path"), F.when(k % 8 == 2, F.lit("run: markdown-lint")).otherwise(F.lit("run: build")).alias("content")))
    return governance.evidence_found(spark, found)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = carriers.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("organisation"))
    each = customers.select("organisation", F.explode(governance.catalogue()).alias("m"))
    met = (F.col("organisation") * (F.col("m.dim_ord") + 3) + F.col("m.level") * 7) % 5 != 0
    return each.select("organisation", "m.dimension", "m.criterion", met.alias("met"))


def maturity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.maturity(_answers(spark, sf_dir)).drop("dim_ord")


def maturity_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.overall(governance.maturity(_answers(spark, sf_dir)))


def trend_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of orders: one a month and priority, with the change since the one before."""
    orders = carriers.table(spark, sf_dir, "orders")
    shots = orders.groupBy(F.col("o_orderpriority").alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("timestamp")).agg(F.count("*").alias("total"))
    return governance.trend(shots)


def queries() -> dict[str, Query]:
    return {
        "sentence_length": _rule("sentence-length", carriers.documents),
        "paragraph_length": _rule("paragraph-length", carriers.documents),
        "sentence_average": _rule("sentence-average", carriers.documents),
        "word_stats_by_lang": word_stats_by_lang,
        "sentence_stats_by_source": sentence_stats_by_source,
        "complex_word": _rule("complex-word", carriers.documents),
        "acronym_undefined": acronym_undefined,
        "legalese": _rule("legalese", carriers.part("phrases"), "part"),
        "framed_legalese": _rule("legalese", carriers.part("framed"), "part"),
        "double_negative": _rule("double-negative", carriers.part("phrases"), "part"),
        "wordy_phrase": _rule("wordy-phrase", carriers.part("phrases"), "part"),
        "doublet": _rule("doublet", carriers.part("phrases"), "part"),
        "filler_opening": _rule("filler-opening", carriers.part("openings"), "part"),
        "prose_enumeration": _rule("prose-enumeration", carriers.part("enumerations"), "part"),
        "heading_depth": _rule("heading-depth", carriers.part("headings"), "part"),
        "heading_skip": _rule("heading-skip", carriers.part("headings"), "part"),
        "heading_style": _rule("heading-style", carriers.part("headings"), "part"),
        "table_header": _rule("table-header", carriers.part("tables"), "part"),
        "link_text": _rule("link-text", carriers.part("links"), "part"),
        "image_alt": _rule("image-alt", carriers.part("links"), "part"),
        "page_link_text": page_link_text,
        "rule_totals": rule_totals,
        "files_summary": files_summary,
        "plain_rule_totals": plain_rule_totals,
        "all_rule_totals": rule_totals,
        "all_files_summary": files_summary,
        "full_audit": full_audit,
        "evidence_sweep": evidence_sweep,
        "maturity_score": maturity_score,
        "maturity_overall": maturity_overall,
        "trend_by_month": trend_by_month,
    }


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:  # noqa: ANN001
    return ", ".join(map(_q, values))


def _pick(values, key: str = "p_partkey") -> str:  # noqa: ANN001
    values = list(values)
    return f"([{_list(values)}])[({key} % {len(values)} + 1)::int]"


def _sentences() -> str:
    """CTEs up to s: the fragments of documents, with verdicts and the numbers of the sentences they fall in."""
    word = rf"[^{ALL_WS}]"
    return rf"""
f as (select doc_id, source, string_split(regexp_replace(coalesce(text, ''), {_q(f"([.!?][{CLOSERS}]*[{ALL_WS}]+)")}, '\1' || chr(1), 'g'), chr(1)) as parts from documents where regexp_matches(coalesce(text, ''), {_q(word)})),
p as (select doc_id, source, unnest(parts) as t, generate_subscripts(parts, 1) as i from f),
q as (select *, regexp_replace(regexp_extract(regexp_replace(lag(t) over o, {_q(f"[{ALL_WS}]+$")}, ''), {_q(word + "*$")}), {_q(f"[{CLOSERS}]+$")}, '') as token, regexp_extract(t, {_q(f"^[{ALL_WS}]*({word}*)")}, 1) as nxt,
  len(regexp_extract_all(t, {_q(word + "+")})) as words, length(t) - length(replace(t, chr(10), '')) as ends from p window o as (partition by doc_id order by i)),
r as (select *, lower(regexp_replace(replace(token, '.', ''), '^[^A-Za-z]+', '')) as word, regexp_matches(nxt, '^[^A-Za-z]*[A-Z]') as capital,
  lower(regexp_replace(nxt, '[^A-Za-z]', '', 'g')) in ({_list(lex.STARTERS)}) as starting, regexp_replace(nxt, '[^A-Za-z0-9]', '', 'g') in ({_list(lex.LOWERCASE_NAMES)}) as named, regexp_matches(nxt, '^[^A-Za-z]*[a-z]') as low from q),
v as (select *, case when i = 1 or not ends_with(token, '.') then 'split' when word in ({_list(lex.TITLES)}) then 'merge'
  when regexp_matches(token, '^[^A-Za-z]*[A-Z]\.$') then case when capital and not starting then 'merge' else 'ambiguous' end
  when word in ({_list(lex.ABBREVIATIONS)}) then case when regexp_matches(nxt, '^[^A-Za-z0-9]*[A-Z0-9][^A-Za-z]*$') then 'merge' when capital and starting then 'split' when named or capital then 'ambiguous' else 'merge' end
  when regexp_matches(token, '^[^A-Za-z]*(?:[A-Za-z]\.){{2,}}$') then case when low and not named then 'merge' when capital and starting then 'split' else 'ambiguous' end
  else 'split' end as verdict from r),
s as (select *, sum((verdict <> 'merge')::int) over o as most, sum((verdict = 'split')::int) over o as fewest, coalesce(sum(ends) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as before from v window o as (partition by doc_id order by i)),
a as (select doc_id, source, most, sum(words) as w, min(before) as before from s group by all having w > 0),
b as (select doc_id, source, fewest, sum(words) as w from s group by all having w > 0),
l as (select doc_id, (1 + before)::int as line, w::bigint || ' words (limit 30)' as detail from a where w > 30),
g as (select doc_id, 1 as line, count(*) || ' sentences (limit 5)' as detail from b group by doc_id having count(*) > 5),
h as (select a.doc_id, 1 as line, 'average ' || (round((sum(a.w)::double / count(*))::decimal(30, 18), 1)::decimal(20, 1)) || ' words across ' || count(*) || ' sentences (limit 20)' as detail from a
  where doc_id in (select doc_id from b group by doc_id having count(*) >= 10 and sum(w) > 20 * count(*)) group by a.doc_id having count(*) >= 10 and sum(a.w) > 20 * count(*)),
{_complex("c")}"""


def _complex(name: str) -> str:
    pairs = ", ".join(f"({_q(k)}, {_q(v)})" for k, v in lex.COMPLEX_WORDS.items())
    return rf"""
{name} as (select doc_id, line::int as line, '"' || w || '" where "' || plain || '" would do' as detail from (
  select doc_id, line, unnest(regexp_extract_all(t, '[A-Za-z'']+')) as w from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)) x
  join (values {pairs}) m(word, plain) on lower(w) = word)"""


def _name(values) -> str:  # noqa: ANN001
    return _pick(values).replace("\n", "' || chr(10) || '")


def part_sql() -> dict[str, str]:
    """The texts of `carriers.part_texts`, of which SQL reads openings in lower case alone."""
    nl = " || chr(10) || "
    mark = "repeat('#', (p_partkey % 6 + 1)::int)"
    label = "case p_partkey % 4 when 0 then 'here' when 1 then 'Click here' when 2 then '' else p_name end"
    return {
        "phrases": f"'The ' || p_name || ' team ' || {_pick(lex.LEGALESE)} || ' ship the item ' || {_pick(lex.WORDY)} || ' the plan.'{nl}'This is ' || {_pick(lex.DOUBLE_NEGATIVES)} || ' news about ' || {_pick(lex.DOUBLETS)} || ' for all.'",
        "openings": f"case when p_partkey % 17 < 15 then {_pick(lex.FILLERS)} else 'the box' end || ', the ' || p_name || ' is ready.'",
        "enumerations": f"'For the ' || p_name || ': ' || {_pick(carriers.ENUMERATIONS)}",
        "headings": f"'# Catalogue'{nl}''{nl}{mark} || ' ' || p_name || {_pick(carriers.ENDINGS)}{nl}''{nl}'Body of the entry.'{nl}''{nl}'## Parts ##'{nl}''{nl}{mark} || '# Last'",
        "tables": f"'Sizes:'{nl}''{nl}'| name | ' || case p_partkey % 3 when 0 then '' when 1 then '*size*' else '**' end || ' |'{nl}'|---|:-:|'{nl}'| ' || p_name || ' | 1 |'{nl}''{nl}'no | table | ' || p_name",
        "links": f"'See [' || {label} || '](http://example.com/p/' || p_partkey || ')'{nl}'and ![' || case when p_partkey % 5 = 0 then '' else p_name end || '](i' || p_partkey || '.png) or [www.example.com](q' || p_partkey || ') too.'",
        "framed": f"{_name([a for a, _ in carriers.FRAMES])} || 'The ' || p_name || ' team ' || {_pick(lex.LEGALESE)} || ' go.' || {_name([b for _, b in carriers.FRAMES])}",
    }


def _lines(name: str) -> str:
    """CTEs: the texts of a carrier as c(part, text) and their lines as l(part, line, t)."""
    return f"""c as (select p_partkey as part, {part_sql()[name]} as text from part),
l as (select part, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1)::int as line from c)"""


def _phrases(phrases, detail: str) -> str:  # noqa: ANN001
    """Findings of phrases in the carrier; detail may use w, the phrase as written."""
    pattern = _q(r"(?i)\b(?:" + "|".join(sorted(phrases, key=len, reverse=True)) + r")\b")
    return f"with {_lines('phrases')} select part, line, {detail} as detail from (select part, line, unnest(regexp_extract_all(t, {pattern})) as w from l)"


HEADINGS = r"""h as (select part, line, length(regexp_extract(t, '^ {0,3}(#{1,6})(?:[ \t]|$)', 1)) as level, trim(regexp_replace(trim(regexp_extract(t, '^ {0,3}#{1,6}[ \t]+(.*)$', 1)), '\s+#+$', '')) as head
  from l where regexp_matches(t, '^ {0,3}#{1,6}([ \t]|$)'))"""
LINKS = r"""m as (select part, line, unnest(regexp_extract_all(t, '!?\[[^\[\]]*\]\([^()]*\)')) as m from l),
k as (select part, line, starts_with(m, '!') as image, trim(regexp_replace(regexp_extract(m, '\[([^\[\]]*)\]', 1), '[*_~`]', '', 'g')) as label, trim(regexp_extract(m, '\(([^()]*)\)', 1)) as target from m)"""


def _initials(text: str) -> str:
    return f"upper(array_to_string(list_transform(list_filter(regexp_extract_all({text}, '[A-Za-z]+'), lambda w: lower(w) not in ({_list(lex.EXPANSION_STOP_WORDS)})), lambda w: w[1]), ''))"


def _acronyms() -> str:
    """CTEs up to au(doc_id, line, detail): undefined acronyms in documents without structure, which are one block."""
    space = _q(f"[{ALL_WS}]+")
    shape = _q(r"^(?:[A-Z]{2,6}|[A-Z]\.(?:[A-Z]\.)+)$")
    clear = lambda c: f"(length({c}) >= 4 and regexp_matches({c}, {_q(lex.ROMAN)}) and {c} not in ({_list(lex.NUMERAL_EXCEPTIONS)}))"
    number = lambda c: f"lower({c}) in ({_list(lex.NUMBERING)})"
    roman = lambda c: f"({c} <> '' and regexp_matches({c}, {_q(lex.ROMAN)}))"
    titled = " or ".join(f"b{k} in ({_list(lex.NAMED_BY_NUMERAL)})" for k in (1, 2, 3))
    listed = " or ".join(f"{roman(f'b{k}')} and {number(f'b{k + 1}')}" for k in (2, 3, 4))
    evidence = f"""{number('b1')} or {number('b2')} or {number('b3')} or {titled} or (regexp_matches(b1, '^[A-Z][a-z]{{4,}}$') and lower(b1) not in ({_list(everyday())}) and not {number('b1')})
  or {clear('b1')} or {clear('a1')} or (lower(b1) in ('and', 'or', 'to', 'through') and ({listed} or {clear('b2')} or {clear('b3')} or {clear('b4')}))"""
    back = ", ".join(f"coalesce(lag(bare, {k}) over o, '') as b{k}" for k in range(1, 6))
    opening = "case " + " ".join(f"when starts_with(lead(raw, {k}) over o, '(') then lead(pos, {k}) over o" for k in (1, 2, 3)) + " end"
    return rf"""
w0 as (select doc_id, line, list_filter(string_split_regex(t, {space}), lambda x: x <> '') as raws from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line
  from documents where regexp_matches(text, '[A-Z]{{2}}|[A-Z]\.[A-Z]\.'))),
w1 as (select doc_id, line, raws, unnest(raws) as raw, generate_subscripts(raws, 1) as nth from w0),
w2 as (select *, line * 4294967296 + nth as pos, regexp_replace(raw, '[^A-Za-z]', '', 'g') as bare, regexp_replace(regexp_replace(raw, '^["''“‘(\[{{<]+', ''), '["''”’)\]}}>,:;!?]+$', '') as core,
  regexp_replace(regexp_replace(raw, '^[^A-Za-z]+', ''), '[^A-Za-z.]+$', '') as big from w1),
w3 as (select *, case when regexp_matches(core, {shape}) then core when regexp_matches(regexp_replace(core, '\.$', ''), {shape}) then regexp_replace(core, '\.$', '') end as token,
  regexp_matches(big, {shape}) or regexp_matches(big, '^[A-Z]{{2,}}$') as caps, lower(bare) in ({_list(everyday())}) as common from w2),
w4 as (select *, replace(token, '.', '') as key, sum((not caps)::int) over o as run, {back}, coalesce(lead(bare, 1) over o, '') as a1, {opening} as opens from w3 window o as (partition by doc_id order by pos)),
w5 as (select *, count(*) over r as n, sum(common::int) over r as usual from w4 window r as (partition by doc_id, run, caps)),
w6 as (select * from w5 where token is not null and key not in ({_list(lex.KNOWN_ACRONYMS)}) and not (regexp_matches(key, {_q(lex.ROMAN)}) and ({clear('key')} or {evidence}))),
e1 as (select w6.doc_id, w6.pos, opens, min(c.pos) as closes from w6 join w1c c on c.doc_id = w6.doc_id and c.pos >= opens group by all),
e2 as (select e1.doc_id, e1.pos, string_agg(w2.raw, ' ' order by w2.pos) as inside from e1 join w2 on w2.doc_id = e1.doc_id and w2.pos between opens and closes group by all),
e3 as (select doc_id, pos, {_initials("regexp_extract(inside, '^.([^)]*)[)]', 1)")} as spelt from e2),
w7 as (select w6.*, coalesce(spelt = key, false) as expanded from w6 left join e3 using (doc_id, pos)),
d1 as (select doc_id, pos, replace(regexp_extract(raw, '\(([A-Z][A-Z.]{{1,5}})\)', 1), '.', '') as key, {_initials("array_to_string(raws[1:nth - 1], ' ') || ' ' || split_part(raw, '(', 1)")} as before from w2 where regexp_matches(raw, '\(([A-Z][A-Z.]{{1,5}})\)')),
d2 as (select doc_id, key, min(pos) as said from (select doc_id, key, pos from d1 where right(before, length(key)) = key union all select doc_id, key, pos from w7 where expanded) group by all),
u1 as (select doc_id, key, min(pos) as pos, arg_min(line, pos) as line, arg_min(token, pos) as token from w7
  where not expanded and not common and not (caps and n >= 2 and case when n = 2 then usual = 2 else 2 * usual >= n end) group by all),
au as (select doc_id, line::int as line, 'define acronym "' || token || '" on first use' as detail from u1 left join d2 using (doc_id, key) where said is null or said > pos)""".replace("w3 as (select", "w1c as (select doc_id, line * 4294967296 + nth as pos from w1 where contains(raw, ')')),\nw3 as (select", 1)


def _everywhere() -> str:
    """CTEs up to ar(doc_id, rule): the findings of all rules in documents, which hold no Markdown structure."""
    found = lambda rule, phrases: rf"select doc_id, '{rule}' as rule from (select doc_id, unnest(regexp_extract_all(text, {_q(r'(?i)\b(?:' + '|'.join(p.replace(' ', r'\s+') for p in sorted(phrases, key=len, reverse=True)) + r')\b')})) from documents)"
    opening = "^(?:" + "|".join(lex.FILLERS) + ")"
    filler = rf"select doc_id, 'filler-opening' from documents where regexp_matches(lower(trim(text)), {_q(opening + r'(?:$|[\s.,;:!?)\]])')}) and not regexp_matches(lower(trim(text)), {_q(opening + r'[\s.,;:!?]*not\b')})"
    ranks = rf"""list_concat(list_transform(list_filter(regexp_extract_all(replace(text, chr(10), ' '), '(?i)(?:first|second|third|fourth|fifth|sixth)(?:ly)?-?'), lambda x: not ends_with(x, '-')), lambda x: list_position(['fi', 'se', 'th', 'fo', 'ff', 'si'], case when starts_with(lower(x), 'fif') then 'ff' else lower(x)[1:2] end)),
  list_transform(regexp_extract_all(replace(replace(text, chr(10), ' '), ' ', '  '), '(?:^|\s)(\([1-6]\)|[1-6][.)])(?:\s|$)', 1), lambda x: regexp_extract(x, '[1-6]')::int))"""
    enumerated = f"select doc_id, 'prose-enumeration' from (select doc_id, list_distinct({ranks}) as r from documents) where list_contains(r, 1) and len(r) >= 3"
    return f"""{_sentences()}, {_acronyms()},
ar as (select doc_id, 'sentence-length' as rule from l union all select doc_id, 'paragraph-length' from g union all select doc_id, 'sentence-average' from h union all select doc_id, 'complex-word' from c union all select doc_id, 'acronym-undefined' from au
union all {found('legalese', lex.LEGALESE)} union all {found('double-negative', lex.DOUBLE_NEGATIVES)} union all {found('wordy-phrase', lex.WORDY)} union all {found('doublet', lex.DOUBLETS)} union all {filler} union all {enumerated})"""


def _map(table: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in table.items()) + "}[lower(w)]"


def oracle_sql() -> dict[str, str]:
    s = _sentences()
    lean = {k: v for k, v in lex.DOUBLETS.items() if v}
    legal = _list(k for k, v in lex.DOUBLETS.items() if v is None)
    union = "select doc_id, 'sentence-length' as rule from l union all select doc_id, 'paragraph-length' from g union all select doc_id, 'sentence-average' from h union all select doc_id, 'complex-word' from c"
    categories = ", ".join(f"({_q(c)}, {_q(p)})" for c, p in lex.EVIDENCE.items())
    model = ", ".join(f"({_q(d)}, {i}, {level}, {_q(c)})" for i, (d, cs) in enumerate(lex.MATURITY.items()) for level, c in enumerate(cs, 1))
    maturity = f"""m(dimension, dim_ord, level, criterion) as (values {model}),
x as (select c_custkey as organisation, m.*, (c_custkey * (dim_ord + 3) + level * 7) % 5 <> 0 as met from customer, m),
y as (select organisation, dimension, min(case when not met then level end) as gap from x group by all),
z as (select y.organisation, y.dimension, coalesce(gap - 1, 4)::int as level, coalesce(m.criterion, '') as missing from y left join m on m.dimension = y.dimension and m.level = y.gap)"""
    vague = _list(lex.VAGUE_LINKS)
    return {
        "sentence_length": f"with {s} select doc_id, line, detail from l",
        "paragraph_length": f"with {s} select doc_id, line, detail from g",
        "sentence_average": f"with {s} select doc_id, line, detail from h",
        "word_stats_by_lang": f"select lang, count(*) as n_docs, sum(len(regexp_extract_all(coalesce(text, ''), {_q(f'[^{ALL_WS}]+')})))::bigint as n_words from documents group by lang",
        "sentence_stats_by_source": f"with {s} select source, n_most::bigint as n_most, n_fewest::bigint as n_fewest, n_words::bigint as n_words from (select source, count(*) as n_most, sum(w) as n_words from a group by source) join (select source, count(*) as n_fewest from b group by source) using (source)",
        "complex_word": f"with {_complex('c')} select * from c",
        "legalese": _phrases(lex.LEGALESE, "'banned term \"' || lower(w) || '\"'"),
        "double_negative": _phrases(lex.DOUBLE_NEGATIVES, "'\"' || w || '\" makes the reader unpick two negatives'"),
        "wordy_phrase": _phrases(lex.WORDY, f"'\"' || lower(w) || '\" says what \"' || {_map(lex.WORDY)} || '\" says'"),
        "doublet": _phrases(lex.DOUBLETS, f"case when lower(w) in ({legal}) then 'legal-register phrase \"' || lower(w) || '\"; review for audience fit' else 'redundant phrase \"' || lower(w) || '\"; consider \"' || {_map(lean)} || '\"' end"),
        "framed_legalese": f"with {_lines('framed')} select part, line, 'banned term \"' || regexp_extract(t, '(?i){'|'.join(lex.LEGALESE)}') || '\"' as detail from l where contains(t, ' team ') and part % {len(carriers.FRAMES)} not in {carriers.HIDING}",
        "filler_opening": rf"""with {_lines('openings')}, f(filler, n) as (values {", ".join(f"({_q(x)}, {k})" for k, x in enumerate(lex.FILLERS))})
select part, 1 as line, 'opens with "' || arg_min(filler, n) || '" instead of the answer' as detail from c join f on starts_with(lower(text), filler) and regexp_matches(lower(text)[length(filler) + 1:], '^(?:$|[\s.,;:!?)\]])')
  and not regexp_matches(lower(text)[length(filler) + 1:], '^[\s.,;:!?]*not\b') group by part""",
        "prose_enumeration": rf"""with {_lines('enumerations')},
r as (select part, list_sort(list_distinct(list_concat(
  list_transform(regexp_extract_all(text, '(?i)\b(?:first|second|third|fourth|fifth|sixth)(?:ly)?\b'), lambda x: list_position(['firs', 'seco', 'thir', 'four', 'fift', 'sixt'], lower(x)[1:4])),
  list_transform(regexp_extract_all(text, '\s(\([1-6]\)|[1-6][.)])\s', 1), lambda x: regexp_extract(x, '[1-6]')::int)))) as ranks from c)
select part, 1 as line, 'enumeration ranks ' || array_to_string(ranks, ', ') || ' in prose; consider a list' as detail from r where list_contains(ranks, 1) and len(ranks) >= 3""",
        "heading_depth": rf"with {_lines('headings')}, {HEADINGS} select part, line, 'heading level ' || level || ' (limit 4)' as detail from h where level > 4",
        "heading_skip": rf"with {_lines('headings')}, {HEADINGS}, b as (select *, lag(level) over (partition by part order by line) as before from h) select part, line, 'heading jumps from level ' || before || ' to level ' || level as detail from b where level > before + 1",
        "heading_style": rf"""with {_lines('headings')}, {HEADINGS},
n as (select part, line, len(regexp_extract_all(head, '\S+')) as words, len(regexp_extract_all(head, '[.!?][*_]*\s+')) + 1 as sentences, regexp_replace(head, '[*_~]+$', '') as form from h),
d as (select part, line, case when words > 12 then words || ' words (limit 12)' when sentences >= 2 then sentences || ' sentences in heading' when ends_with(form, '.') and not ends_with(form, '...') then 'heading ends with a full stop' end as detail from n)
select * from d where detail is not null""",
        "table_header": rf"""with {_lines('tables')},
n as (select part, line, trim(t) as row, trim(lead(t) over (partition by part order by line)) as below from l),
k as (select part, line, string_split(case when starts_with(row, '|') then regexp_replace(row, '^\||\|$', '', 'g') else row end, '|') as cells from n where contains(row, '|') and regexp_matches(below, '^\|?[\s:|-]+\|?$') and contains(below, '-'))
select part, line, 'table header has an empty column name' as detail from k where len(list_filter(cells, lambda x: trim(regexp_replace(x, '[*_~`]', '', 'g')) = '')) > 0""",
        "link_text": rf"""with {_lines('links')}, {LINKS}
select part, line, case when label = '' then 'link has no text; say where it goes' else 'link text "' || label || '" describes no destination (' || target[1:40] || ')' end as detail
from k where not image and target <> '' and (label = '' or lower(label) in ({vague}) or regexp_matches(label, '(?i)^<?(?:https?://|www\.)'))""",
        "image_alt": rf"with {_lines('links')}, {LINKS} select part, line, 'image has no alternative text (' || target[1:40] || ')' as detail from k where image and label = '' and target <> ''",
        "acronym_undefined": f"with {_acronyms().strip()} select * from au",
        "rule_totals": f"with {_everywhere().strip()} select '{config_hash()}' as config_hash, rule, count(*) as n from ar group by rule",
        "files_summary": f"with {_everywhere().strip()}, k as (select doc_id, count(*) as n, count(distinct rule) as r from ar group by doc_id) select documents.doc_id, coalesce(n, 0)::bigint as n_violations, coalesce(r, 0)::bigint as n_rules from documents left join k using (doc_id)",
        "all_rule_totals": f"with {_everywhere().strip()} select '{config_hash()}' as config_hash, rule, count(*) as n from ar group by rule",
        "all_files_summary": f"with {_everywhere().strip()}, k as (select doc_id, count(*) as n, count(distinct rule) as r from ar group by doc_id) select documents.doc_id, coalesce(n, 0)::bigint as n_violations, coalesce(r, 0)::bigint as n_rules from documents left join k using (doc_id)",
        "page_link_text": rf"""with p as (select page_id, case when page_id % 3 = 0 then regexp_replace(html, '>[^<>]*</a>', '>' || {_pick(lex.VAGUE_LINKS, "page_id")} || '</a>', 'g') else html end as html from pages),
a as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a\s*>')) as e from p),
b as (select page_id, trim(regexp_replace(regexp_replace(regexp_extract(e, '(?is)^<a\b[^>]*>(.*?)</a\s*>$', 1), '<[^>]*>', ' ', 'g'), '[*_~`]', '', 'g')) as label, regexp_extract(e, 'href="([^"]*)"', 1) as target from a)
select page_id, case when label = '' then 'link has no text; say where it goes' else 'link text "' || label || '" describes no destination (' || target[1:40] || ')' end as detail, count(*) as n from b where label = '' or lower(label) in ({vague}) or regexp_matches(label, '(?i)^(?:https?://|www\.)') group by all""",
        "plain_rule_totals": f"with {s} select '{config_hash()}' as config_hash, rule, count(*) as n from ({union}) group by rule",
        "evidence_sweep": f"""with c(category, pattern) as (values {categories}),
p as (select {_pick(NAMES, "page_id")} || page_id || case when page_id % 4 = 2 then '.yml' else '.md' end as path, page_id % 8 = 2 as linted from pages),
h as (select category, path from c join p on regexp_matches(lower(path), pattern) or category = 'automated-checks' and linted and regexp_matches(lower(path), {_q(lex.WORKFLOW_PATH)}))
select category, count(path) > 0 as found, count(path) as n_paths, min(path) as first_path from c left join h using (category) group by category""",
        "maturity_score": f"with {maturity} select * from z",
        "maturity_overall": f"with {maturity} select organisation, min(level) as overall from z group by organisation",
        "trend_by_month": """with t as (select o_orderpriority as series, strftime(o_orderdate, '%Y-%m') as timestamp, count(*) as total from orders group by all)
select *, (row_number() over w)::int as audit, total - lag(total) over w as change from t window w as (partition by series order by timestamp)""",
    }
