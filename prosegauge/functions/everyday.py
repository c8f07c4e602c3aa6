"""Everyday words for the acronym rule: a run of capitals made of these is shouting, not a row of acronyms.

A list of our own: words of notices, forms and headings, with the words that the rules' own lists hold, and the regular
forms of all these (plurals, tenses, comparisons, adverbs), which a rule makes. It is fixed, so a document has the same findings alone and in any corpus. A project with more words passes its own list or
table (`common` of `prosegauge.plans.audit.audit`); `words_of_corpus` makes one from a corpus.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import lexicon as lex

OWN = """
about act add alarm always answer apply are ask attention away back bad be been best big build button buy by call can car card care caution change
check child city clean clear close cold come copy cost could cut danger data date day delete did do does done door down drive emergency enter error
exit fail fast file fire first food free full get give go good great had hand has have heavy help high home hot hour house important information is
job keep key know large last late left less light line list live long look lost low mail make man many may me message money month move must my name near
need never new night notice number office old open order out page pay people phone place plan please point press price private public pull push put
question quiet read ready remove report rest right road room rule run safe sale save say school see sell send service set shop should show sign size
small smoking sold start state stay step stop store street take team test thank time today top train true try turn up update urgent use used very
view visit wait walk want warning was watch water way week well will win word work world would write wrong year
""".split()  # fmt: skip
#: Words in the rules' lists that are also well-known acronyms.
NOT_EVERYDAY = {"it", "us", "ai"}


def forms(word: str) -> set[str]:
    """A word with its regular forms. Words of one or two letters have none, as theirs would look like acronyms."""
    if len(word) < 3 or not word.isalpha():
        return {word}
    last, before = word[-1], word[-2]
    vowels = "aeiou"
    if last == "y" and before not in vowels:
        plural, stem, open_ = word[:-1] + "ies", word[:-1] + "i", word
    else:
        plural = word + ("es" if word.endswith(("s", "x", "z", "ch", "sh")) else "s")
        stem = open_ = word[:-1] if last == "e" else word
        # A single vowel before a single consonant: stop, stopped.
        if len(word) <= 4 and last not in "aeiouwxy" and before in vowels and word[-3] not in vowels:
            stem = open_ = word + last
    made = {word, plural, stem + "ed", open_ + "ing", open_ + "ings", stem + "er", stem + "ers", stem + "est"}
    adverb = word[:-1] + "ily" if stem == word[:-1] + "i" else word[:-1] + "y" if word.endswith("le") else word + "ly"
    return made | {adverb, "un" + word, "re" + word, "un" + stem + "ed", "re" + stem + "ed", "re" + open_ + "ing"}


@cache
def everyday() -> tuple[str, ...]:
    phrases = (*lex.WORDY, *lex.WORDY.values(), *lex.DOUBLETS, *lex.DOUBLE_NEGATIVES, *lex.VAGUE_LINKS, *lex.LEGALESE, *lex.COMPLEX_WORDS, *lex.COMPLEX_WORDS.values())
    words = {*OWN, *lex.STARTERS, *lex.EXPANSION_STOP_WORDS, *lex.ORDINALS, *lex.NUMBERING, *lex.NAMED_WORK, *(w for p in phrases for w in p.split())}
    small = {*lex.STARTERS, *lex.EXPANSION_STOP_WORDS}
    every = set().union(*map(forms, words - small - NOT_EVERYDAY))
    known = {a.lower() for a in lex.KNOWN_ACRONYMS}
    return tuple(sorted((every - known | words) - NOT_EVERYDAY))


def words_of_corpus(corpus: DataFrame, share: float = 0.01) -> DataFrame:
    """(word): what at least a share of the distinct texts of a corpus (doc, text) write in lower case. Copies count
    once, and the share makes the list alike at every size."""
    texts = corpus.where("text <> ''").groupBy(F.xxhash64("text"), F.md5("text")).agg(F.min("text").alias("text"))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![A-Za-z])[a-z]+(?![A-Za-z])"), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.join(texts.agg((F.count("*") * share).alias("least"))).where("n >= least").select("word")
