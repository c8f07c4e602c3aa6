"""Word lists, phrases and thresholds of the rules.

All of these are fixed values that results depend on, each in its natural order. Everyday words have a module of their
own: `prosegauge.functions.everyday`.
"""

from __future__ import annotations

THRESHOLDS = {
    "sentenceWordLimit": 30,
    "sentenceAverageLimit": 20,
    "averageMinimumSentences": 10,
    "paragraphSentenceLimit": 5,
    "maximumHeadingLevel": 4,
    "headingWordLimit": 12,
    "acronymMinimumLetters": 2,
    "acronymMaximumLetters": 6,
    "acronymDefinitionWindow": 3,
    "enumerationMinimumRanks": 3,
}

RULES = (
    "sentence-length", "paragraph-length", "legalese", "sentence-average", "heading-depth", "heading-skip", "heading-style", "acronym-undefined", "doublet",
    "prose-enumeration", "wordy-phrase", "complex-word", "double-negative", "filler-opening", "table-header", "link-text", "image-alt",
)

# Fixed values.
LEGALESE = ("shall", "hereby", "hereinafter", "wherefore", "heretofore", "aforesaid")
TITLES = "dr mr mrs ms messrs prof rev fr sr jr st gen gov sen rep capt col maj lt sgt".split()
ABBREVIATIONS = "inc ltd co vs etc fig no al approx cf dept est vol ed eds pp ca min max ext ref eq ver".split()
STARTERS = (
    "a after afterwards again all also although and another any as at because before besides between both but by consequently during each either even "
    "every finally first for from furthermore he hence her here his how however if in instead into it its later likewise meanwhile moreover most much "
    "neither nevertheless next no none nonetheless nor not now of on once only or otherwise our over she similarly since so some still such than that "
    "the their then there therefore these they this those though thus to under unless until up us we what when whenever where whereas wherever whether "
    "which while who whom whose why with within without yet you your"
).split()
LOWERCASE_NAMES = "iOS iPhone iPad iPadOS macOS watchOS tvOS visionOS eBay iTunes iCloud eSIM npm pnpm nginx ffmpeg".split()
COMPLEX_WORDS = {
    "utilise": "use", "utilize": "use", "utilising": "using", "utilizing": "using", "commence": "start", "commences": "starts", "commenced": "started",
    "ascertain": "find", "facilitate": "help", "facilitates": "helps", "endeavour": "try", "endeavor": "try", "terminate": "end", "terminates": "ends",
    "aforementioned": "this", "notwithstanding": "despite", "henceforth": "now", "thereafter": "then", "whereby": "how", "herein": "here", "thereof": "its",
    "therein": "inside", "expedite": "hasten", "disseminate": "share", "remuneration": "pay",
}
FILLERS = (
    "certainly", "sure", "of course", "absolutely", "great question", "good question", "happy to help", "i'd be happy to", "i would be happy to", "let me",
    "as an ai", "here is the summary", "here's the summary", "in this document we will", "this document will",
)
DOUBLE_NEGATIVES = (
    "not unlike", "not uncommon", "not unusual", "not unreasonable", "not unimportant", "not insignificant", "not inconsiderable", "not without",
    "never without", "cannot fail to", "not impossible", "not unknown", "no fewer than no", "not unhelpful", "not unclear",
)
#: Phrase -> the lean form; None where the phrase belongs to the legal register.
DOUBLETS = {
    "null and void": "void", "cease and desist": None, "terms and conditions": None, "each and every": "each", "first and foremost": "first",
    "true and correct": "true", "full and complete": "complete", "revert back": "revert", "repeat again": "repeat", "free gift": "gift",
    "past history": "history", "future plans": "plans", "end result": "result", "unexpected surprise": "surprise", "advance planning": "planning",
    "close proximity": "close", "general consensus": "consensus",
}
WORDY = {
    "in order to": "to", "due to the fact that": "because", "in the event that": "if", "at this point in time": "now", "at this moment in time": "now",
    "in the near future": "soon", "for the purpose of": "to", "with regard to": "about", "with reference to": "about", "in relation to": "about",
    "in the absence of": "without", "a large number of": "many", "a small number of": "a few", "the majority of": "most", "prior to": "before",
    "subsequent to": "after", "in spite of the fact that": "although", "notwithstanding the fact that": "although", "it is possible that": "may",
    "has the ability to": "can", "is able to": "can", "make a decision": "decide", "provide assistance": "help", "take into consideration": "consider",
}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6}
NAMED_WORK = "article book campaign company film initiative journal organisation organization paper programme program project publication report series study work".split()
VAGUE_LINKS = ("click here", "here", "this", "link", "this link", "read more", "more", "more info", "details", "see more", "learn more", "go", "page", "website", "download")
KNOWN_ACRONYMS = "KG KM CM MM MB GB KB TB PDF URL HTML TV PIN UN USA ISO AI API CLI JSON HTTP HTTPS SSH MIT OK ID AM PM".split()
NUMBERING = (
    "section sections chapter chapters part parts volume volumes appendix appendices annex figure figures table tables phase step tier page article "
    "articles title titles schedule schedules clause clauses edition act level grade stage"
).split()
NAMED_BY_NUMERAL = "King Queen Pope Emperor Empress Tsar Prince Princess Duke Earl Bowl War Olympiad Cup Festival".split()
NUMERAL_EXCEPTIONS = "MMIX MMX MMXI MIX DIM".split()
#: Fixed value: canonical numerals alone.
ROMAN = r"^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"
EXPANSION_STOP_WORDS = "a an and for in of on the to".split()

#: Fixed values. Dimension -> the criterion of levels 1 to 4.
MATURITY = {
    "governance": ("policy-documented", "owner-accountable", "resourced-mandated", "executive-review-cycle"),
    "capability": ("style-guide-available", "training-delivered", "competence-maintained", "roles-embedded"),
    "process": ("review-step-exists", "checks-in-workflow", "signoff-gates", "all-document-types-covered"),
    "measurement": ("corpus-baseline-taken", "regular-sampling", "user-testing", "metrics-drive-decisions"),
    "culture": ("leadership-aware", "leadership-champions", "feedback-loops", "improvement-cycles"),
}

#: Fixed values. Category -> pattern over a lower-case relative path; workflows count by their content too.
EVIDENCE = {
    "policy": r"plain[-_ ]?language[-_ ]?policy|style[-_ ]?guide",
    "review-workflow": r"pull_request_template|review[-_ ]?(?:process|workflow|checklist)",
    "automated-checks": r"\.vale\.ini$|\.textlintrc",
    "training": r"(?:^|/)(?:training|onboarding)/",
    "glossary": r"glossary|terminology",
}
WORKFLOW_PATH, WORKFLOW_CONTENT = r"workflows/.*\.(?:yml|yaml)$", r"vale|textlint|prose|lint"
AUDITED = r"\.(?:md|markdown|txt)$"
