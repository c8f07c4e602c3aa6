"""Phrases of the rules in blocks of text, told by Arrow's patterns, which go through a text once whatever they look for.

Java's patterns try each phrase at each place, five lists one after the other, and then once more to mark what they
find. Here one look tells which blocks hold a phrase at all, and one pass for each list marks all of its phrases. Blocks
in which more decides than the phrase and its edges (quotes, names in title case, digits beside a complex word) are
left to the columns in `prosegauge.operators.rules`.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prosegauge.functions import lexicon as lex
from prosegauge.functions.text import WS, first_look
from prosegauge.operators.rules import SAID_BY, in_title_case

#: What all blocks with a phrase match, and few others.
PHRASES = first_look((*lex.LEGALESE, *lex.DOUBLE_NEGATIVES, *lex.WORDY, *lex.DOUBLETS, *lex.COMPLEX_WORDS))


def _any_case(phrases: Iterable[str]) -> str:
    """Letters of both cases, ASCII alone as in Java's patterns; more words first."""
    cased = lambda w: "".join(f"[{c.upper()}{c}]" for c in w)
    return "|".join(f"[{WS}]+".join(map(cased, p.split(" "))) for p in sorted(phrases, key=lambda p: -len(p.split(" "))))


#: Phrases begin and end with letters, so edges of words are those of the columns' patterns.
_PATTERNS = [rf"\b(?:{_any_case(phrases)})\b" for phrases in SAID_BY.values()]
_COMPLEX = _any_case(lex.COMPLEX_WORDS)
_ELSEWHERE = f"[`“”\"'‘’]|\\b(?:{'|'.join(map(in_title_case, lex.DOUBLETS))})\\b|[0-9_](?:{_COMPLEX})|(?:{_COMPLEX})[0-9_]"


def said(blocks: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[int, dict]]]:
    """The blocks that may hold a phrase, those of them that are left to the columns, and (block, phrase) of the others:
    kind, its list; k, line ends before it; i, its number within the block and list."""
    may = pc.indices_nonzero(pc.match_substring_regex(blocks, PHRASES))
    texts = blocks.take(may)
    left = pc.match_substring_regex(texts, _ELSEWHERE).to_numpy(zero_copy_only=False)
    may = may.to_numpy(zero_copy_only=False)
    texts, at = texts.filter(pa.array(~left)), may[~left]
    found = []
    for kind, pattern in enumerate(_PATTERNS):
        has = pc.match_substring_regex(texts, pattern)
        marked = pc.replace_substring_regex(texts.filter(has), pattern, "\x01\\0\x02")
        for block, text in zip(at[has.to_numpy(zero_copy_only=False)].tolist(), marked.to_pylist()):
            first, *pieces = text.split("\x01")
            k = first.count("\n")
            for i, piece in enumerate(pieces):
                found.append((block, {"kind": kind, "k": k, "i": i, "phrase": piece.partition("\x02")[0]}))
                k += piece.count("\n")
    return may, may[left], found
