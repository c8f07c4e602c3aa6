"""BPE encoding and decoding by per-prefix dynamic programming.

A word is a row of symbols (its bytes, the last one with the word end). For each prefix there is exactly one token
that can be last in the prefix's encoding: the candidates are the vocabulary entries that end there, and the one to
take is the one that may follow the last token of the prefix before it. Two tokens may stand side by side if merging
them as a row of symbols gives just these two tokens back, which `Vocabulary.compatible` tests by undoing merges.
Back-pointers from the last prefix spell the ids. Candidates come from a suffix-matching automaton: not the automaton
of all substrings of one string, but a trie of the vocabulary's entries whose failure links lead to the next shorter
suffix that begins an entry (Aho and Corasick), so that each state knows all entries that are suffixes of what was
read (`Vocabulary._automaton`).

The file's own normaliser and splitter are followed: NFC, white space runs, lower case letter by letter; contractions,
runs of letters, single digits, runs of other signs. White space never stands within a word, so texts are encoded
chunk by chunk between white space; of equal chunks in a batch one is encoded, and Arrow copies its ids.

Cases: null and empty texts give no ids. Special tokens written out in a text become their ids, as in the library.
A symbol outside the vocabulary is left out, as in the library (the file has no unknown token). Repeated rows give
repeated results, a null doc_id stays null, an empty table gives an empty result, other columns are ignored. Texts
are processed whole; the look-up table of chunks is dropped when it holds CACHE entries, which changes no result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import small_parts

#: Chunks remembered by a task before it starts afresh; bounds its memory, not its results.
CACHE = 400_000

#: Fixed value: the splitter's pattern of the tokenizer file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPACES = regex.compile(r"\p{White_Space}+")
#: Letters below U+0180 and the marks that may follow them: there all versions of Unicode agree.
USUAL = regex.compile(r"[\x00-\u017f\u0300-\u0304\u2010-\u2022]*")
#: Marks that often end a word; no contraction begins with one.
MARKS = ",.;:!?"
#: Python's and Arrow's splits also cut at these four, which are not white space for the splitter.
ODD = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """The tables of a tokenizer file: entries, merges, automaton and the memo of compatible pairs."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        named = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = [named.get(i, "") for i in range(max(named) + 1)]
        self.letters = byte_symbols()
        # Symbols: a letter, or a letter with the word end.
        self.symbols: dict[str, int] = {}
        for c in self.letters:
            for s in (c, c + self.end):
                if s in vocab:
                    self.symbols[s] = vocab[s]
        self.parts: dict[int, tuple[int, int]] = {}  # token -> the two it was merged from
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            token = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = (rank, token)
            self.parts.setdefault(token, (vocab[a], vocab[b]))
        self.rank = {token: rank for rank, token in self.merged.values()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._automaton(vocab)

    def _spell(self, token: int) -> list[int]:
        """The symbols of a token."""
        out, todo = [], [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                a, b = self.parts[t]
                todo += [b, a]
            else:
                out.append(t)
        return out

    def _automaton(self, vocab: dict[str, int]) -> None:
        """step[state][symbol] -> state; ends[state]: (token, number of symbols) of all entries that are suffixes."""
        step: list[dict[int, int]] = [{}]
        token: list[int] = [-1]
        size = [0]
        for t in {*self.symbols.values(), *self.parts}:
            state = 0
            for s in self._spell(t):
                if s not in step[state]:
                    step[state][s] = len(step)
                    step.append({})
                    token.append(-1)
                    size.append(size[state] + 1)
                state = step[state][s]
            token[state] = t
        fail = [0] * len(step)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(step)
        queue = list(step[0].values())
        for state in queue:  # breadth first, so shorter suffixes are done before longer ones
            own = ((token[state], size[state]),) if token[state] >= 0 else ()
            ends[state] = own + ends[fail[state]]
            for s, after in step[state].items():
                f = fail[state]
                while f and s not in step[f]:
                    f = fail[f]
                fail[after] = step[f].get(s, 0)
                queue.append(after)
        self.step, self.fail, self.ends = step, fail, ends

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's symbols and b's symbols in a row is a, b. Merges across the seam are undone
        from the outside in: none of them may come before the merges that made the two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = len(self.merged)
        while True:
            seam = self.merged.get((a, b))
            if seam is not None and seam[0] < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # The later merge of the two is undone first. Of merges with one rank the left comes first, so a seam
            # with a's rank comes after a, and one with b's rank before b.
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]

    def word(self, symbols: list[int]) -> list[int]:
        """The ids of a row of symbols."""
        n = len(symbols)
        last = [0] * (n + 1)
        width = [0] * (n + 1)
        state, step, fail, ends = 0, self.step, self.fail, self.ends
        for i, s in enumerate(symbols, 1):
            while state and s not in step[state]:
                state = fail[state]
            state = step[state].get(s, 0)
            for token, size in ends[state]:
                before = i - size
                if before == 0 or self.compatible(last[before], token):
                    last[i], width[i] = token, size
                    break
            else:
                raise ValueError("the vocabulary's merges are not consistent")
        out = []
        i = n
        while i:
            out.append(last[i])
            i -= width[i]
        out.reverse()
        return out

    def piece(self, letters: str) -> list[int]:
        """The ids of a piece, given in the letters that stand for its bytes."""
        names = list(letters)
        names[-1] += self.end
        symbols = [self.symbols[s] for s in names if s in self.symbols]
        return self.word(symbols) if symbols else []


class Encoder:
    """Encodes texts chunk by chunk and remembers chunks and pieces. With library, the ids of new pieces come from the
    tokenizers library's own model; else from the dynamic program here."""

    def __init__(self, path: str, cache: int = CACHE, library: bool = False) -> None:
        self.cache = cache
        self.rules = tokenizers.Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.rules.get_added_tokens_decoder().items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.plain_words = not any(t[0].isalpha() or t[0] in MARKS for t in self.special)
        self.letters = byte_symbols()
        if library:
            tokenize = self.rules.model.tokenize
            self.piece = lambda letters: [t.id for t in tokenize(letters)]
        else:
            self.vocabulary = Vocabulary(path)
            self.names = pa.array(self.vocabulary.names, pa.large_string())
            self.piece = self.vocabulary.piece
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        """The pieces of a chunk, in letters that stand for bytes."""
        if USUAL.fullmatch(text):
            names = self.letters
            return ["".join([names[b] for b in piece.encode()]) for piece in PIECES.findall(unicodedata.normalize("NFC", text).lower())]
        # For other letters the library's own normaliser and splitter rule, as versions of Unicode differ.
        rules = self.rules
        return [piece for piece, _ in rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text))]

    def _ids(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            found = self.piece(piece)
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(piece) < 64:
                if len(self.pieces) >= self.cache:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._ids, self._split(text)))

    def _chunk(self, text: str) -> bytes:
        special = self.special_pattern
        if special is None or not special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += [self._plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _known(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        if self.plain_words and word.isascii() and word.isalpha():
            # A run of letters and one of marks, which stand for themselves.
            ids = self._ids(word.lower())
            return ids if len(word) == len(chunk) else ids + self._ids(chunk[len(word) :])
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = self._chunk(chunk)
            if len(chunk) < 64:
                if len(self.chunks) >= self.cache:
                    self.chunks.clear()
                self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._known, SPACES.split(text) if ODD.search(text) else text.split()))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in a row, and where each text's ids begin, with their number at the end.
        A null has none."""
        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, ODD.pattern)).as_py():
            packed = [self.encode(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(packed), "<u4"), np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int64)
        chunks = pc.utf8_split_whitespace(texts)
        places = chunks.flatten().dictionary_encode()
        known = list(map(self._known, places.dictionary.to_pylist()))
        sizes = np.array([len(k) // 4 for k in known], np.int64)
        starts = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
        ids = pa.LargeListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(known), "<u4"))).take(places.indices).flatten().to_numpy()
        before = np.concatenate(([0], np.cumsum(sizes[places.indices.to_numpy()])))
        cuts = chunks.offsets.to_numpy()
        return ids, before[cuts - cuts[0]]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The file names no decoder, so the tokens' names are joined by spaces, special tokens included."""
        names = self.names.take(pa.array(ids))
        if ends[-1] > 1 << 31 or (pc.sum(pc.binary_length(names)).as_py() or 0) > 1 << 31:  # beyond Arrow's shorter lists
            return pa.array([" ".join(names[a:b].to_pylist()) for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.large_string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), names.cast(pa.string())), " ")


@functools.lru_cache(maxsize=4)
def encoder_of(path: str, library: bool = False) -> Encoder:
    """A worker's own encoder: its tables and what it remembers serve the tasks that the worker runs later too."""
    return Encoder(path, library=library)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs, with ids also the ids (int array), with
    decoded also the decoded text.

    path: the tokenizer file, at the same place on every machine.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * decoded

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for part in small_parts(batch, 1, rows=2000):
                found, ends = encoder.encode_all(part.column(1))
                texts = encoder.decode_all(found, ends)
                raw = memoryview(found.astype("<u4").tobytes())
                columns = [
                    part.column(0),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string()),
                    pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts.cast(pa.large_binary())], pa.string()),
                ]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype("<i4"))))
                if decoded:
                    columns.append(texts.cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)
