"""BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary are compiled one after another into a deterministic
automaton whose arcs are tokens and which accepts exactly the token sequences that
BPE makes of some word. It starts as one state with an arc of every byte back to
itself. The gadget of a merge (u, v) gives u a new state, a copy of the one its arcs
led to without the arc v; every state with an arc u gets an arc uv, to where v led.
Copies are not written out: a state is the chain of the gadgets it came through, and
an arc is there unless one of them took it or the arc it was copied from.

Words are then encoded byte by byte. A state of the byte table holds, for every
place where a token may have begun, the automaton's state there and the bytes since.
Of the arcs that can end at a byte exactly one exists, so each transition of the
table names the next state and the last token of the word up to here; the tokens are
read off backwards by their lengths. Transitions are worked out when a text first
needs them and are looked up from then on. Decoding emits the labels of the arcs.

A worker holds the automaton, at most twice ``TRANSITIONS`` transitions and twice
``WORDS`` encoded words; beyond that it starts its tables anew, which changes
no result.

Defined results: a null text is the empty text, without tokens; the strings of added
tokens are those tokens, as in the file; bytes that form no text decode to U+FFFD;
ids that the vocabulary lacks decode to nothing; rows with equal or null ids are
encoded each for itself; other columns are not read; an empty table gives no rows.
Texts are encoded whole, in runs of at most ``RUN`` words."""

from __future__ import annotations

import codecs
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how byte-level BPE cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TRANSITIONS = 300_000
WORDS = 200_000
RUN = 65_536
_NEVER = 1 << 60
#: Bits for a token or a node of the tree of labels.
_TOKEN = 24
_NODE = (1 << _TOKEN) - 1


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes
    stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tokens as arcs. ``labels`` are their bytes; ``merges`` are pairs of tokens with
    the token they make, in order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self._rank: dict[tuple[int, int], int] = {}
        self._made: dict[int, tuple[int, int, int]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self.state = {t: 0 for t, label in labels.items() if len(label) == 1}
        self.owner = {}
        self.states = 1
        for rank, (u, v, both) in enumerate(merges):
            if u not in self.state or v not in self.state or not self._follow(u, v):
                continue  # no word has the two side by side, so nothing is merged
            # arcs uv lead to where v led; u gets a copy of its state without the arc v
            self.state[both] = self.state[v]
            self.state[u] = self.states
            self.states += 1
            self._rank[u, v] = rank
            self._made[both] = (rank, u, v)
        for token, state in self.state.items():
            self.owner.setdefault(state, token)
        # the tree of labels, by node and byte
        self._down: dict[int, int] = {}
        self._token = [-1]
        for token in self.state:
            node = 0
            for byte in labels[token]:
                key = node << 8 | byte
                node = self._down.setdefault(key, len(self._token))
                if node == len(self._token):
                    self._token.append(-1)
            self._token[node] = token
        self._sizes = {t: len(labels[t]) for t in self.state}
        self._clear()

    def _clear(self) -> None:
        self._arcs: dict[int, bool] = {}
        #: states of the byte table: pairs of a state and a node, each as one number
        self._ids = {(0,): 0}
        self._places: list[tuple[int, ...]] = [(0,)]
        #: by state and byte: the next state and the last token, as one number
        self._steps: dict[int, int] = {}

    def _lineage(self, token: int, side: int, known: dict) -> list[tuple[int, int]]:
        """The tokens a copied state (side 2) or arc (side 1) came from, each with the
        rank of the merge that copied it."""
        found = known.get(token)
        if found is None:
            found, at, limit = [(token, _NEVER)], token, _NEVER
            while at in self._made:
                limit, at = self._made[at][0], self._made[at][side]
                found.append((at, limit))
            known[token] = found
        return found

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc of the token."""
        if state == 0:
            return True
        key = state << _TOKEN | token
        found = self._arcs.get(key)
        if found is None:
            found = self._arcs[key] = self._follow(self.owner[state], token)
        return found

    def _follow(self, u: int, token: int) -> bool:
        """Whether the state that arcs u lead to has an arc of the token."""
        rank, ends = self._rank, self._lineage(token, 1, self._left)
        for a, copied in self._lineage(u, 2, self._right):
            for b, grown in ends:
                taken = rank.get((a, b))
                if taken is not None and taken < copied and taken <= grown:
                    return False
        return True

    def accepts(self, tokens: list[int]) -> bool:
        """Whether the tokens are what BPE makes of their bytes as one word."""
        state = 0
        for token in tokens:
            if token not in self.state or not self.arc(state, token):
                return False
            state = self.state[token]
        return True

    def _step(self, at: int, byte: int) -> int:
        """The transition of the byte table, worked out once."""
        last, open_, down, tokens = -1, [], self._down, self._token
        for place in self._places[at]:
            below = down.get((place & _NODE) << 8 | byte)
            if below is None:
                continue
            open_.append(place >> _TOKEN << _TOKEN | below)
            token = tokens[below]
            if token >= 0 and last < 0 and self.arc(place >> _TOKEN, token):
                last = token
        open_.append(self.state[last] << _TOKEN)
        key = tuple(open_)
        to = self._ids.setdefault(key, len(self._places))
        if to == len(self._places):
            self._places.append(key)
        found = self._steps[at << 8 | byte] = to << _TOKEN | last
        return found

    def encode(self, word: bytes) -> list[int]:
        if len(self._steps) > TRANSITIONS:
            self._clear()
        at, ends, step = 0, [], self._steps.get
        for byte in word:
            found = step(at << 8 | byte)
            if found is None:
                found = self._step(at, byte)
                if len(self._steps) > 2 * TRANSITIONS:  # within one very long word
                    here = self._places[found >> _TOKEN]
                    self._clear()
                    step = self._steps.get
                    found = self._ids.setdefault(here, 1) << _TOKEN | found & _NODE
                    self._places += [here][: found >> _TOKEN]
            ends.append(found & _NODE)
            at = found >> _TOKEN
        tokens, i, sizes = [], len(ends), self._sizes
        while i:
            token = ends[i - 1]
            tokens.append(token)
            i -= sizes[token]
        tokens.reverse()
        return tokens


@lru_cache(maxsize=1)
def _unsettled() -> re.Pattern:
    """Characters that the tables of this Python do not know yet."""
    new = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    ranges = [[c, c] for c in new[:1]]
    for c in new[1:]:
        if c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


_CUT = regex.compile(PATTERN)
# The same cut for texts of Latin letters alone, which plain classes tell apart faster.
_L, _N, _W = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_beyond_latin = re.compile("[^\x00-ɏ]").search


class Tokenizer:
    """A byte-level vocabulary file: its automaton, its added tokens, its words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec["normalizer"]:
            raise ValueError("only plain BPE vocabularies can be compiled")
        if cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True):
            raise ValueError("only byte-level vocabularies without a prefix space can be compiled")
        letters = _byte_letters()
        ids = model["vocab"]
        labels = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.automaton = Automaton(labels, [(ids[u], ids[v], ids[u + v]) for u, v in pairs])
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take their neighbourhood are not supported")
        self._added = {t["content"]: (str(t["id"]), 1, t["content"].encode()) for t in added}
        self.labels = labels | {t["id"]: t["content"].encode() for t in added}
        longest = sorted(self._added, key=len, reverse=True)
        self._cut_added = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self._path = path
        self._library = None
        self._new, self._old = dict(self._added), {}

    def _pieces(self, text: str) -> Iterator[str]:
        if self._cut_added is None:
            yield text
            return
        at = 0
        for found in self._cut_added.finditer(text):
            yield text[at : found.start()]
            yield found.group()
            at = found.end()
        yield text[at:]

    def _cut_off(self, piece: str) -> list[str] | Iterator[str]:
        """The words of a piece without added tokens. Tables of letters differ in the
        characters that Unicode took in last; pieces that hold such are cut by the
        library that reads the file."""
        if _beyond_latin(piece) is None:
            return _LATIN.findall(piece) if len(piece) <= RUN else (m.group() for m in _LATIN.finditer(piece))
        if _unsettled().search(piece) is None:
            return (m.group() for m in _CUT.finditer(piece))
        if self._library is None:
            from tokenizers import Tokenizer as Library

            self._library = Library.from_file(self._path).pre_tokenizer
        return (piece[a:b] for _, (a, b) in self._library.pre_tokenize_str(piece))

    def runs(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in lists of at most ``RUN``."""
        for piece in self._pieces(text):
            if piece in self._added:
                yield [piece]
                continue
            words = self._cut_off(piece)
            if isinstance(words, list):
                yield words
                continue
            while run := list(islice(words, RUN)):
                yield run

    def _word(self, word: str) -> tuple[str, int, bytes]:
        entry = self._old.get(word)
        if entry is None:
            ids = self.automaton.encode(word.encode("utf-8"))
            entry = (",".join(map(str, ids)), len(ids), self.emit(ids))
        if len(self._new) >= WORDS:
            self._old, self._new = self._new, dict(self._added)
        self._new[word] = entry
        return entry

    def coded(self, text: str | None) -> Iterator[list[tuple[str, int, bytes]]]:
        """Per run and word: its ids as text, their number, their labels."""
        for run in self.runs(text or ""):
            known = self._new.get
            yield [known(word) or self._word(word) for word in run]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for run in self.coded(text) for word in run for i in word[0].split(",")]

    def emit(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after another."""
        return b"".join([self.labels.get(i, b"") for i in ids])

    def decode(self, ids: list[int] | None) -> str:
        return self.emit(ids or []).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The compiled vocabulary, once for each worker."""
    return Tokenizer(path)


def _kind(docs: DataFrame, column: str = "doc_id") -> str:
    return docs.schema[column].dataType.simpleString()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document. ``vocabulary`` is a file that is installed at
    the same place on every machine."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = pa.array([own.encode(one.column("text")[0].as_py())], pa.list_(pa.int32()))
                yield pa.record_batch([one.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {_kind(docs)}, ids array<int>")


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            texts = [own.decode(ids.as_py()) for ids in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(rows, f"doc_id {_kind(coded)}, text string")


def _digest(own: Tokenizer, text: str | None) -> tuple[int, str, str]:
    ids, decoded = sha256(), sha256()
    back = codecs.getincrementaldecoder("utf-8")("replace")
    n = 0
    for run in own.coded(text):
        if not run:
            continue
        numbers, sizes, labels = zip(*run)
        ids.update((("," if n else "") + ",".join(numbers)).encode())
        decoded.update(back.decode(b"".join(labels)).encode())
        n += sum(sizes)
    decoded.update(back.decode(b"", True).encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def round_trip_digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text is encoded and its
    ids decoded, of both only digests are kept."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            found = [_digest(own, text.as_py()) for text in batch.column("text")]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
