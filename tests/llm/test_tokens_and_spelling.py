"""The tokenization automaton against the library, spelling variants against plain rules."""

import os
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from docreg.llm import bpe_automaton as b, spelling as sp

tokens = pytest.mark.skipif(not os.path.exists(b.VOCABULARY), reason="no vocabulary files")
DOC = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(b.VOCABULARY)


def some_texts(n=2500):
    rng = random.Random(3)
    anything = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    parts = ["a", "aa", " ", "  ", "\n", "\t", "'s", "'ll", "'", "<|endoftext|>", "1", "0", "é", "ß", "...", "\x85", "\xa0", "\x1c", " ", "ɏ", "ɐ", "\U0003d001", "-", "²"]
    letters = "aehtinr " * 3 + "bcdfgklmosuwyz"
    yield from ("", " ", "\n \n", "<|endoftext|>", "a" * 300, "the " * 50, "e" * 7 + " " + "ab" * 40)
    for k in range(n):
        size = rng.randint(1, 60)
        yield "".join(rng.choice((letters, anything, parts)[k % 3]) for _ in range(size))


@tokens
def test_encodes_and_decodes_as_the_library(library):
    own = b.tokenizer(b.VOCABULARY)
    for text in some_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@tokens
def test_every_character_of_the_fast_cut(library):
    own = b.tokenizer(b.VOCABULARY)
    for c in range(0x250):
        text = f"a{chr(c)}1{chr(c)}-{chr(c)} {chr(c)}b {chr(c) * 2}. \t{chr(c)}"
        assert [w for run in own.runs(text) for w in run] == [text[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(text)]


@tokens
def test_decodes_any_ids(library):
    own, rng = b.tokenizer(b.VOCABULARY), random.Random(5)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@tokens
def test_the_automaton_accepts_just_what_is_encoded():
    own, rng = b.tokenizer(b.VOCABULARY), random.Random(7)
    for _ in range(2000):
        word = "".join(rng.choice("aehtinr") for _ in range(rng.randint(1, 12))).encode()
        ids = own.automaton.encode(word)
        assert own.automaton.accepts(ids) and own.emit(ids) == word
        other = [i for byte in word for i in own.automaton.encode(bytes([byte]))]
        assert own.automaton.accepts(other) == (other == ids)


def plain_bpe(word, merges):
    parts = [bytes([c]) for c in word]
    while True:
        ranks = [(merges.get((x, y), 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))]
        if not ranks or min(ranks)[0] == 1 << 30:
            return parts
        rank = min(ranks)[0]
        out, i = [], 0
        while i < len(parts):
            both = i + 1 < len(parts) and merges.get((parts[i], parts[i + 1])) == rank
            out.append(parts[i] + parts[i + 1] if both else parts[i])
            i += 2 if both else 1
        parts = out


def test_random_merges_and_full_tables(monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(b, "TRANSITIONS", 12)
    for _ in range(60):
        known = [b"a", b"b", b"c"]
        merges = {}
        for _ in range(rng.randint(1, 14)):
            x, y = rng.choice(known), rng.choice(known)
            # also pairs that no word has side by side, and second ways to one token
            merges.setdefault((x, y), len(merges))
            known += [x + y][: x + y not in known]
        ids = {label: i for i, label in enumerate(known)}
        auto = b.Automaton(dict(enumerate(known)), [(ids[x], ids[y], ids[x + y]) for x, y in merges])
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25)))
            assert [known[i] for i in auto.encode(word)] == plain_bpe(word, merges), (merges, word)


@tokens
def test_digest_of_odd_rows(spark, library):
    long = "Über den Fluß, " * 40_000
    rows = [(1, "The same text.", "x"), (1, "The same text.", "x"), (None, None, None), (2, "", "y"), (3, long, "z")]
    docs = spark.createDataFrame(rows, DOC).withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1))
    got = sorted(map(tuple, b.round_trip_digest(docs).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert b.round_trip_digest(docs.limit(0)).count() == 0
    back = b.decode(b.encode(docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one_apart(x, y):
        if len(x) > len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y)) == 1
        return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("alphabet, size", [("ab", 7), ("aab", 12), ("abcé", 6), ("aÀÿbcdefgh", 9)])
def test_variants_of_random_words(spark, alphabet, size):
    rng = random.Random(size)
    rows = []
    for i in range(25):
        base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, size))) for _ in range(12)]
        words = []
        for w in base:
            words += [w] * rng.choice((5, 5, 30))
            at = rng.randrange(len(w))
            words += [w[:at] + rng.choice(["", rng.choice(alphabet), w[at] + rng.choice(alphabet)]) + w[at + 1 :]] * rng.choice((1, 5, 6, 200))
        rng.shuffle(words)
        rows.append((i if i % 7 else None, " ".join(w.upper() if k % 9 == 0 and w.isascii() else w for k, w in enumerate(words))))
    got = sp.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == plain_variants(rows)


def test_chains_of_forms_ties_and_odd_rows(spark):
    chain = [("abcdef", 5), ("abcdeg", 25), ("abcdhg", 125), ("abkdhg", 625), ("zzzzzz", 5), ("zzzzzza", 25), ("zzzzzzb", 25), ("y" * 5000, 5), ("y" * 5001, 25)]
    rows = [(None, None, 1), (1, "", 1), (2, "123 ab", 1), *[(k, " ".join([w] * n), 1) for k, (w, n) in enumerate(chain)]]
    rows += [rows[2], (77, "×÷×÷×÷ " * 6, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {tuple(r) for r in sp.spelling_variants(docs).collect()}
    assert got == plain_variants([r[:2] for r in rows])
    found = {r[0]: r for r in got}
    assert found["zzzzzz"][1] == "zzzzzza" and found["abcdef"][1:3] == ("abcdeg", "abkdhg")
    assert sp.spelling_variants(docs.limit(0)).count() == 0


def test_counting_hands_on_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abcdefg " * 9 + "hijklmn " * 9)], "doc_id long, text string").repartition(1)
    found = sp.counted_words(docs).groupBy("word").agg(F.sum("n").alias("n"))
    assert {(r.word, r.n) for r in found.collect()} == {("abcdefg", 9), ("hijklmn", 9)}
