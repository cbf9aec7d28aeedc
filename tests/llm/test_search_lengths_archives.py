"""Exact search, length histogram, archives."""

import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docreg.llm import length_histogram, topk_search, warc

# --- op9


def plain_top(rows, k=20, scale=64):
    ok = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for at, (q, a) in enumerate(ok):
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for other, (i, b) in enumerate(ok) if other != at)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(16_384, 4_096), (3, 17)])
def test_top_k(spark, blocks):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        kind = i % 4
        if kind == 0:
            v = [rng.uniform(-1, 1) for _ in range(12)]
        elif kind == 1:
            v = [rng.choice([0.0, 0.0, 0.5, -0.25]) for _ in range(12)]  # ties and sparse terms
        elif kind == 2:
            v = [0.0, 0.0, 0.0, 1.0] + [0.0] * 8
        else:
            v = [rng.uniform(-1e4, 1e4) for _ in range(rng.randint(0, 14))]  # other lengths
        rows.append((i, v))
    rows += [(200, None), (220, [None] * 12), (240, [float("nan")] * 12), (201, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (260, []), (20, rows[20][1]), (21, rows[22][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, w int, rank int")
    got = topk_search.top_k(df, query_block=blocks[0], candidate_block=blocks[1])
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(rows)
    assert topk_search.top_k(df.where("false")).collect() == []
    assert topk_search.top_k(df.where("vec_id = 40")).collect() == []


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_search.top_k(df).collect())) == [(0, 1, 1, 8192), (0, 2, 2, 8192)]


@pytest.mark.parametrize("blocks", [(16_384, 4_096), (2, 3)])
def test_every_row_of_a_repeated_id_is_a_candidate(spark, blocks):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (20, [3.0, 1.0]), (20, [3.0, 1.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, topk_search.top_k(df, query_block=blocks[0], candidate_block=blocks[1]).collect()))
    assert got == plain_top(rows) and (0, 3, 1, 8192) in got


# --- op7


def test_lengths(spark):
    encoding = length_histogram._encoding(length_histogram.VOCABULARY, length_histogram.PATTERN)
    rng = random.Random(2)
    texts = [None, "", " ", "<|endoftext|>", "It's 12,000 é\n\n x"] + [" ".join(rng.choices(["the", "Haus", "été", "x9", "..."], k=rng.randint(1, 60))) for _ in range(80)] + ["word " * 9_000]
    texts += texts[-3:]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
    lengths = length_histogram.token_lengths(docs)
    assert {r["doc_id"]: r["n_tokens"] for r in lengths.collect()} == dict(enumerate(sizes))
    histogram = length_histogram.length_histogram(lengths)
    rows = histogram.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(sizes))
    for r in rows:
        n = r["n_tokens"]
        assert r["n_docs"] == sizes.count(n) and r["tokens"] == n * sizes.count(n)
        assert r["docs_from"] == sum(s >= n for s in sizes) and r["tokens_from"] == sum(s for s in sizes if s >= n)
        assert r["kept_at_limit"] == sum(min(s, n) for s in sizes) and r["lost_at_limit"] == sum(max(0, s - n) for s in sizes)
        assert r["docs_up_to"] == sum(s <= n for s in sizes) and (r["all_docs"], r["all_tokens"]) == (len(sizes), sum(sizes))
    limits = [0, 1, 7, 33, 4096, 100_000]
    for r in length_histogram.kept_at(histogram, limits).collect():
        n = r["max_tokens"]
        assert (r["docs_from"], r["kept"], r["lost"]) == (sum(s >= n for s in sizes), sum(min(s, n) for s in sizes), sum(max(0, s - n) for s in sizes))
    for q in (0.1, 0.5, 0.99, 1.0):
        assert histogram.agg(length_histogram.quantile(histogram, q).alias("q")).first()["q"] == sorted(sizes)[math.ceil(q * len(sizes)) - 1]
    assert length_histogram.length_histogram(length_histogram.token_lengths(docs.where("false"))).collect() == []


# --- op10


def page_rows():
    long = "<p>" + "é" * 120 + "</p>"
    return [
        (1, "http://a", long), (7, "http://b", long), (3, "http://c\r\nX: 1", long), (4, None, "short"), (5, "http://e", "short"), (6, "http://f", None),
        (8, "http://g", ""), (9, "http://h", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5), (10, "u", "x" * 99), (11, "u", "x" * 99),
        (12, "u", "y" * 100), (13, "u", "y" * 100), (None, "n", "z" * 200), (14, "n", "z" * 200), (15, "r", "q" * 150), (15, "r", "q" * 150), (16, "big", "w " * 300_000), (None, "m", "only null id" * 20),
    ]


def test_archives(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    first = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and i is not None:
            first[payload] = min(i, first.get(payload, i))
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        other = first.get(payload)
        again = other is not None and other != i
        want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", other if again else None))
    assert sorted(map(str, (tuple(r) for r in warc.archive_digest(pages).collect()))) == sorted(map(str, want))
    path = warc.write_archives(pages, archive_bytes=2_000)
    read = warc.read_archives(spark, path).collect()
    assert {r["kind"] for r in read} == {"record"}
    payloads = sorted(((r["page_id"] or ""), bytes(r["payload"])) for r in read if r["record_type"] == "response")
    assert payloads == sorted((str(w[0] or ""), (r[2] or "").encode()) for r, w in zip(rows, want) if w[3] == "response")
    assert {r["url"] for r in read if r["page_id"] == "3"} == {"http%3A%2F%2Fc%0D%0AX%3A+1"} and {r["url"] for r in read if r["page_id"] == "4"} == {None}
    assert warc.archive_digest(pages.where("false")).collect() == []


def test_long_addresses_keep_their_rows(spark):
    urls = {1: "data:text/html," + "a" * 100_000, 2: "http://x/ " + "é" * 30_000, 3: "http://x/WARC/1.1"}
    pages = spark.createDataFrame([(i, url, f"page {i}") for i, url in urls.items()], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.archive_digest(pages).collect()) == [1, 2, 3]
    read = {r["page_id"]: r["url"] for r in warc.read_archives(spark, warc.write_archives(pages)).collect()}
    assert read == {"1": urls[1], "2": "http%3A%2F%2Fx%2F+" + "%C3%A9" * 30_000, "3": urls[3]}


def record(page, payload):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def pages_of(walk):
    return [f["warc-record-id"][10:-1] for kind, _, _, f in walk if kind == "record"]


def gaps_of(walk):
    return [(start, end) for kind, start, end, _ in walk if kind == "gap"]


def test_salvage_plain():
    parts = [record(i, f"payload {i} ".encode() * 20) for i in range(6)]
    whole = b"".join(parts)
    assert pages_of(warc.salvage(whole)) == list("012345") and gaps_of(warc.salvage(whole)) == []
    at = [sum(map(len, parts[:i])) for i in range(7)]
    torn = bytearray(whole)
    torn[at[2] - 60] ^= 1  # a payload byte of record 1
    torn[at[4] + 3] = 0  # the version line of record 4
    walk = list(warc.salvage(bytes(torn)))
    assert pages_of(walk) == list("0235") and gaps_of(walk) == [(at[1], at[2]), (at[4], at[5])]
    missing = whole[: at[1] + 40] + whole[at[2] - 20 :]
    assert pages_of(warc.salvage(missing)) == list("02345")
    assert pages_of(warc.salvage(b"junk" + whole[:-9])) == list("01234")
    walk = list(warc.salvage(whole[:-9]))
    assert gaps_of(walk) == [(at[5], at[6] - 9)]
    assert list(warc.salvage(b"")) == [] and gaps_of(warc.salvage(b"nothing")) == [(0, 7)]
    big = record(0, b"a").replace(b"Content-Length: 1\r", b"Content-Length: 99999999999\r")
    assert pages_of(warc.salvage(big + parts[1])) == ["1"]


def test_salvage_members():
    parts = [gzip.compress(record(i, f"payload {i} ".encode() * 30)) for i in range(5)]
    at = [sum(map(len, parts[:i])) for i in range(6)]
    whole = b"".join(parts)
    assert pages_of(warc.salvage(whole)) == list("01234")
    torn = bytearray(whole)
    torn[at[1] + 30] ^= 255
    torn[at[3] : at[3] + 2] = b"\0\0"
    walk = list(warc.salvage(bytes(torn)))
    assert pages_of(walk) == list("024") and gaps_of(walk) == [(at[1], at[2]), (at[3], at[4])]
    mixed = record(9, b"plain") + gzip.compress(record(7, b"a") + record(8, b"b")) + record(6, b"c")
    assert pages_of(warc.salvage(mixed)) == list("9786")
    assert pages_of(warc.salvage(whole[:-4])) == list("0123")


def test_salvage_inside_members():
    parts = [record(i, random.Random(i).randbytes(3_000)) for i in range(40)]
    at = [sum(map(len, parts[:i])) for i in range(41)]
    torn = bytearray(b"".join(parts))
    torn[at[3] - 60] ^= 1  # a payload byte of record 2
    torn[at[7] + 3] = 0  # the version line of record 7
    member = gzip.compress(bytes(torn))
    found = list(warc.walk(record("a", b"a") + member + record("b", b"b")))
    assert pages_of(f[:4] for f in found) == ["a", *[str(i) for i in range(40) if i not in (2, 7)], "b"]
    assert [f[4:] for f in found if f[0] == "gap"] == [(at[2], at[3]), (at[7], at[8])]
    ends = (len(record("a", b"a")), len(record("a", b"a")) + len(member))
    assert {f[1:3] for f in found if f[4] is not None} == {ends}


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_of_members_that_break(level):
    parts = [record(i, random.Random(i).randbytes(3_000)) for i in range(40)]
    at = [sum(map(len, parts[:i])) for i in range(41)]
    whole = gzip.compress(b"".join(parts), level)
    for after, more in ((b"", []), (record("b", b"b"), ["b"]), (gzip.compress(record("c", b"c")), ["c"])):
        # the tail is gone: in the middle of a record, or only of the member's checks
        half = list(warc.walk(whole[: len(whole) // 2] + after))
        n = len(pages_of(f[:4] for f in half)) - len(more)
        assert 18 <= n <= 20 and pages_of(f[:4] for f in half) == [*map(str, range(n)), *more]
        if level:  # what follows a cut stored block is unpacked with it
            [gap] = [f for f in half if f[0] == "gap"]
            assert gap[1:3] == (0, len(whole) // 2) and gap[4:] == (at[n], None)
        assert pages_of(warc.salvage(whole[:-4] + after)) == [*map(str, range(40)), *more]
        # checks that do not fit: every record is judged by its own
        wrong = bytearray(whole)
        wrong[-6] ^= 1
        assert pages_of(warc.salvage(bytes(wrong) + after)) == [*map(str, range(40)), *more]
    # a block that does not unpack
    packer = zlib.compressobj(level, wbits=31)
    begun = packer.compress(b"".join(parts[:9])) + packer.flush(zlib.Z_FULL_FLUSH)
    assert pages_of(warc.salvage(begun + b"\xff" * 50 + record("b", b"b"))) == [*map(str, range(9)), "b"]


def test_every_cut_keeps_the_other_records():
    parts = [record(i, bytes([65 + i]) * 30) for i in range(3)]
    whole = b"".join(parts)
    at = [sum(map(len, parts[:i])) for i in range(4)]
    for place in range(len(whole)):
        torn = bytearray(whole)
        torn[place] ^= 0x80
        hit = max(i for i in range(3) if at[i] <= place)
        walk = list(warc.salvage(bytes(torn)))
        assert [p for p in pages_of(walk) if p != str(hit)][:2] and set("012") - set(pages_of(walk)) <= {str(hit)}, place
        covered = sorted((start, end) for _, start, end, _ in walk)
        assert covered[0][0] == 0 and covered[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_damaged_files_are_read_around(spark, tmp_path):
    parts = [record(i, f"payload {i} ".encode() * 20) for i in range(8)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts[:4])[:-30] + parts[4])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[5:7]) + b"tail")
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path))
    assert sorted(r["page_id"] for r in got.where("kind = 'record'").collect()) == list("012456")
    gaps = got.where("kind = 'gap'").select((F.col("end") - F.col("start")).alias("n"), "reason").collect()
    assert sorted(g["n"] for g in gaps) == sorted([len(parts[3]) - 30, 4]) and all(g["reason"] for g in gaps)


def test_every_record_has_its_mandatory_fields(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(1, "http://a/", big), (2, "http://b/", big), (2, "http://b/", big), (3, None, "small"), (3, None, "small"), (None, "http://c/", big), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages.repartition(3), str(tmp_path / "w"))
    seen = []
    for file in sorted((tmp_path / "w").glob("part-*")):
        data = file.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            assert version == "WARC/1.1" and len(fields) == len(lines)
            assert re.fullmatch(r"<urn:[^\s<>]+>", fields["WARC-Record-ID"]) and fields["WARC-Type"] in ("response", "revisit")
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and fields["Content-Length"].isdigit()
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To"] == "<urn:page:1>" and fields["Content-Length"] == "0"
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
            seen.append(fields["WARC-Record-ID"])
    assert len(seen) == len(set(seen)) == len(rows) and "<urn:page:1>" in seen
    back = warc.read_archives(spark, path).where("kind = 'record'")
    assert sorted(str(r["page_id"]) for r in back.collect()) == sorted(str(r[0]) for r in rows)


def test_lengths_are_encoded_once(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a")], "doc_id long, text string")
    plan = length_histogram.length_histogram(length_histogram.token_lengths(docs))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
