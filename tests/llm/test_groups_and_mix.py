"""Decontamination, near-duplicates, components, curriculum: against plain rules."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docreg.llm import curriculum, decontamination, near_dedup
from docreg.llm.components import components

DOCS = "doc_id long, text string, source string, words string, row string, n int, hit_id long, id long, bucket int"
_word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*(r if len(r) == 3 else (*r, "s")), "x", "y", 1, 2, 3, 4) for r in rows], DOCS)


# --- op2


def plain_hits(text, items):
    words = _word.findall((text or "").translate(_upper))
    hit, found = set(), set()
    for item_id, item in items:
        own = _word.findall((item or "").translate(_upper))
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[i : i + n]:
                    hit |= set(range(at, at + n))
                    found.add("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(found)


def benchmark_case(rng, short):
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "x9", "ñu"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(10, 30))) for i in range(12)] + [(3, text(15)), (None, text(11)), (50, None), (51, " .. "), (12, text(14).upper())]
    if short:
        items += [(60, "w1 w2 É"), (61, text(7)), (62, "w5")]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            words = (rng.choice(items)[1] or "").split()
            low = rng.randint(0, max(0, len(words) - 1))
            parts += [", ".join(words[low : low + rng.randint(5, 20)]), text(rng.randint(0, 12))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, " ?! "), (None, items[0][1]), (7, rows[7][1]), (8, "other text"), (103, "w1 " * 20_000 + (items[1][1]))]
    return rows, items


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, short):
    rows, items = benchmark_case(random.Random(5 + short), short)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontamination.find_contamination(docs_of(spark, rows), bench).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([key((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got]) == sorted(key((i, *plain_hits(t, items))) for i, t in rows)
    assert any(r["n_hit"] for r in got)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    digest = decontamination.contamination_digest(docs_of(spark, rows), bench).where("doc_id = 100").first()
    assert digest["items_sha256"] == hashlib.sha256(b"").hexdigest() and not digest["contaminated"]
    kept = decontamination.keep_clean(docs_of(spark, rows), bench)
    dirty = {r["doc_id"] for r in got if r["n_hit"]}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in dirty)
    assert kept.columns == docs_of(spark, rows).columns
    none = decontamination.find_contamination(docs_of(spark, rows), bench.where("false"))
    assert none.where("n_hit > 0").isEmpty() and none.count() == len(rows)
    assert decontamination.find_contamination(docs_of(spark, rows).where("false"), bench).collect() == []


def test_rows_are_kept_by_their_own_text(spark):
    dirty = " ".join(f"w{i}" for i in range(12))
    rows = [(None, f"a {dirty}"), (None, "clean one"), (None, None), (9, dirty), (9, "clean two"), (9, "clean two"), (10, dirty), (10, dirty)]
    bench = spark.createDataFrame([(1, dirty)], "item_id long, text string")
    kept = decontamination.keep_clean(docs_of(spark, rows), bench).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted((str(i), str(t)) for i, t in rows if dirty not in (t or ""))


# --- op6


def plain_groups(rows, words=3, percent=85):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        own = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        sets.setdefault(i, []).append(own)
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= percent * len(s | t):
                        low, high = sorted((root(a), root(b)))
                        parent[high] = low
    return {i: root(i) for i in parent}, sets


def copies_case(rng):
    text = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    rows, at = [], 0
    base = text(60)
    # one large group of near copies, some of which link only through others
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randint(0, len(own) - 1)] = f"n{rng.randint(0, 9)}"
        rows.append((at, " ".join(own)))
        at += 1
    # chains: each text is near the one before it, the ends are far apart
    own = text(80)
    for _ in range(25):
        rows.append((at, " ".join(own)))
        at += 1
        own = own[2:] + text(2)
    for _ in range(80):
        rows.append((at, " ".join(text(rng.randint(1, 40)))))
        at += 1
    rows += [(900, None), (901, ""), (902, " \t"), (903, ""), (904, "one two"), (905, "One Two"), (906, "one"), (None, rows[0][1]), (3, rows[3][1]), (907, "a b c " * 30_000), (908, "A b c " * 20_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,block", [(3, 85, 2048), (5, 80, 2048), (3, 85, 7)])
def test_near_duplicates(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = copies_case(random.Random(words))
    plan = near_dedup.Plan(words=words, percent=percent)
    got = near_dedup.near_duplicates(docs_of(spark, rows), plan).collect()
    want, sets = plain_groups(rows, words, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
        assert r["component_id"] == want.get(r["doc_id"])
    kept = near_dedup.keep_one(docs_of(spark, rows), plan)
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 400)}" for _ in range(60)) for _ in range(4))
    rows = [(5, a), (5, b), (2, a + " x"), (7, d), (7, d + " x"), (None, c), (None, c), (None, c + " x"), (None, d), (None, ""), (None, ""), (None, None), (8, None), (8, "")]
    kept = [near_dedup.keep_one(docs_of(spark, some), near_dedup.Plan()).collect() for some in (rows, rows[::-1])]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1]))
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in kept[0])
    [seven] = [t for i, t in got if i == "7"]
    [no_id] = [t for i, t in got if i == "None" and t.startswith(c)]
    want = [(5, b), (2, a + " x"), (7, seven), (None, no_id), (None, d), (None, ""), (None, ""), (None, None), (8, None), (8, "")]
    assert got == sorted((str(i), str(t)) for i, t in want)
    other = spark.createDataFrame([(1, a, "z"), (1, a, "k"), (1, a, "z")], "doc_id long, text string, source string")
    assert [r["source"] for r in near_dedup.keep_one(other, near_dedup.Plan()).collect()] == ["k"]


def test_an_id_with_several_texts_ties_their_groups(spark):
    rng = random.Random(6)
    t, u, v = (" ".join(f"w{rng.randint(0, 400)}" for _ in range(60)) for _ in range(3))
    rows = [(3, t), (9, t), (9, u), (10, u + " x"), (20, v), (21, v), (21, t + " y"), (21, "")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == plain_groups(rows)[0] == dict.fromkeys((3, 9, 10, 20, 21), 3)


def test_repeats_of_an_id_cost_no_pairs(spark, monkeypatch):
    t = " ".join(f"w{i}" for i in range(50))
    docs = docs_of(spark, [(1, t)] * 10_000 + [(2, t + " x")] * 10_000 + [(3, "other " + t[:100])]).repartition(20)
    links = []
    plain = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda *a: links.append(plain(*a)) or links[-1])
    found = near_dedup.near_duplicates(docs).groupBy("doc_id").agg(F.max("component_id").alias("c")).collect()
    assert {r["doc_id"]: r["c"] for r in found} == {1: 1, 2: 1, 3: 3} and [link.count() for link in links][0] == 1


def test_text_ids_and_columns_of_any_name(spark):
    rows = copies_case(random.Random(5))
    plan = near_dedup.Plan(words=5, percent=80)
    named = docs_of(spark, rows).where("doc_id is not null").withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    numbered = near_dedup.keep_one(docs_of(spark, rows), plan).where("doc_id is not null")
    clash = named.drop("key", "row").selectExpr("*", "'k' AS _key", "'s' AS _several", "1 AS key", "2 AS row", "3 AS several")
    kept = near_dedup.keep_one(clash, plan)
    assert kept.columns == clash.columns and {tuple(r) for r in kept.select("_key", "_several", "key", "row", "several").distinct().collect()} == {("k", "s", 1, 2, 3)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(f"d{r['doc_id']:05d}" for r in numbered.collect())


def test_near_duplicates_of_nothing(spark):
    none = docs_of(spark, [(1, "a")]).where("false")
    assert near_dedup.near_duplicates(none).collect() == []
    one = near_dedup.dedup_digest(docs_of(spark, [(1, None)])).first()
    assert tuple(one) == (1, 0, 1, True)


def test_members_of_mixed_buckets_are_all_compared(spark):
    """Candidates of one bucket that are linked, but not to its center."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    left, right = base[:92] + ["l"] * 8, ["r"] * 8 + base[8:]
    rows = [(0, " ".join(base[:50] * 2))] + [(1 + i, " ".join(left if i % 2 else right)) for i in range(6)] + [(20 + i, " ".join(base[:95] + [f"x{i}"] * rng.randint(1, 5))) for i in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == plain_groups(rows)[0]


def test_sketch_bound():
    for plan in (near_dedup.Plan(), near_dedup.Plan(words=5, percent=80)):
        assert (1 - (plan.percent / 100) ** plan.rows) ** plan.bands < 1e-6
        assert 2 * plan.samples * (1 - plan.percent / 100) < plan.most_apart() < plan.bits / 2


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (4, None), (300, 301)]
    parent = {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- op8


def plain_targets(sizes, weights, share=1.5, most=2):
    """Share by weight, cap, share the rest again until none is above."""
    total, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = total / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > most * sizes[s]}
        if not full:
            target |= {s: weights[s] * level for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            total -= target[s]
        open_ -= full
    return target


def mix_rows(rng):
    rows = []
    for i in range(400):
        source = "big" if i % 3 == 0 else rng.choice(["a", "b", "C", "é", "", None])
        rows.append((i, " ".join(["w"] * rng.randint(0, 30)), source))
    return rows + [(900, None, "a"), (901, "", "only empty"), (None, "x y", "b"), (5, rows[5][1], rows[5][2]), (902, " \t a\x0bb\n" * 20_000, "long")]


@pytest.mark.parametrize("slice_rows", [100_000, 10])
def test_curriculum(spark, slice_rows):
    rows = mix_rows(random.Random(6))
    plan = curriculum.plan_curriculum(docs_of(spark, rows), slice_rows=slice_rows)
    got = plan.collect()
    size = lambda t: len((t or "").encode().split())
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    want = plain_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)})
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
    for s in sources:
        assert sum(r["taken"] for r in got if r["source"] == s) == int(want[s])
    # the curriculum: up to any position, a source has the share that its weights integrate to
    order = [tuple(r) for r in curriculum.training_order(plan).collect()]
    assert [r[4] for r in order] == sorted(r[4] for r in order)
    ranks = {s: curriculum.SCHEDULES[k % 3] for k, s in enumerate(sources)}
    for s in sources:
        a, b = ranks[s]
        for t in (0.25, 0.5, 0.8):
            demand = want[s] * (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            begun = sum(r[3] for r in order if r[1] == s and r[4] < t)
            longest = max(r["size"] for r in got if r["source"] == s)
            assert abs(begun - demand) <= longest + 1, (s, t)


def test_curriculum_is_the_same_for_any_slices(spark):
    rows = mix_rows(random.Random(7))
    plans = [sorted(map(str, curriculum.plan_curriculum(docs_of(spark, rows), slice_rows=n).collect())) for n in (100_000, 10)]
    assert plans[0] == plans[1]


def test_curriculum_of_nothing(spark):
    docs = docs_of(spark, [(1, None, None), (2, "", "a")])
    assert [(r["size"], r["target"], r["taken"]) for r in curriculum.mix_digest(docs).collect()] == [(0, 0.0, 0)] * 2
    assert curriculum.mix_digest(docs.where("false")).collect() == []


def test_the_pipeline_mix_holds_every_copy(spark):
    import corpus_pipeline

    docs = docs_of(spark, mix_rows(random.Random(8)))
    mix = corpus_pipeline.mixed_documents(spark, docs, "").collect()
    copies = sorted((c["position"], str(r["doc_id"]), at, c["words"]) for r in mix for at, c in enumerate(r["copies"]))
    order = curriculum.training_order(curriculum.plan_curriculum(docs)).collect()
    assert copies == sorted((r["position"], str(r["doc_id"]), r["copy"], r["words"]) for r in order)
    assert any(at for _, _, at, _ in copies)


def test_size_counts_ascii_white_space_only(spark):
    rows = [(1, "a b c d\x1ce", "s"), (2, "  a  ", "s"), (3, "\x0b\x0c", "s")]
    got = {r["doc_id"]: r["size"] for r in curriculum.plan_curriculum(docs_of(spark, rows)).collect()}
    assert got == {1: 2, 2: 1, 3: 0}
