"""Page operators: against recursive SQL on random pages, by hand, and by properties."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docreg.operators import labels, lines, words as w
from docreg.plans.labelled_fields import LabelSpecs, extract_labelled
from sql_rules import KEPT, LINES, solve

VOCABULARY = ["Republic", "First", "name", "Father", "her", "Nationality", "ANCHORLAND", "Place", "of", "birth", "ace",
              "Authority", "GIVEN", "PARENT", "TOWN", "EL", "12/03/2020", "26:07", "Fa", "ther", "noise", "SU"]


def random_rows(seed, pages, size, heights, step=1, width=600, depth=300):
    rng = random.Random(seed)
    rows = []
    for doc in range(pages):
        for _ in range(rng.randint(1, size)):
            text, height = rng.choice(VOCABULARY), rng.choice(heights)
            x, y = rng.randrange(0, width, 20), rng.randrange(0, depth, step)
            rows.append((doc, text, rng.choice([0.5, 0.7, 0.8, 0.9]), x, y, x + 10 * len(text), y + height))
    return rows


@pytest.mark.parametrize("heights", [[12], [8, 12, 16], [2, 9, 30, 60]])
def test_lines_equal_the_first_fit_rule(words_of, heights):
    rows = random_rows(1, 80, 30, heights)
    got = {r.word_no: r.line_no for r in lines.group_lines(words_of(rows)).collect()}
    assert got == dict(solve(rows, LINES))


@pytest.mark.parametrize("most", [0, 7])
def test_folded_and_streamed_blocks_are_alike(words_of, monkeypatch, most):
    monkeypatch.setattr(lines, "BLOCK_WORDS", most)
    rng = random.Random(most)
    rows = [(d, f"w{k}", 0.9, k, y := rng.randint(0, 60), k + 5, y + rng.randint(-2, 25)) for d in range(12) for k in range(20)]
    rows += [(50, "w", 0.9, 0, 0, 5, 10)] * 9
    got = {r.word_no: r.line_no for r in lines.group_lines(words_of(rows)).collect()}
    assert got == dict(solve(rows, LINES))


@pytest.mark.parametrize("most", [0, 7, 4096])
def test_lines_of_dealt_pages_move_no_words(spark, words_of, monkeypatch, most):
    monkeypatch.setattr(lines, "BLOCK_WORDS", most)
    rows = random_rows(3, 40, 40, [8, 12, 30]) + random_rows(4, 40, 40, [2, 9, 30, 60])
    words = words_of(rows).repartition(3, "doc_id")
    dealt = lines.group_lines(words, dealt=True)
    assert {r.word_no: r.line_no for r in dealt.collect()} == dict(solve(rows, LINES))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dealt.select("doc_id", "word_no", "line_no")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]
    # only those of long blocks, by block
    assert len(moves) == 1 and "_block" in moves[0] and "Join" not in plan


def test_lines_do_not_depend_on_row_order(words_of):
    words = words_of(random_rows(11, 40, 40, [8, 12, 30]))
    run = lambda df: sorted((r.word_no, r.line_no) for r in lines.group_lines(df).collect())
    assert run(words) == run(words.orderBy(F.desc("word_no")).repartition(5))


def test_words_of_one_height_band(words_of):
    """Worked out by hand. Slack is 4 pixels below a line."""
    rows = [
        (1, "a", 0.9, 0, 0, 10, 12),  # line 0, bottom 12
        (1, "b", 0.9, 20, 9, 30, 21),  # middle 15: 12 + 4 reaches it, line 0, bottom 21
        (1, "c", 0.9, 40, 20, 50, 32),  # middle 26 > 25: line 1
        (1, "d", 0.9, 60, 20, 70, 28),  # middle 24: line 0 again
    ]
    assert sorted((r.text, r.line_no) for r in lines.group_lines(words_of(rows)).collect()) == [("a", 0), ("b", 0), ("c", 1), ("d", 0)]


def double_rows(seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(60):
        x = 0
        for _ in range(rng.randint(1, 25)):
            x += rng.choice([0, 1, 4, 9, 15, 60])
            y = rng.choice([0, 0, 2, 5, 40])
            rows.append((doc, "w", rng.choice([0.5, 0.7, 0.7, 0.9]), x, y, x + rng.choice([0, 30, 40]), y + 14))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_dedupe_equals_greedy_suppression(words_of, seed):
    rows = double_rows(seed)
    assert {r.word_no for r in w.dedupe_overlaps(words_of(rows)).collect()} == {n for n, in solve(rows, KEPT)}


def iou(a, b):
    wide, high = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    both = max(wide, 0) * max(high, 0)
    return both / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - both) if both else 0


def test_kept_boxes_stand_apart_and_dropped_ones_do_not(words_of):
    """Properties: no two kept boxes overlap by half, and every dropped box does
    with a better one that is kept."""
    rows = double_rows(5)
    kept = {r.word_no for r in w.dedupe_overlaps(words_of(rows)).collect()}
    for doc in range(60):
        own = [(n, r) for n, r in enumerate(rows) if r[0] == doc]
        for n, r in own:
            rivals = [m for m, o in own if m in kept and m != n and iou(r, o) >= 0.5]
            if n in kept:
                assert not rivals
            else:
                assert any((-rows[m][2], m) < (-r[2], n) for m in rivals)


def test_long_chain_is_decided_in_one_pass(words_of):
    """Each box overlaps only the next weaker one: every second box stays."""
    rows = [(1, "w", 0.9 - i / 100, i * 10, 0, i * 10 + 40, 14) for i in range(12)]
    assert sorted(r.word_no for r in w.dedupe_overlaps(words_of(rows)).collect()) == [0, 2, 4, 6, 8, 10]


def test_boxes_of_any_size_meet_few_cells(spark):
    """A box as large as the page, and one pixel: the rows of the join are bounded."""
    boxes = spark.createDataFrame([(1, 0, 0, 0, 100_000, 100_000), (1, 1, 1, 1, 99_000, 99_999), (1, 2, 5, 5, 6, 6)], "doc_id long, rank int, x0 int, y0 int, x1 int, y1 int")
    spread = w._cells(w._cells(boxes, "x0", "x1", "x", True), "y0", "y1", "y", True)
    assert max(r["count"] for r in spread.groupBy("rank").count().collect()) <= 16
    assert [(r.better, r.worse) for r in w.overlapping_pairs(boxes, ["doc_id"], 0.5).collect()] == [(0, 1)]


def test_copies_of_one_box_never_pair(spark):
    """A third of all words are copies of one box; one survives, and no pair of
    copies is formed."""
    hot = spark.range(30000).selectExpr("1L AS doc_id", "id AS word_no", "'w' AS text", "(id % 7) / 10D AS conf",
                                        "0 AS x0", "0 AS y0", "40 AS x1", "14 AS y1")
    rest = spark.range(60000).selectExpr("2 + id % 100 AS doc_id", "id AS word_no", "'w' AS text", "0.9D AS conf",
                                         "CAST(id AS INT) * 50 AS x0", "0 AS y0", "CAST(id AS INT) * 50 + 40 AS x1", "14 AS y1")
    kept = w.dedupe_overlaps(hot.unionByName(rest))
    assert kept.filter("doc_id = 1").select("word_no").collect()[0][0] == 6
    assert kept.count() == 60001


def test_crowds_of_near_copies(words_of):
    """Jittered detections of a few glyphs."""
    rng = random.Random(60)
    rows = [(9, "w", 0.9, 40 * i, 500, 40 * i + 30, 514) for i in range(6)]
    for doc in range(3):
        for _ in range(250):
            x, y = rng.choice([0, 25, 60, 130]) + rng.randint(-4, 4), rng.choice([0, 14]) + rng.randint(-3, 3)
            rows.append((doc, "w", rng.choice([0.3, 0.5, 0.7, 0.9]), x, y, x + rng.randint(25, 35), y + rng.randint(10, 16)))
    assert {r.word_no for r in w.dedupe_overlaps(words_of(rows)).collect()} == {n for n, in solve(rows, KEPT)}


def test_hot_page_of_lines(spark):
    """One page holds a third of all words."""
    words = spark.range(90_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 700 END AS doc_id", "id AS word_no", "concat('w', id) AS text", "0.9D AS conf",
        "CAST(id % 40 * 50 AS INT) AS x0", "CAST(id / 40 AS INT) * 20 AS y0", "CAST(id % 40 * 50 + 40 AS INT) AS x1",
        "CAST(id / 40 AS INT) * 20 + 12 AS y1",
    )
    grouped = lines.group_lines(words)
    wrong = grouped.groupBy("doc_id", "line_no").agg(F.countDistinct("y0").alias("n")).filter("n > 1")
    assert wrong.isEmpty()
    assert grouped.count() == 90_000
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("y0")) - 1
    assert grouped.withColumn("expected", rank).filter("expected <> line_no").isEmpty()


def test_overlap_must_be_at_least_half(words_of):
    with pytest.raises(ValueError):
        w.dedupe_overlaps(words_of([(1, "a", 0.9, 0, 0, 10, 10)]), iou=0.3)


def page(*words, doc=1):
    """Words (text, x0, y0) of 14 pixels height and 8 pixels a letter."""
    return [(doc, t, 0.9, x, y, x + 8 * len(t), y + 14) for t, x, y in words]


LABEL_PAGES = [
    # the first hit in reading order gives the line; words of its row join up to a wide gap
    ([("Father", 10, 50), ("name", 70, 51), ("far", 400, 50), ("Father", 10, 90)], ("f", "father", None), [(10, 50, "Father name")]),
    # a confirm word picks the line that also holds it
    ([("Place", 10, 20), ("of", 60, 20), ("issue", 80, 20), ("Place", 10, 60), ("of", 60, 60), ("birth", 80, 60)], ("p", "place", "birth"), [(10, 60, "Place of birth")]),
    # a label split in two words; the whole word further down wins all the same
    ([("Fa", 10, 20), ("ther", 30, 20)], ("f", "father", None), [(10, 20, "Fa ther")]),
    ([("Fa", 10, 20), ("ther", 30, 20), ("FATHER", 10, 90)], ("f", "father", None), [(10, 90, "FATHER")]),
    ([("noise", 10, 20)], ("f", "father", None), []),
]


def test_label_lines_by_hand(words_of, spark):
    rows = [r for doc, (words, _, _) in enumerate(LABEL_PAGES) for r in page(*words, doc=doc)]
    found = labels.find_label_lines(words_of(rows), labels.label_table(spark, [("f", "father", None), ("p", "place", "birth")])).collect()
    for doc, (_, label, expected) in enumerate(LABEL_PAGES):
        assert [(r.x0, r.y0, r.text) for r in found if r.doc_id == doc and r.label == label[0]] == expected, doc


FATHER, PLACE = ("Father", 10, 100), [("Place", 10, 160), ("of", 60, 160), ("birth", 80, 160)]


PAGES = [
    # values below their labels
    ([FATHER, ("PARENT", 10, 125), *PLACE, ("TOWN", 10, 185), ("EAST", 60, 185)], "", "PARENT", "TOWN EAST"),
    # two lines at most, and only up to a line that looks like a label or a date
    ([FATHER, ("ONE", 10, 118), ("TWO", 10, 140), ("SIX", 10, 162)], "", "ONE TWO", ""),
    ([FATHER, ("PARENT", 10, 125), ("Sex", 10, 150)], "", "PARENT", ""),
    ([FATHER, ("12/03/2020", 10, 125), ("PARENT", 10, 150)], "", "", ""),
    # too far to the left, too far below, beyond a wide gap
    ([("Father", 200, 100), ("LEFT", 150, 125), ("PARENT", 205, 125)], "", "PARENT", ""),
    ([FATHER, ("LOW", 10, 230)], "", "", ""),
    ([FATHER, ("PARENT", 10, 125), ("FAR", 300, 125)], "", "PARENT", ""),
    # what stands above the header counts for nothing
    ([("Father", 10, 5), ("WRONG", 10, 30), ("Republic", 10, 60), FATHER, ("PARENT", 10, 125)], "", "PARENT", ""),
    # no father label: between the first name's label and the nationality's, without the first line
    ([("First", 10, 60), ("GIVEN", 10, 85), ("PARENT", 10, 120), ("Nationality", 10, 150)], "", "PARENT", ""),
    # no labels but the value of the nationality: the place follows, a label of its own is passed over
    ([("ANCHORLAND", 10, 100), ("Place", 10, 125), ("TOWN", 10, 150)], "", "", "TOWN"),
    # the father between the given name and that value
    ([("GIVEN", 10, 60), ("PARENT", 10, 85), ("ANCHORLAND", 10, 110)], "GIVEN OTHER", "PARENT", ""),
    ([("GIVEN", 10, 60), ("PARENT", 10, 85), ("ANCHORLAND", 10, 110)], "", "", ""),
    # the surer of two detections of one word
    ([FATHER, ("PARENT", 10, 125), ("PARENI", 11, 125)], "", "PARENT", ""),
]


def test_extraction_by_hand(words_of, spark):
    rows = [r for doc, (words, *_) in enumerate(PAGES) for r in page(*words, doc=doc)]
    rows = [(*r[:2], 0.7, *r[3:]) if r[1] == "PARENI" else r for r in rows]
    hints = spark.createDataFrame([(doc, p[1]) for doc, p in enumerate(PAGES)], "doc_id long, given_names string")
    reads = {(r.doc_id, r.field_key): r.value for r in extract_labelled(words_of(rows), hints, LabelSpecs(nationality_value="anchorland")).collect()}
    got = [(reads[doc, "father_name"], reads[doc, "place_of_birth"]) for doc in range(len(PAGES))]
    assert got == [(father, place) for _, _, father, place in PAGES]


def test_extraction_does_not_depend_on_row_order(words_of, spark):
    rows = random_rows(7, 30, 30, [12, 16], step=15, width=400, depth=400)
    words = words_of(rows)
    hints = words.select("doc_id", F.lit("GIVEN").alias("given_names")).distinct()
    run = lambda df: sorted(tuple(r) for r in extract_labelled(df, hints).collect())
    assert run(words) == run(words.orderBy(F.desc("text"), "conf"))


def test_column_run_by_hand(words_of):
    cases = [
        ([(0, 30), (40, 60), (100, 120)], 3),  # gaps of 10 and 40, three heights are 42
        ([(0, 30), (73, 90), (95, 99)], 1),  # 43 is too far, and all that follows goes
        ([(0, 90), (10, 20), (125, 130)], 3),  # measured from the furthest right so far
    ]
    rows = [(doc, f"w{n}", 0.9, a, 0, b, 14) for doc, (spans, _) in enumerate(cases) for n, (a, b) in enumerate(spans)]
    got = sorted((r.doc_id, r.text) for r in lines.column_run(words_of(rows)).collect())
    assert got == [(doc, f"w{n}") for doc, (_, kept) in enumerate(cases) for n in range(kept)]


@pytest.mark.parametrize(
    "spans, value",
    [
        ([("13b", 0, 30), ("O+", 60, 80)], "O+"),
        ([("3", 0, 10), ("01", 50, 70), ("TOWN", 80, 120)], "01 TOWN"),
        ([("a", 0, 10), ("b", 20, 30), ("c", 40, 50)], "c"),  # equal gaps: the rightmost
        ([("alone", 0, 50)], "alone"),
    ],
)
def test_inline_label(words_of, spans, value):
    rows = [(1, text, 0.9, x0, 0, x1, 14) for text, x0, x1 in spans]
    assert [r.value for r in lines.strip_inline_label(words_of(rows)).collect()] == [value]


def test_sideways_pages(words_of):
    tall = [(1, "word", 0.9, 10 * i, 0, 10 * i + 8, 60) for i in range(5)]
    wide = [(2, "word", 0.9, 60 * i, 0, 60 * i + 50, 14) for i in range(5)]
    few = [(3, "word", 0.9, 0, 0, 8, 60), (3, "ab", 0.9, 20, 0, 28, 60)]
    got = {r.doc_id: r.rotated for r in w.rotated_pages(words_of(tall + wide + few)).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_pair_across_a_slice_edge(words_of, spark):
    """A label split in two words that fall into different page slices."""
    rows = [(1, "Fa", 0.9, 500, 255, 520, 269), (1, "ther", 0.9, 10, 256, 50, 270)]
    found = labels.find_label_lines(words_of(rows), labels.label_table(spark, [("f", "father", None)])).collect()
    assert [(r.label, r.text) for r in found] == [("f", "Fa")]


@pytest.mark.parametrize("rounds", [0, 1, 3, 40])
def test_rounds_and_order_decide_alike(spark, rounds):
    """Random conflicts and a long chain, against one pass in order of the rank."""
    rng = random.Random(rounds)
    edges = {(p, *sorted(rng.sample(range(40), 2))) for p in range(6) for _ in range(60)} | {(9, k, k + 1) for k in range(60)}
    pairs = spark.createDataFrame(sorted(edges), "doc_id long, better long, worse long").repartition(5)
    want = set()
    for page, better, worse in sorted(edges, key=lambda e: (e[0], e[2], e[1])):
        if (page, better) not in want:
            want.add((page, worse))
    got = [tuple(r) for r in w.suppressed(pairs, ["doc_id"], rounds).collect()]
    assert sorted(got) == sorted(want)


def test_a_page_of_many_boxes_is_decided_by_joins(spark):
    """Groups of four detections on one page: two rounds, all in the engine."""
    boxes = spark.range(40_000).selectExpr(
        "7L AS doc_id", "id AS word_no", "'w' AS text", "CAST(1 - (id % 4) / 8 AS DOUBLE) AS conf",
        "CAST(id DIV 4 % 100 * 50 + id % 4 * 3 AS INT) AS x0", "CAST(id DIV 400 * 30 AS INT) AS y0",
        "CAST(id DIV 4 % 100 * 50 + id % 4 * 3 + 12 AS INT) AS x1", "CAST(id DIV 400 * 30 + 12 AS INT) AS y1",
    )
    kept = w.dedupe_overlaps(boxes)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan
    # by quarters of a box: the first stays, the next two overlap it or each other by half
    assert {r.c for r in kept.groupBy((F.col("word_no") % 4).alias("c")).count().collect()} == {0, 2}
    assert kept.count() == 20_000


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning(")


def test_gathered_lines_are_the_grouped_ones(spark, words_of):
    """Lines apart, touching lines and a missing confidence."""
    rows = [(d, f"w{k}", None if k == 4 else 0.5 + k / 100, 40 - 7 * k, 9 * k + (k * k) % 5, 60 - 7 * k, 9 * k + 4 + (k * 13) % 17) for d in (1, 2) for k in range(5)]
    rows += [(2, "low", 0.9, 0, 500, 9, 512), (2, "er", 0.8, 20, 501, 29, 513)]
    words = words_of(rows)
    expected = lines.line_boxes(lines.group_lines(words))
    assert sorted(map(str, lines.boxed_lines(words).select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_words_of_documents_are_moved_once(spark, tmp_path):
    """Documents are dealt out as texts; their words then stay where they are."""
    from __spark_entry__ import queries

    spark.createDataFrame([(1, "a b\nc  d", "x"), (2, "e", "y")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert _shuffles(queries()["s2_flatten_annotations"](spark, str(tmp_path))) == 1
    # each of the three ways to number lines reads the dealt documents; no other step moves words
    for name in ("text_lines", "a2_line_boxes", "a3_rebuild_text"):
        plan = queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_dumped_words_are_packed_and_stay_where_they_lie(spark, tmp_path):
    import glob

    from docreg.sources import word_dumps

    columns = "run string, region long, word_no int, text string, conf double, x0 int, y0 int, x1 int, y1 int"
    words = spark.createDataFrame([("r", 7, 1, "b", 0.25, 5, 6, 7, 8), ("r", 7, 0, "a", 0.5, 1, 2, 3, 4)], columns)
    assert _shuffles(word_dumps.dump_payloads(words.repartition(3, "region"))) == 1
    word_dumps.write_word_dumps(words, str(tmp_path / "d"))
    assert glob.glob(str(tmp_path / "d/run=r/part-*.gz"))
    read = word_dumps.read_word_dumps(spark, str(tmp_path / "d")).orderBy("word_no").collect()
    assert [(r.region, r.word_no, r.text, r.conf, r.x0, r.y1) for r in read] == [("7", 0, "a", 0.5, 1, 4), ("7", 1, "b", 0.25, 5, 8)]


def test_many_seeds_are_not_broadcast(spark):
    words = spark.range(210_000).selectExpr(
        "id AS doc_id", "id AS word_no", "'Father' AS text", "0.9D AS conf", "10 AS x0", "10 AS y0", "90 AS x1", "24 AS y1"
    )
    found = labels.find_label_lines(words, labels.label_table(spark, [("father", "father", None)]))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 210_000
