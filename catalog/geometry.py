"""Words, lines, labels and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import inputs as i
from docreg.common import WORD_COLUMNS, mean_conf
from docreg.operators import labels, lines, words as w
from docreg.operators.layout import assign_regions
from docreg.plans import readings
from docreg.plans.text_lines import text_lines
from docreg.sources import reference as ref
from docreg.sources.annotations import flatten_annotations

_MEAN = "sum(CAST(CAST(conf AS VARCHAR) AS DECIMAL(38,20)))::DOUBLE/count(*)"

# lines of pages whose words all have the same height: islands in y
_LINES = """numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY y0, word_no ROWS UNBOUNDED PRECEDING)::BIGINT-1 AS line_no
  FROM (SELECT *, CASE WHEN reach IS NULL OR (y0+y1)/2.0 > reach+4 THEN 1 ELSE 0 END AS opens
    FROM (SELECT *, max(y1) OVER (PARTITION BY doc_id ORDER BY y0, word_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source})))"""
_BOXES = f"""SELECT doc_id, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  string_agg(text,' ' ORDER BY x0, word_no) AS text, count(*) AS n_words, {_MEAN} AS conf,
  greatest(max(y1)-min(y0),1) AS height FROM numbered GROUP BY doc_id, line_no"""


def _text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return text_lines(i.words(spark, sf))


def _filter_confident(spark, sf):
    return w.filter_confident(i.words(spark, sf)).select("doc_id", *WORD_COLUMNS)


def _group_lines(spark, sf):
    words = i.words(spark, sf).select("doc_id", "word_no", "y0", "y1")
    return lines.group_lines(words, dealt=True).select("doc_id", "word_no", "line_no")


def _touching_lines(spark, sf):
    """Words of mixed heights, so that lines reach into each other."""
    tall = F.col("y0") + F.element_at(F.array(*[F.lit(h) for h in (14, 34, 54)]), (F.col("word_no") % 3 + 1).cast("int"))
    return lines.group_lines(i.label_words(spark, sf).withColumn("y1", tall), dealt=True).select("doc_id", "word_no", "line_no")


def _line_boxes(spark, sf):
    return lines.boxed_lines(i.words(spark, sf))


def _rebuild_text(spark, sf):
    return lines.rebuild_text(i.words(spark, sf))


def _avg_confidence(spark, sf):
    return w.avg_confidence(i.words(spark, sf), i.table(spark, sf, "documents"))


def _flag_reads(spark, sf):
    """Every printed line as a read; weak words leave some reads blank."""
    words = i.words(spark, sf).withColumn("row_no", F.floor(F.col("word_no") / 1000000))
    strong = F.when(F.col("conf") >= 0.3, F.col("text"))
    reads = words.groupBy("doc_id", "row_no").agg(
        F.coalesce(F.min(strong), F.lit("")).alias("value"), mean_conf().alias("conf"),
        (F.col("doc_id") % 10 == 0).alias("unaligned"),
    )
    return w.flag_reads(reads).select("doc_id", "row_no", "value", "flagged")


def _dedupe(spark, sf):
    return w.dedupe_overlaps(i.doubled(spark, sf)).select("doc_id", *WORD_COLUMNS)


def _rotated(spark, sf):
    """Pages as they are, and each page turned by a quarter (negative id)."""
    words = i.words(spark, sf)
    turned = words.select(
        (-1 - F.col("doc_id")).alias("doc_id"), "word_no", "text", "conf",
        F.col("y0").alias("x0"), F.col("x0").alias("y0"), F.col("y1").alias("x1"), F.col("x1").alias("y1"),
    )
    own = i.table(spark, sf, "documents").select("doc_id")
    return w.rotated_pages(words.unionByName(turned), pages=own.unionByName(own.select((-1 - F.col("doc_id")).alias("doc_id"))))


def _strip_inline_label(spark, sf):
    """Confident words of every printed line: dropped words leave the gaps."""
    words = w.filter_confident(i.words(spark, sf)).withColumn("row_no", F.floor(F.col("word_no") / 1000000))
    return lines.strip_inline_label(words, ["doc_id", "row_no"])


def _column_run(spark, sf):
    words = w.filter_confident(i.words(spark, sf)).withColumn("row_no", F.floor(F.col("word_no") / 1000000))
    return lines.column_run(words, ["doc_id", "row_no"]).select("doc_id", "word_no")


def _line_around(spark, sf):
    words = i.label_words(spark, sf)
    seeds = words.filter(F.col("text").isin("First", "Place", "noise")).withColumn("seed_no", F.col("word_no"))
    return lines_around(words, seeds)


def lines_around(words: DataFrame, seeds: DataFrame) -> DataFrame:
    return labels.line_around(words, seeds).select("doc_id", "seed_no", "word_no")


_LABELS = [("father", "father", None), ("place", "place", "birth"), ("first", "first", None),
           ("nationality", "national", None), ("value", "anchorland", None), ("pair", "ofbir", None)]


def _label_lines(spark, sf):
    found = labels.find_label_lines(i.label_words(spark, sf), labels.label_table(spark, _LABELS))
    return found.select("doc_id", "label", "x0", "y0", "x1", "y1", "text")


def _cut_above_header(spark, sf):
    return labels.cut_above_header(i.label_words(spark, sf)).select("doc_id", "word_no")


def _own_labels(spark, sf, *wanted):
    words = i.label_words(spark, sf)
    return words, labels.find_label_lines(words, labels.label_table(spark, [l for l in _LABELS if l[0] in wanted]))


def _value_band(spark, sf):
    words, found = _own_labels(spark, sf, "father", "nationality")
    return labels.value_band(words, found).select("doc_id", "label", "word_no")


def _band_between(spark, sf):
    words, found = _own_labels(spark, sf, "first", "nationality")
    top, bottom = (found.filter(F.col("label") == l) for l in ("first", "nationality"))
    return labels.band_between(words, top, bottom).select("doc_id", "word_no")


def _select_value_lines(spark, sf):
    """The page below its nationality value, both ways of selecting."""
    words, found = _own_labels(spark, sf, "nationality")
    keys = ["doc_id", "label"]
    band = lines.column_run(labels.value_band(words, found, below=9), keys)
    grouped = lines.value_lines(band, keys)
    plain = lines.select_value_lines(grouped, keys).withColumn("skipping", F.lit(False))
    skipping = lines.select_value_lines(grouped, keys, True).withColumn("skipping", F.lit(True))
    return plain.unionByName(skipping).select("doc_id", "skipping", "line_no", "text")


def _orientation(spark, sf):
    """Pages as they are, and each page upside down (negative id)."""
    words = i.label_words(spark, sf)
    turned = words.withColumn("doc_id", -1 - F.col("doc_id")).withColumn("y0", 400 - F.col("y0")).withColumn("y1", F.col("y0") + 14)
    anchors = labels.label_table(spark, [(a, a, None) for a in labels.ORDERED_ANCHORS])
    own = i.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    # a third set of pages holds no words at all
    blank_pages = own.select((F.col("doc_id") + 1000000000).alias("doc_id"))
    pages = own.unionByName(own.select((-1 - F.col("doc_id")).alias("doc_id"))).unionByName(blank_pages)
    return labels.orientation_ok(labels.find_label_lines(words.unionByName(turned), anchors), pages=pages)


def _page_readings(spark, sf):
    """Even pages are first read on their side; every fourth is then read upside down."""
    words = i.label_words(spark, sf)
    key = F.col("doc_id")
    side = words.select("doc_id", "word_no", "text", "conf", F.col("y0").alias("x0"), F.col("x0").alias("y0"), F.col("y1").alias("x1"), F.col("x1").alias("y1"))
    down = words.withColumn("y0", 400 - F.col("y0")).withColumn("y1", F.col("y0") + 14)
    as_ = lambda df, n: df.select(*words.columns, F.lit(n).alias("attempt"))
    tries = [as_(words.where(key % 2 == 1), 0), as_(side.where(key % 2 == 0), 0), as_(down.where(key % 4 == 0), 1), as_(words.where(key % 4 != 0), 1), as_(words, 2)]
    every = tries[0].unionByName(tries[1]).unionByName(tries[2]).unionByName(tries[3]).unionByName(tries[4])
    # the last documents have an attempt without any words
    bare = i.table(spark, sf, "customer").select((F.col("c_custkey") + 1000000000).alias("doc_id"), F.lit(0).alias("attempt"))
    return readings.page_readings(every, every.select("doc_id", "attempt").distinct().unionByName(bare))


def _assign_regions(spark, sf):
    regions = ref.region_table(spark, ref.FRONT_REGIONS)
    return assign_regions(i.card_words(spark, sf), i.card_sizes(spark, sf), regions).select("doc_id", "word_no", "field_key")


def _nested(words: DataFrame) -> DataFrame:
    """Reader responses built from words: one paragraph per printed line. As in a
    response, numbers that are 0 are left out, and so are some empty lists."""
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    corner = lambda x, y: F.struct(some(x).alias("x"), some(y).alias("y"))
    word = F.struct(
        "word_no",
        F.transform(F.split("text", ""), lambda s: F.struct(s.alias("text"))).alias("symbols"),
        F.nullif(F.col("conf") * 2, F.lit(0.0)).alias("confidence"),
        F.struct(F.array(corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")).alias("vertices")).alias("bounding_box"),
    )
    pick = lambda x: F.struct(x["symbols"].alias("symbols"), x["confidence"].alias("confidence"), x["bounding_box"].alias("bounding_box"))
    paragraphs = words.withColumn("row_no", F.floor(F.col("word_no") / 1000000)).groupBy("doc_id", "row_no").agg(
        F.struct(F.transform(F.array_sort(F.collect_list(word)), pick).alias("words")).alias("paragraph")
    )
    listed = F.array_sort(F.collect_list(F.struct("row_no", "paragraph")))
    block = F.struct(F.transform(listed, lambda p: p["paragraph"]).alias("paragraphs"))
    bare = F.struct(F.lit(None).cast("array<struct<words:array<struct<symbols:array<struct<text:string>>,confidence:double,bounding_box:struct<vertices:array<struct<x:int,y:int>>>>>>>").alias("paragraphs"))
    page = F.struct(F.array(bare, block).alias("blocks"))
    return paragraphs.groupBy("doc_id").agg(F.struct(F.lit("t").alias("text"), F.array(F.struct(F.lit(None).cast("array<struct<paragraphs:array<struct<words:array<struct<symbols:array<struct<text:string>>,confidence:double,bounding_box:struct<vertices:array<struct<x:int,y:int>>>>>>>>>").alias("blocks")), page).alias("pages")).alias("annotation"))


def _flatten_annotations(spark, sf):
    return flatten_annotations(_nested(i.words(spark, sf)))


_GAPPED = "gapped AS (SELECT *, word_no//1000000 AS row_no FROM words WHERE conf >= 0.6)"
_REGIONS = ", ".join(f"('{k}',{a}::DOUBLE,{b}::DOUBLE,{c}::DOUBLE,{d}::DOUBLE)" for k, (a, b, c, d) in ref.FRONT_REGIONS.items())
# the printed lines of the label pages: rows at one height, split at wide gaps
_ROWS = f"""{i.LABEL_WORDS}, runs AS (
  SELECT *, sum(jump) OVER (PARTITION BY doc_id, y0 ORDER BY x0, word_no ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN x0-lag(x1) OVER (PARTITION BY doc_id, y0 ORDER BY x0, word_no) > 56 THEN 1 ELSE 0 END AS jump FROM label_words)),
printed AS (SELECT doc_id, y0, run, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1,
  string_agg(text,' ' ORDER BY x0, word_no) AS text FROM runs GROUP BY doc_id, y0, run)"""
_FOUND = """found AS (
  SELECT l.label, p.*, row_number() OVER (PARTITION BY l.label, doc_id ORDER BY y0, x0) AS nth
  FROM printed p JOIN (VALUES ('father','%father%','%'),('place','%place%','%birth%'),('first','%first%','%'),
    ('nationality','%national%','%'),('value','%anchorland%','%'),('pair','%of birth%','%')) AS l(label, kw, confirm)
  ON lower(p.text) LIKE l.kw AND lower(p.text) LIKE l.confirm)"""

QUERIES = {
    "text_lines": (_text_lines, f"WITH {i.WORDS}, strong AS (SELECT * FROM words WHERE conf >= 0.6), {_LINES.format(source='strong')} {_BOXES}"),
    "f1_filter_confident": (_filter_confident, f"WITH {i.WORDS} SELECT * FROM words WHERE conf >= 0.6"),
    "f2_flag_reads": (_flag_reads, f"""WITH {i.WORDS}, reads AS (SELECT doc_id, word_no//1000000 AS row_no,
  coalesce(min(CASE WHEN conf >= 0.3 THEN text END),'') AS value, {_MEAN} AS mean FROM words GROUP BY 1, 2)
SELECT doc_id, row_no, value, mean < 0.6 OR value = '' OR doc_id%10=0 AS flagged FROM reads"""),
    "w1_group_lines": (_group_lines, f"WITH {i.WORDS}, {_LINES.format(source='words')} SELECT doc_id, word_no, line_no FROM numbered"),
    # the rule itself, word by word: a word joins the first line whose bottom and slack reach its middle
    "w1_touching_lines": (_touching_lines, f"""WITH RECURSIVE {i.LABEL_WORDS},
tall AS (SELECT doc_id, word_no, y0, y0+[14,34,54][(word_no%3+1)::INT] AS y1 FROM label_words),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, word_no) AS pos FROM tall),
walk(doc_id, pos, word_no, line_no, bottoms) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, NULL::INT, NULL::BIGINT, []::INT[] FROM tall
  UNION ALL
  SELECT doc_id, pos, word_no, fit-1, CASE WHEN fit > len(bottoms) THEN list_append(bottoms, y1)
    ELSE list_concat(list_append(bottoms[1:fit-1], greatest(bottoms[fit], y1)), bottoms[fit+1:]) END
  FROM (SELECT o.*, w.bottoms, coalesce(list_position(list_transform(w.bottoms, lambda b: b+4 >= (o.y0+o.y1)/2.0), true), len(w.bottoms)+1) AS fit
    FROM walk w JOIN ordered o ON o.doc_id=w.doc_id AND o.pos=w.pos+1))
SELECT doc_id, word_no, line_no FROM walk WHERE word_no IS NOT NULL"""),
    "a2_line_boxes": (_line_boxes, f"WITH {i.WORDS}, {_LINES.format(source='words')} {_BOXES}"),
    "a3_rebuild_text": (_rebuild_text, f"""WITH {i.WORDS}, {_LINES.format(source='words')}
SELECT doc_id, string_agg(text,' ' ORDER BY line_no, x0, word_no) AS text FROM numbered GROUP BY doc_id"""),
    "a1_avg_confidence": (_avg_confidence, f"""WITH {i.WORDS}, means AS (SELECT doc_id, {_MEAN} AS m FROM words GROUP BY doc_id)
SELECT d.doc_id, coalesce(m, 0.0::DOUBLE) AS avg_conf FROM documents d LEFT JOIN means USING (doc_id)"""),
    # pairs by cells of 128 pixels on a printed line, then each line's pairs in order of the worse box
    "j2_dedupe_overlaps": (_dedupe, f"""WITH RECURSIVE {i.DOUBLED},
boxed AS (SELECT *, word_no//1000000 AS row_no, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, word_no) AS rank FROM doubled WHERE word_no >= 0),
wide AS (SELECT *, unnest(generate_series(x0//128, x1//128)) AS cell FROM boxed),
sized AS (SELECT b.doc_id, b.row_no, a.rank AS better, b.rank AS worse, greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0) AS inter,
    (a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0) AS areas
  FROM wide a JOIN boxed b ON a.doc_id=b.doc_id AND a.row_no=b.row_no AND a.cell=((b.x0+b.x1)//2)//128 AND a.rank < b.rank),
edges AS (SELECT *, row_number() OVER (PARTITION BY doc_id, row_no ORDER BY worse, better) AS step FROM sized WHERE inter > 0 AND inter::DOUBLE/(areas-inter) >= 0.5),
walk(doc_id, row_no, step, gone) AS (
  SELECT DISTINCT doc_id, row_no, 0::BIGINT, []::BIGINT[] FROM edges
  UNION ALL
  SELECT w.doc_id, w.row_no, e.step, CASE WHEN list_contains(gone, e.better) OR list_contains(gone, e.worse) THEN gone ELSE list_append(gone, e.worse) END
  FROM walk w JOIN edges e ON e.doc_id=w.doc_id AND e.row_no=w.row_no AND e.step=w.step+1),
beaten AS (SELECT doc_id, unnest(arg_max(gone, step)) AS rank FROM walk GROUP BY doc_id, row_no)
SELECT doc_id, word_no, text, conf, x0, y0, x1, y1 FROM boxed ANTI JOIN beaten USING (doc_id, rank)
UNION ALL SELECT doc_id, word_no, text, conf, x0, y0, x1, y1 FROM doubled WHERE word_no < 0"""),
    "a4_rotated_pages": (_rotated, f"""WITH {i.WORDS}, pages2 AS (SELECT doc_id, text, x1-x0 AS w, y1-y0 AS h FROM words
  UNION ALL SELECT -1-doc_id, text, y1-y0, x1-x0 FROM words),
counts AS (SELECT doc_id, count(*) FILTER (length(text)>=3) AS n_words,
  count(*) FILTER (length(text)>=3 AND h > w*1.3::DOUBLE) AS n_tall FROM pages2 GROUP BY doc_id)
SELECT doc_id, coalesce(n_words,0) AS n_words, coalesce(n_tall,0) AS n_tall, coalesce(n_words >= 3 AND n_tall >= n_words*0.6::DOUBLE, FALSE) AS rotated
FROM (SELECT doc_id FROM documents UNION ALL SELECT -1-doc_id FROM documents) LEFT JOIN counts USING (doc_id)"""),
    "w2_strip_inline_label": (_strip_inline_label, f"""WITH {i.WORDS}, {_GAPPED},
gaps AS (SELECT *, row_number() OVER o AS pos, lead(x0) OVER o - x1 AS gap FROM gapped WINDOW o AS (PARTITION BY doc_id, row_no ORDER BY x0, word_no)),
split AS (SELECT doc_id, row_no, pos AS cut FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, row_no ORDER BY gap DESC, pos DESC) AS nth
  FROM gaps WHERE gap IS NOT NULL) WHERE nth=1)
SELECT doc_id, row_no, string_agg(text,' ' ORDER BY pos) AS value
FROM gaps LEFT JOIN split USING (doc_id, row_no) WHERE pos > coalesce(cut, 0) GROUP BY doc_id, row_no"""),
    "w3_column_run": (_column_run, f"""WITH {i.WORDS}, {_GAPPED},
breaks AS (SELECT doc_id, row_no, word_no, x0, CASE WHEN x0 - max(x1) OVER (PARTITION BY doc_id, row_no ORDER BY x0, word_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3*greatest(y1-y0,1) THEN 1 ELSE 0 END AS brk FROM gapped),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, row_no ORDER BY x0, word_no ROWS UNBOUNDED PRECEDING) AS passed FROM breaks)
SELECT doc_id, word_no FROM runs WHERE passed = 0"""),
    "w4_line_around": (_line_around, f"""WITH {_ROWS} SELECT s.doc_id, s.word_no AS seed_no, m.word_no
FROM runs s JOIN runs m ON s.doc_id=m.doc_id AND s.y0=m.y0 AND s.run=m.run WHERE s.text IN ('First','Place','noise')"""),
    "j5_find_label_lines": (_label_lines, f"WITH {_ROWS}, {_FOUND} SELECT doc_id, label, x0, y0, x1, y1, text FROM found WHERE nth=1"),
    "f7_cut_above_header": (_cut_above_header, f"""WITH {i.LABEL_WORDS}, header AS (SELECT doc_id, min(y1) AS bottom FROM label_words
  WHERE lower(text) LIKE '%republic%' GROUP BY doc_id)
SELECT doc_id, word_no FROM label_words LEFT JOIN header USING (doc_id) WHERE coalesce(y0 >= bottom, TRUE)"""),
    "j6_value_band": (_value_band, f"""WITH {_ROWS}, {_FOUND} SELECT w.doc_id, l.label, w.word_no FROM label_words w JOIN found l
 ON w.doc_id=l.doc_id AND l.nth=1 AND l.label IN ('father','nationality')
 AND (w.y0+w.y1)/2.0 BETWEEN l.y1 AND l.y1+6*(l.y1-l.y0) AND w.x0 >= l.x0-2*(l.y1-l.y0)"""),
    "j7_band_between": (_band_between, f"""WITH {_ROWS}, {_FOUND} SELECT w.doc_id, w.word_no FROM label_words w
 JOIN found a ON w.doc_id=a.doc_id AND a.nth=1 AND a.label='first'
 JOIN found b ON w.doc_id=b.doc_id AND b.nth=1 AND b.label='nationality'
 WHERE (w.y0+w.y1)/2.0 BETWEEN a.y1 AND b.y0 AND w.x0 >= a.x0-2*(a.y1-a.y0)"""),
    # below the nationality value: the value itself, the place label when it
    # still reads as one, and the place; the other column is cut off
    "w5_select_value_lines": (_select_value_lines, f"""WITH {_ROWS}, band AS (
  SELECT doc_id, y0, text, row_number() OVER (PARTITION BY doc_id ORDER BY y0)-1 AS line_no,
    regexp_matches(lower(text),'father|place|birth|first|national|date') AS is_label
  FROM printed WHERE x0=100 AND y0 BETWEEN 230 AND 300),
modes AS (SELECT * FROM band CROSS JOIN (VALUES (FALSE),(TRUE)) AS m(skipping)),
kept AS (SELECT *, sum(is_label::INT) OVER (PARTITION BY doc_id, skipping ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS stops FROM modes)
SELECT doc_id, skipping, line_no, text FROM kept WHERE stops=0 AND line_no < 2"""),
    "a5_orientation_ok": (_orientation, f"""WITH {_ROWS}, {_FOUND}, n AS (SELECT doc_id, count(*) AS n FROM (
  SELECT doc_id, label FROM found WHERE nth=1 AND label IN ('father','first','nationality')
  UNION ALL SELECT doc_id, 'place' FROM printed WHERE lower(text) LIKE '%place%') GROUP BY doc_id)
, all_ AS (SELECT c_custkey AS doc_id, coalesce(n,0)::INT AS n FROM customer LEFT JOIN n ON n.doc_id=c_custkey)
SELECT doc_id, n AS n_anchors, TRUE AS upright FROM all_ UNION ALL SELECT -1-doc_id, n, n < 2 FROM all_
UNION ALL SELECT doc_id+1000000000, 0, TRUE FROM all_"""),
    "a5_page_readings": (_page_readings, f"""WITH {_ROWS}, {_FOUND}, n AS (SELECT doc_id, count(*) AS n FROM (
  SELECT doc_id, label FROM found WHERE nth=1 AND label IN ('father','first','nationality')
  UNION ALL SELECT doc_id, 'place' FROM printed WHERE lower(text) LIKE '%place%') GROUP BY doc_id)
SELECT c_custkey AS doc_id, CASE WHEN c_custkey%2=1 THEN 0 WHEN c_custkey%4=0 AND coalesce(n,0) >= 2 THEN 2 ELSE 1 END AS attempt FROM customer LEFT JOIN n ON n.doc_id=c_custkey
UNION ALL SELECT c_custkey+1000000000, 0 FROM customer"""),
    "j1_assign_regions": (_assign_regions, f"""WITH {i.CARD_WORDS}
SELECT doc_id, word_no, r.k AS field_key FROM card_words JOIN (VALUES {_REGIONS}) AS r(k,a,b,c,d)
 ON (x0+x1)/2.0 >= trunc(a*1000) AND (x0+x1)/2.0 < trunc(c*1000) AND (y0+y1)/2.0 >= trunc(b*600) AND (y0+y1)/2.0 < trunc(d*600)"""),
    "s2_flatten_annotations": (_flatten_annotations, f"""WITH {i.WORDS}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY word_no)-1)::INT AS word_no, text,
  least(conf*2, 1.0::DOUBLE) AS conf, x0, y0, x1, y1 FROM words"""),
}
