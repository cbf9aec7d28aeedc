"""Zones, labelled fields, fixed layouts, categories and the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as i
from docreg.operators import categories, forms
from docreg.plans import autofill, labelled_fields, mrz_validation as mrz, readings, source_merge
from docreg.plans.category_table import extract_categories
from docreg.plans.layout_fields import extract_layout
from docreg.sources.reference import CATEGORY_CLASS, category_table

_ZONE = ["doc_id", "line1", "line2", "document_type", "issuing_country", "surname", "given_names", "document_number",
         "number_valid", "nationality", "date_of_birth", "birth_valid", "sex", "expiry_date", "expiry_valid",
         "personal_number", "valid", "birth_day", "expiry_day"]


def _candidates(spark, sf):
    return mrz.mrz_candidates(i.mrz_pages(spark, sf))


def _last_two(spark, sf):
    return mrz.last_two(i.mrz_pages(spark, sf))


def _validate(spark, sf):
    """Both outputs of the job; ``review`` tells them apart. Beside each page stands
    one without a zone, and without words."""
    pages = i.mrz_pages(spark, sf)
    bare = pages.select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit("no zone here").alias("full_text"))
    valid, review = mrz.validate_mrz(pages.unionByName(bare), i.mrz_words(spark, sf), i.AS_OF)
    both = valid.withColumn("review", F.lit(False)).unionByName(review.withColumn("review", F.lit(True)))
    warned = F.coalesce(F.array_join("warnings", "; "), F.lit(""))
    return both.select(*_ZONE, warned.alias("warnings"), "names_flagged", "review", "avg_conf", F.coalesce("error", F.lit("")).alias("error"))


def _zone_readings(spark, sf):
    """Three attempts: only Arabic and noise, a zone on some pages, a zone on more."""
    pages = i.mrz_pages(spark, sf)
    key = F.col("doc_id")
    blank_read = F.concat(F.lit("noise\n"), F.lit("\u0627\u0628 " * 30), F.lit("\n"), F.lit("\u0627\u0628 " * 30))
    tries = [
        pages.select("doc_id", F.lit(0).alias("attempt"), blank_read.alias("full_text")),
        pages.select("doc_id", F.lit(1).alias("attempt"), F.when(key % 2 == 0, F.col("full_text")).otherwise("nothing").alias("full_text")),
        pages.select("doc_id", F.lit(2).alias("attempt"), F.when(key % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("full_text")).alias("full_text")),
    ]
    return readings.zone_readings(tries[2].unionByName(tries[0]).unionByName(tries[1]))


def _quality(spark, sf):
    return mrz.mrz_quality(mrz.read_zones(i.mrz_pages(spark, sf), i.AS_OF))


def _labelled(spark, sf):
    pages, words = i.mrz_pages(spark, sf), i.label_words(spark, sf)
    hints = mrz.read_zones(pages, i.AS_OF).select("doc_id", "given_names")
    specs = labelled_fields.LabelSpecs(nationality_value="anchorland")
    return labelled_fields.extract_labelled(words, hints, specs)


def _layout(spark, sf):
    return extract_layout(i.card_words(spark, sf), i.card_sizes(spark, sf)).withColumn("typed", F.col("typed").cast("string"))


def _categories(spark, sf):
    return extract_categories(i.back_words(spark, sf), i.back_sizes(spark, sf)).select("doc_id", "category", "issue", "expiry")


def _map_categories(spark, sf):
    mapped = categories.map_categories(i.category_reads(spark, sf), category_table(spark))
    return mapped.select("doc_id", "row_no", "category", "class", "issue", "expiry")


def _held_classes(spark, sf):
    pages = i.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 13 == 0).alias("unaligned"))
    return categories.held_classes(i.category_reads(spark, sf), category_table(spark), pages)


def _never_held(spark, sf):
    return categories.never_held(i.category_reads(spark, sf))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    reads = i.source_reads(spark, sf)
    app = F.col("app_id")
    passport = reads.select(
        "app_id", F.col("passport_surname").alias("surname"),
        F.when(app % 8 != 0, F.concat(F.lit("G"), app)).otherwise("").alias("given_names"),
        F.col("passport_flagged").alias("names_flagged"),
        F.when(app % 9 != 0, F.lit("01/02/1990")).alias("date_of_birth"), F.col("birth_ok").alias("birth_valid"),
        F.when(app % 4 != 0, F.concat(F.lit("F"), app)).otherwise("").alias("father_name"), (app % 3 == 1).alias("father_flagged"),
        F.when(app % 6 != 0, F.lit("TOWN")).otherwise("").alias("place_of_birth"), (app % 5 == 2).alias("place_flagged"),
        F.when(app % 17 == 0, F.lit("unreadable")).alias("error"),
    )
    # every third application has no read of its father's name on the licence
    listed = F.array(
        F.struct(F.lit("1").alias("field_key"), F.col("licence_surname").alias("value"), F.col("licence_flagged").alias("flagged")),
        *[F.struct(F.lit(k).alias("field_key"), F.when(app % m == 0, "").otherwise(F.concat(F.lit(f"{k}:"), app)).alias("value"),
                   (app % m == 1).alias("flagged")) for k, m in _LICENCE.items()],
    )
    front_reads = reads.select("app_id", F.inline(listed)).filter(~((F.col("field_key") == "13c") & (app % 3 == 0)))
    front = reads.select("app_id", F.when(app % 19 == 0, F.lit("no card found")).alias("error"))
    backs = reads.select("app_id", (app % 12 == 0).alias("unaligned"), F.when(F.col("back_error"), F.lit("no table found")).alias("error"))
    cats = i.category_reads(spark, sf).select(F.col("doc_id").alias("app_id"), "category", "issue", "expiry")
    back = source_merge.back_classes(cats.join(reads.select("app_id"), "app_id", "left_semi"), backs)
    return passport, front_reads, back, front


_LICENCE = {"2": 10, "3": 11, "4a": 7, "4b": 13, "4c": 9, "5": 8, "8": 6, "13b": 5, "13c": 4}


def _merge(spark, sf):
    return source_merge.merge_sources(*_sides(spark, sf))


def _merge_errors(spark, sf):
    return source_merge.merge_errors(*_sides(spark, sf)).select("app_id", F.array_join("errors", "; ").alias("errors"))


def _autofill(spark, sf):
    """Passports, fronts and backs of applications; every tenth passport belongs to
    an application of its own, most backs stand alone."""
    own = F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") + 1000000000).otherwise(F.col("doc_id"))
    moved = lambda df: df.withColumn("doc_id", own)
    customer, orders = i.table(spark, sf, "customer"), i.table(spark, sf, "orders")
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    fail = lambda df, doc, side, field, no, error: df.select(doc.alias("doc_id"), F.lit(side).alias("side"), F.lit(field).cast("string").alias("field_key"), F.lit(no).cast("long").alias("read_no"), F.lit(error).alias("error"))
    passport = F.when(key % 10 == 3, key + 1000000000).otherwise(key)
    failures = (
        fail(customer.where(key % 17 == 0), passport, "passport", None, 2, "blurred")
        .unionByName(fail(customer.where(key % 34 == 0), passport, "passport", None, 1, "unreadable"))
        .unionByName(fail(customer.where(key % 34 == 0), passport, "passport", None, 3, "blurred"))
        .unionByName(fail(customer.where(key % 19 == 0), key, "front", "5", 1, "region lost"))
        .unionByName(fail(orders.where(order % 12 == 0), order, "back", None, 1, "no table found"))
    )
    done = autofill.autofill(
        moved(i.mrz_pages(spark, sf)), moved(i.mrz_words(spark, sf)), moved(i.label_words(spark, sf)), i.card_words(spark, sf), i.card_sizes(spark, sf),
        i.back_words(spark, sf), i.back_sizes(spark, sf), i.AS_OF, labelled_fields.LabelSpecs(nationality_value="anchorland"), failures,
    )
    named = done.errors.select("app_id", F.array_join("errors", "; ").alias("errors"))
    return done.form.join(named, "app_id").join(done.summary.withColumnRenamed("flagged", "n_flagged"), "app_id")


def _applicable(spark, sf):
    return forms.applicable_fields(_merge(spark, sf)).select("app_id", "field_key", "value", "flagged", "source")


def _run_summary(spark, sf):
    return forms.run_summary(_merge(spark, sf))


def _collect_errors(spark, sf):
    """Failed events of a user as errors of a document, in time order."""
    events = i.table(spark, sf, "events")
    message = F.when(F.col("event_type") != "view", F.concat(F.col("event_type"), F.lit(" "), F.col("event_id") % 3))
    reads = events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("read_no"), message.alias("error"))
    return forms.collect_errors(reads)


def _check(data: str, digit: str, digits: int = 0) -> str:
    shape = f" AND regexp_full_match({data}, '[0-9]{{{digits}}}')" if digits else ""
    return f"(regexp_full_match({digit}, '[0-9]') AND CAST({i.duck_cd(data)} AS VARCHAR) = {digit}{shape})"


def _checks(line: str) -> list[str]:
    part = lambda a, n: f"substr({line},{a},{n})"
    return [_check(part(1, 9), part(10, 1)), _check(part(14, 6), part(20, 1), 6), _check(part(22, 6), part(28, 1), 6)]


def _day(start: int, century: str) -> str:
    yy, mm, dd = (f"substr(l2,{start + k},2)" for k in (0, 2, 4))
    return (f"CASE WHEN regexp_full_match(substr(l2,{start},6),'[0-9]{{6}}') AND {mm} BETWEEN '01' AND '12' AND {dd} BETWEEN '01' AND '31' "
            f"THEN {dd}||'/'||{mm}||'/'||{century}||{yy} END")


_SCORE = lambda line: "+".join(f"CAST({c} AS INT)" for c in _checks(line))
_CANDIDATES = f"""{i.MRZ_PAGES}, split_lines AS (
  SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls,1) AS pos FROM (SELECT doc_id, string_split(full_text, chr(10)) AS ls FROM mrz_pages)),
normal AS (SELECT doc_id, pos, rpad(regexp_replace(upper(trim(raw)),'[^A-Z0-9<]','<','g'),44,'<') AS line FROM split_lines WHERE length(trim(raw)) >= 20),
candidates AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos)-1)::INT AS line_no, line
  FROM normal WHERE length(replace(line,'<','')) >= 10)"""
_PAIRS = f"""{_CANDIDATES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS back, count(*) OVER (PARTITION BY doc_id) AS n FROM candidates),
zones AS (SELECT p.doc_id, a.line AS line1, b.line AS line2 FROM mrz_pages p LEFT JOIN ranked a ON a.doc_id=p.doc_id AND a.back=2 AND a.n>=2
  LEFT JOIN ranked b ON b.doc_id=p.doc_id AND b.back=1 AND b.n>=2)"""
_OK = _checks("l2")
_PARSED = f"""{_PAIRS}, scored AS (SELECT *, {_SCORE('line1')} > {_SCORE('line2')} AS swap FROM zones),
ordered AS (SELECT doc_id, CASE WHEN swap THEN line2 ELSE line1 END AS l1, CASE WHEN swap THEN line1 ELSE line2 END AS l2 FROM scored),
checked AS (SELECT *, {_OK[0]} AS number_valid, {_OK[1]} AS birth_valid, {_OK[2]} AS expiry_valid, substr(l1,6,39) AS names FROM ordered),
parsed AS (SELECT doc_id, l1 AS line1, l2 AS line2, replace(substr(l1,1,2),'<','') AS document_type, substr(l1,3,3) AS issuing_country,
  trim(replace(split_part(names,'<<',1),'<',' ')) AS surname,
  CASE WHEN strpos(names,'<<')>0 THEN trim(replace(substr(names,strpos(names,'<<')+2),'<',' ')) ELSE '' END AS given_names,
  replace(substr(l2,1,9),'<','') AS document_number, number_valid, substr(l2,11,3) AS nationality,
  {_day(14, "CASE WHEN substr(l2,14,2) > '26' THEN '19' ELSE '20' END")} AS date_of_birth, birth_valid, substr(l2,21,1) AS sex,
  {_day(22, "'20'")} AS expiry_date, expiry_valid, replace(substr(l2,29,14),'<','') AS personal_number,
  number_valid AND birth_valid AND expiry_valid AS valid,
  3-number_valid::INT-birth_valid::INT-expiry_valid::INT AS n_warnings FROM checked)"""

_CLASS_ROWS = ", ".join(f"('{c}','{k}')" for c, k in CATEGORY_CLASS.items() if k)
_CLASSES = f"classes(category, class) AS (VALUES {_CLASS_ROWS})"
_HELD = f"{i.CATEGORY_READS}, {_CLASSES}, held AS (SELECT doc_id, class FROM category_reads JOIN classes USING (category) WHERE issue<>'' OR expiry<>'')"

# what the card of each customer holds, field by field
_CARD = f"""{i.CARD_WORDS}, fields AS (
SELECT c_custkey AS doc_id, f.field_key, f.words, CASE f.field_key
  WHEN '1' THEN CASE WHEN c_custkey%6=0 THEN '' ELSE '' END||c_mktsegment
  WHEN '2' THEN 'GIVEN NAME'
  WHEN '3' THEN '01/02/1980 TOWN'||CAST(c_nationkey AS VARCHAR)
  WHEN '4a' THEN CASE c_custkey%3 WHEN 0 THEN '01/02/2025' WHEN 1 THEN '15/06/2021' ELSE '1X/02/2020' END
  WHEN '4b' THEN '08/09/2030' WHEN '4c' THEN 'CENTRAL OFFICE' WHEN '5' THEN lpad(CAST(c_custkey AS VARCHAR),7,'0')
  WHEN '8' THEN 'STREET TOWN'||CAST(c_nationkey AS VARCHAR) WHEN '13a' THEN 'XLAND'
  WHEN '13b' THEN CASE c_custkey%4 WHEN 0 THEN 'A+' WHEN 1 THEN 'O+' WHEN 2 THEN 'A+' ELSE 'AB-' END
  WHEN '13c' THEN 'PARENT' WHEN '13d' THEN '' ELSE CASE WHEN c_custkey%2=0 THEN 'M' ELSE 'F' END END AS value,
  c_custkey%9=0 AS unaligned, f.field_key='4a' AND c_custkey%3=2 AS odd
FROM customer CROSS JOIN (VALUES ('1',[0,1]),('2',[2,3]),('3',[4,5,6]),('4a',[7,8]),('4b',[9,10,11,12,13,14]),('4c',[15,16,17]),
  ('5',[18,19]),('8',[20,21,22]),('13a',[23,24]),('13b',[25,26]),('13c',[27,28]),('13d',[]::INT[]),('15',[29])) AS f(field_key, words)),
means AS (SELECT f.doc_id, f.field_key, sum(CAST(CAST(conf AS VARCHAR) AS DECIMAL(38,20)))::DOUBLE/count(*) AS m
  FROM fields f JOIN card_words w ON f.doc_id=w.doc_id AND list_contains(f.words, w.word_no) GROUP BY 1, 2)"""

_mod = lambda m, k: f"CASE WHEN app_id%{m}=0 THEN '' ELSE '{k}:'||CAST(app_id AS VARCHAR) END"
# a read that is not flagged stays unflagged even where it is blank
_own = {k: (_mod(m, k), f"app_id%{m}=1") for k, m in _LICENCE.items()}


def _merged_sql() -> str:
    rows = []

    def add(key: str, value: str, flagged: str, source: str) -> None:
        rows.append(f"SELECT app_id, '{key}' AS field_key, {value} AS value, {flagged} AS flagged, {source} AS source FROM sides")

    def first(key: str, value: str, flagged: str, other: str, other_flagged: str) -> None:
        add(key, f"CASE WHEN {value}<>'' THEN {value} ELSE {other} END",
            f"CASE WHEN {value}<>'' THEN {flagged} WHEN {other}<>'' THEN {other_flagged} ELSE TRUE END",
            f"CASE WHEN {value}<>'' THEN 'passport' WHEN {other}<>'' THEN 'license' ELSE '' END")

    v3, _ = _own["3"]
    vc, fc = _own["13c"]
    first("Surname", "passport_surname", "passport_flagged", "licence_surname", "licence_flagged")
    first("First Name", "CASE WHEN app_id%8<>0 THEN 'G'||app_id ELSE '' END", "passport_flagged", *_own["2"])
    first("Father''s Name", "CASE WHEN app_id%4<>0 THEN 'F'||app_id ELSE '' END", "app_id%3=1",
          f"CASE WHEN app_id%3=0 THEN '' ELSE {vc} END", fc)
    add("Mother''s Name", "''", "TRUE", "''")
    first("Date of B.", "CASE WHEN birth_ok AND app_id%9<>0 THEN '01/02/1990' ELSE '' END", "FALSE", v3, "TRUE")
    first("Place of B.", "CASE WHEN app_id%6<>0 THEN 'TOWN' ELSE '' END", "app_id%5=2", v3, "TRUE")
    for key, k in source_merge.LICENCE_ONLY.items():
        value, flagged = _own[k]
        add(key, value, flagged, f"CASE WHEN {value}<>'' THEN 'license' ELSE '' END")
    add("Original Document.Category", "CASE WHEN back_error THEN '' ELSE classes END",
        "back_error OR classes='' OR app_id%12=0", "CASE WHEN back_error THEN '' ELSE 'license' END")
    for key in forms.NEVER_FILLED:
        add(key, "''", "FALSE", "''")
    return f"""{_HELD}, {i.SOURCE_READS}, joined_classes AS (SELECT doc_id, string_agg(DISTINCT class, ', ' ORDER BY class) AS classes FROM held GROUP BY doc_id),
sides AS (SELECT s.*, coalesce(classes,'') AS classes FROM source_reads s LEFT JOIN joined_classes ON doc_id=app_id),
merged AS ({' UNION ALL '.join(rows)})"""


_MERGED = _merged_sql()


def _autofill_sql() -> str:
    rows = []
    keys = ["1", "2", "3", "4a", "4b", "4c", "5", "8", "13b", "13c"]

    def add(key: str, value: str, flagged: str, source: str) -> None:
        rows.append(f"SELECT app_id, '{key}' AS field_key, {value} AS value, {flagged} AS flagged, {source} AS source, errors FROM sides")

    def first(key: str, value: str, flagged: str, other: str, mark: bool = False) -> None:
        licence = "TRUE" if mark else f"v{other}='' OR f{other}"
        add(key, f"CASE WHEN {value}<>'' THEN {value} ELSE v{other} END", f"CASE WHEN {value}<>'' THEN {flagged} ELSE {licence} END",
            f"CASE WHEN {value}<>'' THEN 'passport' WHEN v{other}<>'' THEN 'license' ELSE '' END")

    first("Surname", "surname", "names_flagged", "1")
    first("First Name", "given_names", "names_flagged", "2")
    first("Father''s Name", "father", "FALSE", "13c")
    add("Mother''s Name", "''", "TRUE", "''")
    first("Date of B.", "birth", "FALSE", "3", True)
    first("Place of B.", "place", "FALSE", "3", True)
    for key, k in source_merge.LICENCE_ONLY.items():
        add(key, f"v{k}", f"f{k}", f"CASE WHEN v{k}<>'' THEN 'license' ELSE '' END")
    add("Original Document.Category", "CASE WHEN no_back THEN '' ELSE classes END", "no_back OR classes=''", "CASE WHEN no_back THEN '' ELSE 'license' END")
    for key in forms.NEVER_FILLED:
        add(key, "''", "FALSE", "''")
    wide = ", ".join(f"max(value) FILTER (field_key='{k}') AS v{k}, bool_or(flagged) FILTER (field_key='{k}') AS f{k}" for k in keys)
    whole = ", ".join(f"coalesce(v{k},'') AS v{k}, coalesce(f{k},TRUE) AS f{k}" for k in keys)
    return f"""{_PARSED}, {i.MRZ_WORDS}, zone_means AS (SELECT doc_id, sum(CAST(CAST(conf AS VARCHAR) AS DECIMAL(38,20)))::DOUBLE/count(*) AS zm FROM mrz_words GROUP BY doc_id),
{_CARD}, {_CLASSES},
p AS (SELECT CASE WHEN c_custkey%10=3 THEN c_custkey+1000000000 ELSE c_custkey END AS app_id, surname, given_names, NOT valid OR zm < 0.6 AS names_flagged,
  CASE WHEN birth_valid THEN coalesce(date_of_birth,'') ELSE '' END AS birth, 'PARENT'||CAST(c_custkey%97 AS VARCHAR) AS father,
  'TOWN'||CAST(c_nationkey AS VARCHAR)||CASE WHEN c_custkey%13=0 THEN '' ELSE ' noise' END AS place,
  CASE WHEN c_custkey%34=0 THEN 'unreadable; blurred' WHEN c_custkey%17=0 THEN 'blurred' END AS p_error
  FROM customer JOIN parsed ON parsed.doc_id=c_custkey JOIN zone_means ON zone_means.doc_id=c_custkey),
reads AS (SELECT doc_id AS app_id, field_key, CASE WHEN lost THEN '' ELSE value END AS value,
  lost OR coalesce(m, 0.0) < 0.6 OR (value='' AND field_key<>'13b') OR unaligned OR odd AS flagged
  FROM (SELECT *, field_key='5' AND doc_id%19=0 AS lost FROM fields LEFT JOIN means USING (doc_id, field_key))),
f AS (SELECT app_id, {wide}, CASE WHEN app_id%19=0 THEN 'region lost' END AS f_error FROM reads GROUP BY app_id),
cells AS (SELECT DISTINCT l_orderkey AS app_id, {list(CATEGORY_CLASS)}[(l_partkey%11+1)::INT] AS category FROM lineitem WHERE l_partkey%3<>0 OR l_suppkey%3<>0),
b AS (SELECT o_orderkey AS app_id, coalesce(c,'') AS classes, CASE WHEN o_orderkey%12=0 THEN 'no table found' END AS b_error FROM orders LEFT JOIN (
  SELECT app_id, string_agg(DISTINCT class, ', ' ORDER BY class) AS c FROM cells JOIN classes USING (category) GROUP BY app_id) x ON x.app_id=o_orderkey),
sides AS (SELECT app_id, coalesce(surname,'') AS surname, coalesce(given_names,'') AS given_names, coalesce(names_flagged,TRUE) AS names_flagged, coalesce(birth,'') AS birth,
  coalesce(father,'') AS father, coalesce(place,'') AS place, {whole}, coalesce(classes,'') AS classes, classes IS NULL OR b_error IS NOT NULL AS no_back,
  concat_ws('; ', 'Passport: '||p_error, 'License front: '||f_error, 'License back: '||b_error) AS errors
  FROM p FULL JOIN f USING (app_id) FULL JOIN b USING (app_id)),
filled_form AS ({' UNION ALL '.join(rows)})"""


_MASK = "field_key <> 'Original Document.Place of Issue'"

QUERIES = {
    "f11_mrz_candidates": (_candidates, f"WITH {_CANDIDATES} SELECT * FROM candidates"),
    "t3_last_two": (_last_two, f"WITH {_PAIRS} SELECT * FROM zones"),
    "p1_validate_mrz": (_validate, f"""WITH {_PARSED}, {i.MRZ_WORDS}, means AS (SELECT doc_id,
  sum(CAST(CAST(conf AS VARCHAR) AS DECIMAL(38,20)))::DOUBLE/count(*) AS m FROM mrz_words GROUP BY doc_id)
SELECT p.* EXCLUDE (n_warnings), CAST(strptime(date_of_birth,'%d/%m/%Y') AS DATE) AS birth_day, CAST(strptime(expiry_date,'%d/%m/%Y') AS DATE) AS expiry_day,
  concat_ws('; ', CASE WHEN NOT number_valid THEN 'document number fails its check digit' END, CASE WHEN NOT birth_valid THEN 'date of birth fails its check digit' END,
    CASE WHEN NOT expiry_valid THEN 'date of expiry fails its check digit' END) AS warnings,
  NOT valid OR m < 0.6 AS names_flagged, NOT valid OR m < 0.6 AS review, m AS avg_conf, '' AS error FROM parsed p JOIN means USING (doc_id)
UNION ALL BY NAME SELECT doc_id+1000000000 AS doc_id, '' AS warnings, TRUE AS names_flagged, TRUE AS review, 0.0::DOUBLE AS avg_conf, 'no two MRZ lines found' AS error FROM mrz_pages"""),
    "p1_zone_readings": (_zone_readings, f"""WITH {i.MRZ_PAGES}
SELECT doc_id, CASE WHEN doc_id%2=0 THEN 1 WHEN doc_id%3<>0 THEN 2 END AS attempt, CASE WHEN doc_id%2=0 OR doc_id%3<>0 THEN full_text END AS full_text FROM mrz_pages"""),
    "a12_mrz_quality": (_quality, f"""WITH {_PARSED} SELECT issuing_country, count(*) AS documents,
  count(*) FILTER (number_valid)/count(*) AS number_valid_share, count(*) FILTER (birth_valid)/count(*) AS birth_valid_share,
  count(*) FILTER (expiry_valid)/count(*) AS expiry_valid_share FROM parsed GROUP BY issuing_country"""),
    # father: below its label, else between neighbours (every fourth page),
    # else between the given name and the nationality (every eighth)
    "p2_extract_labelled": (_labelled, """
SELECT c_custkey AS doc_id, 'father_name' AS field_key, 'PARENT'||CAST(c_custkey%97 AS VARCHAR) AS value, 0.9::DOUBLE AS conf,
  CASE WHEN c_custkey%8=0 THEN 3 WHEN c_custkey%4=0 THEN 2 ELSE 1 END AS tier, FALSE AS flagged FROM customer
UNION ALL SELECT c_custkey, 'place_of_birth', 'TOWN'||CAST(c_nationkey AS VARCHAR)||CASE WHEN c_custkey%13=0 THEN '' ELSE ' noise' END,
  0.9::DOUBLE, CASE WHEN c_custkey%5=0 THEN 2 ELSE 1 END, FALSE FROM customer"""),
    "p3_extract_layout": (_layout, f"""WITH {_CARD} SELECT f.doc_id, f.field_key, f.value, coalesce(m, 0.0::DOUBLE) AS conf,
  coalesce(m, 0.0) < 0.6 OR (f.value='' AND f.field_key<>'13b') OR unaligned OR odd AS flagged,
  CASE WHEN f.field_key IN ('4a','4b') AND regexp_matches(f.value, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') THEN CAST(CAST(try_strptime(f.value, '%d/%m/%Y') AS DATE) AS VARCHAR) END AS typed FROM fields f LEFT JOIN means USING (doc_id, field_key)"""),
    # words of a cell in two rows; those at one place are detections of one word, of which the best stays
    "p4_extract_categories": (_categories, f"""WITH {i.BACK_WORDS}, placed AS (SELECT doc_id, (y0-120)//50 AS c, (y0-120)%50 AS line, x0=540 AS issue,
  text, row_number() OVER (PARTITION BY doc_id, x0, y0 ORDER BY conf DESC, word_no) AS nth FROM back_words SEMI JOIN orders ON doc_id=o_orderkey),
cells AS (SELECT doc_id, c, string_agg(text, ' ' ORDER BY line) FILTER (issue) AS issue, string_agg(text, ' ' ORDER BY line) FILTER (NOT issue) AS expiry
  FROM placed WHERE nth=1 GROUP BY doc_id, c)
SELECT doc_id, {list(CATEGORY_CLASS)}[(c+1)::INT] AS category, coalesce(issue,'') AS issue, coalesce(expiry,'') AS expiry FROM cells"""),
    "j3_map_categories": (_map_categories, f"WITH {i.CATEGORY_READS}, {_CLASSES} SELECT doc_id, row_no, category, class, issue, expiry FROM category_reads JOIN classes USING (category)"),
    "a8_held_classes": (_held_classes, f"""WITH {_HELD}, agg AS (SELECT doc_id, string_agg(DISTINCT class, ', ' ORDER BY class) AS c FROM held GROUP BY doc_id)
SELECT o_orderkey AS doc_id, coalesce(c,'') AS classes, c IS NULL OR o_orderkey%13=0 AS flagged FROM orders LEFT JOIN agg ON doc_id=o_orderkey"""),
    "j9_never_held": (_never_held, f"""WITH {i.CATEGORY_READS} SELECT doc_id, category FROM category_reads
GROUP BY doc_id, category HAVING NOT bool_or(issue<>'' OR expiry<>'')"""),
    "p5_merge_sources": (_merge, f"WITH {_MERGED} SELECT * FROM merged"),
    "p5_autofill": (_autofill, f"""WITH {_autofill_sql()} SELECT *, count(*) FILTER (field_key <> 'Original Document.Place of Issue' AND value<>'') OVER (PARTITION BY app_id) AS filled,
  count(*) FILTER (field_key <> 'Original Document.Place of Issue' AND flagged) OVER (PARTITION BY app_id) AS n_flagged FROM filled_form"""),
    "p5_merge_errors": (_merge_errors, """SELECT c_custkey AS app_id, concat_ws('; ', CASE WHEN c_custkey%17=0 THEN 'Passport: unreadable' END,
  CASE WHEN c_custkey%19=0 THEN 'License front: no card found' END, CASE WHEN c_custkey%10=0 THEN 'License back: no table found' END) AS errors FROM customer"""),
    "f6_applicable_fields": (_applicable, f"WITH {_MERGED} SELECT app_id, field_key, value, flagged, source FROM merged WHERE {_MASK} AND (value<>'' OR flagged)"),
    "a6_run_summary": (_run_summary, f"""WITH {_MERGED} SELECT app_id, count(*) FILTER ({_MASK} AND value<>'') AS filled,
  count(*) FILTER ({_MASK} AND flagged) AS flagged FROM merged GROUP BY app_id"""),
    "a7_collect_errors": (_collect_errors, """WITH e AS (SELECT user_id AS doc_id, event_type||' '||CAST(event_id%3 AS VARCHAR) AS error, min(event_id) AS no
  FROM events WHERE event_type<>'view' GROUP BY 1, 2) SELECT doc_id, string_agg(error, '; ' ORDER BY no) AS errors FROM e GROUP BY doc_id"""),
}
