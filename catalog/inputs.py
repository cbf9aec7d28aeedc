"""Inputs derived from the test tables, the same way in Spark and in DuckDB.

The tables hold no boxes, zones or audit lines, so every query derives what it
needs from whole tables. ``*_SQL`` strings run in both engines unless they are
named for one."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = date(2026, 1, 1)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of a table in one part, each of which becomes up to thirty words.
_ROWS = 1 << 14
#: Rows of a table in one part that stay one row each.
_SINGLE_ROWS = 1 << 18


def dealt_rows(rows: DataFrame, key: str, per_part: int = _ROWS) -> DataFrame:
    """Rows dealt out by their key before each becomes many: a small file is one split,
    and what is made of a split would be sorted by one task. The number of parts grows
    with the rows, which are counted from the files' footers."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, rows.count() // per_part), key)


def run(spark: SparkSession, sf: str, sql: str, *names: str, by: str | None = None) -> DataFrame:
    """Run SQL that names its tables plainly; with ``by``, over rows dealt out by it."""
    bound = {n: table(spark, sf, n) for n in names}
    if by is not None:
        bound = {n: dealt_rows(t, by) for n, t in bound.items()}
    for n in names:
        sql = sql.replace(f" {n}\n", f" {{{n}}}\n").replace(f" {n} ", f" {{{n}}} ")
    return spark.sql(sql, **bound)


# --- words: documents → word boxes; word_no is unique and in page order
_WORD_COLUMNS = """
SELECT doc_id, CAST(line_no AS BIGINT)*1000000+word_no AS word_no, text,
  CAST(coalesce(sum(length(text)+1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)*10 AS INT) AS x0,
  CAST(line_no*20+(word_no*7+doc_id)%3 AS INT) AS y0,
  CAST(line_no*20+(word_no*7+doc_id)%3+12 AS INT) AS y1,
  CAST((doc_id*7+line_no*13+word_no*31)%129 AS DOUBLE)/128 AS conf
"""
_SPARK_WORDS = _WORD_COLUMNS.replace("doc_id, ", "doc_id, {carried}", 1) + """
FROM (SELECT doc_id, {carried}line_no, word_no, wd AS text
  FROM (SELECT doc_id, {carried}line_no, ln FROM {dealt}
        LATERAL VIEW posexplode(split(text, chr(10))) a AS line_no, ln)
  LATERAL VIEW posexplode(split(ln, ' ')) b AS word_no, wd
  WHERE length(wd) > 0)
"""
_DUCK_WORDS = _WORD_COLUMNS + """
FROM (SELECT doc_id, line_no, unnest(ws) AS text, generate_subscripts(ws,1)-1 AS word_no
  FROM (SELECT doc_id, line_no, string_split(ln,' ') AS ws
    FROM (SELECT doc_id, unnest(ls) AS ln, generate_subscripts(ls,1)-1 AS line_no
      FROM (SELECT doc_id, string_split(text,chr(10)) AS ls FROM documents))))
WHERE length(text) > 0
"""
_X1 = "SELECT doc_id, word_no, text, conf, x0, y0, CAST(x0+length(text)*10 AS INT) AS x1, y1 FROM"
WORDS = f"words AS ({_X1} ({_DUCK_WORDS}))"

# words with further detections of some of them: a weaker one beside the word, a
# chain of two in which only neighbours overlap by half, a copy of the same box and
# confidence, and a box as large as the page
_STEP = "CAST(floor((x1-x0)/4.0) AS INT)"
_DOUBLED = f"""
SELECT doc_id, word_no, text, conf, x0, y0, x1, y1 FROM words
UNION ALL
SELECT doc_id, word_no+500000, text, conf/2, x0+1, y0, x1+1, y1 FROM words WHERE (doc_id+word_no)%17=0
UNION ALL
SELECT doc_id, word_no+600000, text, conf/2, x0+{_STEP}, y0, x1+{_STEP}, y1 FROM words WHERE (doc_id+word_no)%19=0
UNION ALL
SELECT doc_id, word_no+700000, text, conf/4, x0+2*{_STEP}+1, y0, x1+2*{_STEP}+1, y1 FROM words WHERE (doc_id+word_no)%19=0
UNION ALL
SELECT doc_id, word_no+800000, text, conf, x0, y0, x1, y1 FROM words WHERE (doc_id+word_no)%23=0
UNION ALL
SELECT doc_id, -1, 'page', CAST(1 AS DOUBLE), 0, 0, 100000, 100000 FROM words GROUP BY doc_id
"""
DOUBLED = f"{WORDS}, doubled AS ({_DOUBLED})"


#: Bytes of the documents' files in one part: some million words.
_DEALT = 4 << 20


def _dealt(documents: DataFrame) -> DataFrame:
    """The documents dealt out by id while they are whole texts: windows and groups of a
    document's words then need no shuffle of words. The number of parts grows with the
    table, so a part holds as many words at any size."""
    size = documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.repartition(max(least, int(size) // _DEALT), "doc_id")


def words(spark: SparkSession, sf: str, *carried: str) -> DataFrame:
    """The words, each with the columns ``carried`` of its document."""
    more = "".join(f"{c}, " for c in carried)
    sql = f"{_X1.replace('doc_id, ', f'doc_id, {more}', 1)} ({_SPARK_WORDS.replace('{carried}', more)})"
    return spark.sql(sql, dealt=_dealt(table(spark, sf, "documents").select("doc_id", "text", *carried)))


def doubled(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``_DOUBLED``, each word with its further detections, and the first of
    a page with the page's box: a union would deal all rows out anew."""
    first = F.col("word_no") == F.min("word_no").over(Window.partitionBy("doc_id"))
    key, step, conf = F.col("doc_id") + F.col("word_no"), F.expr(_STEP), F.col("conf")
    box = lambda x0, y0, x1, y1: [c.cast("int").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))]
    row = lambda no, text, conf, *at: F.struct(no.cast("long").alias("word_no"), text.alias("text"), conf.alias("conf"), *box(*at))
    moved = lambda no, conf, by: row(F.col("word_no") + no, F.col("text"), conf, F.col("x0") + by, F.col("y0"), F.col("x1") + by, F.col("y1"))
    every = F.array_compact(F.array(
        moved(0, conf, F.lit(0)), F.when(key % 17 == 0, moved(500000, conf / 2, F.lit(1))),
        F.when(key % 19 == 0, moved(600000, conf / 2, step)), F.when(key % 19 == 0, moved(700000, conf / 4, 2 * step + 1)),
        F.when(key % 23 == 0, moved(800000, conf, F.lit(0))),
        F.when(F.col("_first"), row(F.lit(-1), F.lit("page"), F.lit(1.0), F.lit(0), F.lit(0), F.lit(100000), F.lit(100000))),
    ))
    return words(spark, sf).withColumn("_first", first).select("doc_id", F.inline(every))


# --- zones: customer → page text with a machine-readable zone
_MRZ_PARTS = """
SELECT c_custkey AS doc_id,
  'X'||substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ',CAST(1+c_nationkey%26 AS INT),1)||'Z' AS cc,
  rpad('P<X'||substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ',CAST(1+c_nationkey%26 AS INT),1)||'Z'
    ||c_mktsegment||'<<GIVEN<'||replace(c_name,'#','<'),44,'<') AS line1,
  lpad(CAST(c_custkey AS STRING),9,'0') AS doc,
  CASE WHEN c_custkey%7=0 THEN replace(lpad(CAST(c_custkey AS STRING),9,'0'),'0','O')
    ELSE lpad(CAST(c_custkey AS STRING),9,'0') END AS doc_ocr,
  lpad(CAST(c_custkey%100 AS STRING),2,'0')||lpad(CAST(1+c_custkey%12 AS STRING),2,'0')
    ||lpad(CAST(1+c_custkey%28 AS STRING),2,'0') AS dob,
  CAST(24+c_custkey%12 AS STRING)||lpad(CAST(1+c_custkey%12 AS STRING),2,'0')
    ||lpad(CAST(1+c_custkey%28 AS STRING),2,'0') AS exp,
  CASE WHEN c_custkey%2=0 THEN 'M' ELSE 'F' END AS sex,
  c_custkey%11=0 AS swapped
FROM customer
"""
_ALPHABET = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def duck_cd(s: str) -> str:
    """Check digit of a string expression in DuckDB."""
    return (
        f"list_sum(list_transform(range(0,length({s})), lambda i: "
        f"greatest(strpos({_ALPHABET},substr({s},i+1,1))-1,0)*[7,3,1][(i%3+1)::INT]))%10"
    )


def _spark_cd(s: str) -> str:
    return (
        f"aggregate(transform(sequence(0,length({s})-1), i -> greatest(instr({_ALPHABET},substr({s},i+1,1))-1,0)"
        f"*element_at(array(7,3,1),i%3+1)),0,(a,x)->a+x)%10"
    )


def _mrz_pages(cd) -> str:
    digit = lambda s: f"CAST({cd(s)} AS STRING)"
    line2 = f"doc_ocr||{digit('doc')}||cc||dob||{digit('dob')}||sex||exp||{digit('exp')}||rpad('',14,'<')||'00'"
    return f"""
SELECT doc_id, 'Republic of Somewhere'||chr(10)||'noise that is no zone ..............'||chr(10)||
  CASE WHEN swapped THEN line2||chr(10)||line1 ELSE line1||chr(10)||line2 END AS full_text
FROM (SELECT *, {line2} AS line2 FROM mrz_parts )
"""


MRZ_PAGES = f"mrz_parts AS ({_MRZ_PARTS}), mrz_pages AS ({_mrz_pages(duck_cd)})"


def mrz_pages(spark: SparkSession, sf: str) -> DataFrame:
    parts = run(spark, sf, _MRZ_PARTS, "customer")
    return spark.sql(_mrz_pages(_spark_cd).replace("mrz_parts", "{parts}"), parts=parts)


# --- zone words: customer → confidences of the words of a zone
_MRZ_WORDS = """
SELECT c_custkey AS doc_id, t.word_no, CAST((c_custkey*3+t.word_no*17)%129 AS DOUBLE)/128 AS conf
FROM customer CROSS JOIN (VALUES (0),(1),(2)) AS t(word_no)
"""
MRZ_WORDS = f"mrz_words AS ({_MRZ_WORDS})"


def mrz_words(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _MRZ_WORDS, "customer")


# --- label words: customer → two-column pages of labels and values
_LABEL_WORDS = """
SELECT c_custkey AS doc_id, t.word_no, t.x0, t.y0, t.x0+t.w AS x1, t.y0+14 AS y1,
  CASE t.kind WHEN 'G' THEN 'GIVEN'||CAST(c_custkey AS STRING)
    WHEN 'F' THEN 'PARENT'||CAST(c_custkey%97 AS STRING)
    WHEN 'P' THEN 'TOWN'||CAST(c_nationkey AS STRING) ELSE t.text END AS text,
  CAST(CASE WHEN c_custkey%13=0 AND t.kind='N' THEN 0.5 ELSE 0.9 END AS DOUBLE) AS conf
FROM customer CROSS JOIN (VALUES
  (0,'L','Republic',100,20,80),(1,'L','First',100,60,50),(2,'L','name',156,60,40),
  (3,'G','',100,90,80),(4,'L','Father',100,130,60),(5,'L','name',166,130,40),
  (6,'F','',100,160,90),(7,'L','Nationality',100,200,100),(8,'A','ANCHORLAND',100,230,100),
  (9,'L','Place',100,270,50),(10,'L','of',156,270,20),(11,'L','birth',182,270,50),
  (12,'P','',100,300,70),(13,'N','noise',176,300,50),(14,'C','Authority',500,160,90),
  (15,'C','99/99/9999',500,300,90),
  (16,'D','ANCHORLAND',100,0,100)) AS t(word_no,kind,text,x0,y0,w)
WHERE NOT (c_custkey%4=0 AND t.word_no IN (4,5)) AND NOT (c_custkey%8=0 AND t.word_no IN (1,2))
  AND NOT (c_custkey%5=0 AND t.word_no=11)
"""
LABEL_WORDS = f"label_words AS ({_LABEL_WORDS})"


def label_words(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _LABEL_WORDS, "customer", by="c_custkey")


# --- card words: customer → the front of a card of 1000 x 600 pixels
_CARD_WORDS = """
SELECT c_custkey AS doc_id, t.word_no,
  CASE t.kind
    WHEN 'SURNAME' THEN c_mktsegment
    WHEN 'NUMBER' THEN lpad(CAST(c_custkey AS STRING),7,'0')
    WHEN 'TOWN' THEN 'TOWN'||CAST(c_nationkey AS STRING)
    WHEN 'ISSUED' THEN CASE c_custkey%3 WHEN 0 THEN '0I/O2/2Q2S' WHEN 1 THEN '15/06/2021' ELSE '1X/02/2020' END
    WHEN 'GROUP0' THEN CASE WHEN c_custkey%4=0 THEN '13b.4' ELSE '13b.' END
    WHEN 'GROUP1' THEN CASE c_custkey%4 WHEN 0 THEN '+' WHEN 1 THEN '0+' WHEN 2 THEN 'At' ELSE 'AB-' END
    WHEN 'SEX' THEN CASE WHEN c_custkey%2=0 THEN 'M' ELSE 'F' END
    ELSE t.text END AS text,
  CAST((52+(c_custkey*5+t.word_no)%77) AS DOUBLE)/128 AS conf,
  t.x0, t.y0, t.x0+t.w AS x1, t.y0+14 AS y1
FROM customer CROSS JOIN (VALUES
  (0,'L','1.',335,155,12),(1,'SURNAME','',400,155,90),
  (2,'L','GIVEN',400,205,60),(3,'L','NAME',470,206,50),
  (4,'L','3.',360,258,12),(5,'L','01/02/1980',420,258,90),(6,'TOWN','',520,258,60),
  (7,'L','4a',358,296,20),(8,'ISSUED','',430,296,90),
  (9,'L','4b',362,335,20),(10,'L','DB',430,335,20),(11,'L','/',455,335,5),(12,'L','09',465,335,20),
  (13,'L','/',490,335,5),(14,'L','2O3O',500,335,40),
  (15,'L','4c',360,366,20),(16,'L','CENTRAL',420,366,70),(17,'L','OFFICE',500,366,60),
  (18,'L','5',725,100,10),(19,'NUMBER','',780,100,90),
  (20,'L','8',355,470,10),(21,'L','STREET',380,470,60),(22,'TOWN','',450,471,60),
  (23,'L','13a',365,400,30),(24,'L','XLAND',440,400,60),
  (25,'GROUP0','',750,396,40),(26,'GROUP1','',810,396,20),
  (27,'L','13c',366,440,30),(28,'L','PARENT',420,440,60),
  (29,'SEX','',800,362,12)) AS t(word_no,kind,text,x0,y0,w)
WHERE NOT (c_custkey%6=0 AND t.word_no IN (0,20))
"""
CARD_WORDS = f"card_words AS ({_CARD_WORDS})"
_CARD_SIZES = "SELECT c_custkey AS doc_id, 1000 AS width, 600 AS height, c_custkey%9=0 AS unaligned FROM customer "


def card_words(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _CARD_WORDS, "customer", by="c_custkey")


def card_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _CARD_SIZES, "customer")


# --- category reads: lineitem → cells of the table on the back
_CATEGORY_READS = """
SELECT l_orderkey AS doc_id, l_linenumber AS row_no,
  CASE l_partkey%11 WHEN 0 THEN 'A1' WHEN 1 THEN 'A' WHEN 2 THEN 'B1' WHEN 3 THEN 'B' WHEN 4 THEN 'C1'
    WHEN 5 THEN 'C' WHEN 6 THEN 'CE' WHEN 7 THEN 'D1' WHEN 8 THEN 'D' WHEN 9 THEN 'agri' ELSE 'plant' END AS category,
  CASE WHEN l_partkey%3=0 THEN '' ELSE '1/2/2020' END AS issue,
  CASE WHEN l_suppkey%3=0 THEN '' ELSE '1/2/2030' END AS expiry
FROM lineitem
"""
CATEGORY_READS = f"category_reads AS ({_CATEGORY_READS})"


def category_reads(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _CATEGORY_READS, "lineitem")


# --- back words: lineitem → the table on the back, 1000 x 1000 pixels
_BACK_WORDS = """
SELECT l_orderkey AS doc_id, ((l_partkey*100000000+l_suppkey)*10+l_linenumber)*2+t.side AS word_no,
  CASE WHEN t.side=0 THEN '1/2/20' ELSE '1/2/30' END||CAST(l_linenumber%10 AS STRING) AS text,
  CAST((l_linenumber*7+t.side)%101 AS DOUBLE)/100 AS conf,
  CASE WHEN t.side=0 THEN 540 ELSE 400 END AS x0,
  CAST(120+50*(l_partkey%11)+(l_linenumber-1)%2*20 AS INT) AS y0,
  CASE WHEN t.side=0 THEN 540 ELSE 400 END+60 AS x1,
  CAST(120+50*(l_partkey%11)+(l_linenumber-1)%2*20+12 AS INT) AS y1
FROM lineitem CROSS JOIN (VALUES (0),(1)) AS t(side)
WHERE (t.side=0 AND l_partkey%3<>0) OR (t.side=1 AND l_suppkey%3<>0)
"""
BACK_WORDS = f"back_words AS ({_BACK_WORDS})"


def back_words(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _BACK_WORDS, "lineitem", by="l_orderkey")


def back_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))


# --- sides: customer → the three sides of an application
_SOURCE_READS = """
SELECT c_custkey AS app_id,
  CASE WHEN c_custkey%5=0 THEN '' ELSE 'P'||c_name END AS passport_surname,
  c_custkey%6=0 AS passport_flagged,
  CASE WHEN c_custkey%3=0 THEN '' ELSE 'L'||c_name END AS licence_surname,
  c_custkey%4=0 AS licence_flagged,
  c_custkey%7<>0 AS birth_ok, c_custkey%10=0 AS back_error
FROM customer
"""
SOURCE_READS = f"source_reads AS ({_SOURCE_READS})"


def source_reads(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _SOURCE_READS, "customer", by="c_custkey")


# --- registry: orders and customer → records as key and value, and changes
_RECORD_KV = """
SELECT o_orderkey AS id, 'Surname' AS k, CASE WHEN o_orderkey%31=0 THEN ' ' ELSE c_mktsegment END AS v
  FROM orders JOIN customer ON o_custkey=c_custkey
UNION ALL SELECT o_orderkey, 'First Name', c_name FROM orders JOIN customer ON o_custkey=c_custkey
UNION ALL SELECT o_orderkey, 'Issued Document.Number',
  CASE WHEN o_orderkey%9=0 THEN '' ELSE 'D-'||lpad(CAST(o_orderkey AS STRING),6,'0') END FROM orders
UNION ALL SELECT o_orderkey, 'Receipt.Number',
  CASE WHEN o_orderkey%2=0 THEN '' ELSE lpad(CAST(o_orderkey AS STRING),6,'0') END FROM orders
UNION ALL SELECT o_orderkey, 'Original Document.Category', substr('A, B, C, D',1,CAST(1+3*(o_orderkey%4) AS INT)) FROM orders
"""
RECORD_KV = f"record_kv AS ({_RECORD_KV})"
_RECORD_CHANGES = """
SELECT CASE WHEN o_orderkey%101=0 THEN o_orderkey+10000000 ELSE o_orderkey END AS id,
  'Surname' AS k, o_orderpriority AS v FROM orders
"""
RECORD_CHANGES = f"record_changes AS ({_RECORD_CHANGES})"
_CREATED = "SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS STRING)||'T08:00:00' AS created_at FROM orders\n"
CREATED = f"created AS ({_CREATED})"
RECORDS = f"{RECORD_KV}, {CREATED}"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Records packed inside the row: one join, no grouping."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    key = F.col("o_orderkey")
    serial = F.lpad(key.cast("string"), 6, "0")
    fields = F.create_map(
        F.lit("Surname"), F.when(key % 31 == 0, " ").otherwise(F.col("c_mktsegment")),
        F.lit("First Name"), F.col("c_name"),
        F.lit("Issued Document.Number"), F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("D-"), serial)),
        F.lit("Receipt.Number"), F.when(key % 2 == 0, "").otherwise(serial),
        F.lit("Original Document.Category"), F.expr("substr('A, B, C, D',1,CAST(1+3*(o_orderkey%4) AS INT))"),
    )
    created = F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T08:00:00"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"), created.alias("created_at"), fields.alias("fields")
    )


def record_changes(spark: SparkSession, sf: str) -> DataFrame:
    kv = dealt_rows(run(spark, sf, _RECORD_CHANGES + " ", "orders"), "id", _SINGLE_ROWS)
    return kv.select("id", F.create_map("k", "v").alias("fields"))


# --- audit: events → audit events and lines
_AUDIT = """
SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'record_saved' WHEN 'click' THEN 'record_opened'
    WHEN 'view' THEN CASE event_id%3 WHEN 0 THEN 'print' WHEN 1 THEN 'receipt' ELSE 'form' END||'_rendered'
    WHEN 'purchase' THEN CASE event_id%3 WHEN 0 THEN 'print' WHEN 1 THEN 'receipt' ELSE 'form' END||'_dispatched'
    ELSE CASE event_id%3 WHEN 0 THEN 'print' WHEN 1 THEN 'receipt' ELSE 'form' END||'_dispatch_failed' END AS event,
  'u'||CAST(user_id AS STRING) AS usr,
  CASE WHEN event_id%50=0 THEN 'unsaved' ELSE CAST(event_id%200 AS STRING) END AS record_id,
  CASE event_id%4 WHEN 0 THEN 'has space' WHEN 1 THEN '' WHEN 2 THEN 'q"uote' ELSE 'plain' END AS note
FROM events
"""
AUDIT = f"audit AS ({_AUDIT})"
AUDIT_LINES = AUDIT + """, audit_lines AS (
SELECT event_id, strftime(ts,'%Y-%m-%d %H:%M:%S')||' event='||event||' user='||usr||' record_id='||record_id||' note='||
  CASE WHEN note='' THEN '""' WHEN note LIKE '% %' OR note LIKE '%"%'
    THEN '"'||replace(note,'"','\\"')||'"' ELSE note END AS value
FROM audit)"""


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _AUDIT, "events").withColumnRenamed("usr", "user")


# --- intake: events → documents of applications
_INTAKE = """
SELECT DISTINCT user_id*1000+event_id%40 AS app_id, CASE WHEN event_type IN ('view','signup') THEN 'passport'
  WHEN event_type='click' THEN 'front' ELSE 'back' END AS kind
FROM events
"""
INTAKE = f"intake AS ({_INTAKE})"


def intake(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _INTAKE, "events")


# --- accounts: customer → staff accounts
_ACCOUNTS = """
SELECT CASE c_custkey%3 WHEN 0 THEN upper(c_name) WHEN 1 THEN lower(c_name)||' ' ELSE 'Clerk '||CAST(c_nationkey AS STRING) END AS username,
  c_custkey%50=7 AS is_admin
FROM customer
"""
ACCOUNTS = f"accounts AS ({_ACCOUNTS})"


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, _ACCOUNTS, "customer")
