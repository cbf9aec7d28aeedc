"""The registered queries of this package, each with its SQL where SQL can
express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docreg.llm import bpe_automaton, conversations, curriculum, decontamination, language_id, length_histogram, near_dedup, ngram_lm, quality, spelling, topk_search, toxicity, warc
from docreg.llm.base import fold, table


def _scored(found, parts, held, *more):
    """The columns of a classifier's contract beside its own."""
    return found.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *more)


def deleted_interpolation(spark, sf_dir):
    part = fold(F.col("doc_id"), 7)
    return ngram_lm.score(ngram_lm.fit(table(spark, sf_dir, "documents"), part == 2, part == 3))


def winnowed_hits(spark, sf_dir):
    return decontamination.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxic_spans(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(toxicity.score_toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0), 5, 0, "n_toxic", F.size("spans").alias("n_spans"))


def languages(spark, sf_dir):
    found = language_id.identify_language(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 0)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def line_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(quality.score_quality(docs, labels, fold(F.col("doc_id"), 3) != 1), 3, 1, "n_lines", F.size("bad_lines").alias("n_bad_lines"))


def token_lengths(spark, sf_dir):
    return length_histogram.length_histogram(length_histogram.token_lengths(table(spark, sf_dir, "documents")))


def curriculum_mix(spark, sf_dir):
    return curriculum.mix_digest(table(spark, sf_dir, "documents"))


def exact_top_k(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def odd_sketch_groups(spark, sf_dir):
    return near_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def archived_pages(spark, sf_dir):
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def conversation_repair(spark, sf_dir):
    return conversations.repair_digest(table(spark, sf_dir, "conversations"))


def tokenization_automaton(spark, sf_dir):
    return bpe_automaton.round_trip_digest(table(spark, sf_dir, "documents"))


def pivotal_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce({0},''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"

_BENCH_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_BENCH_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR,'') AS item_id, {_BENCH_WORDS} AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(len(w),10) AS n FROM i WHERE len(w)>0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p+n-1],' ') AS win FROM (
  SELECT item_id, w, least(len(w),10) AS n, unnest(generate_series(1, len(w)-least(len(w),10)+1)) AS p FROM i WHERE len(w)>0)),
dw AS (SELECT row, n, p, array_to_string(w[p:p+n-1],' ') AS win FROM (
  SELECT row, w, n, unnest(generate_series(1, len(w)-n+1)) AS p FROM d, lengths WHERE len(w)>=n)),
hits AS (SELECT dw.row, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.win=iw.win AND dw.n=iw.n),
words AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(generate_series(p,p+n-1)) AS q FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items,
  sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)"""

CURRICULUM_SQL = f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source,'') AS source, {_WORDS.format('text')}::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR,'')) AS draw FROM documents),
totals AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
ranked AS (
  SELECT *, [3.0,1.0,2.0][place]::DOUBLE AS weight, [-2.0::DOUBLE/6.0::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE/4.0::DOUBLE][place] AS lean,
    (source_size*2)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE*1.5::DOUBLE AS demand
  FROM (SELECT *, (row_number() OVER (ORDER BY no_source, source)-1)%3+1 AS place FROM totals)),
stepped AS (
  SELECT *, cap/weight AS full_at, (demand-coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))
    /sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS step
  FROM ranked WINDOW o AS (ORDER BY cap/weight, no_source, source)),
shares AS (
  SELECT no_source, source, source_size, lean,
    least(cap, coalesce(weight*(SELECT arg_min(level, step) FROM stepped WHERE full_at>=level), cap)) AS target FROM stepped),
placed AS (
  SELECT s.*, source_size, lean, target, (sum(size) OVER (PARTITION BY s.no_source, s.source ORDER BY draw, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-size)::BIGINT AS begun
  FROM sized s JOIN shares t ON s.no_source=t.no_source AND s.source=t.source),
copies AS (
  SELECT doc_id, size, source_size, target, lean, r, draw, begun,
    greatest(least(floor(target)::BIGINT-r*source_size-begun, size), 0) AS words, (r*source_size+begun)/target AS part
  FROM placed, (VALUES (0),(1)) x(r))
SELECT doc_id, size, source_size, target, sum(words)::BIGINT AS taken,
  min(CASE WHEN words>0 THEN 2.0::DOUBLE*part/((1.0::DOUBLE-lean)+sqrt((1.0::DOUBLE-lean)*(1.0::DOUBLE-lean)+4.0::DOUBLE*lean*part)) END) AS position
FROM copies GROUP BY doc_id, size, source_size, target, draw, begun"""

TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64*x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
terms AS (SELECT row, vec_id, unnest(w) AS w, generate_subscripts(w,1) AS t FROM v),
scored AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, c.row, c.vec_id, sum(q.w*c.w)::BIGINT AS score
  FROM terms q JOIN terms c ON q.t=c.t AND q.row<>c.row WHERE q.vec_id%20=0 GROUP BY ALL)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank<=20"""

NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+2],' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w)-2,1))) AS p FROM d WHERE len(w)>0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY ALL),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s=b.s AND a.doc_id<b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id=a JOIN sizes y ON y.doc_id=b WHERE 100*k>=85*(x.n+y.n-k)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, far) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM reach r JOIN ends e ON e.a=r.far),
least AS (SELECT id, min(far) AS component_id FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n,0)::BIGINT AS n_shingles, component_id, d.doc_id=component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN least ON least.id=d.doc_id"""

ARCHIVE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html,''))::BIGINT AS payload_bytes, sha256(coalesce(html,'')) AS payload_digest FROM pages),
shared AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes>=100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id<>first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id<>first THEN first END AS refers_to
FROM p LEFT JOIN shared USING (payload_digest)"""

#: crc32 over the bytes of an ASCII or UTF-8 text, by its table of 256 remainders.
_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    """Of an SQL expression, in a query that reads the table ``crc``."""
    hexed = f"hex(encode({text}))"
    code = f"list_transform(range(0, length({hexed}), 2), lambda i: (instr('0123456789ABCDEF', substr({hexed}, i+1, 1))-1)*16 + instr('0123456789ABCDEF', substr({hexed}, i+2, 1))-1)"
    return f"xor(list_reduce([4294967295] || {code}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


SPELLING_SQL = f"""
WITH RECURSIVE {_CRC},
runs AS (SELECT coalesce(doc_id::VARCHAR,'') AS id, unnest(regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (SELECT run, h, (h % length(run))::INT AS cut FROM (SELECT run, {_crc32("id||':'||run")}::BIGINT AS h FROM runs, crc WHERE length(run)>=6)),
words AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h%199=0 THEN substr(run,1,cut)||substr(run,cut+2) ELSE run END AS word FROM hashed) WHERE length(word)>=6 GROUP BY word HAVING count(*)>=5),
gaps AS (SELECT word, length(word) AS size, p, substr(word,1,p-1) AS ahead, substr(word,p+1) AS behind FROM (SELECT word, unnest(generate_series(1, length(word))) AS p FROM words)),
near AS (SELECT DISTINCT x.word AS a, y.word AS b FROM gaps x JOIN gaps y ON x.p=y.p AND x.ahead=y.ahead AND x.behind=y.behind AND x.word<>y.word
  UNION SELECT x.word, y.word FROM gaps x JOIN words y ON x.ahead||x.behind=y.word UNION SELECT y.word, x.word FROM gaps x JOIN words y ON x.ahead||x.behind=y.word),
best AS (SELECT a AS word, count(*) AS n_near, min({{'less': -n, 'word': b}}) AS top FROM near JOIN words ON words.word=b GROUP BY a),
forms AS (SELECT w.word, n, coalesce(n_near,0)::BIGINT AS n_near, CASE WHEN -top.less>=5*n THEN top.word END AS form, CASE WHEN -top.less>=5*n THEN -top.less END AS form_n FROM words w LEFT JOIN best USING (word)),
far(word, root) AS (SELECT word, word FROM forms UNION SELECT far.word, forms.form FROM far JOIN forms ON forms.word=far.root WHERE forms.form IS NOT NULL),
ends AS (SELECT far.word, root FROM far JOIN forms ON forms.word=far.root WHERE form IS NULL)
SELECT word, form, root, n::BIGINT AS n, n_near, form_n::BIGINT AS form_n FROM forms JOIN ends USING (word)"""

_least = lambda *options: "least(" + ", ".join(options) + ")"
_edit = lambda cost, initial, state: f"{{'c': v{state}.c+{cost}, 'a': '{initial}'||v{state}.a}}"
_REROLE, _KEEP = "2+cut", "cut"
_when = lambda test, option: f"CASE WHEN {test} THEN {option} END"
_OWN = ", ".join([
    _least(_edit(3, "D", 0), _when("NOT gone", _edit(_REROLE, "R", 2)), _when("NOT gone AND i='s'", _edit(_KEEP, "K", 1)), _when("NOT gone AND i='u'", _edit(_KEEP, "K", 2))) + " AS o0",
    _least(_edit(3, "D", 1), _when("NOT gone", _edit(_REROLE, "R", 2)), _when("NOT gone AND i='u'", _edit(_KEEP, "K", 2))) + " AS o1",
    _least(_edit(3, "D", 2), _when("NOT gone", _edit(_REROLE, "R", 3)), _when("NOT gone AND i='a'", _edit(_KEEP, "K", 3))) + " AS o2",
    _least(_edit(3, "D", 3), _when("NOT gone", _edit(_REROLE, "R", 2)), _when("NOT gone AND i='u'", _edit(_KEEP, "K", 2))) + " AS o3",
])
_made = lambda cost, initials, state: f"{{'c': o{state}.c+{cost}, 'a': '{initials}'||o{state}.a}}"
REPAIR_SQL = rf"""
WITH RECURSIVE {_CRC},
hashed AS (SELECT conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text, {_crc32("coalesce(conv_id::VARCHAR,' ')||':'||coalesce(turn::VARCHAR,' ')")}::BIGINT % 20 AS h FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN h=4 THEN 'user' ELSE role END AS role, CASE WHEN h=1 THEN '' WHEN h=2 THEN translate(text,'.!?','') ELSE text END AS text,
  unnest(CASE WHEN h=3 THEN [1,2] ELSE [1] END) AS copy FROM hashed WHERE h<>0),
placed AS (SELECT *, left(role,1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn FROM hurt),
faults AS (SELECT * EXCLUDE (seen), CASE WHEN NOT regexp_matches(text,'[^ 	-
]') THEN 'blank' WHEN seen>1 THEN 'duplicate' WHEN NOT regexp_matches(text,'[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS seen FROM placed)),
steps AS (SELECT *, fault IN ('blank','duplicate') AS gone, (fault='truncated')::INT AS cut FROM faults),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault='blank') AS blank,
  count(*) FILTER (fault='duplicate') AS duplicate, count(*) FILTER (fault='truncated') AS truncated FROM faults GROUP BY conv_id),
illegal AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY rn)||i AS two FROM faults) WHERE two NOT IN ('su','ua','au') GROUP BY conv_id),
best(conv_id, rn, v0, v1, v2, v3) AS (
  SELECT conv_id, n+1, {{'c': 0, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}} FROM counts
  UNION ALL
  SELECT conv_id, rn, {_least("o0", _made(2, "I", 2), _made(4, "II", 3))}, {_least("o1", _made(2, "I", 2), _made(4, "II", 3))}, {_least("o2", _made(2, "I", 3))}, {_least("o3", _made(2, "I", 2))}
  FROM (SELECT s.conv_id, s.rn, {_OWN} FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.rn=b.rn-1)),
audits AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM best WHERE rn=1),
edits AS (SELECT *, sum((e<>'I')::INT) OVER w AS row, sum((e<>'D')::INT) OVER w - 1 - len(replace(audit,'D',''))%2 AS k
  FROM (SELECT conv_id, audit, unnest(generate_series(1,len(audit))) AS p, unnest(string_split(audit,'')) AS e FROM audits WHERE audit<>'') WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
lines AS (SELECT d.conv_id, string_agg(CASE WHEN e='K' THEN s.role WHEN k%2=0 THEN 'user' ELSE 'assistant' END||':'||CASE WHEN e='I' THEN '' ELSE s.text END, chr(10) ORDER BY p) AS repaired
  FROM edits d LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.rn=d.row WHERE e<>'D' GROUP BY d.conv_id)
SELECT a.conv_id, coalesce(gaps,0)::BIGINT AS gaps, coalesce(blank,0)::BIGINT AS blank, coalesce(duplicate,0)::BIGINT AS duplicate, coalesce(truncated,0)::BIGINT AS truncated,
  coalesce(illegal,0)::BIGINT AS illegal, coalesce(cost,0)::BIGINT AS cost, coalesce(audit,'') AS audit, sha256(coalesce(repaired,'')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN illegal i ON i.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN audits u ON u.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM a.conv_id"""

QUERIES = {
    "op1_deleted_interpolation": (deleted_interpolation, None),
    "op2_winnowed_hits": (winnowed_hits, CONTAMINATION_SQL),
    "op3_toxic_spans": (toxic_spans, None),
    "op4_languages": (languages, None),
    "op5_line_quality": (line_quality, None),
    "op7_token_lengths": (token_lengths, None),
    "op6_odd_sketch_groups": (odd_sketch_groups, NEAR_SQL),
    "op8_curriculum_mix": (curriculum_mix, CURRICULUM_SQL),
    "op9_exact_top_k": (exact_top_k, TOP_K_SQL),
    "op10_archived_pages": (archived_pages, ARCHIVE_SQL),
    "op11_conversation_repair": (conversation_repair, REPAIR_SQL),
    "op12_tokenization_automaton": (tokenization_automaton, None),
    "op13_pivotal_spelling": (pivotal_spelling, SPELLING_SQL),
}
