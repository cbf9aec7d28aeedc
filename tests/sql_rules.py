"""Two page rules as recursive SQL over (doc_id, word_no, conf, x0, y0, x1, y1), to
compare against. One row of the recursion is one word of a page, in the order of
the rule, with the state of the page after it."""

# a word, taken by its top, joins the first line whose bottom plus the slack reaches its middle
LINES = """
WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, word_no) AS pos FROM words),
walk(doc_id, pos, word_no, line_no, bottoms) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::INT[] FROM words
  UNION ALL
  SELECT doc_id, pos, word_no, fit-1, CASE WHEN fit > len(bottoms) THEN list_append(bottoms, y1)
    ELSE list_concat(list_append(bottoms[1:fit-1], greatest(bottoms[fit], y1)), bottoms[fit+1:]) END
  FROM (SELECT o.doc_id, o.pos, o.word_no, o.y1, w.bottoms,
      coalesce(list_position(list_transform(w.bottoms, lambda b: b+4 >= (o.y0+o.y1)/2.0), true), len(w.bottoms)+1) AS fit
    FROM walk w JOIN ordered o ON o.doc_id=w.doc_id AND o.pos=w.pos+1))
SELECT word_no, line_no FROM walk WHERE word_no IS NOT NULL"""

# a box goes if it overlaps by half a box that stays and comes before it
KEPT = """
WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, word_no) AS pos FROM words),
walk(doc_id, pos, word_no, goes, kept) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, NULL::BIGINT, true, []::STRUCT(a INT, b INT, c INT, d INT)[] FROM words
  UNION ALL
  SELECT doc_id, pos, word_no, goes, CASE WHEN goes THEN kept ELSE list_append(kept, {'a': x0, 'b': y0, 'c': x1, 'd': y1}) END
  FROM (SELECT o.*, w.kept, len(list_filter(w.kept, lambda k:
      greatest(least(o.x1,k.c)-greatest(o.x0,k.a),0)*greatest(least(o.y1,k.d)-greatest(o.y0,k.b),0)*3 >= (o.x1-o.x0)*(o.y1-o.y0)+(k.c-k.a)*(k.d-k.b)
      AND least(o.x1,k.c) > greatest(o.x0,k.a) AND least(o.y1,k.d) > greatest(o.y0,k.b))) > 0 AS goes
    FROM walk w JOIN ordered o ON o.doc_id=w.doc_id AND o.pos=w.pos+1))
SELECT word_no FROM walk WHERE NOT goes"""


def solve(rows, sql):
    """Run a rule over rows (doc_id, text, conf, x0, y0, x1, y1) in list order."""
    import duckdb
    import pandas as pd

    names = ["doc_id", "text", "conf", "x0", "y0", "x1", "y1"]
    con = duckdb.connect()
    con.register("words", pd.DataFrame(rows, columns=names).assign(word_no=range(len(rows))))
    return con.execute(sql).fetchall()
