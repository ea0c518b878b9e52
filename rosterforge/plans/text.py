"""Retrieval text work over documents (corpus) and conversations (questions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.functions.strings import clean_text as clean
from rosterforge.operators import text as ops
from rosterforge.plans.registry import query
from rosterforge.plans.standins import table

# Every third document gets blank lines, carriage returns and tabs, so that cleaning and the
# paragraph cuts have something to do.


def raw_docs(spark, sf):
    d = table(spark, sf, "documents")
    messy = F.replace(F.replace("text", F.lit(".\n"), F.lit(".\r\n\r\n \r\n\r\n")), F.lit(", "), F.lit(", \t "))
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, messy).otherwise(F.col("text")).alias("text"))


def docs(spark, sf):
    return ops.cleaned(raw_docs(spark, sf))


def sql_clean(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)),"
            r" ':contentReference\[[^\]]+\]\{[^}]+\}', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')")


SQL_DOCS = f"""raw AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(replace(text, '.' || chr(10),
    '.' || chr(13) || chr(10) || chr(13) || chr(10) || ' ' || chr(13) || chr(10) || chr(13) || chr(10)), ', ', ', ' || chr(9) || ' ') ELSE text END AS text FROM documents),
docs AS (SELECT doc_id, {sql_clean('text')} AS text FROM raw)"""


@query("clean_text", f"WITH {SQL_DOCS} SELECT doc_id, md5(text) AS h, length(text) AS n FROM docs")
def clean_text(spark, sf):
    return raw_docs(spark, sf).select("doc_id", clean("text").alias("t")).select(
        "doc_id", F.md5("t").alias("h"), F.length("t").alias("n"))


def _last(needle: str) -> str:
    return (f"CASE WHEN contains(win, {needle}) THEN length(win) - strpos(reverse(win), reverse({needle})) - length({needle}) + 1 ELSE -1 END")


SQL_CHUNKS = f"""{SQL_DOCS},
walk AS (
  SELECT doc_id, 0 AS s, -1 AS e, 0 AS nxt FROM docs WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, nxt AS s, e2 AS e, CASE WHEN back > 0 AND NOT regexp_matches(ahead, '^\\s') AND strpos(ahead, ' ') > 0
      THEN back + strpos(ahead, ' ') ELSE back END AS nxt
  FROM (SELECT *, substr(text, back + 1, 40) AS ahead FROM (SELECT *, greatest(0, e2 - 150) AS back FROM (
    SELECT *, CASE WHEN nxt + 900 < n THEN CASE WHEN cut > 540 THEN nxt + cut + 1 ELSE nxt + 900 END ELSE n END AS e2 FROM (
      SELECT *, greatest({_last('chr(10) || chr(10)')}, {_last("'. '")}) AS cut FROM (
        SELECT w.doc_id, w.nxt, d.text, length(d.text) AS n, substr(d.text, w.nxt + 1, 900) AS win
        FROM walk w JOIN docs d ON d.doc_id = w.doc_id WHERE w.e < length(d.text))))))
),
chunks0 AS (SELECT w.doc_id, s, regexp_replace(substr(d.text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS text
  FROM walk w JOIN docs d ON d.doc_id = w.doc_id WHERE e >= 0),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS chunk_index, length(text) AS chunk_size, text
  FROM chunks0 WHERE text <> '')"""


def chunks(spark, sf):
    return ops.chunk_documents(docs(spark, sf))


@query("chunk_documents", f"WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, chunk_index, chunk_size, md5(text) AS h FROM chunks")
def chunk_documents(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_index", "chunk_size", F.md5("text").alias("h"))


@query("corpus_summary", f"""WITH RECURSIVE {SQL_CHUNKS} SELECT d.doc_id, length(d.text) AS cleaned_chars, count(c.doc_id) AS chunks
  FROM docs d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.doc_id, d.text""")
def corpus_summary(spark, sf):
    return ops.corpus_summary(docs(spark, sf), chunks(spark, sf))


@query("corpus_totals", f"""WITH RECURSIVE {SQL_CHUNKS} SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars,
  (SELECT count(*) FROM chunks) AS chunks FROM docs""")
def corpus_totals(spark, sf):
    return ops.corpus_totals(docs(spark, sf), chunks(spark, sf))


@query("sample_chunks", f"""WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, chunk_index, md5(substr(text, 1, 700)
  || CASE WHEN length(text) > 700 THEN chr(10) || '...' ELSE '' END) AS h FROM chunks ORDER BY doc_id, chunk_index LIMIT 5""")
def sample_chunks(spark, sf):
    return ops.sample_chunks(chunks(spark, sf), ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", F.md5("text").alias("h"))


@query("embed_column", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER % 64 AS dim, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM c GROUP BY 1)
SELECT doc_id, dim, CAST(floor((n / norm)::FLOAT::DOUBLE * 100000000) AS BIGINT) AS value_e8 FROM c JOIN s USING (doc_id)""")
def embed_column(spark, sf):
    """Every component of every vector that is not zero."""
    rows = ops.embed_column(table(spark, sf, "documents").select("doc_id", "text"), "text", ops.hashed_token_encoder)
    each = rows.select("doc_id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0")
    return each.select("doc_id", "dim", F.floor(F.col("value").cast("double") * 100000000).cast("long").alias("value_e8"))


# --- questions and ranking -------------------------------------------------------------------

def questions(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), F.col("text").alias("question"))


def _named(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("filename"), "doc_id", "text")


SQL_Q = """qs AS (SELECT conv_id * 1000 + turn AS q, text AS question FROM conversations WHERE role = 'user'),
kw AS (SELECT q, list_filter(list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda t: length(t) > 2)),
  lambda t: NOT list_contains(['what', 'does', 'this', 'that', 'the', 'and', 'for'], t)) AS words,
  list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda t: length(t) > 2) AS all_words, question FROM qs)"""
SQL_RANKED = SQL_Q + """,
low AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS filename, doc_id, text, lower(text) AS t FROM documents),
words AS (SELECT DISTINCT unnest(words) AS w FROM kw),
occ AS (SELECT filename, w, (length(t) - length(replace(t, w, ''))) // length(w) AS n FROM low, words WHERE contains(t, w)),
kwx AS (SELECT q, unnest(words) AS w FROM kw),
scores AS (SELECT q, filename, CAST(sum(n) AS BIGINT) AS score FROM kwx JOIN occ USING (w) GROUP BY 1, 2),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, filename) AS rank FROM scores) WHERE rank <= 3)"""


@query("keyword_tokens", f"WITH {SQL_Q} SELECT q, array_to_string(list_sort(words), ' ') AS words, array_to_string(all_words, ' ') AS all_words FROM kw")
def keyword_tokens(spark, sf):
    return questions(spark, sf).select(
        "q", F.array_join(F.array_sort(ops.keyword_tokens(F.col("question"))), " ").alias("words"),
        F.array_join(ops.keyword_tokens(F.col("question"), distinct=False), " ").alias("all_words"))


@query("rank_documents", f"WITH {SQL_RANKED} SELECT q, rank, filename, score FROM ranked")
def rank_documents(spark, sf):
    return ops.rank_documents(questions(spark, sf), _named(spark, sf), 3)


SQL_ANSWER = SQL_RANKED + """,
best AS (SELECT kw.q, kw.all_words, filename, text FROM kw LEFT JOIN (SELECT q, filename FROM ranked WHERE rank = 1) r USING (q) LEFT JOIN low USING (filename)),
paras AS (SELECT q, filename, all_words, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT *, list_filter(list_transform(
  regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM best WHERE filename IS NOT NULL)),
ps AS (SELECT q, filename, p, i, list_sum(list_transform(all_words, lambda w: (length(lower(p)) - length(replace(lower(p), w, ''))) // length(w))) AS s FROM paras),
pick AS (SELECT q, filename, regexp_replace(regexp_replace(arg_max(p, s * 1000000 - i), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM ps GROUP BY 1, 2),
answers AS (SELECT kw.q, CASE WHEN c IS NULL OR c = '' THEN 'Insufficient information available.' WHEN length(c) > 420
  THEN regexp_replace(substr(c, 1, 417), '\\s+$', '') || '...' ELSE c END AS answer, coalesce(filename, 'Local RAG Knowledge Base') AS source
  FROM kw LEFT JOIN pick USING (q))"""


def _answers(spark, sf):
    ranked = ops.rank_documents(questions(spark, sf), _named(spark, sf), 3)
    return ops.extract_answer(ranked, questions(spark, sf), _named(spark, sf))


@query("extract_answer", f"WITH {SQL_ANSWER} SELECT q, answer, source FROM answers")
def extract_answer(spark, sf):
    return _answers(spark, sf)


def _graded(spark, sf):
    required = questions(spark, sf).select(
        "q", F.slice(ops.keyword_tokens(F.col("question"), distinct=False), 1, 3).alias("required_keywords"))
    return ops.grade_answers(_answers(spark, sf).join(required, "q"))


SQL_GRADES = SQL_ANSWER + """,
found AS (SELECT q, len(all_words[1:3]) AS n, len(list_filter(all_words[1:3], lambda w: contains(lower(answer), w))) AS f FROM answers JOIN kw USING (q)),
grades AS (SELECT q, CASE WHEN f = n THEN 'Correct' WHEN f > 0 THEN 'Partial' ELSE 'Incorrect' END AS grade FROM found)"""


@query("grade_answers", f"WITH {SQL_GRADES} SELECT q, grade FROM grades")
def grade_answers(spark, sf):
    return _graded(spark, sf).select("q", "grade")


@query("grade_counts", f"""WITH {SQL_GRADES} SELECT g.grade, count(grades.q) AS n FROM (VALUES ('Correct'), ('Partial'), ('Incorrect')) g(grade)
  LEFT JOIN grades ON grades.grade = g.grade GROUP BY 1""")
def grade_counts(spark, sf):
    return ops.grade_counts(_graded(spark, sf))


# --- neighbours and context: documents stand for chunks of ten-chunk files ---------------------

def _chunk_table(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 10).cast("string")).alias("filename"),
                    (F.col("doc_id") % 10).cast("int").alias("chunk_index"), "text")


def _hits(spark, sf):
    ranked = ops.rank_documents(questions(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), 3, key="chunk_id")
    return ranked.withColumn("score", F.col("score").cast("double"))


def _expanded(spark, sf):
    return ops.expand_neighbours(_hits(spark, sf), _chunk_table(spark, sf))


SQL_EXPANDED = SQL_RANKED + """,
ct AS (SELECT doc_id AS chunk_id, 'f' || (doc_id // 10) AS filename, doc_id % 10 AS chunk_index, text FROM documents),
hits AS (SELECT q, rank, doc_id AS chunk_id, score::DOUBLE AS score FROM ranked JOIN low USING (filename)),
around AS (SELECT q, rank, c.filename, c.chunk_index + d AS chunk_index, t, CASE WHEN d = 0 THEN score ELSE score * 0.95::DOUBLE END AS score
  FROM hits JOIN ct c USING (chunk_id), (VALUES (0, 0), (1, -1), (2, 1)) o(t, d)),
cand AS (SELECT a.*, c.chunk_id FROM around a JOIN ct c ON c.filename = a.filename AND c.chunk_index = a.chunk_index),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, chunk_id ORDER BY rank, t) AS r FROM cand) WHERE r = 1),
expanded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, t) AS position FROM once) WHERE position <= 4)"""


@query("expand_neighbours", f"WITH {SQL_EXPANDED} SELECT q, position, chunk_id, filename, chunk_index, CAST(round(score * 100) AS BIGINT) AS score_c FROM expanded")
def expand_neighbours(spark, sf):
    rows = _expanded(spark, sf)
    return rows.select("q", "position", "chunk_id", "filename", "chunk_index", F.round(F.col("score") * 100).cast("long").alias("score_c"))


SQL_CONTEXT = SQL_EXPANDED + """,
ctx AS (SELECT q, string_agg('[Chunk ' || position || ' | Source: ' || e.filename || ' | Chunk index: ' || e.chunk_index || ']' || chr(10) || text,
  chr(10) || chr(10) ORDER BY position) AS context FROM expanded e JOIN ct USING (chunk_id) GROUP BY 1)"""


@query("format_context", f"WITH {SQL_CONTEXT} SELECT q, md5(context) AS h, length(context) AS n FROM ctx")
def format_context(spark, sf):
    return ops.format_context(_expanded(spark, sf), _chunk_table(spark, sf)).select("q", F.md5("context").alias("h"), F.length("context").alias("n"))


@query("build_prompt", f"""WITH {SQL_CONTEXT} SELECT q, 'system' AS r0, 'Use the context.' AS c0, 'user' AS r1, md5('Context:' || chr(10) || coalesce(context, '')
  || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer:') AS c1 FROM qs LEFT JOIN ctx USING (q)""")
def build_prompt(spark, sf):
    contexts = ops.format_context(_expanded(spark, sf), _chunk_table(spark, sf))
    prompt = ops.build_prompt(contexts, questions(spark, sf), "Use the context.")
    first, second = F.get("messages", F.lit(0)), F.get("messages", F.lit(1))
    return prompt.select("q", first["role"].alias("r0"), first["content"].alias("c0"), second["role"].alias("r1"), F.md5(second["content"]).alias("c1"))


@query("source_list", f"""WITH {SQL_EXPANDED}, f AS (SELECT q, filename, min(position) AS p FROM expanded GROUP BY 1, 2)
SELECT q, string_agg(filename, ', ' ORDER BY p) AS sources FROM f GROUP BY 1""")
def source_list(spark, sf):
    return ops.source_list(_expanded(spark, sf))


# --- relations: part names as lines, eight parts per chunk --------------------------------------

def _relation_line():
    return F.expr("""CASE p_size % 6 WHEN 0 THEN '- ' || p_name || ' + ' || p_type || ' stone → ' || p_brand WHEN 1 THEN p_name || '  +  Night charm -> N' || p_size
      WHEN 2 THEN CASE WHEN p_size % 4 = 2 THEN '## Trade Evolutions with Items' ELSE 'plain + text' END
      WHEN 3 THEN '--' || p_name || ' + gem -> G' || p_size || ' ' WHEN 4 THEN CASE WHEN p_size % 8 = 4 THEN 'Level-up while holding item:' ELSE '' END
      ELSE 'about ' || p_name END""")


SQL_LINES = """lines AS (SELECT p_partkey // 8 AS chunk_id, p_partkey % 8 AS line_no, p_size, p_name, p_type, p_brand,
  p_size % 6 = 2 AND p_size % 4 = 2 AS trade, p_size % 6 = 4 AND p_size % 8 = 4 AS lvl FROM part),
flags AS (SELECT *, coalesce(bool_or(trade) OVER w, false) AS in_trade, coalesce(bool_or(lvl) OVER w, false) AS in_level FROM lines
  WINDOW w AS (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rel0 AS (SELECT *, p_name AS subject, CASE p_size % 6 WHEN 0 THEN p_type || ' stone' WHEN 1 THEN 'Night charm' ELSE 'gem' END AS item,
  CASE p_size % 6 WHEN 0 THEN p_brand WHEN 1 THEN 'N' || p_size ELSE 'G' || p_size END AS result FROM flags WHERE p_size % 6 IN (0, 1, 3)),
rel AS (SELECT *, CASE WHEN in_trade THEN 'by being traded while holding ' || item WHEN in_level OR item = 'Night charm'
  THEN 'by leveling up while holding ' || item ELSE 'using or meeting the condition for ' || item END AS condition FROM rel0)"""


def _relation_chunks(spark, sf):
    lines = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 8).alias("chunk_id"), (F.col("p_partkey") % 8).alias("i"), _relation_line().alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "line")))
    return lines.groupBy("chunk_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text"))


@query("extract_relations", f"WITH {SQL_LINES} SELECT chunk_id, line_no, subject, item, result, condition FROM rel")
def extract_relations(spark, sf):
    return ops.extract_relations(_relation_chunks(spark, sf))


@query("answer_relations", f"""WITH {SQL_LINES}, asked AS (SELECT c_custkey AS q, 'How does the ' || upper(p_name) || CASE WHEN c_nationkey % 3 = 0 THEN ' work' ELSE ' evolve' END AS question
  FROM customer JOIN part ON p_partkey = c_custkey),
cand AS (SELECT q, o.d AS position, r.* FROM asked, (VALUES (0), (1)) o(d), rel r WHERE r.chunk_id = q // 8 + o.d AND contains(question, ' evolve')
  AND contains(lower(question), lower(subject))),
first AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY position, line_no) AS k FROM cand)
SELECT q, subject || ' evolves into ' || result || ' ' || condition || '.' AS answer FROM first WHERE k = 1""")
def answer_relations(spark, sf):
    c, p = table(spark, sf, "customer"), table(spark, sf, "part")
    asked = c.join(p, c.c_custkey == p.p_partkey).select(
        F.col("c_custkey").alias("q"), F.concat(F.lit("How does the "), F.upper("p_name"),
                                                F.when(F.col("c_nationkey") % 3 == 0, " work").otherwise(" evolve")).alias("question"))
    hits = asked.select("q", F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).withColumn(
        "chunk_id", F.floor(F.col("q") / 8) + F.col("position"))
    return ops.answer_relations(asked, hits, ops.extract_relations(_relation_chunks(spark, sf)))
