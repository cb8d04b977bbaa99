"""Registered text queries: normaliser, tokenisers, expansion, chunkers, index, TF-IDF,
BM25, cosine search, context and ranking metrics (F6-F9, T1-T10) and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendgrid.functions import text as TX
from spendgrid.operators import chunking as CH
from spendgrid.operators import retrieval as RV
from spendgrid.plans import bindings as B
from spendgrid.plans import sqltext as S
from spendgrid.plans.registry import register
from spendgrid.session import file_version, stored

# --- F6-F9 ----------------------------------------------------------------------------------------
@register(
    "f06_normalize_ascii",
    f"SELECT doc_id, translate(text, '{TX._F6_SRC}', '{TX._F6_DST}') AS text FROM documents",
)
def f06(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.normalize_ascii(F.col("text")).alias("text"))


@register("f07_tokens_word", f"SELECT doc_id, {S.tokens_word('text')} AS tokens FROM documents")
def f07(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", TX.tokens_word(F.col("text")).alias("tokens"))


@register("f08_tokens_stem", f"SELECT doc_id, {S.tokens_stem('text')} AS tokens FROM documents")
def f08(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", TX.tokens_stem(F.col("text")).alias("tokens"))


@register(
    "f09_expand_query",
    f"""WITH q AS (SELECT item_id AS qid, {S.tokens_stem('text')} AS toks FROM benchmark),
{S.expansion_ctes('q', 'x')}
SELECT qid, toks AS tokens FROM x""",
)
def f09(spark, sf_dir):
    q = B.passages(spark, sf_dir)
    return q.select("qid", TX.expand_query(TX.tokens_stem(F.col("text"))).alias("tokens"))


# --- T1-T3: chunkers --------------------------------------------------------------------------------
def _chunk_sql(marker, boundary, heading, first_name, kind):
    return f"""WITH {S.corpus_cte(marker)}, {S.lines_cte()},
c AS (SELECT *, SUM(CASE WHEN {boundary} THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chunk FROM ln),
g AS (SELECT doc_id, chunk, min(pos) AS start_line, max(pos) AS end_line, arg_min(line, pos) AS first_line,
        string_agg(line, chr(10) ORDER BY pos) AS body FROM c GROUP BY doc_id, chunk)
SELECT doc_id, CASE WHEN chunk = 0 THEN '{first_name}' ELSE {heading} END AS heading,
  CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, '{kind}' AS type,
  {S.strip('body')} AS content
FROM g WHERE {S.strip('body')} <> ''"""


T1_SQL = _chunk_sql("# ", "starts_with(line, '#')", S.strip("regexp_replace(first_line, '^#+', '')"), "General", "markdown")
_DEF = f"(starts_with({S.strip('line')}, 'def ') OR starts_with({S.strip('line')}, 'class '))"
T3_SQL = _chunk_sql(
    "def ", _DEF,
    S.strip(f"replace(replace(split_part({S.strip('first_line')}, '(', 1), 'def ', ''), 'class ', '')"),
    "modulo", "python",
)
# chunk 0 is kept as 'General'/'modulo' only when the first line is not itself a boundary
T1_SQL = T1_SQL.replace("CASE WHEN chunk = 0 THEN 'General'", "CASE WHEN chunk = 0 AND NOT starts_with(first_line, '#') THEN 'General'")
T3_SQL = T3_SQL.replace(
    "CASE WHEN chunk = 0 THEN 'modulo'",
    f"CASE WHEN chunk = 0 AND NOT (starts_with({S.strip('first_line')}, 'def ') OR starts_with({S.strip('first_line')}, 'class ')) THEN 'modulo'",
)


@register("t01_chunk_headings", T1_SQL)
def t01(spark, sf_dir):
    return CH.chunk_headings(B.corpus(spark, sf_dir, "# "))


H2 = CH.H2_RE
H1 = CH.H1_RE
T2_SQL = f"""WITH {S.corpus_cte('## ')}, {S.lines_cte()},
c AS (SELECT *, SUM(CASE WHEN regexp_matches(line, '{H2}') THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chunk FROM ln),
t AS (SELECT doc_id, {S.strip(f"regexp_extract(arg_min(line, pos), '{H1}', 1)")} AS title FROM ln
      WHERE regexp_matches(line, '{H1}') GROUP BY doc_id),
g AS (SELECT doc_id, chunk, min(pos) AS start_line, max(pos) AS end_line, arg_min(line, pos) AS first_line,
        string_agg(line, chr(10) ORDER BY pos) AS body FROM c GROUP BY doc_id, chunk),
n AS (SELECT doc_id, max(pos) AS n FROM ln GROUP BY doc_id)
SELECT g.doc_id,
  CASE WHEN chunk = 0 THEN coalesce(t.title, regexp_replace(CAST(g.doc_id AS VARCHAR), '\\.[^./]*$', ''))
       ELSE {S.strip(f"regexp_extract(first_line, '{H2}', 1)")} END AS heading,
  CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, 'markdown' AS type,
  {S.strip('body')} AS content
FROM g LEFT JOIN t ON g.doc_id = t.doc_id WHERE {S.strip('body')} <> ''"""


@register("t02_chunk_h2", T2_SQL)
def t02(spark, sf_dir):
    return CH.chunk_h2(B.corpus(spark, sf_dir, "## "))


@register("t03_chunk_code", T3_SQL)
def t03(spark, sf_dir):
    return CH.chunk_code(B.corpus(spark, sf_dir, "def "))


# --- T4: inverted index over T1 chunks ---------------------------------------------------------------
def _chunks_cte(sql: str, name: str) -> str:
    """Turn a chunker query 'WITH a, b, c SELECT ...' into CTEs ending with ``name``."""
    head, _, tail = sql.partition("WITH ")
    ctes, sel = tail.rsplit("\nSELECT ", 1)
    return f"{ctes},\n{name} AS (SELECT doc_id || ':' || start_line AS chunk_id, * FROM (SELECT {sel}))"


_INDEXES: dict[tuple, object] = {}


def corpus_index(spark, sf_dir: str, kind: str):
    """The stored index of a corpus: built by the first query of the application that needs it,
    then read by all (``tfidf`` over T1 chunks, ``bm25`` over T2 chunks, ``cosine`` over documents).
    A corpus whose files changed is indexed anew."""
    key = (spark.sparkContext.applicationId, file_version(spark, f"{sf_dir}/documents.parquet"), kind)
    if key not in _INDEXES:
        if kind == "tfidf":
            _INDEXES[key] = RV.tfidf_index(RV.chunk_key(CH.chunk_headings(B.corpus(spark, sf_dir, "# "))))
        elif kind == "bm25":
            _INDEXES[key] = RV.bm25_index(RV.chunk_key(CH.chunk_h2(B.corpus(spark, sf_dir, "## "))))
        else:
            _INDEXES[key] = RV.cosine_index(B.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _INDEXES[key]


@register(
    "t04_build_index",
    f"""WITH {_chunks_cte(T1_SQL, 'ch')},
tok AS (SELECT chunk_id, unnest({S.tokens_word('content')}) AS term FROM ch),
post AS (SELECT chunk_id, term, COUNT(*) AS tf FROM tok GROUP BY chunk_id, term),
df AS (SELECT term, COUNT(*) AS df FROM post GROUP BY term)
SELECT chunk_id, term, tf, df FROM post JOIN df USING (term)""",
)
def t04(spark, sf_dir):
    return corpus_index(spark, sf_dir, "tfidf").counts.select("chunk_id", "term", "tf", "df")


# --- T5: TF-IDF search over T1 chunks ---------------------------------------------------------------------
@register(
    "t05_search_tfidf",
    f"""WITH {_chunks_cte(T1_SQL, 'ch')},
tok AS (SELECT chunk_id, unnest({S.tokens_word('content')}) AS term FROM ch),
post AS (SELECT chunk_id, term, COUNT(*) AS tf FROM tok GROUP BY chunk_id, term),
lens AS (SELECT chunk_id, len({S.tokens_word('content')}) AS len FROM ch),
df AS (SELECT term, COUNT(*) AS df FROM post GROUP BY term),
nn AS (SELECT COUNT(*) AS n FROM ch),
qt AS (SELECT qid, term, COUNT(*) AS qtf FROM (SELECT item_id AS qid, unnest({S.tokens_word('text')}) AS term FROM benchmark)
       GROUP BY qid, term),
s AS (SELECT qt.qid, post.chunk_id,
        SUM(qtf * (tf / greatest(len, 1)) * (ln((nn.n + 1) / (df + 0.5)) + 1.0)) AS score
      FROM qt JOIN post ON qt.term = post.term JOIN df ON qt.term = df.term JOIN lens ON post.chunk_id = lens.chunk_id
      CROSS JOIN nn GROUP BY qt.qid, post.chunk_id),
r AS (SELECT s.qid, ch.*, s.score, ROW_NUMBER() OVER (PARTITION BY s.qid ORDER BY round(s.score, 9) DESC, ch.doc_id, ch.start_line) AS rank
      FROM s JOIN ch ON s.chunk_id = ch.chunk_id WHERE s.score > 0)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, heading, start_line, end_line, type, round(score, 4) AS score,
  CASE WHEN length(content) > 400 THEN substr(content, 1, 400) || '...' ELSE content END AS snippet
FROM r WHERE rank <= 5""",
)
def t05(spark, sf_dir):
    return RV.search_tfidf(B.passages(spark, sf_dir), corpus_index(spark, sf_dir, "tfidf"), 5).withColumn("rank", F.col("rank").cast("int"))


# --- T6: BM25 over T2 chunks ------------------------------------------------------------------------------------
_SEARCHABLE = "heading || ' ' || content || ' ' || translate(CAST(doc_id AS VARCHAR), '_-', '  ')"
def bm25_ctes(queries: str) -> str:
    """CTEs up to ``hits`` for the queries ``(qid, text)``."""
    return f"""{_chunks_cte(T2_SQL, 'ch')},
tok AS (SELECT chunk_id, unnest({S.tokens_stem(_SEARCHABLE)}) AS term FROM ch),
post AS (SELECT chunk_id, term, COUNT(*) AS tf FROM tok GROUP BY chunk_id, term),
lens AS (SELECT chunk_id, len({S.tokens_stem(_SEARCHABLE)}) AS len FROM ch),
df AS (SELECT term, COUNT(*) AS df FROM post GROUP BY term),
nn AS (SELECT COUNT(*) AS n, avg(len) AS avgdl FROM lens),
q0 AS (SELECT qid, {S.tokens_stem('text')} AS toks FROM ({queries})),
{S.expansion_ctes('q0', 'q')},
qt AS (SELECT qid, term, COUNT(*) AS qtf FROM (SELECT qid, unnest(toks) AS term FROM q) GROUP BY qid, term),
s AS (SELECT qt.qid, post.chunk_id,
        SUM(qtf * (ln(1.0 + (nn.n - df + 0.5) / (df + 0.5)) * (tf * 2.5)
            / (tf + 1.5 * (0.25 + 0.75 * len / nn.avgdl)))) AS score
      FROM qt JOIN post ON qt.term = post.term JOIN df ON qt.term = df.term JOIN lens ON post.chunk_id = lens.chunk_id
      CROSS JOIN nn GROUP BY qt.qid, post.chunk_id),
r AS (SELECT s.qid, ch.doc_id, ch.start_line, s.score,
        ROW_NUMBER() OVER (PARTITION BY s.qid ORDER BY round(s.score, 9) DESC, ch.doc_id, ch.start_line) AS rank
      FROM s JOIN ch ON s.chunk_id = ch.chunk_id WHERE s.score > 0),
first AS (SELECT doc_id, start_line, ROW_NUMBER() OVER (ORDER BY doc_id, start_line) AS rank FROM ch
          ORDER BY doc_id, start_line LIMIT 3),
hits AS (SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, start_line, round(score, 6) AS score FROM r WHERE rank <= 3
         UNION ALL SELECT q.qid, CAST(first.rank AS INTEGER), first.doc_id, first.start_line, 0.0
         FROM q JOIN q0 ON q.qid = q0.qid CROSS JOIN first WHERE len(q0.toks) = 0)"""


_BM25_CTES = bm25_ctes("SELECT item_id AS qid, text FROM benchmark")


@register("t06_search_bm25", f"WITH {_BM25_CTES} SELECT * FROM hits")
def t06(spark, sf_dir):
    return RV.search_bm25(B.passages(spark, sf_dir), corpus_index(spark, sf_dir, "bm25"), 3).withColumn("rank", F.col("rank").cast("int"))


# --- T7: cosine TF-IDF over whole documents ---------------------------------------------------------------------
def _cos_tokens(x):
    sw = ", ".join("'" + w.replace("'", "''") + "'" for w in RV.ENGLISH_STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower({x}), '{RV.COSINE_TOKEN}'), lambda w: NOT list_contains([{sw}], w))"


def _t7_sql():
    return f"""WITH dt AS (SELECT doc_id, unnest({_cos_tokens('text')}) AS term FROM documents),
post AS (SELECT doc_id, term, COUNT(*) AS tf FROM dt GROUP BY doc_id, term),
df AS (SELECT term, COUNT(*) AS df FROM post GROUP BY term),
nn AS (SELECT COUNT(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + nn.n) / (1 + df)) + 1.0 AS idf FROM df CROSS JOIN nn),
dw AS (SELECT doc_id, post.term, tf * idf AS w FROM post JOIN idf ON post.term = idf.term),
dn AS (SELECT doc_id, sqrt(SUM(w * w)) AS dn FROM dw GROUP BY doc_id),
qp AS (SELECT qid, term, COUNT(*) AS tf FROM (SELECT item_id AS qid, unnest({_cos_tokens('text')}) AS term FROM benchmark)
       GROUP BY qid, term),
qw AS (SELECT qid, qp.term, tf * idf AS w FROM qp JOIN idf ON qp.term = idf.term),
qn AS (SELECT qid, sqrt(SUM(w * w)) AS qn FROM qw GROUP BY qid),
sims AS (SELECT qw.qid, dw.doc_id, SUM(qw.w * dw.w) AS dot FROM qw JOIN dw ON qw.term = dw.term GROUP BY qw.qid, dw.doc_id),
sc AS (SELECT sims.qid, sims.doc_id, dot / (qn * dn) AS score FROM sims JOIN qn ON sims.qid = qn.qid JOIN dn ON sims.doc_id = dn.doc_id),
fill AS (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 3),
z AS (SELECT b.item_id AS qid, fill.doc_id, 0.0 AS score FROM benchmark b CROSS JOIN fill
      WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.qid = b.item_id AND sc.doc_id = fill.doc_id)),
cand AS (SELECT * FROM sc UNION ALL SELECT * FROM z),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id DESC) AS rank FROM cand)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 3"""


@register("t07_search_cosine", _t7_sql)
def t07(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "cosine")
    return RV.search_cosine(B.passages(spark, sf_dir), idx, 3).withColumn("rank", F.col("rank").cast("int"))


# --- T8-T10 over BM25 hits --------------------------------------------------------------------------------------------
def _bm25_hits(spark, sf_dir):
    hits = RV.search_bm25(B.passages(spark, sf_dir), corpus_index(spark, sf_dir, "bm25"), 3)
    return stored(hits, "hits")  # of known size: the texts they meet need no shuffle if it is small


@register(
    "t08_build_context",
    f"""WITH {_BM25_CTES}
SELECT hits.qid, string_agg('- ' || ch.content, chr(10) ORDER BY hits.rank) AS context
FROM hits JOIN ch ON hits.doc_id = ch.doc_id AND hits.start_line = ch.start_line GROUP BY hits.qid""",
)
def t08(spark, sf_dir):
    hits = _bm25_hits(spark, sf_dir)
    docs = B.corpus(spark, sf_dir, "## ").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")  # others are not cut again
    return RV.build_context(hits, CH.chunk_h2(docs).withColumnRenamed("content", "text"), ("doc_id", "start_line"))


_RANKED = """ranked AS (SELECT hits.qid, hits.rank, CASE WHEN instr(d.text, b.text) > 0 THEN 1 ELSE 0 END AS rel
  FROM hits JOIN documents d ON hits.doc_id = d.doc_id JOIN benchmark b ON hits.qid = b.item_id)"""


def _ranked(spark, sf_dir):
    hits = _bm25_hits(spark, sf_dir)
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc_text"))
    q = B.passages(spark, sf_dir).withColumnRenamed("text", "q_text")
    j = hits.join(docs, "doc_id").join(q, "qid")
    return j.select("qid", "rank", F.when(F.instr("doc_text", F.col("q_text")) > 0, 1).otherwise(0).alias("rel"))


@register(
    "t09_ndcg",
    f"""WITH {_BM25_CTES}, {_RANKED},
rr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS ideal_pos FROM ranked WHERE rank <= 5),
gg AS (SELECT qid, SUM((pow(2.0, rel) - 1) / log2(rank + 1)) AS dcg, SUM((pow(2.0, rel) - 1) / log2(ideal_pos + 1)) AS idcg
      FROM rr GROUP BY qid)
SELECT qid, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 9) AS ndcg FROM gg""",
)
def t09(spark, sf_dir):
    return RV.ndcg(_ranked(spark, sf_dir), 5)


@register(
    "t10_mrr",
    f"""WITH {_BM25_CTES}, {_RANKED}
SELECT qid, round(coalesce(1.0 / min(CASE WHEN rel > 0 THEN rank END), 0.0), 9) AS mrr FROM ranked GROUP BY qid""",
)
def t10(spark, sf_dir):
    return RV.mrr(_ranked(spark, sf_dir))


# --- O8: top-k per query with a unique tie-break (over T5 candidate scores) ------------------------------
@register(
    "o08_top_k",
    f"""WITH {_chunks_cte(T1_SQL, 'ch')},
tok AS (SELECT chunk_id, unnest({S.tokens_word('content')}) AS term FROM ch),
post AS (SELECT chunk_id, term, COUNT(*) AS tf FROM tok GROUP BY chunk_id, term),
qt AS (SELECT DISTINCT item_id AS qid, unnest({S.tokens_word('text')}) AS term FROM benchmark),
s AS (SELECT qt.qid, post.chunk_id, CAST(SUM(tf) AS BIGINT) AS score FROM qt JOIN post ON qt.term = post.term GROUP BY 1, 2),
r AS (SELECT s.qid, ch.doc_id, ch.start_line, s.score,
        ROW_NUMBER() OVER (PARTITION BY s.qid ORDER BY s.score DESC, ch.doc_id, ch.start_line) AS rank
      FROM s JOIN ch ON s.chunk_id = ch.chunk_id)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, start_line, score FROM r WHERE rank <= 10""",
)
def o08(spark, sf_dir):
    idx = corpus_index(spark, sf_dir, "tfidf")
    qt = B.passages(spark, sf_dir).select("qid", F.explode(TX.tokens_word(F.col("text"))).alias("term")).distinct()
    top = RV.top_k(RV.most_frequent(idx, qt, 10), 10, [F.col("score").desc(), "doc_id", "start_line"])
    return top.select("qid", F.col("rank").cast("int").alias("rank"), "doc_id", "start_line", "score")
