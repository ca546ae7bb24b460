"""The engine's queries over the plain tables, and the same in SQL.

Each query runs over its whole tables.  In the oracles, ties and rounding are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.words import STOP, SUFFIXES, TERMS
from .operators import evaluation, expansion, ranking, reporting, retrieval
from .registry import oracles, query, registered
from .shared import kept, written
from .sources.tables import benchmark_queries, calls, chunks, load

_CHUNKS = r"""
chunks AS (
  SELECT doc_id AS chunk_id, source || '/' || doc_id || '.' || lang AS file_path, lang AS language, source AS dir,
         coalesce(regexp_extract(lower(text), '[\p{L}\p{N}]+'), '') AS name,
         CASE WHEN n_chars > 4000 THEN 'class' WHEN n_chars > 1000 THEN 'function' ELSE 'method' END AS chunk_type,
         text AS content, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS filled, strlen(text) AS size_bytes
  FROM documents)"""
_VECTOR = """
pairs AS (
  SELECT q.vec_id AS qid, c.vec_id AS chunk_id,
         round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) AS score
  FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 100 = 0{where}),
vec AS (
  SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM pairs
  QUALIFY rank <= {k})"""
_FTS = r"""
terms AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT chunk_id, sum(tf) AS size FROM tf GROUP BY ALL),
totals AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents)::DOUBLE AS mean),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, totals GROUP BY term, n),
asked AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
hits AS (
  SELECT qid, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN size USING (chunk_id), totals GROUP BY qid, chunk_id),
fts AS (
  SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM hits
  QUALIFY rank <= {k})"""


#: The stated query set of the vector searches, against all vectors.
ASKED = "chunk_id % 100 = 0"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    return e, e.filter(ASKED).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    def make():
        docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
        return written(retrieval.postings(docs, {"content": F.col("text")})), docs.count()

    return kept(spark, "postings", sf_dir, make)


def _fts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    index, n = _index(spark, sf_dir)
    return retrieval.text_top_k(index, n, benchmark_queries(spark, sf_dir), k)


@query(f"WITH {_VECTOR.format(k=5, where='')} SELECT * FROM vec")
def vector_topk(spark, sf_dir):
    """The five vectors nearest to each asked vector."""
    e, q = _vectors(spark, sf_dir)
    return retrieval.vector_top_k(e, q, 5)


@query(f"WITH {_VECTOR.format(k=5, where=' AND c.label IN (1, 2)')} SELECT * FROM vec")
def vector_topk_filtered(spark, sf_dir):
    """The same among labels 1 and 2, filtered before ranking."""
    e, q = _vectors(spark, sf_dir)
    return retrieval.vector_top_k(e, q, 5, F.col("label").isin(1, 2))


@query(
    f"""WITH {_VECTOR.format(k=5, where='')},{_CHUNKS},
    kept AS (SELECT qid, chunk_id, chunk_type, round(score * CASE chunk_type WHEN 'class' THEN 1.15 WHEN 'method' THEN 0.95 ELSE 1.0 END, 4) AS score
             FROM vec JOIN chunks USING (chunk_id) WHERE score >= 0.45)
    SELECT qid, chunk_id, chunk_type, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM kept"""
)
def semantic_boosted(spark, sf_dir):
    """Vector search with the threshold, then type boosts."""
    e, q = _vectors(spark, sf_dir)
    found = retrieval.vector_top_k(e, q, 5).filter(F.col("score") >= ranking.THRESHOLD).drop("rank")
    typed = found.join(chunks(spark, sf_dir).select("chunk_id", "chunk_type"), "chunk_id")
    return retrieval.ranked(ranking.boosted(typed), [F.col("score").desc(), "chunk_id"]).select("qid", "chunk_id", "chunk_type", "score", "rank")


@query(f"WITH {_FTS.format(k=5)} SELECT * FROM fts")
def fts_topk(spark, sf_dir):
    """The five documents that match each benchmark passage best."""
    return _fts(spark, sf_dir, 5)


@query(
    f"""WITH {_FTS.format(k=5)},{_CHUNKS}
    SELECT qid, chunk_id, chunk_type, score, row_number() OVER (PARTITION BY qid ORDER BY
      CASE chunk_type WHEN 'class' THEN 0 WHEN 'method' THEN 1 WHEN 'function' THEN 2 ELSE 3 END, rank) AS rank
    FROM fts JOIN chunks USING (chunk_id)"""
)
def exact_search(spark, sf_dir):
    """Full-text hits in the order of their types."""
    found = _fts(spark, sf_dir, 5).join(chunks(spark, sf_dir).select("chunk_id", "chunk_type"), "chunk_id")
    return ranking.by_type(found).select("qid", "chunk_id", "chunk_type", "score", "rank")


_RRF = """
sides AS (
  SELECT qid, chunk_id, rank AS a, NULL AS b FROM l UNION ALL SELECT qid, chunk_id, NULL, rank FROM r),
both_ AS (SELECT qid, chunk_id, min(a) AS a, min(b) AS b FROM sides GROUP BY ALL),
raw AS (SELECT qid, chunk_id, 1.0::DOUBLE / (60 + coalesce(a - 1, 11)) + 1.0::DOUBLE / (60 + coalesce(b - 1, 11)) AS raw FROM both_),
fused AS (
  SELECT qid, chunk_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 12) DESC, chunk_id) AS rank FROM raw
  QUALIFY rank <= 5)"""
_LISTS = (
    _VECTOR.format(k=10, where="")
    + ", l AS (SELECT qid, chunk_id, rank FROM vec), "
    + "r AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY "
    "round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) DESC, c.vec_id DESC) AS rank "
    "FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 100 = 0 AND c.label < 5 QUALIFY rank <= 10)"
)


@query(f"WITH {_LISTS}, {_RRF} SELECT * FROM fused")
def rrf_fuse(spark, sf_dir):
    """Two vector rankings fused: all labels, and labels below 5 with ties the other way round."""
    e, q = _vectors(spark, sf_dir)
    left = retrieval.vector_top_k(e, q, 10)
    right = retrieval.vector_top_k(e.filter("label < 5").withColumn("chunk_id", -F.col("chunk_id")), q, 10).withColumn("chunk_id", -F.col("chunk_id"))
    return retrieval.rank_fusion(left, right, 10, 5)


_HYBRID = (
    _FTS.format(k=10)
    + f""",{_CHUNKS},
qv AS (SELECT b.item_id AS qid, e.embedding::DOUBLE[] AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
sem AS (SELECT qid, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY
        round(list_cosine_similarity(v, c.embedding::DOUBLE[]), 4) DESC, c.vec_id) AS rank
        FROM qv CROSS JOIN embeddings c QUALIFY rank <= 10),
l AS (SELECT qid, chunk_id, rank FROM sem), r AS (SELECT qid, chunk_id, rank FROM fts)"""
)


def _hybrid(spark, sf_dir, k: int = 5) -> DataFrame:
    e, _ = _vectors(spark, sf_dir)
    asked = benchmark_queries(spark, sf_dir).join(e, F.col("qid") == F.col("chunk_id")).select("qid", F.col("embedding").alias("vector"))
    return retrieval.rank_fusion(retrieval.vector_top_k(e, asked, 10), _fts(spark, sf_dir, 10), 10, k)


def _hybrid_results(spark, sf_dir) -> DataFrame:
    """Hybrid results with what the expansions read, as a table of their own: every expansion reads it several times."""
    own = chunks(spark, sf_dir).select("chunk_id", "file_path", "dir", "name", "chunk_type", "language", "norm", "filled")
    return written(_hybrid(spark, sf_dir).join(own, "chunk_id").withColumnRenamed("rank", "pos"))


@query(f"WITH {_HYBRID}, {_RRF} SELECT * FROM fused")
def hybrid(spark, sf_dir):
    """Vector and full-text rankings of the benchmark passages, fused."""
    return _hybrid(spark, sf_dir)


_RESULTS = f"{_HYBRID}, {_RRF}, res AS (SELECT fused.qid, fused.rank AS pos, fused.score, chunks.* FROM fused JOIN chunks USING (chunk_id))"


@query(
    f"""WITH {_HYBRID},
    s AS (SELECT DISTINCT qid, file_path, name FROM l JOIN chunks USING (chunk_id)), e AS (SELECT DISTINCT qid, file_path, name FROM r JOIN chunks USING (chunk_id))
    SELECT coalesce(s.qid, e.qid) AS qid, coalesce(s.file_path, e.file_path) AS file_path, coalesce(s.name, e.name) AS name,
      CASE WHEN e.qid IS NULL THEN 'semantic_only' WHEN s.qid IS NULL THEN 'exact_only' ELSE 'both' END AS category
    FROM s FULL OUTER JOIN e ON s.qid = e.qid AND s.file_path = e.file_path AND s.name = e.name"""
)
def audit_categories(spark, sf_dir):
    """What semantic and exact search find in common and alone."""
    e, _ = _vectors(spark, sf_dir)
    asked = benchmark_queries(spark, sf_dir).join(e, F.col("qid") == F.col("chunk_id")).select("qid", F.col("embedding").alias("vector"))
    own = chunks(spark, sf_dir).select("chunk_id", "file_path", "name")
    return reporting.audit(retrieval.vector_top_k(e, asked, 10).join(own, "chunk_id"), _fts(spark, sf_dir, 10).join(own, "chunk_id"))


@query(
    f"""WITH {_RESULTS},
    h AS (SELECT *, count(*) OVER (PARTITION BY qid, dir) AS mates, CASE WHEN filled < 3 THEN round(score * 0.5, 6) ELSE score END AS s1 FROM res),
    m AS (SELECT *, CASE WHEN mates >= 2 THEN round(s1 * 1.05, 6) ELSE s1 END AS s2 FROM h),
    d AS (SELECT *, row_number() OVER (PARTITION BY qid, file_path ORDER BY s2 DESC, pos) AS n FROM m QUALIFY n <= 2)
    SELECT qid, chunk_id, file_path, s2 AS score, row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, pos) AS rank FROM d"""
)
def rerank_diversity(spark, sf_dir):
    """Hybrid results reranked by length, neighbourhood and diversity."""
    return ranking.rerank(_hybrid_results(spark, sf_dir)).select("qid", "chunk_id", "file_path", "score", "rank")


_CALLS = r"""
ct AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[2:] AS t FROM documents),
cu AS (SELECT chunk_id, unnest(t) AS callee, generate_subscripts(t, 1) AS i FROM ct),
calls AS (SELECT chunk_id, callee, row_number() OVER (PARTITION BY chunk_id ORDER BY min(i)) - 1 AS at_ FROM cu GROUP BY chunk_id, callee),
by_name AS (SELECT * FROM chunks WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path, chunk_id) = 1)"""
_CALLERS = """
callers AS (SELECT callee, name AS caller, count(*) AS times FROM calls JOIN chunks USING (chunk_id) WHERE callee <> '' AND name <> '' GROUP BY ALL)"""


@query(f"WITH {_CHUNKS}, {_CALLS}, {_CALLERS} SELECT * FROM callers")
def callers_index(spark, sf_dir):
    """Who calls each name, and how often: every term of a text behind its name."""
    return expansion.callers_index(calls(spark, sf_dir), chunks(spark, sf_dir))


@query(
    f"""WITH {_RESULTS}, {_CALLS},
    named AS (SELECT qid, pos AS by_, at_, callee AS name, score FROM res JOIN calls USING (chunk_id)),
    fresh AS (SELECT * FROM named n WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM res WHERE res.qid = n.qid AND res.name = n.name)
              QUALIFY row_number() OVER (PARTITION BY qid, name ORDER BY by_, at_) = 1),
    got AS (SELECT qid, by_, at_, f.name, f.score, chunk_id, file_path, row_number() OVER (PARTITION BY qid ORDER BY by_, at_, f.name) AS pos
            FROM fresh f JOIN by_name b ON b.name = f.name QUALIFY pos <= 2)
    SELECT qid, pos, chunk_id, file_path, name, round(score * 0.8, 6) AS score FROM got"""
)
def expand_calls(spark, sf_dir):
    """What the hybrid results call, by every term of a text."""
    out = expansion.via_calls(_hybrid_results(spark, sf_dir), calls(spark, sf_dir), chunks(spark, sf_dir), 5)
    return out.select("qid", "pos", "chunk_id", "file_path", "name", "score")


@query(
    f"""WITH {_RESULTS}, {_CALLS}, {_CALLERS},
    own AS (SELECT * FROM callers QUALIFY sum(times) OVER (PARTITION BY callee) < 50),
    named AS (SELECT qid, pos AS by_, caller AS name, score, callee AS caller_of FROM res JOIN own ON own.callee = res.name),
    fresh AS (SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.qid = n.qid AND res.name = n.name)
              QUALIFY row_number() OVER (PARTITION BY qid, name ORDER BY by_, name) = 1),
    got AS (SELECT qid, f.name, f.score, caller_of, chunk_id, file_path, row_number() OVER (PARTITION BY qid ORDER BY by_, f.name) AS pos
            FROM fresh f JOIN by_name b ON b.name = f.name QUALIFY pos <= 10)
    SELECT qid, pos, chunk_id, file_path, name, round(score * 0.75, 6) AS score, caller_of FROM got"""
)
def expand_callers(spark, sf_dir):
    """Who calls the hybrid results, by every term of a text."""
    c = chunks(spark, sf_dir)
    out = expansion.via_callers(_hybrid_results(spark, sf_dir), expansion.callers_index(calls(spark, sf_dir), c), c)
    return out.select("qid", "pos", "chunk_id", "file_path", "name", "score", "caller_of")


@query(
    f"""WITH {_RESULTS},
    dirs AS (SELECT qid, dir FROM res GROUP BY ALL HAVING count(*) >= 2),
    best AS (SELECT qid, max(score) AS top FROM res GROUP BY ALL),
    below AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY dir ORDER BY file_path, chunk_id) <= 50),
    near AS (SELECT d.qid, b.* FROM dirs d JOIN below b USING (dir) WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.qid = d.qid AND res.file_path = b.file_path)),
    got AS (SELECT qid, chunk_id, file_path, row_number() OVER (PARTITION BY qid ORDER BY CASE chunk_type WHEN 'class' THEN 0 ELSE 1 END, file_path) AS pos FROM near QUALIFY pos <= 5)
    SELECT qid, pos, chunk_id, file_path, round(top * 0.7, 6) AS score FROM got JOIN best USING (qid)"""
)
def module_siblings(spark, sf_dir):
    """Other files below directories that hold two hybrid results or more."""
    out = expansion.siblings(_hybrid_results(spark, sf_dir), chunks(spark, sf_dir))
    return out.select("qid", "pos", "chunk_id", "file_path", "score")


_NORM = "regexp_replace(name, '({})$', '')".format("|".join(SUFFIXES))


@query(
    f"""WITH {_RESULTS},
    n AS (SELECT *, CASE WHEN {_NORM} <> '' THEN {_NORM} ELSE name END AS norm FROM chunks),
    met AS (SELECT r.qid, r.pos AS by_, r.score, c.chunk_id, c.file_path, c.name
      FROM (SELECT res.*, n.norm FROM res JOIN n USING (chunk_id)) r JOIN n c ON r.language <> c.language AND r.norm <> '' AND c.norm <> ''
       AND (r.norm = c.norm OR (length(r.norm) >= 5 AND starts_with(c.norm, r.norm)) OR (length(c.norm) >= 5 AND starts_with(r.norm, c.norm)))),
    one AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.qid = m.qid AND res.file_path = m.file_path AND res.name = m.name)
            QUALIFY row_number() OVER (PARTITION BY qid, file_path, name ORDER BY by_, chunk_id) = 1)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY by_, file_path, name) AS pos, chunk_id, file_path, name, round(score * 0.7, 6) AS score FROM one"""
)
def cross_layer(spark, sf_dir):
    """Counterparts of the hybrid results in other languages."""
    out = expansion.cross_layer(_hybrid_results(spark, sf_dir), chunks(spark, sf_dir))
    return out.select("qid", "pos", "chunk_id", "file_path", "name", "score")


def _with_tests(c: DataFrame) -> DataFrame:
    """Every chunk, and for those of type class a test file beside it, its form by the parity of the id."""
    tests = c.filter("chunk_type = 'class'").withColumn(
        "file_path", F.concat("dir", F.lit("/"), F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("test_"), F.col("chunk_id"))).otherwise(F.concat(F.col("chunk_id"), F.lit("_test"))), F.lit("."), "language")
    )
    return c.unionByName(tests.withColumn("chunk_id", -F.col("chunk_id") - 1))


@query(
    f"""WITH {_RESULTS},
    tests AS (SELECT -chunk_id - 1 AS chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'test_' || chunk_id ELSE chunk_id || '_test' END AS stem, dir, language, chunk_id AS of_ FROM chunks WHERE chunk_type = 'class')
    SELECT res.qid, row_number() OVER (PARTITION BY res.qid ORDER BY res.pos) AS pos, t.chunk_id, t.dir || '/' || t.stem || '.' || t.language AS file_path,
      round(res.score * 0.6, 6) AS score, res.file_path AS test_for
    FROM res JOIN tests t ON t.of_ = res.chunk_id"""
)
def test_association(spark, sf_dir):
    """Test files of the hybrid results."""
    out = expansion.test_files(_hybrid_results(spark, sf_dir), _with_tests(chunks(spark, sf_dir)))
    return out.select("qid", "pos", "chunk_id", "file_path", "score", "test_for")


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_TERMS_SQL = "MAP {" + ", ".join(f"'{k}': ['" + "', '".join(v) + "']" for k, v in TERMS.items()) + "}"


@query(
    rf"""WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS words FROM conversations),
    k AS (SELECT *, list_filter(words, lambda t: regexp_matches(t, '[a-z][a-zA-Z0-9]*[A-Z]|[a-zA-Z_][\p{{L}}\p{{N}}_]*_[\p{{L}}\p{{N}}_]+|[A-Z][a-z]+[A-Z]') OR NOT list_contains({_STOP_SQL}, lower(t))) AS kept FROM w)
    SELECT conv_id, turn, CASE WHEN len(words) <= 5 OR len(kept) = 0 THEN text ELSE array_to_string(kept, ' ') END AS filtered FROM k"""
)
def stopword_filter(spark, sf_dir):
    """Turns of conversations without stop words."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.filter_stop_words(F.col("text")).alias("filtered"))


_ASKED = "concat_ws(' ', event_type, CASE WHEN event_id % 3 = 0 THEN 'config erro' WHEN event_id % 3 = 1 THEN 'Login, token!' ELSE 'the' END)"


@query(
    rf"""WITH q AS (SELECT event_id, list_filter(regexp_split_to_array(regexp_replace(lower({_ASKED}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: t <> '' AND NOT list_contains({_STOP_SQL}, t)) AS words FROM events),
    t AS (SELECT event_id, flatten(list_transform(words, lambda w: coalesce({_TERMS_SQL}[w], []))) AS t FROM q),
    u AS (SELECT event_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM t),
    d AS (SELECT event_id, term, min(i) AS i FROM u GROUP BY ALL)
    SELECT e.event_id, string_agg(term, ' ' ORDER BY i) AS technical FROM events e LEFT JOIN d USING (event_id) GROUP BY e.event_id"""
)
def query_expand(spark, sf_dir):
    """Technical terms for a query made of each event."""
    return load(spark, sf_dir, "events").select("event_id", text.technical_query(F.expr(_ASKED)).alias("technical"))


@query(
    rf"""WITH s AS (SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') || (['Service', 'Guard', 'View', ''])[(p_partkey % 4 + 1)::INT] AS camel FROM part),
    p AS (SELECT p_partkey, camel, replace(lower(regexp_replace(regexp_replace(camel, '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '-', '_') AS snake FROM s),
    r AS (SELECT *, regexp_replace(regexp_replace(snake, '({"|".join(SUFFIXES)})$', ''), '_+$', '') AS short FROM p)
    SELECT p_partkey, camel, CASE WHEN short <> '' THEN short ELSE snake END AS norm FROM r"""
)
def normalize_names(spark, sf_dir):
    """Part names as identifiers, normalised."""
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    suffix = F.element_at(F.array(*map(F.lit, ("Service", "Guard", "View", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    df = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.array_join(words, ""), suffix).alias("camel"))
    return df.withColumn("norm", text.normalized_name(F.col("camel")))


_VERSIONS = """
old AS (SELECT source || '/' || doc_id || '.' || lang AS file_path, sha256(text) AS file_hash FROM documents WHERE lang <> 'fr'),
new AS (SELECT source || '/' || doc_id || '.' || lang AS file_path, sha256(CASE WHEN lang = 'de' THEN text || 'x' ELSE text END) AS file_hash FROM documents WHERE lang <> 'es')"""


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of a tree: French files are new, German ones changed, Spanish ones gone."""
    d = load(spark, sf_dir, "documents").withColumn("file_path", F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit("."), "lang"))
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    old = d.filter("lang <> 'fr'").select("file_path", F.sha2("text", 256).alias("file_hash"))
    return old, d.filter("lang <> 'es'").select("file_path", F.sha2(changed, 256).alias("file_hash"))


@query(
    f"""WITH {_VERSIONS} SELECT coalesce(o.file_path, n.file_path) AS file_path,
    CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN o.file_hash = n.file_hash THEN 'unchanged' ELSE 'modified' END AS state
    FROM old o FULL OUTER JOIN new n ON o.file_path = n.file_path"""
)
def reindex_diff(spark, sf_dir):
    """What an incremental index run must do."""
    return reporting.reindex_diff(*_versions(spark, sf_dir))


@query(f"WITH {_VERSIONS} SELECT n.file_path, coalesce(o.file_hash <> n.file_hash, true) AS stale FROM new n LEFT JOIN old o ON o.file_path = n.file_path")
def stale_files(spark, sf_dir):
    """Whether each file has changed since it was indexed."""
    from .operators.lookups import staleness

    return staleness(*_versions(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT language, count(*) AS chunks, count(DISTINCT file_path) AS files, grouping(language)::INT AS is_total FROM chunks GROUP BY GROUPING SETS ((), (language))")
def inspect_global(spark, sf_dir):
    """Chunks and files, in all and by language."""
    out = reporting.inspect_global(chunks(spark, sf_dir))
    return out.withColumn("is_total", F.col("is_total").cast("int"))


@query(
    f"""WITH {_RESULTS}, ix AS (SELECT list_sort(list_distinct(list(language))) AS indexed FROM chunks),
    f AS (SELECT qid, list_sort(list_distinct(list(language))) AS found, avg(score) AS mean FROM res GROUP BY qid),
    j AS (SELECT b.item_id AS qid, text AS query, indexed, coalesce(found, []) AS found, coalesce(mean, 0.0) AS mean, len(coalesce(found, []))::DOUBLE / len(indexed) AS ratio FROM benchmark b LEFT JOIN f ON f.qid = b.item_id, ix),
    c AS (SELECT *, CASE WHEN ratio >= 0.8 AND mean > 0.7 THEN 'high' WHEN ratio >= 0.5 OR mean BETWEEN 0.5 AND 0.7 THEN 'partial' ELSE 'low' END AS confidence FROM j)
    SELECT qid, array_to_string(indexed, ',') AS languages_indexed, array_to_string(found, ',') AS languages_found,
      array_to_string(list_filter(indexed, lambda x: NOT list_contains(found, x)), ',') AS missing, round(ratio, 4) AS ratio, round(mean, 4) AS mean_score, confidence,
      confidence <> 'high' AND len(regexp_split_to_array(trim(query), '\\s+')) > 1 AS suggest FROM c"""
)
def coverage(spark, sf_dir):
    """Which languages the hybrid results cover."""
    return reporting.coverage(_hybrid_results(spark, sf_dir), chunks(spark, sf_dir), benchmark_queries(spark, sf_dir))


@query(
    f"""WITH {_RESULTS}, p AS (SELECT qid, file_path, size_bytes, length(file_path) + length(name) AS n FROM res),
    w AS (SELECT qid, sum(ceil(size_bytes / 4.0)::BIGINT)::BIGINT AS without FROM (SELECT DISTINCT qid, file_path, size_bytes FROM p) GROUP BY qid),
    s AS (SELECT qid, ceil((sum(n) + 2 * count(*)) / 4.0)::BIGINT AS with_engine FROM p GROUP BY qid)
    SELECT qid, without, with_engine, greatest(0, without - with_engine) AS saved,
      CASE WHEN without > 0 THEN round(greatest(0, without - with_engine)::DOUBLE / without * 100, 1) ELSE 0.0 END AS reduction_pct FROM w JOIN s USING (qid)"""
)
def token_savings(spark, sf_dir):
    """Tokens of the result list (path and name) against tokens of whole files."""
    results = _hybrid_results(spark, sf_dir).withColumn("payload", F.concat("file_path", "name"))
    return reporting.savings(results, chunks(spark, sf_dir).select("file_path", "size_bytes"))


@query("SELECT sum(floor(value)::BIGINT)::BIGINT AS total_saved, count(*) AS total_queries, max(ts) AS last_updated FROM events")
def cumulative_metrics(spark, sf_dir):
    """Events as a log of queries."""
    return reporting.cumulative(load(spark, sf_dir, "events").select(F.floor("value").cast("long").alias("saved"), F.col("ts").alias("queried_at")))


@query(
    """SELECT event_id, user_id, floor(value)::BIGINT AS saved, (sum(floor(value)::BIGINT) OVER w)::BIGINT AS saved_so_far, count(*) OVER w AS queries_so_far
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def running_savings(spark, sf_dir):
    """What each user had saved and asked up to each event."""
    log = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("saved"))
    return reporting.running(log, ["ts", "event_id"]).drop("ts")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, sum(floor(value)::BIGINT)::BIGINT AS saved, count(*) AS queries FROM events GROUP BY 1")
def savings_by_window(spark, sf_dir):
    """Savings by ten minutes of event time, by the operator that also runs on a stream."""
    from .streaming.increments import savings_by_window as by_window

    return by_window(load(spark, sf_dir, "events").select(F.col("ts").alias("queried_at"), F.floor("value").cast("long").alias("saved")))


@query(f"WITH {_CHUNKS} SELECT dir, language, file_path, name, chunk_type, line_start_ AS line_start FROM (SELECT *, 1 AS line_start_ FROM chunks) WHERE starts_with(file_path, 'src7/') ORDER BY file_path, line_start LIMIT 50")
def directory_chunks(spark, sf_dir):
    """The first chunks below a directory; fifty is the lookup's own limit."""
    from .operators.lookups import by_directory

    return by_directory(chunks(spark, sf_dir), "src7").select("dir", "language", "file_path", "name", "chunk_type", "line_start")


@query(f"WITH {_VERSIONS} SELECT file_path, min(file_hash) AS file_hash FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY file_path")
def file_hashes(spark, sf_dir):
    """One hash for each path of two states of a tree."""
    from .operators.lookups import file_hashes as by_path

    old, new = _versions(spark, sf_dir)
    return by_path(old.unionByName(new))


_GRADED = """
exp AS (SELECT q.vec_id AS qid, c.vec_id AS item, 2 + (c.vec_id % 2)::INT AS grade FROM embeddings q JOIN embeddings c ON c.label = q.label WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
g AS (SELECT v.qid, v.rank, coalesce(grade, 0) AS grade FROM vec v LEFT JOIN exp ON exp.qid = v.qid AND exp.item = v.chunk_id),
per AS (SELECT qid, count(*) AS returned, count(*) FILTER (grade >= 2) AS hits, min(rank) FILTER (grade >= 2) AS first_, sum((2.0 ** grade - 1) / log2(rank + 1.0)) AS dcg FROM g GROUP BY qid),
o AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, item) AS i FROM exp),
best AS (SELECT qid, count(*) AS relevant, sum((2.0 ** grade - 1) / log2(i + 1.0)) FILTER (i <= 10) AS ideal FROM o GROUP BY qid),
pr AS (SELECT qid, hits::DOUBLE / returned AS p, hits::DOUBLE / relevant AS r, 1.0::DOUBLE / first_ AS f, dcg / ideal AS nd FROM per JOIN best USING (qid)),
q AS (SELECT qid, 'semantic' AS method, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1, round(coalesce(f, 0.0), 4) AS mrr, round(nd, 4) AS ndcg FROM pr)"""


def _quality(spark, sf_dir) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    found = retrieval.vector_top_k(e, q, 10).select("qid", F.lit("semantic").alias("method"), "rank", F.col("chunk_id").alias("item"))
    mates = e.filter(ASKED).select(F.col("chunk_id").alias("qid"), "label").join(e.select(F.col("chunk_id").alias("item"), "label"), "label").filter("qid <> item").drop("label")
    return evaluation.measures(found, mates.withColumn("grade", (2 + F.col("item") % 2).cast("int")), 10)


@query(f"WITH {_VECTOR.format(k=10, where='')}, {_GRADED} SELECT * FROM q")
def retrieval_quality(spark, sf_dir):
    """Precision, recall, f1, reciprocal rank and gain of the vector search, same labels being relevant."""
    return _quality(spark, sf_dir)


@query(
    f"""WITH {_VECTOR.format(k=10, where='')}, {_GRADED},
    c AS (SELECT vec_id AS qid, 'c' || vec_id % 3 AS category, 'd' || vec_id % 2 AS difficulty FROM embeddings)
    SELECT method, category, difficulty, count(*) AS queries, round(avg(precision) + 1e-9, 4) AS precision, round(avg(recall) + 1e-9, 4) AS recall, round(avg(f1) + 1e-9, 4) AS f1, round(avg(mrr) + 1e-9, 4) AS mrr, round(avg(ndcg) + 1e-9, 4) AS ndcg
    FROM q JOIN c USING (qid) GROUP BY GROUPING SETS ((method), (category, method), (difficulty, method))"""
)
def report_grouping_sets(spark, sf_dir):
    """Mean measures by method, category and difficulty."""
    groups = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.concat(F.lit("c"), F.col("vec_id") % 3).alias("category"), F.concat(F.lit("d"), F.col("vec_id") % 2).alias("difficulty"))
    return evaluation.report(_quality(spark, sf_dir), groups)


@query(
    """WITH s AS (SELECT page_id, string_split(html, chr(10)) AS l, html FROM pages)
    SELECT page_id, CASE WHEN len(l) > 15 THEN array_to_string(l[1:15], chr(10)) || chr(10) || '... (' || (len(l) - 15) || ' more lines)' ELSE html END AS shown FROM s"""
)
def line_truncate(spark, sf_dir):
    """The first fifteen lines of each page."""
    return load(spark, sf_dir, "pages").select("page_id", text.first_lines(F.col("html"), 15).alias("shown"))


@query(f"WITH {_CHUNKS} SELECT chunk_id, file_path FROM chunks WHERE ends_with(file_path, '.de') AND starts_with(file_path, 'src1')")
def path_filters(spark, sf_dir):
    """Chunks of an extension below a path prefix."""
    return chunks(spark, sf_dir).filter(text.path_filter(F.col("file_path"), ".de", "src1")).select("chunk_id", "file_path")


def queries() -> dict:
    from . import catalog_files  # noqa: F401  registers its own

    return registered()


def oracle_sql() -> dict[str, str]:
    from . import catalog_files  # noqa: F401

    return oracles()
