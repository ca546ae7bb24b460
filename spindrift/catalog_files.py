"""Queries over documents as the files of a repository: scanning, chunking, lookups, the store, and quality gates.

Each document stands for a source file; what its chunks are follows from its id, so that SQL can state them.
"""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _CALLERS, _CALLS, _CHUNKS, _HYBRID, _RESULTS, _RRF, _VECTOR, _hybrid, _hybrid_results, _vectors
from .chunking.files import chunk_files
from .functions import text
from .operators import evaluation, expansion, lookups, ranking, reporting, retrieval
from .registry import oracles, query
from .shared import kept, own_folder, written
from .sources.repo import read_repository
from .sources.snapshots import Snapshots, upserted
from .sources.tables import benchmark_queries, calls, chunks, load

#: Statements in the body of a file's function: a third of the files have more than one chunk holds.
_BODY = "doc_id % 3 * 90"
_FILES = f"f AS (SELECT doc_id AS id, ({_BODY})::INT AS n, source || '/' || doc_id AS stem FROM documents WHERE doc_id % 4 = {{part}})"


def _files(spark: SparkSession, sf_dir: str, part: int, language: str, extension: str, template: str, line: str) -> DataFrame:
    """Documents whose id leaves `part` by four as files: {id} in the template is the id, {body} so many times the line."""
    d = load(spark, sf_dir, "documents").filter(F.col("doc_id") % 4 == part)
    number = F.col("doc_id").cast("string")
    fill = lambda x: F.replace(F.lit(x), F.lit("{id}"), number)
    content = F.replace(fill(template), F.lit("{body}"), F.repeat(fill(line), F.expr(_BODY).cast("int")))
    return d.select(F.concat("source", F.lit("/"), number, F.lit(extension)).alias("file_path"), content.alias("content"), F.sha2("text", 256).alias("file_hash"), F.lit(language).alias("language"))


def _shown(found: DataFrame) -> DataFrame:
    joined = lambda c, by: F.array_join(c, by).alias(c)
    return found.select("file_path", "chunk_type", "name", "line_start", "line_end", "parent_name", joined("calls", ","), joined("outline", " | "), joined("imports", " | "), "language")


def _chunk_rows(part: int, language: str, extension: str, imports: str, rows: list[tuple], function: tuple) -> str:
    """SQL for the chunks: rows of (type, name, first, last, parent, calls, outline), {id} in any of them; function: (name, line, calls before and behind the body's)."""
    text_of = lambda x: "replace('" + x.replace("'", "''") + "', '{id}', id::VARCHAR)"
    fixed = " UNION ALL ".join(
        f"SELECT stem, '{kind}' AS chunk_type, {text_of(name)} AS name, {a} AS line_start, {b} AS line_end, {text_of(parent)} AS parent_name, {text_of(called)} AS calls, {text_of(shape)} AS outline FROM f"
        for kind, name, a, b, parent, called, shape in rows
    )
    name, at, plain, long, tail = function
    own = f"CASE WHEN n > 0 THEN {text_of(long)} ELSE {text_of(plain)} END"
    whole = f"SELECT stem, 'function', {text_of(name)}, {at}, {at} + n + {tail}, '', {own}, '' FROM f WHERE n + {tail} + 1 <= 150"
    parts = " UNION ALL ".join(
        f"SELECT stem, 'function', {text_of(name)} || '__part{k}', {a}, {b}, '', {own}, '' FROM f WHERE n + {tail} + 1 > 150" for k, a, b in ((1, f"{at} + 1", f"{at} + 150"), (2, f"{at} + 151", f"{at} + n + 1"))
    )
    return f"""WITH {_FILES.format(part=part)}, every AS ({fixed} UNION ALL {whole} UNION ALL {parts})
    SELECT stem || '{extension}' AS file_path, chunk_type, name, line_start::INT AS line_start, line_end::INT AS line_end, parent_name, calls, outline,
      replace('{imports.replace("'", "''")}', '{{id}}', regexp_extract(stem, '[0-9]+$')) AS imports, '{language}' AS language FROM every"""


_PYTHON = """import os
from lib{id} import helper{id}, other

class Stock{id}:
    def __init__(self, n):
        self.n = n

    async def load{id}(self):
        rows = fetch(self.n)
        return self.clean(rows)

    @property
    def size(self):
        return 1

def use_{id}(x):
{body}    return other(x)

@cached
def hidden(x):
    return x

LIMIT = 3
"""


@query(
    _chunk_rows(
        0,
        "python",
        ".py",
        "import os | from lib{id} import helper{id}, other",
        [
            ("class", "Stock{id}", 4, 14, "", "", "def __init__(self, n): | async def load{id}(self):"),
            ("method", "__init__", 5, 6, "Stock{id}", "", ""),
            ("method", "load{id}", 8, 10, "Stock{id}", "clean,fetch", ""),
        ],
        ("use_{id}", 16, "other", "other,step{id}", 1),
    )
)
def chunk_python(spark, sf_dir):
    """Python files: classes as outlines, methods, functions in parts where long; no decorated definitions, no module code."""
    return _shown(chunk_files(_files(spark, sf_dir, 0, "python", ".py", _PYTHON, "    a = step{id}(x)\n")))


_TYPESCRIPT = """import { a{id} } from './lib{id}';
import b from 'b';

export interface Shape{id} {
  side: number;
  area(): number;
}

export class Stock{id} extends Base {
  private n = 1;
  constructor(n: number) {
    super();
  }
  async load{id}(id: string): Promise<void> {
    const rows = await fetch(id);
    return this.clean(rows);
  }
}

export function use{id}(x: number) {
{body}  return other(x);
}

const arrow = () => 1;
type Row = number;
"""


@query(
    _chunk_rows(
        1,
        "typescript",
        ".ts",
        "import { a{id} } from './lib{id}'; | import b from 'b';",
        [
            ("class", "Shape{id}", 4, 7, "", "", "side: number; | area(): number;"),
            ("class", "Stock{id}", 9, 18, "", "", "constructor(n: number) { | async load{id}(id: string): Promise<void> {"),
            ("method", "constructor", 11, 13, "Stock{id}", "", ""),
            ("method", "load{id}", 14, 17, "Stock{id}", "clean,fetch", ""),
        ],
        ("use{id}", 20, "other", "other,step{id}", 2),
    )
)
def chunk_typescript(spark, sf_dir):
    """TypeScript files: interfaces, exported classes and functions; no arrow functions and types."""
    return _shown(chunk_files(_files(spark, sf_dir, 1, "typescript", ".ts", _TYPESCRIPT, "  step{id}(x);\n")))


_JAVASCRIPT = """import b from './lib{id}';

class Stock{id} {
  load{id}(id) {
    return this.clean(b(id));
  }
}

function use{id}(x) {
{body}  return lib.other(x);
}

export default function () {
  return 1;
}
"""


@query(
    _chunk_rows(
        2,
        "javascript",
        ".js",
        "import b from './lib{id}';",
        [
            ("class", "Stock{id}", 3, 7, "", "", "load{id}(id) {"),
            ("method", "load{id}", 4, 6, "Stock{id}", "b,clean", ""),
            ("function", "{id}", "13 + n", "15 + n", "", "", ""),
        ],
        ("use{id}", 9, "other", "other,step{id}", 2),
    )
)
def chunk_javascript(spark, sf_dir):
    """JavaScript files: what is exported by default without a name takes the file's."""
    return _shown(chunk_files(_files(spark, sf_dir, 2, "javascript", ".js", _JAVASCRIPT, "  step{id}(x);\n")))


_DART = """import 'package:a/lib{id}.dart';

class Stock{id} extends Base {
  final int n;
  Stock{id}(this.n);
  Stock{id}.empty() : n = 0;
  int get size => n;
  @override
  Future<void> load{id}(String id) async {
    final rows = await fetch(id);
    clean(rows);
    Widget(rows);
  }
}

mixin Mix{id} on Base {
  void mixed{id}() {
    helper{id}();
  }
}

extension Ext{id} on String {
  String twice{id}() => this + this;
}

enum Kind{id} { a, b }

int use{id}(int x) {
{body}  return other(x);
}
"""


@query(
    _chunk_rows(
        3,
        "dart",
        ".dart",
        "import 'package:a/lib{id}.dart';",
        [
            ("class", "Stock{id}", 3, 14, "", "", "Stock{id}(this.n); | Stock{id}.empty() : n = 0; | int get size => n; | Future<void> load{id}(String id) async {"),
            ("method", "Stock{id}", 5, 5, "Stock{id}", "", ""),
            ("method", "empty", 6, 6, "Stock{id}", "", ""),
            ("method", "size", 7, 7, "Stock{id}", "", ""),
            ("method", "load{id}", 8, 13, "Stock{id}", "clean,fetch", ""),
            ("class", "Mix{id}", 16, 20, "", "", "void mixed{id}() {"),
            ("method", "mixed{id}", 17, 19, "Mix{id}", "helper{id}", ""),
            ("class", "Ext{id}", 22, 24, "", "", "String twice{id}() => this + this;"),
            ("method", "twice{id}", 23, 23, "Ext{id}", "", ""),
        ],
        ("use{id}", 28, "other", "other,step{id}", 2),
    )
)
def chunk_dart(spark, sf_dir):
    """Dart files: classes, mixins and extensions with their members, named constructors and getters; enums make none."""
    return _shown(chunk_files(_files(spark, sf_dir, 3, "dart", ".dart", _DART, "  step{id}(x);\n")))


#: Folders and names that a tree of documents has, by the id; some are ignored, and some aren't source files.
_PLACES = ("src/{id}.py", "node_modules/{id}.js", "app/{id}.ts", "gen/{id}.py", "lib/{id}.dart", "build/{id}.js", "docs/{id}.md", "app/__pycache__/{id}.py", "src/deep/er/{id}.tsx", "web/{id}.min.js")
_PLACE_SQL = "CASE doc_id % 10 " + " ".join(f"WHEN {n} THEN replace('{p}', '{{id}}', doc_id::VARCHAR)" for n, p in enumerate(_PLACES)) + " END"


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder that all tasks see, with one file for each document and a .gitignore; made once a session."""

    def make() -> str:
        root = Path(own_folder(spark, "tree").removeprefix("file://").removeprefix("file:"))
        root.mkdir(parents=True, exist_ok=True)
        (root / ".gitignore").write_text("# made\ngen/\n*.min.js\n")
        (root / ".git").mkdir(exist_ok=True)

        def write(batches):
            for pdf in batches:
                for i, body in zip(pdf["doc_id"], pdf["text"], strict=True):
                    at = root / _PLACES[i % len(_PLACES)].replace("{id}", str(i))
                    at.parent.mkdir(parents=True, exist_ok=True)
                    at.write_bytes((body or "").encode())
                yield pd.DataFrame({"n": [len(pdf)]})

        load(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(write, "n long").agg(F.sum("n")).collect()
        return str(root)

    return kept(spark, "tree", sf_dir, make)


_KEPT_SQL = f"""tree AS (SELECT {_PLACE_SQL} AS file_path, text FROM documents),
live AS (
  SELECT file_path, CASE regexp_extract(file_path, '[.][a-z]+$') WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' ELSE 'dart' END AS language,
    strlen(coalesce(text, ''))::BIGINT AS size_bytes, sha256(coalesce(text, '')) AS file_hash FROM tree
  WHERE NOT regexp_matches(file_path, '(^|/)(node_modules|gen|build|__pycache__)/') AND NOT ends_with(file_path, '.min.js') AND NOT ends_with(file_path, '.md'))"""


@query(f"WITH {_KEPT_SQL} SELECT * FROM live")
def scan_repository(spark, sf_dir):
    """The source files of a tree of documents, without ignored folders, ignored lines of its .gitignore, and other kinds of file."""
    return read_repository(spark, _tree(spark, sf_dir)).drop("content")


@query(f"WITH {_KEPT_SQL} SELECT language, count(*) AS files FROM live GROUP BY language")
def scan_languages(spark, sf_dir):
    """Files of the scanned tree by language."""
    return reporting.languages(read_repository(spark, _tree(spark, sf_dir)))


_STATES = """
old AS (SELECT 'd' || doc_id % 50 || '/' || doc_id AS file_path, sha256(text) AS file_hash FROM documents WHERE lang <> 'fr'),
fresh AS (SELECT 'd' || doc_id % 50 || '/' || doc_id AS file_path, sha256(text || 'x') AS file_hash FROM documents WHERE lang IN ('de', 'fr'))"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A stored table, rows that replace or join it, and rows that leave."""
    d = load(spark, sf_dir, "documents").withColumn("file_path", F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string"), F.lit("/"), F.col("doc_id").cast("string")))
    old = d.filter("lang <> 'fr'").select("file_path", F.sha2("text", 256).alias("file_hash"))
    fresh = d.filter("lang in ('de', 'fr')").select("file_path", F.sha2(F.concat("text", F.lit("x")), 256).alias("file_hash"))
    return old, fresh, d.filter("lang = 'es'").select("file_path")


@query(
    f"""WITH {_STATES} SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM fresh) AND file_path NOT IN (SELECT 'd' || doc_id % 50 || '/' || doc_id FROM documents WHERE lang = 'es')
    UNION ALL SELECT * FROM fresh"""
)
def store_upsert(spark, sf_dir):
    """A stored table after an upsert and a deletion, by two versions of a store and read back from it."""
    old, fresh, gone = _states(spark, sf_dir)
    store = Snapshots(spark, own_folder(spark, "store"))
    with store.lock():
        store.commit(files=old)
    with store.lock():
        stored = store.table("files", old.schema)
        store.commit(files=upserted(stored, fresh, fresh.select("file_path").unionByName(gone)))
    return store.table("files", old.schema)


@query(f"WITH {_STATES} SELECT (SELECT count(*) FROM old) AS stored, sum(floor(value)::BIGINT)::BIGINT AS total_saved, count(*) AS total_queries FROM events")
def store_metrics(spark, sf_dir):
    """A query log kept in a store beside another table, read back and added up."""
    log = load(spark, sf_dir, "events").select(F.floor("value").cast("long").alias("saved"), F.col("ts").alias("queried_at"))
    old, _, _ = _states(spark, sf_dir)
    store = Snapshots(spark, own_folder(spark, "log"))
    with store.lock():
        store.commit(files=old, queries=log)
    total = reporting.cumulative(store.table("queries", log.schema)).drop("last_updated")
    return total.withColumn("stored", F.lit(store.table("files", old.schema).count()))


# lookups and filters


@query(f"WITH {_CHUNKS} SELECT chunk_id, file_path, name, chunk_type FROM chunks WHERE name = (SELECT max(name) FROM chunks) ORDER BY file_path LIMIT 1")
def lookup_name(spark, sf_dir):
    """The first chunk of a name, in file order: the name that comes last in order."""
    c = chunks(spark, sf_dir)
    return lookups.by_name(c, c.agg(F.max("name")).first()[0]).select("chunk_id", "file_path", "name", "chunk_type")


_SHARED_CHUNKS = f"{_CHUNKS}, shared AS (SELECT chunk_id, dir || '/' || (chunk_id % 40) AS file_path, name, chunk_type, chunk_id AS line_start, dir, language, filled, content FROM chunks)"


def _shared_files(spark, sf_dir) -> DataFrame:
    """Chunks of which many share a file; the line is the id."""
    return chunks(spark, sf_dir).withColumn("file_path", F.concat("dir", F.lit("/"), (F.col("chunk_id") % 40).cast("string"))).withColumn("line_start", F.col("chunk_id"))


@query(
    f"""WITH {_SHARED_CHUNKS} SELECT file_path, name, chunk_type, line_start, row_number() OVER (ORDER BY CASE chunk_type WHEN 'class' THEN 0 WHEN 'method' THEN 1 WHEN 'function' THEN 2 ELSE 3 END, line_start) AS pos
    FROM shared WHERE file_path = (SELECT min(file_path) FROM shared)"""
)
def lookup_file(spark, sf_dir):
    """A file's chunks in its order: classes, methods, functions, each by line."""
    c = _shared_files(spark, sf_dir)
    found = lookups.by_file(c, c.agg(F.min("file_path")).first()[0])
    order = F.expr("row_number() over (order by case chunk_type when 'class' then 0 when 'method' then 1 when 'function' then 2 else 3 end, line_start)")
    return found.withColumn("pos", order).select("file_path", "name", "chunk_type", "line_start", "pos")


@query(
    f"""WITH {_SHARED_CHUNKS}, now AS (SELECT file_path, max(sha256(content)) AS file_hash FROM shared GROUP BY file_path), was AS (SELECT file_path, min(sha256(content)) AS file_hash FROM shared GROUP BY file_path)
    SELECT file_path, count(*) AS chunks, min(line_start) AS first_line, now.file_hash <> was.file_hash AS stale FROM shared JOIN now USING (file_path) JOIN was USING (file_path) GROUP BY file_path, now.file_hash, was.file_hash"""
)
def inspect_files(spark, sf_dir):
    """Every file with its chunks and whether it has changed since it was indexed."""
    c = _shared_files(spark, sf_dir)
    state = lambda f: c.groupBy("file_path").agg(f(F.sha2("content", 256)).alias("file_hash"))
    stale = lookups.staleness(state(F.min), state(F.max))
    return c.groupBy("file_path").agg(F.count("*").alias("chunks"), F.min("line_start").alias("first_line")).join(stale, "file_path")


@query(f"WITH {_CHUNKS}, {_CALLS}, {_CALLERS} SELECT callee, caller, times FROM callers WHERE callee = (SELECT min(callee) FROM callers)")
def lookup_callers(spark, sf_dir):
    """Who calls one name, out of a reverse index that is stored."""
    index = written(expansion.callers_index(calls(spark, sf_dir), chunks(spark, sf_dir)))
    return lookups.callers_of(index, index.agg(F.min("callee")).first()[0])


@query(f"WITH {_CHUNKS} SELECT file_path, name, chunk_type, language FROM chunks")
def lookup_metadata(spark, sf_dir):
    """All chunks without their contents."""
    return lookups.metadata(chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS}, {_CALLS} SELECT name, string_agg(callee, ',' ORDER BY at_) AS calls FROM chunks JOIN calls USING (chunk_id) GROUP BY chunk_id, name")
def lookup_calls(spark, sf_dir):
    """Names and what they call, in order."""
    made = calls(spark, sf_dir).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "callee"))).alias("calls"))
    found = lookups.with_calls(chunks(spark, sf_dir).join(made.withColumn("calls", F.transform("calls", lambda c: c["callee"])), "chunk_id"))
    return found.select("name", F.array_join("calls", ",").alias("calls"))


_ODD = "CASE doc_id % 4 WHEN 0 THEN 'a_b/' WHEN 1 THEN 'axb/' WHEN 2 THEN 'a%b/' ELSE 'a''b/' END || doc_id || '.' || lang"


@query(f"SELECT doc_id, p AS file_path, w AS asked FROM (SELECT doc_id, {_ODD} AS p, unnest(['a_b/', 'a%b/', 'a''b/', '.de']) AS w FROM documents) WHERE CASE WHEN w = '.de' THEN ends_with(p, w) ELSE starts_with(p, w) END")
def filter_literal(spark, sf_dir):
    """Filters are literal: signs that are wild in patterns stand for themselves; one alias names an extension or a prefix."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr(_ODD.replace("a''b", "a\\'b")).alias("file_path"))
    out = None
    for asked in ("a_b/", "a%b/", "a'b/", ".de"):
        one = d.filter(text.path_filter(F.col("file_path"), *text.file_filter(asked))).withColumn("asked", F.lit(asked))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 0 END AS n, CASE event_id % 4 WHEN 0 THEN event_type || ',z' ELSE '' END AS calls FROM events")
def calls_of_json(spark, sf_dir):
    """Called names out of JSON text, some of it not a list or no JSON."""
    json = F.expr("CASE event_id % 4 WHEN 0 THEN concat('[\"', event_type, '\", \"z\"]') WHEN 1 THEN '[]' WHEN 2 THEN 'no json [' ELSE NULL END")
    e = load(spark, sf_dir, "events").select("event_id", json.alias("calls_json")).withColumn("calls", lookups.calls_from_json())
    return e.select("event_id", F.size("calls").alias("n"), F.array_join("calls", ",").alias("calls"))


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(replace(lower(p_name), ' ', '_'), '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') AS pascal FROM part")
def pascal_names(spark, sf_dir):
    """Snake-case names as class names."""
    snake = F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))
    return load(spark, sf_dir, "part").select("p_partkey", text.pascal_name(snake).alias("pascal"))


# searches


def _fields(name: str, column: str) -> str:
    return f"SELECT chunk_id, '{name}' AS field, unnest(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM chunks"


@query(
    f"""WITH {_CHUNKS}, terms AS ({_fields('content', 'content')} UNION ALL {_fields('name', 'name')} UNION ALL {_fields('file_path', 'file_path')}),
    tf AS (SELECT field, chunk_id, term, count(*) AS tf FROM terms GROUP BY ALL), size AS (SELECT field, chunk_id, sum(tf) AS size FROM tf GROUP BY ALL),
    mean AS (SELECT field, sum(tf) / (SELECT count(*) FROM documents)::DOUBLE AS mean FROM tf GROUP BY field), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
    idf AS (SELECT field, term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY field, term, n),
    asked AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
    hits AS (SELECT qid, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
      FROM asked JOIN tf USING (term) JOIN idf USING (field, term) JOIN size USING (field, chunk_id) JOIN mean USING (field) GROUP BY qid, chunk_id)
    SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM hits QUALIFY rank <= 5"""
)
def fts_fields(spark, sf_dir):
    """Full-text search over content, name and path, scores of the three added up."""

    def make():
        c = chunks(spark, sf_dir)
        return written(retrieval.postings(c, {f: F.col(f) for f in ("content", "name", "file_path")})), c.count()

    return retrieval.text_top_k(*kept(spark, "postings of three fields", sf_dir, make), benchmark_queries(spark, sf_dir), 5)


@query(
    f"""WITH {_VECTOR.format(k=10, where="")}, l AS (SELECT qid, chunk_id, rank FROM vec WHERE qid % 200 = 0),
    r AS (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(t.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) DESC, c.vec_id) AS rank
      FROM embeddings q JOIN embeddings t ON t.vec_id = q.vec_id + 1 CROSS JOIN embeddings c WHERE q.vec_id % 200 = 0 QUALIFY rank <= 10), {_RRF}
    SELECT qid, chunk_id, rank FROM fused UNION ALL SELECT qid, chunk_id, rank FROM vec WHERE qid % 200 <> 0 AND rank <= 5"""
)
def dual_vectors(spark, sf_dir):
    """Queries with a second wording fused from both rankings, the others by their one: the next id's vector is the other wording of each second query."""
    e, q = _vectors(spark, sf_dir)
    first = written(retrieval.vector_top_k(e, q, 10))
    other = e.select((F.col("chunk_id") - 1).alias("qid"), F.col("embedding").alias("vector")).filter("qid % 200 = 0")
    second = retrieval.vector_top_k(e, other.join(q.select("qid"), "qid", "left_semi"), 10)
    return retrieval.two_wordings(first, second, 10, 5).select("qid", "chunk_id", "rank")


def _oracle(name: str) -> str:
    return oracles()[name]


@query(
    f"""WITH {_RESULTS}, every AS (
      SELECT 0 AS stage, qid, pos, chunk_id, score FROM res UNION ALL SELECT 1, qid, pos, chunk_id, score FROM ({_oracle("expand_calls")}) UNION ALL SELECT 2, qid, pos, chunk_id, score FROM ({_oracle("expand_callers")})
      UNION ALL SELECT 3, qid, pos, chunk_id, score FROM ({_oracle("test_association")}))
    SELECT qid, stage, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY stage, pos, chunk_id) AS pos FROM every"""
)
def expansion_union(spark, sf_dir):
    """Results, what they call, who calls them, and their tests, one after the other."""
    from .catalog import _with_tests

    c, results = chunks(spark, sf_dir), _hybrid_results(spark, sf_dir)
    made = calls(spark, sf_dir)
    stages = results, expansion.via_calls(results, made, c, 5), expansion.via_callers(results, expansion.callers_index(made, c), c), expansion.test_files(results, _with_tests(c))
    return expansion.appended(*stages).select("qid", "stage", "chunk_id", "score", "pos")


_DEEP = "split_part(file_path, '/', 1) || '/g' || (chunk_id % 2) || '/f' || (chunk_id % 30) || '.' || language"


@query(
    f"""WITH {_RESULTS}, deep AS (SELECT chunk_id, split_part(file_path, '/', 1) || '/f' || (chunk_id % 3) AS file_path, dir, filled, score, qid, pos FROM res),
    h AS (SELECT *, count(*) OVER (PARTITION BY qid, dir) AS mates, CASE WHEN filled < 3 THEN round(score * 0.5, 6) ELSE score END AS s1 FROM deep),
    m AS (SELECT *, CASE WHEN mates >= 2 THEN round(s1 * 1.05, 6) ELSE s1 END AS s2 FROM h),
    d AS (SELECT *, row_number() OVER (PARTITION BY qid, file_path ORDER BY s2 DESC, pos) AS n FROM m QUALIFY n <= 2)
    SELECT qid, chunk_id, file_path, s2 AS score, row_number() OVER (PARTITION BY qid ORDER BY s2 DESC, pos) AS rank FROM d"""
)
def rerank_shared_files(spark, sf_dir):
    """Reranking where results share files: the third and later chunk of a file leaves."""
    shared = F.concat(F.split("file_path", "/")[0], F.lit("/f"), (F.col("chunk_id") % 3).cast("string"))
    return ranking.rerank(_hybrid_results(spark, sf_dir).withColumn("file_path", shared)).select("qid", "chunk_id", "file_path", "score", "rank")


@query(
    f"""WITH {_RESULTS}, every AS (SELECT chunk_id, {_DEEP} AS file_path, chunk_type FROM chunks), own AS (SELECT res.qid, res.pos, res.score, e.* FROM res JOIN every e USING (chunk_id)),
    dirs AS (SELECT qid, regexp_extract(file_path, '^(.*)/', 1) AS dir FROM own GROUP BY ALL HAVING count(*) >= 2), best AS (SELECT qid, max(score) AS top FROM own GROUP BY ALL),
    up AS (SELECT *, unnest([split_part(file_path, '/', 1), split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2)]) AS dir FROM every),
    below AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY dir ORDER BY file_path, chunk_id) <= 50),
    near AS (SELECT d.qid, b.* FROM dirs d JOIN below b USING (dir) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.qid = d.qid AND own.file_path = b.file_path)),
    one AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY qid, file_path ORDER BY CASE chunk_type WHEN 'class' THEN 0 ELSE 1 END, length(dir) DESC, chunk_id) = 1),
    got AS (SELECT qid, chunk_id, file_path, row_number() OVER (PARTITION BY qid ORDER BY CASE chunk_type WHEN 'class' THEN 0 ELSE 1 END, file_path) AS pos FROM one QUALIFY pos <= 5)
    SELECT qid, pos, chunk_id, file_path, round(top * 0.7, 6) AS score FROM got JOIN best USING (qid)"""
)
def module_siblings_nested(spark, sf_dir):
    """Siblings in nested folders whose files hold several chunks."""
    folder = F.concat(F.split("file_path", "/")[0], F.lit("/g"), (F.col("chunk_id") % 2).cast("string"))
    nest = lambda df: df.withColumn("dir", folder).withColumn("file_path", F.concat("dir", F.lit("/f"), (F.col("chunk_id") % 30).cast("string"), F.lit("."), "language"))
    out = expansion.siblings(nest(_hybrid_results(spark, sf_dir)), nest(chunks(spark, sf_dir)))
    return out.select("qid", "pos", "chunk_id", "file_path", "score")


# quality gates

_ANSWERS = f"WITH {_RESULTS}, need AS (SELECT item_id AS qid, unnest(['src' || item_id % 8, 'src' || (item_id + 3) % 8]) AS directory FROM benchmark)"


def _required(spark, sf_dir) -> DataFrame:
    """Two folders that each benchmark query should reach."""
    q = load(spark, sf_dir, "benchmark")
    one = lambda x: F.concat(F.lit("src"), (x % 8).cast("string"))
    return q.select(F.col("item_id").alias("qid"), F.explode(F.array(one(F.col("item_id")), one(F.col("item_id") + 3))).alias("directory"))


@query(
    f"""{_ANSWERS}, met AS (SELECT qid, count(DISTINCT directory) AS met FROM res JOIN need USING (qid) WHERE contains(file_path, directory) GROUP BY qid)
    SELECT r.qid, 'hybrid' AS method, round(coalesce(met, 0)::DOUBLE / 2, 4) AS coverage FROM (SELECT DISTINCT qid FROM res) r LEFT JOIN met USING (qid)"""
)
def directory_coverage(spark, sf_dir):
    """The share of the required folders that each query's results reach."""
    return evaluation.directory_coverage(_hybrid_results(spark, sf_dir).withColumn("method", F.lit("hybrid")), _required(spark, sf_dir))


_VALUES = "v AS (SELECT 'm' || doc_id % 7 AS method, avg(quality)::DOUBLE AS f1, 1 - avg(toxic)::DOUBLE AS precision FROM labels GROUP BY 1)"


def _metrics(spark, sf_dir) -> DataFrame:
    """Means of the labels as the figures of seven methods."""
    l = load(spark, sf_dir, "labels").groupBy(F.concat(F.lit("m"), (F.col("doc_id") % 7).cast("string")).alias("method")).agg(F.avg("quality").alias("f1"), (1 - F.avg("toxic")).alias("precision"))
    return l.select("method", F.expr("stack(2, 'f1', f1, 'precision', precision) as (metric, value)"))


@query(
    f"""WITH {_VALUES}, u AS (SELECT method, 'f1' AS metric, f1 AS value FROM v UNION ALL SELECT method, 'precision', precision FROM v)
    SELECT method, metric, value, CASE metric WHEN 'f1' THEN value >= 0.5 ELSE value >= 0.7 END AS passed FROM u"""
)
def quality_floors(spark, sf_dir):
    """Which figures meet the release's floors."""
    return evaluation.meets_floors(_metrics(spark, sf_dir))


@query(
    f"""WITH {_VALUES}, u AS (SELECT method, 'f1' AS metric, f1 AS value FROM v UNION ALL SELECT method, 'precision', precision FROM v)
    SELECT method, metric, value, base, round((base - value) / base, 4) AS drop, (base - value) / base > 0.05 AS failed
    FROM (SELECT *, CASE WHEN method < 'm3' THEN value * 1.1 ELSE value * 1.01 END AS base FROM u)"""
)
def quality_regressions(spark, sf_dir):
    """Which figures fall more than a twentieth below their baseline."""
    now = _metrics(spark, sf_dir)
    before = now.withColumn("value", F.when(F.col("method") < "m3", F.col("value") * 1.1).otherwise(F.col("value") * 1.01))
    return evaluation.regressions(now, before)


@query("SELECT doc_id AS qid, 'labels' AS method, round(quality / (greatest(1, floor((doc_id % 900 + 4) * 10 / 4)) / 5000.0), 4) AS ter FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)")
def token_efficiency(spark, sf_dir):
    """What quality the sent tokens bought, against those of an explorer without the engine."""
    l = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("qid")).agg(F.max("quality").cast("double").alias("f1")).withColumn("method", F.lit("labels"))
    return evaluation.token_efficiency(l, l.select("qid", "method", ((F.col("qid") % 900 + 4) * 10).alias("characters")))
