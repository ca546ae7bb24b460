"""The seven entry points: index a repository, search it in three ways, audit, read, inspect.

Searches take one query or a batch; all queries of a batch share one plan.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import embedding
from ..chunking.files import chunk_files
from ..config import Config
from ..errors import EngineError, as_response
from ..functions import text
from ..operators import expansion, lookups, ranking, reporting, retrieval
from ..schema import CALLERS, EMBEDDED, FILES, META, POSTINGS, QUERY_LOG
from ..shared import written
from ..sources.repo import find_root, read_repository
from ..sources.snapshots import Snapshots, index_folder, upserted

#: Lines of a chunk that a search and a file listing show.
SHOWN, SHOWN_IN_FILE = 15, 20
CHUNK_KEYS = ("file_path", "name", "line_start")


class Engine:
    def __init__(self, spark: SparkSession, repository: str, base: str, config: Config | None = None, provider: embedding.Provider | None = None):
        self.spark, self.repository, self.config = spark, str(Path(repository).resolve()), config or Config()
        self.provider = provider or embedding.create(self.config)
        self.store = Snapshots(spark, index_folder(base, self.repository))

    @classmethod
    def from_environment(cls, spark: SparkSession, base: str, config_path: str | None = None) -> Engine:
        """The repository that CTS_REPO_PATH names, or else the one around the working folder, under the settings in force."""
        return cls(spark, os.environ.get("CTS_REPO_PATH") or str(find_root(Path.cwd())), base, Config.load(config_path))

    def _k(self, top_k) -> int:
        """A stated number of results, or the configured one."""
        try:
            k = self.config.top_k if top_k is None else int(top_k)
        except (TypeError, ValueError) as e:
            raise EngineError(f"top_k must be a number, not {top_k!r}") from e
        if k < 1:
            raise EngineError("top_k must be at least 1")
        return k

    # indexing

    def live(self) -> DataFrame:
        return read_repository(self.spark, self.repository, self.config.extra_ignore)

    def reindex(self, force: bool = False, progress: Callable[[str], None] | None = None) -> dict:
        """Bring the index up to date by content hash; force makes every chunk anew. Files that are gone leave in both cases."""
        began, tell = time.time(), progress or (lambda stage: None)
        with self.store.lock():
            tell("scanning")
            live, stored = self.live().persist(), self.store.table("files", FILES)
            try:
                diff = reporting.reindex_diff(stored, live)
                if force:
                    diff = diff.withColumn("state", F.when(F.col("state") == "unchanged", "modified").otherwise(F.col("state")))
                diff = diff.persist()
                counts = {r["state"]: r["count"] for r in diff.groupBy("state").count().collect()}
                states = ("new", "modified", "deleted", "unchanged")
                created = 0
                if any(counts.get(s) for s in states[:3]):
                    tell("chunking")
                    changed = live.join(diff.filter("state in ('new', 'modified')").select("file_path"), "file_path", "left_semi")
                    fresh = embedding.embed_chunks(chunk_files(changed, self.config.max_chunk_lines), self.provider)
                    fresh = written(fresh.select(*EMBEDDED.names))
                    created = fresh.count()
                    tell("storing")
                    touched = diff.filter("state <> 'unchanged'")
                    chunks = upserted(self.store.table("chunks", EMBEDDED), fresh, touched)
                    terms = upserted(self.store.table("postings", POSTINGS), self._postings(fresh), touched)
                    files = live.select("file_path", "language", "size_bytes", "file_hash")
                    meta = upserted(self.store.table("meta", META), self._meta(fresh), touched)
                    self.store.commit(chunks=chunks, postings=terms, files=files, meta=meta)
                    # the reverse index of calls follows from the table just stored
                    self.store.commit(callers=self._callers())
                by_language = {r["language"]: r["files"] for r in reporting.languages(live).collect()}
                diff.unpersist()
            finally:
                live.unpersist()
        return {
            "files_scanned": sum(counts.get(s, 0) for s in ("new", "modified", "unchanged")),
            "files_indexed": counts.get("new", 0) + counts.get("modified", 0),
            "files_deleted": counts.get("deleted", 0),
            "chunks_created": created,
            "languages": by_language,
            "duration_ms": int((time.time() - began) * 1000),
        }

    def _ready(self) -> str | None:
        if "callers" in self.store.version():
            return None
        stats = self.reindex()
        return f"First index: {stats['files_scanned']} files scanned, {stats['chunks_created']} chunks created in {stats['duration_ms'] / 1000:.1f} s."

    def delete_file(self, path: str) -> int:
        """Take a file's chunks out of the index; how many there were. It comes back with the next reindex if it is still there."""
        with self.store.lock():
            gone = self.spark.createDataFrame([(path,)], "file_path string")
            count = self.chunks().filter(F.col("file_path") == path).count()
            if count:
                stored = {n: self.store.table(n, kind) for n, kind in (("chunks", EMBEDDED), ("postings", POSTINGS), ("files", FILES), ("meta", META))}
                self.store.commit(**{n: df.join(gone, "file_path", "left_anti").select(*df.columns) for n, df in stored.items()})
                self.store.commit(callers=self._callers())
        return count

    def chunks(self, extension: str | None = None, prefix: str | None = None) -> DataFrame:
        df = self._derived(self.store.table("chunks", EMBEDDED))
        return df.filter(text.path_filter(F.col("file_path"), extension, prefix)) if extension or prefix else df

    # searching

    def _queries(self, query: str | list[str]) -> DataFrame:
        asked = [query] if isinstance(query, str) else list(query)
        return self.spark.createDataFrame(list(enumerate(asked)), "qid long, query string")

    def _vectors(self, queries: DataFrame, column: str) -> DataFrame:
        rows = [(r["qid"], self.provider.embed_query(r[column])) for r in queries.select("qid", column).collect() if r[column]]
        return self.spark.createDataFrame(rows, "qid long, vector array<double>")

    @staticmethod
    def _postings(chunks: DataFrame) -> DataFrame:
        """Terms of chunks by field; only chunks of changed files are split into terms."""
        own = chunks.select(F.xxhash64(*CHUNK_KEYS).alias("chunk_id"), "content", "name", "file_path")
        found = retrieval.postings(own, {c: F.col(c) for c in ("content", "name", "file_path")})
        return found.join(own.select("chunk_id", "file_path").distinct(), "chunk_id").select("file_path", "field", "term", "chunk_id", "tf", "size")

    @staticmethod
    def _derived(chunks: DataFrame) -> DataFrame:
        return chunks.withColumns(
            {
                "chunk_id": F.xxhash64(*CHUNK_KEYS),
                "dir": text.directory_of(F.col("file_path")),
                "norm": text.normalized_name(F.col("name")),
                "filled": text.filled_lines(F.col("content")),
            }
        )

    def _meta(self, chunks: DataFrame) -> DataFrame:
        return self._derived(chunks).select("chunk_id", "file_path", "dir", "name", "norm", "chunk_type", "language", "line_start", "filled", "calls")

    def _callers(self) -> DataFrame:
        meta = self.store.table("meta", META)
        return expansion.callers_index(meta.select("chunk_id", F.col("name").alias("caller"), F.posexplode("calls").alias("at", "callee")), meta)

    def get_callers(self, name: str) -> list[str]:
        """Names that call a name, out of the stored reverse index."""
        return [r["caller"] for r in lookups.callers_of(self.store.table("callers", CALLERS), name).collect()]

    def _fts(self, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        index = self.store.table("postings", POSTINGS).drop("file_path")
        return retrieval.text_top_k(index, self.chunks().count(), queries, k, chunks.select("chunk_id"))

    def _expanded(self, found: DataFrame, chunks: DataFrame, k: int, extension: str | None) -> DataFrame:
        """Callees, callers, siblings, counterparts, each seeing what came before; reranked, then tests."""
        meta = self.store.table("meta", META)
        base, callers = meta.drop("calls"), self.store.table("callers", CALLERS)
        calls = meta.select("chunk_id", F.posexplode("calls").alias("at", "callee"))
        tail = base.select("chunk_id", "norm", "filled")

        def grown(results: DataFrame, more: DataFrame) -> DataFrame:
            names = [c for c in results.columns if c not in ("norm", "filled", "stage")]
            return written(expansion.appended(results.select(*names), more).drop("stage").join(tail, "chunk_id"))

        results = written(found.join(base, "chunk_id").withColumnRenamed("rank", "pos"))
        results = grown(results, expansion.via_calls(results, calls, base, k))
        results = grown(results, expansion.via_callers(results, callers, base))
        results = grown(results, expansion.siblings(results, base, extension))
        results = grown(results, expansion.cross_layer(results, base))
        tests = expansion.test_files(results, base)
        ordered = ranking.rerank(results).drop("pos", "norm", "filled").withColumnRenamed("rank", "pos")
        return written(expansion.appended(ordered, tests).drop("stage", "line_start").withColumnRenamed("pos", "rank"))

    def search_semantic(self, query: str | list[str], top_k: int | None = None, extension: str | None = None, prefix: str | None = None, file_filter: str | None = None) -> DataFrame:
        """By meaning. Queries with technical terms are asked in both wordings and fused; others pass the threshold and type boosts."""
        self._ready()
        extension, prefix = text.file_filter(file_filter, extension, prefix)
        k, chunks, queries = self._k(top_k), self.chunks(extension, prefix), self._queries(query)
        queries = written(queries.withColumn("technical", text.technical_query(F.col("query"))))
        first = written(retrieval.vector_top_k(chunks, self._vectors(queries, "query"), 2 * k))
        both = queries.filter("technical is not null")
        second = retrieval.vector_top_k(chunks, self._vectors(both, "technical"), 2 * k)
        fused = retrieval.rank_fusion(first.join(both.select("qid"), "qid", "left_semi"), second, 2 * k, k)
        single = first.join(both.select("qid"), "qid", "left_anti").filter((F.col("rank") <= k) & (F.col("score") >= ranking.THRESHOLD))
        boosted = ranking.boosted(single.drop("rank").join(chunks.select("chunk_id", "chunk_type"), "chunk_id")).drop("chunk_type")
        boosted = retrieval.ranked(boosted, [F.col("score").desc(), "chunk_id"])
        return self._expanded(fused.unionByName(boosted), chunks, k, extension)

    def search_exact(self, query: str | list[str], top_k: int | None = None, extension: str | None = None, prefix: str | None = None, file_filter: str | None = None) -> DataFrame:
        """By words of content, name and path; classes first. Nothing is expanded."""
        self._ready()
        extension, prefix = text.file_filter(file_filter, extension, prefix)
        k, chunks = self._k(top_k), self.chunks(extension, prefix)
        found = self._fts(self._queries(query), chunks, k)
        names = ("chunk_id", "file_path", "dir", "name", "chunk_type", "language")
        return ranking.by_type(found.join(chunks.select(*names), "chunk_id"))

    def search_hybrid(self, query: str | list[str], top_k: int | None = None, extension: str | None = None, prefix: str | None = None, file_filter: str | None = None) -> DataFrame:
        """Meaning and words fused, then expanded and reranked."""
        self._ready()
        extension, prefix = text.file_filter(file_filter, extension, prefix)
        k, chunks = self._k(top_k), self.chunks(extension, prefix)
        queries = written(self._queries(query).withColumn("technical", text.technical_query(F.col("query"))))
        first = written(retrieval.vector_top_k(chunks, self._vectors(queries, "query"), 2 * k))
        both = queries.filter("technical is not null")
        second = retrieval.vector_top_k(chunks, self._vectors(both, "technical"), 2 * k)
        twice = retrieval.rank_fusion(first.join(both.select("qid"), "qid", "left_semi"), second, 2 * k, 2 * k)
        vector = twice.unionByName(first.join(both.select("qid"), "qid", "left_anti"))
        words = self._fts(queries.select("qid", text.filter_stop_words(F.col("query")).alias("query")), chunks, 2 * k)
        return self._expanded(retrieval.rank_fusion(vector, words, 2 * k, k), chunks, k, extension)

    def audit_search(self, query: str | list[str], top_k: int = 10) -> DataFrame:
        """What both searches find, and each alone."""
        self._ready()
        top_k, chunks, queries = self._k(top_k), self.chunks(), self._queries(query)
        own = chunks.select("chunk_id", "file_path", "name")
        semantic = retrieval.vector_top_k(chunks, self._vectors(queries, "query"), top_k).join(own, "chunk_id")
        return reporting.audit(semantic, self._fts(queries, chunks, top_k).join(own, "chunk_id"))

    # reading

    def stale(self) -> DataFrame:
        return lookups.staleness(self.store.table("files", FILES), self.live().select("file_path", "file_hash"))

    def _relative(self, path: str) -> str:
        """A path as the index has it: relative to the repository, also where it was given whole."""
        given = Path(path)
        return given.resolve().relative_to(self.repository).as_posix() if given.is_absolute() and given.resolve().is_relative_to(self.repository) else path

    def _file_is_stale(self, path: str) -> bool:
        """Whether one file has changed since it was indexed; no other file is read."""
        at, stored = Path(self.repository) / path, self.store.table("files", FILES).filter(F.col("file_path") == path).first()
        return stored is None or not at.is_file() or hashlib.sha256(at.read_bytes()).hexdigest() != stored["file_hash"]

    def get_file(self, path: str) -> str:
        """A file's chunks as text, marked if the file has changed since."""
        self._ready()
        path = self._relative(path)
        rows = lookups.by_file(self.chunks(), path).select("name", "chunk_type", "line_start", "line_end", "parent_name", text.first_lines(F.col("content"), SHOWN_IN_FILE).alias("shown")).collect()
        if not rows:
            there = (Path(self.repository) / path).is_file()
            raise EngineError(f"{path} isn't in the index" if there else f"there is no file {path}")
        head = path + (" [STALE]" if self._file_is_stale(path) else "")
        return "\n\n".join([head, *(f"{r['chunk_type']} {r['name']}{f' in {r['parent_name']}' if r['parent_name'] else ''} (lines {r['line_start']}-{r['line_end']})\n{r['shown']}" for r in rows)])

    def inspect_index(self, path: str | None = None) -> dict:
        """Counts by language, bytes, stale files and savings so far; or a file's chunks."""
        if path:
            path = self._relative(path)
            rows = lookups.by_file(self.chunks(), path).select("name", "chunk_type", "line_start", "line_end").collect()
            return {"file": path, "chunks": [r.asDict() for r in rows], "stale": self._file_is_stale(path)}
        counts = reporting.inspect_global(self.store.table("meta", META)).collect()
        total = next((r for r in counts if r["is_total"]), None)
        changed = self.stale().filter("stale").orderBy("file_path")
        saved = reporting.cumulative(self.store.log("queries", QUERY_LOG)).first()
        return {
            "files": total["files"] if total else 0,
            "chunks": total["chunks"] if total else 0,
            "languages": {r["language"]: r["chunks"] for r in counts if not r["is_total"]},
            "bytes": self.store.size(),
            "stale_files": changed.count(),
            "stale_listed": [r["file_path"] for r in changed.limit(10).collect()],
            "total_saved": saved["total_saved"],
            "total_queries": saved["total_queries"],
            "last_updated": saved["last_updated"],
        }

    def answer(self, tool: str, *args, **options) -> str:
        """What one of the entry points gives, as JSON; every failure comes back as JSON as well, and none is raised."""
        try:
            if tool in ("search_semantic", "search_exact", "search_hybrid"):
                return self._searched(tool.removeprefix("search_"), *args, **options)
            if tool not in ("audit_search", "get_file", "inspect_index", "reindex", "delete_file", "get_callers"):
                raise EngineError(f"there is no tool {tool!r}")
            found = getattr(self, tool)(*args, **options)
            if isinstance(found, DataFrame):
                found = [r.asDict() for r in found.orderBy("qid", "category", "file_path", "name").collect()]
            return json.dumps({"result": found}, ensure_ascii=False, default=str)
        except Exception as e:  # noqa: BLE001  the caller of a tool sees no exceptions
            return json.dumps(as_response(e))

    def respond(self, kind: str, query: str, **options) -> str:
        """One query's results as JSON with a summary, savings and coverage; errors come back as JSON as well."""
        return self.answer(f"search_{kind}", query, **options)

    def _searched(self, kind: str, query: str, **options) -> str:
        began, notice = time.time(), self._ready()
        found = written(getattr(self, f"search_{kind}")(query, **options))
        content = self.chunks().select("chunk_id", "line_start", "line_end", "parent_name", text.first_lines(F.col("content"), SHOWN).alias("content"))
        full = written(found.join(content, "chunk_id"))
        files = self.store.table("files", FILES)
        payload = full.withColumn("payload", F.to_json(F.struct("file_path", "name", "chunk_type", "line_start", "line_end", "content", "score")))
        saved = reporting.savings(payload, files).first()
        saved = saved.asDict() if saved else {"without": 0, "with_engine": 0, "saved": 0, "reduction_pct": 0.0}
        covered = reporting.coverage(found, self.chunks(), self._queries(query)).first().asDict()
        results = [r.asDict() for r in full.join(self.stale(), "file_path", "left").orderBy("rank").collect()]
        if results:
            entry = self.spark.sql("select current_timestamp() as queried_at").select(F.lit(saved["saved"]).cast("long").alias("saved"), "queried_at")
            self.store.append("queries", entry)
        took = int((time.time() - began) * 1000)
        lines = [notice] if notice else []
        lines += [f"{n}. {r['name']} ({r['chunk_type']}) - {r['file_path']}:{r['line_start']} [score: {r['score']}]" for n, r in enumerate(results, 1)] or ["No results found."]
        lines.append(f"Tokens saved: {saved['saved']:,} ({saved['reduction_pct']}%) | {took} ms")
        body = {"summary": "\n".join(lines), "results": results, "tokens_saved": saved, "coverage": covered, "metadata": {"query_time_ms": took, "notice": notice}}
        return json.dumps(body, ensure_ascii=False, default=str)
