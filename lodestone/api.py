"""The engine as a caller sees it: index repositories, ask, look at files. Returns DataFrames; only ``index``, ``compact``,
``delete`` and ``vacuum`` write. Small results (a file, a status) are still DataFrames: whoever shows them collects them.

A repository's version is one manifest of segments. An index run writes a segment of what changed (files, chunks,
postings, counts per term, and the ids of the rows of older segments that are gone) and then the manifest: a run that
dies anywhere leaves the last version as it was, and the next run does the whole work. Term counts are sums over the
segments, negative where chunks went, so an incremental index costs what the change costs; many segments are merged."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import answer
from lodestone.functions import text as t
from lodestone.operators import chunk, context, filenames, fusion, generate, lexical, repository, rerank, vector
from lodestone.operators.order import numbered
from lodestone.params import AST_LANGUAGES, DEFAULTS, Params
from lodestone.sources import embed, walk
from lodestone.sources.cache import ROWS, SearchCache
from lodestone.sources.manifest import Conflict, Versions

STATUS = "repo_id string, version long, url string, commit string, indexed_at string, files long, chunks long, functions long, tokens long, deleted boolean"
#: Chunk kinds that count as functions.
FUNCTIONS = ("function", "method")
PARSED = sorted({*AST_LANGUAGES.values()})
#: More segments are merged into one at the end of an index run.
SEGMENTS = 8
#: What identifies a row of a segment's table.
KEYS = {"files": "file_path", "chunks": "chunk_id", "postings": "doc_id"}


class Engine:
    """Each repository has its own versions, so a change to one writes no other's."""

    def __init__(self, spark: SparkSession, folder: str, params: Params = DEFAULTS, embedder: embed.Embedder | None = None):
        self.spark, self.folder, self.params, self.embedder = spark, folder.rstrip("/"), params, embedder
        self.model = embedder.model if embedder else "hash64"
        self.answers = SearchCache()

    def _versions(self, repo_id: str) -> Versions:
        return Versions(self.spark, f"{self.folder}/repositories/{hashlib.sha256(repo_id.encode()).hexdigest()[:32]}")

    def _current(self, repo_id: str) -> tuple[Versions, dict]:
        v = self._versions(repo_id)
        last = v.read()
        if last is None or last.get("deleted"):
            raise KeyError(f"not indexed: {repo_id}")
        return v, last

    def _live(self, v: Versions, manifest: dict, table: str) -> DataFrame:
        """A table's rows over all segments, less those that a later segment says are gone."""
        segments, key = manifest["segments"], KEYS[table]
        parts = [v.table(s["tables"][table]).withColumn("segment", F.lit(i)) for i, s in enumerate(segments)]
        rows = reduce(DataFrame.unionByName, parts)
        if len(segments) == 1:
            return rows.drop("segment")
        ids = "gone_files" if table == "files" else "gone_chunks"
        gone = reduce(DataFrame.unionByName, [v.table(s["tables"][ids]).withColumn("gone_at", F.lit(i)) for i, s in enumerate(segments)])
        gone = gone.toDF(key, "gone_at").groupBy(key).agg(F.max("gone_at").alias("gone_at"))
        return rows.join(gone, key, "left").where(F.col("gone_at").isNull() | (F.col("gone_at") <= F.col("segment"))).drop("segment", "gone_at")

    def _terms(self, v: Versions, manifest: dict) -> DataFrame:
        """(term, df) over all segments."""
        rows = reduce(DataFrame.unionByName, [v.table(s["tables"]["terms"]) for s in manifest["segments"]])
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _read(self, table: str, repo_id: str) -> DataFrame:
        return self._live(*self._current(repo_id), table)

    def _chunks_of(self, files: DataFrame, aside: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        """(path, content, language) to chunks: definitions where the language is parsed, windows of lines elsewhere. The
        parser's rows are stored by ``aside``, as two parts of the plan read them."""
        p = self.params
        parsed = aside(chunk.syntax_chunks(files.where(F.col("language").isin(*PARSED))), "definitions")
        named = F.concat(F.element_at(F.split("path", "/"), -1), F.lit(":L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
        rest = files.where(~F.col("language").isin(*PARSED)).select("path", "content").unionByName(parsed.where("chunk_type = 'unparsed'").select("path", "content"))
        windows = chunk.sliding_windows(rest, p.window_lines, p.overlap_lines).select("path", "start_line", "end_line", named.alias("name"), F.lit("module").alias("chunk_type"), F.lit(None).cast("string").alias("parent"), "content")
        split = chunk.split_long(parsed.where("chunk_type != 'unparsed'"), p.max_chunk_chars, ("name", "chunk_type", "parent")).drop("piece")
        chunks = windows.unionByName(split)
        return chunks.withColumn("chunk_id", t.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("name"))).dropDuplicates(["chunk_id"])

    def index(self, repo_id: str, source: DataFrame, url: str | None = None, commit: str | None = None, incremental: bool = True, whole: bool = True, batch: int | None = None) -> Iterator[dict]:
        """Source files (path, length, content as bytes) become files and chunks of ``repo_id``. Yields an event per
        stage; nothing is seen before the last.

        With ``incremental`` only files that are new, changed or not wholly embedded are parsed and embedded, and
        nothing at all is done at the commit of the last version; without it everything is. ``whole``: files that the
        source lacks are deleted. ``batch`` numbers the batches of a stream: one that is in the version already is
        skipped."""
        v = self._versions(repo_id)
        last = v.read()
        old = None if last is None or last.get("deleted") or not incremental else last
        if old and ((commit is not None and old["commit"] == commit) or (batch is not None and old.get("batch", -1) >= batch)):
            yield {"stage": "complete", "chunks": old["chunks"], "changed": 0, "current": True}
            return
        scratch = []

        def kept_aside(df: DataFrame, name: str) -> DataFrame:
            scratch.append(v.write(df, name))
            return v.table(scratch[-1])

        yield {"stage": "walking"}
        files = source.withColumn("reason", walk.skip_reason(F.col("path"), F.col("length"), F.col("content")))
        files = files.select(F.col("path").alias("file_path"), "reason", F.when(F.col("reason").isNull(), walk.as_text(F.col("content"))).alias("content"), walk.language(F.col("path")).alias("language"))
        files = files.withColumn("hash", F.sha2("content", 256)).withColumn("total_lines", t.total_lines(F.col("content")).cast("int"))
        fresh = F.lit(True)
        if old:
            known = self._live(v, old, "files").select("file_path", F.col("hash").alias("was"))
            torn = self._live(v, old, "chunks").where("embedding is null").select("file_path").distinct()
            files = files.join(known.join(torn, "file_path", "left_anti"), "file_path", "left")
            fresh = ~F.col("was").eqNullSafe(F.col("hash"))
        walked = kept_aside(files.withColumn("fresh", fresh).withColumn("content", F.when(fresh, F.col("content"))).drop("was"), "scan")
        scan = walked.where("reason is null").drop("reason")
        changed = scan.where("fresh").drop("fresh")
        no_ids = self.spark.createDataFrame([], "id string")
        gone_files, gone_chunks = no_ids, None
        if old:
            left = known.join(scan.where("not fresh"), "file_path", "left_anti") if whole else known.join(changed, "file_path", "left_semi")
            gone_files = kept_aside(left.select(F.col("file_path").alias("id")), "gone")
            gone_chunks = kept_aside(self._live(v, old, "chunks").drop("embedding").join(gone_files.withColumnRenamed("id", "file_path"), "file_path", "left_semi"), "gone")
        n = {"changed": changed.count(), "gone": gone_files.count()}
        n["files"] = (old["files"] if old else 0) + n["changed"] - n["gone"]
        deleted = n["gone"] - (gone_files.withColumnRenamed("id", "file_path").join(changed, "file_path", "left_semi").count() if n["gone"] else 0)
        yield {"stage": "parsing", "files": n["files"]} | ({"changed": n["changed"] + deleted} if old else {})
        texts = self._chunks_of(changed.select(F.col("file_path").alias("path"), "content", "language"), kept_aside).withColumn("text", F.concat_ws("\n", "path", "content"))
        texts = kept_aside(texts.withColumn("hash", embed.content_hash(F.col("text"))), "texts")
        yield {"stage": "embedding"}
        cache = self.spark.createDataFrame([], "hash string, model string, embedding array<float>")
        if old and old["model"] == self.model:
            cache = self._live(v, old, "chunks").where("embedding is not null").select("hash", F.lit(self.model).alias("model"), "embedding").dropDuplicates(["hash"])
        new = kept_aside(embed.embed_new(embed.cache_misses(texts.select("text"), cache, self.model), self.embedder), "vectors")
        vectors = new.select("hash", "embedding").where("embedding is not null").unionByName(cache.join(texts.select("hash").distinct(), "hash", "left_semi").select("hash", "embedding"))
        rows = texts.join(vectors, "hash", "left").select("chunk_id", F.col("path").alias("file_path"), "start_line", "end_line", "name", "chunk_type", "parent", "content", "hash", "embedding")
        yield {"stage": "storing", "failed": new.where("error is not null").count()}
        entry = {"files": v.write(changed, "files"), "chunks": v.write(rows, "chunks"), "failures": v.write(new.where("error is not null").select("hash", "error"), "failures")}
        entry["gone_files"] = v.write(gone_files, "gone-files")
        entry["gone_chunks"] = v.write(no_ids if gone_chunks is None else gone_chunks.select(F.col("chunk_id").alias("id")), "gone-chunks")
        chunks = v.table(entry["chunks"])
        posted = lexical.postings(chunks, "chunk_id", "content")
        entry["postings"] = v.write(lexical.by_term(posted), "postings")
        terms = lexical.term_counts(v.table(entry["postings"]))
        sums = [F.count("*").alias("chunks"), F.count_if(F.col("chunk_type").isin(*FUNCTIONS)).alias("functions"), F.coalesce(F.sum(F.size(t.identifier_words(F.col("content")))), F.lit(0)).alias("tokens")]
        total = chunks.agg(*sums, F.max(F.size("embedding")).alias("most"), F.min(F.size("embedding")).alias("least")).first().asDict()
        lengths = {x for x in (total.pop("most"), total.pop("least"), old["dimensions"] if old else None) if x is not None and x >= 0}
        if len(lengths) > 1:
            raise ValueError(f"vectors of lengths {sorted(lengths)}: index with incremental=False after a change of model")
        if gone_chunks is not None:
            lost = lexical.term_counts(lexical.postings(gone_chunks, "chunk_id", "content"))
            terms = terms.unionByName(lost.withColumn("df", -F.col("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")
            less = gone_chunks.agg(*sums).first()
            total = {k: old[k] + x - less[k] for k, x in total.items()}
        entry["terms"] = v.write(terms, "terms")
        manifest = {"repo_id": repo_id, "url": url, "commit": commit, "indexed_at": datetime.datetime.now(datetime.UTC).isoformat(), "deleted": False, "model": self.model, "dimensions": next(iter(lengths), None), "files": n["files"], **total, "batch": batch if batch is not None else -1}
        manifest["segments"] = [*(old["segments"] if old else []), {"tables": entry}]
        now = self._live(v, manifest, "files").select(F.lit(repo_id).alias("repo_id"), F.col("file_path").alias("path"), "language")
        tables = {"tree": repository.tree(now), "languages": repository.language_stats(now, ["repo_id"], self.params.top_languages)}
        tables |= {"walk": walked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("files")), "extensions": repository.top_extensions(walked.select(F.col("file_path").alias("path")))}
        manifest["tables"] = {name: v.write(df, name) for name, df in tables.items()}
        manifest["mean_idf"] = lexical.mean_idf(self._terms(v, manifest), manifest["chunks"])
        manifest = v.commit(manifest, last["version"] if last else 0)
        for x in scratch:
            v.drop(x)
        if len(manifest["segments"]) > SEGMENTS:
            self.compact(repo_id)
        yield {"stage": "complete", "chunks": manifest["chunks"]}

    def compact(self, repo_id: str) -> None:
        """Merges a repository's segments into one; if another writer was first, it stays as that writer left it."""
        v, last = self._current(repo_id)
        none = self.spark.createDataFrame([], "id string")
        entry = {table: v.write(self._live(v, last, table), table) for table in ("files", "chunks")}
        entry |= {"postings": v.write(lexical.by_term(self._live(v, last, "postings")), "postings"), "terms": v.write(self._terms(v, last), "terms")}
        entry |= {"gone_files": v.write(none, "gone-files"), "gone_chunks": v.write(none, "gone-chunks"), "failures": last["segments"][-1]["tables"]["failures"]}
        try:
            v.commit({k: x for k, x in last.items() if k != "version"} | {"segments": [{"tables": entry}]}, last["version"])
        except Conflict:
            for x in entry.values():
                if x != entry["failures"]:
                    v.drop(x)

    def delete(self, repo_id: str, older_than: float = 0.0) -> None:
        """Ends a repository with an empty version and removes its data from disk, at once or (for readers still at
        work) only what is older than so many seconds; ``vacuum`` removes the rest later."""
        v = self._versions(repo_id)
        if (last := v.read()) is None or last.get("deleted"):
            return
        v.commit({"repo_id": repo_id, "deleted": True, "segments": [], "indexed_at": datetime.datetime.now(datetime.UTC).isoformat()}, last["version"])
        v.vacuum(1, older_than)

    def vacuum(self, repo_id: str, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Removes what only versions before the last ``keep``, or no version, needs; returns how many folders."""
        return self._versions(repo_id).vacuum(keep, older_than)

    def status(self) -> DataFrame:
        """A row per repository: url, commit, when it was indexed, files, chunks, functions, tokens."""
        found = Versions(self.spark, self.folder).matching("repositories/*/versions/*.json")
        if not found:
            return self.spark.createDataFrame([], STATUS).drop("version", "deleted")
        rows = self.spark.read.schema(STATUS).json(f"{self.folder}/repositories/*/versions/*.json")
        columns = [c for c in rows.columns if c not in ("repo_id", "version")]
        last = rows.groupBy("repo_id").agg(F.max_by(F.struct(*columns), "version").alias("m")).select("repo_id", "m.*")
        return last.where("not deleted").drop("deleted")

    def is_current(self, repo_id: str, commit: str) -> bool:
        """Whether the repository is indexed at this commit."""
        last = self._versions(repo_id).read()
        return bool(last) and not last.get("deleted") and last["commit"] == commit

    def exists(self, repo_id: str) -> bool:
        last = self._versions(repo_id).read()
        return bool(last) and not last.get("deleted")

    def failures(self, repo_id: str) -> DataFrame:
        """(hash, error) of the texts that the last index run could not embed."""
        v, last = self._current(repo_id)
        return v.table(last["segments"][-1]["tables"]["failures"])

    def peek(self, repo_id: str, n: int = 5) -> DataFrame:
        return self._read("chunks", repo_id).drop("embedding").orderBy("chunk_id").limit(n)

    def file(self, repo_id: str, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
        if ".." in path or path.startswith("/"):
            raise ValueError(f"not a path within a repository: {path}")
        rows = self._read("files", repo_id).where(F.col("file_path") == path)
        ls = t.lines(F.col("content"))
        first = start or 1
        shown = F.slice(ls, first, F.greatest(F.lit(0), F.least(F.lit(end) if end else F.size(ls), F.size(ls)) - first + 1))
        return rows.select("file_path", "language", "total_lines", F.array_join(shown, "\n").alias("content"))

    def _made(self, repo_id: str, table: str) -> DataFrame:
        """What the index run has made of all files of the version."""
        v, last = self._current(repo_id)
        return v.table(last["tables"][table])

    def tree(self, repo_id: str) -> DataFrame:
        return self._made(repo_id, "tree")

    def summary(self, repo_id: str) -> DataFrame:
        return self._made(repo_id, "languages")

    def walk_report(self, repo_id: str) -> DataFrame:
        """(reason, files) of the last index run's walk: how many files were kept, and why others were left out."""
        return self._made(repo_id, "walk")

    def extensions(self, repo_id: str) -> DataFrame:
        """The 15 most frequent extensions of that walk, skipped files included."""
        return self._made(repo_id, "extensions")

    def listed(self, repo_id: str) -> DataFrame:
        """The first files, functions and classes, as a summary shows them."""
        return repository.listed(self._read("chunks", repo_id).withColumn("repo_id", F.lit(repo_id)), ["repo_id"])

    def starters(self, repo_id: str) -> DataFrame:
        return repository.starters(self._read("files", repo_id).select(F.col("file_path").alias("path")))

    def unmatched(self, repo_id: str, question: str) -> DataFrame:
        """File names in the question that no file of the repository has."""
        return filenames.unmatched(self._mentions(question), self._read("files", repo_id).select("file_path")).select("name")

    def _mentions(self, question: str) -> DataFrame:
        return filenames.mentions(self.spark.createDataFrame([(0, question)], "query_id int, question string"))

    def _candidates(self, repo_id: str, asked: str, hybrid: bool, most: int) -> DataFrame:
        """(id, rank, score) of the first ``most``: fused, or by vector alone with the least similarity that counts."""
        p, (v, last) = self.params, self._current(repo_id)
        row = self.spark.createDataFrame([("q", asked)], "hash string, text string")
        queries = embed.embed_new(row, self.embedder).where("embedding is not null").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query_vector"))
        vectors = self._live(v, last, "chunks").where("embedding is not null").select(F.col("chunk_id").alias("vec_id"), "embedding")
        if not hybrid:
            near = vector.nearest(vectors, queries, most)
            return near.where(F.col("similarity") >= p.min_score).select(F.col("vec_id").alias("id"), "rank", F.round("similarity", 6).alias("score"))
        terms = lexical.question_terms(row.select(F.lit(0).alias("query_id"), "text"))
        wanted = [r["term"] for r in terms.select("term").collect()]  # as long as a question at most
        known = lexical.with_idf(self._terms(v, last).where(F.col("term").isin(wanted)), last["chunks"], last["mean_idf"], p)
        index = lexical.Index(self._live(v, last, "postings").where(F.col("term").isin(wanted)), known, last["tokens"] / max(last["chunks"], 1), p)
        return fusion.hybrid(index, vectors, terms, queries, p, most).select(F.col("doc_id").alias("id"), "rank", "score")

    def _placed(self, repo_id: str, asked: str, hybrid: bool, scorer: rerank.Scorer | None) -> DataFrame:
        """(chunk_id, position, score): the best top_k, and before them the chunks of files that the question names."""
        p = self.params
        chunks = self._read("chunks", repo_id).select("chunk_id", "file_path", "start_line", "content")
        named = filenames.matched_files(self._mentions(asked), self._read("files", repo_id).select("file_path")).select("file_path").distinct()
        forced = numbered(chunks.join(named, "file_path", "left_semi").select(F.col("chunk_id").alias("id"), "file_path", "start_line"), "ordinal", "file_path", "start_line", "id").select("id", "ordinal")
        if scorer is None:
            ranking = self._candidates(repo_id, asked, hybrid, p.top_k)
        else:
            # The scorer sees twice as many as are shown, after the chunks of named files.
            pool = self._candidates(repo_id, asked, hybrid, 2 * p.top_k).select("id", F.lit(1).alias("part"), F.col("rank").cast("long").alias("at"))
            pool = pool.unionByName(forced.select("id", F.lit(0).alias("part"), F.col("ordinal").alias("at"))).groupBy("id").agg(F.min(F.struct("part", "at")).alias("m"))
            pool = numbered(pool, "rank", "m.part", "m.at", "id").join(chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text")), "id")
            ranking = rerank.reranked(pool.select(F.lit(asked).alias("question"), "id", "text", "rank"), scorer).where(F.col("rank") <= p.top_k).select("id", "rank", "score")
        placed = fusion.force_include(ranking, forced, p.top_k).join(ranking.select("id", "score"), "id", "left")
        return placed.select(F.col("id").alias("chunk_id"), F.col("position").cast("int").alias("position"), F.coalesce("score", F.lit(1.0)).alias("score"))

    @staticmethod
    def _asked(question: str, previous: str | None) -> str:
        last = (previous or "").strip()
        return question if not last or last.lower() == question.lower() else f"{last} {question}"

    def search(self, repo_id: str, question: str, previous: str | None = None, hybrid: bool = True, scorer: rerank.Scorer | None = None) -> DataFrame:
        """The best chunks, with the lines around them: position, file_path, lines, name, score, enriched text.

        ``previous`` is the question before, which a follow-up is read together with, file names included. Without ``hybrid`` vectors alone
        decide, down to a least similarity. A ``scorer`` of (question, text) reorders the candidates. Chunks of files
        that the question names come first, with score 1, where they are not among the best anyway. Answers without a
        scorer are kept per version of the repository."""
        low, high = self.params.question_chars
        if not low <= len(question) <= high:
            raise ValueError(f"a question has {low} to {high} characters")
        asked = self._asked(question, previous)
        _, last = self._current(repo_id)
        key = (repo_id, last["version"], asked, hybrid)
        if scorer is None and (kept := self.answers.get(key)) is not None:
            return self.spark.createDataFrame(*kept)
        chunks = self._read("chunks", repo_id).select("chunk_id", "file_path", "start_line", "end_line", "name", "chunk_type", "parent", "content")
        hits = chunks.join(self._placed(repo_id, asked, hybrid, scorer), "chunk_id")
        both = hits.join(self._read("files", repo_id).select("file_path", "language", F.col("content").alias("whole")), "file_path").withColumn("ls", t.lines(F.col("whole")))
        around = context.enriched(F.col("content"), F.col("ls"), F.col("start_line"), F.col("end_line"), self.params.context_lines, self.params.shown_lines)
        out = context.prompt_headers(both.withColumn("enriched", around).drop("ls", "whole"))
        if scorer is not None:
            return out
        rows = out.limit(ROWS + 1).collect()  # top_k, and more only where a question names files of many chunks
        if len(rows) > ROWS:
            return out
        self.answers.put(key, (rows, out.schema))
        return self.spark.createDataFrame(rows, out.schema)

    def debug_search(self, repo_id: str, question: str) -> DataFrame:
        """The hits of a question with their scores: position, file_path, start_line, end_line, name, chunk_type, score (4
        digits), above_threshold, preview."""
        hits = self.search(repo_id, question)
        above = F.col("score") >= self.params.min_score
        return hits.select("position", "file_path", "start_line", "end_line", "name", "chunk_type", F.round("score", 4).alias("score"), above.alias("above_threshold"), F.substring("enriched", 1, 200).alias("preview"))

    def prompt(self, repo_id: str, question: str, history: Sequence[tuple[str, str | None]] = (), scorer: rerank.Scorer | None = None) -> DataFrame:
        """(n_hits, prompt) for a model: what a search finds, the last of ``history`` (questions and answers, in order) and
        the question, with the names in it that no file has. No row where the search finds nothing."""
        return self._prompts(repo_id, question, history, scorer)[0].drop("query_id")

    def _prompts(self, repo_id: str, question: str, history: Sequence[tuple[str, str | None]], scorer: rerank.Scorer | None) -> tuple[DataFrame, list[str]]:
        p, previous = self.params, history[-1][0] if history else None
        hits = self.search(repo_id, question, previous, scorer=scorer).drop("content").withColumnRenamed("enriched", "content").withColumn("query_id", F.lit(0))
        missing = sorted(r["name"] for r in self.unmatched(repo_id, self._asked(question, previous)).collect())  # of one question
        recent = [(q or "", a or "") for q, a in history[-p.history_turns :]]
        row = self.spark.createDataFrame([(0, question, recent, missing)], "query_id int, question string, recent array<struct<q: string, a: string>>, missing array<string>")
        return context.prompts(hits, row.withColumn("history", context.history_text(F.col("recent"), p.history_answer_chars))), missing

    def ask(self, repo_id: str, question: str, generator: generate.Generator, history: Sequence[tuple[str, str | None]] = (), scorer: rerank.Scorer | None = None) -> DataFrame:
        """One row: answer, error, its parts (text, code, charts) and citations. ``generator`` makes the answer of a list of
        prompts; it is not called where the search finds nothing."""
        prompts, missing = self._prompts(repo_id, question, history, scorer)
        asked = self.spark.createDataFrame([(0, generate.without_hits(missing))], "query_id int, otherwise string")
        made = asked.join(generate.generated(prompts, generator), "query_id", "left")
        # One row, kept: a model must not be asked again by whoever looks at the answer twice.
        rows = made.select(F.when(F.col("answer").isNull() & F.col("error").isNull(), F.col("otherwise")).otherwise(F.col("answer")).alias("answer"), "error").collect()
        kept = self.spark.createDataFrame(rows, "answer string, error string")
        return kept.select("answer", "error", answer.parts(F.col("answer")).alias("parts"), answer.citations(F.col("answer")).alias("citations"))
