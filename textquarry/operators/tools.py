"""Tool calls as a table: inputs are decoded once, file calls run in order, and each other tool runs once over all of its calls."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from textquarry.functions.toolinput import decode_calls, whole_k
from textquarry.operators import file_calls, mutations, upsert
from textquarry.operators.ranks import ranked
from textquarry.operators.vector_search import DEFAULT_K
from textquarry.plans.search import cascade
from textquarry.schemas import WEB_RESPONSE
from textquarry.session import cut_lineage, stored

# Entries in one directory-listing result row.
LISTING_PAGE = 10_000

# Answers when nothing is found.
NO_FALLBACK = "No fallback files found. No search results available."
NO_MATCH = "No relevant information found in fallback files."

# Input fields per tool, and what each tool is for.
FIELDS = {
    "read_file": {"path": "string"},
    "list_files": {"path": "string"},
    "edit_file": {"path": "string", "old_str": "string", "new_str": "string"},
    "create_file": {"path": "string", "content": "string"},
    "search_web": {"query": "string"},
    "vector_search": {"query": "string", "k": "int"},
    "vector_upsert": {"text_content": "string", "metadata": "text_map"},
}
PURPOSE = {
    "read_file": "Content of one file of the workspace.",
    "list_files": "Entries of one workspace directory, the root if no path is given.",
    "edit_file": "Replace a text that occurs exactly once in a file.",
    "create_file": "Create a file that does not exist yet.",
    "search_web": "Results of a web search.",
    "vector_search": "Snippets nearest to a query, or keyword hits if there are none.",
    "vector_upsert": "Store a text with its metadata for later search.",
}
# Tools whose calls see each other's work.
FILE_TOOLS = (file_calls.READ, file_calls.CREATE, file_calls.EDIT)
_JSON_TYPES = {"string": "string", "int": "integer", "text_map": "object"}

Handler = Callable[[DataFrame], DataFrame]


def _answer(done: DataFrame, content: Column, error: Column, *more: str) -> DataFrame:
    """call_id, content, error of one tool's calls; an error leaves no content."""
    return done.select("call_id", F.when(error.isNull(), content).alias("content"), error.alias("error"), *more)


def _live(calls: DataFrame, handlers: dict[str, Handler], registry: DataFrame | None) -> DataFrame:
    """Names of the enabled tools; the registry has one row per tool in code, a fixed handful."""
    if registry is None:
        registry = calls.sparkSession.createDataFrame([(n, True) for n in handlers], "name string, enabled boolean")
    return F.broadcast(registry.filter(F.col("enabled") & F.col("name").isin(list(handlers))).select("name"))


def _pages(done: DataFrame | None = None) -> list[Column]:
    number = lambda name: F.coalesce(F.col(name), F.lit(1)) if done is not None and name in done.columns else F.lit(1)
    return [number(name).cast("int").alias(name) for name in ("page", "pages")]


def execute(calls: DataFrame, handlers: dict[str, Handler], registry: DataFrame | None = None) -> DataFrame:
    """TOOL_CALL rows to TOOL_RESULT rows.

    ``registry``: name, enabled; by default every handler is enabled. A call of
    an unknown or disabled tool is answered ``tool not found``. An answer of
    several rows numbers them by page, of pages; other answers are page 1 of 1.
    """
    live = _live(calls, handlers, registry)
    results = calls.join(live, "name", "left_anti").select(
        "call_id", F.lit("tool not found").alias("content"), F.lit(True).alias("is_error"), *_pages())
    known = calls.join(live, "name", "left_semi")
    for name, handler in handlers.items():
        done = handler(known.filter(F.col("name") == name))
        failed = F.concat(F.lit(f"Error executing tool '{name}': "), "error")
        results = results.unionByName(done.select(
            "call_id", F.coalesce(failed, F.col("content")).alias("content"),
            F.col("error").isNotNull().alias("is_error"), *_pages(done)))
    return results


@dataclass
class ToolBox:
    """The data the tools work on. A tool whose data is missing is not offered.

    ``files``: FILE rows. ``snippets``: SNIPPET rows to search. ``model``: an
    embedding model, or None for the built-in one. ``web``: query, body (JSON
    responses fetched elsewhere). ``names`` renames tools. ``listing_page``:
    entries in one row of a directory listing, by default LISTING_PAGE.
    """

    files: DataFrame
    snippets: DataFrame | None = None
    model: Callable[[list[str]], list[list[float]]] | None = None
    web: DataFrame | None = None
    names: dict[str, str] = field(default_factory=dict)
    listing_page: int | None = None

    def _offered(self) -> list[str]:
        more = ["search_web"] * (self.web is not None) + ["vector_search", "vector_upsert"] * (self.snippets is not None)
        return [*FILE_TOOLS, "list_files", *more]

    def handlers(self) -> dict[str, Handler]:
        return {self._name(tool): lambda calls, tool=tool: self._answers(self._decoded(calls), [tool]) for tool in self._offered()}

    def execute(self, calls: DataFrame, registry: DataFrame | None = None) -> DataFrame:
        """TOOL_CALL rows to TOOL_RESULT rows, as ``execute``; inputs are decoded once for all tools. Calls that read, create and edit files
        see what the calls before them did; listings and searches see the files as they were at the start."""
        live = _live(calls, self.handlers(), registry)
        unknown = calls.join(live, "name", "left_anti").select(
            "call_id", F.lit("tool not found").alias("content"), F.lit(True).alias("is_error"), *_pages())
        decoded = stored(self._decoded(calls.join(live, "name", "left_semi")), "decoded")
        done = self._answers(decoded, self._offered())
        failed = F.concat(F.lit("Error executing tool '"), "name", F.lit("': "), "error")
        return unknown.unionByName(done.select(
            "call_id", F.coalesce(failed, F.col("content")).alias("content"), F.col("error").isNotNull().alias("is_error"), *_pages(done)))

    def effects(self, calls: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """What the calls leave behind: the next file table, and SNIPPET rows to upsert (None if nothing can be stored).

        A text without a vector is a fallback file; a file of the same name is replaced.
        """
        known = calls.join(_live(calls, self.handlers(), registry), "name", "left_semi")
        decoded = stored(self._decoded(known), "decoded").filter("format_error is null")
        files = file_calls.apply(self.files, self._file_calls(decoded).contents)
        if self.snippets is None:
            return files, None
        snips, fallback, _ = self._upserts(self._of(decoded, "vector_upsert"))
        body = F.col("content").cast("binary")
        written = fallback.dropDuplicates(["filename"]).select(
            F.col("filename").alias("path"), F.octet_length(body).cast("long").alias("length"), body.alias("content"))
        return files.join(written.select("path"), "path", "left_anti").unionByName(written), snips

    def definitions(self) -> DataFrame:
        """The tools on offer: name, description, input_schema (JSON)."""
        rows = []
        for tool, fields in FIELDS.items():
            if self._name(tool) in self.handlers():
                properties = {f: {"type": _JSON_TYPES[kind]} for f, kind in fields.items()}
                rows.append((self._name(tool), PURPOSE[tool], json.dumps({"type": "object", "properties": properties})))
        return self.files.sparkSession.createDataFrame(rows, "name string, description string, input_schema string")

    def _name(self, name: str) -> str:
        return self.names.get(name, name)

    def _decoded(self, calls: DataFrame) -> DataFrame:
        fields = {self._name(tool): FIELDS[tool] for tool in self._offered()}
        return decode_calls(calls.select("call_id", "seq", "name", "input"), fields, (self._name("list_files"),)).drop("input")

    def _of(self, decoded: DataFrame, tool: str) -> DataFrame:
        return decoded.filter(F.col("name") == self._name(tool)).select("call_id", "seq", "name", *FIELDS[tool], "format_error")

    def _answers(self, decoded: DataFrame, tools: list[str]) -> DataFrame:
        """call_id, name, content, error, page, pages of decoded calls."""
        bad = decoded.filter("format_error is not null").filter(F.col("name").isin([self._name(t) for t in tools]))
        out = bad.select("call_id", "name", F.lit(None).cast("string").alias("content"), F.col("format_error").alias("error"), *_pages())
        good = decoded.filter("format_error is null")
        if set(tools) & set(FILE_TOOLS):
            mine = good.filter(F.col("name").isin([self._name(t) for t in tools if t in FILE_TOOLS]))
            names = F.create_map(*[F.lit(x) for tool in FILE_TOOLS for x in (tool, self._name(tool))])
            out = out.unionByName(self._file_calls(mine).answers.select("call_id", names[F.col("tool")].alias("name"), "content", "error", *_pages()))
        answer = {"list_files": self.list_files, "search_web": self.search_web, "vector_search": self.vector_search, "vector_upsert": self.vector_upsert}
        for tool in tools:
            if tool in answer:
                done = answer[tool](self._of(good, tool))
                out = out.unionByName(done.select("call_id", F.lit(self._name(tool)).alias("name"), "content", "error", *_pages(done)))
        return out

    def _file_calls(self, decoded: DataFrame) -> file_calls.Done:
        tools = F.create_map(*[F.lit(x) for tool in FILE_TOOLS for x in (self._name(tool), tool)])
        mine = decoded.filter(F.col("name").isin([self._name(t) for t in FILE_TOOLS]))
        return file_calls.run(mine.withColumn("tool", tools[F.col("name")]), self.files)

    def list_files(self, asked: DataFrame) -> DataFrame:
        """JSON lists of paths in order of name, a row per page; a short listing is page 1 of 1.

        Places come from ranges of names, so a directory of any size is listed by many tasks.
        """
        entries = mutations.list_dir(asked.select(F.col("call_id").alias("seq"), "path"), self.files)
        size = self.listing_page or LISTING_PAGE
        listed = (ranked(entries, ["seq"], ["entry"]).withColumn("page", F.floor(F.col("place") / size) + 1)
                  .groupBy("seq", "page").agg(F.to_json(F.array_sort(F.collect_list("entry"))).alias("content"),
                                              F.max("error").alias("error")))
        pages = listed.groupBy(F.col("seq").alias("call_id")).agg(F.max("page").alias("pages"))
        listed = listed.withColumnRenamed("seq", "call_id").join(pages, "call_id")
        return _answer(listed, F.col("content"), F.col("error"), "page", "pages")

    def search_web(self, asked: DataFrame) -> DataFrame:
        error = F.coalesce("format_error", F.when(
            F.col("query") == "", F.lit(f"query is required for {self._name('search_web')}")))
        checked = asked.withColumn("error", error)
        found = checked.join(self.web.select("query", "body"), "query", "left")
        body = F.to_json(F.from_json("body", WEB_RESPONSE))
        missing = F.when(F.col("body").isNull(), F.lit("no response for this query"))
        return _answer(found, body, F.coalesce("error", missing))

    def vector_search(self, asked: DataFrame) -> DataFrame:
        name = self._name("vector_search")
        error = F.coalesce("format_error", F.when(F.col("query") == "", F.lit(f"query is required for {name}")))
        checked = asked.withColumn("error", error)
        queries = checked.filter("error is null").select(
            F.col("call_id").alias("query_id"), "query", whole_k(F.col("k"), DEFAULT_K).alias("k"))
        docs = upsert.fallback_docs(self.files)
        vector, keyword = cascade(queries, self.snippets, docs, self.model)

        # A call has at most k hits.
        def as_list(hits: DataFrame, record: Column) -> DataFrame:
            ranked = F.array_sort(F.collect_list(F.struct("rank", F.to_json(record).alias("hit"))))
            return hits.groupBy(F.col("query_id").alias("call_id")).agg(F.concat(
                F.lit("["), F.array_join(F.transform(ranked, lambda r: r["hit"]), ","), F.lit("]")).alias("content"))

        snippet = F.struct("id", "content", "file_path", "start_line", "end_line", "symbols",
                           F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata"))
        line = F.struct("filename", "content", "relevance", "matched_line")
        found = as_list(vector, snippet).unionByName(as_list(keyword, line))
        nothing = NO_MATCH if not docs.isEmpty() else NO_FALLBACK
        return _answer(checked.join(found, "call_id", "left"),
                       F.coalesce("content", F.lit(nothing)), F.col("error"))

    def vector_upsert(self, asked: DataFrame) -> DataFrame:
        """The answers; ``effects`` gives the rows to write."""
        _, _, checked = self._upserts(asked)
        stored = F.concat(F.lit("Successfully upserted content with ID: "), "id")
        fell_back = F.concat(F.lit("Successfully created file '"), "filename", F.lit("'"))
        return _answer(checked, F.when(F.col("embedded"), stored).otherwise(fell_back), F.col("error"))

    def upserts(self, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
        """SNIPPET rows to store, and fallback files (filename, content) for texts without a vector."""
        snips, fallback, _ = self._upserts(self._of(self._decoded(calls), "vector_upsert"))
        return snips, fallback

    def _upserts(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        name = self._name("vector_upsert")
        error = F.coalesce("format_error", F.when(
            F.col("text_content") == "", F.lit(f"text_content is required for {name}")))
        embedded = upsert.embed_texts(asked.withColumn("error", error), self.model)
        if self.model:
            # Snippets, fallback files and answers come from one call of the model per text.
            embedded = cut_lineage(embedded)
        good = embedded.filter("error is null")
        snips = upsert.text_snippets(good.filter(upsert.is_embedded(F.col("embedding"))))
        checked = embedded.select(
            "call_id", "error", upsert.is_embedded(F.col("embedding")).alias("embedded"),
            upsert.text_id(F.col("text_content"), F.col("metadata")).alias("id"),
            upsert.fallback_name(F.col("text_content"), F.col("metadata")).alias("filename"))
        return snips, upsert.fallback_files(good), checked
