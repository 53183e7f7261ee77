"""Four read-only tools over an indexed corpus, each with the JSON schema of its arguments: search, browse, outline and read.

A turn keeps what its calls have found: a passage has the number of its first appearance, however often it is
found again. Tools are limited to the turn's repositories; bad arguments are errors, not empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniq.config import SearchConfig
from graniq.functions import text as T
from graniq.operators import browse
from graniq.plans import stored as plans
from graniq.plans.providers import Embedder, Reranker
from graniq.plans.stored import Stored


def _schema(required: list[str], **properties: tuple[str, str]) -> dict[str, Any]:
    return {"type": "object", "properties": {k: {"type": kind, "description": about} for k, (kind, about) in properties.items()}, "required": required}


# The names of the tools and of their arguments.
SCHEMAS = {
    "rag_search": _schema(["query"], query=("string", "A question or its key words."), top_k=("integer", "Passages to give: 8, at most 20."), path=("string", "A folder to search below.")),
    "rag_browse": _schema([], path=("string", "The folder to list; the top without it.")),
    "rag_outline": _schema(["path"], path=("string", "The path or name of a document.")),
    "rag_read": _schema(["path"], path=("string", "The path or name of a document."), section=("string", "Part of a heading."), page=("integer", "A page."), max_chars=("integer", "Characters to give: 6000, from 500 to 20000.")),
}
_TYPES = {"string": str, "integer": int}


def checked(name: str, given: dict[str, Any]) -> dict[str, Any]:
    """Arguments of a tool by its schema: numbers may come as texts; missing, unknown and wrong ones are errors. Empty texts count as not given."""
    if name not in SCHEMAS:
        raise LookupError(f"no such tool: {name}")
    known, out = SCHEMAS[name]["properties"], {}
    for key, value in given.items():
        if key not in known:
            raise ValueError(f"{name} has no argument {key}")
        if value is None or value == "":
            continue
        try:
            out[key] = _TYPES[known[key]["type"]](value)
        except (TypeError, ValueError):
            raise ValueError(f"{key} must be of the type {known[key]['type']}") from None
    if missing := [k for k in SCHEMAS[name]["required"] if not str(out.get(k, "")).strip()]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return out


@dataclass
class Turn:
    """The tools of one turn.

    nodes: node_id, repository, path, name, size_bytes. sections: node_id, ordinal, level, title, summary. Chunks have a
    heading_path and a page where read asks for them.
    """

    stored: Stored
    nodes: DataFrame
    sections: DataFrame
    repositories: list[str]
    cfg: SearchConfig = field(default_factory=SearchConfig)
    embedder: Embedder | None = None
    reranker: Reranker | None = None
    cited: dict[tuple, int] = field(default_factory=dict)

    def call(self, name: str, **given: Any) -> DataFrame:
        args = checked(name, given)
        return {"rag_search": self._search, "rag_browse": self._browse, "rag_outline": self._outline, "rag_read": self._read}[name](**args)

    def _number(self, found: list[tuple]) -> list[int]:
        return [self.cited.setdefault(key, len(self.cited) + 1) for key in found]

    def _inside(self) -> DataFrame:
        return self.nodes.filter(F.col("repository").isin(self.repositories))

    def _document(self, path: str) -> DataFrame:
        wanted = "/" + path.strip().strip("/")
        own = browse.resolve(self._inside().withColumn("name", F.concat(F.lit("/"), "name")), wanted)
        if own.isEmpty():  # a citation shows a path; its last part may be all that is left of it
            own = browse.resolve(self._inside(), wanted.rsplit("/", 1)[-1])
        if own.isEmpty():
            raise LookupError(f"no such document: {path}")
        return own.select("node_id")

    def _search(self, query: str, top_k: int = 0, path: str = "") -> DataFrame:
        """number, node_id, path, ordinals, score, text."""
        cfg = replace(self.cfg, top_k=max(1, min(plans.MOST, top_k or self.cfg.resolved().top_k)))
        found = plans.search(self.stored, query, None, cfg, self.repositories, path, self.embedder, self.reranker)
        rows = found.join(self.nodes.select("node_id", "path"), "node_id").orderBy("place").collect()  # at most MOST passages
        numbers = self._number([(r["node_id"], tuple(r["ordinals"])) for r in rows])
        return self.stored.spark.createDataFrame([(n, r["node_id"], r["path"], r["ordinals"], r["score"], r["text"]) for n, r in zip(numbers, rows)], "number long, node_id long, path string, ordinals array<long>, score double, text string")

    def _browse(self, path: str = "") -> DataFrame:
        """kind, name, path, repository, size_bytes of what is directly below; at most 200."""
        return browse.children(browse.with_folders(self._inside()), path).select("kind", "name", "path", "repository", "size_bytes")

    def _outline(self, path: str) -> DataFrame:
        """node_id, ordinal, line, summary of a document's sections."""
        return browse.outline(self.sections.join(F.broadcast(self._document(path)), "node_id", "left_semi"))

    def _read(self, path: str, section: str = "", page: int | None = None, max_chars: int = 6000) -> DataFrame:
        """node_id, n_chunks, text: of a document, of its parts below a heading, or of a page."""
        node = self._document(path).first()["node_id"]
        own = self.stored.index.chunks("node_id", [node])
        for column, kind in (("heading_path", "string"), ("page", "int")):
            if column not in own.columns:
                own = own.withColumn(column, F.lit(None).cast(kind))
        if section:
            own = own.filter(T.contains_text(F.col("heading_path"), section))
        return browse.read_part(own, "", page, max_chars=max_chars)
