"""Recall in one call: by time, by similarity or by rank alone, with the ledger of what was shown; and the scoped session of a guest."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import beliefs as B
from tessera.operators import retrieval
from tessera.operators.writes import Context
from tessera.plans.writes import Draft, Writer, guest_arguments

#: Fixed value: what queries, not texts, are prefixed with before they are embedded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    """Texts to unit vectors; an index made by one model isn't read with another."""

    model_id: str
    dim: int

    def embed(self, rows: DataFrame, text_col: str = "text") -> DataFrame: ...

    def embed_query(self, text: str) -> list[float]: ...


class StubEmbedder:
    """Signed hashing of tokens: no model, but equal words give near vectors."""

    def __init__(self, dim: int = 384):
        self.model_id, self.dim = f"stub-{dim}", dim

    def embed(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        return retrieval.stub_embed(rows, text_col, self.dim)

    def embed_query(self, text: str) -> list[float]:
        return retrieval.stub_vector(QUERY_PREFIX + text, self.dim)


def recall(writer: Writer, ctx: Context, text: str, as_of: dt.datetime | None = None, embedder: Embedder | None = None, index: DataFrame | None = None, max_chunks: int = retrieval.MAX_CHUNKS) -> DataFrame:
    """(belief_id, text, score) of at most max_chunks beliefs for the context's actor.

    With ``as_of``, the beliefs valid then; with an embedder and an index (belief_id, embedding), the most similar ones that
    the gate lets through, best rank first, and the ledger records all candidates; else what the gate lets through.
    """
    _, have = writer.store.snapshot()
    if as_of is not None:
        return retrieval.recall_as_of(have["belief"], as_of, max_chunks)
    selected = B.select_for_context(have["belief"], have["ownership"], have["supersession"], ctx.actor, ctx.now)
    if embedder is None or index is None:
        return retrieval.recall_fallback(selected, max_chunks).select("belief_id", "text", "score")
    candidates = retrieval.recall_candidates(index, selected, embedder.embed_query(text), max_chunks)
    rows = candidates.toArrow()  # at most 4 * max_chunks
    candidates = writer.spark.createDataFrame(rows, candidates.schema)
    writer.record_retrieval(ctx, candidates)
    titles = have["belief"].select("belief_id", F.col("title").alias("text"))
    return candidates.join(titles, "belief_id").orderBy(F.desc("rank"), "belief_id").limit(max_chunks).select("belief_id", "text", F.col("similarity").alias("score"))


class ScopeError(PermissionError):
    """The session has no scope for the call."""


class Session:
    """What a program may do: calls whose scope (extension:function) was granted, none by default. Identity and time come from
    the context, whatever the arguments say."""

    def __init__(self, writer: Writer, ctx: Context, scopes: Iterable[str] = (), embedder: Embedder | None = None, index: DataFrame | None = None, extensions: dict[str, dict[str, Callable]] | None = None):
        self.writer, self.ctx, self.scopes, self.embedder, self.index = writer, ctx, {*scopes}, embedder, index
        self.extensions = extensions or {}

    def _need(self, scope: str) -> None:
        if scope not in self.scopes:
            raise ScopeError(f"{scope} isn't granted")

    def recall(self, text: str, as_of: dt.datetime | None = None, max_chunks: int = retrieval.MAX_CHUNKS) -> list[dict]:
        self._need("mem:recall")
        return [r.asDict() for r in recall(self.writer, self.ctx, text, as_of, self.embedder, self.index, max_chunks).collect()]

    def remember(self, text: str, event_time: dt.datetime | None = None) -> str:
        self._need("mem:remember")
        return self.writer.observe(self.ctx, text, event_time or self.ctx.now)

    def derive(self, text: str, evidence: list[str], method: str, confidence: float | None = None) -> str:
        self._need("mem:derive")
        return self.writer.assert_belief(self.ctx, Draft(text, confidence), evidence, method)

    def supersede(self, old: str, text: str, reason: str, confidence: float | None = None) -> str:
        self._need("mem:supersede")
        return self.writer.supersede(self.ctx, old, Draft(text, confidence), reason)

    def contest(self, claims: list[str], condition: str) -> str:
        self._need("mem:contest")
        return self.writer.contest(self.ctx, claims, condition)

    def call(self, extension: str, function: str, **arguments):
        """A function that an extension provides."""
        self._need(f"{extension}:{function}")
        if function not in self.extensions.get(extension, {}):
            raise ValueError(f"{extension} has no function {function}")
        return self.extensions[extension][function](self.writer, self.ctx, **guest_arguments(arguments))
