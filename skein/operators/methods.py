"""Whole methods: a registry of retrieval compositions, and the way from questions to validated answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import dense, generation, retrieval

#: A method makes ranked hits (query_id, chunk_id, rank, ...) of retrievers and queries.
Method = Callable[[list[retrieval.Retriever], DataFrame, int], DataFrame]
METHODS: dict[str, Method] = {}


def method(name: str):
    """Registers a composition; names don't repeat."""

    def add(fn: Method) -> Method:
        if name in METHODS:
            raise ValueError(f"method {name} is there already")
        METHODS[name] = fn
        return fn

    return add


def run(name: str, retrievers: list[retrieval.Retriever], queries: DataFrame, top: int = 10) -> DataFrame:
    if name not in METHODS:
        raise ValueError(f"unknown method {name}; there are {sorted(METHODS)}")
    return METHODS[name](retrievers, queries, top)


@method("flat")
def flat(retrievers: list[retrieval.Retriever], queries: DataFrame, top: int) -> DataFrame:
    """All text is one index: words and vectors."""
    words, vectors = (next(r for r in retrievers if r.name == n) for n in ("bm25", "dense"))
    return retrieval.hybrid(words.search(queries, 50), vectors.search(queries, 50), None, (words.weight, vectors.weight), top)


@method("modality")
def modality(retrievers: list[retrieval.Retriever], queries: DataFrame, top: int) -> DataFrame:
    """Each modality has its retrievers; their lists are fused within and across."""
    return retrieval.by_modality(retrievers, retrieval.retrieve(retrievers, queries), top)


@method("pages")
def pages(retrievers: list[retrieval.Retriever], queries: DataFrame, top: int) -> DataFrame:
    """The modalities and a list of whole pages by late interaction, a retriever like the others."""
    if not any(r.modality == "page" for r in retrievers):
        raise ValueError("this method needs a page retriever")
    return modality(retrievers, queries, top)


def page_retriever(page_tokens: DataFrame, query_tokens: DataFrame, chunks: DataFrame, weight: float = 1.0, n_pages: int = 50) -> retrieval.Retriever:
    """Pages by the sum of best token matches, expanded to their chunks. chunks: chunk_id, page_id, ordinal."""
    from skein.operators.ranking import top_k

    def search(queries: DataFrame, k: int) -> DataFrame:
        asked = query_tokens.join(queries.select("query_id").distinct(), "query_id", "left_semi")
        hits = top_k(dense.maxsim(page_tokens, asked, n_pages), n_pages, [F.col("score").desc(), F.col("page_id")])
        return dense.expand_pages(hits, chunks, k)

    return retrieval.Retriever("visual_page", "page", search, weight)


def answer(questions: DataFrame, hits: DataFrame, chunks: DataFrame, provider: Callable[[str], tuple[str, int, int]], pipeline: str = "v2", budget: int = 6000) -> DataFrame:
    """One record per question: answer, status, attempts, error, prompt_sha256, prompt_version, n_sources, context_tokens, cited and unresolved numbers, refused, passed, tokens.

    questions: query_id, question; hits: query_id, rank, chunk_id; chunks: as evidence_pack() wants sources, without query_id and rank.
    """
    from skein.functions.text import citations

    pack = generation.evidence_pack(hits.select("query_id", "rank", "chunk_id").join(chunks, "chunk_id"), budget)
    asked = generation.prompts(questions, pack, pipeline)
    done = generation.complete(asked, provider)
    sources = pack.select("query_id", "number", F.col("block").alias("text"))
    report = generation.validation_report(done.select("query_id", "answer"), sources).select("query_id", "refused", "mixed_refusal", "coverage", "unresolved", "ungrounded", "passed")
    version = F.lit(f"{pipeline}-{generation.prompt_version(pipeline)}")
    return done.join(report, "query_id", "left").select(
        "query_id", "answer", "status", "attempts", "error", "prompt_sha256", version.alias("prompt_version"), "n_sources", "context_tokens", citations(F.col("answer")).alias("cited"), "unresolved", "ungrounded", "refused", "mixed_refusal", "coverage", "passed", "prompt_tokens", "completion_tokens",
    )
