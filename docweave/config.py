"""Settings of the engine, from defaults, .env files and the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

#: Kinds of documents that a parser can be asked for.
PARSER_KINDS = ("presentation", "laws", "manual", "paper", "resume", "book", "qa", "table", "naive", "picture", "one", "audio", "email", "knowledge_graph", "tag")
#: The variable that sets each setting.
VARIABLES = {
    "storage_dir": "RAG_STORAGE_DIR",
    "knowledge_base": "RAG_KNOWLEDGE_BASE",
    "backend": "RAG_BACKEND",
    "embedding": "RAG_EMBEDDING",
    "chunker": "RAG_CHUNKER",
    "chunk_size": "RAG_CHUNK_SIZE",
    "chunk_overlap": "RAG_CHUNK_OVERLAP",
    "hybrid_enabled": "RAG_HYBRID_ENABLED",
    "hybrid_vector_weight": "RAG_HYBRID_VECTOR_WEIGHT",
    "hybrid_candidate_k": "RAG_HYBRID_CANDIDATE_K",
    "bm25_k1": "RAG_BM25_K1",
    "bm25_b": "RAG_BM25_B",
    "decomposition_enabled": "RAG_QUERY_DECOMPOSITION_ENABLED",
    "decomposition_most": "RAG_QUERY_DECOMPOSITION_MAX_SUBQUERIES",
    "qa_enabled": "RAG_QA_GENERATION_ENABLED",
    "qa_context_chars": "RAG_QA_GENERATION_MAX_CONTEXT_CHARS",
    "qa_most_pairs": "RAG_QA_GENERATION_MAX_PAIRS",
    "qa_preview_pages": "RAG_QA_PDF_PREVIEW_PAGES",
    "qa_summary_chars": "RAG_QA_PDF_PREVIEW_SUMMARY_MAX_CHARS",
}


@dataclass(frozen=True)
class Settings:
    storage_dir: str = "storage"
    knowledge_base: str = "default_kb"
    backend: str = "faiss"
    embedding: str = "hash"
    chunker: str = "simple"
    chunk_size: int = 800
    chunk_overlap: int = 120
    hash_dim: int = 384
    hybrid_enabled: bool = False
    hybrid_vector_weight: float = 0.7
    hybrid_candidate_k: int = 20
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    decomposition_enabled: bool = True
    decomposition_most: int = 4
    qa_enabled: bool = False
    qa_context_chars: int = 8000
    qa_most_pairs: int = 20
    qa_preview_pages: int = 4
    qa_summary_chars: int = 1200

    @classmethod
    def load(cls, *env_files: str, environ: dict[str, str] | None = None) -> Settings:
        """Process variables win over files, earlier files over later ones."""
        seen = dict(os.environ if environ is None else environ)
        for f in env_files:
            for k, v in read_env(f).items():
                seen.setdefault(k, v)
        made = {}
        for f in fields(cls):
            raw = seen.get(VARIABLES.get(f.name, ""), "").strip()
            if raw:
                kind = type(f.default)
                made[f.name] = raw.lower() == "true" if kind is bool else kind(raw)
        return cls(**made)


def read_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines; a # outside quotes starts a comment, quotes around a value go."""
    out: dict[str, str] = {}
    if not Path(path).exists():
        return out
    for line in Path(path).read_text("utf-8").splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, _, rest = line.partition("=")
        quote, kept = "", []
        for c in rest.strip():
            if c == "#" and not quote:
                break
            if c in "'\"":
                quote = "" if quote == c else quote or c
            kept.append(c)
        out.setdefault(key.strip(), "".join(kept).strip().strip("'\""))
    return out
