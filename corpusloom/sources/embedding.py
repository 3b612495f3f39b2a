"""Embedding backends over HTTP, and rows for an external vector database."""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.sources.config import ProjectConfig

BATCH, TIMEOUT = 64, 60


@dataclass(frozen=True)
class EmbeddingConfig:
    """backend: local_hash, openai, ollama or custom (any endpoint that speaks like the second)."""

    backend: str = "local_hash"
    model: str = "local-hash"
    endpoint: str | None = None
    dimensions: int = 256

    @staticmethod
    def of(config: ProjectConfig) -> EmbeddingConfig:
        """The environment's values, then the file's, then the defaults."""
        env = lambda n: os.environ.get(f"CORPUSLOOM_EMBEDDING_{n}")
        backend = env("BACKEND") or config.embedding_backend or "local_hash"
        known = {"local_hash": ("local-hash", None), "openai": ("text-embedding-3-small", "https://api.openai.com/v1/embeddings"), "ollama": ("nomic-embed-text", "http://localhost:11434/api/embed"), "custom": ("custom", None)}
        if backend not in known:
            raise ValueError(f"unknown embedding backend {backend}")
        model, endpoint = known[backend]
        return EmbeddingConfig(backend, env("MODEL") or config.embedding_model or model, env("ENDPOINT") or config.embedding_endpoint or endpoint, config.dimensions())


def parsed(reply: dict) -> list[list[float]]:
    """Unit vectors of a reply, in the order asked for."""
    rows = reply["embeddings"] if "embeddings" in reply else [r["embedding"] for r in sorted(reply["data"], key=lambda r: r["index"])]
    out = []
    for v in rows:
        norm = math.sqrt(sum(x * x for x in v))
        out.append([x / norm for x in v] if norm else list(v))
    return out


def _post(url: str, body: dict, key: str | None) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urlopen(Request(url, json.dumps(body).encode(), headers), timeout=TIMEOUT) as r:
        return json.load(r)


def embedder(config: EmbeddingConfig, post: Callable[[str, dict, str | None], dict] = _post) -> Callable[[DataFrame], DataFrame]:
    """A function of (id, text) to (id, vector) that asks the endpoint in batches."""
    key = os.environ.get("CORPUSLOOM_EMBEDDING_API_KEY") or os.environ.get("OPENAI_API_KEY")
    if config.backend == "openai" and not key:
        raise ValueError("the openai backend needs an API key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                yield pd.DataFrame({"id": part["id"], "vector": parsed(post(config.endpoint, {"model": config.model, "input": part["text"].tolist()}, key))})

    return lambda df: df.select("id", "text").mapInPandas(run, "id string, vector array<double>")


def point_id(chunk_id: str) -> str:
    """A UUID from SHA-256 of the chunk's id, with version and variant bits set."""
    raw = bytearray(hashlib.sha256(chunk_id.encode()).digest()[:16])
    raw[6], raw[8] = raw[6] & 0x0F | 0x50, raw[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(raw)))


def points(vectors: DataFrame, batch: int = 128) -> DataFrame:
    """(body) of upsert requests, ``batch`` vectors each, for a database of points with payloads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"id": point_id(r.id), "vector": [float(x) for x in r.vector], "payload": {"chunk_id": r.id, "path": r.file_path, "line_start": int(r.line_start), "line_end": int(r.line_end), "source": r.source}} for r in pdf.itertuples()]
            yield pd.DataFrame({"body": [json.dumps({"points": rows[i : i + batch]}) for i in range(0, len(rows), batch)]})

    return vectors.select("id", "vector", "file_path", "line_start", "line_end", "source").mapInPandas(run, "body string")


def collection_body(dims: int) -> dict:
    return {"vectors": {"size": dims, "distance": "Cosine"}}


def search_body(vector: list[float], limit: int) -> dict:
    return {"vector": vector, "limit": limit, "with_payload": True}


def hits(reply: dict) -> list[tuple[str, float, dict]]:
    """(id, score, payload) of a search reply."""
    rows = reply.get("result", [])
    rows = rows.get("points", []) if isinstance(rows, dict) else rows
    return [(str(r["id"]), float(r["score"]), r.get("payload") or {}) for r in rows]


def checked_collection(name: str) -> str:
    if not name or not all(c.isascii() and (c.isalnum() or c in "_-") for c in name):
        raise ValueError(f"bad collection name {name!r}")
    return name
