"""Project configuration: a small TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field


@dataclass
class ProjectConfig:
    ignore_paths: list[str] = field(default_factory=list)
    embedding_backend: str | None = None
    embedding_model: str | None = None
    embedding_endpoint: str | None = None
    embedding_dimensions: int | None = None
    max_context_tokens: int | None = None
    auto_open_browser: bool | None = None
    benchmarks: dict[str, object] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> ProjectConfig:
        """The file's values; defaults if it is missing or can't be read."""
        try:
            with open(path, "rb") as f:
                raw = tomllib.load(f)
        except (OSError, tomllib.TOMLDecodeError):
            return ProjectConfig()
        e, c = raw.get("embedding", {}), raw.get("context", {})
        return ProjectConfig(
            ignore_paths=[str(p) for p in raw.get("ignore", {}).get("paths", [])], embedding_backend=e.get("backend"), embedding_model=e.get("model"), embedding_endpoint=e.get("endpoint"),
            embedding_dimensions=e.get("dimensions"), max_context_tokens=c.get("max_tokens"), auto_open_browser=raw.get("ui", {}).get("auto_open_browser"), benchmarks=raw.get("benchmarks", {}),
        )

    def dimensions(self) -> int:
        """Dimensions of embeddings: environment, then the file, then 256."""
        return int(os.environ.get("CORPUSLOOM_EMBEDDING_DIMENSIONS") or self.embedding_dimensions or 256)
