"""Which paths a scan leaves out."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Folders and files that are never scanned.
IGNORED_NAMES = (
    "node_modules target build dist .cpl .ohos .hvigor hvigor .git .claude .analyzer DerivedData Pods .gradle .idea .vscode .playwright-mcp coverage "
    ".env .env.local .env.development .env.production .env.test entry/build oh_modules __pycache__ .ruff_cache"
).split()


def glob_regex(pattern: str) -> str:
    """Anchored expression of a glob in which ``*`` also crosses ``/``."""
    return "".join(".*" if c == "*" else re.escape(c) for c in pattern)


@dataclass(frozen=True)
class IgnoreRules:
    """One expression over lower-cased relative paths: built-in names and the lines of ignore files.

    Comments, blank lines and negations say nothing.  A pattern with a slash, or anchored by a leading
    one, is matched against the path; any other also against each component.
    """

    expression: str

    @staticmethod
    def of(lines: list[str] = (), names: list[str] = IGNORED_NAMES) -> IgnoreRules:
        alternatives = [rf"(?:^|.*/){re.escape(n.lower())}(?:/.*)?$" for n in names]
        for line in lines:
            p = line.strip()
            if not p or p[0] in "#!":
                continue
            p = p.removeprefix("./")
            anchored = p.startswith("/")
            p = p.lstrip("/") if anchored else p
            folder = p.endswith("/")
            p = (p.rstrip("/") if folder else p).strip().replace("\\", "/").lower()
            if not p:
                continue
            glob, exact = glob_regex(p), re.escape(p)
            alternatives.append(rf"^{glob}$")
            alternatives.append(rf"(?:^|.*/){exact}/.*$" if folder else rf".*/{exact}$")
            if folder:
                alternatives.append(rf"^{exact}(?:/.*)?$")
            if not anchored and "/" not in p:
                part = "".join("[^/]*" if c == "*" else re.escape(c) for c in p)
                alternatives.append(rf"(?:^|.*/){part}(?:/.*)?$")
        return IgnoreRules("|".join(f"(?:{a})" for a in alternatives))

    def ignores(self, rel: str) -> bool:
        rel = rel.replace("\\", "/").strip("/").lower()
        return bool(rel) and re.match(self.expression, rel, re.DOTALL) is not None
