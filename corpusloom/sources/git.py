"""What a version control working copy says has changed."""

from __future__ import annotations

import subprocess

from corpusloom.sources.ignore import IgnoreRules


def _run(root: str, *args: str) -> str | None:
    try:
        out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return out.stdout if out.returncode == 0 else None


def status(root: str) -> str:
    return _run(root, "status", "--short") or ""


def diff(root: str, path: str | None = None) -> str:
    return _run(root, "diff", *(["--", path] if path else [])) or ""


def recent_changes(root: str, rules: IgnoreRules, commits: int = 5) -> list[str]:
    """Changed paths of the working copy and, with enough history, of the last commits; renamed files by their new name."""
    found = [line[3:].split(" -> ")[-1].strip('"') for line in (_run(root, "status", "--porcelain") or "").splitlines()]
    if int(_run(root, "rev-list", "--count", "HEAD") or 0) >= commits:
        found += (_run(root, "diff", "--name-only", f"HEAD~{commits}..HEAD") or _run(root, "diff", "--name-only", f"HEAD~{commits - 1}..HEAD") or "").splitlines()
    return sorted({p for p in found if p and not rules.ignores(p)})
