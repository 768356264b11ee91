"""Confinement of paths to a project."""

from __future__ import annotations

from pathlib import Path


def resolve_inside(root: str | Path, value: str | Path) -> Path:
    """``value`` below ``root`` with links followed; ValueError if it leads outside."""
    base = Path(root).resolve()
    full = (base / value).resolve()
    if full != base and base not in full.parents:
        raise ValueError(f"Path escapes project root: {value}")
    return full


def is_inside(root: str | Path, value: str | Path) -> bool:
    try:
        resolve_inside(root, value)
    except ValueError:
        return False
    return True
