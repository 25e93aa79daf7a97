"""SQL text for axis-aligned Gaussians, unrolled over the dimensions so that it
stays inside generated code. Arguments are SQL fragments, one per dimension."""

from __future__ import annotations

from collections.abc import Sequence


def scaled_sq_distance(a: Sequence[str], b: Sequence[str], scale: Sequence[str]) -> str:
    """Sum over the dimensions of ((a - b) / scale) squared.

    The scale must be positive (populations are floored at ``eps``): in ANSI
    mode a division by zero raises.
    """
    parts = [f"(({x} - {y}) / {s})" for x, y, s in zip(a, b, scale, strict=True)]
    return "(" + " + ".join(f"{p} * {p}" for p in parts) + ")"


def prefixed(prefix: str, names: Sequence[str]) -> list[str]:
    return [prefix + n for n in names]
