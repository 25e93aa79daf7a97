"""Counter-based random numbers: a hash of the seed and of what the number is
for. The same number comes out whatever the partitioning, on a retried task,
and in any SQL engine that has MD5.

All builders return SQL text for ``F.expr`` / ``selectExpr``. Their parts are
numbers or SQL fragments (a column name, a quoted tag).
"""

from __future__ import annotations

HEX_DIGITS = 13  # 52 bits, exact in a double
RESOLUTION = 16**HEX_DIGITS


def digest(*parts) -> str:
    """MD5 of the parts joined with ``|``, as 32 hex digits."""
    return f"md5(concat_ws('|', {', '.join(str(p) for p in parts)}))"


def uniform(*parts) -> str:
    """Double in [0, 1)."""
    return f"(double(conv(substr({digest(*parts)}, 1, {HEX_DIGITS}), 16, 10)) / {RESOLUTION}D)"


def hash_below(fraction: float, *parts) -> str:
    """Predicate that keeps a ``fraction`` of the keys, independently per key.

    Compares the hex text itself, so no number is parsed per row.
    """
    if fraction >= 1:
        return "true"
    return f"{digest(*parts)} < '{int(fraction * RESOLUTION):0{HEX_DIGITS}x}'"
