"""Bounded descriptions of JSON values."""

from __future__ import annotations

import json

DEPTH, ITEMS, KEYS = 6, 1000, 200


def describe(value, budget: int = 1 << 20, depth: int = DEPTH):
    """The value with deep parts, long lists and wide objects cut, or a note of its size where it is over budget."""

    def cut(v, left: int):
        if isinstance(v, (dict, list)) and not left:
            return {"truncated": "object" if isinstance(v, dict) else "array", "size": len(v)}
        if isinstance(v, dict):
            return {str(k): cut(x, left - 1) for k, x in list(v.items())[:KEYS]}
        if isinstance(v, list):
            return [cut(x, left - 1) for x in v[:ITEMS]]
        return v

    out = cut(value, depth)
    size = len(json.dumps(out, ensure_ascii=False, default=str).encode())
    return out if size <= budget else {"truncated": type(value).__name__, "bytes": size, "budget": budget}
