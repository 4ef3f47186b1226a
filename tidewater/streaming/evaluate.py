"""The window aggregates over the rows of one frame, for the stateful processor; tests hold them against the SQL forms."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from ..functions.registry import BASES, NAMES, WINDOW_AGGREGATES


def text(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        if math.isnan(x):
            return "NaN"
        if math.isinf(x):
            return "inf" if x > 0 else "-inf"
        return f"{x:.6f}".rstrip("0").rstrip(".")
    return str(x)


def standard(name: str, xs: list):
    """SQL's aggregate of the non-null values among ``xs``."""
    some = [x for x in xs if x is not None]
    n = len(some)
    if name == "count":
        return n
    if not n:
        return None
    if name in ("sum", "min", "max"):
        return {"sum": sum, "min": min, "max": max}[name](some)
    mean = sum(some) / n
    if name == "avg":
        return mean
    spread = sum((x - mean) ** 2 for x in some)
    population = name.endswith("_pop")
    if not population and n == 1:
        return None
    variance = spread / (n if population else n - 1)
    return math.sqrt(variance) if name.startswith("stddev") else variance


def _listed(pairs: list[tuple]) -> str:
    return ",".join(f"{text(k)}:{text(m)}" for k, m in pairs)


def _grouped(rows: list[tuple]) -> dict:
    out = defaultdict(list)
    for v, k in rows:
        out[k].append(v)
    return out


def _first(pairs: list[tuple], n: int, by_value: bool) -> str:
    return _listed(sorted(pairs, key=(lambda p: (p[1], p[0])) if by_value else (lambda p: p[0]), reverse=True)[: max(0, n)])


def evaluate(name: str, rows: list[tuple]):
    """``name`` over the argument tuples of a frame, which is never empty."""
    if name in WINDOW_AGGREGATES:
        return standard(name, [r[0] if r else 1 for r in rows])
    if name not in NAMES:
        raise ValueError(f"unsupported window aggregate {name!r}")
    if name in ("top", "topn_frequency", "top1_ratio"):
        some = [r[0] for r in rows if r[0] is not None]
        if name == "top":
            return ",".join(map(text, sorted(some, reverse=True)[: rows[0][1]]))
        ranked = sorted(((c, v) for v, c in Counter(some).items()), reverse=True)
        if name == "top1_ratio":
            return ranked[0][0] / len(some) if some else 0.0
        return ",".join(text(v) for _, v in ranked[: rows[0][1]])
    if name.endswith("ratio_cate"):
        groups = _grouped([(bool(c), k) for v, c, k, _ in rows if v is not None and k is not None])
        return _first([(k, sum(xs) / len(xs)) for k, xs in groups.items()], rows[0][3], "_value_" in name)
    base = next(b for b in BASES if b in name.split("_"))
    if name == f"{base}_where":
        return standard(base, [v for v, c in rows if c])
    masked = [(r[0], r[-1]) for r in rows if r[-1] is not None] if name == f"{base}_cate" else [(r[0], r[2]) for r in rows if r[1] and r[2] is not None]
    pairs = [(k, m) for k, xs in _grouped(masked).items() if (m := standard(base, xs)) is not None]
    if name.startswith("top_n_"):
        return _first(pairs, rows[0][3], "_value_" in name)
    return ",".join(sorted(f"{text(k)}:{text(m)}" for k, m in pairs))


def result_type(name: str, first: str | None) -> str:
    """Spark type of the result for a first argument of type ``first``."""
    if name in NAMES and name != "top1_ratio" and not (name.endswith("_where") and "cate" not in name):
        return "string"
    base = name.removesuffix("_where")
    if base == "count":
        return "bigint"
    if base in ("min", "max"):
        return first
    if base == "sum" and first in ("int", "bigint"):
        return "bigint"
    return "double"
