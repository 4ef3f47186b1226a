"""Thirty aggregates for features, written as SQL text over built-in functions.

The same text serves GROUP BY, windows (``over`` is put behind the one collecting
aggregate) and the rewriting of SQL statements, so semantics cannot drift.
Everything stays in the JVM; nothing is a UDF.

Rules shared by all:

* a null category leaves a row out; a null condition counts as not true;
* a category whose aggregate is null is left out; no category gives "";
* values are written by ``text``: booleans true/false, whole numbers plain,
  floating-point numbers with six decimals less trailing zeros, strings as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("sum", "avg", "count", "min", "max")
#: Standard aggregates that windows accept; any other name is an error.
WINDOW_AGGREGATES = (*BASES, "stddev", "stddev_pop", "stddev_samp", "var_pop", "var_samp", "variance")


def text(x: str) -> str:
    """SQL text that writes the value ``x``; six decimals are rounded half to even, from the number's exact value."""
    number = f"try_cast({x} AS DOUBLE)"
    # The product with a million and what its rounding lost, exactly: the number is split into two halves of 26 bits.
    split = "named_struct('a', abs(d), 'h', abs(d) * 134217729D - (abs(d) * 134217729D - abs(d)))"
    product = "named_struct('p', s.a * 1e6D, 'e', (s.h * 1e6D - s.a * 1e6D) + (s.a - s.h) * 1e6D)"
    half = "(q.p - floor(q.p))"
    up = f"CASE WHEN {half} > 0.5D OR ({half} = 0.5D AND (q.e > 0 OR (q.e = 0 AND floor(q.p) % 2 = 1))) THEN 1L ELSE 0L END"
    digits = _let("n", f"CAST(floor(q.p) AS BIGINT) + {up}", "concat(CAST(n div 1000000L AS STRING), '.', lpad(CAST(n % 1000000L AS STRING), 6, '0'))")
    exact = _let("s", split, _let("q", product, digits))
    plain = f"regexp_replace(CASE WHEN abs(d) < 9e9D THEN concat(CASE WHEN d < 0 THEN '-' ELSE '' END, {exact}) ELSE printf('%.6f', d) END, '[.]?0+$', '')"
    special = f"CASE WHEN isnan(d) THEN 'NaN' WHEN d = double('infinity') THEN 'inf' WHEN d = double('-infinity') THEN '-inf' ELSE {plain} END"
    return f"CASE WHEN typeof({x}) IN ('double', 'float') THEN {_let('d', number, special)} ELSE CAST({x} AS STRING) END"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _collect(x: str, over: str | Callable[[str], str]) -> str:
    if callable(over):
        return over(x)
    return f"collect_list({x}){' OVER ' + over if over else ''}"


def _metric(base: str, rows: str) -> str:
    """The aggregate ``base`` of the array of values ``rows``; null where SQL's is."""
    some = f"filter({rows}, y -> y IS NOT NULL)"
    if base == "count":
        return f"CAST(size({some}) AS BIGINT)"
    if base in ("min", "max"):
        return f"array_{base}({rows})"
    if base == "avg":
        return _let("zs", some, "CASE WHEN size(zs) > 0 THEN aggregate(zs, 0D, (a, y) -> a + CAST(y AS DOUBLE)) / size(zs) END")
    wide = f"transform({some}, y -> y * 1L)"
    return _let("zs", wide, "aggregate(zs, get(zs, size(zs)), (a, y) -> coalesce(a + y, y))")


def _by_category(base: str, xs: str) -> str:
    """Array of (k, m): each category of the collected (v, k) with its aggregate, without null ones."""
    own = f"transform(filter({xs}, x -> x.k = k), x -> x.v)"
    pairs = f"transform(array_distinct(transform({xs}, x -> x.k)), k -> named_struct('k', k, 'm', {_metric(base, own)}))"
    return f"filter({pairs}, p -> p.m IS NOT NULL)"


def _masked(v: str, cond: str, cate: str) -> str:
    return f"CASE WHEN ({cate}) IS NOT NULL AND coalesce({cond}, false) THEN named_struct('v', {v}, 'k', {cate}) END"


def _pairs(array: str) -> str:
    """"key:metric" of each element, in the order of ``array``."""
    return f"array_join(transform({array}, p -> concat({text('p.k')}, ':', {text('p.m')})), ',')"


def _cate(base: str, v: str, cond: str, cate: str, over: str) -> str:
    parts = f"transform({_by_category(base, 'xs')}, p -> concat({text('p.k')}, ':', {text('p.m')}))"
    return _let("xs", _collect(_masked(v, cond, cate), over), f"array_join(array_sort({parts}), ',')")


def _first(array: str, n: str, by_value: bool) -> str:
    """The first ``n`` of (k, m), by key or by metric and then key, falling."""
    if by_value:
        ranked = f"sort_array(transform({array}, p -> named_struct('m', p.m, 'k', p.k)), false)"
    else:
        ranked = f"sort_array({array}, false)"
    return f"slice({ranked}, 1, CAST({n} AS INT))"


def _top_cate(base: str, v: str, cond: str, cate: str, n: str, by_value: bool, over: str) -> str:
    return _let("xs", _collect(_masked(v, cond, cate), over), _pairs(_first(_by_category(base, "xs"), n, by_value)))


def _ratio_cate(v: str, cond: str, cate: str, n: str, by_value: bool, over: str) -> str:
    row = f"CASE WHEN ({cate}) IS NOT NULL AND ({v}) IS NOT NULL THEN named_struct('v', coalesce({cond}, false), 'k', {cate}) END"
    ratio = "size(filter(xs, x -> x.k = k AND x.v)) / CAST(size(filter(xs, x -> x.k = k)) AS DOUBLE)"
    pairs = f"transform(array_distinct(transform(xs, x -> x.k)), k -> named_struct('k', k, 'm', {ratio}))"
    return _let("xs", _collect(row, over), _pairs(_first(pairs, n, by_value)))


def _histogram(xs: str) -> str:
    return f"sort_array(transform(array_distinct({xs}), d -> named_struct('c', size(filter({xs}, x -> x = d)), 'd', d)), false)"


def _top(v: str, n: str, over: str) -> str:
    return _let("xs", _collect(v, over), f"array_join(transform(slice(sort_array(xs, false), 1, CAST({n} AS INT)), x -> {text('x')}), ',')")


def _frequency(v: str, n: str, over: str) -> str:
    return _let("xs", _collect(v, over), f"array_join(transform(slice({_histogram('xs')}, 1, CAST({n} AS INT)), x -> {text('x.d')}), ',')")


def _top1_ratio(v: str, over: str) -> str:
    return _let("xs", _collect(v, over), f"CASE WHEN size(xs) = 0 THEN 0D ELSE element_at({_histogram('xs')}, 1).c / CAST(size(xs) AS DOUBLE) END")


def _arity() -> dict[str, int]:
    out = {"top": 2, "topn_frequency": 2, "top1_ratio": 1}
    for b in BASES:
        out |= {f"{b}_where": 2, f"{b}_cate": 2, f"{b}_cate_where": 3, f"top_n_key_{b}_cate_where": 4, f"top_n_value_{b}_cate_where": 4}
    return out | {"top_n_key_ratio_cate": 4, "top_n_value_ratio_cate": 4}


#: Names of the aggregates with the number of their arguments.
NAMES: dict[str, int] = _arity()


def expression(name: str, args: list[str], over: str | Callable[[str], str] = "") -> str:
    """SQL text for ``name(args)``, over the window ``over`` ("(PARTITION BY ...)" or a window's name) if given.

    Of a collecting aggregate, ``over`` may instead give the array of the collected expression that it is called with.
    """
    if name not in NAMES:
        raise ValueError(f"unknown aggregate {name!r}")
    if len(args) != NAMES[name]:
        raise ValueError(f"{name} takes {NAMES[name]} arguments, not {len(args)}")
    if name == "top":
        return _top(*args, over)
    if name == "topn_frequency":
        return _frequency(*args, over)
    if name == "top1_ratio":
        return _top1_ratio(*args, over)
    if name.startswith("top_n_"):
        by_value, base = name.startswith("top_n_value_"), name.split("_")[3]
        return _ratio_cate(*args, by_value, over) if base == "ratio" else _top_cate(base, *args, by_value, over)
    base, _, rest = name.partition("_")
    if rest == "where":
        return f"{base}(CASE WHEN {args[1]} THEN {args[0]} END){' OVER ' + over if over else ''}"
    v, cond, cate = (args[0], "true", args[1]) if rest == "cate" else args
    return _cate(base, v, cond, cate, over)


def feature(name: str, *args: str, over: str = "") -> Column:
    """The aggregate as a Column; arguments are SQL expressions."""
    return F.expr(expression(name, list(args), over))
