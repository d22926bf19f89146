"""Checking SQL for batches of formulas, and for the normal distribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from panelworks.operators.formulas import FEATURES, computable


def _over(expression: str, w: int) -> str:
    return f"{expression} OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _windowed(op: str, a: str, b: str, w: int) -> str:
    order = "OVER (PARTITION BY symbol ORDER BY d)"
    if op == "ts_delay":
        return f"lag({a}, {w}) {order}"
    if op == "ts_delta":
        return f"{a} - lag({a}, {w}) {order}"
    x, y = f"(CASE WHEN {b} IS NOT NULL THEN {a} END)", f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    spread = f"{_over(f'stddev_pop({x})', w)} * {_over(f'stddev_pop({y})', w)}"
    pairs = _over(f"count({x})", w)
    inner = {
        "ts_mean": _over(f"avg({a})", w),
        "ts_std": _over(f"stddev_pop({a})", w),
        "ts_max": _over(f"max({a})", w),
        "ts_min": _over(f"min({a})", w),
        "ts_sum": _over(f"sum({a})", w),
        "ts_rank": f"CASE WHEN {a} IS NOT NULL THEN len(list_filter({_over(f'list({a})', w)}, lambda v: v <= {a}))"
        f" / CAST({_over(f'count({a})', w)} AS DOUBLE) END",
        "ts_argmax": f"d - {_over(f'arg_max(d, row({a}, -d)) FILTER (WHERE {a} IS NOT NULL)', w)}",
        "ts_argmin": f"d - {_over(f'arg_min(d, row({a}, d)) FILTER (WHERE {a} IS NOT NULL)', w)}",
        "ts_corr": f"CASE WHEN {pairs} >= 2 AND {spread} > 1e-12 THEN {_over(f'covar_pop({x}, {y})', w)} / ({spread}) END",
        "ts_cov": f"CASE WHEN {pairs} >= 2 THEN {_over(f'covar_pop({x}, {y})', w)} END",
    }[op]
    return f"CASE WHEN d >= {w - 1} THEN {inner} END"


_CELL = {
    "neg": "-{0}",
    "add": "{0} + {1}",
    "sub": "{0} - {1}",
    "mul": "{0} * {1}",
    "div": "CASE WHEN abs({1}) >= 1e-12 THEN {0} / {1} END",
    "max": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END",
    "min": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END",
}


def formula_ctes(
    formulas: Mapping[str, Sequence[str]], source: str = "panel", columns: Sequence[str] = FEATURES[:9], keep: str = "n_days, fwd"
) -> str:
    """CTEs ending in ``fv(factor_id, symbol, d, *keep, value)``; every formula ends in ``cs_rank``."""
    usable = computable(formulas, columns)
    terms = {t.key: t for ts in usable.values() for t in ts if t.kind != "section"}
    name = {key: key if t.kind == "feature" else f"t{i}" for i, (key, t) in enumerate(sorted(terms.items()))}
    ctes, previous = [], source
    for level in range(1, 1 + max(t.level for t in terms.values())):
        made = []
        for t in terms.values():
            if t.level == level:
                a = name[t.args[0]]
                b = name[t.args[1]] if len(t.args) > 1 else a
                expression = _windowed(t.op, a, b, t.window) if t.kind == "window" else _CELL[t.op].format(a, b)
                made.append(f"{expression} AS {name[t.key]}")
        ctes.append(f"lv{level} AS (SELECT *, {', '.join(made)} FROM {previous})")
        previous = f"lv{level}"
    keep_columns = f", {keep}" if keep else ""
    parts = " UNION ALL ".join(
        f"SELECT '{factor}' AS factor_id, symbol, d{keep_columns}, CAST({name[ts[-1].args[0]]} AS DOUBLE) AS raw FROM {previous}"
        for factor, ts in usable.items()
    )
    ctes.append(f"fraw AS (SELECT * FROM ({parts}) WHERE raw IS NOT NULL)")
    ctes.append(
        "fv AS (SELECT *, row_number() OVER (PARTITION BY factor_id, d ORDER BY raw, symbol)"
        " / CAST(count(*) OVER (PARTITION BY factor_id, d) AS DOUBLE) AS value FROM fraw)"
    )
    return ",\n" + ",\n".join(ctes) + "\n"


def erfc_sql(x: str) -> str:
    """Complementary error function of a column as one SQL expression."""
    a = f"abs({x})"
    series = "1.0"
    for k in range(60, 0, -1):
        series = f"(1 + 2 * a * a / {2 * k + 1} * {series})"
    tail = "a"
    for k in range(60, 0, -1):
        tail = f"(a + {k / 2} / {tail})"
    low = f"1 - 2 / sqrt(pi()) * exp(-a * a) * a * {series}"
    high = f"exp(-a * a) / sqrt(pi()) / {tail}"
    upper = f"(SELECT CASE WHEN a <= 2.5 THEN {low} ELSE {high} END FROM (SELECT {a} AS a))"
    return f"CASE WHEN {x} >= 0 THEN {upper} ELSE 2 - {upper} END"
