"""Small helpers to write the SQL twins."""

from __future__ import annotations


def q(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def even(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * {float(10**digits)}, 0) / {float(10**digits)})"


def case(col: str, table: dict, otherwise: str = "null") -> str:
    rows = " ".join(
        f"when {col} = {q(k) if isinstance(k, str) else k} then "
        f"{q(v) if isinstance(v, str) or v is None else v}"
        for k, v in table.items()
    )
    return f"case {rows} else {otherwise} end"


def rungs(x: str, table, otherwise) -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else str(v)

    rows = " ".join(f"when {x} >= {b} then {lit(v)}" for b, v in table)
    return f"case {rows} else {lit(otherwise)} end"


def join_reasons(pairs, sep: str = ", ") -> str:
    """Texts of the true conditions, in order, joined."""
    items = ", ".join(f"case when {c} then {t} end" for c, t in pairs)
    return f"coalesce(array_to_string(list_filter([{items}], lambda v: v is not null), '{sep}'), '')"
