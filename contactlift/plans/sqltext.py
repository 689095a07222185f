"""DuckDB SQL text for the oracle side of the checks (the same semantics written in SQL)."""

from __future__ import annotations

from collections.abc import Sequence

from contactlift.operators.packs import PACKS, Spec, _final_specs, layers


def dbl(x: float) -> str:
    """A DOUBLE literal (DuckDB reads 0.025 as DECIMAL otherwise)."""
    return f"cast({float(x)!r} as double)"


def nn(x: str) -> str:
    return f"(case when isnan(cast({x} as double)) then null else cast({x} as double) end)"


def q(name: str) -> str:
    return '"' + name + '"'


def _input(token: str) -> str:
    if "/" in token:
        name, scale = token.split("/")
        return f"(cast({q(name)} as double) / {dbl(float(scale))})"
    return q(token)


def sql_sum(xs: Sequence[str]) -> str:
    return "(" + " + ".join(f"coalesce({nn(x)}, {dbl(0)})" for x in xs) + ")"


def sql_mean(xs: Sequence[str]) -> str:
    cnt = " + ".join(f"(case when {nn(x)} is not null then 1 else 0 end)" for x in xs)
    return f"(case when ({cnt}) > 0 then {sql_sum(xs)} / ({cnt}) end)"


def sql_ratio(n: str, d: str) -> str:
    """DuckDB divides doubles the IEEE way (x/0 = +-Inf by the signs, 0/0 = NaN, NULL stays NULL)."""
    return f"(cast({n} as double) / cast({d} as double))"


def sql_op(op: str, inputs: Sequence[str]) -> str:
    xs = [_input(i) for i in inputs]
    if op == "max":
        return "greatest(" + ", ".join(nn(x) for x in xs) + ")"
    if op == "min":
        return "least(" + ", ".join(nn(x) for x in xs) + ")"
    if op == "sum":
        return sql_sum(xs)
    if op == "mean":
        return sql_mean(xs)
    if op == "ratio":
        return sql_ratio(xs[0], xs[1])
    raise ValueError(op)


def finite(x: str) -> str:
    return f"(case when isnan({x}) or abs({x}) = 'inf'::double then null else {x} end)"


def ieee(x: str) -> str:
    return (f"(case when {x} is null then null when isnan({x}) then 3 when {x} = 'inf'::double then 1 "
            f"when {x} = '-inf'::double then 2 else 0 end)")


def pack_sql(pack: str, source: str, id_col: str = "id_cliente") -> str:
    """Layered SELECTs adding a pack's columns to ``source``, then the compared projection."""
    specs: list[Spec] = PACKS[pack]
    body = f"select * from {source}"
    for i, layer in enumerate(layers(specs)):
        exprs = ", ".join(f"{sql_op(op, inputs)} as {q(name)}" for name, op, inputs in layer)
        body = f"select *, {exprs} from ({body}) l{i}"
    final = _final_specs(specs)
    out = [q(id_col)]
    for name, (_, op, _) in final.items():
        out.append(f"{finite(q(name))} as {q(name)}")
        if op == "ratio":
            out.append(f"cast({ieee(q(name))} as integer) as {q(name + '__ieee')}")
    return "select " + ", ".join(out) + f" from ({body}) packed"
