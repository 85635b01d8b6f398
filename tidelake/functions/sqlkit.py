"""Pieces of the SQL that queries are checked against."""

P = "partition by sym order by t"
BARS = """bars as (select event_type as sym, (epoch_us(ts) // 14400000000) * 14400 as t, arg_min(value, (ts, event_id)) as o, max(value) as h,
  min(value) as l, arg_max(value, (ts, event_id)) as c, count(*)::double as v, sum(value) as n, (count(*) filter (where value > 50))::double as tb
  from events group by 1, 2)"""


def over(k: int) -> str:
    return f"over ({P} rows between {k - 1} preceding and current row)"


def roll(agg: str, c: str, k: int, m: int | None = None) -> str:
    """``agg`` may hold ``{}`` for the column."""
    f = agg.format(c) if "{}" in agg else f"{agg}({c})"
    return f"(case when count({c}) {over(k)} >= {k if m is None else m} then {f} {over(k)} end)"


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) over ({P})"


def lead(c: str, k: int = 1) -> str:
    return f"lead({c}, {k}) over ({P})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def zscore(c: str, k: int, eps: float = 0.0) -> str:
    return div(f"{c} - {roll('avg', c, k)}", f"{roll('stddev_samp', c, k)} + {eps}")


def staged(*stages: dict[str, str], source: str = "bars", head: str = BARS, keep: str = "sym, t", digits: int = 6) -> str:
    """Stages of named expressions over a source; the last stage's are returned, rounded, with the key."""
    sql, at = f"with {head}", source
    for i, s in enumerate(stages):
        if i < len(stages) - 1:
            sql += f", s{i} as (select *, {', '.join(f'{e} as {n}' for n, e in s.items())} from {at})"
            at = f"s{i}"
    return f"{sql} select {keep}, {', '.join(f'round(({e})::double, {digits}) + 0.0 as {n}' for n, e in stages[-1].items())} from {at}"
