"""SQL of the queries that SQL can express."""

from __future__ import annotations

_LETTERS = r"upper(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]+', '', 'g'))"
_KEY = "nullif(" + _LETTERS + ", '')"

_P3 = f"""
with c as (select 'coords_df' as tbl, row_id, {_KEY.format('ZoneID')} as k, {_LETTERS.format('ZoneName')} as zname, XCoord + 0 as x, YCoord + 0 as y, POPU + 0 as p, hosp + 0 as h, AddedOn, RemovedOn, geometry from coords_df),
cg as (select tbl, row_id, min(row_id) over w as first_id from c where k is not null window w as (partition by k, zname, x, y, p, h, AddedOn, RemovedOn, geometry)),
a as (select 'df_adj' as tbl, row_id, {_KEY.format('focal')} as f, {_KEY.format('neighbor')} as n, SnapshotOn, BorderKm + 0 as b from df_adj),
ag as (select tbl, row_id, min(row_id) over w as first_id from a where f is not null and n is not null window w as (partition by least(f, n), greatest(f, n), SnapshotOn, b)),
g as (select * from cg union all select * from ag)
"""
P3_SQL = _P3 + "select tbl, first_id as row_a, row_id as row_b from g where row_id <> first_id"
P3_COUNTS_SQL = _P3 + "select tbl, first_id as row_id, count(*) as n_copies from g group by tbl, first_id"

SQL = {"p3_found": P3_SQL, "p3_counts": P3_COUNTS_SQL}


def _percentiles(of: str, keys: str) -> str:
    """Exact percentiles of ``v`` per ``keys``, as sketches give them of groups that they hold whole: the least value that a share of all doesn't exceed."""
    picked = ", ".join(f"s[greatest(1, cast(ceil(round({r} * len(s), 7)) as integer))] as p{int(r * 100):02d}" for r in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    return f"select {keys}, len(s) as n_values, {picked}, 0.0::double as rank_error from (select {keys}, list_sort(list(v)) as s from {of} group by {keys})"


_P1 = f"""
with f as (select {_KEY.format('Destin')} as destin, Service as service, FlowDate as day, strftime(FlowDate, '%Y-%m') as month, Flow + 0.0 as v from df_flow where Flow is not null and not isnan(Flow)),
named as (select * from f where destin is not null),
unions as (select destin, service, unnest([year(day) || 'Q' || quarter(day), strftime(day, '%a')]) as days, v from named where day is not null)
"""
SQL["p1_percentiles"] = _P1 + _percentiles("named", "destin, service, month")
SQL["p1_day_unions"] = _P1 + _percentiles("unions", "destin, service, days")
SQL["p1_outside"] = "select * from (values " + ", ".join(f"({r}::double, 0::bigint)" for r in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + ") t(share, n_outside)"
