"""FilterSpec -> DuckDB WHERE text, for the oracle side only."""

from __future__ import annotations

from tenderlake.functions.filters import FilterSpec, month_bounds


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def sql_where(f: FilterSpec, r: str = "r", c: str | None = "c") -> str:
    """WHERE text; ``c`` is the chunk alias, or None to test the release's item CPVs."""
    p: list[str] = []
    if f.cpv_prefix is not None and c is not None:
        p.append(f"len(list_filter({c}.cpv_codes, lambda x: starts_with(x, {_q(f.cpv_prefix)}))) > 0")
    elif f.cpv_prefix is not None:
        p.append(f"EXISTS (SELECT 1 FROM release_cpvs rc WHERE rc.ocid = {r}.ocid "
                 f"AND starts_with(rc.cpv, {_q(f.cpv_prefix)}))")
    if f.main_procurement_category is not None:
        p.append(f"{r}.main_procurement_category = {_q(f.main_procurement_category)}")
    if f.procurement_method is not None:
        p.append(f"{r}.procurement_method = {_q(f.procurement_method)}")
    if f.status is not None:
        p.append(f"{r}.status = {_q(f.status)}")
    if f.value_min is not None:
        p.append(f"{r}.value_amount >= {float(f.value_min)!r}")
    if f.value_max is not None:
        p.append(f"{r}.value_amount <= {float(f.value_max)!r}")
    if f.buyer_name is not None:
        p.append(f"contains(lower({r}.buyer_name), {_q(f.buyer_name.lower())})")
    dl = f"coalesce({r}.submission_deadline, {r}.deadline)"
    if f.deadline_before is not None:
        p.append(f"{dl} <= {_q(f.deadline_before)}")
    if f.deadline_after is not None:
        p.append(f"{dl} >= {_q(f.deadline_after)}")
    if f.tag is not None:
        p.append(f"list_contains({r}.tag, {_q(f.tag)})")
    if f.has_awards is not None:
        p.append(f"{r}.has_awards = {'TRUE' if f.has_awards else 'FALSE'}")
    if f.eu_funded is not None:
        p.append(f"{r}.eu_funded = {'TRUE' if f.eu_funded else 'FALSE'}")
    if f.location_nuts is not None:
        p.append(f"EXISTS (SELECT 1 FROM release_nuts n WHERE n.ocid = {r}.ocid "
                 f"AND starts_with(n.nuts, {_q(f.location_nuts)}))")
    if f.submission_deadline_before is not None:
        p.append(f"{r}.submission_deadline <= {_q(f.submission_deadline_before)}")
    if f.submission_deadline_after is not None:
        p.append(f"{r}.submission_deadline >= {_q(f.submission_deadline_after)}")
    if f.result_code is not None:
        p.append(f"{r}.result_code = {_q(f.result_code)}")
    if f.nuts_code is not None:
        p.append(f"EXISTS (SELECT 1 FROM party_nuts pn WHERE pn.ocid = {r}.ocid "
                 f"AND starts_with(pn.nuts, {_q(f.nuts_code)}))")
    if f.month is not None:
        lo, hi = month_bounds(f.month)
        p.append(f"{r}.date >= {_q(lo)} AND {r}.date < {_q(hi)}")
    return " AND ".join(p) if p else "TRUE"


TRUNCATE_200 = ("CASE WHEN strlen({t}) <= 200 THEN {t} ELSE "
                "left({t}, CAST((SELECT max(n) FROM range(0, 201) rr(n) WHERE strlen(left({t}, CAST(n AS BIGINT))) <= 200) AS BIGINT)) "
                "|| '…' END")


def truncate_sql(t: str) -> str:
    return TRUNCATE_200.format(t=t)
