"""Structured filters compiled to one boolean Column.

Every predicate follows SQL's WHERE rule: a NULL (missing metadata) rejects
the row, which is also the reference's "missing means reject" rule.  The
columns are those of ``tenderlake.operators.metadata.release_metadata``; the
CPV prefix of the match path reads the *chunk's* codes (``cpv_col``).

Equality, range and ``startswith`` predicates on top-level columns are
pushed into the parquet scan when the metadata is read from a written table.
"""

from __future__ import annotations

import dataclasses
import functools
from typing import Optional

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_FIELDS = (
    "cpv_prefix", "main_procurement_category", "procurement_method", "status",
    "value_min", "value_max", "buyer_name", "deadline_before", "deadline_after",
    "tag", "has_awards", "eu_funded", "location_nuts",
)
LISTING_FIELDS = ("submission_deadline_before", "submission_deadline_after",
                  "result_code", "nuts_code", "month")


def _any_startswith(arr: Column, prefix: str) -> Column:
    return F.exists(arr, lambda x: x.startswith(F.lit(prefix)))


def effective_deadline(submission_deadline: Column, end_date: Column) -> Column:
    """The submission deadline, else the tender period's end."""
    return F.coalesce(submission_deadline, end_date)


@dataclasses.dataclass(frozen=True)
class FilterSpec:
    cpv_prefix: Optional[str] = None
    main_procurement_category: Optional[str] = None
    procurement_method: Optional[str] = None
    status: Optional[str] = None
    value_min: Optional[float] = None
    value_max: Optional[float] = None
    buyer_name: Optional[str] = None
    deadline_before: Optional[str] = None
    deadline_after: Optional[str] = None
    tag: Optional[str] = None
    has_awards: Optional[bool] = None
    eu_funded: Optional[bool] = None
    location_nuts: Optional[str] = None
    # listing-only
    submission_deadline_before: Optional[str] = None
    submission_deadline_after: Optional[str] = None
    result_code: Optional[str] = None
    nuts_code: Optional[str] = None
    month: Optional[str] = None
    # "text" compares ISO strings like the reference; "instant" parses them
    deadline_mode: str = "text"

    def has_any(self) -> bool:
        """True when at least one of the 13 shared filters is given (False/0 count)."""
        return any(getattr(self, f) is not None for f in MATCH_FIELDS)

    def needs_release(self) -> bool:
        """True when a predicate reads release metadata (all but the CPV prefix)."""
        fields = [f for f in MATCH_FIELDS + LISTING_FIELDS if f != "cpv_prefix"]
        return any(getattr(self, f) is not None for f in fields)

    def _time_cmp(self, col: Column, bound: str, op: str) -> Column:
        if self.deadline_mode == "instant":
            lhs, rhs = F.try_to_timestamp(col), F.try_to_timestamp(F.lit(bound))
        else:
            lhs, rhs = col, F.lit(bound)
        return lhs <= rhs if op == "<=" else lhs >= rhs

    def predicates(self, cpv_col: str = "cpv_codes") -> list[Column]:
        p: list[Column] = []
        c = F.col
        if self.cpv_prefix is not None:
            p.append(F.coalesce(_any_startswith(c(cpv_col), self.cpv_prefix), F.lit(False)))
        if self.main_procurement_category is not None:
            p.append(c("main_procurement_category") == F.lit(self.main_procurement_category))
        if self.procurement_method is not None:
            p.append(c("procurement_method") == F.lit(self.procurement_method))
        if self.status is not None:
            p.append(c("status") == F.lit(self.status))
        if self.value_min is not None:
            p.append(c("value_amount") >= F.lit(float(self.value_min)))
        if self.value_max is not None:
            p.append(c("value_amount") <= F.lit(float(self.value_max)))
        if self.buyer_name is not None:
            p.append(F.lower(c("buyer_name")).contains(self.buyer_name.lower()))
        dl = effective_deadline(c("submission_deadline"), c("deadline"))
        if self.deadline_before is not None:
            p.append(self._time_cmp(dl, self.deadline_before, "<="))
        if self.deadline_after is not None:
            p.append(self._time_cmp(dl, self.deadline_after, ">="))
        if self.tag is not None:
            p.append(F.array_contains(c("tag"), F.lit(self.tag)))
        if self.has_awards is not None:
            p.append(c("has_awards") == F.lit(bool(self.has_awards)))
        if self.eu_funded is not None:
            p.append(c("eu_funded") == F.lit(bool(self.eu_funded)))
        if self.location_nuts is not None:
            p.append(F.coalesce(_any_startswith(c("location_nuts"), self.location_nuts), F.lit(False)))
        if self.submission_deadline_before is not None:
            p.append(self._time_cmp(c("submission_deadline"), self.submission_deadline_before, "<="))
        if self.submission_deadline_after is not None:
            p.append(self._time_cmp(c("submission_deadline"), self.submission_deadline_after, ">="))
        if self.result_code is not None:
            p.append(c("result_code") == F.lit(self.result_code))
        if self.nuts_code is not None:
            p.append(F.coalesce(_any_startswith(c("party_nuts"), self.nuts_code), F.lit(False)))
        if self.month is not None:
            lo, hi = month_bounds(self.month)
            p.append((c("date") >= F.lit(lo)) & (c("date") < F.lit(hi)))
        return p

    def column(self, cpv_col: str = "cpv_codes") -> Column:
        """All given predicates ANDed (``lit(True)`` when none is given)."""
        return functools.reduce(lambda a, b: a & b, self.predicates(cpv_col), F.lit(True))


def month_bounds(month: str) -> tuple[str, str]:
    """``'2024-03'`` -> (``'2024-03'``, ``'2024-04'``): a string range on ISO dates."""
    y, m = (int(x) for x in month.split("-"))
    if not (1 <= m <= 12):
        raise ValueError(f"bad month {month!r}")
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    return f"{y:04d}-{m:02d}", f"{ny:04d}-{nm:02d}"
