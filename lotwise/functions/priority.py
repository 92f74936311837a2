"""Attention priority of a dealer from its ``current_segmentation`` label.

The status is the first of the critical, high and medium lists that has a
member occurring as a *substring* of the label (otherwise Low); the score is
the position of the first such member in the status's own list, or the list
length when nothing matches.  Because matching is by substring, list order
changes results (for example ``Inactive - Frequent (New)`` is Critical 7).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: status labels and case lists, in the dashboard's order ----
CRITICAL = "🔴 Critical Priority"
HIGH = "🟠 High Priority"
MEDIUM = "🟡 Medium Priority"
LOW = "⚪ Low Priority"

CRITICAL_CASES = (
    "Active - Active (At Risk)",
    "Active - Frequent (At Risk)",
    "Frequent - Frequent (At Risk)",
    "Frequent - No Purchase",
    "Frequent - Active (At Risk)",
    "Inactive - Active (At Risk)",
    "Inactive - Frequent (At Risk)",
    "Inactive - Frequent",
    "No Purchase - Active (At Risk)",
    "No Purchase - 1 Time Purchaser",
    "No Purchase - Frequent (At Risk)",
)
HIGH_CASES = (
    "Active - No Purchase",
    "Active - Frequent",
    "Active - Inactive",
    "Frequent - Active",
    "Frequent - Inactive",
    "Frequent - 1 Time Purchaser",
    "Inactive - Active",
    "No Purchase - Active",
    "No Purchase - Frequent",
)
MEDIUM_CASES = (
    "Active - 1 Time Purchaser",
    "Active - Active",
    "Active - Frequent (New)",
    "Active - Active (New)",
    "Frequent - Frequent",
    "Frequent - Active (New)",
    "Frequent - Frequent (New)",
    "Inactive - Active (New)",
    "Inactive - Frequent (New)",
    "Inactive - Inactive",
    "Inactive - No Purchase",
    "Inactive - 1 Time Purchaser",
    "No Purchase - Active (New)",
    "No Purchase - Frequent (New)",
)
LOW_CASES = (
    "1 Time Purchaser - No Purchase",
    "No Purchase - Inactive",
    "No Purchase - No Purchase",
)
# -----------------------------------------------------------------------------

STATUS_ORDER = (CRITICAL, HIGH, MEDIUM, LOW)
CASES = {CRITICAL: CRITICAL_CASES, HIGH: HIGH_CASES, MEDIUM: MEDIUM_CASES, LOW: LOW_CASES}


def first_substring_index(label: Column, cases) -> Column:
    """0-based index of the first case contained in ``label``, else NULL."""
    return F.coalesce(*[F.when(label.contains(F.lit(case)), F.lit(i))
                        for i, case in enumerate(cases)])


def priority_columns(label: Column | str) -> dict[str, Column]:
    """``status``, ``priority_score`` and ``priority_rank`` (0 = Critical)."""
    label = F.col(label) if isinstance(label, str) else label
    idx = {status: first_substring_index(label, cases) for status, cases in CASES.items()}
    status = F.lit(LOW)
    rank = F.lit(3)
    for i, s in reversed(list(enumerate(STATUS_ORDER[:3]))):
        status = F.when(idx[s].isNotNull(), F.lit(s)).otherwise(status)
        rank = F.when(idx[s].isNotNull(), F.lit(i)).otherwise(rank)
    score = F.coalesce(idx[LOW], F.lit(len(LOW_CASES)))
    for s in reversed(STATUS_ORDER[:3]):
        score = F.when(idx[s].isNotNull(), idx[s]).otherwise(score)
    # Critical is tested first, then High, then Medium; the loops above build
    # the chain from the inside out so the outermost test is Critical.
    return {"status": status, "priority_score": score, "priority_rank": rank}
