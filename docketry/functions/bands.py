"""Bands, labels and defaults that views of reports and disputes use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
SCORE_BANDS = ((750, "Excellent"), (700, "Good"), (650, "Fair"), (600, "Poor"))
SCORE_COLOURS = ((750, "#10b981"), (700, "#6366f1"), (650, "#f59e0b"))
STATUS_COLOURS = (
    (("current", "open"), "#10b981"),
    (("late", "past"), "#f59e0b"),
    (("charged", "collection", "derogatory"), "#ef4444"),
)
DASHBOARD_LABELS = {
    "pending_approval": "Needs Approval", "approved": "Approved", "submitted": "Submitted", "response_received": "Response In",
    "resolved": "Resolved", "escalated": "Escalated", "frivolous_flagged": "Flagged",
}
LIST_LABELS = {
    "pending_approval": "Pending Approval", "approved": "Approved", "submitted": "Submitted", "response_received": "Response Received",
    "resolved": "Resolved ✓", "escalated": "Escalated", "frivolous_flagged": "Flagged Frivolous",
}
# ---- end of fixed values ----


def score_band(score: Column) -> Column:
    out = F.when(F.coalesce(score, F.lit(0)) == 0, "N/A")
    for least, name in SCORE_BANDS:
        out = out.when(score >= least, name)
    return out.otherwise("Bad")


def score_colour(score: Column) -> Column:
    out = F
    for least, colour in SCORE_COLOURS:
        out = out.when(score >= least, colour)
    return out.otherwise("#ef4444")


def gauge_fill(score: Column) -> Column:
    """The filled part of a 300 to 850 gauge."""
    return F.least((score - 300) / F.lit(550.0), F.lit(1.0))


def priority_level(priority: Column) -> Column:
    """5 where no priority, or 0, is given."""
    return F.coalesce(F.nullif(priority, F.lit(0)), F.lit(5))


def priority_band(priority: Column) -> Column:
    level = priority_level(priority)
    return F.when(level >= 8, "high").when(level >= 5, "med").otherwise("low")


def priority_dots(priority: Column) -> Column:
    return F.round(priority_level(priority) / 2).cast("int")


def status_colour(status: Column) -> Column:
    low = F.lower(status)
    out = F.when(F.coalesce(status, F.lit("")) == "", "#64748b")
    for words, colour in STATUS_COLOURS:
        test = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            test = test | F.contains(low, F.lit(w))
        out = out.when(test, colour)
    return out.otherwise("#94a3b8")


def status_label(status: Column, labels: dict[str, str]) -> Column:
    """The label, or the raw status where there is none."""
    out = F
    for name, label in labels.items():
        out = out.when(status == name, label)
    return out.otherwise(status)


def plain_words(name: Column) -> Column:
    return F.translate(name, "_", " ")


def opening_bureau(bureau: Column) -> Column:
    """A dispute about a merged report goes to the first bureau."""
    return F.when(bureau == "tri_merge", "equifax").otherwise(bureau)
