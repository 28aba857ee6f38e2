"""What follows from a response: status, strategy and letter type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the tables of statuses and strategies ----
STATUS_AFTER = {
    "removed": "resolved", "updated": "response_received", "verified": "response_received", "denied": "response_received",
    "no_response": "escalated", "frivolous": "frivolous_flagged",
}
STRATEGY_AFTER = {
    "removed": "monitor", "no_response": "deletion_demand", "updated": "verify_update_and_escalate_if_incomplete", "denied": "new_angle_attack",
}
VERIFIED_STRATEGY = {1: "section_609_method_of_verification", 2: "furnisher_direct_dispute"}
LETTER_DESCRIPTIONS = {
    "metro2_compliance": "Metro 2 Format Compliance Dispute — cites specific CDIA Metro 2 field violations",
    "section_609": "Section 609 Method of Verification Request — demands original documentation",
    "section_611": "Section 611 Reinvestigation Demand — demands re-investigation after failed verification",
    "fcra_violation": "FCRA Violation Notice — cites specific statutory violations with damages warning",
    "furnisher_direct": "Furnisher Direct Dispute — sent directly to data furnisher under § 1681s-2",
}
BUREAU_ADDRESSES = {
    "equifax": "Equifax Information Services LLC\nP.O. Box 740256\nAtlanta, GA 30374-0256",
    "experian": "Experian\nP.O. Box 4500\nAllen, TX 75013",
    "transunion": "TransUnion LLC\nConsumer Dispute Center\nP.O. Box 2000\nChester, PA 19016",
}
# ---- end of fixed values ----


def _chosen(key: Column, table: dict, default: Column | str | None) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def status_after(response: Column) -> Column:
    return _chosen(response, STATUS_AFTER, "response_received")


def round_after(response: Column, current: Column) -> Column:
    """The next round, unless the item went or the dispute was called frivolous."""
    return F.when(response.isin("removed", "frivolous"), current).otherwise(current + 1)


def outcome_after(response: Column) -> Column:
    return F.when(response.isin("removed", "verified", "denied"), response)


def next_strategy(response: Column, current: Column) -> Column:
    """By the response and the round in which it came."""
    verified = _chosen(current, VERIFIED_STRATEGY, "legal_escalation")
    return F.when(response == "verified", verified).otherwise(_chosen(response, STRATEGY_AFTER, "review_required"))


def action_required(response: Column) -> Column:
    return ~response.eqNullSafe("removed")


def urgent(response: Column) -> Column:
    return response.eqNullSafe("no_response")


def letter_type(violation_types: Column, primary: Column, primary_given: Column, current: Column) -> Column:
    """The letter of a round, from the types of the violations found and the analysis' primary strategy.

    ``primary_given`` says whether the analysis names a strategy at all: a missing one counts as
    factual_dispute, an empty or null one as section_609.
    """
    strategy = F.when(primary_given, F.coalesce(primary, F.lit(""))).otherwise("factual_dispute")
    has = lambda kind: F.coalesce(F.array_contains(violation_types, kind), F.lit(False))
    opening = F.when(has("metro2"), "metro2_compliance").when(has("fcra"), "fcra_violation").when(strategy == "", "section_609").otherwise(strategy)
    second = F.when(strategy == "factual_dispute", "section_609").when(strategy == "section_609", "section_611").otherwise("fcra_violation")
    return F.when(current == 1, opening).when(current == 2, second).otherwise("fcra_violation")


def letter_description(kind: Column) -> Column:
    return _chosen(kind, LETTER_DESCRIPTIONS, None)


def bureau_address(bureau: Column) -> Column:
    return _chosen(F.lower(bureau), BUREAU_ADDRESSES, F.concat(F.initcap(bureau), F.lit(" Credit Bureau")))
