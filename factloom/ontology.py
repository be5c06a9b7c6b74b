"""Closed vocabulary: relation registry, status transitions, synonym tables and rubrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Predicate, source types, target types, cardinality.
RELATIONS = (
    ("PARTICIPATES_IN", ("Person",), ("Event",), "m:n"),
    ("MEMBER_OF", ("Person",), ("Organization",), "m:n"),
    ("OWNS", ("Person", "Organization"), ("Project",), "m:n"),
    ("CONTAINS", ("Project",), ("Task",), "1:n"),
    ("ASSIGNED_TO", ("Task",), ("Person",), "m:1"),
    ("PRECEDES", ("Event",), ("Event",), "m:n"),
    ("SUPPORTS", ("Claim",), ("Claim", "Decision"), "m:n"),
    ("CONTRADICTS", ("Claim", "Assertion"), ("Claim", "Assertion"), "m:n"),
    ("EVIDENCE_FOR", ("Document", "Event"), ("Claim", "Decision", "Assertion"), "m:n"),
    ("RESULTS_IN", ("Event", "Decision"), ("Event", "Task", "Project"), "m:n"),
    ("ABOUT", ("Document", "Claim"), ("Person", "Project", "Task", "Event", "Decision"), "m:n"),
    ("POSSIBLY_SAME_AS", ("Person", "Organization", "Project", "Task", "Event"), ("Person", "Organization", "Project", "Task", "Event"), "m:n"),
    ("SUPERSEDES", ("Assertion",), ("Assertion",), "m:n"),
    ("HAS_STATUS", ("Person", "Organization", "Project", "Task", "Claim", "Decision"), ("StatusValue",), "m:1"),
    ("HAS_VALUE", ("Slot",), ("SlotValue",), "m:1"),
)
PREDICATES = tuple(r[0] for r in RELATIONS)
SINGLE_VALUED = tuple(r[0] for r in RELATIONS if r[3] in ("m:1", "1:1"))

# Allowed task status changes.
TRANSITIONS = (
    ("todo", "in_progress"), ("todo", "blocked"), ("todo", "cancelled"),
    ("in_progress", "blocked"), ("in_progress", "done"), ("in_progress", "cancelled"),
    ("blocked", "in_progress"), ("blocked", "cancelled"),
)
STATUSES = ("accepted", "quarantined", "superseded", "rejected", "unknown")

# Status words and their canonical value, for each type.
STATUS_WORDS = {
    "Task": {
        "todo": "todo", "to do": "todo", "to-do": "todo", "not started": "todo", "backlog": "todo", "pending": "todo", "open": "todo", "new": "todo",
        "in progress": "in_progress", "in-progress": "in_progress", "inprogress": "in_progress", "ongoing": "in_progress", "started": "in_progress",
        "active": "in_progress", "wip": "in_progress", "doing": "in_progress", "blocked": "blocked", "stuck": "blocked", "on hold": "blocked",
        "waiting": "blocked", "done": "done", "complete": "done", "completed": "done", "finished": "done", "closed": "done", "resolved": "done",
        "cancelled": "cancelled", "canceled": "cancelled", "abandoned": "cancelled", "dropped": "cancelled", "unknown": "unknown",
    },
    "Project": {
        "active": "active", "in progress": "active", "ongoing": "active", "started": "active", "inactive": "inactive", "paused": "inactive",
        "on hold": "inactive", "completed": "completed", "complete": "completed", "done": "completed", "finished": "completed",
        "cancelled": "cancelled", "canceled": "cancelled", "abandoned": "cancelled", "unknown": "unknown",
    },
    "Person": {
        "active": "active", "current": "active", "employed": "active", "inactive": "inactive", "departed": "inactive", "left": "inactive",
        "former": "inactive", "terminated": "inactive", "unknown": "unknown",
    },
    "Organization": {
        "active": "active", "operating": "active", "inactive": "inactive", "defunct": "inactive", "dissolved": "inactive", "closed": "inactive",
        "unknown": "unknown",
    },
    "Decision": {
        "draft": "draft", "proposed": "draft", "pending": "draft", "final": "final", "finalized": "final", "approved": "final", "accepted": "final",
        "confirmed": "final", "superseded": "superseded", "replaced": "superseded", "rejected": "rejected", "declined": "rejected",
        "unknown": "unknown",
    },
}
# Priority words and their canonical value.
PRIORITY_WORDS = {
    "low": "low", "low priority": "low", "minor": "low", "p3": "low", "p4": "low", "medium": "medium", "med": "medium", "medium priority": "medium",
    "normal": "medium", "moderate": "medium", "default": "medium", "p2": "medium", "high": "high", "high priority": "high", "important": "high",
    "major": "high", "p1": "high", "urgent": "urgent", "urgent priority": "urgent", "critical": "urgent", "highest": "urgent", "blocker": "urgent",
    "p0": "urgent", "unknown": "unknown",
}
# Phrases and the predicate they stand for.
PREDICATE_WORDS = {
    "owns": "OWNS", "own": "OWNS", "owner of": "OWNS", "is owner of": "OWNS", "assigned to": "ASSIGNED_TO", "assigned": "ASSIGNED_TO",
    "assignee": "ASSIGNED_TO", "is assigned to": "ASSIGNED_TO", "results in": "RESULTS_IN", "result in": "RESULTS_IN", "leads to": "RESULTS_IN",
    "causes": "RESULTS_IN", "produces": "RESULTS_IN", "precedes": "PRECEDES", "comes before": "PRECEDES", "before": "PRECEDES",
    "happens before": "PRECEDES", "contradicts": "CONTRADICTS", "conflicts with": "CONTRADICTS", "contradict": "CONTRADICTS",
    "participates in": "PARTICIPATES_IN", "participated in": "PARTICIPATES_IN", "takes part in": "PARTICIPATES_IN", "member of": "MEMBER_OF",
    "belongs to": "MEMBER_OF", "is member of": "MEMBER_OF", "contains": "CONTAINS", "has task": "CONTAINS", "includes": "CONTAINS",
    "supports": "SUPPORTS", "support": "SUPPORTS", "backs": "SUPPORTS", "evidence for": "EVIDENCE_FOR", "is evidence for": "EVIDENCE_FOR",
    "evidences": "EVIDENCE_FOR", "about": "ABOUT", "regarding": "ABOUT", "concerns": "ABOUT", "relates to": "ABOUT",
    "possibly same as": "POSSIBLY_SAME_AS", "same as": "POSSIBLY_SAME_AS", "maybe same as": "POSSIBLY_SAME_AS", "supersedes": "SUPERSEDES",
    "replaces": "SUPERSEDES", "overrides": "SUPERSEDES",
}
# Patterns of a quarantine's reason, in order, and the cause each names.
QUARANTINE_CAUSES = (
    ("entity_alias_resolution", "alias|possibly_same_as|identity|same entity|unresolved entit"),
    ("evidence_provenance", "is 'done' but has no completion event"),
    ("evidence_provenance", "evidence|supporting|unsupported|provenance"),
    ("genuine_ambiguity", "single-valued conflict"),
    ("temporal_cardinality", "transition .* is not permitted"),
    ("temporal_cardinality", "timestamp|temporal|valid_from|valid_to|interval|precedes|cycle"),
    ("temporal_cardinality", "cardinality|domain|range"),
    ("genuine_ambiguity", "cannot overwrite an accepted status|status contradiction|contradiction|conflict"),
)
# Attribute words and the slot they stand for.
SLOT_WORDS = {
    "company": "current_employer", "current_company": "current_employer", "current_employer": "current_employer", "employer": "current_employer",
    "organization": "current_employer", "workplace": "current_employer", "job": "current_job", "occupation": "current_job",
    "profession": "current_job", "role": "current_job", "title": "current_job", "city": "current_residence", "current_city": "current_residence",
    "home": "current_residence", "home_city": "current_residence", "where_i_live": "current_residence", "where_the_user_lives": "current_residence",
    "residence": "current_residence", "current_residence": "current_residence", "address": "current_residence", "hometown": "hometown",
    "advisor": "advisor", "academic_advisor": "advisor", "phd_advisor": "advisor", "supervisor": "advisor", "school": "school",
    "university": "school", "college": "school", "degree": "degree_program", "degree_program": "degree_program", "program": "degree_program",
    "diet": "dietary_restriction", "dietary_restriction": "dietary_restriction", "food_restriction": "dietary_restriction",
    "allergy": "dietary_restriction", "favorite_food": "favorite_food", "favourite_food": "favorite_food", "favorite_meal": "favorite_food",
    "favorite_color": "favorite_color", "favourite_color": "favorite_color", "cat_name": "pet_name", "dog_name": "pet_name", "pet": "pet_name",
    "pet_name": "pet_name", "partner": "partner_name", "partner_name": "partner_name", "spouse": "partner_name", "email": "email_address",
    "email_address": "email_address", "phone": "phone_number", "phone_number": "phone_number", "frequent_flyer": "frequent_flyer_number",
    "frequent_flyer_number": "frequent_flyer_number",
}
# Confidence words.
CONFIDENCE_WORDS = {
    "certain": 1.0, "definite": 1.0, "very high": 0.95, "high": 0.9, "likely": 0.8, "probable": 0.75, "medium": 0.6, "moderate": 0.6,
    "possible": 0.5, "unknown": 0.5, "low": 0.3, "unlikely": 0.2, "very low": 0.1, "none": 0.0,
}
# Authority of a source by the scheme of its reference.
AUTHORITY = {
    "system-of-record": 0.98, "analyst": 0.95, "verified": 0.92, "tool": 0.75, "document": 0.70,
    "observation": 0.50, "inferred": 0.35, "unverified": 0.25, "untrusted": 0.10, "poisoned": 0.05,
}
DEFAULT_AUTHORITY, BLANK_AUTHORITY, AUTHORITATIVE = 0.55, 0.0, 0.90
# Consequence of a wrong assertion by predicate.
CONSEQUENCE = {
    "OWNS": 0.80, "MEMBER_OF": 0.55, "ASSIGNED_TO": 0.60, "HAS_STATUS": 0.65, "HAS_VALUE": 0.45, "PRECEDES": 0.50, "RESULTS_IN": 0.55,
    "EVIDENCE_FOR": 0.35, "SUPPORTS": 0.30, "CONTRADICTS": 0.40, "ABOUT": 0.20, "CONTAINS": 0.30, "PARTICIPATES_IN": 0.35,
    "POSSIBLY_SAME_AS": 0.50, "SUPERSEDES": 0.60,
}
DEFAULT_CONSEQUENCE = 0.60
# Reversibility by what a write would retire.
REVERSIBLE, CREATE_ONLY, MULTI_RETIRE, IRREVERSIBLE = 0.90, 0.70, 0.35, 0.15


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, list(s), list(t), c) for p, s, t, c in RELATIONS], "predicate string, source_types array<string>, target_types array<string>, cardinality string")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSITIONS), "old string, new string")


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
