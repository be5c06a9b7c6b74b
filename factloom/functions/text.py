"""String functions over columns; all run inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ontology as o


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_name(x) -> Column:
    """Lower-case, punctuation to blanks, white space collapsed; null is empty."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def compact(x) -> Column:
    return F.regexp_replace(normalize_name(x), r"[^a-z0-9]", "")


def name_tokens(x) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_name(x), " "), lambda t: t != ""))


def alpha_number(x) -> Column:
    """(prefix, number) of labels such as T01, else null."""
    c = compact(x)
    at = r"^([a-z]+)0*([0-9]+)"
    return F.when(c.rlike(at), F.concat_ws("#", F.regexp_extract(c, at, 1), F.regexp_extract(c, at, 2)))


def canonical_name(x) -> Column:
    """Collapse blanks; a token in capitals (over one letter) or mixed case stays, others get a capital first."""
    s = F.trim(F.regexp_replace(_c(x), r"\s+", " "))
    keep = lambda t: ((t == F.upper(t)) & (F.length(t) > 1) & (t != F.lower(t))) | F.substring(t, 2, 1 << 20).rlike("[A-Z]")
    cap = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 20)))
    return F.array_join(F.transform(F.split(s, " "), lambda t: F.when(keep(t), t).otherwise(cap(t))), " ")


def key_form(x) -> Column:
    """Lower-case with white space collapsed, for synonym look-ups."""
    return F.lower(F.trim(F.regexp_replace(_c(x), r"\s+", " ")))


def status_canon(x, entity_type) -> Column:
    key = key_form(x)
    task = F.element_at(o.literal_map(o.STATUS_WORDS["Task"]), key)
    own = F.lit(None).cast("string")
    for t, words in o.STATUS_WORDS.items():
        own = F.when(_c(entity_type) == t, F.element_at(o.literal_map(words), key)).otherwise(own)
    return F.coalesce(own, task, _c(x))


def priority_canon(x) -> Column:
    table = o.literal_map(o.PRIORITY_WORDS)
    key = key_form(x)
    return F.coalesce(F.element_at(table, key), F.when(key.endswith(" priority"), F.element_at(table, F.trim(F.regexp_replace(key, " priority$", "")))), _c(x))


def predicate_canon(x) -> Column:
    raw = F.trim(_c(x))
    upper = F.regexp_replace(F.upper(raw), "[ -]", "_")
    known = F.when(upper.isin(*o.PREDICATES), upper)
    return F.when(_c(x).isNull() | (raw == ""), _c(x)).otherwise(F.coalesce(known, F.element_at(o.literal_map(o.PREDICATE_WORDS), key_form(x)), upper))


def confidence_parse(x) -> Column:
    """Numbers, percentages and words to [0, 1]; null where nothing fits."""
    raw = F.trim(_c(x))
    plain = raw.try_cast("double")
    percent = F.when(raw.endswith("%"), F.trim(F.regexp_replace(raw, "%$", "")).try_cast("double") / 100)
    return F.coalesce(F.element_at(o.literal_map(o.CONFIDENCE_WORDS), F.lower(raw)), clamp(percent), clamp(plain))


def clamp(x) -> Column:
    return F.when(_c(x) < 0, 0.0).when(_c(x) > 1, 1.0).otherwise(_c(x))


def nullish_to_null(x) -> Column:
    # Strings that stand for no value.
    return F.when(~F.lower(F.trim(_c(x))).isin("", "null", "none", "n/a", "na", "nil", "undefined"), _c(x))


def source_scheme(x) -> Column:
    return F.when(_c(x).contains(":"), F.lower(F.trim(F.substring_index(_c(x), ":", 1)))).otherwise("")


def marker(x) -> Column:
    return F.regexp_extract(_c(x), r"\[\[(.+?)\]\]", 1)


def name_variants(x) -> Column:
    n = normalize_name(x)
    return F.array_distinct(F.array(n, F.regexp_replace(n, "^(project|task|person|organization|event|decision|document|claim) ", "")))


def token_count(x) -> Column:
    return F.size(F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"\s+"), lambda t: t != "")).cast("long")


def sentences(x) -> Column:
    return F.filter(F.transform(F.split(_c(x), r"[.\n;!?]+"), F.trim), lambda s: s != "")


def stable_id(kind, *parts) -> Column:
    """Three letters of the kind and twelve hex digits of the content's SHA-1."""
    return F.concat(F.lower(F.left(_c(kind), F.lit(3))), F.lit("_"), F.left(F.sha1(F.concat_ws("|", *[_c(p) for p in parts])), F.lit(12)))


# Question families in order of precedence; the first that matches names the type.
QUERY_TYPES = (
    ("provenance", (
        r"\bsource(?:s|d)?\b", r"\bwhere did .* come from\b", r"\bwhere (?:did|does|do) (?:this|it|that|these|those)\b", r"\bevidence (?:for|of)?\b",
        r"\bhow do we know\b", r"\bhow do you know\b", r"\bprovenance\b", r"\bciteation?\b", r"\bcite\b",
    )),
    ("contradiction", (
        r"\bconflict(?:s|ing)?\b", r"\bcontradict(?:s|ion|ory|ed)?\b", r"\bdiscrepanc(?:y|ies)\b", r"\bdisagree(?:s|ment)?\b",
        r"\binconsisten(?:t|cy|cies)\b", r"\bis it true (?:that)?\b",
    )),
    ("planning", (
        r"\bnext steps?\b", r"\bwhat(?:'s| is) next\b", r"\bplan(?:s|ning|ned)?\b", r"\bwhat should\b", r"\btasks? (?:for|in|of|under|remaining)\b",
        r"\bto-?do(?:s)?\b", r"\bremaining work\b", r"\bbacklog\b",
    )),
    ("temporal", (
        r"\bbefore\b", r"\bafter\b", r"\bprecede(?:s|d)?\b", r"\border of\b", r"\bwhen (?:did|does|do|was|were|is)\b", r"\btimeline\b",
        r"\bwhat happened\b", r"\b\d{4}-\d{2}-\d{2}\b",
    )),
    ("direct_fact", (
        r"\bwho owns\b", r"\bwho is (?:the )?owner\b", r"\bwho is assigned\b", r"\bwho(?:'s| is) responsible\b",
        r"\bwhat is the (?:current )?status of\b", r"\bwhat(?:'s| is) the status of\b", r"\bwho is\b",
    )),
)
# Words that hint at a predicate.
PREDICATE_HINTS = (
    ("OWNS", (r"\bown(?:s|ed|er|ership|ing)?\b",)),
    ("ASSIGNED_TO", (r"\bassign(?:ed|s|ee|ment)?\b", r"\bresponsible for\b")),
    ("PRECEDES", (r"\bbefore\b", r"\bafter\b", r"\bprecede(?:s|d)?\b", r"\border of\b")),
    ("CONTAINS", (r"\bcontain(?:s|ed)?\b", r"\btasks? (?:for|in|of|under)\b")),
    ("CONTRADICTS", (r"\bcontradict(?:s|ion|ory|ed)?\b", r"\bconflict(?:s|ing)?\b", r"\bdisagree(?:s|ment)?\b")),
    ("EVIDENCE_FOR", (r"\bevidence (?:for|of)\b",)),
    ("SUPPORTS", (r"\bsupport(?:s|ed|ing)?\b",)),
)
# Words that are no mention by themselves, types of entities, words a question opens with.
STOP_WORDS = (
    "who", "what", "when", "where", "why", "how", "which", "is", "are", "was", "were", "the", "a", "an", "of", "to", "for", "do", "does", "did",
    "this", "that", "it", "tell", "me", "about", "there",
)
TYPE_PREFIXES = ("Project", "Task", "Event", "Document")
TYPE_WORDS = ("project", "task", "event", "document", "decision", "organization", "org", "person")
QUESTION_LEADERS = (
    "who", "what", "when", "where", "why", "how", "which", "whom", "whose", "is", "are", "was", "were", "do", "does", "did", "can", "could",
    "should", "would", "will", "has", "have", "had", "tell", "show", "list", "find", "give", "describe", "summarize", "explain", "search",
)


def any_of(patterns) -> str:
    return "(?i)" + "|".join(patterns)


def query_type(x) -> Column:
    out = F.lit("open_ended")
    for name, pattern in reversed(QUERY_TYPES):
        out = F.when(_c(x).rlike(any_of(pattern)), name).otherwise(out)
    return out


def predicate_hints(x) -> Column:
    return F.array_compact(F.array(*[F.when(_c(x).rlike(any_of(p)), F.lit(n)) for n, p in PREDICATE_HINTS]))


def mentions(x) -> Column:
    """Quoted spans, identifiers and capitalised spans without stop words at their ends, case-insensitively distinct in that order."""
    span = r"""["']([^"']+)["']"""
    quoted = F.transform(F.regexp_extract_all(_c(x), F.lit(span), 1), F.trim)
    rest = F.regexp_replace(_c(x), span, " ")
    ids = F.regexp_extract_all(rest, F.lit(r"\b[A-Z]+-?\d+\b"), 0)
    caps = F.regexp_extract_all(rest, F.lit(r"(?U)\b[A-Z][\w-]*(?:\s+[A-Z][\w-]*)*\b"), 0)
    stop = "|".join(STOP_WORDS)
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, rf"(?i)^(?:(?:{stop})(?:\s+|$))+", ""), rf"(?i)(?:(?:^|\s+)(?:{stop}))+$", "")
    caps = F.transform(caps, lambda t: F.regexp_replace(bare(t), r"\s+", " "))
    caps = F.filter(caps, lambda t: ~t.isin("", *TYPE_PREFIXES))
    every = F.filter(F.concat(quoted, ids, caps), lambda t: t != "")
    # Named by a lambda, as what a lambda only quotes is found again for each element.
    once = lambda e: F.filter(e, lambda t, i: F.array_position(F.transform(e, F.lower), F.lower(t)) == i + 1)
    return F.transform(F.array(every), once)[0]


def label_variants(x) -> Column:
    """A mention's forms to look up: itself, and without a type word in front."""
    n = key_form(x)
    return F.array_distinct(F.array(n, F.regexp_replace(n, rf"^(?:{'|'.join(TYPE_WORDS)}) (?=.)", "")))


def is_question(x) -> Column:
    """Blank, ending in a question mark, or opening with a question's or a command's word."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^\s+|\s+$", "")
    first = F.lower(F.regexp_replace(F.regexp_extract(s, r"^\S+", 0), r"""^[.,!:;"']+|[.,!:;"']+$""", ""))
    return (s == "") | s.endswith("?") | first.isin(*QUESTION_LEADERS)


def slot_name(x) -> Column:
    """Snake-case attribute, mapped to the slot that its word stands for."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.element_at(o.literal_map(o.SLOT_WORDS), n), n)


def tokens_match(expected, answer) -> Column:
    """Whether every expected token is in the answer, whatever the case; with none expected, whether there is an answer."""
    text = F.lower(F.coalesce(_c(answer), F.lit("")))
    return F.when(F.size(F.coalesce(_c(expected), F.array().cast("array<string>"))) > 0, F.forall(F.filter(_c(expected), lambda t: t != ""), lambda t: F.contains(text, F.lower(t)))).otherwise(F.trim(text) != "")


# Ways to write a task's name so that it is not recognised.
EVASIONS = ("novel_alias", "spelling_variant", "spacing_variant", "partial", "adaptive_alias", "role_description", "unrelated_alias")


def evasive_surface(name, axis, i, salt=None) -> Column:
    """A task's name in disguise along an axis; with a salt the variants of the second round."""
    n, at = _c(name), _c(i)
    digits, letters = F.regexp_replace(n, "[^0-9]", ""), F.regexp_replace(n, "[^A-Za-z]", "")
    digits = F.when(digits == "", (at + 1).cast("string")).otherwise(digits)
    letters = F.when(letters == "", "T").otherwise(letters)
    text = lambda v: v.cast("string")
    if salt is None:
        forms = (
            F.concat(n, F.lit("Proxy"), text(at)), F.concat(letters, F.lit("0"), digits), F.when(F.length(n) < 2, F.concat(n, F.lit("_alias"))).otherwise(F.concat(F.left(n, F.lit(1)), F.lit("_"), F.substring(n, 2, 1 << 20))),
            F.concat(n, F.lit("Alias"), text(at)), F.concat(F.lit("Aster"), text(at + 4000)), F.concat(F.lit("LeadOn"), letters, digits), F.concat(F.lit("QX"), text(at + 9000)),
        )
    else:
        v = text(_c(salt))
        forms = (
            F.concat(F.lit("Aster"), v), F.concat(letters, F.lit("00"), digits), F.concat(letters, F.lit("_"), digits, F.lit("_alt"), v), F.concat(n, F.lit("Ref"), v), F.concat(F.lit("Cobalt"), v),
            F.concat(F.lit("OwnerOf"), letters, digits, F.lit("Draco"), v), F.concat(F.lit("Zed"), v),
        )
    out = F.lit(None).cast("string")
    for a, f in zip(EVASIONS, forms):
        out = F.when(_c(axis) == a, f).otherwise(out)
    return out


def memory_action(x) -> Column:
    """insert, update or skip from the JSON object in a reply; insert where there is none."""
    from .udfs import lenient_json

    a = F.lower(F.trim(F.get_json_object(lenient_json(_c(x)), "$.action")))
    return F.when(a.isin("insert", "update", "skip"), a).otherwise("insert")
