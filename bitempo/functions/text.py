"""Text: names, sentences, nouns, predicates, overlap, question classes, source code names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------
#: First that matches names the predicate of a sentence; otherwise RELATED_TO.
PREDICATES = (
    (r"\bowns\b", "OWNS"),
    (r"\bprefers?\b", "PREFERS"),
    (r"\bworks (at|for)\b", "WORKS_AT"),
    (r"\bis (a )?part of\b", "PART_OF"),
    (r"\bdepends on\b", "DEPENDS_ON"),
    (r"\bcauses\b", "CAUSES"),
    (r"\breports to\b", "REPORTS_TO"),
)
NOT_NOUNS = ("the", "a", "an", "this", "that", "these", "those")
#: Words of a question that name nothing in source code.
NOT_NAMES = ("what", "who", "where", "which", "how", "the", "a", "an", "is", "are", "in", "on", "of", "for", "to", "from", "and", "or", "callers", "calls", "callees", "impact", "function", "class", "method", "module", "import")
QUESTION_RULES = {
    "VIBE": (r"\bsimilar to\b", r"\blike this\b", r"\breminds me\b", r"\bfind something\b", r"\brelated to\b", r"\bvibe of\b", r"\bkind of like\b", r"\bsomething like\b"),
    "FACT": (r"^who\b", r"^where\b", r"^which\b", r"^what is\b", r"^what's\b", r"\bowns\b", r"\bowned by\b", r"\bpart of\b", r"\breports to\b", r"\bdepends on\b", r"\bworks at\b"),
    "CHANGE": (
        r"\bwhen\b", r"\bsince\b", r"\bused to\b", r"\bpreviously\b", r"\bhistorically\b", r"\bin \d{4}\b", r"\bas of\b", r"\bsuperseded\b", r"\bdeprecated\b", r"\bever\b", r"\bbefore\b", r"\bafter\b",
        r"\bhistory of\b", r"\bcurrently\b", r"\bnow\b", r"\btoday\b", r"\bpresent\b", r"\bnowadays\b",
    ),
    "CODE": (
        r"\bfunction\b", r"\bclass\b", r"\bmethod\b", r"\bmodule\b", r"\bimport\b", r"\bcalls?\b", r"\bcallers?\b", r"\bcallees?\b", r"\bimpact( of)?\b", r"\bwho calls\b", r"\bdepends? on\b", r"\bsubclass(es)?\b",
        r"\binherits? from\b", r"\boverrides?\b", r"\bdefined in\b", r"\b\w+\.(py|ts|tsx|js|jsx|mjs|cjs|go|rs|java|cpp|h|hpp)\b", r"\bsince commit\b", r"\bsince v\d", r"\brefactor(ing)?\b",
    ),
}
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rs": "rust", "java": "java", "php": "php"}
TURN_CHARS = 8000
# ----------------------------------------------------------------------------------------------------------


def canonical(name: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def nouns(sentence: Column) -> Column:
    """Capitalised words of two characters or more, in order, with repeats."""
    words = F.regexp_extract_all(sentence, F.lit(r"([A-Za-z][A-Za-z0-9_-]*)"), 1)
    return F.filter(words, lambda w: w.rlike("^[A-Z].") & ~F.lower(w).isin(*NOT_NOUNS))


def predicate(sentence: Column) -> Column:
    out = F.lit("RELATED_TO")
    for pattern, name in reversed(PREDICATES):
        out = F.when(sentence.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def fingerprint(subject: Column, relation: Column, object_: Column) -> Column:
    return F.concat_ws("|", F.lower(subject), relation, F.lower(object_))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def overlap(query: Column, name: Column) -> Column:
    """Smoothed share of the question's words that a name has."""
    q = word_set(query)
    return (F.size(F.array_intersect(q, word_set(name))) + 1) / (F.size(q) + 1)


def rule_counts(query: Column, rules: Mapping[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """How many rules of each class match; ``rules`` (patterns by class) replace the given ones of their class."""
    return {k: sum((query.rlike(f"(?i){r}").cast("int") for r in of_class), F.lit(0)) for k, of_class in (QUESTION_RULES | dict(rules or {})).items()}


def question_class(counts: dict[str, Column]) -> Column:
    """VIBE, FACT, CHANGE, CODE or HYBRID from counts of matching rules."""
    vibe, fact, change, code = (counts[k] for k in ("VIBE", "FACT", "CHANGE", "CODE"))
    classes = sum(((c > 0).cast("int") for c in (vibe, fact, change, code)), F.lit(0))
    top = F.greatest(vibe, fact, change, code)
    return (
        F.when(classes == 0, "VIBE")
        .when((code > 0) & (change > 0), "HYBRID")
        .when((classes >= 2) & (code == 0), "HYBRID")
        .when(vibe == top, "VIBE")
        .when(fact == top, "FACT")
        .when(change == top, "CHANGE")
        .otherwise("CODE")
    )


def code_names(query: Column) -> Column:
    """Identifiers of a question, in order."""
    words = F.regexp_extract_all(query, F.lit(r"([A-Za-z_][A-Za-z0-9_]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*NOT_NAMES))


def language_of(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        out = F.when(ending == k, v).otherwise(out)
    return out


def module_name(path: Column, language: Column) -> Column:
    """Dotted name of a source file."""
    bare = F.regexp_replace(path, r"\.[A-Za-z]+$", "")
    drop = F.when(language == "python", F.array(F.lit("__init__"))).when(language.isin("typescript", "javascript"), F.array(F.lit("index"))).otherwise(F.array(F.lit("src"), F.lit("internal")))
    return F.array_join(F.filter(F.split(bare, r"[/\\]+"), lambda s: (s != "") & (s != ".") & ~F.array_contains(drop, s)), ".")


def visibility(name: Column, language: Column) -> Column:
    """By name alone: a leading underscore is private; in Go a capital is public."""
    go = F.when(name.rlike("^[A-Z]"), "public").otherwise("private")
    return F.when(language == "go", go).otherwise(F.when(name.startswith("_"), "private").otherwise("public"))


def like_pattern(text: str) -> str:
    """A literal for LIKE, with its wildcards escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
