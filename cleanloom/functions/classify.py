"""Text classifiers as column expressions: goal of an analysis and intent of a message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from cleanloom.functions.text import norm_name, strip

# ---------------------------------------------------------------------------
# Patterns are tried in this order on trimmed, lower-case text.
# ---------------------------------------------------------------------------
GOAL_TASKS = [
    ("classification", "classification model",
     r"\b(classif|churn|fraud|spam|predict .*(class|category|label)|binary|logistic|segment .*customers? into)\b"),
    ("regression", "regression model",
     r"\b(regress|forecast .*(price|value|amount|revenue|sales)|predict .*(price|value|amount|salary|revenue|score|cost)|estimate)\b"),
    ("timeseries", "time-series forecast", r"\b(time[- ]?series|forecast|seasonal|trend over time|arima|prophet)\b"),
    ("clustering", "clustering / segmentation", r"\b(cluster|segment|unsupervised|k-?means|cohort|group .*similar)\b"),
    ("nlp", "NLP / text model",
     r"\b(nlp|text (analysis|mining|classification)|sentiment|topic model|embedding|llm|language model)\b"),
    ("eda", "analysis / reporting", r"\b(dashboard|report|explor|visuali[sz]|bi\b|analytics|insight)\b"),
]
TARGET_PHRASE = r"(?:predict|forecast|estimate|target(?: is|:)?|label(?: is|:)?|classify)\s+(?:the\s+)?([\w .\-]{2,40})"
KEYWORD = r"[a-z]{4,}"
SUMMARY_UNKNOWN = ("Objective noted", ' — target column "', '"', ". I'll keep suggestions general-purpose.")
SUMMARY_KNOWN = ("Aligning to a ", ' with target "', '"', ".")

UNDO = r"\b(undo|revert|go back|take (that|it) back)\b"
RESET = r"\b(reset|start over|clear (the )?recipe|restore original)\b"
NO_DATA_HELP = r"(hi|hello|hey|help|start)"
COLUMN_VERB = r"(analy|profile|tell me about|column|check|inspect|look at|stats)"
INTENTS_BEFORE_COLUMN = [
    ("greeting", r"^(hi|hello|hey)\b"),
    ("auto_clean", r"(auto[- ]?clean|fix everything|clean (it|this|all|everything)|do it all|all at once)"),
    ("priorities", r"(what|which|where).*(fix|issue|problem|wrong|first)|suggest|recommend|prioriti[sz]|what should"),
]
INTENTS_AFTER_COLUMN = [
    ("nulls", r"null|missing|empty|blank|impute|imputation|nan"),
    ("duplicates", r"duplicat|dedup|dupe"),
    ("outliers", r"outlier|anomal|winsor|capping|\biqr\b"),
    ("knn", r"\bknn\b"),
    ("types", r"type|cast|convert|number|numeric|string"),
    ("text_hygiene", r"trim|whitespace|space|case|capital|lower|upper"),
    ("export", r"export|download|save|csv out"),
    ("undo_help", r"undo|reset|revert|start over"),
    ("help", r"help|what can you|how do you work|capab"),
]


def matches(text: Column, pattern: str) -> Column:
    """Regex search; word boundaries look at ASCII letters only."""
    return text.rlike(pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"))


def _clean(text: Column) -> Column:
    return F.lower(strip(text))


def goal_task(text: Column) -> Column:
    low, out = _clean(text), None
    for task, _, pattern in GOAL_TASKS:
        out = F.when(matches(low, pattern), task) if out is None else out.when(matches(low, pattern), task)
    return out.otherwise("unknown")


def goal_target(text: Column, columns: Sequence[str]) -> Column:
    """Column the goal is about: named after a verb of intent, else mentioned anywhere; longest name first."""
    names = [(c, "".join(ch for ch in c.lower() if ch.isascii() and ch.isalnum())) for c in columns]
    ranked = sorted([n for n in names if len(n[1]) > 2], key=lambda n: -len(n[1]))
    if not ranked:
        return F.lit(None).cast("string")
    low = _clean(text)
    catalog = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in ranked])
    spoken = F.when(low.rlike(TARGET_PHRASE), norm_name(F.regexp_extract(low, TARGET_PHRASE, 1)))
    explicit = F.get(F.filter(catalog, lambda x: F.contains(spoken, x["n"]) | F.contains(x["n"], spoken)), F.lit(0))
    mentioned = F.get(F.filter(catalog, lambda x: F.contains(norm_name(low), x["n"])), F.lit(0))
    return F.coalesce(explicit["c"], mentioned["c"])


def goal_keywords(text: Column, limit: int | None = None) -> Column:
    """Distinct keywords in order of occurrence, all or the first ``limit``."""
    found = F.array_distinct(F.regexp_extract_all(_clean(text), F.lit(KEYWORD), F.lit(0)))
    return found if limit is None else F.slice(found, 1, limit)


def goal_summary(task: Column, target: Column) -> Column:
    label = None
    for name, words, _ in GOAL_TASKS:
        label = F.when(task == name, words) if label is None else label.when(task == name, words)

    def sentence(parts, middle: Column) -> Column:
        named = F.coalesce(F.concat(F.lit(parts[1]), target, F.lit(parts[2])), F.lit(""))
        return F.concat(F.lit(parts[0]), middle, named, F.lit(parts[3]))

    return F.when(task == "unknown", sentence(SUMMARY_UNKNOWN, F.lit(""))).otherwise(sentence(SUMMARY_KNOWN, label))


def named_column(text: Column, columns: Sequence[str]) -> Column:
    """First column, in table order, whose normalised name occurs in the normalised text."""
    names = [(c, "".join(ch for ch in c.lower() if ch.isascii() and ch.isalnum())) for c in columns]
    usable = [F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in names if len(n) > 1]
    if not usable:
        return F.lit(None).cast("string")
    return F.get(F.filter(F.array(*usable), lambda x: F.contains(norm_name(text), x["n"])), F.lit(0))["c"]


def message_intent(message: Column, columns: Sequence[str] | None) -> Column:
    """Route of a message; ``columns=None`` means that no table is loaded."""
    low = _clean(message)
    if columns is None:
        return F.when(matches(low, NO_DATA_HELP), "no_data_help").otherwise("no_data")
    whole, column = F.lower(message), named_column(low, columns)
    out = F.when(matches(whole, UNDO), "undo").when(matches(whole, RESET), "reset")
    for intent, pattern in INTENTS_BEFORE_COLUMN:
        out = out.when(matches(low, pattern), intent)
    out = out.when(column.isNotNull() & matches(low, COLUMN_VERB), "column_analysis")
    for intent, pattern in INTENTS_AFTER_COLUMN:
        out = out.when(matches(low, pattern), intent)
    return out.when(column.isNotNull(), "column_mention").otherwise("fallback")
