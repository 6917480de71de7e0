"""Rule-based category, priority, gate and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark import rules as R
from deskspark import schemas
from deskspark.functions import text as X
from deskspark.settings import DEFAULTS, Settings


def keyword_class(
    subject: Column, body: Column, ladder: Sequence[R.LadderRule] = R.LADDER,
    fallback: R.LadderRule = R.LADDER_DEFAULT, whole_word: bool = False,
) -> Column:
    """Struct (category, priority, confidence, reasoning, first_hit) from the first rung that hits."""
    def verdict(rule: R.LadderRule, text: Column) -> Column:
        priority = F.lit(rule.priority)
        if rule.high_terms:
            priority = F.when(X.contains_any(text, rule.high_terms), F.lit("high")).otherwise(priority)
        first = X.first_term(text, rule.terms) if rule.terms else F.lit(None).cast("string")
        return F.struct(
            F.lit(rule.category).alias("category"), priority.alias("priority"),
            F.lit(rule.confidence).alias("confidence"), F.lit(rule.reasoning).alias("reasoning"),
            first.alias("first_hit"),
        )

    def climb(text: Column) -> Column:
        out = None
        for rule in ladder:
            hit = X.contains_any(text, rule.terms, whole_word)
            value = verdict(rule, text)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(verdict(fallback, text))

    blank = F.lit("")
    return X.let(F.lower(F.concat(F.coalesce(subject, blank), F.lit(" "), F.coalesce(body, blank))), climb)


def classify(mails: DataFrame, subject: str = "subject", body: str = "body", **rules) -> DataFrame:
    verdict = keyword_class(F.col(subject), F.col(body), **rules)
    return mails.withColumn("_class", verdict).select(*mails.columns, "_class.*")


def classify_with_model(mails: DataFrame, model_json: str, **rules) -> DataFrame:
    """Model verdict (JSON text column) where valid, keyword ladder elsewhere."""
    parsed = F.from_json(F.col(model_json), schemas.CLASSIFICATION)
    valid = (
        parsed["category"].isin(*R.CATEGORIES)
        & parsed["priority"].isin(*R.PRIORITIES)
        & parsed["confidence"].between(0.0, 1.0)
        & parsed["reasoning"].isNotNull()
    )
    ladder = keyword_class(F.col("subject"), F.col("body"), **rules)
    shaped = F.struct(*[ladder[f].alias(f) for f in schemas.names(schemas.CLASSIFICATION)])
    picked = F.when(F.coalesce(valid, F.lit(False)), parsed).otherwise(shaped)
    origin = F.when(F.coalesce(valid, F.lit(False)), F.lit("model")).otherwise(F.lit("rules"))
    return mails.withColumns({"_class": picked, "class_origin": origin}).select(
        *mails.columns, "_class.*", "class_origin"
    )


def passes_gate(category: Column, confidence: Column, settings: Settings = DEFAULTS) -> Column:
    return (category != "unrelated") & (confidence >= settings.min_confidence)


def process_gate(classified: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return classified.filter(passes_gate(F.col("category"), F.col("confidence"), settings))


def route(category: Column, confidence: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(category.isin(*R.FEEDBACK_CATEGORIES), F.lit("feedback"))
        .when(passes_gate(category, confidence, settings), F.lit("process"))
        .otherwise(F.lit("skip"))
    )


def needs_account(
    category: Column, body: Column, terms: Sequence[str] = R.ACCOUNT_TERMS, whole_word: bool = False
) -> Column:
    return (category == "billing") | X.holds_any(body, terms, whole_word)


def corpus_category(category: Column) -> Column:
    out = None
    for source, target in R.CORPUS_CATEGORY.items():
        cond = category == source
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return out.otherwise(category)


def has_escalation(reply: Column, terms: Sequence[str] = R.ESCALATION_TERMS) -> Column:
    return X.holds_any(F.coalesce(reply, F.lit("")), terms)
