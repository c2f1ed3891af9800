"""Rule-based reading of food descriptions: abbreviations, fat, brand, preparation, naming."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from larder import fixed
from larder.functions import text

Rule = tuple[str, str, str, bool]


def _java(pattern: str, any_case: bool) -> str:
    """The pattern with Unicode word classes, and case folding where asked."""
    return ("(?iU)" if any_case else "(?U)") + pattern


def expansion_steps(c: Column, rules: Sequence[Rule] = fixed.ABBREVIATION_RULES) -> list[Column]:
    """The text before each rule, then the final text with single blanks."""
    steps = [c]
    for _, pattern, replacement, any_case in rules:
        steps.append(F.regexp_replace(steps[-1], _java(pattern, any_case), replacement))
    steps[-1] = F.trim(F.regexp_replace(steps[-1], r"(?U)\s+", " "))
    return steps


def expand_abbreviations(c: Column, rules: Sequence[Rule] = fixed.ABBREVIATION_RULES) -> Column:
    """The text with every rule applied; one search decides whether any of them is needed."""
    some = "|".join(f"(?{'i' if any_case else ''}U:{pattern})" for _, pattern, _, any_case in rules)
    plain = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(c.rlike(some), expansion_steps(c, rules)[-1]).otherwise(plain)


def substitutions(c: Column, rules: Sequence[Rule] = fixed.ABBREVIATION_RULES) -> Column:
    """Array of (rule, old_text, new_text), one element per replaced fragment."""
    def logged(name: str, replacement: str):
        return lambda hit: F.struct(
            F.lit(f"abbrev:{name}").alias("rule"), hit.alias("old_text"),
            F.lit(replacement.strip()).alias("new_text"))

    found = []
    for before, (name, pattern, replacement, any_case) in zip(expansion_steps(c, rules), rules):
        hits = F.regexp_extract_all(before, F.lit(_java(pattern, any_case)), F.lit(0))
        found.append(F.transform(hits, logged(name, replacement)))
    return F.concat(*found)


def lost_tokens(before: Column, after: Column) -> Column:
    """Protected words of the first text that the second no longer holds."""
    keep = F.array(*[F.lit(t) for t in fixed.PRESERVE_TOKENS])
    held = F.array_intersect(F.array_distinct(text.words(before)), keep)
    return F.array_sort(F.array_except(held, text.words(after)))


def guarded(before: Column, after: Column) -> Column:
    """The expanded text, failing the job if a protected word vanished."""
    lost = lost_tokens(before, after)
    return F.when(F.size(lost) > 0, F.raise_error(F.concat(
        F.lit("protected words lost: "), F.array_join(lost, ", "), F.lit(" in "), before
    )).cast("string")).otherwise(after)


def fat_percentage(c: Column) -> Column:
    """Stated milk fat, else fat, else the complement of lean; NULL when not stated."""
    def stated(suffix: str) -> Column:
        return F.regexp_extract(c, rf"(?i)(\d+(?:\.\d+)?)\s*%\s*{suffix}", 1).try_cast("double")

    return F.coalesce(
        stated(r"(?:milk\s*fat|milkfat)"), stated(r"fat\b"), F.round(100.0 - stated(r"lean\b"), 2)
    )


def has_brand_token(c: Column, tokens: Sequence[str] = fixed.BRAND_TOKENS) -> Column:
    any_token = "|".join(re.escape(t.strip()) for t in tokens)
    return c.rlike(rf"(?iU)(?<!\w)(?:{any_token})(?!\w)")


def has_shouted_word(c: Column, known: Sequence[str] = fixed.ALLCAPS_WHITELIST) -> Column:
    shouted = F.regexp_extract_all(c, F.lit(r"[A-Z][A-Z'\.]{2,}"), F.lit(0))
    bare = F.transform(shouted, lambda w: F.regexp_replace(w, r"^[.']+|[.']+$", ""))
    return F.exists(bare, lambda w: (F.length(w) >= 3) & ~w.isin(*known))


def is_branded(description: Column, data_type: Column, tokens: Sequence[str] = fixed.BRAND_TOKENS,
               known: Sequence[str] = fixed.ALLCAPS_WHITELIST,
               checked_type: str = "sr_legacy_food") -> Column:
    """Only the one release type names brands inside its descriptions."""
    return (data_type == checked_type) & (
        has_brand_token(description, tokens) | has_shouted_word(description, known)
    )


def is_meat_or_dairy(category: Column) -> Column:
    """Category gate for a varying fat content."""
    return F.coalesce(F.lower(category).rlike("|".join(fixed.MEAT_DAIRY_KEYWORDS)), F.lit(False))


def is_penalised(display_name: Column, description: Column) -> Column:
    joined = F.lower(F.concat_ws(" ", F.coalesce(display_name, F.lit("")), description))
    return F.array_contains(
        F.array(*[joined.contains(term) for term in fixed.PENALTY_TERMS]), True
    )


def parent_label(label: Column) -> Column:
    """The widest label that still covers this one."""
    return F.when(label.isin(*fixed.COOKED_METHODS), F.lit("cooked")).otherwise(label)


def corrected_label(prep: Column, description: Column, base_name: Column, kind: Column) -> Column:
    """Sharpen a vague "cooked", and read "raw" off an ingredient that states it.

    Words of the food's own identity are not evidence; a specific label stands.
    """
    stated = F.array_except(
        F.coalesce(text.words(description), F.array().cast("array<string>")),
        F.coalesce(text.words(base_name), F.array().cast("array<string>")),
    )
    named = F.filter(stated, lambda w: w.isin(*fixed.COOKED_METHODS))
    says_raw = F.exists(stated, lambda w: w.isin(*fixed.RAW_WORDS))
    from_raw = F.coalesce(F.lower(description).contains("from raw"), F.lit(False))
    return (
        F.when((prep == "cooked") & (F.size(named) == 1), F.get(named, F.lit(0)))
        .when(prep.isNull() & (kind == "ingredient") & ~from_raw & says_raw, F.lit("raw"))
        .otherwise(prep)
    )


def naming_issues(display_name: Column, emoji: Column, base_name: Column) -> Column:
    """Array of defects of a suggested name, empty when it passes."""
    name_words = F.array_distinct(text.words(display_name))
    base_words = F.coalesce(
        F.array_distinct(text.words(base_name)), F.array().cast("array<string>")
    )
    added = F.array_sort(F.array_except(
        F.filter(name_words, lambda w: w.isin(*fixed.NAME_PREP_WORDS)), base_words
    ))
    dropped = (F.coalesce(base_name, F.lit("")) != "") & (F.size(name_words) < F.size(base_words))
    return F.array_compact(F.array(
        F.when(emoji.isNotNull() & ~text.is_single_emoji(emoji),
               F.concat(F.lit("not one emoji: "), emoji)),
        F.when(F.size(added) > 0,
               F.concat(F.lit("preparation words added: "), F.array_join(added, " "))),
        F.when(dropped, F.concat(F.lit("qualifiers dropped from: "), base_name)),
    ))


def route(confidence: Column, brand_flagged: Column, failed: Column) -> Column:
    """Brand or failed checks always go to a person; otherwise the threshold decides."""
    return (
        F.when(failed | brand_flagged, F.lit("needs_review"))
        .when(confidence >= fixed.HIGH_THRESHOLD, F.lit("auto_approved"))
        .otherwise(F.lit("needs_review"))
    )
