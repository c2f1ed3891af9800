"""Text as Column expressions: words, keys, similarity, amounts, portion labels.

Nothing here is a Python UDF, so a projection over these stays in the JVM.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from itertools import chain

from pyspark.sql import Column, functions as F

from larder import fixed

# A double-quoted emoji part: marks, joiners and skin tones do not count.
_EMOJI_MARKS = r"[\p{Mn}\p{Me}\p{Cf}\x{1F3FB}-\x{1F3FF}]"
_ZWJ = "‍"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def words(c: Column) -> Column:
    """Runs of ASCII letters of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


@cache
def _plain_letters() -> tuple[str, str]:
    """(letters that decompose into another and marks, that other letter); marks follow at the end of the first.

    Hangul syllables decompose into letters, not marks, and stay.
    """
    accented, plain, marks = [], [], []
    for n in range(0x80, sys.maxunicode + 1):
        c = chr(n)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        parts = unicodedata.normalize("NFD", c)
        letters = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if len(letters) == 1 and letters != c and c.lower() == c:
            accented.append(c)
            plain.append(letters)
    return "".join(accented + marks), "".join(plain)


def fold(c: Column) -> Column:
    """Lower case without accents: letters give up their marks, marks that stand alone go."""
    accented, plain = _plain_letters()
    return F.translate(F.lower(c), accented, plain)


def index_tokens(c: Column) -> Column:
    """Letter and digit runs of the folded text: the search index's tokens."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# --- singular forms ---------------------------------------------------------
def _drop(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)


def singular_noun(w: Column) -> Column:
    """Singular of an identity word: irregular table, then suffix rules.

    Short words and words in -ss, -us, -is are left alone.
    """
    irregular = F.create_map(*[F.lit(x) for x in chain(*fixed.IRREGULAR_PLURALS.items())])
    n = F.length(w)
    return (
        F.when((n < 4) | w.rlike("(ss|us|is)$"), w)
        .when(~w.endswith("s") & ~w.isin("feet", "teeth", "geese", "mice", "women", "children", "oxen"), w)
        .when(irregular[w].isNotNull(), irregular[w])
        .when((n > 4) & w.endswith("ies"), F.concat(_drop(w, 3), F.lit("y")))
        .when(w.rlike("(ch|sh|x|z|ss|o)es$"), _drop(w, 2))
        .otherwise(_drop(w, 1))
    )


def singular_suffix(w: Column) -> Column:
    """The lighter rule used when comparing names: -es past four letters, else -s past three."""
    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("es"), _drop(w, 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), _drop(w, 1))
        .otherwise(w)
    )


# --- identity ----------------------------------------------------------------
def key_words(base_name: Column) -> Column:
    """Identity words in written order: no fat level, singular, no stop words."""
    plain = F.regexp_replace(F.lower(base_name), fixed.FAT_LEVEL_PATTERN, " ")
    found = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))
    return F.filter(F.transform(found, singular_noun), lambda w: ~w.isin(*fixed.KEY_STOPWORDS))


def key_of_words(ws: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(ws)), " ")


def identity_key(base_name: Column) -> Column:
    """Order-, case- and plural-free key of a food identity; '' when there is none."""
    return F.coalesce(key_of_words(key_words(base_name)), F.lit(""))


def name_tokens(c: Column) -> Column:
    """Tokens compared when matching two names."""
    found = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")
    return F.transform(found, singular_suffix)


def name_key(c: Column) -> Column:
    """Order-free, plural-insensitive name; unlike the identity key it keeps repeats."""
    found = F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")
    return F.array_join(F.array_sort(F.transform(found, singular_suffix)), " ")


def dice(a: Column, b: Column) -> Column:
    """Sørensen–Dice of two token arrays as sets; 0 when either is empty."""
    left, right = F.array_distinct(a), F.array_distinct(b)
    total = F.size(left) + F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        2.0 * F.size(F.array_intersect(left, right)) / total
    )


def slug(c: Column, longest: int = fixed.MAX_ID_CHARS) -> Column:
    """Lower ASCII letters and digits joined by single underscores, ``longest`` characters at most."""
    body = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.left(F.regexp_replace(body, "^_", ""), F.lit(longest)), "_+$", "")


# --- queries and grams ---------------------------------------------------------
def query_tokens(c: Column) -> Column:
    """Terms of a typed query, one per blank-separated part, repeats kept.

    A part with punctuation inside is a phrase: its words with a blank between them.
    """
    parts = F.transform(F.split(F.trim(c), r"\s+"), lambda p: F.array_join(index_tokens(p), " "))
    return F.filter(parts, lambda t: t != "")


def trigrams(c: Column) -> Column:
    """Distinct three-character grams without blank edges, in first-seen order."""
    low = F.lower(c)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))),
        lambda i: F.substring(low, i, F.lit(3)),
    )
    return F.array_distinct(F.filter(grams, lambda g: F.length(F.trim(g)) == 3))


def all_trigrams(c: Column) -> Column:
    """Every gram of a document, repeats kept: what the fuzzy index counts."""
    low = fold(c)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))),
        lambda i: F.substring(low, i, F.lit(3)),
    )
    return F.filter(grams, lambda g: F.length(g) == 3)


# --- emoji, keywords, tidy-ups ------------------------------------------------
def is_single_emoji(c: Column) -> Column:
    """One pictograph: each joiner-separated part is one non-ASCII character."""
    parts = F.transform(F.split(c, _ZWJ), lambda p: F.regexp_replace(p, _EMOJI_MARKS, ""))
    ok = F.forall(parts, lambda p: (F.length(p) == 1) & ~p.rlike(r"^[\x00-\x7F]$"))
    return F.coalesce((c != "") & ok, F.lit(False))


def leading_emoji(c: Column, most_bytes: int = fixed.MAX_EMOJI_BYTES) -> Column:
    """Characters before the first letter, digit or blank, cut once ``most_bytes`` are reached."""
    lead = F.trim(F.regexp_extract(F.trim(c), r"^[^\p{L}\p{Nd}\s]+", 0))
    chars = F.filter(F.split(lead, ""), lambda x: x != "")
    kept = F.filter(
        chars,
        lambda x, i: F.octet_length(F.array_join(F.slice(chars, F.lit(1), i), "")) < most_bytes,
    )
    # Nearly every answer is one short emoji; only a longer one is counted out.
    cut = F.when(F.octet_length(lead) <= most_bytes, lead).otherwise(F.array_join(kept, ""))
    return F.coalesce(cut, F.lit(""))


def clean_keywords(c: Column, longest: int = fixed.LONGEST_KEYWORD, most: int = fixed.MAX_KEYWORDS) -> Column:
    """Trimmed, lower-case, distinct; at most ``longest`` characters each and ``most`` in all."""
    tidy = F.transform(c, lambda k: F.lower(F.trim(k)))
    fit = F.filter(tidy, lambda k: (F.length(k) > 0) & (F.length(k) <= longest))
    return F.slice(F.array_distinct(fit), 1, most)


def tidy_identity(c: Column) -> Column:
    """Single blanks, no stray edge punctuation; NULL when nothing is left."""
    single = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.nullif(F.regexp_replace(single, r"^[ ,;]+|[ ,;]+$", ""), F.lit(""))


def strip_code_fence(c: Column) -> Column:
    """The inside of a fenced block, or the trimmed text when there is no fence."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    opened = F.when(t.contains("\n"), F.regexp_replace(t, r"(?s)^[^\n]*\n", "")).otherwise(
        F.regexp_replace(t, "^```", "")
    )
    closed = F.regexp_replace(opened, r"(?s)^(.*)```.*$", "$1")
    return F.when(t.startswith("```"), F.regexp_replace(closed, r"^\s+|\s+$", "")).otherwise(t)


def term_or_name(term: Column, name: Column) -> Column:
    return F.coalesce(blank_to_null(term), name)


def clipped_error(c: Column, longest: int = fixed.ERROR_TEXT_CHARS) -> Column:
    return F.left(c, F.lit(longest))


# --- display ---------------------------------------------------------------------
def shown_name(display_name: Column, description: Column) -> Column:
    return F.coalesce(display_name, description)


def prep_text(label: Column) -> Column:
    return F.coalesce(label, F.lit("plain"))


def composed_name(name: Column, label: Column, n_preps: Column) -> Column:
    """``name · label`` where there was a preparation to choose, else the name."""
    return F.when(n_preps > 1, F.concat_ws(" · ", name, prep_text(label))).otherwise(name)


def portion_label(measure_unit: Column, modifier: Column, description: Column) -> Column:
    """First usable of unit, modifier, and the description without its leading count of one."""
    return blank_to_null(F.coalesce(
        blank_to_null(measure_unit),
        blank_to_null(modifier),
        F.regexp_replace(F.trim(description), fixed.LEADING_ONE_PATTERN, ""),
    ))


def parse_amount(c: Column) -> Column:
    """``1 1/2`` is 1.5: blank-separated parts summed, unreadable parts count 0."""
    def part(p: Column) -> Column:
        number = F.coalesce(p.try_cast("double"), F.lit(0.0))
        top = F.coalesce(F.substring_index(p, "/", 1).try_cast("double"), F.lit(0.0))
        bottom = F.regexp_replace(p, "^[^/]*/", "").try_cast("double")
        return F.when(p.contains("/"), F.coalesce(F.try_divide(top, bottom), F.lit(0.0))).otherwise(number)

    return F.aggregate(F.split(F.trim(c), r"\s+"), F.lit(0.0), lambda total, p: total + part(p))


def format_amount(c: Column) -> Column:
    """``2`` for 2.0, ``0.5`` for 0.5."""
    return F.when(c == F.round(c), F.round(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def format_grams(c: Column) -> Column:
    return F.when(c >= 100, F.round(c).cast("bigint").cast("string")).otherwise(
        format_amount(F.round(c * 10) / 10)
    )
