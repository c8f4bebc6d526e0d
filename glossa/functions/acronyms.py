"""Acronym extractors: text column to array of acronyms, inside the JVM.

All work on word tokens, so that a letter with an accent never splits a word.
``v1`` of the inventory is ``v2`` followed by an anti join with a word list
(``without_words``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import ROMAN, words

# Hyphens and dashes at which a token is split further.
DASHES = r"-֊־᐀᠆‐-―⸗⸚⸺⸻⹀〜〰゠︱︲﹘﹣－/"

# Closed-class words that are no acronyms even in capitals.
CLOSED_CLASS = tuple(
    "a an the this that these those my your his her its our their some any each every no all both either neither "
    "about above across after against along among around at before behind below beside between beyond by down during except for from "
    "in inside into like near of off on onto out outside over past since through to toward under until up upon with within without "
    "and but or nor so yet if when while because although though as than whether".split()
)


def _matching(text: Column, pattern: str) -> Column:
    return F.filter(words(text), lambda w: w.rlike(pattern))


def upper_tokens(text: Column, least: int = 3, most: int = 8) -> Column:
    """Tokens of capitals, with an optional plural s, in order and with repeats (X-05)."""
    return _matching(text, rf"^[A-Z]{{{least},{most}}}s?$")


def v2(text: Column, least: int = 3) -> Column:
    """Distinct, upper-cased tokens of three to eight capitals (X-02; X-03 with ``least=2``)."""
    return F.array_distinct(F.transform(upper_tokens(text, least), F.upper))


def v3(text: Column) -> Column:
    """Tokens of two to eight letters or digits, at least half capitals (X-04); two-letter ones wholly capitals or digits."""
    def fits(w: Column) -> Column:
        bare = F.regexp_replace(w, "s$", "")
        capitals = F.length(F.regexp_replace(w, "[^A-Z]", ""))
        return F.when(F.length(bare) <= 2, bare.rlike("^[A-Z0-9]+$") & w.rlike("[A-Z]")).otherwise(capitals * 2 >= F.length(w))

    return F.array_distinct(F.transform(F.filter(_matching(text, r"^[A-Za-z0-9]{2,8}s?$"), fits), F.upper))


def singular(acronyms: Column) -> Column:
    """Without plural s, first occurrences kept in order (X-06)."""
    return F.array_distinct(F.transform(acronyms, lambda a: F.regexp_replace(a, "[sS]$", "")))


def spanish(text: Column) -> Column:
    """White-space tokens of which at least 60 % are capitals, Ch and Ll counting as one letter (X-08)."""
    bare = F.transform(F.split(text, r"[ \n\t]+"), lambda t: F.regexp_replace(F.regexp_replace(t, r"[.,;:()\[\]\"'¿?¡!]", ""), "Ch|Ll", "C"))

    def fits(t: Column) -> Column:
        return (F.length(t) > 1) & ~t.rlike("[ÁÉÍÓÚÑ]") & (F.length(F.regexp_replace(t, "[^A-Z]", "")) >= 0.6 * F.length(t))

    return F.array_distinct(F.filter(bare, fits))


def candidate_tokens(text: Column) -> Column:
    """All tokens a short form may be: split at white space and dashes, a letter within, not lower-case after the first (X-09)."""
    toks = F.transform(F.split(text, f"[\\s{DASHES}]+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}(]+|[^\p{L}\p{N})]+$", ""))
    return F.array_distinct(
        F.filter(toks, lambda t: (F.length(t) >= 2) & t.rlike(r"^[\p{L}\p{N}(]") & t.rlike(r"\p{L}") & ~t.rlike(r"^.[\p{Ll}\p{M}]+$"))
    )


def capital_tokens(text: Column) -> Column:
    """Tokens wholly in capitals that are valid acronyms (X-10, F-14)."""
    return F.array_distinct(F.filter(words(text), lambda w: (w == F.upper(w)) & (w != F.lower(w)) & valid_acronym(w)))


def short_forms(text: Column, ratio: float = 0.6) -> Column:
    """Tokens of 2 to 10 characters with more than ``ratio`` capitals, no Roman numerals (X-11, X-13)."""
    roman = F.array(*(F.lit(r) for r in ROMAN))
    return F.array_distinct(
        F.filter(
            words(text),
            lambda w: F.length(w).between(2, 10) & (F.length(F.regexp_replace(w, r"[^\p{Lu}]", "")) > ratio * F.length(w)) & ~F.array_contains(roman, w),
        )
    )


def french_candidates(text: Column) -> Column:
    """Tokens that are no number, numeral or elision and stand in capitals (X-12)."""
    roman = F.array(*(F.lit(r) for r in ROMAN))
    return F.array_distinct(
        F.filter(words(text), lambda w: ~w.rlike(r"^\p{N}+$") & ~F.array_contains(roman, w) & (F.length(w) > 1) & w.rlike(r"^[\p{Lu}\p{N}]+$"))
    )


def valid_acronym(c: Column) -> Column:
    """Two to ten letters and digits in at most two tokens, a letter among them, no closed-class word (F-14)."""
    n = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return (
        (F.length(c) >= 2) & (n <= 10) & c.rlike(r"\p{L}") & (F.size(F.split(F.trim(c), " +")) <= 2)
        & ~F.lower(c).isin(*CLOSED_CLASS)
    )


def embedded(text: Column) -> Column:
    """Neighbouring capital tokens joined by a hyphen in the text, as one acronym (X-14)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])([A-Z0-9]*[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+)(?![\p{L}\p{N}])"), F.lit(1)))


def exploded(docs: DataFrame, id_col: str, acronyms: Column, name: str = "acronym") -> DataFrame:
    """``(id_col, acronym)``; documents without acronyms and null texts give no row."""
    return docs.select(F.col(id_col), F.explode(acronyms).alias(name))


def without_words(found: DataFrame, lexicon: DataFrame, column: str = "acronym") -> DataFrame:
    """Drop acronyms that are words of a list in any case (X-01, F-08)."""
    listed = lexicon.select(F.upper(lexicon.columns[0]).alias("_w")).distinct()
    return found.join(listed, F.upper(column) == F.col("_w"), "left_anti")
