"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents and the plain letters that stand for them.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuuncyy"

# English function words left out of bags of words.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can "
    "did do does doing don down during each few for from further had has have having he her here hers herself him himself his how "
    "i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out "
    "over own s same she should so some such t than that the their theirs them themselves then there these they this those through "
    "to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)

# Roman numerals from one to twenty.
ROMAN = tuple("I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split())

WORD = r"[\p{L}\p{N}_]+"


def fold_accents(c: Column) -> Column:
    """Lower case with the usual Latin accents removed (P-11)."""
    return F.translate(F.lower(c), ACCENTED, UNACCENTED)


def expansion_token(e: Column) -> Column:
    """An expansion as one token: other characters than word characters become single underscores (P-01)."""
    return F.regexp_replace(F.trim(F.regexp_replace(e, r"[^\p{L}\p{N}_]+", " ")), r" +", "_")


def singular_acronym(a: Column) -> Column:
    """Without a final s (P-02)."""
    return F.regexp_replace(a, r"s$", "")


def acronym_key(a: Column) -> Column:
    """Upper case, trimmed, without dots and the plural s; the key under which acronyms meet."""
    bare = F.regexp_replace(F.trim(a), r"\.", "")
    return F.upper(F.regexp_replace(bare, r"([A-Z0-9])s$", "$1"))


def expansion_key(e: Column) -> Column:
    """Lower case without accents, hyphens or repeated blanks."""
    return F.trim(F.regexp_replace(fold_accents(e), r"[-_ ]+", " "))


def words(text: Column) -> Column:
    """Word tokens in order, as they stand."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def content_words(text: Column) -> Column:
    """Lower-case words without digits-only tokens and function words (P-06, P-08)."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    low = F.transform(words(text), F.lower)
    return F.filter(low, lambda w: ~w.rlike(r"^\p{N}+$") & ~F.array_contains(stop, w))


def initials(e: Column) -> Column:
    """Upper-case first letters of the words."""
    return F.upper(F.array_join(F.transform(words(e), lambda w: F.left(w, F.lit(1))), ""))


def prefix_key(e: Column, n: int = 4) -> Column:
    """First letters of every word: expansions with equal keys start the same way."""
    return F.array_join(F.transform(F.split(expansion_key(e), " "), lambda w: F.left(w, F.lit(n))), " ")


def fuzzy_equal(a: Column, b: Column, edits: int = 2) -> Column:
    """Equality of expansions up to case, hyphens, word endings or two edits (P-18)."""
    x, y = expansion_key(a), expansion_key(b)
    return (x == y) | (prefix_key(a) == prefix_key(b)) | (F.levenshtein(x, y, edits) >= 0)


def distinct_choices(choices: Column) -> Column:
    """Whether the first and the last of sorted choices start differently (P-20)."""
    return prefix_key(F.element_at(choices, 1)) != prefix_key(F.element_at(choices, -1))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets; 0 if both are empty (P-21)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def word_ngrams(tokens: Column, n: int) -> Column:
    """n neighbouring tokens joined by blanks; empty for shorter arrays (P-22)."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def context(text: Column, term: Column, width: int) -> Column:
    """Up to ``width`` characters on each side of the term's first occurrence; null if it doesn't occur (P-24, E-20)."""
    at = F.instr(F.lower(text), F.lower(term))
    return F.when(at > 0, F.substring(text, F.greatest(at - width, F.lit(1)), F.least(at - 1, F.lit(width)) + F.length(term) + width))


def substitute(text: Column, term: Column, token: Column) -> Column:
    """Replace a whole term, or its plural in s, by a token, whatever the case (P-03, P-04)."""
    quoted = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), F.regexp_replace(term, r"\\E", ""), F.lit(r"\Es?(?![\p{L}\p{N}_])"))
    return F.regexp_replace(text, quoted, F.regexp_replace(token, r"([\\$])", r"\\$1"))


def substitute_pairs(text: Column, pairs: Column) -> Column:
    """Replace each (acronym, expansion) of an array, in order, by the expansion's token."""
    def step(t: Column, p: Column) -> Column:
        token = expansion_token(p["expansion"])
        return substitute(substitute(t, p["expansion"], token), p["acronym"], token)

    return F.aggregate(F.filter(pairs, lambda p: p["expansion"].isNotNull()), text, step)


def restore_acronym(text: Column, expansion: Column, acronym: Column) -> tuple[Column, Column]:
    """(text with the expansion's token replaced by the acronym, number of replacements) (P-05)."""
    token = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), expansion_token(expansion), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.regexp_replace(text, token, acronym), F.regexp_count(text, token)


def french_form(e: Column) -> Column:
    """Comparison form: no accents, hyphens as blanks, every word without one final s (P-28)."""
    return F.array_join(F.transform(F.split(expansion_key(e), " "), lambda w: F.regexp_replace(w, "s$", "")), " ")


def plain_html(html: Column) -> Column:
    """Text of well-formed markup: no scripts, styles, tags; the common entities decoded (P-14)."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def detokenise(tokens: Column) -> Column:
    """Tokens as running text: blanks before closing and after opening marks removed (E-19)."""
    t = F.array_join(tokens, " ")
    t = F.regexp_replace(t, r" ([.,;:!?)\]}%])", "$1")
    t = F.regexp_replace(t, r"([(\[{]) ", "$1")
    t = F.regexp_replace(t, r" ('s|n't|'re|'ve|'ll|'d|'m)\b", "$1")
    return F.regexp_replace(t, r'" ([^"]*?) "', '"$1"')


def normal_space(text: Column) -> Column:
    """Control characters and white space as single blanks (P-25)."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Cc}]+", " "))


# Abbreviations whose period ends no sentence.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Fig", "Sec", "No", "vol", "vs", "al", "etc", "approx", "e\\.g", "i\\.e")


def sentence_array(text: Column) -> Column:
    """Sentences by their closing marks, in the JVM (P-17); null stays null, blank texts have none.

    A mark ends a sentence before white space, in scripts without blanks
    everywhere; the period of an abbreviation and of a number doesn't.
    """
    dot, cut = "\u2024", "\u241e"
    t = F.regexp_replace(text, "(^|[^\\p{L}\\p{N}_])(" + "|".join(ABBREVIATIONS) + ")\\.", "$1$2" + dot)
    t = F.regexp_replace(t, "([.!?][\"”»’)\\]]*)[ \\t\\r\\n]+", "$1" + cut)
    t = F.regexp_replace(t, "([。！？।][\"”」』]*)", "$1" + cut)
    parts = F.transform(F.split(t, cut), lambda s: F.trim(F.replace(s, F.lit(dot), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


# The marks that cleaned words leave out.
CLEANED_MARKS = r"""[,;:.!?\-"'&()\\/`\[\]\x{AD}<>%+=]"""


def cleaned_words(text: Column, drop_numbers: bool = False) -> Column:
    """Lower-case words without marks and function words, in order (P-09); ``functions.inflect.lancaster`` gives their stems."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    low = F.transform(F.split(F.regexp_replace(text, CLEANED_MARKS, " "), r"[ \t\r\n]+"), F.lower)
    kept = F.filter(low, lambda w: (w != "") & ~F.array_contains(stop, w))
    return F.filter(kept, lambda w: ~w.rlike(r"^\p{N}+$")) if drop_numbers else kept


def lowered_words(text: Column, kept: Column | None = None) -> Column:
    """Tokens in lower case without function words; those in the array ``kept`` stay as they are (P-12)."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    toks = F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")
    if kept is None:
        return F.filter(F.transform(toks, F.lower), lambda w: ~F.array_contains(stop, w))
    own = lambda w: F.coalesce(F.array_contains(kept, w), F.lit(False))
    return F.transform(F.filter(toks, lambda w: own(w) | ~F.array_contains(stop, F.lower(w))), lambda w: F.when(own(w), w).otherwise(F.lower(w)))


def linked_text(text: Column, pairs: Column) -> Column:
    """Each (acronym, expansion) replaced by the expansion's token; an acronym without expansion is deleted (P-13)."""
    def step(t: Column, p: Column) -> Column:
        token = F.coalesce(expansion_token(p["expansion"]), F.lit(""))
        t = F.when(p["expansion"].isNull(), t).otherwise(substitute(t, F.coalesce(p["expansion"], F.lit("\u0000")), token))
        return substitute(t, p["acronym"], token)

    return F.aggregate(pairs, text, step)


def without_substring(text: Column, part: Column) -> tuple[Column, Column]:
    """(text without a substring, offsets in it of what was removed) (P-27); an empty substring removes nothing."""
    pieces = F.when(F.length(part) > 0, F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)).otherwise(F.array(text))
    ends = F.aggregate(pieces, F.array().cast("array<int>"), lambda a, p: F.array_append(a, F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + F.length(p)))
    return F.array_join(pieces, ""), F.slice(ends, 1, F.size(pieces) - 1)


def flat_strings(value) -> list[str] | str:
    """Values of nested lists and mappings as strings, in order (P-23)."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        value = value.values()
    elif not hasattr(value, "__iter__"):
        return str(value)
    out: list[str] = []
    for v in value:
        flat = flat_strings(v)
        out += [flat] if isinstance(flat, str) else flat
    return out
