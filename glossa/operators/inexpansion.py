"""In-expansion: acronyms and the expansions written beside them in a text.

Rules find candidate places with one regular expression and select the
expansion with another that is built from the acronym's letters, so a rule is a
pair (places, selection) and all rules share one Arrow stage. ``extract`` runs
several rules at once and returns ``doc_id, acronym, expansion, rule``;
``best_by_priority`` merges them, later rules overriding earlier ones.

The simplest rule, words whose initials spell the bracketed acronym, is also
given as column expressions (``initials_before``), inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.acronyms import CLOSED_CLASS
from glossa.runtime import spread

# How the digits of an acronym may be written in its expansion.
DIGIT_WORDS = (
    ("0", "zero"), ("1", "one", "first", "i", "mono", "uni"), ("2", "two", "second", "ii", "bi", "di", "double"),
    ("3", "three", "third", "iii", "tri", "triple"), ("4", "four", "fourth", "iv", "tetra"), ("5", "five", "fifth", "v", "penta"),
    ("6", "six", "sixth", "vi", "hexa"), ("7", "seven", "seventh", "vii", "hepta"), ("8", "eight", "eighth", "viii", "octa"), ("9", "nine", "ninth", "ix", "nona"),
)

_ALNUM = r"[\p{L}\p{N}]"
_PAREN = regex.compile(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)")
_DASH = regex.compile(r"(\S+)\s+-\s+|(\S+)\s*:\s+|(\S+?):(?=\S)")
_SENTENCE_START = regex.compile(r"(?:.*(?:[.;:!?](?=\s)|\n))?", regex.S)
_SENTENCE_END = regex.compile(r"[.;:!?](?=\s|$)|\n")


def valid(acronym: str) -> bool:
    """Two to ten letters and digits in one or two tokens, a letter among them, no closed-class word."""
    n = sum(c.isalnum() for c in acronym)
    return (
        len(acronym) >= 2 and n <= 10 and 1 <= len(acronym.split()) <= 2 and any(c.isalpha() for c in acronym) and acronym.lower() not in CLOSED_CLASS
    )


def within_bound(acronym: str, expansion: str) -> bool:
    """Not more words than twice the acronym's length, nor than its length and five."""
    n = len(acronym)
    return len(expansion.split()) <= min(n + 5, 2 * n)


@lru_cache(50_000)
def _pattern(acronym: str, backward: bool) -> regex.Pattern | None:
    parts = []
    for c in acronym:
        if c.isdigit():
            words = DIGIT_WORDS[int(c)] if c in "0123456789" else (c,)
            words = sorted((w[::-1] if backward else w for w in words), key=len, reverse=True)
            parts.append(rf"(?<!{_ALNUM})(?:{'|'.join(words)})(?!{_ALNUM})")
        elif c.isalpha():
            parts.append(regex.escape(c))
    if not parts:
        return None
    if backward:
        parts.reverse()
        parts[-1] += rf"(?!{_ALNUM})"
    else:
        parts[0] = rf"(?<!{_ALNUM})" + parts[0]
    return regex.compile(".*?".join(parts), regex.I | regex.S)


def select_before(acronym: str, text: str) -> str | None:
    """The expansion of an acronym that follows it: letters matched from the right, the first at the start of a word."""
    if _spelled_out(acronym, text):
        return None
    p = _pattern(acronym, True)
    m = p.search(text[::-1]) if p else None
    if not m:
        return None
    start, end = len(text) - m.end(), len(text) - m.start()
    while end < len(text) and not text[end].isspace():
        end += 1
    out = text[start:end].strip()
    return out if within_bound(acronym, out) else None


def select_after(acronym: str, text: str) -> str | None:
    """The expansion of an acronym that precedes it: letters matched from the left."""
    if _spelled_out(acronym, text):
        return None
    p = _pattern(acronym, False)
    m = p.search(text) if p else None
    if not m:
        return None
    start, end = m.start(), m.end()
    while end < len(text) and not text[end].isspace():
        end += 1
    out = text[start:end].strip()
    return out if within_bound(acronym, out) else None


def _spelled_out(acronym: str, text: str) -> bool:
    inside = set(regex.findall(_ALNUM + "+", text.lower()))
    own = regex.findall(_ALNUM + "+", acronym.lower())
    return bool(own) and all(t in inside for t in own)


def places(text: str) -> Iterator[tuple[str, str, bool]]:
    """(acronym, text beside it, whether the text stands before it) at brackets, dashes and colons."""
    for m in _PAREN.finditer(text):
        start = _SENTENCE_START.match(text[: m.start()]).end()
        yield from _ordered(m.group(1), text[start : m.start()], True)
    for m in _DASH.finditer(text):
        acronym = m.group(1) or m.group(2) or m.group(3)
        stop = _SENTENCE_END.search(text, m.end())
        yield from _ordered(acronym, text[m.end() : stop.start() if stop else len(text)], False)


def _ordered(acronym: str, beside: str, before: bool) -> Iterator[tuple[str, str, bool]]:
    acronym, beside = acronym.strip(" \"'«»“”"), beside.strip(" \"'«»“”,")
    if len(acronym) > len(beside) or len(acronym.split()) > 2:
        # The long form is in the brackets and the short form before them.
        words = beside.split()
        if before and words:
            yield words[-1], acronym, False
        return
    yield acronym, beside, before


def schwartz_hearst(text: str) -> dict[str, str]:
    """Bracketed short forms with the long form that spells them (E-01 to E-03)."""
    out: dict[str, str] = {}
    for m in regex.finditer(r"\(([^()]{2,80})\)", text):
        short = regex.split(r"[,;]\s", m.group(1), maxsplit=1)[0].strip()
        start = max(text.rfind(". ", 0, m.start()), text.rfind(", ", 0, m.start()), text.rfind("\n", 0, m.start() - 1))
        long = text[start + 1 : m.start()].strip(" ,.")
        if len(short.split()) > 2 or len(short) > len(long):
            words = text[: m.start()].split()
            short, long = (words[-1] if words else ""), m.group(1).strip()
            if not any(c.isupper() for c in short):
                continue
        if len(short) < 2 or not any(c.isalpha() for c in short) or not (short[0].isalnum() or short[0] == "("):
            continue
        p = _pattern(short, True)
        hit = p.search(long[::-1]) if p else None
        if not hit:
            continue
        best = long[long.rfind(" ", 0, len(long) - hit.end() + 1) + 1 :]
        n, size = sum(c.isalnum() for c in short), len(regex.split(r"[\s-]+", best))
        if len(best) >= len(short) and short + " " not in best and not best.endswith(short) and size <= min(2 * n, n + 5) and n <= 10:
            out[short] = best
    return out


def bounded(text: str) -> dict[str, str]:
    """Selection on both sides of brackets, dashes and colons (E-04 to E-06)."""
    out: dict[str, str] = {}
    for acronym, beside, before in places(text):
        if valid(acronym):
            found = (select_before if before else select_after)(acronym, beside)
            if found:
                out[acronym] = found
    return out


_WORD = regex.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")


def character_match(text: str) -> dict[str, str]:
    """Capitals of an acronym against the initials of the words around it (E-07, E-08c)."""
    toks = _WORD.findall(text)
    out: dict[str, str] = {}
    for i, t in enumerate(toks):
        upper = [c for c in t if c.isupper()]
        if not 2 <= len(t) <= 10 or len(upper) <= 0.6 * len(t):
            continue
        want = "".join(upper).lower()
        reach = min(len(want) + 5, 2 * len(want))
        for window in (toks[max(0, i - reach - 1) : i], toks[i + 1 : i + 2 + reach]):
            words = [w for w in window if w[0].isalnum()]
            for a in range(len(words) - len(want) + 1):
                run = words[a : a + len(want)]
                if "".join(w[0] for w in run).lower() == want and t not in run:
                    out.setdefault(t, " ".join(run))
    return out


def initial_capitals(text: str) -> dict[str, str]:
    """Runs of capitalised words, small words allowed between, that spell an acronym of the text (E-08d)."""
    toks = _WORD.findall(text)
    acronyms = {t for t in toks if 2 <= len(t) <= 10 and t.isupper()}
    out: dict[str, str] = {}
    for m in regex.finditer(r"\p{Lu}[\p{L}-]+(?:\s+(?:(?:of|and|for|the|de|la|des|du|y)\s+)*\p{Lu}[\p{L}-]+)+", text):
        letters = "".join(w[0] for w in m.group().split() if w[0].isupper())
        if letters in acronyms:
            out.setdefault(letters, m.group())
    return out


_STANDS = regex.compile(r"(?<![\w])([\p{Lu}\p{N}]{2,10}),?\s+(?:which\s+)?(?:stands\s+for|es\s+decir|means)\s+([^,.;()]+)")
_OR = regex.compile(r"([\p{L}][\p{L} -]+),\s+or\s+([\p{Lu}\p{N}]{2,10}),")


def template(text: str) -> dict[str, str]:
    """Phrases that name the expansion: "X, which stands for Y", "Y, or X," (E-08e)."""
    out = {}
    for m in _STANDS.finditer(text):
        words, want = m.group(2).split(), "".join(c for c in m.group(1) if c.isalpha()).lower()
        # Words whose initials spell the acronym end the expansion; else it goes to the next mark.
        spelled = next((n for n in range(len(want), len(words)) if _initials(words[:n], True) == want or _initials(words[:n], False) == want), len(words))
        out[m.group(1)] = " ".join(words[:spelled])
    for m in _OR.finditer(text):
        found = select_before(m.group(2), m.group(1))
        if found:
            out.setdefault(m.group(2), found)
    return out


def french(text: str) -> dict[str, str]:
    """French: both sides, function words skipped when spelling; of several the one with most valuable words, then the shortest (E-09, E-10)."""
    small = {"de", "du", "des", "la", "le", "les", "l", "d", "et", "à", "au", "aux", "en", "pour", "sur"}
    out: dict[str, str] = {}
    for acronym, beside, before in places(text):
        if not valid(acronym) or not acronym.isupper():
            continue
        want = [c for c in acronym.lower() if c.isalpha()]
        words = regex.findall(r"[\p{L}\p{M}\p{N}-]+['’]?", beside)
        options = []
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + 2 * len(want) + 2) + 1):
                value = [w for w in words[a:b] if w.lower().rstrip("'’") not in small]
                if len(value) == len(want) and [_plain(w[0]) for w in value] == want and words[a].lower() not in small and words[b - 1].lower() not in small:
                    options.append((-len(value), b - a, a, " ".join(words[a:b]).replace("' ", "'").replace("’ ", "’")))
        if options:
            out[acronym] = min(options)[3]
    return out


def spanish(text: str) -> dict[str, str]:
    """Spanish: short forms of at least 60 % capitals, Ch and Ll as one letter (E-11, E-21)."""
    out: dict[str, str] = {}
    for acronym, beside, before in places(text):
        short = acronym.replace("Ch", "C").replace("Ll", "L")
        if valid(short) and sum(c.isupper() for c in short) >= 0.6 * len(short):
            found = (select_before if before else select_after)(short, beside)
            if found:
                out[acronym] = found
    return out


def _plain(c: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFD", c.lower())[0]


# Small words that don't count among the initials of an expansion.
SMALL_WORDS = frozenset("a an and at by da de del des di du et for from in la las le les los of on or the to und von with y".split())


def short_forms(toks: list[str], share: float = 0.6, lower_first: bool = True, dots: bool = True) -> list[int]:
    """Places of the tokens of two to ten characters of which more than ``share`` are capitals."""
    out = []
    for i, t in enumerate(toks):
        bare = t.replace(".", "") if dots else t
        first = bare[:1].isupper() or lower_first and bare[:1].islower() or bare[:1].isdigit()
        if 2 <= len(bare) <= 10 and first and sum(c.isupper() for c in bare) > share * len(bare):
            out.append(i)
    return out


def _initials(words: list[str], small: bool) -> str:
    return "".join(w[0] for w in words if w[0].isalnum() and (small or w.lower() not in SMALL_WORDS)).lower()


def high_recall(text: str) -> dict[str, str]:
    """Short forms anywhere, without brackets: the nearest words on the left, else on the right, whose initials or capitals spell them (E-08b)."""
    toks = _WORD.findall(text)
    out: dict[str, str] = {}
    for i in short_forms(toks):
        want, reach = toks[i].replace(".", "").lower(), min(len(toks[i]) + 5, 2 * len(toks[i]))
        left, right = toks[max(0, i - reach - 1) : i], toks[i + 1 : i + 2 + reach]
        runs = [left[a:] for a in range(len(left) - 1, -1, -1)] + [right[b : c + 1] for c in range(len(right)) for b in range(c + 1)]
        for run in runs:
            while run and (not run[-1][0].isalnum() or run[-1].lower() in SMALL_WORDS):
                run = run[:-1]
            if not run or not run[0][0].isalnum() or not all(w[0].isalnum() for w in run) or run[0].lower() in SMALL_WORDS:
                continue
            capitals = "".join(w[0] for w in run if w[0].isupper()).lower()
            if len(run) > 1 and toks[i] not in run and want in (capitals, _initials(run, False)):
                out.setdefault(toks[i], " ".join(run))
                break
    return out


def high_recall_character(text: str) -> dict[str, str]:
    """Capitals of a short form against initials around it, small words passed over (E-08c); only for acronyms nothing else explains."""
    toks = _WORD.findall(text)
    out: dict[str, str] = {}
    for i in short_forms(toks):
        want = "".join(c for c in toks[i] if c.isupper()).lower()
        reach = min(len(want) + 5, 3 * len(want))
        for window in (toks[max(0, i - reach - 1) : i], toks[i + 1 : i + 2 + reach]):
            words = [w for w in window if w[0].isalnum()]
            for a in range(len(words)):
                for b in range(a + 2, len(words) + 1):
                    run = words[a:b]
                    ends = run[0].lower() not in SMALL_WORDS and run[-1].lower() not in SMALL_WORDS
                    if ends and toks[i] not in run and len(want) > 1 and _initials(run, False) == want:
                        out.setdefault(toks[i], " ".join(run))
    return out


def hyphenated(text: str) -> dict[str, str]:
    """Capitals joined by hyphens as one short form, spelled by the bracket beside it or that it stands in."""
    out: dict[str, str] = {}
    for acronym, beside, before in places(text):
        if regex.fullmatch(r"[\p{Lu}\p{N}]+(?:-[\p{Lu}\p{N}]+)+", acronym):
            found = (select_before if before else select_after)(acronym.replace("-", ""), beside)
            if found:
                out[acronym] = found
    return out


RULES = {
    "schwartz_hearst": schwartz_hearst, "bounded": bounded, "high_recall": high_recall, "character_match": character_match,
    "high_recall_character": high_recall_character, "initial_capitals": initial_capitals, "template": template, "hyphenated": hyphenated,
    "french": french, "spanish": spanish,
}
#: The cascade: a later rule overrides an earlier one for the same acronym (E-08).
CASCADE = ("schwartz_hearst", "bounded", "character_match", "initial_capitals", "template")

#: The switches of the cascade and their defaults: rules, then what is done with the candidates and the pairs.
SWITCHES = {
    "schwartz_hearst": True, "bounded": True, "high_recall": False, "character_match": True, "high_recall_character": False,
    "initial_capitals": True, "template": True, "hyphenated": False,
    "low_threshold": False, "starting_lower_case": True, "ignore_dots": True, "check_all_capitals": True, "small_window": True,
    "no_beginning_small_word": True, "left_only": False, "no_brackets": True, "trimmed_marks": True, "embedded": True, "roman": True,
    "without_punctuation": False, "unexpanded": False,
}
_ROMAN = regex.compile(r"(?=[IVXLC])(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})")


def cascade(text: str, **switches: bool) -> dict[str, str | None]:
    """Acronyms of a text with their expansions by the cascade of rules; null where one has none (E-08).

    Rules run in the order of ``SWITCHES`` and later ones override earlier ones,
    but for ``high_recall_character``, which only fills gaps. The candidate
    switches bound the capitals of a short form and the words of an expansion;
    ``embedded`` adds short forms that stand inside another's expansion,
    ``unexpanded`` all others; ``roman`` drops Roman numerals.
    """
    unknown = set(switches) - set(SWITCHES)
    if unknown:
        raise ValueError(f"no such switches: {', '.join(sorted(unknown))}")
    on = {**SWITCHES, **switches}
    pairs: dict[str, str | None] = {}
    for name in SWITCHES:
        if name in RULES and on[name]:
            found = RULES[name](text)
            pairs = {**found, **pairs} if name == "high_recall_character" else {**pairs, **found}
    toks = _WORD.findall(text)
    shorts = [toks[i] for i in short_forms(toks, 0.5 if on["low_threshold"] else 0.6, on["starting_lower_case"], on["ignore_dots"])]
    kept: dict[str, str | None] = {}
    for acronym, expansion in pairs.items():
        words = expansion.split()
        if on["no_brackets"]:
            words = regex.sub(r"[()\[\]]", " ", expansion).split()
        while on["no_beginning_small_word"] and len(words) > 1 and words[0].lower() in SMALL_WORDS and not acronym.lower().startswith(words[0][0].lower()):
            words = words[1:]
        expansion = " ".join(words)
        if on["trimmed_marks"]:
            expansion = expansion.strip(" ,;:.\"'“”-")
        n = sum(c.isalnum() for c in acronym)
        if not expansion or len(expansion.split()) > (min(n + 5, 2 * n) if on["small_window"] else min(n + 10, 3 * n)):
            continue
        if on["check_all_capitals"] and not any(c.isupper() for c in acronym):
            continue
        if on["left_only"] and 0 <= text.find(acronym) < text.find(expansion):
            continue
        kept[acronym] = expansion
    inside = " ".join(v for v in kept.values() if v)
    if on["embedded"]:
        kept |= {a: None for a in shorts if a not in kept and regex.search(r"(?<!\w)" + regex.escape(a) + r"(?!\w)", inside)}
    if on["unexpanded"]:
        kept |= {a: None for a in shorts if a not in kept}
    if on["roman"]:
        kept = {a: e for a, e in kept.items() if not _ROMAN.fullmatch(a)}
    if on["without_punctuation"]:
        kept = {regex.sub(r"[^\p{L}\p{N}]", "", a): e for a, e in kept.items()}
    return kept


def cascaded(docs: DataFrame, id_col: str, text_col: str, **switches: bool) -> DataFrame:
    """``id_col, acronym, expansion``: the cascade over all texts; null and empty texts give no row."""
    cascade("", **switches)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(i, a, e) for i, t in zip(pdf["i"], pdf["t"]) if t for a, e in cascade(t, **switches).items()]
            yield pd.DataFrame(rows, columns=[id_col, "acronym", "expansion"])

    return spread(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))).mapInPandas(run, f"{id_col} {id_type}, acronym string, expansion string")


def extract(docs: DataFrame, id_col: str, text_col: str, rules: tuple[str, ...] = ("schwartz_hearst",)) -> DataFrame:
    """``id_col, acronym, expansion, rule``; null and empty texts give no row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [
                (i, a, e, r) for i, t in zip(pdf["i"], pdf["t"]) if t for r in rules for a, e in RULES[r](t).items()
            ]
            yield pd.DataFrame(rows, columns=[id_col, "acronym", "expansion", "rule"])

    return spread(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))).mapInPandas(run, f"{id_col} {id_type}, acronym string, expansion string, rule string")


def best_by_priority(found: DataFrame, id_col: str, order: tuple[str, ...] = CASCADE) -> DataFrame:
    """One expansion per document and acronym: that of the latest rule of ``order``."""
    rank = F.array_position(F.array(*(F.lit(r) for r in order)), F.col("rule"))
    return found.groupBy(id_col, "acronym").agg(F.max_by("expansion", F.struct(rank, "expansion")).alias("expansion"))


def initials_before(text, most: int = 6):
    """Array of (acronym, expansion): bracketed capitals spelled by the initials of the words just before, in the JVM."""
    hits = F.regexp_extract_all(text, F.lit(rf"((?:[A-Za-z]+ ){{2,{most}}}\([A-Z]{{2,{most}}}\))"), F.lit(1))
    both = F.transform(hits, lambda h: F.struct(F.regexp_extract(h, r"\(([A-Z]+)\)", 1).alias("a"), F.split(F.trim(F.regexp_extract(h, r"^([^(]*)", 1)), " ").alias("w")))
    cut = F.transform(both, lambda x: F.struct(x["a"].alias("acronym"), F.when(F.size(x["w"]) >= F.length(x["a"]), F.slice(x["w"], F.size(x["w"]) - F.length(x["a"]) + 1, F.length(x["a"]))).otherwise(F.array().cast("array<string>")).alias("w")))
    fit = F.filter(cut, lambda x: F.upper(F.array_join(F.transform(x["w"], lambda w: F.left(w, F.lit(1))), "")) == x["acronym"])
    return F.transform(fit, lambda x: F.struct(x["acronym"].alias("acronym"), F.lower(F.array_join(x["w"], " ")).alias("expansion")))


def by_letters(text, acronym):
    """Expansion of a given acronym by a regular expression made from its letters: words of those initials before "(ACR)" (E-13)."""
    letters = F.filter(F.split(F.regexp_replace(acronym, r"[^A-Z0-9]", ""), ""), lambda c: c != "")
    words = F.array_join(F.transform(letters, lambda c: F.concat(F.lit(r"\b["), c, F.lower(c), F.lit(r"]\w*"))), r"[\s-]+")
    pattern = F.concat(F.lit("("), words, F.lit(r")\s*\(\Q"), acronym, F.lit(r"\E\)"))
    return F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(1)), F.lit(""))


# Between the letters of an acronym (of words of several letters; of any words; of parts of words), and
# what may stand between an expansion and the acronym.
LETTER_GAPS = {"strict": r"\w{3,}[-\s](?:\w{2,5}[-\s]){0,1}", "short": r"\w{2,}[-\s](?:\w{2,5}[-\s]){0,1}", "loose": r"\w+[-\s]{0,1}(?:\w{2,5}[-\s]{0,1}){0,1}", "parts": r"\w*[-.\s]*"}
BETWEEN = {
    "or": r"(?=\sor\s{0,1}(?:the\s){0,1}(?:a\s){0,1}@\b)", "bracket": r"(?=[\"(\s,]{2,}(?:or\s){0,1}(?:the\s){0,1}[\"]{0,1}@\b)",
    "dash": r"(?=[-\s]{2,}(?:of\s){0,1}@\b)", "after": r"(?<=\b@\s\W)",
}
LETTER_ORDERS = {"v1": (("strict", "loose"), ("or", "bracket", "after")), "v3": (("short", "loose"), ("or", "bracket", "dash", "after"))}


def expansion_in_text(text, acronym, version: str = "v1"):
    """The first text that spells an acronym beside one of its mentions, by patterns made of its letters (E-13).

    "v1" and "v3" try stricter letters first and in each the places "X or ACR",
    "X (ACR", for v3 "X - ACR", and "ACR (X"; "v2" takes parts of words, in any
    case, before or after the acronym. Null if there is none or a field is null.
    """
    letters = F.filter(F.split(F.regexp_replace(acronym, r"[^\p{L}\p{N}]", ""), ""), lambda c: c != "")
    quoted = F.concat(F.lit(r"\Q"), acronym, F.lit(r"\E"))
    first = lambda pattern: F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(1)), F.lit(""))
    either = lambda c: F.concat(F.lit("["), F.upper(c), F.lower(c), F.lit("]"))
    if version == "v2":
        spelled = F.concat(F.lit(r"\b"), F.array_join(F.transform(letters, either), LETTER_GAPS["parts"]), F.lit(r"\w*"))
        near = F.lit(r"""[-,"'(\s\w]{0,10}""")
        found = [first(F.concat(F.lit("(?im)("), spelled, F.lit(")"), near, quoted)), first(F.concat(F.lit("(?im)"), quoted, near, F.lit("("), spelled, F.lit(")")))]
        found = [F.when(F.upper(f) != F.upper(acronym), f) for f in found]
    else:
        gaps, places = LETTER_ORDERS[version]
        found = []
        for gap in gaps:
            spelled = F.concat(F.lit(r"(\b"), F.array_join(F.transform(letters, either), LETTER_GAPS[gap]), F.lit(r"\w+\b)"))
            for place in places:
                left, right = BETWEEN[place].split("@")
                beside = F.concat(F.lit(left), quoted, F.lit(right))
                found.append(first(F.concat(beside, spelled) if place == "after" else F.concat(spelled, beside)))
    return F.when(F.size(letters) > 1, F.coalesce(*found))
