"""Word forms that need more than column expressions: Porter stems and English plurals, as Arrow functions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

_VOWEL = regex.compile(r"[aeiou]|(?<=[^aeiou])y")


def _shape(stem: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return regex.sub(r"(.)\1*", r"\1", _shape(stem)).lstrip("c").count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short_end(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# The suffix tables of Porter's algorithm, steps 2 to 4.
STEP2 = (
    "ational ate", "tional tion", "enci ence", "anci ance", "izer ize", "abli able", "alli al", "entli ent", "eli e", "ousli ous",
    "ization ize", "ation ate", "ator ate", "alism al", "iveness ive", "fulness ful", "ousness ous", "aliti al", "iviti ive", "biliti ble",
)
STEP3 = ("icate ic", "ative ", "alize al", "iciti ic", "ical ic", "ful ", "ness ")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _by_table(w: str, table: tuple[str, ...]) -> str:
    for row in sorted(table, key=lambda r: -len(r.split(" ")[0])):
        end, new = row.split(" ")
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if _measure(stem) > 0 else w
    return w


@lru_cache(200_000)
def porter(word: str) -> str:
    """The stem of a lower-case English word."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _by_table(w, STEP2)
    w = _by_table(w, STEP3)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def plural(noun: str) -> str:
    """The regular English plural of a noun or noun phrase."""
    if regex.search(r"(s|x|z|ch|sh)$", noun):
        return noun + "es"
    if regex.search(r"[^aeiou]y$", noun):
        return noun[:-1] + "ies"
    return noun + "s"


def singular(noun: str) -> str:
    """The singular of a regular English plural; other words stay."""
    if regex.search(r"[^aeiou]ies$", noun):
        return noun[:-3] + "y"
    if regex.search(r"(s|x|z|ch|sh)es$", noun):
        return noun[:-2]
    return noun[:-1] if regex.search(r"[^su]s$", noun) else noun


@pandas_udf(ArrayType(StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Porter stems of arrays of lower-case words; null stays null (P-07)."""
    return tokens.map(lambda t: None if t is None else [porter(w) if w is not None else None for w in t])


@pandas_udf(StringType())
def plural_of(e: pd.Series) -> pd.Series:
    return e.map(lambda x: None if x is None else plural(x))


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's similarity of two strings, null if either is null (P-19)."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def token_budget(tokens: list[list[str]], budget: int) -> list[str]:
    """Tokens around a term's occurrences, within a budget (P-10).

    ``tokens`` are the stretches before, between and after the occurrences. The
    stretches take turns: the outer ones get one token, inner ones two, until
    the budget or the text is used up; the tokens nearest to an occurrence are kept.
    """
    if sum(map(len, tokens)) <= budget:
        return [t for part in tokens for t in part]
    last = len(tokens) - 1
    share = [0] * len(tokens)
    i = 0
    while budget > 0:
        want = min(1 if i in (0, last) else 2, len(tokens[i]) - share[i], budget)
        share[i] += want
        budget -= want
        i = (i + 1) % len(tokens)
    out: list[str] = []
    for i, (part, n) in enumerate(zip(tokens, share)):
        head = 0 if i == 0 else n if i == last else (n + 1) // 2
        out += part[:head]
        out += part[len(part) - (n - head) :] if n > head else []
    return out


def edit_cost(a: str, b: str, limit: int) -> int:
    """Cost of turning a into b (insertion 3, deletion 1, substitution 2), or ``limit`` if it isn't below."""
    last = [3 * j for j in range(len(b) + 1)]
    for x in a:
        row = [last[0] + 1]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 3, last[j - 1] + 2 * (x != y)))
        if min(row) >= limit:
            return limit
        last = row
    return min(last[-1], limit)


_PIECE = regex.compile(r"[^\s.,;:()]+")


def replace_nearly(text: str, expansion: str, token: str) -> str | None:
    """Replace the passage most like an expansion by a token; None if none is (P-16).

    An exact passage counts first. Otherwise runs of words, one more or fewer
    than the expansion's, of which at least half begin like words of the
    expansion, are compared by ``edit_cost``; the cheapest below the
    expansion's length is taken, of equals the first.
    """
    if not expansion.strip():
        return None
    m = regex.search(rf"(?<!\w){regex.escape(expansion)}(?!\w)", text, regex.I)
    if m:
        return text.replace(m.group(), token)
    low = expansion.lower()
    starts = {w[:3] for w in low.split()}
    n = len(low.split())
    spans = [(p.start(), p.end()) for p in _PIECE.finditer(text)]
    like = [text[a : a + 3].lower() in starts for a, _ in spans]
    best, found = len(low), None
    for size in (n, n - 1, n + 1):
        for i in range(len(spans) - size + 1) if size > 0 else ():
            if 2 * sum(like[i : i + size]) < n:
                continue
            passage = text[spans[i][0] : spans[i + size - 1][1]]
            cost = edit_cost(low, passage.lower(), best)
            if cost < best:
                best, found = cost, passage
    return text.replace(found, token) if found else None


@pandas_udf(StringType())
def replaced_nearly(text: pd.Series, expansion: pd.Series, token: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or e is None else replace_nearly(t, e, k or "") for t, e, k in zip(text, expansion, token)], dtype=object)


# The published rules of the Paice/Husk stemmer. A rule is an ending
# written backwards, * where the word must be whole, the number of letters to
# remove, letters to add, and . to stop or > to go on.
PAICE_HUSK = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. "
    "hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> "
    "lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. "
    "pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> "
    "tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> "
    "yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
).split()


def _paice_husk() -> dict[str, list[tuple[str, bool, int, str, bool]]]:
    import re

    table: dict[str, list] = {}
    for rule in PAICE_HUSK:
        ending, whole, cut, add, go = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([.>])", rule).groups()
        table.setdefault(ending[0], []).append((ending[::-1], bool(whole), int(cut), add, go == ">"))
    return table


_RULES_BY_LAST: dict = {}


def lancaster_stem(word: str) -> str:
    """The Paice/Husk stem of a word (P-09)."""
    if not _RULES_BY_LAST:
        _RULES_BY_LAST.update(_paice_husk())
    word = stem = word.lower()
    going = True
    while going and stem:
        going = False
        for ending, whole, cut, add, more in _RULES_BY_LAST.get(stem[-1], ()):
            if not stem.endswith(ending) or whole and stem != word:
                continue
            left = len(stem) - cut
            # A stem keeps two letters if it begins with a vowel, else three with a vowel or y among them.
            if stem[0] in "aeiouy" and stem[0] != "y":
                fits = left >= 2
            else:
                fits = left >= 3 and any(c in "aeiouy" for c in stem[1:left])
            if fits:
                stem, going = stem[:left] + add, more
                break
    return stem


def lancaster(words):
    """Stems of an array of words, a batch at a time, each distinct word once."""
    @pandas_udf("array<string>")
    def stems(s: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        return s.map(lambda ws: None if ws is None else [seen.get(w) or seen.setdefault(w, lancaster_stem(w)) for w in ws])

    return stems(words)
