"""Sentence and word rules, boundary marks and character n-grams.

The rules approximate a punctuation-based sentence splitter followed by a
Penn-Treebank-style word splitter, keeping only letters of each token. They
use no look-around so the same patterns run in Java regex and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning patterns (Java and RE2 syntax alike).
WS_CLASS = (
    "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)
WS = f"[{WS_CLASS}]"
SENTENCE_MARK = "\u0001"
SENTENCE_END = "([.!?]+[\"')\\]]*)" + WS + "+"
CLAUSE_PUNCT = "([:,])([^0-9])"
DROP_PUNCT = "\\.\\.\\.|--|[;@#$%&?!()\\[\\]{}<>\"“”„«»]"
NEG_CONTRACTION = "(?i)(n't)([^\\p{L}\\p{Nd}_]|$)"
CONTRACTION = "(?i)('(?:s|m|d|ll|re|ve))([^\\p{L}\\p{Nd}_]|$)"
NON_LETTER_OR_WS = f"[^\\p{{L}}{WS_CLASS}]"
BLANK = f"^{WS}*$"
BOUNDARY = "*"

# A full stop that ends no sentence is shown as this mark while sentences are
# split; it is no letter, so it leaves with the other marks.
STOP_MARK = "\u0002"
#: Abbreviations after which a sentence goes on, by language.
ABBREVIATIONS = {
    "de": "Abb Abs Abt Art Aufl Bd Bsp Dr Fr Hr Hrsg Ing Inh Jh Kap Lt Nr Pfr Prof Sr St Str Tel Univ bspw bzgl bzw ca eigtl evtl exkl ggf inkl insb max min sog vgl zzgl",
    "en": "Capt Col Dept Dr Fig Gen Gov Hon Jr Lt Mr Mrs Ms Mt No Prof Rep Rev Sen Sgt Sr St Univ approx cf vs",
    "fr": "Dr Me MM Mgr Mlle Mme Mmes Mr Pr St Ste art av boul cf chap env fig vol",
    "es": "Av Da Dr Dra Exc Gral Ing Lic Prof Sr Sra Sres Srta Sta Sto Ud Uds aprox art cap fig pág vol",
}
LANGUAGE_CODES = {"german": "de", "english": "en", "french": "fr", "spanish": "es"}
# Two short parts with stops, such as initials; the second may be of two letters ("p. ej.").
# They stand on one line.
INITIALS = f"(^|{WS}|[(\"'„“«])(\\p{{L}})\\.([ \\x{{A0}}\\x{{2009}}\\x{{202F}}]*)(\\p{{L}}|e[jx])\\."


# The same for Java alone, several times as fast: a place is looked at only if it begins with
# what a match needs, and then behind. A match ends with a stop, which none begins after.
_BEFORE = f"(?<![^{WS_CLASS}(\"'„“«])"
_INITIALS = f"(?=\\p{{L}}\\.){_BEFORE}(\\p{{L}})\\.([ \\x{{A0}}\\x{{2009}}\\x{{202F}}]*)(\\p{{L}}|e[jx])\\."
_OTHER_SPACE = f"[{WS_CLASS.replace(' ', '')}]"


def _abbreviations(code: str) -> str:
    words = ABBREVIATIONS[code].split()
    return f"(?=[{''.join(sorted({w[0] for w in words}))}]){_BEFORE}({'|'.join(words)})\\."


def abbreviation_pattern(code: str) -> str:
    return f"(^|{WS}|[(\"'„“«])({'|'.join(ABBREVIATIONS[code].split())})\\."


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mark_stops(text, lang=None) -> Column:
    """``text`` with ``STOP_MARK`` for the stops of initials and of its language's abbreviations.

    ``lang`` is a language name or code, as a column; for any other one only
    initials count.
    """
    out = F.regexp_replace(_c(text), _INITIALS, f"$1{STOP_MARK}$2$3{STOP_MARK}")
    if lang is None:
        return out
    name = F.lower(_c(lang))
    found = out
    for long, code in LANGUAGE_CODES.items():
        found = F.when(name.isin(long, code), F.regexp_replace(out, _abbreviations(code), f"$1{STOP_MARK}")).otherwise(found)
    return found


def mark_sentences(text, lang=None) -> Column:
    """Array of raw sentence chunks: a boundary follows ``.!?`` runs (plus closing quotes) and whitespace.

    The stops of initials and of the language's abbreviations are no boundary.
    """
    return F.split(F.regexp_replace(mark_stops(text, lang), SENTENCE_END, "$1" + SENTENCE_MARK), SENTENCE_MARK, -1)


def is_blank(chunk) -> Column:
    return _c(chunk).rlike(BLANK)


def clean_sentence_words(chunk) -> Column:
    """Words of one raw sentence: split punctuation and contractions, keep letters, lowercase."""
    s = _c(chunk)
    s = F.regexp_replace(s, CLAUSE_PUNCT, " $1 $2")
    s = F.regexp_replace(s, DROP_PUNCT, " ")
    s = F.regexp_replace(s, NEG_CONTRACTION, " $1$2")
    s = F.regexp_replace(s, CONTRACTION, " $1$2")
    s = F.lower(F.regexp_replace(s, NON_LETTER_OR_WS, ""))
    # split by one plain character: Spark compiles any other pattern anew for every row
    return F.array_remove(F.split(F.regexp_replace(s, _OTHER_SPACE, " "), " ", -1), "")


def mark_word(word) -> Column:
    return F.concat(F.lit(BOUNDARY), _c(word), F.lit(BOUNDARY))


def char_ngrams(word, n: int) -> Column:
    """All length-``n`` substrings of ``*word*`` left to right, then ``*word*`` itself.

    Short words keep the duplicate (``*i*`` twice for n=3); ``sequence`` counts
    down for an empty range, hence the length guard.
    """
    m = mark_word(word)
    n = int(n)
    grams = F.transform(F.sequence(F.lit(1), F.char_length(m) - n + 1), lambda i: F.substring(m, i, n))
    return F.concat(
        F.when(F.char_length(m) >= n, grams).otherwise(F.array().cast("array<string>")),
        F.array(m),
    )
