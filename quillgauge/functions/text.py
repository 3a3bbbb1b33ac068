"""Text expressions: cleaning, token arrays, trailing parentheticals, lemmas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points counted as white space in text (Unicode White_Space plus the
# four ASCII separators 1c to 1f).
WHITESPACE = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# English function words left out of the lemma measure by default.
STOP_WORDS = (
    "a about after all also am an and any are as at be because been before being but by can could "
    "did do does for from had has have he her here him his how i if in into is it its me more most "
    "my no nor not of on one only or other our out over she should so some such than that the their "
    "them then there these they this those to too under up very was we were what when where which "
    "while who whom why will with would you your"
).split()

# Suffix rules as (endings, endings that are exempt, least length, letters cut, letters
# added). The first rule that fits is used.
LEMMA_RULES = (
    (("ies",), (), 6, 3, "y"),
    (("sses", "shes", "ches"), (), 6, 2, ""),
    (("xes",), (), 5, 2, ""),
    (("s",), ("ss", "is", "us"), 4, 1, ""),
    (("ing",), (), 6, 3, ""),
    (("ed",), (), 5, 2, ""),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(text: Column | str) -> Column:
    """Lower-case letters separated by single white space."""
    t = F.lower(_col(text))
    t = F.regexp_replace(t, r"([a-z])-([a-z])", "$1 $2")
    # A class of many ranges is slow, so only what is no letter or blank is looked up in it. Behind
    # this step what is no letter is white space.
    t = F.regexp_replace(t, f"[^a-z ](?<![{WHITESPACE}])", "")
    t = F.regexp_replace(t, "[^a-z][^a-z]+", " ")
    return F.regexp_extract(t, "(?s)[a-z](.*[a-z])?", 0)


def letters(text: Column | str) -> Column:
    """Everything but letters and spaces removed.

    ``\\p{Alpha}`` is a-zA-Z; as two ranges beside a blank, Java takes several times as long for it.
    """
    return F.regexp_replace(_col(text), r"[^\p{Alpha} ]", "")


def token_array(text: Column | str) -> Column:
    """``letters`` cut at each space; empty tokens stay."""
    return F.split(letters(text), " ", -1)


def token_number(text: Column | str) -> Column:
    """The size of ``token_array`` without making it: the spaces and one."""
    t = _col(text)
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1


def word_array(text: Column | str) -> Column:
    """Lower-case tokens without the empty ones, as used by the classifiers."""
    return F.filter(token_array(F.lower(_col(text))), lambda w: w != "")


def strip_parenthetical(text: Column | str) -> Column:
    """Cut a trailing parenthetical: all from the last opening bracket on."""
    t = _col(text)
    return F.when(t.endswith(")"), F.regexp_extract(t, r"(?s)^(.*)\(", 1)).otherwise(t)


def raw_words(text: Column | str) -> Column:
    """Lower-case words between white space, punctuation still on them.

    What is printed ASCII is no white space, so only other characters are looked up in the large class.
    """
    return F.split(F.lower(_col(text)), f"(?:[^!-~](?<=[{WHITESPACE}]))+", -1)


def strip_punctuation(word: Column | str) -> Column:
    """A word without the punctuation around it; pure punctuation becomes empty."""
    return F.regexp_replace(_col(word), r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")


def rule_lemma(word: Column | str) -> Column:
    """The default lemma: the first suffix rule that fits, else the word."""
    w = _col(word)
    out = w
    for endings, exempt, least, cut, added in reversed(LEMMA_RULES):
        fits = F.lit(False)
        for ending in endings:
            fits = fits | w.endswith(ending)
        for ending in exempt:
            fits = fits & ~w.endswith(ending)
        stem = F.substring(w, F.lit(1), F.length(w) - cut)
        out = F.when(fits & (F.length(w) >= least), F.concat(stem, F.lit(added)) if added else stem).otherwise(out)
    return out
