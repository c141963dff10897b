"""Text functions: ``Column -> Column``, all inside the JVM.

Java's ``\\w`` is ASCII only and ``(?U)\\w`` also keeps combining marks, so word and
space characters are spelled out as Unicode classes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .lexicons import SPLIT_WORDS

SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
BENGALI = r"\x{0980}-\x{09FF}"

_URL = f"http[^{SPACE}]+|www[^{SPACE}]+"
_SPACES = f"[{SPACE}]+"
# every run of characters that becomes one blank: dropped characters and white space
_NOT_KEPT = f"[^{WORD}{BENGALI}@#!?]+"
_SPLIT_WORDS = "|".join(f"({a})({b})" for a, b in SPLIT_WORDS.values())
_BEFORE = "".join(f"${2 * i + 1}" for i in range(len(SPLIT_WORDS)))
_AFTER = "".join(f"${2 * i + 2}" for i in range(len(SPLIT_WORDS)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_spaces(text: Column | str) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), _SPACES, " "))


def clean_text(text: Column | str) -> Column:
    """Drop URLs and symbols, keep words, Bengali script and ``@ # ! ?``.

    Missing or blank text gives ``""``; text of which nothing is left gives ``" "``.
    """
    text = F.coalesce(_col(text), F.lit(""))
    has_url = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www"))
    no_url = F.when(has_url, F.regexp_replace(text, _URL, "")).otherwise(text)
    kept = F.trim(F.regexp_replace(no_url, _NOT_KEPT, " "))
    # both uses of `kept` are always evaluated, so the generated code computes it once
    return F.concat(kept, F.when((kept == "") & ~is_blank(text), F.lit(" ")).otherwise(F.lit("")))


def has_bengali(text: Column | str) -> Column:
    return _col(text).rlike(f"[{BENGALI}]")


def is_blank(text: Column | str) -> Column:
    """Missing, empty or white space only."""
    return ~F.coalesce(_col(text), F.lit("")).rlike(f"[^{SPACE}]")


def word_count(text: Column | str) -> Column:
    """Number of runs without white space; 0 for blank text."""
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(f"[^{SPACE}]+"))


def words(text: Column | str) -> Column:
    """Lower-case runs of word characters (letters, numbers, ``_``)."""
    return F.split(F.lower(_col(text)), f"[^{WORD}]+")


def space_tokens(text: Column | str) -> Column:
    """Lower-case tokens between white space; an empty array for blank text."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    # most texts have blanks only, and one sign splits much faster than a pattern
    flat = F.when(low.rlike(f"[{SPACE}&&[^ ]]"), F.regexp_replace(low, _SPACES, " ")).otherwise(low)
    return F.array_remove(F.split(flat, " "), "")


def report_tokens(cleaned: Column | str, stop: Iterable[str]) -> Column:
    """Letter-only tokens of cleaned text, longer than two, that are no stop-words."""
    low = F.lower(F.coalesce(_col(cleaned), F.lit("")))
    low = F.when(
        low.rlike("|".join(SPLIT_WORDS)),
        F.regexp_replace(
            low, f"(?<![{WORD}])(?:{_SPLIT_WORDS})(?![{WORD}])", f"{_BEFORE} {_AFTER}"
        ),
    ).otherwise(low)
    stop = sorted(stop)
    keep = lambda t: t.rlike(r"^\p{L}{3,}$")
    tokens = F.filter(F.split(low, "[ @#!?]+"), keep)
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


# a word without what a treebank tokeniser cuts off its end, or anything else between white space
_TREEBANK_WORD = (
    f"([a-z]++\\p{{L}}*|\\p{{L}}+)(?:'(?:s|m|d|ll|re|ve)?|n't)?(?![^{SPACE}])|[^{SPACE}]++"
)


def english_tokens(raw: Column | str) -> Column:
    """Letter-only tokens of raw lower-case text, split as a treebank tokeniser does.

    Signs that the tokeniser sets apart are no letters, so a blank stands for them; words are taken
    out by one pass, not split and tested one by one.
    """
    t = F.lower(F.coalesce(_col(raw), F.lit("")))
    for pattern, by in (
        # the first class is quick to leave letters, digits and blanks out
        (r"[^\p{L}\p{N}\s,:'_.-](?<=[;@#$%&?!(){}<>\[\]\"«»“”‘’„`])|\.\.\.|--", " "),
        (r"[:,](?:([^\p{Nd}])|$)", " $1"),  # takes the sign after it along, so a run is cut in pairs
        (f"\\.+(?:[{SPACE}]|$)", " "),
    ):
        t = F.regexp_replace(t, pattern, by)
    return F.array_remove(F.regexp_extract_all(t, F.lit(_TREEBANK_WORD), F.lit(1)), "")


def term_words(text: Column | str, stop: Iterable[str] = ()) -> Column:
    """Lower-case runs of two or more word characters that are no stop-words."""
    stop = sorted(stop)
    every = words(F.coalesce(_col(text), F.lit("")))
    if not stop:
        return F.filter(every, lambda t: F.length(t) >= 2)
    return F.filter(every, lambda t: (F.length(t) >= 2) & ~t.isin(stop))


def _neighbours(w: Column, pair) -> Column:
    """``pair(a, b)`` of every two neighbours where it is not NULL."""
    after = F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))
    # the shorter array is filled up with NULL, which a pair with NULL is, too
    return F.filter(F.zip_with(w, after, pair), lambda p: p.isNotNull())


def word_ngrams(text: Column | str, stop: Iterable[str] = ()) -> Column:
    """Single words and pairs of neighbours, after stop-words are taken out."""
    blank = F.lit(" ")
    # the words are split once and named inside the function
    return F.get(
        F.transform(
            F.array(term_words(text, stop)),
            lambda w: F.concat(w, _neighbours(w, lambda a, b: F.concat(a, blank, b))),
        ),
        F.lit(0),
    )


def safe_name(name: Column | str) -> Column:
    """A file-name form: word characters, hyphens, and ``_`` for blanks."""
    kept = F.regexp_replace(_col(name), f"[^{WORD}{SPACE}-]", "")
    return F.replace(F.trim(kept), F.lit(" "), F.lit("_"))


def model_file_name(name: Column | str) -> Column:
    """Lower case with blanks, hyphens and slashes as ``_``."""
    return F.translate(F.lower(_col(name)), " -/", "___")


def model_key(model: Column | str, embedding: Column | str) -> Column:
    return F.concat(_col(model), F.lit(" ("), _col(embedding), F.lit(")"))
