"""Label functions: decode, remap, arg-max, soft-max, bins and the row labellers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from . import lexicons as lex
from .text import WORD, word_count, words


# a backslash is an escape inside a SQL string
WORD_SQL = WORD.replace("\\", "\\\\")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _choose(code: Column, table: Mapping, other: Column | None = None) -> Column:
    out = None
    for key, value in table.items():
        out = (F if out is None else out).when(code == F.lit(key), F.lit(value))
    return out if other is None else out.otherwise(other)


def label_decode(code: Column | str, other: str | None = None) -> Column:
    """0/1/2 as Negative/Neutral/Positive; any other code as ``other`` (NULL)."""
    return _choose(_col(code), lex.SENTIMENT_NAMES, None if other is None else F.lit(other))


def label_encode(name: Column | str) -> Column:
    return _choose(_col(name), {v: k for k, v in lex.SENTIMENT_NAMES.items()})


def label_remap(class_idx: Column | str, classes: Mapping[int, int], invalid: int | None = -1) -> Column:
    """Class index of one scorer as a sentiment code; unmapped classes as ``invalid``."""
    return _choose(_col(class_idx), classes, F.lit(invalid).cast("int"))


def lookup(key: Column | str, table: Mapping, default) -> Column:
    """Value of ``table`` for a key, or the default."""
    return _choose(_col(key), table, F.lit(default))


def argmax_map(scores: Column | str, order: Sequence[str]) -> Column:
    """Struct ``(label, score)`` of the highest score; ties go to the earlier label.

    Labels that ``order`` lacks come after all others.
    """
    place = lambda key: F.array_position(F.lit(list(order)), key)
    ranked = F.transform(
        F.map_entries(_col(scores)),
        lambda e: F.struct(
            e["value"].alias("score"),
            F.when(place(e["key"]) > 0, -place(e["key"])).otherwise(-len(order) - 1).cast("long").alias("rank"),
            e["key"].alias("label"),
        ),
    )
    top = F.array_max(ranked)
    return F.struct(top["label"].alias("label"), top["score"].alias("score"))


def softmax(logits: Column | str) -> Column:
    """Soft-max of an array of class scores."""


    def shares(top_and_all: Column) -> Column:
        powers = F.transform(top_and_all["all"], lambda x: F.exp(x - top_and_all["top"]))
        return F.transform(
            F.array(powers),
            lambda p: F.transform(
                p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y)
            ),
        )[0]

    logits = _col(logits)
    named = F.struct(F.array_max(logits).alias("top"), logits.alias("all"))
    return F.get(F.transform(F.array(named), shares), F.lit(0))


def bin_score(score: Column | str, bins: Sequence[tuple[float, str]] = tuple(lex.TOXICITY_BINS)) -> Column:
    """Right-closed bins from 0 on, the lowest edge included; outside them NULL."""
    score = _col(score)
    out = F.when(score < 0, F.lit(None).cast("string"))
    for edge, name in bins:
        out = out.when(score <= F.lit(edge), F.lit(name))
    return out


def format_pct(part: Column | str, whole: Column | str, digits: int = 1) -> Column:
    """``part`` in percent of ``whole``, rounded half to even."""
    return F.bround(_col(part) * F.lit(100.0) / _col(whole), digits)


# ---------------------------------------------------------------- themes


def theme_keywords(pair: tuple[str, str]) -> list[tuple[str, int]]:
    """``(lower-case substring, points)`` of one theme pair."""
    theme, sub = pair[0].lower(), pair[1].lower()
    return [(k, 2) for k in theme.split()] + [(k, 3) for k in sub.split()] + [(sub, 5)]


def sql_text(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _low(text: str) -> str:
    return f"lower(coalesce(`{text}`, ''))"


def _all_in(where: str, terms: Iterable[str]) -> str:
    return " AND ".join(f"contains({where}, {sql_text(t)})" for t in terms)


def _theme_points(text: str, pairs: Sequence[tuple[str, str]]) -> list[str]:
    """SQL per pair. A few hundred terms are far quicker to state as text than as Columns."""
    low = _low(text)
    points = []
    for pair in pairs:
        *single, (sub, whole_points) = theme_keywords(pair)
        terms = [f"int({_all_in(low, [k])}) * {p}" for k, p in single]
        # the whole subtheme can only occur where each of its words does
        terms.append(f"int({_all_in(low, [*sub.split(), sub])}) * {whole_points}")
        points.append("(" + " + ".join(terms) + ")")
    return points


def theme_points(text: str, pairs: Sequence[tuple[str, str]] = tuple(lex.THEME_PAIRS)) -> Column:
    """Array of the points of every theme pair for a text column, in rank order."""
    return F.expr(f"array({', '.join(_theme_points(text, pairs))})")


def theme_struct(text: str, pairs: Sequence[tuple[str, str]] = tuple(lex.THEME_PAIRS)) -> Column:
    """Struct ``(theme, subtheme)`` of a text column's best pair; ties go to the earlier pair.

    Score and rank are packed in one number, so the choice is integer work inside the
    generated code. A stand-in with score 1 (real scores start at 2) means "no theme".
    """
    n = len(pairs)
    base = n + 1
    packed = [f"{p} * {base} + {n - i}" for i, p in enumerate(_theme_points(text, pairs))]
    rows = [f"struct({sql_text(t)} AS theme, {sql_text(s)} AS subtheme)" for t, s in pairs]
    rows.append("CAST(NULL AS STRUCT<theme: STRING, subtheme: STRING>)")
    best = f"greatest({', '.join(packed)}, {base})"
    return F.expr(f"get(array({', '.join(rows)}), {n} - {best} % {base})")


# ---------------------------------------------------------------- lexicon sentiment


def _anchors(phrases: Sequence[str]) -> dict[str, str]:
    """One word per phrase, chosen so that few different words serve all phrases."""
    uses = Counter(w for p in phrases for w in set(p.split()))
    return {p: max(p.split(), key=lambda w: (uses[w], w)) for p in phrases}


def lexicon_points(
    text: str,
    negative: Mapping[str, int] = lex.NEGATIVE_KEYWORDS,
    positive: Mapping[str, int] = lex.POSITIVE_KEYWORDS,
) -> Column:
    """Struct ``(negative, positive)`` of keyword, phrase and emoji points of a text column.

    A phrase counts twice its weight wherever it occurs as a substring, a word its weight
    where it stands alone, each keyword once. A phrase is only searched for in texts that
    hold its anchor word; few anchors serve all phrases.
    """
    raw, low = f"coalesce(`{text}`, '')", _low(text)
    every = [*negative, *positive]

    def word_array(words_: Iterable[str]) -> str:
        return f"array({', '.join(map(sql_text, words_))})"

    words_found = f"split({low}, '[^{WORD_SQL}]+')"
    found = f"array_intersect({words_found}, {word_array(k for k in every if ' ' not in k)})"
    anchor = _anchors([k for k in every if " " in k])
    signs = sorted(e[0] for e in lex.NEGATIVE_EMOJI + lex.POSITIVE_EMOJI)
    near, far = ([s for s in signs if (ord(s) > 0xFFFF) == beyond] for beyond in (False, True))
    # a text without a character in these ranges is not searched for each emoji
    any_emoji = f"{raw} RLIKE '[{near[0]}-{near[-1]}{far[0]}-{far[-1]}]'"

    def points(keywords: Mapping[str, int], emoji: Sequence[str]) -> str:
        terms = [
            f"int({_all_in(low, [anchor[k], k])}) * {2 * w}" for k, w in keywords.items() if " " in k
        ]
        singles = {k: w for k, w in keywords.items() if " " not in k}
        for weight in sorted(set(singles.values())):
            group = word_array(k for k, w in singles.items() if w == weight)
            terms.append(f"size(array_intersect({found}, {group})) * {weight}")
        terms += [f"int({any_emoji} AND {_all_in(raw, [sign])}) * {lex.EMOJI_WEIGHT}" for sign in emoji]
        return f"double({' + '.join(terms)})"

    return F.expr(
        f"struct({points(negative, lex.NEGATIVE_EMOJI)} AS negative, "
        f"{points(positive, lex.POSITIVE_EMOJI)} AS positive)"
    )


def length_bonus(points: Column | str, text: Column | str) -> Column:
    """The points with a tenth of the word count added to the larger side.

    Only in texts of over 20 words. ``points`` should be a computed column, so that it is
    not worked out again for each use here.
    """
    points = _col(points)
    n, p = points["negative"], points["positive"]
    length = word_count(text)
    bonus = F.when((n != p) & (length > 20), length.cast("double") * F.lit(0.1)).otherwise(
        F.lit(0.0)
    )
    return F.struct(
        F.when(n > p, n + bonus).otherwise(n).alias("negative"),
        F.when(p > n, p + bonus).otherwise(p).alias("positive"),
    )


def sentiment_from_scores(negative: Column | str, positive: Column | str) -> Column:
    """0/1/2 from negative and positive points."""
    n, p = _col(negative), _col(positive)
    return (
        F.when(
            (n > 0) & (p > 0),
            F.when(n / p > 2.0, F.lit(0)).when(n / p < 0.5, F.lit(2)).otherwise(F.lit(1)),
        )
        .when(n >= 3, F.lit(0))
        .when(p >= 3, F.lit(2))
        .otherwise(F.lit(1))
    )


def toxicity_from_scores(negative: Column | str, positive: Column | str) -> Column:
    """Share of negative points in [0, 1): a stand-in for a toxicity model."""
    return _col(negative) / (_col(negative) + _col(positive) + F.lit(4.0))


# ---------------------------------------------------------------- lexicon emotion


def emotion_scores(
    text: Column | str, keywords: Mapping[str, Mapping[str, float]] = lex.EMOTION_KEYWORDS
) -> Column:
    """Map emotion -> probability: soft-max of the weights of the keywords found."""
    every = sorted({k for group in keywords.values() for k in group})
    found = F.array_intersect(words(F.coalesce(_col(text), F.lit(""))), F.lit(every))

    def weight_sum(hits: Column, group: Mapping[str, float]) -> Column:
        total = F.lit(0.0)
        for weight in sorted(set(group.values())):
            terms = [k for k, w in group.items() if w == weight]
            total = total + F.size(F.array_intersect(hits, F.lit(terms))) * F.lit(float(weight))
        return total

    def score(hits: Column) -> Column:
        return F.array(*(weight_sum(hits, group) for group in keywords.values()))

    logits = F.transform(F.array(found), score)
    probabilities = F.get(F.transform(logits, softmax), F.lit(0))
    return F.map_from_arrays(F.lit(list(keywords)), probabilities)
