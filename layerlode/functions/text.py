"""Words and word n-grams as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two word characters or more, hyphens and apostrophes inside. The same matches in Java, RE2 and Python.
WORD = r"[\p{L}\p{N}_][-'\p{L}\p{N}_]*[\p{L}\p{N}_]"

#: English function words; a gram that begins or ends with one isn't a phrase.
STOP_WORDS = tuple(
    """about above after again all also am an and any are as at be because been before being below between both but by can
    could did do does doing down during each else few for from further had has have having he her here hers him his how if
    in into is it its just me might more most must my no nor not now of off on once only or other our out over own per same
    shall she should so some such than that the their them then there these they this those through to too under until up
    upon us very was we were what when where which while who whom whose why will with within without would you your""".split()
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 4, stop: Collection[str] = STOP_WORDS) -> Column:
    """All runs of ``low`` to ``high`` tokens, joined by spaces, whose first and last token isn't in ``stop``.

    Positions are chosen by the tokens at a run's ends before any string is built.
    """
    none = F.array().cast("array<int>")

    def at(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(none)
        if stop:
            kept = [*stop]
            starts = F.filter(starts, lambda i: ~F.get(tokens, i - 1).isin(kept) & ~F.get(tokens, i + (n - 2)).isin(kept))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(*[at(n) for n in range(low, high + 1)])


def truncate_middle(text: Column, most: int) -> Column:
    """``text`` up to ``most`` characters, else its first and last halves around a note of what is missing."""
    half = most // 2
    gone = F.length(text) - 2 * half
    short = F.concat(F.substring(text, 1, half), F.lit(" ...["), gone.cast("string"), F.lit(" characters left out]... "), F.expr("''") if not half else F.right(text, F.lit(half)))
    return F.when(F.length(text) <= most, text).otherwise(short)
