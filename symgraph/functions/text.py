"""Tokens, phrases and terms of the text index."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters and what they become in the index.
_FOLD = {
    "a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ",
}
FOLD_FROM = "".join(_FOLD.values())
FOLD_TO = "".join(k * len(v) for k, v in _FOLD.items())

#: Words that say nothing about a task.
STOP_WORDS = (
    "a", "an", "and", "are", "bug", "code", "fix", "for", "how", "in", "of", "on", "or", "the", "this", "to",
    "what", "where", "why",
)

_TERM = r"[A-Za-z_][A-Za-z0-9_$.:-]*"


def fold(text: str) -> str:
    return text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits without diacritics, in order; a null has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Texts without a character beyond ASCII have nothing to fold.
    folded = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), 1)


def phrases(query: str) -> list[list[str]]:
    """The query's terms as token lists; the last token of each is a prefix.  Terms without a token drop out."""
    out = []
    for term in query.replace("::", " ").split():
        found = re.findall(r"[^\W_]+", fold(re.sub('["*:]', "", term)))
        if found:
            out.append(found)
    return out


def context_terms(task: Column) -> Column:
    """Identifier-like terms of a task: three characters or more, no stop words, first spelling of each.

    A fold over the terms that remembers what it has seen; its lambda refers to nothing outside, since such
    expressions would be computed anew for each element.
    """
    found = F.filter(F.regexp_extract_all(task, F.lit(f"({_TERM})"), 1), lambda t: (F.octet_length(t) >= 3) & ~F.lower(t).isin(*STOP_WORDS))

    def step(acc: Column, term: Column) -> Column:
        new = F.struct(F.array_append(acc["seen"], F.lower(term)).alias("seen"), F.array_append(acc["out"], term).alias("out"))
        return F.when(F.array_contains(acc["seen"], F.lower(term)), acc).otherwise(new)

    none = F.array().cast("array<string>")
    first = F.aggregate(found, F.struct(none.alias("seen"), none.alias("out")), step, lambda acc: acc["out"])
    whole = F.trim(task)
    return F.when(F.size(found) > 0, first).when(whole != "", F.array(whole)).otherwise(none)


def context_terms_of(task: str) -> list[str]:
    """The same for one string on the driver."""
    seen: dict[str, str] = {}
    for term in re.findall(_TERM, task):
        if len(term) >= 3 and term.lower() not in STOP_WORDS:
            seen.setdefault(term.lower(), term)
    return list(seen.values()) or ([task.strip()] if task.strip() else [])
