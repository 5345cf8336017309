"""Stemming of Russian words by the published Snowball rules (X7), as an Arrow-batched function.

The algorithm is described at snowballstem.org: endings are removed from the region after the first vowel (RV), and
derivational ones from the region R2.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

VOWELS = "аеиоуыэюя"


def _alternatives(text: str) -> str:
    return "|".join(sorted(text.split(), key=len, reverse=True))


# The endings of the published algorithm. Those of group one need а or я before them.
_GERUND = re.compile(f"((?<=[ая])({_alternatives('в вши вшись')})|({_alternatives('ив ивши ившись ыв ывши ывшись')}))$")
_REFLEXIVE = re.compile("(ся|сь)$")
_ADJECTIVE = _alternatives("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_PARTICIPLE = f"((?<=[ая])({_alternatives('ем нн вш ющ щ')})|({_alternatives('ивш ывш ующ')}))"
_ADJECTIVAL = re.compile(f"{_PARTICIPLE}?({_ADJECTIVE})$")
_VERB_ONE = _alternatives("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно")
_VERB_TWO = _alternatives("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_VERB = re.compile(f"((?<=[ая])({_VERB_ONE})|({_VERB_TWO}))$")
_NOUN = re.compile(
    f"({_alternatives('а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я')})$"
)
_SUPERLATIVE = re.compile("(ейш|ейше)$")
_DERIVATIONAL = re.compile("(ост|ость)$")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, from some place on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def stem_word(word: str) -> str:
    """The stem of a lower-cased word."""
    word = word.lower().replace("ё", "е")
    first = next((i for i, c in enumerate(word) if c in VOWELS), None)
    if first is None:
        return word
    rv = first + 1
    r2 = _region(word, _region(word, 0))

    def strip(pattern: re.Pattern, text: str) -> tuple[str, bool]:
        head, tail = text[:rv], text[rv:]
        # endings are taken in RV alone; what must come before one is in RV as well
        cut = pattern.sub("", tail)
        return head + cut, cut != tail

    word, done = strip(_GERUND, word)
    if not done:
        word, _ = strip(_REFLEXIVE, word)
        for pattern in (_ADJECTIVAL, _VERB, _NOUN):
            word, done = strip(pattern, word)
            if done:
                break
    if len(word) > rv and word.endswith("и"):
        word = word[:-1]
    if (found := _DERIVATIONAL.search(word)) and found.start() >= r2:
        word = word[: found.start()]
    if word[rv:].endswith("нн"):
        return word[:-1]
    cut, done = strip(_SUPERLATIVE, word)
    if done:
        return cut[:-1] if cut[rv:].endswith("нн") else cut
    return word[:-1] if word[rv:].endswith("ь") else word


def stem_tokens():
    """A column function: stems of the tokens that start with a letter."""
    return F.pandas_udf(_stem_batch, "array<string>")


def _stem_batch(tokens: pd.Series) -> pd.Series:
    """Each distinct token of a batch is stemmed once."""
    known: dict[str, str] = {}

    def stem(token: str) -> str:
        if token not in known:
            known[token] = stem_word(token)
        return known[token]

    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts if t[:1].isalpha()])
