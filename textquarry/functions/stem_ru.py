"""The published Snowball stemmer for Russian, for words in lower case with ё read as е."""

from __future__ import annotations

VOWELS = frozenset("аеиоуыэюя")

# Endings of the published algorithm. Those of an "after" list count only after а or я.
GERUND_AFTER = "в вши вшись".split()
GERUND = "ив ивши ившись ыв ывши ывшись".split()
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE_AFTER = "ем нн вш ющ щ".split()
PARTICIPLE = "ивш ывш ующ".split()
REFLEXIVE = "ся сь".split()
VERB_AFTER = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
DERIVATIONAL = "ост ость".split()


def _cut(word: str, start: int, plain: list[str], after: list[str] = ()) -> str | None:
    """word without its longest listed ending, looked for from start on; null if it has none that may go."""
    ending = max((e for e in (*plain, *after) if word.endswith(e) and len(word) - len(e) >= start), key=len, default=None)
    if ending is None:
        return None
    stem = word[: len(word) - len(ending)]
    if ending in after and ending not in plain and not (len(stem) > start and stem[-1] in "ая"):
        return None
    return stem


def _regions(word: str) -> tuple[int, int]:
    """Where the part after the first vowel begins, and the second of the parts after vowel and consonant."""
    first = next((i + 1 for i, c in enumerate(word) if c in VOWELS), len(word))

    def beyond(start: int) -> int:
        return next((i + 1 for i in range(max(start, 0) + 1, len(word)) if word[i] not in VOWELS and word[i - 1] in VOWELS and i - 1 >= start), len(word))

    return first, beyond(beyond(0))


def stem(word: str) -> str:
    start, second = _regions(word)
    gerund = _cut(word, start, GERUND, GERUND_AFTER)
    if gerund is not None:
        word = gerund
    else:
        reflexive = _cut(word, start, REFLEXIVE)
        word = word if reflexive is None else reflexive
        adjective = _cut(word, start, ADJECTIVE)
        if adjective is not None:
            participle = _cut(adjective, start, PARTICIPLE, PARTICIPLE_AFTER)
            word = adjective if participle is None else participle
        else:
            verb = _cut(word, start, VERB, VERB_AFTER)
            noun = _cut(word, start, NOUN) if verb is None else None
            word = verb if verb is not None else noun if noun is not None else word
    if word.endswith("и") and len(word) - 1 >= start:
        word = word[:-1]
    derived = _cut(word, second, DERIVATIONAL)
    word = word if derived is None else derived
    superlative = _cut(word, start, ["ейш", "ейше"])
    word = word if superlative is None else superlative
    if word.endswith("нн") and len(word) - 1 >= start + 1:
        return word[:-1]
    if superlative is None and word.endswith("ь") and len(word) - 1 >= start:
        return word[:-1]
    return word
