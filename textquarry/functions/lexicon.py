"""Stop words and synonyms, and the rules that lists of them must meet."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from pathlib import Path

from textquarry.errors import InvalidInput

# The default Russian stop words, without the negations that carry sentiment.
STOP_WORDS = tuple(
    (
        "а без более бы был была были было быть в вам вас ведь во вот все всего вы где да даже для до его ее "
        "если есть еще же за здесь и из или им их к как когда кто ли меня мне может мы на над но о об от по "
        "под при про с со так он такой там то того тоже тот тут ты у уже что чтобы она эти они я "
    ).split()
)

# Canonical forms with their variants.
SYNONYMS = {
    "хороший": ["отличный", "прекрасный"],
    "плохой": ["ужасный", "отвратительный"],
    "красивый": ["симпатичный", "привлекательный"],
    "удобный": ["комфортный", "комфортабельный"],
    "размер": ["габарит", "величина"],
    "товар": ["ассортимент", "изделие"],
    "быстрый": ["проворный", "скорый"],
    "медленный": ["неторопливый", "неспешный"],
    "дешевый": ["недорогой", "дешевенький"],
    "ткань": ["материя", "материал"],
}


def stop_words(lines: Iterable[str]) -> tuple[str, ...]:
    """Words of a list with one form a line, without blank lines and # comments; at least 50, no не or ни."""
    words = tuple(dict.fromkeys(x for line in lines if (x := line.strip()) and not x.startswith("#")))
    if len(words) < 50:
        raise InvalidInput(f"a stop word list needs 50 words, this has {len(words)}")
    if {"не", "ни"} & set(words):
        raise InvalidInput("не and ни carry sentiment and must not be stop words")
    return words


def read_stop_words(path: str | Path) -> tuple[str, ...]:
    return stop_words(Path(path).read_text("utf-8").splitlines())


def synonym_table(groups: dict[str, list[str]], normalize: Callable[[str], str] = str) -> dict[str, str]:
    """Variant to canonical form, both normalized; at least ten groups of two variants, no word in conflict."""
    if len(groups) < 10:
        raise InvalidInput("a synonym list needs ten groups")
    table: dict[str, str] = {}
    for canonical, variants in groups.items():
        if len(variants) < 2:
            raise InvalidInput(f"the group of {canonical} needs two variants")
        target = normalize(canonical)
        for variant in variants:
            if table.setdefault(normalize(variant), target) != target:
                raise InvalidInput(f"{variant} stands in two groups")
    clash = set(table) & set(table.values()) - {k for k, v in table.items() if k == v}
    if clash:
        raise InvalidInput(f"both variant and canonical: {', '.join(sorted(clash))}")
    return {k: v for k, v in table.items() if k != v}


def read_synonyms(path: str | Path, normalize: Callable[[str], str] = str) -> dict[str, str]:
    """From a JSON file with groups of canonical and variants."""
    data = json.loads(Path(path).read_text("utf-8"))
    try:
        groups = {g["canonical"]: list(g["variants"]) for g in data["groups"]}
    except (KeyError, TypeError) as e:
        raise InvalidInput(f"not a synonym file: {path}") from e
    return synonym_table(groups, normalize)
