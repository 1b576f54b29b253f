"""Invented texts for the tests."""

import random

SYLLABLES = {
    "en": "the and tion ing er on th re at ly ness of to".split(),
    "de": "der und ung sch heit keit ein zu ver lich ß ü".split(),
    "fr": "le la eau tion que ment é è ou eux de".split(),
}


def invented(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))
