"""Texts of many kinds for plain versions of features."""

import random

_rng = random.Random(11)
_words = "lorem Ipsum dolor SIT amet, elit. sed! do? magna naïve Grüße 漢字 don't x 12 3.5 #tag a|b (c) \"q\" zzzzzzzzzzzzzzzzzzzzzzzzz réeuxelle achkeit bomente".split()

TEXTS = ["", " ", "one", "One ONE one. one", "a\tb\n\nc.\nc.\n", "\x00\x01\x7f`", "The end.\nThe End.\nx" * 9, "word " * 500]
TEXTS += [_rng.choice([" ", "  ", "\n", ". \n"]).join(_rng.choices(_words, k=_rng.randint(1, 60))) for _ in range(40)]
