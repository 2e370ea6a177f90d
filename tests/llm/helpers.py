"""Invented texts for the tests."""

import random


def story(seed, words=120):
    """Invented words, the same for the same seed."""
    draw = random.Random(seed)
    parts = ["tor", "min", "gal", "esh", "uri", "bok", "len", "dra", "pis", "vam"]
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(2, 4))) for _ in range(words))
