"""Helpers the tests import."""

from __future__ import annotations

import random


def prose(seed, n, vocabulary=400):
    """n words of invented prose."""
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))
