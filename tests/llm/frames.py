"""Rows for the tests of the corpus operators."""

import random


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def messy_rows() -> list[tuple]:
    base = prose(1, 60)
    near = base[:30] + ["changed"] + base[31:]
    rows = [
        (1, " ".join(base), "en", "a", 1),
        (2, "  ".join(base) + " ", "en", "a", 1),
        (3, " ".join(near), "en", "b", 1),
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (6, " \n\t ", "de", "b", 3),
        (7, "short", "de", "b", 5),
        (8, "short", "de", None, 5),
        (8, "short", "de", None, 5),
        (None, "short", None, "a", None),
        (None, " ".join(prose(2, 40)), "en", "a", None),
        (11, " ".join(prose(3, 30_000)), "en", "a", 1),
        (12, "é ü ñ " * 50 + "token = \"abcdefgh12345678\" é", "fr", "c", 1),
        (12, " ".join(prose(4, 25)), "fr", "c", 1),
        (13, "x" * 200_000, "en", "c", 1),
        (14, "4711 !!", "en", "c", 1),
    ]
    return rows
