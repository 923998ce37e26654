"""Rows that every operator must take: nulls in any column, empty and very long texts, repeats, ties,
and extra columns whose names operators use inside."""

import random

LONG = " ".join(f"w{i % 9973}" for i in range(120_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, tok long, size long, h long, key double, component long, row long, _i long, _s long, _d long, _gone long, _copies long, _rows long, _takes long, _row long, _nth long"


def rows():
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [
        (1, base[0]), (2, base[0]), (3, base[0] + " tail"), (4, base[1]), (5, base[1].upper()), (6, None), (7, ""), (8, " \t\n\r\x0b\x0c "),
        (9, "one two three"), (10, "One TWO three"), (11, "one two four"), (12, LONG), (13, LONG + " end"), (None, base[0]), (None, None),
        (14, base[2]), (14, base[2]), (15, base[3]), (15, base[4]), (16, base[4]), (17, base[5]), (18, "é ñ 日本   x"), (19, "x" * 300_000), (20, "a"),
    ]
    return [(i, t, None if i == 4 else "en", None if i in (3, 9) else f"s{(i or 0) % 2}", None, 1, 2, 3, 4, 0.5, 6, 7, *range(9)) for i, t in texts]


def docs(spark, some=None):
    """Rows of ``some`` may stop after any column; the rest is as in the others."""
    rest = (None, None, "en", "s0", None, 1, 2, 3, 4, 0.5, 6, 7, *range(9))
    return spark.createDataFrame([(*r, *rest[len(r):]) for r in (rows() if some is None else some)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
