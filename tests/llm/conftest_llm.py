"""Rows that every operator must stand."""

import random

SCHEMA = "doc_id bigint, text string, lang string, Score double, source string"


def edge_rows():
    """Nulls, empty and very long texts, repeated rows, copies and shared passages."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
                  for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    shared, base = prose(40), prose(120)
    near = base.split()
    near[5] = "changed"
    long = prose(30_000)
    texts = [
        (1, base), (2, " ".join(near)), (3, base.upper()), (4, None), (5, ""), (6, " \t\n "),
        (7, "one"), (8, "one two"), (9, "ONE"), (10, prose(50) + " " + shared),
        (11, shared + "\n" + prose(60)), (12, prose(20) + "\t" + shared + " " + prose(20)),
        (13, long), (14, "x" * 50_000), (15, "é ü ñ 日本語 \U0001F600 ok"), (16, "12 34 !!"),
        (17, base), (17, base), (18, "a b c " * 40), (19, prose(13)), (None, base), (None, None),
        (20, long + " tail"), (2**53 + 1, shared), (-4, shared + " " + prose(5)),
        (21, prose(15) + "   " + prose(15)),
    ]
    return [(d, t, "en" if d and d % 2 else None, 0.5, "src") for d, t in texts]

