"""Small tables with the awkward cases every operator must stand, and reading results."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, h string, key string, n int, id long"


def documents(table, rows):
    """`documents` with further columns whose names operators use inside."""
    return table(SCHEMA, [(i, text, "en", "src0", len(text or ""), "x", "y", "z", 7, 1) for i, text in rows])


def words(seed, count):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(count))


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r"),
    (4, "one"),
    (4, "one"),
    (5, "ONE  "),
    (6, "one two three"),
    (7, "Ünïcödé line that is long enough\nÜnïcödé line that is long enough  \nshort"),
    (8, "ünïcödé line that is long enough\n\n" + words(1, 300)),
    (9, " ünïcödé line that is long enough\nA line of this document that is LONG enough\n"),
    (10, words(2, 400)),
    (11, words(2, 400) + " more"),
    (12, words(3, 30000)),
    (None, "without id, a line that is long enough"),
    (None, None),
    (13, "x" * 50000),
    (14, "a line of this document that is long enough <|endoftext|> 漢字かな 🙂"),
    (15, "a line of this document that is long enough"),
]


def rows_of(frame, *columns):
    return sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=str)
