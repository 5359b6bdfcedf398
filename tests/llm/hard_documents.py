"""Documents that every operator has to cope with."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, part int, body string, score string, _row int, features string, limits int, _key string, _hits string, _items string, _q string, _lang string, _limits string, _failed string, _place_of_the_text string, key string, row string, q string, failed string, place_of_the_text string, o string"

CLASHING = tuple("key hits items q lang limits failed place k r qq f p o".split())  # values of columns whose names operators use inside


def prose(seed, n, vocabulary=400):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(n))


def hard_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, rows of one id, and shared passages."""
    shared = prose(1, 60)
    texts = [
        (1, prose(2, 50) + " " + shared),
        (2, shared + "\n" + prose(3, 30)),
        (2, shared + "\n" + prose(3, 30)),  # a repeated row
        (3, prose(4, 20) + " " + shared + " " + shared),
        (3, "another text of the same id " + shared),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (None, "no id " + shared),
        (None, None),
        (7, prose(5, 40_000, 3_000) + " " + shared),  # very long
        (8, "the " * 60 + "end"),
        (9, "the " * 45 + "fin"),
        (10, "a" * 150 + " " + "é" * 80 + " ñandú über " + "a" * 150),
        (11, "a b c"),
        (12, "a b c"),
        (13, prose(2, 50) + " " + shared),  # an exact copy
        (14, "### $$$ %%% &&& " * 20),
        (15, "MANY LOUD WORDS!! " * 12),
    ]
    langs, sources = ["en", None, "de"], ["s0", None]
    return [(i, t, langs[k % 3], sources[k % 2], None if t is None else len(t), k, k, "x", "y", k, "f", 0, *CLASHING) for k, (i, t) in enumerate(texts)]
