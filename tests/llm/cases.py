"""Documents with everything odd: nulls, empty and long texts, repeated rows, ties, and columns named as operators name theirs."""

CLASHING = [
    "row__", "fp", "h", "h2", "v", "w", "tag", "tag2", "first", "site__", "keys__", "kept__", "text__", "key", "hit", "i", "k", "doc", "words", "id__", "score__", "target__",
    "is_target__", "root", "component_id", "start", "halves", "llr", "kept", "g", "lines",
]
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions under a pale autumn moon"
LONG = " ".join(f"{w}{k % 97}" for k in range(6000) for w in ("alpha", "beta", "gamma"))
TEXTS = [
    (1, PROSE + ".\nFooter line of the site.\n" + PROSE, "en", "a", 10),
    (2, PROSE + ".\nFooter line of the site.\n" + PROSE, "en", "a", 10),
    (2, PROSE + ".\nFooter line of the site.\n" + PROSE, "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n\v\f\r ", "en", None, 6),
    (None, PROSE, "de", "b", 5),
    (None, None, None, None, None),
    (6, "one", "fr", "b", 3),
    (7, LONG, "en", "b", 1),
    (8, "été naïve 日本語 🙂 é ß", "fr", "c", 9),
    (9, "x" * 5000, "en", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    rows = [(*row, *(f"x{k}" for k in range(len(CLASHING)))) for row in TEXTS]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in CLASHING))


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows):
    """From (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], SCHEMA)


def brute_words(text):
    import re

    return [w for w in re.split("[ \t\n\v\f\r]+", text or "") if w]
