"""Small tables with all the awkward rows: nulls, empty, very long, repeated, clashing columns."""
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, target int, _size int"
LONG = "lange wörter stehen hier und mail an a@b.co oder 4242 4242 4242 4242 " * 3000


def documents(spark, extra=()):
    rows = [
        (0, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1, 0.5, "x", 1, 2),
        (1, "THE quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1, None, None, None, None),
        (2, "", "en", "b", 0, 0.5, "x", 1, 2), (3, None, None, None, None, None, None, None, None),
        (4, " \t\n ", "fr", "b", 3, 0.1, "x", 1, 2), (5, LONG, "de", None, 9, 0.1, "x", 1, 2), (6, LONG, "de", "é", 9, 0.1, "x", 1, 2),
        (7, "one", None, "c", 3, 0.1, "x", 1, 2), (7, "one", None, "c", 3, 0.1, "x", 1, 2), (8, "two words", "en", "c", 3, 0.1, "x", 1, 2),
        (9, "le chat et le chien sont dans la maison avec les enfants", "fr", "a", 3, 0.1, "x", 1, 2),
        (None, "a row without its id", "en", "a", 3, 0.1, "x", 1, 2), (10, "1234 5678 +1 (407) 555-7710, 999.1.2.3, 10.0.0.1", "xx", "a", 1, 1.0, "x", 1, 2),
        *extra,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
