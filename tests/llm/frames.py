"""Small frames with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of their input.
EXTRA = ("digest", "kept", "keep_id", "fp", "text_mark", "mark", "gone", "line", "n", "words", "order", "license", "host", "p_toxic", "score", "__salt", "first")
PROSE = {
    "en": "the cat sat on the mat and looked at the moon while the others were sleeping in the house",
    "fr": "le chat est sur le tapis et il regarde la lune pendant que les autres dorment dans la maison",
    "de": "die katze sitzt auf der matte und schaut den mond an während die anderen im haus schlafen",
}


def long_text() -> str:
    return " ".join(f"word{i % 997} {PROSE['en']}" for i in range(8000))


def rows() -> list[tuple]:
    out = [
        (1, PROSE["en"], "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, "  \n\t ", "en", None, 3),
        (5, long_text(), "en", "b", None),
        (6, PROSE["en"] + "\n", "en", "c", 5),
        (6, PROSE["en"] + "\n", "en", "c", 5),
        (7, "12 34 -- !!", "fr", "c", 9),
        (8, PROSE["fr"], "fr", "d", 9),
        (None, PROSE["de"], "de", "d", 9),
        (None, PROSE["de"], "de", "e", 9),
        (None, None, None, None, None),
        (9, "<|endoftext|> tail \x1c x", "en", "e", 9),
        (10, PROSE["en"].upper(), "en", "e", 2),
    ]
    return out + [(100 + 3 * i + j, f"{PROSE[k]} {i} {PROSE[k][: 20 + i]}", k, "f", 1) for i in range(30) for j, k in enumerate(PROSE)]


def messy(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in EXTRA})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
