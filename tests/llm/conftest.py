import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASH = "k long, n long, sig string, score string, leaks string, n_tokens string, _t string, kind string, root string, cluster string, w string, c string, _text string, lang_pred string"

PROSE = [
    "The quick brown fox jumps over the lazy dog while seven kind people watch from the old bridge and say nothing at all today.",
    "Un renard brun saute par dessus le chien paresseux pendant que sept personnes regardent depuis le vieux pont sans rien dire.",
    "Der schnelle braune Fuchs springt über den faulen Hund während sieben Leute von der alten Brücke schauen und nichts sagen.",
]


@pytest.fixture(scope="session")
def frame(spark):
    """rows of (doc_id, text[, lang, source]) -> documents."""

    def make(rows, clash=False):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], SCHEMA)
        if clash:
            for c in CLASH.split(", "):
                name, kind = c.rsplit(" ", 1)
                df = df.selectExpr("*", f"cast(7 as {kind}) as `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, repeated rows, a null id, ties, a very long text, and hard runs of characters."""
    return [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", None), (4, PROSE[0], "en", "a"), (4, PROSE[0], "en", "a"), (None, PROSE[1], "fr", "b"),
        (6, PROSE[0], "en", "a"), (7, PROSE[2] * 40, "de", None), (8, "word " * 30_000, "en", "a"), (9, "1" * 20_000, None, "a"), (10, "a" * 20_000 + "@", "en", "a"),
        (11, "naïve ½ 日本語 😀 <|endoftext|>   x\x0by\x1cz", "en", "a"), (12, "!!! ???", "en", "a"), (13, "two words", "en", "a"), (14, "\n\n" + PROSE[1] + "\n\n", "fr", "b"),
    ]
