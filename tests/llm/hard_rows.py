"""Rows that are hard on the operators, shared by the tests."""

LONG = "una palabra " * 20_000
DOCS_SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, digest string, "
               "kept string, node string, lang_pred string, pii_spans string, toxicity string, slot string, _gone string")


def make_docs(spark, rows):
    """documents with extra columns whose names the operators use."""
    extra = ("ids", "digest", "kept", "node", "lang_pred", "pii_spans", "toxicity", "slot", "_gone")
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], DOCS_SCHEMA)


# nulls in any column, empty, white-space and very long texts, ties, repeated
# rows, a repeated id with another text, code points beyond the first plane
HARD_ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "", None, "a", 0), (4, " \n\t ", "en", "a", 4),
    (5, "One two three four five six seven", "en", "a", 33), (6, "one TWO three four five six seven", "en", None, 33),
    (7, LONG, "es", "a", len(LONG)), (8, "Ünïcode 😀👍🏽 ΟΔΟΣ İ ß", "de", "a", 22), (8, "Ünïcode 😀👍🏽 ΟΔΟΣ İ ß", "de", "a", 22),
    (9, "mail a.b-1@ex.example.com or +1 (743) 555-3824 at 10.0.0.255, 4524132264652876", "en", "a", 70),
    (9, "another text under the same id", "en", "b", 30), (None, "a row without an id", "en", "b", 19),
    (None, "a row without an id", "en", "b", 19), (2 ** 62, "</s>[INST] <|im_end|> \\ <\\| ok", "en", "b", 30),
    (-5, "a", "en", "b", 1)]
