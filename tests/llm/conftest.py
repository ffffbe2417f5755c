import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash with internal ones."""

    def of(rows, **more):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        clash = {n: F.lit("x") for n in ("fp", "u", "v", "score", "ids", "n", "rep", "size", "row", "key", "kind", "label", "copies")}
        return df.withColumns(clash | more)

    return of
