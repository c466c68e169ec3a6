"""Small tables for the tests of this folder."""

import pytest

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"

#: Names the operators use themselves; inputs may have them too.
CLASHING = (
    "ids", "fp", "mark", "score", "kept", "row", "part", "id", "rest", "host", "lines", "rank",
    "_id", "_mark", "_root", "_host", "_removed", "page url", "a:b",
)


@pytest.fixture(scope="session")
def documents(spark):
    """``documents(rows)`` of ``(doc_id, text[, lang[, source]])``, with columns of clashing names."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        odd = F.struct(F.lit(1).alias("page url"), F.lit("x").alias("a:b"))
        return df.withColumns({c: F.lit("x") for c in CLASHING} | {"nested": odd})

    return make
