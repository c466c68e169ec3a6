import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import SMALL, documents  # noqa: F401
from pyspark.sql import functions as F

from drillsight.llm import fill_middle

ALPHABET = "ab Z\n\t<>PSM$\\é𝒳1{}"


def by_hand(key, text, seed=1, rate=90, suffix_first=20):
    """``n, form, output, prefix, middle`` with plain loops."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    draws = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted(d % (len(units) + 1) for d in draws[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    if draws[3] % 100 < suffix_first:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def compare(docs, rows, **how):
    made = fill_middle.rearrange(docs, **how)
    got = made.select(
        "doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars",
        fill_middle.restore(F.col("output"), F.col("form")).alias("back"),
    ).collect()
    want = sorted([(k, t, *by_hand(k, t, **how)) for k, t in rows], key=repr)
    assert sorted([tuple(r)[:-1] for r in got], key=repr) == want
    assert all(r["back"] == (r["text"] or "") for r in got)
    return made


def test_edges(spark, documents):
    rows = [(1, None), (2, ""), (3, "a"), (None, "no key at all"), (None, None), (4, "has <P> in it"), (5, "<M>"), (6, "< P><"), (7, "same"), (7, "same")]
    rows += [(k, "tail ends in < and $1 \\ {2}" * (k % 5)) for k in range(10, 60)]
    made = compare(documents(rows), rows)
    assert {"ids", "fp", "mark", "rank"} <= set(made.columns)
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}
    assert fill_middle.rearrange(documents([])).count() == 0


def test_other_settings(spark, documents):
    rows = [(k, f"word {k} and more") for k in range(40)]
    for how in ({"rate": 0}, {"rate": 100, "suffix_first": 100, "seed": 7}):
        compare(documents(rows), rows, **how)


def test_result_columns_replace_those_of_the_input(spark, documents):
    clash = documents([(1, "a b c")]).withColumns({c: F.lit("x") for c in ("n", "form", "output", "page url", "a:b")})
    row = fill_middle.rearrange(clash).first()
    assert (row["n"], row["output"]) == by_hand(1, "a b c")[::2][:2] and row["page url"] == "x"


def test_very_long_texts(spark, documents):
    rows = [(k, "ab, " * 400_000 + "𝒳" * k) for k in range(8)] + [(99, "x" * 1_000_000)]
    compare(documents(rows), rows)


def test_random_texts(spark, documents):
    seen = []

    @settings(max_examples=300, database=None, deadline=None)
    @given(st.integers(0, 10**9), st.text(ALPHABET, max_size=60))
    def collect(key, text):
        seen.append((key, text))

    collect()
    compare(documents(seen), seen)


def test_query_has_one_row_per_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {}
    for r in docs:
        n, form, output, prefix, middle = by_hand(r["doc_id"], r["text"])
        want[r["doc_id"]] = (n, form, prefix, middle, *(hashlib.sha256(x.encode()).hexdigest() for x in (output, r["text"] or "")))
    assert {r[0]: tuple(r)[1:] for r in fill_middle.query(spark, SMALL).collect()} == want
