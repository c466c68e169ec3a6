from llm_data import MEDIUM, documents  # noqa: F401

from drillsight.llm import language_id


def test_plain_letters():
    assert language_id.plain("Été 12 — OK!") == "été — ok".encode()
    assert language_id.plain("12 !? ---") == b"" == language_id.plain(None) == language_id.plain("— … 🙂")


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = language_id.query(spark, MEDIUM).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 0.2 < len(held) / len(rows) < 0.3
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, documents):  # noqa: F811
    rows = [(k, "the quick brown fox jumps over the lazy dog " * 3, "en") for k in range(5)]
    rows += [(10 + k, "der schnelle braune Fuchs springt über den faulen Hund " * 3, "de") for k in range(5)]
    odd = [(20, None, "en"), (21, "", "de"), (22, "123 !!!", "de"), (23, "the lazy dog jumps over the fox"), (24, "springt der Hund über den Fuchs " * 500), (None, "the fox"), (25, "the dog"), (25, "the dog")]
    docs = documents(rows + odd)
    learned = language_id.learn(docs)
    assert sorted(learned) == ["de", "en"]
    done = language_id.identify(docs, learned)
    got = {r["doc_id"]: r for r in done.collect()}
    assert [got[k]["lang_pred"] for k in (0, 10, 20, 21, 22, 23, 24)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert got[20]["score"] == 0 and got[20]["rejected"] and not got[24]["rejected"]
    assert done.count() == len(rows + odd) and done.filter("doc_id = 25").count() == 2
    assert language_id.identify(documents([]), learned).count() == 0
    nothing = language_id.learn(documents([]))
    assert nothing == {} and {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_ties_are_rejected(spark, documents):  # noqa: F811
    rows = [(k, "same words here", lang) for k, lang in enumerate("abbcc")]
    learned = language_id.learn(documents(rows))
    assert list(learned) == ["b", "c", "a"]
    row = language_id.identify(documents([(1, "same words")]), learned).collect()[0]
    assert (row["lang_pred"], row["margin"], row["rejected"]) == ("b", 0.0, True)


def test_bodies_of_distinct_texts_teach(spark, documents):  # noqa: F811
    """All documents open with one long header; most rows of a language are copies of one text."""
    header = "permission is hereby granted free of charge to any person " * 20
    bodies = {"en": "quick brown foxes jump over lazy dogs ", "de": "schnelle braune hunde springen weit "}
    rows = [(100 * n + k, header + (body + f"{chr(97 + k)} ") * 200, lang) for n, (lang, body) in enumerate(bodies.items()) for k in range(20)]
    rows += [(1000 + k, "copied again and again " * 40, "en") for k in range(500)]
    learned = language_id.learn(documents(rows), docs_each=21, bytes_each=500)
    assert b"lazy dogs" in learned["en"] and b"braune hunde" in learned["de"]
    assert 0 < learned["en"].count(b"copied") <= 25
