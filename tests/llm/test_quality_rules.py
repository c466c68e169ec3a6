import random
import re

import duckdb
from llm_data import SMALL, documents  # noqa: F401

from drillsight.llm import quality_rules, sql

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def naive(text):
    words = WORDS.findall(text)
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k for found in places.values() if len(found) > 1 for p in found for k in range(p, p + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_figures():
    draw = random.Random(1)
    texts = ["", "\n\n", "a", "x  y\tz\x0b\x0c", "é # ü|<>", " a b", "w " * 30, "\n a\n a\na\n"]
    texts += [draw.choice([" ", "\n"]).join(draw.choice("ab c# é") for _ in range(draw.randrange(200))) for _ in range(300)]
    texts += [" ".join(draw.choice("abc") for _ in range(draw.randrange(8, 60))) for _ in range(300)]
    for text in texts:
        assert quality_rules.base_figures(text) == naive(text), repr(text)


def words(k, n=40):
    """Words of their own for each ``k``; digits would count as equal."""
    name = "".join(chr(97 + int(d)) for d in str(abs(k))) + ("z" if k < 0 else "")
    return " ".join(f"{name}x{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(n))


def test_frequent_lines_go(spark, documents):  # noqa: F811
    menu = "Home | About | page 1"
    rows = [(k, f"{words(k)}\n{menu.replace('1', str(k % 10))}\n{words(-k - 1)}", None, "a") for k in range(40)]
    rows += [(100 + k, f"{words(k + 500, 12)}\n" + "\n".join(["  HOME | about | PAGE 7 "] * 9), None, "a") for k in range(2)]
    rows += [(200, f"{words(900)}\n{menu}", None, "b"), (201, None, None, "a"), (202, "", None, None), (None, words(7), None, None)]
    rows += [(300, f"{words(901)}\nonly in copies", None, "c")] * 60
    docs = documents(rows)
    got = {}
    for r in quality_rules.judge(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert all(got[k][0]["removed_lines"] == [1] and got[k][0]["kept"] for k in range(40))
    assert got[100][0]["words_left"] == 12 and got[100][0]["base_failed"] is True
    assert got[200][0]["removed_lines"] == [] and got[200][0]["kept"]
    assert len(got[300]) == 60 and all(r["kept"] and r["removed_lines"] == [] for r in got[300])
    assert not got[201][0]["kept"] and not got[202][0]["kept"] and got[None][0]["kept"]
    clean = quality_rules.cleaned(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[3] == f"{words(3)}\n{words(-4)}" and 201 not in texts and 100 not in texts
    assert clean.filter("doc_id = 300").count() == 60


def test_depleted_documents_go(spark, documents):  # noqa: F811
    shared = "\n".join(words(1000 + j, 10) for j in range(5))
    rows = [(k, f"{words(k, 12)}\n{shared}", None, "a") for k in range(30)] + [(99, words(99), None, "a")]
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(rows)).collect()}
    assert all(not got[k]["kept"] and not got[k]["base_failed"] and got[k]["words_left"] == 12 for k in range(30))
    assert got[99]["kept"]
    assert quality_rules.judge(documents([])).count() == 0


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in quality_rules.query(spark, SMALL).collect():
        want = naive(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_copies_do_not_raise_the_limit(spark, documents):  # noqa: F811
    """25 of 41 distinct texts share a line; with 900 copies of one of them the host has 940 rows."""
    rows = [(k, words(k) + ("\nhome and about" if k < 25 else ""), None, "a") for k in range(40)]
    rows += [(1000 + k, words(700), None, "a") for k in range(900)]
    got = {r["doc_id"]: r["removed_lines"] for r in quality_rules.judge(documents(rows)).collect()}
    assert all(got[k] == ([1] if k < 25 else []) for k in range(40)) and got[1000] == []


def test_sql_says_the_same(spark, tmp_path):
    """On hosts full of copies, lines with digits of other scripts, and the sample itself."""
    rows = [(k, words(k) + ("\nhome and about ٣" if k < 25 else ""), "a") for k in range(40)]
    rows += [(1000 + k, words(700), "a") for k in range(900)]
    rows += [(2000 + k, words(k + 40) + f"\nhome and about {k % 10}", None) for k in range(30)] + [(5000, None, "b"), (5001, "", None)]
    folder = tmp_path / "tables"
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    cursor = con.execute(sql.QUALITY_RULES)
    names = sorted(d[0] for d in cursor.description)
    want = sorted(tuple(dict(zip([d[0] for d in cursor.description], r))[n] for n in names) for r in cursor.fetchall())
    got = quality_rules.query(spark, str(folder)).select(names).collect()
    assert sorted(map(tuple, got)) == want and sum(r["lines_removed"] for r in got) == 55


def test_a_very_long_text(spark, documents):  # noqa: F811
    text = "\n".join(f"{words(k, 8)}" for k in range(20_000)) + "\n" + "x" * 500_000
    row = quality_rules.judge(documents([(1, text), (2, words(1))])).filter("doc_id = 1").first()
    assert (row["n_words"], row["n_dup_lines"], row["kept"]) == (160_001, 0, True)
