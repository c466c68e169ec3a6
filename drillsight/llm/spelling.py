"""Spelling variants of the words of a corpus, by PartEnum signatures of letter multisets.

A word is the binary vector of its letters with their count (``e1, e2, ...``).  One replaced
letter changes two places of that vector, an inserted or deleted one changes one.  The places are
dealt to partitions by hash; two vectors at distance k agree in all but k partitions, so they
share the signature of some choice of ``partitions - k`` of them.  All choices are enumerated, and
words that share a signature are joined and verified by their edit distance:

* words of one length at distance two: four partitions, the six pairs of them;
* words whose lengths differ by one, at distance one: two partitions, each alone.

Multisets forget the order of letters, so anagrams would be candidates by the thousand.  As one
edit leaves one half of a word as it is, a signature also holds the length and the first, or
the last, half of the word; that drops no pair, and a pair is found by either half.  A
signature is a 64-bit hash, on which the words are dealt out; a collision costs a comparison.

Rules: words are compared in code points.  A word's near words are those one edit away; its
form is the near word of largest count (ties: the smallest in code-point order) if that is
at least ``ratio`` times the word's own; its root is where the chain of forms ends (counts rise
along it, so it does).  Null texts have no words, an empty table gives no rows, repeated rows count
as often as they are there, null ids count as empty text in the query.  Columns beside the key
and the text are not read.  Words are counted before they move, so frequent words, copies and very
long texts cost no more than others; no word, pair or candidate is left out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.llm.common import table
from drillsight.session import stage

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Partitions of a vector by the distance looked for.
PARTITIONS = {1: 2, 2: 4}
#: Letters of a word, as a class of regular expressions.
LETTER = "[A-Za-zÀ-ÿ]"
#: One run in so many is misspelt by the query, and which are is told by a checksum.
MISSPELT = 31

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """``key, run``: maximal runs of at least ``least`` letters, A-Z in lower case, repeats included.

    Shorter runs are passed over inside the expression, so they never become rows.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"{LETTER}{{{least},}}+"), F.lit(0))
    return docs.select(F.col(key).alias("key"), F.explode(found).alias("run")).withColumn(
        "run", F.translate("run", _UPPER, _LOWER)
    )


def misspelt(rows: DataFrame, one_in: int = MISSPELT) -> DataFrame:
    """``word`` of each run: a letter is deleted where ``one_in`` divides the checksum of key and run."""
    mark = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (mark % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return rows.select(F.when(mark % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of a table of words with repeats."""
    long_enough = words.filter(F.char_length("word") >= least_letters)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def signatures(words: DataFrame, distances: dict[int, int] = PARTITIONS) -> DataFrame:
    """``words`` with ``sig<k>``: for distance k an array of one hash for each choice of partitions
    that two vectors may agree in.  Each projection uses the one before more than once, so they
    are not folded into one."""
    kept = words.columns
    lettered = words.withColumn("letters", F.sort_array(F.split("word", "")))
    # A place is a letter and its count so far in the sorted word.
    place = F.transform("letters", lambda x, i: F.xxhash64(x, i - F.array_position("letters", x)))
    placed = lettered.select(*kept, place.alias("places"))

    def folded(count: int, part: int) -> Column:
        """The places of one partition as one number."""
        return F.aggregate(
            "places",
            F.lit(0).cast("long"),
            lambda a, h: F.when(F.pmod(h, F.lit(count)) == part, a.bitwiseXOR(h)).otherwise(a),
        )

    parts = [folded(count, p).alias(f"part{k}_{p}") for k, count in distances.items() for p in range(count)]
    chosen = [
        F.array(
            *[
                F.xxhash64(F.lit(sum(1 << p for p in choice)), *[f"part{k}_{p}" for p in choice])
                for choice in combinations(range(count), count - k)
            ]
        ).alias(f"sig{k}")
        for k, count in distances.items()
    ]
    return placed.select(*kept, *parts).select(*kept, *chosen)


#: What a word is in a pair: of one length with the other, the shorter, the longer.
_EQUAL, _SHORTER, _LONGER = 0, 1, 2
_ROLES = 4


def _keyed(words: DataFrame) -> DataFrame:
    """``key, role, word, n``: the signatures of each word, each with a half and the pair's length.

    Of two words of length s, one edit apart, floor(s / 2) letters agree in front or at the
    end; of lengths s and s + 1, ceil(s / 2).
    """
    size = F.char_length("word")
    floor, ceiling = F.floor(size / 2).cast("int"), F.ceil(size / 2).cast("int")

    def keys(role: int, distance: int, shorter: Column, half: Column) -> Column:
        halves = (F.concat(F.lit("<"), F.substring("word", F.lit(1), half)), F.concat(F.lit(">"), F.right("word", half)))
        def of_half(half: Column) -> Column:
            beside = F.xxhash64(F.lit(distance), shorter, half)
            return F.transform(
                f"sig{distance}", lambda s: F.struct(F.xxhash64(s, beside).alias("key"), F.lit(role).alias("role"))
            )

        return F.concat(*map(of_half, halves))

    every = F.concat(
        keys(_EQUAL, 2, size, floor), keys(_SHORTER, 1, size, ceiling), keys(_LONGER, 1, size - 1, floor)
    )
    return signatures(words.select("word", "n")).select(F.inline(every), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` of ``word, n``: words one edit apart, in both directions, each once."""
    keyed = _keyed(words)
    a, b = (keyed.select("key", *[F.col(c).alias(c + x) for c in ("role", "word", "n")]) for x in "ab")
    # One number for both roles, so that neither side gets a filter of its own and both read
    # one exchange.  A merge join, whatever size is estimated for the many keys of few words.
    roles = F.col("rolea") * _ROLES + F.col("roleb")
    fit = (roles == _EQUAL * _ROLES + _EQUAL) & (F.col("worda") < F.col("wordb")) | (roles == _SHORTER * _ROLES + _LONGER)
    pairs = a.join(b.hint("merge"), "key").filter(fit & (F.levenshtein("worda", "wordb", 1) == 1))
    ways = [
        F.struct(F.col(f"word{x}").alias("word"), F.col(f"n{x}").alias("n"), F.col(f"word{y}").alias("near"), F.col(f"n{y}").alias("near_n"))
        for x, y in ("ab", "ba")
    ]
    # Dealt out by word, the rows of a word also meet to be counted.
    return pairs.select(F.inline(F.array(*ways))).repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms are followed to the last, in steps that double."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
        now = stage(moved, "roots")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, form, root, n_near, form_n`` of ``word, n``."""
    words = stage(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.least")
    taken = form_n >= ratio * F.col("n")
    told = stage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.when(taken, F.col("best.near")).alias("form"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, form_n).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Variants of the words of all documents, one run in 31 misspelt."""
    return variants(counted(misspelt(runs(table(spark, folder, "documents")))))
