"""Column functions on hand-made values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from drillsight.functions import agents, network, people, rates, text
from drillsight.functions.messages import split_headers, split_messages


def test_three_kinds_of_missing(apply):
    values = [(None,), ("",), ("  ",), (" a ",)]
    assert apply(text.empty_to_null, *values) == [None, None, "  ", " a "]
    assert apply(text.nonblank, *values) == [False, False, False, True]
    assert apply(people.department_or_unknown, *values) == ["Unknown", "Unknown", "Unknown", "a"]
    assert apply(lambda c: text.or_else(c, F.lit("d")), *values) == ["d", "d", "  ", " a "]


def test_trims(apply):
    padded = "\t\n\r  ﻿x y 　\n"
    assert apply(text.web_trim, (padded,)) == ["x y"]
    assert apply(text.normalize_email, (" A@X.com\t",)) == ["a@x.com"]
    assert apply(lambda c: F.trim(c), ("\tx ",)) == ["\tx"]


def test_user_agents(apply):
    cases = {
        "(Windows NT 10.0) Chrome/120 Safari/537 Edg/120": "Edge / Windows",
        "Chrome/120 Safari/537 OPR/99": "Opera / Unknown OS",
        "Opera 12 (Mac OS X)": "Opera / macOS",
        "(X11; Linux) Chrome/120 Safari/537": "Chrome / Linux",
        "(Linux; Android 14) Firefox/121": "Firefox / Android",
        "(iPhone; like Mac OS X) Version/17 Safari/604": "Safari / iOS",
        "(iPad; like Mac OS X) Safari/604": "Safari / iOS",
        "curl/8.0": "Unknown Browser / Unknown OS",
        "edg/ chrome/": "Unknown Browser / Unknown OS",
        "": "—",
        None: "—",
    }
    assert apply(agents.parse_user_agent, *[(c,) for c in cases]) == list(cases.values())


def test_whole_percent_rounds_halves_up_from_the_double(apply):
    rows = [(1, 200), (5, 200), (0, 0), (3, 2), (29, 200), (7, 0)]
    # 29/200*100 is 14.499999999999998 in doubles, which web clients show as 14.
    assert apply(rates.percent_whole, *rows, types=["long", "long"]) == [1, 3, 0, 150, 14, 0]


def test_tenth_percent_is_exact(apply):
    rows = [(247, 2000), (1, 3), (0, 7), (0, 0), (13, 10), (1, 2000)]
    assert apply(rates.percent_tenth, *rows, types=["long", "long"]) == [12.4, 33.3, 0.0, 0.0, 130.0, 0.1]


def test_one_decimal_follows_the_exact_value(apply):
    values = [0.15, 0.25, 106.25, 0.35, 2.5, 0.05, 1.45, 8.345, 20.0, 0.0]
    want = ["0.1", "0.3", "106.3", "0.3", "2.5", "0.1", "1.4", "8.3", "20.0", "0.0"]
    assert apply(rates.one_decimal, *[(v,) for v in values], types=["double"]) == want


def test_one_decimal_against_decimal_arithmetic(apply):
    from decimal import ROUND_HALF_UP, Decimal

    values = [c / s * 100 for s in (7, 80, 200, 800, 2000) for c in range(0, 2 * s, 3)]
    want = [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
    assert apply(rates.one_decimal, *[(v,) for v in values], types=["double"]) == want


def test_bands(apply):
    assert apply(rates.rate_band, (20.0,), (20.1,), (40.0,), (40.1,), types=["double"]) == [
        "green", "amber", "amber", "red",
    ]
    days = [(30,), (31,), (160,), (161,), (None,)]
    assert apply(rates.days_band, *days, types=["long"]) == ["low", "mid", "mid", "high", "none"]
    assert apply(rates.clicked_flag, (0,), (1,), types=["long"]) == ["No", "Yes"]


def test_names(apply):
    rows = [("A", "B", "e"), ("", "B", "e"), (None, None, "e"), ("", "", None), ("A", None, "")]
    assert apply(people.display_name, *rows) == ["A B", "B", "e", None, "A"]
    pairs = [("A", "B"), ("", "B"), (None, None), (" ", None), ("A", "")]
    assert apply(people.short_name, *pairs) == ["A", "B", "Employee", " ", "A"]
    assert apply(people.full_name, *pairs) == ["A B", "B", "Employee", "Employee", "A"]


def test_short_label(apply):
    assert apply(lambda c: text.short_label(c, 20), ("x" * 20,), ("x" * 21,)) == ["x" * 20, "x" * 20 + "…"]


def test_profiles(apply):
    rows = [('{"location":"Rome","notes":null}',), ("",), (None,), ("broken",), ('{"other":1}',)]
    parsed = apply(people.parse_profile, *rows)
    assert [p and p["location"] for p in parsed] == ["Rome", None, None, None, None]
    assert [p is None for p in parsed] == [False, True, True, True, False]

    def stored(c, flag):
        return people.profile_text(people.parse_profile(c), flag)

    kept, dropped = apply(stored, (rows[0][0], True), (rows[0][0], False), types=["string", "boolean"])
    assert kept == (
        '{"linkedin":"","social":"","location":"Rome","manager":"","interests":"","projects":"","notes":""}'
    )
    assert dropped is None


def test_addresses(apply):
    rows = [("9.9.9.9, 1.1.1.1", "2"), (None, "2.2.2.2"), ("", "2.2.2.2"), (" , 1", "2"), (None, None)]
    assert apply(network.client_ip, *rows) == ["9.9.9.9", "2.2.2.2", "2.2.2.2", "", ""]
    empty = hashlib.sha256(b"").hexdigest()
    assert apply(network.hash_ip, (None,), ("",), ("1.1.1.1",)) == [
        empty, empty, hashlib.sha256(b"1.1.1.1").hexdigest(),
    ]


def test_day_of(apply):
    assert apply(network.day_of, ("2024-01-01T23:59:59.999Z",)) == ["2024-01-01"]
    assert apply(lambda c: network.day_of(c.cast("timestamp_ntz")), ("2024-01-01 23:59:59",)) == ["2024-01-01"]


def test_tracking_keys(apply):
    def key(c, r):
        return network.tracking_key(c, r, "s")

    keys = apply(key, (1, 23), (12, 3), (1, 23), types=["long", "long"])
    assert len(keys[0]) == 48 and keys[0] == keys[2] != keys[1]
    other = apply(lambda c, r: network.tracking_key(c, r, "t"), (1, 23), types=["long", "long"])
    assert other != keys[:1]


def test_csv_quote_and_links(apply):
    assert apply(text.csv_quote, ('a"b',), ("",)) == ['"a""b"', '""']
    row = ("see HTTPS://a.b/c?d now, http://x\nhttps:// y",)
    assert apply(text.neutralize_links, row) == ["see [SIMULATED LINK] now, [SIMULATED LINK]\nhttps:// y"]
    assert apply(lambda c: text.neutralize_links(c, "$1\\"), ("http://x y",)) == ["$1\\ y"]
    assert apply(text.count_links, row) == [2]
    assert apply(text.neutralize_links, ("http://a b",)) == ["[SIMULATED LINK] b"]


def test_prefixes(apply):
    label = text.TRAINING_LABEL
    assert apply(text.ensure_prefix, ("x",), (label + " x",), (None,)) == [
        label + "\n\nx", label + " x", label + "\n\n",
    ]
    strip = lambda c: text.strip_prefixes(c, ["AA", "B", ""])
    assert apply(strip, ("AA \n x",), ("AA B y",), ("BAA z",), (None,)) == ["x", "y", "AA z", ""]


def test_nonempty_join(apply):
    join = lambda a, b: text.nonempty_join(" — ", a, b)
    assert apply(join, ("x", "y"), ("", "y"), (None, "y"), (None, "")) == ["x — y", "y", "y", ""]


MESSAGES = [
    ("SIMULATION x\r\n\r\nfrom: a@b\r\nSUBJECT: s\r\nbody", ("a@b", "s", "body")),
    ('{"subject":"s","body":"http://b"}', ("d", "s", "http://b")),
    (' {"from":"f","subject":"","body":"b"} ', ("f", "(No Subject)", "b")),
    ('{"from":"f"}', ("d", "(No Subject)", '{"from":"f"}')),
    ("no headers http://x here", ("d", "(No Subject)", "no headers [SIMULATED LINK] here")),
    ("", ("d", "(No Subject)", "")),
    (None, ("d", "(No Subject)", "")),
    # Only the first such line is a header, and only it goes.
    ("Subject: one\ntext\nSubject: two", ("d", "one", "text\nSubject: two")),
    # A header without a value takes the next line.
    ("From:\n  me\nrest", ("me", "(No Subject)", "rest")),
    # Not at the start of a line, so no header; the same text earlier in a line goes first.
    ("see From: x there", ("d", "(No Subject)", "see From: x there")),
    ("say From: x\n\nFrom: x", ("x", "(No Subject)", "say From: x")),
    # Nothing but headers: the text stays the body.
    ("From: x", ("x", "(No Subject)", "From: x")),
    ("a simulation\nSIMULATION b", ("d", "(No Subject)", "a simulation\nSIMULATION b")),
]


@pytest.mark.parametrize("message,want", MESSAGES)
def test_messages(spark, message, want):
    df = spark.createDataFrame([(message,)], "m string")
    row = split_messages(df, "m", "d").first()
    assert (row["from"], row["subject"], row["body"]) == want


def test_headers_of_plain_text_keep_links(spark):
    df = spark.createDataFrame([("From: a\nSubject: b\nhttp://x",)], "m string")
    row = split_headers(df, "m").first()
    assert (row["from"], row["subject"], row["body"]) == ("a", "b", "http://x")


def test_strict_objects(apply):
    from drillsight.functions.text import strict_object

    texts = [
        '{"a":"1"}', ' {"a":"1"} ', '{"a":"1","a":"2"}', "{}", '{"a":"1"} tail http://x', '{"a":"1"}] tail',
        '{"a":"1"}} tail', '{"a":"1"}] tail}', '{"a":"1"}, {"a":"2"}', "[1]", '"x"', '{"a":', "", None, "{'a':1}",
    ]
    got = apply(lambda c: strict_object(c, "a: string"), *[(t,) for t in texts])
    assert [None if x is None else x["a"] for x in got] == ["1", "1", "2", None] + [None] * 11
    assert got[3] is not None
