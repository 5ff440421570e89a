"""Search on four pairs of reads, with every expectation written out."""

import random
import re

import pytest

from strandframe.functions.fuzzy import Fuzzy, matches
from strandframe.operators import grep
from strandframe.plans.matching import checked_span, java_regex, plan, search
from strandframe.plans.parse import Range, Span
from strandframe.sources.patterns import Pattern, parse

READS = [("AACCGGTTAA", "GGGGGGGGGG"), ("GATTACAGAT", "CCCCAAAAAA"), ("TTTTTTTTTT", "GATTACAGAT"), ("ACGTACGTAC", "TTTTCCCCGG")]


@pytest.fixture(scope="module")
def paired(spark):
    rows = [(i, f"r{i}", s, "I" * 10, f"r{i}", x, "I" * 10) for i, (s, x) in enumerate(READS)]
    return spark.createDataFrame(rows, "idx long, s_header string, s_seq string, s_qual string, x_header string, x_seq string, x_qual string")


@pytest.fixture(scope="module")
def single(paired):
    return paired.select("idx", "s_header", "s_seq", "s_qual")


def found(df, s):
    return sorted(r.idx for r in grep.matching(df, s).collect())


CASES = [
    (search(["GATTA"]), [1, 2]),
    (search(primary=["GATTA"]), [1]),
    (search(extended=["GATTA"]), [2]),
    (search(["GATT", "CCCC"]), [1]),
    (search(["GATT", "CCCC"], logic="or"), [1, 2, 3]),
    (search(["GATT", "CCCC"], invert=True), [0, 2, 3]),
    (search(["GATT", "CCCC"], logic="or", invert=True), [0]),
    (search(["TTTT"], mate="1"), [2]),
    (search(["TTTT"], mate="2"), [3]),
    (search(["TTACA"], within=Range(2, 7)), [1, 2]),
    (search(["TTACA"], within=Range(3)), []),
    (search(["GATTA"], span=Span(2, 4)), [2]),
    (search(["^ATTA"], within=Range(1)), [1, 2]),
    (search(["TGTAATC"], rc=True), [1, 2]),
    (search(["GA(T+)A"]), [1, 2]),
    (search(["GA(T+)A"], fixed=True), []),
    (search(["r[02]$"], header=True), [0, 2]),
    (search(["GATTACA"], fuzzy=Fuzzy(0)), [1, 2]),
    (search(["GATTTACA"], fuzzy=Fuzzy(1)), [1, 2]),
    (search(["GATTACA"], fuzzy=Fuzzy(1, inexact=True)), []),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_pairs(paired, k):
    s, want = CASES[k]
    assert found(paired, s) == want


def test_single_reads(single):
    assert found(single, search(["GATTA"])) == [1]
    assert found(single, search(["TGTAATC"], rc=True)) == [1]
    assert found(single, search(["TTTT"], mate="2")) == [2]
    with pytest.raises(ValueError):
        grep.matching(single, search(extended=["GATTA"]))


def test_counts(paired):
    assert tuple(grep.count(paired, search(["GATTA"])).first()) == (2, 4, "0.5000")
    assert tuple(grep.count(paired.where("false"), search(["GATTA"])).first()) == (0, 0, "0.0000")


def names(df):
    return [(r["name"], r["count"], r.frac_total) for r in df.collect()]


def test_pattern_counts(paired):
    assert names(grep.pattern_counts(paired, search(["AAAA", "CCCC"]))) == [("AAAA", 1, 0.25), ("CCCC", 2, 0.5)]
    assert names(grep.pattern_counts(paired, search(["AAAA", "CCCC"], invert=True))) == [("AAAA", 3, 0.75), ("CCCC", 2, 0.5)]
    own = [Pattern("GGGG", "primary", "g"), Pattern("AAAA", "either", "same")]
    s = search(["AAAA"], ["TTT"], ["TTT"], own)
    want = [("TTT", 1, 0.25), ("g", 0, 0.0), ("TTT", 1, 0.25), ("AAAA", 1, 0.25), ("same", 1, 0.25)]
    assert s.logic == "or"
    for how in (None, "scan", "words", "automaton"):
        assert names(grep.pattern_counts(paired, s, how=how)) == want
    assert names(grep.pattern_counts(paired, s, 1)) == want


def test_spans_and_colours(paired):
    rows = {r.idx: r for r in grep.spans(paired, search(["TT", "TTT"], logic="or", within=Range(1))).collect()}
    assert [(s.a, s.b) for s in rows[2].s_spans][:2] == [(1, 3), (1, 4)]
    line = {r.idx: r for r in grep.highlighted(paired, search(["GATT", "TTAC"], logic="or")).collect()}[1]
    assert line.s_seq == "\x1b[31;1mGATTAC\x1b[0mAGAT" and line.s_qual == "\x1b[31;1mIIIIII\x1b[0mIIII" and line.x_seq == "CCCCAAAAAA"
    regex = {r.idx: r for r in grep.spans(paired, search(["T+A"])).collect()}
    assert [(s.a, s.b) for s in regex[1].s_spans] == [(2, 5)]


def test_empty_sequences_never_match(spark):
    df = spark.createDataFrame([(0, "", None), (1, "A", "")], "idx long, s_seq string, x_seq string")
    assert found(df, search(["^$"])) == []
    assert found(df, search([".*"])) == [1]
    assert found(df, search([""], fixed=True)) == [1]


@pytest.mark.parametrize("text", ["a(?=b)", "(?<!a)b", r"(a)\1", "a*+", "(?>a)", "a(", "[a"])
def test_refused_expressions(paired, text):
    with pytest.raises(ValueError):
        plan(search([text]), True)


def test_expressions_in_java():
    assert java_regex("a$") == "a\\z" and java_regex("[$]\\$") == "[$]\\$" and java_regex("(?P<x>a)") == "(?<x>a)"


@pytest.mark.parametrize(
    "s",
    [search(), search(["ACN"], rc=True), search(["ACG", "AC"], fuzzy=Fuzzy(1)), search(extended=["A"], mate="1")],
)
def test_refused_searches(paired, s):
    with pytest.raises(ValueError):
        plan(s, True)


def test_refused_flags():
    with pytest.raises(ValueError):
        search(["a"], header=True, rc=True)


def test_span_start_behind_the_end(paired):
    with pytest.raises(ValueError):
        checked_span(paired, Span(5, 9))
    assert checked_span(paired, Span(3, 1)).count() == 0 and checked_span(paired, Span(1, 99)).count() == 3


FUZZY = [
    ("ACGTACGT", "TTACGAACGTTT", Fuzzy(0), False),
    ("ACGTACGT", "TTACGAACGTTT", Fuzzy(1), True),
    ("AAAAAAAA", "GGGGAAAAAAAATTTT", Fuzzy(2, inexact=True), False),
    ("AAAAAAAA", "GGGGAAAAACAATTTT", Fuzzy(2, inexact=True), True),
    ("ACGTACGTACGT", "N" * 18, Fuzzy(1), False),
    ("ACGTACGTACGT", "N" * 18, Fuzzy(1, max_n_frac=1.0), True),
    ("AAAAAAAA", "GGGGAAAAAAANTTTT", Fuzzy(1, max_n_frac=0.0), False),
]


@pytest.mark.parametrize(("pattern", "text", "how", "want"), FUZZY)
def test_edit_distance(pattern, text, how, want):
    assert bool(matches([text], pattern, how)[0]) == want


def test_edit_distance_equals_substrings():
    """Without N, a match within k is a substring within k."""
    import random

    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(60):
        pattern = "".join(rng.choice("ACGT") for _ in range(5))
        texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 14))) for _ in range(4)]
        k = rng.randint(0, 2)
        for t, got in zip(texts, matches(texts, pattern, Fuzzy(k)), strict=True):
            subs = {t[i:j] for i in range(len(t) + 1) for j in range(i, len(t) + 1)}
            assert bool(got) == (min(distance(pattern, s) for s in subs) <= k)
            assert all(distance(pattern, t[a:b]) == c for a, b, c in got)


def test_pattern_files():
    assert parse(">alpha x\nGAT\nTA\n>beta\nAAAA\n") == [Pattern("GATTA", "either", "alpha"), Pattern("AAAA", "either", "beta")]
    assert parse("x\tGATTA\ny\tCCCC\n", "primary") == [Pattern("GATTA", "primary", "x"), Pattern("CCCC", "primary", "y")]
    assert parse("GATTA\n\n  \nCCCC\n") == [Pattern("GATTA"), Pattern("CCCC")]
    assert parse("") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[[:digit:]]{2}", ["r10", "x99y"]), ("r[^[:digit:]]", ["dr g"]), ("[[:alpha:]_]{5}", ["digit"]), (r"\pN\pN", ["r10", "x99y"]), (r"\p{Greek}", ["αβ"]), (r"\p{Lu}", ["ÄB"]),
        (r"[]x]9", ["x99y"]), (r"(?P<a>r)1", ["r10"]), ("(?<a>x)9", ["x99y"]), ("[[:^alpha:]]g", ["dr g"]),
    ],
)
def test_classes_and_groups(spark, text, want):
    texts = ["r10", "digit", "x99y", "αβ", "ÄB", "dr g", ""]
    df = spark.createDataFrame([(i, t, "A") for i, t in enumerate(texts)], "idx long, s_header string, s_seq string")
    got = [r.s_header for r in grep.matching(df, search([text], header=True)).orderBy("idx").collect()]
    assert got == want


@pytest.mark.parametrize("text", ["AC", "A[CG]", "(?<x>AC)G?", "A*", "G|", "C$", "^A", "N+?", "(AC)+"])
def test_regex_spans_equal_a_plain_version(spark, text):
    rng = random.Random(3)
    seqs = ["", "A", "AC", "ACAC", "NNN", *("".join(rng.choice("ACGN") for _ in range(rng.randint(1, 40))) for _ in range(60))]
    df = spark.createDataFrame([(i, f"h{i}", t) for i, t in enumerate(seqs)], "idx long, s_header string, s_seq string")
    got = {r.idx: [(x.a, x.b) for x in r.s_spans] for r in grep.spans(df, search([text])).collect()}
    plain = re.compile(text.replace("(?<x>", "(?P<x>").replace("$", r"\Z"))
    for i, t in enumerate(seqs):
        want, last = [], -1
        for m in plain.finditer(t):
            if m.start() < m.end() or m.start() != last:
                want.append((m.start(), m.end()))
            last = m.end()
        assert got.get(i, []) == (want if t else []), (text, t)


def test_one_long_read_among_many_needs_little_memory():
    import resource

    from strandframe.functions import fuzzy

    texts = ["ACGT" * 40] * 4096 + ["ACGTTTGA" * 125_000]
    most = max(max(len(texts[k]) for k in own) * len(own) for own in fuzzy.groups(texts))
    assert most <= 1_000_000 and sorted(k for own in fuzzy.groups(texts) for k in own) == list(range(len(texts)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = fuzzy.matches([texts[0], "ACGTTTGA" * 12_500], "GATTTG", fuzzy.Fuzzy(1))
    assert len(found) == 2 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_positions_of_a_long_read(spark):
    from strandframe.operators import qc

    rows = [(i, "ACGN"[: 1 + i % 4]) for i in range(50)] + [(50, "AC" * 10_000)]
    df = spark.createDataFrame(rows, "idx long, s_seq string").repartition(2)
    got = {r.pos: (r.a, r.c, r.n) for r in qc.base_content(df).collect()}
    assert len(got) == 20_000 and got[0] == (51, 0, 0) and got[19_999] == (0, 1, 0) and got[19_998] == (1, 0, 0) and got[1] == (0, 38, 0)
