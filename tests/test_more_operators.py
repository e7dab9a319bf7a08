"""Quantiles without sorting a group together, keywords by containment, file choice, statuses, labels and odd requests."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from planlens.functions import labels
from planlens.operators import parity, planner, selection
from planlens.operators.quantiles import exact_quantiles, slice_of
from planlens.plans import validation
from planlens.sources import ingest, staging


def linear(values, p):
    values, place = sorted(values), p * (len(values) - 1)
    low = int(place)
    return values[low] if place == low else values[low] * (1 - (place - low)) + values[low + 1] * (place - low)


def test_exact_quantiles(spark):
    rng = random.Random(3)
    groups = {
        "ties": [rng.choice([1.0, 1.0, 2.5, -3.0]) for _ in range(300)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(500)],
        "near": [1 + rng.random() * 1e-9 for _ in range(200)],
        "zeros": [0.0] * 5 + [-1.0, 1.0],
        "one": [7.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    ps = {"lo": 0.05, "q": 0.25, "mid": 0.5, "hi": 0.95, "top": 1.0}
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ps).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in ps.items():
            assert got[g][name] == pytest.approx(linear(vs, p), rel=1e-12)
    assert got["near"].mid == pytest.approx(statistics.median(groups["near"]), rel=1e-14)
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", ps).count() == 0


def test_slices_never_fall(spark):
    values = sorted([-1e308, -3.0, -1.0, -5e-324, 0.0, 5e-324, 1e-9, 0.5, 1.0, 1.01, 2.0, 1e308])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").orderBy("v").select(slice_of(F.col("v"))).collect()]
    assert got == sorted(got)


def test_keywords_by_containment(spark):
    names = spark.createDataFrame([(1, ["불빛", "공룡"]), (2, ["불빛"]), (3, ["국제불빛"]), (4, ["공룡"]), (5, ["공룡불빛", "없음"])], "id int, tokens array<string>")
    vocab = planner.vocabulary(names)
    assert {(r.token, r.df, r.first_seen) for r in vocab.collect()} == {("불빛", 2, 1), ("공룡", 2, 1)}
    got = {(r.id, r.keyword) for r in planner.keywords(names, vocab).collect()}
    assert got == {(1, "불빛"), (1, "공룡"), (2, "불빛"), (3, "불빛"), (4, "공룡"), (5, "공룡"), (5, "불빛")}


def test_names_with_unicode_blanks(spark):
    got = spark.createDataFrame([("제　3　회　불빛 2024 년 축제",)], "n string").select(planner.tokens(F.col("n"), planner.removal_terms([], []))).first()[0]
    assert got == ["불빛"]


def test_files(spark, tmp_path):
    for name in ("a_2024년.csv", "b_2026 년.csv", "c.csv"):
        (tmp_path / name).write_text(name)
    files = ingest.fingerprints(spark, str(tmp_path))
    assert {r.sha256 for r in files.collect()} == {hashlib.sha256(n.encode()).hexdigest() for n in ("a_2024년.csv", "b_2026 년.csv", "c.csv")}
    names = spark.createDataFrame([(n,) for n in ("a_2024년.csv", "b_2026 년.csv", "c.csv")], "path string")
    assert ingest.latest_file(names).first().path == "b_2026 년.csv"
    assert ingest.latest_file(names.where("path = 'c.csv'")).first().path is None


def test_golden_rows(spark, tmp_path):
    """Expected results from a file against computed ones: exact fields, a tolerance, and a row on one side only."""
    (tmp_path / "g.csv").write_text("k,n,x,note\n1,2,1.5,a\n2,,2.5,\n4,1,x,\n")
    want = ingest.golden(spark, str(tmp_path / "g.csv"), "k int, n int, x double")
    assert sorted(map(tuple, want.collect())) == [(1, 2, 1.5), (2, None, 2.5), (4, 1, None)]
    got = spark.createDataFrame([(1, 2, 1.6), (2, None, 2.5), (3, 1, 1.0)], "k int, n int, x double")
    found = {r.field: (r.passed, r.failed) for r in parity.summary(parity.differences(want, got, ["k"], ["n"], {"x": 0.05})).collect()}
    assert found == {"n": (2, 2), "x": (1, 3)}


def test_statuses(spark):
    rows = [(5.0, None, "CONFIRMED"), (0.0, None, "ZERO"), (-1.0, None, "ZERO"), (None, "미확정", "UNCONFIRMED"), (None, "x", "NO_RESPONSE"), (None, None, "NO_RESPONSE")]
    df = spark.createDataFrame([r[:2] for r in rows], "n double, t string")
    assert [r[0] for r in df.select(ingest.budget_status(F.col("n"), F.col("t"))).collect()] == [r[2] for r in rows]


def test_labels_and_warnings(spark):
    df = spark.createDataFrame([("SEOUL", 3, 0), ("NOWHERE", 10, 1), (None, 0, 0)], "r string, n long, k long")
    got = df.select(labels.label(F.col("r"), labels.REGIONS).alias("l"), F.size(labels.cohort_warnings(F.col("n"), F.col("k"), F.col("r"), F.lit("COMMUNITY"))).alias("w")).collect()
    assert [tuple(r) for r in got] == [("서울", 2), ("NOWHERE", 0), (None, 2)]


def test_breakdown_lists_tiers_that_bring_nothing(spark):
    chosen = spark.createDataFrame([(1, 2, 4), (1, 4, 4)], "query_id int, tier int, reached_tier int")
    queries = spark.createDataFrame([(1, None, "v"), (2, "d", None)], "query_id int, q_district string, q_venue string")
    got = sorted(tuple(r) for r in selection.breakdown(chosen, queries).collect())
    assert got == [(1, 2, 1, 1), (1, 3, 0, 1), (1, 4, 1, 2), (2, 4, 0, 0), (2, 5, 0, 0), (2, 6, 0, 0)]


def test_odd_request_bodies(spark):
    rows = [(1, None), (2, ""), (3, "null"), (4, '{"regionCode": {"a": 1}, "festivalType": "T", "venueType": true, "durationDays": 3}'), (5, '{"regionCode": "R", "festivalType": "T", "venueType": "V", "durationDays": 1e3}')]
    got = {r.request_id: (r.status, r.problem) for r in validation.single_year(spark.createDataFrame(rows, "request_id int, body string"), ["R"], ["T"], ["V"]).collect()}
    assert got == {1: (400, "json"), 2: (400, "json"), 3: (400, "json"), 4: (400, "regionCode"), 5: (200, None)}


def test_staged_tables_come_and_go(spark):
    df = staging.materialise(spark.range(5), "t")
    assert df.count() == 5
    staging.discard(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        spark.read.parquet(df.stored).count()


def test_terms_of_the_corpus_in_one_walk(spark):
    """Against replacing each term after the other, on names of few letters so that terms overlap and touch."""
    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choice("abc ") if rng.random() < 0.95 else "시" for _ in range(rng.randint(a, b)))
    for n in range(60):
        terms = sorted({word(1, 5).strip() or "a" for _ in range(rng.randint(1, 14))}, key=len, reverse=True)
        if n % 2:
            terms = [t.replace(" ", "b") for t in terms]
        rng.shuffle(terms) if n % 5 == 0 else None
        cut = next((i for i, t in enumerate(terms) if " " in t), len(terms))
        places = {}
        for i, t in enumerate(terms[:cut]):
            places.setdefault(t, i)
        for name in (word(0, 30) for _ in range(100)):
            want = name
            for t in terms:
                want = want.replace(t, " ")
            assert planner.removed(name, places, sorted(set(map(len, places))), terms[cut:]) == want
    records = spark.createDataFrame([("서울", "고성군"), ("서울", None), ("", "포항시"), (None, "")], "region string, district string")
    assert planner.corpus_terms(records) == planner.removal_terms(["서울"], ["고성군", "포항시"])


def test_set_differences_name_the_keys(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3000), rng.choice(["x", None]), rng.randrange(3)) for _ in range(4000)]
    other = [r if i % 500 else (r[0], r[1], r[2] + 9) for i, r in enumerate(rows)][5:] + [(-1, None, 0), rows[77]]
    df = lambda r: spark.createDataFrame(r, "k int, s string, v int")

    def by_hand(a, b):
        from collections import Counter

        ca, cb, out = Counter(a), Counter(b), {}
        for r in ca.keys() | cb.keys():
            if ca[r] != cb[r]:
                w, g = out.get(r[:2], (0, 0))
                out[r[:2]] = (w + ca[r], g + cb[r])
        return out

    got = {(r.k, r.s): (r.want, r.got) for r in parity.set_differences(df(rows), df(other), ["k", "s"], ["v"]).collect()}
    assert got == by_hand(rows, other) and got
    assert parity.set_differences(df(rows), df(rows[::-1]), ["k", "s"], ["v"]).count() == 0
    digest = lambda r: parity.set_digest(df(r), [], F.concat_ws(":", "k", "s", "v")).first()
    assert digest(rows) == digest(rows[::-1]) != digest(other)
    none = digest(rows[:0])
    assert none.n == 0


def test_a_sheet_ends_at_the_first_empty_serial(spark):
    cells = spark.createDataFrame([(i, None if i in (3, 20, 25) else float(i)) for i in range(40)], "row int, serial double").repartition(4)
    got = sorted(r.row for r in ingest.until_empty(cells, "row", "serial").collect())
    assert got == list(range(8, 20))
    assert ingest.until_empty(cells.where("serial is not null"), "row", "serial").count() == 40 - 8 - 2
    assert ingest.until_empty(cells.where("false"), "row", "serial").count() == 0
