import pytest
from pyspark.sql import functions as F

from strandline.operators import table as O


@pytest.fixture
def t(spark):
    return O.make_table(spark, ["id", "foo", "bar"], [(1, "abc", 11), (2, "bca", 22), (3, "cab", 33), (4, "abc", 55)])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_filtered_by_text_is_translated_and_not_evaluated(t):
    assert rows(O.filtered(t, "foo == 'abc' and bar > 20")) == [(4, "abc", 55)]
    assert rows(O.filtered(t, "foo == 'abc'", negate=True).select("id")) == [(2,), (3,)]
    assert rows(O.filtered(t, "10 < bar < 30").select("id")) == [(1,), (2,)]
    assert O.filtered(t, "id in (1, 4)").count() == 2
    with pytest.raises(ValueError):
        O.python_to_sql("__import__('os').system('true')")


def test_counts(t):
    assert rows(O.count_unique(t, "foo")) == [("abc", 2), ("bca", 1), ("cab", 1)]
    assert O.count(t, "foo == 'abc'").first().n == 2
    assert O.distinct_values(t, "foo").count() == 3


def test_new_column_goes_last(t):
    out = O.with_new_column(t, "foo", "bar * 2")
    assert out.columns == ["id", "bar", "foo"]
    assert [r.foo for r in out.orderBy("id").collect()] == [22, 44, 66, 110]


def test_inner_join_matches_nulls_and_prefixes(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, w string")
    out = O.inner_join(a, b, "k", "k")
    assert out.columns == ["k", "v", "right_w"]
    assert set(map(tuple, out.collect())) == {(1, "x", "p"), (None, "y", "q")}
    assert O.cross_join(a, b.filter("k > 5")).count() == 0
    assert O.cross_join(a, b).columns == ["k", "v", "right_k", "right_w"]


def test_appended(t):
    out = O.appended(t, t, new_column="title", titles=["one", "two"])
    assert out.columns[0] == "title" and out.count() == 8


def test_sorted_reverse(t):
    assert [r.id for r in O.sort(t, ["foo", "bar"], reverse="bar").collect()] == [4, 1, 2, 3]


def test_sums_and_normalisation(spark):
    m = O.make_table(spark, ["a", "b"], [(1.0, 3.0), (2.0, 2.0)])
    assert tuple(O.sum_columns(m).first()) == (3.0, 5.0)
    assert [tuple(r) for r in O.normalized(m, ["a", "b"]).collect()] == [(0.25, 0.75), (0.5, 0.5)]
    assert [r.a for r in O.normalized(m, ["a"], by_row=False).collect()] == [1 / 3, 2 / 3]
    mixed = O.make_table(spark, ["a"], [("1",), ("x",)])
    assert O.sum_columns(mixed, strict=False).first()[0] == 1.0


def test_transposed(spark):
    m = O.make_table(spark, ["k", "x", "y"], [("a", 1, 2), ("b", 3, 4)])
    assert rows(O.transposed(m, "name", "k")) == [("x", 1, 3), ("y", 2, 4)]
    with pytest.raises(ValueError):
        O.transposed(O.make_table(spark, ["k", "x"], [("a", 1), ("a", 2)]), "name", "k")


def test_cast_ladder(spark):
    m = O.cast_ladder(O.make_table(spark, ["i", "f", "s"], [("1", "1.5", "a"), ("2", "3", "4")]))
    assert [t for _, t in m.dtypes] == ["bigint", "double", "string"]


def test_mode_breaks_ties_to_the_largest_key(spark):
    c = spark.createDataFrame([("a", 2), ("c", 2), ("b", 1)], "k string, n long")
    assert O.mode(c, "k").first().mode == "c"
    assert O.counts_entropy(c).first().entropy == pytest.approx(1.5219280948873621)


def test_text_forms(t):
    for style in ("simple", "md", "rst", "latex", "html", "csv", "tsv"):
        assert "abc" in O.format_table(t, style)
    assert O.from_rich_json(t.sparkSession, O.to_rich_json(t)).count() == 4


def test_number_counter(spark):
    c = spark.createDataFrame([(1, 2), (3, 1)], "k int, n long")
    r = O.number_counter_stats(c, "k").first()
    assert r.mean == pytest.approx(5 / 3) and r["var"] == pytest.approx(4 / 3)
    assert O.expand_counts(c).count() == 3


def test_filtered_by_column(t):
    assert O.filtered_by_column(t.select("id", "bar"), lambda c: F.max(c) > 10).columns == ["bar"]
