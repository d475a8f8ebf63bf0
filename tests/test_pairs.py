"""Distances of all pairs of rows: blocks against plain loops, and what a query sends to its tasks."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandline.operators import blocks, vecdist
from strandline.operators import distance as D
from strandline.plans import registry

SF = "/root/testdata/sf0.001"

#: Queries whose pairs are made in tiles, one row a pair of rows leaving the task in its last form.
TILED = [
    "vecdist_manhattan",
    "dist_gap",
    "dist_paralinear",
    "dist_tn93",
    "dist_hamming",
    "dist_max_pair",
    "dist_calculator",
    "dist_jc69",
    "dist_percent_identity",
    "dist_min_pair",
    "dist_pdist",
    "vecdist_euclidean",
    "vecdist_bray_curtis",
    "vecdist_canberra",
    "vecdist_chord",
    "vecdist_hellinger",
    "vecdist_pearson",
    "vecdist_specprof",
    "vecdist_soergel",
    "vecdist_spearman_approx",
]


@pytest.mark.parametrize("name", TILED)
def test_query_makes_pairs_in_tiles(spark, name):
    """No join row by row, no projection of every pair afterwards."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in plan and "round(" not in above and "isnan(" not in above


def test_rows_are_sent_to_few_blocks():
    """A row's copies are as many as the blocks: 26 for 51,282 rows of 64 numbers before."""
    assert blocks.number_of_blocks(51_282, 512, 6) <= 8
    assert blocks.number_of_blocks(1_000_000, 512, 6) == 16
    assert blocks.number_of_blocks(3, 512, 6) == 2
    assert blocks.number_of_blocks(1000, 64 << 20, 1) == 1000


def test_rounding_as_sql():
    x = np.array([0.5, 1.5, -0.5, 2.5, 0.285, 1.0000004999, -1e-9, np.nan, np.inf])
    assert [repr(float(v)) for v in blocks.rounded(x, 0)] == ["1.0", "2.0", "-1.0", "3.0", "0.0", "1.0", "-0.0", "nan", "inf"]
    assert blocks.rounded(np.array([0.285]), 2)[0] == 0.28


@pytest.mark.parametrize("kind", ["long", "string"])
def test_every_pair_once_over_tiles_and_blocks(spark, monkeypatch, kind):
    """Repeated names meet others but not each other, null names nothing; both orders of an ordered distance are right."""
    r = np.random.default_rng(5)
    vectors = [[float(v) for v in r.integers(0, 3, 5)] for _ in range(700)]
    names = [*range(698), 17, None]
    names = [None if n is None else n if kind == "long" else f"n{n}é" for n in names]
    df = spark.createDataFrame(list(zip(names, vectors)), f"name {kind}, v array<double>")
    got = sorted(map(tuple, vecdist.pairwise(df, "otu_gain", block=150).collect()))
    want = [(a, b, float(sum(x != 0 and y == 0 for x, y in zip(v, w)))) for (a, v), (b, w) in itertools.permutations(zip(names, vectors), 2) if a is not None and b is not None and a < b]
    assert got == sorted(want)


def _plain(a: str, b: str) -> dict:
    n = np.array([[sum(x == i and y == j for x, y in zip(a, b)) for j in "TCAG"] for i in "TCAG"], dtype=float)
    valid, diffs = n.sum(), n.sum() - np.trace(n)
    p = diffs / valid if valid else None
    f = n + np.diag(np.where(np.diag(n) == 0, 0.5, 0))
    det, under = np.linalg.det(f / f.sum()), math.sqrt(np.prod(f.sum(0) / f.sum()) * np.prod(f.sum(1) / f.sum()))
    runs = [{(m.start(), m.end() - m.start()) for m in re.finditer("-+", s)} for s in (a, b)]
    return {
        "hamming": diffs, "pdist": p, "identity": None if p is None else 1 - p,
        "jc69": math.nan if p is None or p >= 0.75 else -0.75 * math.log(1 - p / 0.75) + 0.0,
        "paralinear": -math.log(det / under) / 4 if det > 1e-12 and under > 0 else math.nan,
        "gap": float(sum(12 + n for _, n in runs[0] ^ runs[1])),
    }


def test_aligned_distances_equal_plain_loops(spark):
    """Several chunks of columns, rows without a letter, equal rows, one block pair and several."""
    r = np.random.default_rng(8)
    base = r.choice(list("TCAG"), 700)
    rows = [("".join(np.where(r.random(700) < p, r.choice(list("TCAG-N"), 700), base))) for p in (0, 0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.9)] + ["-" * 700, "NNNNNNN" * 100]
    aln = spark.createDataFrame([(i, i, s) for i, s in enumerate(rows)], "name long, ord int, seq string")
    want = {(i, j): _plain(rows[i], rows[j]) for i, j in itertools.combinations(range(len(rows)), 2)}
    for b in (None, 3):
        made = {"hamming": D.hamming(aln, blocks=b), "pdist": D.pdist(aln, blocks=b), "jc69": D.jc69(aln, blocks=b), "paralinear": D.paralinear(aln, blocks=b), "gap": D.gap_dist(aln, blocks=b), "identity": D.percent_identity(aln, blocks=b)}
        for k, d in made.items():
            got = {(x[0], x[1]): x[2] for x in d.collect()}
            assert set(got) == set(want), k
            for pair, v in got.items():
                assert v == pytest.approx(want[pair][k], nan_ok=True, abs=1e-9), (k, pair)
    assert D.extreme_pair(aln, "max").first().dist == max(w["hamming"] for w in want.values())
    assert D.extreme_pair(aln, "min", blocks=3).first().dist == 0
    assert D.extreme_pair(aln.limit(0), "max").first().dist is None
    counts = {(x.name1, x.name2): x for x in D.pair_counts(aln, blocks=3).collect()}
    assert all(counts[i, j].n_02 == sum(x == "T" and y == "A" for x, y in zip(rows[i], rows[j])) for i, j in want)


@pytest.mark.parametrize("width", [1, 63, 64, 65, 300])
def test_letters_meet_as_bits(width):
    """Counts of any width in small integers, of letters and of groups of letters."""
    r = np.random.default_rng(width)
    x, y = r.integers(0, 5, (7, width)), r.integers(0, 5, (11, width))
    m = D.Meetings(D.letter_bits(x, 4), D.letter_bits(y, 4))
    assert (m.count([[1]], [[3]]) == [[((a == 2) & (b == 4)).sum() for b in y] for a in x]).all()
    assert (m.valid(4) == [[((a > 0) & (b > 0)).sum() for b in y] for a in x]).all()
    assert (m.same(4) == [[((a > 0) & (a == b)).sum() for b in y] for a in x]).all()
    assert (m.diffs(4) == [[((a > 0) & (b > 0) & (a != b)).sum() for b in y] for a in x]).all()
    full = D.letter_bits(np.full((2, width), 4), 4)
    assert (D.Meetings(full, full).count([range(4)], [range(4)]) == width).all()
    assert D.Meetings(full[:, :, :0], full[:, :, :0]).valid(4).tolist() == [[0, 0], [0, 0]]


@pytest.mark.parametrize("width", [64, 72, 200])
def test_paralinear_is_exact_at_its_largest_counts(spark, width):
    """The letters in equal parts, where determinants in 4-byte floats are largest; and one letter throughout."""
    rows = [("TCAG" * width)[:width], ("TTTTCCCCAAAAGGGG" * width)[:width], "T" * width, "".join(np.random.default_rng(2).permutation(list(("TCAG" * width)[:width])))]
    aln = spark.createDataFrame([(i, i, s) for i, s in enumerate(rows)], "name long, ord int, seq string")
    for x in D.paralinear(aln).collect():
        assert x.dist == pytest.approx(_plain(rows[x.name1], rows[x.name2])["paralinear"], nan_ok=True, abs=1e-9), x


def _bytes_a_row(df, out) -> dict[str, float]:
    """Of each column, as Spark writes Parquet."""
    df.write.parquet(str(out))
    n, size = 0, {}
    for f in out.glob("*.parquet"):
        m = pq.read_metadata(f)
        n += m.num_rows
        for g in range(m.num_row_groups):
            for c in range(m.num_columns):
                x = m.row_group(g).column(c)
                size[x.path_in_schema] = size.get(x.path_in_schema, 0) + x.total_compressed_size
    return {k: v / n for k, v in size.items()}


def test_paralinear_names_take_few_bytes(spark, tmp_path):
    """A tile is as wide as names are found again soon."""
    r = np.random.default_rng(1)
    aln = spark.createDataFrame([(i, i, "".join(x)) for i, x in enumerate(r.choice(list("TCAG"), (3000, 8)))], "name long, ord int, seq string")
    size = _bytes_a_row(D.paralinear(aln, blocks=2), tmp_path / "out")
    assert size["name1"] + size["name2"] < 0.3, size


def _written(out) -> np.ndarray:
    """Pairs in order, a line of two names and a distance each."""
    t = pq.read_table(str(out))
    return np.array(sorted(zip(*(t[k].to_numpy() for k in ("name1", "name2", "dist")))))


@pytest.mark.parametrize("name", ["pearson", "manhattan"])
def test_rounded_distances_of_many_values_take_few_bytes(spark, tmp_path, name):
    """Plain doubles, 8 bytes each, before; every pair is there once, with its value, whatever leaves first."""
    x = np.abs(np.random.default_rng(2).normal(size=(2400, 64))) / 10
    x[7], x[8] = np.nan, x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "name long, v array<double>")
    size = _bytes_a_row(vecdist.pairwise(df, name, block=1200, digits=5), tmp_path / "out")
    assert size["dist"] < 4, size
    got = _written(tmp_path / "out")
    i, j = np.triu_indices(len(x), 1)
    with np.errstate(invalid="ignore"):
        want = blocks.rounded(vecdist.METRICS[name](x, x)[i, j], 5)
    assert (got[:, :2] == np.stack([i, j], 1)).all()
    apart = np.abs(got[:, 2] - want)
    assert (np.isnan(got[:, 2]) == np.isnan(want)).all() and np.nanmax(apart) < 1.1e-5 and (apart > 1e-9).sum() < 10  # products of matrices round apart at half a digit
    assert name != "manhattan" or np.nanmax(apart) == 0


def test_cuts_part_values_for_dictionaries():
    """As few bands as hold the values, the most usual ones together; none for few values or far too many."""
    r = np.random.default_rng(3)
    d = np.concatenate([r.normal(5, 0.5, 100_000), [np.nan, np.inf]])
    low, high = blocks.cuts_between(d, 5)
    assert high - low == pytest.approx(blocks.VALUES / 1e5) and ((d >= low) & (d < high)).mean() > 0.7
    assert blocks.cuts_between(d, 4) == blocks.cuts_between(d, 7) == blocks.cuts_between(d[:0], 5) == blocks.cuts_between(d[-2:], 5) == []
    assert len(blocks.cuts_between(r.random(1000) * 2, 5)) == 1


def test_bands_keep_all_pairs(spark):
    """Values at the cuts, below, above and none, of names that repeat: once each."""
    names, x = [*range(300), 7, None], np.random.default_rng(4).integers(0, 3, 302).astype(float)
    x[11] = np.nan
    df = spark.createDataFrame(list(zip(names, x.tolist())), "name long, v double")
    load, kernel = (lambda t: t["v"].to_numpy()), (lambda a, b: [np.abs(a[:, None] - b[None, :])])
    rows = [blocks.by_blocks(df, load, kernel, {"dist": "double"}, 3, digits=2, opening=c != (), cuts=c).collect() for c in ((), (1.0,), (0.5, 1.0, 2.0))]
    whole, *parted = [sorted((r.name1, r.name2, str(r.dist)) for r in made) for made in rows]
    assert len(whole) == 301 * 300 // 2 - 1 and parted == [whole, whole]
    assert {str(r.dist) for r in rows[0]} == {"0.0", "1.0", "2.0", "nan"}


def test_manhattan_sums_whole_numbers():
    """To the bit as plain sums round, rounded already or not."""
    test_faster_sums_round_as_plain_ones("manhattan")
    rows, special = _odd_rows(), np.array([[np.nan] * 8, [np.inf] + [1.0] * 7, [-1.0, 1] * 4, [0.0] * 8, [1e300] * 8, [5e-324] * 8])
    with np.errstate(all="ignore"):
        for x, y in [(rows, rows), (rows[:7], np.concatenate([rows[7:], special])), (special, rows), (rows[:, :0], rows[:5, :0]), (np.zeros((3, 8)), rows)]:
            for digits in (0, 2, 5, 9):
                a, b = blocks.rounded(vecdist.manhattan(x, y), digits), vecdist.manhattan_to(x, y, digits, True)
                assert np.array_equal(a, b, equal_nan=True), digits


def test_manhattan_needs_no_plain_sums(monkeypatch):
    """Of amounts as the query has them: of 4 bytes, with a total below 8."""
    monkeypatch.setattr(vecdist, "_sum_of", lambda *_: pytest.fail("plain sums"))
    x = np.abs(np.random.default_rng(3).normal(size=(300, 64)))
    x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32).astype(float)
    x[x < 0.05] = 0
    assert vecdist.manhattan_to(x[:100], x[100:], 5, True).shape == (100, 200)


#: Distances that are summed in a faster way when they are rounded.
FASTER = ["canberra", "soergel", "bray_curtis", "euclidean", "chord", "hellinger", "specprof"]


def _odd_rows() -> np.ndarray:
    """Amounts with copies, all but equal rows, rows of zeros, tiny and large ones, and such whose distances lie at half a digit."""
    r = np.random.default_rng(12)
    x = np.where(r.random((90, 8)) < 0.3, 0, r.random((90, 8)).astype(np.float32).astype(float))
    grid = np.zeros((30, 8))
    grid[:, 0], grid[:, 1] = 0.5, np.arange(30) * 0.5e-2  # distances of a half at 2 digits
    return np.concatenate([x, x[:20], x[:20] * (1 + 1e-9), x[:20] + 1e-7 * (x[:20] > 0), grid, np.eye(8) * 3, x[:3] * 1e-6])


@pytest.mark.parametrize("name", FASTER)
def test_faster_sums_round_as_plain_ones(name):
    """To the bit, at any number of digits, and where the faster sums don't apply."""
    f = vecdist.METRICS[name]
    rows, special = _odd_rows(), np.array([[np.nan] * 8, [np.inf] + [1.0] * 7, [-1.0, 1] * 4, [0.0] * 8, [1e300] * 8, [5e-324] * 8])
    sides = [(rows, rows), (rows[:1], rows), (rows[:7], np.concatenate([rows[7:], special])), (np.concatenate([special, rows[:5]]), rows), (rows * 1e4, rows * 1e4), (rows[:, :0], rows[:5, :0])]
    prepare, to = getattr(f, "prepare", lambda x: x), getattr(f, "f", f).to
    with np.errstate(all="ignore"):
        for x, y in sides:
            for digits in (0, 1, 2, 5, 9, 14):
                plain, got = f(x, y), to(prepare(x), prepare(y), digits)
                a, b = blocks.rounded(plain, digits), blocks.rounded(got, digits)
                assert np.array_equal(np.isnan(a), np.isnan(b)) and (a[~np.isnan(a)].view(np.int64) == b[~np.isnan(b)].view(np.int64)).all(), digits


@pytest.mark.parametrize("name", FASTER)
def test_faster_sums_are_used(name, monkeypatch):
    """Of rows that are well apart, nearly no pair needs the plain sum."""
    f = vecdist.METRICS[name]
    f = getattr(f, "f", f)
    monkeypatch.setattr(vecdist, "_sum_of", lambda *_: pytest.fail("plain sums"))
    x = np.random.default_rng(3).random((300, 64)).astype(np.float32).astype(float)
    assert f.to(x[:100], x[100:], 5).shape == (100, 200)


#: Distances that leave their kernel rounded.
DONE = ["hellinger", "specprof"]


@pytest.mark.parametrize("name", DONE)
def test_done_distances_are_rounded_as_plain_ones(name):
    """To the bit, with copies, rows of zeros, special rows and distances at half a digit; a second rounding isn't needed."""
    f = vecdist.METRICS[name]
    rows, special = _odd_rows(), np.array([[np.nan] * 8, [np.inf] + [1.0] * 7, [0.0] * 8, [1e300] * 8, [5e-324] * 8])
    with np.errstate(all="ignore"):
        for x, y in [(rows, rows), (rows[:7], np.concatenate([rows[7:], special])), (special, rows), (rows * 1e4, rows * 1e4), (rows[:, :0], rows[:5, :0])]:
            for digits in (0, 1, 2, 5, 9, 14):
                a, b = blocks.rounded(f(x, y), digits), f.f.to(f.prepare(x), f.prepare(y), digits, True)
                assert np.array_equal(np.isnan(a), np.isnan(b)) and (a[~np.isnan(a)].view(np.int64) == b[~np.isnan(b)].view(np.int64)).all(), digits


@pytest.mark.parametrize("name", DONE)
def test_pairs_need_no_second_rounding_nor_null_checks(spark, monkeypatch, name):
    """What leaves a task: columns without nulls, so that no row is asked for them, and distances that by_blocks doesn't round again."""
    asked = []
    monkeypatch.setattr(vecdist, "by_blocks", lambda *a, digits=None, **k: asked.append(digits) or blocks.by_blocks(*a, digits=digits, **k))
    df = registry.QUERIES[f"vecdist_{name}"](spark, SF)
    assert asked == [None] and [(f.name, f.nullable) for f in df.schema] == [("name1", False), ("name2", False), ("dist", False)]


@pytest.mark.parametrize("name", DONE)
def test_one_product_rounds_as_plain_sums(name):
    """To the bit, of rows that bring their squares; without rows of zeros, too, as such a row sends its whole tile the longer way."""
    f = vecdist.METRICS[name]
    rows, special = _odd_rows(), np.array([[np.nan] * 8, [np.inf] + [1.0] * 7, [-1.0, 1] * 4, [0.0] * 8, [1e300] * 8, [5e-324] * 8])
    some = rows[rows.any(1)]
    with np.errstate(all="ignore"):
        for x, y in [(some, some), (rows, rows), (some[:7], np.concatenate([some[7:], special])), (special, some), (some[:1], some * 1e4), (rows[:, :0], rows[:5, :0])]:
            for digits in (0, 1, 2, 5, 9, 14):
                a = blocks.rounded(f(x, y), digits)
                b = vecdist.done_apart(f.f, vecdist.with_squares(f.prepare(x)), vecdist.with_squares(f.prepare(y)), digits)
                assert np.array_equal(np.isnan(a), np.isnan(b)) and (a[~np.isnan(a)].view(np.int64) == b[~np.isnan(b)].view(np.int64)).all(), digits


@pytest.mark.parametrize("name", DONE)
def test_query_rounds_in_few_steps(spark, monkeypatch, name):
    """Of rows that are well apart, the kernel that a query hands over needs neither the longer way nor plain sums."""
    handed = []
    monkeypatch.setattr(vecdist, "by_blocks", lambda *a, **k: handed.append(a[1:3]) or blocks.by_blocks(*a, **k))
    registry.QUERIES[f"vecdist_{name}"](spark, SF)
    load, kernel = handed[0]
    x = np.random.default_rng(3).random((300, 64)).astype(np.float32).astype(float)
    sides = [load(pa.table({"v": list(v)})) for v in (x[:100], x[100:])]
    want = blocks.rounded(vecdist.METRICS[name](x[:100], x[100:]), 5)
    monkeypatch.setattr(vecdist, "_settled", lambda *_: pytest.fail("longer way"))
    monkeypatch.setattr(vecdist, "_sum_of", lambda *_: pytest.fail("plain sums"))
    assert (kernel(*sides)[0] == want).all()


@pytest.mark.parametrize("n", [2, 3, 7, 16])
def test_short_tasks_come_last(spark, n):
    """Each pair of blocks has its own number, and those of a block with itself, half the work, have the highest."""
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    got = spark.createDataFrame(pairs, "i int, j int").selectExpr("i", "j", f"{blocks.pair_number('i', 'j', n)} AS g").collect()
    assert sorted(x.g for x in got) == list(range(len(pairs)))
    assert {x.i for x in got if x.g >= n * (n - 1) // 2 and x.i == x.j} == set(range(n))
    assert blocks.number_of_blocks(51_282, 512, 6) == 8


def test_rank_distances_are_exact_in_4_bytes():
    r = np.random.default_rng(4)
    for n in (2, 64, 161, 162, 400):
        x = vecdist.ranks(r.integers(0, n, (6, n)).astype(float))
        x[0] = np.arange(1, n + 1)
        want = [[6 * ((p - q) ** 2).sum() / (n * (n * n - 1)) for q in x] for p in x]
        assert (vecdist._rank_apart(x, x) == want).all()
