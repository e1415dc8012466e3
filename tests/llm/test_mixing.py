import collections
from fractions import Fraction

from pyspark.sql import functions as F

from cohortmill.llm import mixing

WEIGHTS = {"a": 5.0, "b": 2.0, "c": 1.0, "hot": 3.0}


def frame(spark, counts):
    rows = [(i * 1000 + ord(s[0]), s) for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string").repartition(5)


def test_deviation_stays_below_one_block(spark):
    counts = {"a": 90, "b": 60, "c": 40, "hot": 400}
    rows = sorted(mixing.mix_sources(frame(spark, counts), WEIGHTS, block_rows=2, resolution=44).select("source", "mix.*").collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(sum(counts.values())))
    phases = collections.defaultdict(list)
    for r in rows:
        phases[r.phase].append(r)
    assert 1 < len(phases) <= 4
    for phase in phases.values():
        weight = {r.source: r.weight for r in phase}
        assert abs(sum(weight.values()) - 1) < 1e-9
        assert all(r.release <= r.slot < r.deadline for r in phase)
        ends = {s: max(r.slot for r in phase if r.source == s) for s in weight}
        ran = collections.Counter()
        by_slot = {r.slot: r.source for r in phase}
        for t in range(min(ends.values())):  # as long as every source has blocks
            ran[by_slot.get(t)] += 1
            assert all(abs(ran[s] - w * (t + 1)) < 1 for s, w in weight.items())


def test_one_cycle_equals_a_plain_simulation(spark):
    parts = [7, 3, 1, 13]
    total = sum(parts)
    got = spark.range(1).select(mixing.cycle_slots(F.array(*map(F.lit, parts)), F.lit(total)).alias("c")).first().c
    run = [0] * len(parts)
    for t, slot in enumerate(got):
        ready = [(-(-(run[i] + 1) * total // p), -p, i) for i, p in enumerate(parts) if run[i] < p and run[i] * total // p <= t]
        _, _, i = min(ready)
        assert (slot.who, slot.k) == (i, run[i])
        run[i] += 1
    assert run == parts


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 0), (1, None, 0), (2, "x", 0), (None, "x", 0)], "doc_id long, source string, mix int").drop("mix").withColumn("slot", F.lit("kept"))
    rows = mixing.mix_sources(df, block_rows=1).collect()
    assert sorted(r.mix.position for r in rows) == [0, 1, 2, 3] and {r.slot for r in rows} == {"kept"}
    assert mixing.mix_sources(df.limit(0)).count() == 0
    ordered = mixing.in_mixed_order(mixing.mix_sources(frame(spark, {"a": 40, "b": 40}), block_rows=1), ["doc_id", "source"]).collect()
    assert all({ordered[i].source, ordered[i + 1].source} == {"a", "b"} for i in range(0, 80, 2))


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_sources(frame(spark, {"a": 4}))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def check_exact(spark, counts, weights, given, **more):
    """Every source stays within one block of its given weight, in exact arithmetic, as long as all sources have blocks."""
    rows = sorted(mixing.mix_sources(frame(spark, counts), weights, block_rows=1, **more).select("source", "mix.*").collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(sum(counts.values())))
    first = [r for r in rows if r.phase == 0]
    assert [r.slot for r in first] == list(range(len(first)))
    share = {s: Fraction(w) / sum(map(Fraction, given.values())) for s, w in given.items()}
    ran = collections.Counter()
    for t, r in enumerate(first):
        w = share[r.source]
        assert r.weight == float(w) and r.release == r.block // w and r.deadline == -(-(r.block + 1) // w)
        assert r.release <= t < r.deadline
        ran[r.source] += 1
        assert all(abs(ran[s] - x * (t + 1)) < 1 for s, x in share.items())
    assert any(ran[s] == n for s, n in counts.items())
    return first


def test_given_weights_are_exact(spark):
    named = {"src0": 4.0, "src1": 3.0, "src2": 2.0}
    counts = {f"src{i}": 40 * int(named.get(f"src{i}", 1)) for i in range(20)}
    first = check_exact(spark, counts, named, {s: named.get(s, 1) for s in counts})
    assert len(first) > 26 * 39
    # A weight below 1/240, and one whose cycle is longer than the phase.
    check_exact(spark, {"a": 3, "b": 1200}, {"a": 1, "b": 999}, {"a": 1, "b": 999})
    check_exact(spark, {"a": 90, "b": 50, "c": 70}, {"a": 0.1, "b": 1 / 3, "c": 0.7}, {"a": "0.1", "b": repr(1 / 3), "c": "0.7"})


def test_weights_count_with_many_sources(spark):
    counts = {f"s{i}": 3 for i in range(250)} | {"big": 60}
    check_exact(spark, counts, {"big": 20.0}, {s: 20 if s == "big" else 1 for s in counts})


def test_one_layout_however_it_is_split_or_joined(spark, monkeypatch):
    counts, weights = {"a": 31, "b": 57, "c": 8}, {"a": 0.37, "b": 1.21, "c": 0.013}

    def mixed(**more):
        return sorted(tuple(r) for r in mixing.mix_sources(frame(spark, counts), weights, block_rows=2, **more).select("doc_id", "mix.*").collect())

    whole = mixed()
    assert mixed(resolution=7) == whole
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    assert mixed() == whole


def test_layout_equals_the_cycle_as_a_column(spark):
    parts = [7, 3, 1, 13]
    got = spark.range(1).select(mixing.cycle_slots(F.array(*map(F.lit, parts)), F.lit(sum(parts))).alias("c")).first().c
    assert mixing.earliest_deadlines(parts, [100] * 4) == [x.who for x in got]


def test_clashing_names_are_kept(spark):
    df = frame(spark, {"a": 3, "b": 2}).withColumn("Mix", F.lit("own")).withColumn("mix_", F.lit(7)).withColumn("_source", F.lit("x"))
    got = mixing.mix_sources(df, WEIGHTS)
    assert got.columns == [*df.columns, "mix__"]
    rows = mixing.in_mixed_order(got, ["Mix", "mix_", "_source", "mix__.position"]).collect()
    assert [r.position for r in rows] == [0, 1, 2, 3, 4] and {(r[0], r[1], r[2]) for r in rows} == {("own", 7, "x")}
