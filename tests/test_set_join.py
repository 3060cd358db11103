"""The set-similarity join and the duplicates by stages against comparing everything with everything."""

import random

import pytest
from pyspark.sql import functions as F

from calltide.operators import entity_resolution as R
from calltide.operators import set_join


def brute(rows, t):
    """Pairs of rows (not classes) of one block that reach t."""
    out = set()
    for i, (a, block_a, x) in enumerate(rows):
        for b, block_b, y in rows[i + 1 :]:
            if block_a == block_b and x is not None and y is not None and a is not None and b is not None:
                x_, y_ = ({w for w in s if w is not None} for s in (x, y))
                if set(x) == set(y) or (x_ and y_ and len(x_ & y_) >= t * len(x_ | y_) - 1e-9):
                    out.add((min(a, b), max(a, b)))
    return out


def pairs_of_rows(members, pairs):
    by = {}
    for r in members.collect():
        by.setdefault(r["rep"], []).append(r["id"])
    out = {(min(a, b), max(a, b)) for ids in by.values() for i, a in enumerate(ids) for b in ids[i + 1 :]}
    for r in pairs.collect():
        assert r["rep_a"] < r["rep_b"]
        out |= {(min(a, b), max(a, b)) for a in by[r["rep_a"]] for b in by[r["rep_b"]]}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(220):
        if out and rng.random() < 0.6:
            _, block, words = rng.choice(out)
            words = list(words)
            for _ in range(rng.randrange(3)):
                if words and rng.random() < 0.5:
                    words.pop(rng.randrange(len(words)))
                else:
                    words.append(f"w{rng.randrange(60)}")
            rng.shuffle(words)
            out.append((i, block if rng.random() < 0.9 else "b", words))
        else:
            out.append((i, rng.choice(["a", "b", None]), [f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randrange(1, 14))]))
    return out + [(1000, "a", None), (1001, "a", []), (1002, "a", []), (None, "a", out[0][2]), (1003, "a", [None, "w1"]), (1004, "a", ["w1", "w1"])]


@pytest.mark.parametrize("t", [0.8, 0.5, 0.75, 1.0, 0.1])
@pytest.mark.parametrize("ranked", [20_000, 3])
def test_pairs_equal_brute_force(spark, rows, t, ranked, monkeypatch):
    monkeypatch.setattr(set_join, "RANKED", ranked)
    df = spark.createDataFrame(rows, "id long, block string, words array<string>").withColumns({"token": F.lit("clash"), "n": F.lit(1), "rep": F.lit(2)}).repartition(3)
    members, pairs = set_join.similar_sets(df, t, ("block",))
    assert pairs_of_rows(members, pairs) == brute(rows, t)
    assert members.count() == sum(i is not None and w is not None for i, _, w in rows)


def test_no_pair_is_made_that_prefixes_and_sizes_rule_out(spark):
    """Sets that all share common words and have rare ones of their own meet nowhere."""
    rows = [(i, [f"common{k}" for k in range(6)] + [f"rare{i}-{k}" for k in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    _, pairs = set_join.similar_sets(df, 0.8)
    assert pairs.count() == 0
    assert set_join.met_prefixes(set_join.set_classes(df)[1], 0.8).count() == 0
    near = spark.createDataFrame([(0, list("abcdefghij")), (1, list("abcdefghik")), (2, list("abcdefghijklm")), (3, list("abcdefghijklmnopq"))], "id long, words array<string>")
    made = {(r["rep_a"], r["rep_b"]) for r in set_join.met_prefixes(set_join.set_classes(near)[1], 0.8).collect()}
    assert (0, 1) in made and not {(0, 3), (1, 3)} & made
    with pytest.raises(ValueError):
        set_join.similar_sets(df, 0.0)


def test_copies_make_no_pairs(spark):
    df = spark.range(2000).select("id", F.array(F.lit("same"), F.lit("words")).alias("words"))
    members, pairs = set_join.similar_sets(df, 0.8)
    assert pairs.count() == 0 and {r["rep"] for r in members.select("rep").distinct().collect()} == {0} and members.count() == 2000


EVENT = "id long, owner_id long, number string, type string, direction string, duration int, content string, ts timestamp_ntz"


def test_stages_lead_to_events_that_are_no_duplicates(spark):
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    call = lambda i, s, d=60, number="+15550001111": (i, 1, number, "call", "inbound", d, None, at(s))
    sms = lambda i, s, text, owner=1: (i, owner, f"+1555000{i:04d}", "sms", "inbound", None, text, at(s))
    rows = [call(1, 0), call(2, 0), call(3, 100), call(4, 290), call(5, 500), call(6, 500, 61)]
    rows += [sms(10, 9000, "one two three four five"), sms(11, 19000, "Five four three two one!"), sms(12, 29000, "one two three four"), sms(13, 39000, "one two three"), sms(14, 49000, "one two three four five", 2), sms(15, 59000, "one two"), sms(16, 69000, None), sms(17, 79000, "- - - - - - - -"), sms(18, 89000, "* * * * * * * *")]
    got = {r["id"]: (r["duplicate_of"], r["stage"]) for r in R.staged_duplicates(spark.createDataFrame(rows, EVENT), by_content=True).collect()}
    assert not {root for root, _ in got.values()} & set(got)
    assert got[2] == (1, "exact") and {got[i][0] for i in (2, 3, 4, 5, 6)} == {1}
    assert got[11] == (10, "content") and got[12] == (10, "content") and not {10, 13, 14, 15, 16, 17, 18} & set(got)
    assert R.staged_duplicates(spark.createDataFrame([], EVENT), by_content=True).count() == 0


def test_roots_of_long_chains(spark):
    links = spark.range(1, 200).select("id", (F.col("id") - 1).alias("duplicate_of"), F.lit("fuzzy").alias("stage"))
    assert {tuple(r) for r in R.to_roots(links).collect()} == {(i, 0, "fuzzy") for i in range(1, 200)}


def test_signatures_rule_out_pairs_that_meet_but_differ(spark):
    """Sets that share a rare token and little else aren't verified, at sizes on both sides of where signatures widen."""
    rng = random.Random(4)
    sets, near = [], []
    for i, n in enumerate([60, 300, 440, 460, 700, 890, 910, 1100]):
        one = [f"s{i}-{k}" for k in range(n)]
        other = [f"t{i}-{k}" for k in range(n)]
        close = one[: n - n // 10] + [f"c{i}-{k}" for k in range(n // 10 - 1)]
        for words in (one, other, close):
            rng.shuffle(words)
            sets.append((len(sets), [*words, f"rare{i}"]))
        near.append((3 * i, 3 * i + 2))
    df = spark.createDataFrame(sets, "id long, words array<string>")
    _, pairs = set_join.similar_sets(df, 0.8)
    assert sorted((r["rep_a"], r["rep_b"]) for r in pairs.collect()) == near
    made = {(r["rep_a"], r["rep_b"]) for r in set_join.met_prefixes(set_join.set_classes(df)[1], 0.8).collect()}
    assert made == set(near)


def test_wide_signatures_bound_the_difference(spark):
    sets = [(n, list(range(n))) for n in (451, 899, 901, 1100)]
    x = spark.createDataFrame(sets, "n int, o array<int>").select("n", F.transform("o", lambda k: F.xxhash64(k)).alias("o"))
    x = x.select("n", set_join.wide_signature(F.col("o"), F.size("o")).alias("w"))
    got = {(r["n"], r["m"]): r["d"] for r in x.crossJoin(x.select(F.col("n").alias("m"), F.col("w").alias("v"))).select("n", "m", set_join.bits_apart(F.col("w"), F.col("v")).alias("d")).collect()}
    assert {r["n"]: r["k"] for r in x.select("n", F.size("w").alias("k")).collect()} == {451: 8, 899: 8, 901: 16, 1100: 16}
    assert all(d <= abs(n - m) and d % 2 == abs(n - m) % 2 for (n, m), d in got.items())


@pytest.mark.parametrize("tokens, pairs", [(4_000_000, 250_000), (40, 20)])
def test_each_pair_is_made_once(spark, monkeypatch, tokens, pairs):
    """Like sets meet at many tokens of their prefixes, in cells of one chunk and of many, and are still one pair each."""
    monkeypatch.setattr(set_join, "TOKENS", tokens)
    monkeypatch.setattr(set_join, "PAIRS", pairs)
    rows = [(i, "a", [f"w{k}" for k in range(40 + i % 12)] + [f"own{i}-{k}" for k in range(i % 5)]) for i in range(48)]
    df = spark.createDataFrame(rows, "id long, block string, words array<string>")
    met = [(r["rep_a"], r["rep_b"]) for r in set_join.met_prefixes(set_join.set_classes(df, ("block",))[1], 0.8, ("block",)).collect()]
    assert len(met) == len(set(met))
    members, found = set_join.similar_sets(df, 0.8, ("block",))
    assert pairs_of_rows(members, found) == brute(rows, 0.8)
    made = [(r["rep_a"], r["rep_b"]) for r in found.collect()]
    assert len(made) == len(set(made))


def test_parts_of_a_task_lose_no_pair(monkeypatch):
    """A task works on few meetings, and verifies few tokens, at a time."""
    import pyarrow as pa

    rng = random.Random(5)
    sets = [sorted({*range(30), *(rng.randrange(2**40) for _ in range(rng.randrange(9)))}, reverse=i % 2 == 0) for i in range(40)]
    tokens = [sorted(s, reverse=True)[: len(s) - int(0.8 * len(s) - 1e-9)] for s in sets]  # in an order from the largest, as negative keys
    prefix = [[2**41 - k for k in p] for p in tokens]
    cells = ["x"] * 25 + ["y"] * 15
    batch = pa.RecordBatch.from_pydict({"cell": cells, "side": pa.array([2] * 40, pa.int8()), "size": pa.array([len(s) for s in sets], pa.int32()), "last": pa.array([p[-1] for p in prefix]), "number": pa.array([1] * 25 + [2] * 15), "rep": list(range(40)), "prefix": pa.array(prefix, pa.list_(pa.int64()))})
    found = []
    for meetings, together in ((1 << 21, 250_000), (3, 1)):
        monkeypatch.setattr(set_join, "MEETINGS", meetings)
        monkeypatch.setattr(set_join, "TOGETHER", together)
        met = pa.Table.from_batches(set_join._meetings(iter([batch.slice(i, 7) for i in range(0, 40, 7)]), 0.8)).to_pydict()
        found.append(sorted(zip(met["x"], met["y"], strict=True)))
    near = [(i, j) for i in range(40) for j in range(i + 1, 40) if cells[i] == cells[j] and len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})]
    assert found[0] == found[1] and set(near) <= {(min(p), max(p)) for p in found[0]} and near
    words = pa.array([[str(k) for k in s] for s in sets])
    pairs = sorted(near)
    rows = pa.RecordBatch.from_pydict({"pair": pa.array([0] * 40 + [1] * len(pairs), pa.int32()), "x": list(range(40)) + [a for a, _ in pairs], "y": pa.array([None] * 40 + [b for _, b in pairs], pa.int64()), "words": pa.concat_arrays([words, pa.nulls(len(pairs), words.type)])})
    monkeypatch.setattr(set_join, "LOOKED_UP", 50)
    out = pa.Table.from_batches(set_join._verified(iter([rows.slice(i, 11) for i in range(0, len(rows), 11)]), 0.8)).to_pydict()
    assert list(zip(out["rep_a"], out["rep_b"], strict=True)) == pairs
    assert out["similarity"] == [len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b in pairs]
