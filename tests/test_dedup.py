import random

import pytest
from pyspark.sql import functions as F

from wareloom.functions.vectors import difference_bits
from wareloom.operators import dedup


def sequential(rows):
    seen, out = [set(), set(), set()], {}
    for ordinal, *keys in sorted(rows):
        clash = next((f"k{i}" for i, k in enumerate(keys) if k is not None and k in seen[i]), None)
        out[ordinal] = (clash is None, clash)
        if clash is None:
            for i, k in enumerate(keys):
                seen[i].add(k)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_matches_sequential_model(spark, seed):
    rng = random.Random(seed)
    rows = [(i, *[None if rng.random() < 0.1 else f"v{rng.randrange(9 + 3 * seed)}" for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "ordinal bigint, k0 string, k1 string, k2 string").withColumn("kept", F.lit("clash"))
    got = {r["ordinal"]: (r["kept"], r["reason"]) for r in dedup.greedy_multikey(df, "ordinal", ["k0", "k1", "k2"]).collect()}
    assert got == sequential(rows)


def test_greedy_keeps_what_only_a_dropped_row_shares(spark):
    rows = [(1, "f1", "i1"), (2, "f1", "i2"), (3, "f3", "i2")]
    got = dedup.greedy_multikey(spark.createDataFrame(rows, "o bigint, f string, i string"), "o", ["f", "i"])
    assert {r["o"]: r["kept"] for r in got.collect()} == {1: True, 2: False, 3: True}
    assert dedup.greedy_multikey(spark.createDataFrame([], "o bigint, f string"), "o", ["f"]).count() == 0


def test_greedy_settles_a_chain_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(dedup, "checkpoint", lambda df: spark.createDataFrame(df.toArrow()))  # local rows: quicker rounds
    # each row shares one key with the row before and the other with the row after
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(206)]
    df = spark.createDataFrame(rows, "ordinal bigint, k0 string, k1 string").coalesce(1)
    got = {r["ordinal"]: (r["kept"], r["reason"]) for r in dedup.greedy_multikey(df, "ordinal", ["k0", "k1"]).collect()}
    assert got == sequential(rows)


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = [(i, "g" if i % 2 else "h", base[i % 12] ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(5)))) for i in range(80)]
    got = {(r["id_a"], r["id_b"], r["distance"]) for r in dedup.near_hash_pairs(spark.createDataFrame(rows, "id bigint, grp string, bits bigint"), "grp", "id", "bits", 4).collect()}
    firsts = {}
    for i, g, b in rows:
        firsts.setdefault((g, b), i)
    want = {
        (min(i, j), max(i, j), (a ^ b).bit_count())
        for (g, a), i in firsts.items() for (h, b), j in firsts.items() if g == h and i != j and (a ^ b).bit_count() <= 4
    }
    assert got == want


def test_difference_bits(spark):
    values = [float((i * 37) % 11) for i in range(64)]
    got = spark.createDataFrame([(values,)], "v array<double>").select(difference_bits(F.col("v")).alias("b")).head()["b"]
    assert got == int("".join("1" if a > b else "0" for a, b in zip(values, values[1:])), 2)


def test_leaks_only_exclude_training_rows(spark):
    rows = [("a", "b1", "m1", "train"), ("b", "b1", "m1", "test"), ("c", "b1", "m1", "train"), ("d", "b1", "", "train"), ("e", "", "m1", "test"), ("f", "b2", "m", "train"), ("g", "b2", "m", None)]
    df = spark.createDataFrame(rows, "id string, brand string, model string, split string")
    evidence = dedup.leak_evidence(df, ["brand", "model"], "id", "split")
    assert {r["train_id"] for r in evidence.collect()} == {"a", "c"}
    assert {r["id"] for r in dedup.without_leaks(df, evidence, "id", "split").collect()} == {"b", "d", "e", "f", "g"}
