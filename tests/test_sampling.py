import hashlib

from wareloom.operators import sampling


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def rows(spark, n=57):
    return spark.createDataFrame([(i, None if i % 10 == 0 else f"g{i % 3}", "clash") for i in range(n)], "id bigint, grp string, position string").drop("position")


def test_stratified_split_matches_sequential_model(spark):
    df = rows(spark)
    got = {r["id"]: r["split"] for r in sampling.stratified_split(df, "grp", "id").collect()}
    want = {}
    for g in {r["grp"] for r in df.collect()}:
        ids = sorted((r["id"] for r in df.collect() if r["grp"] == g), key=lambda i: (sha("split", 42, i), i))
        a, b = int(len(ids) * 0.8), int(len(ids) * 0.1)
        want |= {i: "train" if k < a else "validation" if k < a + b else "test" for k, i in enumerate(ids)}
    assert got == want
    again = {r["id"]: r["split"] for r in sampling.stratified_split(df.repartition(7), "grp", "id").collect()}
    assert again == got


def test_samples_and_assignments(spark):
    df = rows(spark).where("grp IS NOT NULL")
    sample = sampling.sample_per_group(df, "grp", "id", 5).collect()
    assert len(sample) == 15
    blind = sampling.blind_assignment(df, "id").collect()
    assert sum(r["left_is"] == "A" for r in blind) == len(blind) // 2 and len({r["pair_id"] for r in blind}) == len(blind)
    balanced = sampling.balanced_assignment(df, "grp", "id").collect()
    for g in {r["grp"] for r in balanced}:
        mine = [r for r in balanced if r["grp"] == g]
        assert abs(2 * sum(r["left_is"] == "A" for r in mine) - len(mine)) <= 1
    steps = sampling.epoch_groups(df, "id", 1, 8).groupBy("step").count().collect()
    assert sorted(r["count"] for r in steps)[1:] == [8] * (len(steps) - 1)


def test_quota_marks_short_groups_and_replacements_keep_position(spark):
    df = rows(spark).where("grp IS NOT NULL")
    quotas = spark.createDataFrame([("g0", 3), ("g1", 99)], "grp string, quota int")
    chosen = sampling.quota_selection(df, quotas, "grp", "id")
    assert {r["grp"]: r["short"] for r in chosen.collect()} == {"g0": False, "g1": True}
    ids = [r["id"] for r in chosen.where("grp = 'g0'").collect()]
    swaps = spark.createDataFrame([(ids[0], 1000, "g0"), (ids[1], 1001, "other"), (ids[2], ids[0], "g0")], "old bigint, new bigint, new_group string")
    after = {r["id"]: r["replaced"] for r in sampling.replace_selected(chosen.select("id", "grp", "rank"), swaps, "id", "grp").collect()}
    assert after[1000] and not after[ids[1]] and not after[ids[2]] and ids[0] not in after


def test_empty_input(spark):
    empty = rows(spark).limit(0)
    assert sampling.stratified_split(empty, "grp", "id").count() == 0
    assert sampling.blind_assignment(empty, "id").count() == 0
