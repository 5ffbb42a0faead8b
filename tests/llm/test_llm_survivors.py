import random

from ampora.llm import survivors as s


def test_alignment_and_consensus():
    assert s.consensus([["a", "b", "c"], ["a", "c"], ["x", "b", "c", "d"]], [1, 1, 1]) == ["a", "b", "c"]
    assert s.consensus([["a"], ["b"], ["b"]], [1, 1, 1]) == ["b"]
    assert s.consensus([["a"], ["b"], ["b"]], [4, 2, 1]) == ["a"]  # the first outweighs all others together
    assert s.closest(["one value"], [1.0]) == 0
    assert s.closest(["North Wind Farm", "North Wind Farm Ltd", "Nort Wind Farm Ltd"], [1.0, 1.0, 1.0]) == 1
    assert s.closest(["a b", "c d"], [1.0, 1.0]) == 0


def test_split_alignment_is_as_long(monkeypatch):
    rnd = random.Random(2)
    columns = [{rnd.randrange(6)} for _ in range(60)]
    tokens = [rnd.randrange(6) for _ in range(50)]
    whole = s.align(columns, tokens)
    monkeypatch.setattr(s, "CELLS", 16)
    split = s.align(columns, tokens)
    for placed in (whole, split):
        used = [c for c in placed if c is not None]
        assert used == sorted(set(used)) and all(t in columns[c] for t, c in zip(tokens, placed) if c is not None)
    assert sum(c is not None for c in whole) == sum(c is not None for c in split)


def test_dominant_weights_choose_the_first_and_others_do_not():
    """With weights in which each value outweighs all after it the vote is the order of precedence; with equal ones it isn't."""
    rnd = random.Random(7)
    differ = 0
    for _ in range(200):
        values = list(dict.fromkeys(" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 6))) for _ in range(5)))
        n = len(values)
        assert s.closest(values, [2.0 ** (n - k) for k in range(n)]) == 0
        differ += s.closest(values, [1.0] * n) != 0
    assert differ > 20


def test_half_of_the_weight_settles_a_vote():
    rnd = random.Random(3)
    for _ in range(300):
        values = list(dict.fromkeys(" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 7))) for _ in range(rnd.randrange(2, 5))))
        weights = [float(rnd.randrange(1, 5)) for _ in values]
        k = rnd.randrange(len(values))
        weights[k] = max(sum(weights) - weights[k], max(weights))
        if weights[k] * 2 >= sum(weights):
            assert s.closest(values, weights) == weights.index(max(weights))


def test_consensus_survivors_of_hot_groups(spark):
    rows = []
    for i in range(900):  # 300 distinct slips of one name, more than a block, against the name itself
        value = "North Harbour Wind Farm" if i % 3 else f"North Harbour {i} Wind Farm"
        rows.append(("hot", "name", value, (False, False, -1, 0, i), "x"))
    rows += [("k", "name", "Alpha Solar Park", (False, False, -1, 0, 1000), "x"), ("k", "name", "Alpha Solar", (False, False, -1, 0, 1001), "x"), ("k", "name", "Alpha Solar Park", (False, False, -5, 0, 1002), "x")]
    schema = "canonical_key string, field string, value string, rank struct<in_conflict:boolean,no_evidence:boolean,distrust:int,age:bigint,row_id:bigint>, weight string"
    got = {r.canonical_key: (r.row_id, r.value) for r in s.consensus_survivors(spark.createDataFrame(rows, schema).drop("weight"), s.record_weight()).collect()}
    assert got == {"hot": (1, "North Harbour Wind Farm"), "k": (1002, "Alpha Solar Park")}


def brute(rows):
    best = {}
    for key, field, value, rank in rows:
        if (key, field) not in best or rank < best[key, field][0]:
            best[key, field] = (rank, value)
    return {k: (v[0][-1], v[1]) for k, v in best.items()}


def test_survivors_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(1500):  # one group of a third of all rows, with more distinct values than a block
        key = "hot" if i % 3 == 0 else f"k{i % 40}"
        rows.append((key, "owner", f"value {rnd.randrange(900)} of {rnd.choice('abc')}", (rnd.random() < 0.3, rnd.random() < 0.5, -rnd.randrange(5), -rnd.randrange(9), i)))
    schema = "canonical_key string, field string, value string, rank struct<in_conflict:boolean,no_evidence:boolean,distrust:int,age:bigint,row_id:bigint>"
    got = {(r.canonical_key, r.field): (r.row_id, r.value) for r in s.survivors(spark.createDataFrame(rows, schema)).collect()}
    assert got == brute(rows)


def test_field_values_edges(spark):
    projects = spark.createDataFrame(
        [
            (1, "k", "s", '{"a":"x","b":"TBD","c":5}', "[]", '{"a":"e"}', "2024-01-01 00:00:00"),
            (2, "k", None, '{"a":"y","b":" ? ","c":null}', '[{"field":"a","values":["y","z"]}]', None, None),
            (3, "k", "s", None, None, "no json", "2024-01-01 00:00:00"),
            (4, "single", "s", '{"a":"x"}', "[]", None, "2024-01-01 00:00:00"),
            (5, None, "s", '{"a":"x"}', "[]", None, "2024-01-01 00:00:00"),
        ],
        "row_id long, canonical_key string, source_id string, fields_json string, conflicts_json string, evidence_json string, updated_at string",
    )
    sources = spark.createDataFrame([("s", 3), ("s", 3)], "source_id string, trust_level int")
    got = {(r.canonical_key, r.field, r.row_id) for r in s.found(projects, sources).collect()}
    assert got == {("k", "a", 1), ("k", "c", 1)}
    assert s.found(projects.limit(0), sources).count() == 0
