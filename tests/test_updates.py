"""Updates by bucket, and unique and link rules at update."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmill.operators.quality import split_updates
from talentmill.sources.buckets import Bucketed

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.LongType())])


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names
            if f.endswith(".parquet") and "_published" not in d}


def table(spark, path, n=200, buckets=8):
    place = Bucketed(spark, str(path))
    place.clear(buckets)
    place.append(spark.range(n).select("id", (F.col("id") * 10).alias("x")))
    return place


def rows(spark, path):
    return {(r.id, r.x) for r in Bucketed(spark, str(path)).read(SCHEMA).collect()}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    place = table(spark, tmp_path)
    before = files(tmp_path)
    assert rows(spark, tmp_path) == {(i, 10 * i) for i in range(200)}
    keys = spark.createDataFrame([(3,), (3,), (None,), (7777,)], "id long")
    touched = {r[0] for r in keys.where("id is not null").select(place.bucket()).distinct().collect()}
    Bucketed(spark, str(tmp_path)).update(keys, SCHEMA, lambda df: df.withColumn("x", F.when(F.col("id") == 3, -1).otherwise(F.col("x"))))
    assert rows(spark, tmp_path) == {(i, -1 if i == 3 else 10 * i) for i in range(200)}
    now = Bucketed(spark, str(tmp_path))
    assert {b for b, v in now.live if (b, v) not in place.live} == touched
    assert before <= files(tmp_path) and len({f.split("/")[0] for f in files(tmp_path) - before}) == len(touched) < 8
    now.expire()
    assert rows(spark, tmp_path) == {(i, -1 if i == 3 else 10 * i) for i in range(200)}
    assert {f.split("/")[0] for f in before - files(tmp_path)} == {f"bucket={b}" for b in touched}


def test_a_failed_update_leaves_the_old_state(spark, tmp_path):
    table(spark, tmp_path)
    fail = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        Bucketed(spark, str(tmp_path)).update(spark.range(50), SCHEMA, lambda df: df.withColumn("x", fail("x")))
    assert rows(spark, tmp_path) == {(i, 10 * i) for i in range(200)}


def test_of_two_writers_from_one_state_the_second_fails(spark, tmp_path):
    table(spark, tmp_path)
    one, two = Bucketed(spark, str(tmp_path)), Bucketed(spark, str(tmp_path))
    one.append(spark.createDataFrame([(900, 1)], SCHEMA))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        two.append(spark.createDataFrame([(901, 1)], SCHEMA))
    assert {i for i, _ in rows(spark, tmp_path)} == {*range(200), 900}


def test_an_unfinished_state_does_not_count(spark, tmp_path):
    table(spark, tmp_path)
    os.makedirs(tmp_path / "_published" / "state=000000000099")
    assert len(rows(spark, tmp_path)) == 200


def test_empty_updates_and_empty_tables(spark, tmp_path):
    place = table(spark, tmp_path, n=0)
    assert rows(spark, tmp_path) == set()
    place.update(spark.range(3), SCHEMA, lambda df: df)
    place.update(spark.range(0), SCHEMA, lambda df: df)
    assert rows(spark, tmp_path) == set() and files(tmp_path) == set()


T0 = dt.datetime(2030, 1, 1)
CHANGES = "id long, set_fields array<string>, changed_at timestamp, seq long, email string, user_id long, name string"


def refused(stored, moves):
    """Plain fixpoint over net moves {id: new value}."""
    moves = {i: x for i, x in moves.items() if stored[i] != x}
    out = {i for i, x in moves.items() if any(moves[o] == x and o < i for o in moves)}
    out |= {i for i, x in moves.items() if any(e == x and o not in moves for o, e in stored.items())}
    while more := {i for i, x in moves.items() if i not in out and any(stored[o] == x for o in out)}:
        out |= more
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unique_values_after_the_whole_batch(spark, seed):
    rng = random.Random(seed)
    stored = {i: f"m{i}" for i in range(30)}
    net = {i: f"m{rng.randrange(36)}" for i in rng.sample(range(30), 18)}
    net.update({0: "m1", 1: "m2", 2: "m0"} if seed == 1 else {})
    changes = [(i, ["email"], T0, 2, x, None, None) for i, x in net.items()]
    changes += [(i, ["email", "name"], T0, 1, "m5", None, "earlier") for i in list(net)[:5]] + [(i, ["name"], T0, 3, "m9", None, "n") for i in range(3)]
    people = spark.createDataFrame([(i, e) for i, e in stored.items()], "id long, email string")
    good, bad = split_updates(spark.createDataFrame(changes, CHANGES), "recruiters", ["email", "name"], people, {})
    wrong = refused(stored, net)
    assert {(r.id, r.seq) for r in bad.collect()} == {(c[0], c[3]) for c in changes if c[0] in wrong and "email" in c[1]}
    assert all(r.broken_rules == ["email unique"] for r in bad.collect())
    assert good.count() + bad.count() == len(changes)
    after = {**stored, **{i: x for i, x in net.items() if i not in wrong}}
    assert len(set(after.values())) == len(after)


def test_values_may_be_swapped_and_links_need_parents(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, email string")
    changes = spark.createDataFrame([
        (1, ["email"], T0, 1, "b", None, None), (2, ["email"], T0, 2, "a", None, None), (3, ["user_id"], T0, 3, None, 9, None),
        (3, ["user_id"], T0, 4, None, None, None), (3, ["user_id", "email"], T0, 5, "c", 8, None), (3, ["email"], T0, 6, None, 9, None)], CHANGES)
    users = spark.createDataFrame([(8,), (8,)], "id long")
    good, bad = split_updates(changes, "recruiters", ["email", "user_id"], people, {"users": users})
    assert {(r.seq, *r.broken_rules) for r in bad.collect()} == {(3, "user_id in users"), (6, "email not null")}
    assert sorted(r.seq for r in good.collect()) == [1, 2, 4, 5]
