"""Coverage as stream state: a restart in mid-stream, repeats, and the batch operator's counters."""

import random

import pytest

from ionweave.operators.aggregates import identity_coverage
from ionweave.streaming import coverage

PROXIES = {"am": "ammonium", "de": "dehydrated"}


@pytest.fixture()
def parts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", "", None, *map(str, range(40))]), rng.choice(["up", "am", "de", "zz", None]), rng.choice(["1", "2", "3", "", None])) for _ in range(900)]
    rows += [("hot", "am", str(k % 2)) for k in range(500)]
    schema = "ident string, kind string, sig string"
    return [spark.createDataFrame(rows[k::4], schema).coalesce(1) for k in range(4)], spark.createDataFrame(rows, schema), str(tmp_path)


def values(pair):
    return [sorted(map(tuple, df.collect())) for df in pair]


def test_restart_gives_the_batch_result(spark, parts):
    split, whole, folder = parts
    stream = lambda: spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = lambda: coverage.incremental_coverage(stream(), "ident", "kind", "sig", "up", PROXIES, f"{folder}/out", f"{folder}/state")
    seen = None
    for k, part in enumerate(split):
        part.write.mode("append").parquet(f"{folder}/in")
        if k == 1:
            continue  # two files are waiting at the next start
        got = run()
        seen = part if seen is None else split[0].union(split[1]).union(split[2]) if k == 2 else whole
        assert values(got) == values(identity_coverage(seen, "ident", "kind", "sig", "up", PROXIES)), k
    updates = spark.read.parquet(f"{folder}/out")
    again = updates.count()
    split[0].write.mode("append").parquet(f"{folder}/in")  # nothing new in it
    assert values(run()) == values(identity_coverage(whole, "ident", "kind", "sig", "up", PROXIES))
    assert spark.read.parquet(f"{folder}/out").count() == again and updates.filter("identity = 'hot'").count() == 2


def test_nothing(spark, parts):
    split, whole, folder = parts
    split[0].limit(0).write.parquet(f"{folder}/in")
    got = coverage.incremental_coverage(spark.readStream.schema(whole.schema).parquet(f"{folder}/in"), "ident", "kind", "sig", "up", PROXIES, f"{folder}/out", f"{folder}/state")
    assert values(got)[0] == [(0,) * 7]


def test_state_is_sparks_own_and_each_fact_is_emitted_once(spark, parts):
    split, whole, folder = parts
    split[0].write.parquet(f"{folder}/in")
    twice = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    facts = coverage.coverage_facts(twice, "ident", "kind", "sig", "up", PROXIES)
    assert "dedup" in facts._jdf.queryExecution().analyzed().toString().lower()
    split[0].write.mode("append").parquet(f"{folder}/in")
    coverage.incremental_coverage(twice, "ident", "kind", "sig", "up", PROXIES, f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out").select("identity", "direct", "proxy", "sig")
    assert out.count() == out.distinct().count() > 0 and out.filter("proxy is not null and (sig is null or sig = '')").count() == 0
