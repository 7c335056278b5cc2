import pytest

from quire.plans import transport
from quire.sources.sinks import run_name


def test_retries_and_waits():
    calls, waits = [], []

    def client(prompt):
        calls.append(prompt)
        if len(calls) < 4:
            raise OSError("down")
        return "ok", "length", {"total_tokens": 3}

    assert transport.retried(client, "p", sleep=waits.append) == ("ok", transport.CUT_OFF, {"total_tokens": 3}, 4)
    assert len(waits) == 3 and waits == sorted(waits) and 4 <= waits[2] <= 5
    assert transport.wait(9) == transport.LONGEST_WAIT

    def broken(prompt):
        raise OSError("down")

    waits.clear()
    assert transport.retried(broken, "p", 3, waits.append) == ("Error", "error", {}, 3)
    assert len(waits) == 2


def test_structured_replies():
    replies = iter(["no json", '{"a": 1, "b": []}'])
    n = iter([5, 7])
    got = transport.structured(lambda p: (next(replies), "stop", {"total_tokens": next(n)}), "p", ["a", "b"])
    assert got["value"] == {"a": 1, "b": []} and got["usage"] == {"total_tokens": 7} and got["error"] is None
    bad = transport.structured(lambda p: ("[1]", "stop", {}), "p", ["a"])
    assert bad["value"] is None and bad["error"] == "missing keys"


def factory():
    def client(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper(), "stop", {"total_tokens": len(prompt)}

    return client


def test_calls_from_executors(spark):
    df = spark.createDataFrame([(1, "one"), (2, "bad"), (3, "three")], "id long, prompt string").repartition(2)
    got = {r.id: r for r in transport.ask(df, factory, attempts=1).collect()}
    assert (got[1].reply, got[1].finish, got[3].total_tokens) == ("ONE", "finished", 5)
    assert (got[2].reply, got[2].finish, got[2].attempts) == ("Error", "error", 1)


def test_run_names():
    import datetime

    assert run_name("a/b", datetime.datetime(2024, 5, 6, 7, 8, 9)) == "a-b_20240506_070809"


def test_sampled_verification(spark):
    from pyspark.sql import functions as F

    from quire.operators import toc

    rows = [(d, i) for d in range(3) for i in range(d * 4 + 2)]
    items = spark.createDataFrame(rows, "doc_id int, idx int")
    got = toc.sampled(items, 5, seed=1)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 5, 2: 5}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, toc.sampled(items, 5, seed=1).collect()))


def test_public_names():
    import quire

    assert set(quire.__all__) <= set(dir(quire))
    with pytest.raises(AttributeError):
        quire.nothing
