"""Lookups over a table of ids, and what happens when the service fails."""

import pytest

from valograph.sources import remote


def flaky(statuses):
    """A lookup that answers with the given statuses, and then well."""
    left = list(statuses)
    asked = []

    def fetch(ids):
        asked.append(list(ids))
        status = left.pop(0) if left else 200
        if status == 0:
            raise ConnectionError("reset")
        return (status, [f"got {i}" for i in ids])

    return fetch, asked


def test_a_lookup_that_fails_twice_is_asked_again(monkeypatch):
    pauses = []
    monkeypatch.setattr(remote.time, "sleep", pauses.append)
    fetch, asked = flaky([503, 0])
    assert remote.with_retries(fetch, pause=2.0)(["a", "b"]) == ["got a", "got b"]
    assert asked == [["a", "b"]] * 3 and pauses == [2.0, 4.0]


def test_a_wrong_request_is_not_repeated_and_attempts_end(monkeypatch):
    monkeypatch.setattr(remote.time, "sleep", lambda s: None)
    fetch, asked = flaky([404])
    with pytest.raises(remote.LookupFailed, match="404"):
        remote.with_retries(fetch)(["a"])
    assert len(asked) == 1
    fetch, asked = flaky([429] * 9)
    with pytest.raises(remote.LookupFailed, match="after 3 attempts"):
        remote.with_retries(fetch, attempts=3)(["a"])
    assert len(asked) == 3
    assert remote.with_retries(fetch)([]) == []


def test_tables_of_ids_are_asked_once_each_in_chunks(spark):
    state = {"failures": 2}

    def fetch(ids):
        assert 0 < len(ids) <= 4
        if state["failures"]:
            state["failures"] -= 1
            return (500, [])
        return [f"{len(set(ids)) == len(ids)} {i}" for i in ids]

    rows = [(f"w{i % 23}",) for i in range(200)] + [(None,)]
    got = remote.fetch_payloads(spark.createDataFrame(rows, "id string"), "id", fetch, chunk=4, pause=0.01).collect()
    assert sorted(r.payload for r in got) == sorted(f"True w{i}" for i in range(23))
    assert remote.fetch_payloads(spark.createDataFrame([], "id string"), "id", fetch).count() == 0
