"""Line dedup whose filters don't fit one broadcast."""

import pytest
from test_texts import lines_brute

from tidewheel.llm import linededup


@pytest.mark.parametrize("keep", ["none", "first"])
def test_filters_in_portions(make, odd, monkeypatch, keep):
    monkeypatch.setattr(linededup, "SEGMENT_LINES", 40)
    looked = []
    monkeypatch.setattr(linededup, "over_batches", lambda df, f, schema, g=linededup.over_batches: looked.append(str(schema)) or g(df, f, schema))
    rows = [*odd, *[(20 + k, f"shared LINE \nown {k}\nends \u2028\nends\u2028\npair {k // 2}") for k in range(40)]]
    got = linededup.digest(linededup.dedup_lines(make(rows), min_docs=2, keep=keep, max_filter_bytes=0, max_keys_bytes=0)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == lines_brute(rows, 2, keep)
    assert sum(x.startswith("key binary") for x in looked) >= 1 and sum("bits" in x for x in looked) == 1  # the filters are asked at any bound


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_keys_are_broadcast_and_the_rest_joined(spark, make, odd, keep):
    rows = [*odd, *[(20 + k, f"hot line\nown {k}\nhot line\nfour {k // 4}\n four {k // 4} \nlast") for k in range(64)]]
    confirmed = linededup.repeated_lines(make(rows), min_docs=2)
    assert linededup._broadcast_from(confirmed, 10**6) == 0 and linededup._broadcast_from(confirmed, 400) == 6 and linededup._broadcast_from(confirmed, 0) == 64
    for most in (10**6, 400, 0):
        got = linededup.digest(linededup.dedup_lines(make(rows), min_docs=2, keep=keep, max_keys_bytes=most)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == lines_brute(rows, 2, keep)


def test_only_suspects_make_the_filter(spark, make):
    """100 segments of lines, of which a few repeat: the filter that goes out has one segment."""
    rows = [(k, "\n".join(f"line {k} {i}" for i in range(40)) + f"\ntwice {k // 2}") for k in range(100)]
    got = {}
    for r in linededup.repeated_lines(make(rows), min_docs=2).collect():
        got[bytes(r["key"])] = r["n"]
    assert got == {f"twice {k}".encode(): 2 for k in range(50)}
