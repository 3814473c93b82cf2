"""Calls that fail by a rule, and pool sources that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import calls
from lumenrank.plans import derived
from tests.conftest import SF


def service(folder, fails):
    """Answers in upper case; texts in ``fails`` fail that often first (-1: for ever, -2: refused). Every call leaves a line in ``folder``."""

    def make():
        seen = {}

        def call(text):
            seen[text] = seen.get(text, 0) + 1
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as log:
                log.write(json.dumps(text) + "\n")
            left = fails.get(text, 0)
            if left == -2:
                raise calls.Refused("never")
            if left == -1 or seen[text] <= left:
                raise TimeoutError("late")
            return text.upper()

        return call

    return make


def sent(folder):
    out = []
    for name in os.listdir(folder):
        with open(folder / name) as log:
            out += [json.loads(line) for line in log]
    return sorted(out)


ROWS = [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, None), (6, ""), (7, "a"), (1, "a")]


def test_failures_are_rows_and_a_second_run_does_what_is_left(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "id int, text string").coalesce(1)
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    first = calls.call_all(rows, f"{tmp_path}/kept", service(one, {"b": 1, "c": -1, "d": -2}), parts=3, wait=0.0)
    got = {r["id"]: (r["answer"], r["error"], r["tries"]) for r in first.collect()}
    assert got == {
        1: ("A", None, 1), 2: ("B", None, 2), 3: (None, "TimeoutError: late", 3), 4: (None, "Refused: never", 1), 5: (None, None, 0), 6: ("", None, 1), 7: ("A", None, 1),
    }
    assert sent(one) == ["", "a", "a", "b", "b", "c", "c", "c", "d"]
    second = calls.call_all(rows, f"{tmp_path}/kept", service(two, {}), parts=3, wait=0.0)
    got = {r["id"]: r["answer"] for r in second.collect()}
    assert sent(two) == ["c", "d"] and got == {1: "A", 2: "B", 3: "C", 4: "D", 5: None, 6: "", 7: "A"}


def test_calls_are_not_repeated_by_the_plan(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id int, text string")
    out = rows.withColumn("r", calls.called(F.col("text"), service(tmp_path, {}), wait=0.0)).select("id", "r.answer", "r.error", "r.tries").where("tries > 0")
    assert len(out.collect()) == 40 and len(sent(tmp_path)) == 40


def test_empty_and_wrong_settings(spark, tmp_path):
    none = spark.createDataFrame([], "id int, text string")
    assert calls.call_all(none, f"{tmp_path}/kept", service(tmp_path, {}), parts=1).collect() == []
    with pytest.raises(ValueError):
        calls.called(F.col("text"), service(tmp_path, {}), tries=0)


def test_generated_queries_of_notes(spark, tmp_path):
    """Over documents: notes whose text has an odd length fail; the others give a query each."""
    notes = derived.notes(spark, SF).select("source", "text")

    def make():
        def call(text):
            if len(text) % 2:
                raise ValueError("odd")
            return "not json" if len(text) % 4 else json.dumps({"queries": [{"query": text[:5], "passage": text[:9], "type": "exact"}]})

        return call

    done = calls.call_all(notes, f"{tmp_path}/kept", make, key="source", parts=2, tries=1)
    made, failed = calls.generated_queries(done)
    texts = {r["source"]: r["text"] for r in notes.collect() if r["text"] is not None}
    assert {(r["source_file"], r["query"]) for r in made.collect()} == {(s, t[:5]) for s, t in texts.items() if len(t) % 4 == 0}
    assert {(r["source_file"], r["error"]) for r in failed.collect()} == {(s, "ValueError: odd" if len(t) % 2 else "unreadable answer") for s, t in texts.items() if len(t) % 4}
