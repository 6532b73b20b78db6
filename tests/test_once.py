"""What is dear is worked out once a row, and Python sees texts in steps."""

from __future__ import annotations

from evidara.plans import registry

registry.load()
SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_web_queries_cut_a_text_into_lines_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    assert plan(registry.QUERIES["FN-21_web_queries"](spark, SMALL)).count("split(coalesce(text") == 1


def test_texts_are_printed_once_before_they_are_compared(spark):
    assert "regexp_replace" not in plan(registry.QUERIES["JN-17_text_similarity"](spark, SMALL))


def test_serialised_cells_are_read_once(spark):
    for name in ("SRC-24_legacy_cells", "SRC-24_legacy_headers"):
        assert "TableCell" not in plan(registry.QUERIES[name](spark, SMALL))


def test_python_holds_a_step_of_texts_at_a_time(monkeypatch):
    """What the work of a step makes is Arrow before the next step is read; nulls, empty arrays and a text over the limit keep their places."""
    import re

    import pyarrow as pa

    from evidara.operators import segments as G
    from evidara.operators import steps

    seen = []
    work = lambda texts: seen.append(texts) or pa.array([None if t is None else len(t) for t in texts], pa.int32())
    texts = ["ab"] * 10 + [None, "c" * 50, ""]
    assert steps.in_steps(pa.array(texts), work, limit=8, rows=3).to_pylist() == [None if t is None else len(t) for t in texts]
    assert sum(seen, []) == texts and max(map(len, seen)) == 3 and ["c" * 50] in seen
    assert steps.in_steps(pa.array([], pa.string()), work).to_pylist() == []
    got = G._all_matches(pa.array(["12 é3", None, "", "x"]), re.compile(r"\d+")).to_pylist()
    assert got == [[{"start": 0, "end": 2, "label": "12"}, {"start": 4, "end": 5, "label": "3"}], None, [], []]


def test_bindings_find_the_first_bad_selector_without_a_join(spark):
    assert plan(registry.QUERIES["BND-01_bind"](spark, SMALL)).count("Join LeftOuter") == 3


def test_a_dump_counts_annotations_where_it_reads_the_text(spark):
    assert plan(registry.QUERIES["TXT-14_dump"](spark, SMALL)).count("Join LeftOuter") == 2


def test_few_bytes_of_notes_are_dealt_before_python_reads_them(spark):
    for name in ("TXT-13_digest", "TXT-14_dump"):
        assert "RepartitionByExpression [id" in plan(registry.QUERIES[name](spark, SMALL))


def test_kinds_of_selectors_meet_in_one_shuffle(spark):
    assert "count(distinct" not in plan(registry.QUERIES["AGG-18_selector_types"](spark, SMALL))
