"""What the driver plans at once: the tables that iterative operators read and join in one plan do not grow with their rounds."""

import pytest

from webloom.llm import line_dedup, session
from webloom.llm.components import components


@pytest.fixture
def planned(monkeypatch):
    """name without its round -> the most tables read by a plan that was written under it."""
    most, write = {}, session.written

    def written(df, name, rows=None):
        kind = name.rstrip("-0123456789")
        most[kind] = max(most.get(kind, 0), tables_read(df))
        return write(df, name, rows)

    monkeypatch.setattr(session, "written", written)
    return most


def tables_read(df):
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return leaves.size()


def repeated(spark, lines):
    """Two documents with one run of so many lines, of one word each."""
    run = "\n".join(f"word{k}" for k in range(lines))
    return spark.createDataFrame([(1, f"{run}\none"), (2, f"{run}\ntwo")], "doc_id bigint, text string")


def test_line_plans_do_not_grow_with_the_rounds(spark, planned):
    reads = []
    for least in (2, 60):
        planned.clear()
        out = line_dedup.dedup_lines(repeated(spark, 70), least_words=least)
        assert [(r["doc_id"], r["lines_deleted"]) for r in out.orderBy("doc_id").collect()] == [(1, 0), (2, 70)]
        reads.append((max(planned.values()), tables_read(out)))
    assert reads[0] == reads[1]


def test_passages_of_all_rounds_are_found(spark):
    for whole in (False, True):
        for least in (1, 2, 3, 31, 32, 33, 70):
            out = line_dedup.dedup_lines(repeated(spark, 70), least_words=least, whole_runs=whole)
            assert [(r["doc_id"], r["text"], r["lines_deleted"]) for r in out.orderBy("doc_id").collect()][1] == (2, "two", 70)


def test_a_round_of_components_reads_its_edges_eight_times_at_most(spark, planned):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)], "a bigint, b bigint")
    assert {r["component"] for r in components(links).collect()} == {0}
    assert planned["edges"] <= 8
