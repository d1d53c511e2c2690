"""Plan guards: no registered query forms all pairs (no Cartesian product or
nested-loop join), and scans prune columns."""
import pytest

from conftest import SF

SLOW = {"word2vec_neighbours", "relevance_predict", "cbow_model", "cbow_continued", "cbow_neighbours"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    from lexicor.plans import registry
    registry.load_all()
    bad = []
    for name, fn in registry.QUERIES.items():
        if name in SLOW:
            continue
        plan = _plan(fn(spark, SF))
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def test_document_scan_reads_only_needed_columns(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["doc_sentences"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
