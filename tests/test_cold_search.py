"""One question to tables without an index reads them, and gives what the index gives."""

import pytest

from quillstone.operators import retrieval as R
from quillstone.operators.fulltext import TextIndex
from quillstone.plans import catalog

SMALL = "/root/testdata/sf0.001"


def ask(spark, names):
    return {n: sorted(map(str, catalog.QUERIES[n](spark, SMALL).collect())) for n in names}


def test_a_question_builds_no_index(spark, monkeypatch):
    names = ["search_packet", "search_response", "search_token", "search_short_token", "search_meetings", "search_response_empty"]
    with monkeypatch.context() as m:

        def build(*_, **__):
            raise AssertionError("an index was built")

        m.setattr(TextIndex, "whole", staticmethod(lambda *_: False))
        m.setattr(TextIndex, "build", build)
        cold = ask(spark, names)
    assert all(cold.values())
    catalog.QUERIES["search_index"](spark, SMALL).count()
    assert TextIndex.whole(spark, catalog._index_root(catalog.Tables(spark, SMALL))) and ask(spark, names[:2]) == {n: cold[n] for n in names[:2]}


def test_what_follows_reads_hits_and_not_tables(spark):
    """A response takes the hits twice and a packet too; the texts aren't read again for that."""
    row = ("e", "U0", "t", "budget", "high", ["E1"])
    units = spark.createDataFrame([row], "event string, unit_id string, topic string, claim string, certainty string, evidence_ids array<string>").repartition(1)
    records = spark.createDataFrame([("e", "R0", "budget")], "event string, record_id string, clean_literal string").repartition(1)
    hits = R.search(units, records, "budget")
    assert "LogicalRDD" not in hits._jdf.queryExecution().optimizedPlan().toString()
    token = R.search_token(units, records, "budget")
    assert "LogicalRDD" not in token._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in token.collect()] == [(1, "U0", "budget", 1)]


@pytest.mark.parametrize("token, tier", [("budget", 1), ("bu", 2), ("zz", 3), ("qq", None)])
def test_tiers_in_turn(spark, token, tier):
    units = spark.createDataFrame([("U0", "t", "budget", "high"), ("U1", "t", "budget", "low")], "unit_id string, topic string, claim string, certainty string")
    records = spark.createDataFrame([("R0", "zz")], "record_id string, clean_literal string")
    got = R.search_token(units, records, token, limit=1).collect()
    assert [(r.tier, r["rank"]) for r in got] == ([] if tier is None else [(tier, 1)])
