import importlib
import sys

import pytest
from support import DATA, same_as_sql

from trialweave.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], f"{DATA}/sf0.001")


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_is_registered_without_what_the_training_data_operators_need(monkeypatch):
    import __spark_entry__ as entry

    for missing in ("trialweave.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, missing, None)
    assert set(importlib.reload(entry).queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLE_SQL)
    monkeypatch.undo()
    importlib.reload(entry)
