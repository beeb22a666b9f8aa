"""Registration: one query for each operator, and SQL only where a query has it."""

import re

import __spark_entry__
from strandline.llm import entry


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in entry.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(entry.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(entry.ORACLE_SQL) <= set(entry.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
