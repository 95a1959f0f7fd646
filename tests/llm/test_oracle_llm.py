"""The opN queries that SQL can express, against it; tables of several sizes."""

import pytest

from compare import check, connection
from dossier.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, name, folder):
    check(queries.QUERIES[name](spark, folder), connection(folder), queries.ORACLE_SQL[name])
