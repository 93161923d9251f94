"""Registered queries of the subpackage against their SQL."""

import pytest

from termweave.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees_with_sql(name, same):
    same(Q.queries()[name], Q.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))
