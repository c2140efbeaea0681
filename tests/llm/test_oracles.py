import pytest

from folio.llm.oracles import ORACLES
from folio.llm.queries import QUERIES
from tests.test_queries import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):  # noqa: F811
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in sorted(names)) for r in df.collect()), key=repr) == expected
