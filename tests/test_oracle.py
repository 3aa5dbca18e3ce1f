import os
from pathlib import Path

import duckdb
import pytest

from tomeforge import catalog

#: TOMEFORGE_SF=sf0.01 runs the comparison at another scale.
DATA = f"/root/testdata/{os.environ.get('TOMEFORGE_SF', 'sf0.001')}"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    own = catalog.queries()[name](spark, DATA)
    columns = sorted(own.columns)
    got = sorted(str(tuple(r)) for r in own.select(*columns).collect())
    found = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert got == sorted(str(tuple(r[names.index(x)] for x in columns)) for r in found.fetchall())
