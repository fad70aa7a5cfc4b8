"""Conflicts by key and by hash of the key against SQL, on keys that collide and keys that are null."""

import duckdb
import pytest

from tidelog import queries as engine
from tidelog.functions.hashes import fingerprint_of

# order, supplier, flag: A is a read, R a write
COLLIDING = [(10, 10000, "R"), (11, 10, "A"), (11, 5, "R"), (20, 20, "R"), (20, 10, "R"), (21, 20, "A"), (21, 10010, "A"), (21, 6, "R"), (22, 20000, "A"), (22, 7, "R")]
NULL = [(30, 8, "R"), (31, 8, "A"), (31, None, "R"), (40, None, "R"), (41, None, "A"), (41, 9, "R"), (50, 9, "R"), (51, 9, "A")]


@pytest.mark.parametrize("name", ["occ_conflicts", "occ_conflicts_hash"])
@pytest.mark.parametrize(("lines", "want"), [(COLLIDING, [22]), (NULL, [32])])
def test_conflicts(spark, tmp_path, name, lines, want):
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(c for (c,) in con.sql(engine.oracle_sql()[name]).fetchall()) == want
    assert sorted(r.commit_ts for r in engine.queries()[name](spark, str(tmp_path)).collect()) == want


def test_keys_collide():
    assert len({fingerprint_of(b"supplier_%06d" % k) for k in (10, 10000)}) == 1
    assert len({fingerprint_of(b"supplier_%06d" % k) for k in (20, 10010, 20000)}) == 1
