"""Compare column types of each registered query with its DuckDB oracle (sf0.001)."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def main():
    from citegraph.session import get_spark
    from tests.oracle_check import duck
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = get_spark()
    con = duck(sf)
    qs, oracle = E.queries(), E.oracle_sql()
    for n in names or list(oracle):
        sdf = qs[n](spark, sf)
        st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema}
        rel = con.sql(oracle[n])
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        bad = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        print(("TYPES-OK " if not bad else "TYPES-DIFF ") + n + ("" if not bad else f" {bad}"), flush=True)


if __name__ == "__main__":
    main()
