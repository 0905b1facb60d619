"""Compare registered queries with their SQL: python tests/check_queries.py [folder] [query ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return db


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, db, name, folder):
    """Differences between a query and its SQL; an empty list means they agree."""
    df = entry.queries()[name](spark, folder)
    got = _rows(df.columns, df.collect())
    db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in db.description]
    kinds = {d[0]: str(d[1]).upper() for d in db.description}
    want = _rows(columns, db.fetchall())
    problems = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} <> {sorted(columns)}"]
    for field in df.schema:
        mine = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}[
            field.dataType.simpleString()]
        if mine not in kinds[field.name]:
            problems.append(f"type of {field.name}: {mine} <> {kinds[field.name]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} <> {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {bad[0]}"[:1500])
    return problems


if __name__ == "__main__":
    from conftest import make_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.oracle_sql())
    session, db = make_session(), connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems = compare(session, db, name, folder)
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n   ", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
