"""Runs DuckDB statements in a process of its own: oracle.py <folder> <in.pickle> <out.pickle>."""

import os
import pickle
import subprocess
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def answers(folder: str, statements: dict[str, str], tmp) -> dict:
    """From name to (columns, rows)."""
    source, target = tmp / "in.pickle", tmp / "out.pickle"
    source.write_bytes(pickle.dumps(statements))
    subprocess.run([sys.executable, __file__, folder, str(source), str(target)], check=True)
    return pickle.loads(target.read_bytes())


def main(folder: str, source: str, target: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    out = {}
    for name, sql in pickle.load(open(source, "rb")).items():
        r = con.sql(sql)
        out[name] = (r.columns, r.fetchall())
    pickle.dump(out, open(target, "wb"))


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def same(df, answer) -> bool:
    """Whether a DataFrame has the rows of an answer, in any order, columns by name."""
    columns, rows = answer
    names = sorted(df.columns)
    if names != sorted(columns):
        return False
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in rows), key=repr)
    return got == want


if __name__ == "__main__":
    main(*sys.argv[1:])
