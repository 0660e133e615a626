"""Compare registered queries with their SQL in DuckDB: python tests/oracle_check.py FOLDER [MODULE_OR_QUERY ...]"""

import importlib
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def cell(v):
        if isinstance(v, float):
            return f"{v:.4f}"
        if hasattr(v, "isoformat"):
            text = v.isoformat()
            return text[:-9] if text.endswith("T00:00:00") else text
        return str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, query, sql):
    t = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if sql is None:
        return ("rows-only", len(rows), None, spent, 0.0, df.columns, [], [])
    t = time.time()
    rel = con.sql(sql)
    names, expected = rel.columns, rel.fetchall()
    sql_spent = time.time() - t
    a, b = canon(rows, df.columns), canon(expected, names)
    same = sorted(df.columns) == sorted(names) and a == b
    only_a = [x for x in a if x not in set(b)][:4] if not same else []
    only_b = [x for x in b if x not in set(a)][:4] if not same else []
    return ("ok" if same else "DIFF", len(rows), len(expected), spent, sql_spent, (sorted(df.columns), sorted(names)), only_a, only_b)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


if __name__ == "__main__":
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    names = [w for w in wanted if os.path.exists(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "lexloom/registry", w + ".py"))]
    queries, oracles = {}, {}
    if names:
        for n in names:
            m = importlib.import_module(f"lexloom.registry.{n}")
            queries.update(m.QUERIES)
            oracles.update(m.ORACLES)
    else:
        from lexloom.registry import all_oracles, all_queries
        queries, oracles = all_queries(), all_oracles()
        if wanted:
            queries = {k: q for k, q in queries.items() if k in wanted}
    con, bad = connect(folder), []
    for name, q in queries.items():
        try:
            status, n, m, spent, sql_spent, cols, a, b = compare(spark, con, folder, q, oracles.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            status, n, m, spent, sql_spent, cols, a, b = "ERROR", 0, 0, 0, 0, str(e)[:700], [], []
        print(f"== {status:9} {name:28} rows={n} sql={m} spark={spent:.2f}s duckdb={sql_spent:.2f}s", flush=True)
        if status in ("DIFF", "ERROR"):
            bad.append(name)
            print("   cols", cols, "\n   spark only", a, "\n   sql only", b, flush=True)
    print("BAD:", bad, "of", len(queries))
