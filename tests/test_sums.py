"""Queries whose results hang on how averages are added up."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from prospectra.plans import catalog


def write(root, name, **columns):
    pq.write_table(pa.table(columns), f"{root}/{name}.parquet")


def test_gates_add_up_in_the_order_of_the_table(spark, tmp_path):
    rng, rows = random.Random(5), []
    for supplier in range(40):
        taxes = [i % 9 / 100 for i in range(594)]  # 0.04 on average, where a label turns
        rng.shuffle(taxes)
        rows += [(supplier, tax, rng.choice("RA"), f"{rng.randrange(1995, 2002)}-03-01") for tax in taxes]
    rng.shuffle(rows)
    suppliers, taxes, flags, days = map(list, zip(*rows))
    write(tmp_path, "lineitem", l_suppkey=suppliers, l_discount=[0.05] * len(rows), l_tax=taxes, l_returnflag=flags, l_shipdate=pa.array(days).cast(pa.timestamp("us")))
    c = duckdb.connect()
    c.execute("set threads = 1")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = sorted(c.execute(f"select l_suppkey, publishes, stage, reasons, label from ({catalog.oracle_sql()['publication_gates']})").fetchall())
    got = catalog.queries()["publication_gates"](spark, str(tmp_path)).select("l_suppkey", "publishes", "stage", "reasons", "label")
    assert len({row[4] for row in want}) == 2
    assert sorted(map(tuple, got.collect())) == want


def test_the_board_ranks_equal_averages_alike(spark, tmp_path):
    rng, rows, parts = random.Random(7), [], [n for n in range(1, 60) if n % 11]
    pairs = list(zip(parts[::2], parts[1::2]))
    for one, other in pairs:
        cents = [rng.randrange(11) for _ in range(31)]
        cents.append((sum(cents) + 1) % 2)  # an odd sum of cents by 32 lies in the middle of six digits
        rows += [(one, c / 100, 5.0) for c in cents] + [(other, c / 100, 1.0) for c in cents * 5]
    numbers, discounts, quantities = map(list, zip(*rows))
    write(tmp_path, "lineitem", l_partkey=numbers, l_discount=discounts, l_quantity=quantities, l_tax=[0.01] * len(rows))
    write(tmp_path, "part", p_partkey=parts, p_brand=["b"] * len(parts), p_name=["n"] * len(parts), p_size=pa.array([1] * len(parts), pa.int32()))
    scores = {r.p_partkey: r.score for r in catalog.queries()["discovery_board"](spark, str(tmp_path)).collect()}
    assert len(set(scores.values())) > 5
    assert [scores[one] for one, _ in pairs] == [scores[other] for _, other in pairs]
