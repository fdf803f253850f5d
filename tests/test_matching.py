"""Assignments and identities against plain versions, with ties, hubs, cycles and contradictions."""

import itertools
import random

from pyspark.sql import functions as F

from prospectra.operators import matching


def plainly_assigned(pairs):
    best = {}
    for a, b, s in pairs:
        if a is not None and b is not None and s is not None and s == s:
            best[a, b] = max(s, best.get((a, b), s))
    everyone = {a for a, _ in best}
    out = {}

    def single(key, side):
        mine = [(s, p[1 - side]) for p, s in best.items() if p[side] == key]
        top = [o for s, o in mine if s == max(mine)[0]]
        return top[0] if len(top) == 1 else None

    while True:
        met = [(a, b) for a, b in best if single(a, 0) == b and single(b, 1) == a]
        if not met:
            break
        out |= {a: (b, "matched") for a, b in met}
        best = {p: s for p, s in best.items() if p[0] not in {a for a, _ in met} and p[1] not in {b for _, b in met}}
    for a in everyone - set(out):
        out[a] = (None, "exhausted" if not any(p[0] == a for p in best) else "ambiguous" if single(a, 0) is None else "contested")
    return out


def test_assignment_equals_a_plain_version(spark):
    r = random.Random(7)
    for n, m, k, top in ((12, 9, 60, 4), (40, 40, 300, 50), (30, 3, 70, 9)):
        pairs = [(r.randrange(n), r.randrange(m), float(r.randrange(top))) for _ in range(k)]
        pairs += [pairs[0], (None, 1, 9.0), (1, None, 9.0), (2, 2, None), (3, 1, float("nan")), (99, 0, 1.0), (98, 0, 1.0)]
        got = matching.assign(spark.createDataFrame(pairs, "l long, r long, s double").repartition(3), "l", "r", "s").collect()
        assert {x.l: (x.r, x.status) for x in got} == plainly_assigned(pairs) and len(got) == len({x.l for x in got})
        taken = [x.r for x in got if x.r is not None]
        assert len(taken) == len(set(taken))
    assert matching.assign(spark.createDataFrame([], "l long, r long, s double"), "l", "r", "s").count() == 0


def test_rounds_in_one_task_or_in_many_give_the_same(spark, monkeypatch):
    r = random.Random(11)
    pairs = spark.createDataFrame([(r.randrange(15), r.randrange(12), float(r.randrange(9))) for _ in range(80)], "l long, r long, s double")
    rows = spark.createDataFrame([(i, r.choice([None, 1, 2]), r.choice([None, None, 7, 8])) for i in range(40)], "id long, k int, m int")
    links = spark.createDataFrame([(r.randrange(40), r.randrange(40), float(r.randrange(1, 4))) for _ in range(60)], "a long, b long, weight double")
    both = []
    for most in (matching.AT_ONCE, 25, -1):
        monkeypatch.setattr(matching, "AT_ONCE", most)
        done = matching.identities(rows, "id", links, ["k", "m"]) if most >= 0 else None
        both.append((sorted(map(str, matching.assign(pairs, "l", "r", "s").collect())), sorted(map(tuple, done.collect())) if done else both[0][1]))
    assert both[0] == both[1] == both[2]


def test_names_that_clash(spark):
    """Two links of the same name and team for two players of that name: ambiguous, unless an id tells one of them."""
    pairs = [("p1", "a", 1.0), ("p1", "b", 1.0), ("p2", "a", 1.0), ("p2", "b", 1.0), ("q1", "c", 1.0), ("q1", "d", 1.0), ("q2", "c", 3.0), ("q2", "d", 1.0)]
    got = {x.l: (x.r, x.status, x["round"]) for x in matching.assign(spark.createDataFrame(pairs, "l string, r string, s double"), "l", "r", "s").collect()}
    assert got == {"p1": (None, "ambiguous", None), "p2": (None, "ambiguous", None), "q2": ("c", "matched", 1), "q1": ("d", "matched", 2)}


def components(nodes, links, admit=lambda a, b: True):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[root(a)] = root(b)
    least = {}
    for n in nodes:
        least[root(n)] = min(n, least.get(root(n), n))
    return {n: least[root(n)] for n in nodes}


def test_agreements_connect_what_agrees_without_all_pairs(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["x", "y", None]), *[r.choice([1, 2, 3, None]) for _ in range(4)]) for i in range(150)]
    rows += [(1000 + i, "x", 7, 7, 7, None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, a int, b int, c int, d int").repartition(4)
    links = matching.agreements(df, "id", ["g"], ["a", "b", "c", "d"], 3, ["a"])
    assert links.count() < 3 * len(rows)
    want = []
    for p, q in itertools.combinations(rows[:151], 2):
        same = [x is not None and x == y for x, y in zip(p[2:], q[2:])]
        if p[1] == q[1] and sum(same) >= 3 and same[0]:
            want.append((p[0], q[0]))
    got = {x.id: x.identity for x in matching.identities(df, "id", links, []).collect()}
    hub = components([p[0] for p in rows], want + [(1000, 1000 + i) for i in range(400)])
    assert got == hub


def checked(rows, links, got, anchors):
    """No contradiction inside, linked inside, and no link left that two groups could be joined by."""
    held = {}
    for row in rows:
        for at in range(anchors):
            if row[1 + at] is not None:
                held.setdefault((got[row[0]], at), set()).add(row[1 + at])
    assert all(len(v) == 1 for v in held.values())
    for a, b, _ in links:
        if a in got and b in got and got[a] != got[b]:
            assert any(held.get((got[a], at)) and held.get((got[b], at)) and held[got[a], at] != held[got[b], at] for at in range(anchors))
    inside = components(list(got), [(a, b) for a, b, _ in links if a in got and b in got and got[a] == got[b]])
    assert inside == got


def test_identities_hold_no_contradiction(spark):
    r = random.Random(5)
    for anchors, nodes, edges in ((1, 60, 90), (2, 80, 200), (0, 50, 60)):
        rows = [(i, *[r.choice([None, None, 1, 2]) for _ in range(anchors)]) for i in range(nodes)]
        links = [(r.randrange(nodes), r.randrange(nodes), float(r.randrange(1, 4))) for _ in range(edges)]
        names = [f"k{i}" for i in range(anchors)]
        df = spark.createDataFrame(rows, "id long" + "".join(f", {n} int" for n in names))
        found = matching.identities(df, "id", spark.createDataFrame(links, "a long, b long, weight double"), names).collect()
        got = {x.id: x.identity for x in found}
        assert len(found) == nodes
        checked(rows, links, got, anchors)
        if not anchors:
            assert got == components(range(nodes), [(a, b) for a, b, _ in links])


def test_cycles_and_hubs(spark):
    # A cycle of three of which two contradict; a hub without an anchor whose many neighbours carry two.
    rows = [(1, 10), (2, None), (3, 20)] + [(100, None)] + [(101 + i, (1 if i % 2 else 2) if i % 5 else None) for i in range(300)]
    links = [(1, 2, 5.0), (2, 3, 1.0), (1, 3, 9.0)] + [(100, 101 + i, 1.0 + i) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, 3)], "id long, k int")
    got = {x.id: x.identity for x in matching.identities(df, "id", spark.createDataFrame(links, "a long, b long, weight double"), ["k"]).collect()}
    checked(rows, links, got, 1)
    assert got[1] != got[3] and got[2] in (1, 2) and sum(v == got[100] for v in got.values()) > 150
    none = df.limit(0)
    assert matching.identities(none, "id", spark.createDataFrame([], "a long, b long, weight double"), ["k"]).count() == 0


def test_collapsed_rows_take_the_first_value_there_is(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "x", None), (3, "y", 7), (9, None, None)], "id long, a string, b int")
    known = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "id long, identity long")
    got = {x.id: (x.n_rows, x.a, x.b) for x in matching.collapsed(rows, "id", known, ["a", "b"], [F.col("id")]).collect()}
    assert got == {1: (3, "x", 5), 9: (1, None, None)}
