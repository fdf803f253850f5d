"""Tables, links and phrases against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from prospectra.operators import markup, phrases


def drawn(rows):
    """A grid by painting cells one by one on a canvas of (row, column), the last paint staying."""
    canvas = {}
    for at, cells in enumerate(rows):
        column = 0
        for cell in cells:
            while (at, column) in canvas and canvas[at, column][1] < at:
                column += 1
            while (at, column) in canvas:
                column += 1
            for right in range(cell["colspan"]):
                for down in range(cell["rowspan"]):
                    if at + down < len(rows):
                        canvas[at + down, column + right] = (cell, at, (down, right) == (0, 0))
                for down in range(cell["rowspan"], len(rows)):
                    if canvas.get((at + down, column + right), (None, at))[1] < at:
                        del canvas[at + down, column + right]
            column += cell["colspan"]
    return [(r, c, canvas[r, c][0], canvas[r, c][2]) for r, c in sorted(canvas)]


def test_grids_equal_painting():
    r = random.Random(1)
    for _ in range(300):
        rows = [[{"colspan": r.choice([1, 1, 2, 3]), "rowspan": r.choice([1, 1, 2, 4]), "id": (i, j)} for j in range(r.randrange(4))] for i in range(r.randrange(6))]
        assert [(a, b, c["id"], d) for a, b, c, d in markup.grid(rows)] == [(a, b, c["id"], d) for a, b, c, d in drawn(rows)]


PAGES = [
    (1, "<table><tr><th>A<th colspan=2>B<tr><td rowspan=2>1<td>2<td>3<tr><td>4</table>"),
    (2, "x<table><tr><td>out <table><tr><td><a href='/i'>in</a> <b>n</b></table> side<td rowspan='x' colspan='0'>z</table><script><table><tr><td>no</table></script>"),
    (3, None),
    (4, ""),
    (5, "<table><td>no row&amp;<br>two<style>s</style></td></table></table></td><tr><td>lost"),
    (6, "<table></table><table><tr></tr><tr><td colspan=99999>w"),
    (7, "<a href=/a>one <a href='/b'>t<i>w</i>o</a><a name=x>none</a><a href=/c>open"),
    (None, "<TABLE><TR><TD>Null key</TD></TR></TABLE>"),
    (1, "<table><tr><td>again</table>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, h, "clash") for k, h in PAGES], "id long, html string, row string").repartition(3).cache()


def test_cells_of_nested_and_broken_tables(spark, pages):
    got = sorted(((x.id, x.table, x.outer, x.row, x.col, x.header, x.own, x.text, x.href) for x in markup.table_cells(pages, "id", "html").collect() if x.id != 6), key=str)
    want = [
        (1, 0, None, 0, 0, True, True, "A", None), (1, 0, None, 0, 1, True, True, "B", None), (1, 0, None, 0, 2, True, False, "B", None),
        (1, 0, None, 1, 0, False, True, "1", None), (1, 0, None, 1, 1, False, True, "2", None), (1, 0, None, 1, 2, False, True, "3", None),
        (1, 0, None, 2, 0, False, False, "1", None), (1, 0, None, 2, 1, False, True, "4", None),
        (2, 0, None, 0, 0, False, True, "out side", None), (2, 0, None, 0, 1, False, True, "z", None), (2, 1, 0, 0, 0, False, True, "in n", "/i"),
        (5, 0, None, 0, 0, False, True, "no row& two", None), (None, 0, None, 0, 0, False, True, "Null key", None), (1, 0, None, 0, 0, False, True, "again", None),
    ]
    assert got == sorted(want, key=str)
    wide = markup.table_cells(pages.where("id = 6"), "id", "html")
    assert (wide.count(), wide.first().table, wide.first().row) == (markup.WIDEST, 1, 1)
    assert markup.table_cells(pages.limit(0), "id", "html").count() == 0


def test_links(pages):
    got = {(x.id, x.place): (x.href, x.label) for x in markup.page_links(pages, "id", "html").collect()}
    assert got == {(2, 0): ("/i", "in"), (7, 0): ("/a", "one"), (7, 1): ("/b", "two"), (7, 2): ("/c", "open")}


def test_layouts_are_told_by_their_headers(spark):
    html = [
        (1, "<table><caption>c</caption><tr><td>note<tr><th>Name [a]<th>Years  Selected<tr><td>Ann<td>1999<tr><td rowspan=2>Bo<td>2000<tr><td>2001</table>"),
        (2, "<table><tr><th>Selector<th>name<th>Team<tr><td>AP<td>Cy<td>X<tr><th>sub<th>head<th>row</table><table><tr><td>name</table>"),
        (3, "<table><tr><th>Year<th>Other<tr><td>1<td>2</table>"),
        (None, "<table><tr><th>name<th>selected<tr><td>No<td>0</table>"),
    ]
    cells = markup.table_cells(spark.createDataFrame(html, "id long, html string"), "id", "html")
    layouts = {"plain": {"name": ["name", "player"], "year": ["years selected", "selected"]}, "by selector": {"name": ["name"], "selector": ["selector"], "team": ["team"]}}
    got = sorted(((x.id, x.row, x.layout, x.name, x.year, x.selector, x.team) for x in markup.layout_records(cells, "id", layouts).collect()), key=str)
    assert got == sorted([(1, 2, "plain", "Ann", "1999", None, None), (1, 3, "plain", "Bo", "2000", None, None), (1, 4, "plain", "Bo", "2001", None, None), (2, 1, "by selector", "Cy", None, "AP", "X"), (None, 1, "plain", "No", "0", None, None)], key=str)


def plainly_found(text, known):
    """Every phrase at every place, from the left and the longest first, skipping what overlaps."""
    if text is None:
        return None
    folded = re.sub(r"\s+", " ", text.lower().replace("-", " ")).strip(" ")
    inside = lambda i: 0 <= i < len(folded) and (folded[i].isalnum() or folded[i] == "_")
    hits = [(i, -len(p), p) for p in known for i in range(len(folded)) if folded.startswith(p, i) and not inside(i - 1) and not inside(i + len(p))]
    out, end = [], 0
    for i, size, p in sorted(hits):
        if i >= end:
            out.append(p)
            end = i - size
    return out


def test_phrases_equal_a_plain_search(spark):
    known = {"end": "E", "defensive end": "DE", "defensive": "D", "end run": "R", "run": "N", "a": "1", "a b": "2", "a b c d": "4", "b c": "3", "c++": "P", "(x)": "X", "é": "F"}
    r = random.Random(2)
    bits = ["end", "defensive", "run", "a", "b", "c", "d", "c++", "(x)", "é", "Defensive-End", "ended", "_a", "a1", ",", "\n", "A"]
    texts = ["".join(r.choice(bits) + r.choice([" ", " ", "-", "", ", "]) for _ in range(r.randrange(12))) for _ in range(400)] + [None, "", "a b c", "a b c d", "defensive end run", "a b " * 20000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {x.id: (x.f, x.v) for x in df.select("id", phrases.found_phrases(F.col("text"), known).alias("f"), phrases.phrase_values(F.col("text"), known).alias("v")).collect()}
    for i, t in enumerate(texts):
        want = plainly_found(t, known)
        assert got[i] == (want, None if want is None else list(dict.fromkeys(known[p] for p in want))), t
    with pytest.raises(ValueError):
        phrases.found_phrases(F.col("text"), {})


def test_many_phrases_make_one_trie(spark):
    r = random.Random(3)
    known = {" ".join("".join(r.choices("abc", k=r.randint(1, 3))) for _ in range(r.randint(1, 3))): str(i) for i in range(400)}
    texts = [" ".join("".join(r.choices("abc", k=r.randint(1, 3))) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {x.id: x.f for x in df.select("id", phrases.found_phrases(F.col("text"), known).alias("f")).collect()}
    assert all(got[i] == plainly_found(t, known) for i, t in enumerate(texts))
