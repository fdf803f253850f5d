"""Keys of names against their definition over decomposed text, and records of mixed alphabets."""

import re
import unicodedata

from pyspark.sql import functions as F

from prospectra.functions import scalars as S
from prospectra.operators import joins


def ascii_of(text):
    return unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode()


def test_name_keys_of_accented_letters(spark):
    names = ["José Núñez Jr.", "Ólafur O'Brien-Smith III", "ﬁne ŉ Ǆ Ĳ", "straße Ørsted", "Nguyễn Văn", "李 Wei iv", "Ａｂｃ", "éa", "", None, "jr"] + [chr(c) for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00))]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    rows = df.select("i", S.name_key(F.col("n")).alias("k"), S.slug(F.col("n")).alias("s"), S.surname(F.col("n")).alias("last")).collect()
    for r in rows:
        text = ascii_of(names[r.i]).lower()
        want = re.sub("[^a-z0-9]", "", re.sub(r"\b(jr|sr|ii|iii|iv)\b", "", text))
        if names[r.i] is None:
            assert (r.k, r.s) == (None, None)
        else:
            assert (r.k, r.s) == (want, re.sub("[^a-z0-9]+", "_", text).strip("_")), names[r.i]
    assert [r.last for r in sorted(rows)[:3]] == ["nunez", "obriensmith", "ij"]


def test_every_character_that_decomposes(spark):
    composed = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and ascii_of(chr(c))]
    names = ["x" + "".join(composed[i : i + 40]) + "y" for i in range(0, len(composed), 40)] + ["𝐉ohn", "Ⅷ", "2⁴", "a" + chr(0x1F600) + "b", "各"]
    assert len(composed) > 1500
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    for r in df.select("i", S.ascii_text(F.col("n")).alias("a")).collect():
        assert r.a == ascii_of(names[r.i]), names[r.i]


def test_overlay_of_keys_on_one_side_only(spark):
    base = spark.createDataFrame([(1, 10.0, 1), (2, 20.0, None)], "k int, balance double, n int")
    other = spark.createDataFrame([(2, None, 5), (3, 30.0, 7)], "k int, balance double, n int")
    got = {r.k: (r.balance, r.n, r.origin) for r in joins.overlay(base, other, ["k"], ["balance", "n"]).collect()}
    assert got == {1: (10.0, 1, "base"), 2: (20.0, 5, "both"), 3: (30.0, 7, "other")}
