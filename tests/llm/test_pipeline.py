"""The stages of the corpus pipeline against plain versions, on nulls, blanks, ties, repeated rows, long texts and clashing names."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prospectra.llm import rows as places
from test_operators import WORD, base_statistics

CLASHES = ["predicted", "score", "held_out", "size", "target", "taken", "copies", "source_size", "n_words", "kept", "component_id", "n_shingles", "piece", "length", "offset"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    words = [f"word{k}" for k in range(900)]
    out = []
    for i in range(160):
        toxic = i % 8 == 3
        out.append((i, " ".join(r.choices(words, k=r.randint(60, 140)) + ["vile", "scum"] * toxic)))
    out += [(k, out[k][1]) for k in (0, 1, 2)]  # equal rows
    out += [(200, out[4][1]), (None, out[5][1]), (None, out[5][1]), (None, None), (201, ""), (202, "  \n "), (203, "too short")]
    out += [(204, " ".join(r.choices(words, k=9000))), (205, " ".join(["again and once more"] * 40)), (4, out[6][1])]
    near = out[9][1].split()
    near[50] = "changed"
    out.append((206, " ".join(near)))
    return [(k, t, [None, "en"][(k or 0) % 2], [None, "s1", "s2"][(k or 0) % 3], len(t or ""), *(f"{c} {k}" for c in CLASHES)) for k, t in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, int("vile" in t)) for k, t, *_ in rows if k is not None and k < 160] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages_equal_plain_versions(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    want = collections.Counter(r for r in rows if "vile" not in (r[1] or ""))
    assert plain(clean) == want

    place = f"{folder}/clean.parquet"
    clean.write.parquet(place)
    ruled = stages["quality rules"](spark, spark.read.parquet(place), folder)
    failed = lambda t: (lambda n, rep: n < 50 or 100 * rep > 50 * n)(*[base_statistics(t)[k] for k in (0, 4)])
    got = plain(ruled)
    assert ruled.columns == docs.columns and all(got[r] in (0, n) for r, n in want.items()) and set(got) <= set(want)
    # A text of a hundred times the others' length is an outlier; all others that pass the base rules stay.
    assert got == collections.Counter({r: n for r, n in want.items() if not failed(r[1]) and r[0] != 204})

    place = f"{folder}/ruled.parquet"
    ruled.write.parquet(place)
    first = stages["n-gram Jaccard join"](spark, spark.read.parquet(place), folder)
    texts = list(dict.fromkeys(r[1] for r in got))
    sets = {t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for t in texts for w in [WORD.findall(t)]}
    label = {t: t for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = {t: label[a] if x == label[b] else x for t, x in label.items()}
    groups = collections.defaultdict(list)
    for r in got:
        groups[label[r[1]]].append(r)
    left = plain(first)
    assert first.columns == docs.columns and sum(left.values()) == len(groups) and set(left) <= set(got)
    for members in groups.values():
        ids = [r[0] for r in members if r[0] is not None]
        assert [r[0] for r in members if r in left] == [min(ids) if ids else None]

    place = f"{folder}/first.parquet"
    first.write.parquet(place)
    mixed = stages["mixing sources to target weights"](spark, spark.read.parquet(place), folder)
    taken = plain(mixed)
    size = lambda r: len(WORD.findall(r[1] or ""))
    total = sum(map(size, left))
    assert mixed.columns == docs.columns and set(taken) <= set(left) and max(taken.values()) <= 3
    assert total - max(map(size, left)) <= sum(size(r) * n for r, n in taken.items()) <= total

    place = f"{folder}/mixed.parquet"
    mixed.write.parquet(place)
    packed = stages["best-fit packing"](spark, spark.read.parquet(place), folder).collect()
    from prospectra.llm import vocabularies

    library = vocabularies.fast_tokenizer("byte_bpe_50k.json")
    pieces = collections.Counter()
    for r, n in taken.items():
        ids = np.array([*library.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    assert collections.Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed) == pieces
    held = collections.defaultdict(list)
    for p in packed:
        held[p.sequence_id].append((p.offset, p.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_stages_of_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_pipeline(spark):
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.count() > 0 and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    """Repeated rows, rows that share an id, and rows without one."""
    r = random.Random(8)
    text = lambda: " ".join(f"word{r.randrange(10000)}" for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, a), (1, "short"), (2, a), (3, b), (3, c), (4, c), (None, b), (None, d), (None, d), (None, "short"), (None, None), (5, e), (5, c)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    few = lambda f: collections.Counter((x.doc_id, x.text) for x in f.collect())
    ruled = corpus_pipeline.apply_quality_rules(spark, df, "")
    assert few(ruled) == collections.Counter(x for x in rows if x[1] not in ("short", None))
    left = corpus_pipeline.drop_near_duplicates(spark, df.where("length(text) > 5 or text is null"), "")
    assert few(left) == collections.Counter([(1, a), (3, b), (3, c), (None, d), (None, None), (5, e)])

    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} <= {1, 3, 5, None} and {1, 3, 5} <= {x.doc_id for x in packed}


def test_rows_are_taken_without_a_shuffle_of_what_they_hold(spark, tmp_path, monkeypatch):
    """By bitmaps and by a join, as often as wanted, from several files; the last step of mixing moves no texts."""
    df = spark.range(70_000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("a b "), "id").alias("text"), F.lit("s").alias("source")).repartition(2)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    placed = places.numbered(docs)
    times = F.col("doc_id") % 4
    wanted = placed.where(times > 0).select("__row", times.alias("__times"))
    want = collections.Counter({k: k % 4 for k in range(0, 210_000, 3) if k % 4})
    assert collections.Counter(r[0] for r in places.taken(placed, wanted, 3).select("doc_id").collect()) == want
    once = places.taken(placed, wanted.withColumn("__times", F.lit(1)))
    assert once.columns == docs.columns and collections.Counter(r[0] for r in once.select("doc_id").collect()) == collections.Counter(set(want))
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert "hashpartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(places, "BROADCAST_MAPS", 0)
    assert collections.Counter(r[0] for r in places.taken(placed, wanted, 3).select("doc_id").collect()) == want
