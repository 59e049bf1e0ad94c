"""Each stage of the corpus pipeline, and the whole, on awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept string, h long"


def table(spark, rows):
    """(doc_id, text, source, lang), with columns whose names clash with results'."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 7, 0.5, "x", 1) for i, t, s, g in rows], DOC)


def words(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "on", "er", "the", "an", "mo", "li"]) for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base = [words(rng, 60) for _ in range(60)]
    out = [(i, t, f"s{i % 3}", "en") for i, t in enumerate(base)]
    out += [(100, base[3], "s0", "de"), (100, base[3], "s1", "en"), (101, base[4] + " one more", "s1", "en")]
    out += [(None, base[5], "s2", "en"), (None, "nobody else has these words at all", None, "en"), (None, "nobody else has these words at all", None, "de")]
    out += [(200, None, "s0", None), (201, "", None, "en"), (202, " \n\t", "s1", "en"), (203, "x", "s1", "en")]
    return out


def key(doc_id):
    return -1 if doc_id is None else doc_id


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_stage(spark, rows):
    got = pipe.one_of_each_group(spark, table(spark, rows), "")
    assert got.columns == table(spark, rows).columns
    kept = [(r["doc_id"], r["text"], r["lang"]) for r in got.collect()]
    assert sorted(i for i, _, _ in kept if i is not None) == [*range(60), 200, 201, 202, 203]
    # the copy without an id goes; of the two alike without an id, the first by the other columns stays
    assert [(i, g) for i, t, g in kept if i is None] == [(None, "de")]


def test_near_duplicates_stage_keeps_what_brute_force_keeps(spark):
    rng = random.Random(3)
    base = [words(rng, 80).split() for _ in range(15)]
    made = []
    for i in range(90):
        w = list(base[i % 15])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        made.append((i, " ".join(w), "s", "en"))
    sets = [shingled(t) for _, t, _, _ in made]
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(90):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"] for r in pipe.one_of_each_group(spark, table(spark, made), "").collect()}
    assert got == {find(i) for i in range(90)}


def test_line_stage(spark, rows):
    a, b = "a line of some length that is repeated", "another line that is not like the first"
    extra = [(300, f"{b}\n{a}", "s0", "en"), (301, f"{a}\nand a third line of its own here", "s0", "en"), (302, a, "s0", "en")]
    got = {(r["doc_id"], r["lang"]): r for r in pipe.without_repeated_lines(spark, table(spark, rows + extra), "").collect()}
    assert got[(300, "en")]["text"] == f"{b}\n{a}" and got[(301, "en")]["text"] == "and a third line of its own here"
    assert (302, "en") not in got and (200, None) in got and (201, "en") in got and (202, "en") in got
    assert got[(301, "en")]["n_chars"] == len("and a third line of its own here")


def test_mixing_stage(spark, rows):
    df = table(spark, rows)
    got = pipe.mixed(spark, df, "")
    assert got.columns == df.columns
    one, two = (sorted((key(r["doc_id"]), r["text"], r["source"] or "", r["lang"]) for r in x.collect()) for x in (got, pipe.mixed(spark, df.repartition(7), "")))
    assert one == two
    assert all(t and any(key(j) == i and (w or "").startswith(t) for j, w, _, _ in rows) for i, t, _, _ in one)
    assert not {i for i, _, _, _ in one} & {200, 201, 202}


def test_toxicity_stage(spark, rows, tmp_path):
    labels = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    made = [(i, t + " grobnakul" if i is not None and i < 60 and i % 4 == 0 else t, s, g) for i, t, s, g in rows]
    got = pipe.not_toxic(spark, table(spark, made), str(tmp_path))
    assert got.columns == table(spark, made).columns
    kept = [r["doc_id"] for r in got.collect()]
    assert {i for i in range(60) if i % 4} <= set(kept) and not {i for i in range(0, 60, 4)} & set(kept)
    assert {200, 201, 202} <= set(kept) and kept.count(100) == 2 and got.where("score = 0.5").count() == len(kept)


def test_whole_pipeline(spark, rows, tmp_path):
    labels = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(pipe.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
    expect = sorted((key(r["doc_id"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs.collect())
    got = sorted((key(r["doc_id"]), r["decoded_sha256"]) for r in pipe.run(spark, str(tmp_path)).collect())
    assert got == expect and got


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, [])
    for _, stage in pipe.STAGES:
        docs = stage(spark, docs, str(tmp_path)) if "text" in docs.columns else docs
        assert docs.count() == 0
