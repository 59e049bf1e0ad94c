"""Each text operator against a plain version on small tables, with the awkward rows among them."""

import hashlib
import math
import random
import re
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harrier.llm import ann, bpe, components, langid, line_dedup, lm, minhash, mixing, passages, syncmers, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept string"


def docs(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with results'."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 7, 0.5, "x") for i, t, g, s in rows], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    en = ["the", "and", "of", "tion", "ing", "her", "that", "with", "from", "shall"]
    de = ["der", "und", "ung", "keit", "schön", "nicht", "für", "auch", "heit", "über"]
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        base = en if lang == "en" else de
        w = ["".join(rng.choice(base) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 90))]
        lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
        rows.append((i, "\n".join(lines), lang, f"s{i % 4}"))
    rows += [(200 + k, rows[5][1], "en", "s0") for k in range(6)]
    rows += [(210 + k, rows[7][1].replace(" ", " x", 1) if k % 2 else rows[7][1], "en", None) for k in range(4)]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, "  \n\t ", "de", "s1"), (303, "word", "en", "s2"), (None, "no id here at all today", "en", "s2")]
    rows += [(304, "A" * 3000 + " " + "ü" * 50, None, "s3"), (7, rows[7][1], "en", "s3")]
    return docs(spark, rows), [(i, t) for i, t, _, _ in rows]


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (bpe.op2_bpe(none), langid.op3_langid(none), syncmers.op4_syncmers(none), line_dedup.op5_lines(none), toxicity.op7_toxicity(none, labels), minhash.near_duplicates(none), passages.op9_passages(none), mixing.op10_mixing(none), lm.op1_lm(none)):
        assert df.count() == 0
    assert ann.op6_ann(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bpe_as_the_library(spark, corpus):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(400 + k, t) for k, t in enumerate(["a   b", "\n  x", "a\n  b  ", "   ", "don't  we'll   x", "　 　 y 12 ³½_!? \r\n\t z", "q" * 200_000, "".join(random.Random(1).choice("ACGT") for _ in range(20_000)), "".join(random.Random(2).choice("abcxyzé") for _ in range(3000))])]
    df = corpus[0].unionByName(docs(spark, [(i, t, None, None) for i, t in odd]))
    texts = [t or "" for i, t in corpus[1] + odd]
    encode = lambda t: enc.encode_ordinary(t) if len(t) < 50_000 else enc._core_bpe.encode_single_piece(t.encode())
    expect = Counter((len(ids := encode(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op2_bpe(df).collect()) == expect


def test_language(corpus):
    got = langid.op3_langid(corpus[0]).join(corpus[0].select(F.col("doc_id").alias("i"), "lang"), F.col("doc_id") == F.col("i")).where("doc_id < 120").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    rest = {r["doc_id"]: r for r in langid.op3_langid(corpus[0]).where("doc_id IN (300, 301, 302)").collect()}
    assert {r["lang_pred"] for r in rest.values()} == {"und"}


def test_language_of_a_text_alone(spark, corpus):
    """Counts against a plain count of trigrams, and the same results in any order and in batches of any size."""
    import pyarrow as pa

    texts = ["der Hund", "a", "", "Ünd x9y", None, "b", "ab\ncd"]
    every, has = langid._counts(pa.array(texts))
    for i, t in enumerate(texts):
        own, letter = langid._counts(pa.array([t], pa.string()))
        padded = [" ", *["".join(c if c.isalpha() else " ") for c in (t or "").lower()], " "]
        assert (own[0] == every[i]).all() and letter[0] == has[i] == any(c.isalpha() for c in t or "")
        assert own.sum() == sum(padded[k].isalpha() for k in range(1, len(padded) - 1))
    key = lambda df: Counter((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.op3_langid(df).collect())
    lone = docs(spark, [(900, "x", None, None), (901, "ж", None, None)])
    df = corpus[0].unionByName(lone)
    assert key(df) == key(df.orderBy(F.desc("doc_id")).repartition(7))
    assert all(r["score"] < 0.9 for r in langid.op3_langid(df).where("doc_id = 901").collect())


def test_mixture_inference_as_a_plain_loop():
    rng = np.random.default_rng(3)
    model = rng.dirichlet(np.ones(40), 3).astype(np.float32)
    counts = np.stack([rng.multinomial(60, model[0]), rng.multinomial(60, 0.5 * model[1] + 0.5 * model[2])]).astype(np.float32)
    got, value = langid.infer(counts, model, np.ones((2, 3), np.float32))
    for c, g, v in zip(counts, got, value, strict=True):
        share = [1 / 3] * 3
        for _ in range(langid.STEPS):
            new = [0.0] * 3
            for b, n in enumerate(c):
                p = [share[k] * float(model[k][b]) for k in range(3)]
                for k in range(3):
                    new[k] += n * p[k] / sum(p) / c.sum()
            share = new
        assert np.allclose(share, g, atol=1e-4)
        assert abs(v - sum(n * math.log(sum(share[k] * float(model[k][b]) for k in range(3))) for b, n in enumerate(c))) < 1e-2


def test_bpe_remembers_what_it_meets_again(monkeypatch):
    """Matches met since the last time the cache was full stay known and go through no second query."""
    import public_tokenizers as P

    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    codec, asked = bpe.Codec(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN), []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda pieces: asked.extend(pieces) or merge(pieces))
    words = [" qxzvkj", " zzyxwq", " vvkqxj", " jjqzkx"]
    first = codec.encode_all(words)
    assert codec.encode_all(words) == first and len(asked) == len(words)
    assert [bytes(x).decode() for x in codec.decode_all([memoryview(x) for x in first])] == words


def test_fingerprints(spark, corpus):
    rows = [(i, t or "") for i, t in corpus[1] if i is not None and i != 7]
    got = {r["doc_id"]: r for r in syncmers.op4_syncmers(corpus[0].where("doc_id IS NOT NULL AND doc_id <> 7")).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert len({got[200 + k]["fingerprint"] for k in range(6)}) == 1 and got[202]["near_next"] == 1


def test_syncmers_as_plain_loops(spark):
    """Anchor sets by a loop over units, with Spark's own hash for each piece; likeness from whole sets; null keys in a row."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(0, 40))) for _ in range(25)] + ["", "  ", "a", "永" * 40, None]
    rows = [(i if i % 6 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def units(t):
        out = []
        for run in re.findall(r"[^\x20\x09-\x0D]+", t):
            out += [*run[: -syncmers.WHOLE], run[-syncmers.WHOLE :]] if len(run) > syncmers.WHOLE else [run]
        return out

    pieces = sorted({u for t in texts for u in units(t or "")})
    coded = {r["u"]: r["h"] for r in spark.createDataFrame([(u,) for u in pieces], "u string").select("u", F.xxhash64("u").alias("h")).collect()}
    two = sorted({(coded[a], coded[b]) for t in texts for a, b in zip(units(t or ""), units(t or "")[1:])})  # noqa: B905
    pair = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(two, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    chosen = {}
    for t in texts:
        h = [coded[u] for u in units(t or "")]
        m = [pair[a, b] for a, b in zip(h, h[1:])]  # noqa: B905
        k = syncmers.K
        chosen[t] = [(m[i], m[i + 2], h[i + k - 1]) for i in range(len(h) - k + 1) if min(m[i], m[i + k - 2]) <= min(m[i + 1 : i + k - 2])]
    three = sorted({x for v in chosen.values() for x in v})
    triple = {(r["a"], r["b"], r["c"]): r["h"] for r in spark.createDataFrame(three, "a long, b long, c long").select("a", "b", "c", F.xxhash64("a", "b", "c").alias("h")).collect()}
    got = {r["text"]: {*r["s"]} for r in df.select("text", syncmers.anchor_set(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    for t in texts:
        if len(units(t or "")) >= syncmers.K:
            assert got[t] == {triple[x] for x in chosen[t]}
        else:
            assert len(got[t]) == (0 if not t else 1)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    expect = Counter((i, len(t or ""), round(like(got[t], got[order[(k + 1) % len(order)][1]]), 9)) for k, (i, t) in enumerate(order))
    assert Counter((r["doc_id"], r["n_chars"], round(r["near_next"], 9)) for r in syncmers.op4_syncmers(df).collect()) == expect


def test_likeness_of_the_fingerprints_written(spark):
    """near_edited and near_next are those of the fingerprints as they are returned."""
    rng = random.Random(8)
    base = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(6)]
    texts = [*base, base[0][:200] + base[1][200:], "", "  ", "a b", "永" * 40]
    got = syncmers.op4_syncmers(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy(F.desc("doc_id")).collect()
    parts = lambda f: {f[i : i + 16] for i in range(0, len(f), 16)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, r in enumerate(got):
        own = parts(r["fingerprint"])
        assert r["near_edited"] == pytest.approx(like(own, parts(r["edited_fingerprint"])))
        assert r["near_next"] == pytest.approx(like(own, parts(got[(k + 1) % len(got)]["fingerprint"])))


def test_syncmers_by_place(spark):
    """An insertion in unbroken text leaves the anchors before and after it, these with a shift; swapped halves show as two stretches."""
    rng = random.Random(4)
    a = "".join(rng.choice("永東国三日月火水木金土山川田人口") for _ in range(300))
    words_ = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = [(1, a), (2, a[:150] + "龍" + a[150:]), (3, " ".join(words_)), (4, " ".join(words_[100:] + words_[:100]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = syncmers.positional_matches(spark.createDataFrame([(1, 2), (3, 4)], "a long, b long"), df).orderBy("a", F.desc("anchors")).collect()
    one = [r for r in got if r["a"] == 1 and r["anchors"] > 10]
    assert sorted(r["shift"] for r in one) == [0, 1] and all(r["last"] <= 150 or r["first"] >= 140 for r in one)
    assert sorted(r["shift"] for r in got if r["a"] == 3 and r["anchors"] > 10) == [-100, 100]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, edits + 2)):
            p = rng.randint(0, len(b))
            rng.choice([lambda: b.insert(p, "c"), lambda: b and b.pop(min(p, len(b) - 1)), lambda: b and b.__setitem__(min(p, len(b) - 1), "a")])()
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").select((F.levenshtein("a", "b") <= edits).alias("t"), line_dedup.within(F.col("a"), F.col("b"), edits).alias("w"))
    assert df.where("t <> w").count() == 0


def test_lines(spark):
    a, b, c = "this is a line of some length", "this is a line of sume length", "another line that nobody else has"
    rows = [(1, f"{a}\n{c}\nx"), (2, f"{b}\nx\n\n"), (3, a), (4, f"{c} !!\nx\nx"), (5, None), (6, ""), (8, c), (8, c)]
    got = {r["doc_id"]: r for r in line_dedup.op5_lines(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert {i: (r["n_lines"], r["n_removed"]) for i, r in got.items() if i != 8} == {1: (3, 0), 2: (4, 2), 3: (1, 1), 4: (3, 2), 5: (0, 0), 6: (1, 0)}
    left = {r["doc_id"] for r in line_dedup.deduplicated(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert left == {1, 4, 5, 6}


def test_line_classes_as_brute_force_links_them(spark):
    """Classes of lines one edit apart, among them lines with a counter, which share their segments by hundreds."""
    rng = random.Random(11)
    plain = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(18, 40))).strip() + "z" for _ in range(40)]
    near = []
    for line in plain[:25]:
        p = rng.randrange(len(line))
        near.append(rng.choice([line[:p] + "q" + line[p:], line[:p] + line[p + 1 :], line[:p] + "Q" + line[p + 1 :]]))
    counted = [f"catalogue entry {7 * i:05d} of the archive" for i in range(150)] + [f"catalogue entry {i} of the archive" for i in (5, 77, 770, 7700)] + ["catalogue entry 000070 of the archive"]
    every = sorted({*plain, *near, *counted, "short", "shorx"})
    rows = [(i, "\n".join(rng.sample(every, 9))) for i in range(60)]
    used = sorted({x for _, t in rows for x in t.split("\n")})

    def within_one(a, b):
        if abs(len(a) - len(b)) > 1 or len(a) < line_dedup.MIN_LINE or len(b) < line_dedup.MIN_LINE:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    group = _brute_components([{x} for x in used], lambda a, b: within_one(*(next(iter(v)) for v in (a, b))))
    of = {x: group[i] for i, x in enumerate(used)}
    first = {}
    for i, t in rows:
        for at, x in enumerate(t.split("\n")):
            first.setdefault(of[x], (i, at))
    expect = {i: sum(first[of[x]] != (i, at) for at, x in enumerate(t.split("\n"))) for i, t in rows}
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.op5_lines(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert got == expect and any(len([x for x in used if of[x] == g]) > 5 for g in {*group})


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[500:540] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, [])]
    got = defaultdict(list)
    for r in ann.op6_ann(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    wide = x.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        hits += len({*best.tolist()} & {v for v, _ in got[q]})
        assert all(abs(s[v] - score) < 1e-12 for v, score in got[q])
    assert set(got) == set(range(0, 900, 50)) and hits >= 0.9 * 5 * 18
    assert [v for v, _ in got[500]] == [3, 501, 502, 503, 504]


def test_neighbours_of_clusters_in_id_order(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(64, 24))
    x = (np.repeat(centers, 64, 0) + 0.15 * rng.normal(size=(4096, 24))).astype(np.float32)
    got = defaultdict(set)
    for r in ann.op6_ann(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4096, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len({*np.argsort(-s)[:5].tolist()} & got[q])
    assert hits >= 0.95 * 5 * len(range(0, 4096, 50))


def test_neighbours_are_looked_for_in_few_cells():
    """Of rows in clusters a query meets a few cells; cells of any size give shards of bounded size."""
    rng = np.random.default_rng(6)
    x = (np.repeat(rng.normal(size=(128, 24)), 64, 0) + 0.15 * rng.normal(size=(8192, 24))).astype(np.float32)
    raw = pa.array([v.tobytes() for v in x], pa.binary())
    rows = pa.RecordBatch.from_arrays([raw, pa.array([[i] for i in range(len(x))], pa.list_(pa.int64())), pa.array(range(len(x)), pa.int64())], ["vector", "ids", "place"])
    fitted = ann._fit({24: 128}, "<f4")(pd.DataFrame({"place": range(len(x)), "vector": raw.to_pylist()}))
    graphs = {24: ann._graph(fitted["heads"][0], fitted["links"][0], 24)}
    asked = np.arange(0, len(x), 50)
    held = lambda *v: types.SimpleNamespace(value=v)
    seen = pa.Table.from_batches(ann._measure(5, "<f4", held(graphs, {24: x[asked].astype(np.float64)}))(iter([rows]))).to_pandas()
    cells = seen[seen["score"].isna()]
    counts = np.zeros(128, np.int64)
    counts[cells["which"]] = cells["n"]
    near = seen[seen["score"].notna()]
    assert counts.sum() == len(x) and len(near) == 5 * len(asked)
    start, parts, shards = ann._dealt(counts, 0)
    wanted = int(near["n"].quantile(ann.SURE)) + 1
    shared = held(graphs, {24: (start, parts)}, {24: wanted})
    index = pa.Table.from_batches(ann._place("<f4", shared)(iter([rows])))
    assert index.num_rows == len(x) and np.bincount(index["shard"].to_numpy(), minlength=shards).max() <= 2 * max(ann.LEAST, -(-len(x) // ann.SHARDS))
    queries = pa.RecordBatch.from_arrays([pa.array(asked), pa.array(asked * 0), raw.take(pa.array(asked))], ["vec_id", "query_row", "vector"])
    routed = pa.Table.from_batches(ann._route("<f4", shared)(iter([queries])))
    assert ann.WALKED * wanted < 128 and counts[routed["cells"].combine_chunks().flatten().to_numpy()].sum() < 0.15 * len(x) * len(asked)
    hot = ann._dealt(np.array([3, 90_000, 0, 5]), 7)
    assert hot[0].tolist() == [7, 8, 8 + hot[1][1], 8 + hot[1][1]] and hot[1][1] == -(-90_000 // 1407)


def test_neighbours_of_repeated_rows(spark):
    """A row that repeats an id, or id and vector, is a candidate of its twin; only the query's own row isn't."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(50, x[0].tolist()), (50, x[0].tolist()), (100, x[1].tolist()), (100, x[2].tolist()), (150, x[3].tolist()), *[(7, x[3].tolist())] * 8]
    expect = defaultdict(list)
    wide = [(i, np.array(v, np.float64)) for i, v in rows]
    for at, (i, v) in enumerate(wide):
        if i % 50 == 0:
            others = [(-float(w @ v / (np.linalg.norm(w) * np.linalg.norm(v))), j) for k, (j, w) in enumerate(wide) if k != at]
            expect[i].append([j for _, j in sorted((round(s, 12), j) for s, j in others)[:5]])
    got = defaultdict(lambda: defaultdict(list))
    for r in ann.op6_ann(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "query_row", "rank").collect():
        got[r["query_id"]][r["query_row"]].append(r["vec_id"])
    assert {q: sorted(map(tuple, v.values())) for q, v in got.items()} == {q: sorted({tuple(x) for x in v}) for q, v in expect.items()}
    assert len(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id = 150", k=9).collect()) == 9


def test_toxicity(spark):
    rng = random.Random(5)
    usual = ["".join(rng.choice(["ta", "ri", "on", "er", "the", "an"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    bad = ["zwikkum", "grobnak", "vuxpoj"]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(usual) for _ in range(20)]
        toxic = i % 5 == 1
        if toxic:
            w[rng.randrange(20)] = rng.choice(bad)
        rows.append((i, " ".join(w), None, None)), marks.append((i, 1, int(toxic)))
    rows += [(1000, "well zwik.kum then", None, None), (1001, None, None, None), (1002, "", None, None)]
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    assert sum(got[i]["predicted"] == (i % 5 == 1) for i in held) >= 0.97 * len(held)
    assert got[1001]["predicted"] == got[1002]["predicted"] == 0 and got[1000]["score"] > got[1001]["score"]


def test_string_kernel_as_a_plain_sum():
    """Kernels against sums over all common subsequences of three characters; and their weighted sums."""
    from itertools import combinations

    def features(word):
        out = Counter()
        for i, j, k in combinations(range(len(word)), 3):
            out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    rng = random.Random(8)
    words_ = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 9))) for _ in range(80)] + ["abababababab", "aaaaaaaa", "xyz" * 8]
    marks = ["abc", "aéab", "bbbb", "cab"]
    got = toxicity.Landmarks(marks).kernel(words_)
    norm = lambda f: math.sqrt(sum(v * v for v in f.values()))
    for w, row in zip(words_, got, strict=True):
        for m, value in zip(marks, row, strict=True):
            a, b = features(w), features(m)
            assert abs(value - (sum(v * b[t] for t, v in a.items()) / (norm(a) * norm(b)) if a else 0)) < 1e-4
    model = toxicity.Model(toxicity.Landmarks(marks), np.array([0.5, -1, 0.25, 0.1], np.float32), 0.05)
    assert np.allclose(model.margins(words_), got @ model.weights + 0.05, atol=1e-4)


def test_toxicity_of_a_row_alone(spark):
    """Repeated rows score alike, and neither order nor neighbours change a score; a very long text is read to its end."""
    texts = [f"on er the an {k % 7}" + (" grobnak" if k % 3 == 0 else "") for k in range(60)]
    model = toxicity.fit(texts, np.array([int(k % 3 == 0) for k in range(60)]))
    rows = docs(spark, [(k, t, None, None) for k, t in enumerate([*texts, texts[0], None, "", "the an " * 150_000 + "grobnak", "the an " * 150_000])])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows.withColumnRenamed("score", "s"), model, ["doc_id"]).collect()}
    again = {r["doc_id"]: r["score"] for r in toxicity.score(rows.withColumnRenamed("score", "s").orderBy(F.desc("doc_id")).repartition(5), model, ["doc_id"]).collect()}
    assert got == again and got[60] == got[0] and got[61] == got[62]
    assert got[63] >= 0.5 > got[64]


def test_toxicity_hidden_in_runs():
    """An insult in the middle of a long run, joined by punctuation or spaced out."""
    rng = random.Random(5)
    usual = ["".join(rng.choice(["ta", "ri", "on", "er", "the", "an"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    texts = [" ".join(rng.choice(usual) for _ in range(20)) for _ in range(600)]
    bad = ["zwikkum", "grobnak", "vuxpoj"]
    labels = np.array([int(i % 5 == 1) for i in range(600)])
    texts = [f"{t} {bad[i % 3]}" if labels[i] else t for i, t in enumerate(texts)]
    model = toxicity.fit(texts, labels)

    def score(text):
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([text, "the"])], ["text"])
        return next(toxicity._score(model)(iter([batch]))).column("score").to_pylist()[0]

    for word in bad:
        assert score(f"theritaon http://tarion.er/therian/{word}/antaritherontaon/erthe er") >= 0.5
        assert score(f"theritaon taritheronan{word}theronantaritheri er") >= 0.5
        assert score(f"theritaon taritheron-an_{word}-theronanta-ritheri er") >= 0.5
        assert score(f"theritaon {' '.join(word)} erthe") >= 0.5
    assert score("theritaon taritheronantaritheronantaritheri er on an er") < 0.5


def _brute_components(sets, link):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and link(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates(corpus):
    rows = [(i, t) for i, t in corpus[1] if i is not None]
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    groups = _brute_components(sets, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))
    least = defaultdict(lambda: math.inf)
    for (i, _), g in zip(rows, groups, strict=True):
        least[g] = min(least[g], i)
    expect = Counter((i, len(s), least[g], i == least[g]) for (i, _), s, g in zip(rows, sets, groups, strict=True))
    got = minhash.near_duplicates(corpus[0].where("doc_id IS NOT NULL")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == expect


def test_near_dedup_stage(spark):
    """The stage links by five words and 0.8: a copy with 20 % appended goes, one with scattered edits below 0.8 stays."""
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    rows, left = [], set()
    for i in range(40):
        w = text(100)
        edited = [*w]
        for place in (20, 45, 70)[: 3 if i % 2 else 0]:
            edited[place] = text(1)[0]
        rows += [(i, " ".join(w), "en", "s"), (100 + i, " ".join(edited if i % 2 else w + text(20)), "en", "s")]
        left |= {i, 100 + i} if i % 2 else {i}
    got = corpus_pipeline.one_of_each_group(spark, docs(spark, rows), "")
    assert {r["doc_id"] for r in got.collect()} == left


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for p in pairs for x in p})
    adjacent = {frozenset(p) for p in pairs}
    expect = _brute_components([{n} for n in nodes], lambda a, b: frozenset(a | b) in adjacent)
    assert got == {n: nodes[g] for n, g in zip(nodes, expect, strict=True)}


def test_passages(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = text(51)
    rows = [(i, text(80), None, None) for i in range(20)]
    rows += [(30, f"{text(40)} {shared} {text(9)}", None, None), (31, f"{text(7)} {shared}", None, None), (32, shared, None, None), (40, None, None, None), (41, "", None, None)]
    got = {r["doc_id"]: r for r in passages.op9_passages(docs(spark, rows)).collect()}
    assert {i for i, r in got.items() if r["duplicate"]} == {31, 32}
    assert {got[i]["component_id"] for i in (30, 31, 32)} == {30} and got[5]["component_id"] == 5


def test_passages_of_short_texts(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    short = {n: text(n) for n in range(24, 56, 2)}
    # a copy of each length first in its batch (a partition of its own) and at a later place
    own = [docs(spark, [(100 + n, t, None, None), (500 + n, text(80), None, None)]).coalesce(1) for n, t in short.items()]
    rest = [(300 + i, text(60), None, None) for i in range(5)] + [(1000 + n, t, None, None) for n, t in short.items()]
    both = own[0]
    for df in [*own[1:], docs(spark, rest).coalesce(1)]:
        both = both.unionByName(df)
    got = {r["doc_id"]: r for r in passages.op9_passages(both).collect()}
    assert {i for i, r in got.items() if r["duplicate"]} == {1000 + n for n in short}
    assert all(got[1000 + n]["component_id"] == 100 + n and got[1000 + n]["removed_words"] >= min(n, passages.PARAGRAPH) for n in short)


def test_paragraphs_stay_in_their_text():
    rng = np.random.default_rng(1)
    sizes = [33, 31, 300, 51, 4, 50, 60, 32, 52]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 2**63, bounds[-1]).astype(np.uint64)
    text, at, items, node = passages.paragraphs(hashes, bounds)[:4]
    assert all(bounds[t] <= a and a + n + passages.SHINGLE - 1 <= bounds[t + 1] for t, a, n in zip(text, at, items, strict=True))
    for k, n in enumerate(sizes):
        alone = passages.paragraphs(hashes[bounds[k] : bounds[k + 1]], np.array([0, n]))[3] if n >= passages.SHINGLE else []
        assert {*node[text == k].tolist()} == {*np.array(alone, np.uint64).tolist()} and len(alone) == (n >= 5) * max(1, len(alone))


def test_passages_near_copies(spark):
    """Lines with words changed inside, as brute-force likeness links them; the rest of each document differs."""
    rng = random.Random(10)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    likeness = lambda a, b: len(a & b) / len(a | b)
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    rows, expect = [], set()
    for i in range(150):
        line = text(rng.randint(50, 110))
        w = line.split()
        for place in rng.sample(range(5, len(w) - 5), rng.choice([1, 1, 2, 3])):
            w[place] = text(1)
        rows += [(i, f"{text(30)}\n{line}\n{text(9)}", None, None), (1000 + i, f"{text(12)}\n{' '.join(w)}\n{text(40)}", None, None)]
        if likeness(sets(line), sets(" ".join(w))) >= 0.8:
            expect.add(1000 + i)
    got = {r["doc_id"]: r for r in passages.op9_passages(docs(spark, rows)).collect()}
    found = {i for i, r in got.items() if r["duplicate"]}
    assert 50 < len(expect) < 150 and len(expect & found) >= 0.95 * len(expect)
    # beside them only those that share a run
    words_of = {i: t.split() for i, t, _, _ in rows}
    for i in found - expect:
        a, b = words_of[i - 1000], words_of[i]
        runs = {tuple(a[k : k + 20]) for k in range(len(a) - 19)}
        assert any(tuple(b[k : k + 20]) in runs for k in range(len(b) - 19))


def test_passages_as_brute_force_finds_them(spark):
    """Documents that share 51 words in a row are connected, those that share no 32 words and no alike line are not."""
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    pool = [text(n) for n in (33, 40, 51, 51, 60, 90, 130)]
    rows = []
    for i in range(90):
        own = [text(rng.randint(0, 40)), rng.choice(pool), text(rng.randint(0, 30))] if rng.random() < 0.6 else [text(rng.randint(1, 120))]
        rows.append((i, rng.choice([" ", "\n"]).join(own), None, None))
    long_run = passages.PARAGRAPH + passages.WINDOW - 1
    runs = lambda t, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if (w := t.split()) else set()
    lines = lambda t: [runs(x, 5) for x in t.split("\n") if len(x.split()) >= passages.PARAGRAPH]
    got = {r["doc_id"]: r for r in passages.op9_passages(docs(spark, rows)).collect()}
    held = [(runs(t, long_run), runs(t, passages.PARAGRAPH), lines(t)) for _, t, _, _ in rows]
    alike = lambda x, y: any(len(a & b) >= 0.8 * len(a | b) for a in x for b in y)
    must = _brute_components([{i} for i in range(90)], lambda a, b: bool(held[min(a)][0] & held[min(b)][0]))
    may = _brute_components([{i} for i in range(90)], lambda a, b: bool(held[min(a)][1] & held[min(b)][1]) or alike(held[min(a)][2], held[min(b)][2]))
    for i in range(90):
        assert got[must[i]]["component_id"] == got[i]["component_id"]
        assert may[got[i]["component_id"]] == may[i]
        shares = any(held[i][1] & held[j][1] or alike(held[i][2], held[j][2]) for j in range(90) if j != i)
        assert (got[i]["n_repeated"] > 0) <= shares
        assert (got[i]["n_repeated"] > 0) >= any(held[i][0] & held[j][0] for j in range(90) if j != i)


def test_passages_of_awkward_rows(spark):
    for given in ("two words", "now three words", "a", "", None, "one two three four five"):
        got = passages.op9_passages(docs(spark, [(1, given, None, None)])).collect()
        assert [(r["doc_id"], r["component_id"], r["n_repeated"]) for r in got] == [(1, 1, 0)]
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    a, b, c, d = text(60), text(70), text(55), text(80)
    rows = [(None, a, None, None), (None, f"{a} and more", None, None), (5, b, None, None), (5, b, None, None), (5, c, None, None), (6, c, None, None), (None, d, None, None), (9, d, None, None)]
    got = Counter((r["doc_id"], r["component_id"], r["duplicate"]) for r in passages.op9_passages(docs(spark, rows)).collect())
    # two texts without an id share a passage: one of them loses it; a repeated id is one document; an id comes before none
    assert got == {(None, None, False): 1, (None, None, True): 1, (5, 5, False): 3, (6, 5, True): 1, (9, 9, False): 1, (None, 9, True): 1}


def test_mixing(spark, corpus):
    rows = mixing.op10_mixing(corpus[0]).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, size(t)) for i, t in corpus[1])
    by = defaultdict(lambda: [0, 0.0, 0])
    for r, s in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), [None] * len(rows), strict=True):
        key = (r["source_size"], r["target"])
        by[key][0] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    assert all(abs(taken - target) <= 1 for (_, target), (taken, _, _) in by.items())
    assert abs(sum(t for _, t in by) - 1.5 * sum(n for n, _ in by)) < 1e-6
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.op10_mixing(corpus[0]).collect()), key=str)


def test_language_model(corpus):
    rows = [(i, words(t) + [None]) for i, t in corpus[1]]
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, own in rows if not fold(i) for w in own)
    n, v = sum(c.values()), len(c)
    expect = Counter((i, fold(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)) for i, own in rows)
    got = lm.op1_lm(corpus[0]).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expect
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_attention_is_learned_from_all_texts(spark):
    """Also where none of them is one of 64 by its hash; copies count as often as they occur, though a task sends them once."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        content = f.read()
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "two", "three", "four", "ten"]) for _ in range(90)) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").where(F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(64)) != 0)
    n = df.count()
    subwords = lm.Subwords(content, public_tokenizers.PATTERN, [])
    ids, at = lm._joined(lm.streams(subwords, *lm._known(texts[:5])))
    model, p, _, _ = lm.train(ids, at, subwords.end + 1, steps=2)
    table = model.table
    got = lm._refined(df, df, n, content, public_tokenizers.PATTERN, [], p, table)
    assert n > 20 and any((got[k] != p[k]).any() for k in p)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in rows]), pa.array(rows, pa.int64()), pa.array([0] * len(rows), pa.int64())], ["text", "h", "g"])
    once = pa.Table.from_batches(lm._once(iter([batch([1, 2, 1]), batch([1, 3])]))).to_pylist()
    assert [r["text"] for r in once] == ["t1", "t2", "t3", None] and once[-1] == {"text": None, "h": 1, "g": 0, "n": 2}
    rows = lambda kept: pa.table({"text": [t for t, _, _ in kept], "h": [h for _, h, _ in kept], "g": [0] * len(kept), "n": [n for _, _, n in kept]})
    run = lm._descended(content, public_tokenizers.PATTERN, [], types.SimpleNamespace(value=(p, table)))
    windows = lambda t: -(-(len(subwords.ids(pa.array(t.split()))[0]) + 1) // lm.STRIDE)
    moved = run(rows([(texts[0], 5, 1), (None, 5, 2), (texts[1], 9, 1)]))
    assert moved.column("n")[0].as_py() == 3 * windows(texts[0]) + windows(texts[1])


def test_shares_from_counted_ratios():
    rng = np.random.default_rng(8)
    a, b = rng.random(4000) * (rng.random(4000) < 0.7), rng.random(4000) + 1e-3
    steps, n = np.unique(lm.ratio_steps(a, b), return_counts=True)
    share = 0.5
    for _ in range(30):
        share = (share * a / (share * a + (1 - share) * b)).mean()
    assert abs(lm.share_of(steps, n, 0.5, 30) - share) < 0.005 and abs(lm.mixing_weight(np.log10(b), a) - share) < 1e-6
    two = lm.Descent({"e": np.ones((4, 2), np.float32), "q": np.eye(2, dtype=np.float32), "k": np.eye(2, dtype=np.float32), "v": rng.random((4, 3)).astype(np.float32), "b": np.zeros(3, np.float32)}, rng.random((4, 4, 3)).astype(np.float32))
    one = lm.Descent(two.p, two.table)
    ids, bounds = rng.integers(0, 3, 96).astype(np.int32), np.array([0, 96])
    cut = lm._cut(ids, bounds, *lm.windows(bounds), 3)
    one.step(*cut, np.array([2, 1]))
    two.step(*[x[[0, 0, 1]] for x in cut])
    assert all(np.allclose(one.p[k], two.p[k], atol=1e-4) for k in one.p)


def test_model_score_as_a_plain_loop():
    """Each id once, attending to what its window shows before it, against loops over places."""
    rng = np.random.default_rng(6)
    m = 30
    bounds = np.array([0, 3, 130, 131, 260])
    ids = rng.integers(0, m - 1, 260).astype(np.int32)
    ids[bounds[1:] - 1] = m - 1
    model, p, _, _ = lm.train(ids, bounds, m, steps=5)
    got = model.score(ids, bounds)
    query, key = p["e"] @ p["q"], p["e"] @ p["k"]
    for t in range(len(bounds) - 1):
        own, total = ids[bounds[t] : bounds[t + 1]].tolist(), 0.0
        for at in range(len(own)):
            first = at // lm.STRIDE * lm.STRIDE - lm.CONTEXT
            shown = [(own[j - 1] if j else m - 1, own[j]) for j in range(max(0, first), at + 1)]
            last = shown[-1][0]
            weights = [math.exp(min(20, float(query[last] @ key[b]))) for b, _ in shown]
            mean = sum(w * p["v"][b] for w, (b, _) in zip(weights, shown, strict=True)) / sum(weights)
            gate = np.exp(mean + p["b"] - (mean + p["b"]).max())
            mix = float((gate / gate.sum()) @ model.table[last, own[at]])
            same = [x for b, x in shown[:-1] if b == last]
            share = float(model.copy[min(len(same), len(model.copy) - 1)])
            total += math.log10((1 - share) * mix + share * (sum(x == own[at] for x in same) / len(same) if same else 0))
        assert abs(total - got[t]) < 1e-3 * len(own)


def test_attention_helps(corpus):
    """Trained attention against gates that are the same everywhere, on texts of two languages that it has not seen."""
    texts = [" ".join(words(t)) for i, t in corpus[1] if i is not None and i < 120]
    spell = lambda some: [np.array([ord(c) % 60 for c in t] + [60], np.int32) for t in some]
    seen, new = spell(texts[:80]), spell(texts[80:])
    joined = lambda x: (np.concatenate(x), np.concatenate([[0], np.cumsum([len(a) for a in x])]))
    model, p, _, _ = lm.train(*joined(seen), 61)
    flat = lm.built({**p, "v": np.zeros_like(p["v"])}, model.copy)
    flat.table = model.table
    assert model.score(*joined(new)).sum() > flat.score(*joined(new)).sum()


def test_language_model_in_any_order(spark, corpus):
    """Scores too, to a millionth, however the rows lie; and workers that have scored before don't matter."""
    key = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_known"], r["base_score"], r["score"]) for r in lm.op1_lm(df).collect())
    first = key(corpus[0])
    for other in (corpus[0].orderBy(F.desc("doc_id")).repartition(3), corpus[0].repartition(7, "source"), corpus[0].coalesce(1), corpus[0].repartition(12, "doc_id")):
        got = key(other)
        assert [r[:2] for r in got] == [r[:2] for r in first]
        assert all(abs(x - y) <= 1e-6 * max(1, abs(y)) for a, b in zip(got, first, strict=True) for x, y in zip(a[2:], b[2:], strict=True))


def test_words_and_shares_mixed():
    """Words' probabilities from ids', and their mixture with shares, against plain loops."""
    rng = np.random.default_rng(5)
    lens, bounds = rng.integers(1, 5, 12), np.array([0, 4, 4, 12])
    logs = -rng.random(int(lens.sum()) + 3)
    words_, ends = lm.by_word(logs, lens, bounds)
    at, expect, last = 0, [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for n in lens[a:b]:
            expect.append(logs[at : at + n].sum())
            at += n
        last.append(logs[at])
        at += 1
    assert np.allclose(words_, expect) and np.allclose(ends, last)
    shares = np.where(rng.random(12) < 0.5, 0, rng.random(12))
    assert np.allclose(lm.mixed(words_, shares, 0.3), [math.log10(0.7 * 10**w + 0.3 * s) for w, s in zip(words_, shares, strict=True)])
    best = lm.mixing_weight(words_, shares)
    total = lambda w: lm.mixed(words_, shares, w).sum()
    assert total(best) >= max(total(w) for w in np.linspace(0.01, 0.99, 99)) - 0.01


def test_model_sums_to_one():
    rng = np.random.default_rng(0)
    m = 40
    ids = rng.integers(0, m - 1, 600).astype(np.int32)
    bounds = np.array([0, 200, 600])
    ids[bounds[1:] - 1] = m - 1
    model, _, _, _ = lm.train(ids, bounds, m, steps=3)
    first, text = lm.windows(bounds)
    before, target, inside = lm._cut(ids, bounds, first, text, m - 1)
    total = 0
    for x in range(m):
        t = target.copy()
        t[:, lm.CONTEXT + 7] = x
        total = total + model.probabilities(before, t)[:, 7]
    assert np.allclose(total[inside[:, lm.CONTEXT + 7]], 1, atol=1e-4)


def test_attention_is_looked_up(monkeypatch):
    """Scoring takes the exponential of a pair of ids once, not once a place that sees another; and the weights are those of training."""
    rng = np.random.default_rng(4)
    m = 50
    bounds = np.array([0, 7, 1207, 1208, 6000])
    ids = rng.integers(0, m - 1, 6000).astype(np.int32)
    ids[bounds[1:] - 1] = m - 1
    model, p, _, _ = lm.train(ids, bounds, m, steps=3)
    first, text = lm.windows(bounds)
    fresh, exp, taken = lm.built(p, model.copy), np.exp, []
    fresh.table = model.table
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))
    got = fresh.score(ids, bounds)
    monkeypatch.undo()
    assert sum(taken) <= (m + 1) ** 2 + lm.EXPERTS * lm.STRIDE * len(first)
    assert np.allclose(got, model.score(ids, bounds))
    assert fresh.__getstate__()["_pairs"] is None
    steep = lm.built({**p, "k": p["k"] * 400}, model.copy)  # some scores pass 20, where they are cut
    assert (steep.query @ steep.key.T).max() > 20
    before, _, _ = lm._cut(ids, bounds, first, text, m - 1)
    for some in (model, steep):
        assert np.allclose(some.gates(before), some.attended(before)[0], atol=1e-5)


def test_earlier_places_as_plain_loops():
    rng = np.random.default_rng(7)
    for kind, high in ((np.int32, 5), (np.int64, 2**50)):
        rows = np.concatenate([rng.integers(0, high, (20, 80)), np.zeros((1, 80), np.int64)]).astype(kind)
        assert lm._alike(rows).tolist() == [[r[:j].count(r[j]) for j in range(80)] for r in rows.tolist()]
    assert lm._alike(rows[:0]).shape == (0, 80)


def test_words_are_spelled_alone():
    """Spelled in one go from an Arrow array, slices too, as each word by itself."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        subwords = lm.Subwords(f.read(), public_tokenizers.PATTERN)
    for some in (["the", "naïve", "don't", "12345", "x" * 300, "日本語", "\u00a0", "🙂🙂"], ["a", "\u2003b", "\u00a0", "\u3000", "c"], ["one"], []):
        words_ = pa.array(["left out", *some], pa.string())[1:]
        ids, n = subwords.raw_ids(words_)
        own = [subwords.encoding.encode_ordinary(" " + w) for w in some]
        assert ids.tolist() == [x for o in own for x in o] and n.tolist() == [len(o) for o in own]


def test_mix_as_plain_loops(spark, corpus):
    """Words taken of each document, from streams laid out by loops; and every stretch of slots holds the sources in proportion."""
    df = corpus[0]
    rows = df.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"), mixing.content_hash(10).alias("h")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {g: (5, 2, 1)[i % 3] for i, g in enumerate(names)}
    target, open_, left = {}, {*names}, 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[g] for g in open_)
        full = {g for g in open_ if 2 * sizes[g] < level * weight[g]}
        if not full:
            break
        for g in full:
            target[g] = 2.0 * sizes[g]
            left -= target[g]
        open_ -= full
    target |= {g: level * weight[g] for g in open_}
    expect = []
    for g in names:
        need, at = math.floor(target[g] + 0.5), 0
        for r in sorted((r for r in rows if r["source"] == g), key=lambda r: (r["h"] % mixing.CHUNKS, r["h"], r["size"])):
            took = sum(max(0, min(need, at + r["size"] + turn * sizes[g]) - (at + turn * sizes[g])) for turn in (0, 1))
            expect.append((-1 if r["doc_id"] is None else r["doc_id"], r["size"], sizes[g], round(target[g], 6), took))
            at += r["size"]
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.op10_mixing(df).collect()]
    assert sorted(got) == sorted(expect)
    plan = spark.createDataFrame([("a", 256 * 500), ("b", 256 * 200), ("c", 256 * 100)], "source string, need long")
    order = [r["source"] for r in mixing.schedule(plan).orderBy("slot").collect()]
    for n in range(50, 780, 10):
        assert all(abs(order[:n].count(g) - n * share) <= 6 for g, share in (("a", 5 / 8), ("b", 2 / 8), ("c", 1 / 8)))
    assert Counter(order) == {"a": 500, "b": 200, "c": 100}
