"""Periodic runs, the n-gram join and phrase mining against plain versions on small tables, with the awkward rows among them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harrier.llm import ngram_join, periodic, phrases

DOC = "doc_id long, text string, lang string, source string, n_chars long, runs string, size long, f long, rank string"


def docs(spark, rows):
    """(doc_id, text, lang) with columns whose names clash with results'."""
    return spark.createDataFrame([(i, t, g, "s", 0, "x", 7, 1, "y") for i, t, g in rows], DOC)


def split(text, lower=True):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_empty_tables(spark):
    none = docs(spark, [])
    for df in (periodic.op12_periodic(none), ngram_join.op11_ngram_join(none), phrases.op13_phrases(none)):
        assert df.count() == 0


def plain_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((i, q, n) for (i, n), q in best.items())


def words_with_runs(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        own = [rng.choice("ABC") if rng.random() < 0.5 else f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 20))]
        out += (own * 9)[: rng.randint(1, 9 * len(own))] if rng.random() < 0.6 else own
    return out


def test_runs_of_slices():
    rng = random.Random(2)
    for _ in range(120):
        texts = [words_with_runs(rng) for _ in range(rng.randint(1, 5))]
        code = {w: i for i, w in enumerate({w for t in texts for w in t})}
        ids = np.array([code[w] for t in texts for w in t], np.int64)
        got = periodic.runs(ids, np.cumsum([0, *map(len, texts)]))
        assert got.T.tolist() == [[k, i, n, q] for k, t in enumerate(texts) for i, q, n in plain_runs(t)]


def test_polynomials_that_collide():
    """Thue-Morse words, whose halves agree modulo 2^64 for any base: what polynomials take for equal is compared word by word."""
    t = np.array([bin(i).count("1") % 2 for i in range(4096)])
    assert periodic.runs(np.concatenate([t, 1 - t, t, 1 - t, t]), np.array([0, 5 * 4096])).shape[1] == len(plain_runs(np.concatenate([t[-40:], (1 - t)[:40]]).tolist()))


def test_wavelet_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(200)
    tree = periodic.Wavelet(values)
    lo = rng.integers(0, 200, 300)
    hi = np.minimum(200, lo + rng.integers(0, 60, 300))
    least = rng.integers(0, 300, 300)
    expect = [min((int(v) for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(lo, hi, least, strict=True)]
    assert tree.successor(lo, hi, least).tolist() == expect


def test_periodic_documents(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(words_with_runs(rng)), "en") for i in range(150)]
    rows += [(500, None, None), (501, "", "en"), (502, " \n ", "en"), (None, "a a a a a a a b", "en"), (3, rows[3][1], "en"), (3, "z " * 9, "en"), (600, "na " * 100_000, "en"), (601, "x " + "one two three " * 20_000 + "end", "en")]
    expect = []
    for i, t, _ in rows:
        w = split(t, lower=False)
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 10_000:
            period = 1 if w[0] == w[1] else 3
            start = 0 if period == 1 else 1
            found = [(start, period, n - start - (period == 3))] if h % 10 else plain_runs(w[:10])
        else:
            found = plain_runs(w)
        top = None
        for start, q, size in found:
            if top is None or Fraction(size, q) > Fraction(top[1], top[2]):
                top = (start, size, q)
        gone = {k for start, q, size in found for k in range(start + q, start + size)}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expect.append((-1 if i is None else i, len(found), *(top + (1000 * top[1] // top[2],) if top else (None,) * 4), digest("".join(f"{a},{size},{q}\n" for a, q, size in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    big = {i for i, t, _ in rows if len(t or "") > 100_000 and zlib.crc32(str(i).encode()) % 10 == 0}
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in periodic.op12_periodic(docs(spark, rows)).collect()]
    keep = lambda x: sorted((r for r in x if r[0] not in big), key=str)
    assert keep(got) == keep(expect) and sum(r[1] > 0 for r in got) > 60


def components(links, ids):
    at = {i: i for i in ids}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, size, percent):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, rows = text(30), []
    for i in range(120):
        rows.append((i, text(rng.randint(3, 120)) + (common if i % 3 == 0 else [])))
    base = text(150)
    for i in range(200, 290):  # one large group of near copies, more than a list may be short of
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = "edit" + str(rng.randrange(5000))
        rows.append((i, own))
    for i in range(300, 320):
        k = rng.randrange(100)
        own = list(rows[k][1])
        own[rng.randrange(len(own))] = "other"
        rows.append((i, own))
    rows = [(i, " ".join(w).replace("w1", "W1") if i % 2 else "  ".join(w)) for i, w in rows]
    rows += [(400, None), (401, ""), (402, "  "), (403, "one"), (404, "One"), (405, rows[4][1]), (4, rows[4][1]), (4, rows[5][1]), (406, " ".join(f"long{k % 70_000}" for k in range(150_000)))]
    rows += [(407, rows[-1][1] + " more")]
    sets = []
    for i, t in rows:
        w = split(t)
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    by = {k: own for k, (_, own) in enumerate(sets)}
    alike = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    near = [(a, b) for a, b in combinations(by, 2) if 100 * min(len(by[a]), len(by[b])) >= percent * max(len(by[a]), len(by[b])) and alike(by[a], by[b])]
    comp = components(near, list(by))
    least = defaultdict(lambda: 1 << 40)
    for k, c in comp.items():
        least[c] = min(least[c], sets[k][0])
    expect = sorted((sets[k][0], len(sets[k][1]), least[comp[k]]) for k in by)
    df = docs(spark, [(i, t, "en") for i, t in rows])
    assert sorted(map(tuple, ngram_join.similar(df, size, percent).collect())) == expect
    sizes = Counter(comp.values())
    assert max(sizes.values()) > 30


def test_every_common_ngram_is_named(spark, monkeypatch):
    """However many n-grams are common, all come last in the order: else each set would share a long list with another."""
    monkeypatch.setattr(ngram_join, "COMMON", 50, raising=False)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*words[i % 4 :], f"x{i} y{i} z{i}"]) for i in range(20)]
    order = ngram_join.global_order(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4)
    sets = list(ngram_join.sets_of(pa.array(texts), 4))
    keys, n = np.unique(np.concatenate(sets), return_counts=True)
    classes = order.classes_of(keys)
    assert (n >= 20).sum() > 300 and (classes[n >= 16] == 4).all() and (classes[n == 1] > 0).mean() < 0.05


def test_steps():
    rng = np.random.default_rng(7)
    lists = [np.unique(rng.integers(0, 1 << 24, n)) for n in (1, 5, 3000)] + [np.array([0]), np.array([0xFFFF, 0xFFFF * 2, (1 << 24) - 1])]
    lens = np.array([len(x) for x in lists])
    steps, ends = ngram_join._steps(np.concatenate(lists), np.cumsum(lens) - lens)
    cuts = [0, *ends[np.cumsum(lens) - 1].tolist()]
    assert [ngram_join._stepped(steps[a:b].tobytes()).tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [x.tolist() for x in lists]
    assert not len(ngram_join._stepped(b"")) and not len(ngram_join._steps(np.empty(0, np.int64), np.empty(0, np.int64))[0])


def test_ngram_join_without_ids(spark):
    rows = [(None, "a b c d e f g h", None), (None, "a b c d e f g h", None), (9, "q r s t u v w x", None), (None, "q r s t u v w x", None), (None, None, None)]
    got = sorted(map(str, (tuple(r) for r in ngram_join.op11_ngram_join(docs(spark, rows)).collect())))
    assert got == sorted(map(str, [(None, 5, None), (None, 5, None), (9, 5, 9), (None, 5, 9), (None, 0, None)]))


def plain_phrases(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, t, g in rows:
        g = "und" if g is None else g
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[g] += len(w)
            for n in (1, 2, 3):
                for k in range(len(w) - n + 1):
                    counts[g][tuple(w[k : k + n])] += 1
    out = []
    for g, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in f.items()) and len(p) == 2:
                continue
            found.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(g, r + 1, p, a, left, right, total[g], s) for r, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def test_phrases(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["Über", "the", "of", "new", "York", "zürich", "a", "b c", "x", "☃"]
    rows = []
    for i in range(160):
        w = [rng.choice(vocabulary) if rng.random() < 0.8 else f"r{rng.randrange(400)}" for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "! "]) for x in w), rng.choice(["en", "de", None, "und"])))
    rows += [(200, None, "en"), (201, "", None), (None, "new york new york new york", "en"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (300, "the same " * 40_000, "fr"), (301, ". ; !", "en")]
    df = docs(spark, rows)
    plain = plain_phrases(rows, 10, 2000)
    assert sorted(map(tuple, phrases.op13_phrases(df).collect())) == plain and len(plain) > 60
    few = phrases.collocations(phrases.frequent_phrases(df, least=4), top=5)
    assert sorted(map(tuple, few.collect())) == plain_phrases(rows, 4, 5)
    # fingerprints of nine bits, so that nearly all phrases collide, and small slices
    monkeypatch.setattr(phrases, "_SLICE", 50)
    again = phrases.frequent_phrases(df.repartition(5), bits=9)
    whole = phrases.frequent_phrases(df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))


def test_scores_beyond_64_bits(spark):
    """Counts whose products pass 64 bits are scored exactly."""
    a, left, right = 3_000_000_000_001, 7_000_000_000_003, 5_000_000_000_009
    table = spark.createDataFrame([("en", 0, "", 9 * 10**13), ("en", 1, "p", left), ("en", 1, "q", right), ("en", 2, "p q", a)], "lang string, size int, phrase string, f long")
    assert [tuple(r) for r in phrases.collocations(table).collect()] == [("en", 1, "p q", a, left, right, 9 * 10**13, 1_000_000 * a * a // (left * right))]


def test_longest_phrases_hide_shorter_ones(spark):
    rows = [("en", 0, "", 500), ("en", 1, "a", 40), ("en", 1, "b", 40), ("en", 1, "c", 40), ("en", 2, "a b", 30), ("en", 2, "b c", 21), ("en", 3, "a b c", 15)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, size int, phrase string, f long"))
    assert {r["phrase"] for r in got.collect()} == {"a b c"}  # 15 is half of 30, and more than half of 21
    assert phrases.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).where(F.col("size") == 3).first()["score"] == min(1_000_000 * 225 // (40 * 21), 1_000_000 * 225 // (30 * 40))
