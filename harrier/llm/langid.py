"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed character trigrams, counted over all learning rows. A
document is a mixture of languages: expectation-maximisation finds the proportions under which its
trigrams are likeliest. The languages in the mixture are chosen by penalised likelihood: the
candidates enter in order of their share in the mixture of all languages, and the set with the best
log-likelihood less a charge for each language wins. The largest share names the document.

A lone letter is a trigram too, between blanks. The score is the winner's share, or a single language's probability among all, so a text that any language
may have written scores low. Texts are scored whole. Texts that are null or have no letter are `und` with score 0; so is every
text where no language could be learned. Rows with a null language teach nothing. Each row is
scored by itself, so repeated rows and ties need no rule (equal shares: the smaller language code).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import fold

#: Buckets of trigrams, steps of the mixture's inference, prior count of a bucket, texts inferred together.
BUCKETS, STEPS, PRIOR, BLOCK = 8192, 12, 0.5, 256
#: Characters hashed at once.
_SPAN = 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with a blank before and after it, and 0 for what is no letter; and where each begins."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    points = np.frombuffer((" " + "  ".join(low.to_pylist()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(pc.utf8_length(low).to_numpy().astype(np.int64) + 2)
    return np.where(_letters()[points], points, 0).astype(np.uint32), np.concatenate([[0], ends])


def _buckets(points: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that begins at each position, -1 where no letter is in its middle: so none lies in two texts."""
    h = points * np.uint32(0x9E3779B1)
    h[:-1] = (h[:-1] ^ (points[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    h[:-2] = (h[:-2] ^ (points[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    out = (h >> np.uint32(8)).astype(np.int32) % BUCKETS
    middle = np.concatenate([points[1:], np.zeros(1, np.uint32)])
    out[middle == 0] = -1
    return out


def _spans(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _SPAN bytes and BLOCK rows at most; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = min(at + BLOCK, max(at + 1, int(np.searchsorted(ends, before + _SPAN))))
        yield at, to
        at = to


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (text, bucket), and whether a text has a letter; of a text alone, whatever its neighbours."""
    if not len(texts):
        return np.zeros((0, BUCKETS), np.float32), np.zeros(0, bool)
    points, bounds = _lowered(texts)
    bucket = _buckets(points)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    has = np.bincount(rows, weights=points > 0, minlength=len(texts)) > 0
    ok = bucket >= 0
    flat = np.bincount(rows[ok] * BUCKETS + bucket[ok], minlength=len(texts) * BUCKETS)
    return flat.reshape(len(texts), BUCKETS).astype(np.float32), has


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for at, to in _spans(batch.column(1)):
            langs = np.array(batch.column(0).slice(at, to - at).to_pylist(), object)
            counts, _ = _counts(batch.column(1).slice(at, to - at))
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + counts[langs == lang].sum(0, dtype=np.float64)
    for lang, c in sums.items():
        used = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(c[used].astype(np.int64))], ["lang", "bucket", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of the rows of `docs` (text, lang) and their trigram distributions, one row each.

    What reaches the driver is bounded by languages x BUCKETS, whatever the rows.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_learn, "lang string, bucket int, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.full((len(langs), BUCKETS), PRIOR)
    if langs:
        np.add.at(counts, (np.searchsorted(langs, got["lang"].to_numpy(str)), got["bucket"].to_numpy()), got["n"].to_numpy())
    return langs, (counts / counts.sum(1, keepdims=True)).astype(np.float32)


def infer(counts: np.ndarray, model: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (text, language) after STEPS of expectation-maximisation among the allowed languages, and the log-likelihoods."""
    shares = allowed / allowed.sum(1, keepdims=True)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    for _ in range(STEPS):
        shares = shares * ((counts / (shares @ model)) @ model.T) / total
        shares = shares / np.maximum(shares.sum(1, keepdims=True), 1e-30)
    return shares, (counts * np.log(np.maximum(shares @ model, 1e-30))).sum(1)


def choose(counts: np.ndarray, model: np.ndarray, charge: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each text's best set, 0 outside it; and how sure the set is: of a single language, its probability among all."""
    n, k = len(counts), len(model)
    full, best_full = infer(counts, model, np.ones((n, k), np.float32))
    order = np.argsort(-full, 1, kind="stable")
    single = counts @ np.log(model).T
    fee = charge * np.log(np.maximum(counts.sum(1), 2))
    first = single.argmax(1)
    shares = np.zeros((n, k), np.float32)
    shares[np.arange(n), first] = 1
    best = single[np.arange(n), first]
    sure = 1 / np.exp(single - best[:, None]).sum(1, dtype=np.float64)
    # No set is likelier than that of all languages, which bounds what more languages can win.
    for m in range(2, k + 1):
        open_ = np.flatnonzero(best_full - (m - 1) * fee > best)
        if not len(open_):
            break
        allowed = np.zeros((len(open_), k), np.float32)
        np.put_along_axis(allowed, order[open_, :m], 1, 1)
        got, value = infer(counts[open_], model, allowed)
        value = value - (m - 1) * fee[open_]
        won = value > best[open_]
        shares[open_[won]], best[open_[won]], sure[open_[won]] = got[won], value[won], 1.0
    return shares, sure


def _predict(langs: list[str], model: np.ndarray, charge: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, scores = batch.column(batch.num_columns - 1), [], []
            for at, to in _spans(texts):
                counts, has = _counts(texts.slice(at, to - at))
                if not langs:
                    has[:] = False
                shares, sure = choose(counts, model, charge) if langs else (np.zeros((len(has), 1)), np.zeros(len(has)))
                top = shares.argmax(1)
                names += [langs[t] if h else "und" for t, h in zip(top, has, strict=True)]
                scores.append(np.where(has, np.round(np.clip(shares.max(1) * sure, 0, 1), 6), 0.0).astype(np.float64))
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, keep: list[Column | str], charge: float = 1.0) -> DataFrame:
    """lang_pred and score of each row's text, beside the `keep` columns. `charge`: times the log of the trigrams, for each further language."""
    rows = docs.select(*keep, F.col("text").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predict(langs, model, charge), f"{kinds}, lang_pred string, score double")


def op3_langid(docs: DataFrame) -> DataFrame:
    out = fold(4) == 2
    langs, model = learn(docs.where(~F.coalesce(out, F.lit(False))))
    return predict(docs, langs, model, ["doc_id", F.coalesce(out, F.lit(False)).alias("held_out")])
