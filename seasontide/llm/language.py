"""Language identification by multilingual mixture inference.

Training counts hashed byte 3-grams per language over all training documents. A
document is a mixture: expectation-maximisation finds the shares of its languages
from the grams' likelihoods. The set of languages grows as long as one more raises
the log-likelihood, fitted anew, by more than a penalty. Numpy works inside tasks;
the counts are added up by Spark, and the model is a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasontide.llm.common import mix, slices

#: Hash buckets of the model; its size is this times the number of languages.
BUCKETS = 1 << 14
#: The model goes to every task, so its number of languages is bounded.
MOST_LANGUAGES = 500
SMOOTHING = 0.5
ROUNDS = 25
#: Log-likelihood, in times log(grams), that one more language must bring.
PENALTY = 3.0
#: Grams overlap, so each counts as this share of an independent one.
WEIGHT = 1 / 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Signs and digits say nothing about a language and count as a gap; bytes of multi-byte letters stay.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Buckets of the 3-grams that hold a letter in their middle, and the text of each."""
    folded = _LOWER[data]
    letter = _LETTER[folded]
    folded = np.where(letter, folded, np.uint8(32)).astype(np.uint64)
    n = len(folded)
    before, after = np.full(n, 32, np.uint64), np.full(n, 32, np.uint64)
    before[1:], after[:-1] = folded[:-1], folded[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    before[heads] = 32
    after[heads[1:] - 1] = 32
    at = np.flatnonzero(letter)
    code = before[at] << np.uint64(16) | folded[at] << np.uint64(8) | after[at]
    return (mix(code + np.uint64(1)) >> np.uint64(50)).astype(np.int64), np.searchsorted(offsets, at, side="right") - 1


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods per bucket, from all rows (text, lang) with a language.

    Null texts add nothing. Each batch adds up its grams per language, Spark adds the
    batches; what comes to the driver is one row of BUCKETS counts per language.
    """
    parts = BUCKETS // 256

    def count(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            place = {name: i for i, name in enumerate(names)}
            own = np.array([place[x] for x in langs], np.int64)
            total = np.zeros(len(names) * BUCKETS, np.int64)
            for row, data, offsets in slices(batch.column(0)):
                buckets, text = _grams(data, offsets)
                total += np.bincount(own[row + text] * BUCKETS + buckets, minlength=len(total))
            table = total.reshape(len(names), parts, 256)
            rows = [(name, p, table[i, p].tolist()) for i, name in enumerate(names) for p in range(parts) if table[i, p].any()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                ],
                ["lang", "part", "counts"],
            )

    rows = labelled.where("lang is not null").select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, part int, counts array<long>")
    sums = counts.groupBy("lang", "part").agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(256)])
    named = [r[0] for r in labelled.where("lang is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(named) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(named)
    table = np.zeros((len(names), BUCKETS))
    for r in sums.collect():
        table[names.index(r[0]), r[1] * 256 : (r[1] + 1) * 256] = r[2:]
    table += SMOOTHING
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def mixture(likelihood: np.ndarray, counts: np.ndarray) -> tuple[dict[int, float], float]:
    """Shares of the languages of one document, and the log-likelihood of the mixture.

    ``likelihood`` has a row per distinct gram and a column per language (logs);
    ``counts`` how often each gram occurs. Languages join in turn, the best one first.
    """
    weight = counts * WEIGHT
    total = weight.sum()
    top = likelihood.max(axis=1, keepdims=True)
    p = np.exp(likelihood - top)
    constant = float((weight * top[:, 0]).sum())
    single = weight @ likelihood
    chosen = [int(np.argmax(single))]
    shares, best = np.ones(1), float(single[chosen[0]])
    while len(chosen) < p.shape[1]:
        # the language that gains most from a tenth of the document
        now = p[:, chosen] @ shares
        gains = weight @ np.log(0.9 * now[:, None] + 0.1 * p)
        gains[chosen] = -np.inf
        new = int(np.argmax(gains))
        tried = p[:, [*chosen, new]]
        s = np.append(shares * 0.9, 0.1)
        for _ in range(ROUNDS):
            mixed = tried * s
            s = (weight[:, None] * mixed / mixed.sum(axis=1, keepdims=True)).sum(axis=0) / total
            if s[-1] < 1e-3:
                break
        value = float(weight @ np.log(np.maximum(tried @ s, 1e-300))) + constant
        if value - best <= PENALTY * np.log(max(total, np.e)):
            break
        chosen, shares, best = [*chosen, new], s, value
    return {lang: float(s) for lang, s in zip(chosen, shares)}, best


def predict(documents: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, languages) for every row.

    lang_pred has the largest share of the mixture (ties: the likelier one), and
    score is that share times the posterior of the language set's leader over any
    other single language, 0 to 1. languages lists those of the set with their shares.
    A null text, or one without a letter, is ``und`` with score 0 and no languages,
    and so is everything if nothing was learned.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.T.copy())

    def run(batches):
        table = shared.value
        for batch in batches:
            n = batch.num_rows
            preds, scores, sets = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            lettered = batch.column(2).to_pylist()
            for row, data, offsets in slices(batch.column(1), 1 << 20) if names else ():
                buckets, text = _grams(data, offsets)
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    own = buckets[bounds[i] : bounds[i + 1]]
                    if not len(own) or not lettered[row + i]:
                        continue
                    grams, counts = np.unique(own, return_counts=True)
                    likelihood = table[grams]
                    shares, _ = mixture(likelihood, counts.astype(float))
                    lead = max(shares, key=shares.get)
                    single = (counts * WEIGHT) @ likelihood
                    others = np.delete(single, list(shares)) - single[lead]
                    posterior = 1.0 / (1.0 + np.exp(np.clip(others, -700, 0)).sum())
                    preds[row + i], scores[row + i] = names[lead], float(shares[lead] * posterior)
                    sets[row + i] = [{"lang": names[k], "share": s} for k, s in sorted(shares.items(), key=lambda x: -x[1])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                ],
                ["doc_id", "lang_pred", "score", "languages"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return documents.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    )


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(documents: DataFrame, held: Callable[[Column], Column] = held_out) -> DataFrame:
    """Learn from the rows that are not held out, and predict all. A null doc_id is not held out."""
    out = F.coalesce(held(F.col("doc_id")), F.lit(False))
    names, model = train(documents.where(~out))
    found = predict(documents, names, model)
    return found.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
