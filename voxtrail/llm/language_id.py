"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors,
rotated by their place (binding); a text is the sum of its trigrams (bundling); a language's
prototype is the sum over its learning texts. A text takes the language whose prototype has the
largest cosine with it. Letters are lower-cased, everything else counts as one blank.

Letter vectors are made from a seed, so tasks share nothing but the prototypes: (languages x DIM)
numbers, where the languages are bounded by the learning sample (``fit_rows``). Prototypes are
sums of whole numbers, equal in any order.

Defined results: null text or no letter: ``und``, score 0. Ties: the smaller language. No rows to
learn from: ``und`` throughout. Null ids are never held out; repeated rows are judged each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from voxtrail.llm.common import held_out

DIM = 1024
ROWS = 8192      # letter vectors; code points share them by remainder
STRIP = 4096     # trigrams bound at once
_made: dict[str, np.ndarray] = {}


def _letters(seed: int = 20240917):
    if not _made:
        base = np.random.default_rng(seed).integers(0, 2, (ROWS, DIM), dtype=np.int8) * 2 - 1
        alpha = np.zeros(0x110000, dtype=bool)
        alpha[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _made.update(a=np.roll(base, 2, axis=1), b=np.roll(base, 1, axis=1), c=base, alpha=alpha)
    return _made


def encode(text: str | None) -> np.ndarray | None:
    """Bundled trigram vector of a whole text, or None without a letter."""
    t = _letters()
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    is_letter = t["alpha"][cp]
    if not is_letter.any():
        return None
    ids = np.where(is_letter, cp % (ROWS - 1) + 1, 0)
    ids = np.concatenate([[0], ids, [0]])
    ids = ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])]
    codes, counts = np.unique((ids[:-2] * ROWS + ids[1:-1]) * ROWS + ids[2:], return_counts=True)
    out = np.zeros(DIM, dtype=np.float64)
    for s in range(0, len(codes), STRIP):
        g = codes[s:s + STRIP]
        bound = t["a"][g // ROWS ** 2] * t["b"][g // ROWS % ROWS]
        bound *= t["c"][g % ROWS]
        out += counts[s:s + STRIP].astype(np.float32) @ bound.astype(np.float32)
    return out


def prototypes(docs: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """Sum of the text vectors per language, over all rows given."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for language, words in zip(pdf["lang"], pdf["text"]):
                v = encode(words)
                if v is not None:
                    acc[language] = acc.get(language, 0) + v
        if acc:
            yield pd.DataFrame({"lang": list(acc), "v": [x.astype(np.int64) for x in acc.values()]})

    parts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInPandas(
        sums, "lang string, v array<bigint>")
    rows = (parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at")
            .agg(F.sum("x").alias("x")).groupBy("lang")
            .agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).collect())  # DIM numbers a language
    return {r.lang: np.array([e.x for e in r.v], dtype=np.float64) for r in rows}


def identify(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str], text: str = "text",
             out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` plus the predicted language and its cosine (0 to 1), row by row.

    A text that is kept travels once."""
    langs = sorted(model)
    proto = np.stack([model[k] / np.linalg.norm(model[k]) for k in langs]) if langs else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for words in batch.column(at):
                v = encode(words.as_py())
                if v is None or proto is None:
                    pred.append("und")
                    score.append(0.0)
                else:
                    cos = proto @ v / max(np.linalg.norm(v), 1e-12)
                    k = int(cos.argmax())
                    pred.append(langs[k])
                    score.append(float(min(1.0, max(0.0, cos[k]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=[*batch.schema.names[:len(keep)], "__pred", "__score"])

    at = keep.index(text) if text in keep else len(keep)
    d = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)],
                    *([] if at < len(keep) else [F.col(text).alias("__text")]))
    schema = T.StructType([*d.schema.fields[:len(keep)], T.StructField("__pred", T.StringType()),
                           T.StructField("__score", T.DoubleType())])
    return d.mapInArrow(judge, schema).select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__pred").alias(out[0]), F.col("__score").alias(out[1]))


def learn(docs: DataFrame, fit_rows: int = 20_000) -> dict[str, np.ndarray]:
    """Prototypes from the labelled documents that are not held out.

    At most about ``fit_rows`` of them, drawn by a hash of the id: the bound on the fit."""
    train = docs.select("doc_id", "text", "lang").filter(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, fit_rows / max(1, train.count()))
    drawn = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
    return prototypes(drawn, "text", "lang")
