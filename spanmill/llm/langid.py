"""Language identification with a string kernel.

Kernel: blended spectrum of n-gram presence. phi(x) marks which character n-grams (1 to 3, over the
lower-cased text, every run of non-letters one blank) occur in the whole text x, hashed to FEATURES
places; k(x, z) = |phi(x) & phi(z)| / sqrt(|phi(x)| |phi(z)|). Nystroem: with landmarks Z of the
training sample, x is mapped to K(Z,Z)^(-1/2) K(Z,x); a kernel ridge regression for each language
against the rest is solved there. Documents are scored in blocks by matrix products.

The model is fitted on a bounded sample: at most PER_LANG training documents a language, those of
smallest hash. Everything else reads every document whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import drop_clashing, trimmed

#: Hashed n-gram places; n-gram lengths.
FEATURES, GRAMS = 1 << 16, (1, 2, 3)
#: Bounds of the fit: training documents of each language, and of all (but one a language at least); landmarks, or as many
#: as there are languages; ridge.
PER_LANG, FIT_ROWS, LANDMARKS, RIDGE = 250, 10_000, 128, 1e-2
#: Documents scored by one matrix product.
BLOCK = 128
#: Answer for a text without letters.
UND = "und"
ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> itself + 1 for letters, 0 for the rest."""
    table = np.zeros(0x110000, np.uint32)
    letters = [i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]
    table[letters] = np.array(letters, np.uint32) + 1
    return table


def presence(text: str | None, piece: int = 1 << 20) -> np.ndarray | None:
    """phi(text) as booleans, None for a text without letters. Long texts are read in pieces."""
    marks, seen = np.zeros(FEATURES, bool), False
    low = (text or "").lower()
    carry, blank = np.zeros(1, np.uint32), np.zeros(1, np.uint32)
    for at in range(0, len(low), piece):
        codes = np.frombuffer(low[at : at + piece].encode("utf-32-le", "surrogatepass"), "<u4")
        own = _letters()[np.minimum(codes, 0x10FFFF)]
        seen = seen or bool(own.any())
        a = np.concatenate([carry, own, blank] if at + piece >= len(low) else [carry, own])
        keep = a != 0
        keep[1:] |= a[:-1] != 0
        keep[0] = True
        a = a[keep]
        carry = a[-(max(GRAMS) - 1) :]
        h = np.zeros(len(a), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(a) - n + 1] * np.uint32(ODD[0]) + a[n - 1 :] * np.uint32(ODD[1])
            if n in GRAMS:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(ODD[2]) + np.uint32(n)
                marks[mixed >> np.uint32(16)] = True
    return marks if seen else None


def sample(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG) -> list:
    """At most per_lang rows of each language and FIT_ROWS of all, as (language, packed phi), chosen by a hash of key and text.

    First one count a language; then a row is drawn with a chance of 1.5 per_lang / count, which needs no shuffle
    of texts. The bound holds exactly, and before anything comes to the driver: of rows equal in key and text one is drawn, and what is drawn
    beyond it is left out by each task already, in the order of the hash.
    """
    good = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    space = 1 << 30
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(11)), F.lit(space))
    # rows equal in key and text are drawn together: what counts is how many different ones there are
    counts = {r[0]: max(1, r[1]) for r in good.groupBy(lang).agg(F.approx_count_distinct(draw, 0.02)).collect()}
    if not counts:
        return []
    per_lang = max(1, min(per_lang, FIT_ROWS // len(counts)))
    share = max(1.5, 8 / per_lang)  # of a language with few places to draw for, some rows are drawn all the same
    limits = [F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(space, int(share * per_lang / n * space) + 1))]
    limit = F.element_at(F.create_map(*limits), F.col(lang))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [presence(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([None if x is None else np.packbits(x).tobytes() for x in bits], pa.binary())], names=["lang", "draw", "bits"])

    thin = good.withColumn("__draw", draw).filter(F.col("__draw") < limit).select(F.col(text).alias("t"), F.col(lang).alias("lang"), F.col("__draw").alias("draw"))
    drawn = thin.mapInArrow(pack, "lang string, draw long, bits binary").filter("bits is not null")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "bits"))
    few = drawn.dropDuplicates(["lang", "draw"]).withColumn("place", place).filter(F.col("place") <= per_lang)
    return [(r["lang"], bytes(r["bits"])) for r in sorted(few.collect(), key=lambda r: (r["lang"], r["place"]))]


class Model:
    """Landmarks and weights; scores(rows of phi) gives one column a language."""

    def __init__(self, labelled: list, landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted({lang for lang, _ in labelled})
        if not labelled:
            self.places, self.z, self.w = np.zeros(0, int), np.zeros((0, 0), np.float32), np.zeros((1, 0), np.float32)
            return
        x = np.unpackbits(np.frombuffer(b"".join(b for _, b in labelled), np.uint8).reshape(len(labelled), -1), axis=1)
        turn = {}
        rank = [turn.setdefault(lang, []).append(i) or len(turn[lang]) for i, (lang, _) in enumerate(labelled)]
        chosen = sorted(range(len(labelled)), key=lambda i: (rank[i], i))[: max(landmarks, len(self.langs))]  # languages take turns
        self.places = np.flatnonzero(x[chosen].any(0))
        z = x[chosen][:, self.places].astype(np.float32)
        self.z = np.ascontiguousarray((z / np.sqrt(x[chosen].sum(1, keepdims=True))).T.astype(np.float32))
        values, vectors = np.linalg.eigh(self.z.T.astype(np.float64) @ self.z)
        good = values > values[-1] * 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        f = self.kernel(x[:, self.places].astype(np.float32), x.sum(1)) @ root
        f = np.hstack([f, np.ones((len(f), 1))])
        names = np.array([lang for lang, _ in labelled])
        y = np.where(names[:, None] == np.array(self.langs)[None], 1.0, -1.0)
        size = np.array([(names == n).sum() for n in names])[:, None]
        weight = len(f) / len(self.langs) / size
        a = f.T @ (f * weight) + ridge * len(f) / 100 * np.eye(f.shape[1])
        beta = np.linalg.solve(a, f.T @ (y * weight))
        self.w = np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32)

    def kernel(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return rows @ self.z / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32)

    def predict(self, texts: list) -> tuple[list, list]:
        """Language and score of each text: the best language, and the logistic of twice its lead over the next."""
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        for at in range(0, len(texts), BLOCK):
            rows, sizes, where = [], [], []
            for i, t in enumerate(texts[at : at + BLOCK]):
                if (p := presence(t)) is not None:
                    rows.append(p[self.places])
                    sizes.append(np.count_nonzero(p))
                    where.append(at + i)
            if not where:
                continue
            s = self.kernel(np.array(rows, np.float32), np.array(sizes)) @ self.w[:-1] + self.w[-1]
            best = s.argmax(1)
            top = np.sort(s, axis=1)
            lead = top[:, -1] - (top[:, -2] if s.shape[1] > 1 else -1.0)
            conf = 1 / (1 + np.exp(-2 * np.clip(lead, 0, 30).astype(float)))
            for i, b, c in zip(where, best, conf, strict=True):
                langs[i], scores[i] = self.langs[b], float(c)
        return langs, scores


def fit(df: DataFrame, **kw) -> Model:
    return Model(sample(df, **kw))


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of df, with `lang_pred` and `score`.

    Null, empty and letterless texts get "und" and 0, as does everything if the model saw no labelled row.
    Ties go to the language that sorts first. Clashing columns of df give way to the results.
    """
    df = drop_clashing(df, lang_pred, score)
    schema = T.StructType([*df.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # landmarks x n-grams: at most LANDMARKS x FEATURES floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                langs, scores = shared.value.predict(b.column(b.schema.names.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang_pred, score])

    return df.mapInArrow(trimmed(run), schema)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from documents that are not held out.

    Null, empty and letterless texts, and all where no row has a language, get "und" and 0. Repeated rows are judged each by
    itself; an empty table gives no rows.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
