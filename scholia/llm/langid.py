"""Language identification in two levels: the family first, then one-versus-one linear SVMs among the languages of the family.

Features are frequencies of byte trigrams of the lower-cased whole text with everything but letters as spaces. Families are told apart by one linear SVM for
each; inside a family every pair of languages has its own SVM and the languages are ranked by won pairs, then by summed margins.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import likely_sampled, release_memory, trimmed

#: Hashed trigram space.
DIMENSIONS = 4096
_CHUNK = 256

# Families of common language codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: A letter, for training and prediction alike: only texts that hold one have a language.
LETTER = r"\p{L}"
# bytes that stay: a-z and all bytes of longer UTF-8 sequences
_KEPT = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def family(language: str) -> str:
    return _FAMILY_OF.get(language, language)


def trigram_features(texts: list[str]) -> np.ndarray:
    """One row of square-rooted trigram frequencies, of length 1, for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
        raw = np.where(_KEPT[raw], raw, np.uint8(32))
        raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)  # runs of spaces count as one
        if len(raw) < 3:
            continue
        mixed = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77) ^ raw[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        out[i] = np.sqrt(np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS))
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(length, 1e-12)


def linear_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Weights and intercept of a linear SVM (squared hinge, classes weighted alike), by accelerated gradient descent."""
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    y, share = y.astype(np.float32), share.astype(np.float32)
    w = past = np.zeros(x.shape[1], np.float32)
    rate = 1 / (2 * 2.0 + penalty)  # rows have length sqrt(2) and the weights of rows sum to 1
    for t in range(rounds):
        ahead = w + np.float32(t / (t + 3)) * (w - past)
        short = np.maximum(np.float32(0), 1 - y * (x @ ahead))
        past, w = w, ahead - np.float32(rate) * (np.float32(penalty) * ahead - 2 * ((share * y * short) @ x))
    return w


class Model:
    """Trained weights; small enough (families and pairs times DIMENSIONS) to travel in a task's closure."""

    def __init__(self, features: np.ndarray, languages: np.ndarray):
        self.languages = sorted(set(languages))
        kin = np.array([family(x) for x in languages])
        self.families = sorted(set(kin))
        self.members = {f: [x for x in self.languages if family(x) == f] for f in self.families}
        self.between = np.array([linear_svm(features, kin == f) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for members in self.members.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    rows = (languages == a) | (languages == b)
                    self.pairs[a, b] = linear_svm(features[rows], languages[rows] == a)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, scores = np.full(len(x), "und", object), np.zeros(len(x))
        if not self.languages:
            return names, scores
        if self.between is None:
            kin, sure = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = x @ self.between[:, :-1].T + self.between[:, -1]
            ranked = np.sort(margins, axis=1)
            kin, sure = margins.argmax(axis=1), 1 / (1 + np.exp(-2 * (ranked[:, -1] - ranked[:, -2])))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(kin == k)
            members = self.members[f]
            if not len(rows):
                continue
            won, total, least = (np.zeros((len(rows), len(members))) for _ in range(3))
            least += np.inf
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    w = self.pairs[a, members[j]]
                    m = x[rows] @ w[:-1] + w[-1]
                    for at, signed in ((i, m), (j, -m)):
                        won[:, at] += signed > 0
                        total[:, at] += signed
                        least[:, at] = np.minimum(least[:, at], signed)
            best = (won + total / (1e3 * (1 + np.abs(total).max(initial=0)))).argmax(axis=1)
            names[rows] = np.array(members, object)[best]
            scores[rows] = sure[rows] / (1 + np.exp(-4 * least[np.arange(len(rows)), best]))
        return names, scores


@trimmed
def _sampled_features(batches):
    for batch in batches:
        for low in range(0, len(batch), _CHUNK):
            part = batch.iloc[low : low + _CHUNK]
            x = trigram_features(list(part["text"])).astype(np.float16)
            yield pd.DataFrame({"lang": part["lang"].to_numpy(), "x": [row.tobytes() for row in x]})


@trimmed
def _predictions(batches, model: Model):
    for batch in batches:
        for low in range(0, len(batch), _CHUNK):
            part = batch.iloc[low : low + _CHUNK]
            known = part["lettered"].to_numpy(bool)
            names, scores = np.full(len(part), "und", object), np.zeros(len(part))
            if known.any():
                names[known], scores[known] = model.predict(trigram_features(list(part["text"][known])))
            yield part[["doc_id", "held_out"]].assign(lang_pred=names, score=scores)


def train(labelled: DataFrame, documents_in_all: int = 1200) -> Model:
    """Fit on a bounded sample of ``labelled`` (doc_id, text, lang): ``documents_in_all`` rows at most, equally many of each language, by smallest hash."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    share = max(2, documents_in_all // max(1, len(totals)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
    # narrow rows are ranked, and of a large language only about twice as many as are wanted
    likely = rows.where(likely_sampled(F.col("lang"), totals, share)).where(F.col("text").rlike(LETTER))
    picked = likely.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= share).select("doc_id", "lang").distinct()
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")  # at most documents_in_all narrow rows
    found = sample.select("lang", "text").mapInPandas(_sampled_features, "lang string, x binary").limit(2 * documents_in_all).collect()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in found], np.float32).reshape(len(found), DIMENSIONS)
    return Model(x, np.array([r["lang"] for r in found], object))


def identify_languages(documents: DataFrame, held_out: F.Column, documents_in_all: int = 1200) -> DataFrame:
    """Predict the language of every whole text of ``documents`` (doc_id, text, lang).

    Learns only from text and non-null lang of rows where ``held_out`` (a condition on doc_id) is false. Returns one row per input row: doc_id, held_out,
    lang_pred (a learned language, or "und" where the text is null or has no letter or nothing could be learned), score (0 to 1; 0 for "und").

    Rows are independent: repeated rows get equal predictions, null ids are kept (held_out is then null and the row isn't learned from), ties in votes go to
    the larger summed margin and then to the alphabetically first language. Extra columns are ignored.
    """
    rows = documents.select(F.col("doc_id"), F.col("text"), F.col("lang")).withColumn("held_out", held_out)
    model = train(rows.where(~F.col("held_out")), documents_in_all)
    release_memory()  # of the sample, on the driver
    kind = dict(documents.dtypes)["doc_id"]
    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered")
    return rows.select("doc_id", "text", "held_out", lettered).mapInPandas(partial(_predictions, model=model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
