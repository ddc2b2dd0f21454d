"""Language identification with string kernels.

A text is the set of the character n-grams of one to three characters that it holds (blended spectrum,
presence only). The kernel of two texts is the number of n-grams in both,
divided by the root of the product of their numbers. Landmark texts, of every language, span a
Nyström approximation; one-versus-rest kernel ridge regression is fitted in it. A text's
scores are its presence row times the landmarks' rows times the ridge weights; the last
two are multiplied once, so a batch of texts takes one matrix product.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.tokens import slices

#: Different letters told apart; all others are one, and all that is no letter another. Seven bits each.
ALPHABET = 126
BITS = 7
PART_BYTES, PART_ROWS = 1_000_000, 512
#: Labelled texts besides the landmarks that it takes to say what share of n-grams known languages have.
CALIBRATE = 100
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _LETTERS[0]


def _codes(texts: list[str], symbol: np.ndarray):
    """n-gram codes of all texts and the text of each, and whether a text has a letter."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    s = symbol[points]
    has = np.bincount(owner[s > 0], minlength=len(texts)) > 0
    blank = s == 0
    keep = ~(blank & np.concatenate(([False], blank[:-1] & (owner[1:] == owner[:-1]))))  # runs of blanks are one
    s, owner = s[keep].astype(np.int32), owner[keep]
    out, code = [(s, owner)], s
    for n in (1, 2):
        code = (code[:-1] << BITS) | s[n:]
        inside = owner[n:] == owner[: len(code)]
        out.append((code[inside] + sum(1 << BITS * (m + 1) for m in range(n)), owner[n:][inside]))
    return np.concatenate([c for c, _ in out]), np.concatenate([o for _, o in out]), has


def _symbols(alphabet: str) -> np.ndarray:
    table = letters().astype(np.uint8)  # 0: no letter, 1: another letter
    for k, c in enumerate(alphabet):
        table[ord(c)] = k + 2
        if len(c.upper()) == 1:
            table[ord(c.upper())] = k + 2
    return table


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    alphabet: str
    codes: np.ndarray  # the n-gram of each feature, ascending
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    floor: float = 0.0  # half of the least share of known n-grams among labelled texts that are no landmarks; 0: too few of these

    def presence(self, texts: list[str], symbol: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of unit length with the features of each text, whether it has a letter, and the share of its n-grams that are features."""
        codes, owner, has = _codes(texts, symbol)
        at = feature[codes]
        there = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        there[owner, at] = 1
        there = there[:, :-1]
        size = np.bincount(owner, minlength=len(texts))
        known = 1 - np.bincount(owner[at == len(self.codes)], minlength=len(texts)) / np.maximum(size, 1)
        return there / np.sqrt(np.maximum(there.sum(1), 1))[:, None], has, known

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols by code point, and features by n-gram (one past the last: none)."""
        feature = np.full(sum(1 << BITS * (n + 1) for n in range(3)), len(self.codes), np.int32)
        feature[self.codes] = np.arange(len(self.codes))
        return _symbols(self.alphabet), feature

    def predict(self, texts: list[str], tables) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and the share of its n-grams that the model knows."""
        rows, has, known = self.presence(texts, *tables)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), known
        scores = rows @ self.weights + self.bias
        best = scores.argmax(1)
        names = [self.languages[b] if h else "und" for b, h in zip(best, has)]
        return names, np.where(has, np.clip(scores.max(1), 0, 1), 0).astype(float), known


def train(samples: list[tuple[str, str]], landmarks: int, ridge: float = 0.1) -> Model:
    """Fit on (text, language) pairs; the first ``landmarks`` of each language are landmarks."""
    samples = [(t, lang) for t, lang in samples if any(map(str.isalpha, t))]
    languages = tuple(sorted({lang for _, lang in samples}))
    if not languages:
        return Model((), "", np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0))
    counted = Counter()
    for t, _ in samples:
        counted.update(t.lower())
    seen = [(-n, c) for c, n in counted.items() if c.isalpha()]
    alphabet = "".join(c for _, c in sorted(seen)[:ALPHABET])
    texts = [t for t, _ in samples]
    rank, number = Counter(), []
    for _, lang in samples:
        number.append(rank[lang])
        rank[lang] += 1
    marks = [t for t, n in zip(texts, number) if n < landmarks]
    codes = np.unique(_codes(marks, _symbols(alphabet))[0]).astype(np.int64)
    empty = Model(languages, alphabet, codes, np.zeros((0, 0)), np.zeros(0))
    tables = empty.tables()

    def rows(of):
        """Features and known shares of texts, a part at a time."""
        for i in range(0, len(of), PART_ROWS):
            there, _, known = empty.presence(of[i : i + PART_ROWS], *tables)
            yield there, known

    base = np.concatenate([there for there, _ in rows(marks)])
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    some = value > 1e-6 * value.max()
    whiten = vector[:, some] / np.sqrt(value[some])
    near, known = zip(*((there @ base.T, known) for there, known in rows(texts)))
    others = np.concatenate(known)[np.array(number) >= landmarks]
    floor = float(others.min()) / 2 if len(others) >= CALIBRATE else 0.0
    z = np.concatenate(near) @ whiten
    y = np.array([[lang == one for one in languages] for _, lang in samples], float)
    middle, bias = z.mean(0), y.mean(0)
    z -= middle
    beta = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ (y - bias))
    return Model(languages, alphabet, codes, (base.T @ (whiten @ beta)).astype(np.float32), bias - middle @ beta, floor)


def fit(
    docs: DataFrame,
    labelled: Column,
    per_language: int = 1000,
    landmarks: int = 64,
    language_bytes: int = 16_000_000,
    languages: int = 500,
    lang_col: str = "lang",
    text_col: str = "text",
    key_col: str = "doc_id",
) -> Model:
    """A model from a sample of the labelled rows.

    Rows for which ``labelled`` is true and whose text and language aren't null are
    drawn by the hash of key and text: about ``per_language`` rows and ``language_bytes`` of whole texts of each language at
    most (all, if it has fewer), from the ``languages`` most frequent ones. That bounds what the driver gathers.
    """
    rows = docs.where(labelled).select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40)).alias("draw")
    share = F.lit(False)
    for r in counts:
        part = min(1, per_language / r.n, language_bytes / max(1, r.size))
        share |= (F.col("lang") == r.lang) & (F.col("draw") < F.lit(int(part * (1 << 40))))
    drawn = rows.withColumn("draw", draw).where(share).select("draw", "text", "lang").collect() if counts else []
    return train([(r.text, r.lang) for r in sorted(drawn, key=lambda r: (r.draw, r.text, r.lang))], landmarks)


def predicted(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """All columns and rows of ``docs`` with lang_pred, score and known, or what ``names`` calls them; they replace columns of these names.

    ``und`` with score 0: the text is null or has no letter, or no language is
    known. The score is the winner's regression value, held within 0 and 1; equal ones go to the language whose name is
    less. ``known``: the share of the text's n-grams that the model has learnt; in an unknown script it lies below the model's ``floor``.
    """
    plain = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by alphabet and landmarks

    def scored(batches):
        model = shared.value
        tables = model.tables()
        for batch in batches:
            for big in slices(batch, text_col, PART_BYTES):
                for at in range(0, len(big), PART_ROWS):
                    part = big.slice(at, PART_ROWS)
                    langs, score, known = model.predict([t or "" for t in part.column(text_col).to_pylist()], tables)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(known)], [*part.schema.names, *names])

    schema = T.StructType([*plain.schema, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType())))])
    return plain.mapInArrow(scored, schema)
