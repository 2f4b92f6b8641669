"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams (1 to 4 letters, word borders
included) by rank. A document is compared with every profile by the out-of-place
distance: over the document's own most frequent n-grams, how far each one's rank
is from its rank in the profile, a missing one counting as the profile's length.

n-grams are 64-bit integers: up to three code points are packed, four are mixed.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otelframe.llm.common import documents, map_texts

#: n-grams in a profile and in a document's own list, and the longest n-gram.
PROFILE, LONGEST = 400, 4
#: Groups of tasks that rank a language's n-grams before all are ranked; results do not depend on it.
SLICES = 16
#: Languages are few by nature; more distinct labels than this are an input error.
MOST_LANGUAGES = 500
#: Code points taken at a time when a text is counted (bounds memory).
BLOCK = 1 << 20


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: its lower-case form where it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> np.ndarray:
    """All n-grams of the text, repeats included. Words are runs of letters; a word's
    border is one code that may only start or end an n-gram."""
    code = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = np.concatenate(([0], code, [0])).astype(np.uint64)
    keep = np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))
    a = code[keep]
    if len(a) < 3:
        return np.empty(0, np.uint64)
    letter = a != 0
    out = [a[letter]]
    a = np.where(letter, a, np.uint64(1))  # a border is no letter's code, and not 0: n-grams of all lengths differ
    packed, inside = a, letter
    for n in range(2, LONGEST + 1):
        shifted = a[n - 1 :]
        packed = packed[:-1]
        packed = (packed << np.uint64(21)) | shifted if n <= 3 else (packed * np.uint64(0x9E3779B97F4A7C15) ^ (shifted * np.uint64(0xC2B2AE3D27D4EB4F))) | np.uint64(1 << 63)
        if n == 2:
            ok = letter[:-1] | letter[1:]
        else:
            inside = letter[1 : len(a) - 1] if n == 3 else inside[:-1] & letter[n - 2 : len(a) - 1]
            ok = inside
        out.append(packed[ok])
    return np.concatenate(out)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and counts; long texts are cut between words into blocks."""
    if len(text) <= BLOCK:
        return np.unique(grams(text), return_counts=True)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        parts.append(np.unique(grams(text[at:end]), return_counts=True))
        at = end
    return total(parts)


def total(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def learn(rows: DataFrame, text_column: str = "text", lang_column: str = "lang", profile: int = PROFILE) -> DataFrame:
    """Profiles: lang, gram, place (0 for the most frequent). Counts cover every row
    with a text and a label, long texts in blocks; a repeated row counts each time, ties
    go by the n-gram's number. A table without such rows gives no profiles. Other columns
    are not read, whatever they are called."""

    def count(batch: dict) -> dict:
        by_lang: dict[str, list] = {}
        for text, lang in zip(batch["text"], batch["lang"]):
            by_lang.setdefault(lang, []).append(text)
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang, texts in by_lang.items():
            sums = [counted("\n".join(texts[i : i + 200])) for i in range(0, len(texts), 200)]
            keys, n = total(sums)
            out["lang"] += [lang] * len(keys)
            out["gram"].append(keys.view(np.int64))
            out["n"].append(n)
        return {"lang": out["lang"], "gram": np.concatenate(out["gram"]), "n": np.concatenate(out["n"])}

    rows = rows.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("text is not null and lang is not null")
    counts = map_texts(rows, ["text", "lang"], "lang string, gram long, n long", count, at_once=20_000).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a bound on the rank itself lets each task drop the rest of its rows before they travel;
    # tasks are ranked in SLICES groups first, so the last ranking meets few rows of a language
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))
    sliced = counts.withColumn("slice", F.spark_partition_id() % SLICES)
    best = sliced.withColumn("rank", rank("lang", "slice")).where(F.col("rank") <= profile).drop("rank")
    top = best.withColumn("rank", rank("lang")).where(F.col("rank") <= profile)
    return top.select("lang", "gram", (F.col("rank") - 1).alias("place"))


class Profiles:
    """Profiles of all languages as sorted arrays, for comparing one document."""

    def __init__(self, rows: pd.DataFrame, profile: int):
        self.size = profile
        self.langs = sorted(rows["lang"].unique())
        self.tables = []
        for lang in self.langs:
            part = rows[rows["lang"] == lang]
            order = np.argsort(part["gram"].to_numpy())
            self.tables.append((part["gram"].to_numpy()[order], part["place"].to_numpy()[order]))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """lang_pred, score (1 - distance / largest distance), margin over the next."""
        keys, n = counted(text) if text else (np.empty(0, np.uint64), np.empty(0, np.int64))
        if not len(keys) or not self.langs:
            return "und", 0.0, 0.0
        if len(keys) > self.size:
            least = np.partition(n, -self.size)[-self.size]
            some = n >= least
            keys, n = keys[some], n[some]
        own = keys.view(np.int64)
        own = own[np.lexsort((own, -n))][: self.size]
        mine, far = np.arange(len(own)), []
        for table, places in self.tables:
            at = np.minimum(np.searchsorted(table, own), len(table) - 1)
            far.append(int(np.where(table[at] == own, np.minimum(np.abs(places[at] - mine), self.size), self.size).sum()))
        order = np.argsort(far, kind="stable")
        most = self.size * len(own)
        near = far[order[0]]
        other = far[order[1]] if len(far) > 1 else most
        return self.langs[order[0]], 1 - near / most, (other - near) / most


def predict(docs: DataFrame, profiles: DataFrame, carry: dict[str, Column] | None = None, text_column: str = "text", profile: int = PROFILE) -> DataFrame:
    """``carry`` columns plus lang_pred, score, margin for each row. Null texts and
    texts without a letter are ``und`` with score 0, as is every text without profiles.
    Rows are independent: repeated rows repeat, of equal distances the first language by
    name is taken, an empty table gives an empty result, and columns that are not carried
    are not read. Profiles come to the driver: at most ``profile`` rows a language, and at
    most MOST_LANGUAGES languages."""
    table = profiles.limit(profile * MOST_LANGUAGES + 1).toPandas()
    if len(table) > profile * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is this a column of labels?")
    known = Profiles(table, profile)
    carry = carry or {}

    def rows(batch: dict) -> dict:
        found = [known.predict(t) for t in batch["_text"]]
        return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "margin": [f[2] for f in found]}

    text = F.col(f"`{text_column}`").alias("_text")
    columns = [*[c.alias(k) for k, c in carry.items()], text]
    return map_texts(docs, columns, "lang_pred string, score double, margin double", rows, keep=tuple(carry))


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string")) % 4 == 2


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, profiles, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(held_out(), F.lit(False))})
