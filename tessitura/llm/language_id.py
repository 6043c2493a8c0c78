"""Language identification by word-first backoff.

A text's lower-cased words (runs of letters; longer ones in pieces of ``WORD_LETTERS``) are scored by their log frequency in each language. A word the model doesn't know is scored by
its character n-grams (edge marks included), at each position by the longest known one of four letters down to a single
letter. The posterior over languages (equal priors) gives the prediction and its score.

The model is fitted on at most ``DOCS_PER_LANG`` labelled rows of each language, drawn by a hash of the id (all rows
where there are fewer): a bound on the classifier's sample, counted over whole texts; of the ``MAX_LANGS`` most frequent
languages, without those whose rows hold no word. It keeps the ``MAX_WORDS`` and
``MAX_GRAMS`` most frequent entries, so what is broadcast has a fixed size; rarer words are scored by their n-grams.
Scoring is one pass over every whole text without a shuffle.

Defined cases: null text, empty text or one without a letter: ``und`` with score 0; without training rows every text is
``und``; a null id is never a training row; ties go to the first language by code point; repeated rows are scored one by one; extra columns are ignored, or kept where
``keep`` names them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, tidy

DOCS_PER_LANG, MAX_WORDS, MAX_GRAMS, ORDER = 1500, 60_000, 60_000, 4
MIN_WORD, MIN_GRAM, GRAM_WEIGHT = 3, 5, 2.0
CLIP, WORD_LETTERS = 4.0, 64
#: Languages of a model: the most frequent labels; and the score below which no language stands out.
MAX_LANGS, LEAST_SCORE = 1000, 0.4
MEMO = 200_000
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]{1,%d}" % WORD_LETTERS)


class Model:
    """words, grams: entry -> row of log frequencies, one column for each language."""

    def __init__(self, langs: list[str], words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]]):
        self.langs = langs
        self.words, self.word_logs = self._logs(words)
        self.grams, self.gram_logs = self._logs(grams)

    def _logs(self, table: dict[str, dict[str, int]]) -> tuple[dict[str, int], np.ndarray]:
        counts = np.array([[by.get(x, 0) for x in self.langs] for by in table.values()], dtype=np.float64).reshape(len(table), len(self.langs))
        total = counts.sum(axis=0) + 0.5 * max(1, len(table))
        logs = np.log((counts + 0.5) / total)
        # no entry outweighs others by more than CLIP, so a passage in another language counts by its length
        return {w: i for i, w in enumerate(table)}, np.maximum(logs - logs.max(axis=1, keepdims=True, initial=-np.inf), -CLIP)

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the positions of the longest known n-gram ending there."""
        w, rows = f"_{word}_", []
        for end in range(1, len(w) + 1):
            for n in range(min(ORDER, end), 0, -1):
                if (k := self.grams.get(w[end - n : end])) is not None:
                    rows.append(k)
                    break
        return GRAM_WEIGHT * self.gram_logs[rows].mean(axis=0) if rows else np.zeros(len(self.langs))

    def scorer(self):
        memo: dict[str, int] = dict(self.words)
        logs = [self.word_logs, np.zeros((1024, len(self.langs)))]
        base, used = len(self.words), 0

        def score(text: str | None) -> tuple[str, float]:
            nonlocal used, memo
            found = Counter(_WORDS.findall(text.lower())) if text else None
            if not found or not self.langs or not any(any(map(str.isalpha, w)) for w in found):
                return UNKNOWN, 0.0
            if used > MEMO:
                memo, used = dict(self.words), 0
            rows = []
            for w in found:
                k = memo.get(w)
                if k is None:
                    if used == len(logs[1]):
                        logs[1] = np.concatenate([logs[1], np.zeros_like(logs[1])])
                    logs[1][used] = self.unseen(w)
                    k = memo[w] = base + used
                    used += 1
                rows.append(k)
            k, n = np.array(rows), np.array(list(found.values()), dtype=np.float64)
            seen = k < base
            z = n[seen] @ logs[0][k[seen]] + n[~seen] @ logs[1][k[~seen] - base]
            best = int(np.argmax(z))
            return self.langs[best], float(1 / np.exp(z - z[best]).sum())

        return score


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, mod modulus, equals remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Count words and n-grams per language over the whole texts of the sample; rows without text or language don't count."""
    rows = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGS).collect()}
    if not n:
        return Model([], {}, {})
    share = F.create_map(*[F.lit(x) for k, c in n.items() for x in (k, min(1.0, docs_per_lang / c))])
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1 << 30)) < F.element_at(share, F.col(lang_col)) * (1 << 30)
    words = rows.filter(F.col(lang_col).isin(list(n)) & drawn).select(F.col(lang_col).alias("lang"), F.explode(F.expr(rf"regexp_extract_all(lower({text_col}), '[\\p{{L}}]{{1,{WORD_LETTERS}}}', 0)")).alias("w"))
    by_word = words.groupBy("w", "lang").agg(F.count("*").alias("n")).repartition("w").persist()

    def top(df: DataFrame, key: str, least: int, most: int) -> dict[str, dict[str, int]]:
        whole = df.groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        return {r[key]: r["by"] for r in whole.filter(F.col("total") >= least).orderBy(F.desc("total"), key).limit(most).select(key, "by").collect()}

    known = top(by_word, "w", MIN_WORD, MAX_WORDS)
    marked = F.concat(F.lit("_"), F.col("w"), F.lit("_"))
    starts = lambda k: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - (k - 1)))
    grams_of = lambda k: F.filter(F.transform(starts(k), lambda i: F.substring(marked, i, F.lit(k))), lambda g: F.length(g) == k)
    cut = F.flatten(F.array(*map(grams_of, range(1, ORDER + 1))))
    by_gram = by_word.select("lang", "n", F.explode(cut).alias("g")).groupBy("g", "lang").agg(F.sum("n").alias("n"))
    grams = top(by_gram, "g", MIN_GRAM, MAX_GRAMS)
    heard = sorted(r[0] for r in by_word.select("lang").distinct().collect())  # a language without a word can't be told
    by_word.unpersist()
    return Model(heard, known, grams)


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The ``keep`` columns with the predicted language and its score, under names that keep must not hold."""
    if {pred, score} & set(keep):
        raise ValueError(f"keep holds {pred} or {score}: give other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema
    sent = [F.col(c) for c in keep] + ([] if text_col in keep else [F.col(text_col)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = shared.value.scorer()
        for batch in batches:
            got = [scored(t.as_py()) for t in batch.column(text_col)]
            rest = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, pred, score])

    out = schema.add(pred, "string").add(score, "double")
    lean(docs.sparkSession)
    return docs.select(*sent).mapInArrow(tidy(run), out)


def keep_languages(docs: DataFrame, least: float = LEAST_SCORE, languages: list[str] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language can't be told (no letter, or a score below ``least``: none stands out) and,
    with ``languages``, without those of another predicted language; a row without a language gets the predicted one."""
    pred, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    told = identify(docs, fit(docs, text_col=text_col, lang_col=lang_col), docs.columns, text_col, pred, score)
    good = (F.col(pred) != UNKNOWN) & (F.col(score) >= least)
    if languages is not None:
        good &= F.col(pred).isin(languages)
    return told.filter(good).withColumn(lang_col, F.coalesce(lang_col, pred)).select(*docs.columns)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Contract form: doc_id, held_out, lang_pred, score; fitted on the rows that are not held out."""
    held = in_fold(F.col("doc_id"), 3, 1)
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held))
    return identify(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
