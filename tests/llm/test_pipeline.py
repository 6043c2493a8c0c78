"""The pipeline against a brute-force version in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from conftest import DATA
from fixtures import DOC, brute_components, clashing

from tessitura.llm import language_id

import corpus_pipeline

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows, told=None):
    """told: (predicted language, score) by text, of the texts with a letter; without it all of those are told."""
    rows = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"]) and (told is None or told[r["text"]][1] >= 0.4)]
    first = {}
    for r in rows:
        k = SPACE.sub(" ", r["text"])
        first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    rows = [r for r in rows if first[SPACE.sub(" ", r["text"])] == r["doc_id"]]
    comp = {i: c for i, _, c in brute_components([r["text"] for r in rows], [r["doc_id"] for r in rows])}
    rows = [r for r in rows if comp[r["doc_id"]] == r["doc_id"]]
    size = {r["doc_id"]: len([w for w in SPACE.split(r["text"]) if w]) for r in rows}
    per = defaultdict(int)
    for r in rows:
        per[r["source"]] += size[r["doc_id"]]
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(per.values())
    while over := {s for s in open_ if weight[s] * rest >= 2.0 * per[s] * sum(weight[x] for x in open_)}:
        target |= {s: 2.0 * per[s] for s in over}
        open_ -= over
        rest = 1.5 * sum(per.values()) - sum(target.values())
    target |= {s: weight[s] * rest / sum(weight[x] for x in open_) for s in open_}
    draw = lambda i, k: hashlib.sha256(f"{k // 5}:{i}".encode()).hexdigest()[12 * (k % 5) : 12 * (k % 5) + 12]
    copies = Counter()
    for s in order:
        mine = [r["doc_id"] for r in rows if r["source"] == s]
        rate = target[s] / per[s] if per[s] else 0.0
        low, limit = math.floor(rate), "%012x" % math.floor((rate - math.floor(rate)) * 2**48)
        take = lambda k: [low + (draw(i, k) < limit) for i in mine]  # noqa: B023, E731
        seed = min(range(10), key=lambda k: (abs(sum(n * size[i] for n, i in zip(take(k), mine)) - target[s]), k))  # noqa: B023
        copies.update(dict(zip(mine, take(seed))))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return Counter((r["doc_id"], tuple(sp.encode(r["text"]))) for r in rows for _ in range(copies[r["doc_id"]]))


def predictions(docs):
    """(language, score) by text of the stage's own model, which test_operators.py holds against a plain version."""
    model = language_id.fit(docs)
    return {r["text"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model, ["text"]).collect()}


def got(df):
    return Counter((r["doc_id"], tuple(r["ids"])) for r in df.collect())


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert got(corpus_pipeline.run(spark, f"{DATA}/sf0.001")) == brute(docs.collect(), predictions(docs))


def test_language_stage_decides(spark):
    """A text in equal parts of many languages goes, one of a single language stays; a row without a language gets the
    predicted one; wanted languages can be named."""
    rng, kinds = random.Random(2), "abcdef"
    words = {k: [k * 3 + c + k for c in "ghijklmnop"] for k in kinds}
    say = lambda k: " ".join(rng.sample(words[k], 10))
    rows = [(i, say(k), k, "s", 0) for i, k in enumerate(kinds * 30)]
    mixed = " ".join(words[k][0] for k in kinds) + " " + " ".join(words[k][1] for k in kinds)
    more = [(900, mixed, None, "s", 0), (901, say("b"), None, "s", 0), (902, "12 34", "a", "s", 0)]
    docs = spark.createDataFrame([*rows, *more], DOC)
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_identified(spark, docs, "").collect()}
    assert kept == {**{r[0]: r[2] for r in rows}, 901: "b"}
    some = {r["doc_id"] for r in language_id.keep_languages(docs, languages=["a", "b"]).collect()}
    assert some == {r[0] for r in rows if r[2] in "ab"} | {901}


def test_repeated_ids_of_different_texts(spark):
    """A row that shares its id with a near copy stays, and of near copies with one id one stays."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["red", "green", "blue", "white", "black", "grey"]) + str(rng.randrange(90)) for _ in range(n))
    t, u, v, w = say(60), say(50), say(40), say(70)
    rows = [(3, t), (7, t + " more"), (7, u), (4, v), (4, v + " tail"), (None, w), (9, w + " end"), (5, None), (5, ""), (None, u + " x")]
    docs = spark.createDataFrame([(i, x, "en", "s", k) for k, (i, x) in enumerate(rows)], DOC)
    kept = sorted(r["n_chars"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert [k for k in kept if k not in (3, 4)] == [0, 2, 6, 7, 8] and len({3, 4} & set(kept)) == 1


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "über", "niño"]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += texts[:20] + [t + " tail" for t in texts[20:40]] + [None, "", " ", "123 !!", "\n", "x" * 400_000]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    docs = df = clashing(df)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"]
    assert got(out) == brute(df.collect(), predictions(df))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
