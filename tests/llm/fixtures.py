"""Small tables for the tests of this folder, and sets by brute force."""

from __future__ import annotations

import re
from collections import defaultdict

from conftest import DATA
from pyspark.sql import functions as F

FOLDER = f"{DATA}/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "cls string, size string, comp string, id string, score string, lang_pred string, digest string, _row string, target string, _s string, _copies string, _own string"


def docs(spark, texts, ids=None, lang="en", source="s"):
    rows = [(i if ids is None else ids[i], t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def clashing(df):
    """More columns, some named like those the operators use."""
    return df.select("*", *[F.lit("x").alias(c.split()[0]) for c in CLASH.split(", ") if c.split()[0] not in df.columns])


def word_list(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(t, k=5):
    w = word_list(t)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(texts, ids):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(len(texts)):
        low[find(i)].append(ids[i])
    return [(ids[i], len(sets[i]), min(low[find(i)])) for i in range(len(texts))]
