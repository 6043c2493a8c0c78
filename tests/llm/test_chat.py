from __future__ import annotations

import random

import pytest
from fixtures import clashing

from tessitura.llm import chat_format
from tessitura.llm.chat_format import link_quotes, run_order


def test_links(spark):
    rows = [(1, 0, "user", "Hello  there\nsecond"), (1, 1, "assistant", "fine"), (1, 2, "user", "> hello there\n>> deep\nmy reply"), (2, 0, "user", None), (None, 5, "user", "> x"), (1, 3, "user", "> nowhere\nok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["max_level"], r["n_quoted"], r["content"]) for r in link_quotes(df).collect()}
    assert got[1, 2] == (0, 2, 2, "my reply") and got[1, 1] == (0, 0, 0, "fine") and got[1, 3] == (2, 1, 1, "ok")
    assert got[2, 0] == (None, 0, 0, "") and got[None, 5] == (None, 1, 1, "")
    assert link_quotes(df.limit(0)).count() == 0


def passages(text):
    out, open_ = [], False
    for line in text.split("\n"):
        bare = line.replace(" ", "")
        level = len(bare) - len(bare.lstrip(">"))
        words = line.lstrip("> ").lower().split()
        if words and open_ and out[-1][0] == level:
            out[-1][1].extend(words)
        elif words:
            out.append((level, list(words)))
        open_ = bool(words)
    return out


def brute(rows):
    """(conv, turn) to (reply_to, position), by comparing every passage with every earlier message."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = {t: passages(x) for c, t, _, x in rows if c == conv}
        reply = {}
        for t in sorted(said):
            votes = {}
            for level, w in said[t]:
                holds = [e for e in said if e < t and any(n == level - 1 and any(v[i : i + len(w)] == w for i in range(len(v))) for n, v in said[e])]
                if level and holds:
                    votes.setdefault(level, []).append(max(holds))
            low = votes[min(votes)] if votes else []
            reply[t] = max(low, key=lambda e: (low.count(e), e)) if low else max((e for e in said if e < t), default=None)
        order = []

        def walk(t):
            order.append(t)  # noqa: B023
            for k in sorted(k for k in reply if reply[k] == t):  # noqa: B023
                walk(k)  # noqa: B023

        walk(min(said))
        out |= {(conv, t): (reply[t], order.index(t)) for t in said}
    return out


def test_levels_and_rewrapped_passages(spark):
    rows = [(1, 0, "u", "a1 is\na2 was"), (1, 1, "a", "> a1 is\n> a2 was\nb"), (1, 2, "u", ">> a1 is\n>> a2 was\n> b\nc"), (1, 3, "a", "> A1 is a2\n> was\nd"), (1, 4, "u", ">> a1 is a2\nonly deep"),
            (None, 1, "u", "x"), (None, 2, "u", "y")]
    got = [tuple(r) for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "turn", "reply_to", "position", "depth").collect()]
    assert got[2:] == [(1, 0, None, 0, 0), (1, 1, 0, 1, 1), (1, 2, 1, 2, 2), (1, 3, 0, 3, 1), (1, 4, 3, 4, 2)]
    assert got[:2] == [(None, 1, None, None, None), (None, 2, None, None, None)]


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(25):
        texts = []
        for turn in range(rng.randint(1, 14)):
            lines = []
            for _ in range(rng.randint(0, 2) if texts else 0):
                kept = [x for x in rng.choice(texts).split("\n")]
                for level, w in passages("\n".join(kept)):
                    if level < 3 and rng.random() < 0.7:
                        cut = rng.randint(1, len(w))
                        lines += [">" * (level + 1) + " " + " ".join(w[:cut]).upper(), "> " * (level + 1) + " ".join(w[cut:])]
            lines += [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 3))]
            texts.append("\n".join(lines))
        rows += [(conv, 2 * t, "u", x) for t, x in enumerate(texts)]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert {(r["conv_id"], r["turn"]): (r["reply_to"], r["position"]) for r in got} == brute(rows)
    assert [(r["conv_id"], r["position"]) for r in got] == sorted((r["conv_id"], r["position"]) for r in got)


def place(rows):
    """(m, conv, turn, quoted) to m: (reply_to, position, depth), by building the forest and walking it."""
    out = {}
    for conv in {r[1] for r in rows}:
        mine = sorted((t, m, q) for m, c, t, q in rows if c == conv)
        turns = sorted({t for t, _, _ in mine})
        stands = {t: min(m for u, m, _ in mine if u == t) for t in turns}
        reply = {m: q if q is not None else max((u for u in turns if u < t), default=None) for t, m, q in mine}
        at = 0

        def walk(m, depth):
            nonlocal at
            out[m] = (reply[m], at, depth)  # noqa: B023
            at += 1
            for _, k, _ in mine:  # noqa: B023
                if reply[k] is not None and stands[reply[k]] == m:  # noqa: B023
                    walk(k, depth + 1)  # noqa: B023

        for _, m, _ in mine:
            if reply[m] is None:
                walk(m, 0)
    return out


@pytest.mark.parametrize(("seed", "bucket"), [(1, 10_000), (2, 3), (3, 7)])
def test_places_of_repeated_and_quoted_turns(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(chat_format, "BUCKET", bucket)
    rng, rows = random.Random(seed), []
    for conv in range(12):
        turns = sorted(rng.randrange(40) for _ in range(rng.randrange(1, 25)))
        for t in turns:
            earlier = [u for u in turns if u < t]
            rows.append((len(rows), conv, t, rng.choice(earlier) if earlier and rng.random() < 0.3 else None))
    df = spark.createDataFrame(rows, "_m long, conv_id long, turn long, quoted long").repartition(4)
    assert {r["_m"]: tuple(r)[1:] for r in chat_format._placed(df).collect()} == place(rows)


def test_runs_of_a_long_conversation():
    assert run_order([(10, 500_010, None)]) == [(10, 500_010, 0, 0)]
    # 0 1 2 | 3 and 4 answer 1 | 5 answers 2: after the run come answers to its last message, then to the one before
    assert run_order([(0, 3, None), (3, 4, 1), (4, 5, 1), (5, 6, 2)]) == [(0, 3, 0, 0), (5, 6, 3, 3), (3, 4, 4, 2), (4, 5, 5, 2)]


def test_odd_messages(spark):
    """Repeated rows, equal texts, empty and very long ones, null turns, more columns with clashing names."""
    long = "word " * 60_000
    rows = [(1, 0, "u", "same words"), (1, 0, "u", "same words"), (1, 1, "a", "same words"), (1, 2, "u", "> same words\nyes"), (1, 3, "a", ""), (1, None, "u", "> same words"), (2, 0, "u", long), (2, 1, "a", "x"), (2, 2, "u", "> " + long)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    df = df.withColumns({c: df["id"] for c in ("level", "words", "source", "h", "_m", "passages", "bucket", "first", "position")})
    got = [(r["conv_id"], r["turn"], r["reply_to"], r["position"], r["depth"]) for r in link_quotes(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, None, 0, 0), (1, 1, 0, 1, 1), (1, 2, 1, 2, 2), (1, 3, 2, 3, 3), (1, 0, None, 4, 0), (1, None, None, None, None), (2, 0, None, 0, 0), (2, 1, 0, 1, 1), (2, 2, 0, 2, 1)], key=str)
