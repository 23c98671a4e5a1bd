"""Snapshots of conversations against comparing every pair."""

import random

from phialo.llm import chat


def plain(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    said = {c: [x[1:] for x in sorted(t)] for c, t in chats.items()}
    out = {}
    for c, t in said.items():
        key = lambda c: (c is None, c)
        if any(len(u) > len(t) and u[: len(t)] == t or u == t and key(d) < key(c) for d, u in said.items() if d != c):
            continue
        out[c] = (len(t), "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in t))
    return out


def test_random_snapshots(spark):
    rng = random.Random(3)
    rows = [(None, 0, "user", None), (None, 1, None, "x"), (900, None, "user", ""), (901, 0, "us", "erx"), (902, 0, "user", "x"), (902, 0, "user", "x")]
    for conv in range(120):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], rng.choice(["a", "b"])))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, last string")
    got = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.format_chats(docs).collect()}
    assert got == plain(rows)
    assert chat.format_chats(docs.where("false")).count() == 0
