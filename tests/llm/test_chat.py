"""Folding logs against a slow fold, and the formatted conversations against their turns."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from lintloom.llm import chat

DATA = "/root/testdata/sf0.001"


def slow_fold(log):
    """conversation -> [(role, text)] by one pass over each conversation's events in order."""
    out = {}
    for conv in {e[0] for e in log}:
        messages = {}
        for _, seq, message, role, kind, text in sorted((e for e in log if e[0] == conv), key=lambda e: e[1]):
            m = messages.setdefault(message, [role, None])
            if kind == "delta":
                m[1] = (m[1] or "") + text
            else:
                m[1] = {"regenerate": "", "delete": None}.get(kind, text)
        out[conv] = [(r, t) for _, (r, t) in sorted(messages.items()) if t is not None]
    return out


def folded(rows):
    out = {}
    for r in rows:
        out.setdefault(r.conv_id, []).append((r.message, r.role, r.text))
    return {c: [(role, text) for _, role, text in sorted(m)] for c, m in out.items()}


def test_fold_is_the_slow_fold(spark):
    rng, log = random.Random(1), []
    for conv in range(20):
        for seq in range(rng.randint(1, 60)):
            message = rng.randint(0, 5)
            kind = rng.choice(["delta", "delta", "delta", "message", "edit", "regenerate", "delete"])
            log.append((conv, seq * 3, message, "user" if message % 2 else "assistant", kind, rng.choice(["", "a", "bc", "é"])))
    rng.shuffle(log)
    df = spark.createDataFrame(log, chat.EVENT).withColumn("part", F.lit(1))
    want = {c: m for c, m in slow_fold(log).items() if m}
    assert folded(chat.fold(df).collect()) == want
    blocks = chat.format_chats(df).collect()
    for conv, messages in want.items():
        whole = "".join(b.formatted for b in sorted((b for b in blocks if b.conv_id == conv), key=lambda b: (b.part, b.number)))
        assert [(r, chat.unescape(whole[a:b])) for r, a, b in chat.parse(whole)] == messages


def test_log_of_turns_has_all_kinds_and_folds_back(spark):
    rng, rows = random.Random(2), []
    for conv in range(30):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn, "assistant" if turn % 2 else "user", "".join(rng.choices("ab [</s>INST]", k=rng.randint(0, 30)))))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.events_of(turns).collect()
    assert {e.kind for e in log} == {"delta", "edit", "regenerate", "delete", "message"}
    assert len({(e.conv_id, e.seq) for e in log}) == len(log)
    # events of several messages stand between those of one
    assert any(a.message < b.message and a.seq > b.seq and a.conv_id == b.conv_id for a in log for b in log)
    want = {}
    for c, t, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text))
    assert slow_fold([tuple(e) for e in log]) == want == folded(chat.fold(chat.events_of(turns)).collect())


def sql(con, rows):
    con.execute("CREATE OR REPLACE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.sql(chat.ORACLE).fetchall())


def test_ties_nulls_and_odd_texts_as_in_sql(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", ""), (1, None, None, "x"), (1, None, "a", None), (2, 5, "assistant", "z"), (2, 5, "assistant", "y"), (2, 5, "assistant", "é"),
            (2, 5, "assistant", "x" * 100 + "b"), (2, 5, "assistant", "x" * 100 + "a"), (2, 5, "assistant", "x" * 100 + "a"), (3, 1, "system", "</s>[INST]"), (3, 0, "assistant", "y" * 600_000), (4, -1, "user", "[INST] [/INST] </s>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash")).withColumn("seq", F.lit(0)).withColumn("kind", F.lit("x"))
    turns.drop("message", "seq", "kind").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op5_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    want = sql(con, rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    direct = chat.digests(chat.format_chats(chat.events_of(turns))).select(*names)
    assert sorted(tuple(r) for r in direct.collect()) == [r for r in want if r[0] != -7]
    assert chat.digests(chat.format_chats(chat.events_of(turns.limit(0)))).count() == 0


def test_null_conversations_are_one(spark):
    rows = [(None, 0, "assistant", "y" * 600_000), (None, 1, "user", "q"), (1, 0, "user", "a")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert got[None].loss_chars == 600_000 and got[None].n_turns == 2 and got[1].turns_sha256 == hashlib.sha256(b"user\na\n").hexdigest()
