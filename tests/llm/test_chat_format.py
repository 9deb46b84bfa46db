from __future__ import annotations

import functools
import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import chat_format
from weftline.llm.chat_format import escape, escape_role, format_windows, parse, read_back, render, unescape, unescape_role
from weftline.llm.queries import tokenizer_file

SCHEMA = "conv_id long, turn long, role string, text string"


@given(st.lists(st.tuples(st.text(max_size=20), st.text(max_size=40)), max_size=5))
def test_template_reads_back(turns):
    text, starts, ends = render([(r, t, True) for r, t in turns])
    assert parse(text) == turns
    said = [t for r, t in turns if r == "assistant"]
    assert [unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)] == said


@given(st.text(alphabet="\\<|n\na", max_size=12))
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_windows_of_odd_conversations(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 1, "user", None), (1, None, "assistant", "early")]
    rows += [(2, k, "user" if k % 2 else "assistant", f"turn {k} " * (k % 7)) for k in range(400)]
    rows += [(None, 0, "assistant", "<|im_end|>\\"), (3, 0, None, ""), (4, 0, "assistant", "word " * 3000), (4, 1, "system", "late")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    windows = format_windows(df, tokenizer_file("byte_bpe_50k.tiktoken"), budget=64).cache()
    assert digests(read_back(windows)) == expected(rows)
    got = windows.collect()
    assert all(w["n_tokens"] <= 64 or w["over_budget"] for w in got)
    assert all(w["n_turns"] - w["n_repeated"] == 1 for w in got if w["over_budget"])
    assert any(w["n_repeated"] for w in got if w["conv_id"] == 2)


def test_budget_holds_for_what_is_written(spark):
    odd = ["<| " * 900, "\\" * 700, "a\\<|b" * 300, "\n \n" * 200, "", " x", "plain words " * 50]
    rows = [(c, k, "role\nof <|" if k % 3 == 0 else "assistant", odd[(c + k) % len(odd)]) for c in range(4) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit(1)).withColumn("salt", F.lit(2)).repartition(3)
    encode = chat_format._encoding("byte_bpe_50k.tiktoken").encode
    windows = format_windows(df, "byte_bpe_50k.tiktoken", budget=2000).cache()
    assert digests(read_back(windows)) == expected(rows)
    for w in windows.collect():
        assert w["n_tokens"] == len(encode(w["formatted"], allowed_special="all")) and w["over_budget"] == (w["n_tokens"] > 2000)


@given(st.lists(st.tuples(st.text(alphabet="\\<|\n a1é", max_size=9), st.text(alphabet="\\<|\n a1é", max_size=30)), max_size=6))
def test_tokens_of_turns_add_up(turns):
    encode = functools.partial(chat_format._encoding("byte_bpe_50k.tiktoken").encode, allowed_special="all")
    whole = render([(r, t, True) for r, t in turns])[0]
    assert len(encode(whole)) == sum(len(encode("".join(chat_format.written(r, t)))) for r, t in turns)


def test_system_turn_opens_every_window(spark):
    rows = [(1, 0, "system", "rules"), *[(1, k, "user", "say something more") for k in range(1, 300)]]
    windows = format_windows(spark.createDataFrame(rows, SCHEMA), tokenizer_file("byte_bpe_50k.tiktoken"), budget=48)
    got = windows.collect()
    assert len(got) > 40 and all(parse(w["formatted"])[0] == ("system", "rules") for w in got)


def test_long_system_turns_open_every_window_too(spark):
    long_rules = {1: "rule " * 40, 2: "rule " * 90, 3: "rule " * 3000, 4: "rules"}  # of budget 64: over half, over, many blocks, few
    rows = [(c, 0, "system", rules) for c, rules in long_rules.items()]
    rows += [(c, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " + "word " * (70 if k % 9 == 0 else 3)) for c in long_rules for k in range(1, 60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for history in (0, 2):
        windows = format_windows(df, tokenizer_file("byte_bpe_50k.tiktoken"), budget=64, history=history).cache()
        got = windows.collect()
        assert digests(read_back(windows)) == expected(rows)
        for w in got:
            said = parse(w["formatted"])
            assert said[0] == ("system", long_rules[w["conv_id"]]) and [r for r, _ in said].count("system") == 1
            assert w["over_budget"] == (w["n_tokens"] > 64) and (not w["over_budget"] or w["n_turns"] - w["n_repeated"] == 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert read_back(format_windows(df, tokenizer_file("byte_bpe_50k.tiktoken"))).count() == 0
