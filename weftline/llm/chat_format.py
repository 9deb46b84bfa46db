"""Chat formatting with budgeted windows.

A turn is written as `<|im_start|>role NEWLINE text<|im_end|>NEWLINE`. Control strings inside
roles and texts are escaped: a backslash becomes two, and `<|` becomes `<\\|`; a newline in a
role becomes `\\n`. So the template's marks occur nowhere else, and reading back is exact.

A conversation is split into windows of whole turns. A turn has the tokens of all that is written
for it: the two marks, which are ids of their own, and role and text with their escapes. Ids never
reach across a mark, so a window has the sum of its turns' tokens. Prefix sums of turn tokens deal a conversation's turns to
blocks of some windows each, and within a block the windows take turns until the budget is spent.
The system turn (a first turn of role system) opens every window, and each window repeats the
last turns before it, up to a number of turns and a share of the budget. The loss mask covers the
texts of assistant turns that are new in a window, so no target counts twice. A turn that exceeds
the budget, alone or with the system turn, has a window of its own, which the system turn opens too;
turns are never cut, and such a window is marked over_budget.

The prefix sums of one conversation are computed over ranges of its turns, each range in its own
task, with the sums of the ranges before added; so a conversation may hold any share of the table.

Cases: null texts and roles are empty; null conversation ids are one conversation; turns without
or with the same number are ordered by number (nulls first), role and text; repeated rows are
turns of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.llm.common import cut, vocabulary

START, END = "<|im_start|>", "<|im_end|>"
WINDOWS_A_BLOCK = 32  #: windows that one block of a conversation is about long

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text) if "\\" in text else text


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def written(role: str, text: str) -> tuple[str, str, str]:
    """What stands for a turn: before its text, the text, after it."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


def render(turns: list[tuple[str, str, bool]]) -> tuple[str, list[int], list[int]]:
    """The text of (role, text, new) turns and its loss mask as starts and ends in code points."""
    parts, starts, ends, at = [], [], [], 0
    for role, text, new in turns:
        head, body, tail = written(role, text)
        if new and role == "assistant":
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


@functools.cache
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    marks = {START: len(ranks), END: len(ranks) + 1}
    return tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)


COUNTED = "conv_id long, part int, role string, text string, n_tokens long, local_seq long, local_before long"


def counted(turns: DataFrame, ranks_path: str) -> DataFrame:
    """The turns in ranges of (conversation, turn), with their tokens and their place within the range.

    part: the range; local_seq, local_before: turns and tokens of the conversation before this one in its range.
    """
    filled = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    arrow = to_arrow_schema(StructType.fromDDL(COUNTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = functools.partial(_encoding(ranks_path).encode, allowed_special={START, END})
        part, conv, seq, before = TaskContext.get().partitionId(), object(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000).to_pydict()
                tokens = [len(encode("".join(written(r, t)))) for r, t in zip(rows["role"], rows["text"], strict=True)]
                seqs, befores = [], []
                for c, n in zip(rows["conv_id"], tokens, strict=True):
                    if c != conv:
                        conv, seq, before = c, 0, 0
                    seqs.append(seq)
                    befores.append(before)
                    seq, before = seq + 1, before + n
                columns = {c: rows[c] for c in ("conv_id", "role", "text")}
                columns |= {"part": [part] * len(tokens), "n_tokens": tokens, "local_seq": seqs, "local_before": befores}
                yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    # the ranges are found before the tokens are counted, as that reads the rows twice
    return filled.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, COUNTED)


def with_prefix_sums(ranged: DataFrame) -> DataFrame:
    """Rows of `counted`, with seq (place in the conversation) and before (tokens of the turns before)."""
    parts = ranged.groupBy("conv_id", "part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    below = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        F.col("conv_id").alias("conv"),
        F.col("part").alias("p"),
        F.sum("tokens").over(below).alias("tokens_base"),
        F.sum("n").over(below).alias("seq_base"),
    ).where("seq_base > 0")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("p"))
    # one row for each range at most: only its first conversation began in another
    return ranged.join(F.broadcast(bases), same, "left").select(
        "conv_id", "role", "text", "n_tokens",
        (F.col("local_seq") + F.coalesce("seq_base", F.lit(0))).alias("seq"),
        (F.col("local_before") + F.coalesce("tokens_base", F.lit(0))).alias("before"),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from batch.slice(at, 1000).to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows in record batches of at most `most`."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with the same keys, one row in memory at a time."""
    return itertools.groupby(_rows(batches), key=lambda r: tuple(r[k] for k in keys))


WINDOW_SCHEMA = (
    "conv_id long, block long, window long, n_tokens long, n_turns long, n_repeated long, over_budget boolean, "
    "formatted string, loss_starts array<long>, loss_ends array<long>"
)
_WINDOW_ARROW = pa.schema(
    [
        *[(c, pa.int64()) for c in ("conv_id", "block", "window", "n_tokens", "n_turns", "n_repeated")],
        ("over_budget", pa.bool_()),
        ("formatted", pa.string()),
        ("loss_starts", pa.list_(pa.int64())),
        ("loss_ends", pa.list_(pa.int64())),
    ]
)


def windows_of(rows: Iterator[dict], budget: int, history: int, history_tokens: int) -> Iterator[dict]:
    """The windows of one block. Rows: kind 0 the system turn, 1 turns before the block, 2 its own turns."""
    system: dict | None = None
    past: list[dict] = []
    own: list[dict] = []
    repeated: list[dict] = []
    window, spent = 0, 0

    def open_window() -> None:
        nonlocal repeated, spent
        tail: list[dict] = []
        for r in reversed(past):
            if len(tail) == history or sum(x["n_tokens"] for x in tail) + r["n_tokens"] > history_tokens:
                break
            tail.insert(0, r)
        repeated = ([system] if system else []) + tail
        spent = sum(r["n_tokens"] for r in repeated)

    def close_window() -> dict:
        turns = [(r["role"], r["text"], False) for r in repeated] + [(r["role"], r["text"], True) for r in own]
        text, starts, ends = render(turns)
        return {
            "window": window, "n_tokens": spent, "n_turns": len(turns), "n_repeated": len(repeated),
            "over_budget": spent > budget, "formatted": text, "loss_starts": starts, "loss_ends": ends,
        }

    for r in rows:
        if r["kind"] == 0:
            system = r
            continue
        if r["kind"] == 1:
            if system is None or r["seq"] != system["seq"]:
                past.append(r)
            continue
        if not own and not repeated:
            open_window()
        if own and spent + r["n_tokens"] > budget:
            yield close_window()
            past = [*past, *[x for x in own if x is not system]][-history:] if history else []
            window, own = window + 1, []
            open_window()
        if not own and spent + r["n_tokens"] > budget:  # history gives way to the turn
            repeated = [x for x in repeated if x is system]
            spent = sum(x["n_tokens"] for x in repeated)
        if system is None and r["seq"] == 0 and r["role"] == "system":
            system = r
        own.append(r)
        spent += r["n_tokens"]
    if own:
        yield close_window()


def format_windows(
    turns: DataFrame, ranks_path: str, budget: int = 4096, history: int = 2, history_share: float = 0.25
) -> DataFrame:
    """Windows of all conversations: one row a window, ordered in a conversation by block and window.

    turns: conv_id, turn, role, text. ranks_path: a byte-level vocabulary as token ranks, the place of its
    file on every executor or the bare name of a public one.
    """
    summed = with_prefix_sums(cut(counted(turns, ranks_path)))
    block_tokens = budget * WINDOWS_A_BLOCK
    own = summed.withColumn("block", F.expr(f"before div {block_tokens}")).withColumn("kind", F.lit(2))
    blocks = own.groupBy("conv_id", "block").agg(F.max("seq").alias("last"))
    following = Window.partitionBy("conv_id").orderBy("block")
    nexts = blocks.withColumn("next", F.lead("block").over(following)).where("next is not null")
    nexts = nexts.select(F.col("conv_id").alias("conv"), F.col("block").alias("b"), "last", "next")
    # the turns that the next block may repeat, and the system turn for every block but the first
    halo = (
        own.join(nexts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("b")))
        .where(F.col("seq") > F.col("last") - history)
        .withColumn("block", F.col("next"))
        .withColumn("kind", F.lit(1))
    )
    later = blocks.where("block > 0").select(F.col("conv_id").alias("conv"), F.col("block").alias("b"))
    system = (
        own.where((F.col("seq") == 0) & (F.col("role") == "system"))
        .join(later, F.col("conv_id").eqNullSafe(F.col("conv")))
        .withColumn("block", F.col("b"))
        .withColumn("kind", F.lit(0))
    )
    columns = ["conv_id", "block", "kind", "seq", "role", "text", "n_tokens"]
    everything = own.select(columns).unionByName(halo.select(columns)).unionByName(system.select(columns))
    share = int(budget * history_share)

    def found(batches):
        for (conv_id, block), rows in _groups(batches, ("conv_id", "block")):
            for w in windows_of(rows, budget, history, share):
                yield {"conv_id": conv_id, "block": block, **w}

    def run(batches):
        yield from _batched(found(batches), _WINDOW_ARROW)

    sorted_rows = everything.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "seq")
    return sorted_rows.mapInArrow(run, WINDOW_SCHEMA)


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_windows long, over_budget long"
)


def read_back(windows: DataFrame) -> DataFrame:
    """One row a conversation with what its windows hold, parsed from their texts.

    A digest of a whole conversation is one sequential hash, so each conversation is streamed in
    order through one task, which keeps one window in memory.
    """
    arrow = pa.schema(
        [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGEST_SCHEMA.split(", ")]
    )

    def digests(batches):
        for (conv_id,), rows in _groups(batches, ("conv_id",)):
            turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = n_windows = over = 0
            for w in rows:
                text = w["formatted"]
                for role, said in parse(text)[w["n_repeated"] :]:
                    turns_hash.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n_turns += 1
                for a, b in zip(w["loss_starts"], w["loss_ends"], strict=True):
                    said = unescape(text[a:b])
                    loss_hash.update(said.encode("utf-8", "surrogatepass"))
                    loss_chars += len(said)
                chars += len(text)
                n_windows += 1
                over += w["over_budget"]
            values = (conv_id, n_turns, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars, n_windows, over)
            yield dict(zip(arrow.names, values, strict=True))

    def run(batches):
        yield from _batched(digests(batches), arrow)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return ordered.mapInArrow(run, DIGEST_SCHEMA)
