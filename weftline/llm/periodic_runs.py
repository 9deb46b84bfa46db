"""Periodic run detection: Main-Lorentz divide and conquer on interned word ids.

A text is its words as numbers. A part of it is halved at its midpoint; a repetition that crosses the
midpoint and has period q makes the midpoint agree with a word q places before or after it, forwards
and backwards. How far they agree are the values of two Z-functions, of the right half over the part
and of the left half over the part, both reversed; their sum tells whether the stretch is long enough.
The halves are treated alike, level by level, for all texts of a batch at once. A stretch that
reaches the edge of its part and goes on there crosses the midpoint of a part above, which finds it
whole, and is left out here. Equal intervals are one run, with their smallest period.

Z-values matter only where three words in a row agree with those at the midpoint, since f + b must
be at least max(q, 12 - q), which is 6 or more. Those few are extended by comparing words; where
many of one part reach far, the linear Z-algorithm gives them all. So a part costs its length at most,
and a text n log n words, repetitive texts included.

A document's words may first be made periodic by a rule on its id (`plant`), which a query states.

Cases: a null or empty text has no words and no run, and the digest of nothing; a document without an
id is never planted; repeated rows have a result each; texts are searched whole whatever their length;
other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_columns

LEAST = 12  #: words of a run, at least
ROUNDS = 16  #: words that are compared for all candidates at once
FEW = 32  #: candidates of a part that are extended one by one beyond that

DIGESTS = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
WHOLE = ", collapsed binary, runs array<struct<start: long, length: long, period: long>>"

_MIX = [np.int64(x) for x in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15 - (1 << 64), 0x5851F42D4C957F2D)]


def z_function(s: list[int]) -> list[int]:
    """For each place of s how many values from there on agree with those from the start."""
    z, left, right = [0] * len(s), 0, 0
    for i in range(1, len(s)):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _further(x: np.ndarray, i: int, j: int, room: int) -> int:
    """How many of the values from i and from j on agree, at most room; longer and longer pieces are compared."""
    done, piece = 0, 64
    while done < room:
        piece = min(2 * piece, room - done)
        differ = x[i + done : i + done + piece] != x[j + done : j + done + piece]
        if differ.any():
            return done + int(differ.argmax())
        done += piece
    return room


def _agreeing(x: np.ndarray, t: np.ndarray, part: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many values from t and from the part's midpoint on agree, within the part.

    t: places; part: their parts, in ascending order; lo, mid, hi: the parts' starts, midpoints and ends.
    """
    m, end = mid[part], hi[part]
    room = end - np.maximum(t, m)
    done = np.zeros(len(t), np.int64)
    some = np.flatnonzero(room > 0)
    for k in range(ROUNDS):
        some = some[(x[t[some] + k] == x[m[some] + k])]
        done[some] = k + 1
        some = some[room[some] > k + 1]
        if not len(some):
            return done
    of = part[some]
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
    for a, b in zip(edges, edges[1:], strict=False):
        own, p = some[a:b], of[a]
        if b - a <= FEW:
            for c in own:
                done[c] = ROUNDS + _further(x, t[c] + ROUNDS, m[c] + ROUNDS, room[c] - ROUNDS)
        else:
            right = x[mid[p] : hi[p]].tolist()
            z = z_function([*right, np.iinfo(np.int64).min, *x[lo[p] : hi[p]].tolist()])
            done[own] = np.minimum([z[len(right) + 1 + c - lo[p]] for c in t[own]], room[own])
    return done


def find_runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The runs of some texts: rows (start, end, period) of places in x, by start and end.

    x: word numbers of all texts, with three values in front, one after each text and three at the end
    that occur once each.
    """
    code = np.zeros(len(x), np.int64)
    for k, c in enumerate(_MIX):
        code[: len(x) - 2] += x[k : len(x) - 2 + k] * c
    back = x[::-1].copy()
    lo, hi = starts[ends - starts >= least], ends[ends - starts >= least]
    found = [np.zeros((0, 3), np.int64)]
    while len(lo):
        mid, size = (lo + hi) // 2, hi - lo
        part = np.repeat(np.arange(len(lo)), size)
        t = np.arange(len(part)) + np.repeat(lo - (np.cumsum(size) - size), size)
        near = (code[t] == code[mid][part]) | (code[t - 3] == code[mid - 3][part])
        near[mid - lo + np.cumsum(size) - size] = False
        at = np.flatnonzero(near)
        if len(at):
            t, part = t[at], part[at]
            f = _agreeing(x, t, part, lo, mid, hi)
            n = len(x)
            # the places before t and the midpoint, in the reversed text; a part's places there descend, which does not matter
            b = _agreeing(back, n - t, part, n - hi, n - mid, n - lo)
            i, j = np.minimum(t, mid[part]), np.maximum(t, mid[part])
            q, s, e = j - i, i - b, j + f
            long = (e - s >= least) & (e - s >= 2 * q)
            q, s, e, part = q[long], s[long], e[long], part[long]
            goes_on = ((s == lo[part]) & (x[s - 1] == x[s - 1 + q])) | ((e == hi[part]) & (x[e] == x[e - q]))
            found.append(np.column_stack([s, e, q])[~goes_on])
        lo, hi = np.column_stack([lo, mid]).ravel(), np.column_stack([mid, hi]).ravel()
        lo, hi = lo[hi - lo >= least], hi[hi - lo >= least]
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def plant(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word for each place of a document whose id is dealt a repetition; None for the others."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places >= a, a + (places - a) % p, places)


def _columns(ids: list[int | None], texts: list[bytes | None], planted: Callable | None) -> dict[str, list]:
    """The columns of DIGESTS and WHOLE for some documents."""
    number: dict[bytes, int] = {}
    words, numbers, starts, at = [], [np.array([-1, -2, -3])], [], 3
    for k, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
        own = (text or b"").split()
        order = planted(doc_id, len(own)) if planted else None
        if order is not None:
            own = [own[i] for i in order.tolist()]
        words.append(own)
        numbers += [np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)), np.array([-4 - k])]
        starts.append(at)
        at += len(own) + 1
    x = np.concatenate([*numbers, np.array([-4 - len(ids) - k for k in range(3)])])
    starts = np.array(starts, np.int64)
    runs = find_runs(x, starts, starts + [len(w) for w in words])
    edges = np.searchsorted(runs[:, 0], [*starts, at])
    out: dict[str, list] = {f.split()[0]: [] for f in DIGESTS.split(", ")} | {"collapsed": [], "runs": []}
    for k, own in enumerate(words):
        mine = runs[edges[k] : edges[k + 1]] - [starts[k], starts[k], 0]
        start, length, period = mine[:, 0], mine[:, 1] - mine[:, 0], mine[:, 2]
        mine = np.column_stack([start, length, period])[np.lexsort((period, start))]
        best = min(mine.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
        dropped = np.zeros(len(own) + 1, np.int64)
        np.add.at(dropped, mine[:, 0] + mine[:, 2], 1)
        np.add.at(dropped, mine[:, 0] + mine[:, 1], -1)
        kept = own if best is None else [own[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()]
        out["doc_id"].append(ids[k])
        out["n_words"].append(len(own))
        out["n_runs"].append(len(mine))
        for c, v in zip(("start", "length", "period"), best or (None, None, None), strict=True):
            out[c].append(v)
        out["exponent_milli"].append(None if best is None else 1000 * best[1] // best[2])
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in mine.tolist())
        out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
        out["collapsed"].append(b" ".join(kept))
        out["collapsed_sha256"].append(hashlib.sha256(out["collapsed"][-1]).hexdigest())
        out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in mine.tolist()])
    return out


def detect_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    planted: Callable[[int | None, int], np.ndarray | None] | None = None,
    whole: bool = True,
) -> DataFrame:
    """One row a document: the number of its runs, the longest one and digests.

    whole: also the runs themselves and the text without the repetitions (`collapsed`, UTF-8). A word
    goes if any run contains it after that run's first period. planted: from an id and a number of words
    to the order in which the words are taken, or None.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_columns(named, lambda c: _columns(c["doc_id"], c["text"], planted), DIGESTS + WHOLE * whole, 200)
