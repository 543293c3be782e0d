"""Secret scan: how many guesses would a value in a credential context need?

A context is an identifier with a credential word as one of its parts, followed by ``:`` or ``=`` and a
value (``password=...``, ``"accessToken": ...``, ``secret_key_id = ...``, ``API key: ...``), a bearer
header, or an access key id.  Parts end at a change from small to capital letters, a digit, dash, dot or
underscore, or a blank between words that belong together.  The value is cut into words, dates, repeats, keyboard walks and
brute-force spans so that the sum of the logarithms of their guesses is least; a dynamic programme
over the ends of segments finds it.  Words and dates have a bounded length.  A walk or a repeat may be of any
length, and each of its parts is a segment as well: their cheapest starts are kept as lower envelopes, so
that a value takes time about linear in its length.  Repeats have a unit of up to ``PERIOD`` characters.
Values above ``MIN_GUESSES`` are secrets, the others (``changeme``,
``2024-01-01``) are reported as weak and left alone.

Defined results: null and empty text have no findings; an empty value is none; values and texts are
taken whole, however long; repeated rows each give their findings; null doc_id is carried as it is;
an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_GUESSES = 8.0
MASK = "[SECRET]"
#: Every context holds one of these; texts without them needn't leave the JVM.
HINT = r"[:=]|[Aa][Kk][Ii][Aa]|[Bb][Ee][Aa][Rr][Ee][Rr]"
#: Where a part of an identifier begins and ends; compiled with case, since it tells the parts.
BEGIN = r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z])|(?<=[0-9])|(?<=[A-Z])(?=[A-Z][a-z]))"
END = r"(?:(?![A-Za-z0-9])|(?<=[a-z])(?=[A-Z])|(?=[0-9]))"
CONTEXT = re.compile(
    rf"(?P<word>(?i:password|passwd|passphrase|api[ _.-]?key)|{BEGIN}(?i:pass[ _.-](?:word|phrase)|pwd|credentials?|(?:access|private|auth|secret)[ _.-]?key|(?:access|auth|bearer|client|refresh|session|user)?(?:secret|token))){END}"
    r"(?:[A-Za-z0-9_.-]*|[ \t]+(?i:key|value|string|text|id))[\"']?[ \t]*(?:=>|:=|[:=])[ \t]*"
    r"(?:\"(?P<v1>[^\"\n]+)\"|'(?P<v2>[^'\n]+)'|(?P<v3>[^\s\"',;]+))"
    r"|(?<![A-Za-z0-9])(?P<bearer>(?i:bearer))[ \t]+(?P<v4>[A-Za-z0-9._~+/=-]{8,})"
    r"|(?<![A-Za-z0-9])(?P<v5>(?i:AKIA[0-9A-Z]{16}))(?![A-Za-z0-9])"
)
#: By rank, as guessers would try them.
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login changeme secret test guest root user pass hello abc iloveyou sunshine princess football "
    "shadow michael superman batman trustno baseball default example sample dummy placeholder token key none null true false your my the and for you are with this that from have "
    "not but what all were when we there can an which their said if do will each about how up out them then she many some so these would other into has more her two like him see "
    "time could no make than first been its who now people over did down only way find use may water long little very after word called just where most know love summer winter "
    "spring autumn january february march april june july august september october november december monday friday sunday server database system service private public access "
    "account config local prod production staging develop demo temp backup home office company internet computer google amazon "
    "string number boolean integer value values field fields required optional empty unknown undefined missing hidden enter change forgot reset expired expires expire invalid valid "
    "session client header request response string type name username email address phone file path folder environment variable variables settings setting option options parameter parameters "
    "argument input output result error message text title content description format method function class object array list item items index length size count total start stop "
    "begin open close read write update delete create insert select remove add set get put post send receive return call run build deploy release version upgrade install download upload "
    "connect connection network cloud storage bucket cluster node host port domain proxy cache queue stream event action trigger handler module package library plugin "
    "encrypted encryption hash hashed signature signed certificate authorization authentication authenticate authorize permission role group member owner manager customer order product price "
    "please must should never always before again another different same right left first second third next previous current present future today tomorrow yesterday morning evening night "
    "week month year hour minute good great best better simple easy hard strong weak short small large high full half part whole really every everyone something nothing anything people "
    "work working world life school family friend friends money book story question answer reason idea example examples information data table line page site link click button view show "
    "hide display screen mobile device window login logout signin signup register confirm confirmation verify verification generate generated random secure security safe policy rules rule "
    "minimum maximum least most characters character letter letters digits symbol symbols special lowercase uppercase match matches provided provide using used user users team admin administrator"
).split()
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for w in WORDS if len(w) > 2))}
LONGEST = max(map(len, RANK))
BEGINNINGS = {w[:3] for w in RANK}
LEET = str.maketrans("@4310!5$7", "aaeioisst")
ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
SHIFT = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
DATE = [
    (re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), 365),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"), 365),
    (re.compile(r"(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\1(?:19|20)\d\d"), 365),
    (re.compile(r"((?:19|20)\d\d)"), 1),
]
#: Whole periods of a repeat are tried as its unit.
PERIOD = 16
LOG2, LOG47, TURN = math.log10(2), math.log10(47), math.log10(4.6)


def _places() -> dict[str, tuple[float, int]]:
    return {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}


PLACES = _places()


def _near(a: str, b: str) -> tuple[float, int] | None:
    """The step from key a to key b, if they touch."""
    p, q = PLACES.get(a), PLACES.get(b)
    if p is None or q is None or a == b:
        return None
    step = (q[0] - p[0], q[1] - p[1])
    return step if abs(step[0]) <= 1 and abs(step[1]) <= 1 else None


STEPS = {(a, b): step for a in PLACES for b in PLACES if (step := _near(a, b))}


def _size(has: tuple[bool, ...]) -> float:
    return math.log10(max(sum(n for n, there in zip((10, 26, 26, 33, 100), has, strict=True) if there), 10))


def _kinds(value: str) -> tuple[bool, ...]:
    return any(c in "0123456789" for c in value), any("a" <= c <= "z" for c in value), any("A" <= c <= "Z" for c in value), any(c.isascii() and not c.isalnum() for c in value), any(not c.isascii() for c in value)


def alphabet(value: str) -> float:
    """Log10 of the number of characters that a guesser would have to try at each place of a brute-force span."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return math.log10(10 if value.isdigit() else 16)
    return _size(_kinds(value))


def _lowered(value: str) -> str:
    low = value.lower()
    if len(low) != len(value):  # a character whose lower case is longer
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    return low


def fixed(value: str, low: str, plain: str, i: int) -> Iterator[tuple[int, str, float]]:
    """Words and dates from place i: end, kind, log10 of guesses."""
    if low[i : i + 3] in BEGINNINGS or plain[i : i + 3] in BEGINNINGS:
        for j in range(i + 3, min(len(value), i + LONGEST) + 1):
            for text, leet in ((low[i:j], 0.0), (plain[i:j], LOG2)):
                if text in RANK and not (leet and text == low[i:j]):
                    yield j, "word", math.log10(RANK[text]) + leet + (LOG2 if value[i:j] != low[i:j] else 0.0)
    if value[i] in "0123456789":
        for rx, days in DATE:
            if m := rx.match(value, i):
                year = int(re.search(r"(?:19|20)\d\d", m.group())[0])
                yield m.end(), "date", math.log10(days * max(abs(year - 2020), 20)) + (math.log10(4) if days > 1 and m.group(1) else 0.0)


def walk_cost(length: int, turns: int) -> float:
    return math.log10(47 * length) + turns * TURN


def repeat_cost(unit: str, times: int) -> float:
    return len(unit) * alphabet(unit) + math.log10(times)


class Starts:
    """Least a + log10(x - i) over starts (i, a), for growing x.

    A start that is no cheaper than a later one never wins, and an earlier, cheaper one catches up with a later one at
    one x and leads from there on.  So starts that can still win form a stack, where those on top are caught first.
    """

    __slots__ = ("stack",)

    def __init__(self):
        self.stack: list[tuple[int, float, float]] = []  # start, cost, x at which the one below catches up

    def add(self, i: int, a: float, x: int) -> None:
        """To count from x on."""
        s = self.stack
        while s and s[-1][1] >= a:
            s.pop()
        caught = math.inf
        while s:
            j, b, other = s[-1]
            r = 10.0 ** min(a - b, 300.0)
            caught = (r * i - j) / (r - 1) if r > 1 else math.inf
            if caught <= x:
                return
            if other > caught:
                break
            s.pop()  # it is caught before it catches
            caught = math.inf
        s.append((i, a, caught))

    def best(self, x: int) -> tuple[float, int]:
        s = self.stack
        while len(s) > 1 and s[-1][2] <= x:
            s.pop()
        i, a, _ = s[-1]
        return a + math.log10(x - i), i


def _repeats(value: str) -> dict[int, list[tuple[int, float]]]:
    """By end of a segment the periods p of which it ends at least two (of one character: three), each with the log10 of its unit."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    found: dict[int, list[tuple[int, float]]] = {}
    for p in range(1, min(PERIOD, len(value) // 2) + 1):
        same = np.concatenate([[False], codes[p:] == codes[:-p], [False]])
        edge = np.nonzero(same[1:] != same[:-1])[0]
        for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # value[a + p:e + p] equals what is p places before
            if e - a >= max(p, 2):
                unit = p * alphabet(value[a : a + p])
                for j in range(a + max(2 * p, 3), e + p + 1):
                    found.setdefault(j, []).append((p, unit))
    return found


def guess_cost(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """Log10 of the guesses of the cheapest segmentation, and that segmentation; neighbouring brute-force characters are one span."""
    n, each = len(value), alphabet(value)
    low = _lowered(value)
    plain, keys = low.translate(LEET), low.translate(SHIFT)
    best: list[float] = [math.inf] * (n + 1)
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    best[0] = 0.0
    repeats = _repeats(value)
    running: dict[tuple[int, int], tuple[Starts, int]] = {}
    walks, since, last, turns = Starts(), 0, None, [0] * (n + 1)  # turns[j]: changes of direction up to character j
    for j in range(n + 1):
        if j:
            if best[j - 1] + each < best[j] - 1e-12:
                best[j], back[j] = best[j - 1] + each, (j - 1, "brute")
            step = STEPS.get((keys[j - 2], keys[j - 1])) if j > 1 else None
            if step is None:
                walks, since, last = Starts(), j - 1, None
            turns[j] = turns[j - 1] + (step is not None and last is not None and step != last)
            last = step
            if j - since >= 3:
                i = j - 3
                # From i on, the first step is a turn, and changes count from the step after it.
                walks.add(i, best[i] - turns[i + 2] * TURN, j)
                cost, i = walks.best(j)
                cost += LOG47 + (1 + turns[j]) * TURN
                if cost < best[j] - 1e-12:
                    best[j], back[j] = cost, (i, "walk")
            for p, unit in repeats.get(j, ()):
                key, i = (p, j % p), j - (2 * p if p > 1 else 3)
                own, before = running.get(key, (None, -1))
                if own is None or before != j - p:
                    own = Starts()
                running[key] = (own, j)
                own.add(i, best[i], j)
                cost, i = own.best(j)
                cost += unit - math.log10(p)
                if cost < best[j] - 1e-12:
                    best[j], back[j] = cost, (i, "repeat")
        if j < n:
            for end, kind, cost in fixed(value, low, plain, j):
                if best[j] + cost < best[end] - 1e-12:
                    best[end], back[end] = best[j] + cost, (j, kind)
    parts, j = [], n
    while j:
        i, kind = back[j]
        if parts and kind == "brute" == parts[-1][2] and parts[-1][0] == j:
            parts[-1] = (i, parts[-1][1], kind)
        else:
            parts.append((i, j, kind))
        j = i
    return best[n], parts[::-1]


def findings(text: str) -> Iterator[tuple[int, int, str, float, str]]:
    """Start and end of the value in code points, context, log10 of guesses, segmentation."""
    for m in CONTEXT.finditer(text):
        group = next(g for g in ("v1", "v2", "v3", "v4", "v5") if m.group(g))
        value = m.group(group)
        cost, parts = guess_cost(value)
        context = m.group("word") or m.group("bearer") or "access key id"
        yield m.start(group), m.end(group), context.lower(), round(cost, 4), " ".join(f"{k}:{j - i}" for i, j, k in parts)


def secret_scan(docs: DataFrame) -> DataFrame:
    """A row for each value in a credential context: doc_id, start, end, context, guesses_log10, segments, secret."""
    src = docs.select("doc_id", "text").filter(F.col("text").rlike(HINT))
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("context", T.StringType()), T.StructField("guesses_log10", T.DoubleType()), T.StructField("segments", T.StringType()), T.StructField("secret", T.BooleanType())])

    def scan(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at, rows = [], []
            for i in range(b.num_rows):
                for f in findings(texts[i].as_py()):
                    at.append(i)
                    rows.append(f)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.string()), pa.array([c >= MIN_GUESSES for c in cols[3]], pa.bool_())],
                names=schema.names,
            )

    return src.mapInArrow(scan, schema)


def redact(text: str) -> str:
    out, at = [], 0
    for start, end, _, cost, _ in findings(text):
        if cost >= MIN_GUESSES:
            out += [text[at:start], MASK]
            at = end
    return text if not out else "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All documents, with every secret value replaced by ``[SECRET]`` and ``n_chars`` (if there) set anew; only texts with a hint of a context pass through Python."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    changed = masked(F.when(F.col("text").rlike(HINT), F.col("text")))
    out = docs.withColumn("text", F.coalesce(changed, F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
