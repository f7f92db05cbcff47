"""Operator 1: personal data by base patterns and a character-level BiLSTM-CRF.

The patterns' spans always stay.  They also label the training windows, a sample bounded by
``WINDOWS`` drawn over all documents by hash; each labelled window is joined by respelled
ones (other separators, spelled-out signs, no country code) whose spans move along, and by
windows of plain numbers, dates and tokens without any.  The tagger thus learns spellings that
the patterns miss.

Every text is decoded in overlapping windows.  A window without a digit, an at sign or a
spelled-out one cannot hold a span that passes the final check, so only the others are
decoded; nothing is lost by that.  A span that touches an inner edge of its window is left to
the neighbour that sees it whole.  The spans of all windows of a text are then reconciled
together: the choice without overlaps that has the highest total score.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulecorpus.llm import pii_model as M
from joulecorpus.llm import pii_rules as R
from joulecorpus.llm.frames import bounded_sample

#: Characters of a window, and of the part that the next one repeats.
WIDTH = 96
OVERLAP = 48
#: Labelled windows for training at most, and passes over them.
WINDOWS = 400
EPOCHS = 10
#: Windows that are decoded together.
BATCH = 512
#: What a span's tags must gain over leaving it out.
MARGIN = 2.0

FOUND = "doc_id bigint, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"


def window_starts(text: str) -> list[int]:
    """Windows that hold a trigger."""
    stride = WIDTH - OVERLAP
    out: list[int] = []
    for m in R.TRIGGER.finditer(text):
        last = m.start() // stride
        first = max(0, -(-(m.end() - WIDTH) // stride))
        out.extend(k * stride for k in range(max(first, out[-1] // stride + 1 if out else 0), last + 1))
    return out


def padded(texts: list[str]) -> np.ndarray:
    out = np.full((len(texts), WIDTH), M.PAD, np.int64)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = M.classes(text)
    return out


def labelled_windows(text: str, doc_key: int) -> Iterator[tuple[int, str, str]]:
    """Sort key, text and joined spans of windows around base spans; whole spans only."""
    base = R.base_spans(text)
    for kind in R.KINDS:
        for k, (a, b) in enumerate(base[kind]):
            if b - a > WIDTH - 20:
                continue
            rng = random.Random(f"{doc_key}:{kind}:{k}")
            low = max(0, a - rng.randint(5, WIDTH - (b - a) - 5))
            high = min(len(text), low + WIDTH)
            inside = {n: [(x - low, y - low) for x, y in base[n] if low <= x and y <= high] for n in R.KINDS}
            yield rng.getrandbits(62), text[low:high], R.joined(inside)


def parsed(spans: str) -> dict[str, list[R.Span]]:
    out: dict[str, list[R.Span]] = {}
    for part in spans.split(",") if spans else []:
        kind, a, b = part.split(":")
        out.setdefault(kind, []).append((int(a), int(b)))
    return out


def respelled(kind: str, body: str, rng: random.Random) -> str:
    """Another way to write a span."""
    digits = [c for c in body if c.isdigit()]
    if kind == "email":
        at, dot = rng.choice([(" @ ", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("@", " . ")])
        return body.replace("@", at).replace(".", dot)
    if kind == "ip":
        return body.replace(".", rng.choice([" . ", "[.]", ". ", " [dot] "]))
    if kind == "card":
        gap = rng.choice([".", "/", "_", " - ", "-", " "])
        return gap.join("".join(digits[k : k + 4]) for k in range(0, len(digits), 4))
    cut = max(1, len(digits) - 10)
    head, area, mid, tail = digits[:cut], digits[cut:-7], digits[-7:-4], digits[-4:]
    gap = rng.choice([".", "/", " ", "-", " - "])
    number = gap.join("".join(p) for p in (area, mid, tail) if p)
    return rng.choice([number, f"({''.join(area)}) {''.join(mid)}-{''.join(tail)}", f"00{''.join(head)} {number}", f"+{''.join(head)}/{number}"])


def variant(text: str, spans: dict[str, list[R.Span]], rng: random.Random) -> tuple[str, dict[str, list[R.Span]]]:
    """The window with its spans respelled and moved along; spans that don't pass the check lose their label."""
    out, moved, at = [], {}, 0
    for a, b, kind in sorted((a, b, k) for k, v in spans.items() for a, b in v):
        if a < at:
            continue
        out.append(text[at:a])
        new = respelled(kind, text[a:b], rng)
        start = sum(map(len, out))
        out.append(new)
        moved.setdefault(kind, []).append((start, start + len(new)))
        at = b
    whole = "".join(out) + text[at:]
    kept = {k: [s for s in v if s[1] <= WIDTH and R.accepted(k, whole, *s)] for k, v in moved.items()}
    return whole[:WIDTH], kept


def plain_numbers(text: str, rng: random.Random) -> str:
    """A window with numbers that are no personal data."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    item = rng.choice(
        [
            lambda: f"{number(4)}-{number(2)}-{number(2)}",
            lambda: f"{number(2)}.{number(2)}.{number(4)}",
            lambda: f"{number(2)}:{number(2)}:{number(2)}",
            lambda: f"{number(3)},{number(3)}.{number(2)}",
            lambda: f"version {number(1)}.{number(1)}",
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
            lambda: number(rng.randint(1, 7)),
            lambda: f"{number(4)}-{number(2)}-{number(2)} {number(2)}:{number(2)}",
            lambda: f"v{number(1)}.{number(2)}.{number(1)}",
            lambda: f"{number(16)}",
        ]
    )()
    bare = re.sub(r"[0-9@+]+\S*", "", text)
    cut = rng.randint(0, min(len(bare), WIDTH - 45))
    return f"{bare[:cut]} {item} {bare[cut:]}"[:WIDTH]


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 0) -> M.Tagger | None:
    """A tagger from (window, joined spans); None without any."""
    if not samples:
        return None
    rng = random.Random(seed)
    texts, marks = [], []
    for text, spans in samples:
        known = parsed(spans)
        other, moved = variant(text, known, rng)
        for body, own in ((text, known), (other, moved), (plain_numbers(text, rng), {})):
            texts.append(body)
            marks.append(M.tags(WIDTH, own))
    tagger = M.Tagger(seed)
    tagger.train(padded(texts), np.array(marks), epochs)
    return tagger.narrowed()


def model_spans(texts: list[str], tagger: M.Tagger) -> list[list[tuple[int, int, str, float]]]:
    """Spans of every text by all its windows, those at inner edges left out."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    waiting: list[tuple[int, int]] = []

    def flush() -> None:
        rows = tagger.decode(padded([texts[k][low : low + WIDTH] for k, low in waiting]))
        for (k, low), spans in zip(waiting, rows, strict=True):
            size = len(texts[k])
            for a, b, kind, score in spans:
                cut = (a == 0 and low > 0) or (b == WIDTH and low + WIDTH < size)
                if not cut and low + b <= size and score >= MARGIN and R.accepted(kind, texts[k], low + a, low + b):
                    out[k].append((low + a, low + b, kind, score))
        waiting.clear()

    for k, text in enumerate(texts):
        for low in window_starts(text):
            waiting.append((k, low))
            if len(waiting) == BATCH:
                flush()
    if waiting:
        flush()
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> M.Tagger | None:
    """Train on at most ``WINDOWS`` labelled windows, chosen over all documents by hash."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                row
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if text
                for row in labelled_windows(text, doc or 0)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))],
                names=["key", "window", "spans"],
            )

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.where(F.col("text").rlike("[0-9@]")).mapInArrow(label, "key bigint, window string, spans string")
    sample = bounded_sample(found, F.col("key"), WINDOWS).collect()
    return train(sorted((r.window, r.spans) for r in sample))


def find_pii(docs: DataFrame, tagger: M.Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, added``: spans of the patterns, and those that the tagger adds.

    Places are code points, end exclusive; spans are sorted by kind and start.  An added span
    overlaps no other.  A null or empty text has none.  Rows without an id and repeated rows
    are searched like others; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger.weights if tagger else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tagger = M.Tagger(0, shared.value) if shared.value else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [R.base_spans(t) for t in texts]
                more = model_spans(texts, own_tagger) if own_tagger else [[] for _ in texts]
                added = []
                for own, found in zip(base, more, strict=True):
                    spans: dict[str, list[R.Span]] = {}
                    if found:
                        taken = _merged(own)
                        for a, b, kind in R.reconciled(found, taken):
                            spans.setdefault(kind, []).append((a, b))
                    added.append(spans)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(base), _lists(added)], names=["doc_id", "base", "added"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, FOUND)


def _merged(spans: dict[str, list[R.Span]]) -> list[R.Span]:
    """All spans as a sorted list without overlaps."""
    out: list[R.Span] = []
    for a, b in sorted(s for v in spans.values() for s in v):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _lists(rows: list[dict[str, list[R.Span]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k in R.KINDS for a, b in sorted(row.get(k, []))] for row in rows], kind)


def digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of the base spans, and all spans as text."""
    kind = F.array(*(F.lit(k) for k in R.KINDS))
    names = ("start", "end", "kind")
    ordered = lambda x: F.struct(F.array_position(kind, x["kind"]).alias("n"), *(x[n].alias(n) for n in names))
    every = F.array_sort(F.transform(F.concat("base", "added"), ordered))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    is_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", is_kind(k))).cast("bigint").alias(f"n_{k}") for k in R.KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text(every).alias("spans"))
