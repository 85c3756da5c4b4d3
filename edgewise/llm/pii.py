"""Personal data: patterns, and a character-level BiLSTM-CRF that learns from them.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers in every
whole text; they are the base spans and always stay. The tagger of ``char_tagger`` is
fitted on a bounded sample of windows labelled by base spans (``PER_KIND`` windows a
kind and as many without any, those with the smallest hashes of all documents, so the
sample does not depend on partitions or copies). It then reads overlapping windows of
every text; each window is decoded by itself, and the windows' spans are reconciled
over the whole text: a piece that a window's edge cut gives way to the whole span of
a neighbour or is joined with the neighbour's piece, and of overlapping spans the set
with the largest total score stays. A learned span is added if its mean posterior is
``SURE`` or more, no base span overlaps it, it passes its kind's check, and its kind
had at least ``LEAST_LABELLED`` windows.

Every span of these kinds holds a digit or an at sign, and a learned one must too.
So a window without either cannot add a span, and is not decoded: the result is that
of decoding all windows (``every_window=True`` does).

Defined cases: null text is empty and has no span; an empty table gives an empty
result; repeated rows are scanned each; extra columns are ignored; a null id stays
null. Patterns are matched in time linear in the text, however long its runs.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import char_tagger
from .common import column, field, map_batches, prepare_batches

#: fixed values: the kinds in order, their patterns and limits
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, MOST_PART = (16, 19), (8, 15), 255
SEED = re.compile("[0-9@]")
#: characters of a window, and between the starts of two
WINDOW, STRIDE = 128, 64
#: labelled windows of each kind, and of none, in the fit at most; a kind with fewer than the second is not learned
PER_KIND, LEAST_LABELLED = 240, 40
#: least mean posterior, and least length, of a learned span
SURE, SHORTEST = 0.9, 6
#: windows decoded at once
DECODED = 256


# ---- base spans -----------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, an at sign and a domain: the local part is the whole run before the sign."""
    taken = before = 0
    at = text.find("@")
    while at >= 0:
        start, least = at, max(taken, before)
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            taken = m.end()
        before = at + 1
        at = text.find("@", max(before, taken))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _card(s: str) -> bool:
    d = _digits(s)
    return CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= MOST_PART for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= CARD_DIGITS[0] and _card(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text)
                if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]]
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- windows --------------------------------------------------------------------

def window_starts(n: int, seeds: list[int] | None) -> list[int]:
    """Starts of the windows of a text of ``n`` characters, or of those that hold a seed."""
    last = max(0, -(-(n - WINDOW) // STRIDE)) if n > WINDOW else 0
    if seeds is None:
        return [STRIDE * k for k in range(last + 1)]
    return [STRIDE * k for k in sorted({max(0, min(p // STRIDE - back, last)) for p in seeds for back in (0, 1)})]


def seeds_of(text: str) -> list[int]:
    return [m.start() for m in SEED.finditer(text)]


def marks(base: list[tuple[str, int, int]], start: int, end: int) -> list[int]:
    """Tag of each character of a window: 0 outside, 1 + 2k at a span's begin, 2 + 2k inside."""
    tags = [0] * (end - start)
    for kind, a, b in sorted(base, key=lambda s: s[1]):
        k = KINDS.index(kind)
        for p in range(max(a, start), min(b, end)):
            if not tags[p - start]:
                tags[p - start] = 1 + 2 * k if p == a else 2 + 2 * k
    return tags


def labelled_windows(docs: DataFrame, per_kind: int = PER_KIND) -> list[tuple[str, list[int], str]]:
    """(text, tags, kind) of the sample for the fit: ``per_kind`` windows a kind, "none" among them.

    A task keeps as many for each kind; windows of the same text count once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict = {k: [] for k in [*KINDS, "none"]}
        held: dict = {k: set() for k in heaps}
        for batch in batches:
            for text in column(batch, "text").to_pylist():
                seeds = seeds_of(text) if text else []
                if not seeds:
                    continue
                base = base_spans(text)
                whole = np.array(seeds)
                for start in window_starts(len(text), seeds):
                    end = min(start + WINDOW, len(text))
                    if not np.any((whole >= start) & (whole < end)):
                        continue
                    near = [s for s in base if s[1] < end and s[2] > start]
                    kind = min(near, key=lambda s: s[1])[0] if near else "none"
                    part = text[start:end]
                    key = int.from_bytes(hashlib.blake2b(part.encode("utf-8", "replace"), digest_size=7).digest(), "big")
                    heap = heaps[kind]
                    if key in held[kind] or len(heap) == per_kind and key >= -heap[0][0]:
                        continue
                    row = (-key, part, marks(near, start, end))
                    held[kind].add(key)
                    if len(heap) == per_kind:
                        held[kind].discard(-heapq.heappushpop(heap, row)[0])
                    else:
                        heapq.heappush(heap, row)
        rows = [(kind, -r[0], r[1], r[2]) for kind, heap in heaps.items() for r in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["kind", "key", "text", "tags"])

    prepare_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(run, "kind string, key long, text string, tags array<long>")
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("key"))
    rows = found.dropDuplicates(["kind", "key"]).withColumn("r", rank).where(F.col("r") <= per_kind).collect()
    return [(r["text"], r["tags"], r["kind"]) for r in sorted(rows, key=lambda r: (r["kind"], r["key"]))]


def learn(docs: DataFrame, per_kind: int = PER_KIND, least: int = LEAST_LABELLED) -> dict | None:
    """A fitted tagger as plain data, with the kinds it may add; None if no kind has enough labelled windows."""
    rows = labelled_windows(docs, per_kind)
    count = Counter(kind for *_, kind in rows)
    kinds = [k for k in KINDS if count[k] >= least]
    if not kinds:
        return None
    weights = char_tagger.train([(text, tags) for text, tags, _ in rows], 1 + 2 * len(KINDS))
    return {"weights": weights, "kinds": kinds}


# ---- learned spans ----------------------------------------------------------------

def pieces(tags: list[int], sure: list[float], start: int) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, mean posterior) of the spans of one decoded window, as places in the text."""
    out, k, n = [], 0, len(tags)
    while k < n:
        if not tags[k]:
            k += 1
            continue
        kind, end = (tags[k] - 1) // 2, k + 1
        while end < n and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((start + k, start + end, KINDS[kind], sum(sure[k:end]) / (end - k)))
        k = end
    return out


def reconciled(windows: list[tuple[int, int, list[tuple]]], length: int) -> list[tuple[int, int, str, float]]:
    """Spans of a whole text from those of its windows (start, end, pieces), without overlaps."""
    whole, cut = [], []
    for start, end, found in windows:
        for p in found:
            inner = p[0] == start > 0 or p[1] == end < length
            (cut if inner else whole).append(p)
    whole = sorted(set(whole))
    begins = [p[0] for p in whole]
    reach = np.maximum.accumulate([p[1] for p in whole]) if whole else []
    rest: list[list] = []
    for p in sorted(set(cut)):
        k = bisect_right(begins, p[1] - 1)
        if k and reach[k - 1] > p[0]:
            continue  # a neighbour has the span, or another there, whole
        if rest and rest[-1][2] == p[2] and p[0] <= rest[-1][1]:
            rest[-1][1], rest[-1][3] = max(rest[-1][1], p[1]), min(rest[-1][3], p[3])
        else:
            rest.append(list(p))
    best_of: dict = {}
    for p in [*whole, *map(tuple, rest)]:
        best_of[p[:3]] = max(best_of.get(p[:3], 0.0), p[3])
    spans = sorted(((*k, v) for k, v in best_of.items()), key=lambda p: (p[1], p[0], p[2]))
    ends = [p[1] for p in spans]
    best: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # total, span taken, spans before it
    for k, p in enumerate(spans):
        before = bisect_right(ends, p[0], 0, k)
        take = best[before][0] + p[3] * (p[1] - p[0])
        best.append((take, k, before) if take > best[k][0] else (best[k][0], -1, k))
    out, k = [], len(spans)
    while k:
        _, taken, before = best[k]
        if taken >= 0:
            out.append(spans[taken])
        k = before
    return out[::-1]


def plausible(kind: str, text: str) -> bool:
    """What a learned span must be: like its kind, though no pattern matches it."""
    digits = _digits(text)
    if kind == "email":
        return "@" in text and "." in text
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= MOST_PART for p in parts)
    if kind == "card":
        return _card(text)
    return PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1] and not re.search("[A-Za-z]", text)


def learned_spans(texts: list[str], bases: list[list[tuple]], model: dict, every_window: bool = False) -> list[list[tuple]]:
    """(kind, start, end) that the tagger adds to each text's base spans."""
    jobs = []
    for t, text in enumerate(texts):
        seeds = seeds_of(text)
        if seeds or (every_window and text):
            jobs += [(t, a) for a in window_starts(len(text), None if every_window else seeds)]
    found: dict[int, list] = {}
    for at in range(0, len(jobs), DECODED):
        part = jobs[at:at + DECODED]
        ids = np.full((len(part), WINDOW), char_tagger.PAD, np.int16)
        lengths = np.empty(len(part), np.int64)
        for row, (t, a) in enumerate(part):
            cut = texts[t][a:a + WINDOW]
            ids[row, :len(cut)], lengths[row] = char_tagger.char_ids(cut), len(cut)
        tags, sure = char_tagger.decode(model["weights"], ids, lengths)
        for row, (t, a) in enumerate(part):
            n = lengths[row]
            got = pieces(tags[row, :n].tolist(), sure[row, :n].tolist(), a)
            text = texts[t]
            # a span of these kinds holds a digit or an at sign
            got = [p for p in got if SEED.search(text, p[0], p[1])]
            if got:
                found.setdefault(t, []).append((a, a + int(n), got))
    out: list[list[tuple]] = [[] for _ in texts]
    for t, windows in found.items():
        text = texts[t]
        base = sorted((a, b) for _, a, b in bases[t])
        begins, reach = [a for a, _ in base], np.maximum.accumulate([b for _, b in base]) if base else []
        for a, b, kind, score in reconciled(windows, len(text)):
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            k = bisect_right(begins, b - 1)
            if kind in model["kinds"] and score >= SURE and b - a >= SHORTEST and not (k and reach[k - 1] > a) \
                    and plausible(kind, text[a:b]):
                out[t].append((kind, a, b))
    return out


def scan(docs: DataFrame, model: dict | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and ``spans``:
    an array of (kind, start, end) of all spans, by kind as listed, then start; ``n_learned`` of them are learned.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    schema = T.StructType([*(field(docs, c) for c in keep), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.ArrayType(span)),
                           T.StructField("n_learned", T.LongType())])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # plain arrays, some 20 KB

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in column(batch, text_col).to_pylist()]
        bases = [base_spans(t) for t in texts]
        model = shared.value
        more = learned_spans(texts, bases, model) if model else [[] for _ in texts]
        counts = [Counter(k for k, *_ in base) for base in bases]
        rank = KINDS.index
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in sorted([*base, *new], key=lambda s: (rank(s[0]), s[1]))]
                 for base, new in zip(bases, more)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [*(column(batch, c) for c in keep), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS),
             pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base in bases], pa.string()),
             pa.array(spans, kind), pa.array([len(new) for new in more], pa.int64())], names=schema.names)

    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), run, schema)


def spans_text(spans="spans"):
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
