"""BPE encoding and decoding through a minimal acyclic transducer.

Word counts over all texts give the most frequent words. They are encoded once
and compiled into a minimal acyclic automaton: words share prefixes and
suffixes, and each transition adds a number, so that the sum along a word's
path is the word's place in the table of ids (a transducer with outputs in the
integers). The automaton is a few flat arrays in one file, which a task maps
into memory; the distinct words of a batch walk it together. Words that it does
not hold are merged exactly, pair by pair in rank order.

The vocabulary is read from a tokenizer file (byte-level BPE with word ends;
NFC and lower case; white space dropped), whose path is a parameter. Decoding
joins the token strings with one space, as the file has no decoder.

Defined cases: null text is empty and has no token; repeated rows are encoded
each; the strings of special tokens give their ids; an empty table gives an
empty lexicon and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import broadcast_value, column, field, map_batches, prepare_batches, staged

#: words in the automaton, words a task remembers, words it counts between two outputs,
#: symbols from which a word is merged with a heap
LEXICON_WORDS, CACHE_WORDS, COUNT_WORDS, LONG_WORD = 1 << 18, 400_000, 200_000, 200
#: most bytes of a word in the automaton
LONGEST = 64
#: fixed values: white space and word end of the tokenizer file
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [table[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Tokens, merge ranks and special tokens of one tokenizer file."""

    tokens: list[str]
    merges: dict[int, int]  # left << 16 | right -> rank << 16 | merged (ids are below 1 << 16)
    first: list[int]
    last: list[int]
    special: dict[str, int]
    #: the file's rules without its vocabulary; word pattern; characters to be left to the library
    rules: str
    pattern: str
    other: str


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    ids = data["model"]["vocab"]
    special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
    tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
    for t, i in [*ids.items(), *special.items()]:
        tokens[i] = t
    merges = {}
    for rank, pair in enumerate(data["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault(ids[a] << 16 | ids[b], rank << 16 | ids[a + b])
    symbols = byte_symbols()
    rules = json.dumps(data | {"model": data["model"] | {"vocab": {}, "merges": []}, "added_tokens": []})
    return Vocabulary(tokens, merges, [ids[s] for s in symbols], [ids[s + WORD_END] for s in symbols], special,
                      rules, word_pattern(), rf"[\U00010000-\U0010ffff{_ranges(lambda k: k == 'Cn')}]")


def merge_word(vocabulary: Vocabulary, word: str) -> list[int]:
    """Exact BPE of one word: always the pair of the lowest rank, leftmost first."""
    data = word.encode()
    if not data:
        return []
    first, get, none = vocabulary.first, vocabulary.merges.get, 1 << 40
    parts = [first[b] for b in data[:-1]]
    parts.append(vocabulary.last[data[-1]])
    if len(parts) > LONG_WORD:
        return _merge_long(vocabulary, parts)
    pairs = [get(a << 16 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i:i + 2] = [best & 0xffff]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] << 16 | parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] << 16 | parts[i + 1], none)
    return parts


def _merge_long(vocabulary: Vocabulary, parts: list[int]) -> list[int]:
    """The same merges with a heap over a linked list, for words without end."""
    get, n = vocabulary.merges.get, len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m >> 16, i, m & 0xffff, parts[i], parts[i + 1]) for i in range(n - 1)
            if (m := get(parts[i] << 16 | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = new, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (m := get(new << 16 | parts[after[i]])) is not None:
                heapq.heappush(heap, (m >> 16, i, m & 0xffff, new, parts[after[i]]))
        if (h := before[i]) >= 0 and (m := get(parts[h] << 16 | new)) is not None:
            heapq.heappush(heap, (m >> 16, h, m & 0xffff, parts[h], new))
    return [p for p in parts if p >= 0]


def _ranges(holds) -> str:
    """The characters of the basic plane for which ``holds``, as the inside of a character class."""
    out, start = [], None
    for c in range(0x10001):
        if (inside := c < 0x10000 and holds(unicodedata.category(chr(c)))) and start is None:
            start = c
        elif not inside and start is not None:
            out.append(rf"\u{start:04x}-\u{c - 1:04x}")
            start = None
    return "".join(out)


def word_pattern() -> str:
    """The file's word pattern, with its classes written out and its letters first."""
    letters, numbers = (_ranges(lambda k, x=x: k[0] == x) for x in "LN")
    return rf"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{letters}{numbers}]+"


class Pieces:
    """Splits a text into words and special tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.special = special = vocabulary.special
        self.rules, self.library = vocabulary.rules, None
        self.other = re.compile(vocabulary.other).search
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self.find = re.compile(vocabulary.pattern).findall

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            if self.other(text):
                return self.words_by_library(text)
            # every capital sigma becomes the plain one, also at a word's end
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def words_by_library(self, text: str) -> list[str]:
        """Beyond the basic plane or newer than this Python's data: the library's own two steps."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.rules)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(special?, pieces) from left to right."""
        if self.split and any(s in text for s in self.special):
            for i, part in enumerate(self.split(text)):
                yield (True, [part]) if i % 2 else (False, self.words(part))
        else:
            yield False, self.words(text)


# ---- the automaton ------------------------------------------------------------------------------

def build_automaton(words: list[str]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words (by UTF-8 bytes).

    Arrays: ``keys`` (state * 256 + byte, sorted), ``targets`` and ``adds`` by
    transition, ``final`` by state. The sum of ``adds`` along a word is its index.
    """
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []  # of finished states
    finals: list[bool] = []

    def finish(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if (i := register.get(key)) is None:
            i = register[key] = len(edges)
            edges.append(key[1])
            finals.append(state[0])
        return i

    # path[d]: [final, finished transitions, label of the open transition]
    path: list[list] = [[False, [], None]]
    before = b""
    for word in words:
        data = word.encode()
        same = 0
        while same < min(len(data), len(before)) and data[same] == before[same]:
            same += 1
        while len(path) > same + 1:
            done = finish(path.pop())
            path[-1][1].append((path[-1][2], done))
        for b in data[same:]:
            path[-1][2] = b
            path.append([False, [], None])
        path[-1][0] = True
        before = data
    while len(path) > 1:
        done = finish(path.pop())
        path[-1][1].append((path[-1][2], done))
    root = finish(path[0])
    count = [0] * len(edges)  # words from a state on; targets are finished before their sources
    keys, targets, adds = [], [], []
    for s, out in enumerate(edges):
        n = int(finals[s])
        for label, target in out:
            keys.append(s * 256 + label)
            targets.append(target)
            adds.append(n)
            n += count[target]
        count[s] = n
    return {"keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32),
            "adds": np.array(adds, np.int32), "final": np.array(finals, np.int8),
            "root": np.array([root], np.int32)}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a JSON line with names, types and places, then the arrays."""
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        head[name] = [a.dtype.str, len(a), at]
        body.append(raw)
        at += len(raw)
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    return line + b"".join(body)


def mapped(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of a packed file, mapped into memory (the file has no name and needs no clean-up)."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    start = view.find(b"\n") + 1
    return {name: np.frombuffer(view, kind, n, start + at)
            for name, (kind, n, at) in json.loads(view[:start]).items()}


def find_words(arrays: dict[str, np.ndarray], words: list[str]) -> np.ndarray:
    """Index of each word in the automaton, -1 where it has none; all words walk together."""
    found = np.full(len(words), -1, np.int64)
    if not words or not len(arrays["keys"]):
        return found
    data = [w.encode() for w in words]
    lengths = np.array([len(d) for d in data])
    flat = np.frombuffer(b"".join(data) or b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    keys, targets, adds = arrays["keys"], arrays["targets"], arrays["adds"]
    live = np.flatnonzero(lengths > 0)
    state, total = np.full(len(words), arrays["root"][0], np.int64), np.zeros(len(words), np.int64)
    step = 0
    while len(live):
        want = state[live] * 256 + flat[starts[live] + step]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[at] == want
        live, at = live[hit], at[hit]
        state[live] = targets[at]
        total[live] += adds[at]
        step += 1
        ends = lengths[live] == step
        done = live[ends]
        done = done[arrays["final"][state[done]] == 1]
        found[done] = total[done]
        live = live[~ends]
    return found


# ---- on Spark -----------------------------------------------------------------------------------

def word_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; each task sends sums of bounded tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = Pieces(vocabulary), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in column(batch, text_col):
                for is_special, found in pieces.parts(text.as_py() or ""):
                    if not is_special:
                        counts.update(found)
                if len(counts) > COUNT_WORDS:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    prepare_batches(docs.sparkSession)
    sent = docs.select(text_col).mapInArrow(run, "word string, n bigint")
    return sent.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text",
                    size: int = LEXICON_WORDS) -> bytes:
    """The packed automaton of the most frequent words (at most ``size``), with their ids.

    Words of more than ``LONGEST`` bytes are left to exact merging, so the driver holds ``size * LONGEST`` bytes at most.
    """
    counts = staged(word_counts(docs, vocabulary, text_col), "bpe-words").where(F.octet_length("word") <= LONGEST)
    # classes of counts, an eighth of a power of two wide: as many of the highest as fit
    step = F.floor(F.log2("n") * 8).cast("int")
    classes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # at most 504 rows
    least, room = 1 << 30, size
    for c in sorted(classes, key=lambda c: -c.step):
        if c.words > room:
            break
        least, room = c.step, room - c.words
    words = sorted((r[0] for r in counts.where(step >= least).select("word").collect()), key=str.encode)
    ids = [merge_word(vocabulary, w) for w in words]
    arrays = build_automaton(words)
    arrays["offsets"] = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    arrays["ids"] = np.array([i for x in ids for i in x], np.int32)
    return pack(arrays)


class Encoder:
    """Encodes texts with the mapped automaton; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: bytes):
        self.vocabulary, self.arrays, self.pieces = vocabulary, mapped(lexicon), Pieces(vocabulary)
        #: word -> (ids, ids as text, tokens as text)
        self.known: dict[str, tuple[list[int], str, str]] = {}

    def entry(self, ids: list[int]) -> tuple[list[int], str, str]:
        return ids, " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The token strings, joined by one space."""
        tokens = self.vocabulary.tokens
        return " ".join([tokens[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        offsets, ids = self.arrays["offsets"], self.arrays["ids"]
        for word, i in zip(new, find_words(self.arrays, new).tolist(), strict=True):
            self.known[word] = self.entry(ids[offsets[i]:offsets[i + 1]].tolist() if i >= 0
                                          else merge_word(self.vocabulary, word))

    def encode(self, texts: list[str]) -> Iterator[list[tuple[list[int], str, str]]]:
        """For each text the entries of its pieces."""
        at = 0
        while at < len(texts):
            # texts whose distinct words fit the memory, one at least
            group, words = [], set()
            while at < len(texts) and (not group or len(words) < CACHE_WORDS // 2):
                group.append(list(self.pieces.parts(texts[at])))
                words.update(*(p for special, p in group[-1] if not special))
                at += 1
            if len(self.known) + len(words) > CACHE_WORDS:
                self.known.clear()
            self.learn(words)
            known, special = self.known, self.vocabulary.special
            for parts in group:
                if len(parts) == 1:
                    yield [known[w] for w in parts[0][1]]
                else:
                    yield [self.entry([special[w]]) if is_special else known[w]
                           for is_special, found in parts for w in found]


def encoded(docs: DataFrame, vocabulary: Vocabulary, lexicon: bytes, keep: list[str], digests: bool = False,
            text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``n_tokens``, with ``input_ids`` or with the SHA-256 of ids and decoded text."""
    spark = docs.sparkSession
    shared = broadcast_value(spark, (vocabulary, lexicon))  # both of bounded size
    more = ([T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
            if digests else [T.StructField("input_ids", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([*(field(docs, c) for c in keep), T.StructField("n_tokens", T.LongType()), *more])
    ready: list[Encoder] = []

    def sha(parts: list[str]) -> str:
        return hashlib.sha256(" ".join(parts).encode()).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not ready:
            ready.append(Encoder(*shared()))
        texts = [t or "" for t in column(batch, text_col).to_pylist()]
        n, first, second = [], [], []
        for entries in ready[0].encode(texts):
            n.append(sum([len(e[0]) for e in entries]))
            if digests:
                first.append(sha([e[1] for e in entries]))
                second.append(sha([e[2] for e in entries]))
            else:
                first.append([i for e in entries for i in e[0]])
        cols = [pa.array(n, pa.int64())]
        cols += [pa.array(first, pa.string()), pa.array(second, pa.string())] if digests else \
            [pa.array(first, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), *cols], names=schema.names)

    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), run, schema)
