"""Byte-level BPE with a lexicon of frequent words in a minimal acyclic transducer.

Words (what the split pattern of the vocabulary finds) are counted over all documents; the most frequent are compiled
into an automaton whose equal suffixes are shared and whose arcs carry numbers that add up to a word's place, under
which its ids lie. Workers memory-map the compiled file, look up the words of a batch together, and merge those that
the lexicon lacks exactly, by rank. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_materialised, materialise, small_batches

#: The pattern of the byte-level vocabularies, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the lexicon.
LEXICON = 32_768
#: Pieces of text whose ids a worker keeps; words a task counts before it hands them on.
CACHE, COUNTED = 320_000, 300_000
#: Words up to this many bytes are merged by scanning, longer ones by a heap.
SCAN = 48

_SPLIT = regex.compile(PATTERN)
_TRICKY = re.compile(r" \s")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in plain)
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        model = data["model"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        ids: dict[bytes, int] = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for t, i in ids.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in part) for part in (m if isinstance(m, list) else m.split(" ")))
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.ids = ids
        # where ids follow the ranks, the public library's compiled loop merges the same way
        ordered = all(i == r + 256 for r, i in self.merges.values()) and len(ids) == 256 + len(self.merges)
        self.compiled = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={}) if ordered else None
        self.merge_short = self.compiled._core_bpe.encode_single_piece if ordered else self.merge
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank, the leftmost of equals, merges until none is left."""
        parts = [self.byte_ids[b] for b in word]
        return self._scan(parts) if len(parts) <= SCAN else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get = self.merges.get
        pairs = [get(p) for p in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, p in enumerate(pairs):
                if p is not None and (best is None or p < best):
                    best, at = p, i
            if best is None:
                return parts
            parts[at : at + 2] = [best[1]]
            pairs[at : at + 1] = []
            if at < len(pairs):
                pairs[at] = get((parts[at], parts[at + 1]))
            if at:
                pairs[at - 1] = get((parts[at - 1], parts[at]))

    def _heap(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.merges.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(p[0], i, parts[i], parts[i + 1], p[1]) for i in range(n - 1) if (p := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if p := get((made, parts[after[i]])):
                    heapq.heappush(heap, (p[0], i, made, parts[after[i]], p[1]))
            if (h := before[i]) >= 0 and (p := get((parts[h], made))):
                heapq.heappush(heap, (p[0], h, parts[h], made, p[1]))
        return [p for p, here in zip(parts, alive) if here]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton as one file: counts, then arc keys (state · 256 + byte, sorted), targets, numbers, final states, id offsets, ids."""
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    count: list[int] = []

    def settle(final: bool, arcs: list[list[int]]) -> int:
        key = (final, tuple(map(tuple, arcs)))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
            count.append(final + sum(count[t] for _, t in key[1]))
        return registry[key]

    path: list[list] = [[False, []]]  # of the word added last: final, arcs
    last = b""
    ordered = sorted(words)
    for w in ordered:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        for depth in range(len(last), common, -1):
            final, arcs = path.pop()
            path[-1][1].append([last[depth - 1], settle(final, arcs)])
        path += [[False, []] for _ in w[common:]]
        path[-1][0] = True
        last = w
    for depth in range(len(last), 0, -1):
        final, arcs = path.pop()
        path[-1][1].append([last[depth - 1], settle(final, arcs)])
    root = settle(*path[0])
    key, target, number = [], [], []
    for s, (final, arcs) in enumerate(states):
        before = int(final)
        for byte, t in arcs:
            key.append(s * 256 + byte)
            target.append(t)
            number.append(before)
            before += count[t]
    ids = [words[w] for w in ordered]
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]).astype("<i8")
    flat = np.array([i for x in ids for i in x], dtype="<i4")
    head = np.array([len(key), len(states), len(ids), len(flat), root], dtype="<i8")
    return b"".join(x.tobytes() for x in (head, np.array(key, "<i8"), np.array(target, "<i8"), np.array(number, "<i8"), offsets, np.array([f for f, _ in states], "<u1"), flat))


class Lexicon:
    """A compiled lexicon, memory-mapped from a file without a name, which goes with the process."""

    def __init__(self, blob: bytes) -> None:
        self.file = tempfile.TemporaryFile()
        self.file.write(blob)
        self.file.flush()
        m = np.memmap(self.file, dtype=np.uint8, mode="r")
        arcs, states, words, ids, self.root = (int(x) for x in m[:40].view("<i8"))
        at = 40
        parts = []
        for n, kind, width in ((arcs, "<i8", 8), (arcs, "<i8", 8), (arcs, "<i8", 8), (words + 1, "<i8", 8), (states, "<u1", 1), (ids, None, 4)):
            part = m[at : at + n * width]
            parts.append(part.view(kind) if kind else np.frombuffer(part.tobytes(), "<i4"))
            at += n * width
        self.key, self.target, self.number, self.offsets, self.final, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, or -1: all words walk the automaton together, a byte at a time."""
        n = len(words)
        place = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.key):
            return place
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.cumsum(size) - size
        live, state, total = np.arange(n), np.full(n, self.root), np.zeros(n, dtype=np.int64)
        step = 0
        while len(live):
            ended = size[live] == step
            found = ended & (self.final[state] > 0)
            place[live[found]] = total[found]
            live, state, total = live[~ended], state[~ended], total[~ended]
            key = state * 256 + flat[begin[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            at = at[ok]
            live, state, total = live[ok], self.target[at], total[ok] + self.number[at]
            step += 1
        return place


def _packed(ids: list[int]) -> bytes:
    a = array("i", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Encoder:
    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None) -> None:
        self.vocab, self.lexicon = vocab, lexicon
        self.inner: dict[str, bytes] = {}  # ids of what follows a space, the space with it
        self.first: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # inner's last generation: what is met again moves on, the rest is forgotten

    def _words(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode("utf-8") for w in words]
        place = self.lexicon.places(raw) if self.lexicon else np.full(len(raw), -1)
        out, short = {}, self.vocab.merge_short
        for w, r, p in zip(words, raw, place.tolist()):
            if p >= 0:
                out[w] = self.lexicon.ids[self.lexicon.offsets[p] : self.lexicon.offsets[p + 1]].tobytes()
            else:
                out[w] = _packed(short(r) if len(r) <= SCAN else self.vocab.merge(r))
        return out

    def _learn(self, inner: list[str], first: list[str]) -> None:
        plain = [c for c in inner if c.isalpha()]  # letters alone are one word
        split = [(_SPLIT.findall(" " + c), self.inner, c) for c in inner if not c.isalpha()] + [(_SPLIT.findall(c), self.first, c) for c in first]
        words = dict.fromkeys(" " + c for c in plain)
        words.update(dict.fromkeys(w for ws, _, _ in split for w in ws))
        ids = self._words(list(words))
        self.inner.update((c, ids[" " + c]) for c in plain)
        for ws, held, c in split:
            held[c] = b"".join([ids[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers.

        No word of the pattern crosses a space before something else than white space, so texts are cut there and
        the pieces kept; texts in which white space follows a space are split by the pattern as a whole.
        """
        if len(self.inner) + len(self.first) > CACHE // 2:
            self.before, self.inner, self.first = self.inner, {}, {}
        cut = self.vocab.cut
        parts: list[list[tuple[str | None, list[str]]]] = []
        inner, first = set(), set()
        for t in texts:
            mine = []
            for i, s in enumerate(cut.split(t or "") if cut and any(x in (t or "") for x in self.vocab.special) else [t or ""]):
                if cut and i % 2:
                    mine.append((s, []))
                elif s:
                    pieces = s.split(" ") if not _TRICKY.search(s) else [s]
                    mine.append((None, pieces))
                    first.add(pieces[0])
                    inner.update(pieces[1:])
            parts.append(mine)
        new = [c for c in inner if c not in self.inner]
        if self.before:
            self.inner.update((c, self.before[c]) for c in new if c in self.before)
            new = [c for c in new if c not in self.before]
        fresh = [c for c in first if c not in self.first]
        if new or fresh:
            self._learn(new, fresh)
        ids, starts = self.inner.__getitem__, self.first.__getitem__
        return [b"".join([np.array([self.vocab.special[s]], "<i4").tobytes() if s is not None else starts(p[0]) + b"".join(map(ids, p[1:])) for s, p in mine]) for mine in parts]


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON) -> list[str]:
    """The `most` most frequent words of all texts, about, in the order of counts and then of words; the same however
    the table is dealt to tasks.

    Tasks count pieces between spaces, each distinct piece of the corpus is split into words once, and words are summed.
    Counts fall into size classes, of which the largest that fit are taken whole and the next one by a hash of its words,
    so that no more than `most` rows reach the driver, whatever the number of tasks, and all that do are wanted.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], ["piece", "n"])

        for b in batches:
            for t in b.column(0):
                pieces.update((t.as_py() or "").split(" "))
            if len(pieces) > COUNTED:
                yield out()
                pieces.clear()
        yield out()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: Counter = Counter()
            for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in [" " + p] if p.isalpha() else _SPLIT.findall(" " + p):
                    out[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["word", "n"])

    pieces = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    words = materialise(pieces.mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    step = F.floor(F.log2("n") * 32).cast("int")  # counts by size, some 2,000 sizes at most, tell where to cut
    held, low, some = 0, None, F.lit(False)
    for size, n in sorted(((r[0], r[1]) for r in words.groupBy(step.alias("size")).count().collect()), reverse=True):
        if held + n > most:
            share = (most - held) / n
            some = (step == size) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000))
            break
        held, low = held + n, size
    found = words.filter(some if low is None else some | (step >= low)).collect()
    drop_materialised(docs.sparkSession, words)
    return [r[0] for r in sorted(found, key=lambda r: (-r[1], r[0]))][:most]


def lexicon(words: list[str], path: str) -> bytes:
    vocab = vocabulary(path)
    return compile_lexicon({w.encode("utf-8"): vocab.merge(w.encode("utf-8")) for w in words})


def _id_lists(raw: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", blob: bytes | None = None) -> DataFrame:
    """(id, ids): for each row of `docs` its ids as array<int>; null and empty texts have none.

    `blob`: a compiled lexicon; by default one is made of the words of these texts. Its size is bounded by LEXICON.
    Special tokens of the vocabulary that stand in a text become their ids, as in the public library. Repeated rows are
    encoded each, texts of any length as a whole; columns other than these two don't matter. An empty table gives an
    empty result.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(blob if blob is not None else lexicon(frequent_words(docs, text_col), path))
    small_batches(spark)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path), Lexicon(shared.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _id_lists(encoder.encode(b.column(1).to_pylist()))], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids; bytes that aren't UTF-8 become the replacement character, null ids the empty text."""
    names = [c for c in encoded.columns if c != to]
    rows = encoded.select(*names)
    at = names.index(ids_col)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(path).bytes_of.__getitem__
        for b in batches:
            texts = [b"".join(map(of, ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else [])).decode("utf-8", "replace") for ids in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, to])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{to}` string")
