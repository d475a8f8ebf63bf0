"""Hierarchical multi-length packing of tokenised documents.

A document's ids (with the end id) are cut into whole windows of the longest tier; what is left is routed to the
smallest tier that holds it. Every tier packs its own pieces: a piece opens a window of its tier, and the gap is filled
from shorter tiers: by the piece that closes it exactly, if one waits; else by the longest that fits among what a tier
can't close itself (ends of pieces that were cut) and the shortest tier; else by a cut from the tier's own longest piece.
Windows are powers of two and leave full, so nothing is padded; only a task's last ids, fewer than one window of each
tier, are cut into powers of two.

Windows of a tier form steps of `STEP` ids. `POOL` steps' windows are dealt together, in the order of their load, the
sum of the squared lengths of their pieces (what attention costs), in rounds of one window to each step, the heaviest to
the step that has least: steps have equal ids, and of a pool's steps the loads differ by no more than the largest window's. Every task packs what
it reads, in the order read, and holds a bounded number of pieces, so no document moves between executors and a lost task
makes the same windows again. A task leaves one short step a tier at most.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import PATTERN, vocabulary
from .common import small_batches

TIERS = (1024, 512, 256, 128)
#: Ids in a step.
STEP = 8192
#: Steps that are balanced together.
POOL = 16
#: Pieces that wait for gaps, in all tiers.
WAITING = 2048
END_ID = 0
_LONG = re.compile(r"\S{400}|\s{400}")


class Encode:
    """Ids of texts; very long words go to the library whose merging doesn't slow down with their square."""

    def __init__(self, path: str) -> None:
        v = vocabulary(path)
        self.special = v.special
        self.fast = None
        if all(v.bytes_of[i] for i in range(len(v.ids))) and all(i == r + 256 for r, i in v.merges.values()):
            self.fast = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast is None or _LONG.search(text):
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode(text, allowed_special="all") if any(s in text for s in self.special) else self.fast.encode_ordinary(text)
        return np.array([*ids, END_ID], dtype="<u4")


class Waiting:
    """Pieces by length, oldest first among equals."""

    def __init__(self) -> None:
        self.of: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []  # those in use, sorted
        self.count = 0

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        if n not in self.of:
            self.of[n] = []
            insort(self.lengths, n)
        self.of[n].append(piece)
        self.count += 1

    def take(self, n: int) -> tuple:
        pieces = self.of[n]
        piece = pieces.pop(0)
        self.count -= 1
        if not pieces:
            del self.of[n]
            self.lengths.pop(bisect_right(self.lengths, n) - 1)
        return piece

    def longest(self, most: int) -> int:
        """The largest length up to `most`; 0 if there is none."""
        i = bisect_right(self.lengths, most)
        return self.lengths[i - 1] if i else 0


class Packer:
    """add() takes documents, rows collects pieces: (document, start, ids, length, ids of the document, window number, offset, tier, step)."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> None:
        self.base, self.tiers, self.step = base, tiers, step
        self.own = [Waiting() for _ in tiers]  # pieces of documents, by tier
        self.ends = Waiting()  # what cuts have left
        self.pool: list[list[list[tuple]]] = [[] for _ in tiers]  # windows that wait for a step
        self.windows, self.steps, self.kept, self.rows = 0, 0, 0, []

    def waiting(self) -> int:
        return sum(w.count for w in self.own) + self.ends.count

    def _emit(self, pieces: list[tuple], tier: int | None, step: int | None) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids.tobytes(), len(ids), total, self.base + self.windows, at, tier, step))
            at += len(ids)
        self.windows += 1

    def _window(self, pieces: list[tuple], tier: int) -> None:
        self.pool[tier].append(pieces)
        if len(self.pool[tier]) * self.tiers[tier] == POOL * self.step:
            self._steps(tier)

    def _steps(self, tier: int) -> None:
        """Deals a tier's windows to steps; the last step may be short."""
        room = self.step // self.tiers[tier]
        found = sorted(self.pool[tier], key=lambda w: -load(w))
        whole = len(found) // room
        short = found[whole * room :]
        steps: list[list[list[tuple]]] = [[] for _ in range(whole)]
        total = [0] * whole
        for at in range(0, whole * room, max(1, whole)):  # a window to each step: the heaviest to the one that has least
            for i, w in zip(sorted(range(whole), key=total.__getitem__), found[at : at + whole]):
                steps[i].append(w)
                total[i] += load(w)
        for windows in [*steps, *([short] if short else [])]:
            for w in windows:
                self._emit(w, self.tiers[tier], self.steps)
            self.steps += 1
        self.pool[tier] = []

    def add(self, doc, ids: np.ndarray) -> None:
        longest = self.tiers[0]
        whole = len(ids) // longest * longest
        for start in range(0, whole, longest):
            self._window([(doc, start, ids[start : start + longest], len(ids))], 0)
        if whole < len(ids):
            self.own[self._tier(len(ids) - whole)].put((doc, whole, ids[whole:], len(ids)))
        if self.waiting() > WAITING:
            self._pack(WAITING // 4)

    def _tier(self, n: int) -> int:
        return max(i for i, w in enumerate(self.tiers) if n <= w)

    def _cut(self, piece: tuple, n: int) -> tuple:
        doc, start, ids, total = piece
        if n < len(ids):
            self.ends.put((doc, start + n, ids[n:], total))
        return doc, start, ids[:n], total  # all of a shorter piece

    def _fill(self, gap: int, tier: int) -> list[tuple] | None:
        """Pieces that fill the gap of a window of this tier; None if too little waits there."""
        shorter = self.own[tier + 1 :]
        least = self.own[-1]
        if gap and self.ends.longest(1 << 30) == 0 and not self.own[tier].count and not any(w.count for w in shorter):
            return None
        out = []
        while gap:
            exact = next((w for w in (self.ends, *reversed(shorter)) if gap in w.of), None)
            if exact:
                out.append(exact.take(gap))
                break
            best, held = max((self.ends.longest(gap), 1), (least.longest(gap) if least.count > self.kept else 0, 0))
            if best:
                out.append((self.ends if held else least).take(best))
                gap -= best
                continue
            source = next((w for w in (self.ends, self.own[tier], *reversed(shorter)) if w.count), None)
            if source is None:
                for piece in out:
                    self.ends.put(piece)
                return None
            out.append(self._cut(source.take(source.longest(1 << 30)), gap))
            gap -= len(out[-1][2])
        return out

    def _pack(self, keep: int) -> None:
        """Each tier in turn closes windows, a share of what it holds, until `keep` pieces wait or none can be filled."""
        share = [w.count * keep // max(1, self.waiting()) for w in self.own]
        self.kept = self.own[-1].count // 2  # of the shortest tier's pieces, for windows of its own
        for tier, window in enumerate(self.tiers):
            own = self.own[tier]
            self.kept = self.kept if tier < len(self.tiers) - 1 else 0
            while own.count > share[tier]:
                head = own.take(own.longest(window))
                more = self._fill(window - len(head[2]), tier)
                if more is None:
                    own.put(head)
                    break
                self._window([head, *more], tier)
        while self.ends.count > max(keep // 4, len(self.tiers)):  # ends that no gap took make windows of their own tier
            head = self.ends.take(self.ends.longest(self.tiers[0]))
            tier = self._tier(len(head[2]))
            more = self._fill(self.tiers[tier] - len(head[2]), tier)
            if more is None:
                self.ends.put(head)
                break
            self._window([head, *more], tier)

    def finish(self) -> None:
        self._pack(0)
        for tier in range(len(self.tiers)):
            self._steps(tier)
        left = [w.take(w.longest(1 << 30)) for w in (*self.own, self.ends) for _ in range(w.count)]
        count = sum(len(p[2]) for p in left)
        longest = self.tiers[0]
        sizes = [longest] * (count // longest) + [1 << b for b in reversed(range(longest.bit_length())) if count % longest >> b & 1]
        for size in sizes:
            pieces, gap = [], size
            while gap:
                doc, start, ids, total = left.pop(0)
                pieces.append((doc, start, ids[:gap], total))
                if gap < len(ids):
                    left.insert(0, (doc, start + gap, ids[gap:], total))
                gap -= len(pieces[-1][2])
            self._emit(pieces, size if size in self.tiers else None, None)


def load(window: list[tuple]) -> int:
    return sum(len(p[2]) ** 2 for p in window)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, ids (little-endian unsigned 32-bit, as binary), length, doc_tokens, sequence_id,
    offset, tier (null for the few windows shorter than all tiers) and step_id (null for a task's last windows).

    Every id of every row lies in one piece; windows are full. A null or empty text is its end id alone. Repeated rows
    and ids, and rows without id, are packed each for itself; texts of any length as a whole. Columns other than these
    two don't matter. An empty table gives no pieces.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    names = [id_col, "start", "ids", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encode(path), TaskContext.get().partitionId()
        packer = Packer(part << 32)
        kind = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * 9
            packer.rows = []
            kinds = [kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[8] = pa.array([None if s is None else (part << 32) + s for s in columns[8]], pa.int64())
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(doc, encode(text.as_py()))
            if packer.rows:
                yield out()
        packer.finish()
        if packer.rows:
            yield out()

    kinds = f"`{id_col}` {dict(rows.dtypes)[id_col]}, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
    return rows.mapInArrow(run, kinds)
