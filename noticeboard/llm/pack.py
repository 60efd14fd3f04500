"""Best-fit packing of documents into token sequences, by a linear grouping scheme.

Pieces are counted by length; the plan is made from those counts alone (at most ``capacity`` numbers, whatever the
corpus' size). Lengths from a threshold up are sorted and cut into groups of equal cardinality, and each length is
rounded up to its group's largest. A few-size problem is left: its configurations (which multiset of groups fills a
sequence) are optimised by column generation. Then the actual pieces are substituted, and the small ones go best-fit,
longest first, where they leave least room. All steps handle runs of like sequences at once. Last, each piece finds
its place by its rank among the pieces of its length.

Defined cases: a null or empty text is the end token alone; repeated rows and rows of one id are pieces of their own; a
row with a null id is packed like any other; a very long text is tokenized whole, in one task; no pieces, no sequences; other columns play no part.

Of the plans for large lengths from a third and from a half of the capacity, the one of fewest sequences is taken:
rounding costs least where the small pieces can fill what it leaves, and how many small ones there are is the
corpus' affair.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.llm.common import cache, ship, slices, stored, table

CAPACITY, END, GROUPS, REMEMBERED = 2048, 0, 32, 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- tokens


class TokenBytes(dict):
    """A word -> its ids, little-endian, as they are after a space. Remembers the first `limit` words."""

    def __init__(self, encode: Callable[[str], list[int]], limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(f" {word}"), "<u4").tobytes()
        if len(self) < self.limit:
            self[word] = ids
        return ids


class Encoder:
    """Ids as the byte-level BPE file gives them (add_special_tokens=False), many times faster on prose.

    Texts are cut before each single space between other characters, where this kind of tokenizer always cuts, and
    the words' ids are remembered. Texts with other runs of white space, with characters beyond Latin letters or with
    the text of a special token go to the tokenizer whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        pre, bpe = spec["pre_tokenizer"] or {}, spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and spec["normalizer"] is None and bpe["type"] == "BPE" and not bpe.get("ignore_merges") and not bpe.get("dropout")
        self.odd = re.compile(r"[^\t\n\r -~ -ɏ]|[\s] " if usual else "")
        if usual:
            chars = _byte_characters()
            ranks = {bytes(chars[c] for c in piece): i for piece, i in bpe["vocab"].items() if all(c in chars for c in piece)}
            split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.quick = tiktoken.Encoding("file", pat_str=split, mergeable_ranks=ranks, special_tokens={})
            self.words = TokenBytes(self.quick.encode_ordinary, remembered)

    def __call__(self, text: str) -> bytes:
        if self.odd.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.quick.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


def _byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    return cache(f"encoder {path}", lambda: Encoder(path))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and task, nth: its number among the task's pieces of its length."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task, last = encoder(tokenizer), Counter(), TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        for b in (part for whole in batches for part in slices(whole)):
            rows, at = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = memoryview((encode(text) if text else b"") + last)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            if rows:
                k, start, length, crc, tasks, nth = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, tasks, nth))], names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, nth bigint")


# ---- the plan


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[float, np.ndarray]]:
    """Fractional optimum of the few-size problem: how many sequences of which configuration (items of each size)."""
    s, d, m = np.array(sizes), np.array(demand, float), len(sizes)
    basis = np.diag((capacity // s).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)  # each sequence costs 1
        new = _dearest(s, price, capacity)
        if price @ new <= 1 + 1e-7:
            break
        step, x = inverse @ new, inverse @ d
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    return [(float(x), basis[:, j].astype(int)) for j, x in enumerate(np.linalg.solve(basis, d)) if x > 1e-9]


def _dearest(s: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest total price that fits."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(s)
    s_up, p_up = s[order], price[order]
    for c in range(int(s_up[0]), capacity + 1):
        k = int(np.searchsorted(s_up, c, side="right"))
        gain = best[c - s_up[:k]] + p_up[:k]
        j = int(gain.argmax())
        best[c], taken[c] = (gain[j], j) if gain[j] > best[c - 1] else (best[c - 1], -1)
    out, c = np.zeros(len(s)), capacity
    while c >= s_up[0]:
        if taken[c] < 0:
            c -= 1
        else:
            out[order[taken[c]]] += 1
            c -= int(s_up[taken[c]])
    return out


class Plan:
    """Sequences in runs: `n` sequences from number `base` on, alike in the lengths they hold."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, small: int = CAPACITY // 3, groups: int = GROUPS):
        self.capacity, self.next_rank, self.sequences = capacity, defaultdict(int), 0
        self.places: list[tuple[int, int, int, int, int]] = []  # length, first rank, how many, first sequence, offset
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs (base, n)
        left = Counter({k: n for k, n in counts.items() if n})
        if left[capacity]:
            self._put(self._open(left[capacity]), left.pop(capacity), 0, capacity)
        left.pop(capacity, None)
        large = sorted((k for k in left if k >= small), reverse=True)
        if large:
            self._grouped({k: left.pop(k) for k in large}, groups)
        for k in sorted(left, reverse=True):
            self._best_fit(k, left[k])

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, base: int, n: int, offset: int, length: int) -> None:
        self.places.append((length, self.next_rank[length], n, base, offset))
        self.next_rank[length] += n

    def _free(self, free: int, base: int, n: int) -> None:
        if n and free:
            self.room[free].append((base, n))

    def _grouped(self, counts: dict[int, int], groups: int) -> None:
        total = sum(counts.values())
        per = -(-total // groups)
        queues: list[list[list[int]]] = [[]]
        room = per
        for k in sorted(counts, reverse=True):
            n = counts[k]
            while n:
                if not room:
                    queues.append([])
                    room = per
                take = min(n, room)
                queues[-1].append([k, take])
                n, room = n - take, room - take
        rounded: dict[int, list[list[int]]] = {}
        for q in queues:  # groups that round up to the same length are one size
            rounded.setdefault(q[0][0], []).extend(q)
        sizes = sorted(rounded, reverse=True)
        left = np.array([sum(n for _, n in rounded[s]) for s in sizes])
        for x, config in sorted(configurations(sizes, left.tolist(), self.capacity), key=lambda c: -c[0]):
            if n := min([int(x + 1e-6), *(int(left[g] // a) for g, a in enumerate(config) if a)]):
                self._fill([rounded[sizes[g]] for g in np.flatnonzero(config) for _ in range(config[g])], n)
                left -= n * config
        for s in sizes:  # what rounding the counts down has left over
            for k, n in rounded[s]:
                if n:
                    self._best_fit(k, n)

    def _fill(self, slots: list[list[list[int]]], n: int) -> None:
        """n sequences of one configuration get actual pieces, the next of each slot's group."""
        base = self._open(n)
        ends: list[list[int]] = [[base, n, 0]]  # runs: base, n, tokens so far
        for queue in slots:
            after = []
            for run_base, run_n, used in ends:
                while run_n:
                    while not queue[0][1]:
                        queue.pop(0)
                    k = min(run_n, queue[0][1])
                    length = queue[0][0]
                    self._put(run_base, k, used, length)
                    after.append([run_base, k, used + length])
                    queue[0][1] -= k
                    run_base, run_n = run_base + k, run_n - k
            ends = after
        for run_base, run_n, used in ends:
            self._free(self.capacity - used, run_base, run_n)

    def _best_fit(self, length: int, n: int) -> None:
        """n pieces of one length, each where it leaves least room; a new sequence where it fits nowhere."""
        while n:
            free = next((r for r in range(length, self.capacity) if self.room.get(r)), None)
            if free:
                base, have = self.room[free].pop()
            else:
                free, have = self.capacity, -(-n // (self.capacity // length))
                base = self._open(have)
            each = min(free // length, n)  # the tightest sequence stays the tightest until it is full
            whole = min(have, n // each)
            for j in range(each):
                self._put(base, whole, self.capacity - free + j * length, length)
            self._free(free - each * length, base, whole)
            n -= whole * each
            rest_base, rest = base + whole, have - whole
            if rest and 0 < n < each:
                for j in range(n):
                    self._put(rest_base, 1, self.capacity - free + j * length, length)
                self._free(free - n * length, rest_base, 1)
                rest_base, rest, n = rest_base + 1, rest - 1, 0
            self._free(free, rest_base, rest)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """For lookups: length and first rank as one sorted key, then first sequence and offset."""
        p = np.array(self.places or [(0, 0, 0, 0, 0)], np.int64)
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        return (p[:, 0] << 48) + p[:, 1], p[:, 1], p[:, 3], p[:, 4]


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    return min((Plan(counts, capacity, small, groups) for small in (capacity // 3, capacity // 2 + 1)), key=lambda p: p.sequences)


def packed(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document.

    One pass tokenizes and writes the pieces (without ids) to the shared folder. The driver gets a count for each
    length. Ranks come from counts by task and length, so a length that a third of all pieces share is no hot key. The
    plan that is broadcast is in runs of equal pieces, whose number follows from capacity and groups: 13,000 for 20,000
    pieces of lognormal lengths, 19,000 for two billion.
    """
    all_pieces = stored(pieces(docs, tokenizer=tokenizer or default_tokenizer(), id_col=id_col, text_col=text_col, capacity=capacity, end=end), "pieces")
    by_task = all_pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    keys, ranks, sequences, offsets = best_plan(counts, capacity, groups).arrays()
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("task", "length", F.coalesce("before", F.lit(0)).alias("before"))
    plan = docs.sparkSession.sparkContext.broadcast((keys, ranks, sequences, offsets))
    ranked = all_pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:5]) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, sequences, offsets = plan.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], names=names)

    return ranked.mapInArrow(place, schema)


def sequences(docs: DataFrame, places: DataFrame, *, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id and its token ids, for training: pieces are tokenized again and put together (capacity ids at most each)."""
    path, spark = tokenizer or default_tokenizer(), docs.sparkSession
    ship(spark)
    cuts = places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    both = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(cuts, "doc_id").select("text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            rows = []
            for text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer((encode(text) if text else b"") + np.array([end], "<u4").tobytes(), "<u4")
                rows += [(c["sequence_id"], c["offset"], ids[c["start"] : c["start"] + c["length"]].astype(np.int32)) for c in cuts]
            if rows:
                s, o, i = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(o, pa.int64()), pa.array(i, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    parts = both.mapInArrow(run, "sequence_id bigint, offset bigint, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))


def op5(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
