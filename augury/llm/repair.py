"""Token ids in grammar-compressed shards.

Documents are encoded in ascending order of id; a file holds the ids of consecutive documents.
Re-Pair works on the ids of one file: count adjacent pairs, give each pair that occurs LEAST_COUNT
times or more a new nonterminal, replace its occurrences, and start again, until no pair
occurs that often. A round takes all such pairs at once. Where two occurrences overlap, the one of
the more frequent pair is replaced; in a run of one pair every second one is, from the left. Every
occurrence that is left shares a symbol with a replaced one, so a later round only counts the pairs
that hold a symbol of the round before.

A file is MAGIC, the length of a header as 8 bytes, the header (JSON: the arrays' types and
lengths), and the arrays one after another: doc_ids, id_valid, doc_tokens, left and right (the
rules), lengths (tokens that each rule expands to), symbols (ids and nonterminals, which start
behind the file's largest id; in 16 bits if they fit), marks (tokens before every MARK-th symbol).
Tokens from any place are decoded from the mark before it on; only that range is read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import release_memory, scratch_path
from augury.llm.files import FILE_TOKENS, deal_files, read_bytes, write_bytes, write_files
from augury.llm.tokens import gather

MAGIC = b"REPAIR2\n"
LEAST_COUNT = 64
MARK = 1024
#: Pairs are first counted by a hash of so many bits; only those of a full bucket are counted exactly.
BUCKET_BITS = 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _frequent(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes that occur at least so often, their counts, places of them in codes, number of the code at each place)."""
    bucket = ((codes * _FACTOR) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    full = np.bincount(bucket, minlength=1 << BUCKET_BITS) >= least
    places = np.flatnonzero(full[bucket])
    some = codes[places]
    ordered = np.sort(some)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(ordered)))
    often = counts >= least
    found, counts = ordered[first[often]], counts[often]
    if not len(found):
        return found, counts, places[:0], places[:0]
    # The code of each place by its bucket; the few codes that share one with another are searched.
    own = ((found * _FACTOR) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    slot = np.zeros(1 << BUCKET_BITS, np.int32)
    slot[own] = np.arange(len(found), dtype=np.int32)
    number = slot[bucket[places]]
    hidden = slot[own] != np.arange(len(found))
    if hidden.any():
        shared = np.zeros(1 << BUCKET_BITS, bool)
        shared[own[hidden]] = True
        search = np.flatnonzero(shared[bucket[places]])
        number[search] = np.minimum(np.searchsorted(found, some[search]), len(found) - 1)
    hit = found[number] == some
    return found, counts, places[hit], number[hit]


def _chosen(places: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the occurrences (ascending places, each of two symbols) are replaced: a maximal set without overlaps."""
    out = np.zeros(len(places), bool)
    left = np.arange(len(places))
    for last in (False, False, True):
        at, w = places[left], weight[left] if not last else np.zeros(len(left), np.int64)
        joined = np.diff(at) == 1
        lower = np.zeros(len(left), bool)  # beside a heavier one
        lower[1:] |= joined & (w[1:] < w[:-1])
        lower[:-1] |= joined & (w[:-1] < w[1:])
        top = np.flatnonzero(~lower)
        if not len(top):
            continue
        # Tops side by side have one weight: every second one of a run.
        starts = np.concatenate(([True], np.diff(at[top]) != 1))
        run = np.maximum.accumulate(np.where(starts, np.arange(len(top)), 0))
        taken = left[top[(np.arange(len(top)) - run) % 2 == 0]]
        out[taken] = True
        free = np.ones(len(left), bool)
        position = np.searchsorted(left, taken)
        free[position] = False
        for side in (-1, 1):
            beside = position + side
            inside = (beside >= 0) & (beside < len(left))
            beside, own = beside[inside], position[inside]
            free[beside[np.abs(at[beside] - at[own]) == 1]] = False
        left = left[free]
        if not len(left):
            break
    return out


def compress(ids: np.ndarray, least: int = LEAST_COUNT, first_rule: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as n x 2, tokens that each rule expands to). Symbols from first_rule on are nonterminals."""
    now = ids.astype(np.uint32)
    first_rule = int(now.max(initial=0)) + 1 if first_rule is None else first_rule
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32)
    newest = 0  # only pairs with a symbol from here on can have become frequent
    while len(now) > 1:
        if newest:
            new = np.flatnonzero(now >= newest)
            beside = np.zeros(len(now) + 1, bool)
            beside[new] = True
            beside[new + 1] = True  # at k: the pair (k - 1, k)
            at = np.flatnonzero(beside[1:-1])
            left, right = now[at], now[at + 1]
        else:
            left, right = now[:-1], now[1:]
        found, counts, places, number = _frequent((left.astype(np.uint64) << np.uint64(32)) | right, least)
        if not len(found):
            break
        places = at[places] if newest else places
        chosen = _chosen(places, counts[number])
        places, number = places[chosen], number[chosen]
        is_used = np.bincount(number, minlength=len(found)) > 0
        used, rule = np.flatnonzero(is_used), (np.cumsum(is_used) - 1)[number]
        pair = np.stack([found[used] >> np.uint64(32), found[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        newest = first_rule + len(lengths)
        now[places] = (newest + rule).astype(np.uint32)
        keep = np.ones(len(now), bool)
        keep[places + 1] = False
        now = now[keep]
        size = np.concatenate((lengths, [1])).astype(np.uint32)  # the last entry is an id's
        of = np.where(pair < first_rule, len(lengths), pair.astype(np.int64) - first_rule)
        lengths = np.concatenate((lengths, size[of].sum(axis=1, dtype=np.uint32)))
        rules.append(pair)
    return now, np.concatenate(rules), lengths


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that symbols stand for, unfolded level by level; only rules that are met are read."""
    now = symbols.astype(np.uint32)
    while True:
        ruled = now >= first_rule
        where = np.flatnonzero(ruled)
        if not len(where):
            return now
        pair = rules[now[where] - np.uint32(first_rule)]
        out = np.empty(len(now) + len(where), np.uint32)
        at = np.arange(len(now)) + np.cumsum(ruled) - ruled
        out[at] = now
        out[at[where]] = pair[:, 0]
        out[at[where] + 1] = pair[:, 1]
        now = out


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """What expand gives, for many symbols: every rule is unfolded once."""
    if not len(rules):
        return symbols.astype(np.uint32)
    flat, ruled = expand(rules.reshape(-1), rules, first_rule), symbols >= first_rule
    size = np.ones(len(symbols), np.int64)
    rule = symbols[ruled].astype(np.int64) - first_rule
    size[ruled] = lengths[rule]
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    whole = np.ones(len(out), bool)
    whole[begin[~ruled]] = False
    out[~whole] = symbols[~ruled]
    out[whole] = gather(flat, (np.cumsum(lengths, dtype=np.int64) - lengths)[rule], size[ruled])
    return out


def pack_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, rules, lengths = compress(ids)
    first_rule = int(ids.max(initial=0)) + 1
    of = np.where(symbols < first_rule, len(lengths), symbols.astype(np.int64) - first_rule)
    size = np.append(lengths, np.uint32(1)).astype(np.int64)[of]
    kind = "<u2" if first_rule + len(rules) <= 1 << 16 else "<u4"
    arrays = {
        "doc_ids": np.array([d if d is not None else 0 for d in doc_ids], "<i8"),
        "id_valid": np.array([d is not None for d in doc_ids], np.uint8),
        "doc_tokens": np.asarray(sizes).astype("<u4"),
        "left": rules[:, 0].astype(kind),
        "right": rules[:, 1].astype(kind),
        "lengths": lengths.astype("<u4"),
        "symbols": symbols.astype(kind),
        "marks": (np.cumsum(size) - size)[::MARK].astype("<u8"),
    }
    head = json.dumps({"first_rule": first_rule, "mark": MARK, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(v.tobytes() for v in arrays.values())


class File:
    """A file behind read(start, size); what is read is what is asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        begin = read(0, len(MAGIC) + 8)
        if not begin.startswith(MAGIC):
            raise ValueError("not a grammar-compressed token file")
        at = len(begin)
        n = int.from_bytes(begin[len(MAGIC) :], "little")
        head, at = json.loads(read(at, n)), at + n
        self.first_rule, self.mark, self._read = head["first_rule"], head["mark"], read
        self._where: dict[str, tuple[int, np.dtype, int]] = {}
        for name, kind, size in head["arrays"]:
            self._where[name] = (at, np.dtype(kind), size)
            at += size * np.dtype(kind).itemsize

    def array(self, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        at, kind, size = self._where[name]
        stop = size if stop is None else min(stop, size)
        n = max(0, stop - start)
        return np.frombuffer(self._read(at + start * kind.itemsize, n * kind.itemsize), kind, n)

    def rules(self) -> np.ndarray:
        return np.stack([self.array("left"), self.array("right")], axis=1).astype(np.uint32)

    def tokens(self) -> np.ndarray:
        return expand_all(self.array("symbols"), self.rules(), self.array("lengths"), self.first_rule)

    def decode(self, start: int, length: int) -> np.ndarray:
        """The ids from `start` on; symbols before the nearest mark are neither read nor unfolded."""
        marks = self.array("marks")
        if not len(marks) or length < 1:
            return np.zeros(0, np.uint32)
        k = max(0, int(np.searchsorted(marks, start, "right")) - 1)
        last = int(np.searchsorted(marks, start + length, "left"))
        skip = start - int(marks[k])
        return expand(self.array("symbols", k * self.mark, last * self.mark), self.rules(), self.first_rule)[skip : skip + length]


def open_file(path: str) -> File:
    return File(lambda start, size: read_bytes(path, start, size))


def of_bytes(data: bytes) -> File:
    return File(lambda start, size: data[start : start + size])


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, tokenizer: str | None = None, end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files and returns their manifest: part, file, path, n_docs, n_tokens, n_bytes, first_token.

    first_token is the number of ids in all files before. Ids must be integers; null ids come
    first, rows with one id are in the order of a hash of their text; a null text is the end id
    alone. Token ids may be anything below 2^31, end_id included. An empty table gives no file.
    Other columns are not read.
    """
    folder = folder or scratch_path(docs.sparkSession, "repair")

    def save(path: str, ids: list, sizes: np.ndarray, tokens: np.ndarray) -> tuple[int, dict]:
        write_bytes(path, data := pack_file(ids, sizes, tokens))
        return len(data), {}

    manifest = write_files(docs, id_col, text_col, folder, end_id, save, tokenizer=tokenizer, file_tokens=file_tokens)
    # First over the parts, of which there are as many as tasks, then over the files of each.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", ahead.alias("ahead"))
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(F.broadcast(parts), "part").withColumn("first_token", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("ahead")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit), read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first_token in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = read_bytes(path)
                file = of_bytes(data)
                ids = file.tokens().astype("<u4", copy=False)
                doc_ids, valid = file.array("doc_ids"), file.array("id_valid")
                ends = np.concatenate(([0], np.cumsum(file.array("doc_tokens"), dtype=np.int64)))
                for at in range(0, len(doc_ids), 2048):
                    e = ends[at : at + 2049]
                    flat = pa.py_buffer(np.ascontiguousarray(ids[e[0] : e[-1]]))
                    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(e) - 1, [None, pa.py_buffer((4 * (e - e[0])).astype(np.int64)), flat])
                    columns = [pa.array(doc_ids[at : at + 2048], mask=valid[at : at + 2048] == 0), pa.array(e[:-1] + first_token), pa.array(np.diff(e)), made.cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
                release_memory()

    dealt = deal_files(manifest.select("path", "first_token", "n_bytes"))
    return dealt.select("path", "first_token").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
