"""Operator 8, packing: shortest-pack-first over the length histogram.

Texts become token ids, ids become pieces of at most one sequence, and the histogram of piece
lengths is packed on the driver: longest lengths first, each into the emptiest packs that exist,
whole groups of equal packs at a time.  The histogram, the patterns and their slots are bounded by
the sequence length, whatever the number of documents.  Patterns meet documents again by rank.

Defined cases: a null or empty text is the end id alone; a text of any length is encoded whole and
cut into full sequences and a rest; special tokens count only as the file writes them, before letters
are lowered; equal rows each get a place of their own; an empty table gives no pieces.  Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, ranked
from ._words import chunks, tidied

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct words a worker remembers before it starts anew; bounds memory, never the result.
REMEMBERED = 250_000
#: Bytes of text encoded at once: each has several arrays, and a chunk looks up each distinct string once.
ENCODED_BYTES = 1 << 20
#: Letters that NFC leaves alone and that lower to one letter each, and signs that are neither letters nor digits.
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIGNS = "!-/:-@[-`{-~"
_letters = re.compile(f"[{_LETTERS}]+").fullmatch
_signs_after = re.compile(f"(.*[{_LETTERS}])([{_SIGNS}]+)", re.DOTALL).fullmatch
_encoders: dict[str, Encoder] = {}


#: The normaliser and the pre-tokeniser of the file in TOKENIZER.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to those of the tokenizer for each text.

    A tokenizer that lowers all letters itself and never joins what stands on two sides of a space gives
    a text the ids of its space-separated strings; nor does it join a letter and signs after it.  Each
    distinct string without such signs is encoded once as long as it is remembered, by the model alone if
    it is made of letters that normalising only lowers.  Strings that hold a special token in
    any case are encoded as they stand, since special tokens are found before letters are lowered.
    Any other tokenizer encodes whole texts.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.model, self.known = Tokenizer.from_file(str(name)), {}
        self.model.no_truncation()
        self.model.no_padding()
        added = self.model.get_added_tokens_decoder()
        self.added = [t.content.lower() for t in added.values()]
        spec = json.loads(self.model.to_str())
        pre = spec["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers", [])
        split = bool(steps) and steps[0].get("pattern") == {"Regex": _WORDS} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        tail = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in steps[1:]]
        plain = all(not (t.normalized or t.single_word or t.lstrip or t.rstrip) and t.content.isascii() and not re.search(r"\s", t.content) for t in added.values())
        self.by_words = spec["normalizer"] == _NORMALIZER and split and tail == [("ByteLevel", False, False)] and plain
        self.merges = self.model.model
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level model
        self.as_chars = {b: b for b in printed} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
        special = [(t.content, k) for k, t in added.items() if t.special]
        self.between = special[0] if special else None

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, word: str) -> bytes:
        """Ids of a word of ``_LETTERS``, which is one word to the pre-tokeniser."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.as_chars)
        ids = [t.id for t in self.merges.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _each(self, words: list[str]) -> list[bytes]:
        """Ids of each word without special tokens: many are encoded at once, with a special token between them."""
        if self.between is None:
            return self._alone(words)
        out: list[bytes] = []
        mark, k = self.between
        for i in range(0, len(words), 5_000):
            some = words[i : i + 5_000]
            ids = np.array(self.model.encode_batch_fast([mark.join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == k)
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True)]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one after the other, and the offsets of the texts among them."""
        column = pc.fill_null(column, "")
        if not self.by_words:
            each = self._alone(column.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in each], dtype=np.int64)])
        lower = pc.ascii_lower(column)
        odd = any(pc.any(pc.match_substring(lower, t)).as_py() for t in self.added)
        words = pc.split_pattern(pc.replace_substring(column if odd else lower, "\n", " "), " ")
        flat = words.flatten()
        if odd:
            small = pc.ascii_lower(flat)
            held = functools.reduce(pc.or_, [pc.match_substring(small, t) for t in self.added])
            flat = pc.if_else(held, flat, small)
        coded = flat.dictionary_encode()
        own, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        if len(known) > REMEMBERED:
            known.clear()
        raw = list(map(known.get, own))
        new = [i for i, x in enumerate(raw) if x is None]
        if odd:
            held = [i for i in new if any(t in own[i].lower() for t in self.added)]
            for i, x in zip(held, self._alone([own[i] for i in held]), strict=True):
                raw[i] = known[own[i]] = x
            new = [i for i in new if raw[i] is None]
        ends = {i: m.groups() for i in new if (m := _signs_after(own[i]))}
        parts = {own[i] for i in new if i not in ends} | {x for two in ends.values() for x in two}
        parts = [x for x in parts if x not in known]
        other = []
        for x in parts:
            if _letters(x):
                known[x] = self._by_model(x.lower())
            else:
                other.append(x)
        known.update(zip(other, self._each(other), strict=True))
        for i in new:
            raw[i] = known[ends[i][0]] + known[ends[i][1]] if i in ends else known[own[i]]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        start = np.cumsum(size) - size
        at = coded.indices.to_numpy().astype(np.int64)
        n = size[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(start[at] - before[:-1], n) + np.arange(before[-1])]
        return ids, before[words.offsets.to_numpy().astype(np.int64)]


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every text: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for c in chunks(batch, "text", ENCODED_BYTES):
                ids, at = enc.encode(c.column("text"))
                rows = np.arange(c.num_rows)
                own = np.full(len(ids) + c.num_rows, end_id, "<u4")  # each text, then the end id
                own[np.arange(len(ids)) + np.repeat(rows, np.diff(at))] = ids
                total = np.diff(at) + 1
                first = at[:-1] + rows
                pieces = -(-total // capacity)
                row = np.repeat(rows, pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(total[row] - start, capacity)
                begin = first[row] + start
                raw = memoryview(own.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                cols = {"doc_id": c.column("doc_id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total[row])}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(own)), pa.int32()), pa.array(own.view("<i4")))
                yield pa.RecordBatch.from_pydict(cols)
        enc.known.clear()

    return two.mapInArrow(tidied(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; every length of the histogram is placed.

    A length goes to the emptiest packs there are, as long as it fits there, else to new packs.
    """
    packs: dict[int, list[tuple[tuple, int]]] = {}  # by fill: (pattern as nested pairs, count)
    fills: list[int] = []
    done: list[tuple[tuple, int]] = []

    def put(fill: int, pattern: tuple, count: int) -> None:
        if fill == capacity:
            done.append((pattern, count))
        elif count:
            if fill not in packs:
                packs[fill] = []
                heapq.heappush(fills, fill)
            packs[fill].append((pattern, count))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1 to {capacity}")
        while left:
            if fills and fills[0] + length <= capacity:
                fill = fills[0]
                pattern, count = packs[fill].pop()
                if not packs[fill]:
                    del packs[fill]
                    heapq.heappop(fills)
                n = min(left, count)
                put(fill, pattern, count - n)
                put(fill + length, (pattern, length), n)
                left -= n
            else:
                most = capacity // length
                for each, n in ((most, left // most), (left % most, 1 if left % most else 0)):
                    if n:
                        pattern = ()
                        for _ in range(each):
                            pattern = (pattern, length)
                        put(each * length, pattern, n)
                left = 0
    done += [x for group in packs.values() for x in group]

    def flat(pattern: tuple) -> tuple[int, ...]:
        out = []
        while pattern:
            pattern, length = pattern
            out.append(length)
        return tuple(reversed(out))

    return [(flat(p), n) for p, n in done]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of every place of every pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            used[length] = rank + count
            out.append((length, rank, rank + count, sequence, offset))
            offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, start and length."""
    spark = pieces.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.write(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = spark.createDataFrame(slots(shortest_pack_first(histogram, capacity)), "_len long, _r0 long, _r1 long, _seq long, _off long")
    placed = ranked(pieces, scratch, ["length"], ["doc_id", "start"], "_rank")
    hit = (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_r0")) & (F.col("_rank") < F.col("_r1"))
    out = placed.join(F.broadcast(places), hit)
    return out.withColumn("sequence_id", F.col("_seq") + F.col("_rank") - F.col("_r0")).withColumn("offset", F.col("_off")).drop("_rank", "_len", "_r0", "_r1", "_seq", "_off")


def padding(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[int, int]:
    """Ids and padding of the packing of a histogram; a sequence that holds a power of two has none."""
    fills = [(sum(p), n) for p, n in shortest_pack_first(histogram, capacity)]
    return sum(f * n for f, n in fills), sum((capacity - f) * n for f, n in fills if f & (f - 1))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
