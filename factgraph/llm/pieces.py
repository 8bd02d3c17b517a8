"""Operator 10, SentencePiece encoding and decoding: a shared-prefix forward pass.

A task takes the distinct marked words of its texts in sorted order, which is a depth-first walk of
their trie: what two neighbours have in common as a prefix is scored once.  For a unigram model the
state of a prefix is its best score and the piece that ends there (Viterbi).  A model of merges
(BPE) has no scores to add; there the state is the last piece of the prefix's encoding, which is the
one piece whose predecessor's encoding it can follow without another merge coming first.  Both give
exactly the ids of the library for the same model file.

The model file is read where it is; it is never trained or copied.

Defined cases: a null or empty text has no ids; a text is encoded whole; characters outside the
model become byte pieces, or the unknown id if the model has none; the mark character itself counts
as a space, as in the library; equal rows get equal results; an empty table gives an empty result.
Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._words import chunks, tidied

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Distinct words a worker remembers before it starts anew; bounds memory, never the result.
REMEMBERED = 300_000
_RUN = re.compile(f"{MARK} (?={MARK})")
_models: dict[str, Pieces] = {}


class Pieces:
    """A model file, with encoding of sorted words and decoding."""

    def __init__(self, name: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        model = proto.ModelProto()
        with open(name, "rb") as f:
            model.ParseFromString(f.read())
        self.load(model)

    def load(self, model) -> None:
        spec, norm = model.trainer_spec, model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only models without a normalisation of their own are supported")
        if spec.model_type not in (1, 2) or any(p.type == 4 for p in model.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.merges, self.prefix = spec.model_type == 2, norm.add_dummy_prefix
        self.follows = functools.lru_cache(400_000)(self._fits)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.pieces = [p.piece for p in model.pieces]
        self.raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type == 1 else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in model.pieces]
        self.four = [i.to_bytes(4, "little") for i in range(len(model.pieces))]
        #: Lengths of the pieces that end with three characters, longest first, then those of shorter pieces.
        lengths: dict[str, set[int]] = {}
        for x in self.ids:
            if len(x) > 2:
                lengths.setdefault(x[-3:], {1, 2}).add(len(x))
        self.lengths = {x: tuple(sorted(n, reverse=True)) for x, n in lengths.items()}
        self.worst = np.float32(min((self.score[i] for i in self.ids.values()), default=0.0)) - np.float32(10)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that cross a space are not supported")
        self.lone = {c for c in "\n\t" if not any(c in p for p in self.ids)}
        self.known: dict[str, bytes] = {"": b""}
        self.spines: dict[tuple[int, bool], list[tuple[str, float]]] = {}

    # one word -------------------------------------------------------------------------------

    def merged(self, word: str, whole: list | None = None) -> list[str]:
        """Merges in order of score, the leftmost first: the definition, for short strings and runs.

        whole: gets the two parts of each merge.
        """
        part, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        ids, score, queue = self.ids, self.score, []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(part) and (k := ids.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-score[k], i, part[i], part[j]))

        for i in range(len(part)):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            if part[i] != a or (j := after[i]) >= len(part) or part[j] != b:
                continue
            if whole is not None:
                whole.append((a, b))
            part[i], part[j], after[i] = a + b, "", after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in part if x]

    def spine(self, k: int, right: bool) -> list[tuple[str, float]]:
        """The parts of piece k that at some time stand at its right (left) edge, and when each is merged away.

        Time is the order of merges, that is minus their score.  Empty if merges do not make the piece.
        """
        if (out := self.spines.get((k, right))) is None:
            out, x, end = [], self.pieces[k], float("inf")
            while True:
                out.append((x, end))
                if len(x) == 1:
                    break
                steps: list[tuple[str, str]] = []
                if self.merged(x, steps) != [x]:
                    out = []
                    break
                end = -self.score[self.ids[x]]
                x = steps[-1][right]
                if len(x) > 1 and -self.score[self.ids[x]] >= end:
                    raise ValueError("merges out of order are not supported")
            self.spines[k, right] = out
        return out

    def _fits(self, a: int, b: int) -> bool:
        """Whether piece b can follow piece a: no merge across their border would come before their own.

        A merge of two edges comes first if both still stand at its time; of equal merges the left one.
        """
        ids, score = self.ids, self.score
        right = self.spine(b, False)
        for u, gone in self.spine(a, True):
            for v, off in right:
                k = ids.get(u + v)
                if k is not None and -score[k] < gone and -score[k] <= off:
                    return False
        return True

    def _outside(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]

    # sorted words ---------------------------------------------------------------------------

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words in sorted order; the states of a common prefix are kept from word to word.

        done[i] holds the ids of the first i characters, last[i] the last of them, or -1 for a character
        outside the model; best[i] is the score of the prefix (unigram).
        """
        get, raw, lengths, follows, short = self.ids.get, self.four, self.lengths.get, self.follows, (2, 1)
        done, last, best = [b""], [-1], [np.float32(0)]
        old = ""
        for word in words:
            n = min(len(old), len(word))
            i = 0
            while i < n and old[i] == word[i]:
                i += 1
            del done[i + 1 :], last[i + 1 :], best[i + 1 :]
            for end in range(i + 1, len(word) + 1):
                at, piece = end - 1, -1
                if self.merges:
                    for n in lengths(word[end - 3 : end], short) if end > 2 else short:
                        if n <= end and (k := get(word[end - n : end])) is not None:
                            before = last[end - n]
                            if follows(before, k) if before != -1 else self.spine(k, False):
                                at, piece = end - n, k
                                break
                else:
                    top, found = best[end - 1] + self.worst, False
                    for n in lengths(word[end - 3 : end], short) if end > 2 else short:
                        if n <= end and (k := get(word[end - n : end])) is not None:
                            new = best[end - n] + np.float32(self.score[k])
                            if not found or new > top:
                                at, piece, top, found = end - n, k, new, True
                    best.append(top)
                if piece >= 0:
                    done.append(done[at] + raw[piece])
                elif self.bytes or end == 1 or last[end - 1] >= 0:
                    done.append(done[at] + b"".join([raw[x] for x in self._outside(word[at])]))
                else:  # unknown characters in a row are one unknown id
                    done.append(done[at])
                last.append(piece)
            old = word
            yield word, done[-1]

    def _remember(self, words: set[str]) -> None:
        plain = sorted(x for x in words if not x.startswith(MARK * 2))
        self.known.update(self.walk(plain))
        mark = self.four[self.ids[MARK]] if MARK in self.ids else None
        for word in words.difference(plain):  # spaces in a row
            rest = word.lstrip(MARK)
            run = len(word) - len(rest)
            if not self.merges:
                ids = next(self.walk([word]))[1]
            else:
                ids = next(self.walk([MARK + rest]))[1] if rest else b""
                alone = mark is not None and ids.startswith(mark)
                lead = self.merged(MARK * (run if alone or not rest else run - 1))
                ids = b"".join([self.four[self.ids[p]] for p in lead]) + (ids[4:] if alone else ids)
            self.known[word] = ids

    # texts ----------------------------------------------------------------------------------

    def units(self, text: str | None) -> list[str]:
        """Marked words; no piece crosses from one to the next."""
        if not text:
            return []
        s = (" " if self.prefix else "") + text.replace(MARK, " ")
        s = s.replace(" ", f" {MARK}")
        for c in self.lone:
            s = s.replace(c, f" {c} ")
        if f"{MARK} {MARK}" in s:
            s = _RUN.sub(MARK, s)
        return s.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian uint32 bytes."""
        parts = [self.units(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        if new := {x for words in parts for x in words if x not in known}:
            self._remember(new)
        return [b"".join([known[x] for x in words]) for words in parts]

    def forget(self) -> None:
        """Drops remembered words; what is known about pairs of pieces stays."""
        self.known = {"": b""}

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def model(name: str) -> Pieces:
    if name not in _models:
        _models[name] = Pieces(name)
    return _models[name]


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_name: str = MODEL) -> DataFrame:
    """doc_id and the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for batch in batches:
            for c in chunks(batch, "text", 1 << 20):
                raw = m.encode(c.column("text").to_pylist())
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
                ids = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids)], ["doc_id", "ids"])
        m.forget()

    return _two(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_name: str = MODEL) -> DataFrame:
    """doc_id and the text of each list of ids; null ids give a null text."""
    two = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for batch in batches:
            ids = batch.column("ids")
            for a in range(0, batch.num_rows, 256):
                texts = [m.decode(x.values.to_pylist()) if x.is_valid else None for x in ids.slice(a, 256)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 256), pa.array(texts, pa.string())], ["doc_id", "text"])

    return two.mapInArrow(tidied(run), "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_name: str = MODEL) -> DataFrame:
    """Per document: number and crc32 of its ids, and the digest and length of what they decode to."""
    docs = _two(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for batch in batches:
            for c in chunks(batch, "text", 1 << 20):
                rows = []
                for raw in m.encode(c.column("text").to_pylist()):
                    text = m.decode(np.frombuffer(raw, "<u4").tolist())
                    rows.append((len(raw) // 4, zlib.crc32(raw), hashlib.sha256(text.encode()).hexdigest(), len(text)))
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                    ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "decoded_chars"],
                )
        m.forget()

    return docs.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, decoded_chars long")
