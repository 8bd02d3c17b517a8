"""Operator 5, substring deduplication: seed and extend.

Seeds are winnowed anchors: of the ``seed``-word runs inside every window of ``window`` words the
one with the least hash.  Equal windows choose equal anchors, so a repeated window always has a
repeated anchor.  Anchors are joined across documents; around each repeated one the match is
extended both ways, to all windows that chose it, for all its occurrences at once: windows with
equal words meet in one group, whose first member (by document, then position) stays and whose
later members are cut.  Adjacent cut windows merge into maximal repeats.  Nothing is paired, so a
passage with thousands of copies costs a row a copy and window.  Windows of anchors with more than
``Params.hot`` occurrences form their minima before a shuffle and meet them in a join that deals a hot
group to several tasks; the others meet in one shuffle, in groups of at most that size.

Exact copies of a whole text are found first, by a 128-bit fingerprint of the word sequence; only
the first copy is searched for anchors.

Defined cases: a null or empty text has no words and nothing to cut; a text is searched whole; the
windows are those of the input; rows that share an id count as one document if their words are
equal (each keeps its windows) and else stand in the order of position, then of a tag of their text;
a null id stands before all others; an empty table gives an empty result.  Only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, keep_ids, spread_join
from ._words import SMALL_CHUNK_BYTES, Words, chunks, mix, rolling, tidied

_NO_ID = -(2**63)


@dataclass(frozen=True)
class Params:
    window: int = 20
    seed: int = 6
    hot: int = 100_000


def chosen(g: np.ndarray, m: int) -> np.ndarray:
    """For every m neighbours of g the index of the least, the last of equals."""
    at = np.arange(len(g))

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.where(g[j] <= g[i], j, i)

    width = 1
    while 2 * width <= m:
        at = least(at[: len(at) - width], at[width:])
        width *= 2
    if width < m:
        n = len(g) - m + 1
        at = least(at[:n], at[m - width : m - width + n])
    return at


class Windows:
    """Windows of a chunk of texts: first words, and the anchors they choose."""

    def __init__(self, column: pa.Array, p: Params):
        self.words = w = Words(column)
        self.at = self.anchor = np.zeros(0, np.int64)
        self.seeds = np.zeros(0, np.uint64)
        if len(w) >= p.window:
            self.at = np.flatnonzero(w.doc[: len(w) - p.window + 1] == w.doc[p.window - 1 :])
            self.seeds = rolling(w.hash, p.seed, 1)
            self.anchor = chosen(self.seeds, p.window - p.seed + 1)[self.at]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each row's word sequence."""
        w = self.words
        place = np.arange(len(w), dtype=np.uint64) - w.first[w.doc].astype(np.uint64)
        out = []
        for salt in (41, 42):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash ^ mix(place, salt), salt))])
            out.append((total[w.first[1:]] - total[w.first[:-1]]).view(np.int64))
        return out[0], out[1]

    def tags(self) -> np.ndarray:
        return self.fingerprints()[0] & 0x7FFFFFFF

    def text(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """The words of a row (those of keep) joined by one space."""
        w = self.words
        raw = w.data[w.offsets[row] : w.offsets[row + 1]].tobytes().split()
        return b" ".join(raw if keep is None else [x for x, k in zip(raw, keep, strict=True) if k])


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("id"), docs[text_col].cast("string").alias("text"))


def _list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def anchors(docs: DataFrame, p: Params, digests: bool) -> DataFrame:
    """Per row: id, n_words, fa, fb, sha (of all words), its anchors' hashes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text", SMALL_CHUNK_BYTES):
                x = Windows(c.column("text"), p)
                w, rows = x.words, c.num_rows
                at = x.anchor[np.flatnonzero(np.diff(x.anchor, prepend=-1))]  # ascending
                cut = np.searchsorted(w.doc[at], np.arange(rows + 1))
                sha = [hashlib.sha256(x.text(i)).hexdigest() if digests else "" for i in range(rows)]
                fa, fb = x.fingerprints()
                place = (at - w.first[w.doc[at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [c.column("id"), pa.array(w.count.astype(np.int64)), pa.array(fa), pa.array(fb), pa.array(sha), _list(x.seeds[at].view(np.int64), cut), _list(place, cut)],
                    ["id", "n_words", "fa", "fb", "sha", "seeds", "places"],
                )

    return docs.mapInArrow(tidied(run), "id long, n_words long, fa long, fb long, sha string, seeds array<long>, places array<int>")


def extended(seeded: DataFrame, p: Params) -> DataFrame:
    """Windows around repeated anchors of (id, text, places): anchor, window, id, packed place, hot.

    places: twice the anchor's first word, plus one if it is hot.

    A packed place is the window's first word, then 31 bits that tell texts of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text", 1 << 20):
                x = Windows(c.column("text"), p)
                w = x.words
                if not len(x.at):
                    continue
                places = c.column("places")
                row = np.repeat(np.arange(c.num_rows), np.diff(places.offsets.to_numpy()))
                flags = places.flatten().to_numpy().astype(np.int64)
                at = w.first[row] + (flags >> 1)
                inside = at < w.first[row + 1]
                on, hot = np.zeros(len(w) + 1, bool), np.zeros(len(w) + 1, bool)
                on[at[inside]] = True
                hot[at[inside & (flags & 1 > 0)]] = True
                hit = np.flatnonzero(on[x.anchor])
                first = x.at[hit]
                doc = w.doc[first]
                packed = ((first - w.first[doc]) << 31) | x.tags()[doc]
                window = rolling(w.hash, p.window, 2)[first].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.seeds[x.anchor[hit]].view(np.int64)), pa.array(window), c.column("id").take(pa.array(doc)), pa.array(packed), pa.array(hot[x.anchor[hit]])], ["a", "w", "id", "at", "hot"])

    return seeded.mapInArrow(tidied(run), "a long, w long, id long, at long, hot boolean")


def repeats(docs: DataFrame, p: Params, scratch: Scratch, digests: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, copies, cuts): facts of each row, ids and texts that are later copies, cut windows by id.

    ``docs`` has id and text.  copies: (fa, fb, n_words, first, _c rows); cuts: (id, ats).
    """
    found = scratch.write(anchors(docs, p, digests))
    rows = scratch.write(found.drop("seeds", "places"))
    same = ["fa", "fb", "n_words"]
    copies = scratch.write(rows.where(F.col("n_words") >= p.window).groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("_c")).where("_c > 1"))
    later = _later(rows, copies, scratch).select("id", "fa").distinct()
    firsts = keep_ids(found.where(F.col("n_words") >= p.window), scratch.write(later), ["id", "fa"], "left_anti")
    each = firsts.select("id", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(F.col("s.seeds").alias("a"), "id", F.col("s.places").alias("place"))
    twice = scratch.write(each.groupBy("a").agg(F.count("*").alias("_c")).where("_c > 1").select("a", "_c", (F.col("_c") > p.hot).cast("int").alias("hot")))
    scratch.release()
    seeds = scratch.write(spread_join(each, twice.select("a", "hot"), ["a"], scratch, twice.select("a", "_c")).groupBy("id").agg(F.collect_list(F.col("place") * 2 + F.col("hot")).alias("places")))
    scratch.drop(twice, found)
    text = keep_ids(docs, seeds.select("id"), "id")
    windows = scratch.write(extended(text.join(seeds, "id").select("id", "text", "places"), p))
    scratch.drop(seeds)
    least = F.min(F.struct("id", "at"))
    cold = windows.where("NOT hot").withColumn("f", least.over(Window.partitionBy("a", "w"))).select("id", "at", "f")
    hot = windows.where("hot").select("a", "w", "id", "at")
    first = scratch.write(hot.groupBy("a", "w").agg(least.alias("f"), F.count("*").alias("_c")).where("_c > 1"))
    met = spread_join(hot, first.drop("_c"), ["a", "w"], scratch, first.select("a", "w", "_c"))
    again = cold.unionByName(met.select("id", "at", "f")).where("id > f.id OR (id = f.id AND at > f.at)")
    cuts = scratch.write(again.groupBy("id").agg(F.collect_list("at").alias("ats")))
    scratch.drop(windows, first)
    return rows, copies, cuts


def _later(rows: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose whole text is a later copy."""
    same = ["fa", "fb", "n_words"]
    return spread_join(rows.select("id", *same), copies.drop("_c"), same, scratch, copies.select(*same, "_c")).where("id > first")


def _keep(x: Windows, row: int, ats: np.ndarray, tag: int, p: Params) -> np.ndarray | None:
    """Which words of a row stay; None if all do."""
    mine = ats[(ats & 0x7FFFFFFF) == tag] >> 31
    if not len(mine):
        return None
    step = np.zeros(x.words.count[row] + 1, np.int64)
    np.add.at(step, mine, 1)
    np.add.at(step, mine + p.window, -1)
    return np.cumsum(step[:-1]) == 0


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed and kept_sha256."""
    scratch = Scratch(docs.sparkSession)
    docs = _two(docs, id_col, text_col)
    rows, copies, cuts = repeats(docs, p, scratch, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text", SMALL_CHUNK_BYTES):
                x = Windows(c.column("text"), p)
                ids, tags, lists = [], x.tags(), c.column("ats")
                fa, fb = x.fingerprints()
                removed, sha, at = [], [], []
                for i in range(c.num_rows):
                    keep = _keep(x, i, lists[i].values.to_numpy(), int(tags[i]), p)
                    if keep is not None:
                        at.append(i)
                        removed.append(int((~keep).sum()))
                        sha.append(hashlib.sha256(x.text(i, keep)).hexdigest())
                ids = c.column("id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(fa[at]), pa.array(fb[at]), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["id", "fa", "fb", "cut_words", "cut_sha"])

    cut = keep_ids(docs, cuts.select("id"), "id").join(cuts, "id").select("id", "text", "ats").mapInArrow(tidied(run), "id long, fa long, fb long, cut_words long, cut_sha string").distinct()
    same = ["fa", "fb", "n_words"]
    out = spread_join(rows, copies.drop("_c"), same, scratch, how="left").join(cut, ["id", "fa", "fb"], "left")
    copy = F.col("first") < F.col("id")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", p: Params = Params()) -> DataFrame:
    """``docs`` with repeated passages cut from the texts; all columns and rows stay.

    A text without a cut stays as it is, to the byte; of another, the kept words are joined by one
    space.  ``chars_col``, if it is a column, gets the new number of code points.
    """
    scratch = Scratch(docs.sparkSession)
    two = _two(docs, id_col, text_col)
    rows, copies, cuts = repeats(two, p, scratch, False)
    marks = _later(rows, copies, scratch).select("id", F.col("fa").bitwiseAND(F.lit(0x7FFFFFFF)).alias("t")).groupBy("id").agg(F.collect_set("t").alias("_copies"))
    marks = scratch.write(cuts.select("id", F.col("ats").alias("_ats")).join(marks, "id", "full"))
    names = docs.columns
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    inner = docs.withColumn("_id", key)
    ids = marks.select(F.col("id").alias("_id"))
    touched = keep_ids(inner, ids, "_id").join(marks.withColumnRenamed("id", "_id"), "_id").select(*[docs[n] for n in names], "_ats", "_copies")
    spared = keep_ids(inner, ids, "_id", "left_anti").select(*names)
    count_chars = chars_col in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, text_col, SMALL_CHUNK_BYTES):
                x = Windows(c.column(text_col), p)
                tags, ats, gone = x.tags(), c.column("_ats"), c.column("_copies")
                texts = c.column(text_col).to_pylist()
                chars = c.column(chars_col).to_pylist() if count_chars else []
                for i in range(c.num_rows):
                    tag = int(tags[i])
                    if gone[i].is_valid and x.words.count[i] >= p.window and tag in gone[i].as_py():
                        texts[i] = ""
                    elif ats[i].is_valid and (keep := _keep(x, i, ats[i].values.to_numpy(), tag, p)) is not None:
                        texts[i] = x.text(i, keep).decode()
                    else:
                        continue
                    if count_chars:
                        chars[i] = len(texts[i])
                out = c.select(names)
                for name, values in [(text_col, texts)] + [(chars_col, chars)] * count_chars:
                    k = names.index(name)
                    out = out.set_column(k, out.schema.field(k), pa.array(values, out.schema.field(k).type))
                yield out

    return touched.mapInArrow(tidied(run), docs.schema).unionByName(spared)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window against every earlier one: exact, by the words themselves.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS t, count(*) AS n FROM u ANTI JOIN c ON c.doc_id = u.doc_id AND c.i = u.i GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
