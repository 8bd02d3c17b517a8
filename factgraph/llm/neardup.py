"""Operator 3, near-duplicate detection: MinHash with tensored banding.

Two collections of ``half_keys`` keys, each made of ``rows`` minhashes, are computed for a set; the
table keys are all pairs (one key of either collection), so ``half_keys**2`` tables need only
``2 * half_keys * rows`` minhashes instead of ``2 * rows * half_keys**2``.  A pair of sets with
similarity s meets in a table with probability (1 - (1 - s**rows)**half_keys)**2: 0.99964 at 0.8
with the defaults and above 0.99998 at 0.85.

Equal sets are one class before any table is built, so exact copies cost one row.  Members of a
table bucket are linked through hubs (the smallest and the largest class), which takes a number of
pairs linear in the bucket; where hubs leave a bucket in several components, all its members are
compared in blocks of bounded size.  Every link is confirmed on the full sets.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing;
fewer words than a shingle make one shingle of the whole sequence; a null id stands for itself
(component null, kept false); rows that share an id are one document, so their sets are linked;
equal rows get equal results; an empty table gives an empty result.  Only the id and text columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._spark import Scratch, keep_ids, parts_of, salted_join, small, spread_join
from ._words import SMALL_CHUNK_BYTES, Words, chunks, later, mix, rolling, tidied


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 80
    half_keys: int = 12
    rows: int = 3


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each row, and offsets of the rows among them."""
    w = Words(column, lower=True)
    rows = len(w.count)
    key, at = w.ngrams(n)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    whole = np.array([_sequence(w.hash[w.first[i] : w.first[i + 1]]) for i in short], np.uint64)
    key, doc = np.concatenate([key, whole]), np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    key, doc = key[order], doc[order]
    new = ~later(key ^ mix(doc.astype(np.uint64), 5))
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(rows + 1))


def _sequence(h: np.ndarray) -> np.uint64:
    return rolling(h, len(h), 101)[0]


def minhashes(key: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """k minhashes of each nonempty set, as an array (sets, k)."""
    start = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(start), k), np.uint64)
    if len(start):
        seed = mix(np.arange(2 * k, dtype=np.uint64), 7)
        for j in range(k):
            out[:, j] = np.minimum.reduceat((key ^ seed[2 * j]) * (seed[2 * j + 1] | np.uint64(1)), start)
    return out


def half_keys(key: np.ndarray, offsets: np.ndarray, p: Params) -> np.ndarray:
    """2 * half_keys keys of each nonempty set: first one collection, then the other."""
    m = minhashes(key, offsets, 2 * p.half_keys * p.rows).reshape(-1, 2 * p.half_keys, p.rows)
    h = np.zeros(m.shape[:2], np.uint64)
    for r in range(p.rows):
        h = mix(h ^ m[:, :, r], 20 + r)
    return h


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n, a fingerprint of the set (fa, fb) and its half keys (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text", SMALL_CHUNK_BYTES):
                key, offsets = shingles(c.column("text"), p.shingle)
                n = np.diff(offsets)
                sums = []
                for salt in (31, 32):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key, salt))])
                    sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
                halves = half_keys(key, offsets, p)
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, halves.shape[1], 0))])
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), _lists(halves.ravel(), at)], ["doc_id", "n", "fa", "fb", "half"])

    return docs.mapInArrow(tidied(run), "doc_id long, n long, fa long, fb long, half array<long>")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text", SMALL_CHUNK_BYTES):
                key, offsets = shingles(c.column("text"), n)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), _lists(key, offsets)], ["id", "shingles"])

    return docs.mapInArrow(tidied(run), "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; an id may stand in any number of pairs."""
    one = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), ["a"], scratch)
    counts = pairs.groupBy("b").agg(F.count("*").alias("_c"))
    two = spread_join(one, sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), ["b"], scratch, counts)
    common = F.size(F.array_intersect("sa", "sb"))
    return two.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u")).where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b").distinct()


def _near(x: str, y: str, percent: int):
    """Sizes that allow the similarity: a small set cannot cover enough of a large one."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept (and class_id, the class's smallest id)."""
    scratch = Scratch(docs.sparkSession)
    docs = _two(docs, id_col, text_col)
    meta = scratch.write(signatures(docs, p))
    same = ["fa", "fb", "n"]
    named = meta.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.write(named.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("half").alias("half")))
    rows, h = classes.count(), p.half_keys
    keys = (  # each class becomes half_keys**2 rows: dealt anew, so that no task makes too many
        classes.select("rep", "n", "half").repartition(max(1, -(-rows * h * h // EXPLODED)), "rep")
        .select("rep", "n", F.slice("half", 1, h).alias("us"), F.slice("half", h + 1, h).alias("vs"))
        .select("rep", "n", F.posexplode("us").alias("i", "u"), "vs")
        .select("rep", "n", "i", "u", F.posexplode("vs").alias("j", "v"))
        .select(F.xxhash64("i", "j", "u", "v").alias("key"), "rep", "n")
    )
    shared = scratch.write(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))  # a count alone is hashed; structs would be sorted
    scratch.release()
    sizes = shared.select("key", F.col("c").alias("_c"))
    alike = scratch.write(spread_join(keys, shared, ["key"], scratch, sizes))
    scratch.release()
    hubs = alike.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lo"), F.max(F.struct("rep", "n")).alias("hi"))
    members = scratch.write(spread_join(alike, hubs, ["key"], scratch, sizes))
    scratch.drop(shared, alike)
    stars = members.select("rep", "n", F.explode(F.array("lo", "hi")).alias("hub")).where(F.col("rep") != F.col("hub.rep")).where(_near("n", "hub.n", p.percent))
    pairs = scratch.write(stars.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct())
    wanted = scratch.write(members.select(F.col("rep").alias("doc_id")).distinct())
    sets = scratch.write(shingle_sets(keep_ids(docs, wanted, "doc_id"), p.shingle).withColumn("h", F.xxhash64("shingles")).dropDuplicates(["id", "h"]).drop("h"))
    scratch.release()
    links = scratch.write(confirmed(pairs, sets, p.percent, scratch).unionByName(_of_one_id(named, classes, same, scratch)))
    labels = components(links, scratch)
    more = _across(members, labels, sets, p, scratch)
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more), scratch)
    scratch.drop(members, pairs, wanted, sets, links)
    known = classes.select(*same, "rep").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    rows = spread_join(meta.select("doc_id", *same), known, same, scratch, how="left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.coalesce("rep", "doc_id").alias("class_id"))


def _of_one_id(named: DataFrame, classes: DataFrame, same: list[str], scratch: Scratch) -> DataFrame:
    """Links between the classes of rows that share an id: each to the id's smallest class."""
    ends = named.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("x"), F.max(F.struct(*same)).alias("y")).where("x <> y").select("doc_id")
    odd = scratch.write(named.select("doc_id", *same).join(scratch.write(ends), "doc_id", "left_semi").distinct().join(classes.select(*same, "rep"), same).select("doc_id", "rep"))
    least = odd.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return spread_join(odd, least, ["doc_id"], scratch).select("a", F.col("rep").alias("b")).where("a <> b")


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """Confirmed links between members of one bucket whose components differ.

    The rule is the same for every bucket: each two of its members are compared, unless a component
    holds them both or hubs have compared them (all pairs of three).  Buckets with the same members
    count once.  Buckets that overlap form families, and families are dealt to blocks; blocks meet two
    by two inside tasks, which compare the pairs that share a bucket and send only links that join components.
    """
    named = scratch.write(members.where("c > 3").select("key", "rep", "n", "c").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("key", "rep", "n", "c", F.coalesce("label", "rep").alias("label")))
    same = F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("same")
    ends = [F.min("label").alias("x"), F.max("label").alias("y"), F.min("rep").alias("hub"), F.count("*").alias("m"), same]
    open_keys = named.groupBy("key").agg(*ends).where("x <> y").groupBy("x", "y", "hub", "m", "same").agg(F.min("key").alias("key"))
    open_keys = scratch.write(open_keys.select("key", "hub", "m"))
    left = salted_join(named.withColumn("_parts", parts_of(F.col("c"))), open_keys.withColumn("_parts", parts_of(F.col("m"))), ["key"])
    left = scratch.write(left.select("key", "rep", "n", "label", "hub"))
    families = components(left.select(F.col("rep").alias("a"), F.col("hub").alias("b")), scratch)
    families = scratch.write(families.withColumnRenamed("label", "family").unionByName(families.select(F.col("label").alias("id"), F.col("label").alias("family")).distinct()))
    facts = scratch.write(left.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"), F.max("label").alias("label"), F.collect_set("key").alias("keys")).join(families, "id"))
    dealt, pairs = _meetings(facts, scratch)
    ends = [(pairs.select("family", F.col("x").alias("block"), "x", "y"), "x"), (pairs.where("x <> y").select("family", F.col("y").alias("block"), "x", "y"), "y")]
    met = [spread_join(some, dealt, ["family", "block"], scratch).select("id", "label", "keys", "family", "x", "y", F.lit(side).alias("own")) for some, side in ends]
    return scratch.write(met[0].unionByName(met[1]).join(sets, "id").groupBy("family", "x", "y").applyInArrow(lambda t: _block_links(t, p.percent), "a long, b long").distinct())


def _meetings(facts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members with their block, pairs of blocks that must meet) of families.

    A component that fills several blocks has blocks of its own, which do not meet one another; what
    else is in a family shares blocks by a hash of the id.  So a family that fits one block is one
    block, and a large component with few members beside it costs a number of rows linear in its size.
    """
    zero, several = F.lit(0), F.col("own_blocks") > 1
    per = scratch.write(facts.groupBy("family", "label").agg(F.count("*").alias("_c"), F.sum("n").alias("ns")).withColumn("own_blocks", _blocks("_c", "ns")))
    shared = per.where(~several).groupBy("family").agg(F.sum("_c").alias("rows"), F.sum("ns").alias("ns")).select("family", _blocks("rows", "ns").alias("blocks"))
    per = scratch.write(spread_join(per, shared, ["family"], scratch, how="left"))
    mixed = scratch.write(per.where(~several).select("family", "blocks").distinct().select("family", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("i")).select("family", F.concat(F.lit("m:"), "i").alias("b")))
    large = scratch.write(per.where(several).select("family", "label", "own_blocks"))
    each = lambda df: df.withColumn("i", F.explode(F.sequence(zero, F.col("own_blocks") - 1))).select("family", F.concat(F.lit("l:"), "label", F.lit(":"), "i").alias("b"))
    two = large.alias("p").join(large.alias("q"), (F.col("p.family") == F.col("q.family")) & (F.col("p.label") < F.col("q.label")))
    code = lambda k: F.concat(F.lit("l:"), f"{k}label", F.lit(":"), f"{k}i")
    two = two.select("p.family", F.col("p.label").alias("plabel"), F.col("q.label").alias("qlabel"), "q.own_blocks", F.explode(F.sequence(zero, F.col("p.own_blocks") - 1)).alias("pi")).withColumn("qi", F.explode(F.sequence(zero, F.col("own_blocks") - 1)))
    pairs = mixed.withColumnRenamed("b", "x").join(mixed.withColumnRenamed("b", "y"), "family").where("x <= y")
    pairs = pairs.unionByName(mixed.withColumnRenamed("b", "x").join(each(large).withColumnRenamed("b", "y"), "family")).unionByName(two.select("family", code("p").alias("x"), code("q").alias("y")))
    own = F.when(several, F.concat(F.lit("l:"), "label", F.lit(":"), F.pmod(F.xxhash64("id"), "own_blocks"))).otherwise(F.concat(F.lit("m:"), F.pmod(F.xxhash64("id"), "blocks")))
    dealt = spread_join(facts, per.drop("_c", "ns"), ["family", "label"], scratch, per.select("family", "label", "_c"))
    return scratch.write(dealt.select("id", "label", "keys", "family", own.alias("block"))), scratch.write(pairs)


#: Rows that a task makes of classes; sets and shingles of a block; sets with a shingle up to which pairs are listed.
EXPLODED, BLOCK, BLOCK_SHINGLES, RARE = 250_000, 1024, 2_000_000, 16


def _blocks(rows: str, shingles: str):
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _common(lists: pa.ListArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements the lists of rows x and y share, as a matrix.

    Elements of many rows are multiplied as dense columns; of the others each pair of rows is counted.
    """
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    _, word, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)
    both = np.zeros((len(x), len(y)), np.float32)
    dense = seen[word] > RARE
    often, at = row[dense], np.unique(word[dense], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    often, at = often[order], at[order]
    width = 4096
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, [a, a + width])
        m = np.zeros((len(size), min(width, int(at[-1]) + 1 - a)), np.float32)
        m[often[i:j], at[i:j] - a] = 1
        both += m[x] @ m[y].T
    rare = (seen[word] > 1) & ~dense
    order = np.argsort(word[rare], kind="stable")
    row, word = row[rare][order], word[rare][order]
    place = np.full((2, len(size)), -1)
    place[0, x], place[1, y] = np.arange(len(x)), np.arange(len(y))
    for step in range(1, RARE):
        k = np.flatnonzero(word[step:] == word[:-step]) if len(word) > step else np.zeros(0, np.int64)
        if not len(k):
            break
        for a, b in ((row[k], row[k + step]), (row[k + step], row[k])):
            i, j = place[0, a], place[1, b]
            ok = (i >= 0) & (j >= 0)
            np.add.at(both, (i[ok], j[ok]), 1)
    return both


def _block_links(t: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks (or inside one) that join components: at most one a member."""
    own = t["own"].to_numpy(zero_copy_only=False) == "x"
    ids, label = t["id"].to_numpy(), t["label"].to_numpy()
    x, y = np.flatnonzero(own), np.flatnonzero(~own if t["x"][0].as_py() != t["y"][0].as_py() else own)
    lists = t["shingles"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    both = _common(lists, x, y)
    union = size[x][:, None] + size[y][None, :] - both
    near = (both * 100 >= union * percent) & (label[x][:, None] != label[y][None, :])
    if near.any():
        near &= _common(t["keys"].combine_chunks(), x, y) > 0
    i, j = np.nonzero(near)
    root = {int(k): int(k) for k in np.unique(label)}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for a, b in zip(x[i].tolist(), y[j].tolist(), strict=True):
        u, v = find(int(label[a])), find(int(label[b]))
        if u != v:
            root[u] = v
            out.append((int(ids[a]), int(ids[b])))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), p=Params(shingle=2)).drop("class_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id; all columns kept.

    Rows without words or without an id belong to no group and stay.  Rows that repeat an id within
    a group are copies of one another: one of them stays.
    """
    found = Scratch(docs.sparkSession).write(near_duplicates(docs, id_col, text_col, p))
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct()
    rest = docs.join(F.broadcast(gone) if small(gone) else gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
    if found.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        return rest
    return rest.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(rest.where(F.col(id_col).isNull()))


#: All pairs of documents that share a shingle: exact, for small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
q AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS k FROM (SELECT s.doc_id, s.g, count(*) OVER (PARTITION BY s.g) AS c FROM s)),
p AS (SELECT q.doc_id, q.g, n.n FROM q JOIN n USING (doc_id) WHERE q.k <= n.n - (80 * n.n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, count(*) AS i FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS label FROM n UNION SELECT t.b, r.label FROM r JOIN t ON t.a = r.id),
m AS (SELECT id, min(label) AS label FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.label, d.doc_id) AS component_id, d.doc_id = coalesce(m.label, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id"""
