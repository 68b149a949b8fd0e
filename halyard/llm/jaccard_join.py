"""Operator 6: a self-join on the Jaccard similarity of word 5-grams, with Bayesian candidate pruning.

Equal texts are one class, and texts of equal shingle sets are compared as one. Sets that share a band of MinHash values
are candidates, each pair in its first common band only. Their MinHash values are compared a few at a time; a pair goes when the posterior probability
that it reaches the threshold falls below TOLERANCE. The rest are verified on their exact shingle sets.
Large bands are worked on in pairs of blocks, and what leaves a block are counts and a spanning forest, not pairs.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import U64, Workspace, constants, groups_for, map_rows, shingles, table

THRESHOLD = 0.8
#: 32 bands of 4: at similarity 0.8 no band is shared with probability (1 - 0.8^4)^32, under 1e-7.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes between two looks at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-7
#: Documents of a block, and input for each hash bucket.
BLOCK = 512
BUCKET_BYTES = 2 << 20

_A = (constants(HASHES, 11) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (constants(HASHES, 23) >> U64(32)).astype(np.uint32)


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits, as BANDS int64."""
    x = (found >> U64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(x), 2048):
        v = x[None, a : a + 2048] ^ _B[:, None]
        v *= _A[:, None]
        np.minimum(least, v.min(1), out=least)
    return (least & np.uint32(0xFFFF)).astype(np.uint16).view(np.int64)


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, the fewest matches in n hashes with which a pair stays).

    Under a flat prior, m of n matches leave a Beta(m + 1, n - m + 1) posterior, and the probability that
    the similarity is at least t is that of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, limits, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the incremental comparison leaves; sig: rows x HASHES uint16."""
    kept_i, kept_j = [], []
    for at in range(0, len(i), chunk):
        a, b = i[at : at + chunk], j[at : at + chunk]
        same, done = np.zeros(len(a), np.int64), 0
        for n, least in limits:
            same = same + (sig[a, done:n] == sig[b, done:n]).sum(1)
            stay = same >= least
            a, b, same, done = a[stay], b[stay], same[stay], n
        kept_i.append(a)
        kept_j.append(b)
    return (np.concatenate(kept_i), np.concatenate(kept_j)) if kept_i else (i, j)


#: Ids from here on stand for rows without an id.
NAMELESS = (1 << 63) - 1 - (1 << 40)


def known_id():
    """doc_id, or for a null one an id above NAMELESS that is made from the text."""
    made = F.lit(NAMELESS) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 40))
    return F.coalesce(F.col("doc_id").cast("long"), made)


def identified(documents: DataFrame) -> DataFrame:
    return documents.select(known_id().alias("doc_id"), "text")


def digest():
    """128 bits of the text; a null one counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32))


def signed(documents: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, digest of the text, 128 bits of its shingle set and the set's signature (null without words)."""

    def run(rows):
        found = [shingles(t, width) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "digest": rows["digest"], "shingles": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found], "sig": [signature(x).tolist() if len(x) else None for x in found]}

    return map_rows(documents.select("doc_id", "text", digest().alias("digest")), run, "doc_id long, digest binary, shingles binary, sig array<long>")


def _sigs(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, BANDS)


SURVIVORS = "part long, gid long, rep long, partners array<long>"


def _survivors(limits):
    kind = pa.schema([("part", pa.int64()), ("gid", pa.int64()), ("rep", pa.int64()), ("partners", pa.list_(pa.int64()))])

    def run(key, t):
        t = t.sort_by([("gid", "ascending"), ("rep", "ascending")])
        gid, rep, band, side = (t.column(c).to_numpy() for c in ("gid", "rep", "band", "side"))
        bands = _sigs(t.column("sig"))
        values = bands.view(np.uint16)
        cuts = np.append(np.flatnonzero(np.append(True, gid[1:] != gid[:-1])), len(gid))
        out = {"gid": [], "rep": [], "partners": []}
        left, right = [], []

        def flush():
            if not left:
                return
            i, j = prune(values, np.concatenate(left), np.concatenate(right), limits)
            left.clear()
            right.clear()
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
            for a, b in zip(starts, np.append(starts[1:], len(i))):
                out["gid"].append(int(gid[i[a]]))
                out["rep"].append(int(rep[i[a]]))
                out["partners"].append(rep[j[a:b]])
            only = np.setdiff1d(j, i)
            out["gid"] += gid[only].tolist()
            out["rep"] += rep[only].tolist()
            out["partners"] += [[]] * len(only)

        waiting = 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            if side[a:b].min() < 0:  # a block with itself
                i, j = np.triu_indices(b - a, 1)
            else:
                i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1), indexing="ij"))
            i, j, e = i + a, j + a, int(band[a])
            for k in range(0, e):  # a pair belongs to its first common band
                new = bands[i, k] != bands[j, k]
                i, j = i[new], j[new]
                if not len(i):
                    break
            if len(i):
                left.append(i)
                right.append(j)
                waiting += len(i)
            if waiting > 1 << 18:
                flush()
                waiting = 0
        flush()
        return pa.Table.from_pydict({"part": [key[0].as_py()] * len(out["gid"]), **out}, kind)

    return run


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of sorted sets reach the threshold, by exact intersections."""
    n = np.array([len(s) for s in sets])
    if len(i) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:  # dense: products of 0/1 matrices, some columns at a time
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), n)
        shared = times[column] > 1
        rows, column = rows[shared], column[shared]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        product = np.zeros((len(sets), len(sets)), np.float32)
        numbers = np.cumsum(np.append(0, column[1:] != column[:-1])) if len(column) else column
        for first in range(0, int(numbers[-1]) + 1 if len(numbers) else 0, 2048):
            a, b = np.searchsorted(numbers, [first, first + 2048])
            m = np.zeros((len(sets), 2048), np.float32)
            m[rows[a:b], numbers[a:b] - first] = 1
            product += m @ m.T
        both = product[i, j].astype(np.int64)
    return both / (n[i] + n[j] - both) >= threshold


LINKS = "digest binary, copy_id long, links long, anchor binary, anchor_id long"


def _verified(width: int, threshold: float):
    kind = pa.schema([("digest", pa.binary()), ("copy_id", pa.int64()), ("links", pa.int64()), ("anchor", pa.binary()), ("anchor_id", pa.int64())])

    def run(key, t):
        t = t.sort_by([("gid", "ascending"), ("rep", "ascending")])
        gid, rep, doc, many = (t.column(c).to_numpy() for c in ("gid", "rep", "copy_id", "n_texts"))
        partners, texts, digests = t.column("partners"), t.column("text"), t.column("digest")
        cuts = np.append(np.flatnonzero(np.append(True, gid[1:] != gid[:-1])), len(gid))
        out = {c: [] for c in kind.names}
        for a, b in zip(cuts[:-1], cuts[1:]):
            ids, first = np.unique(rep[a:b], return_index=True)  # a row that is repeated counts once
            first += a
            wanted = [partners[int(k)].as_py() for k in first]
            i = np.repeat(np.arange(len(ids)), [len(x) for x in wanted])
            j = np.searchsorted(ids, np.array([x for p in wanted for x in p], np.int64))
            good = similar([shingles(texts[int(k)].as_py(), width) for k in first], i, j, threshold)
            i, j = i[good], j[good]
            times = many[first]
            links = np.bincount(i, times[j], len(ids)) + np.bincount(j, times[i], len(ids))
            parent = list(range(len(ids)))

            def top(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x, y in zip(i.tolist(), j.tolist()):
                x, y = top(x), top(y)
                parent[max(x, y)] = min(x, y)
            for k in np.flatnonzero(links):
                at, to = int(first[k]), int(first[top(k)])
                for name, value in zip(out, (digests[at].as_py(), int(doc[at]), int(links[k]), digests[to].as_py(), int(doc[to]))):
                    out[name].append(value)
        return pa.Table.from_pydict(out, kind)

    return run


def classes(workspace: Workspace, documents: DataFrame, width: int = 5, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The join over identified() documents: doc_id and digest of each row, and for each text its digest, class_id,
    copy_id, n_copies, n_links, without nulls, and least: whether it stands for its class.

    A text, not an id, is what is compared; texts of one shingle set are at similarity 1, so sets are compared, and a
    link between sets counts for each of their texts. The least text of a class has its smallest id, and of several with
    that id the smallest digest, so classes that share their smallest id stay apart and no row order matters.
    """
    # joins are sorted and merged at every size: the planner sees neither how many rows an explode makes nor how far a
    # written table was compressed, so what it takes for small and broadcasts can be many times the driver's memory
    groups = groups_for(documents, BUCKET_BYTES, 64)
    docs = workspace.table(signed(documents, width), "signatures")
    texts = docs.groupBy("digest").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.any_value("shingles").alias("shingles"), F.any_value("sig").alias("sig"))
    texts = workspace.table(texts, "texts")
    sets = texts.where(F.col("sig").isNotNull()).groupBy("shingles").agg(F.count("*").alias("n_texts"), F.min(F.struct("copy_id", "digest")).alias("first"), F.any_value("sig").alias("sig"))
    sets = workspace.table(sets.select("shingles", "n_texts", "first.copy_id", "first.digest", "sig", F.monotonically_increasing_id().alias("rep")), "sets")  # numbered once, as it is written
    bands = sets.select("rep", F.posexplode("sig").alias("band", "value"))
    shared = bands.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    # a row goes to each pair of its block and another (x, y); side -1: the block with itself
    gid = F.xxhash64("band", "value", F.least("x", "y"), F.greatest("x", "y"))
    blocked = (
        bands.hint("merge").join(shared, ["band", "value"])
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        .withColumn("x", F.pmod(F.xxhash64("rep", "value"), "blocks"))
        .withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("rep", "band", gid.alias("gid"), F.signum(F.col("x") - F.col("y")).cast("int").alias("order"), (F.col("blocks") > 1).alias("large"))
        .withColumn("side", F.when(F.col("order") == 0, -1).when(F.col("order") < 0, 0).otherwise(1))
        .withColumn("part", F.when(F.col("large"), F.col("gid")).otherwise(F.pmod("gid", F.lit(groups))))  # small bands share groups, a pair of blocks is one of its own
        .select("rep", "band", "gid", "side", "part")
    )
    survivors = workspace.table(blocked.hint("merge").join(sets.select("rep", "sig"), "rep").groupBy("part").applyInArrow(_survivors(least_matches(threshold)), SURVIVORS), "candidates")
    # a text that is repeated comes once
    texts_of = documents.select(digest().alias("digest"), "text").groupBy("digest").agg(F.min("text").alias("text"))
    found = survivors.hint("merge").join(sets.select("rep", "digest", "copy_id", "n_texts"), "rep").hint("merge").join(texts_of, "digest")
    links = workspace.table(found.groupBy("part").applyInArrow(_verified(width, threshold), LINKS), "links")
    n_links = links.groupBy("digest").agg(F.sum("links").alias("links"))
    node = lambda doc, text: F.struct(F.col(doc).alias("doc"), F.col(text).alias("digest"))
    least = components(links.select(node("copy_id", "digest").alias("u"), node("anchor_id", "anchor").alias("v")), 0).select(F.col("u.digest").alias("digest"), F.col("v").alias("least"))
    by_set = sets.select("shingles", "n_texts", "copy_id", "digest").hint("merge").join(n_links, "digest", "left").hint("merge").join(least, "digest", "left")
    by_set = by_set.select("shingles", (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).cast("long").alias("n_links"), F.coalesce("least", node("copy_id", "digest")).alias("least"))
    by_text = texts.select("digest", "copy_id", "n_copies", "shingles").hint("merge").join(by_set, "shingles", "left")
    return docs.select("doc_id", "digest"), by_text.select(
        "digest",
        F.coalesce("least.doc", "copy_id").alias("class_id"),
        "copy_id",
        "n_copies",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce(F.col("least.digest") == F.col("digest"), F.lit(True)).alias("least"),
    )


def join(spark: SparkSession, documents: DataFrame, width: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest id that chains of links and equal texts reach), copy_id (the smallest id of the
    same text), n_copies (rows of the same text) and n_links (other texts at the threshold or above), for each row.

    Shingles are runs of `width` words in lower case (A-Z); shorter texts have one of all their words; null and empty
    texts are copies of each other and have no links. class_id and copy_id are null where no row of theirs has an id.
    Rows of one id with different texts are different documents: each has the links of its own text. A repeated row is a
    copy, an empty table gives no rows, texts of any length are compared whole. Other columns are not read.
    """
    known = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).alias(c)
    with Workspace(spark, "jaccard") as workspace:
        docs, by_text = classes(workspace, identified(documents), width, threshold)
        return workspace.result(docs.hint("merge").join(by_text, "digest").select(known("doc_id"), known("class_id"), known("copy_id"), "n_copies", "n_links"))


def op6_jaccard_join(spark, sf_dir):
    """Null and empty texts are copies of each other without links, repeated rows are copies; see join()."""
    return join(spark, table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
c AS (SELECT t, min(doc_id) AS rep, count(*) AS n_copies, any_value(a) AS a FROM d GROUP BY t),
s AS (SELECT DISTINCT rep, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(len(a) - 4), lambda i: array_to_string(a[i + 1 : i + 5], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ') || '#' || len(a)] ELSE [] END) AS g FROM c),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
o AS (SELECT x.rep AS a, y.rep AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.rep < y.rep GROUP BY x.rep, y.rep),
l AS (SELECT a, b FROM o JOIN z za ON za.rep = a JOIN z zb ON zb.rep = b WHERE i / (za.n + zb.n - i) >= 0.8),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(rep, m) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.rep),
k AS (SELECT rep, min(m) AS class_id FROM r GROUP BY rep),
n AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, k.class_id, c.rep AS copy_id, CAST(c.n_copies AS BIGINT) AS n_copies, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links
FROM d JOIN c USING (t) JOIN k ON k.rep = c.rep LEFT JOIN n ON n.rep = c.rep
"""
