"""Embedding near-duplicates from a neighbour graph that NN-descent refines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmspark.llm.common import written
from filmspark.llm.components import components

#: Vectors that are compared with each other at once while lists are built.
_BLOCK = 256
#: Up to so many vectors, a component is compared with itself in one task; larger ones go by cells.
_EXACT = 256
#: Rows of a part of a larger component.
_PART = 256
#: Bits of a hyperplane code that split cells which are too large.
_DEEP = 24
_BINS = 128
_SURE = 1e-7


def _units(vectors: pd.Series, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def _checked(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(id, vec, dim) with vec the bytes of the components, null where the vector links with nothing; and the components' numpy type."""
    kind = "<f4" if "float" in dict(vectors.dtypes)[vec_col] else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for v in b.column(1):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and not v.values.null_count else np.zeros(0, kind)
                x = x + np.zeros(1, kind)  # one zero: -0.0 becomes 0.0
                ok = len(x) and np.isfinite(x).all() and 0 < float(np.linalg.norm(x.astype(np.float64))) < np.inf
                out.append(x.tobytes() if ok else None)
                dims.append(len(x))
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], names=["id", "vec", "dim"])

    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return src.mapInArrow(run, "id long, vec binary, dim int"), kind


def tables_for(n: int, threshold: float, missed: float = 0.02) -> tuple[int, int]:
    """Bits of a cell's code, for cells of about _BLOCK / 2 of n vectors, and tables enough that a pair at the threshold meets in one of them but for a share of `missed`."""
    bits = max(0, math.ceil(math.log2(max(1, n / (_BLOCK / 2)))))
    together = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, max(8, math.ceil(math.log(missed) / math.log(1 - together)) if together < 1 else 1)


def _planes(seed: int, dim: int, bits: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, bits))


def _tables(classes: DataFrame, kind: str, bits: int, tables: range) -> DataFrame:
    """(key, deep, cid): each class's cell in each table of random hyperplanes, and the sides of further planes that split a cell which is too large."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = _units(part.vec, kind)
                for t in tables:
                    side = (x @ _planes(t, int(dim), bits + _DEEP) > 0).astype(np.int64)
                    code = side[:, :bits] @ (1 << np.arange(bits, dtype=np.int64))
                    yield pd.DataFrame({"key": (np.int64(t) << 48) ^ code, "deep": side[:, bits:] @ (1 << np.arange(_DEEP, dtype=np.int64)[::-1]), "cid": part.cid.to_numpy()})

    return classes.select("cid", "vec", "dim").mapInPandas(run, "key long, deep long, cid long")


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole runs of equal keys out of sorted batches, many at once, and where each begins (last: the end)."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        k = held[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if len(cuts):
            yield held.iloc[: cuts[-1]], np.append(0, cuts)
            held = held.iloc[cuts[-1] :].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _joined(members: DataFrame, classes: DataFrame, kind: str, per: int, foreign: bool = False) -> DataFrame:
    """members: (key, deep, cid). Compares the vectors that share a key and gives each its best `per` of them: (v, u, cos).

    foreign: only vectors that are `saturated` get any, and only of other components (columns of classes). A key with over 256 members is split by the leading bits of `deep`, and a part that
    is still too large by a hash, so no key makes a large task or all pairs.
    """
    parts = lambda n: F.ceil(F.coalesce(n, F.lit(1)) / _BLOCK)
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > _BLOCK)
    bits = F.least(F.lit(_DEEP), F.greatest(F.lit(0), F.ceil(F.log2(parts("n"))).cast("int") + F.when(F.col("n").isNull(), 0).otherwise(1)))
    dealt = members.join(sizes, "key", "left").select("key", F.expr("deep").alias("deep"), bits.alias("bits"), "cid")
    dealt = dealt.select("key", F.expr(f"shiftright(deep, {_DEEP} - bits)").alias("part"), "cid")
    again = dealt.groupBy("key", "part").agg(F.count("*").alias("n")).where(F.col("n") > _BLOCK)
    dealt = dealt.join(again, ["key", "part"], "left").select("key", "part", F.pmod(F.xxhash64("cid", "key"), parts("n").cast("long")).alias("rest"), "cid")
    more = ["component", "saturated"] if foreign else []
    keys = ["dim", "key", "part", "rest"]
    ordered = dealt.join(classes.select("cid", "vec", "dim", *more), "cid").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, at in _runs(batches, keys):
            out, dims, cids = [], pdf.dim.to_numpy(), pdf.cid.to_numpy()
            if foreign:
                comp, full = pdf.component.to_numpy(), pdf.saturated.to_numpy(bool)
            for d in np.unique(dims):
                lo, hi = np.searchsorted(dims, [d, d + 1])
                x = _units(pdf.vec.iloc[lo:hi], kind)
                edges = at[(at >= lo) & (at <= hi)]
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if b - a < 2 or (foreign and not full[a:b].any()):
                        continue
                    c, cid = x[a - lo : b - lo] @ x[a - lo : b - lo].T, cids[a:b]
                    np.fill_diagonal(c, -2.0)
                    if foreign:
                        c[comp[a:b, None] == comp[None, a:b]] = -2.0
                        c, rows = c[full[a:b]], np.flatnonzero(full[a:b])
                    else:
                        rows = np.arange(b - a)
                    n = min(per, b - a - 1)
                    best = np.argpartition(-c, n - 1, axis=1)[:, :n]
                    out.append((np.repeat(cid[rows], n), cid[best.ravel()], np.take_along_axis(c, best, 1).ravel()))
            if out:
                v, u, cos = (np.concatenate(z) for z in zip(*out, strict=True))
                yield pd.DataFrame({"v": v, "u": u, "cos": cos})[cos > -1.5]

    return ordered.mapInPandas(run, "v long, u long, cos double")


def _lists(candidates: DataFrame, k: int) -> DataFrame:
    one = candidates.groupBy("v", "u").agg(F.max("cos").alias("cos"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("cos", "u")), asc=False), 1, k)
    return one.groupBy("v").agg(best.alias("l")).select("v", F.explode("l").alias("e")).select("v", F.col("e.u").alias("u"), F.col("e.cos").alias("cos"))


def _pools(links: DataFrame, classes: DataFrame, salt: int) -> DataFrame:
    """(key, deep, cid): at every class itself, all that it lists and all that list it."""
    both = links.select(F.col("v").alias("key"), F.col("u").alias("cid")).union(links.select(F.col("u").alias("key"), F.col("v").alias("cid")))
    pools = both.union(classes.select(F.col("cid").alias("key"), "cid")).distinct()
    return pools.select("key", F.pmod(F.xxhash64("cid", F.lit(salt)), F.lit(1 << _DEEP)).alias("deep"), "cid")


def neighbour_lists(classes: DataFrame, kind: str, bits: int, tables: range, k: int, rounds: int, threshold: float) -> DataFrame:
    """classes: (cid, vec, dim). (v, u, cos): for each class its k best neighbours found.

    Lists begin with the best of random-hyperplane cells, as a random start finds nothing in data without large-scale order. A round compares, at every class, all that it
    lists or that list it. Rounds stop when they find under a thousandth more links.
    """
    lists = written(_lists(_joined(_tables(classes, kind, bits, tables), classes, kind, max(2, k // 2)), k), "neighbours")
    found = lists.where(F.col("cos") >= threshold).count()
    for r in range(rounds):
        lists = written(_lists(_joined(_pools(lists, classes, r), classes, kind, 3).union(lists), k), "neighbours")
        now = lists.where(F.col("cos") >= threshold).count()
        if now - found <= 0.001 * now:
            break
        found = now
    return lists


def _enlarged(classes: DataFrame, lists: DataFrame, links: DataFrame, kind: str, bits: int, tables: range, k: int, threshold: float, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """All links, and (cid, component) of the linked classes, once no saturated list can be enlarged by a link.

    A list whose k entries are all links is saturated: links that are less close don't fit in. Such a class gets further lists, of the best k that its component doesn't hold yet: first from the
    cells, then from the neighbours of these neighbours. New links join components, so the next list looks beyond them; it ends when none comes.
    """
    full = lists.groupBy("v").agg((F.count_if(F.col("cos") >= threshold) >= k).alias("saturated")).where("saturated")
    full = written(full.withColumnRenamed("v", "cid"), "saturated")
    member = written(components(links).withColumnsRenamed({"vertex": "cid"}), "member")
    if full.isEmpty():
        return links, member
    cells = written(_tables(classes, kind, bits, tables), "cells")
    for r in range(most):
        known = classes.join(member, "cid", "left").join(full, "cid", "left").select("cid", "vec", "dim", F.coalesce("component", "cid").alias("component"), F.coalesce("saturated", F.lit(False)).alias("saturated"))
        known = written(known, "known")
        open_ = cells.join(cells.join(full.select("cid"), "cid", "left_semi").select("key").distinct(), "key", "left_semi")
        far = written(_lists(_joined(open_, known, kind, 2, foreign=True), k), "far")
        # only what is near the threshold leads further
        close = far.where(F.col("cos") >= math.cos(1.5 * math.acos(threshold))).select("v", "u")
        theirs = lists.join(close.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("v", "u")
        more = _joined(_pools(close.union(theirs), full, r), known, kind, 2, foreign=True)
        fresh = written(far.union(more).where(F.col("cos") >= threshold).select("u", "v").distinct(), "fresh")
        if fresh.isEmpty():
            return links, member
        links = written(links.union(fresh), "links")
        member = written(components(links).withColumnsRenamed({"vertex": "cid"}), "member")
        # a list is looked at again only if its component has grown: from an unchanged one the same cells give nothing new
        ends = fresh.select(F.col("u").alias("cid")).union(fresh.select(F.col("v").alias("cid"))).distinct()
        grown = member.join(ends, "cid", "left_semi").select("component").distinct()
        full = written(full.join(member.join(grown, "component", "left_semi").select("cid"), "cid", "left_semi"), "saturated")
    raise RuntimeError(f"saturated lists still found new links after {most} rounds")


def _counted(x: np.ndarray, y: np.ndarray, mult: np.ndarray, threshold: float) -> np.ndarray:
    return (x @ y.T >= threshold) @ mult


def exact_links(classes: DataFrame, member: DataFrame, kind: str, threshold: float) -> DataFrame:
    """member: (cid, component). (cid, n): rows linked to each class, itself not counted, among all of its component. Exact.

    Components of at most _EXACT classes are compared in one task, many components a task. A larger one is divided into cells around centres that a bounded sample of it gives. By the
    triangle inequality a vector at angle d from a centre is linked with everything of its cell that is within (threshold angle - d) of the
    centre, and with nothing that is beyond d + threshold angle or nearer than d - threshold angle. So whole rings of a cell are counted by their
    numbers, and only the rings between are compared, block by block. No pairs are emitted.
    """
    m = member.join(classes.select("cid", "vec", "mult"), "cid")
    sizes = written(member.groupBy("component").agg(F.count("*").alias("m")), "component-sizes")
    total = sizes.agg(F.sum("m")).first()[0] or 0
    small = m.join(sizes.where(F.col("m") <= _EXACT).select("component"), "component", "left_semi")
    small = small.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(max(1, total // 2048))))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(pdf), np.int64)
        comp, mult = pdf.component.to_numpy(), pdf["mult"].to_numpy(np.int64)
        for c in np.unique(comp):
            at = np.flatnonzero(comp == c)
            x = _units(pdf.vec.iloc[at], kind)
            n[at] = _counted(x, x, mult[at], threshold) - mult[at]
        return pd.DataFrame({"cid": pdf.cid, "n": n})

    out = small.groupBy("bucket").applyInPandas(within, "cid long, n long")
    large = sizes.where(F.col("m") > _EXACT)
    if large.isEmpty():
        return out
    theta = math.acos(threshold)
    width = theta / _BINS
    big = written(m.join(large.withColumn("parts", F.ceil(F.col("m") / _PART).cast("int")), "component").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts").cast("long")).cast("int")), "large")

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _units(pdf.vec, kind)
        left, got = np.ones(len(x), bool), []
        while left.any() and len(got) < 64:
            near = x @ x[np.argmax(left)] >= threshold
            c = x[near].mean(axis=0)
            got.append(c / np.linalg.norm(c))
            left &= ~(near | (x @ got[-1] >= math.cos(theta / 2)))
        return pd.DataFrame({"component": pdf.component.iloc[:1], "centres": [np.array(got).tobytes()]})

    # about 1,000 members of each component, picked by a hash: a proven bound for a group
    sample = big.where(F.pmod(F.xxhash64("cid", F.lit(5)), F.col("m")) < 1000).groupBy("component").applyInPandas(centres, "component long, centres binary")
    first = big.groupBy("component", "parts").agg(F.min("cid").alias("cid")).join(classes.select("cid", "vec"), "cid").select("component", "parts", "vec")
    # a sample may be empty by chance: then one member is the centre
    plan = written(first.join(sample, "component", "left"), "centres")
    each = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["component", "part"]

    def centre_of(y: pd.DataFrame) -> np.ndarray:
        held = y.centres.iloc[0]
        return np.frombuffer(held, np.float64).reshape(-1, np.frombuffer(y.vec.iloc[0], kind).size) if held is not None else _units(y.vec.iloc[:1], kind)

    def place(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"component": [], "part": [], "cid": [], "vec": [], "mult": [], "cell": [], "ring": []})
        d = _angles(_units(x.vec, kind), centre_of(y))
        cell = d.argmin(axis=1)
        return x[["component", "part", "cid", "vec", "mult"]].assign(cell=cell, ring=np.floor(d[np.arange(len(d)), cell] / width).astype(np.int64))

    placed = big.groupBy(*keys).cogroup(each(plan).groupBy(*keys)).applyInPandas(place, "component long, part int, cid long, vec binary, mult long, cell int, ring int")
    placed = written(placed, "placed")
    rings = placed.groupBy("component", "cell", "ring").agg(F.sum("mult").alias("rows"), F.count("*").alias("n"))
    # at most 64 cells with a bounded number of rings
    rings = rings.groupBy("component").agg(F.collect_list(F.struct("cell", "ring", "rows")).alias("rings"))

    def sure(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"component": [], "part": [], "cid": [], "vec": [], "cell": [], "low": [], "high": [], "n": []})
        d = _angles(_units(x.vec, kind), centre_of(y))
        r = pd.DataFrame(list(y.rings.iloc[0]))
        out, n = [], np.zeros(len(x), np.int64)
        for cell, g in r.groupby("cell"):
            near, far, rows = g.ring.to_numpy() * width, (g.ring.to_numpy() + 1) * width, g["rows"].to_numpy(np.int64)
            dc = d[:, int(cell), None]
            yes = dc + far <= theta - _SURE
            no = (dc - far > theta + _SURE) | (near - dc > theta + _SURE)
            n += yes @ rows
            open_ = ~(yes | no)
            for i in np.flatnonzero(open_.any(axis=1)):
                at = g.ring.to_numpy()[open_[i]]
                out.append((i, int(cell), int(at.min()), int(at.max())))
        done = x[["component", "part", "cid"]].assign(vec=None, cell=-1, low=0, high=0, n=n)
        if not out:
            return done
        i, cell, low, high = (np.array(z) for z in zip(*out, strict=True))
        return pd.concat([done, x[["component", "part", "cid", "vec"]].iloc[i].assign(cell=cell, low=low, high=high, n=0)])

    shape = "component long, part int, cid long, vec binary, cell int, low int, high int, n long"
    told = written(placed.select(*keys, "cid", "vec").groupBy(*keys).cogroup(each(plan.join(rings, "component")).groupBy(*keys)).applyInPandas(sure, shape), "told")
    own = placed.select("cid", (-F.col("mult")).alias("n"))
    parts_n = told.where("cell < 0").select("cid", "n").union(own)
    unsure = told.where("cell >= 0")
    if not unsure.isEmpty():
        subs = placed.groupBy("component", "cell").agg(F.ceil(F.count("*") / _PART).cast("int").alias("subs"))
        asked = unsure.join(subs, ["component", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        y = placed.join(subs, ["component", "cell"]).withColumn("sub", F.pmod(F.xxhash64("cid", F.lit(9)), F.col("subs").cast("long")).cast("int"))
        needed = unsure.select("component", "cell", F.col("part").alias("asker")).distinct()
        y = y.select("component", "cell", "sub", "vec", "mult", "ring").join(needed, ["component", "cell"])
        by = ["component", "cell", "sub", "asker"]

        def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame({"cid": [], "n": []})
            ring = y.ring.to_numpy()
            open_ = (ring >= x.low.to_numpy()[:, None]) & (ring <= x.high.to_numpy()[:, None])
            link = (_units(x.vec, kind) @ _units(y.vec, kind).T >= threshold) & open_
            return pd.DataFrame({"cid": x.cid, "n": link @ y["mult"].to_numpy(np.int64)})

        parts_n = parts_n.union(asked.withColumnRenamed("part", "asker").groupBy(*by).cogroup(y.groupBy(*by)).applyInPandas(compare, "cid long, n long"))
    return out.union(parts_n.groupBy("cid").agg(F.sum("n").alias("n")))


def _audit(classes: DataFrame, member: DataFrame, kind: str, threshold: float, queries: int) -> float:
    """Of a class's true links, the share whose other end is in its component: the mean over those of `queries` classes (picked by a hash; a bounded number) that have links. Each is compared with all rows.

    Tasks count true and found links by query, so no pair leaves a task.
    """
    known = classes.join(member, "cid", "left").select("cid", "vec", "dim", F.coalesce("component", "cid").alias("component"))
    asked = known.orderBy(F.xxhash64("cid"), "cid").limit(queries).toPandas()
    by_dim = {int(d): (g.cid.to_numpy(), g.component.to_numpy(), _units(g.vec, kind)) for d, g in asked.groupby("dim")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if int(dim) in by_dim:
                    q, of, x = by_dim[int(dim)]
                    link = x @ _units(part.vec, kind).T >= threshold
                    link &= q[:, None] != part.cid.to_numpy()
                    some = np.flatnonzero(link.any(axis=1))
                    hit = link[some] & (of[some, None] == part.component.to_numpy())
                    yield pd.DataFrame({"q": q[some], "n": link[some].sum(axis=1), "hit": hit.sum(axis=1)})

    each = known.mapInPandas(run, "q long, n long, hit long").groupBy("q").agg((F.sum("hit") / F.sum("n")).alias("share"))
    return each.agg(F.avg("share")).first()[0] if asked.size and not each.isEmpty() else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 3, queries: int = 4096, recall: float = 0.98, attempts: int = 3) -> DataFrame:
    """id_col, n_links, component_id, kept, recall of every row.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do rows with null ids; vectors of different
    length never link. Equal vectors are one class while the graph is built, and all link; an id that comes with several vectors is in several classes, and each of its rows has its own links. Links are pairs with a cosine of at least `threshold` in double precision, never fewer.
    Recall is audited: the links of `queries` classes, compared with all rows, must be in components already found; while under `recall` of them are, as many tables again
    are added, and after `attempts` times it raises RuntimeError rather than give incomplete links as complete. The measured share is in column recall. Repeated rows each get a row; extra columns are ignored; an empty table gives an empty one.
    """
    rows, kind = _checked(vectors, id_col, vec_col)
    rows = written(rows.withColumn("hash", F.sha2("vec", 256)), "vectors")
    usable = rows.where("vec is not null and id is not null")
    # a class's number is its own: an id can come with several vectors
    classes = usable.groupBy("hash").agg(F.min("id").alias("least"), F.count("*").alias("mult"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits, tables = tables_for(classes.count(), threshold)
    links, share = None, 1.0
    for attempt in range(attempts):
        these = range(attempt * tables, (attempt + 1) * tables)
        lists = neighbour_lists(classes, kind, bits, these, k, rounds, threshold)
        got = lists.where(F.col("cos") >= threshold).select("u", "v")
        links, member = _enlarged(classes, lists, got if links is None else links.union(got), kind, bits, these, k, threshold)
        share = _audit(classes, member, kind, threshold, queries)
        if share >= recall:
            break
    else:
        raise RuntimeError(f"only {share:.3f} of the audited links were found; raise `attempts` or `rounds`")
    exact = exact_links(classes, member, kind, threshold)
    of = classes.select("hash", "cid", "mult", "least").join(member, "cid", "left").join(exact, "cid", "left")
    of = of.select("hash", F.coalesce("component", "cid").alias("component"), "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    first = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(first, "component").select("hash", "component_id", "n_links")
    known = rows.where("id is not null").select("id", "hash").join(of, "hash", "left").select("id", "component_id", "n_links")
    out = known.union(rows.where("id is null").select("id", F.lit(None).cast("long"), F.lit(None).cast("long")))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.lit(share).alias("recall"))
    return out.select(id_col, "n_links", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"), "recall")
