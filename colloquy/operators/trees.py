"""Statistics of logged search trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.numeric import hash_key
from colloquy.sources.cache import cut

#: Trees of more levels than this are contracted instead of walked level by level.
SHALLOW = 24
#: Rounds of contraction; each halves chains and takes leaves off, so that deeper trees than any log has are done long before.
ROUNDS = 200
#: Rows of statistics that are broadcast.
LEVELS = 1 << 16
#: Links of chains that one task folds at a time.
RUN = 1 << 18


def _by_level(nodes: DataFrame, deepest: int, gamma: float) -> DataFrame:
    """nodes with value, visits: each level is a join and a grouping by parent of that level's rows; the lineage is cut once a level."""
    done = below = None
    for level in range(deepest, -1, -1):
        here = nodes.where(F.col("level") == level)
        if below is None:
            here = here.withColumns({"_v": F.lit(None).cast("double"), "_n": F.lit(0).cast("long")})
        else:
            up = below.where("value IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.avg(F.col("action_reward") + gamma * F.col("value")).alias("_v"), F.sum("visits").alias("_n"))
            here = here.join(up, ["tree_id", "node_id"], "left")
        here = here.withColumns({"value": F.when(F.col("is_terminal"), F.lit(0.0)).otherwise(F.col("_v")), "visits": F.when(F.col("is_terminal"), F.lit(1).cast("long")).otherwise(F.coalesce("_n", F.lit(0).cast("long")))}).drop("_v", "_n")
        below = cut(here)
        done = below if done is None else done.unionByName(below)
    return done


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of about RUN rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= RUN:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _fold_run(t: pa.Table) -> pa.Table:
    """Links of one run folded by doubling onto what the last one in the run waits for; links in a circle stay as they are."""
    m = t.num_rows
    col = lambda c: pa.concat_arrays(t[c].chunks)
    tree, ids = col("tree_id").dictionary_encode(), pa.concat_arrays([col("node_id"), col("next")]).dictionary_encode()
    code = np.tile(tree.indices.to_numpy().astype(np.int64) * len(ids.dictionary), 2) + ids.indices.to_numpy()
    order = np.argsort(code[:m], kind="stable")
    at = np.minimum(np.searchsorted(code[:m][order], code[m:]), m - 1)
    first = ptr = np.where(code[:m][order][at] == code[m:], order[at], -1)
    has = lambda c: col(c).is_valid().to_numpy(zero_copy_only=False)
    was = (*(col(c).fill_null(0.0).to_numpy() for c in "abz"), has("a"), has("z"), col("n").to_numpy(), np.arange(m))
    a, b, z, ha, hz, n, last = (x.copy() for x in was)
    ptr = ptr.copy()
    for _ in range(m.bit_length() + 1):
        i = np.flatnonzero(ptr >= 0)
        j = ptr[i]
        # a child without a value is left out: where b is 0 and a is z
        new_a, new_b = np.where(ha[j], a[i] + b[i] * a[j], z[i]), np.where(ha[j], b[i] * b[j], 0.0)
        new_ha, new_z, new_hz = np.where(ha[j], ha[i], hz[i]), np.where(hz[j], a[i] + b[i] * z[j], z[i]), np.where(hz[j], ha[i], hz[i])
        a[i], b[i], z[i], ha[i], hz[i] = new_a, new_b, new_z, new_ha, new_hz
        n[i], last[i], ptr[i] = n[i] + n[j], last[j], ptr[j]
    ring = ptr >= 0
    for x, old in zip((a, b, z, ha, hz, n, last), was, strict=True):
        x[ring] = old[ring]
    aside = np.zeros(m, bool)
    aside[first[(first >= 0) & ~ring]] = True
    new = {"a": pa.array(a, mask=~ha), "b": pa.array(b), "z": pa.array(z, mask=~hz), "n": pa.array(n), "next": col("next").take(pa.array(last))}
    return pa.table([new.get(c, t[c]) for c in t.column_names] + [pa.array(aside)], names=[*t.column_names, "_aside"])


def _folded(links: DataFrame, together: bool) -> DataFrame:
    """links with _aside: whether another one of its run waits for it; that one now has its function, so nothing else asks for it before the end. Written."""
    key = ["tree_id", "node_id"]
    width = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = links.coalesce(1) if together else links.repartitionByRange(width, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            yield from _fold_run(t).to_batches(max_chunksize=1 << 16)

    return cut(dealt.mapInArrow(run, T.StructType([*links.schema.fields, T.StructField("_aside", T.BooleanType())])))


def _through(v: Column) -> Column:
    return F.when(v.isNull(), F.col("z")).otherwise(F.col("a") + F.col("b") * v)


def _spliced(links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """links without those whose hash is less than that of the link before and that of the node behind, and these; the one before takes the function of the one that leaves. Both written."""
    h = lambda node: F.xxhash64(F.lit(turn), "tree_id", node)
    less = links.where(h("node_id") < h("next"))
    less = less.select("tree_id", F.col("node_id").alias("next"), F.col("next").alias("_next"), *(F.col(c).alias(f"_{c}") for c in ("a", "b", "z", "n")), h("node_id").alias("_h"))
    d = links.hint("merge").join(less, ["tree_id", "next"], "left").withColumn("_on", F.coalesce(F.col("_h") < h("node_id"), F.lit(False)))
    d = cut(d)
    out = cut(d.where("_on").select("tree_id", F.col("next").alias("node_id"), F.col("_next").alias("next"), *(F.col(f"_{c}").alias(c) for c in ("a", "b", "z", "n"))))
    on, gap = F.col("_on"), F.col("_a").isNull()
    new = {
        "a": F.when(on, F.when(gap, F.col("z")).otherwise(F.col("a") + F.col("b") * F.col("_a"))).otherwise(F.col("a")),
        "b": F.when(on, F.when(gap, F.lit(0.0)).otherwise(F.col("b") * F.col("_b"))).otherwise(F.col("b")),
        "z": F.when(on, _through(F.col("_z"))).otherwise(F.col("z")),
        "n": F.when(on, F.col("n") + F.col("_n")).otherwise(F.col("n")),
        "next": F.when(on, F.col("_next")).otherwise(F.col("next")),
    }
    stay = d.hint("merge").join(out.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti")
    return cut(stay.select(*(new.get(c, F.col(c)).alias(c) for c in links.columns))), out


def _by_contraction(nodes: DataFrame, gamma: float) -> DataFrame:
    """nodes with value, visits, in a number of rounds that grows with the logarithm of the depth.

    A round rakes and compresses. Nodes that have become known give their share to their parent; one
    that waits for nothing more is known. One that waits for a single child is a link: its value is
    a + b V(child) if the child has a value, else z, and its visits are n more than the child's. Links are dealt
    in the order of their ids, and a task folds those of a chain that it holds: the first of them gets the function of all, the
    others are put aside. Of more links than one task folds (RUN), those of least hash are spliced out too, so chains shrink
    whatever their ids. A node has one parent, so one link at most asks for it: it is found among what has become known since the last look.
    What was put aside is told at the end, last first. Only open nodes are carried to the next round, so all rounds together
    look at a few times the nodes.
    """
    key = ["tree_id", "node_id"]
    own = nodes.select("tree_id", "node_id", "parent_id", F.col("action_reward").cast("double").alias("r"), F.coalesce("is_terminal", F.lit(False)).alias("_end"))
    new = own.where("_end").select("tree_id", "node_id", "parent_id", "r", F.lit(0.0).alias("value"), F.lit(1).cast("long").alias("visits"))
    none = F.lit(None)
    zero = {"acc": F.lit(0.0), "k": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "next": none.cast(nodes.schema["node_id"].dataType), **dict.fromkeys("abz", none.cast("double"))}
    live = own.where(~F.col("_end")).withColumns(zero).drop("_end")
    columns, aside = live.columns, []
    live, new = cut(live), cut(new)
    found = [new.where("false")]
    passed = found[0]
    for turn in range(ROUNDS):
        if live.isEmpty():
            break
        kids = live.select("tree_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("_c"), "r", none.cast("double").alias("value"), F.lit(0).cast("long").alias("visits"), F.lit(1).alias("_open"))
        kids = kids.unionByName(new.select("tree_id", F.col("parent_id").alias("node_id"), none.cast(nodes.schema["node_id"].dataType).alias("_c"), "r", "value", "visits", F.lit(0).alias("_open")))
        share = F.when(F.col("value").isNotNull(), F.col("r") + gamma * F.col("value"))
        g = kids.where("node_id IS NOT NULL").groupBy(*key).agg(F.sum(share).alias("_acc"), F.count(share).alias("_k"), F.sum("visits").alias("_n"), F.sum("_open").alias("_u"), F.max("_c").alias("_c"), F.max(F.when(F.col("_open") == 1, F.col("r"))).alias("_r"))
        d = live.hint("merge").join(g, key, "left").fillna({"_acc": 0.0, "_k": 0, "_n": 0, "_u": 0})
        free = F.col("next").isNull()
        add = {"acc": F.col("acc") + F.col("_acc"), "k": F.col("k") + F.col("_k"), "n": F.col("n") + F.col("_n")}
        d = d.withColumns({c: F.when(free, e).otherwise(F.col(c)) for c, e in add.items()})
        link, bare = free & (F.col("_u") == 1), F.col("_r").isNull()
        mean = F.col("acc") / F.nullif(F.col("k"), F.lit(0))
        d = d.withColumn("_known", free & (F.col("_u") == 0)).withColumns({
            "next": F.when(link, F.col("_c")).otherwise(F.col("next")),
            "a": F.when(link, F.when(bare, mean).otherwise((F.col("acc") + F.col("_r")) / (F.col("k") + 1))).otherwise(F.col("a")),
            "b": F.when(link, F.when(bare, F.lit(0.0)).otherwise(gamma / (F.col("k") + 1))).otherwise(F.col("b")),
            "z": F.when(link, mean).otherwise(F.col("z")),
        })
        d = cut(d.select(*columns, "_known", F.when(F.col("_known"), mean).alias("value")))
        raked = d.where("_known").select("tree_id", "node_id", "parent_id", "r", "value", F.col("n").alias("visits"))
        links, rest = d.where("next IS NOT NULL").select(*columns), d.where("next IS NULL AND NOT _known").select(*columns)
        f = _folded(links, links.count() <= RUN)
        aside.append(f.where("_aside"))
        fresh = raked.unionByName(passed).select("tree_id", F.col("node_id").alias("next"), F.col("value").alias("_v"), F.col("visits").alias("_m"), F.lit(True).alias("_is"))
        j = f.where("NOT _aside").drop("_aside").hint("merge").join(fresh, ["tree_id", "next"], "left")
        j = cut(j.select(*columns, F.coalesce("_is", F.lit(False)).alias("_known"), _through(F.col("_v")).alias("value"), (F.col("n") + F.col("_m")).alias("visits")))
        passed = j.where("_known").select("tree_id", "node_id", "parent_id", "r", "value", "visits")
        links = j.where("NOT _known").select(*columns)
        if links.count() > RUN:
            links, out = _spliced(links, turn)
            aside.append(out)
        found += [raked, passed]
        new = raked.unionByName(passed)
        live = rest.unionByName(links)
    else:
        raise ValueError(f"open after {ROUNDS} rounds: parents go round in a circle")
    found = [x.select(*key, "value", "visits") for x in found]
    for d in reversed(aside):
        if d.isEmpty():
            continue
        known = reduce(DataFrame.unionByName, found).select("tree_id", F.col("node_id").alias("next"), F.col("value").alias("_v"), F.col("visits").alias("_m"))
        d = d.join(F.broadcast(known) if known.count() <= LEVELS else known.hint("merge"), ["tree_id", "next"])
        found.append(cut(d.select(*key, _through(F.col("_v")).alias("value"), (F.col("n") + F.col("_m")).alias("visits"))))
    end = F.coalesce("is_terminal", F.lit(False))
    inner = nodes.where(~end).hint("merge").join(reduce(DataFrame.unionByName, found), key)
    return nodes.where(end).withColumns({"value": F.lit(0.0), "visits": F.lit(1).cast("long")}).unionByName(inner)


def values(nodes: DataFrame, gamma: float = 1.0, shallow: int = SHALLOW) -> DataFrame:
    """nodes(tree_id, node_id, parent_id, level, is_terminal, action_reward) with value, visits.

    A leaf that ended is worth 0, an inner node the mean over its children of reward + gamma *
    value, those without a value left out. Visits are the ended leaves at or below a node.
    Trees of up to ``shallow`` levels are walked from the deepest
    up, deeper ones contracted, in as many rounds as the depth has binary digits or so.
    """
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None:
        return nodes.withColumns({"value": F.lit(None).cast("double"), "visits": F.lit(0).cast("long")})
    return _by_level(nodes, deepest, gamma) if deepest <= shallow else _by_contraction(nodes, gamma)


def backup(nodes: DataFrame, gamma: float = 1.0, only_critic: bool = False, shallow: int = SHALLOW) -> DataFrame:
    """nodes with what :func:`values` gives, and advantage, by their critic_value too.

    The root has no advantage; others have r + gamma * V(s') - V(s), by critic values for only
    children, over visits.
    """
    done = values(nodes, gamma, shallow)
    up = done.select("tree_id", F.col("node_id").alias("parent_id"), F.col("value").alias("_pv"), F.col("critic_value").alias("_pc"))
    d = done.withColumn("_kids", F.count("*").over(Window.partitionBy("tree_id", "parent_id"))).join(up, ["tree_id", "parent_id"], "left")
    by_critic = F.lit(only_critic) | (F.col("_kids") == 1)
    gain = F.when(by_critic, F.col("action_reward") + gamma * F.col("critic_value") - F.col("_pc")).otherwise(F.col("action_reward") + gamma * F.col("value") - F.col("_pv"))
    return d.withColumn("advantage", F.when(F.col("parent_id").isNotNull(), gain / F.greatest("visits", F.lit(1)))).drop("_pv", "_pc", "_kids")


def sibling_statistics(nodes: DataFrame) -> DataFrame:
    """level, mean, std (population) of the variances of siblings' critic values by their parent's level, and over all levels (level null)."""
    w = nodes.where("parent_id IS NOT NULL").groupBy("tree_id", "parent_id").agg(F.var_pop("critic_value").alias("v"), F.count("*").alias("n"), (F.min("level") - 1).alias("level"))
    return w.where("n > 1").groupingSets([[], ["level"]], "level").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def prune_siblings(nodes: DataFrame, threshold: float, seed: str = "7", stats: DataFrame | None = None, w_var: float = 0.3, w_gap: float = 0.7, chance: float = 0.9) -> DataFrame:
    """Children that stay: one by hash of the children of a parent that is pruned, all of the others.

    A parent of several children is pruned if w_var * z + w_gap * |critic value - mean of the
    children's| is below the threshold and its draw (by hash) below ``chance``. z is the variance of
    the children's values, normalised by stats(level, mean, std) of the parent's level, else by
    those of all levels (level null), else as it is.
    """
    w = Window.partitionBy("tree_id", "parent_id")
    kids = nodes.where("parent_id IS NOT NULL").withColumns({"_v": F.var_pop("critic_value").over(w), "_q": F.avg("critic_value").over(w), "_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(hash_key(seed, "tree_id", "node_id")))})
    up = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("critic_value").alias("_pc"), F.col("level").alias("_pl"))
    d = kids.hint("merge").join(up, ["tree_id", "parent_id"])
    z = F.col("_v")
    if stats is not None:
        by = cut(stats.where("level IS NOT NULL").select(F.col("level").alias("_pl"), F.col("mean").alias("_m"), F.col("std").alias("_s")))
        by = F.broadcast(by) if by.count() <= LEVELS else by.hint("merge")
        all_ = F.broadcast(stats.where("level IS NULL").agg(F.max("mean").alias("_gm"), F.max("std").alias("_gs")))
        d = d.join(by, "_pl", "left").crossJoin(all_)
        score = lambda m, s: (F.col("_v") - F.col(m)) / (F.col(s) + F.lit(1e-7))
        z = F.when(F.col("_m").isNotNull(), score("_m", "_s")).when(F.col("_gm").isNotNull(), score("_gm", "_gs")).otherwise(F.col("_v"))
    u = F.conv(F.substring(hash_key(seed + "u", "tree_id", "parent_id"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    pruned = (F.col("_n") > 1) & (w_var * z + w_gap * F.abs(F.col("_pc") - F.col("_q")) < threshold) & (u < chance)
    return d.where(~pruned | (F.col("_k") == 1)).select(*nodes.columns)
