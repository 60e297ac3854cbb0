"""Near-duplicate embeddings by a random-projection tree forest.

Per label, ``TREES`` trees split unit vectors at the median of a random projection. Both children keep the
vectors within ``SPILL`` of the split, so close pairs are seldom parted; a pair counts as found if any
tree leaves it in one leaf. Trees are fitted on a hash sample of at most about ``SAMPLE`` vectors of a
label (the documented bound), but every vector is routed through every tree. Where that leaves more than ``MOST`` vectors in
a leaf, the leaf is split further in the same way, fitted on a sample of its own, round by round, until leaves are small
or cannot be split: so leaves do not grow with the table. Leaves are compared by exact
cosine in double precision. A leaf over ``BLOCK`` vectors is compared in pairs of blocks, each block pair
a task of its own, so nothing is capped and no task is unbounded.

Copies collapse to one vector with a multiplicity first. A pair that shares several leaves is counted in
the first of them only (each row carries its leaves' numbers), so counts per vector, and a spanning forest
of each leaf's links, are all that leaves a task: rows grow with the vectors, not with the pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components, null labels and null ids
link with nothing; copies with one label link with each other; vectors of different lengths do not link; repeated
rows count as vectors of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialise
from .vectors import matrix, usable

COSINE = 0.98
TREES = 8
SPILL = 0.01
LEAF = 256
#: A node of which both children would keep more than this share is a leaf: its vectors lie within the spill of each other.
TIGHT = 0.65
SAMPLE = 16_384
#: Vectors in a leaf that is not split further.
MOST = 4 * LEAF
BLOCK = 2048
ROUTE_ROWS = 4096
_NODE_BITS = 40


def _direction(tree: int, node: int, dim: int):
    import numpy as np

    r = np.random.default_rng([tree, node, dim]).normal(size=dim)
    return r / np.linalg.norm(r)


def _unit(x):
    import numpy as np

    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_tree(x, tree: int, leaf: int, spill: float, root: int = 1) -> dict[int, float]:
    """Thresholds by node of a tree over unit vectors, or of what is below one of its nodes; nodes are numbered as in a heap."""
    import numpy as np

    cuts: dict[int, float] = {}
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf or node >> (_NODE_BITS - 2):
            continue
        p = x[rows] @ _direction(tree, node, x.shape[1])
        cut = float(np.median(p))
        low, high = rows[p <= cut + spill], rows[p >= cut - spill]
        if min(len(low), len(high)) > TIGHT * len(rows) or max(len(low), len(high)) == len(rows):
            continue  # a tight group: splitting it would only copy it
        cuts[node] = cut
        todo += [(2 * node, low), (2 * node + 1, high)]
    return cuts


def route(x, tree: int, cuts: dict[int, float], spill: float, root: int = 1) -> list[tuple[int, object]]:
    """(leaf, row numbers) of all leaves that rows of ``x`` reach."""
    import numpy as np

    out, todo = [], [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        cut = cuts.get(node)
        if cut is None:
            out.append((node, rows))
            continue
        p = x[rows] @ _direction(tree, node, x.shape[1])
        todo += [(2 * node, rows[p <= cut + spill]), (2 * node + 1, rows[p >= cut - spill])]
    return out


def spanning_edges(linked) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of a symmetric boolean matrix of links."""
    import numpy as np

    left, edges = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        if not left[i]:
            continue
        left[i], front = False, [i]
        while front:
            u = front.pop()
            hit = np.flatnonzero(linked[u] & left)
            left[hit] = False
            edges += [(u, int(v)) for v in hit]
            front += hit.tolist()
    return edges


def compare_leaf(key: int, ids, mult, x, leaves: list, cosine: float, half=None):
    """Link counts of the pairs whose first common leaf is ``key``, and a spanning forest of all links.

    ``half``: with two blocks, which rows are the second's; then only pairs across count.
    """
    import numpy as np

    x = _unit(x)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if half is not None:
        linked &= half[:, None] != half[None, :]
    used = np.flatnonzero(linked.any(1))
    if not len(used):
        return [], []
    linked = linked[np.ix_(used, used)]
    earlier = [np.asarray(leaves[i], np.int64) for i in used]
    earlier = [e[e < key] for e in earlier]
    names, flat = np.unique(np.concatenate(earlier), return_inverse=True)
    member = np.zeros((len(used), max(1, len(names))), np.float32)
    member[np.repeat(np.arange(len(used)), [len(e) for e in earlier]), flat] = 1
    first = linked & (member @ member.T < 0.5)
    counts = first @ mult[used].astype(np.float64)
    return [(ids[used[i]], int(c)) for i, c in enumerate(counts) if c], [(ids[used[a]], ids[used[b]]) for a, b in spanning_edges(linked)]


def refined(sent: DataFrame, path: str, leaf: int, spill: float, sample: int, most: int, rounds: int = 8) -> tuple[DataFrame, str]:
    """``sent`` with leaves over ``most`` vectors split further, and its path; see :func:`near_duplicates` for its columns.

    Each round fits a large leaf on a sample of at most about ``sample`` of its vectors and routes all of them. Leaves
    that cannot be split, tight groups, stay.
    """
    place, kind = ["label", "dim", "key"], dict(sent.dtypes)
    head = f"label {kind['label']}, dim int, key long"
    at_first = path

    def grow(key, pdf):
        import numpy as np
        import pandas as pd

        k, least = int(key[2]), max(16, int(leaf * min(1.0, float(pdf["share"].iloc[0]))))
        cuts = fit_tree(_unit(matrix(pdf["v"])), k >> _NODE_BITS, least, spill, k & ((1 << _NODE_BITS) - 1))
        rows = [(*key, np.array(list(cuts), np.int64).tobytes(), np.array(list(cuts.values()), np.float64).tobytes())] if cuts else []
        return pd.DataFrame(rows, columns=[*place, "nodes", "cuts"]).astype({"dim": "int32", "key": "int64"})

    def send(key, a, b):
        import numpy as np
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in (*place, "rep", "mult", "v")})
        k = int(key[2])
        tree, root = k >> _NODE_BITS, k & ((1 << _NODE_BITS) - 1)
        cuts = dict(zip(np.frombuffer(b["nodes"].iloc[0], np.int64).tolist(), np.frombuffer(b["cuts"].iloc[0], np.float64).tolist(), strict=True))
        found = route(_unit(matrix(a["v"])), tree, cuts, spill, root)
        r = np.concatenate([rows for _, rows in found])
        keys = np.concatenate([np.full(len(rows), (tree << _NODE_BITS) | node, np.int64) for node, rows in found])
        return pd.DataFrame({"label": key[0], "dim": key[1], "key": keys, "rep": a["rep"].to_numpy()[r], "mult": a["mult"].to_numpy()[r], "v": [a["v"].iloc[i] for i in r]})

    for turn in range(rounds):
        large, large_path = materialise(sent.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "large")
        if not large.limit(1).count():
            discard(sent.sparkSession, large_path)
            break
        some = sent.join(large, place).withColumn("share", F.lit(float(sample)) / F.col("n"))
        some = some.where(F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1_000_000)) < F.col("share") * 1_000_000).select(*place, "v", "share")
        model, model_path = materialise(some.groupBy(*place).applyInPandas(grow, f"{head}, nodes binary, cuts binary"), "trees")
        if not model.limit(1).count():
            for p in (model_path, large_path):
                discard(sent.sparkSession, p)
            break
        parts = large.join(model.select(*place), place).withColumn("parts", F.ceil(F.col("n") / ROUTE_ROWS).cast("int")).drop("n")
        left = sent.join(parts, place).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        right = model.join(parts, place).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        moved = left.groupBy(*place, "part").cogroup(right.groupBy(*place, "part")).applyInPandas(send, f"{head}, rep {kind['rep']}, mult long, v {kind['v']}")
        stay = sent.join(model.select(*place), place, "left_anti").select(*place, "rep", "mult", "v")
        sent, path2 = materialise(stay.unionByName(moved), "leaves")
        for p in (path, model_path, large_path):
            discard(sent.sparkSession, p)
        path = path2
    if path == at_first:
        return sent, path
    own = sent.groupBy("label", "dim", "rep").agg(F.sort_array(F.collect_list("key")).alias("leaves"))  # a vector's leaves: a few for each tree
    sent, path2 = materialise(sent.join(own, ["label", "dim", "rep"]).select(*place, "rep", "mult", "v", "leaves"), "leaves")
    discard(sent.sparkSession, path)
    return sent, path2


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, sample: int = SAMPLE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    valid = rows.where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    reps = valid.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    # vectors of another length are in another space: their trees are their own
    reps, _ = materialise(reps.withColumn("dim", F.size("v")), "vectors")
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    kind = dict(reps.dtypes)
    head = f"label {kind['label']}, dim int"

    def grow(key, pdf):
        import numpy as np
        import pandas as pd

        x, share = _unit(matrix(pdf["v"])), float(pdf["share"].iloc[0])
        least = max(16, int(leaf * min(1.0, share)))
        found = [fit_tree(x, t, least, spill) for t in range(trees)]
        return pd.DataFrame({"label": key[0], "dim": key[1], "tree": range(trees), "nodes": [np.array(list(c), np.int64).tobytes() for c in found], "cuts": [np.array(list(c.values()), np.float64).tobytes() for c in found]})

    sampled = reps.join(sizes, ["label", "dim"]).withColumn("share", F.lit(float(sample)) / F.col("n"))
    sampled = sampled.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("label", "dim", "v", "share")
    model = sampled.groupBy("label", "dim").applyInPandas(grow, f"{head}, tree int, nodes binary, cuts binary")
    model, trees_path = materialise(model, "trees")

    parts = sizes.withColumn("parts", F.ceil(F.col("n") / ROUTE_ROWS).cast("int")).drop("n")
    left = reps.join(parts, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")
    right = model.join(parts, ["label", "dim"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def send(key, a, b):
        import numpy as np
        import pandas as pd

        if not len(a):
            return pd.DataFrame({"label": [], "dim": [], "key": [], "rep": [], "mult": [], "v": [], "leaves": []})
        x = _unit(matrix(a["v"]))
        rows_of, keys_of = [], []
        for t, n, c in zip(b["tree"], b["nodes"], b["cuts"], strict=True):
            cuts = dict(zip(np.frombuffer(n, np.int64).tolist(), np.frombuffer(c, np.float64).tolist(), strict=True))
            for node, rows in route(x, t, cuts, spill):
                rows_of.append(rows)
                keys_of.append(np.full(len(rows), (int(t) << _NODE_BITS) | node, np.int64))
        r, k = np.concatenate(rows_of), np.concatenate(keys_of)
        order = np.lexsort((k, r))
        r, k = r[order], k[order]
        ends = np.cumsum(np.bincount(r, minlength=len(a)))
        mine = [k[s:e] for s, e in zip(np.concatenate(([0], ends[:-1])), ends)]
        return pd.DataFrame({"label": key[0], "dim": key[1], "key": k, "rep": a["rep"].to_numpy()[r], "mult": a["mult"].to_numpy()[r], "v": [a["v"].iloc[i] for i in r], "leaves": [mine[i] for i in r]})

    sent = left.groupBy("label", "dim", "part").cogroup(right.groupBy("label", "dim", "part")).applyInPandas(send, f"{head}, key long, rep {kind['rep']}, mult long, v {kind['v']}, leaves array<long>")
    sent, leaves_path = materialise(sent, "leaves")
    discard(df.sparkSession, trees_path)
    sent, leaves_path = refined(sent, leaves_path, leaf, spill, sample, most)

    place = ["label", "dim", "key"]
    blocks = sent.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    pairs = sent.join(blocks, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    pairs = pairs.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(*place, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "mult", "v", "leaves")

    def compare(key, pdf):
        import numpy as np
        import pandas as pd

        own = pdf["own"].to_numpy()
        counts, edges = compare_leaf(int(key[2]), pdf["rep"].to_numpy(), pdf["mult"].to_numpy(), matrix(pdf["v"]), pdf["leaves"].tolist(), cosine, own if key[3] != key[4] else None)
        return pd.DataFrame({"kind": [0] * len(counts) + [1] * len(edges), "a": [r[0] for r in counts] + [r[0] for r in edges], "b": [r[1] for r in counts] + [r[1] for r in edges]}).astype({"kind": "int32", "a": "int64", "b": "int64"})

    found, _ = materialise(pairs.groupBy(*place, "i", "j").applyInPandas(compare, "kind int, a long, b long"), "links")
    discard(df.sparkSession, leaves_path)
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = connected_components(found.where("kind = 1")).select(F.col("node").alias("rep"), "root")
    info = reps.join(links, "rep", "left").join(roots, "rep", "left")
    info = info.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    out = rows.join(info, ["label", "v"], "left")
    took_part = F.col("vec_id").isNotNull()
    root = F.when(took_part, F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.when(took_part, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))
