"""Problem 2: groups of related records by distributed union-find, and splits that keep groups whole."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.ranking import global_rank, hash_order
from partita.session import broadcast_small, cut_lineage

#: Links a task unites in its own forest.
LINKS_PER_TASK = 400_000
#: Levels after which the merge gives up; each level at least halves the roots that are still linked.
MAX_LEVELS = 60


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: every node seen, with the smallest node of its tree."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(z, z)
            a, z = find(a), find(z)
            if a != z:
                # Python orders strings by code point, as Spark does
                if z < a:
                    a, z = z, a
                parent[z] = a
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([find(x) for x in part], pa.string())], names=["node", "root"])


def star_links(df: DataFrame, node: str, attribute: str) -> DataFrame:
    """(a, b): every node linked to the smallest node that shares its attribute. Null attributes link nothing.

    The smallest node is found with partial aggregation; the join back gives one row per node, never a pair
    of members, and a hot attribute's side is split by AQE.
    """
    rows = df.select(F.col(node).alias("b"), F.col(attribute).alias("at")).where(F.col("at").isNotNull() & F.col("b").isNotNull())
    first = rows.groupBy("at").agg(F.min("b").alias("a"))
    return rows.join(first, "at").where(F.col("a") != F.col("b")).select("a", "b")


def _collapse(hooks: DataFrame) -> DataFrame:
    """Follow (node, root) to the last root; every root is a node. Each step doubles the distance."""
    for _ in range(MAX_LEVELS):
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        hooks = cut_lineage(hooks.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
        if not hooks.where("moved").limit(1).count():
            return hooks.drop("moved")
        hooks = hooks.drop("moved")
    raise RuntimeError("hooks form a loop")


def connected_groups(links: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node it is linked to, directly or through others.

    Local forests merged by level: tasks unite their own links; where tasks disagree on a node's root,
    the roots become links of the next level, over roots only. Each level at least halves the linked
    roots; when no link is left, the answers are put together on the way back. Null ends and loops link nothing; repeats
    do not matter. No task holds more than a share of the links, and nothing goes to the driver but counts.
    """
    x, y = F.col("a").cast("string"), F.col("b").cast("string")
    links = cut_lineage(links.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    levels: list[DataFrame] = []
    n = links.count()
    while n:
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("union-find did not converge")
        parts = max(1, -(-n // links_per_task))
        # dealt by the larger end: the smaller one is the hub of a large group and would fill one task
        forest = cut_lineage(links.repartition(parts, "b").mapInArrow(_local_forest, "node string, root string"))
        if parts == 1:
            levels.append(forest)
            break
        # where tasks disagree, a node hooks to its smallest root; hooks lead to ever smaller nodes, and are
        # followed to their end by doubling, so at least half of the roots that are still linked vanish
        hooks = _collapse(cut_lineage(forest.groupBy("node").agg(F.min("root").alias("root"))))
        levels.append(hooks)
        ends = forest.join(hooks.withColumnRenamed("root", "a"), "node").select("a", "root")
        ends = ends.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("b")), "root")
        links = cut_lineage(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        n = links.count()
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[0]
    for level in levels[1:]:
        up = level.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        out = out.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return out


def _fill(sizes: list[tuple[int, int]], targets: list[Fraction]) -> list[tuple[int, int, int]]:
    """Greedy largest-first over (size, how many): (size, split, how many).

    Each group goes to the split furthest below its target (ties: the first). What a split lacks falls by one size
    with each group it takes, so the greedy serves the largest of the splits' falling sequences, and
    groups of one size are dealt in closed form: down to a common level of what is lacking every split takes
    what lies above it; the few groups left over are dealt one by one. Equal to dealing all one by one, in exact numbers.
    """
    left = [Fraction(t) for t in targets]
    out: list[tuple[int, int, int]] = []
    for size, count in sorted(sizes, reverse=True):
        took = [0] * len(left)
        # the level under which the lacks above it would take all groups, if groups could be split
        lacks = sorted(left, reverse=True)
        for k in range(1, len(lacks) + 1):
            level = (sum(lacks[:k]) - count * size) / k
            if k == len(lacks) or level >= lacks[k]:
                break
        for i, lack in enumerate(left):
            took[i] = max(0, math.ceil((lack - level - size) / size))
        left = [x - m * size for x, m in zip(left, took, strict=True)]
        for _ in range(count - sum(took)):
            k = max(range(len(left)), key=lambda i: (left[i], -i))
            left[k] -= size
            took[k] += 1
        out += [(size, k, m) for k, m in enumerate(took) if m]
    return out


def assign_splits(groups: DataFrame, names: list[str], shares: list[float], seed: int = 0) -> DataFrame:
    """(node, root, split): whole groups dealt to splits, largest group first, to the split furthest below its target.

    ``groups(node, root)`` has every node once. What the driver sees is how many groups there are of
    each size (a few rows: n nodes have fewer than sqrt(2 n) different sizes); inside a size groups
    are taken in seeded order. Empty input gives empty output.
    """
    sizes = cut_lineage(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    table = [(r[0], r[1]) for r in sizes.groupBy("size").count().collect()]
    total = sum(s * c for s, c in table)
    plan, at = [], {}
    for size, k, m in _fill(table, [total * Fraction(str(x)) for x in shares]):
        lo = at.get(size, 0)
        plan.append((size, lo, lo + m, names[k]))
        at[size] = lo + m
    deal = groups.sparkSession.createDataFrame(plan or [(0, 0, 0, "")], "size bigint, lo bigint, hi bigint, split string")
    ranked = global_rank(sizes.withColumn("__h", hash_order(F.col("root"), seed=seed)), ["size"], "__h", ["root"], "__rank", rows=sum(c for _, c in table))
    dealt = ranked.join(broadcast_small(deal, len(plan)), "size").where((F.col("__rank") > F.col("lo")) & (F.col("__rank") <= F.col("hi"))).select("root", "split")
    return groups.join(dealt, "root").select("node", "root", "split")


def composition_signature(chords: Column) -> Column:
    """Signature of an array of canonical chords up to transposition; null below three different chords.

    Nulls, N and X are left out, repeats collapsed; qualities stay and roots count from the first one.
    """
    named = F.filter(chords, lambda c: c.isNotNull() & c.contains(":") & ~c.startswith("?"))
    shifted = F.concat(F.array(F.lit("")), F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0))))
    kept = F.filter(F.zip_with(named, shifted, lambda a, b: F.when(a != b, a)), lambda c: c.isNotNull())
    root = lambda c: F.substring_index(c, ":", 1).cast("int")
    first = root(F.try_element_at(kept, F.lit(1)))
    steps = F.transform(kept, lambda c: F.concat(F.pmod(root(c) - first, F.lit(12)).cast("string"), F.lit(":"), F.substring_index(c, ":", -1)))
    return F.when(F.size(F.array_distinct(kept)) >= 3, F.array_join(steps, " "))


# Artist names that stand for none, after normalising; and leading articles.
PLACEHOLDERS = ("", "unknown", "unknown artist", "artist unknown", "n a", "na", "none", "null", "nil", "v a", "va", "various", "various artists", "artists various", "anonymous", "tba", "untitled")
ARTICLES = ("the", "a", "an", "der", "die", "das", "le", "la", "les", "el", "los", "las")


def _artist_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import unicodedata

    import regex

    words = regex.compile(r"[\p{L}\p{N}]+")
    for b in batches:
        out = []
        for name in b.column("artist").to_pylist():
            if name is None:
                out.append(None)
                continue
            # NFKD and the dropping of marks make accents alike; a trailing article after a comma leads
            plain = "".join(c for c in unicodedata.normalize("NFKD", name).casefold() if not unicodedata.combining(c))
            w = words.findall(plain)
            if " ".join(w) in PLACEHOLDERS:
                out.append(None)
                continue
            head, comma, tail = plain.rpartition(",")
            if comma and len(t := words.findall(tail)) > 1 and t[0] in ARTICLES:
                w = words.findall(head) + t[1:]
            elif comma and len(t) == 1 and t[0] in ARTICLES:
                w = words.findall(head)
            elif len(w) > 1 and w[0] in ARTICLES:
                w = w[1:]
            out.append(" ".join(sorted(w)) or None)
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.string())], names=["key", "artist"])


def artist_names(tracks: DataFrame) -> DataFrame:
    """(key, artist): names that differ only in case, accents, blanks, punctuation, word order or a leading article are equal; placeholders are null."""
    return tracks.select(F.col("key").cast("string").alias("key"), F.col("artist").cast("string").alias("artist")).mapInArrow(_artist_names, "key string, artist string")


def latest_rows(df: DataFrame, key: str, newest: str, *columns: Column) -> DataFrame:
    """One row per non-null key: that of the latest ``newest`` (null times come first; of equal times any, they are repeats)."""
    w = Window.partitionBy(key).orderBy(F.col("__newest").desc_nulls_last())
    rows = df.where(F.col(key).isNotNull()).select(F.col(key), F.col(newest).alias("__newest"), *columns)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__newest")


def related_links(entities: DataFrame, tracks: DataFrame) -> DataFrame:
    """(a, b) links between keys of one tape, one artist or one composition. ``entities(key, chords)`` has each key once."""
    tape = entities.select("key", F.regexp_replace("key", "_[^_]*$", "").alias("at"))
    known = artist_names(tracks).where("artist is not null").join(entities.select("key"), "key", "left_semi")
    artist = known.select("key", F.col("artist").alias("at")).distinct()
    comp = cut_lineage(entities.select("key", F.sha2(composition_signature(F.col("chords")), 256).alias("at")))
    return star_links(tape, "key", "at").unionByName(star_links(artist, "key", "at")).unionByName(star_links(comp, "key", "at"))
