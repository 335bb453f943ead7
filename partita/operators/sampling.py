"""Deterministic sampling and streams: everything is ordered by md5(id | seed), then id, and ranked without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.ranking import BUCKET_ROWS, global_rank, null_safe_join, number_rows, with_offsets
from partita.session import broadcast_small, cut_lineage


def md5_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by |, as text."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def ranked(df: DataFrame, by: list[str], key: Column, tie: str, out: str = "rank") -> DataFrame:
    """Rank from 1 per group in the order of an md5 text, then tie; the text's first 15 digits choose the bucket."""
    keyed = df.withColumn("__k", key).withColumn("__o", F.conv(F.substring("__k", 1, 15), 16, 10).cast("bigint") * 4)
    return global_rank(keyed, by, "__o", ["__k", tie], out).drop("__k", "__o")


def positions(df: DataFrame, order: list[str], out: str = "position", rows: int = BUCKET_ROWS) -> DataFrame:
    """Position from 0 over all rows by an order that is unique and begins with a number; buckets of that are ranked apart.

    The buckets cut the number's range evenly into about one per ``rows`` rows, so their number follows the rows, not the range.
    """
    at = F.col(order[0])
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
    width = max(1, -(-(hi - lo + 1) * rows // n)) if lo is not None else 1
    b = df.withColumn("__b", F.coalesce(F.floor((at - F.lit(lo or 0)) / width), F.lit(-1)))
    off = with_offsets(b, [], "__b", {"__off": F.lit(1)})
    w = Window.partitionBy("__b").orderBy(*order)
    return null_safe_join(b.withColumn("__in", F.row_number().over(w)), off, ["__b"]).withColumn(out, (F.col("__off") + F.col("__in") - 1).cast("bigint")).drop("__in", "__off", "__b")


def kfold(df: DataFrame, id_: str, folds: int, valid_ratio: float, seed: int, by: str | None = None) -> DataFrame:
    """(fold, split, id): each item is tested in one fold; int(ratio * rest) random others validate, the remainder trains.

    With ``by`` each of its values (a subset) is dealt to the folds on its own, and is in the result.
    """
    by_ = [by] if by else []
    df = df.select(*by_, id_)
    n = df.groupBy(*by_).agg(F.count(F.lit(1)).alias("n"))
    r = ranked(df, by_, md5_key(F.col(id_), seed), id_)
    r = null_safe_join(r, n, by_) if by else r.join(F.broadcast(n))  # one row
    tested = F.floor((F.col("rank") - 1) * folds / F.col("n")).cast("int")
    each = r.withColumn("own", tested).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rest = ranked(each.where("own <> fold"), [*by_, "fold"], md5_key(F.col(id_), F.col("fold"), seed), id_, "pick")
    # the test part of fold f begins and ends at these ranks
    size = F.ceil((F.col("fold") + 1) * F.col("n") / folds) - F.ceil(F.col("fold") * F.col("n") / folds)
    limit = F.floor((F.col("n") - size) * F.lit(valid_ratio))
    split = rest.select(*by_, "fold", F.when(F.col("pick") <= limit, "valid").otherwise("train").alias("split"), id_)
    return split.unionByName(each.where("own = fold").select(*by_, "fold", F.lit("test").alias("split"), id_))


def working_set_stream(df: DataFrame, id_: str, by: str, working_set: int, visit: int, seed: int) -> DataFrame:
    """(position, slot, by, id): a pool of ``working_set`` open keys take turns; after ``visit`` samples a key makes room for the next.

    A key's rows come in random order and are cut into visits; visits are dealt to the slots round by round
    (first all first visits, keys in random order), and in a round the slots give one sample each in turn. Every row comes once.
    """
    r = ranked(df.select(by, id_).where(F.col(by).isNotNull()), [by], md5_key(F.col(id_), seed), id_, "__k2").withColumns({"__visit": F.floor((F.col("__k2") - 1) / visit), "__draw": F.pmod(F.col("__k2") - 1, F.lit(visit))})
    visits = r.select(by, "__visit").distinct().withColumn("__o2", md5_key(F.col(by), F.col("__visit"), seed))
    visits = number_rows(visits, ["__visit", "__o2", by], "__turn").drop("__o2").withColumns({"__round": F.floor(F.col("__turn") / working_set), "slot": F.pmod("__turn", F.lit(working_set))})
    each = r.join(visits, [by, "__visit"])
    return number_rows(each, ["__round", "__draw", "slot"], "position").select("position", "slot", by, id_)


def two_set_stream(a: DataFrame, b: DataFrame, id_: str, label: str, low: int, high: int, seed: int) -> DataFrame:
    """uniform_classes() of two sets of rows, of the second only classes from ``low`` to ``high`` (without it): (position, source, id, label)."""
    rows = a.select(F.lit(0).alias("source"), id_, label).unionByName(b.where((F.col(label) >= low) & (F.col(label) < high)).select(F.lit(1).alias("source"), id_, label))
    rows = rows.withColumn("__id", F.struct("source", id_).cast("string"))
    s = uniform_classes(rows.select("__id", label), "__id", label, seed)
    return s.join(rows.select("__id", "source", id_), "__id").select("position", "source", id_, label)


def scored_triples(df: DataFrame, id_: str, label: str, seed: int) -> DataFrame:
    """(id, other, target): pairs from triples of two successive samples of a class (target 1) and one of the next class (target 0).

    The samples of a class come in random order, two by two; the third is that of the next class in class order, with the
    same number as the pair (modulo that class's size). A class's last odd sample is left out.
    """
    c = F.col
    rows = df.where(c(label).isNotNull()).select(c(id_).alias("__id"), c(label).alias("__c"))
    r = ranked(rows, ["__c"], md5_key(c("__id"), seed), "__id", "__r")
    sizes = cut_lineage(number_rows(cut_lineage(r.groupBy("__c").agg(F.count(F.lit(1)).alias("__size"))), ["__c"], "__no"))
    n = sizes.count()
    after = sizes.select(F.pmod(c("__no") - 1, F.lit(max(n, 1))).alias("__no"), c("__c").alias("__far"), c("__size").alias("__far_size"))
    classes = sizes.select("__c", "__no").join(after, "__no").drop("__no")
    first = r.where("__r % 2 = 1").withColumn("__pair", F.floor(c("__r") / 2)).join(broadcast_small(classes, n), "__c")
    second = r.where("__r % 2 = 0").select("__c", (c("__r") / 2 - 1).cast("bigint").alias("__pair"), c("__id").alias("__second"))
    both = first.join(second, ["__c", "__pair"]).withColumn("__k", F.pmod("__pair", c("__far_size")) + 1)
    third = r.select(c("__c").alias("__far"), c("__r").alias("__k"), c("__id").alias("__third"))
    each = both.join(third, ["__far", "__k"])
    pairs = F.array(F.struct(c("__second").alias("other"), F.lit(1).alias("target")), F.struct(c("__third").alias("other"), F.lit(0).alias("target")))
    return each.select(c("__id").alias(id_), F.explode(pairs).alias("__p")).select(id_, "__p.*")


def uniform_classes(df: DataFrame, id_: str, label: str, seed: int) -> DataFrame:
    """(position, id, label): classes take turns, each in its own random order; a class that is used up is skipped."""
    r = ranked(df.where(F.col(label).isNotNull()).select(id_, label), [label], md5_key(F.col(id_), seed), id_)
    # the k-th rows of all classes come before every k+1-th row, in class order
    return positions(r, ["rank", label]).select("position", id_, label)


def weighted_mux(a: DataFrame, b: DataFrame, id_: str, weights: tuple[int, int], seed: int) -> DataFrame:
    """(position, source, id): two streams interleaved by integer weights, each in its own random order; a used-up stream ends."""
    out = []
    for s, (mine, other, w, v) in enumerate(((a, b, weights[0], weights[1]), (b, a, weights[1], weights[0]))):
        n = other.agg(F.count(F.lit(1)).alias("n"))
        r = ranked(mine.select(id_), [], md5_key(F.col(id_), seed), id_).join(F.broadcast(n))
        # rows of the other stream whose turn (2 m - 1) / v comes before mine, (2 k - 1) / w; the first stream goes first on a tie
        x = (F.col("rank") * 2 - 1) * v
        before = F.floor((F.floor((x - (1 if s == 0 else 0)) / w) + 1) / 2)
        out.append(r.select((F.col("rank") - 1 + F.least("n", before)).cast("bigint").alias("position"), F.lit(s).alias("source"), id_))
    return out[0].unionByName(out[1])


def contrastive_pairs(df: DataFrame, id_: str, label: str, seed: int) -> DataFrame:
    """(id, label, other, target): every row with the next of its class (target 1) and with one of another class (target 0).

    The other class is drawn by hash; its row has the same rank, modulo the class's size. Both are equi-joins on
    (class, rank), so no pairs of a class are formed. The last of a class meets its first; a lone row meets itself. Rows without a class are left out.
    """
    r = ranked(df.where(F.col(label).isNotNull()).select(id_, label), [label], md5_key(F.col(id_), seed), id_)
    sizes = cut_lineage(r.groupBy(label).agg(F.count(F.lit(1)).alias("size")))
    n = sizes.count()
    # classes are numbered in their order, and looked up by label and by number
    numbered = cut_lineage(number_rows(sizes, [label]))
    numbers = numbered.select(F.col(label).alias("__c"), "number", "size")
    step = 1 + F.pmod(F.conv(F.substring(md5_key(F.col(id_), "other", seed), 1, 8), 16, 10).cast("bigint"), F.lit(max(n - 1, 1)))
    mine = r.join(broadcast_small(numbers, n), F.col(label) == F.col("__c")).drop("__c")
    mine = mine.withColumn("far", F.pmod(F.col("number") + step, F.lit(max(n, 1))))
    other = numbered.select(F.col("number").alias("far"), F.col(label).alias("__fc"), F.col("size").alias("__fs"))
    mine = mine.join(broadcast_small(other, n), "far")
    want = mine.select(
        id_,
        label,
        F.explode(F.array(F.struct(F.lit(1).alias("target"), F.col(label).alias("c"), (F.pmod(F.col("rank"), F.col("size")) + 1).alias("k")), F.struct(F.lit(0).alias("target"), F.col("__fc").alias("c"), (F.pmod(F.col("rank") - 1, F.col("__fs")) + 1).alias("k")))).alias("w"),
    )
    found = r.select(F.col(label).alias("__c"), F.col("rank").alias("__k"), F.col(id_).alias("other"))
    return want.join(found, (F.col("w.c") == F.col("__c")) & (F.col("w.k") == F.col("__k"))).select(id_, label, "other", F.col("w.target").alias("target"))


def categorical(df: DataFrame, id_: str, weights: DataFrame, label: str, weight: str, seed: int) -> DataFrame:
    """(id, label): a class drawn for each row by weight; the uniform number comes from the id. ``weights`` is a table of classes."""
    total, n = weights.agg(F.sum(weight), F.count(F.lit(1))).first()
    upto = number_rows(weights.select(label, weight), [label], weight=weight)
    bands = broadcast_small(upto.select(label, ((F.col("upto") - F.col(weight)) / total).alias("lo"), (F.col("upto") / total).alias("hi")), n)
    u = F.conv(F.substring(md5_key(F.col(id_), seed), 1, 8), 16, 10).cast("double") / 2**32
    return df.select(id_, u.alias("u")).join(bands, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(id_, label)


def epochs(df: DataFrame, id_: str, by: str, times: int, seed: int) -> DataFrame:
    """(by, epoch, position, id): sampling without replacement, shuffled anew in every epoch."""
    each = df.select(by, id_).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    r = ranked(each, [by, "epoch"], md5_key(F.col(id_), F.col("epoch"), seed), id_)
    return r.select(by, "epoch", (F.col("rank") - 1).alias("position"), id_)


def minibatches(df: DataFrame, order: str, size: int, kept: Column) -> DataFrame:
    """(batch, n, kept): rows in batches of ``size`` by order; null samples are dropped after batching, so batches can be short."""
    p = positions(df, [order])
    return p.groupBy(F.floor(F.col("position") / size).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"))
