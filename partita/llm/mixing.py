"""Problem 8: mix sources to target shares of the tokens, with capped repeats."""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.operators.ranking import global_rank, hash_order
from partita.session import broadcast_small, cut_lineage

#: Where the public vocabulary lies, and (fixed value) the pattern that cuts text before byte pairs are merged.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Membership patterns that are routed as such; texts of smaller patterns are routed source by source.
MAX_PATTERNS = 50_000
_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The byte-pair encoder of a vocabulary file, once per process."""
    if vocabulary not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines()) if a}
        _encoders[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _measure(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        e = encoder(vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [len(e.encode_ordinary(t)) for t in texts]
            h = [xxhash.xxh3_128_hexdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(h, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "source", "content", "n_tokens"])

    return run


def measured(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, content, n_tokens) of every non-null text; sources trimmed and lower-cased, empty is none."""
    source = F.lower(F.trim("source"))
    rows = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(source != "", source).alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure(vocabulary), "doc_id bigint, source string, content string, n_tokens bigint")


def min_cost_flow(arcs: list[tuple[int, int, int, int]], nodes: int, s: int, t: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a cheapest largest flow.

    Primal-dual: node potentials from shortest paths, then all flow that fits on arcs of reduced cost
    zero at once, level by level. There are as many rounds as different path costs, however many units flow.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in arcs:
        for x, y, k, z in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(z)
    potential = [0] * nodes
    while True:
        far: list[float] = [math.inf] * nodes
        far[s] = 0
        heap = [(0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if cap[e] > 0 and (z := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]] = z
                    heapq.heappush(heap, (z, to[e]))
        if far[t] == math.inf:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        for x in range(nodes):
            potential[x] += int(min(far[x], far[t]))
        while _fill_levels(to, cap, cost, out, potential, s, t):
            pass


def _fill_levels(to: list[int], cap: list[int], cost: list[int], out: list[list[int]], potential: list[int], s: int, t: int) -> bool:
    """One blocking flow over arcs of reduced cost zero; False if none reaches t."""
    free = lambda x, e: cap[e] > 0 and cost[e] + potential[x] == potential[to[e]]
    level = [-1] * len(out)
    level[s], line = 0, [s]
    while line and level[t] < 0:
        following = []
        for x in line:
            for e in out[x]:
                if level[to[e]] < 0 and free(x, e):
                    level[to[e]] = level[x] + 1
                    following.append(to[e])
        line = following
    if level[t] < 0:
        return False
    at, path, x = [0] * len(out), [], s
    while True:
        if x == t:
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push
            full = next(i for i, e in enumerate(path) if not cap[e])
            x = to[path[full] ^ 1]
            del path[full:]
            continue
        while at[x] < len(out[x]) and not (free(x, e := out[x][at[x]]) and level[to[e]] == level[x] + 1):
            at[x] += 1
        if at[x] < len(out[x]):
            path.append(out[x][at[x]])
            x = to[path[-1]]
        elif x == s:
            return True
        else:
            x = to[path.pop() ^ 1]
            at[x] += 1


def repeat_steps(once: int, reach: int) -> list[tuple[int, int]]:
    """(tokens, cost) of the uses of a pattern's texts: the first costs nothing, later ones the number of doublings.

    The cost of the n-th use is convex in n, and its steps are as many as the doublings, however often the texts can be used.
    """
    steps, width, level = [], once, 0
    while reach > 0 and once > 0:
        steps.append((min(width, reach), level))
        reach -= width
        width, level = width * (2 if level else 1), level + 1
    return steps


def plan_mix(patterns: list[tuple[str, int, dict[str, int]]], targets: list[tuple[str, float, int]], total: int) -> tuple[dict[tuple[str, str], int], dict[str, tuple[int, int]]]:
    """({(pattern, source): tokens given}, {source: (quota, tokens it gets)}). patterns: (name, tokens of its texts once, tokens its rows have in each source).

    A pattern's tokens are routed to the quotas of its sources, at most max_repeats times its rows, at
    convex costs (see repeat_steps), so texts that several sources share are spread before any is repeated. The flow is a largest one: a
    source whose quota arc is not full cannot reach its share.
    """
    index = {q: 2 + len(patterns) + i for i, (q, _, _) in enumerate(targets)}
    repeats = {q: r for q, _, r in targets}
    arcs, what = [], []
    for p, (name, once, has) in enumerate(patterns):
        has = {q: m for q, m in has.items() if m and q in repeats}
        for tokens, cost in repeat_steps(once, sum(m * repeats[q] for q, m in has.items())):
            arcs.append((0, 2 + p, tokens, cost))
            what.append(None)
        for q, m in sorted(has.items()):
            arcs.append((2 + p, index[q], m * repeats[q], 0))
            what.append((name, q))
    for q, w, _ in targets:
        arcs.append((index[q], 1, max(0, math.ceil(w * total)), 0))
        what.append(q)
    flow = min_cost_flow(arcs, 2 + len(patterns) + len(targets), 0, 1)
    gives, gets = {}, {}
    for k, f, arc in zip(what, flow, arcs, strict=True):
        if isinstance(k, tuple):
            gives[k] = f
        elif k is not None:
            gets[k] = (arc[2], f)
    return gives, gets


def _units(documents: DataFrame, targets: list[tuple[str, float, int]], vocabulary: str) -> tuple[DataFrame, int]:
    """(pattern, source, content, doc_id, n_tokens, copies) of each distinct text of each wanted source, and the tokens of all texts."""
    rows = cut_lineage(measured(documents, vocabulary))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    per = rows.where("source is not null").groupBy("content", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("copies"))
    named = rows.sparkSession.createDataFrame([(q,) for q, _, _ in targets] or [("",)], "source string")
    per = per.join(broadcast_small(named, len(targets)), "source", "left_semi")
    member = per.groupBy("content").agg(F.array_join(F.array_sort(F.collect_set("source")), "\n").alias("pattern"))
    units = cut_lineage(per.join(member, "content"))
    sizes = units.groupBy("pattern").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("size"))
    if sizes.count() > MAX_PATTERNS:
        largest = cut_lineage(sizes.orderBy(F.desc("size"), "pattern").limit(MAX_PATTERNS).select("pattern", F.lit(True).alias("routed")))
        alone = F.concat(F.lit("\n"), "source")
        units = cut_lineage(units.join(largest, "pattern", "left").withColumn("pattern", F.when(F.col("routed"), F.col("pattern")).otherwise(alone)).drop("routed"))
    return units, total


def _route(units: DataFrame, targets: list[tuple[str, float, int]], total: int) -> tuple[dict[str, tuple[int, dict[str, int]]], dict[tuple[str, str], int], dict[str, tuple[int, int]]]:
    """(patterns, gives, gets): one row per pattern and source goes to the driver, at most MAX_PATTERNS patterns and the sources."""
    sums = units.groupBy("pattern", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("rows"), F.sum("n_tokens").alias("once")).collect()
    patterns: dict[str, tuple[int, dict[str, int]]] = {}
    for r in sums:
        patterns.setdefault(r.pattern, (r.once, {}))[1][r.source] = r.rows
    gives, gets = plan_mix([(p, once, has) for p, (once, has) in sorted(patterns.items())], targets, total)
    return patterns, gives, gets


def _targets(weights: DataFrame) -> list[tuple[str, float, int]]:
    """Sources are named in a table of targets, which the driver's flow needs whole; of repeated sources the largest row."""
    return sorted({r[0]: (r[0], float(r[1] or 0), int(r[2] or 0)) for r in sorted(weights.select("source", "target_weight", "max_repeats").where("source is not null").distinct().collect(), key=repr)}.values())


_REPORT = "source string, target_weight double, quota bigint, available bigint, drawn bigint, actual_share double, short boolean"


def shortfalls(documents: DataFrame, weights: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, target_weight, quota, routed, short): what the flow routes to each source; nothing is selected. See mix()."""
    targets = _targets(weights)
    units, total = _units(documents, targets, vocabulary)
    _, _, gets = _route(units, targets, total)
    rows = [(q, w, *gets[q], gets[q][1] < gets[q][0]) for q, w, _ in targets]
    return documents.sparkSession.createDataFrame(rows, "source string, target_weight double, quota bigint, routed bigint, short boolean")


def mix(documents: DataFrame, weights: DataFrame, vocabulary: str = VOCABULARY, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of a mixture of the size of the corpus.

    selection(source, doc_id, n_tokens, uses): each distinct text of a source with its smallest doc_id and
    how often it is used, at most max_repeats times its rows. report(source, target_weight, quota,
    available, drawn, actual_share, short): available tokens count each row once; the quota is
    target_weight * T rounded up, T being the tokens of all non-null texts; a source is short if the
    largest flow, in which it gets at most max_repeats * available, leaves its quota unfilled. Sources without
    a weight and documents without a source are never drawn but count in T. Null texts do not exist;
    an empty corpus gives an empty selection and no short source.
    """
    spark = documents.sparkSession
    targets = _targets(weights)
    units, total = _units(documents, targets, vocabulary)
    patterns, flows, gets = _route(units, targets, total)
    give = [(p, q, f // patterns[p][1][q], f % patterns[p][1][q]) for (p, q), f in flows.items() if f]
    plan = broadcast_small(spark.createDataFrame(give or [("", "", 0, 0)], "pattern string, source string, times bigint, rest bigint"), len(give))
    ranked = units.withColumns({"__w": F.col("n_tokens") * F.col("copies"), "__h": hash_order(F.col("content"), F.col("source"), seed=seed)})
    ranked = global_rank(ranked, ["pattern", "source"], "__h", ["content"], "__upto", weight="__w").join(plan, ["pattern", "source"])
    extra = F.when(F.col("__upto") * 2 - F.col("__w") <= F.col("rest") * 2, F.col("copies")).otherwise(0)
    selection = ranked.select("source", "doc_id", "n_tokens", (F.col("times") * F.col("copies") + F.when(F.col("rest") > 0, extra).otherwise(0)).alias("uses")).where("uses > 0")
    selection = cut_lineage(selection)
    have: dict[str, int] = {}
    for _, has in patterns.values():
        for q, n in has.items():
            have[q] = have.get(q, 0) + n
    drawn = {r[0]: r[1] for r in selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses"))).collect()}
    every = sum(drawn.values())
    report = [(q, w, gets[q][0], have.get(q, 0), drawn.get(q, 0), drawn.get(q, 0) / every if every else 0.0, gets[q][1] < gets[q][0]) for q, w, _ in targets]
    return selection, spark.createDataFrame(report, _REPORT)
