"""Problem 1: records of evaluation splits that also appear, exactly or almost, in training splits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.session import cut_lineage

#: Fixed parameters of what counts as the same recording.
MAX_OFFSET, MIN_FRAMES, MIN_SHARE, MIN_COSINE = 3, 8, 0.6, 0.96
#: Frames of a chunk. Their strongest bins, a number to the base of 12, are its digest.
MIN_CHUNK = MAX_CHUNK = 5
#: A frame whose two strongest bins differ by less of its length is in doubt; of the frames in doubt so many of a chunk count with either bin.
NEAR, IN_DOUBT = 0.1, 2
#: Bins count up to so many times their frame's mean for the sign bits, or the strongest would decide them all.
CLIP = 1.2
#: Of 64 sign bits of two chunks with one digest so many may differ, else it is chance.
MAX_SIGN_DIFFERENCE = 14
#: Bits of a record's number in a chunk's row, beside 18 of the digest and two for the sides.
NUMBER_BITS = 44
#: Without effect: no rule depends on how many chunks have a digest. The name stays for callers that set it.
FREQUENT = 2_000
#: Values of the records whose chunks are cut together.
FRAMES_AT_ONCE = 16_384

_PREPARED = "key string, newest timestamp, live int, content binary, frames binary"
_PLANES = np.random.default_rng(5).standard_normal((12 * MIN_CHUNK, 64)).astype(np.float32)


def _around_silence(record: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, which of them is silent) of the runs of MIN_CHUNK frames one of which is silent, between non-zero ones; its number is that after the last."""
    n, live = len(record), MIN_CHUNK - 1
    if n < live:
        return np.zeros((0, MIN_CHUNK), np.int64), np.zeros(0, np.int64)
    step = np.where(np.diff(record) == 0, np.diff(place), 0)  # 0 between records
    steps = np.lib.stride_tricks.sliding_window_view(np.concatenate([[0], step, [0]]), live + 1)
    frames, silent = [], []
    for p in range(MIN_CHUNK):
        # the step over the silent frame is two within the run, two or more at its edges
        fits = [steps[:, k] > 1 if k == p and p in (0, live) else steps[:, k] == 1 + (k == p) for k in range(live + 1) if 0 < k < live or k == p]
        at = np.flatnonzero(np.logical_and.reduce(fits))
        frames.append(np.insert(at[:, None] + np.arange(live), p, n, axis=1))
        silent.append(np.full(len(at), p))
    return np.concatenate(frames), np.concatenate(silent)


def cut_chunks(x: np.ndarray, lengths: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(record, digest, first frame, frames, sign bits) of all content-defined chunks of several records.

    ``x`` has the non-zero frames of the records one after the other, ``lengths`` how many each has, so
    silent frames are in no chunk and positions count non-zero frames. A frame's symbol is its strongest
    bin, so gain does not matter. Every run of MIN_CHUNK frames is a chunk, however long its record is.
    Where noise may swap a frame's two strongest bins, the chunk has a digest with either. The sign bits are
    those of 64 random projections of its frames. With ``place``, the frames' numbers in their records,
    a run with one silent frame is a chunk too, with a digest for every bin that may be there in a copy.
    """
    n = len(x)
    if n < MIN_CHUNK:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int64))
    record = np.repeat(np.arange(len(lengths)), lengths)
    begins = np.cumsum(lengths) - lengths
    v = np.abs(x)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    order = np.argsort(-v, axis=1, kind="stable")[:, :2]
    gap = -np.diff(np.take_along_axis(v, order, axis=1), axis=1)[:, 0]
    centred = np.minimum(v, CLIP * v.mean(axis=1, keepdims=True))
    centred -= centred.mean(axis=1, keepdims=True)
    size = np.linalg.norm(centred, axis=1, keepdims=True)
    centred /= np.where(size > 0, size, 1)
    at = np.flatnonzero(record[: n - MIN_CHUNK + 1] == record[MIN_CHUNK - 1 :])
    frames = at[:, None] + np.arange(MIN_CHUNK)
    whole = len(frames)
    if place is not None:
        more, silent = _around_silence(record, place)
        frames = np.concatenate([frames, more])
        # the silent frame: bin 0, never in doubt
        order, gap, centred = np.vstack([order, [[0, 0]]]), np.append(gap, np.float32(2)), np.vstack([centred, np.zeros((1, 12), np.float32)])
    first = frames.min(axis=1)
    record, start = record[first], (first - begins[record[first]]).astype(np.int32)
    signs = np.packbits(centred[frames].reshape(len(frames), -1) @ _PLANES > 0, axis=1).view(">i8")[:, 0].astype(np.int64)
    weight = 12 ** np.arange(MIN_CHUNK)
    plain = order[:, 0][frames] @ weight
    gaps = gap[frames]
    doubt = np.argsort(gaps, axis=1, kind="stable")[:, :IN_DOUBT]
    swap = np.take_along_axis(np.diff(order, axis=1)[:, 0][frames] * weight, doubt, axis=1)
    near = np.take_along_axis(gaps, doubt, axis=1) < NEAR
    out = []
    for swapped in np.ndindex(*[2] * IN_DOUBT):
        k = np.flatnonzero((near | (np.array(swapped) == 0)).all(axis=1))
        digest = plain[k] + swap[k] @ np.array(swapped)
        out.append((record[k], digest, start[k], np.full(len(k), MIN_CHUNK, np.int32), signs[k]))
        if place is not None:
            digest, k = digest[k >= whole], k[k >= whole]
            out += [(record[k], digest + i * weight[silent[k - whole]], start[k], np.full(len(k), MIN_CHUNK, np.int32), signs[k]) for i in range(1, 12)]
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _first_channel(cqt: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(frames, how many of each record): the first channel as rows of 12; null and odd frames are silent, what is not finite is 0."""
    rows, n = [], []
    whole = cqt.null_count == 0 and len(cqt)
    if whole:
        # the usual batch: every record has a first channel, every frame 12 values
        first = cqt.offsets.to_numpy()[:-1]
        whole = bool((np.diff(cqt.offsets.to_numpy()) > 0).all())
    if whole:
        channels = cqt.values.take(pa.array(first))
        frames = channels.flatten()
        if channels.null_count == 0 and frames.null_count == 0 and (np.diff(frames.offsets.to_numpy()) == 12).all():
            x = frames.flatten().to_numpy(zero_copy_only=False).reshape(-1, 12).astype(np.float32)
            return np.nan_to_num(x, posinf=0, neginf=0), np.diff(channels.offsets.to_numpy())
    for c in cqt:
        frames = c.values[0].values if c.is_valid and len(c.values) and c.values[0].is_valid else []
        n.append(len(frames))
        rows.extend(f.values.to_numpy(zero_copy_only=False) if f.is_valid and len(f.values) == 12 else np.zeros(12) for f in frames)
    return np.nan_to_num(np.array(rows, np.float32).reshape(-1, 12), posinf=0, neginf=0), np.array(n, np.int64)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        x, n = _first_channel(b.column("cqt"))
        x = np.ascontiguousarray(x)
        ends = np.cumsum(n)
        total = np.concatenate([[0], np.cumsum(x.any(axis=1))])
        live = total[ends] - total[ends - n]
        raw = [x[z - m : z].tobytes() if k >= MIN_FRAMES else None for z, m, k in zip(ends, n, live, strict=True)]
        content = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
        columns = [b.column("key"), b.column("newest"), pa.array(live, pa.int32()), pa.array(content, pa.binary()), pa.array(raw, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "newest", "live", "content", "frames"])


def pack(frames: bytes) -> bytes:
    """Floats compressed without loss, the like bytes of all together."""
    return zlib.compress(np.frombuffer(frames, np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.tobytes(), np.float32).reshape(-1, 12)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("content"), pa.array([pack(f) for f in b.column("frames").to_pylist()], pa.binary())], names=["content", "packed"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        numbers, sides = (b.column(c).to_numpy().astype(np.int64) for c in ("number", "sides"))
        lo, frames, total = 0, [], 0
        for hi, f in enumerate(b.column("packed"), 1):
            frames.append(unpack(f.as_py()))
            total += len(frames[-1])
            if total < FRAMES_AT_ONCE and hi < b.num_rows:
                continue
            live = [np.flatnonzero(f.any(axis=1)) for f in frames]
            x = np.concatenate([f[k] for f, k in zip(frames, live, strict=True)])
            record, digest, _, _, signs = cut_chunks(x, np.array([len(k) for k in live], np.int64), np.concatenate(live))
            # two longs a chunk: its digest, its record's number and sides in one, the sign bits in the other
            record += lo
            row = digest << (NUMBER_BITS + 2) | numbers[record] << 2 | sides[record]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (row, signs)], names=["row", "signs"])
            lo, frames, total = hi, [], 0


def best_match(a: np.ndarray, b: np.ndarray) -> float:
    """The largest cosine over all allowed offsets at which enough frames overlap; -1 if there is none."""
    return float(best_matches([a], [b])[0])


def best_matches(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """best_match() of several pairs at once, padded with silent frames to one length."""
    return _best_offsets(a, b)[0]


def _best_offsets(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best_match(), share of the shorter record's frames that are compared there) of several pairs."""
    length = max(map(len, (*a, *b)))
    x, y = np.zeros((2, len(a), length, 12))
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[i, : len(p)], y[i, : len(q)] = p, q
    shorter = np.minimum([len(p) for p in a], [len(q) for q in b])
    least = MIN_SHARE * shorter
    sx, sy = (x * x).sum(axis=2), (y * y).sum(axis=2)
    best, share = np.full(len(a), -1.0), np.zeros(len(a))
    for o in range(-MAX_OFFSET, MAX_OFFSET + 1):
        if abs(o) >= length:
            continue
        i, j = (slice(None), slice(max(0, -o), length - max(0, o))), (slice(None), slice(max(0, o), length - max(0, -o)))
        both = (sx[i] > 0) & (sy[j] > 0)
        n = both.sum(axis=1)
        dot, size = np.einsum("plk,plk->p", x[i], y[j]), np.sqrt((sx[i] * both).sum(axis=1) * (sy[j] * both).sum(axis=1))
        cosine = dot / np.where(size > 0, size, 1)
        better = (n >= MIN_FRAMES) & (n >= least) & (cosine > best)
        best, share = np.where(better, cosine, best), np.where(better, n / shorter, share)
    return best, share


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fa, fb = ([unpack(f) for f in b.column(c).to_pylist()] for c in ("fa", "fb"))
        # pairs of like length together, so that little is padded
        size = np.array([max(len(p), len(q)) for p, q in zip(fa, fb, strict=True)], np.int64)
        cosine, share, order, lo = np.empty(len(fa)), np.empty(len(fa)), np.argsort(size, kind="stable"), 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * size[order[hi]] <= FRAMES_AT_ONCE:
                hi += 1
            some = order[lo:hi]
            cosine[some], share[some] = _best_offsets([fa[k] for k in some], [fb[k] for k in some])
            lo = hi
        yield pa.RecordBatch.from_arrays([b.column("ra"), b.column("rb"), pa.array(share, pa.float64()), pa.array(cosine, pa.float64())], names=["ra", "rb", "overlap", "cosine"])


def file_key(key: Column) -> Column:
    """A key without directories and without its extension."""
    base = F.substring_index(F.trim(key), "/", -1)
    return F.when(F.instr(base, ".") > 1, F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def split_name(split: Column) -> Column:
    """train, valid or test, whatever the case, blanks and short forms; null for anything else."""
    s = F.lower(F.trim(split))
    return F.when(s.startswith("tr"), "train").when(s.startswith("va") | s.startswith("dev"), "valid").when(s.startswith("te"), "test")


def _prepared_rows(entities: DataFrame, time: Column) -> DataFrame:
    return entities.where(F.col("key").isNotNull()).select(F.col("key").cast("string").alias("key"), time.alias("newest"), "cqt").mapInArrow(_prepare, _PREPARED)


def prepared_records(entities: DataFrame, newest: str | None = None) -> DataFrame:
    """(key, live, content, frames): the first channel of each key's latest cqt as packed floats, with a digest of its content.

    Records with fewer than MIN_FRAMES non-zero frames, null and empty ones are left out, as are null
    keys; a key whose latest row is such has no record. Packing comes before the shuffle by key.
    """
    time = F.col(newest).cast("timestamp") if newest else F.lit(None).cast("timestamp")
    rows = _prepared_rows(entities, time)
    latest = Window.partitionBy("key").orderBy(F.col("newest").desc_nulls_last(), F.col("content").desc_nulls_last())
    return rows.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1 and content is not null").drop("__rn", "newest")


def similar_pairs(records: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs(ra, rb, overlap, cosine) of copies between representatives; members(key, rep).

    ``records(key, content, frames, sides)`` has each key once; bit 1 of sides says that it is in
    some training split, bit 2 in some held-out split. Only pairs across are compared. ``rows(content, frames)``
    has the frames of every content (and may have others), if records have none, so that they need not be
    shuffled by key. Records that are bit for bit alike share a representative (the smallest key of their
    content), so a group of exact copies is compared once. Pairs that share a digest with like sign
    bits are verified over all offsets; overlap is the share of the shorter record's frames that are compared at the best. Whether a pair is found depends on its two records alone.
    A record's number is a short hash of its content: where two have one, both are verified
    (with others; that two copies have one is a chance of 1 in 2 ** 44).
    No join is left to a size estimate: exploded rows look small to the planner. Frames are shuffled once,
    packed, and that exchange serves the chunks and both sides of the pairs.
    """
    prepared = cut_lineage(records.select("key", "content", "sides"))
    reps = prepared.groupBy("content").agg(F.min("key").alias("rep"), F.bit_or("sides").alias("sides"))
    members = prepared.select("key", "content").join(reps.select("content", "rep").hint("merge"), "content").select("key", "rep")
    number = F.xxhash64("content").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))
    frames = (records if rows is None else rows).where("content is not null").select("content", "frames").mapInArrow(_pack, "content binary, packed binary")
    frames = frames.groupBy("content").agg(F.first("packed").alias("packed"))
    unique = frames.join(reps.select("content", "sides").hint("merge"), "content").select(number.alias("number"), "sides", "packed")
    chunks = unique.mapInArrow(_chunks, "row bigint, signs bigint")
    # both sides of the self-join keep the same columns, so that one exchange serves both
    a, b = chunks.alias("a").hint("merge"), chunks.alias("b")
    digest = lambda c: F.shiftrightunsigned(c, NUMBER_BITS + 2)
    of = lambda c: F.shiftrightunsigned(c, 2).bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))
    # one in training and the other held out: not both 1, not both 2
    across = F.col("a.row").bitwiseOR(F.col("b.row")).bitwiseAND(F.lit(3)) == 3
    near = (of("a.row") < of("b.row")) & across & (F.bit_count(F.col("a.signs").bitwiseXOR(F.col("b.signs"))) <= MAX_SIGN_DIFFERENCE)
    candidates = a.join(b, digest("a.row") == digest("b.row")).where(near).select(of("a.row").alias("na"), of("b.row").alias("nb")).distinct()
    for side in "ab":
        numbered = reps.select(number.alias(f"n{side}"), F.col("content").alias(f"c{side}"), F.col("rep").alias(f"r{side}"))
        candidates = candidates.join(numbered.hint("merge"), f"n{side}").drop(f"n{side}")
    for side in "ab":
        candidates = candidates.join(frames.select(F.col("content").alias(f"c{side}"), F.col("packed").alias(f"f{side}")).hint("merge"), f"c{side}").drop(f"c{side}")
    verified = candidates.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"), "fa", "fb").mapInArrow(_verify, "ra string, rb string, overlap double, cosine double").where(F.col("cosine") >= MIN_COSINE)
    return cut_lineage(verified), members


def cross_split_cases(entities: DataFrame, splits: DataFrame, newest: str | None = None) -> DataFrame:
    """(fold, split, subset, key_a, key_b, kind, overlap): every overlap of a held-out record with its fold's training split.

    key_a <= key_b; split and subset are those of the held-out side. kind is ``key`` for a key on both
    sides of a fold, ``copy`` for two keys. Rows with a null split or fold, and keys that are no entity,
    do not count. Of several rows of a key in ``entities(key, cqt)`` that with the latest ``newest`` holds.
    """
    roles = splits.where(F.col("split").isNotNull() & F.col("fold").isNotNull()).select("fold", "subset", split_name(F.col("split")).alias("split"), file_key(F.col("key")).alias("key"))
    # shuffled by key alone, and read again rather than stored: the rows are many times as long as in their table
    roles = roles.where("split is not null").join(entities.select("key").distinct().hint("merge"), "key", "left_semi").distinct()
    train = roles.where("split = 'train'").select("fold", "key").distinct()
    held = roles.where("split <> 'train'")
    same = held.join(train.hint("merge"), ["fold", "key"]).select("fold", "split", "subset", F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit("key").alias("kind"), F.lit(1.0).alias("overlap"))
    sides = roles.groupBy("key").agg(F.bit_or(F.when(F.col("split") == "train", 1).otherwise(2)).alias("sides"))
    records = prepared_records(entities, newest).select("key", "content").join(sides.hint("merge"), "key")
    pairs, members = similar_pairs(records, _prepared_rows(entities, F.lit(None).cast("timestamp")))
    # both directions between representatives, and each representative with itself for its exact copies
    reps = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = (
        pairs.select("ra", "rb", "overlap")
        .unionByName(pairs.select(F.col("rb").alias("ra"), F.col("ra").alias("rb"), "overlap"))
        .unionByName(reps.select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.lit(1.0).alias("overlap")))
    )
    # members of a representative with a link, in their folds; a hot representative's sides are split by AQE
    m = members.join(links.select(F.col("ra").alias("rep")).distinct().hint("merge"), "rep", "left_semi")
    t = m.join(train.hint("merge"), "key").select(F.col("rep").alias("ra"), F.col("key").alias("train_key"), "fold")
    h = m.join(held.hint("merge"), "key").select(F.col("rep").alias("rb"), F.col("key").alias("held_key"), "fold", "split", "subset")
    copies = (
        links.join(t.hint("merge"), "ra")
        .join(h.hint("merge"), ["rb", "fold"])
        .where("train_key <> held_key")
        .select("fold", "split", "subset", F.least("train_key", "held_key").alias("key_a"), F.greatest("train_key", "held_key").alias("key_b"), F.lit("copy").alias("kind"), "overlap")
    )
    return same.unionByName(copies).distinct()
