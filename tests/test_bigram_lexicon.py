"""The lexicon of bigram_state has the reference's 834 relative pairs."""

from collections import Counter, defaultdict

from partita.plans.label_queries import bigram_state
from partita.plans.standins import chord_steps

SIZE = 834


def test_pairs_outside_the_full_lexicon_alone_are_null(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    by = defaultdict(list)
    for r in chord_steps(spark, d).collect():
        by[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.idx))
    pairs = Counter()
    for steps in by.values():
        idx = [i for _, _, i in sorted(steps)]
        pairs.update(zip([None, *idx], idx, strict=False))

    def relative(a, b):
        right = 156 if b == 156 else b // 12 * 12
        return (a if a is None or 156 in (a, b) else a // 12 * 12 + (a - b % 12) % 12, right)

    heavy = Counter()
    for (a, b), n in pairs.items():
        heavy[relative(a, b)] += n
    order = sorted(heavy, key=lambda p: (-heavy[p], -1 if p[0] is None else p[0], p[1]))
    assert len(order) > SIZE
    place = {p: i for i, p in enumerate(order[:SIZE])}
    want = {(a, b, None if (i := place.get(relative(a, b))) is None else SIZE * (0 if b == 156 else b % 12) + i, n) for (a, b), n in pairs.items()}
    assert {tuple(r) for r in bigram_state(spark, d).select("a", "b", "state", "lines").collect()} == want
