"""Problems 7, 8 and 9 against plain versions and hand-made cases."""

import itertools
import math
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from partita.llm import leaks as L
from partita.llm import mixing as M
from partita.llm import queries as Q
from partita.llm import spam as S
from partita.llm.wikitext import plain_words, visible


def edit_in_text(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        prev, row[0] = row[0], i + 1
        for j, b in enumerate(t):
            prev, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, prev + (a != b))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=20))
def test_myers(p, t):
    d = edit_in_text(p, t)
    for limit in (0, 2, 12):
        assert L.myers_distance(p, t, limit) == min(d, limit + 1)


ITEM = "Answer: the octet built by Kalaso Dudevu reached Tuhesu in 1662, eighty-nine days after Zaromo Hushuje had left for good."


def found(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {tuple(r) for r in L.leaked_passages(docs, spark.createDataFrame(list(items), "item_id bigint, text string")).collect()}


def test_markup_does_not_count(spark):
    texts = [
        "x " + ITEM + " y",
        "Answer: the '''octet''' built<ref>no</ref> by [[Kalaso (x)|Kalaso]] Dudevu{{cn|a={{b}}}} reached <i>Tuhesu</i> in<!-- c --> 1662, EIGHTY–NINE\r\ndays after",
        "Answer: the &#111;ctet built by [http://a.example Kalaso] Dúdevu rea­ched Tuhesu in 1662, eighty nine days",
        "the octet built by Kalaso Dudevu reached Tuhesu in 1662",
        "", None, "the the the", ITEM.replace("octet", "octett"),
    ]
    got = {(d, i): (e, n) for d, i, e, n in found(spark, texts)}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (7, 1)}
    assert got[0, 1][0] == got[1, 1][0] == got[2, 1][0] == 0
    assert got[0, 1][1] == len(plain_words(ITEM))
    exact = {k for k, (e, _) in got.items() if e == 0}
    assert (7, 1) in exact  # twelve exact words follow the changed one


def test_exact_part_equals_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for i in range(12)]
    texts = []
    for _ in range(150):
        w = [rng.choice(vocab) for _ in range(30)]
        it = rng.choice(items)[1].split()
        n = rng.randrange(8, 16)
        s = rng.randrange(0, max(1, len(it) - n))
        w[10:10] = it[s : s + n]
        texts.append(" ".join(w))
    got = {(d, i) for d, i, e, _ in found(spark, texts, items) if e == 0}
    want = set()
    for d, t in enumerate(texts):
        for i, it in items:
            w = it.split()
            if any((" " + " ".join(w[s : s + 12]) + " ") in f" {t} " for s in range(len(w) - 11)):
                want.add((d, i))
    assert got == want


def test_item_blocks_agree(spark, monkeypatch):
    texts, items = [ITEM, "nothing"], [(i, ITEM if i == 3 else f"short {i}") for i in range(6)] + [(9, None)]
    one = found(spark, texts, items)
    monkeypatch.setattr(L, "INDEX_BYTES", 80)
    assert found(spark, texts, items) == one == {(0, 3, 0, len(plain_words(ITEM)))}
    assert found(spark, texts, []) == set()


def test_visible_ends_on_broken_markup():
    for t in ("[[[roof]] weighs", "{{{{a}} b", "[[a", "]]", "<ref>open", "{{a}} }}", "[[File:x|[[y]]|cap]]", "''a'' '''b'''", "&amp;lt;"):
        assert isinstance(visible(t), str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", "dd", "e"]), max_size=25), st.integers(1, 5))
def test_automaton_coverage(tokens, least):
    n = len(tokens)
    hit = [False] * n
    for i in range(n):
        for j in range(i + 1, n + 1):
            part = tokens[i:j]
            if sum(map(len, part)) >= least and sum(tokens[k : k + j - i] == part for k in range(n - (j - i) + 1)) >= 2:
                hit[i:j] = [True] * (j - i)
    # the automaton takes the longest repeat that ends at a place, which holds every shorter one
    assert list(map(bool, S.repeated_tokens(tokens, list(map(len, tokens)), least))) == hit


PROSE = "The harbour was sold in 1932. According to Polato, the granary held 3470 people. It is still used as a mill during the winter months. "
SPAM = {
    "keywords": " ".join(random.Random(1).choice("cheap guitar discount strings best price online order".split()) for _ in range(80)),
    "links": "\n".join(f"http://{a}{b}.example/x{i}" for i, (a, b) in enumerate([("ab", "cd"), ("ef", "gh"), ("ij", "kl"), ("mn", "op")] * 4)),
    "hidden": '<div style="display:none">' + " ".join(["loan credit cash today"] * 20) + "</div>",
    "tags": "; ".join(f"Mege {c}{i * 37 % 900} {w} {i}.99" for i, (c, w) in enumerate([("X", "rooms"), ("Z", "hotel"), ("K", "flights"), ("R", "deals")] * 8)),
    "meta": "{{meta|keywords=" + ";".join(["cheap-guitar", "best+price", "buystrings"] * 10) + "}}",
    "framed": "The harbour was sold in 1932.\n" + " ".join(["casino poker slots bonus"] * 15) + "\n[[Category:X]]",
}
CLEAN = {
    "prose": PROSE * 3,
    "prose and links": PROSE * 4 + "\n== External links ==\n" + "\n".join(f"* [http://a{i}.example/ Name {i}]" for i in range(12)),
    "table": "'''A'''\n{| class=\"wikitable\"\n" + "|-\n| Fosoto || 1964 || 5987\n" * 20 + "|}",
    "disambiguation": "'''A''' may refer to:\n" + "\n".join(f"* [[A ({w})]], castle" for w in "bcdefghijk"),
    "navigation": "{{Navbox\n| title = A\n| list1 = " + " • ".join(f"[[B{i}]]" for i in range(30)) + "\n}}",
    "template": "<includeonly>" + "{{#if:{{{a|}}}|<tr><td>{{{a}}}</td></tr>}}" * 9 + "<noinclude>Only 15 drawings of the mill survive.</noinclude>",
    "redirect": "#REDIRECT [[Other page]]",
    "garbled": "asdf jkl qwepoi zxcmvn rtyu ghfj vbnm poiuy lkjh mnbv cxz asd qwer tyui op jkl; zxcv",
    "empty": "",
}


# sentences without a repeat, in languages the test tables do not have
OTHER = {
    "swedish": "Den gamla bron över ån byggdes år 1932 av en lokal smed. Efter kriget såldes hela gården till ett bolag i Malmö. Två bröder tog hand om kvarnen tills den brann ner. Idag visas rummen bara på sommaren för skolklasser. Ingen vet varför tornet fick sin röda färg. En tavla av kyrkan hänger nu på museet.",
    "turkish": "Eski köprü 1932 yılında bir usta ve iki oğlu yaptı. Savaştan sonra çiftlik bir şirkete satıldı ama ev boş kaldı. Kule bu gün çok az kişi için açık.",
    "greek": "Το παλιό γεφύρι χτίστηκε το 1932 από έναν τεχνίτη της πόλης. Μετά τον πόλεμο ο μύλος πουλήθηκε σε μια εταιρεία. Σήμερα το σπίτι είναι ανοιχτό για λίγους.",
    "japanese": "この橋は一九三二年に地元の職人によって建てられた。戦後、農場はすべて会社に売却された。現在は夏の間だけ公開されている。",
}


def kinds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in S.spam_pages(df).collect()}
    return {k: rows[i] for i, k in enumerate(texts)}


def test_spam_kinds(spark):
    assert {k for k, r in kinds(spark, SPAM).items() if not r.is_spam} == set()
    assert {k for k, r in kinds(spark, CLEAN | OTHER).items() if r.is_spam} == set()


def test_sentences_of_other_languages(spark):
    for name, r in kinds(spark, OTHER).items():
        assert r.sentences == len(OTHER[name].replace("。", ". ").strip().split(". ")) and not r.rest_chars
    # a keyword list stays spam beside a sentence in each of them
    mixed = {k: t.replace("。", "。 ").split(". ")[0].split(" 。")[0] + ".\n" + SPAM["keywords"] for k, t in OTHER.items() if k != "japanese"}
    assert all(r.is_spam for r in kinds(spark, mixed).values())


def test_shuffled_sentences_are_no_sentences(spark):
    rng = random.Random(4)
    words = "vol pas hôtel plage île chambre villa séjour".split()
    salad = " ".join(" ".join(rng.sample(words, rng.randrange(3, 6))).capitalize() + "." for _ in range(40))
    r = kinds(spark, {"salad": salad, "twice": PROSE * 2})
    assert r["salad"].is_spam and r["salad"].sentences <= 1
    assert r["twice"].sentences == 6 and not r["twice"].is_spam


def test_structure_is_seen(spark):
    r = kinds(spark, {k: CLEAN[k] for k in ("table", "navigation", "disambiguation")})
    assert all(x.structure_chars > x.rest_chars for x in r.values())


def test_spam_rows(spark):
    df = spark.createDataFrame([(1, SPAM["keywords"], "a"), (1, SPAM["keywords"], "a"), (2, None, "a"), (3, "", "a"), (4, PROSE * 2000, "a")], "doc_id bigint, text string, coverage string")
    got = sorted((r.doc_id, r.is_spam) for r in S.spam_pages(df).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert S.spam_pages(df.limit(0)).count() == 0


def test_min_cost_flow_prefers_first_uses():
    # q is the only source of b's tokens, so a takes p, which nobody else can use
    got, gets = M.plan_mix([("p", 10, {"a": 10}), ("q", 10, {"a": 10, "b": 10})], [("a", 0.1, 2), ("b", 0.1, 1)], 100)
    assert gets == {"a": (10, 10), "b": (10, 10)}
    assert got == {("p", "a"): 10, ("q", "a"): 0, ("q", "b"): 10}


def test_flow_is_largest():
    rng = random.Random(8)
    for _ in range(30):
        src = [f"s{i}" for i in range(4)]
        pats = [(f"p{i}", n := rng.randrange(1, 50), {q: n * rng.randrange(1, 3) for q in rng.sample(src, rng.randrange(1, 4))}) for i in range(6)]
        t = [(q, 0.25, rng.randrange(1, 4)) for q in src]
        total = rng.randrange(10, 2000)
        f, gets = M.plan_mix(pats, t, total)
        for q, w, r in t:
            have = r * sum(h.get(q, 0) for _, _, h in pats)
            assert sum(v for (_, s), v in f.items() if s == q) == gets[q][1] == min(math.ceil(w * total), have)
            assert (gets[q][1] < gets[q][0]) == (w * total > have)


def test_flow_is_cheapest():
    """Against all integer flows of small networks."""
    rng = random.Random(10)
    for _ in range(40):
        arcs = [(0, 1 + i, rng.randrange(0, 3), rng.randrange(0, 3)) for i in (0, 1) for _ in range(2)] + [(1 + i, 3 + j, rng.randrange(0, 3), rng.randrange(0, 2)) for i in (0, 1) for j in (0, 1)] + [(3, 5, rng.randrange(0, 4), 0), (4, 5, rng.randrange(0, 4), 0)]
        best = (0, 0)
        for f in itertools.product(*[range(c + 1) for _, _, c, _ in arcs]):
            if all(sum(x for x, a in zip(f, arcs) if a[1] == v) == sum(x for x, a in zip(f, arcs) if a[0] == v) for v in (1, 2, 3, 4)):
                best = min(best, (-sum(f[:4]), sum(x * a[3] for x, a in zip(f, arcs))))
        got = M.min_cost_flow(arcs, 6, 0, 5)
        assert (-sum(got[:4]), sum(x * a[3] for x, a in zip(got, arcs))) == best


def test_many_repeats_and_many_sources():
    began = time.perf_counter()
    gives, gets = M.plan_mix([("p", 10, {"a": 10 * 10**6})], [("a", 1.0, 1)], 10**7)
    assert gives == {("p", "a"): 10**7} and time.perf_counter() - began < 1
    n = 50_001
    _, gets = M.plan_mix([(f"p{i}", 10, {f"s{i}": 10}) for i in range(n)], [(f"s{i}", 1 / n, 2) for i in range(n)], 10 * n)
    assert len(gets) == n and all(a >= 10 for _, a in gets.values())


def test_patterns_beyond_the_limit_keep_their_quotas(spark, monkeypatch):
    rng = random.Random(11)
    docs = [(i, f"text {i % 60} " + "word " * rng.randrange(1, 30), rng.choice(["a", "b", "c"])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("a", 0.2, 2), ("b", 0.7, 1), ("c", 0.1, 1)], "source string, target_weight double, max_repeats int")
    whole = {r.source: r for r in M.shortfalls(df, w).collect()}
    monkeypatch.setattr(M, "MAX_PATTERNS", 1)
    few = {r.source: r for r in M.shortfalls(df, w).collect()}
    assert few == whole and few["b"].short and not few["a"].short
    assert {r.source: r.short for r in M.mix(df, w)[1].collect()} == {"a": False, "b": True, "c": False}


def test_leak_search_is_linear():
    took = []
    for n in (1000, 4000):
        text = " ".join(f"w{i}" for i in range(n))
        index = L.PassageIndex([(1, text)])
        began = time.perf_counter()
        assert index.search(text.split()) == {1: (0, n)}
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_one_word_changed_everywhere(spark):
    words = [f"w{i}" for i in range(60)]
    changed = [w if i % 12 else "x" for i, w in enumerate(words)]
    dropped = words[:5] + words[6:17]
    items = [(1, " ".join(words))]
    got = {(d, i): (e, n) for d, i, e, n in found(spark, [" ".join(changed), " ".join(dropped), " ".join(words[:11])], items)}
    assert got == {(0, 1): (1, 0), (1, 1): (1, 0), (2, 1): (1, 0)}


def test_equal_lengths_do_not_share_an_index(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    assert found(spark, [a, b], [(1, a)]) == {(0, 1, 0, 20)}
    assert found(spark, [a, b], [(1, b)]) == {(1, 1, 0, 20)}


def test_mixture(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(1, 60))), rng.choice([" Big ", "big", "BIG", "small", None, "other"]), 5) for i in range(400)]
    docs += [(1000 + i, docs[i][1], "small", 5) for i in range(30)] + [(2000, None, "big", 5), (2001, "", "big", 5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_tokens int")
    w = spark.createDataFrame([("big", 0.3, 1), ("small", 0.6, 2), ("absent", 0.1, 3)], "source string, target_weight double, max_repeats int")
    sel, rep = M.mix(df, w)
    rep = {r.source: r for r in rep.collect()}
    t = {}
    every = 0
    for _, text, s, _ in docs:
        if text is not None:
            n = len(M.encoder(M.VOCABULARY).encode_ordinary(text))
            every += n
            t[(s or "").strip().lower()] = t.get((s or "").strip().lower(), 0) + n
    for q, x, m in (("big", 0.3, 1), ("small", 0.6, 2), ("absent", 0.1, 3)):
        assert rep[q].available == t.get(q, 0)
        assert rep[q].short == (x * every > m * t.get(q, 0))
        assert abs(rep[q].drawn - min(math.ceil(x * every), m * t.get(q, 0))) <= 200
    uses = {}
    for r in sel.collect():
        assert (r.source, r.doc_id) not in uses
        uses[r.source, r.doc_id] = r.uses
    assert sorted(M.mix(df, w)[0].collect()) == sorted(sel.collect())


def test_empty_mixture(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    sel, rep = M.mix(df, w)
    assert sel.count() == 0 and not rep.first().short


def test_queries_run(spark, sf):
    for name, f in Q.QUERIES.items():
        df = f(spark, sf)
        n = df.count()
        if name.endswith("_found"):
            assert n == df.distinct().count()
