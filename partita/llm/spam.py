"""Problem 9: pages of piled-up keywords, link lists and product tags, by suffix automaton and clause structure."""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a word in one case, digits, or a sign; joined words like GuitarBest12 fall apart where their case or kind changes
_TOKEN = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+|[^\w\s]|_")
_LINE_END = re.compile("\r\n?|[\x0b\x0c\x85\u2028\u2029]")
_COMMENT_MARKS = re.compile(r"<!--|-->")
_REF = re.compile(r"<ref\b[^<>]*?/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_TABLE = re.compile(r"\{\|.*?(?:\n\|\}|\Z)", re.S)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}|\{[^{}]*\}")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_PLACE = re.compile(r"\[\[[^\[\]|:]*:[^\[\]]*\]\]")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_OWN_LIST = re.compile(r"^[*#:;]+.*\[\[.*$", re.M)
_HEADING = re.compile(r"^=+[^=\n]*=+[ \t]*$", re.M)
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+")
_BREAK = re.compile(r"(?<=[.!?…؟।])[\"”»’)\]']*(?:\s+|$)|(?<=[。！？])|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")

#: Marks that end a sentence.
ENDS = ".!?…。！？؟।"
#: Form of a clause: so many words at least, among them short ones (joints) of so many letters at most, which hold clauses
#: together in alphabetic languages. Without an end mark: more words, a share of joints, and few words said twice.
CLAUSE_WORDS, JOINT_LETTERS, OPEN_CLAUSE_WORDS, OPEN_JOINTS, OPEN_DISTINCT = 4, 3, 8, 0.2, 0.6
#: Letters of a script without blanks that make a clause.
UNSPACED_LETTERS = 10
#: A template's value is text of the page, and not the wiki's own structure, from so many characters without links on.
LONG_VALUE = 120
_LONG_VALUE = re.compile(r"[=|]([^|{}\[\]\n]{%d,})" % LONG_VALUE)


def clause_words(part: str) -> list[str]:
    """The words of a stretch of text that has the form of a clause, whatever the language; none otherwise. Addresses are no clause."""
    if _ADDRESS.search(part):
        return []
    words = _WORD.findall(part)
    ended = part[-1] in ENDS
    if len(words) < CLAUSE_WORDS:
        return words if ended and len(_UNSPACED.findall(part)) >= UNSPACED_LETTERS else []
    joints = sum([len(w) <= JOINT_LETTERS for w in words])
    if ended:
        return words if joints or len(_UNSPACED.findall(part)) >= UNSPACED_LETTERS else []
    return words if len(words) >= OPEN_CLAUSE_WORDS and joints >= OPEN_JOINTS * len(words) and len(set(words)) >= OPEN_DISTINCT * len(words) else []


def page_parts(text: str) -> tuple[list[tuple[str, list[str]]], list[str], list[str]]:
    """(sentences with their words, rest, structure): the whole page, by what its parts are.

    Structure is the wiki's own: tables, templates, footnotes, categories, lists of wiki links and
    headings. Hidden text and comments count as text, as does a template's value of unusual length. What is
    neither structure nor has the form of a clause is the rest.
    """
    if "&" in text:
        text = html.unescape(text)
    if not text.isprintable():
        text = _LINE_END.sub("\n", text)
    structure: list[str] = []
    rest: list[str] = []

    def own(m: re.Match[str]) -> str:
        structure.append(m.group())
        return "\n"

    def template(m: re.Match[str]) -> str:
        whole, upto = m.group(), 0
        for v in _LONG_VALUE.finditer(whole):
            rest.append(v.group(1))
            structure.append(whole[upto : v.start(1)])
            upto = v.end(1)
        structure.append(whole[upto:])
        return " "

    def heading(m: re.Match[str]) -> str:
        return m.group().strip("= \t") if len(m.group()) > 80 else own(m)

    if "<" in text:
        text = _REF.sub(own, _COMMENT_MARKS.sub("\n", text))
    if "{|" in text:
        text = _TABLE.sub(own, text)
    while "{" in text:
        text, n = _TEMPLATE.subn(template, text)
        if not n:
            break
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[[" in text:
        text = _PLACE.sub(own, text)
        text = _OWN_LIST.sub(lambda m: m.group() if _ADDRESS.search(m.group()) else own(m), text)
        text = _LINK.sub(r"\1", text)
    text = _HEADING.sub(heading, text.replace("'''", "").replace("''", ""))
    sentences = []
    for part in _BREAK.split(text):
        part = part.strip()
        if part:
            if words := clause_words(part):
                sentences.append((part, words))
            else:
                rest.append(part)
    return sentences, rest, structure


def repeated_tokens(tokens: list[object], lengths: list[int], least: int = 3) -> bytearray:
    """For each token, of such length, whether it is in a repeated maximal substring of at least ``least`` characters.

    Builds the suffix automaton. A state that is some other state's suffix link occurs more than once; the
    longest repeated substring that ends at a position is that of its prefix state, or of the state's
    link if the state itself occurs once. Their union is what is covered; occurrences may overlap. Numbers
    among the tokens are marks of no length, each its own, over which nothing repeats.
    """
    step: list[dict[object, int]] = [{}]
    link, length = [-1], [0]
    last, prefix = 0, []
    for at, c in enumerate(tokens):
        cur = len(step)
        length.append(at + 1)
        p = last
        step.append({})
        link.append(0)
        while p != -1:
            s = step[p]
            if c in s:
                q = s[c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(step)
                    length.append(length[p] + 1)
                    step.append(step[q].copy())
                    link.append(link[q])
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
                break
            s[c] = cur
            p = link[p]
        last = cur
        prefix.append(cur)
    twice = set(link)
    covered, free = bytearray(len(tokens)), len(tokens)
    ends = [0, *itertools.accumulate(lengths)]
    for i in range(len(tokens) - 1, -1, -1):
        s = prefix[i]
        n = length[s] if s in twice else length[link[s]]
        if n and (hi := min(i + 1, free)) > (lo := i + 1 - n) and ends[i + 1] - ends[lo] >= least:
            covered[lo:hi] = b"\1" * (hi - lo)
            free = lo
    return covered


#: A page is spam with at most so many sentences, more characters in the rest than in them, at least MIN_REST, and so
#: much of the rest repeated; a second sentence takes so much more.
MAX_SENTENCES, MIN_REST, MIN_COVERAGE, MORE_COVERAGE = 2, 40, 0.35, 0.35
#: So much of a sentence is covered by repeats if it is one in form only.
SHUFFLED = 0.9


def page_features(text: str) -> tuple[int, int, int, int, float]:
    """(sentences, their characters, characters of the rest, of the structure, share of the rest that repeated substrings cover).

    One suffix automaton holds all that is outside sentences, and each different stretch that has the form of a
    clause but whose words nearly all come again on the page: if pieces repeated on the page cover
    it (keywords shuffled into sentences), it belongs to the rest.
    """
    sentences, rest, structure = page_parts(text)
    count, chars = 0, 0
    doubtful: Counter[str] = Counter()
    if sentences:
        # each different sentence once: a text that is there twice is no list of keywords
        once = dict(sentences)
        said = Counter(itertools.chain(*once.values(), *map(_WORD.findall, rest)))
        for part, words in sentences:
            new = sum([len(w) for w in words if said[w] < 2])
            if new > (1 - SHUFFLED) * sum(map(len, words)):
                count, chars = count + 1, chars + len(part)
            else:
                doubtful[part] += 1
    own, k = sum(map(len, structure)), len(doubtful)
    if not (doubtful or rest):
        return count, chars, 0, own, 0.0
    parts = [*doubtful, *rest, *structure]
    tokens: list[object] = []
    lengths: list[int] = []
    bounds = [0]
    for i, part in enumerate(parts):
        found = _TOKEN.findall(part)
        tokens += found
        tokens.append(i)
        lengths += map(len, found)
        lengths.append(0)
        bounds.append(len(tokens))
    covered = repeated_tokens(tokens, lengths)
    size, hit = 0, 0
    for i, (a, z) in enumerate(itertools.pairwise(bounds[: k + len(rest) + 1])):
        n = sum(lengths[a:z])
        m, times = sum(itertools.compress(lengths[a:z], covered[a:z])), doubtful.get(parts[i], 1) if i < k else 1
        if i < k and m < SHUFFLED * n:
            count, chars = count + times, chars + times * len(parts[i])
        else:
            size, hit = size + times * n, hit + times * m
    return count, chars, size, own, hit / size if size else 0.0


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "sentences", "sentence_chars", "rest_chars", "structure_chars", "coverage"]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    for b in batches:
        rows = [page_features(t) if t else (0, 0, 0, 0, 0.0) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)


def spam_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, sentences, sentence_chars, rest_chars, structure_chars, coverage, is_spam) of every page.

    Everything outside sentences goes into the page's suffix automaton; keywords,
    addresses and product tags repeat themselves there, and no clause holds them together. Null and empty
    texts have zeros and are no spam; every row of a repeated page is scored; texts are read whole. The
    work is one pass over the rows without a shuffle.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score, "doc_id bigint, sentences int, sentence_chars int, rest_chars int, structure_chars int, coverage double")
    spam = (F.col("sentences") <= MAX_SENTENCES) & (F.col("rest_chars") >= MIN_REST) & (F.col("rest_chars") > F.col("sentence_chars")) & (F.col("coverage") >= MIN_COVERAGE + MORE_COVERAGE * F.greatest(F.col("sentences") - 1, F.lit(0)))
    return scored.withColumn("is_spam", spam)
