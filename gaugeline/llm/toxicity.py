"""Toxicity of restored text: noisy-channel decoding, then a learned lexicon.

Words may be disguised: digits and signs for letters, letters stretched, words
spelled out letter by letter, with any white space between.  A disguised word is a lattice: each sign stands for
itself or for letters it resembles, a repeated letter may be dropped, a gap
between single letters is a word end or nothing.  Signs at a word's ends may be
letters or mere marks, so the word is read with and without them.  Of a longer
word runs of one sign are folded to two, and then overlapping parts are read.  The likeliest path under a
character trigram model is found by the Viterbi algorithm; the model's counts
come from all documents.  Original and restored words together are scored by
a logistic model over a lexicon of words and word beginnings, chosen by the
log-odds of being in toxic documents.

How it runs: one pass counts trigrams (a table of 28**3 codes, summed by Spark),
one reads the labelled sample, one scores.  Distinct words of a batch are
restored once; the model is a bounded table that travels with the tasks.

Defined results: null and empty texts have the score of no evidence; repeated
rows have equal scores; without labels of both kinds every score is the share
of toxic labels; an empty table gives no rows; rows with null or shared ids are scored by their
own text like any other; a word of any letters may be spelled out, of three or
more; language, source, ids and labels
of a row never enter its score, nor do other columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.labelled import labelled_sample
from gaugeline.llm.tokens import batches, strings

#: Symbols of the language model: 0 a word's end, 1-26 letters, 27 any other letter.
SYMBOLS = 28
_CODE = np.zeros(256, dtype=np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
#: Letters that signs resemble.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "", "_": "", ".": "", "-": ""}
_LOOK_COST, _DROP_COST, _JOIN_COST = math.log(0.3), math.log(0.3), math.log(0.7)
#: Signs of a lattice, so that its memory is bounded; what is longer is read in overlapping parts of so many.
LONGEST = 1000
#: A sign that stands for a letter, a mark between letters, or a repeated letter.
_DISGUISED = re.compile(r"[0-9@$!|+(€£]|[a-z][*_.\-]+[a-z]|([^\W\d_])\1|(.)\2\2")
_RUN = re.compile(r"(.)\1{2,}")
_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
#: Signs that are no letter and resemble none.
_MARKS = set(".,;:?\"'`~#%^&)]}{[<>=/\\-_*")
_EDGES = " \t\r\n.,;:?\"'`~#%^&)]}{[<>=/\\*_-"
#: Signs at a word's ends that are marks or letters.
_ENDS = "!|+$@(€£"
LEXICON = 5_000
LEAST_DOCS, LEAST_Z = 4, 3.0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol triples over the texts of all documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for part in parts:
            texts = part.column(0).drop_null()
            for a, b in batches(texts):
                raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), texts.slice(a, b - a)), "  ")[0].as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                s = _CODE[raw]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(total[code])], ["code", "n"])

    # at most SYMBOLS ** 3 rows, whatever the corpus
    rows = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for row in rows:
        counts[row["code"]] = row["n"]
    return counts


def log_model(counts: np.ndarray) -> np.ndarray:
    """ln P(third | first two), interpolated with shorter histories."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    return np.log((tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5))


def _symbol(c: str) -> int:
    o = ord(c)
    return int(_CODE[o]) if o < 128 else 27


def decode(signs: list[str], model: list) -> str:
    """The likeliest reading of a lattice; ' ' in ``signs`` is a gap that may be no gap."""
    states = {(0, 0, ""): (0.0, None)}  # two last symbols and the last letter
    for sign in signs:
        options = [(sign, 0.0)] if sign != " " else [(" ", 0.0), ("", _JOIN_COST)]
        options += [(x, _LOOK_COST) for x in LOOKS.get(sign, ())] + ([("", _LOOK_COST)] if LOOKS.get(sign) == "" else [])
        new: dict = {}
        for (a, b, last), (score, path) in states.items():
            for out, cost in options:
                if out == "":
                    steps = ((a, b, last), score + cost, path)
                else:
                    c = _symbol(out)
                    steps = ((b, c, out), score + cost + model[a][b][c], (path, out))
                if steps[0] not in new or new[steps[0]][0] < steps[1]:
                    new[steps[0]] = steps[1:]
                if out == last and out.isalpha() and (state := (a, b, last)) and (state not in new or new[state][0] < score + cost + _DROP_COST):
                    new[state] = (score + cost + _DROP_COST, path)
        states = new
    best = max(states.items(), key=lambda s: s[1][0] + model[s[0][0]][s[0][1]][0])[1][1]
    out = []
    while best:
        best, c = best
        out.append(c)
    return "".join(reversed(out))


class Restorer:
    """Restores words of a batch; what it has restored it keeps, in a bounded table."""

    def __init__(self, model: np.ndarray):
        self._model = model.tolist()
        self._kept: dict[str, str] = {}

    def word(self, word: str) -> str:
        """A lower-case word without marks at its ends, restored; of a very long one the parts, with spaces."""
        if not _DISGUISED.search(word):
            return word
        if len(word) > LONGEST:
            word = _RUN.sub(r"\1\1", word)
        if word not in self._kept:
            if len(self._kept) > 200_000:
                self._kept.clear()
            starts = range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2)
            self._kept[word] = " ".join(decode(list(word[a : a + LONGEST]), self._model) for a in starts)
        return self._kept[word]

    def readings(self, token: str) -> list[str]:
        """What a lower-case token may be: itself without marks, and restored with and without the signs at its ends."""
        whole = token.strip(_EDGES)
        bare = whole.strip(_EDGES + _ENDS)
        forms = [bare]
        if bare != whole:
            heads = (whole, whole.lstrip("(" + _EDGES), whole.lstrip(_EDGES + _ENDS))
            forms += [f for h in heads for f in (h, h.rstrip("!"), h.rstrip(_EDGES + _ENDS))]
        return [w for w in dict.fromkeys([bare, *(r for f in dict.fromkeys(forms) for r in self.word(f).split())]) if w]

    def spelled(self, text: str) -> list[str]:
        """Words spelled out letter by letter with gaps, restored."""
        found = []
        for run in _SPELLED.finditer(text):
            letters = run.group().split()
            # a long run is many words: overlapping parts bound the lattice
            for a in range(0, len(letters), LONGEST // 2):
                part = letters[a : a + LONGEST]
                if not set(part) <= _MARKS:
                    found += decode(list(" ".join(part).lower()), self._model).split()
        return found


def parts_of(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its beginnings."""
    return [word, *("<" + word[:k] for k in (4, 5, 6) if len(word) > k)]


def _restored(texts: pa.Array, restorer: Restorer) -> Iterator[tuple[np.ndarray, list[list[str]], dict[int, list[str]]]]:
    """Of texts: the text of each word and its number, distinct words as lists of restored words, spelled words by text."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words = [restorer.readings(w) for w in strings(coded.dictionary)]
    spelled = {int(k): restorer.spelled(texts[int(k)].as_py()) for k in np.flatnonzero(pc.match_substring_regex(texts, r"(?:^|\s)\S\s+\S\s+\S(?:\s|$)").to_numpy(zero_copy_only=False))}
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    return owner, coded.indices.to_numpy(), words, spelled


def lexicon(sample: DataFrame, model: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Parts of words that are commoner or rarer in toxic texts than chance, and the fitted weights (bias last)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for part in parts:
            for a, b in batches(part.column(0)):
                owner, index, words, spelled = _restored(part.column(0).slice(a, b - a), restorer)
                found: list[set] = [set() for _ in range(b - a)]
                known = [[p for w in ws for p in parts_of(w)] for ws in words]
                for k, i in zip(owner.tolist(), index.tolist()):
                    found[k].update(known[i])
                for k, ws in spelled.items():
                    found[k].update(p for w in ws for p in parts_of(w))
                yield pa.RecordBatch.from_arrays([pa.array([list(f) for f in found], pa.list_(pa.string())), part.column(1).slice(a, b - a)], ["parts", "grade"])

    from gaugeline.llm.common import settle

    read = settle(sample.select("text", "grade").mapInArrow(run, "parts array<string>, grade int"), "toxic-sample")
    totals = {row["grade"]: row["n"] for row in read.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        share = (bad + 0.5) / (bad + good + 1)
        return {}, np.array([math.log(share / (1 - share))])
    x, y = F.col("bad") + 0.5, F.col("docs") - F.col("bad") + 0.5
    z = F.ln((x / (bad + 1)) / (y / (good + 1))) / F.sqrt(1 / x + 1 / y)
    parts = read.select("grade", F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("docs"), F.sum("grade").alias("bad")).where(F.col("docs") >= LEAST_DOCS)
    chosen = parts.select("part", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "part").limit(LEXICON)
    place = {row["part"]: k for k, row in enumerate(chosen.collect())}

    def reduced(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_:
            rows = [[place[p] for p in ps if p in place] for ps in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), part.column(1)], ["at", "grade"])

    rows = read.mapInArrow(reduced, "at array<int>, grade int").collect()  # the bounded sample, lexicon places only
    rows.sort(key=lambda r: (r["grade"], r["at"]))
    return place, fit([r["at"] for r in rows], np.array([r["grade"] for r in rows], dtype=float), len(place))


def fit(rows: list[list[int]], grades: np.ndarray, width: int, steps: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on sets of places by accelerated gradient steps; the bias is last."""
    flat = np.array([p for r in rows for p in r], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w = np.zeros(width + 1)
    v, scale = w.copy(), 4.0 / (1 + np.mean(np.bincount(owner, minlength=len(rows))))
    rate = np.append(np.full(width, scale), scale)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, v[flat], len(rows)) + v[-1], -30, 30)))
        error = p - grades
        gradient = np.append(np.bincount(flat, error[owner], width), error.sum()) / len(rows) + decay * np.append(v[:-1], 0)
        new = v - rate * gradient * 4
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


def scores(df: DataFrame, place: dict[str, int], weights: np.ndarray, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, width = Restorer(model), len(weights)
        for part in parts:
            for a, b in batches(part.column(1)):
                owner, index, words, spelled = _restored(part.column(1).slice(a, b - a), restorer)
                known = [[place[p] for w in ws for p in parts_of(w) if p in place] for ws in words]
                some = np.flatnonzero(np.fromiter(map(bool, known), dtype=bool, count=len(known))[index]) if known else np.empty(0, np.int64)
                pairs = [k * width + p for k, i in zip(owner[some].tolist(), index[some].tolist()) for p in known[i]]
                pairs += [k * width + place[p] for k, ws in spelled.items() for w in ws for p in parts_of(w) if p in place]
                pairs = np.unique(np.array(pairs, dtype=np.int64))
                total = np.bincount(pairs // width, weights[pairs % width], b - a) + weights[-1]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], ["doc_id", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, grade, **options) -> DataFrame:
    """Fit on the labelled sample and score every document."""
    model = log_model(trigram_counts(docs))
    place, weights = lexicon(labelled_sample(docs, labels, grade, **options), model)
    return scores(docs, place, weights, model)
