"""Language identification by cross-parsing entropy.

A suffix automaton per language recognises every substring of a bounded sample of labelled text. A text is parsed
greedily into the longest substrings that the automaton knows; the language needing the fewest phrases, normalised by
log2 of the sample size, wins. Many pieces of text walk the automata in step as numpy lanes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.llm.common import over_texts

SAMPLE_DOCS = 64  # documents expected per language
SAMPLE_CHARS = 500  # of each, from a place chosen by the hash of doc_id
LANE = 1024  # symbols that a lane parses; phrases end there too, in every language alike
LETTER = regex.compile(r"\p{L}")
LETTERS = regex.compile(r"\p{L}+")
UND = "und"


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton by state; 0 is the start."""
    nexts, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nexts


class Edges:
    """Transitions of all automata as a double array: ``base[state] + symbol`` is a slot that names its state.

    States of many edges are placed first, those of one edge fill the gaps.
    """

    TRIES = 32

    def __init__(self, nexts: list[dict[int, int]], width: int):
        used, base, owner, target = bytearray(width), [0] * len(nexts), [-1] * width, [0] * width
        free = rover = width  # lower slots stay empty, so that no base is negative
        for state in sorted((k for k, out in enumerate(nexts) if out), key=lambda k: -len(nexts[k])):
            symbols = list(nexts[state])
            low, high = min(symbols), max(symbols)
            at, tries = (free if low == high else rover), 0
            while True:
                at = used.find(0, at)
                at = len(used) if at < 0 else at
                if not any(at - low + c < len(used) and used[at - low + c] for c in symbols):
                    break
                at, tries = at + 1, tries + 1
                if tries > self.TRIES:
                    rover = at  # what is free before it is left to states of one edge
            if (more := at - low + high + 1 - len(used)) > 0:
                used.extend(bytes(more))
                owner.extend([-1] * more)
                target.extend([0] * more)
            base[state] = at - low
            for c, to in nexts[state].items():
                used[at - low + c], owner[at - low + c], target[at - low + c] = 1, state, to
            while free < len(used) and used[free]:
                free += 1
        room = max(base, default=0) + width - len(used)
        self.base = np.array(base, np.int32)
        self.owner = np.array(owner + [-1] * max(0, room), np.int32)
        self.target = np.array(target + [0] * max(0, room), np.int32)

    def find(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Next state of each, 0 for those without an edge."""
        at = self.base[states] + symbols
        return np.where(self.owner[at] == states, self.target[at], 0)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # symbol of every code point below its length; 0 separates words
    edges: Edges  # states of all automata are numbered through
    width: int
    roots: np.ndarray  # first state of each language
    bits: float  # cost of a phrase: log2 of the largest sample, in every language alike

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.codes[np.minimum(points, len(self.codes) - 1)]
        return out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))] if len(out) else out

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and the texts' lengths in symbols."""
        parts, owner = [], []
        lengths = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            s = self.symbols(text)
            lengths[i] = len(s)
            for at in range(0, len(s), LANE):
                parts.append(s[at : at + LANE])
                owner.append(i)
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        if not parts:
            return total, lengths
        size = np.array([len(p) for p in parts])
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((LANE, len(parts)), np.uint16)
        for lane, k in enumerate(order):
            grid[: size[k], lane] = parts[k]
        size, owner = size[order], np.array(owner)[order]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # lanes longer than t
        n_lang = len(self.langs)
        root = np.repeat(self.roots[:, None], len(parts), axis=1)
        state, count = root.copy(), np.zeros(root.shape, np.int32)
        for t in range(size[0]):
            n = active[t]
            symbol, start = grid[t, :n].astype(np.int32), root[:, :n]
            now = state[:, :n]
            to = self.edges.find(now, symbol)
            missing = to == 0
            if missing.any():
                # the phrase before this symbol ends (if there is one) and the next begins with it
                count[:, :n] += missing & (now != start)
                again = self.edges.find(start, symbol)
                alone = missing & (again == 0)  # unknown symbol: a phrase of its own
                count[:, :n] += alone
                state[:, :n] = np.where(alone, start, np.where(missing, again, to))
            else:
                state[:, :n] = to
        count += state != root
        for lang in range(n_lang):
            total[:, lang] = np.bincount(owner, weights=count[lang], minlength=len(texts))
        return total, lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: 1 less the ratio of the best entropy to the second best."""
        known = [t if t and LETTER.search(t) else "" for t in texts]
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        count, length = self.phrases(known)
        rate = count * self.bits / np.maximum(length, 1)[:, None]
        best = rate.argmin(axis=1)
        for i, text in enumerate(known):
            if text:
                langs[i] = self.langs[best[i]]
                two = np.partition(rate[i], 1)[:2] if len(self.langs) > 1 else (0.0, 1.0)
                scores[i] = float(1 - two[0] / two[1]) if two[1] else 0.0
        return langs, scores


def fit(train: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Automata of ``train`` (doc_id, text, lang): about ``docs_per_lang`` documents per language, chosen by the
    hash of doc_id below a bound set from the language's count, and ``chars`` characters of each from a place that
    another hash chooses. A language of little text parses into more phrases of the same cost, so a stray label can't
    win; letters that a language's sample lacks are phrases of their own."""
    train = train.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    unit = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    chosen = train.join(counts, "lang").where(unit(3) * F.col("n") < docs_per_lang)
    begin = F.floor(unit(4) * F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    rows = chosen.select("lang", F.substring(F.col("text"), begin, F.lit(chars)).alias("t"), "doc_id").collect()  # the bounded sample
    texts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.t)):
        texts[r.lang] = texts.get(r.lang, "") + r.t + "\n"
    texts = {k: v for k, v in texts.items() if LETTER.search(v)}
    letters = sorted({c for v in texts.values() for c in "".join(LETTERS.findall(v.lower()))})[: (1 << 16) - 1]  # all there are in Unicode's first plane
    codes = np.zeros(max([128, *(ord(c) + 2 for c in letters), *(ord(c.upper()[0]) + 2 for c in letters)]), np.uint16)
    for k, c in enumerate(letters, 1):
        codes[ord(c)] = k
        if len(c.upper()) == 1:
            codes[ord(c.upper())] = k
    langs, width = sorted(texts), len(letters) + 1
    model = Model(langs, codes, Edges([], width), width, np.zeros(0, np.int32), 1.0)
    samples = [model.symbols(texts[k]) for k in langs]
    nexts, roots = [], []
    for sample in samples:
        first = len(nexts)
        roots.append(first)
        nexts += [{c: first + to for c, to in out.items()} for out in automaton(sample.tolist())]
    model.roots = np.array(roots, np.int32)
    model.bits = float(np.log2(max(map(len, samples), default=1) + 1))
    model.edges = Edges(nexts, width)
    return model


def languages(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """(``keep``…, lang_pred, score) of every whole text.

    ``und`` with score 0 for NULL texts, texts without a letter, or a model without languages; equal entropies go to
    the language that sorts first. Only the text decides, so repeated rows and NULL ids need no care; no rows give no
    rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return over_texts(docs, lambda: lambda texts: list(shared.value.predict(texts)), "lang_pred string, score double", keep)
