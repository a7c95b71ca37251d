"""Secret scan with a character convolutional network over every candidate and its context.

Base patterns find secrets of known form. Every other run of key-like characters is a candidate; the network sees its
characters and those around it, marked apart. It is trained on labelled findings: base findings and other candidates
of a bounded sample of documents, and made-up keys and harmless identifiers in plain context, so that a key is known
by its form without a telling name before it. Scores are calibrated on findings left out of training, and the
threshold is the highest that keeps the recall asked for on them.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.llm.common import bounded_sample, over_texts

KINDS = ("assign", "access", "hex")
MODEL_KIND = "cnn"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of the maximal runs, those long enough
CUE = re.compile(r"(?i:passw|secret|token|api_?key)", re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # with a digit
DIGIT = re.compile("[0-9]")
LEFT, MIDDLE, RIGHT = 24, 48, 8  # characters shown; of a longer candidate its first and last half
SAMPLE_DOCS = 20_000  # documents looked through for labelled findings at most
FINDINGS = 3000  # findings of each label used at most
RECALL = 0.95
FILTERS, WIDTH, CHANNELS = 24, 5, 12
ALPHABET = {c: i for i, c in enumerate(string.printable, 2)}  # 0 nothing there, 1 any other character


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start, then kind as listed."""
    out = []
    if CUE.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def other_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of the candidates that no base finding overlaps; both are in order of their starts."""
    out, k, upto = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            upto = max(upto, base[k][1])
            k += 1
        if upto <= m.start() and DIGIT.search(m[0]):
            out.append(m.span())
    return out


def window(text: str, start: int, end: int) -> list[int]:
    """Codes of the context and the candidate; candidate characters are shifted by the alphabet's size."""
    body = text[start:end] if end - start <= MIDDLE else text[start : start + MIDDLE // 2] + text[end - MIDDLE // 2 : end]
    left, right = text[max(start - LEFT, 0) : start], text[end : end + RIGHT]
    shift = len(ALPHABET) + 2
    codes = [0] * (LEFT - len(left)) + [ALPHABET.get(c, 1) for c in left]
    codes += [ALPHABET.get(c, 1) + shift for c in body] + [0] * (MIDDLE - len(body))
    return codes + [ALPHABET.get(c, 1) for c in right] + [0] * (RIGHT - len(right))


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray
    scale: float = 1.0  # calibration: sigmoid(scale * score + shift)
    shift: float = 0.0
    threshold: float = 2.0
    names: tuple = field(default=("embed", "conv", "bias", "out", "offset"), repr=False)

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        n = 2 * (len(ALPHABET) + 2)
        return cls(rng.normal(0, 0.5, (n, CHANNELS)), rng.normal(0, 0.2, (WIDTH * CHANNELS, FILTERS)), np.zeros(FILTERS),
                   rng.normal(0, 0.3, 2 * FILTERS), np.zeros(1))

    def forward(self, codes: np.ndarray):
        x = self.embed[codes]
        n = x.shape[1] - WIDTH + 1
        cols = np.concatenate([x[:, k : k + n] for k in range(WIDTH)], axis=2)
        hidden = np.maximum(cols @ self.conv + self.bias, 0)
        at = hidden.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(hidden, at[:, None], 1)[:, 0], hidden.mean(axis=1)), axis=1)
        return pooled @ self.out + self.offset[0], (x, cols, hidden, at, pooled)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.forward(codes[i : i + 256])[0] for i in range(0, len(codes), 256)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        z, (x, cols, hidden, at, pooled) = self.forward(codes)
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(labels)
        dpool = dz[:, None] * self.out
        dhidden = np.repeat(dpool[:, None, FILTERS:] / hidden.shape[1], hidden.shape[1], axis=1)
        top = np.take_along_axis(dhidden, at[:, None], 1) + dpool[:, None, :FILTERS]
        np.put_along_axis(dhidden, at[:, None], top, 1)
        dhidden *= hidden > 0
        dcols = dhidden @ self.conv.T
        dx, n = np.zeros_like(x), cols.shape[1]
        for k in range(WIDTH):
            dx[:, k : k + n] += dcols[:, :, k * CHANNELS : (k + 1) * CHANNELS]
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, codes.ravel(), dx.reshape(-1, CHANNELS))
        return {"embed": dembed, "conv": np.tensordot(cols, dhidden, ((0, 1), (0, 1))), "bias": dhidden.sum((0, 1)),
                "out": pooled.T @ dz, "offset": np.array([dz.sum()])}


def made_up(rng: np.random.Generator, n: int) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Labelled findings of our own: (text, start, end) of keys, and of harmless identifiers, in plain context."""
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    mixed = string.ascii_letters + string.digits
    words = ["river", "stone", "under", "light", "paper", "winter", "module", "report", "garden", "signal"]
    keys, plain = [], []
    for k in range(n):
        size = int(rng.integers(20, 49))
        key = [pick(mixed, size), pick("0123456789ABCDEF", size), pick(mixed + "+/", size) + "==", "sk_" + pick(mixed, size),
               pick("0123456789abcdef", 20)][k % 5]
        names = [str(w) for w in rng.choice(words, 4)]
        safe = ["-".join(names[:3]) + f"-{rng.integers(2100)}", "_".join(names) + str(rng.integers(99)), "/".join(names[:3]) + f"/{rng.integers(1900, 2100)}/index",
                f"{rng.integers(1900, 2100)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}T0{rng.integers(9)}-{rng.integers(10, 59)}-00", str(rng.integers(10**15, 10**16)) + str(rng.integers(100)),
                "=" * 8 + str(rng.integers(9)) + "=" * 8, names[0].title() + names[1].title() + names[2].title() + str(rng.integers(9))][k % 7]
        for body, where in ((key, keys), (safe, plain)):
            before = " ".join(str(w) for w in rng.choice(words, int(rng.integers(0, 5)))) + " "
            where.append((before + body + " " + names[3], len(before), len(before) + len(body)))
    return keys, plain


def train(keys: list, plain: list, recall: float = RECALL, epochs: int = 12, seed: int = 11) -> Network:
    """Network from findings (text, start, end) of both labels; every fourth is left out for calibration and threshold."""
    codes = np.array([window(*f) for f in (*keys, *plain)], np.int64)
    labels = np.concatenate((np.ones(len(keys)), np.zeros(len(plain))))
    aside = np.arange(len(labels)) % 4 == 3
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in net.names}
    fit, step = np.flatnonzero(~aside), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), 128):
            step += 1
            some = fit[at : at + 128]
            for name, grad in net.gradients(codes[some], labels[some]).items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value = getattr(net, name)
                value -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    z = np.concatenate([net.forward(codes[aside][i : i + 256])[0] for i in range(0, aside.sum(), 256)])
    y = labels[aside]
    a, b = 1.0, 0.0  # Platt scaling
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        a, b = a - 0.05 * ((p - y) * z).mean() / max(1.0, np.abs(z).mean()), b - 0.05 * (p - y).mean()
    net.scale, net.shift = float(a), float(b)
    good = np.sort(net.probability(codes[aside])[y == 1])
    net.threshold = float(good[int((1 - recall) * len(good))])
    return net


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, findings: int = FINDINGS) -> Network:
    """Network trained on the findings of at most ``sample`` documents, ``findings`` of each label at most, with as
    many made-up ones. Base findings are shown without their name at random halves, so that form counts."""

    def step(texts):
        keys, plain = [], []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            cut = lambda s, e: [text[max(s - LEFT, 0) : s], text[s:e][:400], text[e : e + RIGHT]]
            keys.append([x for s, e, kind in base for x in cut(*((value_start(text, s, e), e) if kind == "assign" else (s, e)))])
            plain.append([x for s, e in other_candidates(text, base)[:20] for x in cut(s, e)])
        return ["\x00".join(k) for k in keys], ["\x00".join(p) for p in plain]

    few = bounded_sample(docs.where("text IS NOT NULL").select("doc_id").distinct(), "doc_id", sample)
    some = docs.join(F.broadcast(few), "doc_id")
    rows = over_texts(some, lambda: step, "keys string, plain string").where("keys <> '' OR plain <> ''")
    rows = bounded_sample(rows, "doc_id", findings).collect()  # short windows of at most ``findings`` documents

    def read(cells):
        out = []
        for cell in cells:
            parts = cell.split("\x00") if cell else []
            out += [(a + b + c, len(a), len(a) + len(b)) for a, b, c in zip(parts[::3], parts[1::3], parts[2::3])]
        return out[:findings]

    keys, plain = read(r.keys for r in rows), read(r.plain for r in rows)
    rng = np.random.default_rng(5)
    bare = [(t[s:], 0, e - s) if rng.random() < 0.5 else (t, s, e) for t, s, e in keys]
    more = made_up(rng, max(400, min(findings, len(keys))))
    return train(bare + more[0], plain + more[1])


def value_start(text: str, start: int, end: int) -> int:
    m = ASSIGN.match(text, start, end)
    return m.start(2) if m else start


def scan(docs: DataFrame, net: Network | None, keep=("doc_id",)) -> DataFrame:
    """(``keep``…, n_assign, n_access, n_hex, base, spans) of every whole text.

    ``base`` and ``spans`` list findings as kind:start:end (code points, end exclusive) by start, then kind as listed,
    comma-joined; ``spans`` also has the candidates that the network puts at or above its threshold, as kind ``cnn``.
    NULL and empty texts have none. Only the text decides, so repeated rows and NULL ids need no care; no rows give
    no rows. Without a network the spans are the base ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    order = (*KINDS, MODEL_KIND)
    show = lambda spans: ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)

    def step(texts):
        net = shared.value
        found = [base_spans(t or "") for t in texts]
        tried = [(i, s, e) for i, t in enumerate(texts) if t and net for s, e in other_candidates(t, found[i])]
        more = [[] for _ in texts]
        for at in range(0, len(tried), 4096):
            some = tried[at : at + 4096]
            p = net.probability(np.array([window(texts[i], s, e) for i, s, e in some], np.int64))
            for (i, s, e), value in zip(some, p):
                if value >= net.threshold:
                    more[i].append((s, e, MODEL_KIND))
        counts = [[sum(k == kind for *_, k in f) for f in found] for kind in KINDS]
        both = [sorted(f + m, key=lambda s: (s[0], order.index(s[2]))) for f, m in zip(found, more)]
        return [*counts, list(map(show, found)), list(map(show, both))]

    return over_texts(docs, lambda: step, "n_assign bigint, n_access bigint, n_hex bigint, base string, spans string", keep)
