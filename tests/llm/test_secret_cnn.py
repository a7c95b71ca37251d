import random
import re

import numpy as np
import pytest

from rastertab.llm import secret_cnn as sc

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def slow_base(text):
    """Leftmost non-overlapping matches per kind, found by trying every place in turn."""
    out, at = [], 0
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    rest = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    while at < len(text):
        name = next((n for n in NAMES if low.startswith(n, at)), None)
        m = rest.match(text, at + len(name)) if name else None
        if m and len(m[1]) >= 6:
            out.append((at, 0, m.end(), "assign"))
        at = m.end() if m else at + 1
    for kind, order, pattern, least in (("access", 1, "AKIA[A-Z0-9]+", 20), ("hex", 2, "[0-9a-f]+", 24)):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(a, c, k) for a, _, c, k in sorted(out)]


def pieces(rng):
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    parts = ["token = ", "Secret:'", "API_KEY=", "paſſword: abcdefgh", "pass", "wd", "AKIA", "AKIA" + "Z9" * 9, hexes(23), hexes(30), "\n", " é ", "x", "abcdef12", ":", '"']
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


def test_base_spans_equal_a_slow_search():
    rng = random.Random(4)
    for _ in range(4000):
        text = pieces(rng)
        assert sc.base_spans(text) == slow_base(text)


@pytest.fixture(scope="module")
def net():
    return sc.train(*sc.made_up(np.random.default_rng(1), 500))


def test_held_out_keys_are_told_from_identifiers(net):
    keys, plain = sc.made_up(np.random.default_rng(99), 300)
    p = [net.probability(np.array([sc.window(*f) for f in part])) for part in (keys, plain)]
    assert (p[0] >= net.threshold).mean() > 0.9
    assert (p[1] >= net.threshold).mean() < 0.03


def test_gradients_equal_differences():
    net, rng = sc.Network.fresh(3), np.random.default_rng(0)
    codes, labels = rng.integers(0, len(net.embed), (6, 80)), np.array([0, 1, 1, 0, 1, 0.0])

    def loss():
        z = net.forward(codes)[0]
        return (np.log1p(np.exp(z)) - labels * z).mean()

    grads = net.gradients(codes, labels)
    for name in net.names:
        value, grad = getattr(net, name).reshape(-1), grads[name].reshape(-1)
        k = int(np.abs(grad).argmax())
        kept = value[k]
        value[k] = kept + 1e-5
        up = loss()
        value[k] = kept - 1e-5
        down = loss()
        value[k] = kept
        assert abs((up - down) / 2e-5 - grad[k]) < 1e-4


def test_scan_adds_spans_and_keeps_base_ones(spark, net):
    key = "9fK2mQ7xV4bT8cR1nW5yZ3aLh6Gd0Es"
    rows = [(1, f"see {key} there", "s"), (2, "token = abcdef123456 and " + key, "s"), (None, None, "s"), (3, "", "s"),
            (3, "x" * 50_000 + " 2019-report-garden-light", "s"), (1, f"see {key} there", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = sc.scan(docs, net).collect()
    by = {(r.doc_id, r.base): r for r in got}
    assert len(got) == 6
    assert by[1, ""].spans == f"cnn:4:{4 + len(key)}"
    two = by[2, "assign:0:20"]
    assert two.n_assign == 1 and two.spans == f"assign:0:20,cnn:25:{25 + len(key)}"
    assert by[None, ""].spans == by[3, ""].spans == ""
    assert sc.scan(docs.limit(0), None).count() == 0


def test_fit_on_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i} token = {'ab12' * 10} river", None) for i in range(20)] + [(30, None, None)], "doc_id bigint, text string, base string")
    assert 0 < sc.fit(docs).threshold < 1
    assert 0 < sc.fit(docs.limit(0)).threshold < 1
