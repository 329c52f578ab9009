import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fillsight.llm import quality, toxicity

LABELS = "doc_id bigint, quality int, toxic int, text string"


def held(d, modulus, rest):
    return d is not None and zlib.crc32(str(d).encode()) % modulus == rest


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.mark.parametrize("module,label,modulus,rest", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(tables, module, label, modulus, rest):
    docs, labels = tables
    got = {r.doc_id: r for r in module.classify(docs, labels).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    test = [d for d in truth if held(d, modulus, rest)]
    assert all(got[d].held_out == held(d, modulus, rest) for d in got)
    assert np.mean([got[d].predicted == truth[d] for d in test]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, docs, edge_rows, module):
    labels = spark.createDataFrame(
        [(d, i % 2, i % 2, "x") for i, (d, _) in enumerate(edge_rows)] + [(1, None, None, None), (99, 1, 1, "")], LABELS
    )
    frame = docs(edge_rows, extra=True)
    got = module.classify(frame, labels).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d for d, _ in edge_rows), key=repr)
    assert all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], LABELS)
    assert len(module.classify(frame, none).collect()) == len(edge_rows)
    assert module.classify(docs([]), labels).collect() == []


def test_rejected_rows_go_with_all_columns(docs, edge_rows):
    frame = docs(edge_rows, extra=True)
    everything = quality.Trees(5.0, np.zeros((0, 15), int), np.zeros((0, 15)), np.zeros((0, 16)))
    kept = quality.keep_good(frame, None, everything)
    assert kept.columns == frame.columns
    assert kept.count() == len(edge_rows)
    nothing = quality.Trees(-5.0, *(getattr(everything, k) for k in ("feature", "threshold", "value")))
    assert quality.keep_good(frame, None, nothing).count() == 0


def test_trees_equal_a_row_by_row_walk():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, rounds=10, depth=3)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    for row, got in zip(x[:50], model.raw(x[:50])):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert abs(total - got) < 1e-9


def test_statistics_do_not_depend_on_the_batch(edge_rows):
    texts = [t for _, t in edge_rows]
    whole = quality.batch_statistics(pa.array(texts))
    assert np.allclose(whole, np.vstack([quality.batch_statistics(pa.array([t], pa.string())) for t in texts]))
    assert not whole[1].any() and not whole[2].any()


def small_network():
    texts = [f"t{i}" + " kind" * (i % 40) + (" idiot" if i % 2 else " good") + " kind" * (i % 7) for i in range(60)]
    return texts, toxicity.fit(texts, np.arange(60) % 2)


def test_network_gradients_and_windows():
    texts, net = small_network()
    assert net.scores(*_buffer(["nothing here", "an idiot", "", "?!"]))[1] > 0.5
    assert net.scores(*_buffer([""]))[0] == 0
    # a toxic word anywhere in a long text is inside some window
    for place in (0, 30, 31, 32, 200, 399):
        text = ["kind"] * 400
        text[place] = "idiot"
        assert net.scores(*_buffer([" ".join(text)]))[0] > 0.5, place
    # analytic against numeric gradients
    words = toxicity.read_words(*_buffer(texts[:4]))
    text, start, size = toxicity.windows(words.before, len(words.place))
    index, mask = toxicity._places(words, start, size)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = net.inputs(words).astype(np.float64)
    y = np.arange(len(text)) % 2

    def loss():
        z = net.forward(net.project(x), index, mask)
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    keep = {}
    z = net.forward(net.project(x), index, mask, keep)
    grads = net.backward(keep, index, mask, toxicity._sigmoid(z) - y, len(words.hashes))
    grads["in"] = x.T @ grads["gates"][:-1]
    for name in ("rz0", "n1", "att", "look", "out", "in"):
        p = net.p[name].reshape(-1)
        for i in range(0, len(p), max(len(p) // 5, 1)):
            old, step = p[i], 1e-4
            p[i] = old + step
            up = loss()
            p[i] = old - step
            down = loss()
            p[i] = old
            assert abs((up - down) / (2 * step) - np.asarray(grads[name]).reshape(-1)[i]) < 2e-3, name


def _buffer(texts):
    from fillsight.llm.common import text_buffer

    return text_buffer(pa.array(texts, pa.large_string()))


def plain_forward(net, words, start, size):
    """The network word by word in plain Python floats."""
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    h = toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda v, m, j: sum(a * row[j] for a, row in zip(v, m))
    ends = [*words.first[1:], len(words.grams)]
    vocabulary = {int(w): i + 1 for i, w in enumerate(net.vocabulary)}

    def gates(kind):
        x = list(p["word"][vocabulary.get(int(words.hashes[kind]), 0)])
        grams = [p["gram"][g] for g in words.grams[words.first[kind] : ends[kind]]]
        x += [sum(g[i] for g in grams) for i in range(toxicity.EMBED)]
        return [dot(x, p["in"], j) + p["bias"][j] for j in range(6 * h)]

    out = []
    for s, n in zip(start, size):
        inputs = [gates(k) for k in words.place[s : s + n]]
        both = []
        for way in (0, 1):
            state, states = [0.0] * h, [None] * n
            for t in range(n) if way == 0 else reversed(range(n)):
                g = inputs[t][3 * h * way : 3 * h * (way + 1)]
                r = [sigmoid(g[j] + dot(state, p[f"rz{way}"], j)) for j in range(h)]
                z = [sigmoid(g[h + j] + dot(state, p[f"rz{way}"], h + j)) for j in range(h)]
                new = [math.tanh(g[2 * h + j] + r[j] * dot(state, p[f"n{way}"], j)) for j in range(h)]
                state = states[t] = [(1 - a) * b + a * c for a, b, c in zip(z, new, state)]
            both.append(states)
        hidden = [a + b for a, b in zip(*both)]
        score = [sum(math.tanh(dot(v, p["att"], j)) * p["look"][j] for j in range(h)) for v in hidden]
        weight = [math.exp(x - max(score)) for x in score]
        pooled = [sum(w * v[i] for w, v in zip(weight, hidden)) / sum(weight) for i in range(2 * h)]
        out.append(sum(a * b for a, b in zip(pooled, p["out"])) + p["base"][0])
    return out


def test_network_equals_a_plain_pass():
    texts, net = small_network()
    words = toxicity.read_words(*_buffer(["An idiot wrote this, kind of", "x", "good kind " * 30, "ünïcode idiot 中文"]))
    text, start, size = toxicity.windows(words.before, len(words.place))
    assert len(start) > 4
    assert np.allclose(net.window_scores(words, start, size), plain_forward(net, words, start, size), atol=1e-4)


def test_windows_hold_passages_at_every_offset():
    """A passage of up to 17 words is whole in some window, a longer one all but a few words of it."""
    for n in (40, 41, 55, 64, 200):
        _, start, size = toxicity.windows(np.array([0, n]), n)
        for length in (1, 8, 17, 24, 32):
            whole = toxicity.WINDOW - toxicity.STRIDE + 1
            for a in range(n - length + 1):
                held = max(min(s + m, a + length) - max(s, a) for s, m in zip(start, size))
                assert held >= min(length, whole) and held >= length - (max(length - whole, 0) + 1) // 2


def test_planted_phrases_are_found_at_every_offset():
    r = np.random.default_rng(3)
    clean = [f"plain{i}" for i in range(60)]
    phrase = "you are such a worthless lying fool".split()
    long = lambda n: [clean[i] for i in r.integers(0, 60, n)]
    texts, toxic = [], []
    for i in range(300):
        words = long(int(r.integers(20, 120)))
        if i % 2:
            at = int(r.integers(0, len(words)))
            words[at:at] = phrase
        texts.append(" ".join(words))
        toxic.append(i % 2)
    net = toxicity.fit(texts, np.array(toxic))
    for extra in (0, 8, 25):  # the phrase inside passages of 7, 15 and 32 words
        passage = phrase + long(extra)
        planted = [" ".join([*long(a), *passage, *long(100 - a)]) for a in range(0, 101)]
        assert min(net.scores(*_buffer(planted))) >= toxicity.THRESHOLD
    assert max(net.scores(*_buffer([" ".join(long(150)) for _ in range(100)]))) < toxicity.THRESHOLD


def test_long_texts_teach_through_drawn_passages(spark):
    text = " ".join(f"w{i}" for i in range(400_000))
    drawn = toxicity.drawn_passages(text)
    assert len(drawn) <= toxicity.SAMPLE_CHARS and drawn == toxicity.drawn_passages(text)
    at = [int(w[1:]) for w in drawn.split()]
    assert at == sorted(at) and at[-1] > 300_000 and at[0] < 100_000
    assert len(toxicity.drawn_passages("x" * 1_000_000)) <= toxicity.SAMPLE_CHARS and toxicity.drawn_passages("a b") == "a b"
    # one labelled id on very many rows: the sample stays bounded
    rows = [(1, f"an idiot {i % 40} " + "kind " * 30) for i in range(3_000)] + [(2 + i, "good kind " * 20) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(1, 102)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(frame, labels, 30)
    assert toxicity.batch_scores(model, pa.array(["an idiot 5 kind", "good kind"])).tolist()[0] > 0.3
