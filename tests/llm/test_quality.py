import zlib

import numpy as np
import pytest

from twinpane.llm import quality as q


def naive_features(net, text):
    """One window, chunk and filter at a time."""
    spots = -(-len(text) // q.STRIDE)
    if not spots:
        return np.zeros(2 * q.FILTERS)
    padded = text + bytes(q.STRIDE * q.WIDTH)
    value = np.array([sum(net.tables[j, padded[p * q.STRIDE + j]] for j in range(q.WIDTH)) + net.bias for p in range(spots)])
    halves = [value[i : i + q.HALF].max(0) for i in range(0, spots, q.HALF)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:], strict=False)] or halves
    pooled = np.maximum(np.array(chunks), 0)
    return np.concatenate([pooled.max(0), pooled.mean(0)])


def pack(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_forward_matches_a_naive_network_and_gradient_matches_differences():
    rng = np.random.Generator(np.random.PCG64(1))
    net = q.Network(rng)
    for name in ("tables", "bias", "weights", "offset"):  # differences need the precision
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts = [rng.integers(1, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 5, 255, 256, 257, 511, 512, 513, 2000, 7001)]
    features, kept = net.forward(*pack(texts), keep=True)
    assert np.allclose(features, [naive_features(net, t) for t in texts], atol=1e-4)
    label = np.arange(len(texts)) % 2
    loss = lambda: -np.mean(np.log(np.where(label == 1, p := net.probability(net.forward(*pack(texts))[0]), 1 - p)))
    grads = net.gradient(features, kept, ((net.probability(features) - label) / len(texts)).astype(np.float32))
    for p, g in zip(net.parameters(), grads, strict=True):
        flat, gf = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-abs(gf))[:4]:
            old, step = flat[i], 1e-6
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - gf[i]) < 1e-3 * abs(gf[i]) + 1e-6


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = q.op8_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.9


@pytest.mark.parametrize("labels", [[], [1, 1, 1]])
def test_edges(spark, labels):
    marks = spark.createDataFrame([*((i, y) for i, y in enumerate(labels)), (None, 1), (77, 5), (78, None)], "doc_id long, quality int")
    net = q.train(spark.createDataFrame([(i, "text") for i in range(4)], "doc_id long, text string"), marks)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é" * 300_000, "x"), (3, "é" * 300_000, "x")], "doc_id long, text string, score string")
    got = q.score(docs, net).collect()
    assert len(got) == 4 and len({round(r.score, 6) for r in got}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert q.score(docs.limit(0), net).count() == 0
