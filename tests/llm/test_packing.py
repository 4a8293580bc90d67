"""Problem 7: containers."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing
from millrace.llm.packing import container_fill, non_negative_least_squares, pack_texts, patterns_of, plan_containers

pytest.importorskip("public_tokenizers")


def laid_out(plan, counts):
    """Containers as sorted (position, size) lists; every text of every size is placed once."""
    by_size, out = defaultdict(list), defaultdict(list)
    for size, first, base, many, offset in plan.slots:
        by_size[size].append((first, base, many, offset))
    for size, slots in by_size.items():
        slots.sort()
        assert slots[0][0] == 0
        for (first, base, many, offset), (after, *_) in zip(slots, [*slots[1:], (counts[size],)]):
            for n in range(after - first):
                out[base + n // many].append((offset + n % many * size, size))
    assert sum(map(len, out.values())) == sum(counts.values())
    return {k: sorted(v) for k, v in out.items()}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=60))
def test_plan_is_valid(capacity, sizes):
    counts = defaultdict(int)
    for s in sizes:
        counts[min(s, capacity)] += 1
    plan = plan_containers(counts, capacity)
    boxes = laid_out(plan, counts) if counts else {}
    assert sorted(boxes) == list(range(plan.n_containers))
    for box in boxes.values():
        assert all(a + s <= b for (a, s), (b, _) in zip(box, [*box[1:], (capacity, 0)]))


def test_classes_coarser_than_sizes(monkeypatch):
    monkeypatch.setattr(packing, "SETTINGS", [(20, 3), (20, 8)])
    rng = random.Random(1)
    counts = {s: rng.randrange(1, 30) for s in range(1, 1001, 3)}
    plan = plan_containers(dict(counts), 1000)
    boxes = laid_out(plan, counts)
    assert all(p + s <= 1000 for box in boxes.values() for p, s in box)
    assert plan.n_containers <= 1.045 * sum(s * n for s, n in counts.items()) / 1000


@pytest.fixture(scope="module")
def histogram():
    """Sizes of the texts of sf0.1, as they are after full containers were cut off."""
    import pyarrow.parquet as pq

    from millrace.llm.text_encoding import text_encoder
    from millrace.llm.vocabulary import default_path

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"]
    n = np.concatenate([text_encoder(default_path()).lengths(c) for c in texts.chunks])
    return np.bincount(n[n % 2048 > 0] % 2048, minlength=2049) + (n // 2048).sum() * (np.arange(2049) == 2048)


@pytest.mark.parametrize("times", [1, 100, 10_000])
def test_containers_come_from_patterns(histogram, times):
    """Least squares place nearly all containers, and hardly any space stays unused, however large the corpus is."""
    counts = {s: int(n) * times for s, n in enumerate(histogram) if n}
    plan = plan_containers(dict(counts), 2048)
    tokens = sum(s * n for s, n in counts.items())
    assert plan.from_patterns >= 0.95 * plan.n_containers
    assert plan.n_containers * 2048 * (1 - 0.0001) <= tokens
    assert len(plan.slots) < 3 * 2048 + 65 * 8 * 32  # bounded by capacity and classes, not by the corpus


def test_fill_is_close_on_other_sizes():
    rng = np.random.default_rng(2)
    kinds = [(np.clip(np.exp(rng.normal(5.6, 1.0, 50_000)).astype(int), 1, 2048), 0.001), (rng.integers(1, 2049, 50_000), 0.015), (rng.integers(1, 500, 50_000), 0.001)]
    for sizes, unused in kinds:  # the more small texts, the less stays unused
        for times in (1, 1000):
            counts = {int(s): int(n) * times for s, n in zip(*np.unique(sizes, return_counts=True))}
            plan = plan_containers(counts, 2048)
            assert plan.n_containers * 2048 * (1 - unused) < sizes.sum() * times and plan.from_patterns > 0.5 * plan.n_containers
            assert len(plan.slots) < 20_000


def test_patterns():
    uses = patterns_of(10, 3)
    found = {tuple(np.repeat(np.arange(11), uses[:, p].astype(int)).tolist()) for p in range(uses.shape[1])}
    assert found == {(3,), (4,), (5,), (6,), (7,), (8,), (9,), (10,), (3, 3), (3, 4), (3, 5), (3, 6), (3, 7), (4, 4), (4, 5), (4, 6), (5, 5), (3, 3, 3), (3, 3, 4)}


@pytest.mark.parametrize("seed", range(20))
def test_least_squares(seed):
    """The conditions of the optimum: no gradient where x is positive, none downhill where it is zero."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, (8, 40)).astype(float), rng.random(8) * (50 if seed % 2 else 1)
    x = non_negative_least_squares(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and (x > 0).sum() <= 8
    assert np.abs(gain[x > 0]).max(initial=0) < 1e-6 * (1 + b.max()) and gain.max() < 1e-6 * (1 + b.max())


def test_operator(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "word " * 700, "word " * 16] + ["w" + " word" * rng.randrange(1, 40) for _ in range(200)]
    df = spark.createDataFrame([(i % 190 if i % 7 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, container_id int, position int").repartition(5)
    got = pack_texts(df, capacity=64).collect()
    from millrace.llm.encoding_ops import token_lengths

    sizes = sorted(r.n_tokens for r in token_lengths(df).collect())
    boxes, parts = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.start_token // 64 if r.start_token else 0].append(r)
        if r.n_tokens:
            boxes[r.container_id].append((r.position, r.n_tokens))
        else:
            assert r.container_id is None and r.position is None and r.start_token == 0
    assert sum(r.n_tokens for r in got) == sum(sizes) and sum(r.n_tokens == 0 for r in got) == 2
    assert len(got) == sum(max(1, -(-n // 64)) for n in sizes)
    for box in boxes.values():
        box.sort()
        assert all(a + s <= b for (a, s), (b, _) in zip(box, [*box[1:], (64, 0)]))
    assert sorted(boxes) == list(range(len(boxes))) and len(boxes) <= 1.03 * sum(sizes) / 64 + 1
    assert container_fill(pack_texts(df, capacity=64), 64).first().n_containers == len(boxes)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack_texts(none).count() == 0
    assert tuple(container_fill(pack_texts(none)).first()) == (0, 0, None)
    assert pack_texts(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first().container_id is None
