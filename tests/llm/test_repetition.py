"""Problem 8: repetition inside texts."""

import random

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from millrace.llm import repetition as R
from tests.conftest import rows

UNIT = regex.compile(r"[぀-ヿ㐀-鿿]|[[\p{L}\p{N}]--[぀-ヿ㐀-鿿]]+", regex.V1)


def plain(text):
    units = [u.lower() for u in UNIT.findall(text or "")]
    seen, again = set(), [False] * len(units)
    for i in range(len(units) - 5):
        six = tuple(units[i : i + 6])
        if six in seen:
            again[i : i + 6] = [True] * 6
        seen.add(six)
    return len(units), sum(again), len(set(units))


def parts_again(text, cut):
    seen, total, again = set(), 0, 0
    for s in regex.split(cut, text or ""):
        total += len(s)
        again += len(s) if s and s in seen else 0
        seen.add(s)
    return total, again


TEXTS = [
    None, "", " \n", "a", "a b c d e f g " * 4, "A B C D E F a b c d e f", "a-b_c d'e f a b c d e f", "日本語日本語日本語日本語日本語", "漢a漢a漢a漢a漢a漢a漢a", "x " * 50, "x" * 5000, "ΑΣ ΒΣ α β γ δ ΑΣ ΒΣ α β γ δ ας", "İ i ı I 1 2 İ i ı I 1 2",
    "One line.\nTwo lines!\nOne line.\nOne line.", "1² ½ Ⅷ ٣ a b 1² ½ Ⅷ ٣ a b", "🙂 a 🙂 b 🙂 c 🙂 d 🙂 e 🙂 f 🙂 a b c d e f",
]


def counted(texts):
    return np.concatenate(list(R.statistics(pa.array(texts, pa.string()))), 1)


def test_units_against_plain(monkeypatch):
    rng = random.Random(1)
    words = ["a", "B", "b", "日", "本", "x1", "é", "É", ".", "\n", "- "]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(300)] + ["".join(rng.choices(words, k=40)) for _ in range(300)]
    for size in (1 << 20, 100):
        monkeypatch.setattr(R, "CHUNK_BYTES", size)
        m = counted(texts)
        assert list(map(tuple, m[:3].T.tolist())) == [plain(t) for t in texts]
        lines, sentences = [parts_again(t, r"[\n\r\x85  ]") for t in texts], [parts_again(t, r"[\n\r\x85  .!?。！？]") for t in texts]
        folded = lambda t: (t or "").lower()
        assert [x[0] for x in lines] == m[3].tolist() and [x[0] for x in sentences] == m[5].tolist()
        assert [parts_again(folded(t), r"[\n\r\x85  ]")[1] for t in texts if t != TEXTS[12]] == [v for v, t in zip(m[4].tolist(), texts) if t != TEXTS[12]]


def corpus(spark, n=600, seed=2):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 80))]
        if i % 9 == 0:
            words = words[:8] * rng.randrange(2, 9)
        texts.append(" ".join(words))
    texts += TEXTS
    return texts, spark.createDataFrame([(i, t, 0.5, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, score double, units int").repartition(4)


def is_case(text):
    units, again, _ = plain(text)
    return units >= 20 and again * 5 >= units * 2


def test_no_case_is_lost(spark):
    texts, df = corpus(spark)
    want = [(i,) for i, t in enumerate(texts) if is_case(t)]
    for rows_ in (5, 64, 4096):  # whatever the forest was grown on
        assert rows(R.repeated_texts(df, rows=rows_)) == sorted(want, key=repr)


def test_forest_sets_cases_apart(spark):
    texts, df = corpus(spark)
    scored = R.anomalies(df).collect()
    assert {"repeated_share", "score", "is_candidate"} <= set(scored[0].asDict())
    case = [r.score for r in scored if is_case(texts[r.doc_id])]
    other = [r.score for r in scored if not is_case(texts[r.doc_id])]
    assert np.mean([c > o for c in case for o in other]) > 0.9  # held-out ranking quality


def test_bound_is_below_every_possible_case():
    rng = np.random.default_rng(3)
    x = rng.random((500, 4)) ** 3
    forest = R.IsolationForest.grow(x, trees=20, rows=64)
    forest.calibrated(x, x[:, 0] > 0.95, 0.9, forest.least_score(0, 0.4))
    possible = rng.random((5000, 4)) * 2
    possible[:, 0] = 0.4 + rng.random(5000)
    assert (forest.scores(possible) >= forest.bound).all()


def test_threshold_follows_the_labels(spark):
    """Other labels and another recall give other thresholds; the stated recall holds on the held-out labelled rows."""
    _, df = corpus(spark, 2000)
    stats = R.repetition(df).cache()
    by_rule, wider, none = (R.fit_forest(stats, "doc_id", label=label) for label in (None, F.col("same_unit_share") > 0.1, F.lit(False)))
    assert by_rule.held_out > 50 and by_rule.recall >= R.RECALL and by_rule.threshold > by_rule.bound
    assert wider.threshold < by_rule.threshold and wider.held_out > by_rule.held_out
    assert none.threshold == none.bound and none.held_out == 0
    loose = R.fit_forest(stats, "doc_id", recall=0.5)
    assert loose.threshold > by_rule.threshold and 0.5 <= loose.recall < by_rule.recall
    counted = {r[0]: r[1] for r in R.anomalies(df, recall=0.5).groupBy("is_candidate").count().collect()}
    assert counted[True] < R.anomalies(df).where("is_candidate").count() < sum(counted.values())


def thue_morse(size, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(size))


def test_units_with_equal_hashes():
    """Complementary Thue-Morse words have equal polynomial hashes: they are told apart, in units, lines and sentences."""
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rng = random.Random(5)
    texts = [" ".join(rng.choice((a, b)) for _ in range(30)) for _ in range(5)] + [f"{a}\n{b}\n{a}\n", f"{a} x. {b} x. {b} x."]
    m = counted(texts)
    assert list(map(tuple, m[:3].T.tolist())) == [plain(t) for t in texts]
    assert m[4].tolist()[-2] == 1024 and m[6].tolist()[-1] == 1024 + 3


def test_groups_with_equal_keys():
    values = [5, 7, 5, 7, 9, 7, 5]
    v = np.array(values)
    group, again = R._groups(np.zeros(7, np.uint64), lambda i, j: v[i] == v[j], lambda i: values[i])
    assert again.tolist() == [False, False, True, True, False, True, True]
    assert all((group[i] == group[j]) == (values[i] == values[j]) for i in range(7) for j in range(7))


def test_empty_and_clashing_columns(spark):
    _, df = corpus(spark, 3)
    assert R.repetition(df).columns == ["doc_id", *R.COUNTS, *R.SHARES] and R.repetition(df).count() == 3 + len(TEXTS)
    assert R.repeated_texts(df.limit(0)).count() == 0 and R.anomalies(df.limit(0)).columns[-3:] == ["score", "is_candidate", "is_possible"]
    same = spark.createDataFrame([(None, "a b c d e f g " * 9)] * 3, "doc_id bigint, text string")
    assert rows(R.repeated_texts(same)) == [(None,)] * 3
