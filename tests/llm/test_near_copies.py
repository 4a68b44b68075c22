"""Near copies by word shingles against brute force over exact similarities."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import minhash, simhash


def text(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def edited(r, words, k):
    words = list(words)
    for _ in range(k):
        words[r.randrange(len(words))] = f"x{r.randrange(5000)}"
    return words


def by_force(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_one_changed_word_in_a_hundred_is_a_near_copy(spark):
    r = random.Random(3)
    rows = []
    for k in range(20):
        base = text(r, 100)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:50], "other", *base[51:]]))]
    left = {x.doc_id for x in simhash.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {2 * k for k in range(20)}


@pytest.mark.parametrize(("paired", "tile"), [(32, 128), (1, 4)])
def test_groups_equal_brute_force(spark, monkeypatch, paired, tile):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "TILE", tile)
    r = random.Random(5)
    texts = ["", " ", "a", "A", "a b c", "a b c d", *(" ".join(text(r, 40)) for _ in range(20))]
    for n in (20, 60, 200):
        base = text(r, n)
        texts += [" ".join(edited(r, base, r.randint(0, max(2, n // 25)))) for _ in range(30)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in minhash.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_force(rows)


def test_variants_are_not_broadcast(spark, monkeypatch):
    plans, materialize = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df))
    prints = spark.range(100).select(F.col("id").alias("fp"))
    assert simhash.links(materialize(prints)).count()
    assert "Generate" in plans[0] and "BroadcastExchange" not in plans[0]


@pytest.mark.parametrize("n_left", [1, 60, 120])
def test_a_tile_returns_what_connects_it(n_left):
    r, n = random.Random(n_left), 120
    base = text(r, 300)
    sets = [minhash.shingle_set(" ".join(edited(r, base, k % 12)).encode()) for k in range(n)]
    exact = [set(h.tolist()) for h in sets]
    side = [0 if k < n_left else 1 for k in range(n)]
    ids = [b"%04d" % k for k in range(n)]
    for known in (None, [b"%04d" % (k // 5 * 5) for k in range(n)]):
        table = pa.table({"set": pa.array(ids, pa.binary()), "side": side, "hashes": pa.array([h.tobytes() for h in sets], pa.binary())})
        table = table if known is None else table.append_column("known", pa.array(known, pa.binary()))
        edges = minhash._compare(0.8)(table)
        assert 0 < edges.num_rows < len(set(known or ids))
        right = [k for k in range(n) if side[k]] or range(n)
        linked = [(ids[i], ids[j]) for i in range(n_left) for j in right if 10 * len(exact[i] & exact[j]) >= 8 * len(exact[i] | exact[j])]
        assert len(set(linked)) > n or n_left == 1
        joined = list(zip(ids, known or ids, strict=True))
        assert components(ids, [*zip(edges["src"].to_pylist(), edges["dst"].to_pylist(), strict=True), *joined]) == components(ids, linked + joined)


def components(ids, pairs):
    label = {i: i for i in ids}
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {i: new if x == old else x for i, x in label.items()}
    return label
