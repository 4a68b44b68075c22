"""The ten operators against brute force, and on odd rows: nulls, empty and very long texts, ties, repeats, no rows, clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import crf_language, edit_embedding, ego_join, mixing, nbsvm, packing, simhash, suffix_dedup, url_filter, weak_toxicity
from loomgraph.llm.queries import URL_RULES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary_=("ab", "cde", "fgh", "ijkl", "mno", "p", "qrs", "tu", "vwx", "yz")):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary_) + r.choice(vocabulary_) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    long = words(1, 30_000)
    base = words(2, 200)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", "en", None), (4, None, None, "b"), (5, "", "de", "b"), (6, " \t\n", None, None),
        (7, long, "de", "c"), (None, "no id " + words(3, 50), "en", "c"), (None, None, None, None), (8, "é" * 300 + " ünï 日本", "fr", "a"), (9, base[:150], "en", "b"), (10, "a " * 300, "en", "b"),
    ]
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS)
    # columns with the names of results must not get in the way
    clash = ["score", "predicted", "size", "target", "taken", "copies", "rate", "source_size", "length", "start", "spans", "kept", "n_links", "component_id", "host", "rule", "verdict", "fp", "lang_pred"]
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1, 3, 10: classifiers ----


def labelled(n=240):
    good = [words(k, 40) for k in range(n)]
    bad = [words(k + n, 40) + " nastyword vileterm" for k in range(n // 4)]
    return good + bad, np.array([0] * n + [1] * (n // 4))


@pytest.mark.parametrize("train", [nbsvm.train, weak_toxicity.train])
def test_classifiers_hold_out(train):
    x, y = labelled()
    at = np.random.default_rng(1).permutation(len(x))
    half = len(x) // 2
    model = train(pa.array([x[k] for k in at[:half]]), y[at[:half]])
    s = model.score(pa.array([x[k] for k in at[half:]]))
    assert ((s >= 0.3) == y[at[half:]]).mean() > 0.97 and ((0 <= s) & (s <= 1)).all()


@pytest.mark.parametrize("train", [nbsvm.train, weak_toxicity.train])
def test_classifiers_with_one_class_or_none(train):
    assert 0 <= train(pa.array([], pa.string()), np.array([])).score(pa.array(["a", None, ""]))[1] <= 1
    s = train(pa.array(["a b", None]), np.array([1, 1])).score(pa.array(["a", None]))
    assert s[0] == s[1] > 0.5


def test_posteriors_recover_flipped_labels():
    r = np.random.default_rng(3)
    y = (r.random(600) < 0.3).astype(float)
    votes = (r.random((600, 12)) < np.where(y[:, None] == 1, 0.6, 0.08)).astype(np.int8)
    votes = np.concatenate([votes, votes[:, :4]], 1)  # voters that copy others tell nothing new
    flipped = np.where(r.random(600) < 0.15, 1 - y, y)
    model = weak_toxicity.label_model(votes, weak_toxicity._logistic(votes[:, :12].sum(1) - 3.0), flipped)
    p = model.posterior(votes)
    assert ((p >= 0.5) != y).mean() < 0.03 < 0.1 < (flipped != y).mean()
    assert (np.sort(model.parent[12:]) == np.arange(4)).all() or sum(model.parent[k] == k - 12 or model.parent[k - 12] == k for k in range(12, 16)) == 4


def test_classify_odd_rows(spark, odd, none):
    x, y = labelled(60)
    for module in (nbsvm, weak_toxicity):
        model = module.train(pa.array(x), y)
        got = nbsvm.classify(odd, model).collect()
        assert len(got) == 13 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert nbsvm.classify(none, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None), (99, 0)], "doc_id long, toxic int")
    assert weak_toxicity.fit(odd, labels).score(pa.array(["x"]))[0] > 0


def test_hinge_dual_matches_its_optimum():
    x = np.array([[1.0, 0.2], [0.8, -0.1], [-1.0, 0.3], [-0.7, -0.4]])
    y = np.array([1, 1, -1, -1.0])
    ptr, idx = np.arange(0, 9, 2), np.tile([0, 1], 4)
    w = nbsvm.dual_coordinate_descent(ptr, idx, x.ravel(), y, 2, np.full(4, 1.0), epochs=500)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    best = min(loss(np.array([a, b])) for a in np.linspace(0, 3, 121) for b in np.linspace(-2, 2, 121))
    assert loss(w) <= best + 1e-2


def test_crf_labels_switching_text(spark, odd, none):
    left, right = ("alpha", "beta", "gamma"), ("sol", "luna", "mar")
    texts = [" ".join(random.Random(k).choices(left if k % 2 else right, k=60)) for k in range(60)]
    field = crf_language.train(pa.array(texts), ["x" if k % 2 else "y" for k in range(60)], rounds=60)
    best, share = field.predict(pa.array([" ".join(["alpha beta"] * 20 + ["luna mar"] * 5), "sol luna", None, "123 ---", ""]))
    assert [field.languages[b] if b >= 0 else "und" for b in best] == ["x", "y", "und", "und", "und"]
    assert 0.7 < share[0] < 0.9 and share[2] == 0
    got = {r.doc_id: r for r in crf_language.identify(odd.where("doc_id IS NOT NULL"), field).collect()}
    assert got[4].lang_pred == got[6].lang_pred == "und" and got[8].lang_pred in ("x", "y")
    assert crf_language.identify(none, crf_language.fit(none)).count() == 0


def test_crf_learns_every_language(spark):
    rows = [(100 * k + j, " ".join(random.Random(100 * k + j).choices([f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("ra", "mo", "ti")], k=30)), f"l{k:02}") for k in range(70) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = crf_language.fit(docs, fit_total=140)
    got = crf_language.identify(docs, field).collect()
    assert len(field.languages) == 70 and np.mean([r.lang == r.lang_pred for r in got]) > 0.9


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    score, move = rng.normal(size=(5, 3)).astype(np.float32), rng.normal(size=(3, 3))
    field = crf_language.Field(["a", "b", "c"], np.zeros(0, np.uint64), np.zeros((1, 3)), move)
    want = np.zeros(3)
    total = 0.0
    for code in range(3**5):
        p = [code // 3**t % 3 for t in range(5)]
        w = np.exp(sum(score[t, p[t]] for t in range(5)) + sum(move[p[t], p[t + 1]] for t in range(4)))
        total += w
        for t in p:
            want[t] += w
    assert np.allclose(field.marginal_sums(score, np.array([5]))[0], want / total, atol=1e-3)


# ---- 2: URLs ----


def test_urls(spark):
    urls = ["http://A.Example.org/es/1", "https://example.org/en/12?x", "http://example.org/fr", "http://x.com/de/", "http://com/fr/a", "http://notexample.orgs/es/", "bad", None, "", "http://org", "https://org/#a", "http://u.com?/de/"]
    got = [tuple(r) for r in url_filter.url_filter(spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls * 2)], "page_id int, url string, host string, verdict string"), URL_RULES).orderBy("page_id").select("rule", "verdict").collect()]
    assert got[:12] == got[12:]
    assert got[:12] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"), (None, "allow")]
    many = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "example.org/es/x"), (2, "http://" + "." * 50_000 + "com/de/"), (3, "http://org./")], "page_id int, url string")
    assert [r.rule for r in url_filter.url_filter(many, URL_RULES).orderBy("page_id").collect()] == ["example.org/es/", "com/de/", None]
    pages = spark.createDataFrame([], "page_id int, url string")
    assert url_filter.url_filter(pages, URL_RULES).count() == 0
    assert url_filter.url_filter(spark.createDataFrame([(1, "http://a/b")], "page_id int, url string"), []).first().verdict == "allow"


# ---- 4: packing ----


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    r = random.Random(4)
    atoms = ["'", "s", "ll", "re", " ", "  ", "\n", "a", "É", "9", "!", "'s", "　", "\u0085", "日本", "😀", "''", "x"]
    texts = ["".join(r.choice(atoms) for _ in range(r.randint(0, 30))) for _ in range(800)] + ["", words(5, 3000)]
    pair = ["a"]
    while len(pair[0]) < 2048:  # a word and its swapped twin, which polynomial hashes modulo 2**64 can't tell apart
        pair = [pair[0] + pair[0].translate({97: 98, 98: 97})]
    texts += [pair[0], pair[0].translate({97: 98, 98: 97}), pair[0][:1024] + " x", " " + pair[0][1024:]]
    data, off = packing.T.flat(pa.array(texts))
    coder = packing.Encoder(vocabulary())
    for i, j in packing.T.slices(off, 4000):
        ids, ptr = coder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], 0)
        for k in range(j - i):
            assert ids[ptr[k] : ptr[k + 1]].tolist() == [*plain.encode(texts[i + k], add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_rank_once(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(r.lognormal(3.5, 1, 500 + 400 * seed).astype(int) + 1, 256)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    runs, n = packing.plan(histogram, 256)
    used = {}
    for length, first, count, seq, at in runs.tolist():
        for k in range(count):
            used.setdefault(seq + k, []).append((at, length))
    assert sorted(x for v in used.values() for _, x in v) == sorted(lengths)
    for pieces in used.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end = at + length
        assert end <= 256
    assert len(used) == n and n == -(-int(lengths.sum()) // 256)


def test_pack_documents(spark, odd, none):
    got = packing.pack_documents(odd, vocabulary()).toPandas()
    assert got.sequence_id.nunique() == -(-int(got.length.sum()) // 2048) and (got.length <= 2048).all() and len(got[got.doc_id == 2]) == 2
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all()
    seven = got[got.doc_id == 7].sort_values("piece")
    assert (seven.start == seven.length.cumsum() - seven.length).all() and (seven.length[1:] == 2048).all()
    assert got[got.doc_id == 5].length.tolist() == [1] and got[got.doc_id == 4].ids_crc32.tolist() == [zlib.crc32(b"\0\0\0\0")]
    assert packing.pack_documents(none, vocabulary()).count() == 0


# ---- 5: repeats ----


def repeats_by_force(docs, width=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(w)
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("crowd", [4000, 1])
def test_repeats(spark, crowd):
    r = random.Random(9)
    blocks = [words(k, 30) for k in range(12)] + ["the " * 60, "ab" * 90, "é" * 80]
    docs = [(k, " ".join(r.choice(blocks)[r.randint(0, 40) :] for _ in range(r.randint(0, 6)))) for k in range(60)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), crowd=crowd).collect()
    want = repeats_by_force(docs)
    assert {x.doc_id: bytes(x.kept) for x in got} == want
    assert all(x.n_removed == x.n_bytes - len(x.kept) == sum(s.end - s.start for s in x.spans) for x in got)


def test_repeats_of_crowds(spark):
    r = random.Random(12)
    lines = ["the " * 40, "-" * 150, words(50, 14), words(51, 16)]
    docs = [(k, words(1000 + k, r.randint(0, 6)) + r.choice(lines)[r.randint(0, 60) :] + r.choice(lines)[: r.randint(60, 160)] + words(2000 + k, r.randint(0, 6))) for k in range(120)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), crowd=25).collect()
    assert {x.doc_id: bytes(x.kept) for x in got} == repeats_by_force(docs)


def test_repeats_odd_rows(spark, odd, none):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == 13 and suffix_dedup.remove_repeats(none).count() == 0
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert by[1][0].n_removed == 0 and [x.n_removed for x in by[2]] == [by[2][0].n_bytes] * 2
    assert by[4][0].n_bytes == by[5][0].n_bytes == 0 and by[9][0].n_removed == 150 and by[10][0].n_removed > 400


def test_parts_of_a_long_text_have_its_anchors():
    texts = [words(5, 3000), "", "short", words(6, 60) + "ab" * 400 + words(7, 300), "x" * 5000]
    data, off = suffix_dedup.T.flat(pa.array(texts))
    found = [np.concatenate(x) for limit in (1 << 20, 700) for x in [list(zip(*suffix_dedup.anchored(data, off, limit=limit), strict=True))] for x in x]
    whole, parts = found[:6], found[6:]
    for a, b in zip(whole, parts, strict=True):
        assert (a[np.lexsort((whole[1], whole[0]))] == b[np.lexsort((parts[1], parts[0]))]).all()


def test_repeats_in_one_text_of_20_mb(spark):
    block = words(8, 200_000)
    text = block + " " + words(9, 2_000_000)[: 20_000_000 - 2 * len(block)] + " " + block
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_bytes", "n_removed").first()
    assert got.n_bytes == len(text) and got.n_removed >= len(block)


def test_texts_of_one_id_are_told_apart(spark):
    shared = words(31, 40)
    docs = [(7, shared + words(32, 40)), (7, words(33, 40) + shared), (None, words(34, 40) + shared), (None, words(35, 40))]
    got = sorted((x.doc_id is None, x.n_removed) for x in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    n = len(shared)
    assert [a for a, _ in got] == [False, False, True, True] and [n <= x < n + 12 or x == 0 for _, x in got] == [True] * 4 and sum(x > 0 for _, x in got) == 2


@pytest.mark.parametrize("crowd", [4000, 1])
def test_repeat_groups_name_all_members(spark, crowd):
    shared = words(77, 30)
    docs = [(k, f"{words(100 + k // 2, 20)} {shared} {words(200 + k // 2, 20)}") for k in range(8)]
    got = suffix_dedup.repeat_groups(spark.createDataFrame(docs, "doc_id long, text string"), crowd=crowd).toPandas()
    assert (got.length >= 100).all() and (got.groupby("repeat_id")["first"].sum() == 1).all()
    text = dict(docs)
    for _, g in got.groupby("repeat_id"):
        assert len({text[d][s : s + n] for d, s, n in zip(g.doc, g.start, g.length, strict=True)}) == 1 and g.loc[g["first"], "doc"].item() == g.doc.min()
    assert (got.groupby("repeat_id").doc.nunique() == 8).any() or crowd == 1
    assert set(got.doc) == set(text) and (got.groupby("repeat_id").doc.nunique() == 2).any()


# ---- 6: embeddings ----


def test_cosine_links(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(6, 16))
    x = np.concatenate([c + 0.12 * r.normal(size=(40, 16)) for c in centre] + [r.normal(size=(60, 16))]).astype(np.float32)
    rows = [(int(k), v.tolist(), 0, "x") for k, v in enumerate(x)] + [(1000, x[0].tolist(), 1, "x"), (1001, None, 1, "x"), (1002, [0.0] * 16, 1, "x"), (1003, [float("nan")] + [1.0] * 15, 1, "x"), (1004, [None] + [1.0] * 15, 1, "x"), (1005, [1.0, 2.0], 1, "x"), (None, x[1].tolist(), 1, "x"), (1006, [], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: r for r in ego_join.cosine_links(df).collect()}
    ids = [k for k in range(len(x))] + [1000]
    y = np.concatenate([x, x[:1]]).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    assert [got[i].n_links for i in ids] == (near.sum(1) - 1).tolist()
    root = list(range(len(ids)))
    for _ in ids:
        root = [min(root[j] for j in np.flatnonzero(near[k])) for k in range(len(ids))]
    assert [got[i].component_id for i in ids] == [ids[k] for k in root]
    assert all(got[i].n_links == 0 and got[i].kept for i in (1001, 1002, 1003, 1004, 1005, 1006)) and got[None].n_links == 0
    assert ego_join.cosine_links(df.where("false")).count() == 0


def test_cosine_links_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BLOCK", 16)
    monkeypatch.setattr(ego_join, "FIT", 40)
    r = np.random.default_rng(15)
    x = np.concatenate([c + 0.05 * r.normal(size=(10, 4)) for c in r.normal(size=(40, 4))]).astype(np.float32)
    got = {v.vec_id: v for v in ego_join.cosine_links(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    assert [got[k].n_links for k in range(len(x))] == (near.sum(1) - 1).tolist()
    root = np.arange(len(x))
    for _ in root:
        root = np.array([root[np.flatnonzero(near[k])].min() for k in range(len(x))])
    assert [got[k].component_id for k in range(len(x))] == root.tolist()


def test_tiles_skip_and_recurse(monkeypatch, spark):
    monkeypatch.setattr(ego_join, "LEAF", 8)
    r = np.random.default_rng(6)
    x = r.normal(size=(150, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    many = np.ones(150, np.int64)
    la, _, _ = ego_join.join_sequences(x, None, many, many, x, x, 0.95)
    assert (la == (x @ x.T >= 0.95).sum(1) - 1).all()
    la, lb, _ = ego_join.join_sequences(x[:60], x[60:], many[:60], many[60:], x[:60], x[60:], 0.95)
    near = x[:60] @ x[60:].T >= 0.95
    assert (la == near.sum(1)).all() and (lb == near.sum(0)).all()


# ---- 7: fingerprints ----


def test_walks_match_a_plain_walk():
    text = words(8, 40) + " é日"
    fp = edit_embedding.embed([text, text, "", "x"] + [words(k, 30) for k in range(40)])
    assert fp[0] == fp[1] != fp[3] and fp[2] == "00000000:"
    assert edit_embedding.embed([text])[0] == fp[0]  # alone it takes the other way of walking
    assert edit_embedding.likeness_of(fp[0], fp[0]) == 1 and edit_embedding.likeness_of(fp[0], fp[2]) == 0
    edited = text[:100] + "QQ" + text[100:]
    assert edit_embedding.likeness_of(fp[0], edit_embedding.embed([edited])[0]) > 0.5 > 0.2 > edit_embedding.likeness_of(fp[0], fp[5])


def test_next_edited(spark, odd, none, monkeypatch):
    monkeypatch.setattr(edit_embedding, "GROUP", 7)
    docs = [(k, words(k, k % 9)) for k in range(40)] + [(50, None)]
    got = {r.doc_id: r for r in edit_embedding.next_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs, reverse=True, key=lambda x: x[0])
    for k, (i, t) in enumerate(order):
        t, o = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + o[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
    monkeypatch.setattr(edit_embedding, "GROUP_BYTES", 300)  # ranges are divided until they are small or one id
    again = {r.doc_id: r for r in edit_embedding.next_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert again == got
    assert edit_embedding.next_edited(odd).count() == 13 and edit_embedding.next_edited(none).count() == 0


def test_near_pairs(spark, odd, none):
    base = words(11, 300)
    docs = [(1, base), (2, base), (3, base[:700] + "X" + base[700:]), (4, words(12, 300))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [(r.src, r.dst) for r in edit_embedding.near_pairs(df, 0.7).collect()] == [(1, 3)]
    assert sorted((r.doc_id, r.representative) for r in edit_embedding.fingerprint_classes(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert all(r.src < r.dst and r.likeness >= 0.8 for r in edit_embedding.near_pairs(odd).collect())
    assert edit_embedding.near_pairs(none).count() == 0 and edit_embedding.fingerprint_classes(odd).count() == 13


def test_near_pairs_against_all_pairs(spark):
    r = random.Random(21)
    docs = []
    for k in range(60):
        base = words(500 + k, 60)
        docs.append((3 * k, base))
        for j in (1, 2):
            at = r.randrange(len(base))
            docs.append((3 * k + j, base[:at] + "Q" * j + base[at + 1 :]))
    least = {}
    for (i, _), fp in zip(docs, edit_embedding.embed([t for _, t in docs]), strict=True):
        least.setdefault(fp, i)
    prints = {i: fp for fp, i in least.items()}
    want = {(i, j) for i in prints for j in prints if i < j and edit_embedding.likeness_of(prints[i], prints[j]) >= 0.8}
    got = {(x.src, x.dst) for x in edit_embedding.near_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 60


# ---- 8: mixing ----


def test_mixing_meets_targets(spark):
    r = random.Random(3)
    docs = [(k, words(k, r.randint(1, 400)), r.choice(["b", "a", None, "c", "é"])) for k in range(600)] + [(1000, words(1, 500), "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).toPandas()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    assert all(sizes[i] == s for i, s in zip(got.doc_id, got["size"], strict=True))
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6 and (per.target <= 2 * per["size"] + 1e-9).all()
    big = per[per["size"] > 5000]
    assert (abs(big.taken - big.target) <= 0.01 * big.target).all() and (got.taken <= 2 * got["size"]).all()
    again = mixing.mix_sources(df.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_targets_reshare_the_excess(spark):
    df = spark.createDataFrame([("a", 100), ("b", 100), (None, 100)], "source string, source_size long")
    assert mixing.source_targets(df) == [("a", 100, 200.0), ("b", 100, pytest.approx(250 / 3)), (None, 100, pytest.approx(500 / 3))]


def test_mixing_odd_rows(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 13 and all(r["size"] == 0 for r in got if r.doc_id in (4, 5, 6)) and mixing.mix_sources(none).count() == 0


# ---- 9: SimHash ----


def simhash_by_force(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash_groups(spark, odd, none):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == 13 and simhash.simhash_groups(none).count() == 0
    text = {r.doc_id: r.text for r in odd.collect()}
    assert all(r.fingerprint == f"{simhash_by_force(text[r.doc_id]):016x}" for r in got if r.doc_id is not None)
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == 1 and by[4] == by[5] == by[6] == 4


@pytest.mark.parametrize(("distance", "paired"), [(2, 32), (2, 1), (5, 32), (5, 1)])
def test_links_equal_brute_force(spark, monkeypatch, distance, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    r = random.Random(7)
    prints = {r.getrandbits(64) for _ in range(60)}
    for x in list(prints):
        y = x
        for _ in range(r.randint(0, 7)):
            y ^= 1 << r.randrange(64)
            prints.add(y)
    ids = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in ids]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance).collect()

    def components(pairs):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in signed}

    near = [(signed[i], signed[j]) for i in range(len(ids)) for j in range(i) if (ids[i] ^ ids[j]).bit_count() <= distance]
    assert components([(e.src, e.dst) for e in edges]) == components(near)


def test_dedupe_keeps_one(spark, odd, none):
    got = [r.doc_id for r in simhash.dedupe(odd).select("doc_id").collect()]
    # 2 repeats 1, 3 has but one more word, 5 and 6 are blank as 4 is, 9 begins as 1 does but is too short to be alike
    assert sorted(i for i in got if i is not None) == [1, 4, 7, 8, 9, 10]
    assert got.count(None) == 2 and simhash.dedupe(none).count() == 0
