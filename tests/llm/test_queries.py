"""The registered queries that SQL can't express, on the smallest tables against plain versions or by held-out accuracy."""

import hashlib
import math
import re
import zlib

import pytest
import xxhash

from loomgraph.llm.queries import QUERIES, vocabulary

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
M = (1 << 64) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def held_out(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("query", "label", "modulus", "fold", "least"), [("op1_toxicity", "toxic", 4, 2, 0.75), ("op10_quality", "quality", 5, 0, 0.97)])
def test_scores_of_held_out_documents(spark, query, label, modulus, fold, least):
    got = QUERIES[query](spark, LARGER).collect()
    assert len(got) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r.held_out == (held_out(r.doc_id, modulus) == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert auc([(r.score, truth[r.doc_id] == 1) for r in got if r.held_out and r.doc_id in truth]) >= least


def test_languages_of_held_out_documents(spark):
    got = QUERIES["op3_language"](spark, LARGER).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert len(got) == len(truth) and all(r.held_out == (held_out(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id][1] or "")) for r in got)
    right = [r.lang_pred == truth[r.doc_id][0] for r in got if r.held_out and truth[r.doc_id][0] and r.lang_pred != "und"]
    assert sum(right) >= 0.97 * len(right)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    got = QUERIES["op4_packing"](spark, SF).toPandas()
    whole = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    for i, g in got.sort_values("piece").groupby("doc_id"):
        assert g.piece.tolist() == list(range(len(g))) and g.length.sum() == len(whole[i]) and (g.length.iloc[1:] == 2048).all() and (len(g) == 1) == (len(whole[i]) <= 2048)
        for start, n, crc in zip(g.start, g.length, g.ids_crc32, strict=True):
            assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in whole[i][start : start + n]))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert set(got.doc_id) == set(whole) and got.sequence_id.nunique() == -(-sum(map(len, whole.values())) // 2048)


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def plain_walk(text):
    """The sampled symbols of a text, one step at a time."""
    n, code = len(text), [ord(c) for c in text] + [0, 0, 0]
    h = [mix(c + 1) for c in code]
    emitted, p = [], 0
    for j in range(3 * n):
        third = 0 if code[p + 1] == 0 else h[p + 2]
        emitted.append(mix(h[p] * 3 + h[p + 1] * 5 + third * 7 & M) % 255 + 1 if p < n else 0)
        if p < n:
            p += mix((j // 64 << 8) + h[p] % 255 + 0x5851F42D4C957F2D & M) >> j % 64 & 1
    order = sorted(range(3 * n), key=lambda j: mix(j * 0xA0761D6478BD642F + 0x1D8E4E27C47D124F & M))
    return {j: emitted[j] for j in order[:128]}, n


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (x, n), (y, m) = sorted((a, b), key=lambda v: v[1])
    told = [(y[j], x.get(j, 0) if j < 3 * n else 0) for j in y]
    told = [t for t in told if t != (0, 0)]
    return sum(p == q for p, q in told) / len(told) if n else 0.0


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, SF).collect()}
    rows = sorted(zip(docs.doc_id, docs.text, strict=True), reverse=True)
    assert set(got) == set(docs.doc_id)
    for k, (i, text) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(text) < 1500 and len(other) < 4000:
            walks = [plain_walk(x) for x in (text, edited, other)]
            assert r.fingerprint == f"{len(text):08x}:" + bytes(walks[0][0].values()).hex() and r.edited_fingerprint == f"{len(edited):08x}:" + bytes(walks[1][0].values()).hex()
            assert r.near_edited == pytest.approx(plain_likeness(*walks[:2])) and r.near_next == pytest.approx(plain_likeness(walks[0], walks[2]))
            assert text == other or r.near_edited > r.near_next
    assert sum(len(t or "") < 1500 for _, t in rows) > 30


def test_mixing(spark, docs):
    got = QUERIES["op8_mixing"](spark, SF).toPandas()
    docs = docs.assign(size=[len(WORD.findall(t or "")) for t in docs.text])
    assert dict(zip(got.doc_id, got["size"], strict=True)) == dict(zip(docs.doc_id, docs["size"], strict=True))
    sizes = docs.groupby("source", dropna=False)["size"].sum()
    sources = sorted((s for s in sizes.index if isinstance(s, str)), key=lambda s: s.encode()) + [s for s in sizes.index if not isinstance(s, str)]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total = {s: int(sizes[s]) if isinstance(s, str) else int(docs[docs.source.isna()]["size"].sum()) for s in sources}
    target, left, free = {}, 1.5 * sum(total.values()), set(sources)
    while free:
        each = left / sum(weight[s] for s in free)
        full = {s for s in free if each * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] if full else each * weight[s] for s in full or free}
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    for s in sources:
        mine = got[got.source == s] if isinstance(s, str) else got[got.source.isna()]
        assert (mine.source_size == total[s]).all() and mine.target.to_numpy() == pytest.approx(target[s])
        # the dual by bisection
        x = (mine["size"] / mine["size"].mean()).tolist()
        rates = lambda lam: [min(2.0, math.exp(min(lam * v, 50))) for v in x]  # noqa: B023, E731
        lo, hi = -1e4, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(a * b for a, b in zip(rates(mid), mine["size"], strict=True)) < target[s] else (lo, mid)
        if target[s] < 2 * total[s] * (1 - 1e-9):
            wanted = [r for r, n in zip(rates(hi), mine["size"], strict=True) if n]
            assert mine.rate[mine["size"] > 0].to_numpy() == pytest.approx(wanted, rel=1e-3)
        assert (mine.taken == mine.copies * mine["size"]).all() and mine.copies.between(0, 2).all()
        assert abs(mine.taken.sum() - target[s]) <= max(0.01 * target[s], mine["size"].max() / 2 + 1)


def test_simhash(spark):
    got = QUERIES["op9_simhash"](spark, LARGER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    prints = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        ones = [0] * 64
        for h in grams:
            for b in range(64):
                ones[b] += h >> b & 1
        prints[i] = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{x:016x}" for i, x in prints.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in ids}
