"""Manifest, mixing and whitening against brute force, with nulls, ties, hot groups, long texts and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import merkle, mixing, whitening

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, place int, block string, rank int, size int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], DOCS)


def leaves(spark, rows):
    return docs(spark, rows).select("doc_id", "source", merkle.digest([F.col(c) for c in merkle.FIELDS]).alias("leaf"))


@pytest.fixture(scope="module")
def rows():
    """A hot source, a lone leaf, sources of 16 and 17 rows, null sources and ids, repeated rows, a long text."""
    out = [(i, "hot", "en", 5, f"Text {i} ABC" + " More" * (i % 7)) for i in range(300)]
    out += [(1000 + i, "s16", None, i, f"Word{i}") for i in range(16)] + [(2000 + i, "s17", "de", None, f"W ort{i}") for i in range(17)]
    out += [(3000, "alone", "en", 1, "Only ONE"), (None, "nulls", None, None, None), (None, "nulls", None, None, "With TEXT"), (4001, None, "fr", 0, "")]
    out += [(4002, None, "fr", 2, "ÄÖ Ü Z"), (5000, "twice", "en", 3, "Same ROW"), (5000, "twice", "en", 3, "Same ROW"), (5000, "twice", "en", 3, "other")]
    out += [(6000, "", "en", 9, "A" * 200_000 + " b"), (6001, "zz", "en", 9, "  \t\n ")]
    return out + [(7000 + i, f"many{i:03d}", "en", 1, f"Doc {i}") for i in range(40)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, source, lang, n_chars, text = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def folded(levels, place, start):
    """Siblings on the way up and the node reached from ``start`` in the place of the own one."""
    siblings, node = [], start
    for level in levels[:-1]:
        first = place - place % 16
        left, right = level[first:place], level[place + 1:first + 16]
        siblings += left + right
        node, place = sha("".join(left) + node + "".join(right)), place // 16
    return siblings, node


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], leaf_of(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
        trees.append(levels_of([e[1] for e in groups[name]]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for i, name in enumerate(names):
        for j, (doc_id, leaf, row) in enumerate(groups[name]):
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and row[4] is not None
            text = re.sub("[A-Z]+", lambda m: m[0].lower(), row[4]) if hit else row[4]
            siblings, node = folded(trees[i], j, leaf_of((*row[:4], text)))
            more, node = folded(top, i, node)
            out.append((doc_id, leaf, trees[i][-1][0], top[-1][0], sha("".join(siblings + more)), node, node == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("block", [1, 7, 64, merkle.BLOCK])
def test_manifest_and_proofs_equal_a_tree_built_by_hand(spark, rows, block):
    got = merkle.audit(docs(spark, rows).repartition(5), block=block)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = Counter(map(tuple, got.collect()))
    assert got == brute_manifest(rows)
    assert len({k[6] for k in got}) == 2


def test_blocks_fetch_only_what_they_cannot_derive(spark, rows):
    manifest = merkle.build(leaves(spark, rows), "source", "doc_id", block=50)
    got = defaultdict(set)
    for r in merkle.missing(manifest.spans).collect():
        assert (r["tree"], r["level"], r["place"]) not in got[r["block"]]
        got[r["block"]].add((r["tree"], r["level"], r["place"]))
    width = {(r["tree"], r["level"]): r["width"] for r in manifest.nodes.select("tree", "level", "width").distinct().collect()}
    have = defaultdict(set)
    for r in manifest.leaves.collect():
        have[r["block"]].add((r["tree"], r["place"]))
    for block, own in have.items():
        known, needed = {(t, 0, p) for t, p in own}, set()
        queue = sorted(known)
        while queue:
            t, k, p = queue.pop()
            if width[t, k] == 1:
                up = (merkle.TOP, 0, t) if t != merkle.TOP else None
            else:
                needed |= {(t, k, s) for s in range(p - p % 16, min(p - p % 16 + 16, width[t, k]))}
                up = (t, k + 1, p // 16)
            if up and up not in known:
                known.add(up)
                queue.append(up)
        assert got[block] == needed - known


def test_a_proof_fails_for_another_leaf_and_for_another_order(spark, rows):
    manifest = merkle.build(leaves(spark, rows), "source", "doc_id")
    proven = merkle.multiproof(manifest).cache()
    assert proven.where(merkle.fold("leaf", "proof") != manifest.root).count() == 0 and proven.where("top <> subroot").count() > 0
    assert {r[0] for r in proven.select("top").distinct().collect()} == {manifest.root}
    other = proven.selectExpr("sha2(leaf, 256) AS leaf", "proof")
    assert other.where(merkle.fold("leaf", "proof") == manifest.root).count() == 0


def test_manifest_of_nothing_and_of_one_row(spark):
    assert merkle.audit(docs(spark, [])).collect() == []
    one = (9, None, None, None, None)
    r = merkle.audit(docs(spark, [one])).collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == leaf_of(one) and r["verified"]
    assert r["proof_sha256"] == sha("")


# ---- mixing --------------------------------------------------------------------------------------

def brute_targets(sizes, weights, most=3):
    """Share by weight, stop those above, share again: plain floats."""
    open_, target, rest = set(sizes), {}, sum(sizes.values())
    while True:
        total = sum(weights[s] for s in open_)
        above = {s for s in open_ if rest * weights[s] / total > most * sizes[s]} if total else set()
        if not above:
            return target | {s: rest * weights[s] / total for s in open_}
        for s in above:
            target[s] = float(most * sizes[s])
        open_ -= above
        rest = sum(sizes.values()) - sum(target.values())


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed(spark, rows, **how):
    df = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id bigint, source string, text string, size int")
    return mixing.mix(df, **how)


def check_mix(rows, got):
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, word_count(t)) for i, s, t in rows)
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(word_count(t) for _, q, t in rows if q == s) for s in names}
    want, taken = brute_targets(sizes, weights), Counter()
    largest = {s: max(word_count(t) for _, q, t in rows if q == s) for s in names}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["copies"] <= 3
        if sizes[r["source"]]:
            assert abs(r["copies"] - r["target"] / r["source_size"]) < 1 + 1e-9
        taken[r["source"]] += r["copies"] * r["size"]
    return {s: (taken[s], want[s], largest[s]) for s in names}


def mixture_rows():
    rng = np.random.default_rng(3)
    rows = []
    for k, (name, n) in enumerate((("a", 3000), ("b", 40), ("c", 700), ("d", 5), (None, 90), ("é", 300), ("Z", 1))):
        rows += [(10_000 * k + i, name, "w " * int(rng.lognormal(3, 1.5))) for i in range(n)]
    rows += [(99, "a", None), (99, "a", ""), (99, "a", "w\tw\x0bw\x1cw ü"), (None, "a", "one two"), (None, "a", "one two"), (7, "empty", " \n")]
    return rows + [(5, "c", "x " * 30_000)] + [(77, "b", "same text here")] * 50


def test_mix_meets_its_targets_and_reruns_agree(spark):
    rows = mixture_rows()
    first = mixed(spark, rows, chunk=64, keep=8).collect()
    for taken, want, largest in check_mix(rows, first).values():
        assert abs(taken - want) <= max(4, 0.02 * want, largest)  # runs of 64 hold too little to offset the giant of "c"
    again = mixed(spark, rows[::-1], chunk=64, keep=8).repartition(3).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    default = mixed(spark, rows).collect()
    for taken, want, _ in check_mix(rows, default).values():
        assert abs(taken - want) <= max(4, 0.01 * want)


def test_expected_copies_are_the_rates():
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 400, 60).astype(float))[::-1].copy()
    key = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    total, start = np.zeros(60), np.where(np.arange(60) % 2, 0.3, 0.65)
    for salt in range(3000):
        p = start.copy()
        mixing.settle(p, size, key, salt << 14, 1.5)
        mixing.pair_off(p, size, key, (salt << 14) + (1 << 12), 32)
        assert p @ size == pytest.approx(start @ size, rel=1e-9) and len(np.flatnonzero((p > 0) & (p < 1))) <= 32
        mixing.settle(p, size, key, (salt << 14) + (1 << 13))
        assert set(p) <= {0.0, 1.0} and abs(p @ size - start @ size) <= 400
        total += p
    assert np.abs(total / 3000 - start).max() < 5 * np.sqrt(0.25 / 3000)


def test_mix_of_nothing_and_of_texts_without_words(spark):
    assert mixed(spark, []).collect() == []
    got = mixed(spark, [(1, "a", None), (2, None, " "), (None, None, "")]).collect()
    assert [(r["size"], r["source_size"], r["target"]) for r in got] == [(0, 0, 0.0)] * 3


# ---- whitening -----------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, x string, component int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTORS)


def brute_whitening(rows, wanted):
    kept = [(i, [int(np.floor(256.0 * np.float64(np.float32(c)))) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=object)
    v = (y.T.dot(y) / (n * n * n)).astype(float)
    values, basis = np.linalg.eigh(v)
    return kept, n, sums, values[::-1][:wanted], basis[:, ::-1][:, :wanted], np.trace(v)


def check_whitening(rows, got, wanted=4, rel=1e-9):
    kept, n, sums, values, basis, trace = brute_whitening(rows, wanted)
    assert len(got) == len(kept) * wanted
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, c + 1) for i, _ in kept for c in range(wanted))
    y = np.array([[n * c - s for c, s in zip(x, sums)] for _, x in kept], dtype=object)
    want = (y / n).astype(float) @ basis / np.sqrt(values)
    by_place = defaultdict(list)
    for r in got:
        by_place[r["vec_id"], r["component"]].append(r)
    for c in range(wanted):
        mine = np.array([by_place[i, c + 1][0]["whitened"] for i, _ in kept])
        sign = np.sign(mine @ want[:, c])
        assert np.abs(mine * sign - want[:, c]).max() < rel * 100
    for (i, _), row in zip(kept, y, strict=True):
        r = by_place[i, 1][0]
        assert r["n"] == n and int(r["deviation"]) == sum(int(v) ** 2 for v in row)
    for c in range(wanted):
        assert got and by_place[kept[0][0], c + 1][0]["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-8


def sample(n, d, seed, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(2, 0.2, d) + offset
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_whitening_equals_a_dense_decomposition(spark):
    rows = sample(400, 12, 1) + [(5000 + i, [0.25] * 12) for i in range(200)]  # a third of the rows is one vector
    bad = [(9001, None), (9002, [None] + [1.0] * 11), (9003, [float("nan")] * 12), (9004, [float("inf")] + [0.0] * 11), (9005, []), (9006, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows + bad).repartition(6)).collect()
    check_whitening(rows, got)
    again = whitening.whiten(vectors(spark, bad + rows[::-1]).repartition(2)).collect()
    assert Counter((r[0], r[1], r[3]) for r in got) == Counter((r[0], r[1], r[3]) for r in again)
    one, two = (sorted((r["vec_id"], r["component"], r["whitened"]) for r in rows_) for rows_ in (got, again))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-12 for a, b in zip(one, two, strict=True))


def test_whitening_far_from_the_origin_stays_exact(spark):
    # entries of 2.5 million units: products and their sums pass the exact range of doubles
    check_whitening(rows := sample(300, 6, 2, offset=10_000.0), whitening.whiten(vectors(spark, rows)).collect(), rel=1e-7)


def test_whitening_over_many_intervals(spark):
    rows = sample(500, 40, 4)
    check_whitening(rows, whitening.whiten(vectors(spark, rows), wanted=36).collect(), wanted=36, rel=1e-8)


def test_whitening_without_variance_and_of_nothing(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect() == []
    flat = [(i, [float(i), float(2 * i), 3.0]) for i in range(20)] + [(None, [3.0, 6.0, 3.0])]
    got = whitening.whiten(vectors(spark, flat)).collect()  # rank one: one component
    assert len(got) == 21 and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    assert sum(r["whitened"] ** 2 for r in got if r["vec_id"] is not None) / 20 == pytest.approx(1)


def test_inertia_and_contour_agree_with_dense_eigenvalues():
    rng = np.random.default_rng(8)
    for spectrum in (np.arange(20.0), np.array([5.0] * 6 + [1.0] * 4 + [0.0] * 10), 10.0 ** -np.arange(20), np.array([3, 3, 3, 2.9999999] + [1.0] * 16)):
        q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
        a = (q * spectrum) @ q.T
        a = (a + a.T) / 2
        true = np.linalg.eigvalsh(a)[::-1]
        for shift in (-1.0, 0.5, 1.5, 2.95, 4.2, 30.0):
            assert whitening.above(a, shift) == (true > shift).sum()
        cuts = whitening.intervals(a, 4)
        found = np.concatenate([whitening.feast(a, *cut)[0] for cut in cuts])
        assert len(found) >= 4 and np.abs(found[:4] - true[:4]).max() < 1e-13 * max(1, true[0])
        values, vectors_ = whitening.feast(a, *cuts[0])
        assert np.abs(vectors_.T @ vectors_ - np.eye(len(values))).max() < 1e-12


def test_inertia_of_indefinite_matrices_with_zero_diagonal():
    rng = np.random.default_rng(9)
    for d in (1, 2, 3, 8, 25):
        for _ in range(20):
            a = rng.standard_normal((d, d)) * (rng.random((d, d)) < 0.6)
            a = a + a.T
            np.fill_diagonal(a, 0)
            true = np.linalg.eigvalsh(a)
            if np.abs(true).min() > 1e-9:
                assert whitening.above(a, 0.0) == (true > 0).sum()
