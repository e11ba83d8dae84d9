"""Product codes, clusters and token files against brute force, on small fixtures with nulls, ties, repeats and clashes."""

import hashlib
import importlib.util
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from nightloom.llm import arrow_files, centroids, vector_blocks, vector_codes
from nightloom.llm.queries import TOKENIZER

VECTORS = "vec_id long, embedding array<float>, label int, _id string, _x int, ids string, n int"


def vectors(spark, rows):
    """Vectors with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, v, label, "a", 1, "b", 2) for i, v, label in rows], VECTORS)


def some_vectors(n=400, dims=64, seed=1, groups=9, scale=1.0):
    rng = np.random.default_rng(seed)
    mid = rng.normal(0, scale, (groups, dims))
    rows = [(int(i), [float(np.float32(x)) for x in mid[g] + rng.normal(0, scale / 3, dims)], int(g) if g else None) for i, g in enumerate(rng.integers(0, groups, n))]
    v = rows[0][1]
    odd = [(5, rows[5][1], 3), (5, rows[6][1], 3), (None, rows[7][1], 1), (n + 1, None, 2), (n + 2, [], 2), (n + 3, v[:-1], 2), (n + 4, [*v[:-1], None], 2), (n + 5, [*v[:-1], math.nan], 2), (n + 6, [*v[:-1], math.inf], 2)]
    return rows + odd + [(n + 7 + i, rows[i][1], None) for i in range(20)] + [(n + 50 + i, [0.0] * dims, 1) for i in range(20)]


def ints(rows, dims=64):
    fine = [(i, v, label) for i, v, label in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in fine]


def lloyd(points, centers, rounds):
    """Plain integer Lloyd; (assignment, distances, centers)."""

    def assign():
        best = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centers)) for p in points]
        return [j for _, j in best], [d for d, _ in best]

    for _ in range(rounds):
        own, _d = assign()
        groups = defaultdict(list)
        for p, j in zip(points, own, strict=True):
            groups[j].append(p)
        centers = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centers)]
    return *assign(), centers


@pytest.mark.parametrize(("scale", "entries", "rounds"), [(1.0, 20, 4), (300.0, 7, 2), (1.0, 1, 2)])
def test_product_codes_by_brute_force(spark, scale, entries, rounds):
    rows = some_vectors(200, dims=8, scale=scale)
    own = ints(rows, 8)
    start = [v for i, v, _ in sorted((x for x in own if x[0] is not None), key=lambda x: (x[0], x[1]))][:entries]
    want_code, want_error, books = [[] for _ in own], [0] * len(own), []
    for p in range(4):
        cut = slice(2 * p, 2 * p + 2)
        codes, errors, centers = lloyd([v[cut] for _, v, _ in own], [v[cut] for v in start], rounds)
        books += [x for c in centers for x in c]
        for r, (c, e) in enumerate(zip(codes, errors, strict=True)):
            want_code[r].append(c)
            want_error[r] += e
    by_label = defaultdict(int)
    for (_, _, label), e in zip(own, want_error, strict=True):
        by_label[label] += e
    want = sorted((str(i), "".join(f"{c:02x}" for c in code), e, by_label[label]) for (i, _, label), code, e in zip(own, want_code, want_error, strict=True))
    found = vector_codes.code_digests(vectors(spark, rows).repartition(3), dims=8, parts=4, entries=entries, rounds=rounds).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in found) == want
    assert {r.codebooks_sha256 for r in found} == {hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()}


def test_heaps_pop_only_what_drift_has_reached():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (3000, 8)).astype(np.int32)
    x[1500:] += 1000  # two crowds, entries of both
    books = np.stack([np.concatenate([x[:5, 4 * p : 4 * p + 4], x[1500:1505, 4 * p : 4 * p + 4]]) for p in range(2)]).astype(np.int64)
    codes, heaps = np.zeros((len(x), 2), np.int64), vector_codes.Heaps(20)
    for p in range(2):
        vector_codes.rescan(x, np.arange(len(x)), p, books, np.zeros((2, 10)), codes, heaps)
    size, key, row = heaps.packed()
    assert size.sum() == 2 * len(x) and sorted(row.tolist()) == sorted([*range(len(x))] * 2)
    new = books.copy()
    new[0, 2] += 3  # one entry of one codebook moves a little
    gone = vector_codes.moved(np.zeros((2, 10)), books, new)
    assert (gone[1] == 0).all() and gone[0].min() > 0
    again = vector_codes.Heaps(20, size, key, row)
    popped = [r for e in range(10) for r in again.violated(e, gone[0][e])]
    assert 0 < len(popped) < len(x) / 4
    assert not [r for e in range(10, 20) for r in again.violated(e, gone[1][e - 10]) if e not in again.open]
    stays = np.ones(len(x), bool)
    stays[popped] = False
    exact = vector_blocks.squared(x[:, :4], new[0]).argmin(1)
    assert (codes[stays, 0] == exact[stays]).all()


def test_product_codes_of_empty_tables_and_one_label(spark):
    assert vector_codes.code_digests(vectors(spark, [])).collect() == []
    assert vector_codes.code_digests(vectors(spark, [(1, None, 1), (None, [math.nan] * 64, None)])).count() == 0
    found = vector_codes.code_digests(vectors(spark, some_vectors(30)).drop("label")).collect()
    assert len({r.label_error for r in found}) == 1 and found[0].label_error == sum(r.error for r in found)
    with pytest.raises(Exception, match="beyond"):
        vector_codes.code_digests(vectors(spark, [(1, [1e9] * 64, 1)])).collect()


def test_totals_of_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 50, i) for i in range(900)], "id int, label int, error long")
    want = defaultdict(int)
    for r in rows.collect():
        want[r.label] += r.error
    for share in (4, 10_000, 1):
        found = vector_blocks.with_total(rows, "label", "error", "total", share).collect()
        assert len(found) == 900 and all(r.total == want[r.label] for r in found)


@pytest.mark.parametrize(("scale", "k", "rounds"), [(1.0, 12, 5), (300.0, 40, 3), (1.0, 2, 2), (1.0, 1, 1)])
def test_clusters_by_brute_force(spark, scale, k, rounds):
    rows = some_vectors(250, dims=6, scale=scale)
    own = ints(rows, 6)
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v, _ in own if i is not None)[:k]
    cluster, distance, centers = lloyd([v for _, v, _ in own], [v for _, v in start], rounds)
    by = defaultdict(int)
    for c, d in zip(cluster, distance, strict=True):
        by[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    want = sorted((str(i), c, d, by[c], sum(distance), sha[c]) for (i, _, _), c, d in zip(own, cluster, distance, strict=True))
    found = centroids.cluster_digests(vectors(spark, rows).repartition(3), dims=6, k=k, rounds=rounds).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == want


def test_bounds_certify_and_adapt():
    rng = np.random.default_rng(4)
    centers = rng.integers(-3000, 3000, (40, 16))
    x = (centers[rng.integers(0, 40, 4000)] + rng.integers(-40, 40, (4000, 16))).astype(np.int32)
    bounds = centroids.Bounds.fresh(len(x), 10)
    bounds.measure_all(x, np.arange(len(x)), centers)
    measured = []
    whole = centroids.Bounds.measure_all
    try:
        centroids.Bounds.measure_all = lambda self, x, rows, c: (measured.append(len(rows)), whole(self, x, rows, c))[1]
        for _ in range(6):
            new = centers + rng.integers(-25, 25, centers.shape)
            bounds.shifted(vector_blocks.drift(centers, new))
            centers = new
            bounds.narrowed(max(bounds.settle(x, centers), 5))
            assert (bounds.own == vector_blocks.squared(x, centers).argmin(1)).all()
    finally:
        centroids.Bounds.measure_all = whole
    assert sum(measured) < 4000 and bounds.near.shape[1] == 5
    for _ in range(8):  # wide moves: lists and remainders are passed, the assignment stays exact
        new = centers + rng.integers(-2500, 2500, centers.shape)
        bounds.shifted(vector_blocks.drift(centers, new))
        centers = new
        bounds.settle(x, centers)
        assert (bounds.own == vector_blocks.squared(x, centers).argmin(1)).all()


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 4 - 2) / 2] * 3, i % 2) for i in range(40)]
    own = ints(rows, 3)
    start = [v for _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v, _ in own)[:6]]
    cluster, distance, _ = lloyd([v for _, v, _ in own], start, 3)
    found = centroids.cluster_digests(vectors(spark, rows), dims=3, k=6, rounds=3).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == sorted(zip([i for i, _, _ in own], cluster, distance, strict=True))


def test_clusters_of_empty_tables(spark):
    assert centroids.cluster_digests(vectors(spark, [])).collect() == []
    assert centroids.cluster_digests(vectors(spark, [(1, None, 1)])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    found = centroids.cluster_digests(vectors(spark, [(None, [0.5] * 64, 1), (None, [0.25] * 64, 1)])).collect()
    assert [(r.vec_id, r.cluster) for r in found] == [(None, 0)] * 2


def test_exact_distances_of_large_components():
    rng = np.random.default_rng(5)
    x = rng.integers(-vector_blocks.LARGEST, vector_blocks.LARGEST, (20, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)) for c in x[:4]] for p in x]
    assert vector_blocks.squared(x, x[:4]).tolist() == want


DOCS = "doc_id long, text string, _id string, ids int, start int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


def token_rows():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 5, 60, 300))))) for i in rng.sample(range(1000), 150)]
    return rows + [(2000, None), (2001, ""), (2002, " \n\t "), (None, "null id"), (None, None), (5000, " ".join(rng.choices(words, k=9000))), (rows[0][0], rows[0][1]), (rows[0][0], "other text, same id"), (2003, "a<|endoftext|>b é ü 日本語 'll 12")]


@pytest.mark.skipif(importlib.util.find_spec("tokenizers") is None or importlib.util.find_spec("public_tokenizers") is None, reason="needs the library and its vocabulary")
@pytest.mark.parametrize(("length", "batch", "file_bytes"), [(2048, 256, 64 << 20), (16, 4, 20_000)])
def test_token_files_against_the_library(spark, length, batch, file_bytes):
    import public_tokenizers
    import tokenizers

    rows = token_rows()
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))
    library.no_truncation()
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    docs = documents(spark, rows).repartition(5)
    files = arrow_files.token_files(docs, TOKENIZER, length=length, batch=batch, file_bytes=file_bytes)
    got = arrow_files.digests(files, "bigint").collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(ids[k]) for k in rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
    assert [r.doc_id for r in order[:2]] == [None, None] and order[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(order, order[1:]))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(ids[i, t])) for i, t in rows)
    back = {(str(r.doc_id), r.start): r.ids for r in arrow_files.read_ids(files, "bigint").collect()}
    assert all(crc(back[str(r.doc_id), r.start]) == r.ids_crc32 for r in got)
    found = files.orderBy("start").collect()
    assert sum(r.n_docs for r in found) == len(rows) and (len(found) > 1) == (file_bytes < 64 << 20)
    assert not {r.file for r in files.collect()} - {r.file for r in found}  # the files are named once and for all


@pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="needs the vocabulary")
def test_random_access_without_copies(spark):
    files = arrow_files.token_files(documents(spark, token_rows()), TOKENIZER, length=32, batch=8)
    row = files.first()
    whole = np.concatenate(list(arrow_files.tokens_of(row.file)))
    assert len(whole) == row.n_tokens
    own = arrow_files.SequenceFile(row.file)
    assert own.per_batch == 8 and own.length == 32
    for i in (0, 7, 8, 13, row.n_sequences - 1, 3):
        ids, mask = own[i]
        want = whole[32 * i : 32 * i + 32]
        assert ids.dtype == np.uint16 and ids[: len(want)].tolist() == want.tolist() and not ids[len(want) :].any()
        assert mask.to_pylist() == [True] * len(want) + [False] * (32 - len(want))
        assert not ids.flags.owndata and not ids.flags.writeable
    for i in (row.n_sequences, -1, 10**6):
        with pytest.raises(IndexError):
            own[i]
    import pyarrow as pa

    before = pa.total_allocated_bytes()
    held = [own[i][0] for i in range(row.n_sequences)]
    assert pa.total_allocated_bytes() - before < held[0].nbytes * len(held) / 4  # mapped, not read


@pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="needs the vocabulary")
def test_token_files_of_an_empty_table(spark):
    files = arrow_files.token_files(documents(spark, []), TOKENIZER)
    assert files.count() == 0 and arrow_files.digests(files, "bigint").collect() == []
    only = arrow_files.token_files(documents(spark, [(3, None)]), TOKENIZER, end_id=7)
    assert [(r.doc_id, r.start, r.ids) for r in arrow_files.read_ids(only, "bigint").collect()] == [(3, 0, [7])]


def test_places_of_uris():
    for uri in ("file:/tmp/a b", "file:///tmp/x", "/tmp/x"):
        store, path = arrow_files.place(uri.replace(" ", ""))
        assert path.startswith("/tmp/")

