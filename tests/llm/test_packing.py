"""Both packers: lossless, dense, and equal to plain best fit."""

import random
from collections import defaultdict

import numpy as np

from rankloom.llm import packed_ids, variable_bins
from rankloom.llm.byte_tokens import encoding
from tests.llm.helpers import awkward, documents, nothing


def plain_best_fit(lengths, sizes):
    """Quadratic best fit with the same opening rule."""
    bins = []
    for n in lengths:
        fit = [b for b in bins if b[0] - b[1] >= n]
        if fit:
            chosen = min(fit, key=lambda b: b[0] - b[1])
        else:
            chosen = [min((s for s in sizes if s >= n), key=lambda s: variable_bins.bin_cost(s) / s), 0]
            bins.append(chosen)
        chosen[1] += n
    return sorted((min(s for s in sizes if s >= used), used) for _, used in bins)


def test_variable_bins_equal_plain_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted((rng.choice([rng.randrange(1, 60), rng.randrange(1, 8193)]) for _ in range(200)), reverse=True)
        bins, starts, ends = variable_bins.pack(lengths)
        used = defaultdict(int)
        for b, s, n in zip(bins, starts, lengths, strict=True):
            assert s == used[b]
            used[b] += n
        assert sorted((ends[b], used[b]) for b in used) == plain_best_fit(lengths, variable_bins.SIZES)


def check_bins(spark, docs, **more):
    counts = variable_bins.token_lengths(docs).collect()
    got = variable_bins.pack_lengths(variable_bins.token_lengths(docs), **more).collect()
    whole, fill, ends = defaultdict(int), defaultdict(list), {}
    for r in got:
        whole[r.doc_id] += r.n_tokens
        if r.n_tokens:
            fill[r.bin_id].append((r.bin_start, r.n_tokens))
            assert ends.setdefault(r.bin_id, r.bin_size) == r.bin_size
        else:
            assert r.bin_id is None
    want = defaultdict(int)
    for r in counts:
        want[r.doc_id] += r.n_tokens
    assert whole == want
    for b, parts in fill.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= ends[b] and all(s >= ends[b] or s < at for s in variable_bins.SIZES)
    return sum(ends.values()), sum(want.values())


def test_variable_bins_on_tables(spark, sf_dir):
    room, tokens = check_bins(spark, documents(spark, sf_dir))
    assert tokens / room > 0.97
    check_bins(spark, documents(spark, sf_dir), shard_items=17)
    check_bins(spark, awkward(spark))
    assert variable_bins.pack_documents(nothing(spark)).count() == 0


def test_long_documents_are_cut_without_loss(spark):
    table = spark.createDataFrame([(1, 20000), (2, 8192), (3, 0), (4, None), (None, 5), (1, 20000)],
                                  "doc_id bigint, n_tokens bigint")
    got = variable_bins.pack_lengths(table).collect()
    parts = sorted((r.piece, r.start, r.n_tokens) for r in got if r.doc_id == 1)
    assert parts == sorted(2 * [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 3616)])
    assert {r.doc_id for r in got if r.bin_id is None} == {3, 4}


def test_capacity_tree_equals_search():
    rng = random.Random(3)
    tree, plain = packed_ids.CapacityTree(100), []
    for row in range(3000):
        if rng.random() < 0.5:
            free = rng.randrange(1, 101)
            tree.add(free, row)
            plain.append(free)
        else:
            need = rng.randrange(1, 101)
            want = min((f for f in plain if f >= need), default=None)
            got = tree.take(need)
            assert (got and got[0]) == want
            if got:
                plain.remove(want)


def check_matrix(docs, **more):
    encoder, n = encoding(None), more.get("row_tokens", packed_ids.ROW_TOKENS)
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        if r.text:
            texts[r.doc_id].append(encoder.encode_ordinary(r.text))
    pieces, rows = defaultdict(list), packed_ids.packed_matrix(docs, **more).collect()
    assert len({(r.shard, r.row) for r in rows}) == len(rows)
    for r in rows:
        ids = np.frombuffer(r.ids, "<i4")
        assert len(ids) == n and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= n
        assert r.resets == r.cu_seqlens[:-1] and (ids[r.n_tokens:] == packed_ids.PAD).all()
        for doc, start, low, high in zip(r.doc_ids, r.doc_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            pieces[doc].append((start, ids[low:high].tolist()))
    assert set(pieces) == set(texts)
    for doc, want in texts.items():
        expected = [(low, ids[low:low + n]) for ids in want for low in range(0, len(ids), n)]
        assert sorted(pieces[doc]) == sorted(expected)
    return sum(r.n_tokens for r in rows) / (len(rows) * n)


def test_matrix_round_trip(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    assert check_matrix(docs) > 0.95
    check_matrix(docs, row_tokens=100, shard_bytes=50_000)
    check_matrix(awkward(spark), row_tokens=64)
    assert packed_ids.packed_matrix(nothing(spark)).count() == 0
    path = f"file://{tmp_path}/matrix"
    packed_ids.write_matrix(docs, path)
    back = spark.read.parquet(path)
    assert sorted(map(str, packed_ids.matrix_digests(back).collect())) == sorted(
        map(str, packed_ids.matrix_digests(packed_ids.packed_matrix(docs)).collect()))
