"""Tiles of attention from intervals against all pairs of positions."""

import numpy as np

from textloom.operators import statistics


def test_tiles_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    length, rows, want, tiles = 64, [], {}, {}
    for pack in range(40):
        at, sees = 0, np.zeros((length, length), dtype=bool)
        while at < length:
            at += int(rng.integers(0, 3)) if pack % 2 else 0  # gaps between segments
            n = int(min(length - at, rng.integers(1, 40)))
            k = int(rng.integers(0, n + 1))
            if n <= 0:
                break
            rows.append((0, pack, at, k, n - k))
            q, j = np.indices((n, n))
            sees[at : at + n, at : at + n] = (q >= j) | ((q < k) & (j < k))
            at += n
        for block in (8, 16):
            counts = sees.reshape(length // block, block, length // block, block).sum(axis=(1, 3))
            want[pack, block] = ((counts == block**2).sum(), ((counts > 0) & (counts < block**2)).sum(), (counts == 0).sum())
            tiles[pack, block] = {(int(q), int(k)): bool(counts[q, k] == block**2) for q, k in zip(*np.nonzero(counts), strict=True)}
    frame = spark.createDataFrame(rows, "shard int, pack_id long, start_off int, n_input int, n_label int")
    for block in (8, 16):
        got = {r["pack_id"]: (r["n_full"], r["n_partial"], r["n_empty"]) for r in statistics.tile_counts(frame, block, length).collect()}
        assert got == {p: v for (p, b), v in want.items() if b == block}
        told = {}
        for r in statistics.tile_map(frame, block).collect():
            told.setdefault(r["pack_id"], {})[r["query_block"], r["key_block"]] = r["full"]
        assert told == {p: v for (p, b), v in tiles.items() if b == block}
    assert statistics.tile_map(frame.limit(0), 8).count() == 0
