"""Vector codes against plain loops over integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlens.llm import codes, registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """Codes, errors and codebooks by whole distance tables of Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    dims = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    ints = [[int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (dims - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, [np.float32(x) for x in kept[r][1]]))
    d, out = dims // parts, [[] for _ in kept]
    error, books = [0] * len(kept), []
    for p in range(parts):
        x = [tuple(v[p * d : (p + 1) * d]) for v in ints]
        book = [x[r] for r in order[:entries]]
        near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
        for _ in range(rounds):
            held = [near(v, book)[1] for v in x]
            for e in set(held):
                mine = [v for v, h in zip(x, held, strict=True) if h == e]
                book[e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
        books.append(book)
        for r, v in enumerate(x):
            dist, e = near(v, book)
            out[r].append(e)
            error[r] += dist
    return [(i, label, tuple(c), e) for (i, _, label), c, e in zip(kept, out, error, strict=True)], books


@pytest.mark.parametrize(("parts", "entries", "rounds", "dims"), [(4, 16, 4, 16), (2, 5, 2, 6), (3, 40, 3, 7), (1, 3, 4, 3)])
def test_codes_and_codebooks(spark, parts, entries, rounds, dims):
    rng = np.random.default_rng(dims)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, dims)], int(i) % 3 if i % 5 else None) for i in rng.permutation(90)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], 1), (None, rows[6][1], None)]  # repeated rows, an id with two vectors, none
    rows += [(200, None, 1), (201, [None, *rows[0][1][1:]], 1), (202, [float("nan")] * dims, 1), (203, [float("inf")] * dims, 1), (204, rows[0][1][:-1], 2), (205, [], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in ("code", "error", "part", "entry", "count")})
    books = codes.fit(df, parts, entries, rounds)
    want, want_books = plain(rows, parts, entries, rounds)
    assert [[tuple(c) for c in p] for p in books.entries.tolist()] == want_books
    got = codes.label_errors(codes.encode(df, books)).collect()
    assert sorted(((r.vec_id, r.label, tuple(r.code), r.error) for r in got), key=str) == sorted(want, key=str)
    total = {}
    for r in want:
        total[r[1]] = total.get(r[1], 0) + r[3]
    assert all(r.label_error == total[r.label] for r in got)


def test_bounds_never_pass_the_distance_and_nearest_is_exact():
    rng = np.random.default_rng(3)
    for scale, d in ((3, 16), (1000, 16), (codes.LIMIT, 16), (codes.LIMIT, 5), (2, 1)):
        x, c = (rng.integers(-scale, scale + 1, (n, d)) for n in (300, 64))
        x[:20], c[40:] = c[:20], c[:24]  # zero distances and equal entries
        x[20:40] = x[20:40, :1]  # no residual
        full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        a, b = codes.Blocks(x), codes.Blocks(c)
        for level in range(len(codes.LEVELS)):
            assert (codes.bound(a, np.arange(300)[:, None], b, np.arange(64)[None, :], level) <= full).all()
        index, distance = codes.nearest(x, c, b)
        assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_nothing_to_fit_and_too_large(spark, tmp_path):
    none = spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], SCHEMA)
    assert codes.fit(none) is None and codes.fit(none.where("false")) is None
    none.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.op12_codes(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        codes.fit(spark.createDataFrame([(1, [1e30, 0.0], 1)], SCHEMA), parts=2)
