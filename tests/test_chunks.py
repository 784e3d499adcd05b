"""Lines cut by length against a walk along each line."""

import math
import random
from collections import defaultdict

from meridion.operators import polyline


def walk(points, most):
    """Pieces of one line, cut when ``most`` is reached; short tails are dropped or merged."""
    pts = [points[0]]
    for p in points[1:]:
        if math.dist(p, pts[-1]) > 1e-9:
            pts.append(p)
    out, piece, length = [], [pts[0]], 0.0
    for b in pts[1:]:
        while length + math.dist(piece[-1], b) > most + 1e-9:
            a, w = piece[-1], (most - length) / math.dist(piece[-1], b)
            cut = (a[0] + (b[0] - a[0]) * w, a[1] + (b[1] - a[1]) * w)
            out.append([*piece, cut])
            piece, length = [cut], 0.0
        length += math.dist(piece[-1], b)
        piece.append(b)
    if out and length < 8:
        return out
    if out and length < 14:
        out[-1] += piece  # the cut stays
        out[-1] = [p for k, p in enumerate(out[-1]) if k == 0 or math.dist(p, out[-1][k - 1]) > 1e-9]
        return out
    return [*out, piece]


def test_chunks_have_the_points_of_a_walk(spark):
    rng = random.Random(3)
    lines = {k: [(rng.random() * 90, rng.random() * 90) for _ in range(rng.randint(2, 9))] for k in range(60)}
    lines |= {100: [(0.0, 0.0), (107.0, 0.0)], 101: [(0.0, 0.0), (110.0, 0.0)], 102: [(0.0, 0.0), (114.5, 0.0)], 103: [(0.0, 0.0), (3.0, 0.0)], 104: [(0.0, 0.0), (0.0, 0.0), (40.0, 0.0)], 105: [(7.0, 7.0)], 106: [(0.0, 0.0), (200.0, 0.0)], 107: [(0.0, 0.0), (55.5, 0.0), (230.0, 0.0)]}
    df = spark.createDataFrame([(k, n, *p) for k, pts in lines.items() for n, p in enumerate(pts)], "line_id long, seq long, x double, y double")
    got = defaultdict(dict)
    for r in polyline.chunks(df, 100.0).collect():
        got[r.line_id].setdefault(r.chunk, []).append((r.seq, r.x, r.y))
    for k, pts in lines.items():
        want = walk(pts, 100.0)
        assert sorted(got[k]) == list(range(len(want))), k
        for n, piece in enumerate(want):
            mine = sorted(got[k][n])
            assert len(mine) == len(piece) and all(math.dist(m[1:], p) < 1e-6 for m, p in zip(mine, piece)), (k, n)
