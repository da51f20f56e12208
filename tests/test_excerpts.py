"""Excerpts against the rules as a loop."""

import random
import re

from lectern.operators import excerpts as E


def loop(paras, least, most, target):
    best = None
    for start in range(min(3, len(paras))):
        pieces, found = [], []
        for p in paras[start:]:
            if sum(len(x.split()) for x in [*pieces, p]) <= most:
                pieces.append(p)
                found.append(list(pieces))
                continue
            for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", p):
                pieces = [*pieces, s]
                if sum(len(x.split()) for x in pieces) > most:
                    break
                found.append(pieces)
            break
        for f in found:
            n = sum(len(x.split()) for x in f)
            if n >= least and (best is None or (abs(n - target), start, len(f)) < best[0]):
                best = ((abs(n - target), start, len(f)), "\n\n".join(f))
    return best and (best[0][1], best[0][2], best[1])


def test_excerpts_match_loop(spark):
    r = random.Random(7)
    rows = [(1, None), (2, ""), (3, "Too short.")]
    for i in range(4, 60):
        rows.append((i, "\n\n".join(" ".join("W" + " w" * r.randrange(1, 9) + "." for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 8)))))
    lengths = {"a": (20, 40, 30), "b": (60, 90, 70)}
    got = {(x.doc_id, x.bucket): (x.start, x.pieces, x.excerpt) for x in E.excerpts(spark.createDataFrame(rows, "doc_id long, text string"), lengths).collect()}
    want = {(i, k): w for i, t in rows for k, v in lengths.items() if (w := loop((t or "").split("\n\n"), *v))}
    assert got == want and len(got) > 60
