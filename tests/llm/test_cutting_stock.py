import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomveil.llm import cutting_stock

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def texts(n, seed=1):
    rnd = random.Random(seed)
    parts = ["the ", "a", "ing ", "é", "日本", "\n", "  ", "'s", "12", "<|endoftext|>", "\t", "\x1c", "\x85", "​", "😀", "ǅ", "٣"]
    return ["".join(rnd.choice(parts) for _ in range(int(rnd.lognormvariate(4.5, 1.5)))) for _ in range(n)]


def test_ids_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(cutting_stock, "_LONG", 50)
    for t in [None, "", " ", "<|endoftext|>", "x y z " * 200, *texts(200)]:
        assert cutting_stock.encode(t).tolist() == library(t)


def check(rows, pieces):
    """Pieces hold each id once, sequences are gapless; returns the padded share."""
    want, got, sequences = {}, {}, {}
    for doc, text in rows:
        want.setdefault(doc, []).append(library(text))
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got.keys() == want.keys()
    for doc, all_ids in want.items():
        ids = all_ids[0]  # repeated ids in the tests have equal texts
        own = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got[doc])
        assert sum(p[1] for p in own) == len(ids) * len(all_ids)
        for start, length, crc, n in own:
            assert n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) and length > 0
        cover = np.zeros(len(ids), int)
        for start, length, *_ in own:
            cover[start : start + length] += 1
        assert (cover == len(all_ids)).all()
    total = padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, total)


@pytest.mark.parametrize("n", [1, 7, 400])
def test_pieces_against_the_library(spark, n):
    rows = list(enumerate(texts(n, n)))
    rows += [(None, None), (1000, ""), (1001, "a b " * 3000), (1002, "tie"), (1003, "tie"), (1003, "tie")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, part int").repartition(3)
    out = cutting_stock.pack(df, ids=True)
    assert check(rows, out.drop("ids").collect()) < 0.01
    one = cutting_stock.sequences(out).collect()
    assert sum(len(r.ids) for r in one) == 4 * sum(len(library(t)) for _, t in rows)
    assert all(r.cu_seqlens[-1] * 4 == len(r.ids) and r.cu_seqlens == sorted(r.cu_seqlens) for r in one)
    assert cutting_stock.pack(df.limit(0)).count() == 0


def test_the_cover_is_within_the_gap_of_the_best(spark):
    """Against trying all patterns, on few sizes."""
    rnd = random.Random(3)
    for _ in range(20):
        sizes = sorted(rnd.sample(range(40, 256), 4))
        need = {s: rnd.randint(1, 50) for s in sizes}
        ways = cutting_stock.Master(need).solve()
        for s in sizes:
            assert sum(dict(p).get(s, 0) * x for p, x in ways) == pytest.approx(need[s], abs=0.01)
        assert all(sum(n * k for n, k in p) <= cutting_stock.ROOM for p, _ in ways)
        # weak duality: prices under which no pattern is worth more than 1 bound the cover
        patterns = [c for c in product(*(range(cutting_stock.ROOM // s + 1) for s in sizes)) if sum(a * s for a, s in zip(c, sizes)) <= cutting_stock.ROOM]
        assert sum(x for _, x in ways) <= 1.006 * best_cover(patterns, [need[s] for s in sizes]) + 0.01


def best_cover(patterns, need):
    """The least fractional cover: the best basis of all."""
    from itertools import combinations

    best = float("inf")
    full = [p for p in patterns if not any(q != p and all(b >= a for a, b in zip(p, q)) for q in patterns)]
    matrix = np.array(full + [tuple(-int(i == j) for j in range(4)) for i in range(4)], float)  # the last are surplus
    cost = np.array([1.0] * len(full) + [0.0] * 4)
    for basis in combinations(range(len(matrix)), 4):
        a = matrix[list(basis)].T
        if abs(np.linalg.det(a)) > 1e-9:
            x = np.linalg.solve(a, need)
            if (x >= -1e-9).all():
                best = min(best, float(cost[list(basis)] @ x))
    return best


def test_a_hot_length_keeps_apart_from_others():
    plan = cutting_stock.Plan({600: 10_000_000, 3: 5, 1023: 7, 425: 1})
    seen = {}
    for n, rank in [(600, 0), (600, 9_999_999), (3, 4), (1023, 6), (425, 0)]:
        parts = plan.places(n, rank)
        assert sum(p[0] for p in parts) == n
        for p in parts:
            assert seen.setdefault((p[1], p[2]), (n, rank)) == (n, rank)
