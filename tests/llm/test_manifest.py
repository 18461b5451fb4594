"""The manifest against a plain version: odd rows, a source of several levels, a single row."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from archspark.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, i string, path string, row int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def _way(levels, i, place):
    for nodes in levels[:-1]:
        lo = i // 16 * 16
        place.append((nodes[lo:i], nodes[i + 1 : lo + 16]))
        i //= 16


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, _leaf(r, r[4]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = _levels([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            way: list = []
            _way(trees[s], i, way)
            _way(top, k, way)
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = _leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for before, after in way:
                now = _h(*before, now, *after)
            out.append((r[0], leaf, trees[s][-1][0], root, _h(*(x for b, a in way for x in (*b, *a))), now, now == root))
    return out


def _key(x):
    return tuple(str(v) for v in x)


ODD = [(None, None, None, None, None), (1, "a", "en", 3, "ÄB c"), (1, "a", "en", 3, "ÄB c"), (2, "", "de", 0, ""), (5, None, "x", 9, "X" * 200_000), (5, None, None, None, None), (None, "a", "", -1, "Aé"), (-7, "ß", "en", 2**40, "no capitals")]
BIG = [(k * 3 - 500, "hot" if k % 3 else f"s{k % 40}", None if k % 7 else "en", k, f"Text {k}") for k in range(7000)]


@pytest.mark.parametrize("rows", [ODD, [ODD[1]], [ODD[0], ODD[0]], BIG], ids=["odd", "one", "equal rows", "deep"])
def test_manifest_equals_a_plain_one(spark, rows):
    given = spark.createDataFrame([(*r, 1, "i", "p", 2) for r in rows], SCHEMA).repartition(3)
    got = manifest.manifest(given)
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(plain(rows), key=_key)


def test_manifest_of_an_empty_table(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_proofs_hold_and_tampering_shows(spark):
    got = manifest.manifest(spark.createDataFrame([(*r, 1, "i", "p", 2) for r in BIG], SCHEMA)).collect()
    wrong = [r for r in got if not r.verified]
    assert wrong and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in wrong) and all(r.folded_root == r.root for r in got if r.verified)
