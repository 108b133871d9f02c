"""The pipeline's stages and run() on null and repeated ids, copies and near copies, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline

RNG = random.Random(11)
VOCAB = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, source string"


def words(n=80):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


JUNK = "BUY!!! $$$ " * 30


@pytest.fixture(scope="module")
def learned(spark, tmp_path_factory):
    """A folder of 200 documents and labels; every fourth is junk."""
    folder = tmp_path_factory.mktemp("pipeline")
    rows = [(i, words() if i % 4 else JUNK + str(i), "ab"[i % 2]) for i in range(200)]
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def staged(spark, stage, rows, folder=""):
    return [tuple(r) for r in dict(pipeline.STAGES)[stage](spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder).collect()]


def test_quality(spark, learned):
    folder, rows = learned
    clean = words()
    rows = [*rows, (None, words(), "a"), (None, JUNK, "a"), (None, words(), None), (None, None, "b"), (500, words(), "a"), (500, JUNK, "a"), (501, clean, "b"), (501, clean.upper(), "b"), (501, clean, "b")]
    got = Counter(staged(spark, "quality", rows, folder))
    sure = [r for r in rows if r[1] is not None and not r[1].isupper()]
    assert {r: n for r, n in got.items() if r in sure} == Counter(r for r in sure if not r[1].startswith("BUY"))
    assert not any(r[1] and r[1].startswith("BUY") for r in got)


def least(ids):
    return min((x for x in ids if x is not None), default=None)


def test_exact(spark):
    rows = [(1, "Alpha beta", "a"), (2, "ALPHA BETA", "a"), (None, "alpha beta", None), (None, "only null", "a"), (None, "ONLY null", "a"), (7, "x y", "a"), (7, "x y", "a"), (7, "other", "b"), (2, "only here", "a"), (None, None, "b"), (3, "", "b")]
    groups = {}
    for d, t, _ in rows:
        groups.setdefault((t or "").lower(), []).append(d)
    want = Counter((max((x for x in ids if x is not None), default=None), t) for t, ids in groups.items())
    assert Counter((d, (t or "").lower()) for d, t, _ in staged(spark, "exact_dedup", rows)) == want


def components(rows):
    """The component of each row, by brute force; rows without words are alone."""
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    return root


def near_copies(text, n):
    return [f"{text} {words(2)}" for _ in range(n)]


def test_near(spark):
    a, b, c, d, e = (near_copies(words(), 3) for _ in range(5))
    rows = [(10, a[0]), (11, a[1]), (None, a[2]), *((None, t) for t in b), *((None, t) for t in c), (12, d[0]), (10, d[1]), (20, e[0]), (20, e[1]), (21, e[2])]
    same = words()
    rows = [(*r, "a") for r in [*rows, (40, same), (40, same), (None, words()), (None, ""), (30, " "), (30, None), (31, "two words")]]
    got = staged(spark, "near_dup", rows)
    root = components(rows)
    for k in set(root):
        members = [r for r, x in zip(rows, root, strict=True) if x == k]
        stays = [r for r in got if r in members]
        assert len(stays) == 1 and stays[0][0] == least([r[0] for r in members])
    assert len(got) == len(set(root))


def copies(rows):
    """How often the mix takes each row, in plain Python: targets by water-filling, copies of which half or more is taken."""
    size = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight, free, level = {s: i % 3 + 1 for i, s in enumerate(sources)}, set(sources), 0.0
    while free:
        level = (sum(total.values()) - sum(3 * total[s] for s in sources if s not in free)) / sum(weight[s] for s in free)
        full = {s for s in free if 3 * total[s] < level * weight[s]}
        if not full:
            break
        free -= full
    out = Counter()
    for s in sources:
        taken = min(int((level * weight[s] if s in free else 3 * total[s]) + 0.5), 3 * total[s])
        before, mine = 0, [(hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[0] or 0, n, r) for n, r in zip(size, rows, strict=True) if r[2] == s]
        for _, _, n, r in sorted(mine, key=lambda m: m[:3]):
            part = max(0, min(n, taken % max(1, total[s]) - before))
            out[r] += taken // total[s] + (part > 0 and 2 * part >= n) if n else 1
            before += n
    return +out


def test_mixing(spark):
    rows = [(i, words(RNG.randint(1, 60)), "abc"[i % 3]) for i in range(90)] + [(100, words(7), None), (None, words(9), None), (101, "", "a"), (102, None, "b"), (None, words(11), "c"), *[(103, words(8), "c")] * 3, *[(None, None, None)] * 2]
    want = copies(rows)
    assert Counter(staged(spark, "mixing", rows)) == want and max(want.values()) > 1


def tokens():
    from tokenizers import Tokenizer

    from lathe.llm import huffman

    t = Tokenizer.from_file(huffman.tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def packed(pieces):
    """Tokens by doc_id and length of the document, after a look at the windows and checksums."""
    windows, out = {}, Counter()
    for d, start, length, crc, n, sequence, offset in pieces:
        windows.setdefault(sequence, []).append((offset, length))
        out[d, start, length, crc, n] += 1
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    return out


def covered(pieces, rows, encode):
    """Every piece is a part of a document with its checksum, and all parts of a length add up to the documents'."""
    by = {}
    for d, t, _ in rows:
        by.setdefault(d, []).append(encode(t))
    for d, start, length, crc, n in pieces:
        assert any(len(x) == n and zlib.crc32(np.array(x[start : start + length], dtype="<u4").tobytes()) == crc for x in by[d])
    got = Counter()
    for (d, _, length, _, n), times in pieces.items():
        got[d, n] += length * times
    return got


def test_packing(spark):
    encode = tokens()
    rows = [(i, words(RNG.randint(1, 400)), "a") for i in range(40)] + [(50, words(3000), "a"), (None, words(20), "a"), (None, None, "b"), (51, "é 你好", "b"), (51, words(30), "b"), (52, words(9), "a"), (52, words(9), "a")]
    want = Counter()
    for d, t, _ in rows:
        want[d, len(encode(t))] += len(encode(t))
    assert covered(packed(staged(spark, "packing", rows)), rows, encode) == want


def test_run(spark, learned):
    """All stages in one: what plain Python keeps and mixes is what is packed."""
    folder, rows = learned
    clean = [r for r in rows if not r[1].startswith("BUY")]
    near = near_copies(words(), 3)
    more = [(300, clean[0][1].replace("w", "W", 1), "a"), (None, clean[1][1], "b"), (None, words(81), "b"), (None, JUNK, "a"), (301, JUNK, "a"), (301, words(70), "a"), (302, near[0], "b"), (303, near[1], "a"), (None, near[2], "a")]
    more += [(None, words(60), None)] * 2
    docs = [*rows, *more]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    left = [r for r in docs if not r[1].startswith("BUY")]
    largest = {}
    for r in left:
        old = largest.setdefault(r[1].lower(), r)
        if (r[0] is not None, r[0] or 0) > (old[0] is not None, old[0] or 0):
            largest[r[1].lower()] = r
    left = list(largest.values())
    root, smallest = components(left), {}
    for r, k in sorted(zip(left, root, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        smallest.setdefault(k, r)
    left, encode, want = list(smallest.values()), tokens(), Counter()
    assert len(left) < len(largest) < len(docs)
    for r, n in copies(left).items():
        want[r[0], len(encode(r[1]))] += n * len(encode(r[1]))
    assert covered(packed([tuple(r) for r in pipeline.run(spark, folder).collect()]), left, encode) == want

    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).count() == 0
