"""The training-data operators against brute force, on nulls, empty texts, ties, repeated rows, odd columns and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lathe.llm import common, exact_dedup, huffman, media, mixing, ngram_join, packing, pii, quality, toxicity, warc

SCHEMA = "doc_id long, text string, source string, row string, size long, h string"
random.seed(5)
VOCAB = [f"w{i}" for i in range(300)]
LONG = " ".join(random.choice(VOCAB) for _ in range(20_000))
ROWS = [
    (1, "Alpha beta", "a"), (2, "ALPHA BETA", "a"), (3, None, "b"), (4, "", "b"), (None, "alpha beta", None), (5, "alpha beta", "a"), (5, "alpha beta", "a"),
    (6, LONG, "a"), (7, LONG + " end", "b"), (8, " \n\t", "c"), (9, "é È 你好 \U0001f600", "c"), (10, "mail a@b.co, call +1 (555) 555-1234 4111111111111111", None), (None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", -1, "y") for r in ROWS], SCHEMA).repartition(3)


def low(text):
    return (text or "").encode().lower()


def test_exact_dedup(spark, docs):
    groups = defaultdict(list)
    for d, t, _ in ROWS:
        groups[low(t)].append(d)
    want = []
    for d, t, _ in ROWS:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids, default=None)
        want.append((d, keep, len(groups[low(t)]), d == keep, hashlib.sha256(low(t)).hexdigest()))
    for options in ({}, {"digest": lambda raw: b"\0" * 32, "budget": 1}):
        got = [tuple(r) for r in exact_dedup.dedup(docs, "largest", **options).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_patricia():
    trie, want = exact_dedup.Patricia(), Counter()
    for i in range(2000):
        key = bytes(random.choice(b"ab") for _ in range(random.randint(0, 9)))
        trie.insert(key, i)
        want[key] += 1
    assert {k: n for k, _, n in trie.items()} == want


def test_owner_shares_prefixes_and_spills():
    """Texts with a long common beginning are held once; with a small budget every subtree is spilled, again and again."""
    trie, head = exact_dedup.Patricia(), b"x" * 5000
    for i in range(1000):
        trie.insert(head + str(i).encode(), i)
    assert trie.bytes < 1_000_000
    texts = [head + bytes(random.choice(b"ab") for _ in range(random.randint(0, 12))) for _ in range(800)] + [b"", b"", b"y", head[:17]]
    for budget in (1, 3000, 1 << 30):
        owner = exact_dedup.Owner(budget)
        for i, text in enumerate(texts):
            owner.insert(text, i, 1)
        assert (len(owner.spilled) > 0) == (budget < 1 << 30)
        want: dict = {}
        for i, text in enumerate(texts):
            want.setdefault(text, []).append(i)
        assert sorted(owner.items()) == sorted((t, min(i), len(i)) for t, i in want.items())


def test_mixing(spark, docs):
    rows = mixing.mix(docs, carry=["doc_id", "row"]).collect()
    assert len(rows) == len(ROWS)
    taken, targets = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(e.words for e in r.epochs)
        taken[r.source_size] += r.taken
        targets[r.source_size] = r.target
    assert sum(targets.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    firsts = [r.first for r in rows]
    assert firsts == sorted(firsts) and mixing.mix(docs.limit(0)).count() == 0
    order = [r.position for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert order == sorted(order) and all(0 <= p < 1 for p in order)


def test_mixing_many_sources(spark):
    """Every row a source or two, so that many are capped: targets by water-filling in plain Python."""
    rows = [(i, " ".join(["w"] * (1 + i * i % 97 if i % 9 else 3000)), f"s{i // 2:04}" if i % 11 else None) for i in range(400)]
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += len(t.split())
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, capped, level = {s: i % 3 + 1 for i, s in enumerate(order)}, set(), 0.0
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if 3 * total[s] < level * weight[s]}
        if more == capped:
            break
        capped = more
    want = {i: 3.0 * total[s] if s in capped else level * weight[s] for i, _, s in rows}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    assert 5 < len(capped) < len(order) and all(r.target == pytest.approx(want[r.doc_id]) and r.taken <= 3 * r.size for r in got)


def test_join(spark):
    base, rows = [random.choice(VOCAB) for _ in range(60)], []
    for _ in range(30):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(60)] = random.choice(VOCAB)
        rows.append((len(rows), " ".join(w)))
    rows += [(100, None), (101, "A b"), (102, "a  B"), (None, rows[0][1]), (5, rows[5][1].upper()), (103, LONG), (104, LONG + " x")]
    sets = []
    for _, t in rows:
        w = low(t).split()
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for a, (d, _) in enumerate(rows):
        members[find(a)].append(d)
    want = [(d, len(s), min((x for x in members[find(a)] if x is not None), default=None) if s else d) for a, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_join(df).collect()), key=str) == sorted(want, key=str)
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_components_both_ways(spark):
    """Few links in one task and many by star steps give the same roots."""
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i + 1000, i + 1001) for i in range(60)]
    df = spark.createDataFrame([(u, v) for u, v in links if u != v], "u long, v long")
    one, many = ({r.u: r.v for r in ngram_join.components(df, len(links), most).collect()} for most in (10_000, 0))
    assert one == many and one[1060] == 1000


def test_join_without_broadcasts(spark, monkeypatch):
    """Beyond the bounds of small tables and of known frequent n-grams the result is the same."""
    rows = [(i, " ".join([*VOCAB[j : j + 40], *(random.choice(VOCAB) for _ in range(i % 9))])) for i in range(120) for j in [i % 4 * 50]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.ngram_join(df).collect()))
    for name, value in (("FEW", -1), ("MOST_FREQUENT", 1), ("RANGE", 50), ("CHUNK", 200)):
        monkeypatch.setattr(ngram_join, name, value)
    assert sorted(map(tuple, ngram_join.ngram_join(df).collect())) == want and len({c for *_, c in want}) < 100


def test_huffman_code():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    lengths = huffman.code_lengths(counts, 5)
    assert lengths.max() <= 5 and sum(2.0 ** -int(n) for n in lengths if n) <= 1 and lengths[0] == 0
    code = huffman.Code(lengths)
    ids = np.random.default_rng(1).choice(np.arange(1, 12), 70_000).astype(np.uint32)
    data, starts = code.encode(ids)
    n = np.minimum(huffman.STEP, len(ids) - huffman.STEP * np.arange(len(starts)))
    assert (huffman.decode(data, starts, n, code.table(), code.most) == ids).all()


def test_token_files_and_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(huffman.tokenizer_path())
    encoded = lambda x, end: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], dtype="<u4")
    want = Counter((d, zlib.crc32(encoded(x, 0).tobytes())) for d, x, _ in ROWS)
    back = huffman.read_files(huffman.encode_corpus(docs)).collect()
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in back) == want
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert huffman.read_files(huffman.encode_corpus(docs.limit(0))).count() == 0
    pieces, windows, parts = packing.pack(docs).collect(), defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        parts[p.doc_id, p.doc_tokens].append(p)
    assert sum(p.length for p in pieces) == sum(len(encoded(x, 1)) for _, x, _ in ROWS)
    for key in {(d, len(encoded(x, 1))) for d, x, _ in ROWS}:  # every id of every document is in exactly one piece
        mine = Counter(encoded(x, 1).tobytes() for d, x, _ in ROWS if (d, len(encoded(x, 1))) == key)
        starts = defaultdict(list)
        for p in parts[key]:
            starts[p.start].append(p.ids)
            assert p.length == len(p.ids) // 4 and any(p.ids == x[4 * p.start : 4 * (p.start + p.length)] for x in mine)
        at = 0
        while at < key[1]:
            assert len(starts[at]) == sum(mine.values())
            at += len(starts[at][0]) // 4
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_in_one_python_pass(spark, docs):
    """Two passes in one task would keep two workers alive for each core, beside every later stage."""
    plan = packing.digest(packing.pack(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_arrow_batches_are_short(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('x', 10000) as text")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"]) for b in batches)
    got = common.materialize(rows.mapInArrow(sizes, "n long, bytes long"), "test-batches").collect()
    assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 2 * common.BATCH_BYTES
    assert spark.conf.get(key) == before


def test_differencing():
    sizes = [random.randint(1, 900) for _ in range(200)]
    dealt = packing.differencing(sizes, 40)
    assert sorted(i for w in dealt for i in w) == list(range(200))
    loads = [sum(sizes[i] for i in w) for w in dealt]
    assert max(loads) - min(loads) < 200
    for sizes in (sizes, [1500] * 9, [2048], [2047, 1, 1], [700] * 50 + [1] * 50):
        windows = packing.pack_group(sizes, 2048)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 2048 for w in windows)
    assert len(packing.pack_group([1500] * 9, 2048)) == 9  # the least count, 7, doesn't hold: it rises


def test_encoder():
    from lathe.llm.tokens import Encoder

    e = Encoder(huffman.tokenizer_path(), most_cuts=500)
    texts = ["", None, " ", "a  b", "a\n b", "x\n\ny", "tab\there", "nb sp", "<|endoftext|> hi", "it's 12.7", "你好 \U0001f600", "a\x02b"]
    texts += ["".join(random.choice(["a", "B", " ", "\n", "'s", "'", "9", "!", ".", "…", "ß", "×", "é", "😀"]) for _ in range(random.randint(0, 30))) for _ in range(800)]
    ids, n = e.encode(pa.array(texts))
    for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert list(part) == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_cuts_long_texts(monkeypatch):
    """Texts without safe cuts go to the library in pieces; the ids are those of the whole text."""
    from lathe.llm import tokens

    monkeypatch.setattr(tokens, "MOST_BYTES", 50)
    monkeypatch.setattr(tokens, "MOST_NEW", 7)
    e = tokens.Encoder(huffman.tokenizer_path(), most_cuts=500)
    texts = ["\t".join(VOCAB[:50]), "a\tb " + " ".join(VOCAB) + "  x", "\t" + "y" * 500, "<|endoftext|> " * 30 + "z é " * 40, " ".join(VOCAB)]
    ids, n = e.encode(pa.array(texts))
    assert len(tokens.pieces_of(texts[1])) > 5
    for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert list(part) == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_pii(spark, docs):
    rows = {(r.doc_id, r.base.__str__()): r for r in pii.detect(docs).collect()}
    assert len(pii.detect(docs).collect()) == len(ROWS)
    text = ROWS[11][1]
    found = next(r for r in rows.values() if r.doc_id == 10)
    spans = {text[s.start : s.end] for s in [*found.base, *found.added]}
    assert "a@b.co" in spans
    odd = spark.createDataFrame([(1, "9" * 5000 + " " + "1.2.3.4" * 50 + "a" * 20_000 + "@x.y \U0001f600 c@d.ef 4111 1111-1111 1111")], "doc_id long, text string")
    got = pii.detect(odd).first()
    t = odd.first().text
    base = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    base += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    assert [(s.kind, s.start, s.end) for s in got.base if s.kind < 2] == base and any(s.kind == 2 for s in got.base)
    assert pii.detect(docs.limit(0)).count() == 0


def test_pii_base(spark, tmp_path):
    """Base spans against Python's re, each text alone: no other digits help a number written in short groups."""
    texts = ["call +33 1 23 45 67 89", "41 11 11 11 11 11 11 11", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "411 111 111 111 111 1 \U0001f600 +1.2.3.4.5.6.7.8", "a@b.c 1.2.3.4", "x@y 1.2.3", None]
    rng = random.Random(7)
    texts += ["".join(rng.choice(["0", "4", "18", "111", "+", "+4", " ", "-", ".", "(", ")", "@", "a", "b.c", "é"]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(["41", "1", "11", "0"]) + rng.choice([" ", "-", ""]) for _ in range(rng.randint(9, 14))) for _ in range(1000)]

    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    n = lambda m: len(re.sub("[^0-9]", "", m))
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= n(m) <= 15),
    ]
    want = {i: [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m.group())] for i, t in enumerate(texts)}
    texts.append(" ".join(f"a{i}@b.c +1 ({i % 10}55) 555-0{i:03} x" for i in range(1000)))
    want[len(texts) - 1] = [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, texts[-1]) if ok(m.group())]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, start int")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.detect(df).collect()}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.query(spark, str(tmp_path)).collect():
        said = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want[r.doc_id]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, *_ in want[r.doc_id]) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r.spans.split(",") if r.spans else [])
    assert got == want and want[0] and want[1] and Counter(s[0] for f in want.values() for s in f).keys() == {0, 1, 2, 3}


def test_media(spark, docs):
    got = media.media_features(media.encode_media(docs)).collect()
    want = Counter()
    for d, t, _ in ROWS:
        raw = (t or "").encode()
        raw += b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[d, hashlib.sha256(raw).hexdigest()] += 1
    assert Counter((r.doc_id, r.payload_sha256) for r in got) == want
    x = np.random.default_rng(2).integers(0, 256, (7, 96), dtype=np.uint8)
    png = media.write_png(x)
    assert (media.read_png(png) == x).all()
    with pytest.raises(ValueError, match="checksum"):
        media.read_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])


def test_media_query(spark, tmp_path):
    """Every column that follows from the text, on nulls, repeated rows, sizes at the padding's edge, a long text and a column that clashes."""
    texts = [None, "", "a", "é" * 287, "x" * 575, "x" * 576, "x" * 577, LONG, "\xff 你好 \U0001f600", "a"]
    rows = [(i if i % 4 else None, t, "m") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, media string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, t, _ in rows:
        raw = (t or "").encode()
        whole = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[d, len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:])] += 1
    got = media.query(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    same = {(r.media_bytes, r.media_sha256, r.feature) for r in got if r.payload_sha256 == hashlib.sha256(b"a" + b"\xff" * 575).hexdigest()}
    assert len(same) == 1 and all(len(r.feature) == 16 and r.media_bytes > 0 and len(r.media_sha256) == 64 for r in got)


def test_token_and_packing_queries(spark, tmp_path):
    """op2 and op3 on clashing columns, null and repeated ids and rows."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(huffman.tokenizer_path())
    rows = [(i % 5 if i % 7 else None, t_, 1, "s") for i, t_ in enumerate([None, "", "a b", LONG, "a b", "tab\there", "é 你好", *(" ".join(VOCAB[:n]) for n in range(1, 60))])]
    spark.createDataFrame(rows, "doc_id long, text string, start long, ids string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda x, end: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, end], dtype="<u4").tobytes())
    got = sorted(huffman.query(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((d, crc(x, 0)) for d, x, *_ in rows)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    whole = Counter((r.doc_id, r.ids_crc32) for r in packing.query(spark, str(tmp_path)).collect() if r.length == r.doc_tokens)
    want = Counter((d, crc(x, 1)) for d, x, *_ in rows if x != LONG)
    assert whole == want


def test_unfilter():
    x = np.random.default_rng(3).integers(0, 256, (5, 6), dtype=np.uint8).astype(int)
    lines = np.zeros((5, 6), dtype=np.uint8)
    for y in range(5):
        for c in range(6):
            a, b, d = (x[y, c - 1] if c else 0), (x[y - 1, c] if y else 0), (x[y - 1, c - 1] if c and y else 0)
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            lines[y, c] = (x[y, c] - (0, a, b, (a + b) // 2, paeth)[y]) % 256
    assert (media.unfilter(np.arange(5, dtype=np.uint8), lines) == x).all()


def test_warc(spark):
    pages = [(1, "http://a", "x"), (2, "http://b\r\nX: 1", "x"), (3, None, None), (4, "u", ""), (5, "é", "y\r\n\r\nWARC/1.1"), (None, "n", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(df)).collect()}
    assert len(got) == 6
    assert [(got[k].record_type, got[k].refers_to, got[k].payload_bytes) for k in (1, 2, 3, 4, 5, None)] == [("revisit", 2, 1), ("response", None, 1), ("revisit", 4, 0), ("response", None, 0), ("response", None, 13), ("revisit", 2, 1)]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_against_brute_force(spark, tmp_path):
    """The query itself on null and repeated ids, long and repeated payloads and extra columns."""
    rng = random.Random(9)
    bodies = [None, "", "a", "é" * 300_000, "x\r\n\r\nWARC/1.1\r\n", *(" ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 50))) for _ in range(8))]
    pages = [(rng.choice([None, *range(40)]), "http://h/" + str(i % 7) if i % 5 else None, bodies[i] if i < len(bodies) else rng.choice(bodies), "f", i) for i in range(150)]
    pages += [(None, "n", "only null"), (None, "n", "only null"), (77, "same", "twice"), (77, "same", "twice")]
    pages = [(*p[:3], "f", i) for i, p in enumerate(pages)]
    spark.createDataFrame(pages, "page_id long, url string, html string, file string, ord long").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    groups, want = defaultdict(list), Counter()
    for p in pages:
        groups[(p[2] or "").encode()].append(p[0])
    for raw, ids in groups.items():
        ids.sort(key=lambda x: (x is not None, x or 0))
        said = len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[ids[-1], *said, "response", None] += 1
        want.update((i, *said, "revisit", ids[-1]) for i in ids[:-1])
    got = warc.query(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, got.collect())) == want


def test_toxic_kinds():
    """Kinds of toxicity are found in the data, by no word list: two vocabularies of abuse fall into different clusters."""
    x = np.zeros((60, 12))
    for i in range(60):
        x[i, [random.randrange(0, 6) + 6 * (i % 3 == 0) for _ in range(4)]] = 1
    at = toxicity.clusters(x, 2)
    assert len(set(at[::3])) == 1 and set(at[::3]) != set(at[1::3]) and np.bincount(at).tolist() == [40, 20]


def test_toxic_sample_is_bounded(spark):
    rows = [(i % 7, f"text {i}") for i in range(300)] + [(None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(3, 1), (4, 1)], "doc_id long, toxic int")
    got = toxicity.sample(df, labels, 5).collect()
    assert len(got) == 5 and {r.doc_id for r in got} <= {0, 1, 2, 3, 5, 6}


def test_classifier_queries(spark, tmp_path):
    """The queries themselves on held-out labels, with nulls, ties, very long texts, repeated ids and columns that clash."""
    rng, docs, labels = random.Random(21), [], []
    for i in range(400):
        text = " ".join(rng.choice(VOCAB) for _ in range(rng.randint(20, 120)))
        toxic, junk = i % 6 == 1, i % 4 == 0
        text = f"{text} you {rng.choice(['brute', 'oaf', 'lout', 'dolt'])}" if toxic else text
        docs.append((i, "BUY!!! $$$ ### " * 20 + text[:9] if junk else text, 0.5, 1, "z"))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(None, None, 0.5, 1, "z"), (None, "", 0.5, 1, "z"), (3, docs[3][1], 0.5, 1, "z"), (900, LONG * 20, 0.5, 1, "z")]
    spark.createDataFrame(docs, "doc_id long, text string, score double, label int, x string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    got = quality.query(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in docs)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    told = [r.predicted == labels[r.doc_id][1] for r in got if held(r.doc_id) and r.doc_id < 400]
    assert len(told) > 50 and np.mean(told) > 0.95
    toxic = toxicity.query(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in toxic) == Counter(d[0] for d in docs)
    assert np.mean([r.toxic == labels[r.doc_id][2] for r in toxic if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4]) > 0.98
    assert len({r.toxic_score for r in toxic if r.doc_id == 3}) == 1


def test_classifiers(spark, docs):
    good = [(i, " ".join(random.choice(VOCAB) for _ in range(80)), None) for i in range(200)]
    rows = [(i, t if i % 4 else "BUY!!! $$$ " * 30, s) for i, t, s in good]
    rows = [(i, t + (" you idiot" if i % 5 == 1 else ""), s) for i, t, s in rows]
    df = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 1)) for i in range(200)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    scored = quality.score_documents(df, labels).collect()
    assert len(scored) == 201 and np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in scored if r.doc_id is not None]) > 0.97
    toxic = toxicity.score_toxicity(df, labels).collect()
    assert len(toxic) == 201 and all(r.toxic == int(r.doc_id % 5 == 1) for r in toxic if r.doc_id is not None)
    none = labels.limit(0)
    assert {r.score for r in quality.score_documents(df, none).collect()} == {0.5}
    assert {r.toxic for r in toxicity.score_toxicity(df, none).collect()} == {0}
