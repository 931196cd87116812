"""The training-data operators on small fixtures, against brute force, round trips and held-out labels."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

public_tokenizers = pytest.importorskip("public_tokenizers")

from corpuslab.llm import ann, bpe, html_extract, licenses, mixing, quality_gam, quality_rules, queries, sharding, simhash, textstats, token_file  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "The cat sat on the mat.\nThe dog ran.\nThe cat sat on the mat.", "en", "b", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "Ça va? naïve café 北京 12345 don't  two  spaces\t\ttab nbsp　wide", "fr", "b", 9),
    (5, LONG, "en", "b", len(LONG)), (6, "same text here with more than five words", "en", "c", 3), (7, "same text here with more than five words", "en", "c", 3), (7, "same text here with more than five words", "en", "c", 3),
    (None, "no id at all but some words", "en", "a", 2), (8, "é́ \U0001f600\U0001f600 a\x01b\x02c <|endoftext|> ' 's 'll", "en", "", 5), (9, " \n\t ", "en", "a", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    # An extra column whose name the operators use inside.
    return spark.createDataFrame([(*r, "x") for r in ROWS], DOCS + ", size string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("limit, bucket", [(1 << 20, 1 << 20), (300, 7)])
def test_bpe_is_the_librarys(docs, tokenizer, encoding, limit, bucket):
    out = bpe.decode(bpe.encode(docs, tokenizer, ["text", "size", "doc_id"], limit, bucket), tokenizer).collect()
    assert len(out) == len(ROWS)
    for r in out:
        ids = encoding.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["ids_text"] == " ".join(map(str, ids)) and r["size"] == "x"
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_of_nothing(empty, tokenizer):
    assert bpe.encode(empty, tokenizer, ["doc_id"]).count() == 0
    assert bpe.encode(empty.sparkSession.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), tokenizer, ["doc_id"]).select(F.size("ids")).collect() == [(0,), (0,)]


def test_bpe_of_long_words(spark, tokenizer, encoding):
    """Words of many thousand bytes: one piece again and again, few letters, letters of three bytes, and each length about the limit."""
    r = random.Random(11)
    texts = ["a" * 100_000, "-" * 9_999, "=" * 4_001, "".join(r.choice("ACGT") for _ in range(20_000)), "".join(chr(r.randrange(0x4E00, 0x5000)) for _ in range(3_000)), "aab" * 500]
    texts += ["".join(r.choice("ab") for _ in range(n)) for n in range(bpe.LONG - 3, bpe.LONG + 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for x in bpe.encode(df, tokenizer, ["text"], limit=1).collect():
        assert x["ids"] == encoding.encode_ordinary(x["text"])


def test_rank_map(tokenizer):
    """Every pair stands in the map, and pairs that aren't in it aren't found."""
    entries = bpe.pairs(tokenizer.pieces)
    assert len(entries) == len(tokenizer.pieces) - 256 and all(tokenizer.pieces[a] + tokenizer.pieces[b] == tokenizer.pieces[c] and max(a, b) < c for a, b, c in entries)
    assert all(tokenizer.cells[tokenizer.shift[a] + b] == a << 40 | b << 20 | c for a, b, c in entries)
    with pytest.raises(ValueError):
        bpe.pairs([bytes([b]) for b in range(256)] + [b"abc"])


def test_packed_blocks():
    r = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.where(r.random(n) < 0.02, r.integers(0, 2**32 - 1, n), r.integers(300, 900, n)).astype(np.uint32)
        assert np.array_equal(token_file.unpack(token_file.pack(ids)), ids)
    data = token_file.pack(np.arange(5000, dtype=np.uint32) % 777)
    assert np.array_equal(token_file.unpack(data, 3, 5), (np.arange(5000) % 777)[3 * 512 : 5 * 512])
    assert np.array_equal(token_file.unpack(token_file.pack(np.full(600, 7, dtype=np.uint32))), np.full(600, 7))


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = sorted(token_file.round_trip(docs, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in ROWS], key=lambda x: (x is not None, x))
    texts, start = {r[0]: r[1] for r in ROWS}, 0
    for r in got:
        ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert token_file.round_trip(empty, path).count() == 0


def water_fill(sizes, weights, epochs):
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: epochs * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        more = {s for s in sizes if s not in full and target[s] > epochs * sizes[s]}
        if not more:
            return target
        full |= more


def test_mixture(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), "en", r.choice(["a", "b", "b", "b", "b", "c", None]), 0) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    source = {x[0]: x[3] for x in rows}
    sizes = collections.Counter()
    for x in rows:
        sizes[x[3]] += len(x[1].split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(names)}, 3)
    taken = collections.Counter()
    for x in got:
        s = source[x["doc_id"]]
        assert x["source_size"] == sizes[s] and math.isclose(x["target"], want[s], abs_tol=1e-5)
        assert x["taken"] <= 3 * x["size"]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    again = {(x["doc_id"], x["taken"]) for x in mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()}
    assert again == {(x["doc_id"], x["taken"]) for x in got}
    copies = collections.Counter(x["doc_id"] for x in mixing.repeat_documents(spark.createDataFrame(rows, DOCS)).collect())
    assert all(copies[x["doc_id"]] == x["repeats"] for x in got)


@pytest.mark.parametrize("copies", [500, 37])
def test_mixture_of_copies(spark, copies):
    """Rows that are equal in everything are taken in part: the source comes as near its target as by single rows."""
    text = " ".join(["w"] * 20)
    rows = [(None, text, "en", "a", 0)] * copies + [(i, " ".join(["v"] * (i % 30)), "en", "b", 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mixing.mix(df).collect()
    a = [r for r in got if r["source_size"] == 20 * copies]
    assert len(a) == copies and abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 20
    assert sum(r["taken"] for r in mixing.mix(df).collect()) == sum(r["taken"] for r in got)
    assert mixing.repeat_documents(df).where("doc_id IS NULL").count() == sum(r["repeats"] for r in a)


def test_mixture_edges(docs, empty):
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(empty).count() == 0
    assert mixing.repeat_documents(docs).columns == docs.columns and mixing.repeat_documents(empty).count() == 0


def test_shards(spark, docs, empty):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(1003)]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS)).collect()
    n = collections.Counter(r["shard"] for r in got)
    assert len(n) == 40 and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s]))
    source, total = {r[0]: r[3] for r in rows}, collections.Counter(r[3] for r in rows)
    for s in n:
        own = collections.Counter(source[r["doc_id"]] for r in got if r["shard"] == s)
        # Sources of one size move together, so the rest of a shard gives way to all of them.
        assert all(abs(own[x] - total[x] / 40) < (4 if x == "hot" else 2) for x in total)
    assert all(r["text_crc32"] == zlib.crc32(f"text {r['doc_id']}".encode()) for r in got)
    assert sharding.assign_shards(docs).count() == len(ROWS) and sharding.assign_shards(empty).count() == 0


def test_licences(spark, docs, empty):
    rows = [
        ("repo/LICENSE", "Released under the MIT License."), ("repo/src/a.py", "x = 1"), ("repo/src/deep/b.py", "# Licensed under the Apache License, Version 2.0.\n" + "y = compute(alpha, beta, gamma) + delta\n" * 9), ("repo/src/deep/c.py", "z"),
        ("other/d.py", "the license of this thing is complicated and long and says nothing"), (None, None), ("repo/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3.\nmore words that are not of it, quite many"), ("repo/vendor/e.c", "int e;"),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(rows)], "doc_id long, text string, p string")
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(df, F.col("p")).collect()}
    assert got == {0: ("MIT", "own"), 1: ("MIT", "inherited"), 2: ("Apache-2.0", "own"), 3: ("MIT", "inherited"), 4: (None, None), 5: (None, None), 6: ("GPL-3.0", "own"), 7: ("GPL-3.0", "inherited")}
    assert licenses.scan(docs, F.lit("a/b")).count() == len(ROWS) and licenses.scan(empty, F.lit("a/b")).count() == 0


def counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    at = {i + j for i, k in enumerate(zip(w, w[1:], w[2:])) if c[k] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), dup, len(at)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        own = [r.choice(words) for _ in range(r.randrange(60, 200))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + r.choice(["***", "$$$", "###"]) if bad else w for w in own), "en", "s", 0))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x[1] for x in labels}


def test_quality_rules(docs, empty, labelled, spark):
    own, labels, truth = labelled
    judged = quality_rules.judge(own, own, labels).collect()
    assert sum(r["kept"] == bool(truth[r["doc_id"]]) for r in judged) >= 590
    texts = {r[0]: r[1] for r in ROWS}
    for r in quality_rules.judge(docs, own, labels).collect():
        n, chars, symbols, dup, rep = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["kept"] and r["base_failed"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs, docs, none).count() == len(ROWS) and quality_rules.judge(empty, empty, none).count() == 0
    assert quality_rules.keep_good(docs, own, labels).columns == docs.columns


def test_quality_classifier(docs, empty, labelled, spark):
    own, labels, truth = labelled
    got = quality_gam.classify(own, own, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(quality_gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {r["doc_id"]: r["score"] for r in quality_gam.classify(own, own, flipped).collect()}
    assert all(r["score"] == other[r["doc_id"]] for r in got)
    assert all(0 <= r["score"] <= 1 for r in quality_gam.classify(docs, own, labels).collect())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_gam.classify(docs, docs, none).collect()} <= {quality_gam.sigmoid(math.log(1 / 1e-6))}
    assert quality_gam.classify(empty, empty, none).count() == 0 and quality_gam.keep_good(docs, own, labels).columns == docs.columns


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 24)).astype(np.float32)
    x[50:90] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] * 24), (320, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("extra"))
    got = collections.defaultdict(list)
    for h in sorted(ann.nearest(df, F.col("vec_id") % 20 == 0, block=4, slices=3).collect()):
        got[h["query_id"]].append((h["vec_id"], h["score"]))
    d = x.astype(np.float64)
    for q in range(0, 300, 20):
        s = d @ d[q]
        want = [j for j in np.lexsort((np.arange(300), -s)) if j != q][:20]
        assert [i for i, _ in got[q]] == want
        assert np.allclose([v for _, v in got[q]], s[want], rtol=1e-12)
    assert 320 not in got and ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_ties_at_any_scale(spark):
    """Equal candidates whose quantisation is exact: rounding must not drop the smaller ids."""
    r = np.random.default_rng(3)
    for scale in (1e9 / 3, 1e-7 / 7):
        base = r.integers(-127, 128, (1, 16)).astype(float)
        base[0, 0] = 127
        x = np.vstack([r.integers(-127, 128, (1, 16)) * 1.0, np.repeat(base, 60, axis=0)]) * scale
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = [h["vec_id"] for h in ann.nearest(df, F.col("vec_id") == 0, slices=2).orderBy("rank").collect()]
        assert got == list(range(1, 21))


def test_one_id_with_two_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(50, 8))
    df = spark.createDataFrame([(0, x[0].tolist()), (0, x[1].tolist()), *((i, x[i].tolist()) for i in range(2, 50))], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0, k=5, slices=3).collect()
    want = sorted((k + 1, int(j)) for q in (0, 1) for k, j in enumerate([j for j in np.argsort(-(x @ x[q])) if j > 1][:5]))
    assert sorted((h["rank"], h["vec_id"]) for h in got) == want


def test_simhash(spark, docs, empty):
    r = random.Random(7)
    base = [[f"w{r.randrange(3000)}" for _ in range(r.randrange(3, 120))] for _ in range(60)]
    rows = []
    for i in range(300):
        w = list(base[i % 60])
        for _ in range(r.randrange(0, 2)):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w), "en", "s", 0))
    df = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: x for x in simhash.near_duplicates(df).collect()}
    import xxhash

    def fp(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    f = {x[0]: fp(x[1]) for x in rows}
    assert all(got[i]["fp"] % (1 << 64) == f[i] for i in f)
    root = {i: i for i in f}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in f:
        for b in f:
            if a < b and (f[a] ^ f[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got[i]["component_id"] == find(i) for i in f)
    assert {x["doc_id"] for x in simhash.drop_copies(df).collect()} == {find(i) for i in f}
    edges = simhash.near_duplicates(docs).collect()
    assert len(edges) == len(ROWS) and {x["component_id"] for x in edges if x["doc_id"] in (2, 3, 9)} == {2}
    assert {x["component_id"] for x in edges if x["doc_id"] is None} == {None}
    assert simhash.near_duplicates(empty).count() == 0
    kept = [x["doc_id"] for x in simhash.drop_copies(docs).collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == [1, 2, 4, 5, 6, 8, None]


def test_simhash_hot_keys(spark):
    """Chunks of a hot key lose no link."""
    r = random.Random(8)
    center = r.getrandbits(64)
    fps = sorted({center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = simhash.components(simhash.links(df, 4, chunk=16)).collect()
    assert len({x["label"] for x in found}) == 1 and len(found) == len(fps)


def test_extraction(spark, empty):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=1>Home</a></nav><div id='cookie-notice'>We use cookies.</div>"
        "<!-- c --><article><h1>A &amp; B</h1><p>One  two\n three.<p>Four&nbsp;five &#233;.<div class='ad'>Buy!</div><aside>Side.</aside><form><label>Name</label></form><p>x < y</p><ul><li>i<li>j</ul></article>"
        "<section class='comments'><p>What a great article, I liked it very much and will come back.</p></section><footer>&copy; 1</footer></body></html>"
    )
    tree = html_extract.fit_tree()
    assert sum(html_extract.keeps(tree, r) != bool(y) for r, y in html_extract.TABLE) == 0
    assert html_extract.main_text(page, tree) == "A & B\n\nOne two three.\n\nFour five é.\n\nx < y\n\ni\n\nj"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<article>" + "<p>a</p>" * 20000), (5, "z", "<p class='x"), (1, "u", page)]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2]["text"] == "" == got[3]["text"] and got[4]["n_chars"] == 3 * 20000 - 2
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
