"""Near-duplicates, mixing, quality, URLs, media, neighbours, archives and the pipeline against plain versions."""

import hashlib
import io
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from veridelta.llm import ann, components, mixing, packing, quality, queries, simhash, tiff, urlfilter, warc
from veridelta.llm.common import public_vocabulary, table, tokenizer

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, prints[i], least.get(root(i))) for i, (d, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_fingerprints_and_components(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(odd_docs).collect()]
    assert order(got) == order(plain_components(rows))
    assert simhash.near_duplicates(no_docs).count() == 0


@here
def test_simhash_on_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.op4_simhash(spark, SF).collect()
    assert order((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == order(plain_components(rows))


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fps = np.r_[fps, fps[:50] ^ np.uint64(7), fps[:20] ^ np.uint64(15)]
    for radius in (0, 1, 3, 4, 5):
        q, lane = simhash.near(fps, simhash.bit_planes(fps), radius)
        got = {(a, b) for a, b in zip(q.tolist(), lane.tolist(), strict=True) if b < len(fps)}
        assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_large_buckets_are_cut(spark, monkeypatch):
    """A bucket over the chunk size gives the components that all its pairs would."""
    monkeypatch.setattr(simhash, "CHUNK", 20)
    rng = np.random.default_rng(3)
    fps = sorted({int(x) for x in (0b1 << 60) ^ sum((rng.integers(0, 2, 150).astype(np.int64) << b) for b in range(0, 40, 5))})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(frame).collect()]
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    mine = {frozenset(f for f in fps if root(f) == r) for r in map(root, fps)}
    parent = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    assert mine == {frozenset(f for f in fps if root(f) == r) for r in map(root, fps)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exponents(spark):
    totals = spark.createDataFrame([("+a", 10, 8000), ("+b", 10, 1000), ("+c", 10, 500), ("+d", 10, 500)], "mix_key string, docs long, tokens long")
    share = np.array([0.8, 0.1, 0.05, 0.05])

    def entropy(a):
        w = share**a / (share**a).sum()
        return -(w * np.log(w)).sum()

    a, z, total = mixing.find_exponent(totals, mixing.Targets(entropy=0.9, repetition=None))
    assert entropy(a) == pytest.approx(0.9 * np.log(4), abs=1e-4) and z == pytest.approx((share**a).sum())
    a, _, _ = mixing.find_exponent(totals, mixing.Targets(entropy=1.0, repetition=2.0))
    assert (0.8 / 0.05) ** (1 - a) == pytest.approx(2.0, abs=1e-3)
    assert mixing.find_exponent(totals, mixing.Targets(entropy=0.1, repetition=None))[0] == 1.0
    with pytest.raises(ValueError):
        mixing.find_exponent(totals, mixing.Targets(entropy=None, repetition=2.0, budget=50000))
    each = {r["mix_key"]: r["epochs"] for r in mixing.weights(totals, mixing.Targets(entropy=0.9, repetition=None)).collect()}
    assert each["+a"] == pytest.approx(1.0) and min(each.values()) == pytest.approx(1.0)


def test_schedule(spark, odd_docs, no_docs):
    rows = [(i, f"a b c {i}", "big") for i in range(600)] + [(1000 + i, "d e", "small") for i in range(40)] + [(1000, "d e", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = mixing.Targets(entropy=0.9, repetition=4.0, block=200)
    got = mixing.mix(docs, targets).collect()
    again = mixing.mix(docs.repartition(7), targets).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    seen = {}
    for r in got:
        seen.setdefault((r["source"], r["doc_id"]), []).append(r["epoch"])
    assert set(seen) == {(s, d) for d, _, s in rows} and all(len(e) == 1 for (s, _), e in seen.items() if s == "big")
    blocks = {}
    for r in got:
        blocks.setdefault(r["block"], []).append(r)
    for b, members in blocks.items():
        assert sorted(r["position"] for r in members) == list(range(len(members)))
        if b != max(blocks):
            for s in ("big", "small"):
                assert abs(sum(r["n_tokens"] for r in members if r["source"] == s) - next(r["weight"] for r in members if r["source"] == s) * 200) <= 8
    assert mixing.mix(no_docs).count() == 0
    odd = mixing.mix(odd_docs).collect()
    assert {r["doc_id"] for r in odd} == {r["doc_id"] for r in odd_docs.collect()} and any(r["source"] is None for r in odd)
    kept = mixing.mixed_rows(odd_docs)
    before, after = (Counter(map(str, df.collect())) for df in (odd_docs, kept))
    assert kept.columns == odd_docs.columns and set(before) == set(after) and all(after[r] >= n for r, n in before.items())


def test_schedule_against_a_plain_one(spark):
    """The schedule by its definition, source by source and document by document."""
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 30)), s) for s, n in (("a", 150), ("b", 40), (None, 9)) for i in range(n)] + [(3, "same row", "b")] * 30
    targets = mixing.Targets(entropy=0.97, repetition=3.0, block=120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r["source"]), r["doc_id"], r["n_tokens"], r["epoch"], r["block"]) for r in mixing.mix(docs, targets).collect())
    narrow = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), mixing.source_key(F.col("source")).alias("mix_key"), mixing.tokens(F.col("text")).alias("n_tokens"))
    each = mixing.numbered_copies(narrow).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("h", F.xxhash64(F.lit(targets.seed), "epoch", "id", "tie", "copy")).collect()
    total = Counter()
    for r in each:
        total[r["mix_key"]] += r["n_tokens"] * (r["epoch"] == 0)
    assert {r["n_tokens"] for r in each} == {max(1, len(tokenizer(public_vocabulary("byte_bpe_50k.json")).encode(t).ids)) for _, t, _ in rows}
    share = {s: n / sum(total.values()) for s, n in total.items()}

    def mixture(a):
        z = sum(v**a for v in share.values())
        return {s: v**a / z for s, v in share.items()}

    def entropy(w):
        return -sum(v * np.log(v) for v in w.values())

    def repeats(w):
        return max(w[s] / share[s] for s in w) / min(w[s] / share[s] for s in w)

    grid = np.linspace(0, 1, 20001)
    best = max(a for a in grid if entropy(mixture(a)) >= 0.97 * np.log(3))
    best = max(best, min(a for a in grid if repeats(mixture(a)) <= 3))
    weight = mixture(best)
    budget = sum(total.values()) / min(weight[s] / share[s] for s in weight)
    expected = []
    for s in total:
        epochs = weight[s] * budget / total[s]
        epochs = round(epochs) if abs(epochs - round(epochs)) < 1e-3 else epochs
        for e in range(int(np.ceil(epochs))):
            before = 0
            for r in sorted((r for r in each if r["mix_key"] == s and r["epoch"] == e), key=lambda r: (r["h"] % (1 << 64)) >> 11):
                if before < (epochs - e) * total[s] - 1e-3:
                    expected.append((str(None if s == "-" else s[1:]), r["id"], r["n_tokens"], e, int((e * total[s] + before) / (weight[s] * 120))))
                before += r["n_tokens"]
    expected.sort()
    assert len(got) == len(expected) and [g[:4] for g in got] == [x[:4] for x in expected]
    assert sum(g[4] != x[4] for g, x in zip(got, expected, strict=True)) <= len(got) // 200  # a place on a block's border may round


def test_different_sets_of_one_digest_stay_apart(spark, monkeypatch):
    """Digests of 4 bits make nearly every set collide; the second digest tells them apart."""
    from veridelta.llm import shingles

    whole = shingles.digest
    rows = spark.createDataFrame([(i, i % 3 + 1, c) for i, c in enumerate([5, 6, 7, 5, 6, 7])], "doc_id long, fp long, check long")
    rows = rows.select("doc_id", F.struct(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).alias("th"), (F.col("fp") * 0 + 1).alias("fp"), "check", F.array(F.lit(1)).alias("bands"), F.lit(b"").alias("sim"))
    nodes = simhash.shingle_nodes(rows)
    assert nodes.where("low != high").count() == 1
    apart = simhash.told_apart(rows, nodes).collect()
    assert len({r["fp"] for r in apart}) == 3 and all((r["fp"] == s["fp"]) == (r["check"] == s["check"]) for r in apart for s in apart)
    assert whole(np.array([1, 2], np.uint64)) != whole(np.array([1, 2], np.uint64), 8)


@here
def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r["doc_id"]: r for r in quality.scored(docs, labels).collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(g["held_out"] for g, _ in held) and np.mean([g["predicted"] == q for g, q in held]) > 0.97
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got.values())


def test_quality_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, 1), (None, 1), (9, None), (8, 1)], "doc_id long, quality int")
    got = quality.scored(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.scored(odd_docs, labels.where("quality = 0")).collect()} == {0.5}
    assert quality.scored(no_docs, labels).count() == 0


def test_prior_of_known_mixtures():
    """From scores of positives and of a mixture alone; negatives that score as positives do can only be told apart where they don't."""
    rng = np.random.default_rng(1)
    bins = lambda x: np.histogram(x, quality.BINS, (0, 1))[0].astype(float)
    for share in (0.1, 0.5, 0.9):
        n = int(20000 * share)
        mixture = np.r_[rng.beta(8, 2, n), rng.beta(2, 8, 20000 - n)]
        assert quality.estimate_prior(bins(rng.beta(8, 2, 3000)), bins(mixture)) == pytest.approx(share, abs=0.05)
    assert quality.estimate_prior(bins(np.full(5, 0.5)), bins(np.full(9, 0.5))) == 0.99 and quality.estimate_prior(np.zeros(quality.BINS), np.zeros(quality.BINS)) == 0.99


def test_negative_labels_change_nothing(spark, odd_docs):
    """The prior is estimated from positives and all documents, so labels of 0 may be there or not."""
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, 1), (9, 0), (8, 0)], "doc_id long, quality int")
    score = lambda some: sorted((str(r["doc_id"]), round(r["score"], 9)) for r in quality.scored(odd_docs, some).collect())
    assert score(labels) == score(labels.where("quality = 1"))


def test_non_negative_risk():
    """Against a plain minimiser: no step in any direction lowers the risk, whether its negative part is above, at or below zero."""
    rng = np.random.default_rng(0)
    moments = lambda x: (x.mean(axis=0), x.T @ x / len(x))
    seen = set()
    for prior, n, shift in ((0.3, 400, 1.0), (0.9, 5, 1.0), (0.6, 8, 0.3), (0.97, 4, 2.0), (0.5, 50, 0.0)):
        p, u = rng.normal(shift, 1, (n, 3)), rng.normal(0, 1, (500, 3))
        (mp, sp), (mu, su) = moments(p), moments(u)

        def parts(w):
            first = prior * (1 - 2 * w @ mp + w @ sp @ w) / 4
            return first, (1 + 2 * w @ mu + w @ su @ w) / 4 - prior * (1 + 2 * w @ mp + w @ sp @ w) / 4

        def risk(w):
            first, negatives = parts(w)
            return first + max(0.0, negatives) + quality.RIDGE * w @ w / 4

        w = quality.solve(prior, mp, sp, mu, su)
        seen.add(int(np.sign(round(parts(w)[1], 6))))
        best, step = w.copy(), 0.1
        while step > 1e-7:  # coordinate and random directions
            moves = [best + step * d for d in np.vstack([np.eye(3), -np.eye(3), rng.normal(size=(20, 3))])]
            lower = min(moves, key=risk)
            best, step = (lower, step) if risk(lower) < risk(best) - 1e-12 else (best, step / 2)
        assert risk(w) <= risk(best) + 1e-6
    assert len(seen) > 1


URLS = ["http://Example.NET/en/1", "https://a.b.example.net/en", "http://example.net/EN/", "http://x.net", "http://x.net/", "http://net/", "http://notexample.com/de/", "http://www.example.com/de/x?y#z", "http://example.com/d", "http://m.org/fr/1", "http://org/fr", "nonsense", None, "", "http://", "http:///net/", "http://a.net?/x", "http://a.net#/", "ftp://u.example.com/de/", "http://example.com/de/", "http://example.com/de/"]


def plain_verdict(url):
    rules = {("net", "/"): "block", ("example.com", "/de/"): "block", ("example.net", "/en/"): "allow", ("org", "/fr/"): "allow"}
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, keys string, a long")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(URLS)}
    assert urlfilter.judge(pages.where("false"), ["net/"], []).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(pages, ["net"], [])
    tables = [spark.createDataFrame([(r,) for r in rules], "rule string") for rules in (["net/", "Example.com/de/", None, "net/"], ["example.net/en/", "org/fr/"])]
    again = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, *tables).collect()}
    assert again == got
    none = urlfilter.judge(pages, tables[0].limit(0), [])
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.where("rule is not null").count() == 0


def test_lists_beyond_the_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MOST_BITS", 1)
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], "x", 1)], "page_id long, url string, row_number string, found long")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]).collect()]
    assert order(got) == order([(i, *plain_verdict(u)) for i, u in enumerate(URLS + URLS[:3])] + [(None, *plain_verdict(URLS[0]))])


def test_cascade_is_exact(spark):
    keys = spark.range(20000).select(F.col("id"), F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"))
    cascade = urlfilter.build_cascade(keys.select("a", "b"), keys.where("id % 7 = 0").select("a", "b"))
    rows = keys.collect()
    listed = cascade.lists(*(np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in "ab"))
    assert len(cascade.levels) > 2 and (listed == np.array([r["id"] % 7 == 0 for r in rows])).all()


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, tmp_path, name):
    queries.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = con.sql(f"select * from '{tmp_path}/out/*.parquet'")
    columns = ", ".join(sorted(ours.columns))
    a, b = (con.sql(f"select {columns} from ({q})").fetchall() for q in (f"select * from '{tmp_path}/out/*.parquet'", queries.ORACLE[name]))
    assert sorted(a, key=str) == sorted(b, key=str)


def test_tiff_codecs_and_layouts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 255, 3000, 40000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), bytes(n), (b"abcab" * n)[:n]):
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.unpack_bits(tiff.pack_bits(data)) == data
    images = [rng.integers(0, 9, (37, 50), dtype=np.uint8), np.arange(600, dtype=np.uint32).reshape(20, 30).astype(np.uint8)]
    for compression in tiff.ENCODERS:
        for predictor in (1, 2):
            for tile in (None, (16, 16), (16, 32)):
                got = [p.samples()[:, :, 0] for p in tiff.pages_of(tiff.write_tiff(images, compression, predictor, 8, tile))]
                assert len(got) == 2 and all((a == b).all() for a, b in zip(got, images, strict=True))


def test_tiff_known_bytes():
    """PackBits of a known text, and a big-endian 16-bit image."""
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    pixels = np.array([[1, 2], [300, 65535]], ">u2").tobytes()
    fields = [(256, 3, 1, 2 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 1, 8), (278, 3, 1, 2 << 16), (279, 4, 1, 8)]
    data = b"MM\0*" + (16).to_bytes(4, "big") + pixels + len(fields).to_bytes(2, "big") + b"".join(t.to_bytes(2, "big") + k.to_bytes(2, "big") + n.to_bytes(4, "big") + v.to_bytes(4, "big") for t, k, n, v in fields) + bytes(4)
    (page,) = tiff.pages_of(data)
    assert page.samples()[:, :, 0].tolist() == [[1, 2], [300, 65535]]
    with pytest.raises(ValueError):
        list(tiff.pages_of(b"GIF89a00"))


def test_tiff_rows(spark, odd_docs, no_docs, monkeypatch):
    got = tiff.text_media(odd_docs).collect()
    rows = odd_docs.collect()
    plain = []
    for r in rows:
        raw = (r["text"] or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        plain.append((r["doc_id"], len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert order(plain) == order((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got)
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (1, 2)}) == 1 and tiff.text_media(no_docs).count() == 0
    monkeypatch.setattr(tiff, "PAGE_ROWS", 4)
    files = spark.createDataFrame([(1, tiff.store_payload(bytes(range(256)) * 3)), (2, b"broken"), (3, None)], "doc_id long, media binary")
    kinds = [tiff.layout(str(i).encode()) for i in range(600)]
    assert {k["compression"] for k in kinds} == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE} and {k.get("predictor", 1) for k in kinds} == {1, 2} and any(k.get("tile") for k in kinds)
    good = tiff.store_payload(bytes(range(256)), compression=tiff.DEFLATE)
    huge, empty = bytearray(good), bytearray(good)
    at = int.from_bytes(good[4:8], "little") + 2
    for k in range(int.from_bytes(good[at - 2 : at], "little")):
        if good[at + 12 * k] == 0 or int.from_bytes(good[at + 12 * k : at + 12 * k + 2], "little") in (256, 257):
            huge[at + 12 * k + 8 : at + 12 * k + 12] = (2**31 - 1).to_bytes(4, "little")
        if int.from_bytes(good[at + 12 * k : at + 12 * k + 2], "little") == 273:
            empty[at + 12 * k + 4 : at + 12 * k + 8] = bytes(4)
    faulty = spark.createDataFrame([(1, bytes(huge)), (2, bytes(empty)), (3, bytes(good[:30]))], "doc_id long, media binary")
    assert [(r["page"], bool(r["error"])) for r in tiff.read_pages(faulty).collect()] == [(-1, True)] * 3
    pages = tiff.read_pages(files).orderBy("doc_id", "page").collect()
    assert [(r["doc_id"], r["page"]) for r in pages] == [(1, 0), (1, 1), (1, 2), (2, -1)] and pages[-1]["error"]
    assert b"".join(bytes(r["pixels"]) for r in pages[:3]) == bytes(range(256)) * 3


def plain_neighbours(rows, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = set()
    for q, a in ok.items():
        if q % 50 == 0:
            scored = sorted(((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12), i) for i, b in ok.items() if i != q and len(b) == len(a)))
            out |= {(q, n, i) for n, (_, i) in enumerate(scored[:k], 1)}
    return out


def test_neighbours_and_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(300, None), (350, [0.0] * 8), (400, [float("nan")] + [1.0] * 7), (450, [None] + [1.0] * 7), (500, []), (550, [1.0, 2.0]), (551, [2.0, 1.0]), (None, [1.0] * 8)]
    rows += [(600 + i, [1.0] * 8) for i in range(60)]  # one common vector
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, key int")
    got = ann.search(frame, F.col("vec_id") % 50 == 0, probes=3**ann.HASHES).collect()
    plain = plain_neighbours(rows)
    found = {(r["query_id"], r["rank"], r["vec_id"]) for r in got}
    assert {x for x in found if x[0] >= 550} == {x for x in plain if x[0] >= 550}
    assert len(found & plain) >= 0.9 * len(plain)
    vectors = dict(rows)
    for r in got:
        a, b = np.array(vectors[r["query_id"]]), np.array(vectors[r["vec_id"]])
        assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    assert ann.search(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_that_hashing_does_not_reach(spark):
    """Opposite vectors in a tiny table, and many scaled copies of one direction, whose ties go to the smaller ids."""
    rows = [(0, [1.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.1]), (2, [-1.0, 0.1, 0.0]), (3, [0.0, -1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for probes in (1, None):
        got = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(frame, F.col("vec_id") == 0, probes=probes).collect()}
        assert got == plain_neighbours(rows)
    rows = [(50, [1.0, 2.0, 3.0])] + [(100 - i, [float(x * (i + 2)) for x in (1, 2, 3)]) for i in range(30)] + [(7, [3.0, 2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["rank"]: r["vec_id"] for r in ann.search(frame, F.col("vec_id") == 50, k=30, probes=10).collect()}
    assert set(got.values()) == set(range(71, 101)) and len(got) == 30


@here
def test_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    found = {(r["query_id"], r["vec_id"]) for r in queries.op9_nearest(spark, "/root/testdata/sf0.01").collect()}
    plain = {(q, i) for q, _, i in plain_neighbours(rows)}
    assert len(found & plain) >= 0.9 * len(plain)


def test_probe_order():
    at = np.random.default_rng(0).uniform(0, 5, (3, 2, ann.HASHES))
    codes, cost = ann.probe_order(at)
    assert (np.diff(cost, axis=-1) >= 0).all() and (codes[..., 0] == ann.bucket_code(np.floor(at).astype(int))).all()


def test_archive_streams():
    out = io.BytesIO()
    writer = warc.Writer(out)
    payloads = [b"", b"x", b"\r\n\r\nWARC/1.1", bytes(range(256)) * 5000]
    for i, p in enumerate(payloads):
        writer.record([("WARC-Record-ID", str(i))], [p[k : k + 1000] for k in range(0, len(p), 1000)], len(p))
    back, chunks = {}, {}
    for h, n, data, seen, digest, last in warc.record_chunks(io.BytesIO(out.getvalue()), 4096):
        back[h["warc-record-id"]] = back.get(h["warc-record-id"], b"") + data
        chunks[h["warc-record-id"]] = n + 1
        assert len(data) <= 4096 and seen == len(back[h["warc-record-id"]]) and digest == hashlib.sha256(back[h["warc-record-id"]]).hexdigest() and last == (seen == len(payloads[int(h["warc-record-id"])]))
    assert [back[str(i)] for i in range(4)] == payloads and chunks["3"] == -(-len(payloads[3]) // 4096)
    with pytest.raises(ValueError):
        list(warc.record_chunks(io.BytesIO(b"no archive at all\r\n\r\n")))


def test_archives(spark):
    long, text = "y" * 5000, "z" * 100
    rows = [(5, "http://a/\r\nX: y", long), (2, None, long), (9, "http://b/", long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", text), (1, "u", text), (None, "u", text), (5, "u", long), (10, "u", "é" * 60)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(pages)
    got = warc.payloads(warc.read_archives(spark, manifest, with_data=False)).collect()
    plain = []
    for i, _, html in rows:
        raw = (html or "").encode()
        least = min(j for j, _, h in rows if j is not None and (h or "") == (html or ""))
        again = len(raw) >= 100 and i is not None and least < i
        plain.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None))
    assert sorted(map(str, plain)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    whole = warc.read_archives(spark, manifest, size=1000).where("page_id = 2").orderBy("chunk").collect()
    assert [r["chunk"] for r in whole] == [0, 1, 2, 3, 4] and b"".join(bytes(r["data"]) for r in whole) == long.encode() and [r["last"] for r in whole] == [False] * 4 + [True]
    assert warc.read_archives(spark, warc.write_archives(pages.where("false"))).count() == 0
    assert warc.read_archives(spark, warc.write_archives(pages.coalesce(1).where("page_id = 2").unionByName(pages.where("false")))).count() == 1


def test_archives_of_large_ids_long_urls_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    rows = [(2**53 + 3, "http://h/" + "u" * 100_000, "p" * 3000), (2**53 + 1, "a", "p" * 3000), (None, "b", "p" * 3000), (2**63 - 1, None, "q" * 1000), (7, "c", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.payloads(warc.read_archives(spark, manifest, with_data=False)).collect()}
    assert got == {2**53 + 3: (3000, "revisit", 2**53 + 1), 2**53 + 1: (3000, "response", None), None: (3000, "response", None), 2**63 - 1: (1000, "response", None), 7: (0, "response", None)}


@here
def test_pipeline_against_plain_version(spark):
    """The stages' decisions, taken again without Spark from the classifier's scores on."""
    docs = table(spark, SF, "documents")
    kept = corpus_pipeline.quality_filter(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, table(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, s in scores.items() if s >= corpus_pipeline.LEAST_SCORE}
    alone = corpus_pipeline.near_dedup(spark, kept, SF).cache()
    plain = plain_near_copies([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(plain)
    mixed = corpus_pipeline.source_mix(spark, alone, SF).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in alone.collect()}
    expected = [(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.token_pieces(mixed).collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == sorted(expected)


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        alone = corpus_pipeline.near_dedup(spark, docs, SF)
        assert alone.columns == docs.columns
        mixed = corpus_pipeline.source_mix(spark, alone, SF)
        assert mixed.select("doc_id").distinct().count() == alone.select("doc_id").distinct().count()
        assert corpus_pipeline.sequences(spark, mixed, SF).count() >= mixed.count()
    ids = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, odd_docs, SF).collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and None in ids


def plain_near_copies(rows, least=0.8):
    """(kept ids, pairs of ids of a similarity of 0.8 to 0.9) by all pairs of five-word shingle sets."""
    sets = []
    for _, t in rows:
        words = (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if not sets[i] | sets[j] or n >= least * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    return {min(d for k, (d, _) in enumerate(rows) if root(k) == r) for r in map(root, range(len(rows)))}


def planted_pairs(n, changed, words=200):
    """Texts of ``words`` words and copies with single words changed: each takes five shingles away."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        text = [f"w{x}" for x in rng.integers(0, 5000, words)]
        copy = list(text)
        for c in range(changed):
            copy[7 + c * (words // changed)] = f"new{i}x{c}"
        rows += [(i, " ".join(text)), (1000 + i, " ".join(copy))]
    return rows


def test_pipeline_joins_from_a_similarity_of_080(spark):
    for changed, joined in ((3, True), (4, True), (5, False), (8, False)):  # Jaccard 0.858, 0.815, 0.775 and 0.661
        rows = planted_pairs(60, changed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
        assert kept == plain_near_copies(rows) == {d for d, _ in rows if d < 1000 or not joined}


def test_wide_fingerprints_and_pair_lanes():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 2**64, (130, 4), dtype=np.uint64)
    for i in range(1, 130, 2):  # neighbours that differ in 1 to 129 bits
        bits = np.zeros(256, np.uint8)
        bits[rng.permutation(256)[:i]] = 1
        fps[i] = fps[i - 1] ^ np.packbits(bits).view(np.uint64)
    apart = np.array([[sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True)) for b in fps] for a in fps])
    for radius in (0, 1, 38, 63, 64):
        q, lane = simhash.near(fps, simhash.bit_planes(fps), radius)
        got = {(a, b) for a, b in zip(q.tolist(), lane.tolist(), strict=True) if b < len(fps)}
        assert got == set(zip(*map(list, np.nonzero(apart <= radius)), strict=True))
        a, b = (x.ravel() for x in np.indices(apart.shape))
        assert (simhash.near_pairs(fps, a, b, radius) == (apart <= radius).ravel()).all()


def test_links_of_sets_are_those_of_all_pairs():
    from veridelta.llm import shingles

    rng = np.random.default_rng(7)
    sets = [np.arange(40, dtype=np.int64)]
    for _ in range(60):
        s = sets[rng.integers(0, len(sets))].copy()
        s[rng.integers(0, 40, 5)] = rng.integers(100, 10**6, 5)
        sets.append(np.unique(s))
    alike = [(i, j) for i in range(61) for j in range(i) if len(both := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(both))]
    a, b = shingles.similar(sets, 0.8)
    labels = [simhash.star_labels(61, *map(np.array, zip(*pairs, strict=True))).tolist() for pairs in (alike, list(zip(a, b, strict=True)))]
    assert labels[0] == labels[1] and len(set(labels[0])) > 1
    asking, label = np.arange(61) % 3 == 0, np.arange(61)
    a, b = shingles.similar(sets, 0.8, asking, label)
    assert set(zip(a, b, strict=True)) == {(i, j) for pair in alike for i, j in (pair, pair[::-1]) if i % 3 == 0}


def test_large_and_null_ids_of_fingerprints(spark):
    big = 2**62 + 5
    rows = [(big, "a b c d e"), (None, "a b c d e"), (big + 1, "a b c d e"), (None, "x y z"), (2**63 - 1, "q")]
    got = {(r["doc_id"], r["component"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(big, big), (None, big), (big + 1, big), (None, None), (2**63 - 1, 2**63 - 1)}


def test_large_groups_of_near_copies_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "SETS", 8)
    base = [f"w{x}" for x in np.random.default_rng(5).integers(0, 900, 120)]
    rows = [(k, " ".join(base[:50] + [f"n{k // 2}"] * (k % 3) + base[50:])) for k in range(40)] + [(100 + k, " ".join(base[: 60 + 6 * k])) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == plain_near_copies(rows)


@here
def test_pipeline_near_copies_on_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table(spark, SF, "documents"), SF).collect()} == plain_near_copies(rows)


def test_different_texts_under_one_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(100)) for k in "abc")
    rows = [(5, a, 1), (5, a, 2), (5, b, 3), (3, b + " end", 4), (7, c, 5), (7, a[:200], 6), (7, a[:200], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert kept == sorted([(5, a), (3, b + " end"), (7, c), (7, a[:200])])
