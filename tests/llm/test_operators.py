"""The dealt operators against brute force on small tables with every odd case."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import bpe, bwt, fingerprints, langid, mixing, probminhash, recompression, sharding, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _rid long, key string"


def make(spark, rows):
    """rows of (doc_id, text, lang, source), with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 0.5, 7, "k") for i, t, lang, source in rows], SCHEMA)


def prose(rng, n, words=400):
    vocabulary = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "ra", "so") for b in ("dan", "fer", "gil", "tos", "vum", "x", "é")] + ["the", "of", "and"]
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(rng.randint(n, words)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(14)]
    shared = prose(rng, 90, 120)
    texts = [*base, base[0], base[0], base[1] + " end", shared, base[2] + " " + shared, shared + "\n" + base[3], base[4][:300] * 3, "", None, " \t\n", "one", "x" * 700, "x" * 900, "a b " * 200, "ü" * 130 + " ß"]
    near = base[5].split(" ")
    for k in range(5):
        near = near.copy()
        near[7 + 11 * k] = "changed"
        texts.append(" ".join(near))
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null and repeated keys, repeated rows."""
    return make(spark, [*rows[:6], (None, rows[6][1], None, None), (None, rows[6][1], None, None), (3, rows[3][1], "en", "s0"), (3, rows[8][1], "en", "s0")])


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_probminhash_classes_match_brute_force(docs, rows, empty, odd):
    got = {r["doc_id"]: r["class_id"] for r in collected(probminhash.near_duplicate_classes(docs))}
    profiles = list(probminhash.Weights().profiles([(t or "").encode() for _, t, *_ in rows]))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or probminhash.probability_jaccard(profiles[i], profiles[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in range(len(rows))}
    assert probminhash.near_duplicate_classes(empty).count() == 0
    assert probminhash.near_duplicate_classes(odd).count() == odd.count()


def test_probability_jaccard_is_exact():
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(50):
        a, b = ({int(k): float(w) for k, w in zip(rng.choice(30, 12, False), rng.integers(1, 6, 12), strict=True)} for _ in range(2))
        want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in {*a} & {*b})
        pack = lambda m: (np.array(sorted(m), dtype=np.uint64), np.array([m[k] for k in sorted(m)]))
        assert probminhash.probability_jaccard(pack(a), pack(b)) == pytest.approx(want)


def test_probminhash_registers_estimate_probability_jaccard():
    rng = random.Random(5)
    a = prose(rng, 500, 600)
    b = a[: len(a) * 4 // 5] + " " + prose(rng, 100, 120)
    signatures = probminhash.signer(2000)([a.encode(), b.encode()])
    exact = probminhash.probability_jaccard(*probminhash.Weights().profiles([a.encode(), b.encode()]))
    assert (signatures[0] == signatures[1]).mean() == pytest.approx(exact, abs=0.05)


def test_all_links_finds_what_the_stars_miss(spark):
    """A hub and copies that are near it but not near each other, in one class all the same."""
    rng = random.Random(9)
    hub = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts = []
    for k in range(40):
        words = hub.copy()
        for j in range(6):
            words[(7 * k + 50 * j) % 300] = f"edit{k}x{j}"
        texts.append(" ".join(words))
    df = make(spark, [(i, t, None, None) for i, t in enumerate([*texts, " ".join(hub)])])
    assert {r["class_id"] for r in collected(probminhash.near_duplicate_classes(df))} == {0}


def test_near_duplicates_broadcast_no_nodes(spark, monkeypatch):
    from pagelode.llm import groups

    sent = []
    broadcast = groups.F.broadcast
    monkeypatch.setattr(groups, "LINKS_BROADCAST", 0)
    monkeypatch.setattr(groups.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(60)) for _ in range(30)]
    df = make(spark, [(i, f"{texts[i % 30]} end{i // 30}", None, None) for i in range(90)])
    assert {r["class_id"] for r in collected(probminhash.near_duplicate_classes(df))} == set(range(30))
    assert sent and max(sent) == 1


@pytest.mark.parametrize("n", [0, 1, 700])
def test_texts_of_nodes_lose_none(spark, monkeypatch, n):
    from pagelode.llm import groups

    monkeypatch.setattr(groups, "MAP_WORDS", 64)
    texts = spark.range(3000).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("node"), F.col("id").cast("string").alias("text"))
    got = [int(r["text"]) for r in groups.texts_of(texts.union(texts), texts.filter(f"int(text) < {n}").select("node"), n).collect()]
    assert len(got) == len(set(got)) and set(range(n)) <= set(got) and len(got) < 1500


@pytest.mark.parametrize("limit", [0, 200_000])
def test_components_match_union_find(spark, monkeypatch, limit):
    from pagelode.llm import groups

    monkeypatch.setattr(groups, "LINKS_BROADCAST", limit)
    rng = random.Random(limit)
    edges = [(f"{rng.randint(0, 60):03d}".encode(), f"{rng.randint(0, 60):03d}".encode()) for _ in range(45)] + [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(100, 120)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = groups.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary"))
    want = {n: root(n) for e in edges for n in e if e[0] != e[1]}
    assert {bytes(r["node"]): bytes(r["label"]) for r in got.collect()} == want


def test_fingerprints(docs, rows, empty, odd):
    got = {r["doc_id"]: r for r in collected(fingerprints.compare_following(docs))}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t)] for i in range(max(1, len(w) - 4))} if WORD.findall(t) else set()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    by = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, *_) in enumerate(by):
        t, following = t or "", by[(k + 1) % len(by)][1] or ""
        changed = fingerprints.edited(t, following)
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == pytest.approx(like(shingles(t), shingles(changed)), abs=0.2)
        assert got[i]["near_next"] == pytest.approx(like(shingles(t), shingles(following)), abs=0.2)
    prints = {r["fingerprint"] for r in got.values()}
    assert got[0]["fingerprint"] == got[14]["fingerprint"] and len(prints) <= len({(t or "").strip() for _, t, *_ in rows})
    assert fingerprints.compare_following(empty).count() == 0
    assert fingerprints.compare_following(odd).count() == odd.count()
    parent = list(range(len(rows)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles(rows[i][1] or ""), shingles(rows[j][1] or "")
            if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) >= 0.8 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {r["doc_id"]: r["class_id"] for r in collected(fingerprints.near_duplicates(docs))} == {i: root(i) for i in range(len(rows))}
    assert fingerprints.near_duplicates(empty).count() == 0


def test_following_rows_at_every_boundary(spark, odd):
    """Many ranges, ties and null keys: the successors form one cycle through all rows."""
    df = make(spark, [(i * 7 % 1000, f"text {i}", None, None) for i in range(1000)] + [(None, "none", None, None), (5, "again", None, None), (-(1 << 63), "least", None, None)])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = collected(fingerprints.with_following(df, "doc_id", "text").select("to", "halo", "order", "text", F.spark_partition_id().alias("part")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    ranges = collections.defaultdict(list)
    for r in got:
        ranges[r["to"]].append(r)
    assert len(ranges) > 30 and all(len({r["part"] for r in own}) == 1 for own in ranges.values())
    chain = [r["text"] for to in sorted(ranges) for r in ranges[to] if not r["halo"]]
    want = sorted([(-(i * 7 % 1000), f"text {i}") for i in range(1000)] + [(1 << 63, "none"), (-5, "again"), (1 << 63, "least")])
    assert chain == [t for _, t in want]
    for to, own in ranges.items():
        at = chain.index([r["text"] for r in own if not r["halo"]][-1])
        assert next(r["text"] for r in own if r["halo"]) == chain[(at + 1) % len(chain)]


def test_sharding(spark, docs, rows, empty, odd):
    got = collected(sharding.shuffle_into_shards(docs, bucket_rows=4))
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    slots = collections.defaultdict(list)
    for r in got:
        raw = (rows[r["doc_id"]][1] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in collected(sharding.shuffle_into_shards(docs.repartition(5), bucket_rows=4))}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in collected(sharding.shuffle_into_shards(docs, bucket_rows=4))}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sharding.shuffle_into_shards(empty).count() == 0
    assert sharding.shuffle_into_shards(odd).count() == odd.count()
    spread = spark.range(20000).select(sharding.rendezvous(F.col("id"), 8, 1).alias("s")).groupBy("s").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 1.1 * min(r["count"] for r in spread)


def test_written_shards_hold_all_columns(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), carry=("source",), bucket_rows=2)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(i, t) for i, t, *_ in rows}
    slots = {r["doc_id"]: (r["shard"], r["slot"]) for r in collected(sharding.shuffle_into_shards(docs, bucket_rows=2))}
    order = [r["doc_id"] for r in got.orderBy("shard", "bucket", "_pos").collect()]
    assert order == sorted(order, key=slots.get) and len({slots[i] for i in order}) == len(order)


def test_toxicity(spark, empty):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "ol", "ur", "et")]
    bad = ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        if toxic:
            for _ in range(max(3, len(text) // 40)):
                text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text) if i % 50 else "", None, None))
        labels.append((i, int(toxic and bool(i % 50))))
    docs = make(spark, [*rows, (400, None, None, None), (401, "vile rotten foul vile " + "ban " * 60, None, None)])
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    got = {r["doc_id"]: r for r in collected(toxicity.score_texts(docs, model))}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == dict(labels)[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[400]["predicted"] == 0 and got[400]["spans"] == []
    assert got[401]["spans"][0]["start"] == 0 and got[401]["spans"][0]["end"] == 21
    assert toxicity.score_texts(empty, model).count() == 0
    assert toxicity.drop_toxic(docs, model).count() == sum(r["predicted"] == 0 for r in got.values())
    nothing = toxicity.fit(docs, table.filter("false"))
    assert {r["predicted"] for r in collected(toxicity.score_texts(docs, nothing))} == {0}


def small_chain(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    chain = toxicity.Chain()
    for t in (chain.own, chain.left, chain.right):
        t[:] = rng.normal(size=len(t))
    chain.own[0] = 0
    chain.start, chain.step = rng.normal(size=2), rng.normal(size=(2, 2))
    return chain


def enumerated(chain, emit):
    """P(toxic) of each token by adding up all labellings."""
    scores = {}
    for labels in np.ndindex(*[2] * len(emit)):
        s = chain.start[labels[0]] + sum(chain.step[a, b] for a, b in zip(labels, labels[1:], strict=False)) + sum(e for e, y in zip(emit, labels, strict=True) if y)
        scores[labels] = math.exp(s)
    return [sum(v for y, v in scores.items() if y[t]) / sum(scores.values()) for t in range(len(emit))]


def slowly_emitted(chain, tokens):
    """The log weights of label 1, feature by feature."""
    slots = [toxicity.features([t])[0][0] for t in tokens]
    out = []
    for i, own in enumerate(slots):
        e = sum(chain.own[s] for s in own)
        e += chain.left[slots[i - 1][0]] if i else 0
        e += chain.right[slots[i + 1][0]] if i + 1 < len(slots) else 0
        out.append(e)
    return out


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_marginals_match_enumeration(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK_TOKENS", chunk)
    chain = small_chain(2)
    texts = ["Vile", "you ROTTEN, rotten fool", "", None, "İ vile word", "ΣΑΣ straße_x 12", "a b c d e f g h i"] + ["filler text"] * 40 + ["über İİ foul"]
    toxic, lengths = toxicity.ToxicityModel(chain, np.zeros(2)).marginals(texts)
    assert lengths.tolist() == [len(toxicity.TOKENS.findall(t or "")) for t in texts]
    at = 0
    for t, n in zip(texts, lengths, strict=True):
        want = enumerated(chain, slowly_emitted(chain, toxicity.TOKENS.findall(t or ""))) if n else []
        assert toxic[at : at + n] == pytest.approx(want)
        at += n


def test_chain_learns_from_neighbours(monkeypatch):
    """The same form is toxic after one word and clean after another."""
    rng = random.Random(3)
    texts, labels = [], []
    for _ in range(300):
        words, y = [], []
        for _ in range(20):
            kind = rng.randrange(3)
            words += [["you", "dog"], ["the", "dog"], [rng.choice("abcdef") * 3]][kind]
            y += [[0.0, 1.0], [0.0, 0.0], [0.0]][kind]
        texts.append(" ".join(words))
        labels.append(np.array(y))
    slots, _, lengths = toxicity.features(texts)
    chain = toxicity.Chain()
    chain.fit(np.split(slots, np.cumsum(lengths)[:-1]), labels)
    toxic, _ = toxicity.ToxicityModel(chain, np.zeros(2)).marginals(["abc you dog aaa the dog"])
    assert (toxic >= 0.5).tolist() == [False, False, True, False, False, False]


def test_toxicity_scores_and_offsets_by_hand(spark, odd, rows):
    chain = small_chain(7)
    chain.own[:] = -9.0
    chain.own[0] = 0.0
    chain.left[:], chain.right[:], chain.step[:], chain.start[:] = 0, 0, 0, 0
    for form in ("vile", "foul"):
        chain.own[toxicity.features([form])[0][0][0]] = 400.0
    model = toxicity.ToxicityModel(chain, np.array([-1.0, 1.5]), (1e-3, 1e-1))
    long = "plain " * 200_000 + "vile " * 30_000
    given = ["İ vile word", "a FOUL vile, x foul", "", None, "none", long, "viles"]
    got = {r["doc_id"]: r for r in collected(toxicity.score_texts(make(spark, [(i, t, None, None) for i, t in enumerate(given)]), model))}
    assert [[(t or "")[x["start"] : x["end"]] for x in got[i]["spans"]] for i, t in enumerate(given[:5])] == [["vile"], ["FOUL vile", "foul"], [], [], []]
    assert [(x["start"], x["end"]) for x in got[5]["spans"]] == [(1_200_000, len(long) - 1)] and got[6]["spans"] == []
    for i, t in enumerate(given):
        words = toxicity.TOKENS.findall(t or "")
        bad = sum(w.lower() in ("vile", "foul") for w in words)
        evidence = min(max(bad * math.log(100) - len(words) * (1e-1 - 1e-3), -5), 5)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(1.0 - 1.5 * evidence)), rel=1e-2)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    pairs = collections.Counter((r["doc_id"], round(r["score"], 9)) for r in collected(toxicity.score_texts(odd, model)))
    want = collections.Counter((r["doc_id"], round(float(model.score([r["text"]])[0][0]), 9)) for r in odd.collect())
    assert pairs == want
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (0, None), (10**9, 1), (1, 0)], "doc_id long, toxic int")
    fitted = toxicity.fit(odd, labels)
    assert toxicity.score_texts(odd, fitted).count() == odd.count()
    assert toxicity.fit(odd.filter("false"), labels).chain is None


def test_bpe(spark, docs, rows, empty, odd):
    import regex

    ranks, pattern = bpe.default_ranks()
    encoder = bpe.ByteBPE(ranks, pattern)
    pieces = lambda t: [i for m in regex.finditer(pattern, t) for i in encoder.encoding._encode_single_piece(m[0])]
    long = [(100 + k, t, None, None) for k, t in enumerate(["a" * 300_000, "a" + " " * 200_000 + "b", "word  \n\n two's 12" * 9000, "<|endoftext|>'ll", "é" * 150_000])]
    both = docs.unionByName(make(spark, long))
    got = {r["doc_id"]: r for r in collected(bpe.bpe_encode(both, ranks, pattern, digests=True))}
    for i, t, *_ in [*rows, *long]:
        t = t or ""
        want = pieces(t) if len(t) < 20_000 else encoder.encoding.encode_ordinary(t)
        r = got[i]
        assert r["token_ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["decoded"]) for r in collected(bpe.bpe_decode(bpe.bpe_encode(docs, ranks, pattern), ranks, pattern))}
    assert back == {i: (t or "").encode() for i, t, *_ in rows}
    assert bpe.bpe_encode(empty, ranks, pattern).count() == 0
    assert bpe.bpe_encode(odd, ranks, pattern).count() == odd.count()


def test_topk(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    vectors = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(6)] + [(306, None), (307, [1.0, None] + [0.0] * 18), (308, [float("nan")] * 20), (309, [float("inf")] * 20), (310, [1.0, 2.0]), (350, [0.5] * 20)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int").repartition(3)
    ok = {i: [math.floor(256 * np.float32(x)) for x in v] + [0] * (20 - len(v)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in ok if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    for size in (16 << 20, 400):
        got = collected(topk.top_k(df, F.col("vec_id") % 50 == 0, query_bytes=size, candidate_bytes=size))
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_many_queries(spark):
    """More queries in a cell than candidates are looked at together."""
    rng, n, asking = np.random.Generator(np.random.PCG64(6)), 6000, topk.CANDIDATES + 100
    whole = rng.integers(-60, 60, (n, 12))
    whole[3000:3040] = whole[17]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in enumerate(whole.tolist())], "vec_id long, embedding array<double>").repartition(3)
    scores = whole[:asking] @ whole.T
    scores[np.arange(asking), np.arange(asking)] = -(1 << 40)
    want = np.argsort(-scores, 1, kind="stable")[:, :5]
    got = collected(topk.top_k(df, F.col("vec_id") < asking))
    assert len(got) == 5 * asking
    for r in got:
        i = want[r["query_id"], r["rank"] - 1]
        assert (r["vec_id"], r["score"]) == (i, scores[r["query_id"], i])


def test_searcher_prunes_without_loss(monkeypatch):
    """Decaying, even, equal and far candidates, in rising order of the ids or not, against brute force."""
    monkeypatch.setattr(topk, "MANY", 0.2)
    monkeypatch.setattr(topk, "FEW", 0.1)
    rng = np.random.Generator(np.random.PCG64(7))
    for decay, rising in itertools.product((1.0, 0.9), (True, False)):
        middles = rng.normal(size=(20, 60)) * decay ** np.arange(60)
        whole = np.floor(256 * (middles[rng.integers(0, 20, 6000)] + 0.4 * rng.normal(size=(6000, 60)) * decay ** np.arange(60)))
        whole[2000:2300], whole[4000] = whole[5], 1e6
        ids = np.arange(6000) if rising else rng.permutation(6000)
        searcher = topk.Searcher(ids[:200], whole[:200], 5)
        for start in range(0, 6000, 500):
            searcher.show(ids[start : start + 500], whole[start : start + 500])
        assert max(searcher.opening) < 8
        for q in range(200):
            scores = whole.astype(np.int64) @ whole[q].astype(np.int64)
            first = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
            assert searcher.best_ids[q].tolist() == ids[first].tolist() and searcher.best[q].tolist() == scores[first].tolist()


def test_topk_of_null_vectors_and_huge_queries(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [0.0, 0.0]), (2, []), (3, [0.0, -1.0])], "vec_id long, embedding array<double>")
    got = collected(topk.top_k(df, F.col("vec_id") == 0))
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 0), (2, 2, 0), (3, 3, -65536)]


def test_topk_is_exact_for_large_components(spark):
    """Sums beyond float64 and beyond a long, null and repeated ids, equal vectors."""
    rng = random.Random(5)
    vectors = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 4, 6, 7]) for _ in range(12)]) for i in range(120)]
    vectors += [(120, [1e300] * 12), (150, [-1e300, 3.0]), (151, [5e6 + i for i in range(12)]), (152, [5e6 + i for i in range(12)]), (152, [2.0]), (50, vectors[50][1]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, cell int").repartition(3)
    whole = [(i, [int(math.floor(256 * x)) if abs(x) < 1e15 else int(256 * x) for x in v] + [0] * (12 - len(v))) for i, v in vectors if i is not None]
    want = set()
    for q in {i for i, _ in whole if i % 50 == 0}:
        own = dict(reversed(whole))[q]
        clipped = sorted((-min(max(sum(a * b for a, b in zip(own, v, strict=True)), -(1 << 63)), (1 << 63) - 1), i) for i, v in whole if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(clipped)}
    got = collected(topk.top_k(df, F.col("vec_id") % 50 == 0, query_bytes=100, candidate_bytes=1000))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)


def test_repeated_windows_match_counting():
    rng = random.Random(1)
    for _ in range(150):
        w, letters = rng.choice([3, 5, 8, 20]), b"abcd"[: rng.choice([1, 2, 3, 4])]
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(w, 60))) for _ in range(rng.randint(1, 8))]
        pieces += [pieces[0][:-1] + b"d"] if rng.random() < 0.5 else []
        counts = collections.Counter(p[i : i + w] for p in pieces for i in range(len(p) - w + 1))
        assert [x.tolist() for x in bwt.repeated_windows(pieces, w)] == [[counts[p[i : i + w]] > 1 for i in range(len(p) - w + 1)] for p in pieces]


def bytes_without_repeats(texts, window):
    raw = [(t or "").encode() for t in texts]
    counts = collections.Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if counts[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        yield len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(c for c, g in zip(r, gone, strict=True) if not g)


def test_suffix_dedup(docs, rows, empty, odd):
    want = dict(zip([r[0] for r in rows], bytes_without_repeats([r[1] for r in rows], 200), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in collected(bwt.without_repeats(docs))}
    assert got == want
    assert sum(w[1] for w in want.values()) > 3000
    assert bwt.without_repeats(empty).count() == 0
    odd_rows = odd.select("doc_id", "text").collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in collected(bwt.without_repeats(odd)))
    assert got == sorted((str(r["doc_id"]), *w[:2]) for r, w in zip(odd_rows, bytes_without_repeats([r["text"] for r in odd_rows], 200), strict=True))


def test_a_frequent_anchor_is_split(spark):
    """One passage in many texts, each in other surroundings, parts of which repeat; blocks hold few of its contexts."""
    rng = random.Random(21)
    line = "Licensed under the terms of the licence that stands in this very file, as is, without any warranty."
    letters = "abcdefghij "
    around = lambda n: "".join(rng.choice(letters) for _ in range(n))
    ends = [around(150) for _ in range(12)]
    texts = [around(rng.randint(60, 260)) + line + (rng.choice(ends) if i % 3 else around(120)) + around(40) for i in range(200)] + [around(20) + line * 4, line * 3]
    texts += [texts[5], texts[6][30:], texts[7][:-20] + "zz"]
    want = [(w[0], w[1], w[2]) for w in bytes_without_repeats(texts, 200)]
    df = make(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    rows = bwt.keyed(df, "doc_id", "text")
    for size in (1, 1 << 18):
        spans = {r["rid"]: r["spans"] for r in bwt.repeated_spans(rows, block_bytes=size).collect()}
        for i, t in enumerate(texts):
            own = spans.get(i, [])
            merged = bwt.merged(np.array([s["start"] for s in own], int), np.array([s["end"] for s in own], int), 200)
            assert (len(t), sum(b - a for a, b in merged), len(merged)) == want[i], (size, i)


def test_long_texts_are_scanned_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(bwt, "CHUNK", 500)
    rng = random.Random(8)
    texts = [prose(rng, 900, 1000) for _ in range(2)]
    texts.append(texts[0][700:2000] + texts[1][:900])
    found = collections.defaultdict(set)
    for which, first, n, core, *_ in bwt.ByteScanner().pieces([t.encode() for t in texts]):
        for w, f, k in zip(which, first, n, strict=True):
            found[int(w)] |= set(range(f, f + k))
    assert {w: len(s) for w, s in found.items()} == {i: len(t.encode()) - 199 for i, t in enumerate(texts)}


def words_without_earlier(rows, window):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in sorted(words, key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        yield i, (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))


def test_recompression(spark, docs, rows, empty, odd):
    want = dict(words_without_earlier([(r[0], r[1]) for r in rows], 50))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in collected(recompression.without_earlier(docs))}
    assert got == want
    assert sum(w[1] for w in want.values()) > 300
    assert recompression.without_earlier(empty).count() == 0
    assert recompression.without_earlier(odd).count() == odd.count()
    rng = random.Random(12)
    few = [" ".join(rng.choice("ab") for _ in range(rng.randint(40, 400))) for _ in range(30)] + ["a " * 300, "a " * 200 + "b " + "a " * 120, "a b " * 90]
    small = [(i, t) for i, t in enumerate(few)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in collected(recompression.without_earlier(make(spark, [(i, t, None, None) for i, t in small])))}
    assert got == dict(words_without_earlier(small, 50))


def thue_morse(n, a="ab", b="ba"):
    """Two strings of 2 * n letters that polynomials modulo 2**64 can't tell apart once they are long."""
    x, y = a, b
    while len(x) < 2 * n:
        x, y = x + y, y + x
    return x, y


def test_words_that_polynomials_confuse(spark):
    from pagelode.llm.shingles import Words

    for n in (16, 128, 512, 1024):
        x, y = thue_morse(n)
        hashes, counts = Words().of([x.encode(), y.encode(), f" {x}\n".encode()])
        assert counts.tolist() == [1, 1, 1] and hashes[0] == hashes[2] != hashes[1]
        common = [f"w{i}" for i in range(60)]
        first, second = common.copy(), common.copy()
        first[31], second[31] = x, y
        df = make(spark, [(1, " ".join(first), None, None), (2, " ".join(second), None, None), (3, "\t".join(first[2:]), None, None)])
        got = {r["doc_id"]: r["n_removed"] for r in collected(recompression.without_earlier(df))}
        assert got == {1: 0, 2: 0, 3: 58}
    assert len({r["class_id"] for r in collected(probminhash.near_duplicate_classes(make(spark, [(1, x, None, None), (2, y, None, None)])))}) == 2
    prints = {r["fingerprint"] for r in collected(fingerprints.fingerprint(make(spark, [(1, x, None, None), (2, y, None, None)])))}
    assert len(prints) == 2


def test_word_splitting_matches_a_pattern(monkeypatch):
    from pagelode.llm import shingles

    monkeypatch.setattr(shingles, "PIECE", 300)
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é\t\n\r\x0b\x0c  \x00\xa0") for _ in range(rng.choice([0, 1, 5, 40, 290, 1500]))) for _ in range(200)] + ["x" * 1000, " " * 1000, "a" * 299 + " b"]
    words = shingles.Words()
    seen = {}
    for which, counts, data, start, end, hashes in words.groups([t.encode() for t in texts]):
        ends = np.cumsum(counts)
        for k, i in enumerate(which):
            at = range(ends[k] - counts[k], ends[k])
            assert [data[start[j] : end[j]].decode() for j in at] == WORD.findall(texts[i])
            assert data[start[at[0]] : end[at[-1]]].decode() == " ".join(WORD.findall(texts[i])) if at else True
            for j in at:
                assert seen.setdefault(data[start[j] : end[j]], hashes[j]) == hashes[j]
    assert len(set(seen.values())) == len(seen)


def test_anchors_hang_on_the_window_alone():
    rng = np.random.Generator(np.random.PCG64(6))
    scanner = recompression.WordScanner()
    seen = {}
    for _ in range(60):
        window = rng.integers(0, 4, 50).astype(str)
        for _ in range(4):
            words = [*rng.integers(0, 4, rng.integers(0, 30)).astype(str), *window, *rng.integers(0, 4, rng.integers(0, 30)).astype(str)]
            for _, first, n, core, *_ in scanner.pieces([" ".join(words).encode()]):
                for f, k, c in zip(first, n, core, strict=True):
                    for s in range(f, f + k):
                        seen.setdefault(tuple(words[s : s + 50]), set()).add(int(c))
    assert all(len(c) == 1 for c in seen.values())


def test_mixing(spark, docs, rows, empty, odd):
    got = collected(mixing.mix(docs))
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    by = collections.defaultdict(int)
    for i, _, _, source in rows:
        by[source] += sizes[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, rest = {}, 1.5 * sum(by.values())
    free = set(order)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * by[s]}
        if not over:
            break
        target |= {s: 2.0 * by[s] for s in over}
        rest -= sum(target[s] for s in over)
        free -= over
    target |= share
    taken = collections.defaultdict(int)
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"] and r["source_size"] == by[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert sorted(r["doc_id"] for r in got) == sorted(sizes)
    largest = max(sizes.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    again = {r["doc_id"]: r["taken"] for r in collected(mixing.mix(docs.repartition(5)))}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd).count() == odd.count()


def test_mixing_keeps_words_over_many_documents(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 97 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'hot' else concat('s', id % 5) end").alias("source"))
    for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect():
        assert abs(r["k"] - r["t"]) <= 97


def test_language_id(spark, empty, odd):
    rng = random.Random(2)
    stems = {"aa": ["tha", "whe", "ing"], "bb": ["ñan", "cio", "los"], "cc": ["sch", "ung", "üb"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(30)), lang, None) for i in range(300) for lang in [sorted(stems)[i % 3]]]
    rows += [(300, None, "aa", None), (301, "12 34 !", "aa", None), (302, "日本", None, None)]
    docs = make(spark, rows)
    model = langid.fit(docs.filter(~langid.held_out(docs["doc_id"])))
    got = {r["doc_id"]: r for r in collected(langid.identify(docs, model))}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in held]) > 0.97
    assert got[300]["lang_pred"] == got[301]["lang_pred"] == "und" and got[302]["lang_pred"] in stems
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(odd, model).count() == odd.count()
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in collected(langid.identify(odd, none))} == {"und"}


def test_language_id_by_hand(spark, odd):
    """Scores of a small model added up piece by piece, and a long text."""
    texts = [(0, "the cat the dog", "en", None), (2, "le chat le chien", "fr", None), (3, "the hat, the ÉTÉ", "en", None), (5, "le chien été", "fr", None), (6, "solo", "it", None)]
    docs = make(spark, texts)
    model = langid.fit(docs)
    langs = sorted({r[2] for r in texts})
    words = {lang: collections.Counter(w for _, t, own, _ in texts if own == lang for w in re.findall(r"[^\W\d_]+", t.lower())) for lang in langs}
    pieces = {n: {lang: collections.Counter() for lang in langs} for n in range(1, 6)}
    for lang in langs:
        for w, k in words[lang].items():
            for n in pieces:
                for i in range(len(w) + 3 - n):
                    pieces[n][lang][f"^{w}$"[i : i + n]] += k

    def row(table, piece):
        kept = [p for p in set().union(*table.values()) if sum(table[x][p] for x in langs) >= 2]
        if piece not in kept:
            return None
        logs = [math.log((table[x][piece] + 0.5) / sum(table[x][p] + 0.5 for p in kept)) for x in langs]
        return [v - sum(logs) / len(langs) for v in logs]

    def predicted(text):
        total = [0.0] * len(langs)
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        for w in found:
            rows = [row(words, w)] if row(words, w) else []
            for n in (5, 4, 3, 2, 1):
                grams = [row(pieces[n], f"^{w}$"[i : i + n]) for i in range(len(w) + 3 - n)]
                rows = rows or [r for r in grams if r]
            for r in rows:
                total = [t + v / len(rows) for t, v in zip(total, r, strict=True)]
        if not found:
            return "und", 0.0
        shares = [math.exp(t - max(total)) for t in total]
        return langs[shares.index(max(shares))], max(shares) / sum(shares)

    asked = ["the chien", "lechat", "thehat dog été", "", None, "123", "zzz", "solo soli", "cat " * 3]
    long = "the " * 300_000 + "le " * 100
    got = {r["doc_id"]: r for r in collected(langid.identify(make(spark, [(i, t, None, None) for i, t in enumerate([*asked, long])]), model))}
    for i, t in enumerate(asked):
        want = predicted(t)
        assert (got[i]["lang_pred"], got[i]["score"]) == (want[0], pytest.approx(want[1])), t
    assert got[len(asked)]["lang_pred"] == "en" and got[len(asked)]["score"] == pytest.approx(1.0)


def test_mixing_spreads_copies_of_one_row(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one row of five words").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(df.unionByName(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("t").alias("source"))))
    for r in got.groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.count("*").alias("n"), F.max("copies").alias("most")).collect():
        assert abs(r["k"] - r["t"]) <= 5 and r["n"] == {"s": 4000, "t": 100}[r["source"]] and r["most"] <= 2


def near_pairs(rows):
    """All pairs of keys whose texts are near, by comparing everything with everything."""
    profiles = list(probminhash.Weights().profiles([t.encode() for _, t in rows]))
    by = collections.defaultdict(list)
    for i, (keys, _) in enumerate(profiles):
        for k in keys.tolist():
            by[k].append(i)
    pairs = {(a, b) for held in by.values() for x, a in enumerate(held) for b in held[x + 1 :]}
    return [(a, b) for a, b in pairs if probminhash.probability_jaccard(profiles[a], profiles[b]) >= 0.8]


def test_probminhash_finds_every_near_link(spark):
    """Copies with few and with many edits, around the threshold: no link between different texts is lost."""
    rng = random.Random(31)
    texts = []
    for _ in range(60):
        words = prose(rng, 200, 300).split()
        texts.append(" ".join(words))
        for _ in range(4):
            copy = words.copy()
            for _ in range(rng.randint(1, 9)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    links = near_pairs(rows)
    parent = list(range(len(rows)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert 100 < len(links) < 600
    got = {r["doc_id"]: r["class_id"] for r in collected(probminhash.near_duplicate_classes(make(spark, [(i, t, None, None) for i, t in rows])))}
    assert got == {i: root(i) for i, _ in rows}


def test_texts_of_more_than_a_piece(spark):
    """Long texts through the word operators: equal passages across the cuts are found, near copies are near."""
    rng = random.Random(41)
    words = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in ("n", "rt", "st", "xx")]
    long = " ".join(rng.choice(words) for _ in range(250_000))
    assert len(long) > 2 * (1 << 19)
    other = long.split(" ")
    other[100_000] = "changed"
    rows = [(1, long), (2, " ".join(other)), (3, " ".join(other[150_000:150_120])), (4, "x" * (1 << 20) + " tail")]
    df = make(spark, [(i, t, None, None) for i, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in collected(probminhash.near_duplicate_classes(df))}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in collected(recompression.without_earlier(df))}
    assert removed == {1: (250_000, 0), 2: (250_000, 249_999), 3: (120, 120), 4: (2, 0)}
    spans = {r["doc_id"]: r["n_removed"] for r in collected(bwt.without_repeats(df))}
    assert spans[4] == (1 << 20) and spans[3] == len(rows[2][1]) and spans[1] > 0.99 * len(long)
    prints = {r["doc_id"]: r["fingerprint"] for r in collected(fingerprints.fingerprint(df))}
    assert sum(a == b for a, b in zip(prints[1], prints[2], strict=True)) > 0.95 * len(prints[1])
