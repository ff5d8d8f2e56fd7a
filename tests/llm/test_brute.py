"""The other queries against brute force, over the smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from conftest import DATA
from quarry.llm import queries as Q


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]


def run(spark, prefix):
    (name,) = [n for n in Q.queries() if n.startswith(prefix)]
    return [r.asDict() for r in Q.queries()[name](spark, DATA).collect()]


def test_bpe(spark, docs):
    import public_tokenizers as P
    import tiktoken

    from quarry.llm.bpe import load_ranks

    ranks = load_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in run(spark, "op4_")}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        ids = enc.encode_ordinary(text)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(raw).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}


def components(texts, width, top):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in held[g])
        for j, n in shared.items():
            if 100 * n >= top * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            held[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op6_")}
    assert got == components([d[:2] for d in docs], 3, 90)


def test_sharding(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op9_")}
    order = sorted(docs, key=lambda d: (hashlib.md5(d[1].encode()).digest(), d[0]))
    total, before, slots = sum(len(t.encode()) + 8 for _, t, _ in docs), 0, Counter()
    for i, t, _ in order:
        shard = before * 24 // total
        assert got[i] == {"doc_id": i, "size": len(t.encode()) + 8, "text_crc32": zlib.crc32(t.encode()), "law": "bytes", "shard": shard, "slot": slots[shard], "grown_shard": None}
        slots[shard] += 1
        before += len(t.encode()) + 8


def test_quality(spark, docs):
    rows = run(spark, "op7_")
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in docs)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) >= 0.8


def test_quality_held_out_accuracy(spark):
    (name,) = [n for n in Q.queries() if n.startswith("op7_")]
    d = "/root/testdata/sf0.01"
    out = Q.queries()[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in out if r["quality"] == 1], [r["score"] for r in out if r["quality"] == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95
    assert sum((r["predicted"] == r["quality"]) for r in out) / len(out) >= 0.93


def brute_leaks(texts, items, share=0.5):
    """Leaks by scores anew: every window of every text against every item."""
    import math
    import re

    cut = lambda t: re.findall(r"[^\W_]+(?:_+[^\W_]+)*|\w+", t.lower())  # noqa: E731  the fixture's words are plain
    words = {n: cut(t) for n, t in items}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    part = {n: {w: idf[w] * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, k in Counter(ws).items()} for n, ws in words.items()}

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    bounds, classes = 64, {}
    for n, ws in words.items():
        bounds = 64
        while len(ws) > bounds:
            bounds *= 4
        classes.setdefault(bounds, []).append(n)
    out = {}
    for i, text in texts:
        ws = cut(text or "")
        for own in classes.values():
            long = max(len(words[n]) for n in own)
            for at in range(0, max(len(ws) - long, 1), long):
                window = ws[at : at + 2 * long]
                have, grams = set(window), set(zip(window, window[1:], window[2:], strict=False))
                for n in own:
                    score = sum(w for t, w in part[n].items() if t in have)
                    if score < share * sum(part[n].values()) - 1e-9:
                        continue
                    said = [cut(s) for s in re.split(r"[.!?]+(?:\s+|$)", dict(items)[n])]
                    said = [x for x in said if x]
                    question, answer = ([w for s in said[:-1] for w in s], said[-1]) if len(said) > 1 else (words[n], words[n][-max(1, len(words[n]) // 4) :])
                    own_grams = list(zip(question, question[1:], question[2:], strict=False))
                    q = sum(g in grams for g in own_grams) / len(own_grams) if own_grams else lcs(question, window) / len(question)
                    if len(words[n]) < 5:
                        ok = any(window[k : k + len(words[n])] == words[n] for k in range(len(window)))
                    else:
                        ok = q >= 0.5 and lcs(answer, window) / len(answer) >= 0.5
                    if ok:
                        out[i, n] = max(out.get((i, n), 0), score / sum(part[n].values()))
    return out


def test_leaks(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in run(spark, "op10_")}
    assert {(i, n) for i, t, _ in docs for n, b in items if b in t} <= set(got)
    want = brute_leaks([d[:2] for d in docs], items)
    assert set(got) == set(want) and want
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_walk_misses_nothing():
    """The walk against plain sums, over random weights with many that just reach or miss the threshold."""
    import random

    import numpy as np

    from quarry.llm import decontam as D

    rng = random.Random(11)
    for size, items in ((12, 40), (60, 300), (5, 3)):
        weights = [{t: rng.choice([0.1, 0.25, 0.5, 0.9]) for t in rng.sample(range(size), rng.randint(1, min(6, size)))} for _ in range(items)]
        postings = D.Postings(weights, size, 10)
        passages = [sorted(rng.sample(range(size), rng.randint(0, size // 2))) for _ in range(50)]
        owner = np.array([p for p, ts in enumerate(passages) for _ in ts], np.int64)
        term = np.array([t for ts in passages for t in ts], np.int64)
        got = {(p, n): s for found in postings.walk(owner, term, len(passages)) for p, n, s in zip(*(x.tolist() for x in found), strict=True)}
        want = {(p, n): sum(w for t, w in row.items() if t in ts) for p, ts in enumerate(map(set, passages)) for n, row in enumerate(weights)}
        want = {k: s for k, s in want.items() if s >= 1 - 1e-9}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_secrets(spark, docs):
    import re

    rows = run(spark, "op1_")
    got = {(r["doc_id"], r["value_sha256"]) for r in rows if r["is_secret"]}
    planted = {(i, hashlib.sha256(m.encode()).hexdigest()) for i, t, _ in docs for m in re.findall(r'token = "([0-9a-f]{40})"', t)}
    assert planted <= got
    text = {i: t for i, t, _ in docs}
    for r in rows:
        value = text[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert hashlib.sha256(value.encode()).hexdigest() == r["value_sha256"]
        assert not (value.isdigit() and r["is_secret"])


def test_pipeline(spark, docs):
    import corpus_pipeline as P
    from quarry.llm import bpe, quality
    import public_tokenizers

    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "decontamination", "encode"]
    out = frame
    for name, stage in P.STAGES[:-1]:
        before, out = out, stage(spark, out, DATA)
        assert out.columns == frame.columns and out.dtypes == frame.dtypes
        out = spark.createDataFrame(out.collect(), frame.schema)
        if name == "near_duplicates":
            want = components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name == "line_dedup":
            assert out.count() == before.count()
    last = {r["doc_id"]: list(r["ids"]) for r in P.run(spark, DATA).collect()}
    codec = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(last) == set(texts)
    import numpy as np

    assert all(codec.decode(np.array(ids, "<u4").tobytes()).decode() == texts[i] for i, ids in last.items())
