"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: the results the docstrings define."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, cuckoo, decontam, jaccard, linededup, quality, secrets, sharding, topk, urlrules

LONG = "x" * 300_000 + " " + "word " * 60_000


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


def odd(spark):
    return docs(spark, [(1, None), (2, ""), (None, "a b c d"), (3, LONG), (3, LONG), (4, "a b c d"), (5, "  \n\t"), (6, "é" * 50)])


# --- 1 ---


def test_secret_candidates(spark):
    value = hashlib.sha1(b"x").hexdigest()
    rows = [(1, None), (2, ""), (3, f'a token = "{value}" b "{value}"'), (3, f'a token = "{value}" b "{value}"'), (4, "card 2669109448945250 ok"), (5, f'password: "hunter2hunter" z'), (None, f"key={value}"), (6, LONG)]
    got = secrets.scan(docs(spark, rows, "").withColumn("value", F.lit(1)).withColumn("votes", F.lit("x"))).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["start"], r["value"], r["is_secret"]))
    assert sorted(x[:2] for x in by[3]) == sorted([(11, value), (11 + 40 + 5, value)] * 2) and all(x[2] for x in by[3] if x[0] == 11)
    assert by[4] == [(5, "2669109448945250", False)]
    assert by[5] == [(11, "hunter2hunter", True)] and by[None] == [(4, value, True)]
    assert 1 not in by and 2 not in by and 6 not in by
    assert secrets.scan(docs(spark, [])).count() == 0


# Text, and what is found in it: each value and whether it is a secret (None: either).
FOUND = [
    ('{"password":"hunter2abc!"}', [("hunter2abc!", True)]),
    ('{"user":"bob","password":"Tr0ub4dor&3"}', [("Tr0ub4dor&3", True)]),
    ('{"id":"a1b2c3d4e5f6a7b8c9d0","password":"s3cr3t!pw"}', [("a1b2c3d4e5f6a7b8c9d0", False), ("s3cr3t!pw", True)]),
    ('{"password":"password","token":"password","secret":"é!hunter2"}', [("password", False), ("password", False), ("é!hunter2", None)]),
    ('user     = "bob"\npassword            =   "hunter2abc"\n  é  token\t\t: \'s3cr3t!pw\'', [("hunter2abc", True), ("s3cr3t!pw", True)]),
    ('password ="hunter2abc" secret= "s3cr3t!pw"', [("hunter2abc", True), ("s3cr3t!pw", True)]),
    ('token = "x!a1b2c3d4e5f6a7b8c9d0"', [("x!a1b2c3d4e5f6a7b8c9d0", True)]),
    ('the key is here: nothing "quoted words" for it', []),
    ("API_KEY=abcdef0123456789abcdef01", [("abcdef0123456789abcdef01", True)]),
    ("token=ghp_16C7e42F292c6912E7710c838347Ae178B4a", [("ghp_16C7e42F292c6912E7710c838347Ae178B4a", True)]),
    ('password: "correct-horse!battery"', [("correct-horse!battery", True)]),
    ("password=hunter2 and more", [("hunter2", True)]),
    ('password="abc123abc123abc123!xyz"', [("abc123abc123abc123!xyz", True)]),
    ("Authorization: Bearer abcDEF1234567890xyz", [("abcDEF1234567890xyz", True)]),
    ("commit 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567", [("0a1b2c3d4e5f60718293a4b5c6d7e8f901234567", False)]),
    ("monkey: banana, turkey=2", []),
    ("password: required", [("required", False)]),
    ("password = ${DB_PASSWORD}", [("${DB_PASSWORD", False)]),
    ("-----BEGIN RSA PRIVATE KEY-----\nMIIEowIBAAKCAQEA\nx+/1\n-----END RSA PRIVATE KEY-----", [("-----BEGIN RSA PRIVATE KEY-----\nMIIEowIBAAKCAQEA\nx+/1\n-----END RSA PRIVATE KEY-----", True)]),
]


def test_all_assigned_values_of_a_text(spark):
    got = {}
    for r in secrets.scan(docs(spark, [(i, t) for i, (t, _) in enumerate(FOUND)])).collect():
        assert FOUND[r["doc_id"]][0][r["start"] :].startswith(r["value"])
        got.setdefault(r["doc_id"], []).append((r["start"], r["value"], r["is_secret"]))
    for i, (text, want) in enumerate(FOUND):
        found = sorted(got.get(i, []))
        assert [v for _, v, _ in found] == [v for v, _ in want], text
        assert all(told is None or is_ == told for (_, _, is_), (_, told) in zip(found, want, strict=True)), (text, found)


def brute_candidates(text):
    """The candidates of a text by looking at every place from left to right."""
    import re

    word = lambda c: c.isascii() and (c.isalnum() or c in "_.-")
    run_class = lambda c: c.isascii() and (c.isalnum() or c in "+/_-")
    long_names = re.compile("token|secret|password|passwd|passphrase|apikey|credential|private|signature", re.I)
    parts = re.compile("(?<![A-Za-z])(?:key|pwd|auth|access)", re.I)
    humps = re.compile("(?<=[a-z])(?:Key|Pwd|Auth|Access)")
    out, at = [], 0
    while at < len(text):
        m = re.match("-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", text[at:])
        if m:
            out.append((at, m[0]))
            at += m.end()
            continue
        if word(text[at]) and not (at and word(text[at - 1])):
            end = at
            while end < len(text) and word(text[end]):
                end += 1
            name = text[at:end]
            if long_names.search(name) or parts.search(name) or humps.search(name):
                m = re.match("[\"'`]?[ \t]*(?::=|=>|[:=])[ \t]*(?:(?:bearer|basic)[ \t]+)?", text[end:], re.I)
                if m:
                    begin = end + m.end()
                    q = re.match("\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`", text[begin:])
                    v = re.match("[^ \t\n\x0b\f\r\"'`,;)}\\]]+", text[begin:])
                    if q:
                        out.append((begin + 1, q[0][1:-1]))
                        at = begin + q.end()
                        continue
                    if v:
                        out.append((begin, v[0]))
                        at = begin + v.end()
                        continue
        if run_class(text[at]) and not (at and run_class(text[at - 1])):
            end = at
            while end < len(text) and run_class(text[end]):
                end += 1
            run = text[at:end]
            if len(run) >= 16 and (re.search("[0-9]", run) or re.search("[a-z].*[A-Z]", run)):
                more = re.match("={0,2}", text[end:]).end()
                out.append((at, text[at : end + more]))
                at = end + more
                continue
        at += 1
    return out


def test_candidates_against_brute_force(spark):
    import random

    rng = random.Random(17)
    pieces = ["password", "token", "my_key", "apiKey", "monkey", "x", "é", "=", ": ", ":=", '"', "'", " ", "\n", "\t", "a1b2c3d4e5f6a7b8", "Zz9/+_-", "camelCaseWordsHere", "alllowercaseletters", "==", ",", "{", "}", ".", "Bearer ", "-----BEGIN PRIVATE KEY-----", "ab\ncd", "-----END PRIVATE KEY-----", "hunter2", "secret-"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    got = {}
    for r in secrets.candidates(docs(spark, list(enumerate(texts)))).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["value"]))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_candidates(text), repr(text)


def test_many_candidates_in_one_text(spark):
    text = " ".join(f'é token = "{k:040x}"' for k in range(16_000))
    rows = secrets.candidates(docs(spark, [(1, text)])).select("start", "value").collect()
    assert len(rows) == 16_000 and all(text[r["start"] : r["start"] + 40] == r["value"] for r in rows)


def test_precision_and_recall_by_shape(spark):
    """Findings of other draws than those that the forest is trained on."""
    votes = secrets.train(secrets.labelled_findings(spark))
    fresh = secrets.labelled_findings(spark, 2000, "held out").withColumn("doc_id", F.xxhash64("text", "value", "path"))
    told = secrets.extracted(fresh).withColumn("votes", F.expr(votes)).join(fresh.select("doc_id", "shape").distinct(), "doc_id")
    rows = told.groupBy("shape", "label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("votes") >= 0.5).cast("int")).alias("share")).collect()
    assert sum(r["n"] for r in rows) >= 0.98 * fresh.select("doc_id").distinct().count()
    assert all(r["share"] >= 0.9 if r["label"] else r["share"] <= 0.1 for r in rows), rows


def test_forest_expression_agrees_with_the_forest(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.extracted(secrets.labelled_findings(spark, 400)).orderBy("doc_id", "start"))
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(rows.select("features", "label"))
    told = rows.withColumn("votes", F.expr(secrets.forest_expression(model.toDebugString)))
    trees = [t.transform(rows.select("features", "label")) for t in model.trees]
    votes = [sum(x) / 5 for x in zip(*[[r["prediction"] for r in t.select("prediction").collect()] for t in trees], strict=True)]
    assert [r["votes"] for r in told.select("votes").collect()] == pytest.approx(votes)


# --- 2 ---


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0]), (None, [9.0, 9.0]), (8, []), (100, [-1.0, 0.25]), (2, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    s = 1024 * 1024 + 512 * 512
    assert sorted(got[0]) == [(1, 1, s), (2, 2, s), (3, 100, -1024 * 1024 + 256 * 512)]
    assert [x[1] for x in sorted(got[100])] == [0, 1, 2]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [9.0, 0.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (1, [8.0, 9.0]), (2, [3.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=4, scale=1).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == [(1, 1, 9), (2, 1, 8), (3, 2, 3), (4, 1, 2)]
    assert sorted(got[100]) == [(1, 1, 9), (2, 1, 5), (3, 0, 0), (4, 0, 0)]


def test_top_k_random_with_large_numbers(spark):
    rng = np.random.default_rng(3)
    for scale, n in ((1.0, 700), (1e5, 120)):
        v = (rng.standard_normal((n, 9)) * scale).astype(np.float32)
        v[: n // 4] = v[0]
        df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
        w = [[int(np.floor(np.float64(x) * 1024)) for x in row] for row in v]
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), k=5).collect()}
        for q in range(0, n, 10):
            best = sorted((-sum(a * b for a, b in zip(w[q], w[c], strict=True)), c) for c in range(n) if c != q)[:5]
            assert [got[q, k] for k in range(1, 6)] == [(c, -s) for s, c in best]


# --- 3 ---


def test_chat_round_trip(spark):
    hard = ["", None, "</turn>", "\\</turn>", "\\\\<next>", "a\n</turn>\n<turn>user\nx", "\\", "\n<next>\n", "<turn>", "x" * 5000, "é🙂\\<turn>"]
    rows = [(c, t, role, text) for c, role in ((1, "user"), (2, "assistant"), (3, None), (4, "a\nb\\n\\")) for t, text in enumerate(hard)]
    rows += [(5, t, "assistant" if t % 3 else "user", x) for t, x in enumerate(hard)] + [(5, 0, "user", ""), (None, None, "user", "z"), (None, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        assert [(x["role"], x["text"]) for x in got[c]["t"]] == [(role, text) for _, _, role, text in own]
        assert got[c]["loss"] == "".join(text for _, _, role, text in own if role == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_many_turns_in_one_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"é{t}") for t in range(20_000)]
    r = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == [f"é{t}" for t in range(1, 20_000, 2)]


# --- 4 ---


def tokenizer():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_bpe_edges(spark):
    df = odd(spark).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    out = bpe.decode(bpe.encode(df, *tokenizer()), *tokenizer()).collect()
    assert len(out) == 8
    for r in out:
        assert bytes(r["decoded"]).decode() == (r["text"] or "") and r["n_tokens"] == len(r["ids"])
    assert bpe.encode(odd(spark).limit(0), *tokenizer()).count() == 0
    assert bpe.digests(odd(spark), *tokenizer()).where("doc_id = 1").first()["n_tokens"] == 0


def test_merge_replay_orders_by_rank():
    tiktoken = pytest.importorskip("tiktoken")
    import random

    ranks = {bytes([b]): b for b in range(256)}
    # Ranks under which a merge brings up a lower one, and tokens that split in several ways.
    for n, t in enumerate([b"aba", b"abab", b"ab", b"ba", b"aa", b"bb", b"aab", b"baa", b"abc", b"bc", b"cab", b"ca", b"aaaa", b"bcab"]):
        ranks[t] = 256 + n
    enc = tiktoken.Encoding("t", pat_str=r"[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
    random.seed(5)
    words = ["".join(random.choice("abc") for _ in range(random.randint(1, 40))) for _ in range(3000)]
    got = bpe.MergeReplay(ranks).encode_words([w.encode() for w in words])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [enc.encode_ordinary(w) for w in words]


def test_words_of_the_corpus(spark, monkeypatch):
    """Counts are those of the whole corpus, the table holds its most frequent words, and ids do not depend on it."""
    import regex
    from collections import Counter

    path, pattern = tokenizer()
    texts = [" ".join("w" + "abcdefg"[k % 7] * 3 + "hijklmnopqr"[k % 11] * 3 for k in range(n)) for n in range(60)] + ["y" * 500 + " zzq", None]
    df = docs(spark, list(enumerate(texts)))
    codec = bpe._sharing(spark, path, pattern)
    got = {r["word"]: r["n"] for r in bpe.word_counts(df.select("text"), codec).collect()}
    ranks = bpe.load_ranks(open(path, "rb").read())
    want = Counter(w for t in texts for w in regex.findall(pattern, t or ""))
    assert got == {w: n for w, n in want.items() if w.encode() not in ranks and len(w) <= bpe.WORD_BYTES} and "y" * 500 not in got
    whole = sorted(map(tuple, bpe.digests(df, path, pattern).collect()))
    monkeypatch.setattr(bpe, "TABLE_WORDS", 30)
    monkeypatch.setattr(bpe, "COUNTED", 2)
    held = set(bpe._table(df, "text", codec).value[0])
    of = lambda w: int(np.floor(np.log2(got[w]) * 16))
    assert 0 < len(held) <= 30 and min(map(of, held)) >= max(of(w) for w in got if w not in held)
    assert sorted(map(tuple, bpe.digests(df, path, pattern).collect())) == whole


# --- 5 ---


def brute_lines(rows, min_docs=5, min_chars=40):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if not (len(held.get(key(x), [])) >= min_docs and i != max(held[key(x)]))]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out)


def lined(n):
    shared = ["Shared line " + c * 40 for c in "abc"]
    return [(i, "\n".join([f"own line number {i} " + "z" * 30, " \t" + shared[i % 3].upper() + "\r", "short", "é" * 39, "", shared[0]])) for i in range(n)]


def test_lines_and_undo(spark):
    rows = lined(24) + [(100, None), (101, ""), (102, LONG)]
    df = docs(spark, rows).withColumn("n_lines", F.lit("clash"))
    state = linededup.LineDedup(spark).insert(df.where("doc_id < 12")).insert(df.where("doc_id >= 12"))
    tell = lambda out: sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect())
    assert tell(state.dedup(df)) == brute_lines(rows)
    assert tell(linededup.dedup_lines(df)) == brute_lines(rows)
    # Taken out again, down to below the threshold: as if they had never been there.
    gone = [23, 22, 21] + list(range(10))
    state.delete(docs(spark, [(i, "") for i in gone]).select("doc_id"))
    left = [r for r in rows if r[0] not in gone]
    assert tell(state.dedup(df.where(~F.col("doc_id").isin(gone)))) == brute_lines(left)
    state.insert(df.where(F.col("doc_id").isin(gone)))
    assert tell(state.dedup(df)) == brute_lines(rows)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_repeated_ids(spark):
    line = "one line that is long enough to be counted here"
    rows = [(1, line)] * 5 + [(2, line + "\nother")]
    tell = lambda out: sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect())
    assert tell(linededup.dedup_lines(docs(spark, rows))) == brute_lines(rows)
    rows += [(3, line), (4, line), (4, line.upper()), (5, line), (5, "x")]
    assert tell(linededup.dedup_lines(docs(spark, rows))) == brute_lines(rows)
    # Rows without an id are one document.
    assert sum(r["n_dropped"] for r in linededup.dedup_lines(docs(spark, [(None, line)] * 9 + [(1, line)] * 3)).collect()) == 0


def test_lines_state_is_opened_again(spark, monkeypatch):
    monkeypatch.setattr(linededup, "GENERATIONS", 2)
    rows = lined(30)
    df = docs(spark, rows)
    tell = lambda out: sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect())
    path = linededup.LineDedup(spark).insert(df.where("doc_id < 10")).path
    for at in range(10, 30, 5):  # more changes than are read side by side
        linededup.LineDedup.open(spark, path).insert(df.where(f"doc_id >= {at} and doc_id < {at + 5}"))
    linededup.LineDedup.open(spark, path).delete(df.where("doc_id > 24").select("doc_id"))
    state = linededup.LineDedup.open(spark, path)
    assert len(state.changes) <= linededup.GENERATIONS + 1
    assert tell(state.dedup(df.where("doc_id <= 24"))) == brute_lines([r for r in rows if r[0] <= 24])
    assert {r["refs"] for r in state.repeated().collect()} == {r["refs"] for r in linededup.LineDedup(spark).insert(df.where("doc_id <= 24")).repeated().collect()}


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    f = cuckoo.build(x)
    assert f.contains(x).all()
    assert f.contains(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 0.001
    f.delete(x[:10_000])
    assert f.contains(x[10_000:]).all() and f.contains(x[:10_000]).mean() < 0.01
    g = cuckoo.CuckooFilter.loads(f.dumps())
    assert (g.table == f.table).all()
    with pytest.raises(KeyError):
        cuckoo.CuckooFilter.sized(8).delete(x[:1])


# --- 6 ---


def test_jaccard_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (9, "A b"), (4, "a B"), (5, "a b c"), (6, "c b a"), (7, LONG), (8, LONG + " end"), (8, LONG + " end"), (None, "a b")]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs(spark, rows).withColumn("component_id", F.lit(1)), 3, 90).collect()), key=repr)
    assert sorted(got, key=repr) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (9, 1, 4), (4, 1, 4), (5, 1, 5), (6, 1, 6), (7, 2, 7), (8, 3, 8), (8, 3, 8), (None, 1, 4)], key=repr)
    assert jaccard.jaccard_components(docs(spark, []), 3, 90).count() == 0


@pytest.mark.parametrize(("width", "top", "shingles", "pivots"), [(3, 90, 4_000_000, 64), (1, 60, 4_000_000, 64), (2, 80, 120, 6)])
def test_jaccard_families(spark, width, top, shingles, pivots):
    from test_brute import components

    import random

    random.seed(width * top)
    rows, n = [], 0
    for _ in range(8):  # families of edited copies, chains included
        base = [random.choice("abcdefghij") + random.choice("klmnopq") for _ in range(random.randint(1, 60))]
        for _ in range(random.randint(1, 10)):
            rows.append((n, " ".join(base)))
            n += 1
            for _ in range(random.randint(0, 2)):
                base[random.randrange(len(base))] = random.choice("rstuvw")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, rows), width, top, group_shingles=shingles, pivots=pivots).collect()}
    assert got == components(rows, width, top)


@pytest.mark.parametrize("shingles", [4_000_000, 120])
def test_jaccard_ids_with_several_texts(spark, shingles):
    from test_brute import components

    import random

    random.seed(5)
    texts = []
    for _ in range(12):
        base = [random.choice("abcdefghij") + random.choice("klmnopq") for _ in range(40)]
        for _ in range(6):
            texts.append(" ".join(base))
            base[random.randrange(40)] = random.choice("rstuvw")
    # Texts of different families share their ids.
    ids = [random.randrange(18) for _ in texts]
    own = components(list(enumerate(texts)), 2, 80)
    least = {}
    for i, (_, c) in own.items():
        least[c] = min(least.get(c, 99), ids[i])
    got = jaccard.jaccard_components(docs(spark, list(zip(ids, texts, strict=True))), 2, 80, group_shingles=shingles, pivots=6).collect()
    assert sorted(map(tuple, got)) == sorted((ids[i], n, least[c]) for i, (n, c) in own.items())


def test_voronoi_regions_are_exact(spark, monkeypatch):
    """One group of many families: regions are parted by windows, joined again by themselves, and miss no link."""
    import random

    rng = random.Random(31)
    m = jaccard.Measure(1, 80, 100)
    sets, n = [], 0
    for family in range(30):
        base = {family * 1000 + rng.randrange(300) for _ in range(rng.randint(5, 80))}
        for _ in range(rng.randint(1, 25)):
            sets.append((n, np.array(sorted(base), np.uint64)))
            n += 1
            base = (base - set(rng.sample(sorted(base), min(len(base) - 1, rng.randint(0, 3))))) | {family * 1000 + rng.randrange(300) for _ in range(rng.randint(0, 3))}
    own = {}
    for i, s in sets:  # equal sets are one point
        own.setdefault(s.tobytes(), i)
    points = [(i, np.frombuffer(s, np.uint64)) for s, i in own.items()]
    parent = {i: i for i, _ in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in points:
        for b, y in points:
            if a < b and m.linked(len(np.intersect1d(x, y)), len(x), len(y)):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    frame = spark.createDataFrame([(1, hashlib.md5(s.tobytes()).digest(), i, s.tobytes()) for i, s in points], "root bigint, digest binary, rep bigint, hashes binary")
    seen = []
    plain = jaccard._to_pivots

    def watched(rows, chosen, m):
        out = plain(rows, chosen, m)
        seen.append((rows.select("region").distinct().count(), out.where("n_windows = 1").count()))
        return out

    monkeypatch.setattr(jaccard, "_to_pivots", watched)
    got = {r["digest"]: r["component_id"] for r in jaccard._settle_large(frame, m, 900, 12).collect()}
    assert {i: got[hashlib.md5(s.tobytes()).digest()] for i, s in points} == {i: find(i) for i, _ in points}
    assert seen[0][0] == 1 and max(x for x, _ in seen) > 1 and sum(x for _, x in seen) > len(points) / 2, seen


def test_shingles_of_many_words(spark):
    words = [f"w{k}" for k in range(40)]
    turned = words[:]
    turned[1], turned[17] = turned[17], turned[1]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs(spark, [(1, " ".join(words)), (2, " ".join(turned))]), 40, 100).collect()}
    assert got == {1: 1, 2: 2}


# --- 7 ---


def test_quality_edges(spark):
    df = odd(spark).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(df, quality.train(df, none)).collect()} == {0.5}
    both = spark.createDataFrame([(4, 0), (4, 1), (6, None), (3, 5)], "doc_id long, quality int")
    assert quality.train(df, both).prior == 0.5
    rows = [(i, ("good words here " * 20) if i % 2 else ("### !!! ### " * 20)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(docs(spark, rows), labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, [*rows, (99, None), (98, "")]), model).collect()}
    assert min(got[i] for i in range(1, 40, 2)) > 0.7 > max(got[i] for i in range(0, 40, 2))
    assert got[98] == got[99] == model.prior
    assert quality.contract(docs(spark, []), none).count() == 0


def test_quality_learns_from_whole_texts(spark):
    # All texts open alike, for more than 8,000 characters; only what follows tells good from bad.
    opening = "the same opening of each text goes on and on " * 200
    good, bad = "careful words that explain the matter well ", "$$$ click !!! win >>> now ### free "
    rows = [(i, opening + f"{i} " + (good if i % 2 else bad) * 300) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs(spark, rows), labels)
    assert b"explain the matter" in model.good and b"click !!! win" in model.bad
    assert max(len(model.good), len(model.bad)) <= quality.DICTIONARY
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, rows), model).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > 0.7 > max(got[i] for i in range(0, 60, 2))


# --- 8 ---


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://", "", "", None, "allow"),
        ("http://A.Example.COM/en/70?x", "a.example.com", "/en/70", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://example.com/EN/8", "example.com", "/EN/8", None, "allow"),
        ("http://x.net/de/1#f", "x.net", "/de/1", "net/de/", "allow"), ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        ("http://a.org/es/", "a.org", "/es/", "org/es/", "block"), ("http://a.org/es", "a.org", "/es", None, "allow"),
        ("http://www.cheap-pills.test/x", "www.cheap-pills.test", "/x", None, "block"), ("http://spam-farm.example.net/de/1", "spam-farm.example.net", "/de/1", "net/de/", "allow"),
        ("x://h?q=://com/en/", "h", "", None, "allow"), ("http://com/en/\nx", "com", "/en/\nx", "com/en/", "block"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")
    r = urlrules.judge(df, urlrules.contract_rules() + urlrules.default_patterns()).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_url_rules_in_blocks(spark, monkeypatch):
    rules = [urlrules.host_rule(f"h{n}.test", f"/p{n % 7}/", "block") for n in range(200)] + [urlrules.host_rule("test", "/p3/", "allow")]
    df = spark.createDataFrame([(n, f"http://www.h{n}.test/p3/x") for n in range(200)], "page_id long, url string")
    tell = lambda: sorted(map(tuple, urlrules.judge(df, rules).select("page_id", "rule", "verdict").collect()))
    whole = tell()
    monkeypatch.setattr(urlrules, "BLOCK_CHARS", 6000)
    assert tell() == whole and sum(v == "block" for *_, v in whole) == sum(n % 7 == 3 for n in range(200))
    assert urlrules.judge(df.limit(0), rules).count() == 0


def test_random_rules_against_brute_force(spark):
    import random

    rng = random.Random(23)
    words = ["a", "bb", "free", "casino", "x1", "é"]
    label = lambda: rng.choice([rng.choice(words), "-".join(rng.choice(words) for _ in range(2))])
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n))) + "." + rng.choice(["com", "net"])
    path = lambda: "/" + "/".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
    given = sorted({(host(2), path(), rng.choice(["block", "allow"])) for _ in range(300)})
    given = [g for n, g in enumerate(given) if not any(g[:2] == h[:2] for h in given[:n])]
    pairs = [(a, b) for a in words[:5] for b in words[:5]]
    rules = [urlrules.host_rule(*g) for g in given] + [urlrules.pattern_rule(f"{a} {b}", rf"(?:[^/?#]*\.)?{a}-{b}\.", (a, b)) for a, b in pairs]
    urls = [rng.choice(["http://", "x://", ""]) + rng.choice([str.upper, str])(host(4)) + path() + rng.choice(["", "?q=/a", "#f"]) for _ in range(800)]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["page_id"]: (r["rule"], r["pattern"], r["verdict"]) for r in urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    blocked = 0
    for n, url in enumerate(urls):
        rest = url.split("://", 1)[1] if "://" in url else ""
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        h, p = rest[:at].translate(lower), rest[at:].split("?")[0].split("#")[0]
        fits = [(len(x + y), x + y, v) for x, y, v in given if (h == x or h.endswith("." + x)) and p.startswith(y)]
        spam = min((f"{a} {b}" for a, b in pairs if f"{a}-{b}" in h.split(".")[:-1]), default=None)
        best = max(fits, default=None)
        assert got[n] == (best and best[1], spam, best[2] if best else "block" if spam else "allow"), url
        blocked += got[n][2] == "block"
    assert 50 < blocked < 750


# --- 9 ---


def test_sharding_edges(spark):
    df = odd(spark).withColumn("shard", F.lit("clash"))
    out = sharding.shard_by_bytes(df, 3, range_bytes=1 << 10).collect()
    assert len(out) == 8 and {r["size"] for r in out if r["doc_id"] == 1} == {8} and {r["text_crc32"] for r in out if r["doc_id"] == 1} == {0}
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(docs(spark, []), 24).count() == 0


def test_sharding_splits_a_hot_group(spark):
    rows = [(i, "same text" if i < 600 else f"text {i}") for i in range(1200)]
    out = sharding.shard_by_bytes(docs(spark, rows), 24, range_bytes=100).collect()
    size = {}
    for r in out:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert len(size) == 24 and max(size.values()) - min(size.values()) <= 40
    for s in size:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


# --- 10 ---


def test_leak_edges(spark):
    item = "The quick brown fox jumps over the lazy dog near the river. It was a sunny day."
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "two words"), (5, "Entirely other words that nobody ever writes down anywhere. Never once so far.")], "item_id long, text string")
    shouted = item.upper().replace(" ", "!! ")
    rows = [(1, None), (2, ""), (3, LONG), (4, "filler " * 300 + item + " more" * 500), (5, shouted), (6, item[:30]), (7, "the " * 2000), (None, item), (4, item), (8, "two words")]
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.leaked_pairs(docs(spark, rows).withColumn("leaks", F.lit(1)), items).collect()), key=repr)
    assert got == sorted([(4, 1), (4, 1), (4, 1), (4, 1), (5, 1), (5, 1), (None, 1), (None, 1), (8, 4)], key=repr)
    assert decontam.leaked_pairs(docs(spark, rows), items.limit(0)).count() == 0
    assert decontam.leaked_pairs(docs(spark, []), items).count() == 0


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "Capital of France? Paris."), (2, "日本で一番高い山は何ですか。富士山です。"), (3, "ประเทศไทยมีกี่จังหวัด เจ็ดสิบเจ็ด"), (4, "ok yes"), (5, "word " * 3000 + "at last. The end of it.")]
    rows = [(1, "so: capital of france, Paris, it is"), (2, "Paris is the capital of a France"), (3, "前置き。日本で一番高い山は何ですか。富士山です。後書き"), (4, "山は高い。日本の富士。何ですか"), (5, "x ประเทศไทยมีกี่จังหวัด เจ็ดสิบเจ็ด y"), (6, "yes ok"), (7, "filler " * 700 + " ok, YES! " + "filler " * 900), (8, "so " + "word " * 3000 + "at last. The end of it.")]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaked_pairs(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (7, 4), (8, 5)}


def test_leaks_in_parts(spark, monkeypatch):
    items = spark.createDataFrame([(n, f"item {n} asks about thing{n} and place{n} near spot{n}. The answer is word{n} number{n}.") for n in range(60)], "item_id long, text string")
    rows = docs(spark, [(n, f"before item {n} asks about thing{n} and place{n} near spot{n}. The answer is word{n} number{n}. after") for n in range(60)])
    want = {(n, n) for n in range(60)}
    tell = lambda: {(r["doc_id"], r["item_id"]) for r in decontam.leaked_pairs(rows, items).collect()}
    assert tell() == want
    monkeypatch.setattr(decontam, "PART_CHARS", 1000)
    assert tell() == want
